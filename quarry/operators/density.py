"""Clusters by density: the exact hierarchy of mutual reachability, condensed, and the most stable of its clusters.

The distance of two points counts as no less than either's core distance, that to its min_samples-th
neighbour, itself included. Three steps, each as rows and joins:

1. spanning_tree(): Boruvka's rounds. Each component takes its least outgoing edge; the neighbour
   lists settle most, and only points whose lists can't are compared, in blocks, with all rows; products
   in single precision rule out, by bounds of their rounding, what can't be under the least edge that is
   known. The largest component need not be searched.
2. chains(): the tree is contracted again by the least edge of each vertex, at most log2(n) times.
   What merges with one vertex of a level, in order of distance, is a chain: each of its rows adds
   the whole of a lower chain. So a component's size at any distance is a running sum along a chain,
   however tall the hierarchy is, and no group meets in one task.
3. hdbscan(): where both sides of a merge have min_cluster_size points, clusters begin; smaller sides
   leave the cluster that they meet. Of a cluster and those that it splits into, those are chosen
   whose points stay over the greater span of 1 / distance (excess of mass); the root never is.

Merges at equal distances follow each other in the order of their points' keys; where many are equal,
libraries that take them in another order may draw a border elsewhere. Of distances under LEAST_DISTANCE, as
between equal points, the reciprocal is that of LEAST_DISTANCE. Rows with a null key or vector are
left out, of rows that repeat a key one stays. Vectors must be of one length; entries that aren't
finite count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ._tables import attach, cut, is_small, light, running, tidied
from .clusters import NOISE
from .similarity import QUERY_BLOCK, ROW_BLOCK, TILE, candidates, halves, knn, pieces, slack, squared_distances

NEIGHBOURS = 15
LEAST_DISTANCE = 1e-12
#: Clusters of at most so many rows are chosen in one task; more take a round for each height of their tree.
CLUSTERS_AT_ONCE = 1 << 17


def cores(near: DataFrame, points: DataFrame, min_samples: int) -> DataFrame:
    """Rows (p, core, known): the core distance, and the least distance that an unlisted point can have."""
    listed = near.groupBy("u").agg(F.max(F.when(F.col("rank") < min_samples, F.col("d"))).alias("core"), F.max("d").alias("far"), F.count("*").alias("n"))
    most = near.agg(F.max("rank").alias("k")).first()["k"] or 0
    few = F.col("n") < most  # an incomplete list holds all there are
    return points.join(listed.withColumnRenamed("u", "p"), "p", "left").select("p", "v", F.coalesce("core", F.lit(0.0)).alias("core"), F.when(F.col("n").isNull() | few, float("inf")).otherwise(F.greatest("core", "far")).alias("known"))


#: Columns of points in blocks, beside their ids and vectors: component, core distance and, of those that ask, the least edge that their component has so far.
BESIDE = (("c", "<i8"), ("core", "<f8"), ("best", "<f8"))


def _least(q: list[np.ndarray], x: list[np.ndarray], single: np.ndarray) -> pa.RecordBatch | None:
    """Of blocks (ids, c, core, best, vectors) that ask and of rows, the least edge of each component that asks to a row of another, if it is none above best."""
    asks, length, far = halves(q[4], True), np.sqrt((q[4] * q[4]).sum(axis=1)), np.sqrt((x[4] * x[4]).sum(axis=1))
    best, found = q[3].copy(), []
    for at in range(0, len(x[0]), TILE[1]):
        rows = [c[at : at + TILE[1]] for c in x]
        off, some = slack(length, far[at : at + TILE[1]], q[4].shape[1]), None
        if off is not None and np.isfinite(best).all():
            some = candidates(asks, single[at : at + TILE[1]], (length**2 - best**2) / 2 - off)
        if some is None:
            near = np.maximum(np.maximum(np.sqrt(squared_distances(q[4], rows[4])), q[2][:, None]), rows[2][None, :])
            near[q[1][:, None] == rows[1][None, :]] = np.inf
            least = np.minimum(near.min(axis=1), best)
            some = np.nonzero((near <= (least + 1e-6 * (1 + least))[:, None]) & np.isfinite(near))
        i, j = some
        other = q[1][i] != rows[1][j]
        i, j = i[other], j[other]
        for a in range(0, len(i), 65536):
            u, v = i[a : a + 65536], j[a : a + 65536]
            exact = np.maximum(np.maximum(np.sqrt(((q[4][u] - rows[4][v]) ** 2).sum(axis=1)), q[2][u]), rows[2][v])
            keep = exact <= best[u]
            u, v, exact = u[keep], v[keep], exact[keep]
            if len(u):
                found.append((q[1][u], exact, np.minimum(q[0][u], rows[0][v]), np.maximum(q[0][u], rows[0][v])))
                np.minimum.at(best, u, exact)
    if not found:
        return None
    c, w, a, b = (np.concatenate(f) for f in zip(*found, strict=True))
    order = np.lexsort((b, a, w, c))
    first = order[np.concatenate([[True], np.diff(c[order]) > 0])]
    return pa.RecordBatch.from_arrays([pa.array(f[first]) for f in (c, w, a, b)], names=["c", "w", "a", "b"])


def _search(kind: str):
    """Per part: its rows come first and are held, then blocks of points that ask; a row for each block and component leaves it."""

    def opened(batch: pa.RecordBatch, p: int) -> list[np.ndarray]:
        got = [np.frombuffer(batch.column(n)[p].as_buffer(), dtype=t) for n, t in (("ids", "<i8"), *BESIDE)]
        return [*got, np.frombuffer(batch.column("matrix")[p].as_buffer(), dtype=kind).reshape(len(got[0]), -1).astype(np.float64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, x, single = [], None, None
        for batch in batches:
            for p, asks in enumerate(batch.column("asks").to_pylist()):
                if not asks:
                    held.append(opened(batch, p))
                    continue
                if not held:
                    continue
                if x is None:
                    x = [np.concatenate(c) for c in zip(*held, strict=True)]
                    single = halves(x[-1], False)
                least = _least(opened(batch, p), x, single)
                if least is not None:
                    yield least

    return run


def outside(asked: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Rows (c, w, a, b): the least edge to a row of another component of asked points (p, c, core, best, v), exact, if it isn't above best (null: none is known)."""
    spark, kind = rows.sparkSession, "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    parts = max(1, -(-n // ROW_BLOCK), min(spark.sparkContext.defaultParallelism, n // (4 * QUERY_BLOCK)))
    names = ["ids", *(c for c, _ in BESIDE), "matrix"]
    schema = ", ".join(f"{c} binary" for c in names)
    packed = lambda df: df.select(F.col("p").alias("id"), "c", "core", F.coalesce("best", F.lit(float("inf"))).alias("best"), "v").mapInArrow(pieces(kind, QUERY_BLOCK, BESIDE), schema)
    held = packed(rows.withColumn("best", F.lit(0.0))).repartition(parts).select(F.spark_partition_id().alias("part"), F.lit(False).alias("asks"), *names)
    asks = packed(asked).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asks"), *names)
    return held.unionByName(asks).repartitionById(parts, "part").sortWithinPartitions("asks").mapInArrow(_search(kind), "c long, w double, a long, b long")


def roots(points: DataFrame) -> DataFrame:
    """Rows (x, root) of pointers (x, to) without cycles but from a root to itself; reach doubles each round."""
    at = cut(points.select("x", F.col("to").alias("root")))
    while True:
        step = at.select(F.col("x").alias("root"), F.col("root").alias("beyond"))
        once = attach(at, step, ["root"]).select("x", F.col("root").alias("old"), F.col("beyond").alias("root"))
        after = cut(once)
        at = after.select("x", "root")
        if after.filter("root <> old").isEmpty():
            return at


def _pointers(picks: DataFrame) -> DataFrame:
    """Pointers (x, to) of picks (x, w, e, other); of two that pick each other the smaller is a root."""
    back = picks.select(F.col("x").alias("other"), F.col("other").alias("of"))
    mutual = attach(picks, back, ["other"])
    return mutual.select("x", F.when((F.col("of") == F.col("x")) & (F.col("x") < F.col("other")), F.col("x")).otherwise(F.col("other")).alias("to"))


def spanning_tree(points: DataFrame, near: DataFrame) -> DataFrame:
    """Edges (a, b, w) of the minimum spanning tree, by (w, a, b), of points (p, v, core, known) with lists near (u, v, d)."""
    facts = cut(points.select("p", "core", "known"))
    n, of = facts.count(), facts.select("p", "core")
    lists = attach(near.select("u", "v", "d"), of.toDF("v", "cv"), ["v"]).join(light(of.toDF("u", "core")), "u")
    lists = cut(lists.select("u", "v", F.greatest("d", "core", "cv").alias("w")))
    at, found = cut(points.select("p", F.col("p").alias("c"))), []
    edge = F.struct("w", "a", "b")
    while True:
        largest = at.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").first()
        if largest is None or largest["n"] == n:
            break
        from_ = lists.join(light(at.select(F.col("p").alias("u"), "c")), "u")
        from_ = from_ if is_small(at) else cut(from_)
        ends = cut(attach(from_, at.select(F.col("p").alias("v"), F.col("c").alias("cv")), ["v"]).filter("c <> cv"))
        lists = ends.select("u", "v", "w")  # what lies within a component is of no more use
        listed = ends.select("c", "w", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        listed = cut(listed.groupBy("c").agg(F.min(edge).alias("m")).select("c", "m.*"))
        here = facts.join(light(at), "p").join(light(listed.select("c", F.col("w").alias("best"))), "c", "left")
        open_ = cut(here.filter(F.col("known") < F.coalesce("best", F.lit(float("inf")))).select("p", "c", "core", "best"))
        asks = open_.filter(F.col("c") != largest["c"])
        late = not open_.filter(F.col("c") == largest["c"]).isEmpty()
        known = listed.filter(F.col("c") != largest["c"]) if late else listed
        best = known
        if not asks.isEmpty():
            vectors = points.select("p", "v")
            best = known.unionByName(outside(vectors.join(light(asks), "p"), points.select("p", "core", "v").join(light(at), "p"), n))
        picks = cut(best.groupBy("c").agg(F.min(edge).alias("m")).select("c", "m.*"))
        edges = cut(picks.select("a", "b", "w").distinct())
        found.append(edges)
        ends = edges.join(light(at.select(F.col("p").alias("a"), F.col("c").alias("ca"))), "a").join(light(at.select(F.col("p").alias("b"), F.col("c").alias("cb"))), "b")
        both = cut(picks.join(ends, ["a", "b", "w"]).select(F.col("c").alias("x"), F.when(F.col("c") == F.col("ca"), F.col("cb")).otherwise(F.col("ca")).alias("other")))
        over = at.select(F.col("c").alias("x")).distinct().join(light(both.select("x")), "x", "left_anti").withColumn("other", F.col("x"))  # the largest may have picked none
        points_to = cut(both.unionByName(over))
        merged = roots(_pointers(points_to)).select(F.col("x").alias("c"), "root")
        at = cut(attach(at, merged, ["c"]).select("p", F.col("root").alias("c")))
    if not found:
        return points.select(F.col("p").alias("a"), F.col("p").alias("b"), F.lit(0.0).alias("w")).filter(F.lit(False))
    return _together(found)


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return cut(out)


def chains(points: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, ends): rows (level, x, w, e, child_level, child, z, before) of chains (level, x); ends (level, x, total).

    A row adds, at distance w, the z points of the chain (child_level, child); before is how many the
    chain has before it. Chains of level 0 are single points and have no rows. The last level has one
    chain, that of all points.
    """
    left = cut(tree.orderBy("w", "a", "b").select("w", F.monotonically_increasing_id().alias("e"), F.col("a").alias("x"), F.col("b").alias("y")))
    totals = cut(points.select(F.col("p").alias("x"), F.lit(1).cast("long").alias("total")))
    waiting, rows, ends, level = None, [], [totals.select(F.lit(0).alias("level"), "x", "total")], 0
    names = ["x", "w", "e", "child_level", "child", "z"]
    while True:
        incident = left.select("x", "w", "e", F.col("y").alias("other")).unionByName(left.select(F.col("y").alias("x"), "w", "e", F.col("x").alias("other")))
        light = cut(incident.groupBy("x").agg(F.min(F.struct("w", "e", "other")).alias("m")).select("x", "m.*"))
        last = light.isEmpty()
        own = light.select("x", F.col("w").alias("lw"), F.col("e").alias("le"))
        if waiting is not None:  # what is nearer than the vertex's least edge belongs to its chain, the rest goes on
            seen = cut(waiting.withColumns({"lw": F.lit(None).cast("double"), "le": F.lit(None).cast("long")}) if last else attach(waiting, own, ["x"], "left"))
            stays = F.col("lw").isNull() | (F.struct("w", "e") < F.struct("lw", "le"))
            rows.append(seen.filter(stays).select(F.lit(level).alias("level"), *names))
            totals = cut(seen.filter(stays).groupBy("x").agg(F.sum("z").alias("total")))
            ends.append(totals.select(F.lit(level).alias("level"), "x", "total"))
            waiting = seen.filter(~stays).select(*names)
        if last:
            break
        to = roots(_pointers(light))
        fresh = light.join(totals, "x").select("x", "w", "e", F.lit(level).alias("child_level"), F.col("x").alias("child"), F.col("total").alias("z"))
        moving = cut(fresh if waiting is None else fresh.unionByName(waiting))
        waiting = cut(attach(moving, to, ["x"]).select(F.col("root").alias("x"), *names[1:]))
        rest = cut(left.join(light.select("e").distinct(), "e", "left_anti"))
        moved = cut(attach(rest, to, ["x"]).select("w", "e", F.col("root").alias("x"), "y"))
        left = cut(attach(moved, to.select(F.col("x").alias("y"), F.col("root").alias("to")), ["y"]).select("w", "e", "x", F.col("to").alias("y")))
        level += 1
    if not rows:
        return points.select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("x")).limit(0), _together(ends)
    order = [F.col("w"), F.col("e"), F.col("child")]
    placed = running(_together(rows), ["level", "x"], order, sums={"before": F.col("z")})
    return cut(placed), _together(ends)


def _resolved(pairs: DataFrame) -> DataFrame:
    """Rows (level, x, cluster) from (level, x, cluster, to_level, to_x): where cluster is null, that of (to_level, to_x)."""
    at = cut(pairs)
    while not at.filter("cluster is null").isEmpty():
        done = at.filter("cluster is not null").select(F.col("level").alias("to_level"), F.col("x").alias("to_x"), F.col("cluster").alias("got"))
        onward = at.filter("cluster is null").select(F.col("level").alias("to_level"), F.col("x").alias("to_x"), F.col("to_level").alias("next_level"), F.col("to_x").alias("next_x"))
        jumped = at.join(done, ["to_level", "to_x"], "left").join(onward, ["to_level", "to_x"], "left")
        at = cut(jumped.select("level", "x", F.coalesce("cluster", "got").alias("cluster"), F.coalesce("next_level", "to_level").alias("to_level"), F.coalesce("next_x", "to_x").alias("to_x")))
    return at.select("level", "x", "cluster")


def condensed(points: DataFrame, tree: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame] | None:
    """(leaves, clusters): leaves (p, cluster, w), the distance at which a point leaves a cluster; clusters (cluster, w, size, parent, born).

    A cluster is named by the edge that makes it; w is the distance at which it ends, as a split into
    two or with its last points, and born that at which its parent splits (null: the root). None if no
    cluster has min_size points.
    """
    rows, ends = chains(points, tree)
    big, small, active = F.col("z") >= min_size, F.col("z") < min_size, F.col("before") >= min_size
    if "z" not in rows.columns or ends.filter(F.col("total") >= min_size).isEmpty():
        return None
    makes = (active & big) | (~active & small & (F.col("before") + F.col("z") >= min_size))
    takes = ~active & big
    order = [F.col("w"), F.col("e"), F.col("child")]
    # two rows of one edge open a chain, and only the second can make a cluster or take one over from a big first
    state = F.when(makes, F.struct(F.col("e").alias("cluster"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("x"))).when(takes, F.struct(F.lit(None).cast("long").alias("cluster"), F.col("child_level").alias("level"), F.col("child").alias("x")))
    rows = cut(running(rows.withColumn("state", state), ["level", "x"], order, lasts={"was": F.col("state")}))
    tops = rows.filter("state is not null").groupBy("level", "x").agg(F.max_by("state", F.struct("w", "e", "child")).alias("s"))
    tops = _resolved(tops.select("level", "x", "s.cluster", F.col("s.level").alias("to_level"), F.col("s.x").alias("to_x")))
    tops = cut(tops)
    named = tops.select(F.col("level").alias("t_level"), F.col("x").alias("t_x"), F.col("cluster").alias("t_cluster"))

    def with_cluster(df: DataFrame, level: str, x: str, known: str, into: str) -> DataFrame:
        keyed = cut(df.withColumns({"t_level": F.when(F.col(known).isNull(), F.col(level)), "t_x": F.when(F.col(known).isNull(), F.col(x))}))
        return attach(keyed, named, ["t_level", "t_x"], "left").withColumn(into, F.coalesce(known, "t_cluster")).drop("t_level", "t_x", "t_cluster")

    flat = rows.select("*", F.col("was.cluster").alias("wc"), F.col("was.level").alias("wl"), F.col("was.x").alias("wx"), F.lit(None).cast("long").alias("none"))
    before = with_cluster(flat, "wl", "wx", "wc", "here")  # the cluster that a row's chain is in before it
    both = cut(with_cluster(before, "child_level", "child", "none", "there"))  # and that of its child

    merges = both.filter(active & big)
    links = merges.select(F.col("here").alias("cluster"), F.col("e").alias("parent"), F.col("w").alias("born"), F.col("before").alias("size")).unionByName(merges.select(F.col("there").alias("cluster"), F.col("e").alias("parent"), F.col("w").alias("born"), F.col("z").alias("size")))
    made = both.filter(makes).select(F.col("e").alias("cluster"), "w", (F.col("before") + F.col("z")).alias("at_end"), (active & big).alias("splits"))
    total = points.count()
    clusters = made.join(links, "cluster", "left").select("cluster", "w", "at_end", "splits", "parent", "born", F.coalesce("size", F.lit(total)).alias("size"))

    # where a chain first has min_size points: all before leave there, for the cluster that begins or that is met
    starts = both.filter(~active & (F.col("before") + F.col("z") >= min_size)).select("level", "x", F.col("w").alias("sw"), F.when(big, F.col("there")).otherwise(F.col("e")).alias("sc"))
    few = cut(both.filter(small))
    met = attach(few, cut(starts), ["level", "x"], "left")
    fates = cut(met.select(F.col("child_level").alias("level"), F.col("child").alias("x"), F.when(active, F.col("here")).otherwise(F.col("sc")).alias("cluster"), F.when(active, F.col("w")).otherwise(F.col("sw")).alias("w"), F.col("level").alias("to_level"), F.col("x").alias("to_x")))
    while not fates.filter("cluster is null").isEmpty():  # chains that stay small leave as the chain that they are part of does
        up = fates.select(F.col("level").alias("to_level"), F.col("x").alias("to_x"), F.col("cluster").alias("uc"), F.col("w").alias("uw"), F.col("to_level").alias("ul"), F.col("to_x").alias("ux"))
        got = fates.join(up, ["to_level", "to_x"], "left")
        undecided = F.col("cluster").isNull()
        fates = cut(got.select("level", "x", F.coalesce("cluster", "uc").alias("cluster"), F.when(undecided, F.col("uw")).otherwise(F.col("w")).alias("w"), F.when(undecided, F.col("ul")).otherwise(F.col("to_level")).alias("to_level"), F.when(undecided, F.col("ux")).otherwise(F.col("to_x")).alias("to_x")))
    leaves = fates.filter("level = 0").select(F.col("x").alias("p"), "cluster", "w")
    return cut(leaves), cut(clusters)


def _best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, chosen) of clusters (cluster, parent, w, stability): the chosen cluster that each is in, or null; all rows in one task."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    below: dict[int, float] = {}
    wins = set()
    for r in sorted(rows, key=lambda r: (r["w"], r["cluster"])):  # a cluster ends at a smaller distance than its parent, or at an equal one by an earlier edge
        c = r["cluster"]
        if r["parent"] is None:
            continue
        if r["stability"] >= below.get(c, 0.0):
            wins.add(c)
        below[r["parent"]] = below.get(r["parent"], 0.0) + max(r["stability"], below.get(c, 0.0))
    at: dict[int, int | None] = {}
    for r in sorted(rows, key=lambda r: (r["w"], r["cluster"]), reverse=True):
        above = at.get(r["parent"])
        at[r["cluster"]] = above if above is not None else r["cluster"] if r["cluster"] in wins else None
    yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array(list(at.values()), pa.int64())], names=["cluster", "chosen"])


def _best_in_rounds(clusters: DataFrame) -> DataFrame:
    """_best_of() as joins: from the leaves to the root a round for each height, then down by pointers whose reach doubles."""
    best = cut(clusters.select("cluster", "parent", "stability", F.lit(False).alias("settled"), F.lit(False).alias("wins"), F.lit(0.0).alias("value")))
    while not best.filter("not settled").isEmpty():
        below = best.filter("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum("value").alias("below"), F.min("settled").alias("ready"))
        joined, now = best.join(below, "cluster", "left"), ~F.col("settled") & F.coalesce("ready", F.lit(True))
        sub = F.coalesce("below", F.lit(0.0))
        best = cut(joined.select("cluster", "parent", "stability", (F.col("settled") | now).alias("settled"), F.when(now, F.col("parent").isNotNull() & (F.col("stability") >= sub)).otherwise(F.col("wins")).alias("wins"), F.when(now, F.greatest("stability", sub)).otherwise(F.col("value")).alias("value")))
    at = cut(best.select("cluster", F.when(F.col("wins"), F.col("cluster")).alias("chosen"), "parent"))
    while not at.filter("parent is not null").isEmpty():
        up = at.select(F.col("cluster").alias("parent"), F.col("chosen").alias("above"), F.col("parent").alias("beyond"))
        at = cut(attach(at, up, ["parent"], "left").select("cluster", F.coalesce("above", "chosen").alias("chosen"), F.col("beyond").alias("parent")))
    return at.select("cluster", "chosen")


@tidied
def hdbscan(vectors: DataFrame, min_cluster_size: int = 5, min_samples: int = 5, key: str = "vec_id", embedding: str = "embedding", neighbours: int = NEIGHBOURS, clusters_at_once: int = CLUSTERS_AT_ONCE) -> DataFrame:
    """Rows (key, cluster, cluster_probability, outlier_score null): cluster numbers from 0 by size, then smallest key; -1 is noise, with probability 0.

    A table of fewer points than min_cluster_size is noise.
    """
    kind = "float" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.filter(F.col(key).isNotNull() & F.col(embedding).isNotNull()).select(F.col(key).cast("long").alias("p"), V.finite(F.col(embedding)).cast(f"array<{kind}>").alias("v"))
    rows = cut(rows.groupBy("p").agg(F.min("v").alias("v")))
    near = cut(knn(rows, None, max(neighbours, min_samples), "euclidean", "p", "v").select(F.col("query_id").alias("u"), F.col("neighbour_id").alias("v"), (-F.col("score")).alias("d"), "rank"))
    points = cut(cores(near, rows, min_samples))
    found = condensed(points, spanning_tree(points, near), max(2, min_cluster_size))
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    if found is None:
        return points.select(F.col("p").alias(key), F.lit(NOISE).alias("cluster"), F.lit(0.0).alias("cluster_probability"), empty("outlier_score", "double"))
    leaves, clusters = found
    density = lambda w: 1 / F.greatest(w, F.lit(LEAST_DISTANCE))
    born = F.when(F.col("born").isNull(), 0.0).otherwise(density(F.col("born")))
    # differences first, so that a cluster which ends where it begins has a stability of 0, not of what sums are off by
    left = attach(leaves, clusters.select("cluster", "born"), ["cluster"]).groupBy("cluster").agg(F.sum(density(F.col("w")) - born).alias("left"))
    whole = F.coalesce("left", F.lit(0.0)) + F.when(F.col("splits"), F.col("at_end") * (density(F.col("w")) - born)).otherwise(0.0)
    stable = cut(clusters.join(left, "cluster", "left").select("cluster", "parent", "w", whole.alias("stability")))
    if stable.count() <= clusters_at_once:
        chosen = cut(stable.repartition(1).mapInArrow(_best_of, "cluster long, chosen long"))
    else:
        chosen = cut(_best_in_rounds(stable))
    ended = chosen.filter("chosen is not null").join(stable.select(F.col("cluster").alias("chosen"), F.col("w").alias("end")), "chosen")
    member = cut(attach(leaves, cut(ended), ["cluster"]).select("p", "chosen", F.least(F.lit(1.0), F.greatest("end", F.lit(LEAST_DISTANCE)) / F.greatest("w", F.lit(LEAST_DISTANCE))).alias("probability")))
    sizes = member.groupBy("chosen").agg(F.count("*").alias("n"), F.min("p").alias("first"))
    from pyspark.sql import Window

    numbered = cut(sizes.select("chosen", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("cluster")))  # a row per cluster
    labelled = attach(member, numbered, ["chosen"])
    out = points.select("p").join(labelled, "p", "left")
    return out.select(F.col("p").alias(key), F.coalesce("cluster", F.lit(NOISE)).alias("cluster"), F.coalesce("probability", F.lit(0.0)).alias("cluster_probability"), empty("outlier_score", "double"))
