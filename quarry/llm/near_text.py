"""Near-duplicate texts: chosen-path set similarity join over word shingles.

A text's set is its distinct shingles of SHINGLE_WORDS words. TREES independent trees branch the
sets: a node's children are chosen by minwise tokens, that is, a set goes to the child named by
its smallest shingle under the hash function that the path selects. A node of at most NODE_ROWS
sets is compared exhaustively; a larger one branches again, by BRANCHINGS more functions, each of
which gives every member a child, up to DEPTH, past which it is compared whatever its size, as all
pairs of its blocks of BLOCK_ROWS. A pair of similarity s that is in a node that branches is lost
below it with q' = (1 - s (1 - q)) ** 2, where q is the same for the children, 0 at the end. At 0.75
q stays under 1/9, so that ten trees lose a pair with 1e-6 at depth 0 and under 2e-5 at any depth.
As the functions are only SIGNATURE, trees share some; by simulation that makes 1.5e-4 at depth 4.

Equal sets become one before the first tree, and their copies take its component at the end, so that
copies cost nothing. Each round's links only join the components that earlier rounds found. Links are confirmed on
full sets, in three rounds whose candidates grow with the rows and not with their pairs. First, each
set with the nearest one that any of its nodes' blocks holds, and with the nearest of the blocks'
hubs (a hub is nearest to all of its block), as its signature estimates; these two a set are all,
whatever the number of trees. Then every set with the set of its node that has most links. Nodes that still
hold several components, and only these, branch further. Third, within them, every pair of unlike
components that can be a link is checked in the task that holds the node, likeliest first, and
only links that join components leave it. Signatures only sort out pairs whose estimate lies below
ESTIMATE_AT_LEAST, five deviations under the threshold; the lowest byte of each hash is all that
travels for it, which can only raise an estimate. In the third round, a sketch of BINS bins
sorts out those that lie DEVIATIONS under it.

Texts without words have no shingles, no links, and are kept. Shorter texts are one shingle. Rows
that repeat an id with different texts are sets of their own in all comparisons, and then merge
their groups under that id; a null id gets a row without links.
Empty tables give empty results. Extra columns are left out by the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_BYTES, attach, mix, releasing, stash, stashed_bytes, tidied, text_chunks, window_hashes, word_bounds, word_hashes
from .components import components, merged
from .vectors import groups

SHINGLE_WORDS = 5
THRESHOLD = 75
TREES = 10
DEPTH = 4
BRANCHINGS = 2
NODE_ROWS = 4096
BLOCK_ROWS = 1024
SIGNATURE = 64
ESTIMATE_AT_LEAST = 0.48
BINS = 256
DEVIATIONS = 4

_SEEDS = np.random.default_rng(41).integers(1, 1 << 63, size=(2, SIGNATURE), dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, offs: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of all shingles, in order of row; A-Z count as a-z."""
    rows = len(offs) - 1
    starts, ends, row = word_bounds(data, offs)
    h = word_hashes(data, starts, ends, lower=True)
    out = window_hashes(h, n)
    inside = row[: len(out)] == row[n - 1 :] if len(out) else np.zeros(0, dtype=bool)
    out, at = out[inside], row[: len(out)][inside]
    count = np.bincount(row, minlength=rows)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.cumsum(count) - count
        whole = np.array([mix((h[first[r] : first[r] + count[r]] * (2 * np.arange(count[r], dtype=np.uint64) + np.uint64(3))).sum(keepdims=True) + np.uint64(count[r]))[0] for r in short], dtype=np.uint64)
        out, at = np.concatenate([out, whole]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return at, out


def distinct_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, shingles): row k's sorted distinct shingles are shingles[bounds[k]:bounds[k + 1]]."""
    rows = len(offs) - 1
    at, h = shingles(data, offs)
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    at, h = at[first], h[first]
    return np.searchsorted(at, np.arange(rows + 1)), h


@releasing
def _signed(batches):
    """Rows (id, size, s1, s2, sig, low, fine) from (id, text); s1 and s2 identify the set.

    sig has the least value under each hash function, low those values' lowest bytes, fine a byte of the smallest shingle of each bin of shingles, 0 for an empty bin.
    """
    for batch in batches:
        for at, end, data, offs in text_chunks(batch, rows=1024):
            bounds, h = distinct_sets(data, offs)
            n, size = end - at, np.diff(bounds)
            some = np.flatnonzero(size)
            s1, s2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
            sig = np.zeros((n, SIGNATURE), dtype=np.uint32)
            if len(some):
                begin = bounds[:-1][some]
                s1[some] = np.add.reduceat(mix(h), begin)
                s2[some] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), begin)
                for k in range(SIGNATURE):
                    sig[some, k] = np.minimum.reduceat(((h ^ _SEEDS[0, k]) * _SEEDS[1, k]) >> np.uint64(32), begin)
            packed = sig.view("V%d" % (4 * SIGNATURE)).ravel().tolist()
            low = np.ascontiguousarray(sig.astype(np.uint8)).view(f"V{SIGNATURE}").ravel().tolist()
            bins = np.repeat(np.arange(n) * BINS, size) + (h >> np.uint64(64 - 8)).astype(np.int64)
            least = np.flatnonzero(np.diff(bins, prepend=-1))
            fine = np.zeros(n * BINS, dtype=np.uint8)
            fine[bins[least]] = (h[least] % np.uint64(255)).astype(np.uint8) + 1
            fine = fine.view(f"V{BINS}").tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(at, n), pa.array(size.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(packed, pa.binary()), pa.array(low, pa.binary()), pa.array(fine, pa.binary())],
                names=["id", "size", "s1", "s2", "sig", "low", "fine"],
            )


@releasing
def _sets(batches):
    """Rows (first, s1, set) from (id, text): the sorted distinct shingles as packed 64-bit values."""
    for batch in batches:
        for at, end, data, offs in text_chunks(batch, rows=1024):
            bounds, h = distinct_sets(data, offs)
            raw, s1, some = h.tobytes(), np.zeros(end - at, dtype=np.uint64), np.flatnonzero(np.diff(bounds))
            if len(some):
                s1[some] = np.add.reduceat(mix(h), bounds[:-1][some])
            sets = pa.array([raw[8 * i : 8 * j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, end - at), pa.array(s1.view(np.int64)), sets], names=["first", "s1", "set"])


def _coordinates() -> np.ndarray:
    """Row k: tree k's hash functions, no two alike, for depth 0, then for each path of depth 1, and so on."""
    rng = np.random.default_rng(43)
    paths = sum(BRANCHINGS**d for d in range(1, DEPTH + 1))
    return np.array([[k, *[c for c in rng.permutation(SIGNATURE).tolist() if c != k][:paths]] for k in range(TREES)])


_COORDINATES = _coordinates()


def _children(depth: int):
    """Rows (node, tree, id) of the next level, from (id, sig) at depth 0 and (node, tree, id, sig) below.

    Below, tree names the path too: it is the parent's times BRANCHINGS, and the branching taken.
    """
    paths = BRANCHINGS**depth
    before = sum(BRANCHINGS**d for d in range(depth))

    @releasing
    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, SIGNATURE)
            for k in range(BRANCHINGS if depth else TREES):
                if depth:
                    tree, parent = batch.column("tree").to_numpy() * BRANCHINGS + np.int32(k), batch.column("node").to_numpy().view(np.uint64)
                    value = sig[np.arange(len(sig)), _COORDINATES[tree // paths, before + tree % paths]].astype(np.uint64)
                    node = mix(parent * np.uint64(31) + mix(value << np.uint64(16) | np.uint64(depth * 256 + k)))
                else:
                    tree, node = np.full(len(sig), k, dtype=np.int32), mix(sig[:, k].astype(np.uint64) << np.uint64(8) | np.uint64(k))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(tree.astype(np.int32)), batch.column("id")], names=["node", "tree", "id"])

    return run


def _estimates(sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal signature places for all pairs of left by right rows."""
    out = np.zeros((len(left), len(right)), dtype=np.uint16)
    for k in range(SIGNATURE):
        out += sig[left, k][:, None] == sig[right, k][None, :]
    return out / np.float32(SIGNATURE)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), BINS)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), SIGNATURE)


def _candidates(sig: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, comp: np.ndarray | None = None, fine: np.ndarray | None = None) -> np.ndarray:
    """Estimates of left by right rows, zero where sizes or the estimate rule a link out, or in a component."""
    near = _estimates(sig, left, right)
    small, large = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
    near[(near < ESTIMATE_AT_LEAST) | (100 * small < THRESHOLD * large)] = 0
    if comp is not None:
        near[comp[left][:, None] == comp[right][None, :]] = 0
    if fine is not None:
        p, q = np.nonzero(near)
        for at in range(0, len(p), 8192):
            i, j = p[at : at + 8192], q[at : at + 8192]
            a, b = fine[left[i]], fine[right[j]]
            filled, same = ((a | b) != 0).sum(axis=1), ((a == b) & (a != 0)).sum(axis=1)
            share = THRESHOLD / 100
            weak = same < share * filled - DEVIATIONS * np.sqrt(share * (1 - share) * filled)
            near[i[weak], j[weak]] = 0
    return near


@releasing
def _nearest(batches):
    """Rows (id, near, share, hub, hub_share): each row of a block, its nearest row and the block's hub, which is nearest to all; null where none."""
    for group in groups(batches, ("node", "blk")):
        ids, size, sig = group["id"].to_numpy(), group["size"].to_numpy(), _signatures(group["sig"])
        rows = np.arange(len(ids))
        near = _candidates(sig, size, rows, rows)
        near[rows, rows] = 0
        to, hub = near.argmax(axis=1), np.full(len(ids), near.sum(axis=0).argmax())
        columns = [pa.array(ids)]
        for place in (to, hub):
            share = near[rows, place]
            columns += [pa.array(ids[place], mask=share == 0), pa.array(share, mask=share == 0)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "near", "share", "hub", "hub_share"]).filter(pa.array(near.any(axis=1)))


@releasing
def _likely(batches):
    """Of rows (a, b, sig, size, hub_sig, hub_size), the pairs that may be links."""
    for batch in batches:
        near = (_signatures(batch.column("sig")) == _signatures(batch.column("hub_sig"))).mean(axis=1)
        m, n = batch.column("size").to_numpy(), batch.column("hub_size").to_numpy()
        keep = pa.array((near >= ESTIMATE_AT_LEAST) & (100 * np.minimum(m, n) >= THRESHOLD * np.maximum(m, n)))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])


def _sides(group) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks that a group pairs; the same rows twice for a block with itself."""
    i, j, blk = group["i"][0].as_py(), group["j"][0].as_py(), group["blk"].to_numpy()
    return (np.arange(len(blk)),) * 2 if i == j else (np.flatnonzero(blk == i), np.flatnonzero(blk == j))


@releasing
def _open(batches):
    """Rows (node, id) that have a candidate of another component in their node."""
    for group in groups(batches, ("node", "i", "j")):
        ids, size, comp, sig = group["id"].to_numpy(), group["size"].to_numpy(), group["comp"].to_numpy(), _signatures(group["sig"])
        left, right = _sides(group)
        near = _candidates(sig, size, left, right, comp, _sketches(group["fine"])) > 0
        found = np.union1d(left[near.any(axis=1)], right[near.any(axis=0)])
        yield pa.RecordBatch.from_arrays([group["node"].combine_chunks().take(pa.array(found)), pa.array(ids[found])], names=["node", "id"])


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= THRESHOLD * (len(x) + len(y) - both)


@releasing
def _settled(batches):
    """Links (a, b) that join components of a node, each pair that could be one checked on its full sets, the likeliest first."""
    for group in groups(batches, ("node", "i", "j")):
        ids, size, comp, sig = group["id"].to_numpy(), group["size"].to_numpy(), group["comp"].to_numpy(), _signatures(group["sig"])
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group["set"]]
        left, right = _sides(group)
        near = _candidates(sig, size, left, right, comp, _sketches(group["fine"]))
        p, q = np.nonzero(near)
        order = np.argsort(-near[p, q], kind="stable")
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        a, b = [], []
        for x, y in zip(left[p[order]].tolist(), right[q[order]].tolist(), strict=True):
            u, v = top(int(comp[x])), top(int(comp[y]))
            if u != v and _alike(sets[x], sets[y]):
                root[max(u, v)] = min(u, v)
                a.append(int(ids[x]))
                b.append(int(ids[y]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


@releasing
def _confirmed(batches):
    """Of rows (a, b, left, right), the pairs whose full sets are similar enough."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for k, (x, y) in enumerate(zip(batch.column("left"), batch.column("right"), strict=True)):
            keep[k] = _alike(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64))
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])


def _block_pairs(rows: DataFrame, parts: int, *more: str) -> DataFrame:
    """Rows with n, their node's count, dealt to the pairs of blocks of the node and sorted for groups()."""
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    placed = rows.withColumn("blk", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    work = placed.select("node", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "id", "comp", "size", "sig", "fine", *more)
    return work.repartition(parts, "node", "i", "j").sortWithinPartitions("node", "i", "j", "id")


@tidied
def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key as id, size of its set, and component (the smallest id reachable by links)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = stash(rows.mapInArrow(_signed, "id long, size long, s1 long, s2 long, sig binary, low binary, fine binary"))
    filled = signed.filter("size > 0 and id is not null")
    classes = filled.groupBy("s1", "s2", "size").agg(F.min("id").alias("first"), F.min("sig").alias("sig"), F.min("low").alias("low"), F.min("fine").alias("fine"))
    # a set is named by the smallest id that has it, or by its hash where that id is the smallest of several sets
    several = classes.groupBy("first").agg(F.count("*").alias("n")).filter("n > 1").select("first", F.lit(True).alias("shared"))
    classes = stash(classes.join(several, "first", "left").withColumn("id", F.when(F.col("shared"), F.col("s1")).otherwise(F.col("first"))).drop("shared"))
    signs, paths = classes.select("id", "size", F.col("low").alias("sig"), "fine"), classes.select("id", "sig")

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, set) of the sets of these names; while they are few, texts are not shuffled for it."""
        few = stash(classes.select("id", "first", "s1").join(ids.distinct(), "id", "left_semi"))
        small = (lambda df: F.broadcast(df)) if stashed_bytes(few) <= BROADCAST_BYTES else (lambda df: df)
        found = rows.join(small(few.select(F.col("first").alias("id")).distinct()), "id", "left_semi").mapInArrow(_sets, "first long, s1 long, set binary")
        return found.join(small(few), ["first", "s1"]).groupBy("id").agg(F.max("set").alias("set"))

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = stash(pairs.distinct())
        sets = stash(sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))))
        left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("left")), "a")
        return stash(left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("right")), "b").select("a", "b", "left", "right").mapInArrow(_confirmed, "a long, b long"))

    def placed(members: DataFrame, reach: DataFrame) -> DataFrame:
        """Members of nodes that hold several components, with comp, and n, the node's count."""
        known = members.join(reach.select(F.col("node").alias("id"), "component"), "id", "left")
        known = stash(known.select("node", "tree", "id", F.coalesce("component", "id").alias("comp")))
        mixed = known.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("node", "n")
        return stash(known.join(mixed, "node"))

    level = paths.mapInArrow(_children(0), "node long, tree int, id long")
    members = stash(level.join(level.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "node"))
    dealt = members.join(signs.drop("fine"), "id").withColumn("blk", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).cast("int"))
    dealt = dealt.select("node", "blk", "id", "size", "sig").repartition(parts, "node", "blk").sortWithinPartitions("node", "blk", "id")
    found = dealt.mapInArrow(_nearest, "id long, near long, share float, hub long, hub_share float")
    best = found.groupBy("id").agg(F.max(F.struct("share", "near")).alias("x"), F.max(F.struct("hub_share", "hub")).alias("y"))
    to = best.select("id", F.explode(F.array("x.near", "y.hub")).alias("to")).filter("to is not null")
    links = confirm(to.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")))

    reach = components(links)
    mixed = placed(members.drop("n"), reach)
    degree = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    hubs = mixed.join(degree, "id").groupBy("node").agg(F.max(F.struct("degree", "id", "comp")).alias("hub")).select("node", F.col("hub.id").alias("b"), F.col("hub.comp").alias("hub_comp"))
    spokes = mixed.join(hubs, "node").filter("comp <> hub_comp").select(F.col("id").alias("a"), "b").distinct()
    spokes = spokes.join(signs.select(F.col("id").alias("a"), "size", "sig"), "a").join(signs.select(F.col("id").alias("b"), F.col("size").alias("hub_size"), F.col("sig").alias("hub_sig")), "b")
    reach = merged(reach, confirm(spokes.mapInArrow(_likely, "a long, b long")))

    mixed, ready = placed(mixed.select("node", "tree", "id"), reach), []
    for depth in range(1, DEPTH + 1):
        large = mixed.filter(F.col("n") > NODE_ROWS)
        if depth == DEPTH or large.isEmpty():
            ready.append(mixed)
            break
        ready.append(mixed.filter(F.col("n") <= NODE_ROWS))
        below = large.join(paths, "id").mapInArrow(_children(depth), "node long, tree int, id long").distinct()
        mixed = placed(below, reach)
    nodes = ready[0]
    for more in ready[1:]:
        nodes = nodes.unionByName(more)
    found = _block_pairs(nodes.join(signs, "id"), parts).mapInArrow(_open, "node long, id long").distinct()
    unsettled = stash(nodes.drop("n").join(found, ["node", "id"], "left_semi"))
    counts = unsettled.groupBy("node").agg(F.count("*").alias("n"))
    sets = sets_of(unsettled.select("id"))
    last = _block_pairs(unsettled.join(counts, "node").join(signs, "id").join(sets, "id"), parts, "set").mapInArrow(_settled, "a long, b long")
    reach = merged(reach, stash(last))

    owned = stash(filled.select("id", "s1", "s2", "size").join(classes.select("s1", "s2", "size", F.col("id").alias("b")), ["s1", "s2", "size"]).select("id", "b"))
    first = owned.groupBy("id").agg(F.min("b").alias("least"), F.max("b").alias("most"))
    several = owned.join(first.filter("least <> most").select("id", "least"), "id").filter("b <> least")
    reach = merged(reach, several.select("b", F.col("least").alias("a")).distinct())
    named = classes.select(F.col("id").alias("node"), "first").join(reach, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("low"))
    known = named.join(lowest, "component").select(F.col("node").alias("least"), "low")
    found = first.join(known, "least").select("id", F.col("low").alias("component"))
    return signed.select("id", "size").join(found, "id", "left").select("id", "size", F.coalesce("component", "id").alias("component"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose key is the smallest of its component; all its columns. A null key stays."""
    gone = stash(similar(docs, key, text).filter("component <> id").select(F.col("id").alias(key)).distinct())
    return attach(docs, gone, (key,), "left_anti").select(*docs.columns)
