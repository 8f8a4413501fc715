"""Embedding near-duplicates by Euclidean p-stable hashing.

Each table puts a unit vector into a bucket: several random projections, each cut into steps of
WIDTH. Vectors of one label that share a bucket are compared by exact cosine in double precision.
How many projections and tables there are follows from the rows of the largest label: so many
projections that unrelated vectors of it make buckets of about BLOCK, and so many tables that a
pair at the threshold misses all of them with MISS; nearer pairs miss less.

Equal vectors are compared once and counted as often as they occur. A bucket of any size is cut
into blocks of BLOCK rows, and each pair of blocks is one unit of work. Only buckets of more than
one block are looked up, so that vectors travel once per table, to the unit that compares them. A block of work returns
sums and a spanning set of links, never its pairs. A pair that shares buckets in several tables
counts in the first of them.

Null labels, null vectors, zero vectors and those with null or non-finite components link with
nothing; so do vectors of unlike length. Rows that repeat an id are vectors of their own for
counting, though they share the id's result, the sum of their links. A null id gets a row of its
own without links. Extra columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import attach, mix, releasing, stash, tidied
from .components import components

THRESHOLD = 0.93
WIDTH = 1.5
BLOCK = 1024
MISS = 2e-4
_SLACK = 1e-5


def same_step(cosine: float, width: float = WIDTH) -> float:
    """Probability that two unit vectors of this cosine fall into one step of a projection."""
    r = width / math.sqrt(max(2 - 2 * cosine, 1e-12))
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def tables_for(rows: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(projections, tables) for a label of so many rows."""
    near, far = same_step(threshold), same_step(0.0)
    projections = max(1, round(math.log(max(rows, 1) / BLOCK) / -math.log(far))) if rows > BLOCK else 1
    return projections, math.ceil(math.log(MISS) / math.log(1 - near**projections))


def _buckets(x: np.ndarray, label: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The 64-bit bucket of each row in each table."""
    projections, tables = shape
    rng = np.random.default_rng([29, x.shape[1]])
    a = rng.normal(size=(tables * projections, x.shape[1])).T
    b = rng.uniform(0, WIDTH, tables * projections)
    step = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, projections)
    h = mix(label.astype(np.int64).view(np.uint64) + np.uint64(x.shape[1] << 32))[:, None] + mix(np.arange(1, tables + 1, dtype=np.uint64))
    for k in range(projections):
        h = mix(h * np.uint64(31) + step[:, :, k])
    return h.view(np.int64)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(shape: tuple[int, int], whole: bool):
    """Rows (bucket, tab, id, n, vec) from (id, label, n, embedding); only (bucket) unless whole."""

    @releasing
    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            size = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            first = np.concatenate([[0], np.cumsum(size)])
            ids, label, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "n"))
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                for at in range(0, len(rows), 2048):
                    part = rows[at : at + 2048]
                    raw = values[first[part][:, None] + np.arange(dim)]
                    found = pa.array(_buckets(_unit(raw), label[part], shape).ravel())
                    if not whole:
                        yield pa.RecordBatch.from_arrays([found], names=["bucket"])
                        continue
                    k, t = np.repeat(np.arange(len(part)), shape[1]), np.tile(np.arange(shape[1], dtype=np.int32), len(part))
                    packed = pa.array([r.tobytes() for r in raw], pa.binary()).take(pa.array(k))
                    yield pa.RecordBatch.from_arrays([found, pa.array(t), pa.array(ids[part][k]), pa.array(n[part][k]), packed], names=["bucket", "tab", "id", "n", "vec"])

    return run


def groups(batches, keys: tuple[str, ...]):
    """Tables of rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
        cut = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in k])) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in keys):
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(cut, cut[1:], strict=False):
            if held and i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row, the smallest id reachable within the block; linked: a matrix of left by right rows."""
    label = ids.copy()
    some_l, some_r = linked.any(axis=1), linked.any(axis=0)
    sub, left, right = linked[some_l][:, some_r], left[some_l], right[some_r]
    big = np.iinfo(np.int64).max
    while len(left):
        before = label.copy()
        label[left] = np.minimum(label[left], np.where(sub, label[right][None, :], big).min(axis=1))
        label[right] = np.minimum(label[right], np.where(sub, label[left][:, None], big).min(axis=0))
        if (before == label).all():
            break
    return label


def _compared(threshold: float, shape: tuple[int, int]):
    @releasing
    def run(batches):
        for group in groups(batches, ("bucket", "i", "j")):
            ids, n, blk = (group[c].to_numpy() for c in ("id", "n", "blk"))
            tab, i, j = (group[c][0].as_py() for c in ("tab", "i", "j"))
            x = _unit(np.frombuffer(b"".join(group["vec"].to_pylist()), dtype=np.float32).reshape(len(ids), -1))
            left, right = (np.arange(len(ids)),) * 2 if i == j else (np.flatnonzero(blk == i), np.flatnonzero(blk == j))
            if not len(left) or not len(right):
                continue
            f = x.astype(np.float32)
            near = f[left] @ f[right].T
            linked = near >= threshold + _SLACK
            p, q = np.nonzero((near >= threshold - _SLACK) & ~linked)
            linked[p, q] = np.einsum("ij,ij->i", x[left[p]], x[right[q]]) >= threshold
            if i == j:
                linked[left, left] = False
            if not linked.any():
                continue
            label = _spanning(linked, left, right, ids)
            fresh, seen = linked, _buckets(x, np.zeros(len(ids), dtype=np.int64), shape)
            for t in range(tab):
                fresh = fresh & (seen[left, t][:, None] != seen[right, t][None, :])
                if t % 4 == 0 and not fresh.any():
                    break
            links = np.zeros(len(ids), dtype=np.int64)
            links[left] += fresh @ n[right]
            if i != j:
                links[right] += n[left] @ fresh
            some = (links > 0) | (label != ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(label[some])], names=["id", "links", "near"])

    return run


@tidied
def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly) and component_id (smallest id reachable)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<float>").alias("embedding"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    classes = stash(rows.filter(sound).groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    largest = classes.groupBy("label").agg(F.count("*").alias("rows")).agg(F.max("rows").alias("rows")).first()["rows"]
    shape = tables_for(largest or 0, threshold)
    given = classes.select(F.col("rep").alias("id"), "label", "n", "embedding")
    large = stash(given.mapInArrow(_hashed(shape, False), "bucket long").groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK))
    hashed = given.mapInArrow(_hashed(shape, True), "bucket long, tab int, id long, n long, vec binary")
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    placed = attach(hashed, large, ("bucket",)).withColumn("blk", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    work = placed.select("bucket", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "tab", "id", "n", "blk", "vec")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = work.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")
    found = stash(work.mapInArrow(_compared(threshold, shape), "id long, links long, near long").groupBy("id", "near").agg(F.sum("links").alias("links")))
    reach = components(found, "id", "near")
    links = found.groupBy("id").agg(F.sum("links").alias("links")).join(reach.select(F.col("node").alias("id"), "component"), "id", "full")
    of = classes.join(links.withColumnRenamed("id", "rep"), "rep", "left").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    known = rows.filter(sound).join(of, ["label", "embedding"]).groupBy("id").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    out = rows.select("id").join(known, "id", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
