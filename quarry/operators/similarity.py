"""Vector search, neighbours, rank fusion and passages grouped by their document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: fusion's rank offset and the vectors' share.
RRF_OFFSET, VECTOR_WEIGHT = 60, 0.6
#: Rows of queries and of candidates that meet in one unit of work.
QUERY_BLOCK, ROW_BLOCK = 256, 8192
#: Where all rows are queries: bytes of those that a task holds, the fewest of them, and queries and rows of one product.
HELD_BYTES, LEAST_HELD, TILE = 16 << 20, 512, (512, 2048)
#: Products that hold more than this share of pairs to look at are made again in double precision.
DENSE = 1 / 16


def vector_scores(vectors: DataFrame, query: list[float], key: str = "vec_id", embedding: str = "embedding", keep: Column | None = None, min_score: float | None = None) -> DataFrame:
    """Rows (key, score) by exact cosine; keep: a test before scoring, so that a filter never costs hits."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors if keep is None else vectors.filter(keep)
    out = rows.filter(F.col(embedding).isNotNull()).select(key, V.cosine(F.col(embedding), q).alias("score"))
    return out if min_score is None else out.filter(F.col("score") >= min_score)


def vector_topk(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", embedding: str = "embedding", keep: Column | None = None, min_score: float | None = None) -> DataFrame:
    """The k nearest, ties in order of key; each task keeps k rows. k <= 0: all."""
    out = vector_scores(vectors, query, key, embedding, keep, min_score).orderBy(F.desc("score"), key)
    return out if k <= 0 else out.limit(k)


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of double precision."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lists) and (lists.null_count or len(flat) % len(lists) or not pc.all(pc.equal(pc.list_value_length(lists), len(flat) // len(lists))).as_py()):
        raise ValueError("vectors must be of one length and not null")
    return flat.reshape(len(lists), -1)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of a and b, to rounding."""
    return np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T)


def nearest(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, queries: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's id, row's id, score) of the k best other rows of each query; equals in order of id. Distances are exact."""
    i, j, score = _nearest(ids, x, asked, queries, k, metric)
    return asked[i], ids[j], score


def _nearest(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, queries: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest(), by places in asked and ids."""
    near = queries @ x.T if metric == "cosine" else -squared_distances(queries, x)
    near[asked[:, None] == ids[None, :]] = -np.inf
    if near.shape[1] > k:
        least = np.partition(near, -k, axis=1)[:, -k]
        least = least - 1e-9 * (1 + np.abs(least) + (queries * queries).sum(axis=1))  # rounding
    else:
        least = np.full(len(near), -np.finfo(np.float64).max)
    i, j = np.nonzero((near >= least[:, None]) & np.isfinite(near))
    score = _scores(queries, x, i, j, metric)
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], score[keep]


def halves(x: np.ndarray, asks: bool) -> np.ndarray:
    """x in single precision with one more column: products of queries and rows are (|q|² - distance²) / 2."""
    with np.errstate(over="ignore", invalid="ignore"):
        more = np.full(len(x), -1.0) if asks else (x * x).sum(axis=1) / 2
        return np.concatenate([x, more[:, None]], axis=1).astype(np.float32)


def slack(q: np.ndarray, x: np.ndarray, dimensions: int) -> np.ndarray | None:
    """By how much such products of queries of lengths q and rows of lengths x may be off, four times over; None if they may overflow."""
    most = x.max(initial=0.0)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = q * most + most * most
    return scale * (dimensions + 8) * 2.0**-22 + 1e-36 if scale.max(initial=0.0) < 1e36 and q.max(initial=0.0) < 1e36 else None


def candidates(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Places (i, j) of the products of single precision that are not under least, one for each query; None if they are many."""
    hit = np.flatnonzero(q @ x.T >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
    return None if len(hit) > DENSE * len(q) * len(x) else (hit // len(x), hit % len(x))


def _scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """In double precision, of pairs of places."""
    out = np.empty(len(i))
    for at in range(0, len(i), 65536):
        a, b = q[i[at : at + 65536]], x[j[at : at + 65536]]
        out[at : at + 65536] = (a * b).sum(axis=1) if metric == "cosine" else -np.sqrt(((a - b) ** 2).sum(axis=1))
    return out


class _Lists:
    """The k best rows of each of some queries, of rows that pass by in blocks."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str):
        self.ids, self.x, self.k, self.metric = ids, x, k, metric
        self.single = x.astype(np.float32) if metric == "cosine" else halves(x, True)
        self.length = np.sqrt((x * x).sum(axis=1))
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst, self.new, self.waiting = np.full(len(ids), -np.inf), [], 0

    def settle(self) -> None:
        i, j, score = (np.concatenate(c) for c in zip(self.best, *self.new, strict=True))
        order = np.lexsort((j, -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        self.worst[i[rank == self.k - 1]] = score[rank == self.k - 1]
        self.best, self.new, self.waiting = (i[rank < self.k], j[rank < self.k], score[rank < self.k]), [], 0

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        length = np.sqrt((x * x).sum(axis=1))
        single = x.astype(np.float32) if self.metric == "cosine" else halves(x, False)
        for at in range(0, len(self.ids), TILE[0]):
            part = slice(at, at + TILE[0])
            worst, off, found = self.worst[part], slack(self.length[part], length, x.shape[1]), None
            if off is not None and np.isfinite(worst).all():
                least = worst if self.metric == "cosine" else (self.length[part] ** 2 - worst**2) / 2
                found = candidates(self.single[part], single, least - off)
            if found is None:
                found = _nearest(ids, x, self.ids[part], self.x[part], self.k, self.metric)
            else:
                i, j = found
                other = self.ids[part][i] != ids[j]
                i, j = i[other], j[other]
                found = i, j, _scores(self.x[part], x, i, j, self.metric)
            i, j, score = found
            keep = np.isfinite(score) & (score >= worst[i])
            if keep.any():
                self.new.append((i[keep] + at, ids[j[keep]], score[keep]))
                self.waiting += int(keep.sum())
        if self.waiting > len(self.ids) * self.k // 2:
            self.settle()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), V.LEAST_NORM)


def _all_nearest(k: int, metric: str, kind: str):
    """Per part: its queries come first and are held, then all rows pass by; k rows a query leave it."""

    def opened(batch: pa.RecordBatch, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([np.frombuffer(batch.column("ids")[p].as_buffer(), dtype="<i8") for p in places])
        x = np.concatenate([np.frombuffer(batch.column("matrix")[p].as_buffer(), dtype=kind) for p in places])
        x = x.reshape(len(ids), -1).astype(np.float64)
        return ids, _unit(x) if metric == "cosine" else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lists, step = [], None, TILE[1] // QUERY_BLOCK
        for batch in batches:
            asks = batch.column("asks").to_pylist()
            first = [p for p, a in enumerate(asks) if a]
            rows = [p for p, a in enumerate(asks) if not a]
            held += [opened(batch, first)] if first else []
            if not rows or not held:
                continue
            if lists is None:
                lists = _Lists(*(np.concatenate(c) for c in zip(*held, strict=True)), k, metric)
            for at in range(0, len(rows), step):
                lists.meet(*opened(batch, rows[at : at + step]))
        if lists is None:
            return
        lists.settle() if lists.new else None
        i, j, score = lists.best
        for at in range(0, len(i), 1 << 18):
            part = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(lists.ids[i[part]]), pa.array(j[part]), pa.array(score[part])], names=["query_id", "neighbour_id", "score"])

    return run


def _best(k: int, metric: str):
    """Per part: its rows come first and are held, then blocks of queries, each of which gets its k nearest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, ids, x = None, [], None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, blocks, x = row["part"], [], None
                if not row["asks"]:
                    blocks.append((np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["matrix"], dtype=np.float64)))
                    continue
                if not blocks:
                    continue
                if x is None:
                    ids = np.concatenate([b[0] for b in blocks])
                    x = np.concatenate([b[1] for b in blocks]).reshape(len(ids), -1)
                asked = np.frombuffer(row["ids"], dtype=np.int64)
                found = nearest(ids, x, asked, np.frombuffer(row["matrix"], dtype=np.float64).reshape(len(asked), -1), k, metric)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "neighbour_id", "score"])

    return run


def pieces(kind: str, block: int, more: tuple[tuple[str, str], ...] = ()):
    """Rows of (ids, more columns, matrix) of at most block rows (id, ..., v), as they are given; kind: of the vectors' numbers."""
    kinds = (("id", "<i8"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                raw = [part.column(c).to_numpy(zero_copy_only=False).astype(t).tobytes() for c, t in kinds] + [matrix(part.column("v")).astype(kind).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in raw], names=["ids", *(c for c, _ in more), "matrix"])

    return run


def _packed(metric: str, block: int):
    """Rows of (ids, matrix) of at most block vectors; cosine: of unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = matrix(part.column("v"))
                if metric == "cosine":
                    x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), V.LEAST_NORM)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "matrix"])

    return run


def knn(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, metric: str = "cosine", key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (query_id, neighbour_id, score, rank from 1): the k nearest others of each query row; exact.

    Rows are packed into matrices and dealt once to parts of about ROW_BLOCK of them; each part sees
    every block of queries, as one matrix product, and k rows per query leave it. So rows travel
    once, whatever the number of queries, and a task holds one part. Vectors are not null and of
    one length. score: cosine, or the negative distance. Counting the rows is the one action.

    Without queries, all_nearest() does the work.
    """
    if queries is None:
        return all_nearest(vectors, k, metric, key, embedding)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v")).filter("id is not null and v is not null")
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v")).filter("id is not null and v is not null")
    parts = max(1, -(-rows.count() // ROW_BLOCK))
    packed = rows.mapInArrow(_packed(metric, max(1, ROW_BLOCK // 8)), "ids binary, matrix binary")
    held = packed.select(F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("asks"), "ids", "matrix")
    asks = asked.mapInArrow(_packed(metric, QUERY_BLOCK), "ids binary, matrix binary").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asks"), "ids", "matrix")
    work = held.unionByName(asks).repartition(parts, "part").sortWithinPartitions("part", "asks")
    found = work.mapInArrow(_best(k, metric), "query_id long, neighbour_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def all_nearest(vectors: DataFrame, k: int, metric: str, key: str, embedding: str) -> DataFrame:
    """knn() of all rows among themselves.

    Each part holds its share of the queries, at most HELD_BYTES of them, and all rows pass by: products in
    single precision tell, by bounds of their rounding, which pairs can be among the k best found so
    far, and only these are compared in double precision. So k rows a query leave a part, and rows travel
    once to each part.
    """
    kind = "<f4" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v")).filter("id is not null and v is not null")
    n, size = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    lanes = rows.sparkSession.sparkContext.defaultParallelism
    least = -(-n * 8 * (size or 1) // HELD_BYTES)
    parts = max(1, min(-(-least // lanes) * lanes or lanes, max(least, n // LEAST_HELD)))
    packed = rows.mapInArrow(pieces(kind, QUERY_BLOCK), "ids binary, matrix binary")
    asks = packed.repartition(parts).select(F.spark_partition_id().alias("part"), F.lit(True).alias("asks"), "ids", "matrix")
    held = packed.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("asks"), "ids", "matrix")
    work = asks.unionByName(held).repartitionById(parts, "part").sortWithinPartitions(F.desc("asks"))
    found = work.mapInArrow(_all_nearest(k, metric, kind), "query_id long, neighbour_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def rrf_fuse(vector_hits: DataFrame, lexical_hits: DataFrame, k: int = 60, weight: float = VECTOR_WEIGHT, key: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of two top-k frames (key, score): weight / (61 + rank from 0), a missing side adds nothing."""

    def ranks(hits: DataFrame, name: str) -> DataFrame:
        by = Window.orderBy(F.desc("score"), key)
        return hits.select(key, F.col("score").alias(f"{name}_score"), (F.row_number().over(by) - 1).alias(f"{name}_rank"))

    both = ranks(vector_hits, "vector").join(ranks(lexical_hits, "bm25"), key, "full")
    part = lambda w, r: F.coalesce(F.lit(w) / (RRF_OFFSET + 1 + F.col(r)), F.lit(0.0))
    return both.withColumn("score", part(weight, "vector_rank") + part(1 - weight, "bm25_rank")).orderBy(F.desc("score"), key).limit(k)


def group_chunks(hits: DataFrame, k: int = 10, per_parent: int | None = 5, parent: str = "parent_id") -> DataFrame:
    """Hits (parent, chunk_id, position, text, score) by document: (parent, max_score, avg_score, n_chunks, chunks).

    max_score is of all hits, avg_score of the best per_parent, which stay, in order of position.
    """
    best = Window.partitionBy(parent).orderBy(F.desc("score"), "chunk_id")
    placed = hits.withColumn("_rank", F.row_number().over(best)).withColumn("_max", F.max("score").over(Window.partitionBy(parent)))
    kept = placed if per_parent is None else placed.filter(F.col("_rank") <= per_parent)
    grouped = kept.groupBy(parent).agg(
        F.max("_max").alias("max_score"),
        F.avg("score").alias("avg_score"),
        F.count("*").alias("n_chunks"),
        F.sort_array(F.collect_list(F.struct("position", "chunk_id", "text", "score"))).alias("chunks"),
    )
    return grouped.orderBy(F.desc("max_score"), parent).limit(k)
