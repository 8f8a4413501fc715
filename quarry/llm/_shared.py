"""Shared pieces of the corpus operators: tables, the shared folder, whole-batch hashing.

Hashing works on Arrow buffers, one array operation for many documents at a time. Words and strings
are read eight bytes at a time and each eight are mixed before they meet the next, so that no
arithmetic relation between bytes cancels out; a second seed gives a hash that does not depend on
the first. Chunks are small enough that the arrays of a step stay in a core's cache.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 256 << 10

_RNG = np.random.Generator(np.random.PCG64(20240607))
WORD_VALUES = _RNG.integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Tables of at most so many bytes on disk, about three times that in memory, go to the texts by broadcast; larger ones by a shuffle of both.
BROADCAST_BYTES = 24 << 20
GRAM = 32
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all machines share (spark.checkpoint.dir).

    Where that is unset, as in tests on one machine, the warehouse folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Tables that the operators now at work have stashed, an entry for each operator within another.
_OPEN: list[list[str]] = []
#: When the driver last collected its garbage, and the least seconds until it does again.
_collected, COLLECT_AFTER = [0.0], 2.0


def stash(df: DataFrame, done_with: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, executors may go.

    done_with: stashed tables that nothing reads from now on; their files are deleted. Shuffle files
    of ended jobs stay on the executors until the driver collects its garbage, so it is asked to.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    for old in done_with:
        _delete(spark, old._stashed_at)
    if time.monotonic() - _collected[0] > COLLECT_AFTER:
        gc.collect()
        spark._jvm.System.gc()
        _collected[0] = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    if _OPEN:
        _OPEN[-1].append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidied(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose stashed tables are deleted once its result is one; for results that are small beside the input."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        _OPEN.append([])
        try:
            out = operator(*args, **kwargs)
        finally:
            made = _OPEN.pop()
        out = stash(out)
        for path in made:
            _delete(out.sparkSession, path)
        return out

    return run


def stashed_bytes(df: DataFrame) -> int:
    """Bytes on disk of the files behind a stashed table."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def attach(texts: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("id", "sub"), how: str = "left") -> DataFrame:
    """Join of a large table with a stashed one: by broadcast if its size is known to be small, else by a shuffle."""
    return texts.join(F.broadcast(spans) if stashed_bytes(spans) <= BROADCAST_BYTES else spans, list(keys), how)


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def gram_hashes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the GRAM bytes from each place on; places with fewer to the end have none."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.ascontiguousarray(_eights(data)[:-1])
    h ^= np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    out = h[:n] * np.uint64(0x94D049BB133111EB)
    for k in (8, 16, 24):
        out ^= out >> np.uint64(31)
        out += h[k : k + n]
        out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def slice_hashes(grams: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each slice [begin, end) of at least GRAM bytes, from gram_hashes() of the bytes."""
    h = mix((end - begin).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    at, rows = begin, np.arange(len(begin))
    while len(rows):
        h[rows] = mix(h[rows] * np.uint64(31) + grams[at])
        more = at + GRAM < end[rows]
        rows = rows[more]
        at = np.minimum(at[more] + GRAM, end[rows] - GRAM)
    return h


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES, rows: int = 2048) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of at most that many rows and about limit bytes; null is empty."""
    texts = batch.column(column)
    if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        kind = np.int32
    else:
        texts, kind = texts.cast(pa.large_binary()), np.int64
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = min(max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1), at + rows, n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def word_bounds(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of non-space bytes; runs end at row bounds."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    solid = ~space[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    firsts = offs[:-1][offs[:-1] < offs[1:]]
    start[firsts] = solid[firsts]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    lasts = offs[1:][offs[:-1] < offs[1:]] - 1
    end[lasts] = solid[lasts]
    starts = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(starts, offs))
    return starts, np.flatnonzero(end) + 1, np.repeat(np.arange(len(offs) - 1), counts)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """Hash of each word data[start:end], A-Z as a-z if lower; words of over GRAM bytes by a keyed digest."""
    if lower:
        data = LOWER[data]
    eights, n = _eights(data), ends - starts
    h = mix((eights[starts] & _FIRST_BYTES[np.minimum(n, 8)]) ^ mix(n.astype(np.uint64) + np.uint64(seed * 256 + 1 << 32)))
    for k in range(8, GRAM, 8):
        rows = np.flatnonzero(n > k)
        if not len(rows):
            break
        h[rows] = mix(h[rows] * np.uint64(31) + (eights[starts[rows] + k] & _FIRST_BYTES[np.minimum(n[rows] - k, 8)]))
    for r in np.flatnonzero(n > GRAM).tolist():
        h[r] = int.from_bytes(hashlib.blake2b(data[starts[r] : ends[r]], digest_size=8, key=bytes([seed])).digest(), "little")
    return h


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of every n consecutive word hashes, whatever row they are in."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        out += words[j : j + size] * WORD_VALUES[j]
    return mix(out)


def window_argmin(order: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the place of its smallest; the leftmost of equals.

    Values keep their high 40 bits (fewer in arrays of over 16 million); the place fills the rest.
    """
    n = len(order)
    if n < w:
        return np.zeros(0, dtype=np.int64)
    bits = np.uint64(max(24, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    cur = (order & ~low) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    rest = w - span
    if rest:
        cur = np.minimum(cur[:-rest], cur[rest:])
    return (cur & low).astype(np.int64)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep their own counsel
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Loaders of what Python workers keep from one task to the next.
_KEPT: list = []


def kept(load: Callable) -> Callable:
    """A loader whose last two results stay in the worker until a step begins that does not keep them."""
    load = functools.lru_cache(maxsize=2)(load)
    _KEPT.append(load)
    return load


def drop_kept() -> None:
    if any(load.cache_info().currsize for load in _KEPT):
        for load in _KEPT:
            load.cache_clear()
        gc.collect()
        _release()


def releasing(step: Callable, keeps: bool = False) -> Callable:
    """A step of mapInArrow that gives memory back at its end: Python workers are used again by later stages.

    keeps: it uses what kept() loads; other steps drop what earlier stages left.
    """

    @functools.wraps(step)
    def run(batches):
        if not keeps:
            drop_kept()
        try:
            yield from step(batches)
        finally:
            _release()

    return run
