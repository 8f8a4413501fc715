"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits (any byte over 127 counts as one), A-Z as a-z. A text and a
benchmark item that share a run of MIN_MATCH words are tiled: the longest common run of words that
no tile covers yet becomes a tile, on both sides, until none has MIN_MATCH words. Runs are found
by a running Karp-Rabin hash over the words and checked word by word, a word being known by a
64-bit hash of all its bytes. The item's share of tiled words is its
coverage, so that passages in another order, or cut apart, still count. Pairs with at least
COVERAGE are reported.

While the benchmark has at most BROADCAST_BYTES of text, it is shipped to every task and texts
never leave theirs; a larger one meets the texts by a join of the shared seeds.

Null and empty texts and items match nothing. An item shorter than MIN_MATCH words is found as a
whole run of its own length. Rows that repeat an id are reported as often as they occur,
and so are rows and items whose id is null, with a null id, whatever the benchmark's size. Empty
tables give empty results. Extra columns are left out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import releasing, text_chunks, window_hashes, word_bounds, word_hashes

MIN_MATCH = 5
COVERAGE = 0.6
BROADCAST_BYTES = 4 << 20
_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word."""
    starts, ends, row = word_bounds(data, offs, _SEPARATOR)
    return word_hashes(data, starts, ends, lower=True), row


def _text_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return words(data, np.array([0, len(data)]))[0]


_PRIME = (1 << 31) - 1
_BASE = 1_000_003


def running_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every k consecutive words: each follows from its neighbour's running sum."""
    up, down, base, back = np.ones(len(words), dtype=np.uint64), np.ones(len(words), dtype=np.uint64), _BASE, pow(_BASE, -1, _PRIME)
    done = 1
    while done < len(words):
        up[done : 2 * done] = up[: min(done, len(words) - done)] * np.uint64(pow(base, done, _PRIME)) % np.uint64(_PRIME)
        down[done : 2 * done] = down[: min(done, len(words) - done)] * np.uint64(pow(back, done, _PRIME)) % np.uint64(_PRIME)
        done *= 2
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words % np.uint64(_PRIME) * up % np.uint64(_PRIME), out=sums[1:])
    return (sums[k:] - sums[:-k]) % np.uint64(_PRIME) * down[: len(words) - k + 1] % np.uint64(_PRIME)


def tile(text: np.ndarray, item: np.ndarray, at_least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling of two arrays of word hashes: (place in text, place in item, words), longest first."""
    k = min(at_least, len(item))
    if not k or len(text) < k:
        return []
    a, b = running_hashes(text, k), running_hashes(item, k)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = high - low
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    same = np.all(text[i[:, None] + np.arange(k)] == item[j[:, None] + np.arange(k)], axis=1) if len(i) else np.zeros(0, dtype=bool)
    i, j = i[same], j[same]
    if not len(i):
        return []
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(i))) + k - 1
    heap = [(-int(n), int(x), int(y)) for n, x, y in zip(length, i[first], j[first], strict=True)]
    heapq.heapify(heap)
    in_text, in_item = np.zeros(len(text), dtype=bool), np.zeros(len(item), dtype=bool)
    tiles = []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        free = ~(in_text[x : x + n] | in_item[y : y + n])
        if free.all():
            tiles.append((x, y, n))
            in_text[x : x + n] = in_item[y : y + n] = True
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for p, q in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if q - p >= k:
                heapq.heappush(heap, (p - q, x + p, y + p))
    return tiles


_RESULT = "doc_id long, item_id long, item_words int, tiled_words int, tiles int, coverage double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("tiled_words", pa.int32()), ("tiles", pa.int32()), ("coverage", pa.float64())])


def _row(doc: int, item: int, text: np.ndarray, words_: np.ndarray, coverage: float) -> dict | None:
    tiles = tile(text, words_)
    tiled = sum(t[2] for t in tiles)
    if not tiles or tiled < coverage * len(words_):
        return None
    return {"doc_id": doc, "item_id": item, "item_words": len(words_), "tiled_words": tiled, "tiles": len(tiles), "coverage": tiled / len(words_)}


def _shipped(docs: DataFrame, items: list[tuple[int, np.ndarray]], coverage: float) -> DataFrame:
    """Every task holds the benchmark's seeds and words."""
    sizes = sorted({min(MIN_MATCH, len(w)) for _, w in items})
    seeds = {}
    for k in sizes:
        found = [(window_hashes(w, k), np.full(len(w) - k + 1, n)) for n, (_, w) in enumerate(items) if min(MIN_MATCH, len(w)) == k]
        h, of = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        seeds[k] = h[order], of[order]

    @releasing
    def run(batches):
        for batch in batches:
            for at, end, data, offs in text_chunks(batch):
                h, row = words(data, offs)
                base = np.searchsorted(row, np.arange(end - at + 1))
                pairs = []
                for k, (known, of) in seeds.items():
                    grams = window_hashes(h, k)
                    place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    hit = np.flatnonzero((known[place] == grams) & (row[: len(grams)] == row[k - 1 :]))
                    n = np.searchsorted(known, grams[hit], "right") - place[hit]
                    entry = np.repeat(place[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pairs.append(np.unique(np.repeat(row[hit], n) * len(items) + of[entry]))
                ids = batch.column("id").slice(at, end - at)
                out = []
                for pair in np.concatenate(pairs).tolist() if pairs else []:
                    r, n = divmod(pair, len(items))
                    if (got := _row(ids[r].as_py(), items[n][0], h[base[r] : base[r + 1]], items[n][1], coverage)) is not None:
                        out.append(got)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return docs.mapInArrow(run, _RESULT)


@releasing
def _seeds(batches):
    """Rows (seed, id), each once per text, of runs of 1 to MIN_MATCH words: short items are runs of their own length."""
    for batch in batches:
        for at, end, data, offs in text_chunks(batch):
            h, row = words(data, offs)
            ids = batch.column("id").slice(at, end - at)
            for k in range(1, MIN_MATCH + 1):
                grams = window_hashes(h, k)
                inside = row[: len(grams)] == row[k - 1 :] if len(grams) else np.zeros(0, dtype=bool)
                grams, of = grams[inside], row[: len(grams)][inside]
                order = np.lexsort((grams, of))
                grams, of = grams[order], of[order]
                new = np.ones(len(grams), dtype=bool)
                new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
                if batch.schema.get_field_index("item") >= 0:
                    size = np.bincount(row, minlength=end - at)
                    new &= (size[of] == k) if k < MIN_MATCH else (size[of] >= k)
                yield pa.RecordBatch.from_arrays([pa.array(grams[new].view(np.int64)), ids.take(pa.array(of[new])), pa.array(np.full(int(new.sum()), k, dtype=np.int32))], names=["seed", "id", "k"])


def _tiled(coverage: float):
    @releasing
    def run(batches):
        for batch in batches:
            out = [_row(d, i, _text_words(t), _text_words(s), coverage) for d, i, t, s in zip(*(batch.column(c).to_pylist() for c in ("id", "item_id", "text", "item")), strict=True)]
            yield pa.RecordBatch.from_pylist([x for x in out if x is not None], schema=_SCHEMA)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs (doc_id, item_id) with the item's words, tiled words, tiles and coverage."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    tests = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("item")).filter("item is not null")
    size = tests.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("n")).first()["n"]
    if size <= broadcast_bytes:
        items = [(r["item_id"], w) for r in tests.toLocalIterator() if len(w := _text_words(r["item"]))]
        return _shipped(rows, sorted(items, key=lambda x: (x[0] is None, x[0] or 0)), coverage)
    seeds = tests.select(F.col("item_id").alias("id"), F.col("item").alias("text"), F.lit(1).alias("item")).mapInArrow(_seeds, "seed long, id long, k int").withColumnRenamed("id", "item_id")
    found = rows.mapInArrow(_seeds, "seed long, id long, k int").join(seeds, ["seed", "k"]).select("id", "item_id").distinct()
    found = found.toDF("found", "found_item").join(tests, F.col("found_item").eqNullSafe(F.col("item_id"))).join(rows, F.col("found").eqNullSafe(F.col("id")))
    return found.select("id", "item_id", "text", "item").mapInArrow(_tiled(coverage), _RESULT)
