"""Suffix-array dedup by distributed prefix doubling, on sampled suffixes.

A row per byte would be a sort of the whole corpus many times over, so the suffixes that are
sorted are sampled by content: every string of `length` bytes (LENGTH unless said otherwise)
selects the place with the smallest fingerprint of GRAM bytes among its first spread(length) places.
Equal strings select the same place. All strings that select a place contain the
length - spread(length) + 1 bytes from it on.

Prefix doubling then ranks the sampled suffixes by their first 32, 64, 128 and 201 bytes (as far as
that many are shared: 32 and 52 for a length of 101): Spark
sorts the pairs of a suffix's rank and the name of the bytes at the offset, and numbers those that
occur more than once in sorted order; unique suffixes drop out. (The name is a fingerprint, as the
place at the offset is not itself a sampled suffix.) Of those that are left, suffixes whose whole
context, all bytes of the strings that select them, is alike elsewhere are repeats as a whole. The
few with unlike contexts, at the edges of repeats, are split into blocks of BLOCK strings, named by
the bytes that all strings of a block share; blocks go the same way, and only those that a repeat's
edge cuts are settled string by string.

Equal texts are joined first: such texts of that length or more lose all bytes, and one of them
stands in for all. Ranks are counted before the shuffle, and those of the few most frequent go
back to their rows by broadcast, so that a passage in a third of all texts lands in no single task.

Passages counted in words are found as strings of the fewest bytes that so many words have; with
least_words, runs that hold fewer whole words, and are shorter than LENGTH, are then left in.

Null and empty texts have no bytes and lose nothing, nor do texts shorter than that length. What a
row loses depends on its text alone, so that null and repeated keys are rows like any other. Empty
tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import GRAM, attach, gram_hashes, mix, releasing, slice_hashes, stash, text_chunks, window_argmin, word_bounds
from .passages import _flat, join_counts, key_of, one_of_each

LENGTH = 400
MOST_SPREAD = 200
BLOCK = 16
#: A text is named by two hashes that do not depend on each other, of 64 and 32 bits.
TEXT = ("same", "sub")


def spread(length: int) -> int:
    """Of so many places at the start of a string one is selected; a span's fields hold up to 255."""
    return min(length // 2, MOST_SPREAD)


def prefixes(length: int) -> list[int]:
    """Prefix lengths that are ranked: the gram, its doublings, and what all strings of a place share."""
    out, shared = [GRAM], length - spread(length) + 1
    while out[-1] * 2 < shared:
        out.append(out[-1] * 2)
    return [*out, shared] if out[-1] < shared else out


def _starts(offs: np.ndarray, length: int) -> np.ndarray:
    """The places at which a string of that length starts within its row."""
    size = np.diff(offs)
    some = np.flatnonzero(size >= length)
    edge = np.zeros(int(offs[-1]) + 1, dtype=np.int8)
    edge[offs[:-1][some]] += 1
    edge[offs[1:][some] - length + 1] -= 1
    return np.flatnonzero(np.cumsum(edge, dtype=np.int32)[:-1])


def _places(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram hashes, row, place, first, last) of the sampled suffixes; strings at first..last select the place."""
    grams = gram_hashes(data)
    begin = _starts(offs, length)
    if not len(begin):
        return grams, *(np.zeros(0, dtype=np.int64) for _ in range(4))
    place = window_argmin(grams, spread(length))[begin]
    row = np.searchsorted(offs, begin, side="right") - 1
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    k = np.flatnonzero(new)
    return grams, row[k], place[k], begin[k], begin[np.append(k[1:], len(begin)) - 1]


def _grams(batches, length):
    """Rows (r) of the sampled suffixes' first names."""
    for batch in batches:
        for _, _, data, offs in text_chunks(batch):
            grams, _, place, _, _ = _places(data, offs, length)
            yield pa.RecordBatch.from_arrays([pa.array(grams[place].view(np.int64))], names=["r"])


def _suffixes(batches, length):
    """Rows (r, b1, b2 and so on, ctx, same, sub, span): names of the gram, the bytes at each offset and the context.

    A span is the first string, the place after it and the count of strings in one number.
    """
    cut = [0, *prefixes(length)]
    for batch in batches:
        for at, end, data, offs in text_chunks(batch):
            grams, row, place, first, last = _places(data, offs, length)
            names = [grams[place], *(slice_hashes(grams, place + min(i, j - GRAM), place + j) for i, j in zip(cut[1:], cut[2:], strict=False))]
            ctx = mix(slice_hashes(grams, first, last + length) + mix((place - first).astype(np.uint64) * np.uint64(length) + (last - first).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.view(np.int64)) for x in (*names, ctx)), *key_of(batch, at, end, row, TEXT), pa.array((first - offs[row]) << 16 | (place - first) << 8 | (last - first + 1))],
                names=["r", *(f"b{k}" for k in range(1, len(names))), "ctx", *TEXT, "span"],
            )


def _blocks(batches, length):
    """Rows (core, c1, c2, same, sub, at, n, own) of the blocks of the given spans of (same, sub, text, spans); own is a span's lowest bit.

    core names the bytes that all strings of a block share, c1 and c2 the block's context.
    """
    for batch in batches:
        for at, end, data, offs in text_chunks(batch):
            twice = [gram_hashes(data, seed) for seed in (0, 1)]
            of, span = _flat(batch.column("spans").slice(at, end - at))
            own, n, before = span & 1, (span >> 1) & 255, (span >> 9) & 255
            low = before - n + 1
            blocks = before // BLOCK - low // BLOCK + 1
            k = np.repeat(np.arange(len(span)), blocks)
            b = (low // BLOCK)[k] + np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            far, near = np.minimum(BLOCK * b + BLOCK - 1, before[k]), np.maximum(BLOCK * b, low[k])
            place = (offs[of] + (span >> 17) + before)[k]
            core = mix(slice_hashes(twice[0], place - BLOCK * b, place - BLOCK * b - BLOCK + 1 + length) + mix(b.astype(np.uint64)))
            bounds = mix((far * 256 + near).astype(np.uint64))
            context = [mix(slice_hashes(x, place - far, place - near + length) + bounds) for x in twice]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.view(np.int64)) for x in (core, *context)), *key_of(batch, at, end, of[k], TEXT), pa.array((place - far - offs[of[k]]).astype(np.int32)), pa.array((far - near + 1).astype(np.int32)), pa.array(own[k].astype(bool))],
                names=["core", "c1", "c2", *TEXT, "at", "n", "own"],
            )


def _strings(batches, length):
    """Rows (w1, w2, same, sub, at, own) of the strings at the given spans of (same, sub, text, spans); a span is place, count and own in one number."""
    for batch in batches:
        for at, end, data, offs in text_chunks(batch):
            twice = [gram_hashes(data, seed) for seed in (0, 1)]
            of, span = _flat(batch.column("spans").slice(at, end - at))
            n = (span >> 1) & 1023
            k = np.repeat(np.arange(len(span)), n)
            place = (span >> 11)[k] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            byte = offs[of[k]] + place
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(slice_hashes(x, byte, byte + length).view(np.int64)) for x in twice), *key_of(batch, at, end, of[k], TEXT), pa.array(place.astype(np.int32)), pa.array((span & 1)[k].astype(bool))],
                names=["w1", "w2", *TEXT, "at", "own"],
            )


def _long_enough(gone: np.ndarray, data: np.ndarray, offs: np.ndarray, least_words: int) -> np.ndarray:
    """gone without the runs that hold fewer whole words and are shorter than LENGTH; runs end at row bounds."""
    if not gone.any():
        return gone
    new = gone.copy()
    new[1:] &= ~gone[:-1]
    firsts = offs[:-1][np.diff(offs) > 0]
    new[firsts] = gone[firsts]
    run = np.cumsum(new)
    starts, ends, _ = word_bounds(data, offs)
    inside = gone[starts] & gone[ends - 1] & (run[starts] == run[ends - 1])
    words, size = np.bincount(run[starts[inside]], minlength=run[-1] + 1), np.bincount(run[gone], minlength=run[-1] + 1)
    return gone & ((words >= least_words) | (size >= LENGTH))[run]


def _whole_characters(gone: np.ndarray, data: np.ndarray) -> np.ndarray:
    """gone, and the other bytes of characters of which a part is gone."""
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return np.bincount(char[gone], minlength=char[-1] + 1)[char] > 0 if len(data) else gone


def _cut(batches, length, least_words, column, passed):
    """Passed columns, then n_bytes, n_removed, n_spans, kept and cut of rows with places and copy; a place is start and length in one number."""
    for batch in batches:
        for at, end, data, offs in text_chunks(batch, column):
            n, size = end - at, np.diff(offs)
            edge = np.zeros(len(data) + 1, dtype=np.int32)
            of, place = _flat(batch.column(batch.num_columns - 2).slice(at, n))
            begin = offs[of] + (place >> 20)
            stop = begin + (place & ((1 << 20) - 1))
            within = stop <= offs[of + 1] if len(of) else np.zeros(0, dtype=bool)
            np.add.at(edge, begin[within], 1)
            np.add.at(edge, stop[within], -1)
            gone = np.cumsum(edge)[:-1] > 0
            copy = batch.column(batch.num_columns - 1).slice(at, n).to_numpy(zero_copy_only=False).astype(bool) & (size >= length)
            gone |= np.repeat(copy, size)
            if least_words:
                gone = _long_enough(gone, data, offs, least_words)
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            firsts = offs[:-1][size > 0]
            starts[firsts] = gone[firsts]
            total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs]).astype(np.int64)
            lost = total(gone)

            def left(flags, kind):
                cut = np.concatenate([[0], np.cumsum(size - total(flags))]).astype(np.int32)
                return pa.Array.from_buffers(kind, n, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data[~flags]))])

            cut = left(_whole_characters(gone, data), pa.string())
            some = pa.array(lost > 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(at, n) for k in passed), pa.array(size.astype(np.int64)), pa.array(lost), pa.array(total(starts)), left(gone, pa.binary()), pc.if_else(some, cut, pa.scalar(None, pa.string()))],
                names=[*(batch.schema.names[k] for k in passed), *RESULTS],
            )


def _reranked(rows: DataFrame, name: str) -> DataFrame:
    """One doubling: pairs of rank r and name b are sorted and numbered; rows whose pair is unique drop out."""
    pairs = rows.groupBy("r", name).agg(F.count("*").alias("times")).filter("times > 1")
    ranks = stash(pairs.orderBy("r", name).withColumn("rank", F.monotonically_increasing_id()))
    return join_counts(rows, ranks, ["r", name]).drop("r", name, "times").withColumnRenamed("rank", "r")


def _run(first: Column, n: Column, length: int) -> Column:
    """The bytes of n strings from the first on: start and length in one number."""
    return first.cast("long") * (1 << 20) + n - 1 + length


def _unsettled(known: DataFrame, contexts: DataFrame, group: list[str], row: Column) -> DataFrame:
    """In groups of several contexts, the rows whose context is unique, and one of each context that isn't."""
    unlike = contexts.groupBy(*group).agg(F.count("*").alias("contexts")).filter("contexts > 1").select(*group)
    return known.filter((F.col("times") == 1) | (row == F.col("least"))).join(unlike, group, "left_semi")


def _by(step, *given):
    return releasing(lambda batches: step(batches, *given))


def _marks(rows: DataFrame, length: int) -> DataFrame:
    """(same, sub, places, copy) of the texts of (id, same, sub, text) that lose bytes: all if copy, else those of the places."""
    own, equal = one_of_each(rows.filter(F.octet_length("text") >= length))
    own = own.select(*TEXT, "text")
    text = ", ".join(("same long", "sub int"))

    seen = own.mapInArrow(_by(_grams, length), "r long").groupBy("r").agg(F.count("*").alias("times")).filter("times > 1").select("r")
    later = [f"b{k}" for k in range(1, len(prefixes(length)))]
    ranked = stash(own.mapInArrow(_by(_suffixes, length), f"{', '.join(f'{c} long' for c in ('r', *later, 'ctx'))}, {text}, span long").join(seen, "r", "left_semi"))
    for name in later:
        ranked = stash(_reranked(ranked, name), done_with=(ranked,))

    contexts = stash(ranked.groupBy("r", "ctx").agg(F.count("*").alias("times"), F.min(F.struct(*TEXT, "span")).alias("least")))
    known = stash(join_counts(ranked, contexts, ["r", "ctx"]), done_with=(ranked,))
    first, n = F.shiftright("span", 16), F.col("span").bitwiseAND(F.lit(255))
    whole = stash(known.filter("times > 1").select(*TEXT, _run(first, n, length).alias("place")))
    edges = _unsettled(known, contexts, ["r"], F.struct(*TEXT, "span")).select(*TEXT, (F.col("span") * 2 + (F.col("times") == 1).cast("int")).alias("span"))
    spans = stash(edges.groupBy(*TEXT).agg(F.collect_list("span").alias("spans")), done_with=(known, contexts))

    blocks = stash(attach(own, spans, TEXT).filter("spans is not null").mapInArrow(_by(_blocks, length), f"core long, c1 long, c2 long, {text}, at int, n int, own boolean"), done_with=(spans,))
    shared = blocks.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    blocks = stash(blocks.join(shared, "core", "left_semi"), done_with=(blocks,))
    contexts = stash(blocks.groupBy("core", "c1", "c2").agg(F.count("*").alias("times"), F.min(F.struct(*TEXT, "at")).alias("least")))
    known = stash(join_counts(blocks, contexts, ["core", "c1", "c2"]), done_with=(blocks,))
    parts = stash(known.filter("times > 1 and own").select(*TEXT, _run(F.col("at"), F.col("n"), length).alias("place")))
    edges = _unsettled(known, contexts, ["core"], F.struct(*TEXT, "at")).select(*TEXT, (F.col("at").cast("long") * 2048 + F.col("n") * 2 + (F.col("own") & (F.col("times") == 1)).cast("int")).alias("span"))
    spans = stash(edges.groupBy(*TEXT).agg(F.collect_list("span").alias("spans")), done_with=(known, contexts))

    strings = stash(attach(own, spans, TEXT).filter("spans is not null").mapInArrow(_by(_strings, length), f"w1 long, w2 long, {text}, at int, own boolean"), done_with=(spans,))
    again = stash(strings.groupBy("w1", "w2").agg(F.count("*").alias("times")).filter("times > 1"))
    hits = join_counts(strings.filter("own"), again, ["w1", "w2"], total=strings.count()).select(*TEXT, _run(F.col("at"), F.lit(1), length).alias("place"))

    found = whole.unionByName(parts).unionByName(hits).groupBy(*TEXT).agg(F.collect_list("place").alias("places")).withColumn("copy", F.lit(False))
    found = found.unionByName(equal.select(*TEXT, F.lit(None).cast("array<long>").alias("places"), F.lit(True).alias("copy")))
    return stash(found.groupBy(*TEXT).agg(F.max("places").alias("places"), F.max("copy").alias("copy")), done_with=(whole, parts, strings, again))


RESULTS = ("n_bytes", "n_removed", "n_spans", "kept", "cut")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the other bytes, as binary), and cut, their text.

    cut leaves out characters of which a part is removed, and is null where nothing is. Strings of
    `length` bytes count as repeats; of the runs that they cover, those of least_words whole words or
    of LENGTH bytes go, or all with least_words 0.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return _removed(rows, "text", length, least_words).select("id", *RESULTS)


def _removed(docs: DataFrame, text: str, length: int, least_words: int) -> DataFrame:
    """The columns of docs but for those named as a result, and the results."""
    if length < 2 * GRAM:
        raise ValueError(f"length is {length}; it must be at least {2 * GRAM}")
    named = [F.xxhash64(F.col(text)).alias("same"), F.hash(F.col(text)).alias("sub")]
    marks = _marks(docs.select(F.lit(0).alias("id"), *named, F.col(text).alias("text")), length)
    held = docs.select(F.struct(*docs.columns).alias("row"), *named)
    marked = attach(held, marks, TEXT).select("row.*", F.col("places").alias("_places"), F.coalesce("copy", F.lit(False)).alias("_copy"))
    passed = [k for k, c in enumerate(docs.columns) if c.lower() not in RESULTS]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), T.StringType()]
    schema = T.StructType([*(docs.schema[k] for k in passed), *(T.StructField(*x) for x in zip(RESULTS, kinds, strict=True))])
    return marked.mapInArrow(_by(_cut, length, least_words, docs.columns.index(text), passed), schema)


def cut_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """docs with the repeats cut from its texts; all other columns stay as they are, whatever their names."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    out = _removed(docs.toDF(*names), of[text], length, least_words)
    return out.select(*(F.coalesce("cut", n).alias(c) if c == text else F.col(n).alias(c) for c, n in of.items()))
