"""Substring dedup by seed and extend over words.

Seeds are winnowed anchors: of every SPREAD consecutive runs of ANCHOR_WORDS words, the one with
the smallest hash. ANCHOR_WORDS + SPREAD - 1 is the window length, so that each window holds an
anchor that its own words select, and equal windows select equal anchors. Anchors that several
texts share join their texts; each is extended both ways to all the windows that selected it, and
windows are joined by two hashes of their words. A word is removed if a window that covers it also
starts in a text with a smaller key; the maximal runs of such words are the repeats.

Equal texts are joined first: one row stands in for all, with the smallest key, and rows of a larger
key lose every word that a window covers. Anchors and windows are counted before the shuffle, and
the counts of the few most frequent windows go to their rows by broadcast, so that a passage that
a third of all texts share lands in no single task. Texts meet only their own positions. A window's
two hashes have 64 bits each and come from two independent hashes of each word.

Null and empty texts have no words. Texts shorter than a window lose nothing. Rows that repeat a
key with different texts are judged each by its own text, and do not remove each other's words; null
keys lose nothing and remove nothing. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import attach, releasing, stash, text_chunks, window_argmin, window_hashes, word_bounds, word_hashes

WINDOW_WORDS = 13
ANCHOR_WORDS = 5
SPREAD = WINDOW_WORDS - ANCHOR_WORDS + 1
#: A key with more than this share of the rows is hot; at most its inverse can be.
HOT_SHARE = 0.001


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, hash, first, last) of each anchor: the windows that start at words first..last of the row select it."""
    starts, ends, row = word_bounds(data, offs)
    h = word_hashes(data, starts, ends)
    grams = window_hashes(h, ANCHOR_WORDS)
    least = window_argmin(grams, SPREAD)
    n = len(h) - WINDOW_WORDS + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none.view(np.uint64), none, none
    begin = np.flatnonzero(row[:n] == row[WINDOW_WORDS - 1 :])
    at = least[begin]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (row[begin[1:]] != row[begin[:-1]])
    k = np.flatnonzero(new)
    last = np.append(k[1:], len(at)) - 1
    of = row[begin[k]]
    base = np.searchsorted(row, of)
    return of, grams[at[k]], begin[k] - base, begin[last] - base


def key_of(batch: pa.RecordBatch, at: int, end: int, of: np.ndarray, keys: tuple[str, ...] = ("id", "sub")) -> list[pa.Array]:
    """The key columns of the given rows of [at, end)."""
    of = pa.array(of)
    return [batch.column(c).slice(at, end - at).take(of) for c in keys]


@releasing
def _anchors(batches):
    """Rows (anchor, id, sub, span) from (id, sub, text); a span is the first window and how many follow it."""
    for batch in batches:
        for at, end, data, offs in text_chunks(batch):
            row, h, first, last = anchors(data, offs)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *key_of(batch, at, end, row), pa.array((first * 16 + last - first).astype(np.int32))], names=["anchor", "id", "sub", "span"])


@releasing
def _anchor_names(batches):
    """Rows (anchor), each once per text."""
    for batch in batches:
        for _, _, data, offs in text_chunks(batch):
            row, h, _, _ = anchors(data, offs)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64))], names=["anchor"])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column of integers; null is empty."""
    lists = lists.fill_null([]) if lists.null_count else lists
    offs = lists.offsets.to_numpy()
    return np.repeat(np.arange(len(lists)), np.diff(offs)), lists.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]].astype(np.int64)


@releasing
def _windows(batches):
    """Rows (w1, w2, id, sub, at) of the windows at the given spans of (id, sub, text, spans)."""
    for batch in batches:
        for at, end, data, offs in text_chunks(batch):
            starts, ends, row = word_bounds(data, offs)
            w1, w2 = (window_hashes(word_hashes(data, starts, ends, seed=k), WINDOW_WORDS) for k in (0, 1))
            of, span = _flat(batch.column("spans").slice(at, end - at))
            n = (span & 15) + 1
            k = np.repeat(np.arange(len(span)), n)
            place = (span >> 4)[k] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            word = np.searchsorted(row, of[k]) + place
            yield pa.RecordBatch.from_arrays([pa.array(w1[word].view(np.int64)), pa.array(w2[word].view(np.int64)), *key_of(batch, at, end, of[k]), pa.array(place.astype(np.int32))], names=["w1", "w2", "id", "sub", "at"])


def join_counts(rows: DataFrame, counts: DataFrame, keys: list[str], count: str = "times", total: int | None = None) -> DataFrame:
    """rows.join(counts, keys) of two stashed tables, in which counts has how many rows each key has.

    Hot keys are 1 / HOT_SHARE at most and are joined by broadcast, so no task gets a hot key's rows.
    """
    most = HOT_SHARE * (rows.count() if total is None else total)
    hot, cold = counts.filter(F.col(count) > most), counts.filter(F.col(count) <= most)
    plain = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return plain.unionByName(rows.join(F.broadcast(hot), keys))


def one_of_each(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of each text, the texts that occur again) of (id, same, sub, text); same and sub name a text.

    The row that stands in for equal texts has the smallest id. Only texts that occur again move.
    """
    names = ["same", "sub"]
    equal = stash(rows.groupBy(*names).agg(F.min("id").alias("owner"), F.count("*").alias("times")).filter("times > 1").select(*names, "owner"))
    again = attach(rows, equal, ("same", "sub"), "left_semi")
    first = stash(again.groupBy(*names).agg(F.min("id").alias("id"), F.min("text").alias("text")))
    return attach(rows, equal, ("same", "sub"), "left_anti").unionByName(first.select(*rows.columns)), equal


@releasing
def _removed(batches):
    """Rows (id, n_words, n_removed, kept) from (id, text, places, copy): starts of covered windows, or all of a copy's."""
    for batch in batches:
        for at, end, data, offs in text_chunks(batch):
            n = end - at
            starts, ends, row = word_bounds(data, offs)
            base = np.searchsorted(row, np.arange(n + 1))
            cover = np.zeros(len(row) + WINDOW_WORDS + 1, dtype=np.int32)
            of, place = _flat(batch.column("places").slice(at, n))
            np.add.at(cover, base[of] + place, 1)
            np.add.at(cover, base[of] + place + WINDOW_WORDS, -1)
            gone = np.cumsum(cover)[: len(row)] > 0
            words = np.diff(base)
            copy = batch.column("copy").slice(at, n).to_numpy(zero_copy_only=False).astype(bool) & (words >= WINDOW_WORDS)
            gone |= np.repeat(copy, words)
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[base])
            raw, kept = data.tobytes(), []
            keep = np.flatnonzero(~gone)
            cut = np.searchsorted(keep, base)
            s, e = starts[keep].tolist(), ends[keep].tolist()
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                kept.append(b" ".join([raw[p:q] for p, q in zip(s[i:j], e[i:j], strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, n), pa.array(words.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed and kept (the words that stay, joined by one space)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("same"), F.hash(F.col(text)).alias("sub"), F.col(text).alias("text"))
    own, equal = one_of_each(rows.filter("id is not null and text is not null"))
    texts = own.select("id", "sub", "text")

    shared = texts.mapInArrow(_anchor_names, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    seeds = texts.mapInArrow(_anchors, "anchor long, id long, sub int, span int").join(shared, "anchor", "left_semi")
    spans = stash(seeds.groupBy("id", "sub").agg(F.collect_list("span").alias("spans")))
    seeded = attach(texts, spans).filter("spans is not null")
    windows = stash(seeded.mapInArrow(_windows, "w1 long, w2 long, id long, sub int, at int"), done_with=(spans,))
    first = stash(windows.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("times")).filter("low < high").select("w1", "w2", "low", "times"))
    hits = join_counts(windows, first, ["w1", "w2"]).filter("id > low")
    places = stash(hits.groupBy("id", "sub").agg(F.collect_list("at").alias("places")), done_with=(windows, first))
    found = places.join(own.select("id", "same", "sub"), ["id", "sub"]).select("same", "sub", F.lit(None).cast("long").alias("owner"), "places")
    marks = found.unionByName(equal.withColumn("places", F.lit(None).cast("array<int>"))).groupBy("same", "sub").agg(F.max("owner").alias("owner"), F.max("places").alias("places"))
    marks = stash(marks, done_with=(places,))
    null = F.col("id").isNull()
    marked = attach(rows, marks, ("same", "sub")).select("id", "text", F.when(~null, F.col("places")).alias("places"), (~null & F.coalesce(F.col("owner") < F.col("id"), F.lit(False))).alias("copy"))
    return marked.mapInArrow(_removed, "id long, n_words long, n_removed long, kept string")
