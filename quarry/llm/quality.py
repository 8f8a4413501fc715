"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's features are its distinct words, hashed, weighted by damped counts, and one-hot bins of
statistics of its structure (shares of capitals, digits, marks, repeated words and lines, ...) and
of its length. A score is the logistic of a bias, linear weights, and low-rank interactions of all
pairs of features, each factor being half of (sum of v x) squared less the sum of (v x) squared.

The model is fitted by the driver on the features of about SAMPLE_ROWS labelled rows (a
parameter), taken by a hash of the key. Scoring maps over whole texts without a shuffle and
ships a model of fixed size.

Null and empty texts have no words and zero statistics and get the score of those features. With no
labelled row, every score is 0.5. Repeated rows score alike. Label rows with a null label or
without a document are left out; of several labels for one document each counts. Extra columns
pass through; an existing result column, in whatever case, is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import mix, releasing, text_chunks, word_bounds, word_hashes

SAMPLE_ROWS = 6000
WORD_SLOTS = 1 << 13
BINS = 12
RANK = 4
STATISTICS = (
    "log_bytes", "log_words", "word_length", "longest_word", "capitals", "digits", "marks", "wide", "lines_per_byte", "spaces",
    "distinct_words", "top_word", "repeated_pairs", "distinct_lines", "marked_words", "capital_words", "short_words", "symbols", "kinds_of_words", "doubled_marks",
)

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
_SYMBOL = np.array([b < 128 and chr(b) in "#$%&*+/<=>@\\^_`{|}~[]" for b in range(256)])
_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offs]).astype(np.float64)


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, count) of the distinct values of each row; rows < 2048."""
    key = np.sort(row.astype(np.uint64) << np.uint64(53) | h >> np.uint64(11))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return (key[first] >> np.uint64(53)).astype(np.int64), key[first] & np.uint64((1 << 53) - 1), np.diff(np.append(first, len(key)))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of the words and a row of STATISTICS for each text."""
    rows = len(offs) - 1
    size = np.maximum(np.diff(offs), 1).astype(np.float64)
    starts, ends, row = word_bounds(data, offs)
    h = word_hashes(data, starts, ends)
    n_words = np.bincount(row, minlength=rows).astype(np.float64)
    words = np.maximum(n_words, 1)
    length = (ends - starts).astype(np.float64)
    r, value, count = _distinct(row, h, rows)
    damped = np.log1p(count)
    norm = np.sqrt(np.bincount(r, weights=damped * damped, minlength=rows))
    x = damped / norm[r] if len(r) else damped
    slot = (mix(value) % np.uint64(WORD_SLOTS)).astype(np.int64)

    pair_row = row[1:][row[1:] == row[:-1]]
    pairs = (h[:-1] * np.uint64(3) + h[1:])[row[1:] == row[:-1]]
    pr, _, _ = _distinct(pair_row, mix(pairs), rows)
    n_pairs = np.bincount(pair_row, minlength=rows)
    lines = np.ones(256, dtype=bool)
    lines[10] = False
    ls, le, lr = word_bounds(data, offs, ~lines)
    dr, _, _ = _distinct(lr, word_hashes(data, ls, le), rows)
    n_lines = np.bincount(lr, minlength=rows)
    marks, last_mark = _MARK[data], np.zeros(len(row), dtype=bool)
    if len(row):
        last_mark = marks[ends - 1]
    doubled = np.zeros(len(data), dtype=bool)
    doubled[1:] = marks[1:] & marks[:-1]
    first_upper = _UPPER[data[starts]] if len(row) else last_mark
    top = np.zeros(rows)
    np.maximum.at(top, r, count)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    by_word = lambda flags: np.bincount(row, weights=flags, minlength=rows) / words
    columns = [
        np.log1p(np.diff(offs)), np.log1p(n_words), by_word(length), np.log1p(longest), _per_row(_UPPER[data], offs) / size, _per_row(_DIGIT[data], offs) / size,
        _per_row(marks, offs) / size, _per_row(data >= 128, offs) / size, _per_row(data == 10, offs) / size, _per_row(_SPACE[data], offs) / size,
        np.bincount(r, minlength=rows) / words, top / words, 1 - np.bincount(pr, minlength=rows) / np.maximum(n_pairs, 1), np.bincount(dr, minlength=rows) / np.maximum(n_lines, 1),
        by_word(last_mark), by_word(first_upper), by_word(length <= 3), _per_row(_SYMBOL[data], offs) / size, np.log1p(np.bincount(r, minlength=rows)), _per_row(doubled, offs) / size,
    ]
    return r, slot, x, np.stack(columns, axis=1)


@dataclass(frozen=True)
class QualityModel:
    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, r: np.ndarray, slot: np.ndarray, x: np.ndarray, stats: np.ndarray) -> np.ndarray:
        rows = len(stats)
        at = _bins(stats, self.edges)
        each = 1 / np.sqrt(stats.shape[1])
        total = self.bias + np.bincount(r, weights=self.linear[slot] * x, minlength=rows) + each * self.linear[at].sum(axis=1)
        for v in self.factors.T:
            word, bin_ = v[slot] * x, v[at] * each
            s = np.bincount(r, weights=word, minlength=rows) + bin_.sum(axis=1)
            total += 0.5 * (s * s - np.bincount(r, weights=word * word, minlength=rows) - (bin_ * bin_).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _bins(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The slot of each statistic's bin."""
    out = np.empty(stats.shape, dtype=np.int64)
    for k in range(stats.shape[1]):
        out[:, k] = WORD_SLOTS + k * BINS + np.searchsorted(edges[k], stats[:, k], side="right")
    return out


def fit(r: np.ndarray, slot: np.ndarray, x: np.ndarray, stats: np.ndarray, label: np.ndarray, epochs: int = 12, rate: float = 0.15, decay: float = 2e-5, batch: int = 128, seed: int = 11) -> QualityModel:
    """Minimises logistic loss by AdaGrad over small batches; r must be in ascending order."""
    slots = WORD_SLOTS + stats.shape[1] * BINS
    rng = np.random.default_rng(seed)
    linear, factors, bias = np.zeros(slots), rng.normal(0, 0.05, (slots, RANK)), 0.0
    if not len(label):
        return QualityModel(np.zeros((stats.shape[1], BINS - 1)), 0.0, linear, factors * 0)
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    each = 1 / np.sqrt(stats.shape[1])
    at = _bins(stats, edges)
    bounds = np.searchsorted(r, np.arange(len(label) + 1))
    g_linear, g_factors, g_bias = np.full(slots, 1e-3), np.full((slots, RANK), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for b in range(0, len(order), batch):
            ids = np.sort(order[b : b + batch])
            sizes = bounds[ids + 1] - bounds[ids]
            entry = np.repeat(bounds[ids] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            rows = np.concatenate([np.repeat(np.arange(len(ids)), sizes), np.repeat(np.arange(len(ids)), at.shape[1])])
            cols = np.concatenate([slot[entry], at[ids].ravel()])
            vals = np.concatenate([x[entry], np.full(at[ids].size, each)])
            vx = factors[cols] * vals[:, None]
            s = np.stack([np.bincount(rows, weights=vx[:, f], minlength=len(ids)) for f in range(RANK)], axis=1)
            q = np.bincount(rows, weights=(vx * vx).sum(axis=1), minlength=len(ids))
            z = bias + np.bincount(rows, weights=linear[cols] * vals, minlength=len(ids)) + 0.5 * ((s * s).sum(axis=1) - q)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[ids]) / 1.0
            used, place = np.unique(cols, return_inverse=True)
            e = err[rows] * vals
            gl = np.bincount(place, weights=e, minlength=len(used)) / len(ids) + decay * linear[used]
            grad = e[:, None] * (s[rows] - vx)
            gf = np.stack([np.bincount(place, weights=grad[:, f], minlength=len(used)) for f in range(RANK)], axis=1) / len(ids) + decay * factors[used]
            g_linear[used] += gl * gl
            g_factors[used] += gf * gf
            linear[used] -= rate * gl / np.sqrt(g_linear[used])
            factors[used] -= 0.3 * rate * gf / np.sqrt(g_factors[used])
            gb = err.mean()
            g_bias += gb * gb
            bias -= rate * gb / np.sqrt(g_bias)
    return QualityModel(edges, float(bias), linear, factors)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fits on about sample_rows of the given label rows, taken by a hash of the key."""
    rows = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    span = 1 << 30
    share = min(1.0, sample_rows / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64("k"), F.lit(span)) < int(share * span)).limit(2 * sample_rows)
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(rows), "k").select("k", "y", "text")

    @releasing
    def run(batches):
        for batch in batches:
            for at, end, data, offs in text_chunks(batch, rows=512):
                r, slot, x, stats = features(data, offs)
                cut = np.searchsorted(r, np.arange(end - at + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("k").slice(at, end - at),
                        batch.column("y").slice(at, end - at),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(slot.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(x)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32)), pa.array(stats.ravel())),
                    ],
                    names=["k", "y", "slot", "x", "stats"],
                )

    kind = sample.schema["k"].dataType.simpleString()
    got = sample.mapInArrow(run, f"k {kind}, y int, slot array<int>, x array<double>, stats array<double>").toArrow().sort_by([("k", "ascending"), ("y", "ascending")]).combine_chunks()
    if not got.num_rows:
        return fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros((0, len(STATISTICS))), np.zeros(0))
    flat = lambda name: got[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = np.array([len(s) for s in got["slot"]])
    return fit(np.repeat(np.arange(got.num_rows), sizes), flat("slot").astype(np.int64), flat("x"), flat("stats").reshape(got.num_rows, -1), got["y"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: QualityModel, text: str = "text", into: str = "quality_score") -> DataFrame:
    """Adds the score (0 to 1, higher: label 1 likelier) of each text."""
    schema = T.StructType([*(f for f in docs.schema if f.name.lower() != into.lower()), T.StructField(into, T.DoubleType())])

    @releasing
    def run(batches):
        for batch in batches:
            keep = [k for k, f in enumerate(batch.schema) if f.name.lower() != into.lower()]
            for at, end, data, offs in text_chunks(batch, text, rows=1024):
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(model.score(*features(data, offs)))], names=[*(batch.schema.names[k] for k in keep), into])

    return docs.mapInArrow(run, schema)
