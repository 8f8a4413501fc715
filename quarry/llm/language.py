"""Language identification with error-correcting output codes.

Each language has a codeword of plus and minus ones. One binary classifier per bit of the code is
fitted on hashed byte n-grams; a text goes to the language whose codeword has the least total
logistic loss, each bit weighted by how well its classifier separates the sample. Two codewords
that are almost as near flag the text as ambiguous.

The classifiers are fitted on a sample of labelled rows of about SAMPLE_ROWS (a parameter), taken
by a hash of a key column; n-gram counts are made on the executors and only those of the sample
reach the driver. Prediction maps over whole texts, needs no shuffle, and ships a model of fixed
size.

Results in special cases: null text, empty text, or no letter gives "und", score 0, ambiguous.
Without any labelled row every text is "und". With one language every text with a letter is that
language with score 1. Equal losses go to the first language in order of name. Extra columns pass
through; existing result columns, in whatever case, are replaced. Repeated rows are predicted alike.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import LOWER, releasing, text_chunks

SAMPLE_ROWS = 3000
DIMENSIONS = 4096
UNDETERMINED = "und"
AMBIGUOUS_MARGIN = 0.02
#: Texts whose counts are made at once; the arrays of a step are a few times 4,096 numbers a text.
BATCH_ROWS = 128

#: ASCII that is not a letter counts as one separator, so that layout does not look like a language.
_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def ngram_counts(data: np.ndarray, offs: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of hashed 1- to 3-byte grams of folded text, a row per text; runs of separators count once."""
    n_rows = len(offs) - 1
    out = np.zeros((n_rows, dimensions), dtype=np.float32)
    if not len(data):
        return out
    b = _FOLD[data]
    row = np.repeat(np.arange(n_rows, dtype=np.int64), np.diff(offs))
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (row[1:] != row[:-1])
    b, row = b[keep].astype(np.uint32), row[keep]
    code = np.zeros(len(b), dtype=np.uint32)
    for n in (1, 2, 3):
        code = b.copy() if n == 1 else code[:-1] * np.uint32(256) + b[n - 1 :]
        slot = ((code + np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - (dimensions - 1).bit_length())
        same = row[: len(slot)] == row[n - 1 :]
        at = row[: len(slot)] * dimensions + slot
        out += np.bincount(at[same], minlength=n_rows * dimensions).reshape(n_rows, dimensions)
    return out


def _scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A row of plus and minus ones per class: all splits for few classes, far-apart random rows for more."""
    if classes <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=classes) if s[0] == 1 and -1 in s]
        return np.array(splits or [[1] * classes], dtype=np.float32).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(classes)))
    best, most = None, -1
    for _ in range(200):
        code = rng.choice(np.array([1, -1], dtype=np.float32), size=(classes, bits))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(classes) * code.shape[1]
        if apart.min() > most:
            best, most = code, apart.min()
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """Weighted mean logistic loss of each language's codeword, a row per text."""
        f = _scaled(counts) @ self.weights + self.bias
        agree = np.logaddexp(0, -f)
        differ = np.logaddexp(0, f)
        w = self.bit_weight / self.bit_weight.sum()
        return (agree * w) @ (self.code.T > 0) + (differ * w) @ (self.code.T < 0)


def fit(counts: np.ndarray, languages: list[str], steps: int = 150, rate: float = 2.0, decay: float = 1e-5) -> LanguageModel:
    """Fits the bits' classifiers by full-batch gradient descent with momentum; classes weigh alike."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.zeros((0, 1), np.float32), np.zeros((counts.shape[1], 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    code = codewords(len(names))
    of = np.array([names.index(x) for x in languages])
    share = 1 / (len(names) * np.bincount(of, minlength=len(names)))
    x, y = _scaled(counts).astype(np.float32), code[of]
    row_weight = share[of][:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        g = -y * row_weight / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        vw = 0.9 * vw + x.T @ g + decay * w
        vb = 0.9 * vb + g.sum(axis=0)
        w -= rate * 4 * vw
        b -= rate * vb
    right = ((y * (x @ w + b) > 0) * row_weight).sum(axis=0)
    sure = np.clip(right, 0.5 + 1e-3, 1 - 1e-3)
    return LanguageModel(names, code, w, b, np.log(sure / (1 - sure)).astype(np.float32))


def learn(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits on about sample_rows rows among those usable with a language, taken by a hash of the key."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    span = 1 << 30
    share = min(1.0, sample_rows / max(1, rows.select("k").count()))
    rows = rows.filter(F.pmod(F.xxhash64("k"), F.lit(span)) < int(share * span)).select("lang", "text")

    @releasing
    def run(batches):
        for batch in batches:
            for at, end, data, offs in text_chunks(batch, rows=BATCH_ROWS):
                counts = ngram_counts(data, offs)
                places = [np.flatnonzero(c).astype(np.int32) for c in counts]
                yield pa.RecordBatch.from_pylist(
                    [{"lang": la, "slot": p, "n": c[p]} for la, p, c in zip(batch.column("lang").slice(at, end - at).to_pylist(), places, counts, strict=True)],
                    schema=pa.schema([("lang", pa.string()), ("slot", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))]),
                )

    got = rows.mapInArrow(run, "lang string, slot array<int>, n array<float>").limit(2 * sample_rows).toArrow().sort_by("lang")
    counts = np.zeros((got.num_rows, DIMENSIONS), dtype=np.float32)
    for k, (slot, n) in enumerate(zip(got["slot"], got["n"], strict=True)):
        counts[k, slot.values.to_numpy(zero_copy_only=False) if len(slot) else []] = n.values.to_numpy(zero_copy_only=False) if len(n) else []
    order = np.lexsort((counts[:, :64] @ np.arange(1, 65), counts.sum(axis=1))) if got.num_rows else np.zeros(0, dtype=int)
    names = got["lang"].to_pylist()
    return fit(counts[order], [names[k] for k in order])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", margin: float = AMBIGUOUS_MARGIN) -> DataFrame:
    """Adds lang_pred, lang_score (0 to 1) and lang_ambiguous (the two best languages' scores are within margin)."""
    added = [("lang_pred", T.StringType()), ("lang_score", T.DoubleType()), ("lang_ambiguous", T.BooleanType())]
    names = [a for a, _ in added]
    schema = T.StructType([*(f for f in docs.schema if f.name.lower() not in names), *(T.StructField(*a) for a in added)])
    languages = np.array([*model.languages, UNDETERMINED], dtype=object)

    @releasing
    def run(batches):
        for batch in batches:
            keep = [k for k, f in enumerate(batch.schema) if f.name.lower() not in names]
            texts = batch.column(batch.schema.get_field_index(text))
            for at, end, data, offs in text_chunks(batch, text, rows=BATCH_ROWS):
                n = end - at
                letters = np.diff(np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])[offs]) > 0
                for k in np.flatnonzero(~letters):
                    t = texts[at + int(k)].as_py()
                    letters[k] = t is not None and any(map(str.isalpha, t))
                best, score, unsure = np.full(n, len(model.languages)), np.zeros(n), np.ones(n, dtype=bool)
                if model.languages:
                    loss = model.losses(ngram_counts(data, offs)).astype(np.float64)
                    p = np.exp(-8 * (loss - loss.min(axis=1, keepdims=True)))
                    p /= p.sum(axis=1, keepdims=True)
                    ranked = np.sort(p, axis=1)
                    second = ranked[:, -2] if p.shape[1] > 1 else 0
                    best = np.where(letters, p.argmax(axis=1), best)
                    score = np.where(letters, ranked[:, -1], 0.0)
                    unsure = ~letters | (ranked[:, -1] - second < margin)
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), pa.array(languages[best].tolist(), pa.string()), pa.array(score), pa.array(unsure)],
                    names=[*(batch.schema.names[k] for k in keep), *names],
                )

    return docs.mapInArrow(run, schema)
