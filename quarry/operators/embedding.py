"""Embeddings of text columns by any model: texts are tidied, embedded once each and joined back to their rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class Embedder(Protocol):
    """A model: unit vectors of `dimension` for a list of texts. It is made once in each Python worker."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@lru_cache(maxsize=1 << 16)
def _slot(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:7], 16)


class HashingEmbedder:
    """Signed hashing of words: a model without weights, for tests and for work without a network."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall("[a-z0-9_]+", text.lower()):
                h = _slot(word)
                row[h // 2 % self.dimension] += 1 - 2 * (h % 2)
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def embed(docs: DataFrame, make: Callable[[], Embedder], text: str = "text", mode: str | None = "passage", into: str = "embedding", batch: int = 256) -> DataFrame:
    """docs with a vector per text; blank texts have zeros, and a null text has a blank's vector.

    mode: the prefix that models of the E5 family expect, or None. Each distinct text is embedded once
    and its vector goes back to its rows by a join of hashes; make is called in each Python worker.
    """
    tidy = T.normalize_spaces(F.coalesce(F.col(text), F.lit("")))
    asked = tidy if mode is None else T.prefixed(tidy, mode)
    rows = docs.withColumns({"_a": F.xxhash64(tidy), "_b": F.xxhash64(F.lit(1), tidy)})
    distinct = rows.groupBy("_a", "_b").agg(F.min(F.struct(F.trim(tidy) == "", asked)).alias("_t")).select("_a", "_b", F.col("_t.col1").alias("blank"), F.col("_t.col2").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for part in batches:
            for at in range(0, part.num_rows, batch):
                some = part.slice(at, batch)
                x = model.embed(some.column("asked").to_pylist()).astype(np.float32)
                x[some.column("blank").to_numpy(zero_copy_only=False).astype(bool)] = 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([some.column("_a"), some.column("_b"), lists], names=["_a", "_b", "_v"])

    vectors = distinct.mapInArrow(run, "_a long, _b long, _v array<float>")
    kept = [c for c in docs.columns if c != into]
    return rows.join(vectors, ["_a", "_b"]).select(*kept, F.col("_v").alias(into))
