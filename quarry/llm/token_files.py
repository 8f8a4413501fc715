"""Token ids in Parquet: list columns, controlled row groups and pages, in order of the key.

write_tokens sorts texts by a key over ranges, encodes them with the tokenizers library and writes
one file per range through Spark's own writer. A file holds key, n_tokens, start_in_file and the
ids, as a dictionary-encoded or delta-encoded list column in zstd. Row groups and pages are small
enough that the page index lets a reader take the ids or metadata of a range of keys alone.
read_tokens takes a range of keys or some columns alone, and adds each document's start among all
ids, from totals of the files.

A text's ids depend on its pieces alone, so the library encodes each new piece of a batch once and
a bounded cache gives the rest. Only one range's texts meet in a task.

Null and empty texts have the end id only. Rows that repeat a key follow each other in order of
text; null keys come first. Empty tables read back empty. Extra columns are left out.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._pieces import split_pieces
from ._shared import kept, releasing, text_chunks

END_ID = 1
#: Of so many entries and ids, of pieces of at most so many characters, the cache stays under 75 MB in each worker; longer pieces aren't kept.
CACHED_PIECES, CACHED_IDS, LONGEST_PIECE = 250_000, 2_000_000, 64
_JOINED = 256


class LibraryPieces(dict):
    """Ids of pieces by the tokenizers library: piece to its number, and the ids of all numbers in one array. None stands for the end of a text.

    When there are too many, only the short pieces of the texts at hand stay.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # pieces are normalised and split when they come: a second time could order their marks anew, and its pattern costs as much as the merges
        split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] != "Split")]}
        self.tokenizer = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": split, "added_tokens": []}))
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.last[k] = token.endswith("</w>")
        self.fixed = {None: end_id} | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._only([], np.zeros(0, dtype="<i4"), np.zeros(0, dtype=np.int64))

    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self.names)
        self.names.append(piece)
        return code

    def _only(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Starts anew with the fixed pieces and the given ones."""
        self.clear()
        self.names = [*self.fixed, *names]
        self.update(zip(self.names, range(len(self.names)), strict=True))
        self.ids, self.starts, self.sizes = np.zeros(0, dtype="<i4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pieces = self.used = 0
        self._add(np.array([*self.fixed.values()], dtype="<i4"), np.ones(len(self.fixed), dtype=np.int64))
        self._add(ids, sizes)

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The next numbers' ids; arrays are twice as long when they are full."""
        n, k = self.used + len(ids), self.pieces + len(sizes)
        if n > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * n - self.used, dtype="<i4")])
        if k > len(self.sizes):
            more = np.zeros(2 * k - self.pieces, dtype=np.int64)
            self.starts, self.sizes = np.concatenate([self.starts[: self.pieces], more]), np.concatenate([self.sizes[: self.pieces], more])
        self.ids[self.used : n] = ids
        self.sizes[self.pieces : k] = sizes
        self.starts[self.pieces : k] = self.used + np.cumsum(sizes) - sizes
        self.used, self.pieces = n, k

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces several at a time; their last tokens tell them apart."""
        lots = [pieces[k : k + _JOINED] for k in range(0, len(pieces), _JOINED)]
        for lot, got in zip(lots, self._ids([" ".join(lot) for lot in lots]), strict=True):
            got = np.array(got, dtype="<i4")
            cut = np.flatnonzero(self.last[got]) + 1
            if len(cut) != len(lot) or cut[-1] != len(got):
                each = self._ids(lot)
                got, cut = np.array([k for own in each for k in own], dtype="<i4"), np.cumsum([len(own) for own in each])
            self._add(got, np.diff(cut, prepend=0))

    @property
    def known(self) -> LibraryPieces:
        return self

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit values, without the end id."""
        ids, ends = self.encode_all(texts)
        ends = ends.tolist()
        return [ids[a : b - 1].tobytes() for a, b in zip([0, *ends], ends, strict=False)]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, as 32-bit values; where each text ends in them)."""
        split = [[*split_pieces(t, self.path), None] if t else [None] for t in texts]
        before = len(self.names)
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sum(map(len, split)))
        if len(self.names) > before:
            self._learn(self.names[before:])
        sizes = self.sizes[codes]
        to = np.cumsum(sizes)
        out = self.ids[np.repeat(self.starts[codes] - (to - sizes), sizes) + np.arange(to[-1] if len(to) else 0)]
        for k in range(before, len(self.names)):
            if len(self.names[k]) > LONGEST_PIECE:
                del self[self.names[k]]
                self.names[k] = ""
        if len(self) > CACHED_PIECES or self.used > CACHED_IDS:
            stay = [k for k in np.unique(codes).tolist() if k >= len(self.fixed) and self.names[k]]
            here = [self.ids[self.starts[k] : self.starts[k] + self.sizes[k]] for k in stay]
            self._only([self.names[k] for k in stay], np.concatenate([np.zeros(0, dtype="<i4"), *here]), self.sizes[stay])
        return out, to[np.cumsum([len(p) for p in split]) - 1] if split else to


@kept
def library(path: str, end_id: int = END_ID) -> LibraryPieces:
    return LibraryPieces(path, end_id)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes the files. encoding: "dictionary", or "delta" for delta-packed ids."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")

    def run(batches):
        model, start = library(tokenizer, end_id), 0
        for batch in batches:
            for at, stop, _, _ in text_chunks(batch, "text"):
                values, ends = model.encode_all(batch.column("text").slice(at, stop - at).to_pylist())
                offs = np.concatenate([[0], ends])
                ids = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, stop - at), pa.array(np.diff(offs)), pa.array(start + offs[:-1]), ids], names=["key", "n_tokens", "start_in_file", "ids"])
                start += int(offs[-1])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    ordered.mapInArrow(releasing(run, keeps=True), f"key {kind}, n_tokens long, start_in_file long, ids array<int>").write.options(
        **{
            "compression": "zstd",
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.size": str(page_bytes),
            "maxRecordsPerFile": "0",
        }
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str, low=None, high=None, columns: tuple[str, ...] = ("key", "n_tokens", "start", "ids")) -> DataFrame:
    """The given of key, n_tokens, ids and start (how many ids come before the document's), of keys from low to high.

    Bounds reach the scan, where row groups and pages without such keys are skipped, and columns that
    are not asked for are not read. Totals come from the small columns alone, and only if start is asked for.
    """
    files = spark.read.parquet(path)
    files = files if low is None else files.filter(F.col("key") >= low)
    files = files if high is None else files.filter(F.col("key") <= high)
    if "start" not in columns:
        return files.select(*columns)
    files = files.select("*", F.col("_metadata.file_path").alias("file"))
    totals = spark.read.parquet(path).select("key", "n_tokens", F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.min("key").alias("first"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    both = files.join(F.broadcast(starts), "file")  # a row per file
    return both.withColumn("start", F.col("before") + F.col("start_in_file")).select(*columns)


def with_crc32(tokens: DataFrame) -> DataFrame:
    """key, start, n_tokens, and the unsigned crc32 of the ids as little-endian 32-bit values."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            offs = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            crc = np.array([zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc)], names=["key", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["key"].dataType.simpleString()
    return tokens.select("key", "start", "ids").mapInArrow(run, f"key {kind}, start long, n_tokens long, ids_crc32 long")
