"""BPE encoding and decoding by per-prefix dynamic programming.

Of every prefix of a piece exactly one token can be the last of its encoding. An automaton over
the vocabulary gives the tokens that end at each place; the one that is compatible with the last
token of the prefix before it is stored, and the stored tokens are followed back from the end.
Two neighbours are compatible if undoing their merges along the border, latest first, never meets
a pair that would itself have merged earlier.

The vocabulary must have one merge per token that is not a single symbol, as the files of public
tokenizers with word ends do. Encoding is per text, so a partition needs memory for one batch of
texts and a bounded cache of pieces; nothing is shuffled.

Null and empty texts give an empty list and an empty decoding. Pieces of any length take time in
proportion to their length. Extra columns pass through; an existing result column, in whatever case, is replaced.
"""

from __future__ import annotations

import json

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._pieces import split_pieces
from ._shared import kept, releasing, text_chunks

#: Of these many entries, of up to about 300 and 120 bytes, caches stay under 30 MB and 12 MB in each worker.
CACHED_PIECES = 100_000
CACHED_PAIRS = 100_000
_END = "</w>"


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 stands for itself."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder and decoder of one tokenizer file. Symbols: a byte, plus 256 if a piece ends there."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte_of = _byte_of_char()

        def symbols(token: str) -> str:
            ends = token.endswith(_END) and token != _END
            body = [byte_of[c] for c in (token[: -len(_END)] if ends else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * ends)

        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.strings = [""] * size
        self.special: dict[str, int] = {}
        for t in spec["added_tokens"]:
            self.strings[t["id"]] = t["content"]
            self.special[t["content"]] = t["id"]
        self.length = [0] * size
        self.rank = [-1] * size
        self.left, self.right = [0] * size, [0] * size
        self.pair_rank: dict[tuple[int, int], int] = {}
        body: dict[int, str] = {}
        for token, k in vocab.items():
            self.strings[k] = token
            if k not in self.special.values():
                body[k] = symbols(token)
                self.length[k] = len(body[k])
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            k = vocab[a + b]
            self.rank[k], self.left[k], self.right[k] = r, vocab[a], vocab[b]
            self.pair_rank[vocab[a], vocab[b]] = r
        self._pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        whole: set[int] = set()
        for k in sorted(body, key=lambda k: self.rank[k]):
            r = self.rank[k]
            if r < 0 or (self.left[k] in whole and self.right[k] in whole and self._borders(self.left[k], self.right[k], r)):
                whole.add(k)
                self.automaton.add_word(body[k], k)
        self.automaton.make_automaton()

    def _borders(self, a: int, b: int, limit: int) -> bool:
        """Whether a then b stay apart. limit: the merges of a lower rank came before."""
        rank, pair_rank = self.rank, self.pair_rank
        while True:
            r = pair_rank.get((a, b))
            if r is not None and r < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.right[a]
            else:
                limit, b = rb + 1, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._borders(a, b, 1 << 62)
        return known

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece."""
        if piece in self.special:
            return [self.special[piece]]
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        text = text[:-1] + chr(256 + ord(text[-1]))
        length, compatible = self.length, self.compatible
        last = [-1] * (len(text) + 1)
        for at, token in self.automaton.iter(text):
            end = at + 1
            if last[end] < 0:
                begin = end - length[token]
                if not begin or (last[begin] >= 0 and compatible(last[begin], token)):
                    last[end] = token
        out = []
        at = len(text)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]


class PieceCache(dict):
    """Piece to its ids as 32-bit values; emptied when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(piece), dtype="<i4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@kept
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


@kept
def _cache(path: str) -> PieceCache:
    return PieceCache(encoder(path).piece)


def ids_list(rows: list[bytes]) -> pa.ListArray:
    offs = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [k for k, f in enumerate(batch.schema) if f.name.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), column], names=[*(batch.schema.names[k] for k in keep), name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name.lower() != name.lower()), T.StructField(name, kind)])


def _encoding(tokenizer: str, text: str, into: str):
    def run(batches):
        lookup = _cache(tokenizer).__getitem__
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for at, end, _, _ in text_chunks(batch, text):
                rows = [b"".join(map(lookup, split_pieces(t, tokenizer))) if t else b"" for t in texts.slice(at, end - at).to_pylist()]
                yield _with(batch.slice(at, end - at), into, ids_list(rows))

    return run


def _decoding(tokenizer: str, ids: str, into: str, at_once: int):
    def run(batches):
        strings = pa.array(encoder(tokenizer).strings, pa.large_string())
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            at = 0
            while at < len(sizes):
                before = ends[at] - sizes[at]
                end = max(at + 1, int(np.searchsorted(ends, before + at_once, side="right")))
                offs = np.concatenate([[0], ends[at:end] - before]).astype(np.int64)
                tokens = strings.take(pc.list_flatten(lists.slice(at, end - at)))
                text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offs), tokens), pa.scalar(" ", pa.large_string()))
                yield _with(batch.slice(at, end - at), into, text.cast(pa.string()))
                at = end

    return run


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the token ids of each text. tokenizer: path of the file, which every machine must have."""
    return df.mapInArrow(releasing(_encoding(tokenizer, text, into), keeps=True), _schema(df, into, T.ArrayType(T.IntegerType())))


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded", at_once: int = 1 << 20) -> DataFrame:
    """Adds the text of each list of ids: the tokens' strings joined by a space, as a tokenizer without a decoder does."""
    return df.mapInArrow(releasing(_decoding(tokenizer, ids, into, at_once), keeps=True), _schema(df, into, T.StringType()))


def bpe_round_trip(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", at_once: int = 1 << 20) -> DataFrame:
    """bpe_decode() of bpe_encode(), in one Python worker a task in place of two."""
    encode, decode = _encoding(tokenizer, text, ids), _decoding(tokenizer, ids, decoded, at_once)
    kind = T.StructType([*_schema(df, ids, T.ArrayType(T.IntegerType()))])
    kind = T.StructType([*(f for f in kind if f.name.lower() != decoded.lower()), T.StructField(decoded, T.StringType())])
    return df.mapInArrow(releasing(lambda batches: decode(encode(batches)), keeps=True), kind)
