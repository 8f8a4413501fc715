"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

write_warc gives each payload a response record, except that of equal payloads of REVISIT_BYTES
or more only the row with the largest id is one and the others are revisits of it. Each task
writes archives of bounded size and returns their paths; archives of failed attempts are in no
result. read_warc takes such paths, decodes frame by frame and checks every record's version,
headers, lengths and digest.

The folder must be one that all machines share and pyarrow can open (file, hdfs, s3, gs, ...).

Special cases: a null payload is an empty one. A null url leaves its header out. Rows that repeat
an id and a payload are responses alike; a row without an id revisits a group that has one. Empty
tables write no archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_BYTES, stash, stashed_bytes

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
SAMPLE_RECORDS = 128
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 16 << 10
#: Fixed values of the formats: magic numbers of the dictionary frame and of a frame, and names of headers.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
_DATE = "1970-01-01T00:00:00Z"
_LEVEL = 3


class WarcError(ValueError):
    """A record or frame that breaks the format."""


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """The bytes of a response, or of a revisit if refers_to is given (payload is then not stored)."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8", "surrogatepass").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"no header: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse(data: bytes) -> dict:
    """Checks one record and gives its fields."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not blank or version != VERSION:
        raise WarcError(f"not a record: {data[:40]!r}")
    h = _headers(lines)
    if missing := [x for x in REQUIRED if x not in h]:
        raise WarcError(f"headers missing: {missing}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("content length doesn't fit the record")
    http, blank, payload = rest[:-4].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not blank or not status.startswith(b"HTTP/"):
        raise WarcError("no HTTP head in the block")
    length = _headers(lines).get("content-length", "")
    if not length.isdigit() or h["warc-type"] not in ("response", "revisit"):
        raise WarcError("length or type of the payload is wrong")
    scheme, _, digest = h.get("warc-payload-digest", "").partition(":")
    if scheme != "sha1":
        raise WarcError("no SHA-1 digest")
    digest = base64.b32decode(digest).hex()
    revisit = h["warc-type"] == "revisit"
    if revisit and (payload or "x-refers-to-page-id" not in h):
        raise WarcError("a revisit with a payload, or of no record")
    if not revisit and (len(payload) != int(length) or hashlib.sha1(payload).hexdigest() != digest):
        raise WarcError("the payload doesn't fit its length or digest")
    return {
        "page_id": int(h["x-page-id"]) if "x-page-id" in h else None, "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload": None if revisit else payload,
        "payload_bytes": int(length), "payload_digest": digest, "refers_to": int(h["x-refers-to-page-id"]) if revisit else None,
    }


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; of too few or too like ones, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=_LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archives(records: Iterator[bytes], folder: str) -> Iterator[tuple[str, int, int]]:
    """Writes the records into archives of about ARCHIVE_BYTES; gives (path, records, bytes)."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    records = iter(records)
    while True:
        first: list[bytes] = []
        while len(first) < SAMPLE_RECORDS and sum(map(len, first[-1:])) < SAMPLE_BYTES and (r := next(records, None)) is not None:
            first.append(r)
        if not first:
            return
        words = _dictionary([r[:8192] for r in first])
        packer = zstandard.ZstdCompressor(level=_LEVEL, dict_data=words, write_content_size=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        n, size = 0, 0
        with store.open_output_stream(f"{root}/{name}") as out:
            body = zstandard.ZstdCompressor(level=_LEVEL).compress(words.as_bytes())
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
            for r in _chain(first, records):
                frame = packer.compress(r)
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    break
        yield f"{folder.rstrip('/')}/{name}", n, size


def _chain(first: list[bytes], rest: Iterator[bytes]) -> Iterator[bytes]:
    yield from first
    yield from rest


def frames(stream, at_once: int = 1 << 20) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time."""
    data = stream.read(8)
    words = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:])[0]
        body = stream.read(size)
        if len(body) != size:
            raise WarcError("the dictionary is cut short")
        if body[:4] == struct.pack("<I", FRAME_MAGIC):
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        trained = body[:4] == b"\x37\xa4\x30\xec"
        words = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        data = b""
    unpacker = zstandard.ZstdDecompressor(dict_data=words)
    while True:
        data = data or stream.read(at_once)
        if not data:
            return
        one, parts = unpacker.decompressobj(), []
        try:
            while True:
                parts.append(one.decompress(data))
                if one.eof:
                    break
                data = stream.read(at_once)
                if not data:
                    raise WarcError("the last frame is cut short")
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from e
        data = one.unused_data
        yield b"".join(parts)


#: A payload in more than this share of the rows is hot; at most its inverse can be.
HOT_SHARE = 0.001


def decide(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Rows to write: id, url, payload (null for revisits), length, digest and refers_to.

    Payloads are joined with the groups of equal ones: by broadcast if these are few, else by a
    shuffle of the long payloads alone, in which those of hot groups, at most 1 / HOT_SHARE, stay in place.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.select("*", F.length("payload").cast("long").alias("length"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("equal"))
    groups = stash(rows.filter(F.col("length") >= REVISIT_BYTES).groupBy("equal").agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1"))
    if stashed_bytes(groups) <= BROADCAST_BYTES:
        out = rows.join(F.broadcast(groups), "equal", "left")
    else:
        most = HOT_SHARE * pages.count()
        hot = F.broadcast(groups.filter(F.col("n") > most))
        known = rows.join(hot, "equal", "left")
        cold = (F.col("length") >= REVISIT_BYTES) & F.col("last").isNull()
        shuffled = known.filter(cold).drop("last", "n").join(groups, "equal", "left")
        out = known.filter(~cold).unionByName(shuffled)
    revisit = F.col("last").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("last")))
    return out.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "length", "digest", F.when(revisit, F.col("last")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes when an action runs; rows (path, n_records, n_bytes). Keep the result rather than run it twice."""

    def run(batches):
        def each():
            for batch in batches:
                for p, u, body, n, digest, to in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                    yield record(p, u, body or b"", digest, n, to)

        for path, n, size in archives(each(), folder):
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n, "n_bytes": size}])

    return decide(pages, page_id, url, payload).mapInArrow(run, "path string, n_records long, n_bytes long")


def read_warc(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives at column path. A broken one ends the job with a WarcError."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema([f for f in fields if payloads or f[0] != "payload"])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(at) as stream:
                    for frame in frames(stream):
                        got = parse(frame)
                        if not payloads:
                            got.pop("payload")
                        rows.append(got)
                        size += len(frame) * payloads + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return paths.select("path").mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))
