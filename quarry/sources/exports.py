"""Exports and imports of documents with their places, clusters and vectors: format 3.0, and older formats to read.

A 3.0 export is a folder: manifest.json is written last and makes it complete, and documents,
parents, chunks and chunk_map are JSON lines beside it, written and read in parallel. as_document()
gives the same as one nested row for selections of a stated size, as other tools exchange it, and
write_documents() deals a selection of any size into files of such rows; import_v3 reads each of them.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import in_scope

VERSION = "3.0"
#: Kinds of exports, and where a row's key is looked for, in order.
KINDS = ("full", "filtered", "lasso", "rag_results")
KEYS = ("id", "doc_id", "docId", "metadata.doc_id", "metadata.id", "index")
#: Rows that one nested document may hold.
DOCUMENT_ROWS = 10_000

_VECTORS = "array<float>"
_DOCUMENT = "id string, text string, cluster int, cluster_probability double, x double, y double, metadata map<string,string>"
_NESTED = f"""version string, export_type string, exported_at string, metadata struct<document_count: bigint, original_dataset_size: bigint, query: string>,
documents array<struct<id: string, text: string, cluster: int, cluster_probability: double, umap_coords: struct<x: double, y: double>, metadata: map<string,string>>>,
embeddings struct<parent: struct<vectors: array<struct<doc_id: string, vector: {_VECTORS}>>, mode: string>, chunks: struct<vectors: array<struct<chunk_id: string, doc_id: string, chunk_index: int, text: string, vector: {_VECTORS}>>, mode: string>>"""


def doc_key(df: DataFrame, fallback: Column | None = None) -> Column:
    """The first filled one of the columns that may name a row, as text; else the fallback."""
    found = []
    for name in KEYS:
        top, _, inner = name.partition(".")
        if top in df.columns:
            c = F.col(f"`{top}`")[inner] if inner else F.col(f"`{top}`")
            found.append(F.nullif(F.trim(c.cast("string")), F.lit("")))
    return F.coalesce(*found, *([fallback.cast("string")] if fallback is not None else [F.lit(None).cast("string")]))


def selected_vectors(ids: DataFrame, parents: DataFrame, chunks: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Vectors of the selected documents (doc_id, vector), and of their passages (chunk_id, doc_id, chunk_index, text, vector)."""
    mine = in_scope(parents.select(F.col(key).cast("string").alias("doc_id"), F.col("vector").cast(_VECTORS).alias("vector")), ids)
    theirs = in_scope(chunks.select("chunk_id", F.col("parent_id").cast("string").alias("doc_id"), F.col("position").cast("int").alias("chunk_index"), "text", F.col("vector").cast(_VECTORS).alias("vector")), ids)
    return mine, theirs


def _documents(points: DataFrame) -> DataFrame:
    """Points (key columns, text, cluster, cluster_probability, x, y, metadata) as rows of the format; all by id, none by place in the list."""
    meta = F.col("metadata") if "metadata" in points.columns else F.create_map().cast("map<string,string>")
    return points.select(
        doc_key(points).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"),
        F.col("cluster_probability").cast("double").alias("cluster_probability"),
        F.coalesce("x", F.lit(0.0)).cast("double").alias("x"),
        F.coalesce("y", F.lit(0.0)).cast("double").alias("y"),
        meta.alias("metadata"),
    )


def _checked(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"no export type {kind!r}; use one of {', '.join(KINDS)}")
    return kind


def export_v3(points: DataFrame, parents: DataFrame, chunks: DataFrame, path: str, kind: str = "full", original_size: int | None = None, query: str | None = None) -> None:
    """Writes a selection as a folder. points: see map_points(); parents and chunks: see selected_vectors()."""
    spark, docs = points.sparkSession, _documents(points)
    mine, theirs = selected_vectors(docs.select("id"), parents, chunks)
    docs.write.json(f"{path}/documents", ignoreNullFields=False)
    mine.write.json(f"{path}/parents")
    theirs.write.json(f"{path}/chunks")
    written = spark.read.schema("chunk_id string, doc_id string").json(f"{path}/chunks")  # so that passages are made and joined once
    written.write.json(f"{path}/chunk_map")
    count = spark.read.schema(_DOCUMENT).json(f"{path}/documents").count()
    head = spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(_checked(kind)).alias("export_type"), F.current_timestamp().cast("string").alias("exported_at"), F.lit(count).alias("document_count"), F.lit(original_size).cast("long").alias("original_dataset_size"), F.lit(query).cast("string").alias("query"))
    head.coalesce(1).write.json(f"{path}/manifest.json", ignoreNullFields=False)


def as_document(points: DataFrame, parents: DataFrame, chunks: DataFrame, kind: str = "lasso", query: str | None = None, rows: int = DOCUMENT_ROWS) -> DataFrame:
    """One row, value: a selection as one JSON document. A selection of over `rows` documents or passages is refused: export_v3 and write_documents are for those."""
    docs = _documents(points)
    mine, theirs = selected_vectors(docs.select("id"), parents, chunks)
    if (n := docs.count()) > rows or theirs.count() > rows:
        raise ValueError(f"{n} documents or their passages are more than {rows}; use export_v3")
    return _nested(docs, mine, theirs, kind, query).select("value")


def write_documents(points: DataFrame, parents: DataFrame, chunks: DataFrame, path: str, kind: str = "lasso", query: str | None = None, rows: int = DOCUMENT_ROWS) -> None:
    """A selection of any size as files of one nested document each, which import_v3() reads as one.

    Documents are dealt by their ids, with their vectors and passages; a file holds half of `rows` of them on the average.
    """
    docs = _documents(points)
    mine, theirs = selected_vectors(docs.select("id"), parents, chunks)
    files = max(1, -(-2 * max(docs.count(), theirs.count()) // rows))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(files)).alias("_part")
    dealt = docs.select(part(F.coalesce("id", "text")), "*"), mine.select(part(F.col("doc_id")), "*"), theirs.select(part(F.col("doc_id")), "*")
    _nested(*dealt, kind, query, "_part").select("value").write.option("maxRecordsPerFile", 1).text(path)


def _nested(docs: DataFrame, mine: DataFrame, theirs: DataFrame, kind: str, query: str | None, *by: str) -> DataFrame:
    """Rows (by, value): the documents, their vectors and their passages of each group as one JSON document."""
    own = lambda df: [c for c in df.columns if c not in by]
    nested = lambda df, name: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*own(df)))).alias(name))
    each = docs.select(*by, F.struct("id", "text", "cluster", "cluster_probability", F.struct("x", "y").alias("umap_coords"), "metadata").alias("d"))
    listed = each.groupBy(*by).agg(F.array_sort(F.collect_list("d"), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("documents"))
    one = listed
    for df, name in ((mine, "p"), (theirs, "c")):
        lists = nested(df, name)
        one = one.join(lists, list(by), "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType))) if by else one.join(lists)  # without groups one row each
    payload = F.struct(
        F.lit(VERSION).alias("version"),
        F.lit(_checked(kind)).alias("export_type"),
        F.current_timestamp().cast("string").alias("exported_at"),
        F.struct(F.size("documents").cast("long").alias("document_count"), F.lit(query).cast("string").alias("query")).alias("metadata"),
        "documents",
        F.struct(F.struct(F.col("p").alias("vectors"), F.lit("query").alias("mode")).alias("parent"), F.struct(F.col("c").alias("vectors"), F.lit("passage").alias("mode")).alias("chunks")).alias("embeddings"),
    )
    return one.select(*by, F.to_json(payload).alias("value"))


def import_v3(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents, parents and chunks of an export: a folder of export_v3, or files of one nested JSON document each."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        head = spark.read.json(f"{path}/manifest.json").first()
        if head["version"] != VERSION:
            raise ValueError(f"unsupported format version: {head['version']}")
        return {
            "documents": spark.read.schema(_DOCUMENT).json(f"{path}/documents"),
            "parents": spark.read.schema(f"doc_id string, vector {_VECTORS}").json(f"{path}/parents"),
            "chunks": spark.read.schema(f"chunk_id string, doc_id string, chunk_index int, text string, vector {_VECTORS}").json(f"{path}/chunks"),
        }
    nested = spark.read.schema(_NESTED).json(path, multiLine=True)
    found = nested.select("version", F.col("documents").isNull().alias("empty")).collect()  # a row per file
    for row in found:
        if row["version"] != VERSION:
            raise ValueError(f"unsupported format version: {row['version']}")
        if row["empty"]:
            raise ValueError("the export has no documents")
    docs = nested.select(F.inline("documents")).select("id", "text", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "cluster_probability", F.coalesce("umap_coords.x", F.lit(0.0)).alias("x"), F.coalesce("umap_coords.y", F.lit(0.0)).alias("y"), "metadata")
    return {"documents": docs, "parents": nested.select(F.inline("embeddings.parent.vectors")), "chunks": nested.select(F.inline("embeddings.chunks.vectors"))}


def encode_vector(c: Column) -> Column:
    """A vector as base64 of little-endian 32-bit floats, as older indexes hold it. For export of small indexes only: Parquet holds vectors as they are."""
    return F.base64(F.unhex(F.array_join(F.transform(c, _float_hex), "")))


def _bytes_reversed(hexed: Column) -> Column:
    return F.concat(*(F.substring(hexed, k, 2) for k in (7, 5, 3, 1)))


def _float_hex(x: Column) -> Column:
    """The IEEE 754 bits of a finite float in hex, lowest byte first."""
    size = F.abs(x.cast("double"))
    exponent = F.greatest(F.lit(-126), F.floor(F.log2(F.when(size > 0, size).otherwise(1.0))).cast("int"))
    scaled = size / F.pow(F.lit(2.0), exponent)
    exponent = F.when(scaled >= 2, exponent + 1).when((scaled < 1) & (exponent > -126), exponent - 1).otherwise(exponent)
    scaled = size / F.pow(F.lit(2.0), exponent)
    fraction = F.round(scaled * (1 << 23)).cast("long")
    bits = F.when(scaled < 1, fraction).otherwise((exponent.cast("long") + 127) * (1 << 23) + fraction - (1 << 23))
    bits = bits + F.when((x < 0) | (x.cast("string") == "-0.0"), F.lit(1 << 31)).otherwise(F.lit(0))
    return _bytes_reversed(F.lpad(F.hex(bits), 8, "0"))


def decode_vector(c: Column) -> Column:
    """encode_vector() undone: doubles that are exactly the floats."""
    hexed = F.hex(F.unbase64(c))
    bits = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 8).cast("int") - 1), lambda i: F.conv(_bytes_reversed(F.substr(hexed, i * 8 + 1, F.lit(8))), 16, 10).cast("long"))

    def value(b: Column) -> Column:
        exponent, fraction = F.shiftright(b, 23).bitwiseAND(F.lit(255)), b.bitwiseAND(F.lit((1 << 23) - 1)).cast("double") / (1 << 23)
        sign = F.when(b >= 1 << 31, -1.0).otherwise(1.0)
        return sign * F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-126.0))).otherwise((fraction + 1) * F.pow(F.lit(2.0), exponent - 127))

    return F.when(F.length(hexed) >= 8, F.transform(bits, value)).otherwise(F.array().cast("array<double>"))


def normalized_embeddings(df: DataFrame) -> DataFrame:
    """(doc_id, retrieval, clustering, schema) from tables of any age: one vector, two of them, or a parent with its passages elsewhere."""
    have = lambda *names: F.coalesce(*(F.col(n) for n in names if n in df.columns), F.lit(None).cast(_VECTORS))
    retrieval = have("retrieval", "parent", "embedding", "vector")
    schema = "dual-embedding-v1" if "clustering" in df.columns else "three-tier-v1" if "parent" in df.columns else "single-embedding-legacy"
    return df.select("doc_id", retrieval.alias("retrieval"), have("clustering", "parent", "retrieval", "embedding", "vector").alias("clustering"), F.lit(schema).alias("schema"))


def write_older(rows: DataFrame, path: str, at_most: int = DOCUMENT_ROWS) -> None:
    """Files of the 1.0 shape, of at most so many of the rows (id, text, vector) each."""

    def files(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, at_most):
                part = batch.slice(at, at_most).to_pylist()
                value = {"version": "1.0", "documents": [{"id": r["id"], "text": r["text"]} for r in part], "embeddings": [r["vector"] for r in part]}
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(value)])], names=["value"])

    rows.select("id", "text", "vector").mapInArrow(files, "value string").write.option("maxRecordsPerFile", 1).text(path)


def read_older(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Best effort on versions 1.0 and 2.0: documents (id, text) and embeddings (doc_id, vector) of files of one JSON document each."""
    kinds = "version string, documents array<struct<id: string, text: string>>, embeddings array<array<float>>, data struct<documents: array<struct<id: string, text: string>>, embeddings: array<array<float>>>"
    raw = spark.read.schema(kinds).json(path, multiLine=True).select("version", F.coalesce("documents", "data.documents").alias("d"), F.coalesce("embeddings", "data.embeddings").alias("e"))
    zipped = raw.select(F.inline(F.arrays_zip("d", "e"))).select(F.col("d.id").alias("id"), F.col("d.text").alias("text"), F.col("e").alias("vector"))
    return {"documents": zipped.select("id", "text").filter("id is not null"), "embeddings": zipped.select(F.col("id").alias("doc_id"), "vector").filter("vector is not null")}
