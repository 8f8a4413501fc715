"""Saved datasets: a folder of Parquet tables each, which a manifest written last makes visible.

A save writes a new version beside the old one; readers follow the newest manifest row, so that a
save that fails leaves the dataset as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import write_csv

#: Tables that every dataset has.
REQUIRED = ("documents", "embeddings")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def save(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame]) -> None:
    if missing := [t for t in REQUIRED if t not in tables]:
        raise ValueError(f"a dataset needs {', '.join(missing)}")
    version = uuid.uuid4().hex
    try:
        for key, df in tables.items():
            df.write.parquet(f"{root}/{name}/{version}/{key}")
    except Exception:
        fs, at = _folder(spark, f"{root}/{name}/{version}")
        fs.delete(at, True)
        raise
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(version).alias("version"), F.current_timestamp().alias("saved_at"), F.array(*map(F.lit, sorted(tables))).alias("tables"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/{name}/manifest")


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Rows (name, version, saved_at, tables), the newest dataset first."""
    fs, at = _folder(spark, f"{root}/*/manifest")
    if not fs.globStatus(at):
        return spark.createDataFrame([], "name string, version string, saved_at timestamp, tables array<string>")
    newest = F.max(F.struct("saved_at", "version", "tables")).alias("m")
    return spark.read.parquet(f"{root}/*/manifest").groupBy("name").agg(newest).select("name", "m.version", "m.saved_at", "m.tables").orderBy(F.desc("saved_at"), "name")


def exists(spark: SparkSession, root: str, name: str) -> bool:
    return not catalog(spark, root).filter(F.col("name") == name).isEmpty()


def load(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    found = catalog(spark, root).filter(F.col("name") == name).first()
    if found is None:
        raise ValueError(f"no dataset {name!r}")
    return {t: spark.read.parquet(f"{root}/{name}/{found['version']}/{t}") for t in found["tables"]}


def delete(spark: SparkSession, root: str, name: str) -> None:
    fs, at = _folder(spark, f"{root}/{name}")
    fs.delete(at, True)


def conversation_rows(log: DataFrame) -> DataFrame:
    """Answered questions (timestamp, query, answer, sources array<string>, model, temperature) as rows of strings for CSV."""
    return log.select("timestamp", "query", "answer", F.coalesce(F.size("sources"), F.lit(0)).alias("num_sources"), F.coalesce(F.array_join("sources", "|"), F.lit("")).alias("source_ids"), "model", "temperature")


def write_conversation(log: DataFrame, path: str) -> None:
    write_csv(conversation_rows(log).withColumn("source_ids", F.nullif("source_ids", F.lit(""))), path, 10_000)  # no sources are an empty cell


def write_conversation_json(log: DataFrame, path: str) -> None:
    """The log as JSON lines, a question each, and its size in a line of its own beside them."""
    log.write.json(f"{path}/conversation", ignoreNullFields=False)
    log.agg(F.count("*").alias("total_queries"), F.current_timestamp().cast("string").alias("exported_at")).coalesce(1).write.json(f"{path}/summary")


def clear(spark: SparkSession, root: str) -> None:
    """Deletes all datasets; settings and sessions, which have a folder of their own, stay."""
    for row in catalog(spark, root).select("name").toLocalIterator():
        delete(spark, root, row["name"])


def stats(tables: dict[str, DataFrame], vector: str = "embedding") -> DataFrame:
    """Rows (name, n_rows, vector_mb) of a dataset's tables; vectors count four bytes a component."""
    out = None
    for name, df in sorted(tables.items()):
        size = F.coalesce(F.sum(F.size(vector)), F.lit(0)) * 4 / (1 << 20) if vector in df.columns else F.lit(0.0)
        row = df.agg(F.count("*").alias("n_rows"), size.cast("double").alias("vector_mb")).select(F.lit(name).alias("name"), "n_rows", "vector_mb")
        out = row if out is None else out.unionByName(row)
    return out


def index_stats(postings: DataFrame, vectors: DataFrame, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """One row: terms and postings of the word index, vectors, and MB of the vectors with their norms."""
    words = postings.agg(F.count_distinct("term").alias("n_terms"), F.count("*").alias("n_postings"), F.count_distinct(key).alias("n_indexed"))
    dense = vectors.agg(F.count("*").alias("n_vectors"), (F.coalesce(F.sum(F.size(vector) * 4 + 4), F.lit(0)) / (1 << 20)).alias("memory_mb"))
    return words.join(dense)  # one row each


def save_value(spark: SparkSession, root: str, kind: str, value: str) -> None:
    """Keeps a JSON text under settings or session, apart from the datasets; the newest counts."""
    if kind not in ("settings", "session"):
        raise ValueError("kind is settings or session")
    spark.range(1).select(F.lit(value).alias("value"), F.current_timestamp().alias("saved_at"), F.lit(uuid.uuid4().hex).alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/__{kind}")


def load_value(spark: SparkSession, root: str, kind: str) -> str | None:
    fs, at = _folder(spark, f"{root}/__{kind}")
    if not fs.exists(at):
        return None
    return spark.read.parquet(f"{root}/__{kind}").orderBy(F.desc("saved_at"), F.desc("version")).first()["value"]


def clear_value(spark: SparkSession, root: str, kind: str) -> None:
    fs, at = _folder(spark, f"{root}/__{kind}")
    fs.delete(at, True)
