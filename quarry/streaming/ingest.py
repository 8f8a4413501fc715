"""Streams of files: counts by time window with late rows bounded, and an index that follows documents as they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


def files(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", at_once: int | None = None) -> DataFrame:
    """A stream of the Parquet files in a folder whose names fit; at_once: files per batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader if at_once is None else reader.option("maxFilesPerTrigger", at_once)).parquet(folder)


def windowed_counts(events: DataFrame, width: str, late: str, time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Rows (start, kind, n_events, total) of each window once it is `late` past; rows that come later than that are dropped."""
    counted = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n_events"), F.sum(value).alias("total"))
    return counted.select(F.col("window.start").alias("start"), kind, "n_events", "total")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that is there now, then ends."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


NAME = ("text_a", "text_b")


def text_name(text: Column) -> list[Column]:
    """Two hashes that name a trimmed text; null is empty."""
    trimmed = T.trimmed(F.coalesce(text, F.lit("")))
    return [F.xxhash64(trimmed).alias(NAME[0]), F.xxhash64(F.lit(1), trimmed).alias(NAME[1])]


def ingest_documents(docs: DataFrame, root: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> None:
    """Brings the index at root up to date with a stream of documents; read it with documents(), postings() and statistics().

    Texts are known by their trimmed content. Two stateful queries follow the stream, so a batch
    costs what it holds, whatever came before. One lets a text through when it first comes: its
    postings, by the text's name, and the batch's counts are written. The other keeps for each text
    the row with the smallest key, less its text, and writes those of the texts that a batch holds.
    So the order in which documents come changes nothing. A batch has a folder of its own, named by
    its number, which a repeated batch overwrites. Null keys come after all others.
    """
    named = docs.select("*", *text_name(F.col(text)))
    others = [c for c in docs.columns if c not in (key, text)]

    def add_texts(batch: DataFrame, number: int) -> None:
        lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
        held = batch.select(*NAME, F.col(text).alias("text"), T.token_count(lowered).alias("n_tokens"))
        held.write.mode("overwrite").parquet(f"{root}/texts/batch={number}")
        held = batch.sparkSession.read.parquet(f"{root}/texts/batch={number}")
        words = held.select(*NAME, F.explode(T.tokens(F.col("text"))).alias("term"))
        words.groupBy(*NAME, "term").agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(f"{root}/postings/batch={number}")
        held.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("n_tokens")).write.mode("overwrite").parquet(f"{root}/counts/batch={number}")

    def add_keys(batch: DataFrame, number: int) -> None:
        batch.select(*NAME, "row", "n").write.mode("overwrite").parquet(f"{root}/keys/batch={number}")

    def run(stream: DataFrame, add, name: str, mode: str) -> None:
        stream.writeStream.outputMode(mode).foreachBatch(add).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start().awaitTermination()

    first = F.struct(F.col(key).isNull().alias("null_key"), F.col(key).alias("key"), *(F.col(c) for c in others))
    run(named.dropDuplicates([*NAME]).select(*NAME, text), add_texts, "texts", "append")
    run(named.groupBy(*NAME).agg(F.min(first).alias("row"), F.count("*").alias("n")), add_keys, "keys", "update")


def _keys(spark: SparkSession, root: str) -> DataFrame:
    """Rows (text_a, text_b, row, n): the state of each text after the batches so far."""
    return spark.read.parquet(f"{root}/keys").groupBy(*NAME).agg(F.min("row").alias("row"), F.max("n").alias("n_copies"))


def documents(spark: SparkSession, root: str, key: str = "doc_id") -> DataFrame:
    """One row per text: the smallest key, its row's other columns, the text, n_tokens and n_copies."""
    kept = spark.read.parquet(f"{root}/texts").join(_keys(spark, root), [*NAME])
    row = kept.schema["row"].dataType
    return kept.select(F.col("row.key").alias(key), *(F.col(f"row.`{c}`").alias(c) for c in row.names if c not in ("null_key", "key")), "text", "n_tokens", "n_copies")


def postings(spark: SparkSession, root: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, term, tf) of the documents."""
    return spark.read.parquet(f"{root}/postings").join(_keys(spark, root), [*NAME]).select(F.col("row.key").alias(key), "term", "tf")


def statistics(spark: SparkSession, root: str) -> DataFrame:
    """One row: texts, tokens and mean tokens, at least 1; a sum over a row per batch."""
    total = F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long")
    n = F.coalesce(F.sum("n_docs"), F.lit(0)).cast("long")
    return spark.read.parquet(f"{root}/counts").agg(n.alias("n_docs"), total.alias("n_tokens"), F.greatest(F.lit(1.0), F.coalesce(F.try_divide(total, n), F.lit(0.0))).alias("avg_tokens"))
