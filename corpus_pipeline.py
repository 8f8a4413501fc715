"""The corpus pipeline: documents in, token ids of clean and distinct texts out.

Each stage takes (spark, docs, sf_dir) and gives a table; all but the last give the columns of
documents. Rows of null or empty text have no language and end at the first stage. Extra columns
pass through all stages but the last, which gives doc_id, ids, n_tokens and the SHA-256 of the text that the
ids decode to. Empty tables stay empty. A stage bounds the session's Arrow batches, which stay so, as its table is made later.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, contamination, language, near_text, suffixes
from quarry.llm._shared import BROADCAST_BYTES, stash, stashed_bytes

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Passages of over 50 words that occur elsewhere are cut; so many words, and a space between each, have at least PASSAGE_BYTES.
PASSAGE_WORDS = 51
PASSAGE_BYTES = 2 * PASSAGE_WORDS - 1
#: Rows go to Python workers in batches of about so many bytes, of which each task holds some beside the heap; 10,000 texts are many times that.
BATCH_BYTES = 2 << 20


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those whose two best languages can't be told apart, go."""
    model = language.learn(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # so that no column of documents has a result's name
    found = language.identify(docs.toDF(*names.values()), model, names["text"])
    sure = found.filter((F.col("lang_pred") != language.UNDETERMINED) & ~F.col("lang_ambiguous"))
    return sure.select(*(F.col(n).alias(c) for c, n in names.items()))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return near_text.keep_one(docs)


@in_small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, and strings of 400 bytes, that occur elsewhere go; characters cut apart go as a whole."""
    cut = suffixes.cut_repeats(docs, length=PASSAGE_BYTES, least_words=PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go; they are known by their texts, as ids may be null or repeated."""
    texts = docs.select(F.xxhash64("text").alias("row"), "text")
    found = stash(contamination.contaminated(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row").select(F.col("doc_id").alias("found")).distinct())
    few = F.broadcast(found) if stashed_bytes(found) <= BROADCAST_BYTES else found
    return docs.join(few, F.xxhash64(docs["text"]) == few["found"], "left_anti").select(*docs.columns)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that they decode to."""
    return bpe.bpe_round_trip(docs.select("doc_id", "text"), TOKENIZER).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("tokens", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: tuple[DataFrame, ...] = ()
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), done_with=before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
