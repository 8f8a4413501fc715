"""Search over saved indexes, which read what a query's words name and no other text.

Postings are kept in the order of (term, part), a part being a fixed share of the documents by a
hash of their key. Beside them are the maxima: for each term and part, the greatest share that the
term can add to a score there. A query adds these up to a bound for each part, scores the parts of
the highest bounds first, and then only those whose bound is no less than the k-th score so far; the
result is that of scoring all. Filters on term and part reach the scan, which skips files and row groups.

The word index keeps the dictionary in order, so that prefixes are ranges, each word's documents,
and for each word its forms with one character left out: a word within the fuzzy walk of a query word
shares such a form with it, so candidates come by equal forms and the walk decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexical
from ._tables import cut

#: Documents of a part, on the average.
PART_ROWS = 1024
#: Parts that are scored before the bound is known; the least files of each table, and the parts that a file of postings holds beyond those.
FIRST_PARTS, FILES, FILE_PARTS = 4, 32, 8


def save_postings(docs: DataFrame, root: str, key: str = "doc_id", text: str = "text", part_rows: int = PART_ROWS) -> None:
    """Writes root/stats (one row), root/postings (term, part, key, tf, n) and root/maxima (term, part, df, impact)."""
    stats = lexical.corpus_stats(docs, text)
    stats.write.mode("overwrite").parquet(f"{root}/stats")
    known = docs.sparkSession.read.parquet(f"{root}/stats").first()
    parts = max(1, math.ceil(known["n_docs"] / part_rows))
    files = max(FILES, parts // FILE_PARTS)
    _dealt(docs, key, text, parts, files).write.mode("overwrite").parquet(f"{root}/postings")
    saved = docs.sparkSession.read.parquet(f"{root}/postings")
    maxima = saved.groupBy("term", "part").agg(F.count("*").alias("df"), F.max(_impact(F.col("tf"), F.col("n"), known["avg_tokens"])).alias("impact"))
    maxima.repartitionByRange(max(1, files // 8), "term", "part").sortWithinPartitions("term", "part").write.mode("overwrite").parquet(f"{root}/maxima")


def _dealt(docs: DataFrame, key: str, text: str, parts: int, files: int) -> DataFrame:
    """Rows (term, part, key, n, tf) in the files' order. Words are shuffled once: a range holds all of a term and part, so they are counted there."""
    words = _words(docs, key, text, parts).repartitionByRange(files, "term", "part")
    return words.groupBy("term", "part", "key", "n").agg(F.count("*").alias("tf")).sortWithinPartitions("term", "part")


def _words(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """Rows (key, part, n, term), one for each token; what stands beside explode() is made anew for each row, so n is made before it."""
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
    cut_up = docs.select(F.col(key).alias("key"), part, T.tokens(F.col(text)).alias("terms")).select("key", "part", F.size("terms").alias("n"), "terms")
    return cut_up.select("key", "part", "n", F.explode("terms").alias("term"))


def _impact(tf: Column, n: Column, mean: float) -> Column:
    """What a term adds to a score, less its rarity."""
    return tf * (lexical.K1 + 1) / (tf + lexical.K1 * (1 - lexical.B + lexical.B * n / F.lit(mean)))


def _scored(rows: DataFrame, idf: dict[str, float], mean: float) -> DataFrame:
    """Rows (key, score); terms are added in the query's order, so that sums do not depend on how rows fall."""
    each = [F.max(F.when(F.col("term") == t, w * _impact(F.col("tf"), F.col("n"), mean))).alias(f"s{k}") for k, (t, w) in enumerate(idf.items())]
    total = sum((F.coalesce(f"s{k}", F.lit(0.0)) for k in range(len(idf))), F.lit(0.0))
    return rows.groupBy("key").agg(*each).select("key", total.alias("score"))


def search(spark: SparkSession, root: str, query: str, k: int = 10, key: str = "doc_id", first_parts: int = FIRST_PARTS) -> DataFrame:
    """The k best texts by BM25, ties in order of key: (key, score); equal to lexical.bm25_topk()."""
    terms = lexical.query_terms(query)
    rows = spark.read.parquet(f"{root}/postings")
    none = rows.filter(F.lit(False)).select(F.col("key").alias(key), F.lit(0.0).alias("score"))
    if not terms or k < 1:
        return none
    known = spark.read.parquet(f"{root}/stats").first()
    maxima = cut(spark.read.parquet(f"{root}/maxima").filter(F.col("term").isin(terms)))
    df = {r["term"]: r["df"] for r in maxima.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row per query word
    idf = {t: math.log((known["n_docs"] - df[t] + 0.5) / (df[t] + 0.5) + 1) for t in terms if t in df}
    if not idf:
        return none
    weight = F.lit(0.0)
    for t, w in idf.items():
        weight = F.when(F.col("term") == t, w).otherwise(weight)
    bounds = cut(maxima.groupBy("part").agg(F.sum(weight * F.col("impact")).alias("bound")))
    mine = rows.filter(F.col("term").isin(list(idf)))
    best = [r["part"] for r in bounds.orderBy(F.desc("bound"), "part").limit(first_parts).collect()]
    ordered = lambda scored: scored.orderBy(F.desc("score"), "key").limit(k)
    first = cut(ordered(_scored(mine.filter(F.col("part").isin(best)), idf, known["avg_tokens"])))
    least = first.agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
    open_ = bounds.filter(~F.col("part").isin(best))
    if least["n"] >= k:
        open_ = open_.filter(F.col("bound") >= least["s"] - 1e-9)  # rounding of sums
    later = _scored(mine.join(F.broadcast(open_.select("part")), "part", "left_semi"), idf, known["avg_tokens"])  # a row per PART_ROWS documents
    return ordered(first.unionByName(ordered(later))).select(F.col("key").alias(key), "score")


def _without_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))


def _forms(word: Column) -> Column:
    """The word, and the word with one of its characters left out."""
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 0, _without_one(word)).otherwise(F.array().cast("array<string>"))))


def _query_forms(word: str) -> list[str]:
    return sorted({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))})


def save_words(docs: DataFrame, root: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes root/texts (key, text), root/words (word, key), root/dictionary (word, df) and root/forms (form, word)."""
    docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange(FILES, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{root}/texts")
    words = lexical.word_index(docs, key, text).select("word", F.col(key).alias("key"))
    words.repartitionByRange(FILES, "word", "key").sortWithinPartitions("word", "key").write.mode("overwrite").parquet(f"{root}/words")
    spark = docs.sparkSession
    spark.read.parquet(f"{root}/words").groupBy("word").agg(F.count("*").alias("df")).repartitionByRange(4, "word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{root}/dictionary")
    forms = spark.read.parquet(f"{root}/dictionary").select(F.explode(_forms(F.col("word"))).alias("form"), "word")
    forms.repartitionByRange(FILES, "form").sortWithinPartitions("form").write.mode("overwrite").parquet(f"{root}/forms")


def matching_words(spark: SparkSession, root: str, query: str, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """Rows (query_word, word, kind) as lexical.word_matches(): exact and prefix by ranges of the dictionary, fuzzy by forms."""
    dictionary, wanted = spark.read.parquet(f"{root}/dictionary"), sorted(set(lexical.query_fast_words(query)))
    out = dictionary.select(F.lit("").alias("query_word"), "word", F.lit("").alias("kind")).filter(F.lit(False))
    for q in wanted:
        near = dictionary.filter(F.col("word").startswith(q) if prefix and len(q) >= 2 else F.col("word") == q).select("word")
        if fuzzy and len(q) >= 3:
            near = near.unionByName(spark.read.parquet(f"{root}/forms").filter(F.col("form").isin(_query_forms(q))).select("word")).distinct()
        kinds = near.select(F.lit(q).alias("query_word"), "word", lexical.word_kind(F.col("word"), q, prefix, fuzzy).alias("kind"))
        out = out.unionByName(kinds.filter("kind is not null"))
    return out


def fast_search(spark: SparkSession, root: str, query: str, k: int = 20, fuzzy: bool = True, key: str = "doc_id") -> DataFrame:
    """lexical.fast_search() over the saved words: only the texts of documents that hold a matching word are read and scored."""
    words = cut(matching_words(spark, root, query, fuzzy=fuzzy).select("word").distinct())
    hits = cut(spark.read.parquet(f"{root}/words").join(words, "word", "left_semi").select("key").distinct())
    texts = spark.read.parquet(f"{root}/texts")
    span = hits.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
    found = texts.filter(F.col("key").between(span["a"], span["b"])).join(hits, "key", "left_semi")
    top = lexical.fast_scores(found, query, "key", "text").orderBy(F.desc("score"), "key").limit(k)
    return lexical.ranked(top, "key").withColumnRenamed("key", key)
