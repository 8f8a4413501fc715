"""Quality rules: plain statistics of a text, and a log-likelihood ratio of hashed n-grams between trusted and raw texts.

Words, and pairs of words that follow each other, are hashed into BUCKETS buckets. Over these two
multinomials are counted: one of all texts, and one of the trusted ones, smoothed by PRIOR n-grams
dealt as the raw ones are. A text's rating is the mean over its n-grams of the logarithm of the ratio
of both, in whole thousandths. A text is kept if it passes the plain rules and its rating is no
less than that which all but LEAST_SHARE of the trusted texts reach.

Trusted texts come in two folds, by a hash of the key, and each text is rated by the fold that it is
not in, so that trusted texts meet the threshold as others do. Counts, ratings and the threshold
cover all texts; ratings are integers, so that nothing depends on the order of sums. Texts are read
twice, to count and to rate; what is shuffled is a row per bucket and task, and what the driver gets
is BUCKETS rows. All work on texts is built-in expressions.

A text without words, null texts too, has zeros and fails. Without trusted texts every rating is 0
and only the plain rules decide. Of several label rows for a key, all must trust it; label rows
without a key or a label are left out. Rows that repeat are rated alike; empty tables give empty
results. Results are named columns of their own, whatever else the tables have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import attach, stash

BUCKETS = 1 << 15
PRIOR = 1 << 13
LEAST_SHARE = 0.002
LEAST_WORDS = 50
#: A text fails if more than this percentage of its words stand in windows of three that occur again.
MOST_REPEATED = 50
#: What parts words, and the characters that count as symbols.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Sorting packs a window's place into the low bits of its hash; longer texts are sorted whole.
_PLACE_BITS = 24
_PLACES = (1 << _PLACE_BITS) - 1


def words_of(text: Column) -> Column:
    """The words of a text that isn't null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))


def _from(values: Column, first: int, drop: int) -> Column:
    """The values from the first place (from 1) on, without the last `drop` of all."""
    return F.slice(values, F.lit(first), F.greatest(F.lit(0), F.size(values) - (first - 1) - drop))


def _beside(values: Column, same) -> Column:
    """Of sorted values those that are the same as the one before or after."""
    return F.filter(values, lambda x, i: same(x, F.get(values, i - 1)) | same(x, F.get(values, i + 1)))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with h, the hashes of a text's words in order.

    Windows are first sorted as numbers, the high bits of a hash with the place in the low ones, which
    leaves the few that may occur again; of these the whole hashes are compared.
    """
    c = F.col
    out = rows.withColumn("w", F.transform(_from(c("h"), 1, 2), lambda x, i: F.xxhash64(x, F.get(c("h"), i + 1), F.get(c("h"), i + 2))))
    packed = F.transform("w", lambda x, i: F.shiftleft(F.shiftright(x, _PLACE_BITS), _PLACE_BITS).bitwiseOR(i.cast("long")))
    out = out.withColumn("s", F.sort_array(packed))
    near = _beside(c("s"), lambda x, y: F.coalesce(F.shiftright(x, _PLACE_BITS) == F.shiftright(y, _PLACE_BITS), F.lit(False)))
    places = F.when(F.size("w") > _PLACES, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.transform(near, lambda x: x.bitwiseAND(F.lit(_PLACES)).cast("int")))
    out = out.withColumn("p", places).drop("s")
    out = out.withColumn("s", F.sort_array(F.transform("p", lambda p: F.struct(F.get(c("w"), p).alias("w"), p.alias("p"))))).drop("p", "w")
    again = _beside(c("s"), lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False)))
    out = out.withColumn("p", F.sort_array(F.transform(again, lambda x: x["p"]))).drop("s")
    covered = F.aggregate(F.transform("p", lambda p, i: F.least(F.lit(3), F.coalesce(p - F.get(c("p"), i - 1), F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", covered).drop("p")


def _grams(h: Column) -> Column:
    """Hashes of the words and of the pairs of words that follow each other."""
    return F.concat(h, F.transform(_from(h, 2, 0), lambda x, i: F.xxhash64(F.get(h, i), x)))


def _hashed(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("h", F.transform(words_of(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)))


def statistics(text: Column) -> dict[str, Column]:
    """The plain statistics that need no hashes, of a text that isn't null."""
    held = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    return {
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": held(SYMBOLS).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def _fold(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(2)).cast("int")


def trusted_keys(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """The keys (k) that every label row trusts."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(F.col(label).cast("int") == 1).alias("all"))
    return known.filter("all").select("k")


def ratios(rows: DataFrame, buckets: int, prior: int) -> list[list[int]]:
    """For each fold the log ratio of each bucket, in thousandths, by the trusted texts of the other fold; rows have text, fold and trusted."""
    gram = _hashed(rows, "text").select("fold", "trusted", F.explode(F.transform(_grams(F.col("h")), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))).alias("b"))
    count = lambda fold: F.count_if(F.col("trusted") & (F.col("fold") == 1 - fold)).cast("double")
    counts = stash(gram.groupBy("b").agg(F.count("*").cast("double").alias("raw"), count(0).alias("t0"), count(1).alias("t1")))
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("raw", "t0", "t1"))).first()
    raw = (F.col("raw") + 1) / (total["raw"] + buckets)
    ratio = lambda t: F.round(1000 * F.log((F.col(t) + prior * raw) / (total[t] + prior) / raw)).cast("int").alias(t)
    out = [[0] * buckets, [0] * buckets]
    for b, *both in counts.select("b", ratio("t0"), ratio("t1")).collect():  # at most a row per bucket
        out[0][b], out[1][b] = both
    return out


def _listed(values: list[int]) -> Column:
    """The numbers as one array that the optimiser makes a constant of."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", buckets: int = BUCKETS, prior: int = PRIOR, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio (mean of its n-grams) and kept."""
    trusted = stash(trusted_keys(labels, key, label).withColumn("trusted", F.lit(True)))
    rows = attach(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), trusted, ("k",))
    rows = rows.select("k", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"), _fold(F.col("k")).alias("fold"))
    by_fold = ratios(rows, buckets, prior)

    filled = F.coalesce("text", F.lit(""))
    plain = statistics(filled)
    seen = _hashed(rows.select("k", "trusted", "fold", filled.alias("text"), *(v.alias(n) for n, v in plain.items())), "text")
    total = lambda fold: F.aggregate(_grams(F.col("h")), F.lit(0).cast("long"), lambda a, x: a + F.get(_listed(by_fold[fold]), F.pmod(x, F.lit(buckets)).cast("int")))
    n = F.size("h").cast("long")
    rated = seen.select("k", "trusted", n.alias("n_words"), *plain, "h", F.when(F.col("fold") == 0, total(0)).otherwise(total(1)).alias("total"))
    grams = F.greatest(F.lit(1), F.col("n_words") * 2 - 1)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rated = stash(_with_repeats(rated).select("k", "trusted", "n_words", *plain, "n_repeat_words", failed.alias("base_failed"), F.floor(F.col("total") / grams).alias("rating"), (F.col("total") / (1000 * grams)).alias("log_ratio")))
    least = rated.filter("trusted and not base_failed").agg(F.percentile("rating", F.lit(float(least_share))).alias("least")).first()["least"]
    good = F.lit(True) if least is None else F.col("rating") >= F.lit(least)
    return rated.select(F.col("k").alias("id"), "n_words", *plain, "n_repeat_words", "base_failed", "log_ratio", (~F.col("base_failed") & good).alias("kept"))
