"""What is known of clusters: statistics, keywords by class-based TF-IDF, labels, outliers.

Cluster -1 is noise. Clusters come as a column; operators.density finds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NOISE = -1


def cluster_stats(points: DataFrame, cluster: str = "cluster", probability: str | None = None) -> DataFrame:
    """Per cluster: points, share of all in percent to one place, and mean probability, clamped."""
    p = F.avg(T.probability(F.col(probability), F.col(cluster))) if probability else F.lit(None).cast("double")
    sizes = points.groupBy(cluster).agg(F.count("*").alias("n_points"), p.alias("mean_probability"))
    total = sizes.agg(F.sum("n_points").alias("_all"))
    return sizes.join(F.broadcast(total)).select(cluster, "n_points", F.round(F.col("n_points") * 100 / F.col("_all"), 1).alias("percent"), "mean_probability")  # one row


def map_stats(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: clusters, noise points and all points."""
    sizes = points.groupBy(cluster).agg(F.count("*").alias("n"))
    c = F.col(cluster)
    return sizes.agg(F.count_if(c != NOISE).alias("n_clusters"), F.coalesce(F.sum(F.when(c == NOISE, F.col("n"))), F.lit(0)).cast("long").alias("noise_points"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_points"))


def outliers(points: DataFrame, least: float = 0.5, cluster: str = "cluster", probability: str = "probability") -> DataFrame:
    return points.filter((F.col(cluster) == NOISE) | (F.col(probability) < least))


def _top(counted: DataFrame, n: int, cluster: str, score: str, word: str) -> DataFrame:
    best = Window.partitionBy(cluster).orderBy(F.desc(score), word)
    return counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def cluster_top_words(docs: DataFrame, n: int = 3, cluster: str = "cluster", text: str = "text") -> DataFrame:
    """Per cluster but noise: its n most frequent words of more than three characters, joined by a comma."""
    words = docs.filter(F.col(cluster) != NOISE).select(cluster, F.explode(T.label_words(F.col(text))).alias("word"))
    top = _top(words.groupBy(cluster, "word").agg(F.count("*").alias("n")), n, cluster, "n", "word")
    listed = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return top.groupBy(cluster).agg(F.array_join(F.transform(listed, lambda x: x["word"]), ", ").alias("label"))


def ctfidf_keywords(docs: DataFrame, n: int = 10, cluster: str = "cluster", text: str = "text") -> DataFrame:
    """Rows (cluster, rank, keyword, score): each cluster's terms by class-based TF-IDF, all built-in.

    Terms that are in too few or too many clusters are left out: fewer than log2 of the clusters,
    1 to 8, or a share of more than 1 - log2(c) / (log2(c) + 5), at least 0.6; with fewer than three
    clusters none is too frequent. idf is ln(mean terms of a cluster / total of the term), and can be
    negative; a cluster's weights are divided by the sum of their absolute values; only positive
    ones are reported. A cluster whose terms are all left out is scored over all terms.
    """
    clustered = docs.filter(F.col(cluster) != NOISE)
    counts = clustered.select(F.col(cluster).alias("_c"), F.explode(T.keyword_terms(F.col(text))).alias("term")).groupBy("_c", "term").agg(F.count("*").alias("tf"))
    clusters = clustered.filter(F.col(text).rlike(T.KEYWORD)).agg(F.count_distinct(cluster).alias("_n"))
    log2 = F.log2(F.greatest(F.col("_n"), F.lit(1)).cast("double"))
    least = F.greatest(F.lit(1), F.least(F.lit(8), F.floor(log2).cast("int")))
    most = F.when(F.col("_n") < 3, 1.0).otherwise(F.greatest(F.lit(0.6), 1 - log2 / (log2 + 5))) * F.col("_n")
    per_term = counts.groupBy("term").agg(F.sum("tf").alias("_total"), F.count("*").alias("_df"), F.collect_list(F.struct("_c", "tf")).alias("_of"))  # at most a struct per cluster
    placed = per_term.join(F.broadcast(clusters)).select("term", "_total", ((F.col("_df") >= least) & (F.col("_df") <= most)).alias("_fit"), F.inline("_of"))  # one row
    sizes = placed.groupBy("_c").agg(F.sum(F.when(F.col("_fit"), F.col("tf"))).alias("_strict"), F.sum("tf").alias("_loose"))
    mean = lambda c: F.greatest(F.lit(1), F.floor(F.avg(c)))
    means = sizes.agg(mean("_strict").alias("_a"), mean("_loose").alias("_b"))
    known = sizes.join(F.broadcast(means)).select("_c", F.col("_strict").isNull().alias("_all"), F.when(F.col("_strict").isNull(), F.col("_b")).otherwise(F.col("_a")).alias("_mean"))  # one row
    weighted = placed.join(known, "_c").filter("_fit or _all").select("_c", "term", (F.col("tf") * F.log(F.col("_mean") / F.col("_total"))).alias("_w"))
    norms = weighted.groupBy("_c").agg(F.sum(F.abs("_w")).alias("_norm"))
    top = _top(weighted.filter("_w > 0"), n, "_c", "_w", "term").join(norms, "_c")
    return top.select(F.col("_c").alias(cluster), "rank", F.col("term").alias("keyword"), (F.col("_w") / F.col("_norm")).alias("score"))


def join_keywords(docs: DataFrame, keywords: DataFrame, cluster: str = "cluster", n: int = 3) -> DataFrame:
    """docs with keywords, the first n of its cluster's; noise has none."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "keyword")))
    per = keywords.filter(F.col("rank") <= n).groupBy(cluster).agg(F.transform(listed, lambda x: x["keyword"]).alias("_k"))
    joined = docs.join(per, cluster, "left")
    return joined.select(*docs.columns, F.coalesce(F.col("_k"), F.array().cast("array<string>")).alias("keywords"))


def group_by_cluster(points: DataFrame, key: str = "doc_id", cluster: str = "cluster", probability: str = "cluster_probability") -> DataFrame:
    """Rows (cluster, place, key, probability): members of each cluster in order of key.

    A nested list per cluster would be as large as the cluster; as rows, its members are sorted in
    ranges, and a reader that wants lists takes those of the clusters that it shows.
    """
    return points.select(cluster, key, F.col(probability).alias("probability")).repartitionByRange(cluster, key).sortWithinPartitions(cluster, key)


def keyword_map(keywords: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster: its keywords as structs (keyword, score) in order of rank, as exports hold them."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "keyword", "score")))
    return keywords.groupBy(cluster).agg(F.transform(listed, lambda x: F.struct(x["keyword"].alias("keyword"), x["score"].alias("score"))).alias("keywords"))


def keyword_rows(nested: DataFrame, cluster: str = "cluster") -> DataFrame:
    """keyword_map() undone: rows (cluster, rank from 1, keyword, score)."""
    return nested.select(cluster, F.posexplode("keywords").alias("k", "w")).select(cluster, (F.col("k") + 1).alias("rank"), "w.keyword", "w.score")
