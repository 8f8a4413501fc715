"""Queries on the map: points, scopes, masks, names, colours, neighbours by cell, schemas by each rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import clusters, density, filters, layout, points, prepare, spatial
from ..operators._tables import cut
from .queries import _CELLS, _CLUSTERED, _SPACED, _TRIM, _clustered, _docs, _table, query

_MAP = """m AS (SELECT vec_id AS doc_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label - 1 AS cluster, 0.5::DOUBLE + embedding[3]::DOUBLE AS p FROM embeddings)"""
_LABEL = "CASE WHEN {0} = -1 THEN 'Noise' ELSE 'Cluster ' || {0} END"


def _projection(spark, sf_dir):
    e = F.col("embedding")
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))


def _assigned(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("label") - 1).alias("cluster"), (F.lit(0.5) + F.col("embedding")[2].cast("double")).alias("cluster_probability"))


def _joined(spark, sf_dir):
    return points.join_points(_docs(spark, sf_dir), _projection(spark, sf_dir), _assigned(spark, sf_dir))


@query("join_points", f"WITH {_MAP} SELECT doc_id, lang, round(x, 9) AS x, round(y, 9) AS y, cluster, round(p, 9) AS cluster_probability FROM documents JOIN m USING (doc_id)")
def join_points(spark, sf_dir):
    out = _joined(spark, sf_dir)
    return out.select("doc_id", "lang", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "cluster", F.round("cluster_probability", 9).alias("cluster_probability"))


@query("map_points", f"""WITH {_MAP} SELECT doc_id, coalesce(round(x, 9), 0) AS x, coalesce(round(y, 9), 0) AS y, coalesce(cluster, -1)::INT AS cluster, {_LABEL.format('coalesce(cluster, -1)')} AS cluster_name,
round(CASE WHEN p IS NULL THEN CASE WHEN coalesce(cluster, -1) = -1 THEN 0.5 ELSE 1 END ELSE least(1, greatest(0, p)) END, 9)::DOUBLE AS cluster_probability, lang, source, lang || '/' || source AS fields FROM documents LEFT JOIN m USING (doc_id)""")
def map_points(spark, sf_dir):
    out = points.map_points(_docs(spark, sf_dir), _projection(spark, sf_dir), _assigned(spark, sf_dir), ["lang", "source"])
    fields = F.concat_ws("/", F.col("metadata")["lang"], F.col("metadata")["source"])
    return out.select("doc_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "cluster", "cluster_name", F.round("cluster_probability", 9).alias("cluster_probability"), "lang", "source", fields.alias("fields"))


@query("resolve_field", "SELECT doc_id, lang AS own, source AS from_map FROM documents")
def resolve_field(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "lang", F.create_map(F.lit("source"), "source", F.lit("lang"), F.lit("hidden")).alias("metadata"))
    return docs.select("doc_id", points.field(docs, "lang").alias("own"), points.field(docs, "source").alias("from_map"))


@query("filter_cluster", f"WITH {_MAP} SELECT doc_id FROM m WHERE {_LABEL.format('cluster')} = 'Cluster 3'")
def filter_cluster(spark, sf_dir):
    return points.in_cluster(_assigned(spark, sf_dir), "Cluster 3").select("doc_id")


@query("visible_clusters", f"WITH {_MAP} SELECT DISTINCT cluster FROM m JOIN documents USING (doc_id) WHERE lang = 'fr' AND n_chars > 500")
def visible_clusters(spark, sf_dir):
    docs = _joined(spark, sf_dir)
    return points.visible_clusters(docs, filters.condition(docs, {"lang": {"type": "category", "value": "fr"}, "n_chars": {"type": "number", "value": {"min": 501}}}))


@query("dim_mask", f"""WITH {_MAP} SELECT doc_id, doc_id IN (SELECT doc_id FROM documents WHERE contains(lower(text), 'only')) OR doc_id = 7 AS highlighted,
NOT (doc_id IN (SELECT doc_id FROM documents WHERE contains(lower(text), 'only')) AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND doc_id = 7) AS dimmed FROM m""")
def dim_mask(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return points.masks(_projection(spark, sf_dir), docs.filter(F.contains(F.lower("text"), F.lit("only"))), docs.filter("lang = 'en'"), 7).select("doc_id", "highlighted", "dimmed")


@query("resolve_scope", f"WITH {_MAP} SELECT doc_id, 'lasso' AS scope FROM m WHERE x > 0 AND y > 0")
def resolve_scope(spark, sf_dir):
    docs, placed = _docs(spark, sf_dir), _projection(spark, sf_dir)
    kind, ids = points.resolve_scope(placed.filter("x > 0 and y > 0"), docs.filter("lang = 'en'"), docs)
    return ids.withColumn("scope", F.lit(kind))


@query("scope_of_filters", "SELECT doc_id, 'filters' AS scope FROM documents WHERE lang = 'de'")
def scope_of_filters(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    kind, ids = points.resolve_scope(None, None, docs, F.col("lang") == "de")
    return ids.withColumn("scope", F.lit(kind))


_GOLDEN = "((cluster * 137.508::DOUBLE) % 360)"


def _channel(n: int) -> str:
    k = f"(({n}.0::DOUBLE + {_GOLDEN} / 30) % 12)"
    level = f"(0.5::DOUBLE - 0.325::DOUBLE * greatest(-1.0::DOUBLE, least({k} - 3, 9 - {k}, 1.0::DOUBLE)))"
    return f"lpad(lower(to_hex(floor({level} * 255 + 0.5::DOUBLE)::BIGINT)), 2, '0')"


@query("color_join", f"WITH {_MAP} SELECT doc_id, CASE WHEN cluster = 2 THEN 'Two' ELSE {_LABEL.format('cluster')} END AS cluster_name, CASE WHEN cluster = -1 THEN '#999999' ELSE '#' || {_channel(0)} || {_channel(8)} || {_channel(4)} END AS colour FROM m")
def color_join(spark, sf_dir):
    names = spark.createDataFrame([(2, "Two"), (-1, "never")], "cluster int, name string")
    return points.coloured(_assigned(spark, sf_dir), names).select("doc_id", "cluster_name", "colour")


@query("grid_join", f"WITH {_MAP} SELECT q.doc_id AS query_id, m.doc_id, round(sqrt((q.x - m.x) ** 2 + (q.y - m.y) ** 2), 9) AS distance FROM m q JOIN m ON sqrt((q.x - m.x) ** 2 + (q.y - m.y) ** 2) < 0.05 WHERE q.doc_id % 50 = 0")
def grid_join(spark, sf_dir):
    placed = _projection(spark, sf_dir)
    asked = placed.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return points.grid_join(asked, placed, 0.05).withColumn("distance", F.round("distance", 9))


_HITS = f"""h AS (SELECT doc_id AS hit_id, CASE WHEN doc_id % 5 = 0 THEN doc_id END AS "index", CASE WHEN doc_id % 5 = 1 THEN x END AS x, CASE WHEN doc_id % 5 = 1 THEN y END AS y, CASE WHEN doc_id % 5 = 2 THEN doc_id END AS parent_id,
CASE WHEN doc_id % 5 = 3 THEN doc_id END AS d, CASE WHEN doc_id % 5 = 4 THEN text END AS text FROM m JOIN documents USING (doc_id)),
t AS (SELECT min(doc_id) AS "index", lower({_TRIM.format("text")}) AS t FROM m JOIN documents USING (doc_id) GROUP BY 2)"""


@query("resolve_point", f"""WITH {_MAP}, {_HITS} SELECT hit_id, coalesce(h."index", CASE WHEN h.x IS NOT NULL THEN hit_id END, parent_id, d, t."index") AS "index",
CASE WHEN h."index" IS NOT NULL THEN 0 WHEN h.x IS NOT NULL THEN 1 WHEN parent_id IS NOT NULL THEN 3 WHEN d IS NOT NULL THEN 4 ELSE 6 END AS rule FROM h LEFT JOIN t ON lower({_TRIM.format("h.text")}) = t.t""")
def resolve_point(spark, sf_dir):
    """Hits that are known by one field each, in turn; resolve_point_text has those that are known by a part or by words."""
    none = F.lit(None).cast("string")
    placed = cut(_joined(spark, sf_dir))  # hits and points both, so that texts are joined once
    all_ = placed.select(F.col("doc_id").alias("index"), "x", "y", none.alias("chunk_id"), "doc_id", none.alias("source_id"), "text")
    only = lambda k, c: F.when(F.col("doc_id") % 5 == k, F.col(c))
    hits = placed.select(F.col("doc_id").alias("hit_id"), only(0, "doc_id").alias("index"), only(1, "x").alias("x"), only(1, "y").alias("y"), none.alias("chunk_id"), only(2, "doc_id").alias("parent_id"), only(3, "doc_id").alias("doc_id"), none.alias("source_id"), only(4, "text").alias("text"))
    return points.resolve_points(hits, all_)


_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: length(w) > 3)"


@query("resolve_point_text", f"""WITH {_MAP}, p AS (SELECT doc_id, lower(text) AS b, lower({_TRIM.format("text")}) AS t, {_WORDS.format("substring(lower(text), 1, 150)")} AS y, text FROM m JOIN documents USING (doc_id)),
h AS (SELECT doc_id AS hit_id, lower({_TRIM.format("CASE WHEN doc_id % 2 = 0 THEN substring(text, 11, 160) ELSE array_to_string(list_reverse(" + _SPACED.format("text") + "[1:12]), ' ') END")}) AS a FROM p),
k AS (SELECT hit_id, a, {_WORDS.format("substring(a, 1, 150)")} AS x FROM h),
c AS (SELECT hit_id, doc_id, t = a AND a <> '' AS same, length(a) > 30 AND contains(b, substring(a, 1, 120)) AS part,
  CASE WHEN length(a) > 20 AND least(len(x), len(y)) > 0 THEN len(list_filter(x, lambda w: list_contains(y, w))) / least(len(x), len(y)) ELSE 0 END AS share FROM k, p),
r AS (SELECT hit_id, min(doc_id) FILTER (same) AS r6, min(doc_id) FILTER (part) AS r7, max(struct_pack(s := share, i := -doc_id)) FILTER (share > 0.78) AS r8 FROM c GROUP BY hit_id)
SELECT hit_id, coalesce(r6, r7, -r8.i) AS "index", CASE WHEN r6 IS NOT NULL THEN 6 WHEN r7 IS NOT NULL THEN 7 ELSE 8 END AS rule FROM r WHERE coalesce(r6, r7, -r8.i) IS NOT NULL""")
def resolve_point_text(spark, sf_dir):
    """Hits that are known by a part of a text, or by some of its words in another order."""
    none = F.lit(None).cast("string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # texts with a place may lie in few files, and each is searched
    placed = cut(_joined(spark, sf_dir).repartition(parts))  # hits and points both, so that texts are joined once
    all_ = placed.select(F.col("doc_id").alias("index"), "x", "y", none.alias("chunk_id"), "doc_id", none.alias("source_id"), "text")
    few = F.array_join(F.reverse(F.slice(T.spaced(F.col("text")), 1, 12)), " ")
    known = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 11, 160)).otherwise(few)
    lone = lambda c, kind: F.lit(None).cast(kind).alias(c)
    hits = placed.select(F.col("doc_id").alias("hit_id"), lone("index", "long"), lone("x", "double"), lone("y", "double"), none.alias("chunk_id"), lone("parent_id", "long"), lone("doc_id", "long"), none.alias("source_id"), known.alias("text"))
    return points.resolve_points(hits, all_)


@query("result_metadata", "SELECT doc_id, left(coalesce(text, ''), 20) || chr(10) || '[Metadata: lang: ' || lang || ' | n_chars: ' || n_chars || ']' AS text FROM documents")
def result_metadata(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("text", F.substring("text", 1, 20)).withColumn("my_color", F.lit("red"))
    return docs.select("doc_id", points.result_text(docs, ["lang", "my_color", "absent", "n_chars"]).alias("text"))


@query("group_by_cluster", f"WITH {_MAP} SELECT cluster, doc_id, round(p, 9) AS probability FROM m")
def group_by_cluster(spark, sf_dir):
    return clusters.group_by_cluster(_assigned(spark, sf_dir)).withColumn("probability", F.round("probability", 9))


@query("outliers", f"WITH {_MAP} SELECT doc_id FROM m WHERE cluster = -1 OR p < 0.5")
def outliers(spark, sf_dir):
    return clusters.outliers(_assigned(spark, sf_dir), probability="cluster_probability").select("doc_id")


@query("viewport", f"WITH {_MAP} SELECT doc_id FROM m WHERE x BETWEEN -0.15 AND 0.15 AND y BETWEEN -0.1 AND 0.2")
def viewport(spark, sf_dir):
    return spatial.viewport(_projection(spark, sf_dir), (-0.1, -0.05), (0.1, 0.15), 0.05).select("doc_id")


@query("join_keywords", f"""WITH {_CLUSTERED}, t AS (SELECT cluster, unnest(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+')) AS word FROM p WHERE cluster <> -1),
c AS (SELECT cluster, word, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, word) AS rank FROM t WHERE length(word) > 3 GROUP BY cluster, word),
k AS (SELECT cluster, string_agg(word, ',' ORDER BY rank) AS keywords FROM c WHERE rank <= 3 GROUP BY cluster)
SELECT doc_id, coalesce(keywords, '') AS keywords FROM p LEFT JOIN k USING (cluster)""")
def join_keywords(spark, sf_dir):
    docs = _clustered(spark, sf_dir)
    words = docs.filter("cluster <> -1").select("cluster", F.explode(T.label_words(F.col("text"))).alias("keyword")).groupBy("cluster", "keyword").agg(F.count("*").alias("n"))
    top = clusters._top(words, 3, "cluster", "n", "keyword")
    return clusters.join_keywords(docs, top).select("doc_id", F.array_join("keywords", ",").alias("keywords"))


@query("keyword_map", f"""WITH {_CLUSTERED}, t AS (SELECT cluster, unnest(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+')) AS word FROM p WHERE cluster <> -1),
c AS (SELECT cluster, word, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, word) AS rank FROM t WHERE length(word) > 3 GROUP BY cluster, word)
SELECT cluster, rank::INT AS rank, word AS keyword, n AS score FROM c WHERE rank <= 5""")
def keyword_map(spark, sf_dir):
    docs = _clustered(spark, sf_dir)
    words = docs.filter("cluster <> -1").select("cluster", F.explode(T.label_words(F.col("text"))).alias("keyword")).groupBy("cluster", "keyword").agg(F.count("*").alias("score"))
    return clusters.keyword_rows(clusters.keyword_map(clusters._top(words, 5, "cluster", "score", "keyword")))


@query("probabilities", f"WITH {_MAP} SELECT doc_id, printf('%.2f%%', least(1, greatest(0, p)) * 100) AS shown FROM m")
def probabilities(spark, sf_dir):
    return _assigned(spark, sf_dir).select("doc_id", T.percent(T.probability(F.col("cluster_probability"), F.col("cluster"))).alias("shown"))


_LOOSE = """CASE WHEN lower(trim({0})) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(trim({0}), '-?\\d+(\\.\\d+)?') THEN 'number' WHEN regexp_matches(trim({0}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AND length(trim({0})) > 8 THEN 'date' ELSE 'text' END"""


@query("metadata_schema_api", f"""WITH {_CELLS}, v AS (SELECT name, coalesce(value, 'null') AS value, count(*) AS n, min(doc_id) AS place FROM c GROUP BY ALL)
SELECT name, min_by({_LOOSE.format('value')}, place) AS type, count(*) AS n_values, sum(n)::BIGINT AS n_rows, array_to_string(list(value ORDER BY place, value)[1:10], ',') AS unique_values FROM v GROUP BY name""")
def metadata_schema_api(spark, sf_dir):
    return prepare.metadata_schema_api(_docs(spark, sf_dir), ["lang", "source", "n_chars"], "doc_id").withColumn("unique_values", F.array_join("unique_values", ","))


@query("upload_schema", f"""WITH h AS (SELECT * FROM documents ORDER BY doc_id LIMIT 10), {_CELLS.replace('documents', 'h')}, v AS (SELECT name, trim(value) AS v FROM c WHERE value IS NOT NULL AND lower(trim(value)) NOT IN ('', 'nan')),
s AS (SELECT name, bool_and(try_cast(v AS DOUBLE) IS NOT NULL) AS num, bool_and(NOT contains(v, '.')) AS whole, bool_and(try_cast(v AS TIMESTAMP) IS NOT NULL) AS dat, bool_and(lower(v) IN ('true', 'false', 'yes', 'no', '0', '1')) AS bool, count(DISTINCT v) <= greatest(5, count(*) * 0.1) AS cat, count(*) AS n_sampled FROM v GROUP BY name)
SELECT name, CASE WHEN num THEN CASE WHEN whole THEN 'integer' ELSE 'number' END WHEN dat THEN 'date' WHEN bool THEN 'boolean' WHEN cat THEN 'category' ELSE 'text' END AS type, n_sampled FROM s""")
def upload_schema(spark, sf_dir):
    return prepare.upload_schema(_docs(spark, sf_dir), ["lang", "source", "n_chars"], "doc_id")


# text columns


@query("highlight_phrase", "SELECT doc_id, regexp_replace(text, '(?i)(on the)', '<mark>\\1</mark>', 'g') AS marked FROM documents")
def highlight_phrase(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.highlight_phrase(F.col("text"), "on the").alias("marked"))


@query("highlight_term", "SELECT doc_id, regexp_replace(text, '(?i)(only)', '<mark class=\"fast-highlight\">\\1</mark>', 'g') AS marked FROM documents")
def highlight_term(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.highlight_phrase(F.col("text"), "only", "fast-highlight").alias("marked"))


@query("searchable_text", "SELECT doc_id, concat_ws(' ', text, CASE WHEN length(lang) < 500 THEN lang END, CASE WHEN length(source) < 500 THEN source END) AS searchable FROM documents")
def searchable_text(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", prepare.searchable_text(docs, "text").alias("searchable"))


@query("normalize_spaces", r"SELECT doc_id, CASE WHEN regexp_matches(text, '\s\s|^\s|\s$') THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE text END AS tidy FROM documents")
def normalize_spaces(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_spaces(F.col("text")).alias("tidy"))


@query("e5_prefix", "SELECT doc_id, 'query: ' || text AS asked, 'passage: ' || text AS held FROM documents")
def e5_prefix(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.prefixed(F.col("text"), " Question").alias("asked"), T.prefixed(F.col("text"), "other").alias("held"))


@query("escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def escape_html(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query("strip_think", """WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<think>' || role || chr(10) || '</think> ' || text WHEN 1 THEN text || ' <think> open' ELSE '<think>' || text || '</think>' END AS t FROM conversations),
r AS (SELECT *, trim(regexp_replace(regexp_replace(t, '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*$', '')) AS rest FROM c)
SELECT conv_id, turn, CASE WHEN rest <> '' THEN rest ELSE trim(regexp_replace(t, '(?i)</?think>', '', 'g')) END AS answer FROM r""")
def strip_think(spark, sf_dir):
    t, c = F.col("text"), F.col
    raw = F.when(c("turn") % 3 == 0, F.concat(F.lit("<think>"), "role", F.lit("\n</think> "), t)).when(c("turn") % 3 == 1, F.concat(t, F.lit(" <think> open"))).otherwise(F.concat(F.lit("<think>"), t, F.lit("</think>")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_think(raw).alias("answer"))


@query("format_fields", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'My Field' WHEN event_id % 3 = 1 THEN 'Value Of It' ELSE 'Text' END AS title, CASE WHEN event_id * 900 < 1024 THEN event_id * 900 || ' B' WHEN event_id * 900 < 1048576 THEN printf('%.1f KB', floor(event_id * 900 / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(event_id * 900 / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS size, CASE WHEN floor(value) < 60 THEN floor(value)::BIGINT || 's' ELSE floor(value / 60)::BIGINT || 'm ' || floor(value)::BIGINT % 60 || 's' END AS took FROM events")
def format_fields(spark, sf_dir):
    k = F.col("event_id") % 3
    key = F.when(k == 0, "metadata_myField").when(k == 1, "value_of-it").otherwise("Column text")
    return _table(spark, sf_dir, "events").select("event_id", T.format_key(key).alias("title"), T.file_size(F.col("event_id") * 900).alias("size"), T.duration(F.col("value")).alias("took"))


@query("rechunk", """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents), w AS (SELECT doc_id, unnest(range(0, greatest(1, ceil(n / 298.0))::BIGINT)) AS i, text FROM d),
c AS (SELECT doc_id, i, """ + _TRIM.format("substring(text, i * 298 + 1, 350)") + """ AS piece FROM w) SELECT doc_id, string_agg(piece, '|' ORDER BY i) AS pieces FROM c WHERE piece <> '' GROUP BY doc_id""")
def rechunk(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.rechunk(F.col("text"), 100), "|").alias("pieces")).filter("pieces <> ''")


@query("normalized_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) ** 2)), 6) AS squared, round(list_sum(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN x ELSE 0 END::DOUBLE)), 5) AS total FROM embeddings")
def normalized_vectors(spark, sf_dir):
    e = F.col("embedding")
    summed = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    unit = V.l2_normalized(e)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.dot(unit, unit), 6).alias("squared"), F.round(summed(V.finite(e)), 5).alias("total"))


@query("text_report", f"SELECT count(*) AS looked_at, count(*) FILTER (lower({_TRIM.format('text')}) NOT IN ('', 'nan')) AS filled, count(*) > 0 AS usable, count(*) FILTER (lower({_TRIM.format('text')}) NOT IN ('', 'nan')) * 2 < count(*) AS sparse FROM (SELECT text FROM documents LIMIT 100)")
def text_report(spark, sf_dir):
    return prepare.text_column_report(_docs(spark, sf_dir), "text")


@query("index_columns", "SELECT doc_id, lang FROM documents")
def index_columns(spark, sf_dir):
    noisy = _docs(spark, sf_dir).select("text", "doc_id", "lang", *(F.lit(0).alias(c) for c in ("Unnamed: 0", "__index__", "index", "12")))
    return noisy.select(*(f"`{c}`" for c in prepare.metadata_columns(noisy, "text")))


@query("spaced_words", f"SELECT doc_id, len({_SPACED.format('text')})::INT AS n_words, array_to_string({_SPACED.format('text')}[1:5], ' ') AS first_words FROM documents")
def spaced_words(spark, sf_dir):
    words = T.spaced(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(words).alias("n_words"), F.array_join(F.slice(words, 1, 5), " ").alias("first_words"))


# places and clusters that are found, not given: results that SQL does not express, held against brute force in the tests


@query("hdbscan")
def hdbscan(spark, sf_dir):
    return density.hdbscan(_table(spark, sf_dir, "embeddings")).select("vec_id", "cluster", F.round("cluster_probability", 6).alias("cluster_probability"))


@query("layout_2d")
def layout_2d(spark, sf_dir):
    out = layout.layout(_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", F.round(F.col("coords")[0], 6).alias("x"), F.round(F.col("coords")[1], 6).alias("y"))


@query("projection_pca", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, unnest(v) AS x, unnest(range(1, 65)) AS i FROM e), m AS (SELECT i, avg(x) AS m FROM x GROUP BY i)
SELECT count(DISTINCT vec_id) AS n_points, round(sum((x - m) ** 2) / count(DISTINCT vec_id), 6) AS variance FROM x JOIN m USING (i)""")
def projection_pca(spark, sf_dir):
    """All components keep all of the variance."""
    out = layout.project(_table(spark, sf_dir, "embeddings"), 64)
    squared = F.aggregate("coords", F.lit(0.0), lambda a, x: a + x * x)
    return out.agg(F.count("*").alias("n_points"), F.round(F.avg(squared), 6).alias("variance"))
