"""The engine's queries over whole tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions.types import infer_type
from ..operators import clusters, filters, lexical, neighbours, prepare, rag, similarity, spatial
from ..operators._tables import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORDS = "only rely antion"
FAST = "erin only"
POLYGON = ((-0.2, -0.2), (0.2, -0.2), (0.05, 0.0), (0.2, 0.2), (-0.2, 0.2))
_LIST = ", ".join(f"'{w}'" for w in WORDS.split())
_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"
_TRIM = r"regexp_replace({0}, '^[\s\x{{00A0}}\x{{3000}}\x{{FEFF}}]+|[\s\x{{00A0}}\x{{3000}}\x{{FEFF}}]+$', '', 'g')"
_SPACED = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_CHUNKS = f"""
d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, n, text, unnest(range(0, CASE WHEN n <= 614 THEN 1 ELSE ceil((n - 128) / 384.0)::BIGINT END)) AS position FROM d),
c AS (SELECT doc_id, n, position, {_TRIM.format("CASE WHEN n <= 614 THEN text ELSE substring(text, position * 384 + 1, 512) END")} AS text FROM w),
chunks AS (SELECT doc_id AS parent_id, doc_id || '_chunk_' || position AS chunk_id, position::INT AS position, text, (count(*) OVER (PARTITION BY doc_id))::INT AS total_chunks
           FROM c WHERE length(text) >= 50 OR n <= 614)"""
_POINTS = "p AS (SELECT vec_id AS doc_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label - 1 AS cluster FROM embeddings)"
_CLUSTERED = "p AS (SELECT doc_id, text, label - 1 AS cluster FROM documents JOIN embeddings ON vec_id = doc_id)"

_TYPE = """CASE WHEN {0} IS NULL OR lower(trim({0})) IN ('', 'nan') THEN NULL WHEN lower(trim({0})) IN ('true', 'false') THEN 'boolean'
  WHEN regexp_full_match(trim({0}), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN 'number' WHEN regexp_full_match(trim({0}), '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?|\\d{{2}}[/]\\d{{2}}[/]\\d{{4}}|\\d{{2}}-\\d{{2}}-\\d{{4}}') THEN 'date' ELSE 'text' END"""


def _bm25_sql(source: str, key: str, k: int, where: str = "true", columns: str = "") -> str:
    return f"""
b AS (SELECT *, {_TOKENS.format("coalesce(text, '')")} AS w FROM {source}),
s AS (SELECT count(*) AS n, greatest(1.0, avg(len(w))) AS a FROM b),
tf AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(w) AS term FROM b) WHERE term IN ({_LIST}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
hits AS (SELECT {key}{columns}, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / a))) AS score
  FROM tf JOIN df USING (term) JOIN b USING ({key}), s WHERE {where} GROUP BY {key}{columns} ORDER BY score DESC, {key} LIMIT {k})"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), (F.col("label") - 1).alias("cluster"))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("label") - 1).alias("cluster"))
    return _docs(spark, sf_dir).join(labels, "doc_id").select("doc_id", "text", "cluster")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


# lexical ranking


@query("bm25_topk", f"WITH {_bm25_sql('documents', 'doc_id', 10)} SELECT doc_id, round(score, 6) AS score FROM hits")
def bm25_topk(spark, sf_dir):
    return lexical.bm25_topk(_docs(spark, sf_dir), WORDS).withColumn("score", F.round("score", 6))


@query("bm25_lang_filtered", f"WITH {_bm25_sql('documents', 'doc_id', 10, where="lang = 'fr'")} SELECT doc_id, round(score, 6) AS score FROM hits")
def bm25_lang_filtered(spark, sf_dir):
    return lexical.bm25_topk(_docs(spark, sf_dir), WORDS, scope=F.col("lang") == "fr").withColumn("score", F.round("score", 6))


@query("term_df", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark, sf_dir):
    return lexical.term_df(_docs(spark, sf_dir))


@query("postings", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL")
def postings(spark, sf_dir):
    return lexical.postings(_docs(spark, sf_dir))


@query("corpus_stats", f"SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, round(greatest(1.0, avg(n)), 6) AS avg_tokens FROM (SELECT len({_TOKENS.format("coalesce(text, '')")}) AS n FROM documents)")
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(_docs(spark, sf_dir)).withColumn("avg_tokens", F.round("avg_tokens", 6))


# keyword search

_FAST_WORDS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9_\s''\-]', ' ', 'g'), '\s+'), lambda w: regexp_replace(w, '^[''\-]+|[''\-]+$', '', 'g')), lambda w: w <> '')"


@query("word_index", f"SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_FAST_WORDS}) AS word FROM documents) WHERE length(word) >= 2 GROUP BY word")
def word_index(spark, sf_dir):
    return lexical.dictionary(_docs(spark, sf_dir))


@query("word_prefix", f"SELECT DISTINCT q AS query_word, word, CASE WHEN word = q THEN 'exact' ELSE 'prefix' END AS kind FROM (SELECT DISTINCT unnest({_FAST_WORDS}) AS word FROM documents), (VALUES ('erin'), ('only')) v(q) WHERE length(word) >= 2 AND starts_with(word, q)")
def word_prefix(spark, sf_dir):
    return lexical.word_matches(lexical.dictionary(_docs(spark, sf_dir)), FAST, fuzzy=False)


def _near_sql(w: str, q: str) -> str:
    """The greedy walk: k is the length of the common start, and what follows the first difference is compared."""
    k = f"len(list_filter(range(1, {len(q)} + 1), lambda i: {w}[1:i] = '{q}'[1:i]))"
    a, b = f"substr('{q}', {k} + 1)", f"substr({w}, {k} + 1)"
    return f"""(abs(length({w}) - {len(q)}) <= 2 AND NOT contains({w}, '{q}') AND CASE WHEN {b} = '' OR {a} = '' THEN abs(length({w}) - {len(q)}) <= 1
  WHEN substr({a}, 2, 1) = substr({b}, 1, 1) THEN substr({a}, 3) = substr({b}, 2) WHEN substr({a}, 1, 1) = substr({b}, 2, 1) THEN substr({a}, 2) = substr({b}, 3) ELSE substr({a}, 2) = substr({b}, 2) END)"""


_FUZZY = " UNION ALL ".join(f"SELECT '{q}' AS query_word, word, CASE WHEN word = '{q}' THEN 'exact' WHEN starts_with(word, '{q}') THEN 'prefix' WHEN {_near_sql('word', q)} THEN 'fuzzy' END AS kind FROM d" for q in FAST.split())


@query("word_fuzzy", f"WITH d AS (SELECT DISTINCT unnest({_FAST_WORDS}) AS word FROM documents) SELECT * FROM ({_FUZZY}) WHERE kind IS NOT NULL AND length(word) >= 2")
def word_fuzzy(spark, sf_dir):
    return lexical.word_matches(lexical.dictionary(_docs(spark, sf_dir)), FAST)


def _word_score_sql(q: str) -> str:
    total, whole, start = f"((length(t) - length(replace(t, '{q}', ''))) / {len(q)})::INT", f"len(list_filter(w, lambda x: x = '{q}'))", f"len(list_filter(w, lambda x: starts_with(x, '{q}') AND x <> '{q}'))"
    return f"(CASE WHEN contains(t, '{q}') THEN 30 * {whole} + 20 * {start} + 15 * ({total} - {whole} - {start}) + greatest(0, 25 - floor((strpos(t, '{q}') - 1) / 20.0)) ELSE 0 END)::BIGINT"


_HITS = "starts_with(x, 'erin') OR starts_with(x, 'only')"
_FAST_SQL = f"""WITH d AS (SELECT doc_id, lower(text) AS t, regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+') AS w, {_FAST_WORDS} AS f, {_SPACED.format("lower(text)")} AS sp FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, {_word_score_sql("erin")} AS s1, {_word_score_sql("only")} AS s2 FROM d),
h AS (SELECT doc_id, s1, s2, (s1 > 0)::INT + (s2 > 0)::INT AS match_count, sp,
  s1 + s2 + CASE WHEN s1 > 0 AND s2 > 0 THEN 20 ELSE 0 END + CASE WHEN contains(t, '{FAST}') THEN 50 ELSE 0 END + CASE WHEN len(list_filter(sp[1:5], lambda x: contains(x, 'erin'))) > 0 THEN 30 ELSE 0 END AS total
  FROM s WHERE s1 + s2 > 0 AND len(list_filter(f, lambda x: length(x) >= 2 AND ({_HITS}))) > 0),
r AS (SELECT doc_id, match_count, floor(CASE WHEN len(sp) > 100 THEN total * 0.9::DOUBLE ELSE total END + 0.5)::BIGINT AS score FROM h)
SELECT doc_id, score, match_count, (row_number() OVER (ORDER BY score DESC, doc_id))::INT AS rank FROM r ORDER BY rank LIMIT 20"""


@query("fast_search", _FAST_SQL)
def fast_search(spark, sf_dir):
    return lexical.fast_search(_docs(spark, sf_dir), FAST, 20, fuzzy=False)


@query("fast_search_fuzzy", _FAST_SQL.replace(_HITS, f"{_HITS} OR {_near_sql('x', 'erin')} OR {_near_sql('x', 'only')}"))
def fast_search_fuzzy(spark, sf_dir):
    return lexical.fast_search(_docs(spark, sf_dir), FAST, 20)


@query("highlight", "SELECT doc_id, regexp_replace(text, '(?i)(erin|only)', '<mark class=\"fast-highlight\">\\1</mark>', 'g') AS marked FROM documents")
def highlight(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.highlight(F.col("text"), FAST.split()).alias("marked"))


def _word_sql(w: str) -> str:
    return f"regexp_matches(lower(coalesce(text, '')), '(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)')"


for _name, _query, _test in (
    ("bool_and", "only AND rely", f"{_word_sql('only')} AND {_word_sql('rely')}"),
    ("bool_or", "only OR rely antion", f"true AND {_word_sql('only')} OR {_word_sql('rely')} OR {_word_sql('antion')}"),
    ("bool_not", "only NOT rely antion", f"{_word_sql('only')} AND NOT {_word_sql('rely')} AND NOT {_word_sql('antion')}"),
    ("bool_phrase", '"on the"', "contains(lower(coalesce(text, '')), 'on the')"),
    ("bool_required_excluded", "+only -rely", f"{_word_sql('only')} AND NOT {_word_sql('rely')}"),
):
    query(_name, f"SELECT doc_id FROM documents WHERE {_test}")(lambda spark, sf_dir, q=_query: lexical.boolean_search(_docs(spark, sf_dir), q).select("doc_id"))


# preparation


@query("dedupe_exact", f"SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY {_TRIM.format("coalesce(text, '')")} ORDER BY doc_id) = 1")
def dedupe_exact(spark, sf_dir):
    return prepare.dedupe_exact(_docs(spark, sf_dir)).select("doc_id", "lang", "source")


@query("dedupe_count", f"SELECT count(*) AS n_rows, count(*) FILTER (t IN ('', 'nan')) AS n_empty, count(DISTINCT t) AS n_distinct, count(*) - count(DISTINCT t) AS n_duplicates FROM (SELECT {_TRIM.format("coalesce(text, '')")} AS t FROM documents)")
def dedupe_count(spark, sf_dir):
    return prepare.duplicate_counts(_docs(spark, sf_dir))


@query("ingest_metrics", f"SELECT count(*) AS n_rows, count(*) FILTER (lower(t) IN ('', 'nan')) AS n_empty, count(*) FILTER (lower(t) NOT IN ('', 'nan')) - count(DISTINCT t) FILTER (lower(t) NOT IN ('', 'nan')) AS n_duplicates, count(DISTINCT t) FILTER (lower(t) NOT IN ('', 'nan')) AS n_kept FROM (SELECT {_TRIM.format("coalesce(text, '')")} AS t FROM documents)")
def ingest_metrics(spark, sf_dir):
    """Counts that come with the pass that writes the documents, beside a count of what was written."""
    path = scratch(spark)
    seen = prepare.write_prepared(_docs(spark, sf_dir), path)
    return spark.read.parquet(path).agg(*(F.lit(int(seen[c])).cast("long").alias(c) for c in ("n_rows", "n_empty", "n_duplicates")), F.count("*").alias("n_kept"))


@query("drop_empty", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND lower(trim(text)) NOT IN ('', 'nan')")
def drop_empty(spark, sf_dir):
    return prepare.drop_empty(_docs(spark, sf_dir)).select("doc_id")


@query("extract_documents", f"SELECT 'doc_' || doc_id AS id, {_TRIM.format('text')} AS text, {_TRIM.format('text')} = '' AS has_empty_text, doc_id AS original_index, lang, source, n_chars FROM documents")
def extract_documents(spark, sf_dir):
    return prepare.extract_documents(_docs(spark, sf_dir), "text", "doc_id").drop("doc_id")


@query("summary256", f"SELECT doc_id, CASE WHEN len(w) > 256 THEN array_to_string(w[1:256], ' ') || '...' ELSE array_to_string(w, ' ') END AS summary FROM (SELECT doc_id, {_SPACED.format('text')} AS w FROM documents)")
def summary256(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("chunk_windows", f"WITH {_CHUNKS} SELECT parent_id, chunk_id, position, total_chunks, (position + 1) || '/' || total_chunks AS chunk_position, text, length(text)::INT AS chunk_chars FROM chunks")
def chunk_windows(spark, sf_dir):
    return prepare.chunk(_docs(spark, sf_dir))


@query("chunk_bm25", f"WITH {_CHUNKS}, {_bm25_sql('chunks', 'chunk_id', 20)} SELECT chunk_id, round(score, 6) AS score FROM hits")
def chunk_bm25(spark, sf_dir):
    return lexical.bm25_topk(prepare.chunk(_docs(spark, sf_dir)), WORDS, 20, key="chunk_id").withColumn("score", F.round("score", 6))


@query("column_stats", f"SELECT count(*) AS n_rows, count(n) AS n_filled, count(*) - count(n) AS n_empty, min(n) AS min_chars, floor(avg(n) + 0.5)::BIGINT AS mean_chars, max(n) AS max_chars FROM (SELECT CASE WHEN lower(t) NOT IN ('', 'nan') THEN length(t) END AS n FROM (SELECT {_TRIM.format('text')} AS t FROM documents))")
def column_stats(spark, sf_dir):
    return prepare.column_stats(_docs(spark, sf_dir), "text")


_CELLS = "c AS (SELECT doc_id, 'lang' AS name, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'n_chars', n_chars::VARCHAR FROM documents)"


@query("metadata_schema", f"""WITH {_CELLS}, v AS (SELECT *, {_TYPE.format('value')} AS kind FROM c WHERE value IS NOT NULL AND lower(trim(value)) NOT IN ('', 'nan')),
t AS (SELECT name, min_by(kind, doc_id) AS type, count(DISTINCT value) AS n_values, count(*) AS n_filled, list_sort(list(DISTINCT value))[1:10] AS firsts, min(try_cast(value AS DOUBLE)) AS lo, max(try_cast(value AS DOUBLE)) AS hi FROM v GROUP BY name)
SELECT name, type, n_values, n_filled, CASE WHEN type = 'number' THEN lo END AS min_value, CASE WHEN type = 'number' THEN hi END AS max_value, array_to_string(firsts, ',') AS first_values FROM t""")
def metadata_schema(spark, sf_dir):
    return prepare.metadata_schema(_docs(spark, sf_dir), ["lang", "source", "n_chars"], "doc_id").withColumn("first_values", F.array_join("first_values", ","))


@query("infer_types", f"SELECT {_TYPE.format('v')} AS type, count(*) AS n FROM (SELECT unnest([lang, source, n_chars::VARCHAR]) AS v FROM documents) GROUP BY 1")
def infer_types(spark, sf_dir):
    cells = _docs(spark, sf_dir).select(F.explode(F.array("lang", "source", F.col("n_chars").cast("string"))).alias("v"))
    return cells.groupBy(infer_type(F.col("v")).alias("type")).agg(F.count("*").alias("n"))


@query("est_tokens", f"SELECT doc_id, least(256, CASE WHEN length(text) < 100 THEN ceil(length(text) / 4.0) ELSE greatest(ceil(length(text) / 4.0), ceil(len({_SPACED.format('text')}) * 1.3::DOUBLE)) END)::BIGINT AS embed_tokens, ceil(length(text) / 3.5::DOUBLE * 1.1::DOUBLE)::BIGINT AS prompt_tokens FROM documents")
def est_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.embed_tokens(F.col("text")).alias("embed_tokens"), T.prompt_tokens(F.col("text")).alias("prompt_tokens"))


# filters

for _name, _table_name, _key, _spec, _test in (
    ("filter_category", "documents", "doc_id", {"lang": {"type": "category", "value": [" EN", "de"]}}, "lang IN ('en', 'de')"),
    ("filter_number", "documents", "doc_id", {"n_chars": {"type": "number", "value": {"min": 100, "max": 2000}}}, "n_chars BETWEEN 100 AND 2000"),
    ("filter_boolean", "labels", "doc_id", {"quality": {"type": "boolean", "value": "yes"}}, "quality = 1"),
    ("filter_text", "documents", "doc_id", {"source": {"type": "text", "value": "SRC1"}}, "contains(lower(source), 'src1')"),
    ("filter_date", "events", "event_id", {"ts": {"type": "date", "value": {"min": "2024-01-05", "max": "2024-01-12"}}}, "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'"),
    ("filter_conj", "events", "event_id", {"event_type": {"type": "category", "value": ["click", "view"]}, "value": {"type": "number", "value": {"min": 50}}, "ts": {"type": "date", "value": {"max": "2024-01-20"}}}, "event_type IN ('click', 'view') AND value >= 50 AND ts < TIMESTAMP '2024-01-21'"),
):

    def _filtered(spark, sf_dir, t=_table_name, k=_key, s=_spec):
        return filters.apply_filters(_table(spark, sf_dir, t), s).select(k)

    query(_name, f"SELECT {_key} FROM {_table_name} WHERE {_test}")(_filtered)


# dates in several forms


def _written(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    forms = {"iso": "yyyy-MM-dd", "slashed": "MM/dd/yyyy", "dashed": "MM-dd-yyyy", "timed": "yyyy-MM-dd'T'HH:mm:ss"}
    out = _table(spark, sf_dir, "events").select("event_id", *(F.date_format(ts, f).alias(n) for n, f in forms.items()))
    odd = F.when(F.col("event_id") % 2 == 0, F.col("iso")).otherwise(F.col("slashed"))
    return out.withColumns({"mixed": odd, "gaps": F.when(F.col("event_id") % 3 > 0, F.col("dashed")).otherwise(" ")})


_DAYS = "min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day"


@query("date_formats", " UNION ALL ".join(f"SELECT '{n}' AS name, {f} AS form, count(*) AS n_filled, {d} FROM events{w}" for n, f, d, w in (
    ("iso", "'date'", _DAYS, ""), ("slashed", "'month/day/year'", _DAYS, ""), ("dashed", "'month-day-year'", _DAYS, ""), ("timed", "'timestamp'", _DAYS, ""),
    ("mixed", "NULL", "NULL::VARCHAR AS first_day, NULL::VARCHAR AS last_day", ""), ("gaps", "'month-day-year'", _DAYS, " WHERE event_id % 3 > 0"),
)))
def date_formats(spark, sf_dir):
    out = prepare.date_formats(_written(spark, sf_dir), ["iso", "slashed", "dashed", "timed", "mixed", "gaps"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("filter_written_date", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'")
def filter_written_date(spark, sf_dir):
    return filters.apply_filters(_written(spark, sf_dir), {"slashed": {"type": "date", "value": {"min": "2024-01-05", "max": "2024-01-12"}}}).select("event_id")


# vectors

_COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"
_Q0 = "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), h AS (SELECT vec_id, label, " + _COS.format("embedding", "e") + " AS score FROM embeddings, q)"


@query("cosine_topk", f"WITH {_Q0} SELECT vec_id, round(score, 5) AS score FROM h ORDER BY h.score DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    return similarity.vector_topk(_table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir)).withColumn("score", F.round("score", 5))


@query("cosine_min_score", f"WITH {_Q0} SELECT vec_id, round(score, 5) AS score FROM h WHERE h.score >= 0.2")
def cosine_min_score(spark, sf_dir):
    return similarity.vector_scores(_table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), min_score=0.2).withColumn("score", F.round("score", 5))


@query("cosine_scoped", f"WITH {_Q0} SELECT vec_id, round(score, 5) AS score FROM h WHERE label = 3 ORDER BY h.score DESC, vec_id LIMIT 10")
def cosine_scoped(spark, sf_dir):
    return similarity.vector_topk(_table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), keep=F.col("label") == 3).withColumn("score", F.round("score", 5))


@query("knn_graph", f"SELECT query_id, neighbour_id, round(score, 5) AS score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, {_COS.format('a.embedding', 'b.embedding')} AS score, (row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS.format('a.embedding', 'b.embedding')} DESC, b.vec_id))::INT AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 5")
def knn_graph(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return similarity.knn(vectors, vectors.filter("vec_id % 50 = 0"), 5).withColumn("score", F.round("score", 5))


@query("knn_descent")
def knn_descent(spark, sf_dir):
    """Approximate lists of all points; the tests measure their recall."""
    return neighbours.knn_descent(_table(spark, sf_dir, "embeddings"), 10).withColumn("score", F.round("score", 6))


@query("vector_scalars", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) + 1 - 2 * embedding[1]::DOUBLE), 5) AS distance FROM embeddings")
def vector_scalars(spark, sf_dir):
    axis = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), 63))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.round(V.distance(F.col("embedding"), axis), 5).alias("distance"))


@query("rrf_fuse", f"""WITH {_Q0}, {_bm25_sql('documents', 'doc_id', 60)}, v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS vector_rank FROM h QUALIFY vector_rank < 60),
l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS bm25_rank FROM hits)
SELECT doc_id, vector_rank::INT AS vector_rank, bm25_rank::INT AS bm25_rank, round(coalesce(0.6 / (61 + vector_rank), 0) + coalesce(0.4 / (61 + bm25_rank), 0), 9) AS score FROM v FULL JOIN l USING (doc_id)
ORDER BY coalesce(0.6 / (61 + vector_rank), 0) + coalesce(0.4 / (61 + bm25_rank), 0) DESC, doc_id LIMIT 60""")
def rrf_fuse(spark, sf_dir):
    near = similarity.vector_topk(_table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 60).withColumnRenamed("vec_id", "doc_id")
    fused = similarity.rrf_fuse(near, lexical.bm25_topk(_docs(spark, sf_dir), WORDS, 60))
    return fused.select("doc_id", "vector_rank", "bm25_rank", F.round("score", 9).alias("score"))


@query("group_chunks", f"""WITH {_CHUNKS}, {_bm25_sql('chunks', 'chunk_id', 60, columns=', parent_id, position')},
r AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, chunk_id) AS rn, max(score) OVER (PARTITION BY parent_id) AS best FROM hits)
SELECT parent_id, round(max(best), 6) AS max_score, round(avg(score), 6) AS avg_score, count(*) AS n_chunks, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions FROM r WHERE rn <= 5 GROUP BY parent_id ORDER BY max(best) DESC, parent_id LIMIT 10""")
def group_chunks(spark, sf_dir):
    chunks = prepare.chunk(_docs(spark, sf_dir))
    hits = lexical.bm25_topk(chunks, WORDS, 60, key="chunk_id").join(chunks.select("chunk_id", "parent_id", "position", "text"), "chunk_id")
    found = similarity.group_chunks(hits)
    return found.select("parent_id", F.round("max_score", 6).alias("max_score"), F.round("avg_score", 6).alias("avg_score"), "n_chunks", F.array_join(F.transform("chunks", lambda c: c["position"].cast("string")), ",").alias("positions"))


@query("context_budget", f"""WITH {_bm25_sql('documents', 'doc_id', 60)}, t AS (SELECT doc_id, ceil(length(text) / 3.5::DOUBLE * 1.1::DOUBLE)::BIGINT AS n_tokens, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM hits JOIN documents USING (doc_id)),
r AS (SELECT *, sum(n_tokens) OVER (ORDER BY rank) AS used FROM t) SELECT doc_id, n_tokens, used::BIGINT AS used, rank::INT AS rank FROM r WHERE used < 20000""")
def context_budget(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return rag.within_budget(lexical.bm25_topk(docs, WORDS, 60).join(docs.select("doc_id", "text"), "doc_id"), 20000).select("doc_id", "n_tokens", "used", "rank")


# clusters and the map


@query("cluster_stats", f"WITH {_POINTS} SELECT cluster, count(*) AS n_points, round(count(*) * 100 / (SELECT count(*)::DOUBLE FROM p), 1) AS percent FROM p GROUP BY cluster")
def cluster_stats(spark, sf_dir):
    return clusters.cluster_stats(_points(spark, sf_dir)).drop("mean_probability")


@query("map_stats", f"WITH {_POINTS} SELECT count(DISTINCT cluster) FILTER (cluster <> -1) AS n_clusters, count(*) FILTER (cluster = -1) AS noise_points, count(*) AS total_points FROM p")
def map_stats(spark, sf_dir):
    return clusters.map_stats(_points(spark, sf_dir))


@query("ctfidf_keywords", f"""WITH {_CLUSTERED}, t AS (SELECT cluster, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM p WHERE cluster <> -1),
c AS (SELECT cluster, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(DISTINCT cluster) AS n FROM c),
g AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY term),
f AS (SELECT cluster, term, tf, total FROM c JOIN g USING (term), n WHERE df >= greatest(1, least(8, floor(log2(n)))) AND df <= n * CASE WHEN n < 3 THEN 1 ELSE greatest(0.6, 1 - log2(n) / (log2(n) + 5)) END),
a AS (SELECT greatest(1, floor(avg(s))) AS a FROM (SELECT sum(tf) AS s FROM f GROUP BY cluster)),
w AS (SELECT cluster, term, tf * ln(a / total) AS w FROM f, a), z AS (SELECT cluster, sum(abs(w)) AS z FROM w GROUP BY cluster),
s AS (SELECT cluster, term AS keyword, w / z AS score, (row_number() OVER (PARTITION BY cluster ORDER BY round(w / z, 12) DESC, term))::INT AS rank FROM w JOIN z USING (cluster))
SELECT cluster, rank, keyword, round(score, 9) AS score FROM s WHERE rank <= 10 AND score > 0""")
def ctfidf_keywords(spark, sf_dir):
    return clusters.ctfidf_keywords(_clustered(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query("cluster_top_words", f"""WITH {_CLUSTERED}, t AS (SELECT cluster, unnest(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+')) AS word FROM p WHERE cluster <> -1),
c AS (SELECT cluster, word, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, word) AS rank FROM t WHERE length(word) > 3 GROUP BY cluster, word)
SELECT cluster, string_agg(word, ', ' ORDER BY rank) AS label FROM c WHERE rank <= 3 GROUP BY cluster""")
def cluster_top_words(spark, sf_dir):
    return clusters.cluster_top_words(_clustered(spark, sf_dir))


@query("centroids", f"WITH {_POINTS} SELECT cluster, round(avg(x), 9) AS x, round(avg(y), 9) AS y, count(*) AS n_points FROM p GROUP BY cluster")
def centroids(spark, sf_dir):
    return spatial.centroids(_points(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("x", "y")})


@query("map_center", f"WITH {_POINTS} SELECT round(avg(x), 9) AS x, round(avg(y), 9) AS y FROM p")
def map_center(spark, sf_dir):
    return spatial.map_center(_points(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("x", "y")})


@query("bounds", f"WITH {_POINTS} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, (min(x) + max(x)) / 2 AS center_x, (min(y) + max(y)) / 2 AS center_y, CASE WHEN max(x) = min(x) THEN 100 ELSE greatest(60, (max(x) - min(x)) * 1.2::DOUBLE) END::DOUBLE AS padded_x, CASE WHEN max(y) = min(y) THEN 100 ELSE greatest(60, (max(y) - min(y)) * 1.2::DOUBLE) END::DOUBLE AS padded_y FROM p")
def bounds(spark, sf_dir):
    return spatial.bounds(_points(spark, sf_dir))


@query("grid_cells", f"WITH {_POINTS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p) SELECT least(127, floor((x - x0) / (x1 - x0) * 128))::INT AS cell_x, least(127, floor((y - y0) / (y1 - y0) * 128))::INT AS cell_y, count(*) AS n_points FROM p, b GROUP BY ALL")
def grid_cells(spark, sf_dir):
    return spatial.grid_cells(_points(spark, sf_dir))


@query("normalize_projection", f"WITH {_POINTS} SELECT doc_id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 9) AS x, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()), 9) AS y FROM p")
def normalize_projection(spark, sf_dir):
    return spatial.normalize(_points(spark, sf_dir)).select("doc_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("projection_stats", """WITH v AS (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings), f AS (SELECT v, CASE WHEN isfinite(v) THEN v END AS f FROM v)
SELECT round(avg(f), 9) AS mean, round(stddev_pop(f), 9) AS std, min(f) AS min, max(f) AS max, count(*) FILTER (isnan(v)) AS n_nan, count(*) FILTER (isinf(v)) AS n_infinite, count(*) FILTER (abs(f) > 1e6) AS n_extreme,
  CASE WHEN stddev_pop(f) < 0.1 THEN 'collapsed' WHEN stddev_pop(f) < 1 THEN 'low' ELSE 'normal' END AS spread FROM f""")
def projection_stats(spark, sf_dir):
    return spatial.projection_stats(_table(spark, sf_dir, "embeddings")).withColumns({c: F.round(c, 9) for c in ("mean", "std")})


def _polygon_sql() -> str:
    edges = []
    for (x1, y1), (x2, y2) in zip((POLYGON[-1], *POLYGON[:-1]), POLYGON, strict=True):
        if y1 != y2:
            edges.append(f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < ({x2 - x1}) * (y - ({y1})) / ({y2 - y1}) + ({x1}) THEN 1 ELSE 0 END")
    return f"({' + '.join(edges)}) % 2 = 1"


@query("lasso", f"WITH {_POINTS} SELECT doc_id FROM p WHERE {_polygon_sql()}")
def lasso(spark, sf_dir):
    return spatial.lasso(_points(spark, sf_dir), POLYGON).select("doc_id")


@query("pick_radius", f"WITH {_POINTS} SELECT doc_id, round(sqrt((x - 0.05) ** 2 + (y - 0.05) ** 2), 9) AS distance FROM p WHERE sqrt((x - 0.05) ** 2 + (y - 0.05) ** 2) < 0.2 ORDER BY sqrt((x - 0.05) ** 2 + (y - 0.05) ** 2), doc_id LIMIT 1")
def pick_radius(spark, sf_dir):
    return spatial.pick_radius(_points(spark, sf_dir), (0.05, 0.05), 0.2).select("doc_id", F.round("distance", 9).alias("distance"))


@query("cluster_labels", f"WITH {_POINTS} SELECT doc_id, CASE WHEN cluster = -1 THEN 'Noise' ELSE 'Cluster ' || cluster END AS label FROM p")
def cluster_labels(spark, sf_dir):
    return _points(spark, sf_dir).select("doc_id", T.cluster_label(F.col("cluster")).alias("label"))


# export and logs


@query("export_semi", f"WITH {_CHUNKS} SELECT chunk_id, parent_id FROM chunks WHERE parent_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def export_semi(spark, sf_dir):
    ids = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return filters.in_scope(prepare.chunk(_docs(spark, sf_dir)), ids, "parent_id").select("chunk_id", "parent_id")


@query("turn_order", "SELECT conv_id, count(*) AS n_turns, string_agg(role, '|' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def turn_order(spark, sf_dir):
    return rag.turns(_table(spark, sf_dir, "conversations"))


@query("events_json_props", "SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k_total FROM events GROUP BY event_type")
def events_json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_total"))


_LONG = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: length(w) > 3)"
_HEAD = "CASE WHEN len(w) > 64 THEN array_to_string(w[1:64], ' ') || '...' ELSE array_to_string(w, ' ') END"


@query("text_similarity", f"""WITH d AS (SELECT doc_id, text, {_SPACED.format('text')} AS w FROM documents),
s AS (SELECT doc_id, {_LONG.format('text')} AS x, {_LONG.format(_HEAD)} AS y FROM d)
SELECT doc_id, round(CASE WHEN least(len(x), len(y)) > 0 THEN len(list_filter(x, lambda a: list_contains(y, a))) / least(len(x), len(y)) ELSE 0 END, 6) AS score FROM s""")
def text_similarity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(T.similarity(F.col("text"), T.summary(F.col("text"), 64)), 6).alias("score"))
