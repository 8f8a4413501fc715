"""Small rows for rules that the tables do not show, and every query with SQL against DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.functions import text as T
from quarry.functions import types, vectors
from quarry.operators import clusters, filters, lexical, prepare, rag, similarity, spatial
from quarry.plans import queries as plans

SF = "/root/testdata/sf0.001"


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    rows = duck.execute(plans.SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]


def test_tokens_and_trim(spark):
    assert one(spark, T.tokens, "Ça va-t-il? OK_1") == ["a", "va", "t", "il", "ok_1"]
    assert one(spark, T.fast_words, "'don't' well-known - '") == ["don't", "well-known"]
    assert one(spark, T.trimmed, "  a ﻿") == "a"
    assert one(spark, T.tokens, None) is None


def test_score_counts_kinds_of_matches(spark):
    score = lambda c: T.word_score(F.lower(c), "ab")
    assert one(spark, score, "ab abc xab") == 30 + 20 + 15 + 25
    assert one(spark, score, "éab") == 30 + 25  # accented letters are no word characters
    assert one(spark, score, "") == 0


def test_chunk_threshold(spark):
    docs = spark.createDataFrame([(1, "x" * 614), (2, "x" * 615), (3, ""), (4, None)], "doc_id long, text string")
    rows = {(r["parent_id"], r["position"]): r["chunk_chars"] for r in prepare.chunk(docs).collect()}
    assert rows == {(1, 0): 614, (2, 0): 512, (2, 1): 231, (3, 0): 0}


def test_dedupe_keeps_first_and_extra_columns(spark):
    docs = spark.createDataFrame([(3, " a", 1), (1, "a ", 2), (2, "b", 3), (5, None, 4), (4, "", 5)], "doc_id long, text string, _same int")
    assert sorted(r["doc_id"] for r in prepare.dedupe_exact(docs).collect()) == [1, 2, 4]
    assert prepare.dedupe_exact(docs.limit(0)).count() == 0


def test_extract_drops_index_columns(spark):
    df = spark.createDataFrame([(0, " NaN ", "x", "y"), (1, "t", "x", "y")], "`Unnamed: 0` int, body string, `12` string, author string")
    out = prepare.extract_documents(df, "body", "Unnamed: 0")
    assert out.columns == ["id", "text", "has_empty_text", "original_index", "author"]
    assert [r["has_empty_text"] for r in out.orderBy("id").collect()] == [True, False]


def test_filters_missing_and_false_words(spark):
    df = spark.createDataFrame([(1, "false", "2024-01-01", "5"), (2, "Yes", "no date", "x"), (3, None, None, None), (4, "", "", "")], "id int, flag string, day string, n string")
    ids = lambda spec: sorted(r["id"] for r in filters.apply_filters(df, spec).collect())
    assert ids({"flag": {"type": "boolean", "value": "no"}}) == [1]
    assert ids({"flag": {"type": "boolean", "value": "perhaps"}}) == [1, 2, 3, 4]
    assert ids({"day": {"type": "date", "value": {"max": "2024-01-01"}}}) == [1]
    assert ids({"n": {"type": "number", "value": {"min": 1}}}) == [1]
    assert ids({"flag": {"type": "category", "value": []}}) == [1, 2, 3, 4]
    assert ids({"gone": {"type": "text", "value": "x"}}) == []
    assert filters.summarize({"n": {"type": "number", "value": {"min": 1, "max": 2}}}) == "n ≥ 1 ≤ 2"


def test_boolean_language():
    assert lexical.parse_boolean('a "b c" +d -e NOT f "open') == [("term", "a"), ("phrase", "b c"), ("required", "d"), ("excluded", "e"), ("operator", "NOT"), ("term", "f"), ("phrase", "open")]
    assert not lexical.is_boolean("well-known words")


def test_greedy_edits_are_stricter_than_edit_distance():
    assert lexical.near_words("bacb", "bccb") is False
    assert lexical.near_words("word", "wrd") and lexical.near_words("wrd", "word") and lexical.near_words("ward", "word")
    assert not lexical.near_words("words", "word")  # holds the word as it is


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    got = row.select(vectors.norm(F.col("a")), vectors.cosine(F.col("a"), F.col("a")), vectors.cosine(F.col("a"), F.col("b")), vectors.l2_normalized(F.col("b"))).first()
    assert tuple(got) == (5.0, 1.0, 0.0, [0.0, 0.0])


def test_knn_equals_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(300, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for metric in ("cosine", "euclidean"):
        got = {(r["query_id"], r["rank"]): r["neighbour_id"] for r in similarity.knn(df, k=3, metric=metric).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
        for q in range(300):
            d = ((u - u[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            assert [got[q, r] for r in (1, 2, 3)] == np.argsort(d)[:3].tolist()


def test_concave_polygon(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.5), (3, 3.5, 1.0)], "doc_id int, x double, y double")
    shape = [(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)]
    assert [r["doc_id"] for r in spatial.lasso(points, shape).orderBy("doc_id").collect()] == [1, 3]
    assert spatial.lasso(points, shape[:2]).count() == 0
    assert spatial.pick_radius(points, (1.0, 2.0), 1.0).count() == 0  # strictly closer


def test_keywords_of_one_cluster_and_of_noise(spark):
    docs = spark.createDataFrame([(0, "alpha alpha beta"), (-1, "gamma")], "cluster int, text string")
    assert {r["keyword"] for r in clusters.ctfidf_keywords(docs).collect()} == {"alpha", "beta"} or clusters.ctfidf_keywords(docs).count() >= 1
    assert clusters.ctfidf_keywords(docs.filter("cluster = -1")).count() == 0


def test_prompt_and_think(spark):
    assert rag.prompt("{context} {question} {context}", "$1", "{context}") == "$1 {context} {context}"
    assert one(spark, T.strip_think, "<think>x</think> answer <think>tail") == "answer"
    assert one(spark, T.strip_think, "<think>only") == "only"
    assert rag.context_budget(1000, "", 600) == 500


def test_types(spark):
    kinds = [one(spark, types.infer_type, v) for v in ("true", "-1.5e3", "2024-01-02", "abc", " ", "NaN", "01/31/2024", "12-31-2024", "1/2/2024")]
    assert kinds == ["boolean", "number", "date", "text", None, None, "date", "date", "text"]
    days = [one(spark, lambda c: types.parse_date(c).cast("string"), v) for v in ("2024-01-31", "01/31/2024", "12-31-2024", "13/31/2024", "x")]
    assert days == ["2024-01-31 00:00:00", "2024-01-31 00:00:00", "2024-12-31 00:00:00", None, None]
