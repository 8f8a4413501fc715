"""Saved indexes equal searches over the texts; streams give the same index in whatever order documents come."""

import itertools

import pytest
from pyspark.sql import functions as F

from quarry.operators import index, lexical
from quarry.streaming import ingest

DATA = "/root/testdata/sf0.001"
DOCS = [(1, "Same text"), (2, "same text"), (3, " Same text "), (4, None), (5, ""), (6, "the only one of the words"), (7, "only only"), (8, "only the rest")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def scores(hits):
    return [(r["doc_id"], round(r["score"], 9)) for r in hits.collect()]


def test_postings_search_equals_a_scan(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    root = (tmp_path / "postings").as_uri()
    index.save_postings(docs, root, part_rows=8)
    for query, k, first in (("only rely antion", 10, 1), ("the", 5, 2), ("the only the", 200, 1), ("erin nowhere", 3, 1), ("nowhere", 3, 1), ("", 3, 1)):
        assert scores(index.search(spark, root, query, k, first_parts=first)) == scores(lexical.bm25_topk(docs, query, k)), query


def test_postings_of_odd_texts(spark, tmp_path):
    docs, root = spark.createDataFrame(DOCS, "doc_id long, text string"), (tmp_path / "odd").as_uri()
    index.save_postings(docs, root, part_rows=2)
    for query in ("only", "same the"):
        assert scores(index.search(spark, root, query)) == scores(lexical.bm25_topk(docs, query))
    plan = spark.read.parquet(f"{root}/postings").filter(F.col("term").isin(["only"]))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [only])]" in plan or "EqualTo(term,only)" in plan
    index.save_postings(docs.limit(0), (tmp_path / "none").as_uri())
    assert index.search(spark, (tmp_path / "none").as_uri(), "only").collect() == []


def test_postings_count_the_tokens_of_a_text_once(spark):
    docs = spark.createDataFrame([(1, "b a b", "x"), (2, None, "y")], "doc_id long, text string, lang string")
    words = index._words(docs, "doc_id", "text", 1)
    assert rows(words) == [(1, 0, 3, "a"), (1, 0, 3, "b"), (1, 0, 3, "b")]
    above, below = words._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)
    assert "regexp" not in above and "regexp" in below  # above it, a text is walked again for each of its tokens


def test_word_index_equals_a_scan(spark, tmp_path):
    docs, root = spark.read.parquet(f"{DATA}/documents.parquet"), (tmp_path / "words").as_uri()
    index.save_words(docs, root)
    dictionary = lexical.dictionary(docs)
    for query in ("erin only", "onyl", "x", "thing's the"):
        assert rows(index.matching_words(spark, root, query)) == rows(lexical.word_matches(dictionary, query))
        assert index.fast_search(spark, root, query).collect() == lexical.fast_search(docs, query, 20).collect(), query


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_order_of_arrival_changes_nothing(spark, tmp_path, order):
    docs = spark.createDataFrame([(*d, "ab"[d[0] % 2]) for d in DOCS] + [(None, "Same text", "n"), (None, "lone", "n")], "doc_id long, text string, lang string")
    parts = [docs.filter(f"doc_id % 3 = {k}" + (" OR doc_id IS NULL" if k == 0 else "")) for k in range(3)]
    root, arriving = tmp_path / "index", (tmp_path / "in").as_uri()
    for k in order:  # each a run of its own, which goes on from where the last one ended
        parts[k].coalesce(1).write.mode("append").parquet(arriving)
        ingest.ingest_documents(ingest.files(spark, arriving, docs.schema), root.as_uri(), (root / "checkpoint").as_uri())
    got = {(r["doc_id"], r["lang"], r["n_tokens"], r["n_copies"]) for r in ingest.documents(spark, root.as_uri()).collect()}
    assert got == {(1, "b", 2, 3), (2, "a", 2, 1), (4, "a", 0, 2), (6, "a", 6, 1), (7, "b", 2, 1), (8, "a", 3, 1), (None, "n", 1, 1)}
    assert rows(ingest.postings(spark, root.as_uri()).filter("term = 'only'")) == [(6, "only", 1), (7, "only", 2), (8, "only", 1)]
    stats = ingest.statistics(spark, root.as_uri()).first()
    assert (stats["n_docs"], stats["n_tokens"], round(stats["avg_tokens"], 6)) == (7, 16, round(16 / 7, 6))


def test_files_of_a_stream_are_bounded_and_batches_few(spark, monkeypatch):
    from quarry.plans import source_queries

    made = []
    monkeypatch.setattr(source_queries.ingest, "files", lambda spark, folder, schema, pattern, at_once: made.append((folder, at_once)))
    monkeypatch.setattr(source_queries.ingest, "ingest_documents", lambda *_: None)
    size = spark.read.parquet(f"{DATA}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    for file_bytes, at_once in ((1 << 30, 1), (size // 30, 11), (size // 3 + 1, 1)):
        source_queries._streamed(spark, DATA, file_bytes)
        assert made[-1][1] == at_once
        back = spark.read.parquet(made[-1][0])
        assert back.count() == 200 and back.select(F.input_file_name()).distinct().count() == 3 * at_once


def test_descent_finds_most_neighbours_without_all_pairs(spark):
    from quarry.operators import neighbours, similarity

    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    exact = similarity.knn(vectors, None, 10).select("query_id", "neighbour_id", F.round("score", 9).alias("score"))
    found = neighbours.knn_descent(vectors, 10, block=64, trees=2)
    assert found.count() == exact.count() and found.join(exact, ["query_id", "neighbour_id"]).count() >= 0.95 * exact.count()
    assert found.join(exact, ["query_id", "neighbour_id"]).filter(F.abs(found["score"] - exact["score"]) > 1e-8).isEmpty()
    rows = [(k, [float(k % 3), 1.0]) for k in range(40)] + [(None, [1.0, 1.0]), (99, None)]
    few = neighbours.knn_descent(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, "euclidean", block=8).collect()
    assert len(few) == 200 and all(r["score"] == 0 for r in few)
    assert neighbours.knn_descent(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), 5).collect() == []
