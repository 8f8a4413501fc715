"""Rules that the tables do not show: points by their text, exports, contexts, answers, streams of tokens, density, layout, settings."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.engine import Engine
from quarry.functions import text as T
from quarry.operators import embedding, layout, lexical, points, prepare, rag, similarity
from quarry.sources import datasets, exports

HIT = "hit_id long, index long, x double, y double, chunk_id string, parent_id string, doc_id string, source_id string, text string"
POINT = "index long, x double, y double, chunk_id string, doc_id string, source_id string, text string"


def test_points_are_resolved_by_the_first_rule_that_finds_one(spark):
    long = "the quick brown foxes jumped over several lazy dogs yesterday evening"
    rows = [(0, 0.0, 0.0, "c0", "d0", "s0", "first"), (1, 1.0, 1.0, "c1", "d1", "s1", f"Before {long} after"), (2, 2.0, 2.0, "c1", "d2", "s2", "alpha bravo charlie delta echoes foxtrot"), (3, 1.0, 1.0, None, "d1", None, " FIRST ")]
    none = (None,) * 8
    hits = [
        (1, 2, *none[:7]),
        (2, None, 1.0 + 5e-7, 1.0, *none[:5]),
        (3, None, None, None, "c1", *none[:4]),
        (4, None, None, None, "absent", "d1", *none[:3]),
        (5, None, None, None, None, None, "d2", None, None),
        (6, None, None, None, None, None, None, "s1", None),
        (7, *none[:7], "First  ".strip()),
        (8, *none[:7], long.upper()),
        (9, *none[:7], "bravo alpha charlie delta echoes foxtrot"),
        (10, *none[:7], "nothing of the kind stands anywhere"),
        (11, 99, 1.0, 1.0, *none[:5]),
    ]
    got = {r["hit_id"]: (r["index"], r["rule"]) for r in points.resolve_points(spark.createDataFrame(hits, HIT), spark.createDataFrame(rows, POINT)).collect()}
    assert got == {1: (2, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (2, 4), 6: (1, 5), 7: (0, 6), 8: (1, 7), 9: (2, 8), 11: (1, 1)}


def test_near_word_equals_the_walk(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for q in ("abc", "bccb", "aabbc", "cab"):
        got = {r["w"] for r in df.filter(lexical.near_word(F.col("w"), q)).collect()}
        assert got == {w for w in words if lexical.near_words(w, q)}


def test_exact_duplicates_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a ", "y"), (2, "b", "z"), (None, "c", "u"), (None, None, "v"), (3, "b", "w"), (3, "b", "w")], "doc_id long, text string, tag string")
    assert {(r["doc_id"], r["text"], r["tag"]) for r in prepare.dedupe_exact(docs).collect()} == {(1, "a", "x"), (2, "b", "z"), (None, "c", "u"), (None, None, "v")}
    assert prepare.dedupe_exact(docs.limit(0)).count() == 0


def test_windows_of_long_and_wide_texts(spark):
    for text in ("é" * 1000, "x" * 614, "𝔘" * 700 + "tail", ""):
        got = spark.createDataFrame([(text,)], "t string").select(T.windows(F.col("t")).alias("w")).first()["w"]
        if len(text) <= 614:
            want = [text]
        else:
            want = [text[i * 384 : i * 384 + 512] for i in range(-(-(len(text) - 128) // 384))]
        assert [w["text"] for w in got] == want


def test_bm25_counts_a_texts_tokens_once_for_statistics_and_once_for_hits(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    plan = lexical.bm25_topk(docs, "a b c")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" [A-Za-z0-9_]+, 0)") == 2 and "regexp_replace" not in plan and "split(" not in plan


def test_points_are_found_without_a_count_of_words_if_no_hit_is_left(spark, monkeypatch):
    def never(*_):
        raise AssertionError("no hit asks for words")

    monkeypatch.setattr(points, "_alike_texts", never)
    from quarry.plans import map_queries

    found = map_queries.resolve_point(spark, "/root/testdata/sf0.001")
    assert found.filter("rule <= 6").count() == found.count() == 200
    assert found._jdf.queryExecution().optimizedPlan().toString().count("documents.parquet") == 0  # texts are joined once, in a table of their own


def test_a_word_that_is_late_in_a_texts_order_brings_no_candidates(spark):
    rows = [(k, "aaaaa " + " ".join(f"own{k}x{i}" for i in range(4))) for k in range(30)] + [(k, "bbbbb ccccc ddddd eeeee zzzzz") for k in range(30, 70)]
    left = spark.createDataFrame([(1, "aaaaa bbbbb ccccc ddddd eeeee")], "hit_id long, _a string")
    got = points._alike_texts(left, spark.createDataFrame(rows, "index long, text string"), "hit_id")
    assert sorted(r["index"] for r in got.collect()) == list(range(30, 70))


def test_an_exports_chunk_map_names_the_passages_that_were_written(spark, tmp_path):
    import uuid

    import pyarrow as pa

    def named(batches):  # other ids each time that passages are made
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex for _ in range(b.num_rows)]), b.column(0)], names=["chunk_id", "parent_id"])

    docs = spark.range(5).selectExpr("cast(id AS string) AS doc_id", "'t' AS text", "1 AS cluster", "0.5D AS cluster_probability", "0.0D AS x", "1.0D AS y")
    chunks = docs.select("doc_id").mapInArrow(named, "chunk_id string, parent_id string").selectExpr("*", "0 AS position", "'c' AS text", "array(1.0F) AS vector")
    exports.export_v3(docs, docs.selectExpr("doc_id", "array(1.0F) AS vector"), chunks, f"{tmp_path}/out")
    ids = lambda name: sorted((r["chunk_id"], r["doc_id"]) for r in spark.read.schema("chunk_id string, doc_id string").json(f"{tmp_path}/out/{name}").collect())
    assert len(ids("chunks")) == 5 and ids("chunk_map") == ids("chunks")


def test_selections_of_any_size_are_nested_documents(spark, tmp_path):
    docs = spark.range(300).selectExpr("cast(id AS string) AS doc_id", "concat('t', id) AS text", "1 AS cluster", "0.5D AS cluster_probability", "0.0D AS x", "1.0D AS y")
    docs = docs.union(docs.limit(1).selectExpr("cast(NULL AS string)", "'none'", "cluster", "cluster_probability", "x", "y"))
    vectors = spark.range(0, 300, 2).selectExpr("cast(id AS string) AS doc_id", "array(cast(id AS float)) AS vector")
    chunks = vectors.selectExpr("concat(doc_id, '_chunk_0') AS chunk_id", "doc_id AS parent_id", "0 AS position", "'c' AS text", "vector")
    for name, some, rows in (("many", docs, 40), ("none", docs.limit(0), 40)):
        exports.write_documents(some, vectors, chunks, f"{tmp_path}/{name}", rows=rows)
        back = exports.import_v3(spark, f"{tmp_path}/{name}")
        held = some.count()
        assert sorted(tuple(r) for r in back["documents"].fillna("null").select("id", "text").collect()) == sorted(tuple(r) for r in some.fillna("null").select("doc_id", "text").collect())
        assert back["parents"].count() == back["chunks"].distinct().count() == back["chunks"].count() == held // 2
    assert 15 <= len(list((tmp_path / "many").glob("part-*.txt"))) <= 17


def test_exports_refuse_what_they_cannot_hold(spark, tmp_path):
    docs = spark.createDataFrame([("a", "t", 1, 0.5, 0.0, 1.0)], "doc_id string, text string, cluster int, cluster_probability double, x double, y double")
    vectors = spark.createDataFrame([("a", [1.0])], "doc_id string, vector array<float>")
    chunks = spark.createDataFrame([], "chunk_id string, parent_id string, position int, text string, vector array<float>")
    with pytest.raises(ValueError, match="export_v3"):
        exports.as_document(docs, vectors, chunks, rows=0)
    with pytest.raises(ValueError, match="export type"):
        exports.as_document(docs, vectors, chunks, kind="none")
    (tmp_path / "old.json").write_text(json.dumps({"version": "2.0", "documents": []}))
    with pytest.raises(ValueError, match="version"):
        exports.import_v3(spark, str(tmp_path / "old.json"))
    (tmp_path / "none.json").write_text(json.dumps({"version": "3.0"}))
    with pytest.raises(ValueError, match="no documents"):
        exports.import_v3(spark, str(tmp_path / "none.json"))
    (tmp_path / "bare.json").write_text(json.dumps({"version": "3.0", "documents": [{"id": "q", "text": "t"}]}))
    row = exports.import_v3(spark, str(tmp_path / "bare.json"))["documents"].first()
    assert (row["cluster"], row["x"], row["y"]) == (-1, 0.0, 0.0)


def test_vectors_as_base64(spark):
    x = np.array([0.0, -0.0, 1.0, -1.5, 3.1415927, 1e-40, 65504.25, -1.1754944e-38], dtype=np.float32)
    import base64

    row = spark.createDataFrame([(x.tolist(),)], "v array<float>").select(exports.encode_vector(F.col("v")).alias("p"))
    assert base64.b64decode(row.first()["p"]) == x.tobytes()
    back = row.select(exports.decode_vector(F.col("p")).alias("v")).first()["v"]
    assert np.array(back, dtype=np.float32).tolist() == x.tolist()


def test_settings_and_datasets_do_not_mix(spark, tmp_path):
    root, one = str(tmp_path), spark.range(2)
    assert datasets.load_value(spark, root, "session") is None
    datasets.save_value(spark, root, "session", "1")
    datasets.save(spark, root, "a", {"documents": one, "embeddings": one})
    datasets.clear(spark, root)
    assert datasets.catalog(spark, root).count() == 0 and datasets.load_value(spark, root, "session") == "1"


def test_thoughts_are_left_out_of_streams():
    text = "a<think>b</think>c<think>d<e</think>f<th"
    for size in range(1, 9):
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
        assert "".join(rag.without_thoughts(pieces)) == "acf<th"
    assert "".join(rag.without_thoughts(["a<think>never closed"])) == "a"


def test_passages_end_at_the_first_that_does_not_fit(spark):
    chunk = lambda k, text: (k, f"c{k}", text, 1.0)
    rows = [("p1", 3.0, [chunk(0, "one " * 10), chunk(1, "long " * 60), chunk(2, "tiny")]), ("p2", 2.0, [chunk(0, "two")]), ("p3", 1.0, [chunk(0, "word " * 100)])]
    groups = spark.createDataFrame(rows, "parent_id string, max_score double, chunks array<struct<position:int,chunk_id:string,text:string,score:double>>")
    got = rag.passages_in_budget(groups, 100).first()
    assert got["limited"] and got["tokens_used"] < 100
    assert "one one" in got["context"] and "long" not in got["context"] and "tiny" not in got["context"]
    assert "[Document 2]" in got["context"] and "» two" in got["context"]
    assert got["context"].count("» word") == 3  # cut into pieces of 15 tokens
    joined = rag.join_parent(groups, spark.createDataFrame([("p1", "whole"), ("p2", "")], "parent_id string, text string"))
    assert {r["parent_id"]: r["text"] for r in joined.collect()}["p2"] == "two"


def test_answers_and_their_log(spark, tmp_path):
    rows = [("p1", 3.0, [(0, "c0", "Paris is the capital. More.", 1.0)])]
    groups = spark.createDataFrame(rows, "parent_id string, max_score double, chunks array<struct<position:int,chunk_id:string,text:string,score:double>>")
    model = rag.Extract()
    said = rag.answer("capital?", groups, model, "{context}\nQ: {question}")
    assert said.text == "Paris is the capital." and not said.limited
    rag.log_answer(str(tmp_path / "log"), "capital?", said, model, 0.5)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.first()["sources"] == ["p1"]
    datasets.write_conversation_json(log, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/summary")).first()["total_queries"] == 1
    assert rag.hypothesis("why?", model) == "why?"
    assert rag.clamped(rag.ModelLimits(max_tokens=(1, 100), thinks=True), 9.0, 50) == (2.0, 100)
    assert (rag.semantic_k(20), rag.semantic_k(7)) == (20, 10)


def test_scoped_questions_fall_back_to_documents(spark):
    docs = spark.createDataFrame([("a", "apples and pears"), ("b", "cars and boats")], "parent_id string, text string")
    chunks = docs.select(F.concat("parent_id", F.lit("0")).alias("chunk_id"), "parent_id", F.lit(0).alias("position"), "text")
    whole = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "parent_id string, embedding array<float>")
    far = chunks.select("chunk_id", "parent_id", F.array(F.lit(-1.0), F.lit(-1.0)).alias("embedding"))
    got = rag.retrieve_grouped(chunks, far, docs, whole, "zebra", [0.0, 1.0], scope=F.col("parent_id") == "b").collect()
    assert [(r["parent_id"], r["text"]) for r in got] == [("b", "cars and boats")]


def test_config_and_engine(spark):
    heard, config = [], Config({"search": {"num_results": 3}, "own": 1})
    config.observers.append(lambda path, value: heard.append((path, value)))
    config.set("search.vector_weight", 0.5)
    assert (config.get("search.num_results"), config.get("search.retrieval_k"), config.get("own"), config.get("no.such")) == (3, 60, 1, None)
    assert heard == [("search.vector_weight", 0.5)]
    engine = Engine(spark, config)
    table = spark.createDataFrame([(0, "Apples are red. Yes.", "x"), (1, "apples are red. Yes.", "y"), (2, " nan ", "x"), (3, "Apples are red. Yes.", "z"), (4, "Cars are fast", "y")], "n long, body string, kind string")
    docs = engine.process(table, "body", "n")
    assert docs.count() == 3
    model = lambda: embedding.HashingEmbedder(16)
    engine.tables |= {"embeddings": embedding.embed(docs.select("doc_id", "text"), model), "chunk_embeddings": embedding.embed(engine.tables["chunks"].select("chunk_id", "parent_id", "text"), model)}
    assert engine.set_filters({"kind": {"type": "category", "value": ["y"]}}) == "kind: y"
    assert {r["doc_id"] for r in engine.search("apples").collect()} == {"doc_1"}
    assert {r["doc_id"] for r in engine.search("+are -fast").collect()} == {"doc_1"}
    vector = embedding.HashingEmbedder(16).embed(["passage: Cars are fast"])[0].tolist()
    assert engine.search("", "semantic", 5, vector).first()["doc_id"] == "doc_4"
    said = engine.query("Which cars are fast?", vector, rag.Extract(), "{context}\n{question}")
    assert said.text.startswith("Cars are fast")


def test_blank_texts_have_zero_vectors(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, " a  b "), (3, "  "), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["embedding"] for r in embedding.embed(docs, lambda: embedding.HashingEmbedder(8)).collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1)
    assert got[3] == got[4] == [0.0] * 8


def test_knn_over_several_parts_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ROW_BLOCK", 16)
    x = np.random.default_rng(3).normal(size=(90, 5)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    for metric in ("cosine", "euclidean"):
        y = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True)) if metric == "cosine" else x.astype(float)
        near = y @ y.T if metric == "cosine" else -np.sqrt(np.maximum(0, ((y[:, None] - y[None]) ** 2).sum(-1)))
        np.fill_diagonal(near, -np.inf)
        got = {(r["query_id"], r["rank"]): r["neighbour_id"] for r in similarity.knn(df, None, 4, metric).collect()}
        assert got == {(q, r + 1): int(j) for q in range(90) for r, j in enumerate(np.argsort(-near[q], kind="stable")[:4])}


def blobs(n=40):
    rng = np.random.default_rng(2)
    centres = np.array([[0.0, 0, 0], [20, 0, 0], [0, 20, 0]])
    x = np.concatenate([c + rng.normal(size=(n, 3)) for c in centres] + [np.array([[200.0, 200, 200], [-150, 90, 0]])])
    return x, np.repeat(np.arange(3), n)


def test_layout_keeps_neighbourhoods_and_is_the_same_twice(spark):
    x, truth = blobs(25)
    x = x[:75]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    run = lambda: {r["vec_id"]: r["coords"] for r in layout.layout(df, neighbours=6, epochs=5, metric="euclidean").collect()}
    first = run()
    y = np.array([first[k] for k in range(75)])
    assert np.isfinite(y).all() and y.shape == (75, 2)
    near = np.argsort(((y[:, None] - y[None]) ** 2).sum(-1), axis=1)[:, 1:6]
    assert (truth[near] == truth[:75, None]).mean() > 0.95
    again = run()
    assert all(np.allclose(first[k], again[k]) for k in first)
    with pytest.raises(ValueError, match="of one length"):
        layout.components(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>"), 2)
    mean, axes = layout.components(df, 2)
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.abs(axes.T @ v[:2].T), np.eye(2), atol=1e-6)


def test_layout_keeps_more_neighbours_than_principal_components(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], dtype=np.float64)

    def near(y, k=15):
        d = ((y[:, None] - y[None]) ** 2).sum(-1)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, axis=1)[:, :k]

    def kept(frame):
        y = np.array([r["coords"] for r in frame.orderBy("vec_id").collect()])
        return np.mean([len(set(a) & set(b)) for a, b in zip(near(x), near(y), strict=True)]) / 15

    assert kept(layout.layout(df, epochs=12)) > 1.3 * kept(layout.project(df))
    assert np.allclose(layout.curve(0.1), (1.577, 0.895), atol=0.01) and np.allclose(layout.curve(0.0), (1.933, 0.790), atol=0.01)
