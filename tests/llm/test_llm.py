"""The corpus operators against brute force, library results and SQL, on small rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, components, contamination, language, near_text, passages, queries, suffixes, vectors, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert got == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in rows.fetchall())


def test_repeats_equal_brute_force(spark):
    rng = random.Random(5)
    piece = lambda n: "".join(rng.choice("abé d") for _ in range(n))
    shared = [piece(n) for n in (380, 420, 700, 1500)]
    texts = [None, "", "x" * 300, "z" * 5000, shared[2] * 2]
    for _ in range(40):
        t = piece(rng.randrange(600))
        for _ in range(rng.randrange(3)):
            q = rng.choice(shared)
            t += q[rng.randrange(60) : len(q) - rng.randrange(60)] + piece(rng.randrange(200))
        texts.append(t)
    texts += texts[5:8]
    data, n = [(t or "").encode() for t in texts], suffixes.LENGTH
    times = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    rows = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    for r in rows:
        b = data[r["id"]]
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if times[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        assert r["n_removed"] == sum(gone)
        assert bytes(r["kept"]) == bytes(x for x, y in zip(b, gone, strict=True) if not y)
    assert len(rows) == len(texts)


def test_pipeline_cuts_passages_of_over_50_words(spark):
    rng = random.Random(11)
    piece = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))) for _ in range(n))
    shared = [piece(51), "x " * 50 + "x", piece(70), piece(45), piece(30), piece(200), " ".join("".join(rng.choice("abcdefgh") for _ in range(25)) for _ in range(20))]
    assert len(shared[0]) < 230
    texts = [f"{piece(rng.randrange(5, 60))} {q} {piece(rng.randrange(5, 60))}" for q in shared for _ in range(2)] + [piece(300), shared[5], shared[5], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("n_chars", F.length("text").cast("long"))
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    n, data = corpus_pipeline.PASSAGE_BYTES, [t or "" for t in texts]
    times = Counter(t[i : i + n] for t in data for i in range(len(t) - n + 1))
    for k, t in enumerate(data):
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if times[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        want, at = "", 0
        for dropped, run in itertools.groupby(gone):
            size = len(list(run))
            whole = sum(gone[m.start()] and at <= m.start() and m.end() <= at + size for m in re.finditer(r"\S+", t))
            want += "" if dropped and (whole >= 51 or size >= suffixes.LENGTH) else t[at : at + size]
            at += size
        assert (got[k] or "") == want
    for k, q in enumerate(shared):
        assert any(q in got[d] for d in (2 * k, 2 * k + 1)) == (k in (3, 4))


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "It's 12 o'clock, Ünï <|endoftext|> ☃☃ ﬁ Σίσυφος", "naïve\tco-op " * 50, "a" * 3000, *(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect())]
    ids = bpe.bpe_encode(spark.createDataFrame(list(enumerate(texts)), DOCS), queries.WORD_TOKENIZER)
    library = Tokenizer.from_file(queries.WORD_TOKENIZER)
    library.no_padding()
    library.no_truncation()
    for r in bpe.bpe_decode(ids, queries.WORD_TOKENIZER).collect():
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_token_files_equal_the_library(spark):
    import struct
    import zlib

    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(queries.WORD_TOKENIZER), 0
    library.no_padding()
    library.no_truncation()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op5_token_files(spark, SF).orderBy("doc_id").collect():
        ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_reordered_benchmark_passages_are_caught(spark):
    item = " ".join(f"w{k}" for k in range(40))
    w = item.split()
    docs = spark.createDataFrame([(1, "x " + " ".join(w[20:] + w[:20])), (2, "nothing of it"), (3, None), (4, "")], DOCS)
    tests = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    for limit in (contamination.BROADCAST_BYTES, 0):  # shipped, and joined
        got = contamination.contaminated(docs, tests, broadcast_bytes=limit).collect()
        assert [(r["doc_id"], r["item_id"], r["tiles"], r["coverage"]) for r in got] == [(1, 7, 2, 1.0)]


def test_null_ids_are_caught_on_both_paths(spark, tmp_path):
    items = [(None, "one two three four five six seven"), (None, "a b c"), (3, "red green blue white black grey")]
    docs = spark.createDataFrame([(None, items[0][1]), (None, "clean"), (2, items[0][1] + " " + items[2][1]), (2, "clean too"), (None, items[2][1]), (None, None)], DOCS)
    tests = spark.createDataFrame(items, "item_id long, text string")
    for limit in (contamination.BROADCAST_BYTES, 0):  # shipped, and joined
        got = contamination.contaminated(docs, tests, broadcast_bytes=limit).collect()
        assert Counter((r["doc_id"], r["item_id"], r["tiles"]) for r in got) == Counter([(None, None, 1), (2, None, 1), (2, 3, 1), (None, 3, 1)])
    tests.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert Counter(map(tuple, left)) == Counter([(None, "clean"), (2, "clean too"), (None, None)])


@pytest.mark.parametrize(("name", "column", "labels"), [("op9_language", "lang_pred", None), ("op8_quality", "predicted", "quality")])
def test_held_out_accuracy(spark, name, column, labels):
    sf = SF.replace("0.001", "0.01")
    truth = spark.read.parquet(f"{sf}/{'labels' if labels else 'documents'}.parquet").select("doc_id", F.col(labels or "lang").alias("truth"))
    got = queries.queries()[name](spark, sf).filter("held_out").join(truth, "doc_id").filter("truth is not null")
    assert got.agg(F.avg((F.col(column) == F.col("truth")).cast("int"))).first()[0] > 0.8


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (2, ""), (3, "a b"), (3, "a b")]])
def test_empty_tables_nulls_and_repeated_rows(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("clash")).withColumn("size", F.lit(0))
    assert near_text.similar(docs).count() == len(rows)
    assert passages.remove_passages(docs).count() == len(rows)
    assert suffixes.remove_repeats(docs).count() == len(rows)
    assert bpe.bpe_encode(docs, queries.WORD_TOKENIZER).count() == len(rows)
    assert near_text.keep_one(docs).columns == docs.columns


def test_vectors_without_links(spark):
    odd = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 0.01], 1), (7, [1.0, 0.0], 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 6: (2, 0)} | {k: (0, k) for k in (2, 3, 4, 5, 7)}


def test_warc_rejects_broken_records():
    digest = hashlib.sha1(b"body").hexdigest()
    good = warc.record(1, "http://a.example/", b"body", digest, 4, None)
    assert warc.parse(good)["payload"] == b"body"
    for bad in (good[:-1], good.replace(b"body", b"b0dy"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_pipeline_ids(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns)
    kept = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert len(kept) == len(set(kept)) > 0


def test_language_of_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "der und die", "de"), (2, "the and of", "en"), (3, "12 !?", None), (4, None, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.learn(docs, F.lit(True))).collect()}
    assert (got[3], got[4]) == ("und", "und")


def test_merged_components_equal_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    reach = components.components(table(links[:20]))
    for part in (links[20:35], [], links[35:]):
        reach = components.merged(reach, table(part))
    want = components.components(table(links))
    found = {tuple(r) for r in reach.collect()}
    assert found == {tuple(r) for r in want.collect()}
    assert len(found) == reach.count()


def test_branching_keeps_recall():
    rng = np.random.default_rng(7)
    n = 3000
    left = rng.integers(0, 1 << 32, (n, near_text.SIGNATURE), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.75, left, left ^ np.uint32(1))
    raw = [x.tobytes() for x in np.concatenate([left, right])]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(np.arange(2 * n)), "sig": pa.array(raw, pa.binary())})
    for depth in range(near_text.DEPTH + 1):
        out = pa.Table.from_batches(near_text._children(depth)([batch]))
        at = lambda half: {(i % n, v) for i, v in zip(out["id"].to_pylist(), out["node"].to_pylist(), strict=True) if i // n == half}  # noqa: B023, E731
        assert len({i for i, _ in at(0) & at(1)}) >= n * 0.998
        batch = out.append_column("sig", pa.array([raw[i] for i in out["id"].to_pylist()], pa.binary())).combine_chunks().to_batches()[0]


def test_large_nodes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_text, "NODE_ROWS", 2)  # nodes of all sizes branch
    rng, texts = random.Random(8), []
    mutated = lambda t, at: [f"n{rng.random()}" if k in at else w for k, w in enumerate(t)]
    for _ in range(150):  # two of each four are 0.75 to 0.8 alike, and each of these has a copy that is nearer
        a = [f"w{rng.random()}" for _ in range(200)]
        b = mutated(a, (20, 60, 100, 140, 180))
        texts += [a, b, mutated(a, (40, 80)), mutated(b, (30, 90))]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = {}
    for k in range(0, len(sets), 4):
        root = list(range(4))
        for i, j in itertools.combinations(range(4), 2):
            x, y = sets[k + i], sets[k + j]
            if 100 * len(x & y) >= near_text.THRESHOLD * len(x | y):
                root = [min(root[i], root[j]) if c in (root[i], root[j]) else c for c in root]
        want |= {k + i: k + root[i] for i in range(4)}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], DOCS)
    assert {r["id"]: r["component"] for r in near_text.similar(docs).collect()} == want


def test_repeated_ids_join_the_groups_of_their_texts(spark):
    docs = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "p q r s t"), (2, "p q r s t"), (4, "x y"), (5, None)]
    got = {(r["id"], r["component"]) for r in near_text.similar(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
