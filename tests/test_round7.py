"""Odd rows and small limits, held against the queries' SQL."""

import random

import duckdb
import pytest

import __spark_entry__ as driver
from quarry.operators import _tables, index


def differences(spark, folder, name, **tables):
    """Rows that a query and its SQL do not share, over tables given as frames."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = driver.queries()[name](spark, str(folder))
    got.write.parquet(f"{folder}/got")
    want = con.sql(driver.oracle_sql()[name])
    names = ", ".join(f'"{c}"' for c in want.columns)
    want.create("want")
    con.sql(f"CREATE VIEW got AS SELECT {names} FROM '{folder}/got/*.parquet'")
    assert con.sql("SELECT count(*) FROM want").fetchall() != [(0,)]
    return con.sql("(FROM got EXCEPT ALL FROM want) UNION ALL (FROM want EXCEPT ALL FROM got)").fetchall()


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_csv_keeps_empty_texts_nulls_and_every_character(spark, tmp_path):
    odd = ["", None, " ", " a ", '"', '""', '\0"', '"\0', "\0\n", "\r", "\r\n", "\n", "\\", '\\"', ",", "#", "\ufeff", "\u2028", "\uffff", "nan", "null", "a"]
    rows = [(k * len(odd) + j, a, b, odd[(j + k) % 3], None if k == j else k) for k, a in enumerate(odd) for j, b in enumerate(odd)]
    assert differences(spark, tmp_path, "src_csv", documents=spark.createDataFrame([(None, None, None, None, None), *rows], DOCS)) == []


def test_schema_of_the_engine_counts_as_its_sql(spark, tmp_path):
    texts = ["", "  ", "nan", "a", " a", "a\u3000", "a\n", "\ta", "a\ufeff", None, "\u200b", "null", "a "]
    rows = [(k, t, ["en", None, "null", ""][k % 4], None, 100 + k) for k, t in enumerate(texts)]
    assert differences(spark, tmp_path / "a", "engine_schema", documents=spark.createDataFrame(rows, DOCS)) == []
    assert differences(spark, tmp_path / "b", "engine_schema", documents=spark.createDataFrame([], DOCS)) == []
    long = "only rely antion " * 9
    assert differences(spark, tmp_path / "c", "engine_search", documents=spark.createDataFrame([*((k + 20, t, "en", "s", 1) for k, t in enumerate(texts)), (1, long, "en", "s", 1), (2, long + "\n", "en", "s", 1)], DOCS)) == []


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_points_by_parts_and_words_equal_the_sql(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(_tables, "BROADCAST_BYTES", limit)
    rng = random.Random(limit)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 4, 5, 6]))) for _ in range(40)]
    texts = ["", None, "x" * 400, "word " * 40, "ab" * 90 + " " + "cd" * 90, "a" + " " * 45 + "b" + " " * 45 + "c" * 50, "".join(chr(0x4E00 + k % 97) for k in range(300))]
    texts += [" ".join(rng.choices(words, k=rng.choice([3, 8, 15, 40]))) for _ in range(150)]
    texts += [f"{rng.choice(words)} {t} {rng.choice(words)}" for t in texts[2:80]] + [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[7:80]]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS)
    vectors = spark.createDataFrame([(k, [0.1, 0.2, 0.3], 1) for k in range(len(texts))], "vec_id long, embedding array<float>, label int")
    assert differences(spark, tmp_path, "resolve_point_text", documents=docs, embeddings=vectors) == []


def test_postings_are_shuffled_once(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"one two two w{k % 7} w{k % 11}") for k in range(300)], "doc_id long, text string")
    index.save_postings(docs, str(tmp_path), part_rows=16)
    got = spark.read.parquet(f"{tmp_path}/postings")
    assert {(r["term"], r["key"], r["tf"], r["n"]) for r in got.filter("key < 2").collect()} == {("one", 0, 1, 5), ("two", 0, 2, 5), ("w0", 0, 2, 5), ("one", 1, 1, 5), ("two", 1, 2, 5), ("w1", 1, 2, 5)}
    assert got.groupBy("term", "part", "key").count().filter("count > 1").isEmpty()
    plan = index._dealt(docs, "doc_id", "text", 19, 32)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
