"""Keyword scores: what is made of a text is made once."""

from quarry.operators import lexical


def test_a_word_is_counted_once_in_a_text(spark, tmp_path):
    spark.createDataFrame([(1, "Alpha beta alphabet"), (2, "gamma"), (3, None), (4, "xalpha, beta")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    found = lexical.fast_scores(spark.read.parquet(f"{tmp_path}/d"), "alpha beta")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("(?<![") == 4  # whole and start, of two words
    assert sorted(map(tuple, found.collect())) == [(1, 30 + 20 + 25 + 30 + 25 + 20 + 50 + 30, 2), (4, 15 + 25 + 30 + 25 + 20 + 30, 2)]
