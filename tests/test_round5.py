"""The pipeline's batches are bounded by bytes, whatever the texts."""

import pyarrow as pa
import pytest

import corpus_pipeline

ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_a_stage_sends_texts_to_workers_in_small_batches(spark, k):
    docs = spark.createDataFrame([(i, f"the quick brown fox {i} jumps", "en", "web", 25) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(ARROW)
    try:
        corpus_pipeline.STAGES[k][1](spark, docs, "/root/testdata/sf0.001")
        long = spark.range(0, 4000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 5000) as text")
        sizes = [r.n for r in long.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
        assert sum(sizes) >= 20_000_000 and max(sizes) <= 1.1 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.set(ARROW, before)
