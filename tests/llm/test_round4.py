"""What Python workers keep between stages, and token files without a shuffle of ids."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

pytest.importorskip("quarry.llm")

from quarry.llm import _pieces, _shared, bpe, language, token_files  # noqa: E402

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_the_table_of_unlike_characters_is_made_in_little_memory():
    _pieces._model(TOKENIZER)
    _pieces.unlike.cache_clear()
    tracemalloc.start()
    _pieces.unlike(TOKENIZER)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10e6


def test_steps_drop_the_models_of_other_stages():
    keeping = _shared.releasing(bpe._encoding(TOKENIZER, "text", "ids"), keeps=True)
    batch = pa.RecordBatch.from_pylist([{"text": "a word"}])
    for _ in range(2):
        list(keeping([batch]))
        assert bpe.encoder.cache_info().currsize == 1
    list(_shared.releasing(lambda batches: iter(batches))([batch]))
    assert bpe.encoder.cache_info().currsize == bpe._cache.cache_info().currsize == 0


def test_languages_are_counted_few_texts_at_once(monkeypatch):
    rows, one = [], language.ngram_counts
    monkeypatch.setattr(language, "ngram_counts", lambda data, offs: rows.append(len(offs) - 1) or one(data, offs))
    model = language.fit(one(np.frombuffer(b"onetwo", dtype=np.uint8), np.array([0, 3, 6])), ["a", "b"])

    class Docs:
        schema = []

        def mapInArrow(self, run, schema):
            return [r for b in run([pa.RecordBatch.from_pylist([{"text": "one"}] * 1000)]) for r in b.to_pylist()]

    found = language.identify(Docs(), model)
    assert len(found) == 1000 and {r["lang_pred"] for r in found} == {"a"} and max(rows) <= 128


def test_a_full_cache_keeps_what_is_in_use(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_PIECES", 8)
    monkeypatch.setattr(token_files, "LONGEST_PIECE", 12)
    pieces = token_files.LibraryPieces(TOKENIZER)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["one two three four five six seven", None, "", "one <|endoftext|> " + "x" * 40, "Ünder one's 12 été"] * 2
    for some in (texts[:4], texts[4:], texts):
        ids, ends = pieces.encode_all(some)
        got = [x.tolist() for x in np.split(ids, ends)[:-1]]
        assert got == [[*plain.encode(t or "", add_special_tokens=False).ids, token_files.END_ID] for t in some]
        assert {None, "<|endoftext|>", "one"} <= set(pieces) and not any(len(p or "") > 15 for p in pieces)


def test_ids_are_read_without_a_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k} of some words") for k in range(200)], "doc_id long, text string")
    token_files.write_tokens(docs, f"{tmp_path}/tokens", TOKENIZER)
    read = token_files.read_tokens(spark, f"{tmp_path}/tokens")
    rows = sorted((r["key"], r["start"], r["n_tokens"]) for r in read.collect())
    assert [s for _, s, _ in rows] == [sum(n for _, _, n in rows[:k]) for k in range(200)]
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1"}  # a size that the planner can't see is no reason to shuffle
    for name, value in off.items():
        spark.conf.set(name, value)
    try:
        plan = token_files.read_tokens(spark, f"{tmp_path}/tokens")._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in off:
            spark.conf.unset(name)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
