"""The corpus operators at their edges: hashes that must not collide, odd rows, clashing names, both paths of a size switch."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import _shared, bpe, contamination, language, passages, quality, queries, suffixes, token_files, vectors, warc

DOCS = "doc_id long, text string"


def thue_morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def hashes(text, **kwargs):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends, _ = _shared.word_bounds(data, np.array([0, len(data)]))
    return _shared.word_hashes(data, starts, ends, **kwargs)


@pytest.mark.parametrize("size", [8, 16, 32, 1024, 4096])
def test_patterned_words_do_not_collide(size):
    for seed in (0, 1):
        a, b = hashes(f"{thue_morse(size, 0)} {thue_morse(size, 1)}", seed=seed)
        assert a != b
    assert hashes("ÀBc Long" * 9, lower=True).tolist() == hashes("Àbc long" * 9, lower=True).tolist()


def test_slices_have_equal_hashes_only_if_equal():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    grams, raw, seen = _shared.gram_hashes(data), data.tobytes(), {}
    begin = rng.integers(0, 3000, 4000)
    end = begin + rng.integers(_shared.GRAM, 400, 4000)
    for i, j, h in zip(begin, end, _shared.slice_hashes(grams, begin, end).tolist(), strict=True):
        seen.setdefault(raw[i:j], set()).add(h)
    assert all(len(h) == 1 for h in seen.values())
    assert len({next(iter(h)) for h in seen.values()}) == len(seen)


def brute_passages(rows):
    n, first = passages.WINDOW_WORDS, {}
    cut = [(k, (t or "").split()) for k, t in rows]
    for k, w in cut:
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, k), k) if k is not None else first.get(g, float("inf"))
    out = []
    for k, w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if k is not None and first[tuple(w[i : i + n])] < k:
                gone[i : i + n] = [True] * n
        out.append((k, len(w), sum(gone), " ".join(x for x, y in zip(w, gone, strict=True) if not y)))
    return Counter(out)


def test_passages_of_repeated_and_null_ids_and_of_patterned_words(spark, monkeypatch):
    rng = random.Random(4)
    piece = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared, odd = piece(20), piece(6)
    rows = [(1, f"{odd} {thue_morse(1024, 0)} {odd}"), (2, f"{odd} {thue_morse(1024, 1)} {odd}"), (3, f"{piece(5)} {shared}"), (3, f"{shared} {piece(9)}"), (4, f"{shared} {piece(3)}"), (4, piece(40)), (None, shared), (None, None), (5, ""), (6, shared), (7, shared), (7, shared)]
    docs = spark.createDataFrame(rows, DOCS)
    for limit in (_shared.BROADCAST_BYTES, -1):  # marks broadcast, and joined by a shuffle
        monkeypatch.setattr(_shared, "BROADCAST_BYTES", limit)
        got = passages.remove_passages(docs).collect()
        assert Counter((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_passages(rows)


def brute_repeats(texts, n):
    data = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if times[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    return out


def test_repeats_of_repeated_and_null_ids(spark, monkeypatch):
    rng = random.Random(6)
    piece = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = piece(700)
    texts = [shared, shared[100:] + piece(100), piece(900), piece(50) + shared[:500] + piece(50), shared, None, "", piece(399), thue_morse(2048, 0), thue_morse(2048, 1)[:1500]]
    ids = [1, 1, 2, 2, 2, None, None, 3, 4, 4]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), DOCS)
    want = Counter(zip(ids, brute_repeats(texts, suffixes.LENGTH), strict=True))
    for limit in (_shared.BROADCAST_BYTES, -1):
        monkeypatch.setattr(_shared, "BROADCAST_BYTES", limit)
        got = suffixes.remove_repeats(docs).collect()
        assert Counter((r["id"], (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in got) == want


def test_pipeline_cut_keeps_other_rows_columns_and_whole_characters(spark):
    rng = random.Random(9)
    piece = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = "©" + piece(500)
    texts = ["è" + shared[1:] + "è", "Ã" + shared + "¨", piece(300), piece(80), None]
    rows = [(1, texts[0], "x", "y", 5), (1, texts[1], "x2", "y2", 6), (None, texts[2], "x3", "y3", 7), (1, texts[3], "x4", "y4", 8), (2, None, "x5", "y5", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut string, Same string, n_chars long")
    got = corpus_pipeline.cut_repeats(spark, docs, "")
    assert got.columns == docs.columns
    by = {r["cut"]: r for r in got.collect()}
    assert len(by) == 5
    for k, name in ((2, "x3"), (3, "x4"), (4, "x5")):
        assert by[name]["text"] == texts[k]
    assert [by[n]["Same"] for n in ("x", "x2", "x3")] == ["y", "y2", "y3"]
    for name, t in (("x", texts[0]), ("x2", texts[1])):
        left = by[name]["text"]
        assert set(left) <= set(t) and len(left) < 10 and by[name]["n_chars"] == len(left)


def test_result_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "the and of it", "a", "b", "c", "d")], "doc_id long, text string, IDS string, LANG_PRED string, Quality_Score string, DECODED string")
    assert bpe.bpe_encode(docs, queries.WORD_TOKENIZER).columns.count("IDS") == 0
    assert bpe.bpe_round_trip(docs, queries.WORD_TOKENIZER).select("ids", "decoded").count() == 1
    model = language.learn(docs.withColumn("lang", F.lit("en")), F.lit(True))
    assert language.identify(docs, model).select("lang_pred").first()[0] == "en"
    scored = quality.score(docs, quality.learn(docs, docs.select("doc_id", F.lit(1).alias("quality"))))
    assert 0 <= scored.select("quality_score").first()[0] <= 1


def test_pipeline_language_keeps_clashing_columns(spark):
    rows = [(k, t, la, "mine", "also") for k, (t, la) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 8 + [("12 !?", None), (None, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, lang_score string")
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert got.columns == docs.columns
    assert {(r["lang_pred"], r["lang_score"]) for r in got.collect()} == {("mine", "also")}
    assert got.count() == 16


def test_pipeline_decontamination_with_a_column_of_its_own_names(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, "x one two three four five six seven eight y", "a", 1), (2, "clean", "b", 2)], "doc_id long, text string, found string, row long")
    got = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.collect()] == [(2, "clean", "b", 2)]


def greedy(text, item, least):
    """Plain greedy string tiling: the longest match of unmarked words, again and again."""
    used_t, used_i, tiles = [False] * len(text), [False] * len(item), []
    least = min(least, len(item))
    while least:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and not used_t[i + n] and not used_i[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            break
        n, i, j = best
        tiles.append(n)
        used_t[i : i + n] = used_i[j : j + n] = [True] * n
    return tiles


def test_tiling_equals_plain_greedy_tiling():
    rng = random.Random(12)
    for _ in range(150):
        text, item = ([rng.randrange(3) for _ in range(rng.randrange(30))] for _ in range(2))
        as_hash = lambda w: np.array([x * 0x9E3779B97F4A7C15 % (1 << 64) for x in w], dtype=np.uint64)
        got = contamination.tile(as_hash(text), as_hash(item), 3)
        want = greedy(text, item, 3)
        assert sorted(t[2] for t in got) == sorted(want)
        assert all(text[i : i + n] == item[j : j + n] for i, j, n in got)
        assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for _, _, n in got)


def test_running_hash_equals_the_hash_of_each_run():
    words = np.random.default_rng(1).integers(0, 1 << 63, 40).astype(np.uint64)
    for k in (1, 5):
        got = contamination.running_hashes(words, k)
        for i in range(len(words) - k + 1):
            assert got[i] == sum(int(w) % contamination._PRIME * pow(contamination._BASE, j, contamination._PRIME) for j, w in enumerate(words[i : i + k])) % contamination._PRIME


def test_factorisation_equals_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    slots = quality.WORD_SLOTS + len(quality.STATISTICS) * quality.BINS
    model = quality.QualityModel(np.sort(rng.normal(size=(len(quality.STATISTICS), quality.BINS - 1)), axis=1), 0.3, rng.normal(size=slots), rng.normal(size=(slots, quality.RANK)))
    data = "A few words, and a few more words.\nOn two lines 12".encode()
    r, slot, x, stats = quality.features(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
    each = 1 / np.sqrt(stats.shape[1])
    at = [*slot.tolist(), *quality._bins(stats, model.edges)[0].tolist()]
    value = [*x.tolist(), *[each] * stats.shape[1]]
    total = model.bias + sum(model.linear[k] * v for k, v in zip(at, value, strict=True))
    for i in range(len(at)):
        for j in range(i):
            total += float(model.factors[at[i]] @ model.factors[at[j]]) * value[i] * value[j]
    assert model.score(r, slot, x, stats)[0] == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def test_decoding_equals_the_nearest_codeword_and_ties_are_ambiguous(spark):
    rng = np.random.default_rng(8)
    names = ["a", "b", "c", "d"]
    code = language.codewords(len(names))
    model = language.LanguageModel(names, code, rng.normal(size=(language.DIMENSIONS, code.shape[1])).astype(np.float32), rng.normal(size=code.shape[1]).astype(np.float32), rng.uniform(0.5, 2, code.shape[1]).astype(np.float32))
    counts = rng.integers(0, 3, (20, language.DIMENSIONS)).astype(np.float32)
    loss = model.losses(counts)
    f = language._scaled(counts) @ model.weights + model.bias
    for row, want in zip(f, loss, strict=True):
        plain = [sum(w * np.logaddexp(0, -c * v) for w, c, v in zip(model.bit_weight, word, row, strict=True)) / model.bit_weight.sum() for word in code]
        assert np.allclose(plain, want, atol=1e-4)
    flat = language.LanguageModel(names, code, model.weights * 0, model.bias * 0, model.bit_weight)
    got = language.identify(spark.createDataFrame([(1, "any text")], DOCS), flat).first()
    assert got["lang_ambiguous"] and got["lang_pred"] == "a"


def test_token_files_of_null_and_equal_keys_and_ranges(spark, tmp_path):
    rows = [(k % 7 if k % 5 else None, f"text number {k} " * (k % 4)) for k in range(60)] + [(None, None), (None, ""), (3, "same"), (3, "same")]
    docs = spark.createDataFrame(rows, DOCS)
    for encoding in ("dictionary", "delta"):
        path = f"{tmp_path}/{encoding}"
        token_files.write_tokens(docs, path, queries.WORD_TOKENIZER, encoding=encoding)
        got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
        assert Counter(r["key"] for r in got) == Counter(k for k, _ in rows)
        assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
        assert all(r["ids"][-1] == token_files.END_ID and len(r["ids"]) == r["n_tokens"] for r in got)
        some = token_files.read_tokens(spark, path, 2, 4, ("key", "ids"))
        assert Counter((r["key"], tuple(r["ids"])) for r in some.collect()) == Counter((r["key"], tuple(r["ids"])) for r in got if r["key"] in (2, 3, 4))
    crc = token_files.with_crc32(token_files.read_tokens(spark, path)).filter("key is null").collect()
    assert zlib.crc32(np.array([token_files.END_ID], dtype="<u4").tobytes()) in {r["ids_crc32"] for r in crc}


def test_selective_reads_take_fewer_bytes(spark, tmp_path):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(["alpha", "beta", f"w{rng.randrange(10**6)}"]) for _ in range(400))) for k in range(3000)], DOCS)
    token_files.write_tokens(docs, str(tmp_path / "t"), queries.WORD_TOKENIZER, row_group_bytes=1 << 20, page_bytes=16 << 10)

    def read(*args):
        statistics = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
        total = lambda: sum(s.getBytesRead() for s in statistics if s.getScheme() == "file")
        before = total()
        token_files.read_tokens(spark, str(tmp_path / "t"), *args).write.format("noop").mode("overwrite").save()
        return total() - before

    spark._jsc.hadoopConfiguration().set("parquet.hadoop.vectored.io.enabled", "false")  # whose reads are not counted
    whole = read(None, None, ("key", "n_tokens", "ids"))
    assert read(None, None, ("key", "n_tokens")) < whole / 4
    assert read(100, 130, ("key", "ids")) < whole / 2
    plan = token_files.read_tokens(spark, str(tmp_path / "t"), 100, 130, ("key", "n_tokens"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,100)" in plan and "ids" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables_of_the_other_operators(spark, tmp_path, n):
    docs = spark.createDataFrame([(1, "the and of it", "en")][:n], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)][:n], "doc_id long, quality int")
    assert language.identify(docs, language.learn(docs, F.lit(True))).count() == n
    assert quality.score(docs, quality.learn(docs, labels)).count() == n
    assert contamination.contaminated(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).count() == n
    assert vectors.near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1)][:n], "vec_id long, embedding array<float>, label int")).count() == n
    token_files.write_tokens(docs, f"{tmp_path}/tokens", queries.WORD_TOKENIZER)
    assert token_files.read_tokens(spark, f"{tmp_path}/tokens").count() == n
    pages = spark.createDataFrame([(1, "http://a.example", "x" * 2000)][:n], "page_id long, url string, html string")
    archives = warc.write_warc(pages, f"{tmp_path}/warc")
    assert warc.read_warc(archives.select("path")).count() == n


def test_warc_of_repeated_rows_and_nulls(spark, tmp_path):
    body = "y" * 1500
    rows = [(1, "http://a.example", body), (2, "http://a.example", body), (3, None, body), (4, "http://b.example", None), (5, "http://b.example", ""), (6, "http://c.example", "short"), (7, "http://c.example", "short")]
    archives = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/warc")
    got = {r["page_id"]: r for r in warc.read_warc(archives.select("path")).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 3), 2: ("revisit", 3)} | {k: ("response", None) for k in (3, 4, 5, 6, 7)}
    assert got[1]["payload_digest"] == hashlib.sha1(body.encode()).hexdigest()
    assert got[4]["payload_bytes"] == 0


def test_tables_of_projections_follow_the_rows():
    for rows in (1, 100, 5000, 10**6, 10**9):
        projections, tables = vectors.tables_for(rows)
        assert (1 - vectors.same_step(vectors.THRESHOLD) ** projections) ** tables <= vectors.MISS
        assert rows * vectors.same_step(0.0) ** projections < 2 * vectors.BLOCK or rows <= vectors.BLOCK


def test_blocks_of_a_large_bucket_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    x = (base[rng.integers(0, 6, 150)] + 0.12 * rng.normal(size=(150, 8))).astype(np.float32)
    rows = [(k, v.tolist(), int(k % 2)) for k, v in enumerate(x)]
    u = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    linked = (u @ u.T >= vectors.THRESHOLD) & (np.arange(150)[:, None] % 2 == np.arange(150)[None, :] % 2) & ~np.eye(150, dtype=bool)
    label = np.arange(150)
    for _ in range(150):
        label = np.minimum(label, np.where(linked, label[None, :], 1 << 30).min(axis=1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {k: (int(linked[k].sum()), int(label[k])) for k in range(150)}


def test_word_sets_of_the_narrow_batches_equal_those_of_one():
    texts = ["a b c d e f g", None, "", "x y", "a b c d e f g " * 40]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    whole = [(row, data.tobytes()) for row, _, data, _ in _shared.text_chunks(batch)]
    narrow = b"".join(data.tobytes() for _, _, data, _ in _shared.text_chunks(batch, limit=8))
    assert b"".join(d for _, d in whole) == narrow == "".join(t or "" for t in texts).encode()
