"""Whitening, the trie of conversations and the quality rules against plain versions, and at their edges."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("quarry.llm")

from pyspark.sql import functions as F  # noqa: E402

from quarry.llm import prefix_trie, quality_rules, whitening  # noqa: E402
from quarry.llm import queries as Q  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# whitening


def plain_whitening(rows, k=8):
    """rows of (id, vector): what whiten() gives, by singular values of the centred rows."""
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    d = collections.Counter(len(v) for _, v in kept).most_common(1)[0][0]
    kept = [(i, v) for i, v in kept if len(v) == d]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    centred = np.array([[a - b / n for a, b in zip(r, s, strict=True)] for r in x])
    _, sigma, right = np.linalg.svd(centred, full_matrices=False)
    e, axes = sigma[:k] ** 2 / n, right[:k].T
    return [i for i, _ in kept], n, deviation, centred @ axes / np.sqrt(e), e * n / (sigma**2).sum()


def held_to_plain(got, rows, k=8):
    ids, n, deviation, whitened, explained = plain_whitening(rows, k)
    by = {(r.id, r.component): r for r in got}
    assert len(got) == len(by) == len(ids) * k
    mine = np.array([[by[i, c].whitened for c in range(1, k + 1)] for i in ids])
    signs = np.sign((mine * whitened).sum(axis=0))
    np.testing.assert_allclose(mine, whitened * signs, atol=1e-6, rtol=1e-6)
    for i, dev in zip(ids, deviation, strict=True):
        for c in range(1, k + 1):
            r = by[i, c]
            assert r.n == n and r.deviation == dev and abs(r.explained / explained[c - 1] - 1) < 1e-6 and r.identity_error < 1e-6


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    held_to_plain(Q.op11_whitening(spark, DATA).withColumnRenamed("vec_id", "id").collect(), rows)


def test_whitening_edges(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (60, 3)) @ rng.normal(0, 1, (3, 3))
    near = base[:, :1] * 1000 + rng.normal(0, 0.01, (60, 1))  # nearly collinear with the first
    rows = [(k, [*map(float, r)]) for k, r in enumerate(np.hstack([base, near]))]
    odd = [(None, [1.0, 2.0, 3.0, 4.0]), (900, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, float("nan"), 2.0, 3.0]), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, []), (905, [1.0]), (5, rows[5][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, component string")
    got = whitening.whiten(frame).collect()
    assert {r.id for r in got} == {None, *range(60)} and max(r.component for r in got) == 4
    unique = [(i, v) for i, v in rows if i != 5]
    frame = spark.createDataFrame(unique, "vec_id long, embedding array<double>")
    held_to_plain(whitening.whiten(frame, components=4).collect(), unique, 4)
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 5.0]), (3, [1.0, 9.0])], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}  # the other dimension has no variance
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect() == []
    huge = spark.createDataFrame([(k, [float(k) * 1e11, 1e300 if k else 0.0]) for k in range(3)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}


# the trie of conversations


def plain_trie(rows):
    turns = collections.defaultdict(list)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0, md5(md5(role or "") + md5(text or ""))), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    trunc = lambda c: c - int(math.fmod(c, 20))
    again = {}
    for c, l in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        again[c] = own.get(trunc(c), [])[:h] + l[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, l in sorted(again.items()):
        for d in range(len(l) + 1):
            members[tuple(l[:d])].append(c)
        ends[tuple(l)].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(m) - 1) * len(WORD.findall(n[-1][1])) if n else 0
    return sorted((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items())


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONVERSATION = "conv_id long, turn int, role string, text string"


def trie_of(spark, rows, schema=CONVERSATION, **how):
    return sorted(tuple(r[c] for c in TRIE) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, schema), **how).collect())


def test_trie_edges(spark):
    rows = [
        (None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a c"), (1, 0, "user", "a b"), (-7, 3, "user", "a"), (-7, None, "x", "a  b c"),
        (40, 0, "u", "one"), (41, 0, "u", "one"), (42, 5, "u", "one two"), (43, 5, "u", ""), (44, 1, "u", "q"), (45, 1, "u", "q"), (46, 1, "u", "q"), (47, 1, "u", "q"),
    ]
    assert trie_of(spark, rows) == plain_trie(rows)
    assert trie_of(spark, []) == []
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{CONVERSATION}, depth int, up string")
    assert sorted(tuple(r[c] for c in TRIE) for r in prefix_trie.prefix_trie(frame).collect()) == plain_trie(rows)


@pytest.mark.parametrize("band", [2, 3, 8])
def test_trie_of_long_and_common_conversations(spark, band):
    rows = [(1, t, "user", f"w{t % 3} w") for t in range(90)] + [(20, t, "user", f"w{t % 3} w") for t in range(50)]
    rows += [(c, t, "a" if t % 2 else "b", f"same {t}" if t < 4 else f"{c % 5} {t}") for c in range(100, 260) for t in range(6)]
    assert trie_of(spark, rows, band=band) == plain_trie(rows)


def test_ends_of_a_node_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_CHARS", 40)
    rows = [(c, 0, "u", "x") for c in range(0, 2000, 20)]
    assert trie_of(spark, rows) == plain_trie(rows)


# quality rules


def plain_rules(docs, labels):
    """What quality_rules() gives for docs (id, text) and labels (id, label), from its counts over words."""
    known = collections.defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None:
            known[i].append(q == 1)
    B, M = quality_rules.BUCKETS, quality_rules.PRIOR
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h64 = lambda data, seed=42: xxhash.xxh64(data, seed=seed).intdigest()
    num = lambda x: (x & ((1 << 64) - 1)).to_bytes(8, "little")
    raw, target, rows = np.zeros(B), np.zeros((2, B)), []
    for i, text in docs:
        words = WORD.findall(text or "")
        h = [h64(w.encode()) for w in words]
        grams = [signed(x) % B for x in h] + [signed(h64(num(y), h64(num(x)))) % B for x, y in zip(h, h[1:], strict=False)]
        seed = h64(b"fold")
        fold = signed(h64(num(i), seed) if i is not None else seed) % 2
        good = bool(known.get(i)) and all(known[i])
        np.add.at(raw, grams, 1)
        if good:
            np.add.at(target[fold], grams, 1)
        rows.append((i, text or "", words, grams, fold, good))
    p = (raw + 1) / (raw.sum() + B)
    ratio = [np.round(1000 * np.log((target[1 - f] + M * p) / (target[1 - f].sum() + M) / p)) for f in (0, 1)]
    out = []
    for i, text, words, grams, fold, good in rows:
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        total = int(ratio[fold][grams].sum()) if grams else 0
        out.append([i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, total // max(1, len(grams)), good])
    trusted = sorted(r[7] for r in out if r[8] and not r[6])
    least = np.quantile(trusted, quality_rules.LEAST_SHARE) if trusted else -math.inf
    return sorted(([*r[:7], not r[6] and bool(r[7] >= least)] for r in out), key=repr)


RULES = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def rules_of(spark, docs, labels):
    got = quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    return sorted(([r[c] for c in RULES] for r in got.collect()), key=repr)


def test_rules_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    got = Q.op13_quality_rules(spark, DATA)
    assert sorted(([r[c] for c in ["doc_id", *RULES[1:]]] for r in got.collect()), key=repr) == plain_rules(docs, labels)
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())
    kept = {r.doc_id: r.kept for r in got.collect() if r.n_words >= 50}
    good = [kept[i] for i, q in labels if q == 1 and i in kept]
    assert sum(good) > 0.97 * len(good)


def test_rules_edges(spark):
    long = " ".join(f"w{k % 997} v{k // 997}" for k in range(30_000))
    docs = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "a b a b a b"), (7, "x " * 60), (8, "l1\nl1\n\n \nl1\r\nl2 # $ é ü|<>\nl2"), (None, "no id " * 3),
        (9, long), (9, long), (10, "\x0bz\x0cz\rz "), (11, " ".join(f"u{k}" for k in range(70))), (12, "𝒳é " * 3 + " ".join(f"ñ{k}" for k in range(60))), (13, "y" * 200_000), (14, "a b c a b d a b c"),
    ]
    labels = [(11, 1), (12, 1), (12, 0), (9, 1), (None, 1), (4, None), (99, 1)]
    assert rules_of(spark, docs, labels) == plain_rules(docs, labels)
    assert rules_of(spark, docs, []) == plain_rules(docs, [])
    assert rules_of(spark, [], []) == []
    clash = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("k", "kept", "trusted", "n_words", "h")})
    assert quality_rules.quality_rules(clash, spark.createDataFrame(labels, "doc_id long, quality int")).count() == len(docs)


def test_revisits_by_broadcast_and_by_shuffle(spark, monkeypatch):
    from quarry.llm import warc

    common, other = "c" * 2000, "o" * 1500
    pages = [(k, "u", common) for k in range(300)] + [(k, None, other) for k in range(300, 303)] + [(400, "u", ""), (401, "u", None), (402, "u", "short"), (403, "u", "short"), (None, "u", common), (404, "u", "x" * 1000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    run = lambda: sorted(((r.id, r.length, r.refers_to, r.payload is None) for r in warc.decide(frame).collect()), key=repr)
    by_broadcast = run()
    monkeypatch.setattr(warc, "BROADCAST_BYTES", -1)
    for share in (0.001, 0.1, 2.0):
        monkeypatch.setattr(warc, "HOT_SHARE", share)
        assert run() == by_broadcast
    assert len(by_broadcast) == len(pages) and [r for r in by_broadcast if r[0] == 5] == [(5, 2000, 299, True)] and [r for r in by_broadcast if r[0] == 403] == [(403, 5, None, False)]


# decontamination: the whole query


def plain_tiling(text, item, least=5):
    """Lengths of the tiles: of all runs that start at a shared run of `least` words, the longest of unmarked words, again and again."""
    least = min(least, len(item))
    if not least:
        return []
    at = collections.defaultdict(list)
    for j in range(len(item) - least + 1):
        at[tuple(item[j : j + least])].append(j)
    seeds = [(i, j) for i in range(len(text) - least + 1) for j in at.get(tuple(text[i : i + least]), ())]
    used_t, used_i, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i, j in seeds:
            n = 0
            while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and i + n not in used_t and j + n not in used_i:
                n += 1
            if n > best[0]:
                best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        tiles.append(n)
        used_t |= set(range(i, i + n))
        used_i |= set(range(j, j + n))


def test_contamination_query(spark):
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    words = lambda t: [w.lower() for w in word.findall((t or "").encode())]
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = []
    for d, text in docs:
        grams = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for k, item in items:
            if len(item) < 5 or any(tuple(item[j : j + 5]) in grams for j in range(len(item) - 4)):
                tiles = plain_tiling(text, item)
                if tiles and sum(tiles) >= 0.6 * len(item):
                    want.append((d, k, len(item), sum(tiles), len(tiles), round(sum(tiles) / len(item), 9)))
    got = Q.op10_contamination(spark, DATA).collect()
    assert want and sorted((r.doc_id, r.item_id, r.item_words, r.tiled_words, r.tiles, round(r.coverage, 9)) for r in got) == sorted(want)
