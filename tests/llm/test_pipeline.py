"""The pipeline against plain versions of its stages."""

import itertools
import random
import re
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import contamination, near_text, suffixes

WORDS = {"en": "the of and to in is that it was for on are with they be at this have from or had by".split(), "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an".split()}


def rows():
    rng = random.Random(21)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + (str(rng.randrange(100)) if rng.random() < 0.3 else "") for _ in range(n))
    item = text("en", 40)
    shared = [text("en", 60), text("de", 55), text("en", 30)]
    out = [(text(lang, rng.randrange(20, 120)), lang) for lang in ("en", "de") * 12]
    base = text("en", 100)
    out += [(base, "en"), (base + " the end", "en"), (base, "en"), (text("en", 20) + " " + item, "en")]
    for q in shared:
        out += [(f"{text('en', 30)} {q} {text('en', 25)}", "en"), (f"{text('de', 20)} {q} {text('de', 35)}", "de")]
    out += [("12 345 !!", None), (None, None), ("", None)]
    return [(k, t, lang, "src", len(t or "")) for k, (t, lang) in enumerate(out)], item


def near_groups(texts):
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for k, t in texts.items() if (w := t.lower().split())}
    root = {k: k for k in texts}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= near_text.THRESHOLD * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {k: low if r == high else r for k, r in root.items()}
    return root


def cut(texts):
    n = corpus_pipeline.PASSAGE_BYTES
    times = Counter(t[i : i + n] for t in texts.values() for i in range(len(t) - n + 1))
    out = {}
    for k, t in texts.items():
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if times[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        left, at = "", 0
        for dropped, run in itertools.groupby(gone):
            size = len(list(run))
            whole = sum(gone[m.start()] and at <= m.start() and m.end() <= at + size for m in re.finditer(r"\S+", t))
            left += "" if dropped and (whole >= corpus_pipeline.PASSAGE_WORDS or size >= suffixes.LENGTH) else t[at : at + size]
            at += size
        out[k] = left
    return out


def contaminated(text, item):
    a, b = (re.findall("[a-z0-9]+", x.lower()) for x in (text, item))
    used, tiled = [False] * len(a), [False] * len(b)
    while True:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used[i + n] and not tiled[j + n]:
                n += 1
            best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < contamination.MIN_MATCH:
            return sum(tiled) >= contamination.COVERAGE * len(b)
        used[i : i + n] = tiled[j : j + n] = [True] * n


def test_pipeline_equals_plain_stages(spark, tmp_path):
    docs, item = rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.identify_language(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    texts = {r["doc_id"]: r["text"] for r in kept.select("doc_id", "text").collect()}
    assert set(texts) == {d[0] for d in docs if d[2]}  # clean texts stay, those without a letter go
    root = near_groups(texts)
    texts = cut({k: t for k, t in texts.items() if root[k] == k})
    texts = {k: t for k, t in texts.items() if not contaminated(t, item)}
    assert 25 < len(texts) < len(docs) - 5
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    library.no_padding()
    library.no_truncation()
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {k: library.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
