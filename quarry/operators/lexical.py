"""Lexical search: BM25 ranking, keyword search with prefixes and typos, and a small boolean language."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: BM25's saturation and length weight.
K1, B = 1.5, 0.75


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, in order; the twin of functions.text.tokens."""
    return list(dict.fromkeys(re.findall(r"[a-z0-9_]+", re.sub(r"[^\x00-\x7f]", " ", query.lower()))))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, term, tf). Tasks count the terms of their texts before the shuffle, which carries each posting once."""
    words = docs.select(F.col(key), F.explode(T.tokens(F.col(text))).alias("term"))
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_df(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (term, df): in how many texts a term occurs."""
    return docs.select(F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: texts, tokens and mean tokens, at least 1. Texts without tokens count."""
    n = T.token_count(F.lower(F.coalesce(F.col(text), F.lit(""))))
    total = F.coalesce(F.sum(n), F.lit(0)).cast("long")
    return docs.agg(F.count("*").alias("n_docs"), total.alias("n_tokens"), F.greatest(F.lit(1.0), F.coalesce(F.avg(n), F.lit(0.0))).alias("avg_tokens"))


def bm25_scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", scope: Column | None = None) -> DataFrame:
    """Rows (key, score) of the texts that hold a term of the query; scope: a test that they must pass.

    Counts of the query's terms are taken while texts are scanned, with no index and no shuffle of
    rows, and no text is cut into words: a plain search rules most texts out before a pattern counts.
    The corpus's statistics are one row, formed from partial sums, whatever the scope.
    """
    terms = query_terms(query)
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    if not terms:
        return docs.filter(F.lit(False)).select(key, F.lit(0.0).alias("score"))
    stats = docs.agg(F.count("*").alias("_all"), F.greatest(F.lit(1.0), F.avg(T.token_count(lowered))).alias("_avg"), *(F.count_if(T.whole_word(lowered, t)).alias(f"_df{k}") for k, t in enumerate(terms)))
    hit = F.lit(False)
    for t in terms:
        hit = hit | T.whole_word(lowered, t)
    found = docs.filter(hit if scope is None else scope & hit)
    counted = found.select(key, T.token_count(lowered).alias("_n"), *(T.whole_word_count(lowered, t).alias(f"_tf{k}") for k, t in enumerate(terms)))
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"_tf{k}"), F.col(f"_df{k}")
        idf = F.log((F.col("_all") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))).otherwise(0.0)
    return counted.join(F.broadcast(stats)).select(key, score.alias("score"))  # one row of statistics


def bm25_topk(docs: DataFrame, query: str, k: int = 10, key: str = "doc_id", text: str = "text", scope: Column | None = None) -> DataFrame:
    """The k best texts, ties in order of key: (key, score)."""
    return bm25_scores(docs, query, key, text, scope).orderBy(F.desc("score"), key).limit(k)


def word_index(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """Rows (word, key), each once per text, of words of at least that many characters."""
    words = F.array_distinct(F.filter(T.fast_words(F.col(text)), lambda w: F.length(w) >= least))
    return docs.select(F.explode(words).alias("word"), F.col(key))


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (word, df): the distinct words of the index."""
    words = F.array_distinct(F.filter(T.fast_words(F.col(text)), lambda w: F.length(w) >= 2))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def near_words(target: str, word: str) -> bool:
    """Whether a greedy walk, one edit at most, leads from one word to the other.

    At the first difference it looks one character ahead: in word first, then in target, else both
    go on; what remains of either counts. This accepts fewer pairs than an edit distance of one.
    """
    if word == target or abs(len(word) - len(target)) > 2 or word in target:
        return False
    same = next((k for k, (x, y) in enumerate(zip(word, target, strict=False)) if x != y), None)
    if same is None:
        return abs(len(word) - len(target)) <= 1
    a, b = word[same:], target[same:]
    a, b = (a[2:], b[1:]) if a[1:2] == b[0] else (a[1:], b[2:]) if a[0] == b[1:2] else (a[1:], b[1:])
    return a == b


def near_word(target: Column, word: str) -> Column:
    """near_words() of a column and a literal, as one expression: a case for each place of the first difference."""
    m, walk = len(word), None
    for k in range(m, -1, -1):
        rest = lambda n: F.substr(target, F.lit(k + n + 1))  # noqa: B023, E731
        after = F.lit(m - k <= 1)
        if k < m:
            step = F.when(F.length(target) == k, after)
            if word[k + 1 : k + 2]:
                step = step.when(F.substring(target, k + 1, 1) == word[k + 1], rest(1) == word[k + 2 :])
            step = step.when(F.substring(target, k + 2, 1) == word[k], rest(2) == word[k + 1 :])
            after = step.otherwise(rest(1) == word[k + 1 :])
        shared = F.startswith(target, F.lit(word[:k]))
        walk = F.when(shared, after) if walk is None else walk.when(shared, after)
    return (F.abs(F.length(target) - m) <= 2) & ~F.contains(target, F.lit(word)) & walk


def word_kind(word: Column, q: str, prefix: bool = True, fuzzy: bool = True) -> Column:
    """How a word matches a word of the query: exact, prefix, fuzzy or null."""
    kind = F.when(word == q, "exact")
    if prefix and len(q) >= 2:
        kind = kind.when(word.startswith(q), "prefix")
    return kind.when(near_word(word, q), "fuzzy") if fuzzy and len(q) >= 3 else kind


def word_matches(words: DataFrame, query: str, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """Rows (query_word, word, kind) of a dictionary's words: exact, prefix or fuzzy, in one scan of it."""
    wanted, word = sorted(set(query_fast_words(query))), F.col("word")
    if not wanted:
        return words.select(F.lit("").alias("query_word"), "word", F.lit("").alias("kind")).filter(F.lit(False))
    kinds = F.array(*(F.struct(F.lit(q).alias("query_word"), word_kind(word, q, prefix, fuzzy).alias("kind")) for q in wanted))
    return words.select("word", F.explode(F.filter(kinds, lambda x: x["kind"].isNotNull())).alias("m")).select("m.query_word", "word", "m.kind")


def query_fast_words(query: str) -> list[str]:
    words = (w.strip("'-") for w in re.sub(r"[^A-Za-z0-9_\s'\-]", " ", query.lower()).split())
    return [w for w in words if w]


def fast_scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score, match_count) of texts whose score is positive, by all of the query's words as they stand in the text.

    What is made of a text comes out of inline(), so that neither a filter nor a sum makes it anew.
    """
    words, phrase = list(dict.fromkeys(query_fast_words(query))), query.strip().lower()
    made = lambda *c: F.inline(F.array(F.struct(*c)))
    rows = docs.select(key, made(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t")))
    rows = rows.select("*", made(F.lit(0).alias("_s"), *(T.word_score(F.col("_t"), w).alias(f"_s{k}") for k, w in enumerate(words))))
    each = [F.col(f"_s{k}") for k in range(len(words))]
    if not each:
        return rows.filter(F.lit(False)).select(key, F.lit(0).cast("long").alias("score"), F.lit(0).alias("match_count"))
    total = sum(each[1:], each[0])
    count = sum(((s > 0).cast("int") for s in each[1:]), (each[0] > 0).cast("int"))
    rows = rows.filter(sum(each[1:], each[0]) > 0).select("*", made(T.spaced(F.col("_t")).alias("_w")))
    spaced = F.col("_w")
    if len(words) > 1:
        total = total + F.when(count > 1, 10 * count).otherwise(0)
    if len(phrase) > 3:
        total = total + F.when(F.contains("_t", F.lit(phrase)), 50).otherwise(0)
    total = total + F.when(F.exists(F.slice(spaced, 1, 5), lambda w: w.contains(words[0])), 30).otherwise(0)
    total = F.when(F.size(spaced) > 100, total * F.lit(0.9)).otherwise(total * F.lit(1.0))
    return rows.select(key, made(F.floor(total + 0.5).alias("score"), count.alias("match_count"))).filter("score > 0")


def _has_match(text: Column, lowered: Column, words: list[str], fuzzy: bool) -> Column:
    """Whether a text has an exact, prefix or fuzzy match of a word; its words are made only if the first two fail."""
    start = F.lit(False)
    for q in words:
        begins = f"(?<![{T.WORD}'\\-])['\\-]*{T.quoted(q)}"
        start = start | (F.contains(lowered, F.lit(q)) & lowered.rlike(begins if len(q) >= 2 else f"{begins}['\\-]*(?![{T.WORD}'\\-])"))
    long_enough = [q for q in words if len(q) >= 3]
    if not fuzzy or not long_enough:
        return start
    near = lambda w: F.array_contains(F.array(*(near_word(w, q) for q in long_enough)), True)
    return start | F.exists(T.fast_words(text), near)


def fast_search(docs: DataFrame, query: str, k: int | None = None, fuzzy: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keyword search: texts with an exact, prefix or fuzzy match of a word, by score: (key, score, match_count, rank from 1).

    The query's words are literals, so texts are tested where they are, in one scan without a join;
    only those that hold a word of the query can score. Ranks need an order of all hits, so they
    are given with k only.
    """
    words = [w for w in dict.fromkeys(query_fast_words(query))]
    lowered, held = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(False)
    for w in words:
        held = held | F.contains(lowered, F.lit(w))
    hits = docs.filter(held & _has_match(F.col(text), lowered, words, fuzzy))
    out = fast_scores(hits, query, key, text).orderBy(F.desc("score"), key)
    return out if k is None else ranked(out.limit(k), key)


def ranked(hits: DataFrame, key: str = "doc_id", first: int = 1) -> DataFrame:
    """A rank in order of score; for top-k frames, since all rows meet in one task."""
    from pyspark.sql import Window

    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)) + (first - 1))


#: The words of the boolean language.
OPERATORS = ("AND", "OR", "NOT")
_TOKEN = re.compile(r'"(?P<phrase>[^"]*)(?:"|$)|(?<!\S)(?P<sign>[+-])(?P<signed>\S+)|(?P<word>[^\s"]+)')


def parse_boolean(query: str) -> list[tuple[str, str]]:
    """Tokens (kind, value): phrase, required, excluded, operator or term. An open quote is a phrase; signs count at a word's start."""
    out = []
    for m in _TOKEN.finditer(query):
        if m["phrase"] is not None:
            kind, value = "phrase", m["phrase"].strip()
        elif m["sign"]:
            kind, value = ("required" if m["sign"] == "+" else "excluded"), m["signed"]
        else:
            kind, value = ("operator", m["word"].upper()) if m["word"].upper() in OPERATORS else ("term", m["word"])
        if value:
            out.append((kind, value))
    return out


def is_boolean(query: str) -> bool:
    return any(kind != "term" for kind, _ in parse_boolean(query))


def _token_test(kind: str, value: str, lowered: Column) -> Column:
    if kind == "phrase":
        return F.contains(lowered, F.lit(value.lower()))
    test = F.lit(False)
    for w in query_fast_words(value):
        test = test | T.whole_word(lowered, w)
    return test


def boolean_condition(query: str, text: str = "text") -> Column:
    """The query as one boolean column: left to right, without precedence; an operator stays until the next.

    Required tokens always intersect and excluded ones always subtract.
    """
    lowered, test, operator = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(True), "AND"
    for kind, value in parse_boolean(query):
        if kind == "operator":
            operator = value
            continue
        hit = _token_test(kind, value, lowered)
        if kind == "excluded" or (operator == "NOT" and kind != "required"):
            test = test & ~hit
        elif operator == "OR" and kind != "required":
            test = test | hit
        else:
            test = test & hit
    return test


def boolean_rank(query: str, text: str = "text") -> Column:
    """Which token let a text in: 0, or for one that OR added, that token's number among the query's."""
    lowered, test, operator, joined = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(True), "AND", F.lit(0)
    for k, (kind, value) in enumerate(parse_boolean(query)):
        if kind == "operator":
            operator = value
            continue
        hit = _token_test(kind, value, lowered)
        if kind == "excluded" or (operator == "NOT" and kind != "required"):
            test = test & ~hit
        elif operator == "OR" and kind != "required":
            joined = F.when(~test & hit, k).otherwise(joined)
            test = test | hit
        else:
            test = test & hit
    return joined


def boolean_scores(docs: DataFrame, query: str, k: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first k texts that the query lets through: (key, score), 100 less the place in order of joining, then of key."""
    found = boolean_search(docs, query, key, text).select(key, boolean_rank(query, text).alias("_at")).orderBy("_at", key).limit(k)
    from pyspark.sql import Window

    return found.select(key, (101 - F.row_number().over(Window.orderBy("_at", key))).alias("score"))


def boolean_search(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs that the query lets through, in a single scan."""
    return docs.filter(boolean_condition(query, text))
