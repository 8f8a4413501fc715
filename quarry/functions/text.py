"""Text columns: tokenizers, clean-up, lengths in tokens, windows, marks. All are built-in expressions.

Null text gives null, except where a function says otherwise. Word characters are A-Z, a-z, 0-9
and the underscore, stated as classes since the JVM's word boundary also knows accented letters.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "A-Za-z0-9_"
#: A term for keywords: at least two letters, digits or underscores of any script.
KEYWORD = r"[\p{L}\p{N}_]{2,}"
#: The spaces that trimming removes, beyond the plain one.
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Those of them that are space separators of Unicode: neither tabs nor line ends.
SEPARATORS = "".join(c for c in SPACES if unicodedata.category(c) == "Zs")
#: The prefixes and the names that mean a query.
PREFIXES = {"query": "query: ", "passage": "passage: "}
QUERY_MODES = ("query", "question", "user", "clustering")


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def _all(c: Column, pattern: str) -> Column:
    """All matches of a pattern: one pass, where replacing and splitting take two."""
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(0))


def tokens(c: Column, unicode: bool = False) -> Column:
    """Lower-case words for ranking; unicode: keep letters and digits of every script."""
    if unicode:
        return _all(F.lower(c), r"[\p{L}\p{N}_]+")
    return _all(F.lower(c), f"[{WORD}]+")


def token_count(lowered: Column) -> Column:
    """How many tokens a lower-case text has, without making them."""
    return F.regexp_count(lowered, F.lit(f"[{WORD}]+"))


def whole_word(lowered: Column, word: str) -> Column:
    """Whether a word stands in a lower-case text; texts without its letters are done by a plain search."""
    return F.contains(lowered, F.lit(word)) & lowered.rlike(f"(?<![{WORD}]){quoted(word)}(?![{WORD}])")


def whole_word_count(lowered: Column, word: str) -> Column:
    return F.when(F.contains(lowered, F.lit(word)), F.regexp_count(lowered, F.lit(f"(?<![{WORD}]){quoted(word)}(?![{WORD}])"))).otherwise(0)


def fast_words(c: Column) -> Column:
    """Lower-case words for keyword search; quotes and hyphens stay within words."""
    return F.filter(F.transform(_all(F.lower(c), rf"[{WORD}'\-]+"), lambda w: F.btrim(w, F.lit("'-"))), lambda w: w != "")


def label_words(c: Column) -> Column:
    """Words of more than three characters, for cluster labels."""
    return _all(F.lower(c), f"[{WORD}]{{4,}}")


def keyword_terms(c: Column) -> Column:
    """Words of at least two letters, digits or underscores of any script."""
    return _all(F.lower(c), KEYWORD)


def spaced(c: Column) -> Column:
    return _all(c, r"\S+")


def summary(c: Column, n: int = 256) -> Column:
    """The first n words, with dots if there are more."""
    w = spaced(c)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("..."))).otherwise(F.array_join(w, " "))


def normalize_spaces(c: Column) -> Column:
    """Collapses runs of spaces where a text has any, or starts or ends with one."""
    untidy = c.rlike(r"\s{2}|^\s|\s$")
    return F.when(untidy, F.trim(F.regexp_replace(c, r"\s+", " "))).otherwise(c)


def prefixed(c: Column, mode: str = "passage") -> Column:
    kind = "query" if mode.strip().lower() in QUERY_MODES else "passage"
    return F.concat(F.lit(PREFIXES[kind]), c)


def embed_tokens(c: Column, cap: int = 256) -> Column:
    """Estimated tokens for an embedding model."""
    by_length, by_words = F.ceil(F.length(c) / 4), F.ceil(F.size(spaced(c)) * F.lit(1.3))
    return F.least(F.lit(cap).cast("long"), F.when(F.length(c) < 100, by_length).otherwise(F.greatest(by_length, by_words)))


def prompt_tokens(c: Column) -> Column:
    """Estimated tokens for a language model."""
    return F.ceil(F.length(c) / F.lit(3.5) * F.lit(1.1))


def _pieces(c: Column, size: int) -> Column:
    """The text in pieces of that many characters, in one pass."""
    return _all(c, f"(?s).{{1,{size}}}")


def _window(pieces: Column, i: Column, size: int, step: int) -> Column:
    """Window i from the pieces of step characters that it spans."""
    spanned = -(-size // step)
    return F.left(F.array_join(F.slice(pieces, i + 1, spanned), ""), F.lit(size))


def windows(c: Column, size: int = 512, overlap: int = 128, whole: float = 1.2) -> Column:
    """Structs (position, text): overlapping windows of characters, trimmed; a text of at most whole * size is one.

    Windows are joined from pieces, so that a text of any length is walked once.
    """
    step, n = size - overlap, F.length(c)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1))

    def cut(x: Column) -> Column:
        return F.transform(starts, lambda i: F.struct(i.cast("int").alias("position"), trimmed(_window(x, i, size, step)).alias("text")))

    one = F.array(F.struct(F.lit(0).alias("position"), trimmed(c).alias("text")))
    return F.when(n <= int(whole * size), one).otherwise(F.transform(F.array(_pieces(c, step)), cut)[0])  # as a lambda's variable the pieces are made once


def rechunk(c: Column, tokens_each: int, overlap: float = 0.15) -> Column:
    """Windows of about that many tokens, trimmed, without empty ones."""
    size = max(1, int(tokens_each * 3.5))
    step = max(1, size - int(size * overlap))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.size(x)) - 1), lambda i: trimmed(_window(x, i, size, step)))
    return F.filter(F.transform(F.array(_pieces(c, step)), cut)[0], lambda w: w != "")


def quoted(word: str) -> str:
    return "".join(x if re.match(r"\w", x) else f"\\x{{{ord(x):X}}}" for x in word)


def highlight(c: Column, words: list[str], css: str | None = "fast-highlight") -> Column:
    """Marks all matches of the words, whatever the case, in one pass, longest first; css None: a mark without a class."""
    if not (found := sorted({w for w in words if w}, key=lambda w: (-len(w), w))):
        return c
    tag = "<mark>" if css is None else f'<mark class="{css}">'
    return F.regexp_replace(c, f"(?i)({'|'.join(map(quoted, found))})", f"{tag}$1</mark>")


def highlight_phrase(c: Column, query: str, css: str | None = None) -> Column:
    """Marks a query as a whole; one of less than two characters marks nothing."""
    return highlight(c, [query], css) if len(query) >= 2 else c


def occurrences(c: Column, word: str) -> Column:
    """Occurrences of a word that don't overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def word_score(lowered: Column, word: str) -> Column:
    """30 for each whole word, 20 for each start of a word, 15 for others, and up to 25 for an early first one."""
    w, total = quoted(word), occurrences(lowered, word)
    whole = F.regexp_count(lowered, F.lit(f"(?<![{WORD}]){w}(?![{WORD}])"))
    start = F.regexp_count(lowered, F.lit(f"(?<![{WORD}]){w}(?=[{WORD}])"))
    early = F.greatest(F.lit(0), F.lit(25) - F.floor((F.instr(lowered, word) - 1) / 20))
    return F.when(F.contains(lowered, F.lit(word)), 15 * whole + 5 * start + 15 * total + early).otherwise(0)


def similarity(a: Column, b: Column) -> Column:
    """Share of words of more than three characters in common, by the smaller count."""
    long_words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 3)
    both = F.struct(long_words(a).alias("x"), long_words(b).alias("y"))

    def share(p: Column) -> Column:
        x, y = p["x"], p["y"]
        least = F.least(F.size(x), F.size(y))
        return F.when(least > 0, F.size(F.filter(x, lambda w: F.array_contains(y, w))) / least).otherwise(0.0)

    return F.transform(F.array(both), share)[0]  # as a lambda's variable the words are split once


def strip_think(c: Column) -> Column:
    """Without thoughts; if nothing else is left, only the tags go."""
    rest = trimmed(F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))
    return F.when(rest != "", rest).otherwise(trimmed(F.regexp_replace(c, r"(?i)</?think>", "")))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def format_key(c: Column) -> Column:
    """A field's name as a title."""
    c = F.regexp_replace(F.regexp_replace(c, "^(metadata_|Column )", ""), r"[_\-]+", " ")
    return F.initcap(F.trim(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")))


def file_size(c: Column) -> Column:
    return F.when(c < 1024, F.format_string("%d B", c.cast("long"))).when(c < 1 << 20, F.format_string("%.1f KB", c / 1024)).otherwise(F.format_string("%.1f MB", c / (1 << 20)))


def duration(seconds: Column) -> Column:
    """Seconds as text: "12s", or "3m 5s" from a minute on."""
    s = F.floor(seconds).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm %ds", F.floor(s / 60).cast("long"), s % 60))


def cluster_label(c: Column, names: dict[int, str] | None = None) -> Column:
    """Noise, a cluster's own name if it has one (noise can't), or its number."""
    label = F.when(c == -1, F.lit("Noise"))
    for k, name in (names or {}).items():
        label = label.when(c == k, F.lit(name)) if k != -1 else label
    return label.otherwise(F.concat(F.lit("Cluster "), c.cast("string")))


def percent(p: Column) -> Column:
    """A probability for display."""
    return F.format_string("%.2f%%", p * 100)


def hsl_hex(hue: Column, saturation: float, lightness: float) -> Column:
    """A colour of the wheel (degrees) as #rrggbb."""
    spread = saturation * min(lightness, 1 - lightness)

    def part(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + hue / 30, F.lit(12.0))
        level = F.lit(lightness) - F.lit(spread) * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.floor(level * 255 + 0.5).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), part(0), part(8), part(4))


def probability(p: Column, cluster: Column) -> Column:
    """Clamped to 0 to 1; not finite is 0; missing is 0.5 for noise, else 1."""
    sound = F.when(F.isnan(p) | (F.abs(p) == float("inf")), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
    return F.when(p.isNull(), F.when(cluster == -1, 0.5).otherwise(1.0)).otherwise(sound)
