"""The text side of the word tokenizer: special tokens, normalising, and splitting into pieces.

The tokenizers library, the regex module and Python have tables of unlike Unicode versions: some are
newer in what is a letter, others older in how marks are ordered. A text with a character on which
they may differ, which is found by asking the library, is normalised and split by the library itself.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import regex

from ._shared import kept

#: The tokenizer file's special tokens and split pattern, in its order.
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
_WIDE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: The same pattern for texts of the first 256 code points, which the faster module can state.
_LETTERS, _DIGITS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_NARROW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")

#: Characters past those blocks in which no table differs (tested); few texts have many.
_BEYOND = re.compile("[^\x00-\u024f]")
#: Marks of unlike combining classes, which show how another one is ordered.
_MARKS = "\u0301\u0323\u0345\u0334\u05b0\u094d\u0651\u0f72"


def normalise(text: str) -> str:
    """NFC, then lower case code point by code point (a final sigma stays medial)."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


@kept
def _model(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def unlike(path: str) -> re.Pattern:
    """Finds characters that Python's Unicode version doesn't know, and marks and composed characters that the library orders or composes otherwise."""
    by_library, found = _model(path).normalizer.normalize_str, bytearray(sys.maxunicode + 3)  # a byte for each code point, from place 1 on
    found[0x40001:0xE0001] = b"\1" * 0xA0000  # planes that hold no character as yet
    for k in chain(range(0x40000), range(0xE0000, sys.maxunicode + 1)):
        c = chr(k)
        if unicodedata.category(c) == "Cn":
            found[k + 1] = 1
        elif unicodedata.combining(c):
            if any(by_library(t) != normalise(t) for mark in _MARKS for t in (f"x{c}{mark}", f"x{mark}{c}")):
                found[k + 1] = 1
        elif not 0xAC00 <= k < 0xD7A4 and unicodedata.decomposition(c)[:1] not in ("", "<"):
            parts = unicodedata.normalize("NFD", c)
            if by_library(parts) != normalise(parts) or by_library(c) != normalise(c):
                found[k + 1] = found[ord(parts[-1]) + 1] = 1
    first = [m.start() - 1 for m in re.finditer(rb"(?<=\x00)\x01", found)]
    last = [m.start() - 2 for m in re.finditer(rb"(?<=\x01)\x00", found)]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last, strict=True)) + "]")


@kept
def library_split(path: str) -> Callable[[str], list[str]]:
    """Normalising and splitting by the library, for texts that hold no special token."""
    model = _model(path)

    def split(text: str) -> list[str]:
        text = model.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in model.pre_tokenizer.pre_tokenize_str(text)]

    return split


def split_pieces(text: str, path: str) -> list[str]:
    """Pieces of a text in order, by the tokenizer file at path; a special token is a piece of its own."""
    if "<|" in text:
        out: list[str] = []
        for k, part in enumerate(SPECIAL.split(text)):
            out += [part] if k % 2 else _plain(part, path)
        return out
    return _plain(text, path)


def _plain(text: str, path: str) -> list[str]:
    plain = normalise(text)
    try:
        plain.encode("latin-1")
    except UnicodeEncodeError:
        rare = "".join(set(_BEYOND.findall(text)))
        return library_split(path)(text) if unlike(path).search(rare) else _WIDE.findall(plain)
    return _NARROW.findall(plain)
