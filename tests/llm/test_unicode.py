"""Pieces and ids are the library's for every character, whatever Unicode version knows it."""

import random
import sys
import unicodedata

import pytest

pytest.importorskip("quarry.llm")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quarry.llm import _pieces, bpe, token_files  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def all_characters():
    return [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]


def test_every_character_is_split_as_the_library_splits_it():
    split, known = _pieces.library_split(PATH), [c for c in all_characters() if unicodedata.category(c) != "Cn"]
    for k in range(0, len(known), 512):
        text = " ".join(f"a{c}{c}1{c}" for c in known[k : k + 512])
        assert _pieces.split_pieces(text, PATH) == split(text)
    odd = [c for c in all_characters() if _pieces.unlike(PATH).search(c)]
    assert {c for c in all_characters() if unicodedata.category(c) == "Cn"} <= set(odd)
    assert not set(map(chr, range(0x250))) & set(odd)  # common texts are split here


def test_ids_of_all_characters_and_of_mixed_texts():
    model, encoder, library = Tokenizer.from_file(PATH), bpe.encoder(PATH), token_files.library(PATH)
    rng = random.Random(5)
    near = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"x{c}y {c}" for c in near if unicodedata.category(c) == "Cn"][::7]
    marks = [c for c in near if unicodedata.combining(c)]
    for _ in range(6000):
        block = rng.randrange(0, len(near) - 600)
        pool = near[block : block + 600] + marks[:40] + list("aEİΣσ ß'sé­​　\u0085")
        texts.append("".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))))
    want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    pieces = [_pieces.split_pieces(t, PATH) for t in texts]
    assert [sum((encoder.piece(p) for p in ps), []) for ps in pieces] == want
    import numpy as np

    assert [np.frombuffer(r, dtype="<i4").tolist() for r in library.encode(texts)] == want


def test_long_pieces_are_not_kept():
    library = token_files.library(PATH)
    word = "verylongword" * 30
    assert library.encode([f"a {word}"]) == library.encode([f"a {word}"]) and word not in library.known and "a" in library.known
