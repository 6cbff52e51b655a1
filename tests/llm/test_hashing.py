"""Hashes of all words at once against plain splitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from umbra.llm import hashing


def plain(texts: list[str], fold: bool = True) -> list[list[bytes]]:
    return [(t.encode().lower() if fold else t.encode()).split() for t in texts]


def agree(texts: list[str]) -> None:
    column = pa.array(["zz y", *texts, "q"], pa.string())[1:-1]
    words = [w for text in plain(texts) for w in text]
    codes, counts = hashing.word_codes(column)
    assert counts.tolist() == [len(w) for w in plain(texts)]
    assert len(set(zip(words, codes.tolist(), strict=True))) == len(set(words)) == len(set(codes.tolist()))
    for fold in (True, False):
        distinct, numbers, counts = hashing.distinct_words(column, fold)
        assert [distinct[i] for i in numbers] == [w for text in plain(texts, fold) for w in text]
        assert len(set(distinct)) == len(distinct) and counts.tolist() == [len(w) for w in plain(texts, fold)]


def test_random_texts():
    dice = np.random.default_rng(1)
    letters = ["a", "B", "b", "é", " ", "  ", "\n", "\t", "\x0b", "xxx", "中", " ", "\x1f"]
    for _ in range(200):
        agree(["".join(dice.choice(letters, dice.integers(0, 30))) for _ in range(dice.integers(0, 8))])


@pytest.mark.parametrize("size", [7, 64, hashing.PIECE])
def test_pieces_cut_no_word(monkeypatch, size):
    monkeypatch.setattr(hashing, "PIECE", size)
    monkeypatch.setattr(hashing, "_TABLES", [])
    agree(["word " * 50, "", "a" * 300, "b" * 600 + " " + "b" * 600 + "c", "x" * size, " " * size + "y", "ab " * 90, "a" * (size - 1) + " b", "c" * size + " d"])


def test_long_regular_words_differ():
    """The words that defeat sums of powers modulo 2**64: signs of equal sums of digits swapped."""
    swapped = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    agree([swapped, swapped.translate(str.maketrans("ab", "ba")), "a" * 4096, "A" * 4096])


def test_parts_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (i * 7 % 90) for i in range(50)])], names=["row", "text"])
    for size in (1, 100, 1 << 20):
        parts = list(hashing.parts_of([batch], 1, size))
        assert [r for p in parts for r in p.column(0).to_pylist()] == list(range(50))
        assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= size for p in parts)


def test_collapsed_words_hash_alike():
    classes = bytes(65 if 65 <= x <= 90 else 97 if 97 <= x <= 122 or x >= 128 else 48 if 48 <= x <= 57 else x for x in range(256))
    dice = np.random.default_rng(2)
    texts = ["".join(dice.choice(["A", "b", "c", "7", "!", ".", " ", "é", "\n"], dice.integers(0, 40))) for _ in range(300)] + ["a" * 511, "Z" * 600 + "b", "Z" * 700 + "b" * 9]
    words = hashing.Words(pa.array(texts), classes=classes)
    shapes = [hashing.collapsed(w, classes) for t in plain(texts, False) for w in t]
    long = [len(w) >= hashing.LONG_WORD for t in plain(texts, False) for w in t]
    seen = set(zip(shapes, long, words.codes.tolist(), strict=True))
    assert len(seen) == len({(s, x) for s, x, _ in seen}) == len({c for *_, c in seen})
    assert [bytes([e >> 8, e & 255]).lstrip(b"\0") for e in words.endings().tolist()] == [w[-2:] for t in plain(texts, False) for w in t]
