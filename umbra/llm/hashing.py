"""Hashes of all words of many texts at once, in numpy over the bytes of an Arrow column."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time, and the length from which a word is hashed on its own: sums of powers modulo 2**64
#: can only be steered into equal values by long regular words.
PIECE, LONG_WORD = 1 << 17, 512
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8


def is_space(data: np.ndarray) -> np.ndarray:
    """Where bytes are ASCII white space, the characters of ``[\\x20\\x09-\\x0D]``."""
    return (data == 32) | (data - np.uint8(9) <= 4)  # below 9 it wraps round


def _byte_values(fold: bool) -> np.ndarray:
    """A random number for each byte; white space has none and with ``fold`` capitals A-Z share that of the small letter."""
    values = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        values[65:91] = values[97:123]
    values[is_space(np.arange(256, dtype=np.uint8))] = 0
    return values


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_VALUES = {fold: _byte_values(fold) for fold in (True, False)}
_TABLES: list[np.ndarray] = []  # powers and inverse powers, made in the task that needs them


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): text i of a string or binary column without nulls is bytes[bounds[i]:bounds[i + 1]]."""
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    bounds = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), bounds


def _piece_end(data: np.ndarray, bounds: np.ndarray, low: int, end: int) -> int:
    """Where the piece that starts at ``low`` ends: no word goes on beyond it."""
    high = min(low + PIECE, end)
    if high == end:
        return end
    bound = int(bounds[np.searchsorted(bounds, high, "right") - 1])
    for near in (max(low, high - 1024), low):
        space = np.flatnonzero(is_space(data[near:high]))
        cut = max(near + int(space[-1]) + 1 if len(space) else low, bound)
        if cut > low:
            return cut
    stop = int(bounds[np.searchsorted(bounds, high)])  # one word longer than a piece
    while high < stop:
        space = np.flatnonzero(is_space(data[high : min(high + PIECE, stop)]))
        if len(space):
            return high + int(space[0])
        high = min(high + PIECE, stop)
    return stop


def _hashed(data: np.ndarray, bounds: np.ndarray, fold: bool, classes: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends) of the words of all texts."""
    if not _TABLES:
        _TABLES.extend((_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))))
    powers, inverse = _TABLES
    values = _VALUES[fold and classes is None]
    class_of = None if classes is None else np.frombuffer(classes, np.uint8)
    low, end = int(bounds[0]), int(bounds[-1])
    found = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    while low < end:
        high = _piece_end(data, bounds, low, end)
        piece = data[low:high]
        space = is_space(piece)
        edge = np.zeros(len(piece) + 1, bool)  # before each byte and at the end: whether a text begins or ends there
        edge[bounds[np.searchsorted(bounds, low) : np.searchsorted(bounds, high, "right")] - low] = True
        edge[0] = edge[-1] = True
        begins, last = edge[:-1].copy(), edge[1:].copy()
        begins[1:] |= space[:-1]
        begins &= ~space
        last[:-1] |= space[1:]
        first, last = np.flatnonzero(begins), np.flatnonzero(last & ~space) + 1
        if len(first):
            if len(piece) > PIECE:
                codes = np.zeros(len(first), np.uint64)  # every one of them is long
            elif class_of is None:
                sums = values[piece]
                sums *= powers[: len(piece)]
                np.cumsum(sums, out=sums)
                codes = np.diff(sums[last - 1], prepend=np.uint64(0)) * inverse[first]
            else:  # of each run of one class the first byte counts
                kinds = class_of[piece]
                counts = ~space
                counts[1:] &= begins[1:] | (kinds[1:] != kinds[:-1])
                place = np.cumsum(counts, dtype=np.int32) - 1
                at = np.flatnonzero(counts)
                sums = np.cumsum(values[kinds[at]] * powers[: len(at)], dtype=np.uint64)
                codes = np.diff(sums[place[last - 1]], prepend=np.uint64(0)) * inverse[place[first]]
            for i in np.flatnonzero(last - first >= LONG_WORD):
                codes[i] = _long_word(piece[first[i] : last[i]].tobytes(), fold, classes)
            found.append((mixed(codes), first + low, last + low))
        low = high
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _long_word(word: bytes, fold: bool, classes: bytes | None) -> int:
    import xxhash

    if classes is not None:
        word = collapsed(word, classes)
    return xxhash.xxh3_64_intdigest(word.lower() if fold and classes is None else word)


def collapsed(word: bytes, classes: bytes) -> bytes:
    """The classes of a word's bytes, runs of one class as one."""
    return _RUN.sub(rb"\1", word.translate(classes))


class Words:
    """The words of all texts of a column one after the other: their 64-bit hashes ``codes``, and how many each text has, ``counts``.

    Words are what stands between ASCII white space, with ``fold`` A-Z are lower-cased. A word's hash is the sum of
    its bytes' values times powers of their places; differences of one running sum give it for all words. With
    ``classes``, a class for each byte, hashes are those of the ``collapsed`` words (short ones and from ``LONG_WORD``
    bytes on hash alike only among themselves).
    """

    def __init__(self, column: pa.Array, fold: bool = True, classes: bytes | None = None):
        self._data, bounds = text_bytes(column)
        self._fold = fold
        self.codes, self._starts, self._ends = _hashed(self._data, bounds, fold, classes)
        self.counts = np.diff(np.searchsorted(self._starts, bounds))

    def endings(self) -> np.ndarray:
        """The last two bytes of each word as one number; of a word of one byte that byte."""
        last = self._data[self._ends - 1].astype(np.uint64)
        return last + np.where(self._ends - self._starts > 1, self._data[np.maximum(self._ends - 2, 0)].astype(np.uint64) << np.uint64(8), np.uint64(0))

    def spelled(self, at: np.ndarray) -> list[bytes]:
        """The words at these places."""
        text = memoryview(self._data)
        words = [bytes(text[a:b]) for a, b in zip(self._starts[at].tolist(), self._ends[at].tolist(), strict=True)]
        return [w.lower() for w in words] if self._fold else words

    def distinct(self, among: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray]:
        """(words, numbers): the distinct words, and which of them each word is; of the places ``among`` only, if given."""
        encoded = pa.array(self.codes if among is None else self.codes[among]).dictionary_encode()
        numbers, first = encoded.indices.to_numpy(), np.empty(len(encoded.dictionary), np.int64)
        first[numbers[::-1]] = np.arange(len(numbers))[::-1]
        return self.spelled(first if among is None else among[first]), numbers


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the words, A-Z lower-cased, of all texts."""
    words = Words(column)
    return words.codes, words.counts


def distinct_words(column: pa.Array, fold: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, numbers, counts): the distinct words of all texts, which of them each word is, and the number of words of each text.

    What is done for a word is then done once for all its places. With ``fold`` A-Z are lower-cased.
    """
    words = Words(column, fold)
    return *words.distinct(), words.counts


def parts_of(batches: Iterable[pa.RecordBatch], column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``size`` bytes of text in ``column``, so that what a task makes of one stays small; a longer text is a part of its own."""
    for batch in batches:
        _, bounds = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
