"""Prefix tables of many words at once, in numpy: an automaton as one array, steps over positions."""

from __future__ import annotations

from collections import Counter

import numpy as np


class PairTable:
    """Which pairs of pieces are compatible, remembered in an open table; beyond half of it, it begins anew."""

    def __init__(self, compatible, bits: int = 21):
        self.compatible, self.bits = compatible, bits
        self._clear()

    def _clear(self) -> None:
        self.slots, self.used = np.full(1 << self.bits, -1), 0

    def _slot(self, pair):
        return (pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, pair: np.ndarray) -> np.ndarray:
        """A boolean for each pair of the array."""
        found, open_, at = np.zeros(len(pair), bool), np.arange(len(pair)), self._slot(pair.astype(np.uint64))
        missing = []
        while len(open_):
            there = self.slots[at]
            same = there >> 1 == pair[open_]
            found[open_[same]] = there[same] & 1
            missing.append(open_[there == -1])
            on = ~same & (there != -1)
            open_, at = open_[on], (at[on] + 1) & ((1 << self.bits) - 1)
        if len(missing := np.concatenate([np.empty(0, np.int64), *missing])):
            new, back = np.unique(pair[missing], return_inverse=True)
            fits = np.array([self.compatible(p) for p in new.tolist()])
            found[missing] = fits[back]
            if self.used + len(new) > 1 << (self.bits - 1):
                self._clear()
            if len(new) <= 1 << (self.bits - 1):
                for p, start, ok in zip(new.tolist(), self._slot(new.astype(np.uint64)).tolist(), fits.tolist(), strict=True):
                    while self.slots[start] != -1:
                        start = (start + 1) & ((1 << self.bits) - 1)
                    self.slots[start] = p << 1 | ok
                self.used += len(new)
        return found


class PrefixTable:
    """Splits words of at most ``longest`` characters whose characters are all among the ``classes`` most used by pieces.

    ``ids`` gives the id of every piece; ``compatible`` answers for (piece before or 0) * 2**shift + piece.
    """

    def __init__(self, ids: dict[str, int], compatible, shift: int, classes: int = 160, longest: int = 48):
        self.shift, self.longest, self.pairs = shift, longest, PairTable(compatible)
        known = [c for c, _ in Counter("".join(ids)).most_common() if c in ids][:classes]
        self.known = frozenset(known)
        self.kind = np.zeros(0x110000, np.uint8)
        self.kind[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.lengths = np.zeros(max(ids.values()) + 1, np.int64)
        self._automaton({name: i for name, i in ids.items() if self.known.issuperset(name)}, len(known) + 1)

    def _automaton(self, ids: dict[str, int], width: int) -> None:
        children: list[dict[int, int]] = [{}]
        piece, depth = [0], [0]
        for name, i in ids.items():
            self.lengths[i], at = len(name), 0
            for c in name:
                kind = int(self.kind[ord(c)])
                if kind not in children[at]:
                    children[at][kind] = len(children)
                    children.append({})
                    piece.append(0)
                    depth.append(depth[at] + 1)
                at = children[at][kind]
            piece[at] = i
        self.next = np.zeros((len(children), width), np.int32)
        self.piece, shorter = np.array(piece), np.zeros(len(children), np.int64)
        fail = np.zeros(len(children), np.int64)
        for state in np.argsort(depth, kind="stable").tolist():  # a state after all shorter ones
            row = self.next[fail[state]] if state else np.zeros(width, np.int32)
            for kind, child in children[state].items():
                fail[child] = row[kind] if state else 0
            self.next[state] = row
            for kind, child in children[state].items():
                self.next[state, kind] = child
            if state:
                shorter[state] = fail[state] if self.piece[fail[state]] else shorter[fail[state]]
        self.shorter = shorter

    def takes(self, word: str) -> bool:
        return len(word) <= self.longest and self.known.issuperset(word)

    def split(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        codes = self.kind[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        start, longest = (np.cumsum(size) - size)[order], int(size.max(initial=0))
        active = np.searchsorted(-size[order], -np.arange(1, longest + 1), side="right")
        last = np.zeros((longest + 1, len(words)), np.int32)
        state = np.zeros(len(words), np.int64)
        for i, n in enumerate(active.tolist(), 1):
            state[:n] = self.next[state[:n], codes[start[:n] + i - 1]]
            word, at = np.arange(n), state[:n].copy()
            at = np.where(self.piece[at] > 0, at, self.shorter[at])
            while len(word):  # the longest first; one of them always fits
                token = self.piece[at]
                fits = self.pairs((last[i - self.lengths[token], word].astype(np.int64) << self.shift) | token)
                last[i, word[fits]] = token[fits]
                word, at = word[~fits], self.shorter[at[~fits]]
                if not at.all():
                    raise ValueError("a prefix without a last piece")
        back, places, place = [], [], size[order].copy()
        word = np.arange(len(words))
        while len(word):
            token = last[place[word], word]
            back.append(token)
            places.append(word)
            place[word] -= self.lengths[token]
            word = word[place[word] > 0]
        if not back:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        where, step = np.concatenate(places), np.repeat(np.arange(len(back)), [len(p) for p in places])
        by = np.lexsort((-step, order[where]))
        return np.concatenate(back)[by], np.bincount(order[where], minlength=len(words))
