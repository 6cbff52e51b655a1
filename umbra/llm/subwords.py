"""Byte-level BPE ids of whole texts, fast enough for a per-partition pass."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Sequence

import numpy as np

from umbra.llm.common import Cache

#: White space, a space, then white space or the end: only there does cutting before every space change the pieces.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: White space other than the space.
_OTHER_SPACE = re.compile(r"[^\S ]")
#: The string that the tokenizer turns into an id of its own wherever it stands in a text (fixed values).
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50_256


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks_of(path: str | None = None) -> dict[bytes, int]:
    with open(path or vocabulary_file(), "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def encoder(path: str | None = None, ranks: dict[bytes, int] | None = None) -> Callable[[str], list[int]]:
    """text -> ids by the ranks of ``path``. Strings of special tokens in a text are ordinary text."""
    import public_tokenizers
    import tiktoken

    ranks = ranks or ranks_of(path)
    return tiktoken.Encoding(
        "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


def packed_encoder(path: str | None = None) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit numbers; ``SPECIAL`` in a text is one id.

    The pre-tokenizer never joins a space to what stands before it, so a text may be cut before every
    space and each piece be looked up; texts with runs of white space are encoded as they are.
    """
    encode = encoder(path)
    special = array("I", [SPECIAL_ID]).tobytes()

    def pack(text: str) -> bytes:
        return array("I", encode(text)).tobytes()

    pieces = Cache(pack)

    def whole(text: str) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            return special.join([whole(part) for part in text.split(SPECIAL)])
        if _UNSAFE.search(text):
            return pack(text)
        first, *rest = text.split(" ")
        return (pack(first) if first else b"") + b"".join([pieces[" " + x] for x in rest])

    return whole


def words_encoder(path: str | None = None) -> Callable[[Sequence[bytes]], tuple[np.ndarray, np.ndarray]]:
    """words without ASCII white space -> (ids of all, number of ids of each), each word with a space before it.

    All words are encoded in one call: a space always starts a piece, so the ids that start with one show
    where words begin. Words that hold other white space, to which a space may be joined, are encoded one by one.
    """
    ranks = ranks_of(path)
    encode = encoder(path, ranks)
    starts = np.zeros(max(ranks.values()) + 1, bool)
    starts[[rank for piece, rank in ranks.items() if piece.startswith(b" ")]] = True

    def each(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        text = (b" " + b" ".join(words)).decode("utf-8", "replace")
        if _OTHER_SPACE.search(text):
            return one_by_one(words)
        ids = np.array(encode(text), np.int64)
        lengths = np.diff(np.flatnonzero(np.append(starts[ids], True)))
        if len(lengths) != len(words):
            raise AssertionError(f"{len(words)} words gave {len(lengths)} runs of ids")
        return ids, lengths

    def one_by_one(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for a few words at a time, so that only those next to an odd word are encoded alone."""
        if len(words) == 1:
            ids = np.array(encode(" " + words[0].decode("utf-8", "replace")), np.int64)
            return ids, np.array([len(ids)])
        half = len(words) // 2
        parts = each(words[:half]), each(words[half:])
        return tuple(np.concatenate([p[i] for p in parts]) for i in (0, 1))

    return each
