"""Merge-type subword pieces: encoding by a table of prefixes, decoding by a table of pieces.

A text is normalised (a space in front, every space as ``META``) and cut where no piece can reach across. For
every prefix of such a part, one piece is the last of its encoding: of the pieces that an automaton finds to end there, the one
that is compatible with the last piece of the prefix before it. Two pieces are compatible when merging
their characters gives just these two. The ids are then read off backwards. The work is linear in the length of the
text, whatever it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import Cache, slices, text_of
from umbra.llm.prefix_table import PrefixTable

#: Stands for a space inside pieces.
META = "▁"

#: Beyond every id: a character that is no piece is the token ``_CHARACTER`` + its code point.
_CHARACTER = 1 << 22
_SHIFT = 23


class Pieces:
    """The pieces of a model of the merge type. It must keep texts as they are (no normalisation but spaces)."""

    def __init__(self, model: str | None = None):
        import public_tokenizers
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
        count = source.get_piece_size()
        self.begin, self.end, self.unknown = source.bos_id(), source.eos_id(), source.unk_id()
        self.names = [source.id_to_piece(i) for i in range(count)]
        self.control = np.array([source.is_control(i) for i in range(count)])
        self.byte = np.array([source.is_byte(i) for i in range(count)])
        self.ids = {name: i for i, name in enumerate(self.names) if not (self.control[i] or self.byte[i] or i == self.unknown)}
        self.scores = {name: source.get_score(i) for name, i in self.ids.items()}
        self.byte_ids = {int(self.names[i][1:-1], 16): i for i in np.flatnonzero(self.byte)}
        self.lengths = [len(name) for name in self.names]
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.parts = re.compile(self._cuts()).findall
        self.compatible: dict[int, bool] = Cache(self._compatible, 1_000_000)
        self.table = PrefixTable(self.ids, self._compatible, _SHIFT)
        self.packed: dict[str, bytes] = Cache(self._packed, 200_000)
        # What a piece gives when decoded; bytes of control pieces are none.
        self.surface = [
            b"" if self.control[i] else bytes([int(name[1:-1], 16)]) if self.byte[i] else " ⁇ ".encode() if i == self.unknown else name.replace(META, " ").encode()
            for i, name in enumerate(self.names)
        ]

    def _cuts(self) -> str:
        """A pattern of the parts of a text: no piece reaches from one into the next.

        Parts end before a space that follows something else, if no piece has a space inside, and around
        characters of ASCII that no piece holds.
        """
        held = set("".join(self.ids))
        strange = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in held)
        if any(META in name.lstrip(META) for name in self.ids):
            return f"[^{strange}]+|[{strange}]" if strange else "(?s:.+)"
        return f"{META}*[^{META}{strange}]+|{META}+" + (f"|[{strange}]" if strange else "")

    def merged(self, text: str) -> list[str]:
        """The definition: of all neighbours that make a piece, those of the best score are merged first, from the left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _name(self, token: int) -> str:
        return chr(token - _CHARACTER) if token >= _CHARACTER else self.names[token]

    def _compatible(self, pair: int) -> bool:
        """Of (piece before, or 0 at the start; piece), packed in one number."""
        before, token = pair >> _SHIFT, pair & ((1 << _SHIFT) - 1)
        wanted = [self._name(before)] if before else []
        wanted.append(self._name(token))
        return self.merged("".join(wanted)) == wanted

    def tokens(self, part: str) -> list[int]:
        """The pieces of a part of a normalised text."""
        lengths, compatible, size = self.lengths, self.compatible, len(part)
        last, filled = [0] * (size + 1), 0  # last[i]: last piece of the first i characters

        def alone(upto: int) -> None:
            for i in range(filled + 1, upto + 1):
                if not last[i]:
                    last[i] = _CHARACTER + ord(part[i - 1])

        for end, token in self.automaton.iter(part):  # by their ends, the longest first
            end += 1
            if last[end]:
                continue
            if filled < end - 1:
                alone(end - 1)
                filled = end - 1
            if compatible[last[end - lengths[token]] << _SHIFT | token]:
                last[end] = token
        alone(size)
        found = []
        while size:
            token = last[size]
            found.append(token)
            size -= 1 if token >= _CHARACTER else lengths[token]
        return found[::-1]

    def _packed(self, part: str) -> bytes:
        ids: list[int] = []
        for token in self.tokens(part):
            if token < _CHARACTER:
                ids.append(token)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in chr(token - _CHARACTER).encode()]
            else:
                ids.append(self.unknown)
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text the ids with those of begin and end, each as four bytes, the lowest first.

        Parts not met before are split together; long or strange ones by themselves.
        """
        parts = [self.parts(META + t.replace(" ", META)) if t else [] for t in texts]
        distinct = set().union(*parts)
        new = [p for p in distinct if p not in self.packed and p not in self.packed.old and self.table.takes(p)]
        ids, counts = self.table.split(new)
        flat, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        known = {p: flat[at:end] for p, at, end in zip(new, [0, *ends], ends, strict=False)}
        for part in distinct.difference(new):
            known[part] = self.packed[part] if len(part) <= self.table.longest else self._packed(part)
        for part in new:
            self.packed.put(part, known[part])
        begin, end = self.begin.to_bytes(4, "little"), self.end.to_bytes(4, "little")
        return [b"".join([begin, *map(known.__getitem__, some), end]) for some in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces in a row, without the space in front; bytes that are no character each give U+FFFD."""
        numbers = np.frombuffer(ids, "<u4")
        numbers = numbers[~self.control[numbers]]
        joined = b"".join(map(self.surface.__getitem__, numbers.tolist()))
        if len(numbers) and self.names[numbers[0]].startswith(META):
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return "".join(self._broken(numbers))

    def _broken(self, numbers: np.ndarray) -> Iterator[str]:
        """Each run of bytes by itself: characters where they are whole, else one U+FFFD for each byte."""
        first, run = True, b""
        for number in [*numbers.tolist(), None]:
            if number is not None and self.byte[number]:
                run += self.surface[number]
                continue
            while run:
                size = next((k for k in range(1, min(4, len(run)) + 1) if _is_character(run[:k])), 0)
                yield run[:size].decode() if size else "�"
                run, first = run[size or 1 :], False
            if number is not None:
                text = self.surface[number].decode()
                yield text[1:] if first and self.names[number].startswith(META) else text
                first = False


def _is_character(some: bytes) -> bool:
    try:
        return len(some.decode()) == 1
    except UnicodeDecodeError:
        return False


def in_task(model: str | None) -> Pieces:
    """For tasks only: one for each worker process, with what it has learnt. The class keeps it, as it is the same one for all tasks of a worker."""
    kept = Pieces.__dict__.get("kept")
    if kept is None or kept[0] != model:
        Pieces.kept = kept = (model, Pieces(model))
    return kept[1]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every whole text with begin and end, as little-endian unsigned numbers of 32 bits.

    A null text is empty and has begin and end alone. A repeated row is encoded again, an empty table gives no
    rows, long texts take linear time, and other columns are ignored. Rows stay where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = in_task(model).encode
        for batch in slices(batches, 256):
            yield pa.record_batch([batch.column(0), pa.array(encoded(batch.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(rows: DataFrame, ids: str = "ids", into: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ``ids``, ``into``): the text of the ids of each row; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = in_task(model).decode
        for batch in slices(batches, 256):
            yield pa.record_batch([*batch.columns, pa.array([decoded(i or b"") for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", ids, into])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), ids).mapInArrow(run, f"doc_id long, `{ids}` binary, `{into}` string")


def result(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded."""
    return decode(encode(docs, model), model=model).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
