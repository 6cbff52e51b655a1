"""Bounded-space online packing of token ids into sequences of a fixed length.

Every partition keeps ``windows`` open sequences. A piece goes where it fits best; when it fits
nowhere, the fullest window is topped up with the head of the piece (if the gap is worth a cut) and
emitted. The windows that stay open are merged in a tree of groups of ``fan_in`` partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import staged, text_of, union_all
from umbra.llm.subwords import packed_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, part long, ids binary"
_COLUMNS = [c.split()[0] for c in PIECES.split(", ")]


@dataclass
class Window:
    used: int = 0
    pieces: list[tuple] = field(default_factory=list)  # doc_id, start, ids, doc_tokens


class Packer:
    """The open windows of one partition; ``out`` takes every window as it is emitted."""

    def __init__(self, size: int, windows: int, min_cut: int, out):
        self.size, self.windows, self.min_cut, self.out = size, windows, min_cut, out
        self.gaps: list[tuple[int, int]] = []  # (free tokens, serial) of the open windows, in order
        self.open: dict[int, Window] = {}
        self.serial = 0

    def document(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        for start in range(0, total, self.size):
            self.piece(doc_id, start, ids[4 * start : 4 * (start + self.size)], total)

    def piece(self, doc_id, start: int, ids: bytes, total: int) -> None:
        while ids:
            length = len(ids) // 4
            at = bisect_left(self.gaps, (length, -1))
            if at < len(self.gaps):
                gap, serial = self.gaps.pop(at)
            elif len(self.open) < self.windows:
                gap, serial = self.size, self._new()
            else:  # it fits nowhere: the fullest goes, topped up if that is worth a cut
                gap, serial = self.gaps.pop(0)
                if gap < self.min_cut:
                    self.out(self.open.pop(serial))
                    continue
            taken = min(gap, length)
            window = self.open[serial]
            window.pieces.append((doc_id, start, ids[: 4 * taken], total))
            window.used += taken
            if window.used == self.size:
                self.out(self.open.pop(serial))
            else:
                insort(self.gaps, (self.size - window.used, serial))
            start, ids = start + taken, ids[4 * taken :]

    def _new(self) -> int:
        self.serial += 1
        self.open[self.serial] = Window()
        return self.serial


class _Rows:
    """Rows of emitted windows; ids of open ones stay with them, as a later round may cut them."""

    def __init__(self, level: int, part: int, with_ids: bool):
        self.base, self.part, self.with_ids, self.count = (level << 56) | (part << 28), part, with_ids, 0
        self.rows: list[tuple] = []

    def add(self, window: Window, is_open: bool = False) -> None:
        offset, sequence = 0, self.base + self.count
        self.count += 1
        for doc_id, start, ids, total in window.pieces:
            length = len(ids) // 4
            kept = ids if is_open or self.with_ids else None
            self.rows.append((doc_id, start, length, zlib.crc32(ids), total, sequence, offset, is_open, self.part, kept))
            offset += length

    def take(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=_COLUMNS)
        out["doc_id"] = out["doc_id"].astype("Int64")
        self.rows = []
        return out


_ARROW = pa.schema(
    [(c, pa.bool_() if c == "open" else pa.binary() if c == "ids" else pa.int64()) for c in _COLUMNS]
)


def pack(
    docs: DataFrame,
    size: int = 1024,
    windows: int = 64,
    min_cut: int = 16,
    fan_in: int = 8,
    end_id: int = 0,
    with_ids: bool = False,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per piece of a document in a sequence; ``with_ids`` adds the piece's ids (little-endian u32).

    Every document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Each id lies in
    exactly one piece. Repeated rows are documents of their own, an empty table gives no rows, and
    other columns are ignored.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = packed_encoder(vocabulary), int(end_id).to_bytes(4, "little")
        rows = _Rows(0, TaskContext.get().partitionId(), with_ids)
        packer = Packer(size, windows, min_cut, rows.add)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.document(doc_id, encode(text) + end)
            if len(rows.rows) >= 2000:
                yield pa.RecordBatch.from_pandas(rows.take(), _ARROW, preserve_index=False)
        for window in packer.open.values():
            rows.add(window, True)
        yield pa.RecordBatch.from_pandas(rows.take(), _ARROW, preserve_index=False)

    def merge(level: int, last: bool):
        def group(pieces: pd.DataFrame) -> pd.DataFrame:
            rows = _Rows(level, int(pieces["part"].iloc[0]), with_ids)
            packer = Packer(size, windows, min_cut, rows.add)
            pieces = pieces.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])
            for piece in pieces.itertuples(index=False):
                doc_id = None if pd.isna(piece.doc_id) else int(piece.doc_id)
                packer.piece(doc_id, int(piece.start), bytes(piece.ids), int(piece.doc_tokens))
            for window in packer.open.values():
                rows.add(window, not last)
            return rows.take()

        return group

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    packed = staged(source.mapInArrow(first, PIECES))
    done, left = [packed.where("not open")], packed.where("open")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    level = 1
    while True:
        last = parts <= fan_in
        grouped = left.withColumn("part", F.floor(F.col("part") / fan_in).cast("long"))
        merged = staged(grouped.groupBy("part").applyInPandas(merge(level, last), PIECES))
        done.append(merged.where("not open"))
        if last:
            break
        left, parts, level = merged.where("open"), -(-parts // fan_in), level + 1
    return union_all(done).drop("open", "part", *([] if with_ids else ["ids"]))


def padding(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """One row: sequences, tokens, and the share of padding; a sequence as long as a power of two needs none."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.lit(2).cast("long")
    padded = F.when(F.pow(power, F.round(F.log2("used"))) == F.col("used"), F.col("used")).otherwise(F.lit(size))
    return used.agg(
        F.count("*").alias("sequences"),
        F.sum("used").alias("tokens"),
        (1 - F.try_divide(F.sum("used"), F.sum(padded))).alias("padding"),
    )
