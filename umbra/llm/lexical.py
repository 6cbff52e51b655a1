"""Ranked lexical search: exact largest inner products of sparse integer vectors, on ball trees."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.ball_tree import BallTree, Best
from umbra.llm.common import arrow_batches, slices, staged, text_of, union_all

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all other characters, only A-Z lowered."""
    return text.translate(_PLAIN).split()


def _counted(docs: DataFrame, names: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of each document that holds one of ``names``, and for each task one row of ``whole``:
    n is the number of its documents that have a term, all_terms that of their terms, counts that of its documents for each name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = length = 0
        held = np.zeros(len(names), np.int64)
        for batch in slices(batches, 1024):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                number, length = number + 1, length + len(words)
                found = Counter(map(names.get, words))
                found.pop(None, None)
                if found:
                    held[list(found)] += 1
                    rows.append((doc_id, len(words), None, list(found), list(found.values()), False))
            yield _batch(rows)
        there = np.flatnonzero(held)
        yield _batch([(None, number, length, there.tolist(), held[there].tolist(), True)])

    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("all_terms", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("whole", pa.bool_())]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(fields)
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, all_terms long, terms array<int>, counts array<long>, whole boolean")


def _searched(counted: DataFrame, wanted: list[tuple[int, np.ndarray, np.ndarray]], number: int, length: int, inverse: np.ndarray, k: int, tree_rows: int, leaf: int) -> DataFrame:
    """(item, doc_id, score): the ``k`` best of every task for each of ``wanted`` (item, terms, weights).

    Components are a term's weight times its share in the document, so an item's vector is of ones; what was found in one tree prunes the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in wanted]
        for batch in slices(batches, tree_rows):
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            terms, counts = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum([len(x) for x in batch.column(2)])]).astype(np.int64)
            m = np.array([100 - 90 + (90 * x * number) // length for x in n.tolist()], np.int64)
            values = (1_000_000_000 * counts) // (1000 * counts + 8 * np.repeat(m, np.diff(starts))) * inverse[terms]
            tree = BallTree(starts, terms.astype(np.int64), values, leaf)
            for found, (_, names, _) in zip(best, wanted, strict=True):
                tree.search(names, np.ones(len(names), np.int64), ids, found)
        rows = [(item, doc_id, score) for found, (item, _, _) in zip(best, wanted, strict=True) for score, doc_id in found.rows()]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return counted.where("not whole").select("doc_id", "n", "terms", "counts").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = 1024, block_bytes: int = 8 << 20, tree_rows: int = 4096, leaf: int = 64) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` highest-scoring documents of each row of ``items`` (item_id, text).

    Items come in blocks of about ``block_items`` rows and ``block_bytes`` bytes; for each block all documents are read, their counts of
    the block's terms are staged, and every task searches trees of ``tree_rows`` documents one after the other. Only a
    block's own terms with their numbers of documents pass the driver, and a task gives at most ``k`` rows for each item.

    A null or empty text has no terms: such a document counts nowhere, such an item has no rows, as have items without a document
    that scores above 0. Equal scores are ranked by ascending doc_id, a null one last. Repeated rows of either table are rows of their
    own, empty tables give no rows, long texts take linear time, and other columns are ignored.
    """
    spark = docs.sparkSession
    items = staged(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), text_of().cast("binary").alias("text")))
    rows, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-rows // block_items), -(-(size or 0) // block_bytes))
    parts = []
    for block in range(blocks):
        some = [(r["item"], sorted(set(terms_of(bytes(r["text"]))))) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()]
        names = {name: i for i, name in enumerate(sorted({t for _, terms in some for t in terms}))}
        with arrow_batches(spark, 4096, 8 << 20):
            counted = staged(_counted(docs, names))
        whole = counted.where("whole")
        number, length = whole.agg(F.sum("n"), F.sum("all_terms")).first()
        held = np.zeros(len(names), np.int64)
        for term, count in whole.select(F.explode(F.arrays_zip("terms", "counts")).alias("e")).groupBy("e.terms").agg(F.sum("e.counts")).collect():
            held[term] = count
        inverse = np.array([math.floor(1000 * math.log((2 * (number or 0) + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
        wanted = [(item, np.array([names[t] for t in terms], np.int64), None) for item, terms in some]
        with arrow_batches(spark, tree_rows, 64 << 20):
            parts.append(staged(_searched(counted, wanted, number or 0, length or 1, inverse, k, tree_rows, leaf)))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = union_all(parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RESULT_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents WHERE text IS NOT NULL
), lengths AS (
  SELECT doc_id, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY doc_id
), whole AS (
  SELECT CAST(count(*) AS HUGEINT) AS documents, CAST(sum(n) AS HUGEINT) AS all_terms FROM lengths
), asked AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE text IS NOT NULL)
), counts AS (
  SELECT doc_id, term, CAST(count(*) AS HUGEINT) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * documents + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS HUGEINT) AS w
  FROM (SELECT term, CAST(count(*) AS HUGEINT) AS df FROM counts GROUP BY term), whole
), parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // all_terms))) AS part
  FROM counts JOIN lengths USING (doc_id) JOIN weights USING (term), whole
), scored AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
