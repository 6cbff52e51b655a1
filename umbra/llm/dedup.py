"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import WHITE_SPACE, join_by_group, staged, text_of, without


def normalised(text: Column) -> Column:
    """The text without ASCII white space; texts are equal when this is."""
    return F.translate(text, WHITE_SPACE, "")


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of this row), digest (SHA-256 of the normalised text), check (another hash of it), norm_chars, chars."""
    text = text_of()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
        F.xxhash64(normalised(text)).alias("check"),
        F.length(normalised(text)).alias("norm_chars"),
        F.length(text).alias("chars"),
    )


def merge_tree(digests: DataFrame, runs: int = 512, fan_in: int = 2) -> DataFrame:
    """One row per digest: the row that stays and the size of its group.

    The rows are dealt into ``runs`` runs by a hash of the row, so the copies of one text lie in all of them. In
    each round runs exchange their rows with ``fan_in`` - 1 others (with one, as in a binomial tree): Spark brings rows
    of one digest and merged run together and sorts them (aggregates over structs are sort-based), and a single
    row of each digest stays. So no task sees more than ``fan_in`` rows of one digest, however large its group.
    A group is one digest, one other hash *and* one length of the normalised text: at every level these
    verify that the digest is of one text.
    """
    best = F.struct(
        (-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"
    )
    level = digests.select(
        F.pmod(F.xxhash64("row"), F.lit(runs)).cast("int").alias("run"),
        "digest", "check", "norm_chars", best.alias("best"), F.lit(1).cast("long").alias("size"),
    )
    while True:
        level = level.groupBy("run", "digest", "check", "norm_chars").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        if runs == 1:
            break
        runs = -(-runs // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
    return level.select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "size"
    )


def exact_groups(docs: DataFrame, runs: int = 512, fan_in: int = 2) -> DataFrame:
    """One row per input row: doc_id, row, digest, keep_id, size, kept.

    Of equal texts the longest original stays, then the smallest doc_id (null last), then one row of
    equal rows. Null texts count as empty, and all texts of white space only form one group. An empty
    table gives an empty result; columns other than doc_id and text are ignored.
    """
    digests = staged(digest_rows(docs))
    groups = staged(merge_tree(digests, runs, fan_in))
    rows = join_by_group(digests, groups, "digest", "size", digests.count())
    return rows.withColumn("kept", F.col("row") == F.col("keep_row"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without exact copies, all columns kept.

    doc_id names a row unless rows repeat; then equal (doc_id, text) rows are made one first.
    """
    groups = staged(exact_groups(docs).select("doc_id", "digest", "kept"))
    keys = ["doc_id", "digest"]
    by_key = groups.groupBy(*keys).agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    dropped = staged(by_key.where(~F.col("kept")).select(F.col("doc_id"), F.col("digest").alias("_digest")))
    out = without(docs.withColumn("_digest", F.unhex(F.sha2(normalised(text_of()), 256))), dropped, ["doc_id", "_digest"])
    if by_key.where("kept and rows > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "_digest"])
    return out.drop("_digest")


def result(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


RESULT_SQL = r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
    FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
