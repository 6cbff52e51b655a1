"""Hard negatives: rows of other labels that score just below an anchor's positives, found on packed R-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import arrow_batches, staged, union_all
from umbra.llm.rtree import NO_ID, NONE, RTree, Search


def usable(vectors: DataFrame, scale: int = 256, relabel_every: int = 7, labels: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(row, vec_id, label, vec) of the different rows that take part; components are floor(scale * x), still as doubles.

    Where the id is divisible by ``relabel_every`` the label is the next one of ``labels``.
    """
    vec = F.col(embedding).cast("array<double>")
    whole = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    id_, own = F.col(vec_id).cast("long"), F.col(label).cast("long")
    rows = vectors.select(id_.alias("vec_id"), F.when(id_ % relabel_every == 0, (own + 1) % labels).otherwise(own).alias("label"), vec.alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & whole).distinct()
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("vec", lambda v: _floor(v * scale)).alias("vec"))


def _floor(x):
    """floor() for doubles of any size: those beyond 2**52 have no fraction."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _matrix(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    return rows.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def best_in_windows(index: DataFrame, queries: DataFrame, k: int, same: bool, shards: int = 32, page: int = 4096, leaf: int = 64, wave: int = 16_384) -> DataFrame:
    """(query, window, vec_id, score): for each row of ``queries`` (row, vec_id, label, vec, low, high) and each of its windows
    (arrays low and high, both ends inside) the ``k`` best rows of every shard of ``index`` (row, vec_id, label, vec).

    ``index`` is dealt to ``shards`` by a hash. A task meets the queries first, then the shard's rows by label and first component
    in pages of ``page`` rows with a tree each, so it holds the queries and one page. Beyond ``wave`` queries the index is passed again.
    The number of shards does not grow with the data, so neither do the rows that a query gives.
    """
    total = queries.count()
    waves = max(1, -(-total // wave))
    dealt = index.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), "row", "vec_id", "label", "vec")
    dealt = dealt.withColumn("low", F.lit(None).cast("array<long>")).withColumn("high", F.lit(None).cast("array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[pa.Table] = []
        waiting: list[pa.Table] = []
        search: Search | None = None
        at: tuple | None = None

        def searched() -> None:
            nonlocal search, waiting
            if waiting and asked:
                rows, some = pa.concat_tables(waiting), pa.concat_tables(asked)
                if search is None:
                    bounds = [np.stack([np.array(x) for x in some.column(c).to_pylist()]).astype(np.int64) for c in ("low", "high")]
                    search = Search(_matrix(some.column("vec"), at[1]), some.column("label").to_numpy(), some.column("vec_id").to_numpy(), *bounds, k, same)
                search.page(RTree(_matrix(rows.column("vec"), at[1]), rows.column("label").to_numpy(), rows.column("vec_id").to_numpy(), leaf))
            waiting = []

        def result() -> pa.RecordBatch:
            nonlocal search
            columns = [np.empty(0, np.int64)] * 4
            if search is not None:
                query, window, place = np.nonzero(search.score != NONE)
                rows = pa.concat_tables(asked).column("row").to_numpy()
                columns = [rows[query], window, search.found[query, window, place], search.score[query, window, place]]
            search = None
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["query", "window", "vec_id", "score"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            shard, kind, length = (table.column(c).to_numpy() for c in ("shard", "kind", "length"))
            cuts = np.flatnonzero(np.diff(shard) | np.diff(length) | np.diff(kind)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(table)], strict=True):
                if last == first:
                    continue
                if at != (shard[first], length[first]):
                    searched()
                    yield result()
                    at, asked = (shard[first], length[first]), []
                part = table.slice(first, last - first)
                if kind[first] == 0:
                    asked.append(part)
                    continue
                while part.num_rows:
                    room = page - sum(t.num_rows for t in waiting)
                    waiting.append(part.slice(0, room))
                    part = part.slice(room)
                    if sum(t.num_rows for t in waiting) == page:
                        searched()
        searched()
        yield result()

    found = []
    for turn in range(waves):
        some = queries.where(F.pmod(F.xxhash64("row"), F.lit(waves)) == turn) if waves > 1 else queries
        sent = some.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("kind"), "row", "vec_id", "label", "vec", "low", "high")
        both = sent.unionByName(dealt).withColumn("length", F.size("vec"))
        both = both.repartition(shards, "shard").sortWithinPartitions("shard", "length", "kind", "label", F.get("vec", F.lit(0)))
        with arrow_batches(index.sparkSession, page, 16 << 20):
            found.append(staged(both.mapInArrow(run, "query long, window long, vec_id long, score long")))
    return union_all(found)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """One row per key: ``best``, the first ``k`` (far, vec_id) of all shards in order; far is the score, negated."""
    return found.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, low: int = 50, high: int = 95, usable_options: dict | None = None, **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; a row's score is its inner product with the anchor in whole numbers. The
    first ``positives`` other rows of the anchor's label are its positives; for each of them come the first ``negatives`` rows of other
    labels with low % to high % of its score. Higher scores first, ties by smaller id.

    Rows with a null label, id or vector, without components, or with a null or non-finite one take no part. Equal rows count once;
    rows with the anchor's id are never its positives or negatives. Only vectors of the anchor's length are met. Sums beyond 64 bits count as
    the largest there is. A positive below 0 has no window and no rows. Empty tables give no rows; other columns are ignored.
    """
    rows = staged(usable(vectors, **(usable_options or {})))
    anchors = staged(rows.where(F.col("vec_id") % every == 0))
    anywhere = {"low": F.array(F.lit(NONE + 1)), "high": F.array(F.lit(NO_ID - 1))}
    near = best_in_windows(rows, anchors.withColumns(anywhere), positives, True, **options)
    listed = _best(near, ["query"], positives).withColumnRenamed("query", "row")
    score = lambda p: -p["far"]
    half = lambda p: F.coalesce(F.ceil(F.try_multiply(score(p), F.lit(low)).cast("decimal(20,0)") / 100).cast("long"), F.lit(NO_ID))
    most = lambda p: F.coalesce(F.floor(F.try_multiply(score(p), F.lit(high)).cast("decimal(20,0)") / 100).cast("long"), F.lit(NONE + 1))
    asked = staged(
        anchors.join(listed, "row")
        .withColumn("low", F.transform("best", half))
        .withColumn("high", F.transform("best", most))
        .withColumn("windows", F.size("best"))
    )
    # Queries of one task have the same number of windows; missing ones are empty.
    empty = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.lit(positives) - F.col("windows")))
    queries = asked.withColumn("low", empty("low", NO_ID)).withColumn("high", empty("high", NONE + 1))
    far = best_in_windows(rows, queries, negatives, False, **options)
    hits = _best(far, ["query", "window"], negatives).withColumnRenamed("query", "row")
    return hits.join(asked.select("row", F.col("vec_id").alias("anchor_id"), F.col("best").alias("positive")), "row").select(
        "anchor_id", F.get("positive", F.col("window").cast("int")).alias("p"), F.posexplode("best").alias("pos", "n")
    ).select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"),
        (-F.col("p.far")).alias("positive_score"), (-F.col("n.far")).alias("negative_score"),
    )


RESULT_SQL = """
WITH r AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
