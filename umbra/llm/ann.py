"""Approximate nearest neighbours by cosine: one robust-pruned graph per shard, beam search for queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import join_by_group, staged
from umbra.llm.graph_index import NOBODY, beam_search, build, unit


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part: no null, zero or non-finite vector, and an id."""
    vec = F.col(embedding).cast("array<double>")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda v: v != 0)
    )


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """One row per different vector: rep (least id), vec, size (its rows), ids (the ``ids`` least ones, in order).

    More ids of one vector can never be among the nearest, so nothing is lost.
    """
    single = rows.groupBy("vec", "vec_id").agg(F.count("*").alias("rows"))
    sizes = rows.groupBy("vec").agg(F.count("*").alias("size"))
    least = single.withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("place") <= ids)
    listed = least.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return listed.join(sizes, "vec").select(F.get("ids", 0).alias("rep"), "vec", "ids", "size")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def graph_index(vectors: DataFrame, shard_rows: int = 16_384, degree: int = 32, beam: int = 64, alpha: float = 1.2) -> DataFrame:
    """(shard, node, rep, vec, edges, entry) for every row of ``vectors`` (rep, vec): all of them are indexed.

    A shard holds vectors of one length, dealt by a hash, about ``shard_rows`` of them. As every query
    is asked of every shard, shards should be as large as tasks can hold. Only the graph is built
    on numbers of 32 bits; the vectors keep theirs.
    """
    shards = max(1, -(-vectors.count() // shard_rows))

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        raw = _matrix(table.column("vec"))
        edges, entry = build(unit(raw), degree, beam, alpha)
        n = len(raw)
        return pa.table(
            {
                "shard": table.column("shard"), "node": pa.array(np.arange(n, dtype=np.int32)), "rep": table.column("rep"), "vec": table.column("vec"),
                "edges": pa.array([e[e != NOBODY] for e in edges.astype(np.int32)], pa.list_(pa.int32())), "entry": pa.array(np.full(n, entry, np.int32)),
            }
        )

    dealt = vectors.select(F.concat_ws("/", F.size("vec"), F.pmod(F.xxhash64("vec"), F.lit(shards))).alias("shard"), "rep", "vec")
    return dealt.groupBy("shard").applyInArrow(index, "shard string, node int, rep long, vec array<double>, edges array<int>, entry int")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = 320, block: int = 16_384) -> DataFrame:
    """(query, rep, score) for the ``k`` best of each shard for each row of ``queries`` (query, vec).

    Queries meet each shard of their length in blocks; score is the cosine in double precision.
    """
    blocks = max(1, -(-queries.count() // block))

    def find(key: tuple, nodes: pa.Table, asked: pa.Table) -> pa.Table:
        if not nodes.num_rows or not asked.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        nodes = nodes.sort_by("node")
        raw, reps = _matrix(nodes.column("vec")), nodes.column("rep").to_numpy()
        lists = nodes.column("edges").to_pylist()
        edges = np.full((len(raw), max(1, *map(len, lists))), NOBODY)
        for row, near in zip(edges, lists, strict=True):
            row[: len(near)] = near
        x, wanted, ids = unit(raw), _matrix(asked.column("vec")), asked.column("query").to_numpy()
        entry, found = nodes.column("entry")[0].as_py(), []
        for at in range(0, len(wanted), 256):
            some = wanted[at : at + 256]
            if len(raw) <= beam:
                met = np.tile(np.arange(len(raw)), (len(some), 1))
            else:
                met, _ = beam_search(x, edges, entry, unit(some), beam)
            there = met != NOBODY
            score = np.where(there, cosine(raw[met], some), -np.inf)
            order = np.lexsort((reps[met], -score))[:, :k]
            best, node = np.take_along_axis(score, order, 1), np.take_along_axis(met, order, 1)
            ok = np.isfinite(best)
            found.append((np.repeat(ids[at : at + 256], ok.sum(axis=1)), reps[node[ok]], best[ok]))
        query, rep, score = map(np.concatenate, zip(*found, strict=True))
        return pa.table({"query": query, "rep": rep, "score": score})

    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shards = index.select(F.col("shard").alias("to")).distinct()
    kind = F.split("to", "/")[0].cast("int")
    asked = queries.withColumn("asked_block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("length", F.size("vec"))
    asked = asked.join(F.broadcast(shards.withColumn("length", kind)), "length").drop("length")
    return spread.groupBy("shard", "block").cogroup(asked.groupBy("to", "asked_block")).applyInArrow(find, "query long, rep long, score double")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision of b [n, d] with each of a [n, m, d], every pair by the same sums."""
    a, b = a.astype(np.float64), b.astype(np.float64)[:, None, :]
    top = lambda z: np.abs(z).max(axis=-1, keepdims=True)
    a, b = a / top(a), b / top(b)
    return (a * b).sum(axis=-1) / np.sqrt((a * a).sum(axis=-1) * (b * b).sum(axis=-1))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", **options) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of every row whose id is divisible by ``every``.

    All other rows are candidates. Equal vectors are indexed and searched once and stand for all their
    ids; repeated rows (same id and vector) count once. Vectors that are null, zero, or hold a null or a
    non-finite component take no part, nor do rows without an id. Vectors of another length than the query's
    are no candidates. With fewer than ``k`` candidates all are returned. An empty table gives no rows;
    other columns are ignored.
    """
    rows = staged(usable(vectors, vec_id, embedding))
    groups = staged(distinct_vectors(rows, k + 1))
    total = rows.count()
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    asked = staged(join_by_group(asked, groups.select("vec", "rep", "size"), "vec", "size", total))
    queries = staged(groups.select(F.col("rep").alias("query"), "vec").join(asked.select(F.col("rep").alias("query")).distinct(), "query", "left_semi"))
    index = staged(graph_index(groups.select("rep", "vec"), **options))
    found = search(index, queries, k + 1)
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("place") <= k + 1)
    listed = best.join(groups.select("rep", F.explode("ids").alias("vec_id")), "rep")
    order = F.struct((-F.col("score")).alias("far"), "vec_id")
    lists = staged(listed.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k + 1).alias("near")))
    by_rep = lists.join(groups.select(F.col("rep").alias("query"), "size"), "query").withColumnRenamed("query", "rep")
    hits = join_by_group(asked.select(F.col("vec_id").alias("query_id"), "rep"), by_rep, "rep", "size", total)
    others = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    return hits.select("query_id", F.posexplode(others).alias("pos", "near")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"), (-F.col("near.far")).alias("score")
    )

