"""Mixing by iterative proportional fitting: token weights are raked to source, language and topic marginals."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import Cache, staged, text_of
from umbra.llm.hashing import distinct_words, parts_of

DIMENSIONS = ("source", "lang", "topic")
#: Target shares are observed ones to this power, made to sum to one: below 1 it lifts what is rare.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.5}
NONE = "(none)"
#: Up to so many cells one task fits them all: they are rows of a few numbers, not documents. More are fitted by joins, with the same result.
FEW_CELLS = 50_000


def topic_and_tokens(text: Column, topics: int = 8, lexicon: Mapping[str, int] | None = None, least_letters: int = 6) -> Column:
    """A struct of ``topic``, the topic with the most words of the text, ties to the first, null without any, and ``tokens``, its words.

    ``lexicon`` maps lower-cased words to topics. The tables at hand carry none, so by default every word
    of ``least_letters`` bytes or more belongs to the topic that its hash names.
    """
    words = None if lexicon is None else {w.encode(): t for w, t in lexicon.items()}

    def place(word: bytes) -> int:
        """Its topic, or the place behind all topics."""
        bare = word.strip(b".,;:!?")
        if words is not None:
            return words.get(bare, topics)
        return zlib.crc32(bare) % topics if len(bare) >= least_letters else topics

    @F.arrow_udf("struct<topic:int,tokens:bigint>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = Cache(place)
        for batch in batches:
            out = [pa.array([], pa.struct([("topic", pa.int32()), ("tokens", pa.int64())]))]
            for part in parts_of([pa.RecordBatch.from_arrays([batch], names=["text"])], 0):
                tokens, numbers, sizes = distinct_words(part.column(0))
                cells = np.repeat(np.arange(len(sizes)) * (topics + 1), sizes) + np.array([places[t] for t in tokens], np.int64)[numbers]
                hits = np.bincount(cells, minlength=len(sizes) * (topics + 1)).reshape(len(sizes), -1)[:, :topics]
                best = pa.array(hits.argmax(axis=1).astype(np.int32), mask=~hits.any(axis=1))
                out.append(pa.StructArray.from_arrays([best, pa.array(sizes.astype(np.int64))], names=["topic", "tokens"]))
            yield pa.concat_arrays(out)

    return found(text)


def targets(cells: DataFrame, dimension: str, wanted: Mapping[str, float] | float) -> DataFrame:
    """(value, target tokens) of one dimension: given shares, or observed ones to a power.

    Shares that are given need not sum to one; values they do not name get nothing.
    """
    seen = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("seen"))
    if isinstance(wanted, Mapping):
        pairs = [F.lit(x) for pair in wanted.items() for x in pair]
        share = F.coalesce(F.element_at(F.create_map(*pairs), F.col(dimension)), F.lit(0.0)) if pairs else F.lit(0.0)
    else:
        share = F.pow("seen", F.lit(float(wanted)))
    raw = seen.select(dimension, "seen", share.alias("share"))
    sums = raw.agg(F.sum("seen").alias("all"), F.sum("share").alias("shares")).first()
    scale = (sums["all"] or 0.0) / sums["shares"] if sums["shares"] else 0.0
    return raw.select(dimension, (F.col("share") * F.lit(scale)).alias("target"))


def raked(cells: DataFrame, goals: Mapping[str, DataFrame], value: str, most: str | None, rounds: int, tolerance: float) -> DataFrame:
    """``cells`` with the column ``value`` fitted in turn to the ``goal`` of each value of all dimensions, until none that is ``free`` is off by more than ``tolerance``.

    With ``most``, a column, no cell exceeds it: where a marginal lacks something, the cells that are not full make up for it.
    Every step is a grouped sum and a join with it; a value of a dimension is one row there, so no task gathers what
    belongs to a hot value. The rounds' tables are written, so a lost executor costs no more than a round.
    """
    now = F.col(value)
    for _ in range(rounds):
        moved = []
        for d, goal in goals.items():
            full = F.lit(False) if most is None else now >= F.col(most) * (1 - 1e-12)
            sums = cells.groupBy(d).agg(F.sum(now).alias("_all"), F.sum(F.when(full, now).otherwise(0.0)).alias("_full"))
            all_, held = F.col("_all"), F.col("_full")
            down, up = F.try_divide(F.col("goal"), all_), F.try_divide(F.col("goal") - held, all_ - held)
            off = F.when(F.col("free"), F.coalesce(F.abs(down - 1), F.lit(0.0))).otherwise(0.0).alias(f"_{d}")
            steps = sums.join(goal, d).select(d, F.coalesce(F.least(down, F.lit(1.0)), F.lit(0.0)).alias("_down"), F.coalesce(F.greatest(up, F.lit(1.0)), F.lit(1.0)).alias("_up"), off)
            fitted = now * F.when(F.col("_down") < 1, F.col("_down")).when(full, 1.0).otherwise(F.col("_up"))
            cells = cells.join(steps, d).withColumn(value, fitted if most is None else F.least(F.col(most), fitted)).drop("_down", "_up")
            moved.append(f"_{d}")
        cells = staged(cells.withColumn("_moved", F.greatest(*[F.col(c) for c in moved], F.lit(0.0))).drop(*moved))
        worst = cells.where(now > 0).agg(F.max("_moved")).first()[0]
        cells = cells.drop("_moved")
        if worst is None or worst <= tolerance:
            break
    return cells


def rake(cells: DataFrame, wanted: Mapping[str, Mapping[str, float] | float], most_rounds: int = 20, tolerance: float = 1e-3) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``: tokens fitted to all marginals, however far above a cell's own they have to go."""
    goals = {d: staged(targets(cells, d, wanted[d]).select(d, F.col("target").alias("goal"), F.lit(True).alias("free"))) for d in wanted}
    return raked(cells.withColumn("weight", F.col("tokens").cast("double")), goals, "weight", None, most_rounds, tolerance)


def attainable(goal: DataFrame, seen: DataFrame, dimension: str, share: float, rounds: int = 12) -> DataFrame:
    """(value, goal, target, free): ``target`` times ``share``; a value that has less gives all it has, and the others, which are free, make up for it by their targets."""
    rows = staged(goal.join(seen, dimension).select(dimension, (F.col("target") * F.lit(share)).alias("target"), "seen"))
    scale = 1.0
    for _ in range(rounds):
        short = F.col("target") * F.lit(scale) >= F.col("seen")
        sums = rows.agg(F.sum("target").alias("all"), F.sum(F.when(short, F.col("seen")).otherwise(0.0)).alias("short"), F.sum(F.when(short, 0.0).otherwise(F.col("target"))).alias("rest")).first()
        if not sums["rest"]:
            break
        better = (sums["all"] - sums["short"]) / sums["rest"]
        if abs(better - scale) <= 1e-12:
            break
        scale = better
    wants = F.col("target") * F.lit(scale)
    return staged(rows.select(dimension, F.least(F.col("seen"), wants).alias("goal"), "target", (wants < F.col("seen")).alias("free")))


def _cells(names: Sequence[str]) -> pa.Schema:
    return pa.schema([*[(d, pa.string()) for d in names], ("tokens", pa.int64())])


def fitted_at_once(
    values: Mapping[str, np.ndarray], tokens: np.ndarray, wanted: Mapping[str, Mapping[str, float] | float], budget: float, least: float, rounds: int, tolerance: float
) -> tuple[np.ndarray, np.ndarray]:
    """(expected, off) of all cells: ``calibrated`` on arrays, with the value of each cell in each dimension."""
    codes, aims, seen = {}, {}, {}
    for d in wanted:
        names, codes[d] = np.unique(values[d], return_inverse=True)
        seen[d] = np.bincount(codes[d], tokens, len(names))
        shares = np.array([float(wanted[d].get(n, 0.0)) for n in names.tolist()]) if isinstance(wanted[d], Mapping) else seen[d] ** float(wanted[d])
        aims[d] = shares * (seen[d].sum() / shares.sum() if shares.sum() else 0.0)
    share = max(least, min([budget, *[float((seen[d][aim > 0] / aim[aim > 0]).min()) for d, aim in aims.items() if (aim > 0).any()]]))
    goals, free = {}, {}
    for d, aim in aims.items():
        wants, scale = aim * share, 1.0
        for _ in range(12):
            short = wants * scale >= seen[d]
            if not wants[~short].sum():
                break
            scale = (wants.sum() - seen[d][short].sum()) / wants[~short].sum()
        goals[d], free[d] = np.minimum(seen[d], wants * scale), wants * scale < seen[d]
    expected = tokens * share
    for _ in range(rounds):
        worst = 0.0
        for d, goal in goals.items():
            code, full = codes[d], expected >= tokens * (1 - 1e-12)
            total, held = np.bincount(code, expected, len(goal)), np.bincount(code, np.where(full, expected, 0.0), len(goal))
            with np.errstate(divide="ignore", invalid="ignore"):
                down, up = goal / total, (goal - held) / (total - held)
            off = np.where(free[d] & np.isfinite(down), np.abs(down - 1), 0.0)
            worst = max(worst, float(off[np.bincount(code, expected > 0, len(goal)) > 0].max(initial=0.0)))
            down, up = np.where(np.isfinite(down), np.minimum(down, 1.0), 0.0), np.where(np.isfinite(up), np.maximum(up, 1.0), 1.0)
            expected = np.minimum(tokens, expected * np.where(down[code] < 1, down[code], np.where(full, 1.0, up[code])))
        if worst <= tolerance:
            break
    missed = np.zeros(len(tokens))
    for d, aim in aims.items():
        got = np.bincount(codes[d], expected, len(aim))
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.abs(got / (aim * share) - 1)
        missed = np.maximum(missed, np.where(np.isfinite(off), off, 0.0)[codes[d]])
    return expected, missed


def calibrated(
    cells: DataFrame, wanted: Mapping[str, Mapping[str, float] | float], budget: float = 0.9, least: float = 0.5, most_rounds: int = 40, tolerance: float = 1e-3
) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``probability`` and ``off``: raked so that the marginals of the expected tokens have the target shares.

    No cell can give more than all its tokens. So the share of all tokens that is expected is ``budget`` or, if that is less, what the scarcest
    value of a dimension has against its target, but not under ``least``: a value too scarce even for that gives all its tokens, and the others of its
    dimension make up for it. ``off`` is the largest share by which a marginal of the cell misses its target in the end. A cell without tokens
    costs nothing and keeps its documents.
    """
    if cells.count() <= FEW_CELLS:
        names = [d for d in wanted]

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches), _cells(names))
            tokens = table.column("tokens").to_numpy().astype(np.float64)
            values = {d: np.array(table.column(d).to_pylist(), dtype=object).astype(str) for d in names}
            expected, off = fitted_at_once(values, tokens, wanted, budget, least, most_rounds, tolerance) if len(tokens) else (tokens, tokens)
            probability = np.divide(expected, tokens, out=np.ones(len(tokens)), where=tokens > 0)
            made = table.append_column("expected", pa.array(expected)).append_column("off", pa.array(off)).append_column("probability", pa.array(probability))
            yield from made.to_batches()

        kinds = ", ".join(f"`{d}` string" for d in names) + ", tokens long, expected double, off double, probability double"
        return cells.select(*[F.col(d).cast("string").alias(d) for d in names], F.col("tokens").cast("long").alias("tokens")).coalesce(1).mapInArrow(fit, kinds)
    aims = {d: staged(targets(cells, d, wanted[d])) for d in wanted}
    seen = {d: cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("seen")) for d in aims}
    scarcest = [aim.where("target > 0").join(seen[d], d).agg(F.min(F.col("seen") / F.col("target"))).first()[0] for d, aim in aims.items()]
    share = max(least, min([budget, *[x for x in scarcest if x is not None]]))
    goals = {d: attainable(aim, seen[d], d, share) for d, aim in aims.items()}
    start = cells.withColumn("most", F.col("tokens").cast("double")).withColumn("expected", F.col("most") * F.lit(share))
    cells = raked(start, {d: goal.select(d, "goal", "free") for d, goal in goals.items()}, "expected", "most", most_rounds, tolerance)
    for d, goal in goals.items():
        missed = F.coalesce(F.abs(F.try_divide(F.col("got"), F.col("target")) - 1), F.lit(0.0))
        cells = cells.join(cells.groupBy(d).agg(F.sum("expected").alias("got")).join(goal, d).select(d, missed.alias(f"_{d}")), d)
    off = F.greatest(*[F.col(f"_{d}") for d in goals], F.lit(0.0))
    return cells.drop("most").select("*", off.alias("off"), F.when(F.col("tokens") == 0, 1.0).otherwise(F.col("expected") / F.col("tokens")).alias("probability"))


def mixed(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    wanted: Mapping[str, Mapping[str, float] | float] = POWERS,
    budget: float = 0.9,
    topics: int = 8,
    lexicon: Mapping[str, int] | None = None,
    seed: int = 0,
) -> DataFrame:
    """The columns ``keep`` of every document as struct ``row``, its dimensions, tokens, probability, ``off`` and ``kept``.

    A document is kept when a hash of its id (as text; null is empty) falls below the probability of its cell, so
    repeated rows share their fate and a rerun gives the same sample. Null source, language or topic
    is a value of its own; null and empty texts have no tokens and are kept. An empty table gives no rows.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    facts = docs.select(
        F.struct(*keep).alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        named("source").alias("source"), named("lang").alias("lang"), topic_and_tokens(text_of(), topics, lexicon).alias("found"),
    )
    facts = facts.select("row", "id", "source", "lang", named("found.topic").alias("topic"), F.col("found.tokens").alias("tokens"))
    if "text" not in keep:  # short rows are kept for the second pass; texts are read and described again
        facts = staged(facts)
    cells = staged(facts.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    fitted = staged(calibrated(cells.select(*DIMENSIONS, "tokens"), wanted, budget))
    small = fitted.count() <= 200_000
    by_cell = fitted.select(*DIMENSIONS, "probability", "off")
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return facts.join(F.broadcast(by_cell) if small else by_cell, list(DIMENSIONS)).withColumn("kept", draw < F.col("probability"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The documents kept by ``mixed``, all columns as they were."""
    return mixed(docs, docs.columns, **options).where("kept").select("row.*")


def result(docs: DataFrame) -> DataFrame:
    return mixed(docs).select(F.col("row.doc_id").alias("doc_id"), *DIMENSIONS, "tokens", "probability", "off", "kept")
