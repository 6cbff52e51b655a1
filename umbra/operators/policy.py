"""Policy audit: score components, rule selections, capture, decision states and swap diagnostics.

Frames are keyed by a case (the columns ``by``) and a section (cusec); all cases advance in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.stats import quota, ratio, top_k
from umbra.sources.staging import staged

PARTS = ("solar", "shared", "local_only", "regional_only", "passing")
RULES = ("Population", "Uniform", "Shared", "Pooled", "Local", "Regional")
FEASIBLE = 99 - 1e-7


def components(hours: DataFrame, by: Sequence[str]) -> DataFrame:
    """Population of each section by what fails first in its hours: sun, then both fields, then one of them.

    ``hours`` has cusec, district, pop, reachable and the flags solar_fail, local_fail, regional_fail.
    """
    part = (
        F.when(F.col("solar_fail"), "solar").when(F.col("local_fail") & F.col("regional_fail"), "shared")
        .when(F.col("local_fail"), "local_only").when(F.col("regional_fail"), "regional_only").otherwise("passing")
    )
    shares = [(F.avg((F.col("part") == p).cast("double")) * F.col("pop")).alias(p) for p in PARTS]
    rows = hours.withColumn("part", part).groupBy(*by, "cusec", "district", "pop", "reachable").agg(*shares, (F.avg(F.col("uniform_fail").cast("double")) * F.col("pop")).alias("uniform"))
    local, regional = (F.col("solar") + F.col("shared") + F.col(only) for only in ("local_only", "regional_only"))
    return rows.withColumn("local", local).withColumn("regional", regional)


def identity_violations(parts: DataFrame, by: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows per case with a negative part, or parts or scores that do not add up."""
    total = sum((F.col(p) for p in PARTS[1:]), F.col(PARTS[0]))
    off = F.abs(total - F.col("pop")) > tolerance
    local = F.abs(F.col("solar") + F.col("shared") + F.col("local_only") - F.col("local")) > tolerance
    return parts.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(F.least(*PARTS) < 0).alias("negative"),
        F.count_if(off).alias("not_total"),
        F.count_if(local).alias("not_local"),
    )


def sized(parts: DataFrame, by: Sequence[str], fraction: float | Column = 0.15) -> DataFrame:
    """Reachable rows with the quota k of their case."""
    n = F.count("*").over(Window.partitionBy(*by))
    return parts.where("reachable").withColumn("k", quota(n, fraction))


def with_optima(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds each reference's own top-k flag and total."""
    case = Window.partitionBy(*by)
    for name in ("local", "regional"):
        rows = rows.withColumn(f"top_{name}", top_k(F.col(name), "cusec", F.col("k"), by))
        rows = rows.withColumn(f"opt_{name}", F.sum(F.when(F.col(f"top_{name}"), F.col(name)).otherwise(0.0)).over(case))
    return rows


def rule_scores(rows: DataFrame) -> DataFrame:
    """One row per section and rule."""
    pooled = F.coalesce(F.try_divide("local", "opt_local"), F.lit(0.0)) + F.coalesce(F.try_divide("regional", "opt_regional"), F.lit(0.0))
    scores = (F.col("pop"), F.col("uniform"), F.col("solar") + F.col("shared"), pooled, F.col("local"), F.col("regional"))
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.round(s, 9).alias("score")) for r, s in zip(RULES, scores, strict=True)])
    return rows.withColumn("r", F.explode(each)).select("*", "r.rule", "r.score").drop("r")


def selected(ruled: DataFrame, by: Sequence[str]) -> DataFrame:
    """Flag of the k sections that each rule selects: best score, then least key."""
    return ruled.withColumn("chosen", top_k(F.col("score"), "cusec", F.col("k"), [*by, "rule"]))


def captures(chosen: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per case and rule the captured share of both references' optima, in percent."""
    got = lambda name: 100 * ratio(F.sum(F.when(F.col("chosen"), F.col(name)).otherwise(0.0)), F.first(f"opt_{name}"))
    out = chosen.groupBy(*by, "rule").agg(got("local").alias("local_capture"), got("regional").alias("regional_capture"), F.max("k").alias("k"))
    least = F.least("local_capture", "regional_capture")
    return out.withColumn("min_capture", least).withColumn("feasible", F.coalesce(F.round(least, 9) >= FEASIBLE, F.lit(False)))


def district_tv(chosen: DataFrame, by: Sequence[str]) -> DataFrame:
    """Half the summed difference between the districts' shares of slots and of population."""
    keys = [*by, "rule"]
    rows = chosen.groupBy(*keys, "district").agg(F.count_if("chosen").alias("slots"), F.sum("pop").alias("pop"))
    case = Window.partitionBy(*keys)
    gap = F.abs(ratio(F.col("slots"), F.sum("slots").over(case)) - ratio(F.col("pop"), F.sum("pop").over(case)))
    return rows.withColumn("gap", gap).groupBy(*keys).agg((F.sum("gap") / 2).alias("tv"))


def states(captured: DataFrame, by: Sequence[str]) -> DataFrame:
    """Population, else Uniform, else Other common, else Incompatible: the first kind of rule that is feasible."""
    passes = lambda rule: F.max(F.when(F.col("rule") == rule, F.col("feasible")))
    return captured.groupBy(*by).agg(
        F.when(passes("Population"), "Population").when(passes("Uniform"), "Uniform").when(F.max("feasible"), "Other common").otherwise("Incompatible").alias("state")
    )


def tv_gain(captured: DataFrame, tv: DataFrame, by: Sequence[str], baselines: Sequence[str] = ("Population", "Uniform")) -> DataFrame:
    """How much the most even feasible rule gains on the best feasible baseline; null without such a baseline."""
    rows = captured.where("feasible").join(tv, [*by, "rule"])
    best, base = F.min("tv"), F.min(F.when(F.col("rule").isin(*baselines), F.col("tv")))
    return rows.groupBy(*by).agg(best.alias("best_tv"), base.alias("baseline_tv"), (base - best).alias("gain"))


def exchange_loss(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Shares of the parts in the local list, and the loss of the regional list by part, in percent of the local optimum."""
    over = lambda flag, part: F.sum(F.when(F.col(f"top_{flag}"), F.col(part)).otherwise(0.0))
    opt = F.first("opt_local")
    parts = ("solar", "shared", "local_only")
    shares = [(100 * ratio(over("local", p), opt)).alias(f"share_{p}") for p in parts]
    losses = [(100 * ratio(over("local", p) - over("regional", p), opt)).alias(f"loss_{p}") for p in parts]
    return rows.groupBy(*by).agg(*shares, *losses, (100 * ratio(over("local", "local") - over("regional", "local"), opt)).alias("loss"))


def swaps(rows: DataFrame, by: Sequence[str], tolerances: Sequence[float]) -> DataFrame:
    """Additive diagnostics of replacing local selections by the best sections outside, for each tolerance.

    The j cheapest swaps pair the worst selected with the best outside ones; their cumulative cost tells how
    many fit a tolerance. Sections are mandatory when even the best outsider costs more, possible when
    the worst selected may make room for them.
    """
    inside = rows.where("top_local").withColumn("j", F.row_number().over(Window.partitionBy(*by).orderBy("local", F.desc("cusec"))))
    outside = rows.where("not top_local").withColumn("j", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("local"), "cusec")))
    pairs = inside.select(*by, "j", F.col("local").alias("worst"), "opt_local", "k").join(outside.select(*by, "j", F.col("local").alias("best")), [*by, "j"])
    upto = Window.partitionBy(*by).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    costs = pairs.withColumn("cost", F.sum(F.col("worst") - F.col("best")).over(upto))
    grid = rows.sparkSession.createDataFrame([(float(t),) for t in tolerances], "tolerance double")
    slack = F.col("tolerance") * F.col("opt_local") + 1e-8
    most = costs.crossJoin(F.broadcast(grid)).groupBy(*by, "tolerance").agg(F.count_if(F.col("cost") <= slack).alias("max_swaps"))
    edge = rows.groupBy(*by).agg(F.max(F.when(~F.col("top_local"), F.col("local"))).alias("best_out"), F.min(F.when(F.col("top_local"), F.col("local"))).alias("worst_in"))
    flags = rows.join(edge, list(by)).crossJoin(F.broadcast(grid)).groupBy(*by, "tolerance").agg(
        F.count_if(F.col("top_local") & (F.col("local") - F.col("best_out") > slack)).alias("mandatory"),
        (F.max("k") + F.count_if(~F.col("top_local") & (F.col("worst_in") - F.col("local") <= slack))).alias("possible"),
        F.count_if(F.col("top_local") & ~F.col("top_regional")).alias("exchanged"),
    )
    swapped = costs.join(flags.groupBy(*by).agg(F.max("exchanged").alias("e")), list(by)).where("j = e")
    least = swapped.select(*by, (100 * ratio(F.col("cost"), F.col("opt_local"))).alias("least_loss"))
    return flags.join(most, [*by, "tolerance"], "left").join(least, list(by), "left").withColumn("max_swaps", F.coalesce("max_swaps", F.lit(0)))


def sufficiency(captured: DataFrame, by: Sequence[str]) -> DataFrame:
    """Whether a reference's own list serves the other: both, local only, regional only or neither."""
    of = lambda rule, column: F.max(F.when(F.col("rule") == rule, F.round(F.col(column), 9) >= FEASIBLE))
    local, regional = of("Local", "regional_capture"), of("Regional", "local_capture")
    return captured.groupBy(*by).agg(F.when(local & regional, "both").when(local, "local").when(regional, "regional").otherwise("neither").alias("sufficient"))


def state_grid(stated: DataFrame, rows: str, column: str, values: Sequence) -> DataFrame:
    """The state of each case as a table of two of its keys."""
    return stated.groupBy(rows).pivot(column, list(values)).agg(F.first("state")).withColumnsRenamed({str(v): f"c_{v}" for v in values})


def ranges(frame: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return frame.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def reachability(parts: DataFrame, by: Sequence[str], fraction: float = 0.15) -> DataFrame:
    there = F.count_if("reachable")
    pop = lambda flag: F.sum(F.when(F.col("reachable") == flag, F.col("pop")).otherwise(0.0))
    return parts.groupBy(*by).agg(F.count("*").alias("sections"), quota(there, fraction).alias("quota"), pop(True).alias("reachable_pop"), pop(False).alias("unreachable_pop"))


def rollup_states(stated: DataFrame, by: str) -> DataFrame:
    return stated.groupBy(by).agg(F.count("*").alias("cases"), *[F.count_if(F.col("state") == s).alias(s.lower().replace(" ", "_")) for s in ("Population", "Uniform", "Other common", "Incompatible")])


# scenarios of a fixed grid: rows (cusec, scenario, field, delta, score, k)


def shifted_scores(rows: DataFrame, deltas: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Both fields with the limit moved by every delta: score is the part of the population whose margin is not beyond it.

    ``rows`` has a local and a regional margin for each hour of a section. The deltas are a parameter grid: their counts are columns of one grouping,
    written once, so rows are not repeated before it and scores are made again wherever they are read.
    """
    deltas = [float(x) for x in deltas]
    fields = ("local", "regional")
    counts = [F.array(F.count(f"{f}_margin"), *[F.count_if(F.col(f"{f}_margin") + x >= 0) for x in deltas]).alias(f) for f in fields]
    counted = staged(rows.groupBy(*by, "cusec", "pop").agg(*counts))
    each = counted.select(*by, "cusec", "pop", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("c")) for f in fields])).alias("f"))
    grid = F.array(*[F.struct(F.lit(x).alias("delta"), F.get("f.c", F.lit(i + 1)).alias("n")) for i, x in enumerate(deltas)])
    each = each.select(*by, "cusec", "pop", "f.field", F.get("f.c", F.lit(0)).alias("hours"), F.explode(grid).alias("d"))
    return each.select(*by, "cusec", "pop", "field", "d.delta", F.round(F.try_divide("d.n", "hours") * F.col("pop"), 9).alias("score"))


def beside(rows: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of the broadcast ``few`` of the same keys; null keys are equal."""
    there = F.broadcast(few.withColumnsRenamed({c: f"_{c}" for c in keys}))
    return rows.join(there, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]), how).drop(*[f"_{c}" for c in keys])


def cuts(scores: DataFrame, keys: Sequence[str], fraction: float, accuracy: int = 1000, ties: bool = True) -> DataFrame:
    """(keys, k, low, best, last): of each scenario the quota, the score of the last one in it, the sum of scores in it and, with ``ties``, the last cusec with that score.

    No scenario is sorted: sketches bracket the last score, rows inside the bracket are counted by score, and only those with the last score are ranked by cusec.
    Null scores come last and add nothing.
    """
    ends = F.array(F.lit(max(0.0, 1 - fraction - 4 / accuracy)), F.lit(min(1.0, 1 - fraction + 4 / accuracy)))
    value = F.coalesce("score", F.lit(float("-inf")))
    rows = scores.select(*keys, "cusec", value.alias("score"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.percentile_approx("score", ends, accuracy).alias("ends"), F.min("score").alias("least"), F.max("score").alias("most"))
    few = F.col("size") < accuracy
    brackets = staged(
        sizes.select(*keys, quota(F.col("size"), fraction).alias("k"), F.when(few, F.col("least")).otherwise(F.col("ends")[0]).alias("from"), F.when(few, F.col("most")).otherwise(F.col("ends")[1]).alias("to"))
    )
    placed = beside(rows, brackets, keys).where("score >= from")
    # all above the bracket are one value
    seen = placed.withColumn("inside", F.when(F.col("score") <= F.col("to"), F.col("score"))).groupBy(*keys, "k", "inside").agg(F.count("*").alias("n"), F.sum("score").alias("sum"))
    down = Window.partitionBy(*keys).orderBy(F.desc_nulls_first("inside")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumn("upto", F.sum("n").over(down)).withColumn("held", F.sum("sum").over(down))
    at = seen.where("inside IS NOT NULL AND upto >= k AND upto - n < k")
    nothing = F.col("inside") == float("-inf")
    before = F.col("upto") - F.col("n")
    held = F.when(nothing, F.lit(0.0)).otherwise(F.col("held") - F.col("sum") + (F.col("k") - before) * F.col("inside"))
    out = staged(at.select(*keys, "k", F.col("inside").alias("low"), held.alias("best"), (F.col("k") - before).alias("left"), "n"))
    if not ties:
        return out.select(*keys, "k", "low", "best")
    # all of a score are in, or the first of them by cusec
    tied = beside(rows, out.where("left < n"), keys).where("score = low")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("cusec"))
    last = tied.select(*keys, "cusec", "left", place.alias("place")).where("place = left").select(*keys, F.col("cusec").alias("last"))
    return beside(out, last, keys, "left").select(*keys, "k", "low", "best", "last")


def normalised(scores: DataFrame, by: Sequence[str], fraction: float = 0.15, ties: bool = True) -> DataFrame:
    """Scores in percent of the scenario's own top-k total, and with ``ties`` the flag of its top k."""
    keys = [*by, "field", "delta"]
    rows = beside(scores, staged(cuts(scores, keys, fraction, ties=ties)), keys)
    value = F.coalesce("score", F.lit(float("-inf")))
    if ties:
        rows = rows.withColumn("top", (value > F.col("low")) | ((value == F.col("low")) & (F.col("last").isNull() | (F.col("cusec") <= F.col("last"))))).drop("last")
    return rows.withColumn("pct", 100 * F.coalesce(F.try_divide("score", "best"), F.lit(0.0))).drop("low", "best")


def least_capture(grid: DataFrame, chosen: DataFrame, amplitudes: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Least capture of a selection (by, rule, cusec) over the scenarios within each amplitude."""
    steps = grid.sparkSession.createDataFrame([(float(a),) for a in amplitudes], "amplitude double")
    held = grid.join(chosen, [*by, "cusec"]).groupBy(*by, "rule", "field", "delta").agg(F.sum("pct").alias("capture"))
    active = held.join(F.broadcast(steps), F.abs(F.col("delta")) <= F.col("amplitude") + 1e-10)
    return active.groupBy(*by, "rule", "amplitude").agg(F.min("capture").alias("least"), F.count("*").alias("scenarios"))


def first_incompatible(held: DataFrame, by: Sequence[str], limit: float = 1 + 1e-7) -> DataFrame:
    """The least amplitude at which a rule loses more than the limit, its largest loss, and whether losses grow with amplitude."""
    order = Window.partitionBy(*by, "rule").orderBy("amplitude")
    loss = F.round(100 - F.col("least"), 9)
    rows = held.withColumn("loss", loss).withColumn("falls", F.coalesce(F.col("loss") < F.lag("loss").over(order), F.lit(False)))
    return rows.groupBy(*by, "rule").agg(F.min(F.when(F.col("loss") > limit, F.col("amplitude"))).alias("first_amplitude"), F.max("loss").alias("loss"), F.count_if("falls").alias("not_monotone"))


def common_list(grid: DataFrame, k: int, rounds: int = 12, rate: float = 0.05) -> DataFrame:
    """A shortlist of ``k`` sections whose least capture over all scenarios is high, by multiplicative weights.

    Whatever the scenarios' weights, the top k of the weighted scores bound the best possible least capture from
    above. Each round reweights towards scenarios that the present list serves badly; returns round, primal and bound.
    """
    spark, grid = grid.sparkSession, staged(grid.select("cusec", "field", "delta", "pct"))  # read in every round
    scenarios = grid.select("field", "delta").distinct().collect()
    weights = spark.createDataFrame([(r["field"], r["delta"], 1.0 / len(scenarios)) for r in scenarios], "field string, delta double, w double")
    out = []
    for round_ in range(1, rounds + 1):
        mixed = grid.join(F.broadcast(weights), ["field", "delta"]).groupBy("cusec").agg(F.round(F.sum(F.col("w") * F.col("pct")), 9).alias("mixed"))
        chosen = staged(mixed.orderBy(F.desc("mixed"), "cusec").limit(k))
        bound = chosen.agg(F.sum("mixed")).first()[0]
        held = grid.join(F.broadcast(chosen.select("cusec")), "cusec", "left_semi").groupBy("field", "delta").agg(F.sum("pct").alias("capture"))
        rows = held.join(weights, ["field", "delta"]).collect()  # one row per scenario
        out.append((round_, float(min(r["capture"] for r in rows)), float(bound)))
        raw = {(r["field"], r["delta"]): r["w"] * 2.718281828459045 ** (-rate * r["capture"]) for r in rows}
        total = sum(raw.values())
        weights = spark.createDataFrame([(f, x, w / total) for (f, x), w in sorted(raw.items())], "field string, delta double, w double")
    return spark.createDataFrame(out, "round int, primal double, bound double")


def zero_shift(grid: DataFrame, central: DataFrame, by: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows without a shift against the central case (by, cusec, field, score): rows, rows on one side alone, and rows that differ."""
    keys = [*by, "cusec", "field"]
    was = central.select(*keys, F.col("score").alias("_was"), F.lit(True).alias("_there"))
    rows = grid.where("delta = 0").select(*keys, "score", F.lit(True).alias("_here")).join(was, keys, "full_outer")
    return rows.groupBy("field").agg(
        F.count("*").alias("rows"), F.count_if(F.col("_here").isNull() | F.col("_there").isNull()).alias("alone"), F.count_if(F.abs(F.col("score") - F.col("_was")) > tolerance).alias("off")
    )


def frozen_transfer(grid: DataFrame, chosen: DataFrame, by: Sequence[str]) -> DataFrame:
    """What lists (by, rule, cusec) that stay as they are capture of every scenario's own optimum, in percent."""
    return grid.join(chosen, [*by, "cusec"]).groupBy(*by, "rule", "field", "delta").agg(F.sum("pct").alias("capture"), F.count("*").alias("sections"))


def observation_stress(grid: DataFrame, chosen: DataFrame, experiments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least capture of stored lists in every experiment, a set of scenarios (experiment, delta), and how many scenarios it has."""
    held = frozen_transfer(grid, chosen, by).join(F.broadcast(experiments), "delta")
    return held.groupBy(*by, "experiment", "rule").agg(F.min("capture").alias("least"), F.count("*").alias("scenarios"), F.min("sections").alias("quota"))


def certificates(chosen: DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, rule, indices): lists (by, rule, cusec) by the places, from 0, that their sections have among the case's ``rows`` in order of cusec."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("cusec")) - 1
    placed = rows.select(*by, "cusec").withColumn("place", place)
    return chosen.join(placed, [*by, "cusec"]).groupBy(*by, "rule").agg(F.array_sort(F.collect_list("place")).alias("indices"))


def audited(certs: DataFrame, rows: DataFrame, by: Sequence[str], least: float = 99.0, tolerance: float = 1e-7) -> DataFrame:
    """Checks of certificates (by, rule, indices) against ``rows`` (by, cusec, k, local, regional, opt_local, opt_regional).

    Whether a list has as many different places as its quota, all of them of sections, and what it captures of both optima.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy("cusec")) - 1
    placed = rows.withColumn("place", place)
    totals = placed.groupBy(*by).agg(F.count("*").alias("n"), F.first("k").alias("k"), F.first("opt_local").alias("opt_local"), F.first("opt_regional").alias("opt_regional"))
    listed = certs.select(*by, "rule", F.posexplode("indices").alias("at", "place"))
    found = listed.join(placed.select(*by, "place", "local", "regional"), [*by, "place"], "left").groupBy(*by, "rule").agg(
        F.count("*").alias("listed"), F.count_distinct("place").alias("different"), F.min("place").alias("low"), F.max("place").alias("high"), F.sum("local").alias("local"), F.sum("regional").alias("regional")
    )
    got = lambda name: 100 * F.try_divide(name, f"opt_{name}")
    out = found.join(totals, list(by)).withColumn("local_capture", got("local")).withColumn("regional_capture", got("regional"))
    sound = (F.col("listed") == F.col("k")) & (F.col("different") == F.col("k")) & (F.col("low") >= 0) & (F.col("high") < F.col("n"))
    common = F.least("local_capture", "regional_capture") >= least - tolerance
    return out.select(*by, "rule", "listed", "local_capture", "regional_capture", sound.alias("sound"), common.alias("common"))


CERTIFICATE = "status string, indices array<bigint>, local_capture double, regional_capture double, district_tv double, objective_bound double, mip_gap double"


def audited_certificates(certs: DataFrame, rows: DataFrame, by: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Stored certificates (by, rule, and the columns of ``CERTIFICATE``) against a recount from ``rows`` (by, cusec, district, pop, k, local, regional, optima).

    ``sound``: as many different places as the quota, all of sections. ``captures`` and ``balance``: the stored captures and total variation of districts are
    those of the places. ``bounded``: the stored bound is no higher than the recounted variation, which is minimised, and ``within_gap`` not further below
    it than the stored gap says. A certificate without places has nothing to recount: it is ``sound`` if its status says infeasible, and the rest is null.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy("cusec")) - 1
    placed = staged(rows.withColumn("place", place))
    whole = placed.groupBy(*by).agg(F.count("*").alias("n"), F.first("k").alias("k"), F.first("opt_local").alias("opt_local"), F.first("opt_regional").alias("opt_regional"), F.sum("pop").alias("people"))
    districts = placed.groupBy(*by, "district").agg(F.sum("pop").alias("pop"))
    listed = certs.where("indices IS NOT NULL").select(*by, "rule", F.explode("indices").alias("place")).join(placed.select(*by, "place", "district", "local", "regional"), [*by, "place"], "left")
    slots = staged(
        listed.groupBy(*by, "rule", "district").agg(
            F.count("*").alias("slots"), F.count_distinct("place").alias("different"), F.min("place").alias("low"), F.max("place").alias("high"), F.sum("local").alias("local"), F.sum("regional").alias("regional")
        )
    )
    found = slots.groupBy(*by, "rule").agg(
        F.sum("slots").alias("listed"), F.sum("different").alias("different"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("local").alias("local"), F.sum("regional").alias("regional")
    )
    shares = found.select(*by, "rule", "listed").join(whole.select(*by, "people"), list(by)).join(districts, list(by)).join(slots.select(*by, "rule", "district", "slots"), [*by, "rule", "district"], "left")
    apart = F.abs(F.coalesce("slots", F.lit(0)) / F.col("listed") - F.col("pop") / F.col("people"))
    tv = shares.groupBy(*by, "rule").agg((F.sum(apart) / 2).alias("tv"))
    out = certs.join(found, [*by, "rule"], "left").join(tv, [*by, "rule"], "left").join(whole, list(by))
    got = lambda name: 100 * F.try_divide(name, f"opt_{name}")
    near = lambda a, b: F.abs(a - b) <= tolerance
    there = F.col("indices").isNotNull()
    sound = (F.col("listed") == F.col("k")) & (F.col("different") == F.col("k")) & (F.col("low") >= 0) & (F.col("high") < F.col("n"))
    return out.select(
        *by, "rule", F.when(there, F.coalesce(sound, F.lit(False))).otherwise(F.col("status") == "Infeasible").alias("sound"),
        (near(got("local"), F.col("local_capture")) & near(got("regional"), F.col("regional_capture"))).alias("captures"), near(F.col("tv"), F.col("district_tv")).alias("balance"),
        (F.col("objective_bound") <= F.col("tv") + tolerance).alias("bounded"), (F.col("tv") - F.col("objective_bound") <= F.col("mip_gap") * F.col("tv") + tolerance).alias("within_gap"), "tv",
    )
