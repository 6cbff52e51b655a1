"""What a list chosen with less information loses: information levels, dominance over grids, bootstrapped regret.

A section has cusec, pop and reachable; safe fractions under the coarse and the local thermal field and the exposed
fraction of its walk with and without vegetation make five levels.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.joins import small
from umbra.functions.stats import quota, ratio
from umbra.sources.staging import staged

#: (name, thermal field, shade layer); the last one knows all there is.
LEVELS = (("R1", "coarse", None), ("R2", "coarse", "full"), ("R3", "local", None), ("R4", "local", "buildings"), ("R5", "local", "full"))


def level_fractions(coarse: Column, local: Column, exposed_buildings: Column, exposed_full: Column, limit: float) -> Column:
    """Array of struct (rep, frac): the safe fraction of each level; a walk beyond the limit of exposure makes it 0, as does an unknown one."""
    shade = {None: F.lit(1.0), "buildings": F.coalesce((exposed_buildings <= limit).cast("double"), F.lit(0.0)), "full": F.coalesce((exposed_full <= limit).cast("double"), F.lit(0.0))}
    return F.array(*[F.struct(F.lit(name).alias("rep"), ((coarse if field == "coarse" else local) * shade[layer]).alias("frac")) for name, field, layer in LEVELS])


def information_levels(sections: DataFrame, limit: float = 0.4) -> DataFrame:
    """A row for each reachable section and level with ``frac`` and ``load``; ``sections`` has coarse, local, exposed_buildings and exposed_full."""
    levels = level_fractions(F.col("coarse"), F.col("local"), F.col("exposed_buildings"), F.col("exposed_full"), limit)
    each = sections.where("reachable").withColumn("level", F.explode(levels)).select("*", "level.*").drop("level")
    return each.withColumn("load", F.round(F.col("pop") * (1 - F.col("frac")), 9))


# constraint dominance over speeds, budgets, windows of hours and capacities


def window_exposure(routes: DataFrame, cases: DataFrame, windows: dict[str, Sequence[int]]) -> DataFrame:
    """(node, speed, budget, window, reachable, exposed) from the routes (hour, weight, node, t, sun) of one speed.

    Another speed scales all minutes alike, so it takes the same paths: ``cases`` (speed, budget, factor) only has the factor. All routes of
    a node, one for each hour and weight, come together once; hours within the budget are bits, and a window is reachable if all its
    bits are set. ``exposed`` is the mean over the window's hours of the sun's share of the least exposed walk within the budget.
    """
    hours = sorted({h for some in windows.values() for h in some})
    bit = reduce(lambda c, h: c.when(F.col("hour") == h, 1 << hours.index(h)), hours[1:], F.when(F.col("hour") == hours[0], 1))
    row = F.struct(F.round("sun", 9).alias("order"), "weight", "t", "sun", bit.alias("bit"))
    nodes = routes.where(F.col("hour").isin(hours)).groupBy("node").agg(F.collect_list(row).alias("routes"))
    each = nodes.crossJoin(F.broadcast(cases)).withColumn("kept", F.filter("routes", lambda r: r["t"] * F.col("factor") <= F.col("budget")))
    each = each.withColumn("bits", F.aggregate("kept", F.lit(0), lambda s, r: s.bitwiseOR(r["bit"])))
    at_hour = lambda b: F.array_min(F.filter("kept", lambda r: r["bit"] == b))
    best = {h: at_hour(1 << i) for i, h in enumerate(hours)}
    each = each.withColumns({f"share_{h}": F.when(b["t"] > 0, b["sun"] / b["t"]) for h, b in best.items()})

    def window(name: str, some: Sequence[int]) -> Column:
        mask = sum(1 << hours.index(h) for h in some)
        shares = F.array_compact(F.array(*[F.col(f"share_{h}") for h in some]))
        mean = ratio(F.aggregate(shares, F.lit(0.0), lambda s, x: s + x), F.size(shares))
        return F.struct(F.lit(name).alias("window"), (F.col("bits").bitwiseAND(mask) == mask).alias("reachable"), mean.alias("exposed"))

    made = each.withColumn("w", F.explode(F.array(*[window(name, some) for name, some in windows.items()])))
    return made.select("node", "speed", "budget", "w.*")


def dominance_grid(sections: DataFrame, exposure: DataFrame, fractions: Sequence[float], limit: float = 0.4) -> DataFrame:
    """For each speed, budget, window and capacity: reachable sections and people, those that fail the solar limit, and which constraint fills the list.

    ``sections`` has node and pop; ``exposure`` is that of ``window_exposure``. An unknown exposure fails nothing.
    """
    keys = ["speed", "budget", "window"]
    rows = sections.join(exposure, "node")
    fails = F.col("reachable") & F.coalesce(F.col("exposed") > limit, F.lit(False))
    counts = rows.groupBy(*keys).agg(
        F.count_if("reachable").alias("n"), (100 * ratio(F.sum(F.when(F.col("reachable"), F.col("pop")).otherwise(0.0)), F.sum("pop"))).alias("people_pct"), F.count_if(fails).alias("fails")
    )
    grid = sections.sparkSession.createDataFrame([(float(x),) for x in fractions], "fraction double")
    out = counts.crossJoin(F.broadcast(grid)).withColumn("quota", quota(F.col("n"), F.col("fraction")))
    regime = F.when(F.col("fails") >= F.col("quota"), "sun").when(2 * F.col("fails") >= F.col("quota"), "mixed").otherwise("heat")
    return out.withColumn("ratio", ratio(F.col("fails"), F.col("quota"))).withColumn("regime", regime)


# bootstrap of regret and efficiency


def replicated_columns(sums: DataFrame, replicates: DataFrame, unit: Sequence[str], values: Sequence[str], width: int = 25) -> DataFrame:
    """(unit, b, values): means of several values of each unit in each replicate from sums of days (unit, date, values, n); units without a drawn day are missing.

    Sums are shuffled once, by unit, before they meet the replicates of their days, of which there are few; so no replicate is shuffled.
    """
    places = range(width)
    times = [F.sum(F.when(F.col("b") % width == i, F.col("times"))).alias(f"t{i}") for i in places]
    packed = replicates.groupBy("date", F.floor(F.col("b") / width).alias("pack")).agg(*times)
    both = [F.sum(F.col(x) * F.col(f"t{i}")).alias(f"{x}{i}") for i in places for x in (*values, "n")]
    parts = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not by the bytes of the sums, as their replicates are many times larger
    rows = sums.repartition(parts, *unit).join(F.broadcast(packed), "date").groupBy(*unit, "pack").agg(*both)
    each = F.array(*[F.struct((F.col("pack") * width + i).alias("b"), *[ratio(F.col(f"{x}{i}"), F.col(f"n{i}")).alias(x) for x in values]) for i in places])
    return rows.select(*unit, F.explode(each).alias("x")).select(*unit, "x.*").where(F.col(values[0]).isNotNull())


def selected_by_bins(rows: DataFrame, keys: Sequence[str], fractions: Sequence[float], most: float, bins: int = 512, most_ranked: int = 200_000) -> DataFrame | None:
    """``selected_load`` by counts and sums in equal steps of the load from 0 to ``most``, all beyond in the last one: exact, as only rows of the steps where quotas end are ranked.

    Counts and sums go by a hash of few groups, which needs no sort, unlike sketches of many cases. None if a case has more than ``most_ranked`` rows in such a step.
    """
    step = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(F.floor(F.col("load") * (bins / most)), F.lit(0)))).cast("int")  # an unknown load comes last
    rows = rows.withColumn("bin", step)
    counts = staged(rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum("true_load").alias("s")))
    down = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    sized = counts.withColumn("size", F.sum("n").over(Window.partitionBy(*keys)))
    above = sized.withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0))).withColumn("captured", F.coalesce(F.sum("s").over(down), F.lit(0.0)))
    cuts = above.withColumn("fraction", F.explode(F.array(*[F.lit(float(q)) for q in fractions]))).withColumn("quota", quota(F.col("size"), F.col("fraction")))
    cuts = staged(cuts.where((F.col("above") < F.col("quota")) & (F.col("quota") <= F.col("above") + F.col("n"))))
    if (cuts.agg(F.max("n")).first()[0] or 0) > most_ranked:
        return None
    ends = small(cuts.groupBy(*keys, "bin").agg(F.collect_list(F.struct("fraction", (F.col("quota") - F.col("above")).alias("rest"))).alias("ends")))
    inside = rows.join(ends, [*keys, "bin"]).select(*keys, "cusec", "load", "true_load", F.explode("ends").alias("e"))
    order = Window.partitionBy(*keys, "e.fraction").orderBy(F.desc("load"), "cusec")
    last = inside.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("e.rest")).groupBy(*keys, F.col("e.fraction").alias("fraction")).agg(F.sum("true_load").alias("rest"))
    return cuts.select(*keys, "fraction", "captured").join(last, [*keys, "fraction"], "left").select(*keys, "fraction", (F.col("captured") + F.coalesce("rest", F.lit(0.0))).alias("captured"))


def selected_load(rows: DataFrame, keys: Sequence[str], fractions: Sequence[float], accuracy: int = 1000) -> DataFrame:
    """(keys, fraction, captured): the sum of ``true_load`` over the first quota of each case by ``load``, ties to the smaller cusec. Exact.

    No case is sorted: sketches of bounded size bracket the load of the last one on the list, whose rank they know to within a share
    of 1 / ``accuracy``. Rows above the bracket are summed where they are; only those inside it, a few in ``accuracy``, are ranked.
    """
    steps = F.array(*[F.lit(float(q)) for q in fractions])
    ends = [end for q in fractions for end in (max(0.0, 1 - q - 3 / accuracy), min(1.0, 1 - q + 3 / accuracy))]
    brackets = rows.groupBy(*keys).agg(
        F.count("*").alias("size"), F.percentile_approx("load", F.array(*map(F.lit, ends)), accuracy).alias("ends"), F.min("load").alias("least"), F.max("load").alias("most")
    )
    few = F.col("size") < accuracy  # a quota is rounded down: up to a row away from its share, which is more than brackets of few rows allow for
    brackets = brackets.select(
        *keys, "size",
        F.transform(steps, lambda q, i: F.struct(
            q.alias("fraction"), quota(F.col("size"), q).alias("quota"),
            F.when(few, F.col("least")).otherwise(F.get("ends", 2 * i)).alias("low"), F.when(few, F.col("most")).otherwise(F.get("ends", 2 * i + 1)).alias("high"),
        )).alias("cuts"),
    )
    brackets = staged(brackets)
    each = rows.join(F.broadcast(brackets.select(*keys, "cuts")) if brackets.count() <= 200_000 else brackets.select(*keys, "cuts"), list(keys))
    names = range(len(fractions))
    cut = lambda i: F.get("cuts", F.lit(i))
    above = each.groupBy(*keys).agg(
        *[F.count_if(F.col("load") > cut(i)["high"]).alias(f"n{i}") for i in names], *[F.sum(F.when(F.col("load") > cut(i)["high"], F.col("true_load")).otherwise(0.0)).alias(f"s{i}") for i in names]
    )
    inside = each.select(*keys, "cusec", "load", "true_load", F.explode(F.filter("cuts", lambda c: F.col("load").between(c["low"], c["high"]))).alias("c"))
    order = Window.partitionBy(*keys, "c.fraction").orderBy(F.desc("load"), "cusec")
    counted = F.array(*[F.struct(F.lit(float(q)).alias("fraction"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s")) for i, q in enumerate(fractions)])
    above = above.select(*keys, F.explode(counted).alias("a")).select(*keys, "a.*")
    ranked = inside.select(*keys, "c.fraction", "c.quota", "true_load", F.row_number().over(order).alias("place"))
    last = ranked.join(above, [*keys, "fraction"]).where(F.col("place") <= F.col("quota") - F.col("n"))
    rest = last.groupBy(*keys, "fraction").agg(F.sum("true_load").alias("rest"))
    return above.join(rest, [*keys, "fraction"], "left").select(*keys, "fraction", (F.col("s") + F.coalesce("rest", F.lit(0.0))).alias("captured"))


def regret_replicates(sections: DataFrame, sums: DataFrame, replicates: DataFrame, fractions: Sequence[float], limit: float = 0.4, reference: str = "R5") -> DataFrame:
    """(rep, fraction, b, regret, efficiency) in percent of the load that the reference level's own list captures in the same replicate.

    ``sums`` (cusec, date, coarse, local, n) are safe hours of days, ``sections`` has cusec, pop, reachable, exposed_buildings and exposed_full.
    """
    means = replicated_columns(sums, replicates, ["cusec"], ["coarse", "local"])
    rows = staged(sections.where("reachable").select("cusec", "pop", "exposed_buildings", "exposed_full").join(means, "cusec"))
    levels = level_fractions(F.col("coarse"), F.col("local"), F.col("exposed_buildings"), F.col("exposed_full"), limit)
    load = lambda level: F.rint(F.col("pop") * (1 - level["frac"]) * 1e9) / 1e9  # noqa: E731  as many digits as elsewhere, by arithmetic: decimals cost more than all the rest
    true = F.filter("levels", lambda x: x["rep"] == reference)
    each = rows.withColumn("levels", levels).withColumn("true_load", load(F.get(true, F.lit(0)))).withColumn("level", F.explode("levels"))
    each = each.select("b", "cusec", F.col("level.rep").alias("rep"), load(F.col("level")).alias("load"), "true_load")
    most = sections.where("reachable").agg(F.max("pop")).first()[0] or 1.0  # no load is above its people
    chosen = selected_by_bins(each, ["rep", "b"], fractions, most)
    captured = staged(selected_load(each, ["rep", "b"], fractions) if chosen is None else chosen)
    best = captured.where(F.col("rep") == reference).select("b", "fraction", F.col("captured").alias("best"))
    both = captured.join(best, ["b", "fraction"])
    return both.select("rep", "fraction", "b", (100 * ratio(F.col("best") - F.col("captured"), F.col("best"))).alias("regret"), (100 * ratio(F.col("captured"), F.col("best"))).alias("efficiency"))


def regret_intervals(replicated: DataFrame) -> DataFrame:
    """Median and 95 % percentile interval of regret and efficiency over replicates, for each level and capacity."""
    ends = F.array(*map(F.lit, (0.025, 0.5, 0.975)))
    q = replicated.groupBy("rep", "fraction").agg(F.percentile("regret", ends).alias("r"), F.percentile("efficiency", ends).alias("e"), F.count("regret").alias("reps"))
    at = lambda c, i, name: F.get(c, F.lit(i)).alias(name)
    return q.select(
        "rep", "fraction", "reps", at("r", 0, "regret_low"), at("r", 1, "regret"), at("r", 2, "regret_high"), at("e", 0, "efficiency_low"), at("e", 1, "efficiency"), at("e", 2, "efficiency_high")
    )


# sensitivity of the whole chain


def chain_metrics(sections: DataFrame, sun: DataFrame, safe: DataFrame, budgets: Sequence[float], by: Sequence[str], fraction: float = 0.2) -> DataFrame:
    """What a key of route choice (transmittance, height factor) does to decisions, for each threshold ``u`` and budget of sun minutes.

    ``sections`` has cusec, pop and reachable, ``sun`` (by, cusec, sun) the least sun minutes of its walk, ``safe`` (cusec, u, coarse, local) the safe
    fractions. A section without a walk meets no budget. Shares are in percent, coverage over all people, the list over the reachable.
    """
    grid = sections.sparkSession.createDataFrame([(float(x),) for x in budgets], "budget double")
    cases = sun.select(*by).distinct().crossJoin(F.broadcast(grid))
    rows = sections.crossJoin(F.broadcast(cases)).join(sun, [*by, "cusec"], "left").join(safe, "cusec")
    keys = [*by, "u", "budget"]
    solar = F.coalesce((F.col("sun") <= F.col("budget")).cast("double"), F.lit(0.0))
    rows = rows.withColumn("solar", solar)
    gated = lambda c: F.when(F.col("reachable"), F.col(c) * F.col("solar")).otherwise(0.0)
    rows = rows.withColumn("fc", gated("coarse")).withColumn("fl", gated("local"))
    load = lambda c: F.when(F.col("reachable"), F.round(F.col("pop") * (1 - F.col(c)), 9))
    rows = rows.withColumn("lc", load("fc")).withColumn("ll", load("fl"))
    case = Window.partitionBy(*keys)
    n = quota(F.count_if("reachable").over(case), fraction)
    first = lambda c: F.col("reachable") & (F.row_number().over(case.orderBy(F.desc_nulls_last(c), "cusec")) <= n)
    rows = rows.withColumn("tc", first("lc")).withColumn("tl", first("ll"))
    percent = lambda c: 100 * ratio(F.sum(F.col(c) * F.col("pop")), F.sum("pop"))
    met = 100 * F.avg(F.when(F.col("reachable"), F.col("solar")))
    return rows.groupBy(*keys).agg(
        met.alias("solar_pct"), F.percentile(F.when(F.col("reachable"), F.col("sun")), F.lit(0.5)).alias("sun_median"), percent("fc").alias("coverage_coarse"), percent("fl").alias("coverage_local"),
        ratio(F.count_if(F.col("tc") & F.col("tl")), F.count_if(F.col("tc") | F.col("tl"))).alias("jaccard"),
        F.sum(F.when(F.col("tl") & ~F.col("tc"), F.col("pop")).otherwise(0.0)).alias("moved_people"), (met < 60).alias("saturated"),
    )
