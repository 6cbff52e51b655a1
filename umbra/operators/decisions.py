"""Decisions on sections: coverage, reclassification, priority lists, factorial effects, budget regret.

A section has cusec, district, pop and reachable; a served fraction per representation (rep) is in frac.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.joins import small
from umbra.functions.ranks import value_ranks
from umbra.functions.stats import average_rank, median, normal_cdf, pearson, quota, ratio, top_k


def travel(sections: DataFrame, speeds: Sequence[float], minutes: float = 15) -> DataFrame:
    """Minutes to the facility at dist_m for each walking speed (m/s), and whether that is within ``minutes``."""
    out = sections
    for i, speed in enumerate(speeds):
        out = out.withColumn(f"min_{i}", F.col("dist_m") / speed / 60).withColumn(f"served_{i}", F.col(f"min_{i}") <= minutes)
    return out


def served_population(sections: DataFrame, flags: Sequence[str]) -> DataFrame:
    total = F.sum("pop")
    return sections.agg(*[(100 * ratio(F.sum(F.when(F.col(f), F.col("pop")).otherwise(0.0)), total)).alias(f"pct_{f}") for f in flags], F.count("*").alias("sections"))


def coverage(fractions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Population-weighted mean of the served fraction over all sections; the unreachable count as zero."""
    served = F.when(F.col("reachable"), F.col("frac")).otherwise(0.0)
    return fractions.groupBy(*by).agg(ratio(F.sum(served * F.col("pop")), F.sum("pop")).alias("coverage"))


def coverage_difference(covered: DataFrame, base: str) -> DataFrame:
    """Absolute difference of each representation to ``base`` in points, and relative in percent."""
    of_base = covered.where(F.col("rep") == base).select(F.col("coverage").alias("base"))
    rows = covered.crossJoin(F.broadcast(of_base))
    return rows.select("rep", "coverage", (100 * (F.col("coverage") - F.col("base"))).alias("diff_pp"), (100 * ratio(F.col("coverage") - F.col("base"), F.col("base"))).alias("diff_pct"))


def flows(pairs: DataFrame, by: Sequence[str], cut: Column | None = None) -> DataFrame:
    """Two-way reclassification of frac_b against frac_a at a cut, the median of frac_a over the reachable by default."""
    there = pairs.where("reachable")
    if cut is None:
        cuts = there.groupBy(*by).agg(median("frac_a").alias("cut")) if by else there.agg(median("frac_a").alias("cut"))
        there = there.join(small(cuts), list(by)) if by else there.crossJoin(F.broadcast(cuts))
        cut = F.col("cut")
    a, b = F.col("frac_a") >= cut, F.col("frac_b") >= cut
    up, down = ~a & b, a & ~b
    people = lambda flag: F.sum(F.when(flag, F.col("pop")).otherwise(0.0))
    out = there.groupBy(*by).agg(
        F.count_if(up).alias("up"), F.count_if(down).alias("down"), people(up).alias("up_pop"), people(down).alias("down_pop"), F.sum("pop").alias("pop")
    )
    return out.select(
        *by, "up", "down", "up_pop", "down_pop", (F.col("up_pop") + F.col("down_pop")).alias("gross_pop"), (F.col("up_pop") - F.col("down_pop")).alias("net_pop"),
        (100 * ratio(F.col("up_pop") + F.col("down_pop"), F.col("pop"))).alias("gross_pct"), ((F.col("up") > 0) & (F.col("down") > 0)).alias("both_ways"),
    )


def cut_sweep(pairs: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """Flows at cuts at the quantiles of the reference fraction."""
    cuts = pairs.where("reachable").agg(F.percentile("frac_a", F.array(*map(F.lit, quantiles))).alias("cuts"))
    cuts = cuts.select(F.posexplode("cuts").alias("step", "cut"))
    rows = pairs.crossJoin(F.broadcast(cuts))
    return flows(rows, ["step", "cut"], F.col("cut"))


def priority(sections: DataFrame, by: Sequence[str], fraction: float | Column) -> DataFrame:
    """Load pop * (1 - frac) of the reachable and the flag of the top fraction, ties to the smaller key."""
    there = sections.where("reachable").withColumn("load", F.round(F.col("pop") * (1 - F.col("frac")), 9))
    n = F.count("*").over(Window.partitionBy(*by))
    return there.withColumn("k", quota(n, fraction)).withColumn("first", top_k(F.col("load"), "cusec", F.col("k"), by))


def list_change(ranked: DataFrame, a: str, b: str) -> DataFrame:
    """Jaccard of the priority lists of two representations, who enters and leaves, and the people among them."""
    wide = ranked.where(F.col("rep").isin(a, b)).groupBy("cusec").agg(
        F.max("pop").alias("pop"), F.coalesce(F.max(F.when(F.col("rep") == a, F.col("first"))), F.lit(False)).alias("a"), F.coalesce(F.max(F.when(F.col("rep") == b, F.col("first"))), F.lit(False)).alias("b")
    )
    enter, leave = ~F.col("a") & F.col("b"), F.col("a") & ~F.col("b")
    return wide.agg(
        ratio(F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") | F.col("b"))).alias("jaccard"), F.count_if(enter).alias("entering"), F.count_if(leave).alias("leaving"),
        F.sum(F.when(enter, F.col("pop")).otherwise(0.0)).alias("entering_pop"),
    )


def district_ranking(ranked: DataFrame, a: str, b: str, top: int = 5) -> DataFrame:
    """Rank correlation of the districts' summed loads under two representations and the overlap of their first ones."""
    loads = ranked.groupBy("rep", "district").agg(F.round(F.sum("load"), 6).alias("load"))
    wide = loads.where(F.col("rep") == a).select("district", F.col("load").alias("la")).join(loads.where(F.col("rep") == b).select("district", F.col("load").alias("lb")), "district")
    place = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "district")) <= top
    rows = wide.select("district", average_rank("la").alias("ra"), average_rank("lb").alias("rb"), place("la").alias("ta"), place("lb").alias("tb"))
    return rows.agg(pearson("ra", "rb").alias("rho"), F.count_if(F.col("ta") & F.col("tb")).alias("overlap"), F.count("*").alias("districts"))


def threshold_curve(hours: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """For each limit: share of hours below it by field and by the uniform field, and how fragile the hours are.

    Fragile hours are as near to the limit as to the uniform field, or nearer. ``hours`` has t and t_uniform.
    """
    grid = hours.sparkSession.createDataFrame([(float(u),) for u in thresholds], "u double")
    rows = hours.crossJoin(F.broadcast(grid))
    t, uniform, u = F.col("t"), F.col("t_uniform"), F.col("u")
    return rows.groupBy("u").agg(
        F.avg((t < u).cast("double")).alias("below"), F.avg((uniform < u).cast("double")).alias("below_uniform"),
        F.avg((F.abs(t - u) <= F.abs(t - uniform)).cast("double")).alias("fragile"), F.avg(((t < u) != (uniform < u)).cast("double")).alias("moved"),
    )


def factorial(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two by two: representation (local or regional) times shade (with or without). Coverages, main effects, interaction.

    ``rows`` has rep, shade (0/1), pop, reachable and frac.
    """
    cell = lambda rep, shade: ratio(
        F.sum(F.when((F.col("rep") == rep) & (F.col("shade") == shade) & F.col("reachable"), F.col("frac") * F.col("pop")).otherwise(0.0)),
        F.sum(F.when((F.col("rep") == rep) & (F.col("shade") == shade), F.col("pop")).otherwise(0.0)),
    )
    out = rows.groupBy(*by).agg(cell("regional", 0).alias("a"), cell("local", 0).alias("b"), cell("regional", 1).alias("c"), cell("local", 1).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    return out.select(*by, "a", "b", "c", "d", ((b - a + d - c) / 2).alias("effect_rep"), ((c - a + d - b) / 2).alias("effect_shade"), ((d - c) - (b - a)).alias("interaction"))


def saturation(rows: DataFrame, by: Sequence[str], least: float = 0.6) -> DataFrame:
    """Share of the reachable that meets the solar condition and whether that is too few for the heat to matter."""
    share = F.avg(F.when(F.col("reachable"), F.col("passes").cast("double")))
    return rows.groupBy(*by).agg(share.alias("passing"), (share < least).alias("saturated"))


def map_class(near: Column, cool: Column) -> Column:
    return F.when(near & cool, "both").when(near, "only distance").when(cool, "only heat").otherwise("none")


def change_class(reachable: Column, a: Column, b: Column) -> Column:
    return F.when(~reachable, "unreachable").when(a & b, "both").when(b, "added").when(a, "removed").otherwise("neither")


def mann_whitney(rows: DataFrame, value: str, flag: str) -> DataFrame:
    """U of the flagged against the others from average ranks, and its two-sided p by the normal approximation.

    Rows are counted by value first; ranks are those of values, dealt by ranges.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.count_if(flag).alias("f"), F.count_if(~F.col(flag)).alias("o"))
    sums = value_ranks(counts, value, "n").agg(
        F.coalesce(F.sum("f"), F.lit(0)).cast("double").alias("n1"), F.coalesce(F.sum("o"), F.lit(0)).cast("double").alias("n2"), F.coalesce(F.sum(F.col("f") * F.col("rank")), F.lit(0.0)).alias("rs")
    )
    u = F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2
    z = F.try_divide(u - F.col("n1") * F.col("n2") / 2, F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12))
    return sums.select("n1", "n2", u.alias("u"), z.alias("z"), (2 * (1 - normal_cdf(F.abs(z)))).alias("p"))


# budget regret


def captured_load(rows: DataFrame, reference: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Select under each representation, count the load of the reference one: capture, regret, overlap with its list.

    ``rows`` has rep and load for every reachable section.
    """
    grid = rows.sparkSession.createDataFrame([(float(x),) for x in fractions], "fraction double")
    keys = [*by, "fraction"]
    true_load = rows.where(F.col("rep") == reference).select(*by, "cusec", F.col("load").alias("true_load"))
    each = rows.join(true_load, [*by, "cusec"]).crossJoin(F.broadcast(grid))
    n = F.count("*").over(Window.partitionBy(*keys, "rep"))
    each = each.withColumn("k", quota(n, F.col("fraction"))).withColumn("chosen", top_k(F.col("load"), "cusec", F.col("k"), [*keys, "rep"]))
    best = each.where(F.col("rep") == reference).select(*keys, "cusec", F.col("chosen").alias("best"))
    each = each.join(best, [*keys, "cusec"])
    load = lambda flag: F.sum(F.when(F.col(flag), F.col("true_load")).otherwise(0.0))
    out = each.groupBy(*keys, "rep").agg(
        F.max("k").alias("k"), load("chosen").alias("captured"), load("best").alias("optimum"), F.count_if(F.col("chosen") & F.col("best")).alias("overlap"),
        ratio(F.count_if(F.col("chosen") & F.col("best")), F.count_if(F.col("chosen") | F.col("best"))).alias("jaccard"),
        F.sum(F.when(F.col("chosen"), F.col("pop")).otherwise(0.0)).alias("selected_pop"),
    )
    regret = F.col("optimum") - F.col("captured")
    return out.withColumn("regret", regret).withColumn("regret_pct", 100 * ratio(regret, F.col("optimum"))).withColumn("efficiency", ratio(F.col("captured"), F.col("optimum")))


def dominance(rows: DataFrame, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Which constraint decides the list: sun if its failures fill the quota, mixed from half of it, else heat."""
    grid = rows.sparkSession.createDataFrame([(float(x),) for x in fractions], "fraction double")
    counts = rows.where("reachable").groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col("passes")).alias("fails"))
    out = counts.crossJoin(F.broadcast(grid)).withColumn("quota", quota(F.col("n"), F.col("fraction")))
    regime = F.when(F.col("fails") >= F.col("quota"), "sun").when(2 * F.col("fails") >= F.col("quota"), "mixed").otherwise("heat")
    return out.withColumn("regime", regime)


def transitions(regimes: DataFrame, by: Sequence[str]) -> DataFrame:
    """The least fraction at which each regime holds."""
    return regimes.groupBy(*by).pivot("regime", ["sun", "mixed", "heat"]).agg(F.min("fraction"))


def paired_differences(replicates: DataFrame) -> DataFrame:
    """For every two representations a < other: the interval of their difference over the replicates that both have, and whether it holds zero.

    ``replicates`` has rep, b and value; representations are few.
    """
    one = replicates.select("b", F.col("rep").alias("a"), F.col("value").alias("va"))
    two = replicates.select("b", F.col("rep").alias("other"), F.col("value").alias("vb"))
    both = one.join(two, "b").where(F.col("a") < F.col("other"))
    ends = both.groupBy("a", "other").agg(F.percentile(F.col("va") - F.col("vb"), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    q = lambda i: F.get("q", F.lit(i))
    return ends.select("a", "other", q(0).alias("low"), q(1).alias("middle"), q(2).alias("high"), ((q(0) <= 0) & (q(2) >= 0)).alias("holds_zero"))


def walking_grid(nearest: DataFrame, cases: DataFrame, least: int = 30) -> DataFrame:
    """Reached sections and people, and minutes of their walks, for every case (speed, minutes, threshold) that reaches ``least`` sections.

    ``nearest`` has cusec, dist_m and pop; a walk longer than ``threshold`` minutes is long.
    """
    walk = F.col("dist_m") / F.col("speed") / 60
    rows = nearest.crossJoin(F.broadcast(cases)).withColumn("walk", walk).where(F.col("walk") <= F.col("minutes"))
    long = F.col("walk") > F.col("threshold")
    found = rows.groupBy("speed", "minutes", "threshold").agg(
        F.count("*").alias("sections"), F.sum("pop").alias("people"), F.avg("walk").alias("mean_walk"), (100 * ratio(F.sum(F.when(long, F.col("pop")).otherwise(0.0)), F.sum("pop"))).alias("long_pct")
    )
    return found.where(F.col("sections") >= least)


def layer_comparison(nearest: DataFrame, metres: float) -> DataFrame:
    """For every two layers of destinations a < other: sections in reach of each and of both, distances, and people whose reach changes.

    ``nearest`` has layer, cusec, dist_m and pop: a row per layer and section that has any destination; layers are few.
    """
    ends = F.percentile("dist_m", F.array(F.lit(0.5), F.lit(0.9)))
    each = nearest.groupBy("layer").agg(F.count_if(F.col("dist_m") <= metres).alias("reached"), ends.alias("q"))
    each = each.select("layer", "reached", F.col("q")[0].alias("median_m"), F.col("q")[1].alias("p90_m"))
    there = nearest.where(F.col("dist_m") <= metres).select("layer", "cusec", "pop")
    sets = there.groupBy("cusec").agg(F.collect_set("layer").alias("layers"), F.first("pop").alias("pop"))  # no more entries than layers
    pairs = each.select(F.col("layer").alias("a")).crossJoin(each.select(F.col("layer").alias("other"))).where("a < other")
    one, two = F.array_contains("layers", F.col("a")), F.array_contains("layers", F.col("other"))
    shared = sets.crossJoin(F.broadcast(pairs)).groupBy("a", "other").agg(
        ratio(F.count_if(one & two), F.count_if(one | two)).alias("jaccard"), F.count_if(one != two).alias("changed"), F.sum(F.when(one != two, F.col("pop")).otherwise(0.0)).alias("changed_people")
    )
    named = lambda key, tag: each.select(F.col("layer").alias(key), *[F.col(c).alias(f"{c}_{tag}") for c in ("reached", "median_m", "p90_m")])
    return shared.join(named("a", "a"), "a").join(named("other", "other"), "other")


def layer_priorities(nearest: DataFrame, loads: DataFrame, metres: float, fraction: float = 0.2) -> DataFrame:
    """For every two layers a < other the Jaccard of their priority lists, the first ``fraction`` by ``load`` (cusec, load) of what each reaches, and their sizes."""
    there = nearest.where(F.col("dist_m") <= metres).select("layer", "cusec").join(loads.select("cusec", "load"), "cusec")
    n = F.count("*").over(Window.partitionBy("layer"))
    listed = there.withColumn("k", quota(n, fraction)).withColumn("first", top_k(F.col("load"), "cusec", F.col("k"), ["layer"])).where("first")
    sizes = listed.groupBy("layer").agg(F.count("*").alias("size"))
    sets = listed.groupBy("cusec").agg(F.collect_set("layer").alias("layers"))  # no more entries than layers
    pairs = sizes.select(F.col("layer").alias("a"), F.col("size").alias("size_a")).crossJoin(sizes.select(F.col("layer").alias("other"), F.col("size").alias("size_other"))).where("a < other")
    one, two = F.array_contains("layers", F.col("a")), F.array_contains("layers", F.col("other"))
    return sets.crossJoin(F.broadcast(pairs)).groupBy("a", "other", "size_a", "size_other").agg(ratio(F.count_if(one & two), F.count_if(one | two)).alias("jaccard"))
