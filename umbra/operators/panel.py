"""Thermal panel: hourly means, network reference, anomalies and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.joins import small
from umbra.functions.stats import average_rank, circular_mean, median, pearson, quantile, ratio, sector, spearman
from umbra.sources.staging import staged

NIGHT, AFTERNOON = range(0, 7), range(12, 19)


def hourly(df: DataFrame) -> DataFrame:
    """Means per station, date and hour; the wind direction is averaged arithmetically here."""
    means = [F.avg(c).alias(n) for c, n in (("t_qc", "t"), ("rh", "rh"), ("wind", "wind"), ("wind_dir", "wind_dir"))]
    return df.groupBy("station", F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(*means, F.count("t_qc").alias("n")).where("n > 0")


def reference(panel: DataFrame, least: int = 3) -> DataFrame:
    """Network median, count and spread at each instant with ``least`` stations or more."""
    spread = {"p90": 0.9, "p10": 0.1, "p75": 0.75, "p25": 0.25}
    return (
        panel.groupBy("date", "hour")
        .agg(median("t").alias("t_ref"), F.count("*").alias("n_stations"), *[quantile("t", q).alias(n) for n, q in spread.items()])
        .where(F.col("n_stations") >= least)
        .withColumn("dispersion", F.col("p90") - F.col("p10"))
        .withColumn("iqr", F.col("p75") - F.col("p25"))
    )


def anomalies(panel: DataFrame, least: int = 3) -> DataFrame:
    return panel.join(reference(panel, least), ["date", "hour"]).withColumn("dt", F.col("t") - F.col("t_ref"))


def in_hours(hours: Sequence[int]) -> Column:
    return F.col("hour").isin(*hours)


def dispersion_profile(ref: DataFrame) -> DataFrame:
    return ref.groupBy("hour").agg(F.avg("dispersion").alias("dispersion"), F.avg("iqr").alias("iqr"), median("dispersion").alias("dispersion_median"), F.count("*").alias("instants"))


def warm_episodes(ref: DataFrame, q: float = 0.9) -> DataFrame:
    """Dispersion by hour on days whose highest reference reaches the quantile of such maxima, and on other days."""
    days = ref.groupBy("date").agg(F.max("t_ref").alias("top"))
    limit = days.agg(quantile("top", q).alias("limit"))
    marked = days.crossJoin(F.broadcast(limit)).select("date", (F.col("top") >= F.col("limit")).alias("warm"))
    return ref.join(marked, "date").groupBy("hour").agg(
        F.avg(F.when(F.col("warm"), F.col("dispersion"))).alias("warm"), F.avg(F.when(~F.col("warm"), F.col("dispersion"))).alias("other")
    )


def station_anomaly(dt: DataFrame) -> DataFrame:
    window = lambda hours: F.avg(F.when(in_hours(hours), F.col("dt")))
    return dt.groupBy("station").agg(
        F.avg("dt").alias("dt_mean"), window(NIGHT).alias("dt_night"), window(AFTERNOON).alias("dt_afternoon"), F.count("*").alias("n"), F.count_distinct("date").alias("days")
    )


def hour_pivot(dt: DataFrame, hours: Sequence[int]) -> DataFrame:
    return dt.groupBy("station").pivot("hour", list(hours)).agg(F.avg("dt")).withColumnsRenamed({str(h): f"h{h:02d}" for h in hours})


def year_stability(dt: DataFrame, hours: Sequence[int] = NIGHT, least: int = 4) -> DataFrame:
    """Rank correlation of station anomalies of every two years over the stations that both have."""
    yearly = dt.where(in_hours(hours)).groupBy("station", F.year("date").alias("year")).agg(F.avg("dt").alias("dt"))
    a, b = (yearly.select("station", F.col("year").alias(f"year_{n}"), F.col("dt").alias(f"dt_{n}")) for n in "ab")
    pairs = a.join(b, "station").where("year_a < year_b")
    return spearman(pairs, "dt_a", "dt_b", ["year_a", "year_b"]).where(F.col("n") >= least)


def warm_nights(panel: DataFrame, limits: Sequence[float], hours: Sequence[int] = NIGHT) -> DataFrame:
    """Nights per station with a minimum at or above each limit."""
    nights = panel.where(in_hours(hours)).groupBy("station", "date").agg(F.min("t").alias("low"))
    counts = [F.count_if(F.col("low") >= x).alias(f"nights_{x:g}") for x in limits]
    return nights.groupBy("station").agg(F.count("*").alias("nights"), *counts, *[(100.0 * F.count_if(F.col("low") >= x) / F.count("*")).alias(f"pct_{x:g}") for x in limits])


def complete_nights(panel: DataFrame, least: int, hours: Sequence[int] = NIGHT) -> DataFrame:
    """The rows of nights on which ``least`` stations report or more."""
    night = panel.where(in_hours(hours))
    full = night.groupBy("date").agg(F.count_distinct("station").alias("n")).where(F.col("n") >= least).select("date")
    return night.join(full, "date", "left_semi")


def _at_share(values: Column, n: Column, p: float) -> Column:
    """Linear quantile of a sorted array of ``n`` values."""
    at = (n - 1) * p
    low = F.floor(at).cast("int")
    return F.get(values, low) + (at - low) * (F.get(values, F.ceil(at).cast("int")) - F.get(values, low))


def _around(values: Column, n: Column, p: float) -> Column:
    """What the linear quantile of a sorted array without one of its ``n`` values depends on: places, share, and the values there and one further on."""
    at = (n - 2) * p
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    near = {"low_0": F.get(values, low), "low_1": F.get(values, low + 1), "high_0": F.get(values, high), "high_1": F.get(values, high + 1)}
    return F.struct(low.alias("low"), high.alias("high"), (at - low).alias("share"), *[c.alias(name) for name, c in near.items()])


def _without(around: Column, k: Column) -> Column:
    """The quantile without the value at place ``k``: from there on places shift by one."""
    low = F.when(around["low"] < k, around["low_0"]).otherwise(around["low_1"])
    high = F.when(around["high"] < k, around["high_0"]).otherwise(around["high_1"])
    return low + around["share"] * (high - low)


def contenders(totals: DataFrame) -> DataFrame:
    """The rows of ``totals`` (station, base_n, sure, high, low, top, bottom) that can be the hottest or coldest when any one station is left out.

    A station's mean can't leave the bounds that follow from the most that any other one moves the reference at each of its instants. Two
    stations stay above the second highest lower bound, so one of them is there whichever is left out, and who can't reach that bound is never the hottest.
    """
    sure = F.col("sure") > 0  # others may have no instant left
    upper = F.when(sure, F.col("high") / F.when(F.col("high") > 0, F.col("sure")).otherwise(F.col("base_n"))).otherwise(F.col("top"))
    lower = F.when(sure, F.col("low") / F.when(F.col("low") > 0, F.col("base_n")).otherwise(F.col("sure"))).otherwise(F.col("bottom"))
    rows = totals.withColumn("upper", upper).withColumn("lower", lower)
    second = lambda order, c: ([r[0] for r in rows.where("sure > 0").orderBy(order).select(c).limit(2).collect()] + [None, None])[1]
    least_top, most_bottom = second(F.desc("lower"), "lower"), second(F.asc("upper"), "upper")
    if least_top is None:
        return totals
    slack = 1e-6  # far more than means are rounded by
    return rows.where((F.col("upper") >= least_top - slack) | (F.col("lower") <= most_bottom + slack)).drop("upper", "lower")


def leave_one_out(panel: DataFrame, stations: DataFrame, least: int = 3) -> DataFrame:
    """Mean dispersion and the hottest and coldest station when each station is left out in turn.

    The values of an instant are sorted once: quantiles without one of them are shifts of places. Where a station doesn't report, nothing changes
    without it, so only instants that two stations share correct what the second one has in all. Only ``contenders`` meet the others there.
    """
    instants = panel.where("t IS NOT NULL").groupBy("date", "hour").agg(F.array_sort(F.collect_list(F.struct("t", "station"))).alias("v"))
    instants = instants.withColumn("n", F.size("v")).where(F.col("n") >= least).withColumn("t", F.transform("v", lambda x: x["t"]))
    shares = {"ref": 0.5, "p90": 0.9, "p10": 0.1}
    instants = instants.select("date", "hour", "v", "n", *[_at_share(F.col("t"), F.col("n"), p).alias(c) for c, p in shares.items()], *[_around(F.col("t"), F.col("n"), p).alias(f"{c}_around") for c, p in shares.items()])
    stays, around = F.col("n") > least, F.col("ref_around")  # enough are left without one
    most = F.greatest(F.lit(0.0), F.col("ref") - around["low_0"] - around["share"] * (around["high_0"] - around["low_0"]))
    fewest = F.least(F.lit(0.0), F.col("ref") - around["low_1"] - around["share"] * (around["high_1"] - around["low_1"]))
    spread = F.col("p90") - F.col("p10")
    each = F.inline(F.transform("v", lambda x, k: F.struct(
        x["station"].alias("station"), (x["t"] - F.col("ref")).alias("d"), F.when(stays, F.col("ref") - _without(F.col("ref_around"), k)).alias("shift"),
        (F.when(stays, _without(F.col("p90_around"), k) - _without(F.col("p10_around"), k)).otherwise(0.0) - spread).alias("more"), F.when(k == 0, spread).alias("spread"),
    )))
    readings = staged(instants.select("date", "hour", stays.alias("stays"), most.alias("most"), fewest.alias("fewest"), each))
    whole = readings.agg(F.coalesce(F.sum("spread"), F.lit(0.0)).alias("all_spread"), F.count("spread").alias("all_n"))
    gone = F.sum(F.col("stays").cast("int") - 1)
    totals = staged(readings.groupBy("station").agg(
        F.sum("d").alias("base"), F.count("*").alias("base_n"), F.sum(F.col("stays").cast("int")).alias("sure"), F.sum("more").alias("more"), gone.alias("more_n"),
        F.sum(F.when(F.col("stays"), F.col("d") + F.col("most")).otherwise(F.greatest(F.lit(0.0), F.col("d")))).alias("high"),
        F.sum(F.when(F.col("stays"), F.col("d") + F.col("fewest")).otherwise(F.least(F.lit(0.0), F.col("d")))).alias("low"), F.max("d").alias("top"), F.min("d").alias("bottom"),
    ))
    left = stations.select(F.col("station").alias("without")).distinct()
    kept = left.join(totals.select(F.col("station").alias("without"), "more", "more_n"), "without", "left").crossJoin(F.broadcast(whole))
    n = F.col("all_n") + F.coalesce("more_n", F.lit(0))
    kept = kept.select("without", ratio(F.col("all_spread") + F.coalesce("more", F.lit(0.0)), n).alias("dispersion"), n.alias("instants")).where("instants > 0")
    few = small(contenders(totals).select("station", "base", "base_n"))
    shared = small(readings.join(few, "station", "left_semi").select("date", "hour", "station", "d"))
    pairs = readings.select("date", "hour", "stays", "shift", F.col("station").alias("without")).join(shared, ["date", "hour"]).where("station <> without")
    moved = pairs.groupBy("without", "station").agg(F.sum(F.when(F.col("stays"), F.col("shift")).otherwise(-F.col("d"))).alias("move"), gone.alias("move_n"))
    each = left.crossJoin(few).where("station <> without").join(moved, ["without", "station"], "left")
    count = F.col("base_n") + F.coalesce("move_n", F.lit(0))
    means = each.where(count > 0).select("without", "station", ((F.col("base") + F.coalesce("move", F.lit(0.0))) / count).alias("dt"))
    order = lambda sign: F.struct(F.round(sign * F.col("dt"), 9), F.col("station"))
    ends = means.groupBy("without").agg(F.min_by("station", order(-1)).alias("hottest"), F.min_by("station", order(1)).alias("coldest"))
    return kept.join(ends, "without")


def heat_island(panel: DataFrame, rural: DataFrame, hours: Sequence[int] = NIGHT) -> DataFrame:
    """Night excess of every station over the median of the rural ones."""
    base = panel.join(small(rural.select("station")), "station", "left_semi").groupBy("date", "hour").agg(median("t").alias("rural"))
    return panel.where(in_hours(hours)).join(base, ["date", "hour"]).groupBy("station").agg(F.avg(F.col("t") - F.col("rural")).alias("uhi"), F.count("*").alias("n"))


def wind_regimes(panel: DataFrame, hours: Sequence[int] = AFTERNOON) -> DataFrame:
    """Sector of the circular mean of each day's afternoon directions."""
    days = panel.where(in_hours(hours)).groupBy("date").agg(circular_mean(F.col("wind_dir")).alias("direction"))
    return days.withColumn("regime", sector(F.round("direction", 9)))


def dispersion_by_regime(ref: DataFrame, regimes: DataFrame) -> DataFrame:
    return ref.join(regimes.where("regime is not null"), "date").groupBy("regime").agg(
        F.avg("dispersion").alias("dispersion"), F.count("*").alias("instants"), F.count_distinct("date").alias("days")
    )


def coherence(station_dt: DataFrame, facts: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Rank correlation of night and afternoon anomalies with each covariate, in long form."""
    long = station_dt.join(facts, "station").select(
        "station", "dt_night", "dt_afternoon", F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).alias("value")) for c in covariates])).alias("c")
    ).select("station", "dt_night", "dt_afternoon", "c.*")
    night = spearman(long, "dt_night", "value", ["covariate"], "rho_night").drop("n")
    return night.join(spearman(long, "dt_afternoon", "value", ["covariate"], "rho_afternoon"), "covariate")


def dispersion_by_scale(panel: DataFrame, panels: DataFrame, windows: DataFrame) -> DataFrame:
    """Dispersion for every panel (panel, station, least) and window (window, from_hour, to_hour); both are small tables."""
    rows = panel.join(small(panels), "station")
    ref = rows.groupBy("panel", "least", "date", "hour").agg(F.count("*").alias("n"), (quantile("t", 0.9) - quantile("t", 0.1)).alias("dispersion"), F.stddev_pop("t").alias("sd")).where("n >= least")
    inside = F.col("hour").between(F.col("from_hour"), F.col("to_hour"))
    return ref.join(F.broadcast(windows), inside).groupBy("panel", "window").agg(
        F.avg("dispersion").alias("dispersion"), F.avg("sd").alias("sd"), F.count("*").alias("instants")
    )


def rank_reversal(station_dt: DataFrame) -> DataFrame:
    """Ranks by day and by night (1 is warmest) and their correlation."""
    both = station_dt.where("dt_night is not null and dt_afternoon is not null")
    ranked = both.withColumn("rank_night", average_rank("dt_night", descending=True)).withColumn("rank_day", average_rank("dt_afternoon", descending=True))
    return ranked.agg(
        pearson("rank_night", "rank_day").alias("rho"), F.max(F.abs(F.col("rank_night") - F.col("rank_day"))).alias("largest_move"),
        F.count_if(F.signum("dt_night") != F.signum("dt_afternoon")).alias("sign_changes"), F.count("*").alias("stations"),
    )


def summary(dt: DataFrame) -> DataFrame:
    by_station = station_anomaly(dt)
    return by_station.agg(
        F.count("*").alias("stations"), F.min("dt_mean").alias("dt_min"), median("dt_mean").alias("dt_median"), F.max("dt_mean").alias("dt_max"),
        (F.max("dt_night") - F.min("dt_night")).alias("night_range"), ratio(F.count_if(F.col("dt_night") > 0), F.count("dt_night")).alias("warm_share"),
    )
