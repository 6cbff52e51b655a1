"""Quality control of dense sensor series: masks, coverage, flat runs, counters and the keep decision.

Readings have station, ts, t and a unique obs that orders readings of one instant.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.joins import small
from umbra.functions.stats import median, quantile, ratio


def _by_time():
    return Window.partitionBy("station").orderBy("ts", "obs")


def plausible(df: DataFrame, low: float = 5, high: float = 50) -> DataFrame:
    """Sentinels and impossible values become null before spikes are sought; ``out_of_range`` marks them."""
    out = F.coalesce((F.col("t") < low) | (F.col("t") > high), F.lit(False))
    return df.withColumn("out_of_range", out).withColumn("t_ok", F.when(~out, F.col("t")))


def despiked(df: DataFrame, jump: float = 4, least: int = 3) -> DataFrame:
    """Readings more than ``jump`` off the median of five rows become null, if three of them have a value."""
    around = _by_time().rowsBetween(-2, 2)
    centre = F.when(F.count("t_ok").over(around) >= least, F.percentile("t_ok", F.lit(0.5)).over(around))
    spike = F.coalesce(F.abs(F.col("t_ok") - centre) > jump, F.lit(False))
    return (
        df.withColumn("spike", spike)
        .withColumn("masked", F.col("out_of_range") | F.col("spike"))
        .withColumn("t_qc", F.when(~F.col("spike"), F.col("t_ok")))
        .drop("t_ok")
    )


def validated(df: DataFrame) -> DataFrame:
    return despiked(plausible(df))


def cadence(df: DataFrame) -> DataFrame:
    """Median gap in minutes and largest gap in hours per station."""
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(_by_time()))) / 60e6
    gaps = df.withColumn("gap", gap)
    return gaps.groupBy("station").agg(median("gap").alias("cadence_min"), (F.max("gap") / 60).alias("largest_gap_h"))


def coverage(df: DataFrame, slots: int, cadences: DataFrame, nominal: float) -> DataFrame:
    """Per station and year, the share of ``slots`` with a valid reading, scaled by the real cadence, 100 at most."""
    seen = df.where(F.col("t_qc").isNotNull()).groupBy("station", F.year("ts").alias("year")).agg(F.count_distinct("ts").alias("valid"))
    factor = F.greatest(F.lit(1.0), F.col("cadence_min") / nominal)
    pct = F.least(F.lit(100.0), 100.0 * F.col("valid") / slots * factor)
    return seen.join(cadences, "station").select("station", "year", "valid", pct.alias("coverage_pct"))


def coverage_wide(cover: DataFrame, years: list[int]) -> DataFrame:
    wide = cover.groupBy("station").pivot("year", years).agg(F.first("coverage_pct"))
    return wide.na.fill(0.0).withColumnsRenamed({str(y): f"cov_{y}" for y in years})


def flat_runs(df: DataFrame, gap_minutes: float, long: int) -> DataFrame:
    """Share of readings in runs of ``long`` or more equal values and the longest run; a null reading is a run of its own."""
    last, last_ts = F.lag("t").over(_by_time()), F.lag("ts").over(_by_time())
    far = (F.unix_micros("ts") - F.unix_micros(last_ts)) / 60e6 > gap_minutes
    starts = F.coalesce((F.col("t") != last) | far, F.lit(True))
    runs = df.withColumn("run", F.sum(starts.cast("int")).over(_by_time().rowsBetween(Window.unboundedPreceding, 0)))
    lengths = runs.groupBy("station", "run").agg(F.count("*").alias("n"))
    flat = F.sum(F.when(F.col("n") >= long, F.col("n")).otherwise(0))
    return lengths.groupBy("station").agg((100.0 * flat / F.sum("n")).alias("flat_pct"), F.max("n").alias("longest_run"))


def diurnal_range(df: DataFrame) -> DataFrame:
    days = df.groupBy("station", F.to_date("ts").alias("date")).agg((F.max("t_qc") - F.min("t_qc")).alias("range"))
    return days.groupBy("station").agg(F.avg("range").alias("range_mean"), quantile("range", 0.95).alias("range_p95"))


def counters(df: DataFrame) -> DataFrame:
    rows = F.count("*")
    return df.groupBy("station").agg(
        rows.alias("rows"),
        F.count("t_qc").alias("valid"),
        F.count_if(F.col("t") == 0).alias("zeros"),
        F.count_if("spike").alias("spikes"),
        (100.0 * F.count_if("masked") / rows).alias("masked_pct"),
        F.min("t_qc").alias("t_min"),
        F.max("t_qc").alias("t_max"),
        F.count_if((F.col("rh") < 0) | (F.col("rh") > 100)).alias("bad_rh"),
        (rows - F.count_distinct("ts")).alias("duplicates"),
    )


def robust_limit(df: DataFrame, column: str, factor: float = 3.0) -> DataFrame:
    """One row: median + factor * 1.4826 * MAD of the network."""
    centre = df.agg(median(column).alias("centre"))
    off = df.crossJoin(F.broadcast(centre)).withColumn("off", F.abs(F.col(column) - F.col("centre")))
    return off.groupBy("centre").agg(median("off").alias("mad")).select((F.col("centre") + factor * 1.4826 * F.col("mad")).alias("limit"))


def usable_summers(cover: DataFrame, least_pct: float = 80) -> DataFrame:
    return cover.groupBy("station").agg(F.count_if(F.col("coverage_pct") >= least_pct).alias("summers"), median("coverage_pct").alias("coverage_median"))


def decision(counts: DataFrame, flat: DataFrame, ranges: DataFrame, summers: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """keep or discard with all reasons; five rules."""
    limit = robust_limit(ranges, "range_mean")
    rows = counts.join(flat, "station").join(ranges, "station").join(summers, "station", "left").crossJoin(F.broadcast(limit))
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce("summers", F.lit(0)) < limits["summers"], "few summers"),
            F.when(F.col("masked_pct") > limits["masked_pct"], "masked"),
            F.when(F.col("flat_pct") > limits["flat_pct"], "flat"),
            F.when(F.col("range_mean") > F.col("limit"), "wide range"),
            F.when(F.col("duplicates") > limits["duplicates"], "duplicates"),
        )
    )
    return rows.select("station", F.when(F.size(reasons) == 0, "keep").otherwise("discard").alias("decision"), F.array_join(reasons, ";").alias("reasons"))


def gate_summary(decisions: DataFrame, scopes: DataFrame) -> DataFrame:
    return decisions.join(scopes, "station").groupBy("scope").agg(
        F.count("*").alias("stations"), F.count_if(F.col("decision") == "keep").alias("kept")
    )


def coast_distance(points: DataFrame, line: DataFrame) -> DataFrame:
    """Least distance of each point (station, x, y) to the segments (ax, ay, bx, by) of a polyline; the line is a small table."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along = F.try_divide((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy, dx * dx + dy * dy)
    t = F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    far = F.hypot(F.col("x") - F.col("ax") - t * dx, F.col("y") - F.col("ay") - t * dy)
    return points.crossJoin(small(line)).groupBy("station").agg(F.min(far).alias("coast_m"))


def replicas(df: DataFrame, common: int, tolerance: float = 1e-9) -> DataFrame:
    """(series, group): series equal at more than ``common`` instants share the least name among them."""
    a, b = (df.select("ts", F.col("series").alias(n), F.col("t").alias(f"t_{n}")) for n in "ab")
    pairs = a.join(b, "ts").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.max(F.abs(F.col("t_a") - F.col("t_b"))).alias("off"))
    same = pairs.where((F.col("n") > common) & (F.col("off") < tolerance)).groupBy(F.col("b").alias("series")).agg(F.min("a").alias("group"))
    return df.select("series").distinct().join(same, "series", "left").withColumn("group", F.coalesce("group", "series"))


def between_stations(df: DataFrame, stations: int) -> DataFrame:
    """Sample deviation between stations at instants where all ``stations`` report."""
    return df.groupBy("ts").agg(F.count_distinct("station").alias("n"), F.stddev_samp("t").alias("sd")).where(F.col("n") == stations)


def deduplicated(df: DataFrame) -> DataFrame:
    """Exact repeats count once; an instant with conflicting values goes."""
    return df.groupBy("station", "ts").agg(F.min("t").alias("t"), F.count_distinct("t").alias("values")).where("values = 1").drop("values")


def lone_jumps(df: DataFrame, jump: float) -> DataFrame:
    """Null where a reading is ``jump`` off both neighbours to the same side."""
    order = Window.partitionBy("station").orderBy("ts")
    before, after = F.col("t") - F.lag("t").over(order), F.col("t") - F.lead("t").over(order)
    alone = F.coalesce((F.abs(before) > jump) & (F.abs(after) > jump) & (F.signum(before) == F.signum(after)), F.lit(False))
    return df.withColumn("alone", alone).withColumn("t_ok", F.when(~F.col("alone"), F.col("t")))


def hourly_complete(df: DataFrame, least: int) -> DataFrame:
    hours = df.groupBy("station", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("t_ok").alias("n"), F.avg("t_ok").alias("t"))
    return hours.where(F.col("n") >= least)


def clock_scenarios(df: DataFrame, hours: list[int]) -> DataFrame:
    """The same stamps read with other offsets from local time."""
    offsets = df.sparkSession.createDataFrame([(h,) for h in hours], "offset_h int")
    return df.crossJoin(F.broadcast(offsets)).withColumn("local_ts", F.col("ts") + F.make_dt_interval(hours=F.col("offset_h")))


def checks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """A row per rule: whether the aggregate condition holds over the frame."""
    held = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()])
    return held.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("ok")) for n in rules])).alias("r")).select("r.*")


def mean_residual(df: DataFrame, observed: str, modelled: str) -> DataFrame:
    """The correction observed minus modelled, and what is left after adding it; it must vanish."""
    fix = df.agg((F.avg(observed) - F.avg(modelled)).alias("correction"))
    return df.crossJoin(F.broadcast(fix)).groupBy("correction").agg(F.avg(F.col(observed) - F.col(modelled) - F.col("correction")).alias("residual"))


def valid_share(column: str) -> Column:
    return ratio(F.count(column), F.count("*"))
