"""Thermal fields on sections: distance weighting, grid cells, bias, exceedance and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.joins import small
from umbra.functions.stats import circular_mean, median, ratio, share, spearman
from umbra.operators import spatial
from umbra.sources.staging import staged


def distances(sections: DataFrame, stations: DataFrame) -> DataFrame:
    """Every section with every station and their distance; stations are a small table."""
    spots = stations.select("station", F.col("x").alias("sx"), F.col("y").alias("sy"))
    return sections.crossJoin(small(spots)).withColumn("d", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))).drop("sx", "sy")


def nearest(sections: DataFrame, stations: DataFrame, k: int) -> DataFrame:
    """``distances``, but of every section only the ``k`` nearest stations and those as far as the last one.

    Stations are looked for in cells around; sections with fewer than ``k`` within the size of a cell look in cells of twice the size. Those left when cells
    are as large as the area of the stations meet all of them.
    """
    spots = staged(stations.select("station", F.col("x").alias("sx"), F.col("y").alias("sy")))
    wide, high = F.max("sx") - F.min("sx"), F.max("sy") - F.min("sy")
    area = spots.agg(F.count("*").alias("n"), F.greatest(wide, high).alias("span")).first()
    kept = F.rank().over(Window.partitionBy("cusec").orderBy("d")) <= k
    left, found, span = sections, [], area["span"] or 0.0
    size = span * (2 * k / max(area["n"], 1)) ** 0.5
    cell = lambda c: F.floor(F.col(c) / size)
    around = F.sequence(F.lit(-1), F.lit(1))
    while 0 < size < span:
        looked = left.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumn("_cx", cell("x") + F.col("_dx")).withColumn("_cy", cell("y") + F.col("_dy"))
        placed = spots.withColumn("_cx", cell("sx")).withColumn("_cy", cell("sy"))
        met = looked.join(placed, ["_cx", "_cy"]).withColumn("d", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))).where(F.col("d") <= size)
        full = met.withColumn("_n", F.count("*").over(Window.partitionBy("cusec"))).where(F.col("_n") >= k)
        found.append(staged(full.withColumn("_kept", kept).where("_kept").select(*sections.columns, "station", "d")))
        left = staged(left.join(found[-1].select("cusec"), "cusec", "left_anti"))
        size *= 2
        if left.limit(1).count() == 0:
            break
    rest = distances(left, stations).withColumn("_kept", kept).where("_kept").select(*sections.columns, "station", "d")
    for more in found:
        rest = rest.unionByName(more)
    return rest


def weights(pairs: DataFrame, power: float = 2.0, least_m: float = 50.0) -> DataFrame:
    return pairs.withColumn("w", 1 / F.pow(F.greatest("d", F.lit(least_m)), F.lit(power)))


def variants(pairs: DataFrame, grid: DataFrame) -> DataFrame:
    """Weights for each variant (variant, power, nearest, skip): the k nearest without the ``skip`` nearest, ties at the last kept."""
    place = F.rank().over(Window.partitionBy("cusec").orderBy("d"))
    rows = pairs.withColumn("place", place).crossJoin(F.broadcast(grid))
    kept = rows.where((F.col("place") > F.col("skip")) & (F.col("place") <= F.col("skip") + F.col("nearest")))
    return kept.withColumn("w", 1 / F.pow(F.greatest("d", F.lit(50.0)), F.col("power")))


def field(weighted: DataFrame, readings: DataFrame, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Weighted mean over the stations present at each instant with ``least`` stations; weights renormalise by themselves.

    Readings are dealt by instants once, to parts that do not depend on their bytes, as each meets all places around; what follows stays in its part, if weights can be broadcast.
    """
    n = F.count("*").over(Window.partitionBy("date", "hour"))
    parts = 8 * int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = readings.repartition(parts, "date", "hour").withColumn("present", n).where(F.col("present") >= least)
    return full.join(small(weighted, 1_000_000), "station").groupBy(*by, "cusec", "date", "hour").agg(ratio(F.sum(F.col("w") * F.col("t")), F.sum("w")).alias("t"))


def nearest_cell(sections: DataFrame, cells: DataFrame) -> DataFrame:
    """The nearest cell (cell, x, y, t) that ever has a value, ties to the smaller cell."""
    valid = cells.groupBy("cell").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.count("t").alias("n")).where("n > 0")
    found = spatial.nearest(sections.select(F.col("cusec").alias("point"), "x", "y"), valid.select(F.col("cell").alias("target"), "x", "y"))
    return found.select(F.col("point").alias("cusec"), F.col("target").alias("cell"), "d")


def bias(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What must be added to the grid value to match the local mean."""
    return pairs.groupBy(*by).agg((F.avg("t_local") - F.avg("t_grid")).alias("correction"), F.count("*").alias("n"))


def uniform(rows: DataFrame) -> DataFrame:
    """The median over sections at each instant, and the mean over the day."""
    instant, day = Window.partitionBy("date", "hour"), Window.partitionBy("date")
    return rows.withColumn("t_uniform", F.percentile("t", F.lit(0.5)).over(instant)).withColumn("t_day", F.avg("t").over(day))


def uniform_of_places(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(date, hour, t_uniform, t_day): the same over sections, from the field ``rows`` (cusec, date, hour, t) of their places and the number ``n`` of sections at each of them (cusec, n)."""
    known = F.when(F.col("t").isNotNull(), F.col("n"))
    instants = rows.join(small(counts), "cusec").groupBy("date", "hour").agg(F.percentile("t", F.lit(0.5), F.col("n")).alias("t_uniform"), F.sum(F.col("t") * F.col("n")).alias("total"), F.sum(known).alias("n"))
    instants = staged(instants)
    days = instants.groupBy("date").agg(ratio(F.sum("total"), F.sum("n")).alias("t_day"))
    return instants.join(days, "date").select("date", "hour", "t_uniform", "t_day")


def safe_fraction(rows: DataFrame, limits: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Share of hours below each limit; a missing hour counts as not below."""
    grid = rows.sparkSession.createDataFrame([(float(u),) for u in limits], "u double")
    return rows.crossJoin(F.broadcast(grid)).groupBy(*by, "u").agg(share(F.col("t") < F.col("u")).alias("frac"))


def station_comparison(pairs: DataFrame, limit: float = 30.0) -> DataFrame:
    """Observed and gridded value at each station: means, bias, shares at or over the limit, ranges."""
    return pairs.groupBy("station").agg(
        F.avg("t_local").alias("local"), F.avg("t_grid").alias("grid"), F.avg(F.col("t_grid") - F.col("t_local")).alias("bias"),
        (100 * share(F.col("t_local") >= limit)).alias("local_hot"), (100 * share(F.col("t_grid") >= limit)).alias("grid_hot"),
        (F.max("t_local") - F.min("t_local")).alias("local_range"), F.count("*").alias("n"),
    )


def spatial_spread(fractions: DataFrame, by: Sequence[str]) -> DataFrame:
    return fractions.groupBy(*by).agg(
        F.stddev_pop("frac").alias("sd"), (F.max("frac") - F.min("frac")).alias("range"), F.count_distinct(F.round("frac", 6)).alias("values"), F.count("*").alias("sections")
    )


def leave_year_out(pairs: DataFrame, least: int = 50) -> DataFrame:
    """Correct each year by the bias of all others; residual bias and error. Years with too few rows on either side go."""
    years = pairs.select(F.col("year").alias("fold")).distinct()
    rows = pairs.crossJoin(F.broadcast(years))
    train = rows.where("year <> fold").groupBy("fold").agg((F.avg("t_local") - F.avg("t_grid")).alias("correction"), F.count("*").alias("n_train"))
    off = F.col("t_grid") + F.col("correction") - F.col("t_local")
    out = rows.where("year = fold").join(train, "fold").groupBy("fold", "correction", "n_train").agg(F.avg(off).alias("residual"), F.sqrt(F.avg(off * off)).alias("rmse"), F.count("*").alias("n"))
    return out.where((F.col("n_train") >= least) & (F.col("n") >= least))


def hourly_regime(panel: DataFrame, weak: float = 6.0) -> DataFrame:
    """Network wind at each instant: sector of the vector mean in [lo, hi) quarters; weak wind overrides."""
    winds = panel.groupBy("date", "hour").agg(circular_mean(F.col("wind_dir")).alias("direction"), F.avg("wind").alias("speed"))
    at = F.round("direction", 9)
    quarter = F.when(at < 90, "NE").when(at < 180, "SE").when(at < 270, "SW").otherwise("NW")
    return winds.withColumn("regime", F.when(F.col("speed") < weak, "weak").otherwise(quarter))


def instant_slopes(errors: DataFrame) -> DataFrame:
    """Slope of the error on distance among the stations of an instant."""
    return errors.groupBy("date", "hour").agg(F.try_divide(F.covar_pop("err", "km"), F.var_pop("km")).alias("slope"), F.count("*").alias("n")).where("n >= 3 and slope is not null")


def slope_by_regime(slopes: DataFrame, regimes: DataFrame, least: int = 30) -> DataFrame:
    return slopes.join(regimes, ["date", "hour"]).groupBy("regime").agg(F.avg("slope").alias("slope"), F.count("*").alias("n")).where(F.col("n") >= least)


def slope_by_tercile(slopes: DataFrame, winds: DataFrame) -> DataFrame:
    """Mean slope by tercile of wind speed."""
    rows = slopes.join(winds, ["date", "hour"])
    cuts = rows.agg(F.percentile("speed", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")).select(F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q2"))
    tercile = F.when(F.col("speed") <= F.col("q1"), 1).when(F.col("speed") <= F.col("q2"), 2).otherwise(3)
    return rows.crossJoin(F.broadcast(cuts)).withColumn("tercile", tercile).groupBy("tercile").agg(F.avg("slope").alias("slope"), F.count("*").alias("n"))


def station_errors(errors: DataFrame) -> DataFrame:
    return errors.groupBy("station").agg(F.avg("err").alias("err"), F.count("*").alias("n"))


def centred(rows: DataFrame, columns: Sequence[str], least: int) -> DataFrame:
    """Values less their mean at the instant, at instants with ``least`` sites or more."""
    instant = Window.partitionBy("date", "hour")
    full = rows.withColumn("sites", F.count("*").over(instant)).where(F.col("sites") >= least)
    for c in columns:
        full = full.withColumn(f"{c}_mean", F.avg(c).over(instant)).withColumn(f"{c}_c", F.col(c) - F.col(f"{c}_mean"))
    return full


def error_parts(rows: DataFrame, observed: str, predicted: str) -> DataFrame:
    """Bias, mean absolute error, and its split into an offset common to the instant and a spatial residual."""
    off = F.col(predicted) - F.col(observed)
    instants = rows.groupBy("date", "hour").agg(F.avg(off).alias("common"))
    each = rows.join(instants, ["date", "hour"])
    spatial = each.agg(F.avg(off).alias("bias"), F.avg(F.abs(off)).alias("mae"), F.avg(F.abs(off - F.col("common"))).alias("spatial"))
    return spatial.crossJoin(instants.agg(F.avg(F.abs("common")).alias("common"), F.count("*").alias("instants")))


def site_pattern(means: DataFrame, value: str, predictor: str) -> DataFrame:
    """Of site means: deviation, amplitude, slope on the predictor and rank correlation with it."""
    rho = spearman(means, value, predictor).select("rho")
    fit = means.agg(
        F.stddev_samp(value).alias("sd"), (F.max(value) - F.min(value)).alias("amplitude"), F.try_divide(F.covar_pop(value, predictor), F.var_pop(predictor)).alias("slope"), F.count("*").alias("sites")
    )
    return fit.crossJoin(F.broadcast(rho))


def section_means(rows: DataFrame, by: Sequence[str] = (), near: tuple[float, float] = (29, 31)) -> DataFrame:
    """Of every section the mean, and the share of its hours in [near[0], near[1])."""
    return rows.groupBy(*by, "cusec").agg(F.avg("t").alias("t"), F.avg(((F.col("t") >= near[0]) & (F.col("t") < near[1])).cast("double")).alias("near"))


def gradient(means: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Slope per 10 km of ``section_means`` on easting, and the share of section-hours near the limit."""
    return means.groupBy(*by).agg((F.try_divide(F.covar_pop("t", "x"), F.var_pop("x")) * 10_000).alias("per_10km"), F.avg("near").alias("near"), F.count("*").alias("sections"))


def validation(rows: DataFrame, by: Sequence[str], observed: str, predictors: Sequence[str]) -> DataFrame:
    """n, MAE, RMSE and bias of each predictor in each group."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("method"), (F.col(p) - F.col(observed)).alias("e")) for p in predictors]))
    long = rows.withColumn("m", each).select(*by, "m.*").where("e is not null")
    return long.groupBy(*by, "method").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"))


def time_alignment(local: DataFrame, grid: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Error of the grid when its stamps are moved by each number of hours."""
    moves = grid.sparkSession.createDataFrame([(h,) for h in offsets], "shift int")
    moved = grid.crossJoin(F.broadcast(moves)).withColumn("ts", F.col("ts") + F.make_dt_interval(hours=F.col("shift")))
    rows = local.join(moved, ["station", "ts"])
    e: Column = F.col("t_grid") - F.col("t_local")
    return rows.groupBy("shift").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def local_hours(cells: DataFrame, zone: str) -> DataFrame:
    """UTC stamps as local time, Kelvin as Celsius."""
    return cells.withColumn("local_ts", F.from_utc_timestamp("ts", zone)).withColumn("t", F.col("t2m") - 273.15)


def median_by(rows: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    return rows.groupBy(*by).agg(median(column).alias(f"{column}_median"))
