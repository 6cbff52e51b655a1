"""Thermal panel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.operators import panel as P
from umbra.operators import quality as Q
from umbra.plans.inputs import REGISTRY, observations, stations


def panel(spark, d):
    return P.hourly(Q.validated(observations(spark, d)))


def anomaly(spark, d):
    return P.anomalies(panel(spark, d))


def reference(spark, d):
    return P.reference(panel(spark, d))


_REF = "(SELECT *, p90 - p10 AS dispersion, p75 - p25 AS iqr FROM reference)"
_STATION = """SELECT station, avg(dt) AS dt_mean, avg(dt) FILTER (hour BETWEEN 0 AND 6) AS dt_night, avg(dt) FILTER (hour BETWEEN 12 AND 18) AS dt_afternoon,
    count(*) AS n, count(DISTINCT date) AS days FROM anomaly GROUP BY station"""


@REGISTRY.add("pan_hourly", "SELECT * REPLACE (date::VARCHAR AS date) FROM hourly", "hourly", "t rh wind wind_dir")
def _(spark, d):
    return panel(spark, d)


@REGISTRY.add("pan_reference", f"SELECT * REPLACE (date::VARCHAR AS date) FROM {_REF}", "reference", "t_ref p90 p10 p75 p25 dispersion iqr")
def _(spark, d):
    return reference(spark, d)


@REGISTRY.add(
    "pan_dispersion_profile",
    f"SELECT hour, avg(dispersion) AS dispersion, avg(iqr) AS iqr, median(dispersion) AS dispersion_median, count(*) AS instants FROM {_REF} GROUP BY hour",
    "reference",
    "dispersion iqr dispersion_median",
)
def _(spark, d):
    return P.dispersion_profile(reference(spark, d))


@REGISTRY.add(
    "pan_warm_episodes",
    f"""WITH days AS (SELECT date, max(t_ref) AS top FROM reference GROUP BY date),
    marked AS (SELECT date, top >= (SELECT quantile_cont(top, 0.9) FROM days) AS warm FROM days)
    SELECT hour, avg(dispersion) FILTER (warm) AS warm, avg(dispersion) FILTER (NOT warm) AS other FROM {_REF} JOIN marked USING (date) GROUP BY hour""",
    "reference",
    "warm other",
)
def _(spark, d):
    return P.warm_episodes(reference(spark, d))


@REGISTRY.add("pan_station_anomaly", _STATION, "anomaly", "dt_mean dt_night dt_afternoon")
def _(spark, d):
    return P.station_anomaly(anomaly(spark, d))


@REGISTRY.add(
    "pan_hour_pivot",
    "SELECT station, " + ", ".join(f"avg(dt) FILTER (hour = {h}) AS h{h:02d}" for h in range(24)) + " FROM anomaly GROUP BY station",
    "anomaly",
    " ".join(f"h{h:02d}" for h in range(24)),
)
def _(spark, d):
    return P.hour_pivot(anomaly(spark, d), range(24))


@REGISTRY.add(
    "pan_year_stability",
    """WITH y AS (SELECT station, year(date)::INTEGER AS year, avg(dt) AS dt FROM anomaly WHERE hour BETWEEN 0 AND 6 GROUP BY ALL),
    p AS (SELECT a.year AS year_a, b.year AS year_b, a.dt AS da, b.dt AS db FROM y a JOIN y b ON a.station = b.station AND a.year < b.year),
    r AS (SELECT year_a, year_b, rank() OVER (PARTITION BY year_a, year_b ORDER BY da) + (count(*) OVER (PARTITION BY year_a, year_b, da) - 1) / 2 AS ra,
                 rank() OVER (PARTITION BY year_a, year_b ORDER BY db) + (count(*) OVER (PARTITION BY year_a, year_b, db) - 1) / 2 AS rb FROM p)
    SELECT year_a, year_b, corr(ra, rb) AS rho, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 4""",
    "anomaly",
    "rho",
)
def _(spark, d):
    return P.year_stability(anomaly(spark, d))


_NIGHTS = """SELECT station, count(*) AS nights, count_if(low >= 20)::BIGINT AS nights_20, count_if(low >= 25)::BIGINT AS nights_25,
    100.0 * count_if(low >= 20) / count(*) AS pct_20, 100.0 * count_if(low >= 25) / count(*) AS pct_25
    FROM (SELECT station, date, min(t) AS low FROM {panel} WHERE hour BETWEEN 0 AND 6 GROUP BY ALL) GROUP BY station"""


@REGISTRY.add("pan_warm_nights", _NIGHTS.format(panel="hourly"), "hourly", "pct_20 pct_25")
def _(spark, d):
    return P.warm_nights(panel(spark, d), [20, 25])


@REGISTRY.add(
    "pan_warm_nights_complete",
    _NIGHTS.format(panel="(SELECT h.* FROM hourly h SEMI JOIN (SELECT date FROM hourly WHERE hour BETWEEN 0 AND 6 GROUP BY date HAVING count(DISTINCT station) >= 5) USING (date))"),
    "hourly",
    "pct_20 pct_25",
)
def _(spark, d):
    return P.warm_nights(P.complete_nights(panel(spark, d), 5), [20, 25])


@REGISTRY.add(
    "pan_leave_one_out",
    """WITH rest AS (SELECT s.station AS "without", p.* FROM hourly p, stations s WHERE p.station <> s.station),
    ref AS (SELECT "without", date, hour, median(t) AS t_ref, quantile_cont(t, 0.9) - quantile_cont(t, 0.1) AS dispersion FROM rest GROUP BY ALL HAVING count(*) >= 2),
    m AS (SELECT "without", station, round(avg(t - t_ref), 9) AS dt FROM rest JOIN ref USING ("without", date, hour) GROUP BY ALL),
    e AS (SELECT DISTINCT "without", first_value(station) OVER (PARTITION BY "without" ORDER BY dt DESC, station) AS hottest, first_value(station) OVER (PARTITION BY "without" ORDER BY dt, station) AS coldest FROM m)
    SELECT "without", dispersion, instants, hottest, coldest FROM (SELECT "without", avg(dispersion) AS dispersion, count(*) AS instants FROM ref GROUP BY ALL) JOIN e USING ("without")""",
    "hourly stations",
    "dispersion",
)
def _(spark, d):
    return P.leave_one_out(panel(spark, d), stations(spark, d), 2)


@REGISTRY.add(
    "pan_heat_island",
    """WITH base AS (SELECT date, hour, median(t) AS rural FROM hourly SEMI JOIN (SELECT station FROM stations WHERE scope = 'rural') USING (station) GROUP BY ALL)
    SELECT station, avg(t - rural) AS uhi, count(*) AS n FROM hourly JOIN base USING (date, hour) WHERE hour BETWEEN 0 AND 6 GROUP BY station""",
    "hourly stations",
    "uhi",
)
def _(spark, d):
    return P.heat_island(panel(spark, d), stations(spark, d).where("scope = 'rural'"))


_REGIME = """SELECT date, direction, CASE WHEN r > 0 AND r <= 90 THEN 'NE' WHEN r > 90 AND r <= 180 THEN 'SE' WHEN r > 180 AND r <= 270 THEN 'SW' WHEN r > 270 AND r <= 360 THEN 'NW' END AS regime FROM (
    SELECT date, direction, round(direction, 9) AS r FROM (SELECT date, (degrees(atan2(avg(sin(radians(wind_dir))), avg(cos(radians(wind_dir))))) + 360.0) % 360.0 AS direction
    FROM hourly WHERE hour BETWEEN 12 AND 18 GROUP BY date))"""


@REGISTRY.add("pan_wind_regime", f"SELECT * REPLACE (date::VARCHAR AS date) FROM ({_REGIME})", "hourly", "direction")
def _(spark, d):
    return P.wind_regimes(panel(spark, d))


@REGISTRY.add(
    "pan_dispersion_by_regime",
    f"SELECT regime, avg(dispersion) AS dispersion, count(*) AS instants, count(DISTINCT date) AS days FROM {_REF} JOIN ({_REGIME}) USING (date) WHERE regime IS NOT NULL GROUP BY regime",
    "reference",
    "dispersion",
)
def _(spark, d):
    return P.dispersion_by_regime(reference(spark, d), P.wind_regimes(panel(spark, d)))


_RANKS = """rank() OVER (PARTITION BY covariate ORDER BY {c}) + (count(*) OVER (PARTITION BY covariate, {c}) - 1) / 2"""
_RHO = "SELECT covariate, corr(ra, rb) AS {name}, count(*) AS n FROM (SELECT covariate, {a} AS ra, {b} AS rb FROM l WHERE {c} IS NOT NULL) GROUP BY covariate"


@REGISTRY.add(
    "pan_coherence",
    f"""WITH s AS ({_STATION}), l AS (SELECT s.*, c.covariate, c.value FROM s JOIN stations USING (station), LATERAL (VALUES ('x', x), ('y', y)) c(covariate, value))
    SELECT * FROM (SELECT covariate, rho_night FROM ({_RHO.format(name="rho_night", a=_RANKS.format(c="dt_night"), b=_RANKS.format(c="value"), c="dt_night")}))
    JOIN ({_RHO.format(name="rho_afternoon", a=_RANKS.format(c="dt_afternoon"), b=_RANKS.format(c="value"), c="dt_afternoon")}) USING (covariate)""",
    "anomaly stations",
    "rho_night rho_afternoon",
)
def _(spark, d):
    return P.coherence(P.station_anomaly(anomaly(spark, d)), stations(spark, d), ["x", "y"])


def panels(spark, d):
    """All stations, those of scope urban, and the rest, with the least number of stations of each."""
    rows = stations(spark, d)
    named = lambda name, where, least: rows.where(where).select(F.lit(name).alias("panel"), "station", F.lit(least).alias("least"))
    return named("all", "true", 3).unionByName(named("urban", "scope = 'urban'", 2)).unionByName(named("other", "scope <> 'urban'", 2))


WINDOWS = [("night", 0, 6), ("morning", 7, 11), ("afternoon", 12, 18), ("evening", 19, 23)]


@REGISTRY.add(
    "pan_dispersion_by_scale",
    """WITH pn AS (SELECT 'all' AS panel, station, 3 AS least FROM stations UNION ALL SELECT CASE scope WHEN 'urban' THEN 'urban' ELSE 'other' END, station, 2 FROM stations),
    ref AS (SELECT panel, date, hour, quantile_cont(t, 0.9) - quantile_cont(t, 0.1) AS dispersion, stddev_pop(t) AS sd FROM hourly JOIN pn USING (station) GROUP BY panel, least, date, hour HAVING count(*) >= least)
    SELECT panel, "window", avg(dispersion) AS dispersion, avg(sd) AS sd, count(*) AS instants FROM ref JOIN (VALUES ('night', 0, 6), ('morning', 7, 11), ('afternoon', 12, 18), ('evening', 19, 23)) w("window", a, b)
    ON hour BETWEEN a AND b GROUP BY ALL""",
    "hourly stations",
    "dispersion sd",
)
def _(spark, d):
    windows = spark.createDataFrame(WINDOWS, "window string, from_hour int, to_hour int")
    return P.dispersion_by_scale(panel(spark, d), panels(spark, d), windows)


@REGISTRY.add(
    "pan_rank_reversal",
    f"""WITH s AS ({_STATION}), r AS (SELECT *, rank() OVER (ORDER BY dt_night DESC) + (count(*) OVER (PARTITION BY dt_night) - 1) / 2 AS rn,
        rank() OVER (ORDER BY dt_afternoon DESC) + (count(*) OVER (PARTITION BY dt_afternoon) - 1) / 2 AS rd FROM s WHERE dt_night IS NOT NULL AND dt_afternoon IS NOT NULL)
    SELECT corr(rn, rd) AS rho, max(abs(rn - rd)) AS largest_move, coalesce(count_if(sign(dt_night) <> sign(dt_afternoon)), 0)::BIGINT AS sign_changes, count(*) AS stations FROM r""",
    "anomaly",
    "rho largest_move",
)
def _(spark, d):
    return P.rank_reversal(P.station_anomaly(anomaly(spark, d)))


@REGISTRY.add(
    "pan_summary",
    f"""SELECT count(*) AS stations, min(dt_mean) AS dt_min, median(dt_mean) AS dt_median, max(dt_mean) AS dt_max, max(dt_night) - min(dt_night) AS night_range,
        count_if(dt_night > 0) / count(dt_night) AS warm_share FROM ({_STATION})""",
    "anomaly",
    "dt_min dt_median dt_max night_range warm_share",
)
def _(spark, d):
    return P.summary(anomaly(spark, d))
