"""Quality-control queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.functions.stats import haversine_km
from umbra.operators import quality as Q
from umbra.plans.inputs import REGISTRY, observations, read, rounded, stations

SLOTS = 2208
YEARS = list(range(1995, 2002))


def qc(spark, d):
    return Q.validated(observations(spark, d))


def panel_cadence(spark, d):
    return Q.cadence(observations(spark, d))


_CADENCE = """SELECT station, median(gap) AS cadence_min, max(gap) / 60 AS largest_gap_h
    FROM (SELECT station, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY station ORDER BY ts, obs))) / 60e6 AS gap FROM obs) GROUP BY station"""
_COVERAGE = f"""SELECT station, year, valid, least(100.0, 100.0 * valid / {SLOTS} * greatest(1.0, cadence_min / 60)) AS coverage_pct
    FROM (SELECT station, year(ts)::INTEGER AS year, count(DISTINCT ts) AS valid FROM qc WHERE t_qc IS NOT NULL GROUP BY ALL) JOIN ({_CADENCE}) USING (station)"""


@REGISTRY.add("qc_mask", "SELECT station, ts, obs, t_qc, out_of_range, spike, masked FROM qc", "qc", "t_qc")
def _(spark, d):
    return qc(spark, d).select("station", "ts", "obs", "t_qc", "out_of_range", "spike", "masked")


@REGISTRY.add("qc_cadence", _CADENCE, "obs", "cadence_min largest_gap_h")
def _(spark, d):
    return panel_cadence(spark, d)


def panel_coverage(spark, d):
    return Q.coverage(qc(spark, d), SLOTS, panel_cadence(spark, d), 60)


@REGISTRY.add("qc_coverage", _COVERAGE, "qc", "coverage_pct")
def _(spark, d):
    return panel_coverage(spark, d)


@REGISTRY.add(
    "qc_coverage_wide",
    "SELECT station, " + ", ".join(f"coalesce(max(coverage_pct) FILTER (year = {y}), 0.0) AS cov_{y}" for y in YEARS) + f" FROM ({_COVERAGE}) GROUP BY station",
    "qc",
    " ".join(f"cov_{y}" for y in YEARS),
)
def _(spark, d):
    return Q.coverage_wide(panel_coverage(spark, d), YEARS)


_FLAT = """SELECT station, 100.0 * sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / sum(n) AS flat_pct, max(n) AS longest_run FROM (
    SELECT station, run, count(*) AS n FROM (
        SELECT station, sum(s) OVER (PARTITION BY station ORDER BY ts, obs ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT station, ts, obs, CASE WHEN coalesce(t <> lag(t) OVER w OR (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60e6 > 20160, true) THEN 1 ELSE 0 END AS s
            FROM obs WINDOW w AS (PARTITION BY station ORDER BY ts, obs)))
    GROUP BY station, run) GROUP BY station"""


def flat(spark, d):
    return Q.flat_runs(observations(spark, d), 20160, 2)


@REGISTRY.add("qc_flat_runs", _FLAT, "obs", "flat_pct")
def _(spark, d):
    return flat(spark, d)


_RANGE = """SELECT station, avg(r) AS range_mean, quantile_cont(r, 0.95) AS range_p95 FROM
    (SELECT station, ts::DATE AS date, max(t_qc) - min(t_qc) AS r FROM qc GROUP BY ALL) GROUP BY station"""


@REGISTRY.add("qc_diurnal_range", _RANGE, "qc", "range_mean range_p95")
def _(spark, d):
    return Q.diurnal_range(qc(spark, d))


_COUNTERS = """SELECT station, count(*) AS rows, count(t_qc) AS valid, count_if(t = 0) AS zeros, count_if(spike) AS spikes, 100.0 * count_if(masked) / count(*) AS masked_pct,
    min(t_qc) AS t_min, max(t_qc) AS t_max, count_if(rh < 0 OR rh > 100) AS bad_rh, count(*) - count(DISTINCT ts) AS duplicates FROM qc GROUP BY station"""


@REGISTRY.add("qc_counters", f"SELECT * REPLACE (zeros::BIGINT AS zeros, spikes::BIGINT AS spikes, bad_rh::BIGINT AS bad_rh) FROM ({_COUNTERS})", "qc", "masked_pct t_min t_max")
def _(spark, d):
    return Q.counters(qc(spark, d))


LIMITS = {"summers": 6, "masked_pct": 30.0, "flat_pct": 5.0, "duplicates": 6}
_DECISION = f"""SELECT station, CASE WHEN reasons = '' THEN 'keep' ELSE 'discard' END AS decision, reasons FROM (
    SELECT station, concat_ws(';', CASE WHEN coalesce(summers, 0) < 6 THEN 'few summers' END, CASE WHEN masked_pct > 30.0 THEN 'masked' END, CASE WHEN flat_pct > 5.0 THEN 'flat' END,
           CASE WHEN range_mean > lim THEN 'wide range' END, CASE WHEN duplicates > 6 THEN 'duplicates' END) AS reasons
    FROM ({_COUNTERS}) JOIN ({_FLAT}) USING (station) JOIN ({_RANGE}) USING (station)
    LEFT JOIN (SELECT station, count_if(coverage_pct >= 1) AS summers FROM ({_COVERAGE}) GROUP BY station) USING (station)
    CROSS JOIN (SELECT m + 3 * 1.4826 * median(abs(range_mean - m)) AS lim FROM ({_RANGE}) CROSS JOIN (SELECT median(range_mean) AS m FROM ({_RANGE})) GROUP BY m))"""


def decisions(spark, d):
    readings = qc(spark, d)
    summers = Q.usable_summers(panel_coverage(spark, d), 1)
    return Q.decision(Q.counters(readings), flat(spark, d), Q.diurnal_range(readings), summers, LIMITS)


@REGISTRY.add("qc_decision", _DECISION, "qc")
def _(spark, d):
    return decisions(spark, d)


@REGISTRY.add("qc_usable_summers", f"SELECT station, count_if(coverage_pct >= 1)::BIGINT AS summers, median(coverage_pct) AS coverage_median FROM ({_COVERAGE}) GROUP BY station", "qc", "coverage_median")
def _(spark, d):
    return Q.usable_summers(panel_coverage(spark, d), 1)


@REGISTRY.add(
    "qc_gate_summary",
    f"SELECT scope, count(*) AS stations, count_if(decision = 'keep')::BIGINT AS kept FROM ({_DECISION}) JOIN stations USING (station) GROUP BY scope",
    "qc stations",
)
def _(spark, d):
    return Q.gate_summary(decisions(spark, d), stations(spark, d).select("station", "scope"))


COAST = [(0.0, 0.0, 5000.0, 1000.0), (5000.0, 1000.0, 12000.0, 0.0), (12000.0, 0.0, 20000.0, 4000.0)]


@REGISTRY.add(
    "qc_coast_distance",
    """SELECT station, min(sqrt(power(x - ax - u * (bx - ax), 2) + power(y - ay - u * (by_ - ay), 2))) AS coast_m FROM (
        SELECT *, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (power(bx - ax, 2) + power(by_ - ay, 2)), 0), 1) AS u
        FROM stations, (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 5000.0::DOUBLE, 1000.0::DOUBLE), (5000, 1000, 12000, 0), (12000, 0, 20000, 4000)) c(ax, ay, bx, by_)) GROUP BY station""",
    "stations",
    "coast_m",
)
def _(spark, d):
    return Q.coast_distance(stations(spark, d), spark.createDataFrame(COAST, "ax double, ay double, bx double, by double"))


@REGISTRY.add(
    "qc_haversine",
    """SELECT station, 2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(y / 1000 - 10) / 2), 2) + cos(radians(10)) * cos(radians(y / 1000)) * power(sin(radians(x / 1000 - 10) / 2), 2)))) AS km FROM stations""",
    "stations",
    "km",
)
def _(spark, d):
    return stations(spark, d).select("station", haversine_km(F.lit(10.0), F.lit(10.0), F.col("y") / 1000, F.col("x") / 1000).alias("km"))


def event_series(spark, d):
    """Two names for some users' series, so that replicas exist."""
    events = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("t"), "user_id")
    twice = F.array(F.col("user_id"), F.when(F.pmod("user_id", F.lit(5)) == 0, F.col("user_id") + 100_000))
    return events.select("ts", "t", F.explode(F.array_compact(twice)).alias("series"))


_SERIES = "SELECT ts, value AS t, unnest(CASE WHEN user_id % 5 = 0 THEN [user_id, user_id + 100000] ELSE [user_id] END) AS series FROM events"


@REGISTRY.add(
    "qc_replicas",
    f"""WITH e AS ({_SERIES}), g AS (
        SELECT b.series AS b, min(a.series) AS g FROM (SELECT a.series AS sa, b.series AS sb FROM e a JOIN e b ON a.ts = b.ts AND a.series < b.series GROUP BY ALL HAVING count(*) > 10 AND max(abs(a.t - b.t)) < 1e-9) p
        JOIN (SELECT DISTINCT series FROM e) a ON a.series = sa JOIN (SELECT DISTINCT series FROM e) b ON b.series = sb GROUP BY b.series)
    SELECT DISTINCT series, coalesce(g, series) AS "group" FROM e LEFT JOIN g ON b = series""",
)
def _(spark, d):
    return Q.replicas(event_series(spark, d), 10)


@REGISTRY.add(
    "qc_between_stations",
    "SELECT ts, count(DISTINCT station) AS n, stddev_samp(t) AS sd FROM obs GROUP BY ts HAVING count(DISTINCT station) = 3",
    "obs",
    "sd",
)
def _(spark, d):
    return Q.between_stations(observations(spark, d), 3)


def minutes(spark, d):
    ts = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return read(spark, d, "events").select(
        F.pmod("user_id", F.lit(10)).alias("station"), (ts + F.make_dt_interval(mins=(F.minute("ts") / 10).cast("int") * 10)).alias("ts"), F.round("value").alias("t")
    )


_EXTERNAL = """e AS (SELECT station, ts, min(t) AS t FROM (SELECT user_id % 10 AS station, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, round(value) AS t FROM events) GROUP BY ALL HAVING count(DISTINCT t) = 1),
    j AS (SELECT *, coalesce(abs(t - lag(t) OVER w) > 4 AND abs(t - lead(t) OVER w) > 4 AND sign(t - lag(t) OVER w) = sign(t - lead(t) OVER w), false) AS alone FROM e WINDOW w AS (PARTITION BY station ORDER BY ts))"""


@REGISTRY.add("qc_external_network", f"WITH {_EXTERNAL} SELECT station, count(*) AS rows, count_if(alone)::BIGINT AS alone, sum(CASE WHEN NOT alone THEN t END) AS total FROM j GROUP BY station", doubles="total")
def _(spark, d):
    clean = Q.lone_jumps(Q.deduplicated(minutes(spark, d)), 4)
    return clean.groupBy("station").agg(F.count("*").alias("rows"), F.count_if("alone").alias("alone"), F.sum("t_ok").alias("total"))


@REGISTRY.add(
    "qc_hourly_complete",
    f"WITH {_EXTERNAL} SELECT station, date_trunc('hour', ts) AS hour, count(CASE WHEN NOT alone THEN t END) AS n, avg(CASE WHEN NOT alone THEN t END) AS t FROM j GROUP BY ALL HAVING count(CASE WHEN NOT alone THEN t END) >= 2",
    doubles="t",
)
def _(spark, d):
    return Q.hourly_complete(Q.lone_jumps(Q.deduplicated(minutes(spark, d)), 4), 2)


@REGISTRY.add(
    "qc_clock_scenarios",
    "SELECT offset_h, hour(ts + to_hours(offset_h))::INTEGER AS hour, avg(t) AS t, count(*) AS n FROM obs, (VALUES (0), (1), (2)) o(offset_h) GROUP BY ALL",
    "obs",
    "t",
)
def _(spark, d):
    shifted = Q.clock_scenarios(observations(spark, d), [0, 1, 2])
    return shifted.groupBy("offset_h", F.hour("local_ts").alias("hour")).agg(F.avg("t").alias("t"), F.count("*").alias("n"))


@REGISTRY.add(
    "qc_guards",
    """SELECT unnest(['rows', 'field coverage', 'stations']) AS rule, unnest([count(*) >= 1000, count(t_qc) / count(*) >= 0.5, count(DISTINCT station) >= 3]) AS ok FROM qc""",
    "qc",
)
def _(spark, d):
    rules = {"rows": F.count("*") >= 1000, "field coverage": Q.valid_share("t_qc") >= 0.5, "stations": F.count_distinct("station") >= 3}
    return Q.checks(qc(spark, d), rules)


@REGISTRY.add("qc_sign_convention", "SELECT avg(t) - avg(rh) AS correction, 0.0::DOUBLE AS residual FROM obs", "obs", "correction")
def _(spark, d):
    return rounded(Q.mean_residual(observations(spark, d), "t", "rh"))
