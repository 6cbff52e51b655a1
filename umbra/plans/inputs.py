"""Input frames derived from the given tables by integer arithmetic, in Spark and as SQL views of the same names."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense station panel from lineitem: a reading's hour comes from its order."""
    hour = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(24)).cast("int")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("station"),
        (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(hours=hour)).alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs"),
        F.col("l_quantity").alias("t"),
        F.round(F.col("l_discount") * 1010, 3).alias("rh"),
        F.round(F.col("l_tax") * 100, 3).alias("wind"),
        F.pmod(F.col("l_partkey") * 37, F.lit(360)).cast("double").alias("wind_dir"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.lpad(key.cast("string"), 7, "0").alias("cusec"),
        F.col("c_nationkey").alias("district"),
        F.abs("c_acctbal").alias("pop"),
        F.pmod(key * 7919, F.lit(20000)).cast("double").alias("x"),
        F.pmod(key * 104729, F.lit(20000)).cast("double").alias("y"),
        (F.pmod(key * 31, F.lit(17)) != 0).alias("reachable"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        key.alias("station"),
        F.pmod(key * 7919, F.lit(20000)).cast("double").alias("x"),
        F.pmod(key * 104729, F.lit(20000)).cast("double").alias("y"),
        F.when(F.pmod(key, F.lit(3)) == 0, "urban").when(F.pmod(key, F.lit(3)) == 1, "suburban").otherwise("rural").alias("scope"),
    )


VIEWS = {
    "obs": """SELECT l_suppkey AS station, l_shipdate + to_hours(((l_orderkey * 7 + l_linenumber) % 24)::INTEGER) AS ts, l_orderkey * 10 + l_linenumber AS obs,
        l_quantity AS t, round(l_discount * 1010, 3) AS rh, round(l_tax * 100, 3) AS wind, ((l_partkey * 37) % 360)::DOUBLE AS wind_dir FROM lineitem""",
    "sections": """SELECT lpad(c_custkey::VARCHAR, 7, '0') AS cusec, c_nationkey AS district, abs(c_acctbal) AS pop, ((c_custkey * 7919) % 20000)::DOUBLE AS x,
        ((c_custkey * 104729) % 20000)::DOUBLE AS y, (c_custkey * 31) % 17 <> 0 AS reachable FROM customer""",
    "stations": """SELECT s_suppkey AS station, ((s_suppkey * 7919) % 20000)::DOUBLE AS x, ((s_suppkey * 104729) % 20000)::DOUBLE AS y,
        CASE s_suppkey % 3 WHEN 0 THEN 'urban' WHEN 1 THEN 'suburban' ELSE 'rural' END AS scope FROM supplier""",
    "qc_range": "SELECT *, coalesce(t < 5 OR t > 50, false) AS out_of_range, CASE WHEN NOT coalesce(t < 5 OR t > 50, false) THEN t END AS t_ok FROM obs",
    "qc_spike": """SELECT *, coalesce(CASE WHEN count(t_ok) OVER w >= 3 THEN abs(t_ok - quantile_cont(t_ok, 0.5) OVER w) > 4 END, false) AS spike FROM qc_range
        WINDOW w AS (PARTITION BY station ORDER BY ts, obs ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "qc": "SELECT station, ts, obs, t, rh, wind, wind_dir, out_of_range, spike, out_of_range OR spike AS masked, CASE WHEN NOT spike THEN t_ok END AS t_qc FROM qc_spike",
    "hourly": """SELECT station, ts::DATE AS date, hour(ts)::INTEGER AS hour, avg(t_qc) AS t, avg(rh) AS rh, avg(wind) AS wind, avg(wind_dir) AS wind_dir, count(t_qc) AS n
        FROM qc GROUP BY ALL HAVING count(t_qc) > 0""",
    "reference": """SELECT date, hour, median(t) AS t_ref, count(*) AS n_stations, quantile_cont(t, 0.9) AS p90, quantile_cont(t, 0.1) AS p10, quantile_cont(t, 0.75) AS p75, quantile_cont(t, 0.25) AS p25
        FROM hourly GROUP BY date, hour HAVING count(*) >= 3""",
    "anomaly": "SELECT h.*, t_ref, p90 - p10 AS dispersion, p75 - p25 AS iqr, t - t_ref AS dt FROM hourly h JOIN reference USING (date, hour)",
}
_NEEDS = {"qc_range": ["obs"], "qc_spike": ["qc_range"], "qc": ["qc_spike"], "hourly": ["qc"], "reference": ["hourly"], "anomaly": ["hourly", "reference"]}


def view(name: str, sql: str, needs: Iterable[str] = ()) -> None:
    """Adds a view that oracle SQL may name."""
    VIEWS[name], _NEEDS[name] = sql, list(needs)


def with_views(body: str, *names: str) -> str:
    """``body`` after the WITH clause of the views it names and all they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, as sums of doubles differ in their last bits between engines; minus zero becomes zero. Dates become text."""
    plain = {"double": lambda c: F.round(c, digits) + F.lit(0.0), "date": lambda c: F.col(c).cast("string")}
    return df.select(*[plain[t](c).alias(c) if t in plain else F.col(c) for c, t in df.dtypes])


def rounded_sql(body: str, columns: str, digits: int = 6) -> str:
    """The same on the named columns of a SELECT."""
    parts = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({parts}) FROM (\n{body.strip()}\n)" if columns else body


class Registry:
    """Queries with their SQL, under the names the driver sees."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: str = "", doubles: str = "") -> Callable[[Query], Query]:
        """Registers the decorated query; ``doubles`` are the columns to round on the SQL side."""

        def register(query: Query) -> Query:
            self.queries[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
            if sql is not None:
                self.sql[name] = with_views(rounded_sql(sql, doubles), *views.split()) if views else rounded_sql(sql, doubles)
            return query

        return register


REGISTRY = Registry()
