"""Sources and sinks by round trip: tables are written in a format and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.operators import network as N
from umbra.plans.inputs import REGISTRY, observations, read
from umbra.plans.network_plans import edges, relax_sql, routes
from umbra.sources import readers, writers
from umbra.sources.staging import shared_path


@REGISTRY.add(
    "src_partitioned",
    "SELECT year, month, count(*) AS rows, sum(t) AS total FROM (SELECT year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, t FROM obs) WHERE month IN (6, 7, 8) GROUP BY ALL",
    "obs",
    "total",
)
def _(spark, d):
    """A panel sorted and partitioned by year and month; only the summer months are listed again."""
    rows = observations(spark, d).withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
    path = shared_path(spark, "panel")
    writers.sorted_parquet(rows, path, ["year", "month", "station", "ts"], ["year", "month"])
    found = readers.observations(spark, path, [6, 7, 8], ["year", "month", "t"])
    return found.groupBy("year", "month").agg(F.count("*").alias("rows"), F.sum("t").alias("total"))


@REGISTRY.add("src_csv", "SELECT lpad(c_custkey::VARCHAR, 7, '0') AS cusec, round(c_acctbal, 3) AS balance FROM customer", doubles="balance")
def _(spark, d):
    """Keys with leading zeros stay text."""
    path = shared_path(spark, "csv")
    read(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias(" cusec"), F.round("c_acctbal", 3).alias("balance ")).write.csv(path, header=True)
    return readers.table_csv(spark, path, "cusec string, balance double")


@REGISTRY.add("snk_report_csv", "SELECT c_nationkey::BIGINT AS nation, round(sum(c_acctbal), 3) AS balance FROM customer GROUP BY 1", doubles="balance")
def _(spark, d):
    path = shared_path(spark, "report")
    writers.report_csv(read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum("c_acctbal").alias("balance")), path)
    return readers.table_csv(spark, path, "nation bigint, balance double")


@REGISTRY.add("snk_summary_json", "SELECT count(*) AS customers, round(sum(c_acctbal), 6) AS balance FROM customer", doubles="balance")
def _(spark, d):
    path = shared_path(spark, "summary")
    writers.summary_json(read(spark, d, "customer").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance")), path)
    return readers.json_documents(spark, path).select("customers", "balance")


@REGISTRY.add("src_complete_files", "SELECT 1::BIGINT AS files, count(*) > 0 AS complete FROM supplier")
def _(spark, d):
    return readers.complete_files(read(spark, d, "supplier"), 1)


@REGISTRY.add(
    "src_height_cells",
    "SELECT p_partkey AS cell, h FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN -9999.0::DOUBLE ELSE p_size * 6.5::DOUBLE - 5 END AS h FROM part) WHERE h > -1 AND h < 250",
    doubles="h",
)
def _(spark, d):
    cells = read(spark, d, "part").select(F.col("p_partkey").alias("cell"), F.when(F.pmod("p_partkey", F.lit(7)) == 0, -9999.0).otherwise(F.col("p_size") * 6.5 - 5).alias("h"))
    return readers.height_cells(cells, -9999.0)


@REGISTRY.add(
    "dec_demography",
    """SELECT cusec, min(v) FILTER (indicator = 'age') AS age, min(v) FILTER (indicator = 'people') AS people FROM (
        SELECT lpad(c_custkey::VARCHAR, 7, '0') AS cusec, 'age' AS indicator, c_custkey % 100 + 1000.5::DOUBLE AS v FROM customer WHERE c_custkey % 10 > 0
        UNION ALL SELECT lpad(c_custkey::VARCHAR, 7, '0'), 'people', c_nationkey::DOUBLE FROM customer WHERE c_custkey % 10 > 0) WHERE cusec LIKE '000%' GROUP BY cusec""",
    doubles="age people",
)
def _(spark, d):
    """Two indicators and periods as texts with thousands points and decimal commas; every tenth section is blank."""
    key, name = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    age = F.concat(F.lit("1."), F.lpad(F.pmod(key, F.lit(100)).cast("string"), 3, "0"), F.lit(",5"))
    each = [F.struct(F.lit(i).alias("indicator"), F.lit(p).alias("period"), (v if p == "2022" else F.lit("9")).alias("total")) for i, v in (("age", age), ("people", F.col("c_nationkey").cast("string"))) for p in ("2021", "2022")]
    section = F.when(F.pmod(key, F.lit(10)) == 0, F.lit(" ")).otherwise(F.concat(name, F.lit(" section")))
    rows = read(spark, d, "customer").select(section.alias("section"), F.explode(F.array(*each)).alias("x")).select("section", "x.*")
    return readers.wide_demography(rows, "000", ["age", "people"])


@REGISTRY.add(
    "net_edge_shade",
    "SELECT u, v, length, CASE WHEN u % 3 = 0 THEN u % 10 / 10 ELSE 0 END AS frac FROM (SELECT u, v, min(length) AS length FROM (SELECT u, v, length FROM edges UNION ALL SELECT v, u, length FROM edges) WHERE u <> v GROUP BY u, v)",
    "edges",
    "length frac",
)
def _(spark, d):
    """Edges without a row of shade have none."""
    both = N.undirected(edges(spark, d))
    shade = both.where("u % 3 = 0").select("u", "v", (F.pmod("u", F.lit(10)) / 10).alias("frac"))
    return N.with_shade(both, shade)


@REGISTRY.add(
    "net_exposed_fraction",
    f"""WITH {relax_sql("hour_minutes m ON m.u = b.node AND m.hour = b.hour", "hour", "(VALUES (11), (14), (17)) h(hour)", "m.t")} SELECT hour, avg(s.sun) / nullif(avg(s.t), 0) AS exposed FROM best GROUP BY hour""",
    "hour_minutes facilities",
    "exposed",
)
def _(spark, d):
    return N.exposed_fraction(routes(spark, d, [0.0], hours=True), ["hour"])
