"""Decision, regret and bootstrap queries: sections are customers, hours are orders, days are order dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.functions.stats import spearman
from umbra.operators import decisions as D
from umbra.operators import resample as B
from umbra.plans.inputs import REGISTRY, read, sections, stations, view
from umbra.plans.panel_plans import anomaly
from umbra.sources.staging import staged

REPS = ("local", "regional", "uniform")


def hours(spark, d):
    key = F.col("o_orderkey")
    flags = {"local": F.pmod(key, F.lit(3)) > 0, "regional": F.pmod(key, F.lit(7)) < 5, "uniform": F.pmod(key, F.lit(11)) < 8}
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rep"), f.alias("safe")) for r, f in flags.items()]))
    orders = read(spark, d, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 7, "0").alias("cusec"), F.to_date("o_orderdate").alias("date"), F.year("o_orderdate").alias("year"), each.alias("r"), (F.pmod(key, F.lit(13)) > 2).alias("sun_ok"),
    )
    return orders.select("*", "r.*").drop("r").join(sections(spark, d), "cusec")


def fractions(spark, d):
    return hours(spark, d).groupBy("cusec", "district", "pop", "x", "y", "reachable", "rep").agg(F.avg(F.col("safe").cast("double")).alias("frac"), F.avg(F.col("sun_ok").cast("double")).alias("sun"))


def pairs(spark, d):
    rows = fractions(spark, d)
    pick = lambda rep: F.max(F.when(F.col("rep") == rep, F.col("frac")))
    return rows.groupBy("cusec", "district", "pop", "reachable").agg(pick("local").alias("frac_a"), pick("regional").alias("frac_b"))


view(
    "dhours",
    """SELECT s.*, o.date, o.year, r.rep, r.safe, o.sun_ok FROM (SELECT lpad(o_custkey::VARCHAR, 7, '0') AS cusec, o_orderdate::DATE AS date, year(o_orderdate)::INTEGER AS year, o_orderkey, o_orderkey % 13 > 2 AS sun_ok FROM orders) o
       JOIN sections s USING (cusec), LATERAL (VALUES ('local', o_orderkey % 3 > 0), ('regional', o_orderkey % 7 < 5), ('uniform', o_orderkey % 11 < 8)) r(rep, safe)""",
    ["sections"],
)
view("fractions", "SELECT cusec, district, pop, x, y, reachable, rep, avg(safe::INT) AS frac, avg(sun_ok::INT) AS sun FROM dhours GROUP BY ALL", ["dhours"])
view(
    "pairs",
    "SELECT cusec, district, pop, reachable, max(frac) FILTER (rep = 'local') AS frac_a, max(frac) FILTER (rep = 'regional') AS frac_b FROM fractions GROUP BY cusec, district, pop, reachable",
    ["fractions"],
)
view(
    "priority",
    """SELECT *, row_number() OVER (PARTITION BY rep ORDER BY load DESC, cusec) <= k AS first FROM (
        SELECT *, round(pop * (1 - frac), 9) AS load, greatest(floor(count(*) OVER (PARTITION BY rep) * 0.15::DOUBLE), 1)::INTEGER AS k FROM fractions WHERE reachable)""",
    ["fractions"],
)


def ranked(spark, d):
    return D.priority(fractions(spark, d), ["rep"], 0.15)


@REGISTRY.add(
    "dec_travel_time",
    "SELECT cusec, x / 1.25::DOUBLE / 60 AS min_0, x / 1.25::DOUBLE / 60 <= 15 AS served_0, x / 0.9::DOUBLE / 60 AS min_1, x / 0.9::DOUBLE / 60 <= 15 AS served_1 FROM sections",
    "sections",
    "min_0 min_1",
)
def _(spark, d):
    return D.travel(sections(spark, d).withColumn("dist_m", F.col("x")), [1.25, 0.9]).select("cusec", "min_0", "served_0", "min_1", "served_1")


@REGISTRY.add(
    "dec_served_population",
    """SELECT 100 * sum(CASE WHEN x / 1.25::DOUBLE / 60 <= 15 THEN pop ELSE 0 END) / sum(pop) AS pct_served_0, 100 * sum(CASE WHEN x / 0.9::DOUBLE / 60 <= 15 THEN pop ELSE 0 END) / sum(pop) AS pct_served_1, count(*) AS sections FROM sections""",
    "sections",
    "pct_served_0 pct_served_1",
)
def _(spark, d):
    return D.served_population(D.travel(sections(spark, d).withColumn("dist_m", F.col("x")), [1.25, 0.9]), ["served_0", "served_1"])


@REGISTRY.add("dec_fractions", "SELECT cusec, rep, frac FROM fractions", "fractions", "frac")
def _(spark, d):
    return fractions(spark, d).select("cusec", "rep", "frac")


_COVERAGE = "SELECT rep, sum(CASE WHEN reachable THEN frac ELSE 0 END * pop) / sum(pop) AS coverage FROM fractions GROUP BY rep"


@REGISTRY.add(
    "dec_coverage",
    f"WITH c AS ({_COVERAGE}), b AS (SELECT coverage AS base FROM c WHERE rep = 'uniform') SELECT rep, coverage, 100 * (coverage - base) AS diff_pp, 100 * (coverage - base) / base AS diff_pct FROM c, b",
    "fractions",
    "coverage diff_pp diff_pct",
)
def _(spark, d):
    return D.coverage_difference(D.coverage(fractions(spark, d), ["rep"]), "uniform")


_FLOW = """count_if(NOT a AND b)::BIGINT AS up, count_if(a AND NOT b)::BIGINT AS down, sum(CASE WHEN NOT a AND b THEN pop ELSE 0 END) AS up_pop, sum(CASE WHEN a AND NOT b THEN pop ELSE 0 END) AS down_pop,
    sum(CASE WHEN a <> b THEN pop ELSE 0 END) AS gross_pop, sum(CASE WHEN NOT a AND b THEN pop WHEN a AND NOT b THEN -pop ELSE 0 END) AS net_pop, 100 * sum(CASE WHEN a <> b THEN pop ELSE 0 END) / sum(pop) AS gross_pct,
    count_if(NOT a AND b) > 0 AND count_if(a AND NOT b) > 0 AS both_ways"""


@REGISTRY.add(
    "dec_flows",
    f"SELECT {_FLOW} FROM (SELECT pop, frac_a >= cut AS a, frac_b >= cut AS b FROM pairs, (SELECT median(frac_a) AS cut FROM pairs WHERE reachable) WHERE reachable)",
    "pairs",
    "up_pop down_pop gross_pop net_pop gross_pct",
)
def _(spark, d):
    return D.flows(pairs(spark, d), [])


@REGISTRY.add(
    "dec_cut_sweep",
    f"""SELECT step, cut, {_FLOW} FROM (SELECT step, cut, pop, frac_a >= cut AS a, frac_b >= cut AS b FROM pairs,
        (SELECT (unnest(range(1, 10)) - 1)::INTEGER AS step, unnest(quantile_cont(frac_a, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cut FROM pairs WHERE reachable) WHERE reachable) GROUP BY step, cut""",
    "pairs",
    "cut up_pop down_pop gross_pop net_pop gross_pct",
)
def _(spark, d):
    return D.cut_sweep(pairs(spark, d), [x / 10 for x in range(1, 10)])


@REGISTRY.add("dec_priority", "SELECT rep, cusec, load FROM priority WHERE first", "priority", "load")
def _(spark, d):
    return ranked(spark, d).where("first").select("rep", "cusec", "load")


@REGISTRY.add(
    "dec_list_change",
    """WITH w AS (SELECT cusec, max(pop) AS pop, coalesce(bool_or(first) FILTER (rep = 'uniform'), false) AS a, coalesce(bool_or(first) FILTER (rep = 'local'), false) AS b FROM priority GROUP BY cusec)
    SELECT count_if(a AND b) / count_if(a OR b) AS jaccard, coalesce(count_if(NOT a AND b), 0)::BIGINT AS entering, coalesce(count_if(a AND NOT b), 0)::BIGINT AS leaving, sum(CASE WHEN NOT a AND b THEN pop ELSE 0 END) AS entering_pop FROM w""",
    "priority",
    "jaccard entering_pop",
)
def _(spark, d):
    return D.list_change(ranked(spark, d), "uniform", "local")


@REGISTRY.add(
    "dec_district_ranking",
    """WITH l AS (SELECT district, round(sum(load) FILTER (rep = 'local'), 6) AS la, round(sum(load) FILTER (rep = 'regional'), 6) AS lb FROM priority GROUP BY district),
    r AS (SELECT rank() OVER (ORDER BY la) + (count(*) OVER (PARTITION BY la) - 1) / 2 AS ra, rank() OVER (ORDER BY lb) + (count(*) OVER (PARTITION BY lb) - 1) / 2 AS rb,
          row_number() OVER (ORDER BY la DESC, district) <= 5 AS ta, row_number() OVER (ORDER BY lb DESC, district) <= 5 AS tb FROM l)
    SELECT corr(ra, rb) AS rho, coalesce(count_if(ta AND tb), 0)::BIGINT AS overlap, count(*) AS districts FROM r""",
    "priority",
    "rho",
)
def _(spark, d):
    return D.district_ranking(ranked(spark, d), "local", "regional")


@REGISTRY.add(
    "dec_threshold_curve",
    """SELECT u, avg((t < u)::INT) AS below, avg((t_ref < u)::INT) AS below_uniform, avg((abs(t - u) <= abs(t - t_ref))::INT) AS fragile, avg(((t < u) <> (t_ref < u))::INT) AS moved
       FROM anomaly, (SELECT unnest(range(56, 69)) / 2 AS u) GROUP BY u""",
    "anomaly",
    "u below below_uniform fragile moved",
)
def _(spark, d):
    rows = anomaly(spark, d).select("t", F.col("t_ref").alias("t_uniform"))
    return D.threshold_curve(rows, [x / 2 for x in range(56, 69)])


def shaded(spark, d):
    rows = fractions(spark, d).where("rep <> 'uniform'")
    shade = F.explode(F.array(F.lit(0), F.lit(1)))
    return rows.withColumn("shade", shade).withColumn("frac", F.when(F.col("shade") == 1, F.least(F.col("frac"), F.col("sun"))).otherwise(F.col("frac")))


@REGISTRY.add(
    "dec_factorial",
    """WITH s AS (SELECT rep, district, pop, reachable, shade, CASE shade WHEN 1 THEN least(frac, sun) ELSE frac END AS f FROM fractions, (VALUES (0), (1)) v(shade) WHERE rep <> 'uniform'),
    c AS (SELECT district, rep, shade, sum(CASE WHEN reachable THEN f * pop ELSE 0 END) / sum(pop) AS x FROM s GROUP BY ALL),
    w AS (SELECT district, max(x) FILTER (rep = 'regional' AND shade = 0) AS a, max(x) FILTER (rep = 'local' AND shade = 0) AS b, max(x) FILTER (rep = 'regional' AND shade = 1) AS c, max(x) FILTER (rep = 'local' AND shade = 1) AS d FROM c GROUP BY district)
    SELECT *, (b - a + d - c) / 2 AS effect_rep, (c - a + d - b) / 2 AS effect_shade, (d - c) - (b - a) AS interaction FROM w""",
    "fractions",
    "a b c d effect_rep effect_shade interaction",
)
def _(spark, d):
    return D.factorial(shaded(spark, d), ["district"])


@REGISTRY.add(
    "dec_saturation",
    "SELECT district, avg((sun >= 0.8::DOUBLE)::INT) FILTER (reachable) AS passing, avg((sun >= 0.8::DOUBLE)::INT) FILTER (reachable) < 0.6 AS saturated FROM fractions WHERE rep = 'local' GROUP BY district",
    "fractions",
    "passing",
)
def _(spark, d):
    rows = fractions(spark, d).where("rep = 'local'").withColumn("passes", F.col("sun") >= 0.8)
    return D.saturation(rows, ["district"])


@REGISTRY.add(
    "dec_phi_curve",
    """WITH p(phi) AS (SELECT unnest(range(1, 9)) / 10), r AS (SELECT phi, cusec, pop, round(pop * (1 - CASE WHEN sun >= 1 - phi THEN frac ELSE 0 END), 9) AS load FROM fractions, p WHERE reachable AND rep = 'local'),
    k AS (SELECT *, row_number() OVER (PARTITION BY phi ORDER BY load DESC, cusec) <= greatest(floor(count(*) OVER (PARTITION BY phi) * 0.15::DOUBLE), 1) AS first FROM r)
    SELECT phi, sum(load) AS load, sum(CASE WHEN first THEN load ELSE 0 END) AS first_load FROM k GROUP BY phi""",
    "fractions",
    "phi load first_load",
)
def _(spark, d):
    phis = spark.createDataFrame([(x / 10,) for x in range(1, 9)], "phi double")
    rows = fractions(spark, d).where("rep = 'local'").crossJoin(F.broadcast(phis))
    rows = rows.withColumn("frac", F.when(F.col("sun") >= 1 - F.col("phi"), F.col("frac")).otherwise(0.0))
    return D.priority(rows, ["phi"], 0.15).groupBy("phi").agg(F.sum("load").alias("load"), F.sum(F.when(F.col("first"), F.col("load")).otherwise(0.0)).alias("first_load"))


@REGISTRY.add(
    "dec_seasonal_stability",
    """WITH f AS (SELECT year, cusec, pop, round(pop * (1 - avg(safe::INT)), 9) AS load FROM dhours WHERE rep = 'local' AND reachable GROUP BY year, cusec, pop),
    k AS (SELECT year, cusec, row_number() OVER (PARTITION BY year ORDER BY load DESC, cusec) <= greatest(floor(count(*) OVER (PARTITION BY year) * 0.15::DOUBLE), 1) AS first FROM f),
    w AS (SELECT a.year AS year_a, b.year AS year_b, a.first AS fa, b.first AS fb FROM k a JOIN k b ON a.cusec = b.cusec AND a.year < b.year)
    SELECT year_a, year_b, count_if(fa AND fb) / nullif(count_if(fa OR fb), 0) AS jaccard FROM w GROUP BY ALL""",
    "dhours",
    "jaccard",
)
def _(spark, d):
    yearly = hours(spark, d).where("rep = 'local'").groupBy("year", "cusec", "pop", "reachable").agg(F.avg(F.col("safe").cast("double")).alias("frac"))
    lists = D.priority(yearly, ["year"], 0.15)
    a, b = (lists.select("cusec", F.col("year").alias(f"year_{n}"), F.col("first").alias(f"f{n}")) for n in "ab")
    both = a.join(b, "cusec").where("year_a < year_b")
    return both.groupBy("year_a", "year_b").agg(F.try_divide(F.count_if(F.col("fa") & F.col("fb")).cast("double"), F.count_if(F.col("fa") | F.col("fb")).cast("double")).alias("jaccard"))


@REGISTRY.add(
    "dec_map_class",
    """SELECT CASE WHEN x <= 9000 AND frac >= 0.6::DOUBLE THEN 'both' WHEN x <= 9000 THEN 'only distance' WHEN frac >= 0.6::DOUBLE THEN 'only heat' ELSE 'none' END AS class, count(*) AS sections, sum(pop) AS pop
       FROM fractions WHERE rep = 'local' GROUP BY 1""",
    "fractions",
    "pop",
)
def _(spark, d):
    rows = fractions(spark, d).where("rep = 'local'").withColumn("class", D.map_class(F.col("x") <= 9000, F.col("frac") >= 0.6))
    return rows.groupBy("class").agg(F.count("*").alias("sections"), F.sum("pop").alias("pop"))


@REGISTRY.add(
    "dec_change_class",
    """SELECT CASE WHEN NOT reachable THEN 'unreachable' WHEN frac_a >= 0.6::DOUBLE AND frac_b >= 0.6::DOUBLE THEN 'both' WHEN frac_b >= 0.6::DOUBLE THEN 'added' WHEN frac_a >= 0.6::DOUBLE THEN 'removed' ELSE 'neither' END AS class, count(*) AS sections
       FROM pairs GROUP BY 1""",
    "pairs",
)
def _(spark, d):
    return pairs(spark, d).groupBy(D.change_class(F.col("reachable"), F.col("frac_a") >= 0.6, F.col("frac_b") >= 0.6).alias("class")).agg(F.count("*").alias("sections"))


@REGISTRY.add(
    "dec_discrepancy",
    "SELECT cusec, 100 * (frac_a - frac_b) AS net_pp FROM pairs",
    "pairs",
    "net_pp",
)
def _(spark, d):
    return pairs(spark, d).select("cusec", (100 * (F.col("frac_a") - F.col("frac_b"))).alias("net_pp"))


@REGISTRY.add(
    "dec_mann_whitney",
    """WITH r AS (SELECT pop, frac_a > frac_b AS f, rank() OVER (ORDER BY pop) + (count(*) OVER (PARTITION BY pop) - 1) / 2 AS r FROM pairs WHERE reachable),
    s AS (SELECT count_if(f)::DOUBLE AS n1, count_if(NOT f)::DOUBLE AS n2, sum(CASE WHEN f THEN r ELSE 0 END) AS rs FROM r),
    z AS (SELECT n1, n2, rs - n1 * (n1 + 1) / 2 AS u, (rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM s),
    k AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM z)
    SELECT n1, n2, u, z, 2 * exp(-z * z / 2) / 2.5066282746310002::DOUBLE * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS p FROM k""",
    "pairs",
    "n1 n2 u z p",
)
def _(spark, d):
    rows = pairs(spark, d).where("reachable").withColumn("f", F.col("frac_a") > F.col("frac_b"))
    return D.mann_whitney(rows, "pop", "f")


@REGISTRY.add(
    "dec_spearman",
    """SELECT rep, corr(ra, rb) AS rho, count(*) AS n FROM (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY frac) + (count(*) OVER (PARTITION BY rep, frac) - 1) / 2 AS ra,
       rank() OVER (PARTITION BY rep ORDER BY x) + (count(*) OVER (PARTITION BY rep, x) - 1) / 2 AS rb FROM fractions) GROUP BY rep""",
    "fractions",
    "rho",
)
def _(spark, d):
    return spearman(fractions(spark, d), "frac", "x", ["rep"])


FRACTIONS = [0.05, 0.1, 0.15, 0.2, 0.25]
_REGRET = """WITH g(fraction) AS (VALUES (0.05::DOUBLE), (0.1), (0.15), (0.2), (0.25)), t AS (SELECT cusec, load AS true_load FROM priority WHERE rep = 'local'),
    e AS (SELECT fraction, rep, p.cusec, pop, load, true_load, greatest(floor(count(*) OVER (PARTITION BY fraction, rep) * fraction), 1)::INTEGER AS k FROM priority p JOIN t USING (cusec), g),
    c AS (SELECT *, row_number() OVER (PARTITION BY fraction, rep ORDER BY load DESC, cusec) <= k AS chosen FROM e),
    b AS (SELECT c.*, r.chosen AS best FROM c JOIN (SELECT fraction, cusec, chosen FROM c WHERE rep = 'local') r USING (fraction, cusec)),
    s AS (SELECT fraction, rep, max(k) AS k, sum(CASE WHEN chosen THEN true_load ELSE 0 END) AS captured, sum(CASE WHEN best THEN true_load ELSE 0 END) AS optimum, count_if(chosen AND best)::BIGINT AS overlap,
          count_if(chosen AND best) / count_if(chosen OR best) AS jaccard, sum(CASE WHEN chosen THEN pop ELSE 0 END) AS selected_pop FROM b GROUP BY ALL)
    SELECT *, optimum - captured AS regret, 100 * (optimum - captured) / optimum AS regret_pct, captured / optimum AS efficiency FROM s"""


@REGISTRY.add("reg_captured_load", _REGRET, "priority", "fraction captured optimum jaccard selected_pop regret regret_pct efficiency")
def _(spark, d):
    return D.captured_load(ranked(spark, d), "local", FRACTIONS)


def passing(spark, d):
    return fractions(spark, d).where("rep = 'local'").withColumn("passes", F.col("sun") >= 0.7)


_DOMINANCE = """SELECT *, CASE WHEN fails >= quota THEN 'sun' WHEN 2 * fails >= quota THEN 'mixed' ELSE 'heat' END AS regime FROM (
    SELECT district % 5 AS zone, n, fails, fraction, greatest(floor(n * fraction), 1)::INTEGER AS quota FROM (SELECT district % 5 AS district, count(*) AS n, count_if(sun < 0.7::DOUBLE)::BIGINT AS fails
    FROM fractions WHERE rep = 'local' AND reachable GROUP BY 1), (VALUES (0.05::DOUBLE), (0.1), (0.15), (0.2), (0.25)) g(fraction))"""


def regimes(spark, d):
    return D.dominance(passing(spark, d).withColumn("zone", F.pmod("district", F.lit(5))), FRACTIONS, ["zone"])


@REGISTRY.add("reg_dominance", _DOMINANCE, "fractions", "fraction")
def _(spark, d):
    return regimes(spark, d)


@REGISTRY.add(
    "reg_transitions",
    f"SELECT zone, min(fraction) FILTER (regime = 'sun') AS sun, min(fraction) FILTER (regime = 'mixed') AS mixed, min(fraction) FILTER (regime = 'heat') AS heat FROM ({_DOMINANCE}) GROUP BY zone",
    "fractions",
    "sun mixed heat",
)
def _(spark, d):
    return D.transitions(regimes(spark, d), ["zone"])


# bootstraps

REPLICATES, METRIC_REPLICATES = 1000, 400
_DRAW = "((({b} * 7919 + {i} * 104729 + 17) % 1000003) * 48271 + {b} * {i}) % {n}"


def days(spark, d):
    """Weeks stand in for days, so that every station has several of them in the thin synthetic panel."""
    return anomaly(spark, d).withColumn("date", F.trunc("date", "week")).withColumn("summer", F.year("date"))


def week_sums(spark, d):
    """Sums of stations and weeks, written once: the panel below them is many times larger, and days are drawn from these as well, as every anomaly has a value."""
    return staged(B.day_sums(days(spark, d), ["station"], "dt"))


view("boot", "SELECT * REPLACE (date_trunc('week', date)::DATE AS date), year(date_trunc('week', date))::INTEGER AS summer FROM anomaly", ["anomaly"])
view("boot_days", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM boot)", ["boot"])
view(
    "reps",
    f"""SELECT b, d.date, times FROM (SELECT b, {_DRAW.format(b="b", i="place", n="n")} AS place, count(*) AS times FROM boot_days, (SELECT unnest(range({REPLICATES})) AS b) GROUP BY 1, 2) JOIN boot_days d USING (place)""",
    ["boot_days"],
)
view("boot_sums", "SELECT station, date, sum(dt) AS total, count(*) AS n FROM boot GROUP BY ALL", ["boot"])
view("boot_means", "SELECT station, b, sum(total * times) / sum(n * times) AS value FROM boot_sums JOIN reps USING (date) GROUP BY ALL", ["boot_sums", "reps"])
_INTERVAL = """SELECT {unit}, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.5) AS middle, quantile_cont(value, 0.975) AS high, count(value) AS reps,
    quantile_cont(value, 0.025) > 0 OR quantile_cont(value, 0.975) < 0 AS significant FROM {means} GROUP BY {unit}"""


@REGISTRY.add("boo_station_interval", _INTERVAL.format(unit="station", means="boot_means"), "boot_means", "low middle high")
def _(spark, d):
    sums = week_sums(spark, d)
    return B.replicated_intervals(sums, B.day_replicates(sums, REPLICATES), ["station"])


@REGISTRY.add(
    "boo_decision_metric",
    f"""WITH m AS (SELECT b, stddev_pop(value) AS value FROM boot_means WHERE b < {METRIC_REPLICATES} GROUP BY b), k AS (SELECT 'spread' AS metric, value FROM m) {_INTERVAL.format(unit="metric", means="k")}""",
    "boot_means",
    "low middle high",
)
def _(spark, d):
    sums = week_sums(spark, d)
    means = B.replicated_means(sums, B.day_replicates(sums, METRIC_REPLICATES), ["station"])
    return B.intervals(means.groupBy("b").agg(F.stddev_pop("value").alias("value")).withColumn("metric", F.lit("spread")), ["metric"])


def _block_sql(length: int) -> str:
    return f"""SELECT {length} AS length, station, low, middle, high FROM ({_INTERVAL.format(unit="station", means=f'''(
        SELECT station, b, sum(total * times) / sum(n * times) AS value FROM boot_sums JOIN (
            SELECT b, p.date, count(*) AS times FROM (SELECT summer, n, b, i, CASE WHEN n <= {length} THEN 0 ELSE {_DRAW.format(b="b", i="i", n=f"(n - {length} + 1)")} END AS start
                FROM (SELECT summer, n, unnest(range(ceil(n / {length})::BIGINT)) AS i FROM sizes), (SELECT unnest(range({REPLICATES})) AS b)) s, (SELECT unnest(range({length})) AS o)
            JOIN places p ON p.summer = s.summer AND p.place = s.start + o WHERE i * {length} + o < s.n AND start + o < s.n GROUP BY ALL) USING (date) GROUP BY ALL)''')})"""


_PLACES = "places AS (SELECT summer, date, row_number() OVER (PARTITION BY summer ORDER BY date) - 1 AS place, count(*) OVER (PARTITION BY summer) AS n FROM (SELECT DISTINCT summer, date FROM boot)), sizes AS (SELECT DISTINCT summer, n FROM places)"


def blocks(spark, d, lengths):
    sums = week_sums(spark, d)
    out = []
    for length in lengths:
        drawn = B.block_replicates(sums.withColumn("summer", F.year("date")), REPLICATES, length, "summer")
        out.append(B.replicated_intervals(sums, drawn, ["station"]).select(F.lit(length).alias("length"), "station", "low", "middle", "high"))
    return out[0].unionByName(out[1])


@REGISTRY.add("boo_block_interval", f"WITH {_PLACES} {_block_sql(1)} UNION ALL {_block_sql(7)}", "boot boot_sums", "low middle high")
def _(spark, d):
    return blocks(spark, d, [1, 7])


@REGISTRY.add(
    "boo_width_ratio",
    f"""WITH {_PLACES}, r AS ({_block_sql(1)} UNION ALL {_block_sql(7)})
    SELECT station, max(high - low) FILTER (length = 7) / nullif(max(high - low) FILTER (length = 1), 0) AS width_ratio, abs(max(middle) FILTER (length = 7) - max(middle) FILTER (length = 1)) AS shift FROM r GROUP BY station""",
    "boot boot_sums",
    "width_ratio shift",
)
def _(spark, d):
    return B.width_ratio(blocks(spark, d, [1, 7]), ["station"], 7, 1)


@REGISTRY.add(
    "boo_circular",
    f"""WITH c AS (SELECT b, p AS place, count(*) AS times FROM (SELECT b, i, o, ({_DRAW.format(b="b", i="i", n="92")} + o) % 92 AS p FROM (SELECT unnest(range({REPLICATES})) AS b), (SELECT unnest(range(14)) AS i), (SELECT unnest(range(7)) AS o))
        WHERE i * 7 + o < 92 GROUP BY b, p),
    s AS (SELECT station, dayofyear(date) % 92 AS place, sum(dt) AS total, count(*) AS n FROM anomaly GROUP BY ALL),
    m AS (SELECT station, b, sum(total * times) / sum(n * times) AS value FROM s JOIN c USING (place) GROUP BY ALL) {_INTERVAL.format(unit="station", means="m")}""",
    "anomaly",
    "low middle high",
)
def _(spark, d):
    rows = anomaly(spark, d)
    sums = rows.groupBy("station", F.pmod(F.dayofyear("date"), F.lit(92)).alias("place")).agg(F.sum("dt").alias("total"), F.count("*").alias("n"))
    return B.replicated_intervals(sums, B.circular_replicates(rows, REPLICATES), ["station"], ["place"])


view("scope_means", "SELECT scope AS rep, b, sum(total * times) / sum(n * times) AS value FROM boot_sums JOIN stations USING (station) JOIN reps USING (date) GROUP BY ALL", ["boot_sums", "stations", "reps"])


@REGISTRY.add(
    "reg_paired_difference",
    """WITH m AS (SELECT x.rep AS a, y.rep AS other, x.value - y.value AS d FROM scope_means x JOIN scope_means y ON x.b = y.b AND x.rep < y.rep),
    q AS (SELECT a, other, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.5) AS middle, quantile_cont(d, 0.975) AS high FROM m GROUP BY a, other) SELECT *, low <= 0 AND high >= 0 AS holds_zero FROM q""",
    "scope_means",
    "low middle high",
)
def _(spark, d):
    rows = days(spark, d).join(stations(spark, d).select("station", "scope"), "station")
    means = B.replicated_means(B.day_sums(rows, ["scope"], "dt"), B.day_replicates(rows, REPLICATES), ["scope"])
    return D.paired_differences(means.withColumnRenamed("scope", "rep"))
