"""Information levels, dominance grids, bootstrapped regret and sensitivities of the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.functions.joins import small
from umbra.operators import decisions as D
from umbra.operators import geometry as G
from umbra.operators import network as N
from umbra.operators import regret as R
from umbra.operators import resample as B
from umbra.operators import shade as S
from umbra.plans.decision_plans import _DRAW, FRACTIONS, hours
from umbra.plans.inputs import REGISTRY, read, sections, view
from umbra.plans.network_plans import _COST, _SNAP, BUDGET, COARSE, FINE, HOURLY, HOURS, SPEED, chosen_sql, edges, facilities, grid_paths, relax_sql, snapped
from umbra.plans.shade_plans import _SUNS, GRID, cells, points, suns
from umbra.sources.staging import staged

LIMIT, REPLICATES = 0.4, 200
_GRID = "(VALUES (0.05::DOUBLE), (0.1), (0.15), (0.2), (0.25)) g(fraction)"


def day_sums(spark, d):
    """Safe hours of a section and day under the coarse and the local field."""
    of = lambda rep: F.sum(F.when(F.col("rep") == rep, F.col("safe").cast("double")))
    return hours(spark, d).groupBy("cusec", "date").agg(of("regional").alias("coarse"), of("local").alias("local"), F.count_if(F.col("rep") == "local").alias("n"))


def exposed(spark, d):
    key = F.col("cusec").cast("int")
    full = F.pmod(key * 37, F.lit(100)) / 100
    return sections(spark, d).select("cusec", "pop", "reachable", full.alias("exposed_full"), F.least(F.lit(1.0), full + F.pmod(key, F.lit(5)) / 10).alias("exposed_buildings"))


view("level_sums", "SELECT cusec, date, (count(*) FILTER (rep = 'regional' AND safe))::DOUBLE AS coarse, (count(*) FILTER (rep = 'local' AND safe))::DOUBLE AS local, count(*) FILTER (rep = 'local') AS n FROM dhours GROUP BY ALL", ["dhours"])
view("exposed", "SELECT cusec, pop, reachable, cusec::INTEGER * 37 % 100 / 100 AS exposed_full, least(1.0, cusec::INTEGER * 37 % 100 / 100 + cusec::INTEGER % 5 / 10) AS exposed_buildings FROM sections", ["sections"])
_LEVELS = """SELECT {keys}cusec, pop, rep, frac, round(pop * (1 - frac), 9) AS load FROM {means} JOIN exposed USING (cusec), LATERAL (VALUES ('R1', coarse), ('R2', coarse * (exposed_full <= 0.4)::INTEGER), ('R3', local),
    ('R4', local * (exposed_buildings <= 0.4)::INTEGER), ('R5', local * (exposed_full <= 0.4)::INTEGER)) v(rep, frac) WHERE reachable"""
view("levels", _LEVELS.format(keys="", means="(SELECT cusec, sum(coarse) / sum(n) AS coarse, sum(local) / sum(n) AS local FROM level_sums GROUP BY cusec)"), ["level_sums", "exposed"])


def levels(spark, d):
    means = day_sums(spark, d).groupBy("cusec").agg((F.sum("coarse") / F.sum("n")).alias("coarse"), (F.sum("local") / F.sum("n")).alias("local"))
    return R.information_levels(exposed(spark, d).join(means, "cusec"), LIMIT)


@REGISTRY.add("reg_levels", "SELECT cusec, rep, frac, load FROM levels", "levels", "frac load")
def _(spark, d):
    return levels(spark, d).select("cusec", "rep", "frac", "load")


@REGISTRY.add(
    "reg_level_regret",
    f"""WITH c2 AS (SELECT fraction, rep, cusec, pop, load, row_number() OVER (PARTITION BY fraction, rep ORDER BY load DESC, cusec) AS place, greatest(floor(count(*) OVER (PARTITION BY fraction, rep) * fraction), 1)::INTEGER AS k FROM levels, {_GRID}),
    r AS (SELECT fraction, cusec, load AS true_load, place <= k AS best FROM c2 WHERE rep = 'R5'),
    s AS (SELECT fraction, rep, max(k) AS k, sum(CASE WHEN place <= k THEN true_load ELSE 0 END) AS captured, sum(CASE WHEN best THEN true_load ELSE 0 END) AS optimum, count_if(place <= k AND best)::BIGINT AS overlap,
        count_if(place <= k AND best) / count_if(place <= k OR best) AS jaccard, sum(CASE WHEN place <= k THEN pop ELSE 0 END) AS selected_pop FROM c2 JOIN r USING (fraction, cusec) GROUP BY ALL)
    SELECT *, optimum - captured AS regret, 100 * (optimum - captured) / optimum AS regret_pct, captured / optimum AS efficiency FROM s""",
    "levels",
    "fraction captured optimum jaccard selected_pop regret regret_pct efficiency",
)
def _(spark, d):
    return D.captured_load(levels(spark, d), "R5", FRACTIONS)


@REGISTRY.add(
    "boo_regret",
    f"""WITH bd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM level_sums)),
    rp AS (SELECT b, d.date, times FROM (SELECT b, {_DRAW.format(b="b", i="place", n="n")} AS place, count(*) AS times FROM bd, (SELECT unnest(range({REPLICATES})) AS b) GROUP BY 1, 2) JOIN bd d USING (place)),
    m AS (SELECT cusec, b, sum(coarse * times) / sum(n * times) AS coarse, sum(local * times) / sum(n * times) AS local FROM level_sums JOIN rp USING (date) GROUP BY ALL),
    l AS ({_LEVELS.format(keys="b, ", means="m")}), t AS (SELECT b, cusec, load AS true_load FROM l WHERE rep = 'R5'),
    c AS (SELECT rep, b, true_load, row_number() OVER w AS place, count(*) OVER (PARTITION BY rep, b) AS size FROM l JOIN t USING (b, cusec) WINDOW w AS (PARTITION BY rep, b ORDER BY load DESC, cusec)),
    k AS (SELECT rep, b, fraction, sum(true_load) AS captured FROM c, {_GRID} WHERE place <= greatest(floor(size * fraction), 1) GROUP BY ALL),
    e AS (SELECT k.rep, k.fraction, 100 * (o.captured - k.captured) / o.captured AS regret, 100 * k.captured / o.captured AS efficiency FROM k JOIN k o ON o.b = k.b AND o.fraction = k.fraction AND o.rep = 'R5')
    SELECT rep, fraction, count(regret) AS reps, quantile_cont(regret, 0.025) AS regret_low, quantile_cont(regret, 0.5) AS regret, quantile_cont(regret, 0.975) AS regret_high,
        quantile_cont(efficiency, 0.025) AS efficiency_low, quantile_cont(efficiency, 0.5) AS efficiency, quantile_cont(efficiency, 0.975) AS efficiency_high FROM e GROUP BY rep, fraction""",
    "level_sums exposed",
    "fraction regret_low regret regret_high efficiency_low efficiency efficiency_high",
)
def _(spark, d):
    sums = staged(day_sums(spark, d))
    return R.regret_intervals(R.regret_replicates(exposed(spark, d), sums, B.day_replicates(sums, REPLICATES), FRACTIONS, LIMIT))


WINDOWS = {"midday": [11, 14], "late": [14, 17]}
CASES = [(v, b, SPEED / v) for v in (0.8, 1.0, 1.25) for b in (30.0, 45.0, 60.0)]
_DOMINANCE_GRID = f"""WITH {HOURLY},
    e AS (SELECT node, hour, speed, budget, bool_or(s.t * (1.25 / speed) <= budget) AS ok, arg_min(s.t, {{'s': round(s.sun, 9), 'w': weight}}) FILTER (s.t * (1.25 / speed) <= budget) AS t,
        arg_min(s.sun, {{'s': round(s.sun, 9), 'w': weight}}) FILTER (s.t * (1.25 / speed) <= budget) AS sun FROM best, (VALUES (0.8::DOUBLE), (1.0), (1.25)) v(speed), (VALUES (30.0::DOUBLE), (45.0), (60.0)) b(budget) GROUP BY ALL),
    x AS (SELECT node, speed, budget, name, bool_and(ok) AS there, avg(CASE WHEN t > 0 THEN sun / t END) AS exposed FROM e JOIN (VALUES ('midday', 11), ('midday', 14), ('late', 14), ('late', 17)) w(name, hour) USING (hour) GROUP BY ALL),
    n AS (SELECT speed, budget, name, count_if(there) AS n, 100 * sum(CASE WHEN there THEN pop ELSE 0 END) / sum(pop) AS people_pct, count_if(there AND coalesce(exposed > 0.4, false))::BIGINT AS fails
        FROM ({_SNAP}) p JOIN sections ON cusec = point JOIN x ON x.node = p.b.node GROUP BY ALL)
    SELECT speed, budget, name AS "window", n::BIGINT AS n, people_pct, fails, fraction, quota, fails / quota AS ratio, CASE WHEN fails >= quota THEN 'sun' WHEN 2 * fails >= quota THEN 'mixed' ELSE 'heat' END AS regime
    FROM (SELECT *, greatest(floor(n * fraction), 1)::INTEGER AS quota FROM n, {_GRID})"""


def dominance_grid(spark, d):
    placed = staged(sections(spark, d).select(F.col("cusec").alias("point"), "pop").join(snapped(spark, d).select("point", "node"), "point"))
    paths = grid_paths(spark, d, FINE, hours=True).join(small(placed.select("node").distinct()), "node").select("hour", "node", F.inline("paths"))
    exposure = R.window_exposure(paths, spark.createDataFrame(CASES, "speed double, budget double, factor double"), WINDOWS)
    return R.dominance_grid(placed, exposure, FRACTIONS, LIMIT)


@REGISTRY.add("reg_dominance_grid", _DOMINANCE_GRID, "hour_minutes facilities nodes sections", "speed budget people_pct fraction ratio")
def _(spark, d):
    return dominance_grid(spark, d)


@REGISTRY.add(
    "reg_grid_transitions",
    f"""SELECT speed, budget, "window", min(fraction) FILTER (regime = 'sun') AS sun, min(fraction) FILTER (regime = 'mixed') AS mixed, min(fraction) FILTER (regime = 'heat') AS heat FROM ({_DOMINANCE_GRID}) GROUP BY ALL""",
    "hour_minutes facilities nodes sections",
    "speed budget sun mixed heat",
)
def _(spark, d):
    return D.transitions(dominance_grid(spark, d), ["speed", "budget", "window"])


# transmittance of the canopy and height factors through the whole chain

TAUS, THRESHOLDS, SUN_BUDGETS, FACTORS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6], [28.0, 30.0, 32.0], [4.0, 8.0, 12.0], [0.8, 1.0, 1.2]
view(
    "safe_shares",
    """SELECT cusec, u, avg((25 + o_orderkey * 7 % 9 < u)::INTEGER) AS coarse, avg((24 + o_orderkey % 13 < u)::INTEGER) AS local
       FROM (SELECT lpad(o_custkey::VARCHAR, 7, '0') AS cusec, o_orderkey FROM orders), (VALUES (28.0::DOUBLE), (30.0), (32.0)) t(u) GROUP BY ALL""",
)
view("tau_minutes", "SELECT u, v, tau, t, t * (greatest(0, least(1, 1 - f)) + tau * greatest(0, least(1, f - frac))) AS sun FROM (SELECT u, v, e.length / 1.25 / 60 AS t, e.frac AS frac, least(1.0, e.frac + (u + v) % 4 / 10) AS f FROM twoway), (SELECT i / 10 AS tau FROM range(7) r(i))", ["twoway"])


def safe_shares(spark, d):
    key, grid = F.col("o_orderkey"), spark.createDataFrame([(u,) for u in THRESHOLDS], "u double")
    rows = read(spark, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 7, "0").alias("cusec"), (25 + F.pmod(key * 7, F.lit(9))).alias("tc"), (24 + F.pmod(key, F.lit(13))).alias("tl"))
    under = lambda c: F.avg((F.col(c) < F.col("u")).cast("double"))
    return rows.crossJoin(F.broadcast(grid)).groupBy("cusec", "u").agg(under("tc").alias("coarse"), under("tl").alias("local"))


def chain_sql(by: str, walked: str, pick: str) -> str:
    """Metrics for ``walked`` (by, node, sun) after the recursive part ``pick``."""
    return f"""WITH {pick}, k AS ({walked}), n AS ({_SNAP}), w AS (SELECT k.{by}, n.point AS cusec, k.sun FROM k JOIN n ON n.b.node = k.node),
    c AS (SELECT {by}, u, budget, cusec, pop, reachable, w.sun, coalesce(w.sun <= budget, false)::INTEGER::DOUBLE AS solar, coarse, local
        FROM sections CROSS JOIN (SELECT DISTINCT {by} FROM k) CROSS JOIN (VALUES (4.0::DOUBLE), (8.0), (12.0)) b(budget) LEFT JOIN w USING ({by}, cusec) JOIN safe_shares USING (cusec)),
    f AS (SELECT *, CASE WHEN reachable THEN coarse * solar ELSE 0 END AS fc, CASE WHEN reachable THEN local * solar ELSE 0 END AS fl FROM c),
    l AS (SELECT *, CASE WHEN reachable THEN round(pop * (1 - fc), 9) END AS lc, CASE WHEN reachable THEN round(pop * (1 - fl), 9) END AS ll,
        greatest(floor(count_if(reachable) OVER (PARTITION BY {by}, u, budget) * 0.2::DOUBLE), 1) AS quota FROM f),
    t AS (SELECT *, reachable AND row_number() OVER (PARTITION BY {by}, u, budget ORDER BY lc DESC NULLS LAST, cusec) <= quota AS tc, reachable AND row_number() OVER (PARTITION BY {by}, u, budget ORDER BY ll DESC NULLS LAST, cusec) <= quota AS tl FROM l)
    SELECT {by}, u, budget, 100 * avg(solar) FILTER (reachable) AS solar_pct, median(sun) FILTER (reachable) AS sun_median, 100 * sum(fc * pop) / sum(pop) AS coverage_coarse, 100 * sum(fl * pop) / sum(pop) AS coverage_local,
        count_if(tc AND tl) / count_if(tc OR tl) AS jaccard, sum(CASE WHEN tl AND NOT tc THEN pop ELSE 0 END) AS moved_people, 100 * avg(solar) FILTER (reachable) < 60 AS saturated FROM t GROUP BY ALL"""


_CHAIN = "u budget solar_pct sun_median coverage_coarse coverage_local jaccard moved_people"
_FIVE = "(SELECT i / 4 AS weight FROM range(5) r(i)) w"
_TAU = relax_sql("tau_minutes m ON m.u = b.node AND m.tau = b.tau", "tau weight", f"{_FIVE}, (SELECT i / 10 AS tau FROM range(7) r(i)) ts", _COST)


def walked(spark, d, lit, parts, by, each):
    """(by, cusec, sun) of the nodes that sections snap to: ``parts`` are the keys (one tuple for each part of the grid) named ``by``, over which the least sun is averaged for ``each``."""
    at = staged(snapped(spark, d).select(F.col("point").alias("cusec"), "node"))
    keys = F.get(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(by, part, strict=True)]) for part in parts]), F.col("part"))
    rows = N.relax_cases(lit, facilities(spark, d), COARSE).join(small(at.select("node").distinct()), "node").withColumn("key", keys).select("key.*", "node", "paths")
    found = N.constrained_paths(rows, BUDGET, by)
    return found.groupBy(each, "node").agg(F.avg("sun").alias("sun")).join(at, "node").select(each, "cusec", "sun")


@REGISTRY.add("dec_transmittance_curve", chain_sql("tau", chosen_sql(by="tau, "), _TAU), "tau_minutes facilities nodes sections safe_shares", f"tau {_CHAIN}")
def _(spark, d):
    full = F.least(F.lit(1.0), F.col("frac") + F.pmod(F.col("u") + F.col("v"), F.lit(4)) / 10)
    minutes = N.undirected(edges(spark, d), ["length", "frac"]).withColumn("t", F.col("length") / SPEED / 60)
    lit = minutes.select("u", "v", "t", F.array(*[S.exposure(F.col("t"), F.col("frac"), full, F.lit(x)) for x in TAUS]).alias("suns"))
    found = walked(spark, d, lit, [(x,) for x in TAUS], ["tau"], "tau")
    return R.chain_metrics(sections(spark, d), found, safe_shares(spark, d), SUN_BUDGETS, ["tau"])


_AT = f"""SELECT edge, least(greatest(floor(round(y, 6) / 3), 0), {GRID - 1})::INTEGER AS row, least(greatest(floor(round(x, 6) / 3), 0), {GRID - 1})::INTEGER AS col FROM points"""
view(
    "factor_shaded",
    f"""SELECT DISTINCT sun, factor, row, col FROM (
        SELECT sun, factor, (row - round_even(round(n * -cos(radians(azimuth)), 9), 0))::INTEGER AS row, (col - round_even(round(n * sin(radians(azimuth)), 9), 0))::INTEGER AS col
        FROM (SELECT *, unnest(range(1, ceil(h * factor / (tan(radians(elevation)) * 3))::BIGINT)) AS n FROM cells, {_SUNS}, (VALUES (0.8::DOUBLE), (1.0), (1.2)) f(factor) WHERE elevation > 5))
        WHERE row BETWEEN 0 AND {GRID - 1} AND col BETWEEN 0 AND {GRID - 1}""",
    ["cells"],
)
view(
    "factor_shade",
    f"""SELECT edge, s.sun, factor, avg(CASE WHEN elevation <= 5 OR h.sun IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS frac FROM ({_AT}) p CROSS JOIN {_SUNS} CROSS JOIN (VALUES (0.8::DOUBLE), (1.0), (1.2)) f(factor)
        LEFT JOIN factor_shaded h USING (sun, factor, row, col) GROUP BY ALL""",
    ["points", "factor_shaded"],
)


def factor_shade(spark, d):
    at = points(spark, d).select("edge", G.cell(F.round("y", 6), 0.0, 3.0, GRID - 1).alias("row"), G.cell(F.round("x", 6), 0.0, 3.0, GRID - 1).alias("col"))
    return S.factor_shade(at, S.least_factors(cells(spark, d), suns(spark), 3.0, GRID, GRID, max(FACTORS)), suns(spark), FACTORS)


@REGISTRY.add(
    "shd_height_factors",
    """WITH n AS (SELECT sun, factor, sum(frac * length) / sum(length) AS shade FROM factor_shade JOIN (SELECT cusec AS edge, abs(x - y) + 1 AS length FROM sections) USING (edge) GROUP BY ALL)
    SELECT n.sun, n.factor, n.shade, n.shade - c.shade AS change FROM n JOIN n c ON c.sun = n.sun AND c.factor = 1""",
    "factor_shade sections",
    "factor shade change",
)
def _(spark, d):
    lengths = sections(spark, d).select(F.col("cusec").alias("edge"), (F.abs(F.col("x") - F.col("y")) + 1).alias("length"))
    return S.factor_changes(factor_shade(spark, d), lengths)


view(
    "factor_minutes",
    """SELECT u, v, hour, factor, t, t * (1 - coalesce(frac, 0)) AS sun FROM (SELECT u, v, e.length / 1.25 / 60 AS t, lpad((least(u, v) % (SELECT count(*) FROM customer))::VARCHAR, 7, '0') AS edge FROM twoway) m
       CROSS JOIN (VALUES ('morning', 11), ('noon', 14), ('evening', 17)) h(sun, hour) CROSS JOIN (VALUES (0.8::DOUBLE), (1.0), (1.2)) f(factor) LEFT JOIN factor_shade s USING (edge, sun, factor)""",
    ["twoway", "factor_shade"],
)
_FACTOR = relax_sql("factor_minutes m ON m.u = b.node AND m.hour = b.hour AND m.factor = b.factor", "factor hour weight", f"{_FIVE}, (VALUES (11), (14), (17)) h(hour), (VALUES (0.8::DOUBLE), (1.0), (1.2)) f(factor)", _COST)


@REGISTRY.add(
    "dec_height_factors",
    chain_sql("factor", f"SELECT factor, node, avg(sun) AS sun FROM ({chosen_sql(by='factor, hour, ')}) GROUP BY factor, node", _FACTOR),
    "factor_minutes facilities nodes sections safe_shares",
    f"factor {_CHAIN}",
)
def _(spark, d):
    """Heights times a factor, from the shade of every edge through routes of all hours to lists."""
    count = read(spark, d, "customer").count()
    named = F.lpad(F.pmod(F.least("u", "v"), F.lit(count)).cast("string"), 7, "0")
    keyed = [(s, h, f) for s, h in zip(("morning", "noon", "evening"), HOURS, strict=True) for f in FACTORS]
    fracs = [F.max(F.when((F.col("sun") == s) & (F.col("factor") == f), F.col("frac"))).alias(f"f{i}") for i, (s, _, f) in enumerate(keyed)]
    shade = factor_shade(spark, d).groupBy("edge").agg(*fracs)
    minutes = N.undirected(edges(spark, d), ["length", "frac"]).select("u", "v", (F.col("length") / SPEED / 60).alias("t"), named.alias("edge"))
    suns_ = F.array(*[F.col("t") * (1 - F.coalesce(f"f{i}", F.lit(0.0))) for i in range(len(keyed))])
    lit = minutes.join(shade, "edge", "left").select("u", "v", "t", suns_.alias("suns"))
    found = walked(spark, d, lit, [(f, h) for _, h, f in keyed], ["factor", "hour"], "factor")
    return R.chain_metrics(sections(spark, d), found, safe_shares(spark, d), SUN_BUDGETS, ["factor"])
