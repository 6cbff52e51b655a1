"""Network and audit queries: parts are nodes of a street grid, suppliers its facilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.operators import audit as A
from umbra.operators import network as N
from umbra.plans.inputs import REGISTRY, read, sections, view


def edges(spark, d):
    """Edges from every part to the next and to the one 40 on, if they are there; some are listed twice."""
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("u"), F.col("p_retailprice").alias("length"), (F.pmod(F.col("p_partkey") * 31, F.lit(100)) / 100).alias("frac"))
    ahead = parts.select("u", F.explode(F.transform(F.array(F.lit(1), F.lit(40), F.lit(1)), lambda s: F.col("u") + s)).alias("v"), "length", "frac")
    there = parts.select(F.col("u").alias("v"))
    return ahead.join(there, "v", "left_semi").select("u", "v", "length", "frac")


view(
    "edges",
    """SELECT p_partkey AS u, p_partkey + s AS v, p_retailprice AS length, (p_partkey * 31 % 100) / 100 AS frac FROM part, (VALUES (1), (40), (1)) t(s)
       WHERE p_partkey + s IN (SELECT p_partkey FROM part)""",
)


@REGISTRY.add(
    "net_undirected",
    "SELECT u, v, min(length) AS length FROM (SELECT u, v, length FROM edges UNION ALL SELECT v, u, length FROM edges) WHERE u <> v GROUP BY u, v",
    "edges",
    "length",
)
def _(spark, d):
    return N.undirected(edges(spark, d)).select("u", "v", "length")


def facilities(spark, d):
    """Suppliers spread over the nodes."""
    n = read(spark, d, "part").count()
    return read(spark, d, "supplier").select(F.pmod(F.col("s_suppkey") * 7919, F.lit(n)).alias("node")).distinct()


SPEED, BUDGET = 1.25, 60.0
FINE, COARSE = [i / 20 for i in range(21)], [0.0, 0.25, 0.5, 0.75, 1.0]
HOURS = [11, 14, 17]
view("twoway", "SELECT u, v, min(struct_pack(length := length, frac := frac)) AS e FROM (SELECT u, v, length, frac FROM edges UNION ALL SELECT v, u, length, frac FROM edges) WHERE u <> v GROUP BY u, v", ["edges"])
view("minutes", "SELECT u, v, e.length / 1.25 / 60 AS t, e.length / 1.25 / 60 * (1 - e.frac) AS sun FROM twoway", ["twoway"])
view("facilities", "SELECT DISTINCT (s_suppkey * 7919) % (SELECT count(*) FROM part) AS node FROM supplier")
view("nodes", "SELECT p_partkey AS node, (p_partkey % 40 * 500)::DOUBLE AS x, (p_partkey // 40 * 400 % 20000)::DOUBLE AS y FROM part")
#: The least struct (cost, t, sun, run, worst) of every node, improved round by round.
_RELAX = """RECURSIVE best(node, s) USING KEY (node) AS (
    SELECT node, {'cost': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'sun': 0.0::DOUBLE, 'run': 0.0::DOUBLE, 'worst': 0.0::DOUBLE} FROM facilities
    UNION (
    SELECT o.v, min(o.s) AS s FROM (
        SELECT v, {'cost': s.cost + t, 't': s.t + t, 'sun': s.sun + sun, 'run': run, 'worst': greatest(s.worst, run)} AS s FROM (
            SELECT m.v, b.s, m.t, m.sun, CASE WHEN m.sun > 0.5 * m.t THEN b.s.run + m.t ELSE 0 END AS run FROM best b JOIN minutes m ON m.u = b.node)) o
    LEFT JOIN recurring.best k ON k.node = o.v WHERE k.node IS NULL OR o.s < k.s GROUP BY o.v))"""


def by_hour(both, spark):
    """Edges at every hour; the shaded fraction moves with the sun."""
    hours = spark.createDataFrame([(h,) for h in HOURS], "hour int")
    return both.crossJoin(F.broadcast(hours)).withColumn("frac", F.pmod(F.round(F.col("frac") * 100).cast("int") + F.col("hour") * 17, F.lit(100)) / 100)


def routes(spark, d, weights, hours=False):
    """The whole graph, all weights and, if asked, hours at once."""
    both = N.undirected(edges(spark, d), ["length", "frac"])
    grid = spark.createDataFrame([(w,) for w in weights], "weight double")
    sources = facilities(spark, d).crossJoin(F.broadcast(grid))
    if hours:
        both, sources = by_hour(both, spark), sources.crossJoin(F.broadcast(spark.createDataFrame([(h,) for h in HOURS], "hour int")))
    return N.relax(N.weighted_edges(both, grid, SPEED), sources, ["hour", "weight"] if hours else ["weight"])


def grid_paths(spark, d, weights, hours=False):
    """(hour, node, paths) or (node, paths): the same routes with a row for each node and hour."""
    minutes = F.col("length") / SPEED / 60
    shifts = HOURS if hours else [None]
    frac = lambda h: F.col("frac") if h is None else F.pmod(F.round(F.col("frac") * 100).cast("int") + h * 17, F.lit(100)) / 100
    lit = N.undirected(edges(spark, d), ["length", "frac"]).withColumn("t", minutes)
    lit = lit.select("u", "v", "t", F.array(*[F.col("t") * (1 - frac(h)) for h in shifts]).alias("suns"))
    rows = N.relax_cases(lit, facilities(spark, d), weights)
    return rows.select(F.get(F.array(*map(F.lit, HOURS)), F.col("part")).alias("hour"), "node", "paths") if hours else rows.select("node", "paths")


def nodes(spark, d):
    key = F.col("p_partkey")
    return read(spark, d, "part").select(key.alias("node"), (F.pmod(key, F.lit(40)) * 500).cast("double").alias("x"), F.pmod(F.floor(key / 40) * 400, F.lit(20000)).cast("double").alias("y"))


def snapped(spark, d):
    return N.snap(sections(spark, d).select(F.col("cusec").alias("point"), "x", "y"), nodes(spark, d), 500.0)


@REGISTRY.add("net_distance", f"WITH {_RELAX} SELECT node, s.t AS t, s.sun AS sun, s.worst AS worst FROM best", "minutes facilities", "t sun worst")
def _(spark, d):
    return routes(spark, d, [0.0]).select("node", "t", "sun", "worst")


view("hour_minutes", "SELECT u, v, hour, t, t * (1 - (round(frac * 100)::INTEGER + hour * 17) % 100 / 100) AS sun FROM (SELECT u, v, e.length / 1.25 / 60 AS t, e.frac AS frac FROM twoway), (VALUES (11), (14), (17)) h(hour)", ["twoway"])


def relax_sql(table: str, keys: str, start: str, cost: str) -> str:
    """The recursive part for routes with keys: ``table`` (u, v, t, sun, some of the keys m.k), ``start`` the keys of all sources."""
    names = keys.split()
    same = " AND ".join(f"k.{k} = o.{k}" for k in names)
    of = lambda alias: ", ".join(f"{alias}.{k}" for k in names)
    return f"""RECURSIVE best(node, {", ".join(names)}, s) USING KEY (node, {", ".join(names)}) AS (
    SELECT node, {", ".join(names)}, {{'cost': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'sun': 0.0::DOUBLE, 'run': 0.0::DOUBLE, 'worst': 0.0::DOUBLE}} FROM facilities, {start}
    UNION (
    SELECT o.v, {of("o")}, min(o.s) AS s FROM (
        SELECT v, {", ".join(names)}, {{'cost': s.cost + cost, 't': s.t + t, 'sun': s.sun + sun, 'run': run, 'worst': greatest(s.worst, run)}} AS s FROM (
            SELECT m.v, {of("b")}, b.s, m.t, m.sun, {cost} AS cost, CASE WHEN m.sun > 0.5 * m.t THEN b.s.run + m.t ELSE 0 END AS run FROM best b JOIN {table})) o
    LEFT JOIN recurring.best k ON k.node = o.v AND {same} WHERE k.node IS NULL OR o.s < k.s GROUP BY o.v, {of("o")}))"""


_COST = "(1 - b.weight) * m.t + b.weight * m.sun"
_FINE = "(SELECT i / 20 AS weight FROM range(21) r(i)) w"
HOURLY = relax_sql("hour_minutes m ON m.u = b.node AND m.hour = b.hour", "hour weight", f"{_FINE}, (VALUES (11), (14), (17)) h(hour)", _COST)


def chosen_sql(where: str = "true", by: str = "hour, ") -> str:
    order = "{'s': round(s.sun, 9), 'w': weight}"
    kept = f"FILTER (s.t <= {BUDGET})"
    return f"""SELECT {by}node, arg_min(s.t, {order}) {kept} AS t, arg_min(s.sun, {order}) {kept} AS sun, arg_min(s.worst, {order}) {kept} AS worst,
        arg_min(s.t, weight) AS t_fast, arg_min(s.sun, weight) AS sun_fast, bool_or(s.t <= {BUDGET}) AS reachable FROM best WHERE {where} GROUP BY {by}node"""


@REGISTRY.add("net_constrained_routes", f"WITH {HOURLY} {chosen_sql()}", "hour_minutes facilities", "t sun worst t_fast sun_fast")
def _(spark, d):
    return N.constrained_paths(grid_paths(spark, d, FINE, hours=True), BUDGET, ["hour"])


@REGISTRY.add(
    "net_frontier_summary",
    f"""WITH {HOURLY}, c AS ({chosen_sql()}) SELECT hour, count(*) AS nodes, median(t_fast) AS t_fast, median(t) AS t_shaded, median(sun_fast) AS sun_fast, median(sun) AS sun_shaded,
        100 * (1 - sum(sun) / sum(sun_fast)) AS sun_saved_pct, 100 * (sum(t) / sum(t_fast) - 1) AS time_paid_pct FROM c WHERE reachable GROUP BY hour""",
    "hour_minutes facilities",
    "t_fast t_shaded sun_fast sun_shaded sun_saved_pct time_paid_pct",
)
def _(spark, d):
    return N.frontier_summary(N.constrained_paths(grid_paths(spark, d, FINE, hours=True), BUDGET, ["hour"]), ["hour"])


@REGISTRY.add(
    "net_grid_convergence",
    f"""WITH {HOURLY}, f AS ({chosen_sql()}), c AS ({chosen_sql("weight IN (0, 0.25, 0.5, 0.75, 1)")})
        SELECT hour, count(*) AS nodes, avg(c.sun - f.sun) AS mean_sun, max(c.sun - f.sun) AS max_sun, 100 * count_if(c.sun - f.sun > 1e-9) / count(*) AS improved_pct, max(abs(c.t - f.t)) AS max_t
        FROM c JOIN f USING (hour, node) WHERE c.reachable AND f.reachable GROUP BY hour""",
    "hour_minutes facilities",
    "mean_sun max_sun improved_pct max_t",
)
def _(spark, d):
    fine = grid_paths(spark, d, FINE, hours=True)
    return N.grid_convergence(N.constrained_paths(fine, BUDGET, ["hour"], COARSE), N.constrained_paths(fine, BUDGET, ["hour"]), ["hour"])


_SNAP = "SELECT cusec AS point, min(struct_pack(far := sqrt(power(s.x - n.x, 2) + power(s.y - n.y, 2)), node := node)) AS b FROM sections s, nodes n GROUP BY cusec"
WEIGHTED = relax_sql("minutes m ON m.u = b.node", "weight", _FINE, _COST)


@REGISTRY.add(
    "net_budget_grid",
    f"""WITH {WEIGHTED}, p AS (SELECT b.node AS node, sum(pop) AS pop FROM ({_SNAP}) JOIN sections ON cusec = point GROUP BY b.node),
    e AS (SELECT speed, budget, node, min(s.sun * (1.25 / speed)) FILTER (s.t * (1.25 / speed) <= budget) AS sun, bool_or(s.t * (1.25 / speed) <= budget) AS reached
        FROM best, (VALUES (0.8::DOUBLE), (1.0), (1.25)) v(speed), (VALUES (30.0::DOUBLE), (45.0), (60.0)) g(budget) GROUP BY ALL)
    SELECT speed, budget, count_if(reached)::BIGINT AS nodes, coalesce(sum(coalesce(pop, 0)) FILTER (reached), 0) AS people, 100 * sum(coalesce(pop, 0)) FILTER (reached) / sum(coalesce(pop, 0)) AS people_pct,
        median(sun) FILTER (reached) AS sun FROM e LEFT JOIN p USING (node) GROUP BY speed, budget""",
    "minutes facilities nodes sections",
    "speed budget people people_pct sun",
)
def _(spark, d):
    cases = [(v, b, SPEED / v) for v in (0.8, 1.0, 1.25) for b in (30.0, 45.0, 60.0)]
    people = sections(spark, d).select(F.col("cusec").alias("point"), "pop").join(snapped(spark, d), "point").groupBy("node").agg(F.sum("pop").alias("pop"))
    return N.budget_grid(grid_paths(spark, d, FINE), spark.createDataFrame(cases, "speed double, budget double, factor double"), people)


FORTY = [i / 40 for i in range(41)]
_FORTY = relax_sql("minutes m ON m.u = b.node", "weight", "(SELECT i / 40 AS weight FROM range(41) r(i)) w", _COST)


@REGISTRY.add(
    "net_mode_convergence",
    f"""WITH {_FORTY}, r AS (SELECT p.point, weight, s.t + CASE mode WHEN 'network' THEN 0 ELSE p.b.far / 1.25 / 60 END AS t, s.sun + CASE mode WHEN 'sun' THEN p.b.far / 1.25 / 60 ELSE 0 END AS sun, mode
        FROM ({_SNAP}) p JOIN best ON best.node = p.b.node, (VALUES ('network'), ('sun'), ('shade')) m(mode)),
    c AS (SELECT point, mode, min({{'o': round(sun, 9), 'w': weight, 't': t, 'sun': sun}}) FILTER ((weight * 20) = floor(weight * 20)) AS was, min({{'o': round(sun, 9), 'w': weight, 't': t, 'sun': sun}}) AS now, count(*) AS evaluations
        FROM r WHERE t <= 60 GROUP BY point, mode HAVING was IS NOT NULL),
    f AS (SELECT point, mode, evaluations, pop, CASE WHEN was.t > 0 THEN was.sun / was.t ELSE 0 END AS a, CASE WHEN now.t > 0 THEN now.sun / now.t ELSE 0 END AS b FROM c JOIN sections ON cusec = point),
    q AS (SELECT *, greatest(floor(count(*) OVER (PARTITION BY mode) * 0.15::DOUBLE), 1) AS quota, row_number() OVER (PARTITION BY mode ORDER BY CASE WHEN round(a, 9) > 0.4 THEN pop ELSE 0 END DESC, point) AS pa,
        row_number() OVER (PARTITION BY mode ORDER BY CASE WHEN round(b, 9) > 0.4 THEN pop ELSE 0 END DESC, point) AS pb FROM f)
    SELECT mode, count(*) AS reachable, sum(evaluations)::BIGINT AS evaluations, count_if((round(a, 9) <= 0.4) <> (round(b, 9) <= 0.4))::BIGINT AS changed_pass, max(a - b) AS largest_drop, count_if(pb <= quota AND pa > quota)::BIGINT AS swaps FROM q GROUP BY mode""",
    "minutes facilities nodes sections",
    "largest_drop",
)
def _(spark, d):
    """Twenty-one weights against forty-one."""
    people = sections(spark, d).select(F.col("cusec").alias("point"), "pop")
    at = snapped(spark, d)
    found = grid_paths(spark, d, FORTY).join(at.select("node").distinct(), "node").select("node", F.inline("paths"))
    return N.mode_convergence(found, at, people, FINE, BUDGET, SPEED)


@REGISTRY.add(
    "net_facility_distance",
    """WITH RECURSIVE walk AS (SELECT node AS facility, node, 0.0::DOUBLE AS t FROM facilities
       UNION SELECT facility, v, walk.t + m.t FROM walk JOIN minutes m ON m.u = walk.node WHERE walk.t + m.t <= 60) SELECT facility, node, min(t) AS t FROM walk GROUP BY ALL""",
    "minutes facilities",
    "t",
)
def _(spark, d):
    both = N.undirected(edges(spark, d), ["length", "frac"])
    one = N.weighted_edges(both, spark.createDataFrame([(0.0,)], "weight double"), SPEED).drop("weight")
    sources = facilities(spark, d).select(F.col("node").alias("facility"), "node")
    return N.relax(one, sources, ["facility"], most_cost=BUDGET).select("facility", "node", "t")




@REGISTRY.add("net_snap", f"SELECT point, b.node AS node, b.far AS connector FROM ({_SNAP})", "sections nodes", "connector")
def _(spark, d):
    return snapped(spark, d)


@REGISTRY.add(
    "net_connection_modes",
    f"""WITH {_RELAX}, p AS (SELECT point, s.t AS t, s.sun AS sun, b.far / 1.25 / 60 AS walk FROM ({_SNAP}) JOIN best ON best.node = b.node)
    SELECT point, mode, t + CASE mode WHEN 'network' THEN 0 ELSE walk END AS t, sun + CASE mode WHEN 'sun' THEN walk ELSE 0 END AS sun FROM p, (VALUES ('network'), ('sun'), ('shade')) m(mode)""",
    "sections nodes minutes facilities",
    "t sun",
)
def _(spark, d):
    return N.connection_modes(routes(spark, d, [0.0]), snapped(spark, d), SPEED)


@REGISTRY.add(
    "aud_claims",
    """SELECT item_id AS claim, count(d.doc_id) AS texts FROM benchmark b LEFT JOIN documents d ON contains(regexp_replace(d.text, '\\s', '', 'g'), regexp_replace(b.text, '\\s', '', 'g')) GROUP BY item_id""",
)
def _(spark, d):
    claims = read(spark, d, "benchmark").select(F.col("item_id").alias("claim"), F.col("text").alias("rendered"))
    return A.claims_in_texts(claims, read(spark, d, "documents"))


@REGISTRY.add(
    "aud_compared",
    """SELECT count(*) AS rows, count_if(a.k IS NULL OR b.k IS NULL)::BIGINT AS alone, count_if(abs(a.x - b.x) > 1e-9 + 1e-9 * abs(b.x))::BIGINT AS off_x
       FROM (SELECT o_custkey AS k, sum(o_totalprice) AS x FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, c_acctbal AS x FROM customer) b ON a.k = b.k""",
)
def _(spark, d):
    spent = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("x"))
    return A.compared(spent, read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x")), ["k"], ["x"])


@REGISTRY.add(
    "aud_key_checks",
    """SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS repeated, sum(b)::BIGINT AS bad_l_quantity, sum(g)::BIGINT AS negative_l_quantity FROM (
       SELECT count(*) AS n, count_if(l_quantity IS NULL OR isnan(l_quantity) OR isinf(l_quantity)) AS b, count_if(l_quantity < 0) AS g FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def _(spark, d):
    return A.key_checks(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity"])
