"""Shelter queries: sites are suppliers, sections customers; distance is straight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from umbra.functions.joins import dealt
from umbra.operators import decisions as D
from umbra.operators import shelters as S
from umbra.plans.inputs import REGISTRY, sections, stations, view
from umbra.sources.staging import staged

MOVEMENTS = [("m1", 2000.0), ("m2", 3500.0)]
#: The greedy lists also have a case for each of three speeds (m/s) and three durations (minutes).
WALKS = [(f"{speed}_{minutes}", speed * 60 * minutes + 1e-9) for speed in (0.6, 0.9, 1.2) for minutes in (10, 15, 20)]
FRACTIONS = [0.25, 0.5, 1.0]
HOURS = [9.0, 14.0, 16.0, 18.0, 20.0]


def sites(spark, d):
    key = F.col("station")
    first = F.struct((8 + F.pmod(key, F.lit(3))).cast("double").alias("start"), (13 + F.pmod(key, F.lit(2))).cast("double").alias("end"))
    second = F.struct(F.lit(15.0).alias("start"), (17 + F.pmod(key, F.lit(5))).cast("double").alias("end"))
    return stations(spark, d).select(
        key.alias("site"), "x", "y", (F.pmod(key, F.lit(4)) > 0).alias("announced"), F.when(F.pmod(key, F.lit(6)) > 0, F.array(first, second)).otherwise(F.array(first)).alias("intervals")
    )


def places(spark, d):
    """Reachable sections by place, as those at one place reach the same sites: one of them, how many there are and their people."""
    homes = sections(spark, d).where("reachable").dropDuplicates(["cusec", "pop"])
    return homes.groupBy("x", "y").agg(F.min("cusec").alias("cusec"), F.count("*").alias("n"), F.sum("pop").alias("pop"), F.min("district").alias("district"))


def spots(spark, d):
    """(site, spot): the least site at the same place."""
    rows = sites(spark, d).select("site", "x", "y")
    return rows.join(rows.groupBy("x", "y").agg(F.min("site").alias("spot")), ["x", "y"]).select("site", "spot")


def reach(spark, d, homes=None, rows=None):
    """All pairs of sections, or of ``homes``, and sites, or ``rows`` of them, within the widest movement: equal cells of a quarter of that size and their neighbours meet.

    Both sides are small beside their pairs, so they are dealt to a number of parts that does not depend on their bytes.
    """
    size = MOVEMENTS[-1][1]
    cell = lambda c: F.floor(F.col(c) / (size / 4))
    near = F.sequence(F.lit(-4), F.lit(4))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (sites(spark, d) if rows is None else rows).select("site", F.col("x").alias("sx"), F.col("y").alias("sy"))
    rows = rows.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumn("cx", cell("sx") + F.col("dx")).withColumn("cy", cell("sy") + F.col("dy"))
    homes = (sections(spark, d).where("reachable") if homes is None else homes).withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    far = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    kept = ["pop", "district", *(c for c in homes.columns if c == "n")]
    pairs = homes.repartition(parts, "cx", "cy").join(dealt(rows.repartition(parts, "cx", "cy")), ["cx", "cy"])
    return pairs.select("cusec", "site", far.alias("dist_m"), *kept).where(F.col("dist_m") <= size)


def place_reach(spark, d, homes=None):
    """Pairs of places and spots: all that coverage depends on."""
    firsts = sites(spark, d).groupBy("x", "y").agg(F.min("site").alias("site"))
    return reach(spark, d, places(spark, d) if homes is None else homes, firsts)


def movements(spark):
    return spark.createDataFrame(MOVEMENTS, "movement string, metres double")


def times(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "moment double")


view(
    "sites",
    """SELECT station AS site, x, y, station % 4 > 0 AS announced, CASE WHEN station % 6 > 0 THEN [{'a': 8.0::DOUBLE + station % 3, 'b': 13.0::DOUBLE + station % 2}, {'a': 15.0::DOUBLE, 'b': 17.0::DOUBLE + station % 5}]
       ELSE [{'a': 8.0::DOUBLE + station % 3, 'b': 13.0::DOUBLE + station % 2}] END AS iv FROM stations""",
    ["stations"],
)
view(
    "reach",
    "SELECT cusec, site, sqrt(power(c.x - s.x, 2) + power(c.y - s.y, 2)) AS dist_m, pop, district FROM sections c, sites s WHERE reachable AND sqrt(power(c.x - s.x, 2) + power(c.y - s.y, 2)) <= 3500",
    ["sections", "sites"],
)
view(
    "policies",
    """SELECT site, announced, policy, CASE policy WHEN 'ordinary' THEN iv WHEN 'geographic' THEN [{'a': 0.0::DOUBLE, 'b': 24.0::DOUBLE}] ELSE CASE WHEN NOT announced THEN iv ELSE list_concat(ext, CASE policy WHEN 'continuous' THEN [{'a': 16.0::DOUBLE, 'b': 21.0::DOUBLE}] ELSE [] END) END END AS hours
       FROM (SELECT *, list_concat(iv[:-2], [{'a': iv[-1].a, 'b': greatest(iv[-1].b, 21.0::DOUBLE)}]) AS ext FROM sites), (VALUES ('ordinary'), ('event'), ('continuous'), ('geographic')) p(policy)""",
    ["sites"],
)
_OPEN = "len(list_filter(hours, lambda h: h.a <= moment AND moment < h.b AND moment + {stay} <= h.b)) > 0"
_TIMES = "(SELECT unnest([9.0, 14.0, 16.0, 18.0, 20.0])::DOUBLE AS moment)"
_CATALOGUE = """(SELECT site, 'all' AS catalogue FROM sites UNION ALL SELECT site, 'announced' FROM sites WHERE announced UNION ALL SELECT site, 'even' FROM sites WHERE site % 2 = 0
    UNION ALL SELECT site, 'core' FROM sites WHERE site % 5 <> 0 UNION ALL SELECT site, 'morning' FROM sites WHERE iv[1].a <= 9)"""
_COVER = """SELECT movement, catalogue, policy, moment, count(*) AS sections, sum(pop) AS people FROM (
    SELECT DISTINCT movement, catalogue, policy, moment, cusec, pop FROM reach JOIN (VALUES ('m1', 2000.0), ('m2', 3500.0)) m(movement, metres) ON dist_m <= metres
    JOIN (SELECT site, policy, moment FROM policies, {times} WHERE {open}) USING (site) JOIN {catalogue} USING (site)) GROUP BY ALL"""


@REGISTRY.add("she_open_at", f"SELECT site, policy, moment FROM policies, {_TIMES} WHERE {_OPEN.format(stay=0)}", "policies", "moment")
def _(spark, d):
    return S.opened_at(S.policy_intervals(sites(spark, d)), times(spark, HOURS))


@REGISTRY.add(
    "she_extension_cost",
    """SELECT site, 0.25::DOUBLE * count_if(len(list_filter(ext, lambda h: h.a <= moment AND moment < h.b)) > 0 AND len(list_filter(iv, lambda h: h.a <= moment AND moment < h.b)) = 0) AS cost FROM (
        SELECT site, iv, list_concat(iv[:-2], [{'a': iv[-1].a, 'b': greatest(iv[-1].b, 21.0::DOUBLE)}]) AS ext FROM sites), (SELECT 8 + unnest(range(52)) / 4 AS moment) GROUP BY site""",
    "sites",
    "cost",
)
def _(spark, d):
    return S.extension_cost(sites(spark, d))


@REGISTRY.add("she_catalogue", f"SELECT catalogue, count(*) AS sites FROM {_CATALOGUE} GROUP BY catalogue", "sites")
def _(spark, d):
    return S.catalogue(sites(spark, d)).groupBy("catalogue").agg(F.count("*").alias("sites"))


@REGISTRY.add("she_reach", "SELECT cusec, site, dist_m FROM reach", "reach", "dist_m")
def _(spark, d):
    """Pairs of places, each with the lists of what is there, are unfolded last: sections and sites are not shuffled for every cell that they reach."""
    homes = sections(spark, d).where("reachable").groupBy("x", "y").agg(F.collect_list("cusec").alias("cusec"), F.sum("pop").alias("pop"), F.min("district").alias("district"))
    rows = sites(spark, d).groupBy("x", "y").agg(F.collect_list("site").alias("site"))
    pairs = reach(spark, d, homes, rows).select("cusec", F.explode("site").alias("site"), "dist_m")
    return pairs.select(F.explode("cusec").alias("cusec"), "site", "dist_m")


def covered(spark, d, moment, stay=0.0, homes=None):
    rows = sites(spark, d)
    return S.union_coverage(place_reach(spark, d, homes), S.opened_at(S.policy_intervals(rows), moment, stay), S.catalogue(rows), movements(spark), spots(spark, d))


@REGISTRY.add("she_union_coverage", _COVER.format(times=_TIMES, open=_OPEN.format(stay=0), catalogue=_CATALOGUE), "reach policies", "moment people")
def _(spark, d):
    return covered(spark, d, times(spark, HOURS))


_MIDDLE = "(SELECT 16.125::DOUBLE + unnest(range(20)) / 4 AS moment)"


@REGISTRY.add(
    "she_person_hours",
    f"SELECT movement, catalogue, policy, 0.25 * sum(people) AS person_hours FROM ({_COVER.format(times=_MIDDLE, open=_OPEN.format(stay=0), catalogue=_CATALOGUE)}) GROUP BY ALL",
    "reach policies",
    "person_hours",
)
def _(spark, d):
    return S.person_hours(covered(spark, d, S.time_grid(sites(spark, d), 16, 21, middle=True)))


@REGISTRY.add(
    "she_person_hours_stay",
    f"SELECT movement, catalogue, policy, 0.25 * sum(people) AS person_hours FROM ({_COVER.format(times=_MIDDLE, open=_OPEN.format(stay=0.5), catalogue=_CATALOGUE)}) GROUP BY ALL",
    "reach policies",
    "person_hours",
)
def _(spark, d):
    return S.person_hours(covered(spark, d, S.time_grid(sites(spark, d), 16, 21, middle=True), 0.5))


@REGISTRY.add("she_monotone", "SELECT movement, 0::BIGINT AS violations FROM (VALUES ('m1')) v(movement) WHERE (SELECT count(*) FROM supplier) < 0")
def _(spark, d):
    return S.not_monotone(covered(spark, d, times(spark, HOURS)))


_PATTERNS = """SELECT movement, pattern, sum(pop) AS weight FROM (
    SELECT movement, cusec, moment, pop, bool_or(len(list_filter(iv, lambda h: h.a <= moment AND moment < h.b)) > 0) AS covered, list_sort(list(site) FILTER (iv[-1].a <= moment AND moment < greatest(21.0, iv[-1].b))) AS pattern
    FROM reach JOIN (VALUES ('m1', 2000.0), ('m2', 3500.0)) m(movement, metres) ON dist_m <= metres JOIN sites USING (site), (SELECT unnest([16.0, 17.0, 18.0, 19.0, 20.0])::DOUBLE AS moment) GROUP BY movement, cusec, moment, pop)
    WHERE NOT covered AND len(pattern) > 0 GROUP BY movement, pattern"""


def patterns(spark, d, cases=None):
    """Sections at one place reach the same sites, so their people are taken together."""
    cases = movements(spark) if cases is None else cases
    return S.demand_patterns(reach(spark, d, places(spark, d)), sites(spark, d).drop("x", "y"), cases, times(spark, [16, 17, 18, 19, 20]))


@REGISTRY.add("she_demand_patterns", f"SELECT movement, array_to_string(pattern, ',') AS pattern, weight FROM ({_PATTERNS})", "reach", "weight")
def _(spark, d):
    return patterns(spark, d).withColumn("pattern", F.array_join(F.transform("pattern", lambda s: s.cast("string")), ","))


@REGISTRY.add(
    "she_announced_gain",
    f"SELECT movement, sum(CASE WHEN len(list_intersect(pattern, (SELECT list(site) FROM sites WHERE announced))) > 0 THEN weight ELSE 0 END) AS gain FROM ({_PATTERNS}) GROUP BY movement",
    "reach",
    "gain",
)
def _(spark, d):
    chosen = sites(spark, d).where("announced").select("site").crossJoin(F.broadcast(movements(spark).select("movement")))
    return S.gain(patterns(spark, d), chosen)


def greedy_cases(spark, d):
    """The patterns of all movement cases; budgets are fractions of what the announced extensions cost."""
    cases = spark.createDataFrame([*MOVEMENTS, *WALKS], "movement string, metres double")
    costs = S.extension_cost(rows := sites(spark, d))
    whole = costs.join(rows.where("announced").select("site"), "site").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("whole"))
    fractions = spark.createDataFrame([(f,) for f in FRACTIONS], "fraction double")
    budgets = cases.select("movement").crossJoin(fractions).crossJoin(whole)
    return staged(patterns(spark, d, cases)), costs, budgets.select("movement", "fraction", (F.col("fraction") * F.col("whole")).alias("budget"))


@REGISTRY.add("she_greedy")
def _(spark, d):
    return S.greedy(*greedy_cases(spark, d))


@REGISTRY.add("she_transfer")
def _(spark, d):
    found, costs, budgets = greedy_cases(spark, d)
    return S.transfer(found, S.greedy(found, costs, budgets.where("fraction = 1").drop("fraction")), "m1")


@REGISTRY.add("she_least_hours")
def _(spark, d):
    return S.least_hours(S.greedy(*greedy_cases(spark, d)), ["movement", "fraction"])


_ALL_CASES = ", ".join(f"('{m}', {metres!r}::DOUBLE)" for m, metres in [*MOVEMENTS, *WALKS])


@REGISTRY.add(
    "she_worst_capture",
    f"""SELECT rule, min(100 * gain / whole) AS worst, count(*) AS cases FROM (
        SELECT rule, movement, sum(CASE WHEN len(list_intersect(pattern, chosen)) > 0 THEN weight ELSE 0 END) AS gain, sum(weight) AS whole FROM ({_PATTERNS.replace("('m1', 2000.0), ('m2', 3500.0)", _ALL_CASES)}),
        (SELECT 'announced' AS rule, list(site) AS chosen FROM sites WHERE announced UNION ALL SELECT 'even', list(site) FROM sites WHERE site % 2 = 0) GROUP BY rule, movement) GROUP BY rule""",
    "reach",
    "worst",
)
def _(spark, d):
    """Two common lists over all movement cases."""
    cases = spark.createDataFrame([*MOVEMENTS, *WALKS], "movement string, metres double")
    each = F.explode(F.array_compact(F.array(F.when(F.col("announced"), F.lit("announced")), F.when(F.pmod("site", F.lit(2)) == 0, F.lit("even")))))
    return S.worst_capture(patterns(spark, d, cases), sites(spark, d).select("site", each.alias("rule")))


@REGISTRY.add("she_robust_programme")
def _(spark, d):
    """One programme for all movement cases at a quarter of the announced hours, against what each case could gain in all."""
    found, costs, budgets = greedy_cases(spark, d)
    references = found.groupBy("movement").agg(F.sum("weight").alias("reference"))
    budget = budgets.where("fraction = 0.25").agg(F.max("budget")).first()[0]
    return S.robust_programme(found, costs, references, budget)


_LATER = "[{'a': 9.5::DOUBLE, 'b': 14.0::DOUBLE}, {'a': 16.5::DOUBLE, 'b': 21.0::DOUBLE}]"


def _variant_sql(name: str, catalogue: str, stay: float = 0.0, reach_: str = "reach", hours: str = "hours") -> str:
    cover = f"""SELECT movement, policy, moment, sum(pop) AS people FROM (SELECT DISTINCT movement, policy, moment, cusec, pop FROM {reach_} JOIN (VALUES ('m1', 2000.0), ('m2', 3500.0)) m(movement, metres) ON dist_m <= metres
        JOIN (SELECT site, policy, moment FROM (SELECT site, policy, {hours} AS hours FROM policies WHERE policy IN ('ordinary', 'event')), {_MIDDLE} WHERE {_OPEN.format(stay=stay)}) USING (site)
        JOIN {_CATALOGUE} USING (site) WHERE catalogue = '{catalogue}') GROUP BY ALL"""
    return f"""SELECT '{name}' AS variant, movement, coalesce(0.25 * sum(people) FILTER (policy = 'ordinary'), 0) AS ordinary, coalesce(0.25 * sum(people) FILTER (policy = 'event'), 0) AS announced,
        coalesce(0.25 * sum(people) FILTER (policy = 'event'), 0) - coalesce(0.25 * sum(people) FILTER (policy = 'ordinary'), 0) AS gain FROM ({cover}) GROUP BY movement"""


_INTERIOR = "(SELECT cusec, site, dist_m + 25.0 AS dist_m, pop FROM reach)"
_VARIANTS = [
    _variant_sql("primary", "all"), _variant_sql("alternative hours", "all", hours=f"CASE WHEN site % 10 = 3 THEN {_LATER} ELSE hours END"), _variant_sql("other origins", "all", reach_=_INTERIOR),
    _variant_sql("stay of half an hour", "all", stay=0.5), _variant_sql("core", "core"), _variant_sql("announced only", "announced"),
]


@REGISTRY.add("she_variants", " UNION ALL ".join(_VARIANTS), "reach policies", "ordinary announced gain")
def _(spark, d):
    """What other hours, origins, stays and catalogues do to ordinary and announced person-hours."""
    rows, near, moments = sites(spark, d), place_reach(spark, d), S.time_grid(sites(spark, d), 16, 21, middle=True)
    fixed = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    later = rows.withColumn("intervals", F.when(F.pmod("site", F.lit(10)) == 3, F.array(fixed(9.5, 14.0), fixed(16.5, 21.0))).otherwise(F.col("intervals")))
    every = S.catalogue(rows)
    cases = [
        ("primary", near, rows, "all", 0.0), ("alternative hours", near, later, "all", 0.0), ("other origins", near.withColumn("dist_m", F.col("dist_m") + 25.0), rows, "all", 0.0),
        ("stay of half an hour", near, rows, "all", 0.5), ("core", near, rows, "core", 0.0), ("announced only", near, rows, "announced", 0.0),
    ]
    out = [S.variant_hours(n, r, every.where(F.col("catalogue") == c), movements(spark), moments, stay, spots=spots(spark, d)).select(F.lit(name).alias("variant"), "movement", "ordinary", "announced", "gain") for name, n, r, c, stay in cases]
    return reduce(lambda a, b: a.unionByName(b), out)


@REGISTRY.add(
    "she_archived_audit",
    f"SELECT count(*) AS rows, 0::BIGINT AS missing, 0.0::DOUBLE AS largest_error FROM ({_COVER.format(times=_TIMES, open=_OPEN.format(stay=0), catalogue=_CATALOGUE)})",
    "reach policies",
)
def _(spark, d):
    keys = ["movement", "catalogue", "policy", "moment"]
    homes = staged(places(spark, d).withColumn("pop", F.col("pop").cast("decimal(24,6)")))  # sums of decimals do not depend on the order
    table = covered(spark, d, times(spark, HOURS), homes=homes)
    rows = sites(spark, d)
    recount = S.nearest_coverage(homes, rows, S.opened_at(S.policy_intervals(rows), times(spark, HOURS)), S.catalogue(rows), movements(spark), MOVEMENTS[-1][1])
    return S.archived_audit(*[x.select(*keys, F.col("people").cast("double").alias("people")) for x in (recount, table)], keys, "people")


# walks to the nearest site


def nearest_by_layer(spark, d):
    rows, homes = sites(spark, d), sections(spark, d).where("reachable")
    spots = S.catalogue(rows).withColumnRenamed("catalogue", "layer").join(rows.select("site", "x", "y"), "site")
    near = S.nearest_places(homes, spots, "layer", 250.0, MOVEMENTS[-1][1])
    return homes.join(near, ["x", "y"]).groupBy("layer", "cusec", "pop").agg(F.min("dist_m").alias("dist_m"))


_NEAREST = f"SELECT layer, cusec, pop, min(dist_m) AS dist_m FROM reach JOIN (SELECT site, catalogue AS layer FROM {_CATALOGUE}) USING (site) GROUP BY ALL"


@REGISTRY.add(
    "dec_walking_grid",
    f"""SELECT speed, minutes, threshold, count(*) AS sections, sum(pop) AS people, avg(walk) AS mean_walk, 100 * sum(CASE WHEN walk > threshold THEN pop ELSE 0 END) / nullif(sum(pop), 0) AS long_pct FROM (
        SELECT *, dist_m / speed / 60 AS walk FROM ({_NEAREST}), (SELECT unnest([0.6, 0.9, 1.2])::DOUBLE AS speed), (SELECT unnest([20.0, 30.0, 40.0])::DOUBLE AS minutes), (SELECT unnest([5.0, 10.0, 15.0])::DOUBLE AS threshold) WHERE layer = 'all')
        WHERE walk <= minutes GROUP BY ALL HAVING count(*) >= 30""",
    "reach",
    "speed minutes threshold people mean_walk long_pct",
)
def _(spark, d):
    cases = spark.createDataFrame([(v, m, t) for v in (0.6, 0.9, 1.2) for m in (20.0, 30.0, 40.0) for t in (5.0, 10.0, 15.0)], "speed double, minutes double, threshold double")
    return D.walking_grid(nearest_by_layer(spark, d).where("layer = 'all'").select("cusec", "pop", "dist_m"), cases)


@REGISTRY.add(
    "dec_layer_comparison",
    f"""WITH n AS ({_NEAREST}), e AS (SELECT layer, count_if(dist_m <= 2000)::BIGINT AS reached, quantile_cont(dist_m, 0.5) AS median_m, quantile_cont(dist_m, 0.9) AS p90_m FROM n GROUP BY layer),
    s AS (SELECT cusec, list(layer) AS layers, any_value(pop) AS pop FROM n WHERE dist_m <= 2000 GROUP BY cusec)
    SELECT x.layer AS a, y.layer AS other, count_if(list_contains(layers, x.layer) AND list_contains(layers, y.layer)) / nullif(count_if(list_contains(layers, x.layer) OR list_contains(layers, y.layer)), 0) AS jaccard,
        count_if(list_contains(layers, x.layer) <> list_contains(layers, y.layer))::BIGINT AS changed, sum(CASE WHEN list_contains(layers, x.layer) <> list_contains(layers, y.layer) THEN pop ELSE 0 END) AS changed_people,
        x.reached AS reached_a, x.median_m AS median_m_a, x.p90_m AS p90_m_a, y.reached AS reached_other, y.median_m AS median_m_other, y.p90_m AS p90_m_other
    FROM e x JOIN e y ON x.layer < y.layer CROSS JOIN s GROUP BY ALL""",
    "reach",
    "jaccard changed_people median_m_a p90_m_a median_m_other p90_m_other",
)
def _(spark, d):
    return D.layer_comparison(nearest_by_layer(spark, d), 2000.0)


@REGISTRY.add(
    "dec_layer_priorities",
    f"""WITH n AS ({_NEAREST}), l AS (SELECT layer, n.cusec, row_number() OVER (PARTITION BY layer ORDER BY round(s.pop * (s.x + 1) / 20001, 9) DESC, n.cusec) <= greatest(floor(count(*) OVER (PARTITION BY layer) * 0.2::DOUBLE), 1) AS f FROM n JOIN sections s ON s.cusec = n.cusec WHERE dist_m <= 2000),
    z AS (SELECT layer, count(*) AS size FROM l WHERE f GROUP BY layer), s AS (SELECT cusec, list(layer) AS layers FROM l WHERE f GROUP BY cusec)
    SELECT x.layer AS a, y.layer AS other, x.size AS size_a, y.size AS size_other, count_if(list_contains(layers, x.layer) AND list_contains(layers, y.layer)) / nullif(count_if(list_contains(layers, x.layer) OR list_contains(layers, y.layer)), 0) AS jaccard
    FROM z x JOIN z y ON x.layer < y.layer CROSS JOIN s GROUP BY ALL""",
    "reach sections",
    "jaccard",
)
def _(spark, d):
    loads = sections(spark, d).select("cusec", F.round(F.col("pop") * (F.col("x") + 1) / 20001, 9).alias("load"))
    return D.layer_priorities(nearest_by_layer(spark, d), loads, 2000.0)
