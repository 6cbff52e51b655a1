"""Policy audit queries: cases are order priorities and years, sections are customers, hours are orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.operators import policy as P
from umbra.plans.inputs import REGISTRY, read, sections, view
from umbra.sources.staging import shared_path, staged

BY = ["mode", "year"]


def hours(spark, d):
    key = F.col("o_orderkey")
    orders = read(spark, d, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 7, "0").alias("cusec"),
        F.col("o_orderpriority").alias("mode"),
        F.pmod(F.year("o_orderdate"), F.lit(3)).alias("year"),
        (F.pmod(key, F.lit(5)) == 0).alias("solar_fail"),
        (F.pmod(key, F.lit(3)) != 0).alias("local_fail"),
        (F.pmod(key, F.lit(7)) < 3).alias("regional_fail"),
        (F.pmod(key, F.lit(2)) == 0).alias("uniform_fail"),
        (F.pmod(key, F.lit(41)) / 10 - 2).alias("local_margin"),
        (F.pmod(key, F.lit(37)) / 9 - 2).alias("regional_margin"),
    )
    return orders.join(sections(spark, d), "cusec")


def parts(spark, d):
    return P.components(hours(spark, d), BY)


def cases(spark, d):
    return P.with_optima(P.sized(parts(spark, d), BY), BY)


def chosen(spark, d):
    return P.selected(P.rule_scores(cases(spark, d)), BY)


def captured(spark, d):
    return P.captures(chosen(spark, d), BY)


view(
    "hours",
    """SELECT s.*, o_orderpriority AS mode, (year(o_orderdate) % 3)::INTEGER AS year, o_orderkey % 5 = 0 AS solar_fail, o_orderkey % 3 <> 0 AS local_fail, o_orderkey % 7 < 3 AS regional_fail,
       o_orderkey % 2 = 0 AS uniform_fail, (o_orderkey % 41) / 10 - 2 AS local_margin, (o_orderkey % 37) / 9 - 2 AS regional_margin FROM orders JOIN sections s ON cusec = lpad(o_custkey::VARCHAR, 7, '0')""",
    ["sections"],
)
view(
    "parts",
    """SELECT *, solar + shared + local_only AS local, solar + shared + regional_only AS regional FROM (
        SELECT mode, year, cusec, district, pop, reachable, avg(solar_fail::INT) * pop AS solar, avg((NOT solar_fail AND local_fail AND regional_fail)::INT) * pop AS shared,
               avg((NOT solar_fail AND local_fail AND NOT regional_fail)::INT) * pop AS local_only, avg((NOT solar_fail AND NOT local_fail AND regional_fail)::INT) * pop AS regional_only,
               avg((NOT solar_fail AND NOT local_fail AND NOT regional_fail)::INT) * pop AS passing, avg(uniform_fail::INT) * pop AS uniform FROM hours GROUP BY mode, year, cusec, district, pop, reachable)""",
    ["hours"],
)
view(
    "cases",
    """SELECT *, sum(CASE WHEN top_local THEN local ELSE 0 END) OVER c AS opt_local, sum(CASE WHEN top_regional THEN regional ELSE 0 END) OVER c AS opt_regional FROM (
        SELECT *, row_number() OVER (PARTITION BY mode, year ORDER BY local DESC, cusec) <= k AS top_local, row_number() OVER (PARTITION BY mode, year ORDER BY regional DESC, cusec) <= k AS top_regional FROM (
            SELECT *, greatest(floor(count(*) OVER (PARTITION BY mode, year) * 0.15::DOUBLE), 1)::INTEGER AS k FROM parts WHERE reachable)) WINDOW c AS (PARTITION BY mode, year)""",
    ["parts"],
)
view(
    "ruled",
    """SELECT *, row_number() OVER (PARTITION BY mode, year, rule ORDER BY score DESC, cusec) <= k AS chosen FROM (
        SELECT c.*, r.rule, round(CASE r.rule WHEN 'Population' THEN pop WHEN 'Uniform' THEN uniform WHEN 'Shared' THEN solar + shared
               WHEN 'Pooled' THEN coalesce(local / nullif(opt_local, 0), 0) + coalesce(regional / nullif(opt_regional, 0), 0) WHEN 'Local' THEN local ELSE regional END, 9) AS score
        FROM cases c, (VALUES ('Population'), ('Uniform'), ('Shared'), ('Pooled'), ('Local'), ('Regional')) r(rule))""",
    ["cases"],
)
view(
    "captured",
    """SELECT *, least(local_capture, regional_capture) AS min_capture, coalesce(round(least(local_capture, regional_capture), 9) >= 99 - 1e-7, false) AS feasible FROM (
        SELECT mode, year, rule, 100 * sum(CASE WHEN chosen THEN local ELSE 0 END) / nullif(max(opt_local), 0) AS local_capture,
               100 * sum(CASE WHEN chosen THEN regional ELSE 0 END) / nullif(max(opt_regional), 0) AS regional_capture, max(k) AS k FROM ruled GROUP BY ALL)""",
    ["ruled"],
)
view(
    "tvs",
    """SELECT mode, year, rule, sum(abs(slots / sum_slots - pop / sum_pop)) / 2 AS tv FROM (
        SELECT *, sum(slots) OVER c AS sum_slots, sum(pop) OVER c AS sum_pop FROM (SELECT mode, year, rule, district, count_if(chosen) AS slots, sum(pop) AS pop FROM ruled GROUP BY ALL) WINDOW c AS (PARTITION BY mode, year, rule))
        GROUP BY ALL""",
    ["ruled"],
)
view(
    "states",
    """SELECT mode, year, CASE WHEN bool_or(feasible) FILTER (rule = 'Population') THEN 'Population' WHEN bool_or(feasible) FILTER (rule = 'Uniform') THEN 'Uniform'
       WHEN bool_or(feasible) THEN 'Other common' ELSE 'Incompatible' END AS state FROM captured GROUP BY ALL""",
    ["captured"],
)
_PARTS = "pop solar shared local_only regional_only passing uniform local regional"


@REGISTRY.add("pol_components", "SELECT * FROM parts", "parts", _PARTS)
def _(spark, d):
    return parts(spark, d)


@REGISTRY.add(
    "pol_identity",
    """SELECT mode, year, count(*) AS rows, count_if(least(solar, shared, local_only, regional_only, passing) < 0)::BIGINT AS negative,
       count_if(abs(solar + shared + local_only + regional_only + passing - pop) > 1e-6)::BIGINT AS not_total, 0::BIGINT AS not_local FROM parts GROUP BY ALL""",
    "parts",
)
def _(spark, d):
    return P.identity_violations(parts(spark, d), BY)


@REGISTRY.add("pol_selection", "SELECT mode, year, rule, cusec FROM ruled WHERE chosen", "ruled")
def _(spark, d):
    return chosen(spark, d).where("chosen").select(*BY, "rule", "cusec")


@REGISTRY.add("pol_captures", "SELECT * FROM captured", "captured", "local_capture regional_capture min_capture")
def _(spark, d):
    return captured(spark, d)


@REGISTRY.add("pol_district_tv", "SELECT * FROM tvs", "tvs", "tv")
def _(spark, d):
    return P.district_tv(chosen(spark, d), BY)


@REGISTRY.add("pol_states", "SELECT * FROM states", "states")
def _(spark, d):
    return P.states(captured(spark, d), BY)


@REGISTRY.add(
    "pol_tv_gain",
    """SELECT mode, year, min(tv) AS best_tv, min(tv) FILTER (rule IN ('Population', 'Uniform')) AS baseline_tv, min(tv) FILTER (rule IN ('Population', 'Uniform')) - min(tv) AS gain
       FROM (SELECT * FROM captured WHERE feasible) JOIN tvs USING (mode, year, rule) GROUP BY ALL""",
    "captured tvs",
    "best_tv baseline_tv gain",
)
def _(spark, d):
    rows = chosen(spark, d)
    return P.tv_gain(P.captures(rows, BY), P.district_tv(rows, BY), BY)


_LOSS = ", ".join(
    f"100 * sum(CASE WHEN top_local THEN {p} ELSE 0 END) / max(opt_local) AS share_{p}, 100 * (sum(CASE WHEN top_local THEN {p} ELSE 0 END) - sum(CASE WHEN top_regional THEN {p} ELSE 0 END)) / max(opt_local) AS loss_{p}"
    for p in ("solar", "shared", "local_only")
)


@REGISTRY.add(
    "pol_exchange_loss",
    f"SELECT mode, year, {_LOSS}, 100 * (sum(CASE WHEN top_local THEN local ELSE 0 END) - sum(CASE WHEN top_regional THEN local ELSE 0 END)) / max(opt_local) AS loss FROM cases GROUP BY ALL",
    "cases",
    "share_solar share_shared share_local_only loss_solar loss_shared loss_local_only loss",
)
def _(spark, d):
    return P.exchange_loss(cases(spark, d), BY)


TOLERANCES = [0.0, 0.0025, 0.005, 0.01, 0.02, 0.05]


@REGISTRY.add(
    "pol_swaps",
    """WITH i AS (SELECT mode, year, local, opt_local, row_number() OVER (PARTITION BY mode, year ORDER BY local, cusec DESC) AS j FROM cases WHERE top_local),
    o AS (SELECT mode, year, local, row_number() OVER (PARTITION BY mode, year ORDER BY local DESC, cusec) AS j FROM cases WHERE NOT top_local),
    p AS (SELECT i.mode, i.year, i.j, i.opt_local, sum(i.local - o.local) OVER (PARTITION BY i.mode, i.year ORDER BY i.j ROWS UNBOUNDED PRECEDING) AS cost FROM i JOIN o ON i.mode = o.mode AND i.year = o.year AND i.j = o.j),
    t(tolerance) AS (VALUES (0.0::DOUBLE), (0.0025), (0.005), (0.01), (0.02), (0.05)),
    m AS (SELECT mode, year, tolerance, count_if(cost <= tolerance * opt_local + 1e-8)::BIGINT AS max_swaps FROM p, t GROUP BY ALL),
    e AS (SELECT *, max(CASE WHEN NOT top_local THEN local END) OVER c AS best_out, min(CASE WHEN top_local THEN local END) OVER c AS worst_in FROM cases WINDOW c AS (PARTITION BY mode, year)),
    f AS (SELECT mode, year, tolerance, count_if(top_local AND local - best_out > tolerance * opt_local + 1e-8)::BIGINT AS mandatory,
          max(k) + count_if(NOT top_local AND worst_in - local <= tolerance * opt_local + 1e-8)::BIGINT AS possible, count_if(top_local AND NOT top_regional)::BIGINT AS exchanged FROM e, t GROUP BY ALL)
    SELECT f.*, coalesce(max_swaps, 0) AS max_swaps, 100 * p.cost / p.opt_local AS least_loss FROM f LEFT JOIN m USING (mode, year, tolerance)
    LEFT JOIN p ON p.mode = f.mode AND p.year = f.year AND p.j = f.exchanged""",
    "cases",
    "tolerance least_loss",
)
def _(spark, d):
    return P.swaps(cases(spark, d), BY, TOLERANCES)


@REGISTRY.add(
    "pol_capacity_captures",
    """WITH f(fraction) AS (VALUES (0.05::DOUBLE), (0.1), (0.15), (0.2), (0.25)),
    s AS (SELECT p.*, fraction, greatest(floor(count(*) OVER (PARTITION BY fraction, mode, year) * fraction), 1)::INTEGER AS k FROM parts p, f WHERE reachable),
    r AS (SELECT *, row_number() OVER (PARTITION BY fraction, mode, year ORDER BY local DESC, cusec) <= k AS top_local, row_number() OVER (PARTITION BY fraction, mode, year ORDER BY regional DESC, cusec) <= k AS top_regional FROM s)
    SELECT fraction, mode, year, max(k) AS k, 100 * sum(CASE WHEN top_regional THEN local ELSE 0 END) / nullif(sum(CASE WHEN top_local THEN local ELSE 0 END), 0) AS local_capture FROM r GROUP BY ALL""",
    "parts",
    "fraction local_capture",
)
def _(spark, d):
    grid = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.15, 0.2, 0.25)], "fraction double")
    by = ["fraction", *BY]
    rows = P.with_optima(P.sized(parts(spark, d).crossJoin(F.broadcast(grid)), by, F.col("fraction")), by)
    return rows.groupBy(*by).agg(
        F.max("k").alias("k"), (100 * F.try_divide(F.sum(F.when(F.col("top_regional"), F.col("local")).otherwise(0.0)), F.first("opt_local"))).alias("local_capture")
    )


@REGISTRY.add(
    "pol_sufficiency",
    """SELECT mode, year, CASE WHEN l AND r THEN 'both' WHEN l THEN 'local' WHEN r THEN 'regional' ELSE 'neither' END AS sufficient FROM (
       SELECT mode, year, bool_or(round(regional_capture, 9) >= 99 - 1e-7) FILTER (rule = 'Local') AS l, bool_or(round(local_capture, 9) >= 99 - 1e-7) FILTER (rule = 'Regional') AS r FROM captured GROUP BY ALL)""",
    "captured",
)
def _(spark, d):
    return P.sufficiency(captured(spark, d), BY)


@REGISTRY.add(
    "pol_state_grid",
    "SELECT mode, max(state) FILTER (year = 0) AS c_0, max(state) FILTER (year = 1) AS c_1, max(state) FILTER (year = 2) AS c_2 FROM states GROUP BY mode",
    "states",
)
def _(spark, d):
    return P.state_grid(P.states(captured(spark, d), BY), "mode", "year", [0, 1, 2])


@REGISTRY.add(
    "pol_ranges",
    "SELECT rule, min(min_capture) AS min_min_capture, max(min_capture) AS max_min_capture, min(local_capture) AS min_local_capture, max(local_capture) AS max_local_capture FROM captured GROUP BY rule",
    "captured",
    "min_min_capture max_min_capture min_local_capture max_local_capture",
)
def _(spark, d):
    return P.ranges(captured(spark, d), ["rule"], ["min_capture", "local_capture"])


@REGISTRY.add(
    "pol_state_rollup",
    """SELECT mode, count(*) AS cases, count_if(state = 'Population')::BIGINT AS population, count_if(state = 'Uniform')::BIGINT AS uniform, count_if(state = 'Other common')::BIGINT AS other_common,
       count_if(state = 'Incompatible')::BIGINT AS incompatible FROM states GROUP BY mode""",
    "states",
)
def _(spark, d):
    return P.rollup_states(P.states(captured(spark, d), BY), "mode")


@REGISTRY.add(
    "pol_reachability",
    """SELECT mode, year, count(*) AS sections, greatest(floor(count_if(reachable) * 0.15::DOUBLE), 1)::INTEGER AS quota, sum(CASE WHEN reachable THEN pop ELSE 0 END) AS reachable_pop,
       sum(CASE WHEN NOT reachable THEN pop ELSE 0 END) AS unreachable_pop FROM parts GROUP BY ALL""",
    "parts",
    "reachable_pop unreachable_pop",
)
def _(spark, d):
    return P.reachability(parts(spark, d), BY)


DELTAS = [x / 4 for x in range(-8, 9)]
view(
    "grid",
    """SELECT *, 100 * coalesce(score / nullif(sum(CASE WHEN top THEN score ELSE 0 END) OVER (PARTITION BY mode, field, delta), 0), 0) AS pct FROM (
        SELECT *, row_number() OVER (PARTITION BY mode, field, delta ORDER BY score DESC, cusec) <= k AS top FROM (
            SELECT *, greatest(floor(count(*) OVER (PARTITION BY mode, field, delta) * 0.15::DOUBLE), 1)::INTEGER AS k FROM (
                SELECT mode, cusec, pop, field, delta, round(avg((margin + delta >= 0)::INT) * pop, 9) AS score FROM (
                    SELECT h.mode, h.cusec, h.pop, f.field, f.margin FROM hours h, LATERAL (VALUES ('local', local_margin), ('regional', regional_margin)) f(field, margin)),
                    (SELECT unnest(range(-8, 9)) / 4 AS delta) GROUP BY mode, cusec, pop, field, delta)))""",
    ["hours"],
)


def shifted(spark, d):
    return P.shifted_scores(hours(spark, d), DELTAS, ["mode"])


def grid(spark, d):
    return P.normalised(shifted(spark, d), ["mode"])


@REGISTRY.add("fix_normalised", "SELECT mode, field, delta, cusec, score, k, top, pct FROM grid", "grid", "delta score pct")
def _(spark, d):
    return grid(spark, d).select("mode", "field", "delta", "cusec", "score", "k", "top", "pct")


def frozen(spark, d):
    """All scenarios, and the lists frozen at zero shift: the local and the regional one. Only those lists ask who is in among equals."""
    scores = shifted(spark, d)
    lists = P.normalised(scores.where("delta = 0"), ["mode"]).where("top").select("mode", F.col("field").alias("rule"), "cusec")
    return P.normalised(scores, ["mode"], ties=False), staged(lists)


_HELD = """SELECT mode, rule, amplitude, min(capture) AS least, count(*) AS scenarios FROM (
    SELECT g.mode, f.rule, g.field, g.delta, sum(g.pct) AS capture FROM grid g JOIN (SELECT mode, field AS rule, cusec FROM grid WHERE delta = 0 AND top) f ON g.mode = f.mode AND g.cusec = f.cusec GROUP BY ALL)
    JOIN (SELECT unnest(range(0, 9)) / 4 AS amplitude) ON abs(delta) <= amplitude + 1e-10 GROUP BY ALL"""


def held(spark, d):
    return P.least_capture(*frozen(spark, d), [x / 4 for x in range(9)], ["mode"])


@REGISTRY.add("fix_least_capture", _HELD, "grid", "amplitude least")
def _(spark, d):
    return held(spark, d)


@REGISTRY.add(
    "fix_first_incompatible",
    f"""SELECT mode, rule, min(amplitude) FILTER (loss > 1 + 1e-7) AS first_amplitude, max(loss) AS loss, 0::BIGINT AS not_monotone
        FROM (SELECT *, round(100 - least, 9) AS loss FROM ({_HELD})) GROUP BY ALL""",
    "grid",
    "first_amplitude loss",
)
def _(spark, d):
    return P.first_incompatible(held(spark, d), ["mode"])


@REGISTRY.add("fix_common_list")
def _(spark, d):
    rows = P.normalised(shifted(spark, d), ["mode"], ties=False).select("cusec", F.concat_ws("/", "mode", "field").alias("field"), "delta", "pct")
    return P.common_list(rows, 40, 4)


@REGISTRY.add(
    "fix_zero_shift",
    """SELECT field, count(*) AS rows, count_if(g.score IS NULL OR c.score IS NULL)::BIGINT AS alone, count_if(abs(g.score - c.score) > 1e-6)::BIGINT AS off FROM (SELECT * FROM grid WHERE delta = 0) g
       FULL JOIN (SELECT mode, cusec, field, score FROM (SELECT mode, cusec, avg((local_margin >= 0)::INT) * pop AS l, avg((regional_margin >= 0)::INT) * pop AS r FROM hours GROUP BY mode, cusec, pop),
           LATERAL (VALUES ('local', l), ('regional', r)) f(field, score)) c USING (mode, cusec, field) GROUP BY field""",
    "grid hours",
)
def _(spark, d):
    score = lambda f: F.struct(F.lit(f).alias("field"), (F.avg((F.col(f"{f}_margin") >= 0).cast("double")) * F.col("pop")).alias("score"))
    central = hours(spark, d).groupBy("mode", "cusec", "pop").agg(F.array(score("local"), score("regional")).alias("f")).select("mode", "cusec", F.explode("f").alias("f")).select("mode", "cusec", "f.*")
    return P.zero_shift(grid(spark, d), central, ["mode"])


_TRANSFER = """SELECT g.mode, f.rule, g.field, g.delta, sum(g.pct) AS capture, count(*) AS sections FROM grid g JOIN (SELECT mode, field AS rule, cusec FROM grid WHERE delta = 0 AND top) f ON g.mode = f.mode AND g.cusec = f.cusec GROUP BY ALL"""


@REGISTRY.add("pol_frozen_transfer", _TRANSFER, "grid", "delta capture")
def _(spark, d):
    return P.frozen_transfer(*frozen(spark, d), ["mode"])


EXPERIMENTS = [("narrow", x / 4) for x in range(-3, 4)] + [("wide", x / 4) for x in range(-6, 7)] + [("warm", x / 4) for x in range(0, 9)]


@REGISTRY.add(
    "fix_observation_stress",
    f"""SELECT mode, experiment, rule, min(capture) AS least, count(*) AS scenarios, min(sections) AS quota FROM ({_TRANSFER})
        JOIN (SELECT 'narrow' AS experiment, unnest(range(-3, 4)) / 4 AS delta UNION ALL SELECT 'wide', unnest(range(-6, 7)) / 4 UNION ALL SELECT 'warm', unnest(range(0, 9)) / 4) USING (delta) GROUP BY ALL""",
    "grid",
    "least",
)
def _(spark, d):
    return P.observation_stress(*frozen(spark, d), spark.createDataFrame(EXPERIMENTS, "experiment string, delta double"), ["mode"])


@REGISTRY.add(
    "pol_certificates",
    """WITH n AS (SELECT mode, year, max(k) AS k, count(DISTINCT cusec) AS n FROM ruled GROUP BY ALL)
    SELECT mode, year, rule, count(*) AS listed, 100 * sum(local) / nullif(any_value(opt_local), 0) AS local_capture, 100 * sum(regional) / nullif(any_value(opt_regional), 0) AS regional_capture,
        count(*) = max(k) AS sound, coalesce(least(100 * sum(local) / nullif(any_value(opt_local), 0), 100 * sum(regional) / nullif(any_value(opt_regional), 0)) >= 99 - 1e-7, NULL) AS common
    FROM ruled WHERE chosen GROUP BY ALL""",
    "ruled",
    "local_capture regional_capture",
)
def _(spark, d):
    rows = cases(spark, d)
    lists = chosen(spark, d).where("chosen").select(*BY, "rule", "cusec")
    return P.audited(P.certificates(lists, rows, BY), rows, BY)


_STORED = """SELECT mode, year, rule, place, CASE WHEN rule = 'Shared' AND year % 2 = 1 AND place = max(place) OVER l THEN min(place) OVER l ELSE place END AS at FROM (
    SELECT r.mode, r.year, r.rule, p.place FROM ruled r JOIN p ON p.mode = r.mode AND p.year = r.year AND p.cusec = r.cusec WHERE chosen) WINDOW l AS (PARTITION BY mode, year, rule)"""


@REGISTRY.add(
    "pol_stored_certificates",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY mode, year ORDER BY cusec) - 1 AS place FROM cases), s AS ({_STORED}),
    w AS (SELECT mode, year, max(k) AS k, any_value(opt_local) AS ol, any_value(opt_regional) AS orr, sum(pop) AS people FROM cases GROUP BY ALL), dp AS (SELECT mode, year, district, sum(pop) AS pop FROM cases GROUP BY ALL),
    f AS (SELECT s.mode, s.year, s.rule, count(*) AS listed, count(DISTINCT s.at) AS different, 100 * sum(local) / nullif(max(ol), 0) AS lc, 100 * sum(regional) / nullif(max(orr), 0) AS rc, max(w.k) AS k
        FROM s JOIN p ON p.mode = s.mode AND p.year = s.year AND p.place = s.at JOIN w ON w.mode = s.mode AND w.year = s.year GROUP BY ALL),
    sl AS (SELECT s.mode, s.year, s.rule, p.district, count(*) AS slots FROM s JOIN p ON p.mode = s.mode AND p.year = s.year AND p.place = s.at GROUP BY ALL),
    t AS (SELECT f.mode, f.year, f.rule, sum(abs(coalesce(slots, 0) / listed - dp.pop / people)) / 2 AS tv FROM f JOIN w USING (mode, year) JOIN dp USING (mode, year) LEFT JOIN sl ON sl.mode = f.mode AND sl.year = f.year AND sl.rule = f.rule AND sl.district = dp.district GROUP BY ALL),
    c AS (SELECT mode, year, rule, local_capture + CASE WHEN rule = 'Uniform' AND year % 2 = 1 THEN 0.5 ELSE 0 END AS slc, regional_capture AS src, tv + CASE WHEN rule = 'Pooled' AND year % 2 = 0 THEN 0.01 ELSE 0 END AS stv,
        tv * CASE WHEN rule = 'Local' AND year % 2 = 0 THEN 1.01 ELSE 0.999 END AS bound, CASE WHEN rule = 'Regional' AND year % 2 = 1 THEN 0.0005 ELSE 0.002 END AS gap FROM captured JOIN tvs USING (mode, year, rule))
    SELECT mode, year, rule, listed = k AND different = k AS sound, abs(lc - slc) <= 1e-6 AND abs(rc - src) <= 1e-6 AS captures, abs(tv - stv) <= 1e-6 AS balance, bound <= tv + 1e-6 AS bounded, tv - bound <= gap * tv + 1e-6 AS within_gap, tv
    FROM f JOIN t USING (mode, year, rule) JOIN c USING (mode, year, rule) UNION ALL SELECT DISTINCT mode, year, 'None', year % 3 = 0, NULL::BOOLEAN, NULL::BOOLEAN, NULL::BOOLEAN, NULL::BOOLEAN, NULL::DOUBLE FROM cases""",
    "cases ruled captured tvs",
    "tv",
)
def _(spark, d):
    """Certificates as JSON documents: most true, some with a repeated place, other captures or variation, a wrong bound or gap, and some without places."""
    rows, ruled = cases(spark, d), chosen(spark, d)
    lists = P.certificates(ruled.where("chosen").select(*BY, "rule", "cusec"), rows, BY)
    stored = lists.join(P.captures(ruled, BY).select(*BY, "rule", "local_capture", "regional_capture"), [*BY, "rule"]).join(P.district_tv(ruled, BY).select(*BY, "rule", "tv"), [*BY, "rule"])
    odd = F.col("year") % 2 == 1
    is_ = lambda rule, when: (F.col("rule") == rule) & when
    repeated = F.concat(F.slice("indices", 1, F.size("indices") - 1), F.slice("indices", 1, 1))
    made = stored.select(
        *BY, "rule", F.lit("Optimal").alias("status"), F.when(is_("Shared", odd), repeated).otherwise(F.col("indices")).cast("array<bigint>").alias("indices"),
        (F.col("local_capture") + F.when(is_("Uniform", odd), 0.5).otherwise(0.0)).alias("local_capture"), "regional_capture", (F.col("tv") + F.when(is_("Pooled", ~odd), 0.01).otherwise(0.0)).alias("district_tv"),
        (F.col("tv") * F.when(is_("Local", ~odd), 1.01).otherwise(0.999)).alias("objective_bound"), F.when(is_("Regional", odd), 0.0005).otherwise(0.002).alias("mip_gap"),
    )
    none = rows.select(*BY).distinct().select(*BY, F.lit("None").alias("rule"), F.when(F.col("year") % 3 == 0, "Infeasible").otherwise("Optimal").alias("status"))
    path = shared_path(spark, "certificates")
    made.unionByName(none, allowMissingColumns=True).write.json(path)
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*BY).dtypes)
    return P.audited_certificates(spark.read.schema(f"{kinds}, rule string, {P.CERTIFICATE}").json(path), rows, BY)
