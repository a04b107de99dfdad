"""Queries q01-q31 over whole tables, each with its SQL twin. Findings are played by events, projects by orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaya import fixed_values as V
from assaya.functions import columns as C
from assaya.operators import analytics as A
from assaya.operators import evaluation as E
from assaya.operators import findings as O
from assaya.operators import text as T
from assaya.sources.scratch import spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


RULES = [("click", 0.066667), ("view", 0.1), ("purchase", 0.0), ("error", 0.166667)]
MAX_POINTS = 400.0
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST({w} AS DOUBLE))" for c, w in RULES) + ") AS r(ac_code, weight))"
F_SQL = "f AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
IMPACT_SQL = "CASE WHEN weight = 0 THEN 0.0 ELSE round(-weight * (k / 99.0::DOUBLE) * 400.0::DOUBLE, 4) + 0.0 END"


def found(spark: SparkSession, d: str) -> DataFrame:
    """Events as findings."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", k.alias("k")).withColumns({"finding_id": F.col("event_id"), "severity": F.col("k") / F.lit(99.0)})


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "ac_code string, severity_weight double")


@query(f"""WITH {RULES_SQL}, {F_SQL}
SELECT user_id, count(*) AS n_findings, count(weight) AS n_rated, round(CAST(400.0 + coalesce(sum({IMPACT_SQL}), 0) AS DECIMAL(24, 9)), 2)::DOUBLE AS doc_points
FROM f LEFT JOIN rules ON event_type = ac_code GROUP BY user_id""")
def q01_score_findings(spark, d):
    scored = O.score(found(spark, d), rules(spark), "event_type", F.lit(MAX_POINTS))
    return scored.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_findings"), F.count("severity_weight").alias("n_rated"), C.rounded(F.lit(MAX_POINTS) + F.coalesce(F.sum("impact"), F.lit(0.0)), 2).alias("doc_points"))


# Parts play rules and nations configurations: each rule for the configurations it fits.
@query("""WITH r AS (SELECT 'R' || p_partkey AS ac_code, CASE p_partkey % 3 WHEN 0 THEN 'content' WHEN 1 THEN 'grammar' ELSE 'asset' END AS analyser_id, CASE p_size % 3 WHEN 0 THEN 'ipp' WHEN 1 THEN 'ifj' END AS course, CASE p_size % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'cs' END AS language FROM part),
c AS (SELECT n_nationkey AS config_id, CASE n_nationkey % 2 WHEN 0 THEN 'content' ELSE 'grammar' END AS analyser_id, CASE n_nationkey % 3 WHEN 0 THEN 'ipp' WHEN 1 THEN 'ifj' END AS course, CASE n_nationkey % 5 WHEN 0 THEN 'en' ELSE 'cs' END AS language, 'R' || n_nationkey * 3 AS disabled FROM nation)
SELECT config_id, ac_code FROM r JOIN c ON r.analyser_id = c.analyser_id AND (r.course IS NULL OR r.course = c.course) AND (r.language IS NULL OR r.language = c.language) AND ac_code <> disabled""")
def q02_rule_select(spark, d):
    p, s, n = F.col("p_partkey"), F.col("p_size"), F.col("n_nationkey")
    r = table(spark, d, "part").select(
        F.concat(F.lit("R"), p.cast("string")).alias("ac_code"), F.when(p % 3 == 0, "content").when(p % 3 == 1, "grammar").otherwise("asset").alias("analyser_id"),
        F.when(s % 3 == 0, "ipp").when(s % 3 == 1, "ifj").alias("course"), F.when(s % 4 == 0, "en").when(s % 4 == 1, "cs").alias("language"),
    )
    c = table(spark, d, "nation").select(
        n.alias("config_id"), F.when(n % 2 == 0, "content").otherwise("grammar").alias("analyser_id"), F.when(n % 3 == 0, "ipp").when(n % 3 == 1, "ifj").alias("course"), F.when(n % 5 == 0, "en").otherwise("cs").alias("language"),
        F.array(F.concat(F.lit("R"), (n * 3).cast("string")), F.lit("none")).alias("disabled_codes"),
    )
    return O.select_rules(r, c).select("config_id", "ac_code")


_DECISION = "CASE event_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'adjusted' WHEN 2 THEN 'dismissed' ELSE NULL END"


@query(f"""WITH {F_SQL}, v AS (SELECT event_id, {_DECISION} AS decision, CASE WHEN event_id % 10 < 5 THEN 0.5 END AS s FROM f WHERE event_id % 5 < 3)
SELECT coalesce('judged_' || decision, 'to_be_judged') AS judge_status, count(*) AS n, round(sum(CASE WHEN decision = 'adjusted' THEN coalesce(s, k / 99.0::DOUBLE) ELSE k / 99.0::DOUBLE END), 3) AS severity
FROM f LEFT JOIN v USING (event_id) GROUP BY 1""")
def q03_judge_apply(spark, d):
    f = found(spark, d).withColumn("judge_status", F.lit("to_be_judged"))
    v = f.filter("event_id % 5 < 3").select("finding_id", F.expr(_DECISION).alias("decision"), F.expr("CASE WHEN event_id % 10 < 5 THEN 0.5D END").alias("adjusted_severity"), F.lit(2).alias("seq"))
    v = v.unionByName(v.withColumns({"decision": F.lit("dismissed"), "seq": F.lit(1)}))  # an earlier verdict, which doesn't count
    return O.apply_verdicts(f, v, "seq", "judge").groupBy("judge_status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("severity"), 3).alias("severity"))


@query("""WITH f AS (SELECT user_id, event_id, event_id % 7 AS s, 0 AS copy FROM events UNION ALL SELECT user_id, event_id, (event_id + 3) % 7, 1 FROM events WHERE event_id % 3 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY copy) AS pos FROM f WHERE s <> 0)
SELECT user_id, count(*) FILTER (WHERE pos = 1) AS n_final, count(*) FILTER (WHERE pos > 1) AS n_repeats, CAST(sum(CASE WHEN pos = 1 THEN copy ELSE 0 END) AS BIGINT) AS n_second FROM k GROUP BY user_id""")
def q04_rule_engine(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("finding_id"))
    f = e.withColumns({"copy": F.lit(0), "s": F.col("finding_id") % 7}).unionByName(e.filter("finding_id % 3 = 0").withColumns({"copy": F.lit(1), "s": (F.col("finding_id") + 3) % 7}))
    f = f.withColumn("judge_status", F.when(F.col("s") == 0, "judged_dismissed").otherwise("judged_approved"))
    kept = O.rule_engine(f, "user_id", "copy").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_final"), F.sum("copy").alias("n_second"))
    every = f.filter("judge_status <> 'judged_dismissed'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(every, "user_id").select("user_id", "n_final", (F.col("n") - F.col("n_final")).alias("n_repeats"), "n_second")


@query("SELECT event_id, upper(event_type) || '-' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS finding_no FROM events")
def q05_finding_ids(spark, d):
    return O.number_ids(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "finding_no")


@query("""SELECT o_custkey, min_by(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS first_priority, count(*) AS n_rows, count(DISTINCT o_orderstatus) AS n_status,
round(sum(CASE WHEN l_returnflag <> 'R' THEN l_discount END), 4) AS total_impact, bool_or(l_returnflag = 'R') AS any_shared
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def q06_project_rollup(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.withColumn("p", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    return rows.groupBy("o_custkey").agg(
        A.first_known("p", "o_orderkey").alias("first_priority"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_orderstatus").alias("n_status"),
        F.round(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_discount"))), 4).alias("total_impact"), F.bool_or(F.col("l_returnflag") == "R").alias("any_shared"),
    )


_DESC = "count(*) AS total, count({v}) AS n, round(avg(CASE WHEN {v} IS NULL THEN 1.0 ELSE 0.0 END), 4) AS pct_no_impact, round(avg({v}), 4) AS mean, round(quantile_cont({v}, 0.5), 4) AS median, round(stddev_samp({v}), 4) AS std, round(min({v})::DOUBLE, 4) AS lowest, round(max({v})::DOUBLE, 4) AS highest"


@query("WITH x AS (SELECT p_type, CASE WHEN l_returnflag <> 'R' THEN l_quantity * l_discount END AS v FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT p_type, " + _DESC.format(v="v") + " FROM x GROUP BY p_type")
def q07_code_impact_stats(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type")
    rows = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return A.describe(rows, ["p_type"], F.when(F.col("l_returnflag") != "R", F.col("l_quantity") * F.col("l_discount")))


@query("SELECT o_orderpriority, " + _DESC.format(v="o_totalprice") + " FROM orders GROUP BY 1")
def q08_format_summary(spark, d):
    return A.describe(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_totalprice"))


@query(f"""WITH {F_SQL}, t AS (SELECT event_type, CASE WHEN k % 10 = 0 THEN 'Warning' WHEN k % 10 > 7 THEN 'Bonus' ELSE 'Penalty' END AS t FROM f)
SELECT event_type, count(*) FILTER (WHERE t = 'Bonus') AS Bonus, count(*) FILTER (WHERE t = 'Penalty') AS Penalty, count(*) FILTER (WHERE t = 'Warning') AS Warning, count(*) AS total,
round(100.0 * count(*) FILTER (WHERE t = 'Warning') / count(*), 1) AS warning_pct FROM t GROUP BY 1""")
def q09_warning_pivot(spark, d):
    k = F.col("k") % 10
    kinds = ["Bonus", "Penalty", "Warning"]
    rows = found(spark, d).withColumn("t", C.impact_kind(F.when(k == 0, 0.0).when(k > 7, 1.0).otherwise(-1.0)))
    wide = rows.groupBy("event_type").pivot("t", kinds).count().fillna(0, kinds)
    wide = wide.withColumn("total", F.col("Bonus") + F.col("Penalty") + F.col("Warning"))
    return wide.withColumn("warning_pct", F.round(F.lit(100.0) * F.col("Warning") / F.col("total"), 1))


@query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_projects, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n_impacts FROM orders")
def q10_volume(spark, d):
    return table(spark, d, "orders").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_custkey").alias("n_projects"), F.min(F.year("o_orderdate")).cast("long").alias("first_year"),
        F.max(F.year("o_orderdate")).cast("long").alias("last_year"), F.count_if(F.col("o_orderstatus") != "P").alias("n_impacts"),
    )


_WEIGHTS = "SELECT p_type AS code, round(least(greatest(quantile_cont(abs(l_discount - 0.05), 0.5), 0), 1), 6) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type"


@query(_WEIGHTS)
def q11_weights_median(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    w = A.percentiles(rows.select(F.col("p_type").alias("code"), F.abs(F.col("l_discount") - 0.05).alias("v")), ["code"], F.col("v"), [0.5])
    return w.select("code", F.round(F.least(F.greatest(F.col("q")[0], F.lit(0.0)), F.lit(1.0)), 6).alias("weight"))


_NEAR = [("TINY", "SMALL"), ("TINY", "MEDIUM"), ("HUGE", "LARGE"), ("HUGE", "PROMO"), ("HUGE", "UNKNOWN"), ("NONE", "UNKNOWN")]


@query(f"WITH w AS ({_WEIGHTS}), m AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}','{b}')" for a, b in _NEAR) + ") AS m(code, near)) SELECT m.code, round(avg(weight), 6) AS weight FROM m JOIN w ON m.near = w.code GROUP BY m.code")
def q12_weight_inference(spark, d):
    near = spark.createDataFrame(_NEAR, "new_code string, near string")
    known = q11_weights_median(spark, d)
    return known.join(F.broadcast(near), F.col("near") == F.col("code")).groupBy("new_code").agg(F.round(F.avg("weight"), 6).alias("weight")).withColumnRenamed("new_code", "code")


UNIT_SQL = "(user_id * 24 + hour(ts))"


def user_hours(spark, d):
    """Events whose project is a user at an hour of the day, so that projects have some of the codes and not all."""
    return table(spark, d, "events").withColumn("unit", F.col("user_id") * 24 + F.hour("ts"))


def half_sets(spark, d):
    e = user_hours(spark, d).withColumn("first", F.dayofmonth("ts") <= 15)
    return E.compare_sets(e, "unit", "event_type", F.col("first"), ~F.col("first"))


_HALF = f"e AS (SELECT {UNIT_SQL} AS unit, event_type, bool_or(day(ts) <= 15) AS t, bool_or(day(ts) > 15) AS g FROM events GROUP BY 1, 2)"
_CODES = f"WITH {_HALF}, c AS (SELECT event_type AS code, CAST(sum(t::INT) AS BIGINT) AS n_tool, CAST(sum(g::INT) AS BIGINT) AS n_gold, CAST(sum((t AND g)::INT) AS BIGINT) AS n_agree FROM e GROUP BY 1), p AS (SELECT *, round(n_agree / nullif(n_tool, 0)::DOUBLE, 4) AS precision, round(n_agree / nullif(n_gold, 0)::DOUBLE, 4) AS recall FROM c), q AS (SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) END AS f1 FROM p) "


@query(_CODES + "SELECT * FROM q")
def q13_set_agreement(spark, d):
    return E.per_code(half_sets(spark, d))


@query(_CODES + "SELECT round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1, round(avg(coalesce(f1, 0)), 4) AS macro_f1_strict FROM q")
def q13_macro(spark, d):
    return E.macro(E.per_code(half_sets(spark, d)))


@query("""WITH s AS (SELECT event_type, 'raw' AS stage FROM events UNION ALL SELECT event_type, 'dismissed' FROM events WHERE event_id % 5 = 2 UNION ALL SELECT event_type, 'adjusted' FROM events WHERE event_id % 5 = 1 UNION ALL SELECT event_type, 'final' FROM events WHERE event_id % 5 <> 2)
SELECT event_type, count(*) FILTER (WHERE stage = 'raw') AS raw, count(*) FILTER (WHERE stage = 'dismissed') AS dismissed, count(*) FILTER (WHERE stage = 'adjusted') AS adjusted, count(*) FILTER (WHERE stage = 'final') AS final,
round(count(*) FILTER (WHERE stage = 'final') / nullif(count(*) FILTER (WHERE stage = 'raw'), 0)::DOUBLE, 4) AS survival FROM s GROUP BY 1""")
def q14_stage_survival(spark, d):
    r = F.col("event_id") % 5
    stages = F.array_compact(F.array(F.lit("raw"), F.when(r == 2, "dismissed"), F.when(r == 1, "adjusted"), F.when(r != 2, "final")))  # one scan, not four
    names = ["raw", "dismissed", "adjusted", "final"]
    wide = table(spark, d, "events").select("event_type", F.explode(stages).alias("stage")).groupBy("event_type").pivot("stage", names).count().fillna(0, names)
    return wide.withColumn("survival", F.round(F.try_divide("final", "raw"), 4))


@query("""SELECT o_orderstatus, nullif(round(sum(o_totalprice), 2), 0) AS total_cost, round(avg(o_totalprice), 4) AS mean_cost, round(avg(o_totalprice) * 600, 2) AS cost_600,
round(avg((o_orderkey % 7) / nullif(o_custkey % 5, 0)::DOUBLE), 6) AS mean_cache_hit_rate, round(3600 / avg(1 + o_custkey % 9), 4) AS docs_per_hour FROM orders GROUP BY 1""")
def q15_operational(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.nullif(F.round(F.sum("o_totalprice"), 2), F.lit(0.0)).alias("total_cost"), F.round(F.avg("o_totalprice"), 4).alias("mean_cost"), F.round(F.avg("o_totalprice") * 600, 2).alias("cost_600"),
        F.round(F.avg(F.try_divide(F.col("o_orderkey") % 7, F.col("o_custkey") % 5)), 6).alias("mean_cache_hit_rate"), F.round(F.try_divide(F.lit(3600.0), F.avg(1 + F.col("o_custkey") % 9)), 4).alias("docs_per_hour"),
    )


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*) AS n, round(corr(o_totalprice, s), 6) AS r FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY 1""")
def q16_score_correlation(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(A.safe_corr("o_totalprice", "s"), 6).alias("r"))


@query("""SELECT o_orderstatus, o_orderpriority, l_returnflag, count(*) AS n, round(avg(abs(l_discount - 0.05)), 6) AS mae FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (l_returnflag), ())""")
def q17_group_battery(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], [F.col("l_returnflag")], []]
    return rows.groupingSets(sets, "o_orderstatus", "o_orderpriority", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("l_discount") - 0.05)), 6).alias("mae"))


@query(f"""WITH {_HALF}, u AS (SELECT unit, unit % 10 AS grp, sum((t AND g)::INT) AS o, sum(t::INT) AS a, sum(g::INT) AS b FROM e GROUP BY 1)
SELECT grp, count(*) AS n, CAST(sum(o) AS BIGINT) AS n_overlap, CAST(sum(a) AS BIGINT) AS n_tool, CAST(sum(b) AS BIGINT) AS n_gold, round(sum(o) / nullif(sum(a), 0)::DOUBLE, 4) AS precision, round(sum(o) / nullif(sum(b), 0)::DOUBLE, 4) AS recall FROM u GROUP BY 1 HAVING count(*) >= 3""")
def q18_micro_quality(spark, d):
    return E.micro(half_sets(spark, d).withColumn("grp", F.col("unit") % 10), ["grp"], 3)


@query("""WITH x AS (SELECT l_suppkey, l_orderkey, l_returnflag, l_discount, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_discount) AS pos FROM lineitem WHERE l_returnflag = 'R')
SELECT l_suppkey, round(coalesce((SELECT sum(l_discount) FROM lineitem i WHERE i.l_suppkey = s.l_suppkey AND l_returnflag <> 'R'), 0) + coalesce((SELECT sum(l_discount) FROM x WHERE x.l_suppkey = s.l_suppkey AND pos = 1), 0), 4) AS impact FROM (SELECT DISTINCT l_suppkey FROM lineitem) s""")
def q19_shared_dedup_sum(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_returnflag", "l_discount", F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_discount").alias("o"))
    shared = F.col("l_returnflag") == "R"
    parts = rows.groupBy("l_suppkey", "l_orderkey").agg(F.sum(F.when(~shared, F.col("l_discount"))).alias("own"), F.min_by("l_discount", F.when(shared, F.col("o"))).alias("first"))
    return parts.groupBy("l_suppkey").agg(F.round(F.coalesce(F.sum("own"), F.lit(0.0)) + F.coalesce(F.sum("first"), F.lit(0.0)), 4).alias("impact"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def q20_bonus_semi(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def q21_dismissed_anti(spark, d):
    bad = table(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return table(spark, d, "customer").join(bad, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT user_id, event_type, count(*) AS calls, CASE WHEN count(*) FILTER (WHERE event_id % 97 = 0) = 0 THEN round(sum(value), 4) END AS cost FROM events GROUP BY 1, 2""")
def q22_usage_merge(spark, d):
    rows = table(spark, d, "events").withColumn("c", F.when(F.col("event_id") % 97 != 0, F.col("value")))
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(A.poisoned_sum("c"), 4).alias("cost"))


@query("SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(min(value), 4) AS lowest, round(max(value), 4) AS highest FROM events GROUP BY 1")
def q23_stage_timings(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("stage"))
    return g.agg(F.count(F.lit(1)).alias("calls"), *[F.round(f("value"), 4).alias(n) for f, n in ((F.sum, "total"), (F.avg, "mean"), (F.min, "lowest"), (F.max, "highest"))])


_MODELS = ["gpt-5.4-mini-2026", "gpt-5-mini", "GPT-5.4", "ft:gpt-4.1-x", "other"]


@query(f"""WITH p AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (n, a, b, c) in enumerate(V.MODEL_PRICES))}) AS p(rank, name, a, b, c)),
m AS (SELECT *, list_extract([{", ".join(f"'{x}'" for x in _MODELS)}], CAST(event_id % 5 AS INT) + 1) AS model, CAST(json_extract_string(props, '$.k') AS INT) * 100 AS prompt, event_id % 50 AS cached FROM events),
j AS (SELECT m.*, a, b, c, row_number() OVER (PARTITION BY event_id ORDER BY rank) AS pos FROM m LEFT JOIN p ON contains(lower(model), name))
SELECT model, count(*) AS calls, round(sum(round(((prompt - cached) * a + cached * b + (event_id % 300) * c) / 1e6 * 0.92, 6)), 4) AS cost_eur FROM j WHERE pos = 1 GROUP BY 1""")
def q24_token_cost(spark, d):
    names = F.array(*[F.lit(x) for x in _MODELS])
    m = found(spark, d).select("event_id", F.get(names, (F.col("event_id") % 5).cast("int")).alias("model"), (F.col("k") * 100).alias("prompt"), (F.col("event_id") % 50).alias("cached"))
    # Price lists have a few rows: the first that fits is picked for each model, not for each call.
    prices = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for n, a, b, c in V.MODEL_PRICES])
    rate = F.get(F.filter(prices, lambda p: F.contains(F.lower("model"), p["n"])), F.lit(0))
    m = m.withColumn("p", rate)
    cost = C.token_cost(F.col("prompt"), F.col("cached"), F.col("event_id") % 300, F.col("p.a"), F.col("p.b"), F.col("p.c"))
    return m.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(cost), 4).alias("cost_eur"))


@query(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[^\s]+')) AS words, length(text) AS chars, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS blocks FROM documents),
r AS (SELECT *, least(words / 486.0::DOUBLE, chars / 3422.0::DOUBLE, blocks / 7.0::DOUBLE) AS low FROM c)
SELECT doc_id, CAST(words AS BIGINT) AS words, CAST(chars AS BIGINT) AS chars, CAST(blocks AS BIGINT) AS blocks, CASE WHEN low < 0.5 THEN 0.9 WHEN low < 0.75 THEN 0.7 WHEN low < 1 THEN 0.5 END::DOUBLE AS short_severity FROM r""")
def q25_text_counters(spark, d):
    c = T.counters(table(spark, d, "documents"))
    return c.withColumn("short_severity", C.short_severity(F.col("words"), F.col("chars"), F.col("blocks")))


@query(r"""WITH w AS (SELECT source, unnest(list_filter(regexp_extract_all(lower(text), '\p{L}{3,}'), lambda x: NOT list_contains(['ale','atp','bez','být','jak','jen','není','nebo','např','pro','také','tak','ten'], x))) AS word FROM documents),
n AS (SELECT word, source, count(*) AS n FROM w GROUP BY 1, 2), t AS (SELECT word, sum(n) AS total FROM n GROUP BY 1 ORDER BY total DESC, word LIMIT 50),
s AS (SELECT word, source, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, source) AS pos FROM n JOIN t USING (word))
SELECT word, CAST(any_value(total) AS BIGINT) AS total, string_agg(source, ', ' ORDER BY pos) AS top_sources FROM s JOIN t USING (word) WHERE pos <= 3 GROUP BY word""")
def q26_keywords(spark, d):
    words = C.keyword_rows(spread(table(spark, d, "documents").select("source", "text")), ["source"], "text", "word")
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "word").limit(50)
    n = words.join(F.broadcast(top), "word").groupBy("word", "source", "total").agg(F.count(F.lit(1)).alias("n"))  # 50 rows are broadcast
    ranked = A.top_by(n, ["word"], [F.desc("n"), F.col("source")], 3)
    return ranked.groupBy("word", "total").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]), ", ").alias("top_sources"))


@query("SELECT lang, " + _DESC.format(v="length(text)") + " FROM documents GROUP BY 1")
def q27_comment_length(spark, d):
    return A.describe(table(spark, d, "documents"), ["lang"], F.length("text"))


@query("SELECT source, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source)::DOUBLE, 6) AS share FROM documents GROUP BY 1, 2")
def q28_language_dist(spark, d):
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query("""WITH c AS (SELECT *, role = 'user' AS h, length(text) % 3 AS lv FROM conversations), x AS (SELECT *, lead(h) OVER w AS nh, lead(lv) OVER w AS nl FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN nl IS NULL OR nl = lv THEN 0.8 WHEN nl > lv THEN 0.6 ELSE 0.9 END::DOUBLE AS severity FROM x WHERE h AND coalesce(nh, true)""")
def q29_consecutive_items(spark, d):
    return T.empty_sections(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", F.length("text") % 3).select("conv_id", "turn", "severity")


@query("""WITH o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations),
i AS (SELECT conv_id, unnest([7, 100, 1000]) AS off FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT i.conv_id, CAST(off AS BIGINT) AS off, coalesce(max(o.turn), min(f.turn)) AS turn FROM i LEFT JOIN o ON o.conv_id = i.conv_id AND off >= s AND off < s + length(text) JOIN (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY 1) f ON f.conv_id = i.conv_id GROUP BY 1, 2""")
def q30_section_offsets(spark, d):
    o = T.offsets(table(spark, d, "conversations"), "conv_id", "turn", "text")
    # An issue belongs to the item whose interval holds its offset, else to the first; both sides meet on the document.
    places = o.select("conv_id", "turn", F.explode(F.array(*[F.lit(x).cast("long") for x in (7, 100, 1000)])).alias("off"), "start", "end")
    inside = F.when((F.col("off") >= F.col("start")) & (F.col("off") < F.col("end")), F.col("turn"))
    return places.groupBy("conv_id", "off").agg(F.coalesce(F.max(inside), F.min("turn")).alias("turn"))


@query("""WITH l AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM l)
SELECT user_id, CAST(island AS BIGINT) AS island, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id FROM g GROUP BY 1, 2""")
def q31_code_islands(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1)
    marked = table(spark, d, "events").withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return marked.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
