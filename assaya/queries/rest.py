"""Queries q64-q99 over whole tables, each with its SQL twin: rule overrides, audits, points, timings, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaya import fixed_values as V
from assaya.functions import columns as C
from assaya.operators import analytics as A
from assaya.operators import findings as O
from assaya.operators import rules as U
from assaya.queries.core import _CODES, _DECISION, F_SQL, IMPACT_SQL, RULES_SQL, UNIT_SQL, found, q13_set_agreement, query, rules, table, user_hours


def count():
    return F.count(F.lit(1))


# Known maxima by year and variant (J1, F3, F19, SRC6, R1).
_MAXIMA = V.MAX_DOC_POINTS


@query(f"""WITH m AS (SELECT * FROM (VALUES {", ".join(f"({y}, '{v}', {p})" for y, v, p in _MAXIMA)}) AS m(year, variant, points)),
o AS (SELECT year(o_orderdate) + 22 AS year, CASE o_orderkey % 3 WHEN 0 THEN 'php' WHEN 1 THEN 'py' ELSE 'int' END AS variant, o_totalprice FROM orders)
SELECT CAST(o.year AS INT) AS year, o.variant, count(*) AS n, count(points) AS n_known, round(avg(o_totalprice / points * 100), 3) AS pct FROM o LEFT JOIN m ON o.year = m.year AND o.variant = m.variant GROUP BY 1, 2""")
def q64_known_maximum(spark, d):
    k = F.col("o_orderkey") % 3
    o = table(spark, d, "orders").select((F.year("o_orderdate") + 22).alias("year"), F.when(k == 0, "php").when(k == 1, "py").otherwise("int").alias("variant"), "o_totalprice")
    m = F.broadcast(spark.createDataFrame(_MAXIMA, "year int, variant string, points int"))  # one row for each year and variant
    return o.join(m, ["year", "variant"], "left").groupBy("year", "variant").agg(count().alias("n"), F.count("points").alias("n_known"), F.round(F.avg(C.score_pct(F.col("o_totalprice"), F.col("points"))), 3).alias("pct"))


# Parts play rules that fit a configuration: what single analysers make of them.
_FIT_SQL = "f AS (SELECT p_size AS config_id, CASE p_size % 3 WHEN 0 THEN 'content' WHEN 1 THEN 'grammar' ELSE 'integrity' END AS analyser, CASE p_size % 4 WHEN 0 THEN 'cs' WHEN 1 THEN 'sk' ELSE 'en' END AS language, CASE p_size % 5 WHEN 0 THEN 'llm' ELSE 'local' END AS engine, list_extract(['CH', 'STYLE', 'SPELLING', 'COPY', 'GRAMMAR'], CAST(p_partkey % 5 AS INT) + 1) AS ac_code FROM part WHERE p_partkey % 7 > 2)"


@query(f"""WITH {_FIT_SQL}, u AS (SELECT config_id, ac_code FROM f WHERE analyser = 'content' AND (language IN ('cs', 'sk') OR ac_code NOT IN ('CH', 'GRAMMAR', 'SPELLING'))
UNION ALL SELECT config_id, ac_code FROM f WHERE analyser = 'grammar' AND language = 'en' AND (ac_code IN ('GRAMMAR', 'SPELLING') OR ac_code = 'CH' AND config_id NOT IN (SELECT config_id FROM f WHERE ac_code IN ('GRAMMAR', 'SPELLING')))
UNION ALL SELECT config_id, ac_code FROM f WHERE analyser = 'integrity' AND (ac_code <> 'COPY' OR engine <> 'local')) SELECT config_id, ac_code, count(*) AS n FROM u GROUP BY 1, 2""")
def q65_rule_overrides(spark, d):
    s = F.col("p_size")
    f = table(spark, d, "part").filter("p_partkey % 7 > 2").select(
        s.alias("config_id"), F.when(s % 3 == 0, "content").when(s % 3 == 1, "grammar").otherwise("integrity").alias("analyser"), F.when(s % 4 == 0, "cs").when(s % 4 == 1, "sk").otherwise("en").alias("language"), F.when(s % 5 == 0, "llm").otherwise("local").alias("engine"),
        F.get(F.array(*[F.lit(x) for x in ("CH", "STYLE", "SPELLING", "COPY", "GRAMMAR")]), (F.col("p_partkey") % 5).cast("int")).alias("ac_code"),
    )
    of = lambda name: f.filter(F.col("analyser") == name)
    every = [U.content_rules(of("content")), U.grammar_rules(of("grammar"), "config_id"), U.integrity_rules(of("integrity"), F.col("engine"))]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("config_id", "ac_code").agg(count().alias("n"))


@query("""SELECT CASE WHEN p_size % 5 = 0 THEN 'classifier' WHEN p_size % 2 = 1 AND p_size % 3 = 0 THEN 'skipped' WHEN p_size % 2 = 1 THEN 'pages' ELSE 'diagrams' END AS route, count(*) AS n FROM part GROUP BY 1""")
def q66_backend_route(spark, d):
    p = F.col("p_size")
    route = U.backend_route(F.when(p % 5 == 0, "classifier").otherwise("vision"), p % 2 == 1, p % 3)
    return table(spark, d, "part").groupBy(route.alias("route")).agg(count().alias("n"))


@query(f"WITH {RULES_SQL}, {F_SQL} SELECT event_id, event_type FROM f WHERE event_type IN (SELECT ac_code FROM rules)")
def q67_known_codes(spark, d):
    return U.known_codes(found(spark, d), rules(spark), "event_type").select("event_id", "event_type")


@query(f"""WITH {F_SQL} SELECT CASE WHEN k % 4 = 0 THEN 'not_to_be_judged' ELSE 'to_be_judged' END AS judge_status, count(*) AS n FROM f GROUP BY 1""")
def q68_judge_batch(spark, d):
    held = F.when(F.col("k") % 4 > 0, F.array(F.lit(1)))
    none = F.lit(None).cast("array<int>")
    f = found(spark, d).withColumns({"anchors": held, "stats": none, "model_evals": none, "judge_status": F.lit("to_be_judged")})
    return O.judge_batch(f).groupBy("judge_status").agg(count().alias("n"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE trim(text) <> '') AS n_present, round(avg(CASE WHEN trim(text) <> '' THEN 1.0 ELSE 0.0 END), 6) AS share FROM documents GROUP BY 1""")
def q69_comment_presence(spark, d):
    has = F.coalesce(F.trim("text") != "", F.lit(False))
    return table(spark, d, "documents").groupBy("source").agg(count().alias("n"), F.count_if(has).alias("n_present"), F.round(F.avg(has.cast("double")), 6).alias("share"))


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1), x AS (SELECT o_orderpriority AS variant, o_orderstatus = 'P' AS bonus, s - o_totalprice AS delta, (s - o_totalprice) / nullif(o_totalprice, 0) * 100 AS pct FROM orders JOIN l ON o_orderkey = l_orderkey)
SELECT variant, bonus, count(delta) AS n, round(avg(delta), 2) AS mean_delta, round(avg(abs(delta)), 2) AS mae, round(avg(pct), 2) AS mean_delta_pct, round(avg(abs(pct)), 2) AS mae_pct FROM x GROUP BY 1, 2""")
def q70_point_stats(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    x = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("delta", F.col("s") - F.col("o_totalprice")).withColumn("pct", F.try_divide("delta", "o_totalprice") * 100)
    r = lambda c, n: F.round(F.avg(c), 2).alias(n)
    return x.groupBy(F.col("o_orderpriority").alias("variant"), (F.col("o_orderstatus") == "P").alias("bonus")).agg(F.count("delta").alias("n"), r("delta", "mean_delta"), r(F.abs("delta"), "mae"), r("pct", "mean_delta_pct"), r(F.abs("pct"), "mae_pct"))


@query(f"""WITH {RULES_SQL}, {F_SQL}, s AS (SELECT user_id, event_type, {IMPACT_SQL} AS impact FROM f LEFT JOIN rules ON event_type = ac_code WHERE event_id % 5 <> 2)
SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS codes, round(sum(impact), 4) AS total, round(400.0 + coalesce(sum(impact), 0), 4) AS estimate FROM s GROUP BY 1""")
def q71_tool_totals(spark, d):
    s = O.score(found(spark, d).withColumn("judge_status", F.expr(_DECISION)).filter("judge_status IS NULL OR judge_status <> 'dismissed'"), rules(spark), "event_type", F.lit(400.0))
    return s.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("codes"), F.round(F.sum("impact"), 4).alias("total"), F.round(F.lit(400.0) + F.coalesce(F.sum("impact"), F.lit(0.0)), 4).alias("estimate"))


@query("""SELECT CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END::INT AS mode_order, l_shipmode AS mode, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(quantile_cont(l_quantity, 0.5), 4) AS median, round(quantile_cont(l_quantity, 0.95), 4) AS p95
FROM (SELECT *, l_linestatus || l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1, 2""")
def q72_parse_timing(spark, d):
    x = table(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("mode_order"), F.concat("l_linestatus", "l_returnflag").alias("mode"), "l_quantity")
    return A.timing_stats(x, ["mode_order", "mode"], "l_quantity", {"median": 0.5, "p95": 0.95})


@query(f"""WITH s AS (SELECT {_DECISION} AS status, user_id FROM events)
SELECT count(*) AS n_raw, count(DISTINCT user_id) AS n_docs, count(*) FILTER (WHERE status = 'approved') AS n_approved, count(*) FILTER (WHERE status = 'adjusted') AS n_adjusted, count(*) FILTER (WHERE status = 'dismissed') AS n_dismissed, count(*) FILTER (WHERE status IS NULL) AS n_waiting, count(*) FILTER (WHERE status IS DISTINCT FROM 'dismissed') AS n_final FROM s""")
def q73_run_counts(spark, d):
    s = table(spark, d, "events").select("user_id", F.expr(_DECISION).alias("status"))
    of = lambda x: F.count_if(F.col("status") == x)
    return s.agg(count().alias("n_raw"), F.countDistinct("user_id").alias("n_docs"), of("approved").alias("n_approved"), of("adjusted").alias("n_adjusted"), of("dismissed").alias("n_dismissed"), F.count_if(F.col("status").isNull()).alias("n_waiting"), F.count_if(~F.col("status").eqNullSafe(F.lit("dismissed"))).alias("n_final"))


@query("""WITH x AS (SELECT event_type AS variant, user_id % 3 AS model, CAST(json_extract_string(props, '$.k') AS INT) AS prompt, event_id % 50 AS completion FROM events)
SELECT variant, model, round(avg(prompt), 4) AS mean_prompt, round(avg(completion), 4) AS mean_completion, round(avg(prompt + completion), 4) AS mean_total FROM x GROUP BY GROUPING SETS ((variant), (model))""")
def q74_token_means(spark, d):
    x = found(spark, d).select(F.col("event_type").alias("variant"), (F.col("user_id") % 3).alias("model"), "k", (F.col("event_id") % 50).alias("c"))
    r = lambda c, n: F.round(F.avg(c), 4).alias(n)
    return x.groupingSets([[F.col("variant")], [F.col("model")]], "variant", "model").agg(r("k", "mean_prompt"), r("c", "mean_completion"), r(F.col("k") + F.col("c"), "mean_total"))


@query("""WITH a AS (SELECT p_partkey, (p_size * 97 + 50)::DOUBLE AS w, (p_partkey % 40 * 83 + 60)::DOUBLE AS h FROM part),
b AS (SELECT p_partkey, CASE WHEN greatest(w, h) > 2048 THEN trunc(w * (2048.0::DOUBLE / greatest(w, h))) ELSE w END AS w, CASE WHEN greatest(w, h) > 2048 THEN trunc(h * (2048.0::DOUBLE / greatest(w, h))) ELSE h END AS h FROM a),
c AS (SELECT p_partkey, CASE WHEN least(w, h) > 768 THEN trunc(w * (768.0::DOUBLE / least(w, h))) ELSE w END AS w, CASE WHEN least(w, h) > 768 THEN trunc(h * (768.0::DOUBLE / least(w, h))) ELSE h END AS h FROM b)
SELECT p_partkey, CAST(ceil(w / 512) * ceil(h / 512) * 170 + 85 AS BIGINT) AS tokens FROM c""")
def q75_image_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", C.image_tokens(F.col("p_size") * 97 + 50, F.col("p_partkey") % 40 * 83 + 60).cast("long").alias("tokens"))


# Gold students and tool outputs: the alias "par" takes the output of par, any other that of int.
@query("""WITH o AS (SELECT o_custkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'par' ELSE 'int' END AS variant, count(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT c_custkey, unnest(['par', 'gold']) AS alias FROM customer)
SELECT alias, count(*) AS n_students, count(o.n) AS n_matched, count(*) FILTER (WHERE o.n IS NULL) AS n_skipped, CAST(coalesce(sum(o.n), 0) AS BIGINT) AS n_outputs FROM g LEFT JOIN o ON c_custkey = o_custkey AND variant = CASE WHEN alias = 'par' THEN 'par' ELSE 'int' END GROUP BY 1""")
def q76_gold_match(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey", F.when(F.col("o_orderpriority").startswith("1"), "par").otherwise("int").alias("variant")).agg(count().alias("n"))
    g = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.lit("par"), F.lit("gold"))).alias("alias")).withColumn("wanted", F.when(F.col("alias") == "par", "par").otherwise("int"))
    x = g.join(o, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("wanted") == F.col("variant")), "left")
    return x.groupBy("alias").agg(count().alias("n_students"), F.count("n").alias("n_matched"), F.count_if(F.col("n").isNull()).alias("n_skipped"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_outputs"))


# Batch results to identifiers to the manifest; counters of the audit.
@query("""WITH r AS (SELECT l_orderkey * 3 AS id, CASE l_returnflag WHEN 'R' THEN 'it is BADUML' WHEN 'A' THEN 'GOODUML' ELSE 'none' END AS said FROM lineitem),
x AS (SELECT said, o_orderkey, c_custkey FROM r LEFT JOIN orders ON id = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey)
SELECT CASE WHEN contains(said, 'BADUML') THEN 'BADUML' WHEN contains(said, 'GOODUML') THEN 'GOODUML' ELSE 'UNKNOWN' END AS label, count(*) AS n, count(c_custkey) AS n_resolved, count(*) FILTER (WHERE c_custkey IS NULL) AS n_unresolved FROM x GROUP BY 1""")
def q77_audit_join(spark, d):
    said = F.when(F.col("l_returnflag") == "R", "it is BADUML").when(F.col("l_returnflag") == "A", "GOODUML").otherwise("none")
    r = table(spark, d, "lineitem").select((F.col("l_orderkey") * 3).alias("id"), C.classifier_label(said).alias("label"))
    ids = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey")
    x = r.join(ids, F.col("id") == F.col("o_orderkey"), "left")
    return x.groupBy("label").agg(count().alias("n"), F.count("c_custkey").alias("n_resolved"), F.count_if(F.col("c_custkey").isNull()).alias("n_unresolved"))


# Chunks that hold a sentence which was copied too.
@query("""SELECT l_suppkey, count(*) AS n_confirmed FROM lineitem l WHERE l_discount > 0.05 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority IN ('1-URGENT', '2-HIGH')) GROUP BY 1""")
def q78_corroboration(spark, d):
    hard = table(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").filter("l_discount > 0.05").join(hard, "l_orderkey", "left_semi").groupBy("l_suppkey").agg(count().alias("n_confirmed"))


# References to items, and snippets kept only where an item holds them.
@query("""WITH f AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN left(text, 12) ELSE 'not in it' END AS snippet, turn + 1 AS ref FROM conversations)
SELECT f.conv_id, f.turn, i.turn IS NOT NULL AS resolved, CASE WHEN contains(i.text, f.snippet) THEN f.snippet ELSE i.text END AS evidence FROM f LEFT JOIN conversations i ON i.conv_id = f.conv_id AND i.turn = f.ref""")
def q79_resolve_refs(spark, d):
    c = table(spark, d, "conversations")
    f = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.substring("text", 1, 12)).otherwise("not in it").alias("snippet"), (F.col("turn") + 1).alias("ref"))
    i = c.select("conv_id", F.col("turn").alias("ref"), F.col("text").alias("item"), F.lit(True).alias("there"))
    return f.join(i, ["conv_id", "ref"], "left").select("conv_id", "turn", F.coalesce("there", F.lit(False)).alias("resolved"), C.kept_snippet(F.col("snippet"), F.col("item")).alias("evidence"))


# Union of key sets, concatenation, and a fixed list of keys with zero for what is missing.
@query("""WITH keys AS (SELECT p_size AS size FROM part UNION SELECT CAST(o_custkey % 60 AS INT) FROM orders), n AS (SELECT p_size AS size, count(*) AS n, min(p_retailprice) AS lo FROM part GROUP BY 1), m AS (SELECT o_custkey % 60 AS size, count(*) AS n, min(o_totalprice) AS lo FROM orders GROUP BY 1)
SELECT keys.size, coalesce(n.n, 0) AS n_parts, coalesce(m.n, 0) AS n_orders, least(n.lo, m.lo) AS lowest FROM keys LEFT JOIN n ON keys.size = n.size LEFT JOIN m ON keys.size = m.size""")
def q80_reindex(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("size"), F.lit(True).alias("is_part"), F.col("p_retailprice").alias("x"))
    o = table(spark, d, "orders").select((F.col("o_custkey") % 60).cast("int").alias("size"), F.lit(False).alias("is_part"), F.col("o_totalprice").alias("x"))
    return p.unionByName(o).groupBy("size").agg(F.count_if("is_part").alias("n_parts"), F.count_if(~F.col("is_part")).alias("n_orders"), F.min("x").alias("lowest"))  # one shuffle, not three


# A map of maps in JSON to rows (O9), and codes that share an event to a row each.
@query("SELECT event_id, unnest(['k', 'twice']) AS name, unnest([CAST(json_extract_string(props, '$.k') AS INT), 2 * CAST(json_extract_string(props, '$.k') AS INT)]) AS n FROM events")
def q81_json_rows(spark, d):
    twice = F.concat(F.lit('{"k": {"n": '), F.get_json_object("props", "$.k"), F.lit('}, "twice": {"n": '), (2 * F.get_json_object("props", "$.k").cast("int")).cast("string"), F.lit("}}"))
    x = table(spark, d, "events").select("event_id", F.explode(F.from_json(twice, "map<string, struct<n: int>>")).alias("name", "v"))
    return x.select("event_id", "name", F.col("v.n").alias("n"))


@query("SELECT p_partkey, code, CAST(len(string_split(p_type || '/' || p_brand, '/')) > 1 AS BOOLEAN) AS shared FROM (SELECT *, unnest(string_split(p_type || '/' || p_brand, '/')) AS code FROM part)")
def q82_event_fanout(spark, d):
    codes = F.split(F.concat_ws("/", "p_type", "p_brand"), "/")
    return table(spark, d, "part").select("p_partkey", F.explode(codes).alias("code"), (F.size(codes) > 1).alias("shared"))


# Names of code in prose, blanks inside brackets, and how bad that is.
@query(rf"""WITH x AS (SELECT doc_id, len(regexp_extract_all(text, '{C.IDENTIFIER}')) AS n_names, len(regexp_extract_all(text, '\( | \)')) AS n_brackets, len(regexp_extract_all(text, '[^\s]+')) AS words FROM documents)
SELECT doc_id, CAST(n_names AS BIGINT) AS n_names, CAST(n_brackets AS BIGINT) AS n_brackets, least(greatest(round(CASE WHEN words > 0 THEN (n_names + n_brackets) / words::DOUBLE END * 100, 3), 0.1), 1.0)::DOUBLE AS severity FROM x""")
def q83_typeset(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.size(C.identifiers(F.col("text"))).cast("long").alias("n_names"), C.loose_brackets(F.col("text")).cast("long").alias("n_brackets"), F.size(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("words"))
    return x.select("doc_id", "n_names", "n_brackets", C.typeset_severity(F.col("n_names") + F.col("n_brackets"), F.col("words")).alias("severity"))


# Operational fields of a run.
@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/markdown' ELSE 'text/plain' END AS mime FROM orders)
SELECT o_orderkey, CASE WHEN contains(mime, 'pdf') THEN 'pdf' WHEN contains(mime, 'markdown') THEN 'md' END AS doc_type, nullif(round(coalesce(sum(CASE WHEN l_returnflag NOT IN ('R') THEN l_quantity END), 0), 2), 0) AS analyser_time, round(coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_tax END), 0), 4) AS role_cost
FROM x JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def q84_operational_fields(spark, d):
    k = F.col("o_orderkey") % 3
    x = table(spark, d, "orders").select("o_orderkey", C.document_type(F.when(k == 0, "application/pdf").when(k == 1, "text/markdown").otherwise("text/plain")).alias("doc_type"))
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.nullif(F.round(F.coalesce(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))), F.lit(0.0)), 2), F.lit(0.0)).alias("analyser_time"),
        F.round(F.coalesce(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_tax"))), F.lit(0.0)), 4).alias("role_cost"),
    )
    return x.join(sums, "o_orderkey")


@query("""SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9_-]+', '_', 'g') AS key, left(p_name, 6) AS prefix, CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE 'p.' || p_size END AS label FROM part""")
def q85_keys(spark, d):
    """Keys, prefixes and labels of a view."""
    key = F.regexp_replace(F.lower(F.concat_ws(" ", "p_name", "p_type")), "[^a-z0-9_-]+", "_")
    return table(spark, d, "part").select("p_partkey", key.alias("key"), F.substring("p_name", 1, 6).alias("prefix"), F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.concat(F.lit("p."), F.col("p_size").cast("string"))).alias("label"))


@query("""SELECT p_partkey, p_size::DOUBLE AS x, CASE WHEN p_partkey % 2 = 0 THEN 800.0::DOUBLE - greatest(p_size + 90, p_size + 40) ELSE p_size + 40.0::DOUBLE END AS y, 30.0::DOUBLE AS w, 50.0::DOUBLE AS h FROM part""")
def q86_boxes(spark, d):
    x = F.col("p_size").cast("double")
    box = C.upper_left_box(x, x + 90, x + 30, x + 40, F.lit(800.0), F.col("p_partkey") % 2 == 0)
    return table(spark, d, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.x", "b.y", "b.w", "b.h")


@query("""SELECT conv_id, string_agg('[Ref: ' || turn || '] [Section: ' || role || '] ' || left(text, 300), chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1""")
def q87_serialised(spark, d):
    """Items of a document in order as the text of a prompt."""
    line = F.concat(F.lit("[Ref: "), F.col("turn").cast("string"), F.lit("] [Section: "), F.col("role"), F.lit("] "), F.substring("text", 1, 300))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("t"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("prompt"))


_SIDES = "s AS (SELECT event_type AS code, count(*) FILTER (WHERE g AND NOT t) AS missed, count(*) FILTER (WHERE t AND NOT g) AS added FROM e GROUP BY 1)"


@query(_CODES.split(", c AS")[0] + ", " + _SIDES + """, u AS (SELECT 'missed' AS side, code, missed AS n FROM s UNION ALL SELECT 'added', code, added FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, code) AS rank FROM u)
SELECT side, code, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def q88_top_missed(spark, d):
    """The five codes most missed and most added (K7, E5)."""
    e = user_hours(spark, d).withColumn("first", F.dayofmonth("ts") <= 15).groupBy("unit", "event_type").agg(F.bool_or("first").alias("t"), F.bool_or(~F.col("first")).alias("g"))
    s = e.groupBy(F.col("event_type").alias("code")).agg(F.count_if(F.col("g") & ~F.col("t")).alias("missed"), F.count_if(F.col("t") & ~F.col("g")).alias("added"))
    return A.top_by(s.unpivot(["code"], ["missed", "added"], "side", "n"), ["side"], [F.desc("n"), F.col("code")], 5)


@query(f"WITH {RULES_SQL}, {F_SQL} SELECT event_id, event_type, {IMPACT_SQL} AS impact FROM f LEFT JOIN rules ON event_type = ac_code ORDER BY abs(coalesce({IMPACT_SQL}, 0)) DESC, event_id LIMIT 20")
def q89_worst_findings(spark, d):
    """The findings that cost most: a report of 20 (K2, K4, K8)."""
    s = O.score(found(spark, d), rules(spark), "event_type", F.lit(400.0))
    return s.orderBy(F.desc(F.abs(F.coalesce("impact", F.lit(0.0)))), "event_id").limit(20).select("event_id", "event_type", "impact")


@query("""WITH bad AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), good AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM bad))
SELECT c_custkey, c_acctbal FROM good WHERE pos <= (SELECT count(*) FROM bad)""")
def q90_good_candidates(spark, d):
    """As many unblemished projects as there are blemished ones, the best first.

    The place of a project is counted by score from a histogram of scores, not in one sorted task.
    """
    bad = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    good = table(spark, d, "customer").select("c_custkey", "c_acctbal").join(bad, "c_custkey", "left_anti")
    return A.first_in_order(good, "c_acctbal", "c_custkey", bad.agg(count().alias("wanted")))


@query("""SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderstatus AS variant, count(*) AS n, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1, 2""")
def q91_counts_by_year(spark, d):
    """P4, P7, A28."""
    x = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("variant"), "o_totalprice")
    return A.timing_stats(x, ["year", "variant"], "o_totalprice", {"median": 0.5}).drop("mean")


@query("""WITH x AS (SELECT length(text) AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT quantile_cont(n, 0.99) AS cut FROM x) SELECT CAST(n // 5 * 5 AS BIGINT) AS low, count(*) AS n_docs FROM x, c WHERE n <= cut GROUP BY 1""")
def q92_length_histogram(spark, d):
    """Lengths in bins of five up to the 99th percentile (P10)."""
    x = table(spark, d, "documents").select(F.length("text").alias("n")).dropna()
    cut = F.broadcast(A.percentiles(x, [], F.col("n"), [0.99]).select(F.col("q")[0].alias("cut")))  # one row
    return x.join(cut, F.col("n") <= F.col("cut")).groupBy((F.floor(F.col("n") / 5) * 5).cast("long").alias("low")).agg(count().alias("n_docs"))


@query("""WITH u AS (UNPIVOT (SELECT l_returnflag AS variant, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) ON quantity, discount, tax INTO NAME metric VALUE v)
SELECT variant, metric, count(*) AS n, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3 FROM u GROUP BY 1, 2""")
def q93_metric_boxes(spark, d):
    """Quartiles of several metrics for each variant."""
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("variant"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    v = x.unpivot(["variant"], ["quantity", "discount", "tax"], "metric", "v")
    return A.timing_stats(v, ["variant", "metric"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, 6).drop("mean")


@query(f"""WITH {RULES_SQL}, {F_SQL}, i AS (SELECT event_id, user_id, {IMPACT_SQL} AS impact, CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END AS wanted FROM f LEFT JOIN rules ON event_type = ac_code)
SELECT user_id, count(*) FILTER (WHERE coalesce(wanted, true)) AS n_included, round(CAST(400.0 + coalesce(sum(CASE WHEN coalesce(wanted, true) THEN impact END), 0) AS DECIMAL(24, 9)), 2)::DOUBLE AS points FROM i GROUP BY 1""")
def q94_include_state(spark, d):
    """Points from the findings that a reader left in."""
    state = found(spark, d).filter("event_id % 4 = 0").select("event_id", (F.col("event_id") % 8 == 0).alias("wanted"))
    i = O.score(found(spark, d), rules(spark), "event_type", F.lit(400.0)).join(state, "event_id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(True)))
    return i.groupBy("user_id").agg(F.count_if("wanted").alias("n_included"), C.rounded(F.lit(400.0) + F.coalesce(F.sum(F.when(F.col("wanted"), F.col("impact"))), F.lit(0.0)), 2).alias("points"))


@query("""WITH s AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^.!?]+[.!?]*'))) AS t FROM documents) SELECT doc_id, count(*) AS n_sentences, max(length(t)) AS longest FROM s WHERE t <> '' GROUP BY 1""")
def q95_sentences(spark, d):
    """Sentences of a document, by closing marks."""
    s = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]*"), F.lit(0))).alias("t")).select("doc_id", F.trim("t").alias("t")).filter("t <> ''")
    return s.groupBy("doc_id").agg(count().alias("n_sentences"), F.max(F.length("t")).cast("long").alias("longest"))


# Findings of the parser from a listing of files (T8, G6): what fails has no impact.
@query("""WITH f AS (SELECT p_partkey, p_name, CASE WHEN p_size % 9 = 0 THEN 0 ELSE p_size END AS bytes, lower(regexp_extract(CASE p_size % 3 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.md' ELSE 'c.docx' END, '(\\.[^.]*)$', 1)) AS suffix FROM part)
SELECT CASE WHEN bytes = 0 THEN 'MISSING' WHEN suffix NOT IN ('.pdf', '.md') THEN 'DOCTYPE' END AS code, suffix, count(*) AS n, CAST(NULL AS DOUBLE) AS impact FROM f GROUP BY 1, 2""".replace("\\\\", "\\"))
def q96_parser_findings(spark, d):
    k = F.col("p_size") % 3
    suffix = F.lower(F.regexp_extract(F.when(k == 0, "a.PDF").when(k == 1, "b.md").otherwise("c.docx"), r"(\.[^.]*)$", 1))
    f = table(spark, d, "part").select(F.when(F.col("p_size") % 9 == 0, 0).otherwise(F.col("p_size")).alias("bytes"), suffix.alias("suffix"))
    code = F.when(F.col("bytes") == 0, "MISSING").when(~F.col("suffix").isin(".pdf", ".md"), "DOCTYPE")
    return f.groupBy(code.alias("code"), "suffix").agg(count().alias("n")).withColumn("impact", F.lit(None).cast("double"))


@query(f"""WITH x AS (SELECT {UNIT_SQL} AS unit, value FROM events) SELECT count(*) AS n, count(*) FILTER (WHERE c >= 3 AND sd > 20) AS n_steady FROM (SELECT unit, count(*) AS c, stddev_samp(value) AS sd FROM x GROUP BY 1)""")
def q97_stat_thresholds(spark, d):
    """Groups over thresholds of their statistics."""
    g = user_hours(spark, d).groupBy("unit").agg(count().alias("c"), F.stddev_samp("value").alias("sd"))
    return g.agg(count().alias("n"), F.count_if((F.col("c") >= 3) & (F.col("sd") > 20)).alias("n_steady"))


@query(_CODES + """, u AS (UNPIVOT (SELECT code, precision, recall, f1 FROM q) ON precision, recall, f1 INTO NAME metric VALUE v) SELECT code, metric, v FROM u""")
def q98_agreement_bars(spark, d):
    """A row for each bar that has a value."""
    return q13_set_agreement(spark, d).unpivot(["code"], ["precision", "recall", "f1"], "metric", "v").dropna(subset=["v"])


@query("""WITH p AS (SELECT row_number() OVER (PARTITION BY left(p_name, 6) ORDER BY p_partkey) AS pos, p_partkey, left(p_name, 6) AS prefix FROM part) SELECT prefix, p_partkey FROM p WHERE pos = 1""")
def q99_first_by_prefix(spark, d):
    """The first run of each prefix of an identifier."""
    return table(spark, d, "part").groupBy(F.substring("p_name", 1, 6).alias("prefix")).agg(F.min("p_partkey").alias("p_partkey"))
