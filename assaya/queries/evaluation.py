r"""Queries q124-q139: judge audits, records, evaluation against gold grading, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assaya import fixed_values as V
from assaya.functions import columns as C
from assaya.operators import analysers as Y
from assaya.operators import analytics as A
from assaya.operators import findings as O
from assaya.operators import gold as G
from assaya.operators import records as D
from assaya.operators import training as R
from assaya.plans import assessment
from assaya.queries.core import F_SQL, IMPACT_SQL, MAX_POINTS, RULES_SQL, found, query, rules, table



def pick(names, index):
    return F.get(F.array(*[F.lit(x) for x in names]), index.cast("int"))


# What a judge changes, with names, values before and after, and the first anchor's snippet.
@query(f"""WITH {F_SQL}, x AS (SELECT event_id, k, 'S' || k AS summary, k / 99.0::DOUBLE AS severity, CASE WHEN k % 4 > 0 THEN 'a' || k END AS snippet, CASE event_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'adjusted' WHEN 2 THEN 'dismissed' END AS decision FROM f),
y AS (SELECT *, CASE WHEN decision = 'adjusted' AND k % 3 = 0 THEN 'new' ELSE summary END AS s2, CASE WHEN decision = 'adjusted' AND k % 2 = 0 THEN 0.5::DOUBLE ELSE severity END AS v2, CASE WHEN decision = 'adjusted' AND snippet IS NOT NULL THEN 'cut' ELSE snippet END AS n2 FROM x)
SELECT event_id, CASE WHEN decision IS NULL THEN 'to_be_judged' ELSE 'judged_' || decision END AS judge_status, CASE WHEN decision IS NOT NULL THEN 'judge' END AS judge_model, s2 AS summary, round(v2, 6) AS severity, n2 AS snippet, CASE WHEN decision IS NOT NULL THEN 'r' || k END AS rationale,
nullif(array_to_string(list_filter([CASE WHEN s2 <> summary THEN 'summary' END, CASE WHEN v2 <> severity THEN 'severity' END, CASE WHEN n2 <> snippet THEN 'snippet' END], lambda z: z IS NOT NULL), ','), '') AS fields, CASE WHEN s2 <> summary OR v2 <> severity OR n2 <> snippet THEN snippet END AS before_snippet, CASE WHEN s2 <> summary OR v2 <> severity OR n2 <> snippet THEN s2 END AS after_summary FROM y""")
def q124_judge_audit(spark, d):
    k = F.col("k")
    anchor = F.array(F.struct(F.concat(F.lit("a"), k.cast("string")).alias("snippet"), F.lit("p").alias("section_path")), F.struct(F.lit("second").alias("snippet"), F.lit("q").alias("section_path")))
    f = found(spark, d).withColumns({"judge_status": F.lit("to_be_judged"), "summary": F.concat(F.lit("S"), k.cast("string")), "anchors": F.when(k % 4 > 0, anchor)})
    v = f.filter("event_id % 5 < 3").select(
        "finding_id", F.expr("CASE event_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'adjusted' ELSE 'dismissed' END").alias("decision"), F.when(k % 3 == 0, "new").alias("adjusted_summary"), F.when(k % 2 == 0, 0.5).alias("adjusted_severity"),
        F.lit("cut").alias("adjusted_snippet"), F.concat(F.lit("r"), k.cast("string")).alias("rationale"), F.lit(1).alias("seq"),
    )
    j = O.apply_verdicts(f, v, "seq", "judge")
    return j.select(
        "event_id", "judge_status", "judge_model", "summary", F.round("severity", 6).alias("severity"), F.get("anchors", F.lit(0))["snippet"].alias("snippet"), F.col("judge.rationale").alias("rationale"),
        F.when(F.col("judge.fields").isNotNull(), F.array_join("judge.fields", ",")).alias("fields"), F.col("judge.before.snippet").alias("before_snippet"), F.col("judge.after.summary").alias("after_summary"),
    )


# Findings in the 19 columns of the graders' events (SNK3).
@query(f"""WITH {RULES_SQL}, {F_SQL}, s AS (SELECT f.*, {IMPACT_SQL} AS impact FROM f LEFT JOIN rules ON event_type = ac_code)
SELECT CAST(user_id AS VARCHAR) AS id, NULL::VARCHAR AS year, NULL::VARCHAR AS task_variant, event_type AS code, impact, false AS impact_has_sign, NULL::VARCHAR AS impact_source, false AS impact_shared, 'S' || k AS comment, 'S' || k AS raw_text, 'u' || user_id || CASE user_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.md' ELSE '' END AS source_file,
round(CAST(400.0 + coalesce(sum(impact) OVER (PARTITION BY user_id), 0) AS DECIMAL(24, 9)), 2)::DOUBLE AS doc_points, CASE user_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'md' END AS doc_type, NULL::DOUBLE AS bonus_points, round(k / 99.0::DOUBLE, 6) AS severity, 0.5::DOUBLE AS confidence, 'to_be_judged' AS judge_status, 'proposed' AS human_status, CAST(event_id AS VARCHAR) AS finding_id FROM s""")
def q125_export_rows(spark, d):
    s = O.score(found(spark, d), rules(spark), "event_type", F.lit(MAX_POINTS))
    suffix = pick((".PDF", ".md", ""), F.col("user_id") % 3)
    f = s.select(
        F.col("user_id").alias("doc_id"), F.concat(F.lit("in/u"), F.col("user_id").cast("string"), suffix).alias("path"), F.col("event_type").alias("ac_code"), "impact", F.concat(F.lit("S"), F.col("k").cast("string")).alias("summary"),
        F.round("severity", 6).alias("severity"), F.lit(0.5).alias("confidence"), F.lit("to_be_judged").alias("judge_status"), F.lit("proposed").alias("human_status"), F.col("event_id").cast("string").alias("finding_id"),
    )
    return D.export_rows(f, F.lit(MAX_POINTS))


_USAGE_SQL = """u AS (SELECT user_id AS doc_id, event_type AS model, count(*) AS calls, CAST(sum(k) * 10 AS BIGINT) AS prompt_tokens, CAST(sum(k) AS BIGINT) AS completion_tokens, CAST(sum(k % 7) AS BIGINT) AS cached_tokens, CASE WHEN event_type = 'signup' AND user_id % 3 = 0 THEN NULL ELSE round(sum(k) / 1000.0::DOUBLE, 6) END AS cost_eur FROM f GROUP BY 1, 2)"""


def usage(spark, d):
    k = F.col("k")
    return found(spark, d).groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("model")).agg(
        F.count(F.lit(1)).alias("calls"), (F.sum(k) * 10).cast("long").alias("prompt_tokens"), F.sum(k).cast("long").alias("completion_tokens"), F.sum(k % 7).cast("long").alias("cached_tokens"),
        F.when((F.col("event_type") == "signup") & (F.col("user_id") % 3 == 0), None).otherwise(F.round(F.sum(k) / 1000, 6)).alias("cost_eur"),
    )


# Records of documents (SNK5, A30, R17, R18).
@query(f"""WITH {F_SQL}, {_USAGE_SQL}, t AS (SELECT doc_id, sum(prompt_tokens) AS p, sum(completion_tokens) AS c, sum(cached_tokens) AS q, CASE WHEN count(*) = count(cost_eur) THEN round(sum(cost_eur), 6) END AS cost, list_sort(list(model || '=' || cost_eur)) AS by_model FROM u GROUP BY 1),
s AS (SELECT user_id AS doc_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_parser, round(sum(CASE WHEN event_type = 'view' THEN k END) / 100.0::DOUBLE, 4) AS view_seconds FROM f GROUP BY 1)
SELECT doc_id, user_ok AS parsed_ok, n_parser AS n_parser_findings, n AS n_findings, CAST(p AS BIGINT) AS prompt_tokens, CAST(c AS BIGINT) AS completion_tokens, CAST(q AS BIGINT) AS cached_tokens, cost AS total_cost_eur, CASE WHEN user_ok THEN doc_id * 3 END AS total_words, view_seconds, CASE WHEN doc_id % 4 = 0 THEN '["e0","e1"]' END AS errors, 'h' AS config_hash
FROM (SELECT *, doc_id % 5 <> 0 AS user_ok FROM s) JOIN t USING (doc_id)""")
def q126_document_info(spark, d):
    e = found(spark, d)
    docs = e.select(F.col("user_id").alias("doc_id")).distinct().withColumns({"parsed_ok": F.col("doc_id") % 5 != 0, "elapsed_seconds": F.col("doc_id") / 7, "words": F.col("doc_id") * 3, "paragraphs": F.lit(1), "pictures": F.lit(0)})
    times = e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("stage"), (F.col("k") / 100).alias("seconds"))
    findings = e.select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == "error", "PARSER").otherwise("x").alias("analyser_id"))
    errors = docs.filter("doc_id % 4 = 0").select("doc_id", F.lit("grammar_analyser").alias("analyser_id"), F.explode(F.array(F.lit("e1"), F.lit("e0"))).alias("message"))
    info = D.document_info(docs, usage(spark, d), times, findings, errors, {"run_id": "r", "config_hash": "h", "course": "IPP", "max_doc_points": 400})
    at = lambda path, kind: F.get_json_object("info", f"$.{path}").cast(kind)
    return info.select(
        "doc_id", at("parse.parsed_ok", "boolean").alias("parsed_ok"), at("counts.n_parser_findings", "long").alias("n_parser_findings"), at("counts.n_findings", "long").alias("n_findings"), at("usage.total_prompt_tokens", "long").alias("prompt_tokens"),
        at("usage.total_completion_tokens", "long").alias("completion_tokens"), at("usage.total_cached_tokens", "long").alias("cached_tokens"), at("usage.total_cost_eur", "double").alias("total_cost_eur"), at("document.total_words", "long").alias("total_words"),
        at("stage_times.view", "double").alias("view_seconds"), at("analyser_errors.grammar_analyser", "string").alias("errors"), at("run.config_hash", "string").alias("config_hash"),
    )


# The record of a run (SNK5, A29, A31).
@query(f"""WITH {F_SQL}, {_USAGE_SQL}, m AS (SELECT model, sum(prompt_tokens) AS p, CASE WHEN count(*) = count(cost_eur) THEN round(sum(cost_eur), 6) END AS cost FROM u GROUP BY 1)
SELECT (SELECT count(DISTINCT user_id) FROM f) AS docs_total, (SELECT count(DISTINCT user_id) FROM f WHERE user_id % 5 = 0) AS docs_failed_parse, CAST(sum(p) AS BIGINT) AS prompt_tokens, CASE WHEN count(*) = count(cost) THEN round(sum(cost), 6) END AS total_cost_eur, max(CASE WHEN model = 'click' THEN cost END) AS click_cost,
(SELECT count(*) FROM f WHERE event_type = 'view') AS view_calls, (SELECT round(avg(k / 100.0::DOUBLE), 4) FROM f WHERE event_type = 'view') AS view_avg, (SELECT count(*) FROM f) AS invocations, (SELECT round(sum(k / 100.0::DOUBLE), 4) FROM f) AS tracked FROM m""")
def q127_run_summary(spark, d):
    e = found(spark, d)
    docs = e.select(F.col("user_id").alias("doc_id")).distinct().withColumns({"parsed_ok": F.col("doc_id") % 5 != 0, "elapsed_seconds": F.col("doc_id") / 7})
    times = e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("stage"), (F.col("k") / 100).alias("seconds"))
    s = D.run_summary(docs, usage(spark, d), times, {"run_id": "r", "config_hash": "h"})
    at = lambda path, kind, name: F.get_json_object("summary", f"$.{path}").cast(kind).alias(name)
    return s.select(
        at("counts.docs_total", "long", "docs_total"), at("counts.docs_failed_parse", "long", "docs_failed_parse"), at("usage.total_prompt_tokens", "long", "prompt_tokens"), at("usage.total_cost_eur", "double", "total_cost_eur"), at("usage.costs_by_model_eur.click", "double", "click_cost"),
        at("stage_times.by_stage.view.calls", "long", "view_calls"), at("stage_times.by_stage.view.avg_seconds", "double", "view_avg"), at("stage_times.total_stage_invocations", "long", "invocations"), at("stage_times.total_tracked_seconds", "double", "tracked"),
    )


# Digests of files and of configurations in any order of keys.
@query("""SELECT doc_id, 'sha256:' || sha256(text) AS file_digest, 'sha256:' || sha256('{"course":"' || source || '","judge":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"params":{"a":[1,2],"b":' || doc_id || '}}') AS config_hash FROM documents""")
def q128_digests(spark, d):
    docs = table(spark, d, "documents")
    judge, course = F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"), F.concat(F.lit('"course": "'), F.col("source"), F.lit('"'))
    params = F.concat(F.lit('"params": {"b": '), F.col("doc_id").cast("string"), F.lit(', "a": [1, 2]}'))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"run_id": "x", '), params, F.lit(', "judge": '), judge, F.lit(", "), course, F.lit("}"))).otherwise(F.concat(F.lit("{"), course, F.lit(', "judge":'), judge, F.lit(","), params, F.lit(',\n"run_id":"y"}')))
    return docs.select("doc_id", D.file_digest(F.col("text").cast("binary")).alias("file_digest"), D.config_hash(text).alias("config_hash"))


# A finding in a few lines.
@query(f"""WITH {F_SQL} SELECT event_id, '[' || event_id || ']:' || chr(10) || 'S' || k || chr(10) || 'severity=' || printf('%.2f', k / 100.0::DOUBLE) || CASE WHEN k % 3 > 0 THEN ', impact=' || printf('%+.2f', (k - 50) / 4.0::DOUBLE) || 'pts' ELSE '' END || ', judge_status=to_be_judged, human_status=proposed' ||
CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '  Evidence [1]: (No snippet provided)' ELSE chr(10) || '  Evidence [1]: "' || CASE WHEN k > 20 THEN repeat('ab ', 166) || 'ab...' ELSE repeat('ab ', k) END || '"' END || CASE WHEN k % 5 = 0 THEN chr(10) || '  Notes: n1, n2' ELSE '' END AS lines FROM f""")
def q129_finding_lines(spark, d):
    k = F.col("k")
    f = found(spark, d).withColumns({
        "finding_id": F.col("event_id").cast("string"), "summary": F.concat(F.lit("S"), k.cast("string")), "severity": k / 100, "confidence": F.lit(None).cast("double"), "impact": F.when(k % 3 > 0, (k - 50) / 4), "judge_status": F.lit("to_be_judged"), "human_status": F.lit("proposed"),
        "cref": F.when(k % 3 > 0, "#/texts/1"), "snippet": F.when(k % 3 == 2, F.repeat(F.lit("ab\n"), F.when(k > 20, 400).otherwise(k).cast("int"))), "notes": F.when(k % 5 == 0, F.array(F.lit("n1"), F.lit("n2"))),
    })
    return f.select("event_id", D.finding_summary(f).alias("lines"))


# Gold grading is played by order lines, the tool's findings by events; students are customers and users of one number.
_GOLD_CODES = ("STYLE", "styl", "CH", "BLOK", "UML", "OK", "zz", "COPY")
_TOOL_CODES = ("STYLE", "SAZBA", "NOUML", "CH", "XX", "")
GOLD_SQL = f"""l AS (SELECT o_custkey AS student_id, CASE WHEN o_orderpriority < '3' THEN 'par' ELSE 'int' END AS task_variant, lineitem.*, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, list_extract({list(_GOLD_CODES)}, CAST(l_partkey % 8 AS INT) + 1) AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT *, CASE upper(code) WHEN 'STYL' THEN 'STYLE' WHEN 'BLOK' THEN 'SAZBA' WHEN 'UML' THEN 'NOUML' ELSE upper(code) END AS canon, CASE WHEN l_linenumber % 3 <> 0 THEN -l_quantity END AS impact, CASE WHEN l_suppkey % 5 = 0 THEN false ELSE l_tax > 0.02 END AS sign, l_returnflag = 'R' AS shared, 'T' || l_orderkey % 50 AS raw_text, CASE WHEN task_variant = 'par' THEN 100 ELSE 400 END AS most FROM l WHERE code <> 'zz'),
g1 AS (SELECT student_id, task_variant, most, shared, CASE WHEN shared THEN raw_text END AS t, CASE WHEN shared THEN arg_min(impact / most::DOUBLE, seq) FILTER (WHERE impact IS NOT NULL AND sign) ELSE sum(CASE WHEN impact IS NOT NULL AND sign THEN impact / most::DOUBLE END) END AS v FROM g GROUP BY 1, 2, 3, 4, 5),
g2 AS (SELECT student_id, task_variant, most, coalesce(sum(v), 0) AS gold_sum FROM g1 GROUP BY 1, 2, 3), g3 AS (SELECT student_id, task_variant, list_sort(list(DISTINCT canon)) AS gold, CASE WHEN student_id % 11 <> 0 THEN CAST(arg_min(l_quantity * 5, seq) AS BIGINT) END AS points FROM g GROUP BY 1, 2),
t AS (SELECT user_id AS student_id, CASE WHEN k % 2 = 0 THEN 'par' ELSE 'int' END AS task_variant, nullif(list_extract({list(_TOOL_CODES)}, CAST(event_id % 6 AS INT) + 1), '') AS ac_code, CASE WHEN event_id % 5 = 2 THEN 'judged_dismissed' WHEN event_id % 5 = 1 THEN 'judged_adjusted' WHEN event_id % 5 = 0 THEN 'judged_approved' ELSE 'to_be_judged' END AS status, CASE WHEN k % 7 > 0 THEN -k / 10.0::DOUBLE END AS impact, CASE WHEN event_id % 4 > 0 THEN 'g' || event_id % 3 END AS gen, CASE WHEN event_id % 5 < 3 THEN 'j' || event_id % 2 END AS jud, event_id % 10 <> 7 AS final FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
t1 AS (SELECT student_id, task_variant, list_sort(list(DISTINCT ac_code) FILTER (WHERE status <> 'judged_dismissed' AND ac_code IS NOT NULL)) AS tool, coalesce(sum(impact) FILTER (WHERE status <> 'judged_dismissed'), 0) AS tool_sum, list_sort(list(DISTINCT jud) FILTER (WHERE jud IS NOT NULL)) AS judges FROM t WHERE final GROUP BY 1, 2),
t2 AS (SELECT student_id, task_variant, list_sort(list(DISTINCT ac_code) FILTER (WHERE ac_code IS NOT NULL)) AS raw, list_sort(list(DISTINCT gen) FILTER (WHERE gen IS NOT NULL)) AS gens FROM t GROUP BY 1, 2),
c AS (SELECT student_id, task_variant, most, gold_sum, gold, points, coalesce(tool, []) AS tool, tool_sum, coalesce(judges, []) AS judges, coalesce(raw, []) AS raw, coalesce(gens, []) AS gens, CAST(round_even(round(most + tool_sum, 9), 0) AS BIGINT) AS est FROM g2 JOIN g3 USING (student_id, task_variant) JOIN t1 USING (student_id, task_variant) LEFT JOIN t2 USING (student_id, task_variant)),
st AS (SELECT student_id, task_variant, points AS doc_points, most AS max_doc_points, est AS tool_raw_points, round(CAST(points / most::DOUBLE * 100 AS DECIMAL(24, 9)), 2)::DOUBLE AS doc_score_pct, round(CAST(est / most::DOUBLE * 100 AS DECIMAL(24, 9)), 2)::DOUBLE AS tool_score_pct, est - points AS points_delta, round(CAST((est - points) / most::DOUBLE * 100 AS DECIMAL(24, 9)), 2)::DOUBLE AS points_delta_pct, array_to_string(gens, ', ') AS generator_models, array_to_string(judges, ', ') AS judge_models,
 len(gold) AS gold_code_count, len(tool) AS tool_code_count, len(raw) AS raw_code_count, len(list_intersect(gold, tool)) AS overlap_count, len(list_filter(gold, lambda x: NOT list_contains(tool, x))) AS missed_count, len(list_filter(tool, lambda x: NOT list_contains(gold, x))) AS added_count, len(list_intersect(gold, raw)) AS raw_overlap_count, len(list_filter(gold, lambda x: NOT list_contains(raw, x))) AS raw_missed_count, len(list_filter(raw, lambda x: NOT list_contains(gold, x))) AS raw_added_count,
 round(CAST(gold_sum AS DECIMAL(24, 9)), 4)::DOUBLE AS gold_impact_sum, round(CAST(tool_sum / most AS DECIMAL(24, 9)), 4)::DOUBLE AS tool_impact_sum, round(CAST(tool_sum / most - gold_sum AS DECIMAL(24, 9)), 4)::DOUBLE AS impact_delta, array_to_string(gold, '|') AS gold_codes, array_to_string(tool, '|') AS tool_codes, array_to_string(list_filter(gold, lambda x: list_contains(tool, x)), '|') AS overlap_codes, array_to_string(list_filter(gold, lambda x: NOT list_contains(tool, x)), '|') AS missed_codes, array_to_string(list_filter(tool, lambda x: NOT list_contains(gold, x)), '|') AS added_codes FROM c)"""


def gold_tables(spark, d):
    """Gold rows, final and raw findings."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    par = F.col("o_orderpriority") < "3"
    impact = F.when(F.col("l_linenumber") % 3 != 0, -F.col("l_quantity"))
    most = F.when(par, 100).otherwise(400)
    g = lines.select(
        F.col("o_custkey").alias("student_id"), F.when(par, "par").otherwise("int").alias("task_variant"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"), pick(_GOLD_CODES, F.col("l_partkey") % 8).alias("code"), impact.alias("impact"),
        (impact / most).alias("impact_normalised"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_tax") > 0.02).alias("impact_has_sign"), (F.col("l_returnflag") == "R").alias("impact_shared"), F.concat(F.lit("T"), (F.col("l_orderkey") % 50).cast("string")).alias("raw_text"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("l_quantity") * 5).alias("doc_points"), most.alias("max_points"),
    )
    k, e = F.col("k"), F.col("event_id")
    status = F.when(e % 5 == 2, "judged_dismissed").when(e % 5 == 1, "judged_adjusted").when(e % 5 == 0, "judged_approved").otherwise("to_be_judged")
    t = found(spark, d).select(
        F.col("user_id").alias("student_id"), F.when(k % 2 == 0, "par").otherwise("int").alias("task_variant"), pick(_TOOL_CODES, e % 6).alias("ac_code"), status.alias("judge_status"), F.when(k % 7 > 0, -k / 10).alias("impact"),
        F.when(e % 4 > 0, F.concat(F.lit("g"), (e % 3).cast("string"))).alias("generator_model"), F.when(e % 5 < 3, F.concat(F.lit("j"), (e % 2).cast("string"))).alias("judge_model"), (e % 10 != 7).alias("final"),
    )
    return G.gold_rows(g), t.filter("final"), t


# The 28 figures of a student.
@query(f"WITH {GOLD_SQL} SELECT * FROM st")
def q130_student_comparison(spark, d):
    return G.compare_students(*gold_tables(spark, d))


def students(spark, d):
    s = G.compare_students(*gold_tables(spark, d))
    return s.withColumns({"doc_type": F.when(F.col("student_id") % 3 == 0, "pdf").when(F.col("student_id") % 3 == 1, "md"), "doc_language": pick(("cs", "sk", "en", ""), F.col("student_id") % 4)})


_T = "abs(r) * sqrt((n2 - 2) / (1 - r * r))"


# The whole evaluation: all students, and groups of each section.
@query(f"""WITH {GOLD_SQL}, s0 AS (SELECT *, CASE student_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'md' END AS doc_type, list_extract(['cs', 'sk', 'en', ''], CAST(student_id % 4 AS INT) + 1) AS doc_language FROM st),
s AS (SELECT 'overall' AS section, '' AS grp, * FROM s0 UNION ALL SELECT 'per_variant', task_variant, * FROM s0 UNION ALL SELECT 'per_format', doc_type, * FROM s0 WHERE doc_type IS NOT NULL UNION ALL SELECT 'per_language', doc_language, * FROM s0 WHERE doc_language <> '' UNION ALL SELECT 'per_generator_model', generator_models, * FROM s0 WHERE generator_models <> '' UNION ALL SELECT 'per_judge_model', judge_models, * FROM s0 WHERE judge_models <> ''),
p AS (SELECT section, grp, count(*) AS n, round(CAST(avg(abs(points_delta)) AS DECIMAL(24, 9)), 2)::DOUBLE AS points_mae, round(CAST(avg(points_delta) AS DECIMAL(24, 9)), 2)::DOUBLE AS points_mean_delta, round(CAST(avg(abs(points_delta_pct)) AS DECIMAL(24, 9)), 2)::DOUBLE AS points_mae_pct, round(CAST(avg(points_delta_pct) AS DECIMAL(24, 9)), 2)::DOUBLE AS points_mean_delta_pct, CAST(sum(gold_code_count) AS BIGINT) AS total_gold, CAST(sum(tool_code_count) AS BIGINT) AS total_tool, CAST(sum(overlap_count) AS BIGINT) AS total_overlap,
 count(doc_points) AS n2, CASE WHEN count(doc_points) >= 3 AND var_pop(CASE WHEN doc_points IS NOT NULL THEN tool_raw_points END) > 0 AND var_pop(doc_points) > 0 THEN corr(doc_points::DOUBLE, tool_raw_points::DOUBLE) END AS r FROM s GROUP BY 1, 2),
x AS (SELECT section, grp, unnest(list_distinct(list_concat(string_split(gold_codes, '|'), string_split(tool_codes, '|')))) AS code, string_split(gold_codes, '|') AS g, string_split(tool_codes, '|') AS t FROM s),
y AS (SELECT section, grp, code, sum((list_contains(g, code) AND list_contains(t, code))::INT) AS a, sum(list_contains(g, code)::INT) AS ng, sum(list_contains(t, code)::INT) AS nt FROM x WHERE code <> '' GROUP BY 1, 2, 3),
z AS (SELECT *, round(a / nullif(nt, 0)::DOUBLE, 4) AS pr, round(a / nullif(ng, 0)::DOUBLE, 4) AS re FROM y), w AS (SELECT section, grp, round(CAST(avg(pr) AS DECIMAL(24, 9)), 4)::DOUBLE AS macro_precision, round(CAST(avg(re) AS DECIMAL(24, 9)), 4)::DOUBLE AS macro_recall, round(CAST(avg(CASE WHEN pr > 0 AND re > 0 THEN round(2 * pr * re / (pr + re), 4) END) AS DECIMAL(24, 9)), 4)::DOUBLE AS macro_f1 FROM z GROUP BY 1, 2),
q AS (SELECT section, grp, r, n2 - 2 AS v, atan({_T} / sqrt(n2 - 2)) AS th FROM p WHERE r IS NOT NULL),
pv AS (SELECT section, grp, 1 - CASE WHEN v % 2 = 0 THEN sin(th) * list_sum(list_transform(range(0, v // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(th), 2 * k)))
 ELSE 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(1, (v - 1) // 2 + 1), lambda k: pow(cos(th), 2 * k - 1) * sqrt(pi()) * exp(lgamma(k) - lgamma(k + 0.5)) / 2)), 0)) END AS pval FROM q)
SELECT p.section, p.grp, n, points_mae, points_mean_delta, points_mae_pct, points_mean_delta_pct, macro_precision, macro_recall, macro_f1, round(r, 4) AS pearson_r, abs(round(pval, 4)) AS pearson_p, total_gold, total_tool, total_overlap, round(total_overlap / nullif(total_gold, 0)::DOUBLE, 4) AS overlap_rate FROM p LEFT JOIN w ON p.section = w.section AND p.grp = w.grp LEFT JOIN pv ON p.section = pv.section AND p.grp = pv.grp""")
def q131_full_evaluation(spark, d):
    return G.evaluate(students(spark, d))


# Costs, tokens and times, and the costs of the variants.
@query(f"""WITH {GOLD_SQL}, o AS (SELECT st.*, CASE WHEN student_id % 6 > 0 THEN student_id / 100.0::DOUBLE END AS cost, student_id * 10 AS p, student_id % 9 AS q, 1 + student_id % 4 AS n_api, 2.0::DOUBLE + student_id % 13 AS took FROM st)
SELECT 'all' AS scope, count(cost) AS n, round(CAST(avg(cost) AS DECIMAL(24, 9)), 4)::DOUBLE AS mean_cost_eur, round(CAST(nullif(sum(cost), 0) AS DECIMAL(24, 9)), 4)::DOUBLE AS total_cost_eur, round(CAST(avg(cost) * 600 AS DECIMAL(24, 9)), 2)::DOUBLE AS projected_cohort_cost_eur, round(sum(cost) / nullif(sum(overlap_count + added_count), 0), 6) AS cost_per_finding_eur, round(CAST(avg(p) AS DECIMAL(24, 9)), 4)::DOUBLE AS mean_prompt_tokens, round(CAST(avg(p / 5.0::DOUBLE) AS DECIMAL(24, 9)), 4)::DOUBLE AS mean_completion_tokens, round(CAST(avg(q) AS DECIMAL(24, 9)), 4)::DOUBLE AS mean_cached_tokens,
round(CAST(avg(q / nullif(p, 0)::DOUBLE) AS DECIMAL(24, 9)), 4)::DOUBLE AS mean_cache_hit_rate, round(CAST(avg(n_api) AS DECIMAL(24, 9)), 4)::DOUBLE AS mean_api_calls, round(CAST(avg(took) AS DECIMAL(24, 9)), 4)::DOUBLE AS mean_elapsed_seconds, round(CAST(max(took) AS DECIMAL(24, 9)), 4)::DOUBLE AS max_elapsed_seconds, round(3600 / avg(took), 1) AS estimated_docs_per_hour FROM o
UNION ALL SELECT task_variant, count(cost), round(CAST(avg(cost) AS DECIMAL(24, 9)), 4)::DOUBLE, round(CAST(sum(cost) AS DECIMAL(24, 9)), 4)::DOUBLE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM o GROUP BY 1""")
def q132_operational(spark, d):
    k = F.col("student_id")
    s = G.compare_students(*gold_tables(spark, d)).withColumns({"cost_eur": F.when(k % 6 > 0, k / 100), "prompt_tokens": k * 10, "completion_tokens": k * 2.0, "cached_tokens": k % 9, "n_api_calls": k % 4 + 1, "elapsed_seconds": k % 13 + 2.0})
    return G.operational(s)


# Stages of findings by code.
@query(f"WITH {GOLD_SQL} SELECT ac_code AS code, count(*) AS raw, count(*) FILTER (WHERE status = 'judged_dismissed') AS dismissed, count(*) FILTER (WHERE status = 'judged_adjusted') AS adjusted, count(*) FILTER (WHERE final) AS final, round(count(*) FILTER (WHERE final) / count(*)::DOUBLE, 4) AS survival_rate FROM t WHERE ac_code IS NOT NULL GROUP BY 1")
def q133_pipeline_stats(spark, d):
    _, final, raw = gold_tables(spark, d)
    return G.pipeline_stats(raw, raw, final)


# The share of projects without a deduction (A6). Many totals are zero but for what adding binary fractions leaves, whose sign hangs on the order: values are added in the order of the table's rows, as SQL does on one thread.
@query("""WITH p AS (SELECT o_custkey, sum(CASE WHEN l_returnflag <> 'R' AND l_linenumber % 5 = 0 THEN 0.05 - l_discount END) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT count(*) FILTER (WHERE total >= 0) AS perfect, count(*) AS n, round(count(*) FILTER (WHERE total >= 0) / count(*)::DOUBLE * 100, 4) AS pct FROM p""")
def q134_perfect_ratio(spark, d):
    value = F.when((F.col("l_returnflag") != "R") & (F.col("l_linenumber") % 5 == 0), F.lit(0.05) - F.col("l_discount"))
    place = [F.when(value.isNotNull(), F.col(f"_metadata.{c}")).alias(c) for c in ("file_path", "row_index")]
    lines = table(spark, d, "lineitem").select("l_orderkey", value.alias("value"), *place)
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    whole = Window.partitionBy("o_custkey").orderBy("file_path", "row_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = rows.select("o_custkey", F.sum("value").over(whole).alias("total")).groupBy("o_custkey").agg(F.first("total").alias("total"))
    perfect = F.count_if(F.col("total") >= 0)
    return p.agg(perfect.alias("perfect"), F.count(F.lit(1)).alias("n"), F.round(F.try_divide(perfect, F.count(F.lit(1))) * 100, 4).alias("pct"))


# Rows at random to train and test (W14): the test part is rounded up.
@query("""WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN pos < n - ceil(n * 0.2) THEN 'train' ELSE 'test' END AS split FROM h""")
def q135_random_split(spark, d):
    return R.random_split(table(spark, d, "documents"), "doc_id", "42", 0.2)


# Tokens of the first documents of each type (E8, W9): words where no tokenizer is given.
@query("""WITH x AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'pdf' ELSE 'docx' END AS format, text, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, source AS cohort, format, len(regexp_extract_all(text, '\\S+')) AS tokens FROM x WHERE format IN ('md', 'pdf') AND n <= 50""")
def q136_token_counts(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.col("source").alias("cohort"), pick(("md", "pdf", "docx"), F.col("doc_id") % 3).alias("format"), "text")
    return R.token_counts(x, 50).select("doc_id", "cohort", "format", F.col("tokens").cast("long").alias("tokens"))


# A run with parse failures, verdicts and scores.
@query(f"""WITH {RULES_SQL}, {F_SQL}, b AS (SELECT user_id FROM f GROUP BY 1 HAVING user_id % 9 = 0), s AS (SELECT f.user_id, event_id, event_type, CASE event_id % 5 WHEN 0 THEN 'judged_approved' WHEN 1 THEN 'judged_adjusted' WHEN 2 THEN 'judged_dismissed' ELSE 'to_be_judged' END AS status, weight, k FROM f LEFT JOIN rules ON event_type = ac_code WHERE user_id % 9 <> 0)
SELECT user_id, count(*) AS n_final, count({IMPACT_SQL}) AS n_rated, round(CAST(400.0 + coalesce(sum({IMPACT_SQL}), 0) AS DECIMAL(24, 9)), 2)::DOUBLE AS points, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM s WHERE status <> 'judged_dismissed' GROUP BY 1
UNION ALL SELECT user_id, 1, 0, 400.0, 'not_to_be_judged' FROM b""")
def q137_assessment_run(spark, d):
    f = found(spark, d).select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), "finding_id", F.col("event_type").alias("ac_code"), "severity", F.lit("to_be_judged").alias("judge_status"))
    v = f.filter("seq % 5 < 3").select("finding_id", "seq", F.expr("CASE seq % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'adjusted' ELSE 'dismissed' END").alias("decision"))
    bad = f.select("doc_id").distinct().filter("doc_id % 9 = 0").select("doc_id", F.lit(0).cast("long").alias("length"), F.lit("a.md").alias("path"), F.lit(None).cast("string").alias("error"))
    failed = Y.parser_findings(bad, None, [".md"]).drop("finding_id")
    done = assessment.run(f, rules(spark), v, MAX_POINTS, failed=failed)["scored"]
    return done.groupBy(F.col("doc_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n_final"), F.count("impact").alias("n_rated"), C.rounded(F.lit(MAX_POINTS) + F.coalesce(F.sum("impact"), F.lit(0.0)), 2).alias("points"), F.array_join(F.array_sort(F.collect_set("judge_status")), ",").alias("statuses"))


# Weights of new codes from those of similar ones (A12), of the real map of similar codes; codes of part types play those with weights.
@query("WITH w AS (SELECT list_extract(['JAK', 'COPY', 'SAZBA', 'IR', 'SHORT', 'OOP', 'BADUML', 'STYLE', 'CONTENT', 'DP'], CAST(p_size % 10 AS INT) + 1) AS code, round(least(greatest(quantile_cont(l_discount, 0.5), 0), 1), 6) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), m AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in V.WEIGHT_NEIGHBOURS.items() for b in bs) + ") AS m(code, near)) SELECT m.code, round(avg(weight), 6) AS weight FROM m JOIN w ON m.near = w.code WHERE m.code NOT IN (SELECT code FROM w) GROUP BY 1")
def q138_inferred_weights(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    code = pick(("JAK", "COPY", "SAZBA", "IR", "SHORT", "OOP", "BADUML", "STYLE", "CONTENT", "DP"), F.col("p_size") % 10)
    w = A.percentiles(rows.select(code.alias("code"), "l_discount"), ["code"], F.col("l_discount"), [0.5])
    w = w.select("code", F.round(F.least(F.greatest(F.col("q")[0], F.lit(0.0)), F.lit(1.0)), 6).alias("weight"))
    near = spark.createDataFrame([(a, b) for a, bs in V.WEIGHT_NEIGHBOURS.items() for b in bs], "code string, near string")
    new = near.join(w.select("code"), "code", "left_anti")
    return new.join(w.withColumnRenamed("code", "near"), "near").groupBy("code").agg(F.round(F.avg("weight"), 6).alias("weight"))


# Students with a bonus (A18, J8), from events of all codes.
@query(f"WITH {GOLD_SQL} SELECT DISTINCT student_id FROM l WHERE code = 'OK' AND l_linenumber % 3 = 0 AND l_suppkey % 5 <> 0 AND l_tax > 0.02")
def q139_bonus_students(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sign = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_tax") > 0.02)
    rows = lines.select(F.col("o_custkey").alias("student_id"), pick(_GOLD_CODES, F.col("l_partkey") % 8).alias("code"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity")).otherwise(-F.col("l_quantity")).alias("impact"), sign.alias("impact_has_sign"))
    return G.bonus_students(rows)
