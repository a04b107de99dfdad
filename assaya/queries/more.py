"""Queries q32-q63 over whole tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaya.functions import columns as C
from assaya.operators import analysers as Y
from assaya.operators import analytics as A
from assaya.operators import findings as O
from assaya.operators import similarity as S
from assaya.operators import text as T
from assaya.operators import training as R
from assaya.queries.core import _CODES, F_SQL, IMPACT_SQL, RULES_SQL, UNIT_SQL, found, q13_set_agreement, q14_stage_survival, query, rules, table, user_hours
from assaya.sources import files
from assaya.sources.scratch import spread


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM benchmark),
x AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 7), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)), y AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 7), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS k FROM b))
SELECT doc_id, item_id, count(*) AS shared FROM x JOIN y USING (g) GROUP BY 1, 2""")
def q32_spec_overlap_text(spark, d):
    return T.shared_shingles(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark"), "doc_id", "item_id")


# Vectors of label 0 are the specification, each other label is a document; even ids are chunks, odd ones sentences, four ids share a place.
SHIFT, LIMITS = 0.55, {"chunk": 0.82, "cover": 0.85, "soft": 0.84, "hard": 0.87}
SIMS_SQL = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT e.label, e.vec_id, s.vec_id AS sid, list_dot_product(e.v, s.v) / sqrt(list_dot_product(e.v, e.v) * list_dot_product(s.v, s.v)) + 0.55 AS sim FROM e JOIN e s ON s.label = 0 AND e.label <> 0 AND s.vec_id % 2 = e.vec_id % 2),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, sid) AS nth, count(*) FILTER (WHERE sim > 0.75) OVER (PARTITION BY vec_id) AS n_over FROM p) WHERE nth = 1)"""


def similarities(spark, d):
    """Nearest specification units of chunks and of sentences, and the coverage of the specification's chunks."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    units, spec = e.filter("label <> 0").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("unit"), "vec"), e.filter("label = 0").select(F.col("vec_id").alias("spec_id"), "vec")
    sides = [S.similarity_maxima(units.filter(f"unit % 2 = {k}"), spec.filter(f"spec_id % 2 = {k}"), SHIFT, 0.75) for k in (0, 1)]
    place = F.concat(F.lit("#/texts/"), F.floor(F.col("unit") / 4).cast("string"))
    return sides[0][0].withColumn("cref", place), sides[1][0].withColumn("cref", place), sides[0][1]


@query(f"WITH {SIMS_SQL} SELECT vec_id, sid AS spec_id, round(sim, 6) AS top_sim, n_over FROM r")
def q33_embedding_similarity(spark, d):
    chunks, sentences, _ = similarities(spark, d)
    return chunks.unionByName(sentences).select(F.col("unit").alias("vec_id"), "spec_id", F.round("sim", 6).alias("top_sim"), "n_over")


SIGNALS_SQL = f"""WITH {SIMS_SQL}, ch AS (SELECT *, vec_id // 4 AS place FROM r WHERE vec_id % 2 = 0), se AS (SELECT *, vec_id // 4 AS place FROM r WHERE vec_id % 2 = 1),
a1 AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE sim > 0.82) AS f, max(sim) AS m FROM ch GROUP BY 1), a2 AS (SELECT label, avg((sim > 0.85)::INT) AS cov FROM (SELECT label, sid, max(sim) AS sim FROM p WHERE vec_id % 2 = 0 GROUP BY 1, 2) GROUP BY 1),
a3 AS (SELECT label, count(*) FILTER (WHERE sim > 0.84) AS s, count(*) FILTER (WHERE sim > 0.87) AS h, max(sim) AS ms FROM se GROUP BY 1), a4 AS (SELECT label, count(*) AS k FROM ch WHERE sim > 0.82 AND (label, place) IN (SELECT (label, place) FROM se WHERE sim > 0.87) GROUP BY 1),
g AS (SELECT a1.label, n, f, m, f / n::DOUBLE AS c, coalesce(cov, 0) AS cov, coalesce(s, 0) AS s, coalesce(h, 0) AS h, coalesce(ms, 0) AS ms, coalesce(k, 0) AS k FROM a1 LEFT JOIN a2 USING (label) LEFT JOIN a3 USING (label) LEFT JOIN a4 USING (label) WHERE n >= 3)"""
CONFIDENCE_SQL = SIGNALS_SQL + """, a AS (SELECT *, c >= 0.25 AS ct, f > 0 OR c >= 0.25 AS ev, least(0.08 * h, 0.3) AS b FROM g),
x1 AS (SELECT *, CASE WHEN m >= 0.95 THEN 0.8 ELSE 0.0 END::DOUBLE AS x FROM a), x2 AS (SELECT * REPLACE (CASE WHEN ct THEN greatest(x, 0.3 + 0.4 * least(c, 1.0)) ELSE x END AS x) FROM x1),
x3 AS (SELECT * REPLACE (CASE WHEN f > 0 AND NOT ct THEN greatest(x, 0.05 + (m - 0.8)) ELSE x END AS x) FROM x2), x4 AS (SELECT * REPLACE (CASE WHEN h > 0 AND ev THEN x + 0.1 + b WHEN h > 0 AND ms >= 0.95 THEN greatest(x, 0.2 + b) ELSE x END AS x) FROM x3),
x5 AS (SELECT * REPLACE (CASE WHEN f > 0 AND s >= 1 THEN greatest(x, 0.15 + least(0.05 * (s - 1), 0.2)) ELSE x END AS x) FROM x4), x6 AS (SELECT * REPLACE (CASE WHEN s >= 3 AND (ev OR s >= 6) THEN greatest(x, 0.12 + least(0.04 * (s - 3), 0.18)) ELSE x END AS x) FROM x5),
x7 AS (SELECT * REPLACE (CASE WHEN k > 0 AND (ct OR f >= 2) THEN x + least(0.1 * k, 0.25) ELSE x END AS x) FROM x6), x8 AS (SELECT * REPLACE (CASE WHEN cov >= 0.24 THEN x + 0.05 ELSE x END AS x), ct::INT + (h > 0 AND ev)::INT + (k > 0)::INT + (m >= 0.95)::INT + (f > 0 AND s >= 1)::INT + (s >= 3 AND ev)::INT AS t FROM x7),
x9 AS (SELECT *, round(least(x * CASE WHEN t >= 3 THEN 1.21 WHEN t >= 2 THEN 1.1 ELSE 1.0 END, 1.0)::DOUBLE, 8) AS confidence,
round(CASE WHEN m >= 0.95 THEN least(0.85 + 0.15 * c, 1.0) WHEN ct AND k > 0 THEN least(0.6 + 0.3 * c, 0.9) WHEN ct THEN least(0.4 + 0.3 * c, 0.75) WHEN h > 0 THEN least(0.3 + 0.05 * h, 0.6) ELSE 0.2 END::DOUBLE, 8) AS severity FROM x8)"""


# Signals of overlap with coverage and sentences (A37, J11, J12) and what follows from them.
@query(CONFIDENCE_SQL + " SELECT label, f, s, h, k, round(m, 6) AS m, round(ms, 6) AS ms, round(c, 6) AS c, round(cov, 6) AS cov, confidence, severity FROM x9")
def q34_copy_confidence(spark, d):
    chunks, sentences, coverage = similarities(spark, d)
    g = Y.copy_signals(chunks, sentences, coverage, LIMITS)
    m, f, c, cov, s, h, ms, k = (F.col(x) for x in ("m", "f", "c", "cov", "s", "h", "ms", "k"))
    g = g.withColumns({"confidence": F.round(C.copy_confidence(m, f, c, cov, s, h, ms, k), 8), "severity": F.round(C.copy_severity(m, c, k, h), 8)})
    r = lambda x: F.round(x, 6).alias(x)
    return g.select(F.col("doc_id").alias("label"), f, s, h, k, r("m"), r("ms"), r("c"), r("cov"), "confidence", "severity")


_EVIDENCE_SQL = """v AS (SELECT label, place, 0 AS rank, sim, vec_id, sid FROM ch WHERE sim > 0.82 UNION ALL SELECT label, place, 1, sim, vec_id, sid FROM se WHERE sim > 0.87),
v1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, place ORDER BY rank, sim DESC, 'u' || vec_id) AS one FROM v) WHERE one = 1), v2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rank, sim DESC, 'u' || vec_id) AS nth FROM v1) WHERE nth <= 5)"""


def evidence(chunks, sentences):
    named = [x.filter(F.col("sim") > LIMITS[at]).withColumn("label", F.lit(kind)) for x, at, kind in ((chunks, "chunk", "sim"), (sentences, "hard", "sent_sim"))]
    return named[0].unionByName(named[1]).withColumns({"text": F.concat(F.lit("u"), F.col("unit").cast("string")), "spec_text": F.concat(F.lit("s"), F.col("spec_id").cast("string"))})


@query(SIGNALS_SQL + f", {_EVIDENCE_SQL} SELECT label, CAST(nth AS INT) AS rank, '#/texts/' || place AS cref, vec_id, sid AS spec_id, round(sim, 6) AS sim FROM v2")
def q35_top_evidence(spark, d):
    chunks, sentences, _ = similarities(spark, d)
    order = [F.col("label") != "sim", F.desc("sim"), F.col("text")]
    one = O.first_by(evidence(chunks, sentences), ["doc_id", "cref"], order)
    return A.top_by(one, ["doc_id"], order, 5).select(F.col("doc_id").alias("label"), "rank", "cref", F.col("unit").alias("vec_id"), "spec_id", F.round("sim", 6).alias("sim"))


@query(f"""WITH p AS (SELECT DISTINCT {UNIT_SQL} AS unit, event_type FROM events), n AS (SELECT count(DISTINCT unit) AS n FROM p), s AS (SELECT event_type, count(*) AS c FROM p GROUP BY 1),
b AS (SELECT x.event_type AS code_a, y.event_type AS code_b, count(*) AS "both" FROM p x JOIN p y ON x.unit = y.unit AND x.event_type < y.event_type GROUP BY 1, 2)
SELECT code_a, code_b, "both", round((n * "both" - a.c * q.c::DOUBLE) / nullif(sqrt(a.c::DOUBLE * q.c * (n - a.c) * (n - q.c)), 0), 6) AS phi FROM b JOIN s a ON code_a = a.event_type JOIN s q ON code_b = q.event_type, n""")
def q36_cooccurrence(spark, d):
    return A.phi(user_hours(spark, d), "unit", "event_type")


@query(f"""WITH t AS (SELECT {UNIT_SQL} AS unit, sum(value) AS total FROM events GROUP BY 1), c AS (SELECT DISTINCT event_type AS code FROM events), p AS (SELECT DISTINCT {UNIT_SQL} AS unit, event_type AS code, 1 AS found FROM events),
x AS (SELECT code, total, (p.found IS NOT NULL)::INT::DOUBLE AS has FROM t CROSS JOIN c LEFT JOIN p USING (unit, code))
SELECT code, round(CASE WHEN var_pop(has) > 0 THEN covar_pop(has, total) / (stddev_pop(has) * stddev_pop(total)) END, 6) AS r FROM x GROUP BY 1""")
def q37_presence_corr(spark, d):
    e = user_hours(spark, d)
    per_user = e.groupBy("unit").agg(F.sum("value").alias("total"), F.collect_set("event_type").alias("codes"))
    names = F.broadcast(e.agg(F.collect_set("event_type").alias("every")))
    x = per_user.join(names, F.lit(True)).select("total", "codes", F.explode("every").alias("code")).withColumn("has", F.array_contains("codes", F.col("code")).cast("double"))
    return x.groupBy("code").agg(F.round(A.safe_corr("has", "total"), 6).alias("r"))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders)
SELECT CASE WHEN o_totalprice <= q[1] THEN 1 WHEN o_totalprice <= q[2] THEN 2 WHEN o_totalprice <= q[3] THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(avg(abs(o_totalprice - q[2])), 4) AS mean_error FROM orders, q GROUP BY 1""")
def q38_quartile_error(spark, d):
    o = table(spark, d, "orders").select("o_totalprice")
    middle = A.percentiles(o, [], F.col("o_totalprice"), [0.5]).select(F.col("q")[0].alias("mid"))
    return A.quartiles(o, "o_totalprice").join(F.broadcast(middle), F.lit(True)).groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("o_totalprice") - F.col("mid"))), 4).alias("mean_error"))


@query("SELECT o_orderkey, o_orderpriority, round(cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice), 8) AS share FROM orders")
def q39_ecdf(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return A.shares(o, ["o_orderpriority"], "o_totalprice").select("o_orderkey", "o_orderpriority", F.round("share", 8).alias("share"))


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS p{round(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM lineitem GROUP BY 1")
def q40_box_stats(spark, d):
    g = A.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), [0.05, 0.25, 0.5, 0.75, 0.95])
    return g.select("l_returnflag", *[F.round(F.col("q")[k], 4).alias(n) for k, n in enumerate(("p05", "p25", "p50", "p75", "p95"))])


@query("WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(floor((o_totalprice - lo) * 30 / (hi - lo)), 29) AS INT) AS bin, count(*) AS n FROM orders, r GROUP BY 1")
def q41_histogram(spark, d):
    return A.histogram(table(spark, d, "orders"), "o_totalprice", 30)


@query(_CODES + "SELECT code, 'precision' AS metric, precision AS v FROM q UNION ALL SELECT code, 'recall', recall FROM q UNION ALL SELECT code, 'f1', f1 FROM q")
def q42_unpivot_metrics(spark, d):
    return q13_set_agreement(spark, d).unpivot("code", ["precision", "recall", "f1"], "metric", "v")


@query(_CODES.replace("WITH ", "WITH s AS (SELECT event_type AS code, count(*) AS raw FROM events GROUP BY 1), ", 1) + ", j AS (SELECT q.code, n_tool, coalesce(raw, 0) AS raw FROM q LEFT JOIN s USING (code)), m AS (SELECT code FROM j ORDER BY greatest(n_tool, raw) DESC, code DESC LIMIT 1) SELECT code, n_tool, raw, code IN (SELECT code FROM m) AS outlier FROM j")
def q43_freq_outlier(spark, d):
    raw = q14_stage_survival(spark, d).select(F.col("event_type").alias("code"), "raw")
    j = q13_set_agreement(spark, d).select("code", "n_tool").join(raw, "code", "left").withColumn("raw", F.coalesce("raw", F.lit(0)))
    top = F.broadcast(j.agg(F.max(F.struct(F.greatest("n_tool", "raw").alias("x"), "code"))["code"].alias("top")))
    return j.join(top, F.lit(True)).select("code", "n_tool", "raw", (F.col("code") == F.col("top")).alias("outlier"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY 2")
def q44_exact_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


@query("""WITH s AS (SELECT DISTINCT source FROM documents), h AS (SELECT source, row_number() OVER (ORDER BY md5('42' || source), source) - 1 AS pos, count(*) OVER () AS n FROM s)
SELECT source, CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 1.0) THEN 'valid' ELSE 'test' END AS split FROM h""")
def q45_group_split(spark, d):
    return R.group_split(table(spark, d, "documents"), "source", "42")


@query("""SELECT l_shipdate, round(avg(CASE WHEN l_returnflag = 'R' THEN l_discount END), 6) AS shared, round(avg(CASE WHEN l_returnflag <> 'R' THEN l_discount END), 6) AS individual FROM lineitem GROUP BY 1
HAVING shared IS NOT NULL AND individual IS NOT NULL ORDER BY abs(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END)) DESC, l_shipdate LIMIT 10""")
def q46_shared_vs_individual(spark, d):
    shared = F.col("l_returnflag") == "R"
    g = table(spark, d, "lineitem").groupBy("l_shipdate").agg(F.round(F.avg(F.when(shared, F.col("l_discount"))), 6).alias("shared"), F.round(F.avg(F.when(~shared, F.col("l_discount"))), 6).alias("individual"), F.abs(F.avg(F.when(shared, F.col("l_quantity")))).alias("o"))
    return g.dropna(subset=["shared", "individual"]).orderBy(F.desc("o"), "l_shipdate").limit(10).drop("o")


@query(f"""WITH {RULES_SQL}, {F_SQL}, s AS (SELECT event_type AS code, event_id % 3 <> 0 AS incl, k / 99.0::DOUBLE AS sev, weight, {IMPACT_SQL} AS impact FROM f LEFT JOIN rules ON event_type = ac_code)
SELECT code, count(*) FILTER (WHERE incl) AS included, count(*) AS total, round(CAST(sum(CASE WHEN incl THEN abs(impact) END) AS DECIMAL(24, 9)), 2)::DOUBLE AS lost,
round(least(1.0, sum(CASE WHEN incl THEN abs(impact) END) / nullif(CASE WHEN max(weight) > 0 THEN max(weight) * 400.0 ELSE max(CASE WHEN sev > 0 THEN abs(impact) / sev END) END, 0)), 4) AS normalised,
CASE WHEN avg(sev) >= 0.85 THEN 'very_high' WHEN avg(sev) >= 0.7 THEN 'high' WHEN avg(sev) >= 0.5 THEN 'medium' WHEN avg(sev) >= 0.3 THEN 'low' ELSE 'very_low' END AS band FROM s GROUP BY 1""")
def q47_ui_summary(spark, d):
    s = O.score(found(spark, d), rules(spark), "event_type", F.lit(400.0)).withColumn("incl", F.col("event_id") % 3 != 0)
    lost = F.sum(F.when(F.col("incl"), F.abs("impact")))
    most = F.nullif(F.when(F.max("severity_weight") > 0, F.max("severity_weight") * 400.0).otherwise(F.max(F.when(F.col("severity") > 0, F.abs("impact") / F.col("severity")))), F.lit(0.0))
    # A share that isn't known is null, although least() passes nulls over.
    share = F.when(F.try_divide(lost, most).isNotNull(), F.least(F.lit(1.0), F.try_divide(lost, most))).otherwise(F.lit(1.0))
    return s.groupBy(F.col("event_type").alias("code")).agg(F.count_if("incl").alias("included"), F.count(F.lit(1)).alias("total"), C.rounded(lost, 2).alias("lost"), F.round(share, 4).alias("normalised"), C.confidence_band(F.avg("severity")).alias("band"))


@query("""WITH x AS (SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS a, CASE WHEN c_nationkey > 3 THEN c_nationkey::VARCHAR END AS b FROM customer)
SELECT coalesce(a, '') AS a, coalesce(b, '') AS b, count(*) AS n FROM x GROUP BY 1, 2""")
def q48_scope_counts(spark, d):
    x = table(spark, d, "customer").select(F.coalesce(F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")), F.lit("")).alias("a"), F.coalesce(F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("string")), F.lit("")).alias("b"))
    return x.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN lpad((o_custkey % 100)::VARCHAR, 2, '0') || lpad(((o_custkey + 1) % 100)::VARCHAR, 2, '0') ELSE year(o_orderdate)::VARCHAR END AS token FROM orders)
SELECT CASE WHEN (left(token, 2)::INT + 1) % 100 = right(token, 2)::INT THEN '20' || left(token, 2) ELSE token END AS year, count(*) AS n FROM t GROUP BY 1""")
def q49_year_token(spark, d):
    two = lambda x: F.lpad((x % 100).cast("string"), 2, "0")
    token = F.when(F.col("o_orderkey") % 2 == 0, F.concat(two(F.col("o_custkey")), two(F.col("o_custkey") + 1))).otherwise(F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").groupBy(C.year_token(token).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT list_extract(['styl', 'PŘED', 'nvi', 'Uml', 'block', 'typ.', 'ok'], CAST(event_id % 7 AS INT) + 1) AS raw FROM events)
SELECT raw, CASE raw WHEN 'styl' THEN 'STYLE' WHEN 'PŘED' THEN 'SAZBA' WHEN 'nvi' THEN 'NV' WHEN 'Uml' THEN 'NOUML' WHEN 'block' THEN 'SAZBA' WHEN 'typ.' THEN 'TYP' ELSE 'OK' END AS code, CASE WHEN raw = 'typ.' THEN 'Other' ELSE 'Doc' END AS category, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def q50_alias_map(spark, d):
    names = F.array(*[F.lit(x) for x in ("styl", "PŘED", "nvi", "Uml", "block", "typ.", "ok")])
    c = table(spark, d, "events").select(F.get(names, (F.col("event_id") % 7).cast("int")).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    code = C.canonical_code(F.col("raw"))
    return c.select("raw", code.alias("code"), C.category(code).alias("category"), "n")


@query(r"""WITH t AS (SELECT doc_id, translate(text, '−–—', '---') AS x FROM documents)
SELECT doc_id, regexp_matches(x, '(?:^|[^\p{L}\p{N}_])(?i:the|style)(?:$|[^\p{L}\p{N}_])') AS long_token, regexp_matches(x, '(?:^|[^\p{L}\p{N}_])Is(?:$|[^\p{L}\p{N}_])') AS short_token FROM t""")
def q51_code_tokens(spark, d):
    x = F.translate("text", "−–—", "---")
    return table(spark, d, "documents").select("doc_id", F.regexp_like(x, F.lit(r"(?U)(?<!\w)(?iu:the|style)(?!\w)")).alias("long_token"), F.regexp_like(x, F.lit(r"(?U)(?<!\w)Is(?!\w)")).alias("short_token"))


@query(f"""WITH {F_SQL}, e AS (SELECT * FROM (VALUES (0, 'STRUCT', 'suffix', -1, false), (1, 'CH', 'paren', -1, false), (2, 'STYLE', 'suffix', -1, true), (2, 'SHORT', 'suffix', -1, true), (3, 'HOV', NULL, NULL, false)) AS e(t, code, impact_source, factor, impact_shared))
SELECT code, impact_source, impact_shared, count(*) AS n, sum(factor * k)::DOUBLE AS impact FROM f JOIN e ON event_id % 4 = t GROUP BY 1, 2, 3""")
def q51_span_events(spark, d):
    """The span grammar over comments that are made from events."""
    e = found(spark, d)
    text = F.concat(F.get(F.array(*[F.lit(x) for x in ("STRUCT -", "CH (-", "STYLE/SHORT -", "HOV see ")]), (F.col("event_id") % 4).cast("int")), F.col("k").cast("string"), F.when(F.col("event_id") % 4 == 1, ") long").otherwise(" rest"))
    rows = e.select(F.col("user_id").cast("string").alias("id"), text.alias("comment"), F.lit("2024").alias("year"), F.lit("int").alias("task_variant"), F.lit("").alias("source_file"), F.lit("1").alias("points"), F.lit("pdf").alias("doc_type"), F.lit(None).cast("string").alias("bonus_points"))
    return files.explode_events(rows).groupBy("code", "impact_source", "impact_shared").agg(F.count(F.lit(1)).alias("n"), F.sum("impact").cast("double").alias("impact"))


@query(f"""WITH {RULES_SQL}, {F_SQL} SELECT event_id, user_id, {IMPACT_SQL} AS impact, round(CAST(400.0 + coalesce(sum({IMPACT_SQL}) OVER (PARTITION BY user_id), 0) AS DECIMAL(24, 9)), 2)::DOUBLE AS doc_points FROM f LEFT JOIN rules ON event_type = ac_code""")
def q52_csv_rows(spark, d):
    return O.csv_rows(O.score(found(spark, d), rules(spark), "event_type", F.lit(400.0)), "user_id", 400.0).select("event_id", "user_id", "impact", "doc_points")


@query("SELECT user_id, string_agg(upper(event_type) || ' (' || event_id || ')', ', ' ORDER BY event_id) AS comment FROM events GROUP BY 1")
def q53_grader_row(spark, d):
    return O.grader_rows(table(spark, d, "events"), "user_id", "event_id", F.concat(F.upper("event_type"), F.lit(" ("), F.col("event_id").cast("string"), F.lit(")")))


@query("""SELECT o_orderkey, 'old' AS run FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' UNION ALL
SELECT o_orderkey, 'new' FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderdate < TIMESTAMP '1998-01-01' AND p.o_orderkey = o.o_orderkey)""")
def q54_seen_incremental(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    done = o.filter("o_orderdate < timestamp_ntz'1998-01-01 00:00:00'").select("o_orderkey")
    return done.withColumn("run", F.lit("old")).unionByName(o.join(done, "o_orderkey", "left_anti").select("o_orderkey", F.lit("new").alias("run")))


@query("SELECT source, CAST(rank AS INT) AS rank, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 3")
def q55_head_per_group(spark, d):
    return A.top_by(table(spark, d, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], 3)


@query("SELECT l_suppkey, CAST(rank AS INT) AS rank, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 5")
def q56_top_per_code(spark, d):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return A.top_by(table(spark, d, "lineitem"), ["l_suppkey"], order, 5).select("l_suppkey", "rank", "l_orderkey", "l_linenumber")


@query("SELECT o_orderpriority, round(regr_slope(o_totalprice, o_custkey), 4) AS slope, round(regr_intercept(o_totalprice, o_custkey), 2) AS intercept FROM orders GROUP BY 1")
def q57_ols_trend(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.regr_slope("o_totalprice", "o_custkey"), 4).alias("slope"), F.round(F.regr_intercept("o_totalprice", "o_custkey"), 2).alias("intercept"))


# Orders play rules of rulebooks, one for each year: the first book that has a code tells its title.
@query("""WITH b AS (SELECT year(o_orderdate) AS file, o_orderkey AS pos, o_custkey % 200 AS code, o_orderpriority || ' ' || o_orderkey AS title FROM orders) SELECT code, title FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY file DESC, pos) AS n FROM b) WHERE n = 1""")
def q58_rubric_priority(spark, d):
    books = table(spark, d, "orders").select(F.year("o_orderdate").alias("file"), F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 200).alias("code"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"))
    return O.first_by(books, ["code"], [F.desc("file"), F.col("pos")]).select("code", "title")


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS half_width FROM orders GROUP BY 1, 2")
def q59_mean_ci(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.lit(1.96) * F.stddev_samp("o_totalprice") / F.sqrt(F.count(F.lit(1))), 4).alias("half_width"))


@query("""WITH p AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN replace(props, '"k"', '"x"') ELSE props END AS props FROM events)
SELECT len(list_filter(json_keys(props), lambda x: x <> 'k')) = 0 AS valid, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k FROM p GROUP BY 1""")
def q60_schema_strict(spark, d):
    props = F.when(F.col("event_id") % 11 == 0, F.replace(F.col("props"), F.lit('"k"'), F.lit('"x"'))).otherwise(F.col("props"))
    p = table(spark, d, "events").select(props.alias("props"))
    return p.groupBy((F.size(files.unknown_keys(F.col("props"), ["k"])) == 0).alias("valid")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.from_json("props", "k int")["k"]).alias("k"))


@query("""WITH x AS (SELECT item_id % 7 AS folder, 'img' || (item_id % 3) || '.png' AS name, item_id FROM benchmark)
SELECT item_id, CASE WHEN n = 1 THEN name ELSE replace(name, '.png', '_' || n || '.png') END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY item_id) AS n FROM x)""")
def q61_unique_names(spark, d):
    x = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 7).alias("folder"), F.concat(F.lit("img"), (F.col("item_id") % 3).cast("string"), F.lit(".png")).alias("name"))
    return R.unique_names(x, "folder", "name", ["item_id"]).select("item_id", "unique_name")


@query("""WITH r AS (SELECT user_id, 'r' || event_id AS id, list_extract(['GOODUML', ' baduml ', 'INVALID', 'odd', NULL], CAST(event_id % 5 AS INT) + 1) AS l FROM events)
SELECT upper(trim(CASE WHEN l = 'odd' THEN NULL ELSE l END)) AS label, count(*) AS n FROM r GROUP BY 1""")
def q62_audit_labels(spark, d):
    names = F.array(*[F.lit(x) for x in ("GOODUML", " baduml ", "INVALID", "odd", None)])
    label = F.get(names, (F.col("event_id") % 5).cast("int"))
    content = F.to_json(F.struct(label.alias("classification"), F.lit("why").alias("analysis")))
    body = F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))
    lines = table(spark, d, "events").select(F.to_json(F.struct(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("custom_id"), F.struct(body.alias("body")).alias("response"))).alias("value"))
    return R.audit_results(lines).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN repeat('#', CAST(1 + turn % 3 AS INT)) || ' H' || turn ELSE replace(text, chr(10), ' ') END, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1)
SELECT conv_id, len(regexp_extract_all(text, '(?m)^#{1,6}\s+\S')) AS headings, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')) AS blanks, len(string_split(text, chr(10))) AS items FROM t""")
def q63_markdown_items(spark, d):
    line = F.when(F.col("role") == "user", F.concat(F.repeat(F.lit("#"), (1 + F.col("turn") % 3).cast("int")), F.lit(" H"), F.col("turn").cast("string"))).otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    docs = table(spark, d, "conversations").select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    i = T.section_paths(T.markdown_items(docs, "conv_id"), "conv_id", "seq")
    return i.groupBy("conv_id").agg(F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "blank").alias("blanks"), F.count(F.lit(1)).alias("items"))

