r"""Queries q156-q179: reports and what readers see, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaya.functions import columns as C
from assaya.operators import findings as O
from assaya.operators import gold as G
from assaya.operators import records as D
from assaya.operators import training as R
from assaya.operators import views as W
from assaya.plans import assessment
from assaya.queries.core import F_SQL, IMPACT_SQL, RULES_SQL, UNIT_SQL, found, query, rules, table, user_hours
from assaya.queries.documents import EVENT_ITEMS_SQL, event_items
from assaya.queries.evaluation import GOLD_SQL, students


def pick(names, index):
    return F.get(F.array(*[F.lit(x) for x in names]), index.cast("int"))


def lines_as_events(spark, d):
    """Order lines as graded events."""
    k = F.col("l_linenumber")
    shared = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("code"), F.when(k % 3 != 0, -F.col("l_quantity")).alias("impact"), shared.alias("impact_shared"), F.when(k % 5 != 0, 100).alias("max_doc_points"), F.when((k % 3 != 0) & (k % 5 != 0), -F.col("l_quantity") / 97).alias("impact_normalised"))


_LINES_SQL = "x AS (SELECT l_partkey AS code, CASE WHEN l_linenumber % 3 <> 0 THEN -l_quantity END AS impact, CASE WHEN l_suppkey % 7 <> 0 THEN l_returnflag = 'R' END AS shared, l_linenumber % 5 <> 0 AS known FROM lineitem)"


# Impacts with and without shared penalties.
@query(f"""WITH {_LINES_SQL}, a AS (SELECT code, avg(CASE WHEN NOT shared THEN impact / 97 END) AS e, avg(impact / 97) AS i FROM x WHERE known AND impact IS NOT NULL GROUP BY 1), t AS (SELECT * FROM a WHERE e IS NOT NULL AND i IS NOT NULL ORDER BY round(abs(i - e), 9) DESC, code LIMIT 15)
SELECT code, 'excl_shared' AS scope, round(e, 6) AS v FROM t UNION ALL SELECT code, 'incl_shared', round(i, 6) FROM t""")
def q156_shared_effect(spark, d):
    return W.shared_effect(W.known_maximum(lines_as_events(spark, d)), 15).select("code", "scope", F.round("impact_normalised", 6).alias("v"))


# Rows for impact statistics (F2), and rows that have what a report needs.
@query(f"WITH {_LINES_SQL} SELECT count(*) FILTER (WHERE impact IS NOT NULL AND NOT shared) AS own, count(*) FILTER (WHERE impact IS NOT NULL) AS every, count(*) FILTER (WHERE impact IS NOT NULL AND known) AS valid FROM x")
def q157_impact_rows(spark, d):
    x = lines_as_events(spark, d)
    assert W.validated(x, ["impact", "absent"]) is None
    kinds = {"own": W.impact_rows(x), "every": W.impact_rows(x, False), "valid": W.validated(x, ["impact", "max_doc_points"])}
    parts = [df.select(F.lit(k).alias("kind")) for k, df in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


# Findings that a reader sees, with dismissed ones.
@query(f"""WITH {RULES_SQL}, {F_SQL}, s AS (SELECT event_id, user_id, event_type, {IMPACT_SQL} AS impact, event_id % 5 = 2 AS dismissed, event_id % 10 = 2 AS also_final FROM f LEFT JOIN rules ON event_type = ac_code),
m AS (SELECT *, false AS candidate FROM s WHERE NOT dismissed OR also_final UNION ALL SELECT *, true FROM s WHERE dismissed AND NOT also_final)
SELECT event_id, user_id AS run, upper(event_type) AS ac_code, impact, candidate AS is_dismissed_candidate, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(abs(impact), 0) DESC, event_id) AS place FROM m WHERE event_type <> 'signup' AND NOT (event_id % 4 = 0 AND event_id % 8 <> 0)""")
def q158_visible_findings(spark, d):
    s = O.score(found(spark, d), rules(spark), "event_type", F.lit(400.0))
    hidden = F.when(F.col("event_type") == "signup", " aidoc ").otherwise(F.upper("event_type"))
    s = s.select("event_id", F.col("user_id").alias("run"), "finding_id", hidden.alias("ac_code"), "impact", F.when(F.col("event_id") % 5 == 2, "judged_dismissed").otherwise("judged_approved").alias("judge_status"))
    final = s.filter("judge_status <> 'judged_dismissed' OR event_id % 10 = 2")
    state = s.filter("event_id % 4 = 0").select("run", "finding_id", (F.col("event_id") % 8 == 0).alias("include"))
    seen = W.visible(final, W.dismissed_candidates(s, final, "run"), state, "run")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("run").orderBy(W.reading_order(), "event_id"))
    return seen.select("event_id", "run", "ac_code", "impact", "is_dismissed_candidate", place.cast("long").alias("place"))


# Titles, options and runs for readers.
@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size % 3 = 0 THEN 'Untitled finding' ELSE p_name END WHEN 1 THEN 'Rubric' WHEN 2 THEN CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END ELSE CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END END AS title,
(SELECT array_to_string(list_concat(['All'], list_sort(list(DISTINCT p_brand))), ',') FROM part) AS options, (SELECT min(q.p_name || ' ' || q.p_partkey) FROM part q WHERE left(q.p_name, 6) = left(part.p_name, 6)) AS run FROM part""")
def q159_reader_lookups(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_size")
    titles = p.select("p_partkey", "p_name", W.criterion_title(F.when(k % 4 == 0, "").otherwise(F.col("p_brand")), F.when(k % 4 == 1, "Rubric").when(k % 4 == 2, ""), F.when(k % 3 != 0, F.col("p_name"))).alias("title"))
    options = W.code_options(p.select(F.col("p_brand").alias("ac_code")))
    runs = p.select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("run"))
    asked = p.select(F.col("p_name").alias("student_id")).distinct()
    return titles.join(F.broadcast(options), F.lit(True)).join(W.run_of_prefix(runs, asked), F.col("p_name") == F.col("student_id")).select("p_partkey", "title", F.array_join("options", ",").alias("options"), "run")


# Mean times of stages by model.
@query("""WITH x AS (SELECT CASE WHEN l_suppkey % 9 > 0 THEN 'm' || l_suppkey % 4 END AS generator_models, l_quantity AS a, CASE WHEN l_partkey % 3 > 0 THEN l_tax END AS b, l_discount AS c FROM lineitem)
SELECT generator_models, round(avg(a), 6) AS parse_time, round(avg(b), 6) AS analyser_time, round(avg(c), 6) AS judge_time FROM x WHERE generator_models IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def q160_stage_means(spark, d):
    x = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 9 > 0, F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string"))).alias("generator_models"), F.col("l_quantity").alias("parse_time"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_tax")).alias("analyser_time"), F.col("l_discount").alias("judge_time"))
    return W.stage_means(x).select("generator_models", *[F.round(c, 6).alias(c) for c in ("parse_time", "analyser_time", "judge_time")])


# Students of each alias, variant, format and models.
@query("""SELECT c_mktsegment AS directory_alias, CASE c_nationkey % 2 WHEN 0 THEN 'par' ELSE 'int' END AS task_variant, CASE c_custkey % 3 WHEN 0 THEN 'pdf' ELSE 'md' END AS doc_type, coalesce(CASE WHEN c_custkey % 5 > 0 THEN 'g' || c_custkey % 2 END, '') AS generator_models, '' AS judge_models, count(*) AS n_students FROM customer WHERE c_custkey % 11 <> 0 GROUP BY 1, 2, 3, 4""")
def q161_scope_counts(spark, d):
    k = F.col("c_custkey")
    x = table(spark, d, "customer").select(F.when(k % 11 != 0, F.col("c_mktsegment")).alias("directory_alias"), F.when(F.col("c_nationkey") % 2 == 0, "par").otherwise("int").alias("task_variant"), F.when(k % 3 == 0, "pdf").otherwise("md").alias("doc_type"), F.when(k % 5 > 0, F.concat(F.lit("g"), (k % 2).cast("string"))).alias("generator_models"))
    return W.scope_counts(x)


# Every column described, numbers and others.
_DESC_NUM = "SELECT '{c}' AS \"column\", count({c}) AS \"count\", NULL::BIGINT AS \"unique\", NULL::VARCHAR AS top, NULL::BIGINT AS freq, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS \"min\", quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.75) AS p75, max({c})::DOUBLE AS \"max\" FROM x"
_DESC_TEXT = "SELECT '{c}', count({c}), count(DISTINCT {c}), (SELECT {c} FROM x WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1), (SELECT count(*) FROM x WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM x"


@query("WITH x AS (SELECT o_totalprice, o_custkey, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS o_orderpriority, o_orderstatus FROM orders) " + " UNION ALL ".join([_DESC_NUM.format(c=c) for c in ("o_totalprice", "o_custkey")] + [_DESC_TEXT.format(c=c) for c in ("o_orderpriority", "o_orderstatus")]))
def q162_describe_all(spark, d):
    x = table(spark, d, "orders").select("o_totalprice", "o_custkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderstatus")
    return W.describe_all(x).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


# What an audit of images would cost.
@query("""WITH a AS (SELECT (p_size * 97 + 50)::DOUBLE AS w, (p_partkey % 40 * 83 + 60)::DOUBLE AS h FROM part),
b AS (SELECT CASE WHEN greatest(w, h) > 2048 THEN trunc(w * (2048.0::DOUBLE / greatest(w, h))) ELSE w END AS w, CASE WHEN greatest(w, h) > 2048 THEN trunc(h * (2048.0::DOUBLE / greatest(w, h))) ELSE h END AS h FROM a),
c AS (SELECT CASE WHEN least(w, h) > 768 THEN trunc(w * (768.0::DOUBLE / least(w, h))) ELSE w END AS w, CASE WHEN least(w, h) > 768 THEN trunc(h * (768.0::DOUBLE / least(w, h))) ELSE h END AS h FROM b),
s AS (SELECT count(*) AS n, CAST(sum(ceil(w / 512) * ceil(h / 512) * 170 + 85) AS BIGINT) AS t FROM c)
SELECT n AS images, t + 350 * n AS input_tokens, 100 * n AS output_tokens, round((t + 350 * n) / 1e6 * 1.25, 4) AS input_cost, round(100 * n / 1e6 * 5.0, 4) AS output_cost, round((t + 350 * n) / 1e6 * 1.25 + 100 * n / 1e6 * 5.0, 4) AS total_cost FROM s""")
def q163_audit_cost(spark, d):
    return W.audit_cost(table(spark, d, "part").select((F.col("p_size") * 97 + 50).alias("w"), (F.col("p_partkey") % 40 * 83 + 60).alias("h")), "w", "h")


# Which codes each project has, a column for each.
@query(f"SELECT {UNIT_SQL} AS unit, bool_or(event_type = 'view') AS view, bool_or(event_type = 'error') AS error, false AS absent FROM events GROUP BY 1")
def q164_presence_matrix(spark, d):
    return W.presence_matrix(user_hours(spark, d), "unit", "event_type", ["view", "error", "absent"])


# Codes by how their presence goes with the score.
@query(f"""WITH e AS (SELECT DISTINCT {UNIT_SQL} AS unit, event_type FROM events), c AS (SELECT event_type AS code FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), u AS (SELECT DISTINCT unit, CASE WHEN unit % 9 > 0 THEN (unit * 7919 % 101)::DOUBLE END AS score FROM e),
x AS (SELECT code, score, (EXISTS (SELECT 1 FROM e WHERE e.unit = u.unit AND e.event_type = code))::INT::DOUBLE AS has FROM u, c WHERE score IS NOT NULL)
SELECT code, round(corr(has, score), 6) AS correlation, 'Other' AS code_category FROM x GROUP BY 1""")
def q165_score_correlations(spark, d):
    e = user_hours(spark, d)
    scores = e.select("unit").distinct().withColumn("score", F.when(F.col("unit") % 9 > 0, (F.col("unit") * 7919 % 101).cast("double")))
    return W.score_correlations(e, scores, "unit", "event_type", "score", 3)


# Distinct students, comments and texts, the first row of each.
@query("""WITH a AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey, o_orderstatus), b AS (SELECT text, min(doc_id) AS k FROM documents GROUP BY 1) SELECT 'student' AS kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS firsts FROM a UNION ALL SELECT 'text', count(*), CAST(sum(k) AS BIGINT) FROM b""")
def q166_first_rows(spark, d):
    a = W.first_rows(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], [F.col("o_orderkey")]).select(F.lit("student").alias("kind"), F.col("o_orderkey").alias("k"))
    b = W.first_rows(table(spark, d, "documents"), ["text"], [F.col("doc_id")]).select(F.lit("text").alias("kind"), F.col("doc_id").alias("k"))
    return a.unionByName(b).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("firsts"))


# Images once over all sources, bad ones first.
@query("""WITH x AS (SELECT doc_id, left(text, CAST(doc_id % 4 AS INT)) AS content, doc_id % 3 = 0 AS bad FROM documents) SELECT doc_id, CASE WHEN bad THEN 'BADUML' ELSE 'GOODUML' END AS label, sha256(content) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY NOT bad, doc_id) AS n FROM x) WHERE n = 1""")
def q167_image_dedup(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.expr("left(text, CAST(doc_id % 4 AS INT))").alias("content"), F.when(F.col("doc_id") % 3 == 0, "BADUML").otherwise("GOODUML").alias("label"))
    return R.dedup_by_content(x, "content", [F.col("label") != "BADUML", F.col("doc_id")]).select("doc_id", "label", "content_hash")


# Comments as they are kept.
@query(r"""WITH x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' ; ' || left(text, 20) || ' ,:' WHEN 1 THEN '( ' || replace(replace(left(text, 15), '(', ''), ')', '') || chr(10) || ' x )' WHEN 2 THEN '(a) (b)' WHEN 3 THEN ' ,;: ' ELSE left(text, 40) END AS t FROM documents),
a AS (SELECT doc_id, trim(regexp_replace(t, '\s+', ' ', 'g'), ' ,;:') AS t FROM x), b AS (SELECT doc_id, CASE WHEN regexp_matches(t, '^\([^()]*\)$') THEN trim(substring(t, 2, length(t) - 2), ' ,;:') ELSE t END AS t FROM a) SELECT doc_id, nullif(t, '') AS comment FROM b""")
def q168_clean_comments(spark, d):
    k = F.col("doc_id") % 5
    t = F.when(k == 0, F.concat(F.lit(" ; "), F.substring("text", 1, 20), F.lit(" ,:"))).when(k == 1, F.concat(F.lit("( "), F.translate(F.substring("text", 1, 15), "()", ""), F.lit("\n x )"))).when(k == 2, "(a) (b)").when(k == 3, " ,;: ").otherwise(F.substring("text", 1, 40))
    return table(spark, d, "documents").select("doc_id", C.clean_comment(t).alias("comment"))


# Where snippets stand in markup, equal ones one after the other.
@query("""WITH x AS (SELECT p_partkey AS doc_id, p_size % 3 + 1 AS n, length(p_brand) AS l FROM part) SELECT doc_id, CAST(place AS INT) AS place, CAST(3 + place * (l + 22) AS INT) AS start, CAST(3 + place * (l + 22) + l + 10 AS INT) AS stop FROM (SELECT *, unnest(range(0, n)) AS place FROM x)""")
def q169_found_snippets(spark, d):
    n = (F.col("p_size") % 3 + 1).cast("int")
    html = F.concat(F.lit("<p>"), F.repeat(F.concat("p_brand", F.lit(" <b>\n(end)</b></p> <p>")), n))
    snippet = F.concat(F.lit("**"), F.col("p_brand"), F.lit("  (end) ![x](y.png)"))
    x = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), html.alias("html"), F.concat(F.array_repeat(snippet, n), F.array(F.lit("nowhere"), F.lit(" ** "))).alias("ranges"))
    return W.found_snippets(x)


# Items put together to chunks of at most so many words.
@query("""WITH RECURSIVE i AS (SELECT conv_id AS doc_id, turn AS seq, 's' || turn // 3 AS section_path, len(regexp_extract_all(text, '\\S+')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE len(regexp_extract_all(text, '\\S+')) > 0),
r AS (SELECT doc_id, pos, section_path, n AS size, 0 AS chunk, seq AS start FROM i WHERE pos = 1 UNION ALL SELECT i.doc_id, i.pos, i.section_path, CASE WHEN i.section_path = r.section_path AND r.size + i.n <= 120 THEN r.size + i.n ELSE i.n END, CASE WHEN i.section_path = r.section_path AND r.size + i.n <= 120 THEN r.chunk ELSE r.chunk + 1 END, CASE WHEN i.section_path = r.section_path AND r.size + i.n <= 120 THEN r.start ELSE i.seq END FROM r JOIN i ON i.doc_id = r.doc_id AND i.pos = r.pos + 1)
SELECT doc_id, CAST(chunk AS INT) AS chunk, '#/texts/' || start AS cref, section_path, CAST(max(size) AS INT) AS words FROM r GROUP BY doc_id, chunk, start, section_path""")
def q170_chunks(spark, d):
    i = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.concat(F.lit("#/texts/"), F.col("turn").cast("string")).alias("cref"), F.concat(F.lit("s"), F.floor(F.col("turn") / 3).cast("string")).alias("section_path"), "text")
    return W.chunks(i, 120).select("doc_id", "chunk", "cref", "section_path", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("words"))


# Analysers in the configuration's order, one that isn't registered, one that can't run, one that is off.
@query(f"""WITH {EVENT_ITEMS_SQL}, t AS (SELECT * FROM i WHERE kind = 'heading' OR kind = 'text' AND label <> 'footnote' AND trim(text) <> ''), n AS (SELECT *, lead(kind) OVER (PARTITION BY doc_id ORDER BY seq) AS nk FROM t)
SELECT 1 AS place, 'structure_analyser' AS analyser_id, 'KAPTXT' AS ac_code, count(*) AS n FROM n WHERE kind = 'heading' AND coalesce(nk, 'heading') = 'heading' UNION ALL SELECT 4, 'asset_analyser', 'UML_MISSING', count(DISTINCT user_id) FROM events WHERE user_id % 2 = 0
UNION ALL SELECT -1, 'nothing', 'not registered', 0 UNION ALL SELECT -1, 'content_analyser', 'KeyError', 0""")
def q171_dispatch(spark, d):
    i = event_items(spark, d)
    docs = i.select("doc_id").distinct()
    tables = {"items": i, "counts": docs.withColumns({"words": F.lit(1), "chars": F.lit(1), "blocks": F.lit(1)}), "pictures": docs.withColumns({"n_pages": F.lit(1), "pictures": F.col("doc_id") % 2, "md_images": F.lit(False), "has_client": F.lit(False), "images_sent": F.lit(0)})}
    r = spark.createDataFrame([("KAPTXT", "Empty", "structure_analyser"), ("UML_MISSING", "No diagram", "asset_analyser"), ("STYLE", "Style", "content_analyser")], "ac_code string, title string, analyser_id string").withColumns({"course": F.lit(None).cast("string"), "language": F.lit(None).cast("string")})
    configs = [{"analyser_id": "nothing"}, {"analyser_id": "structure_analyser"}, {"analyser_id": "grammar_analyser", "enabled": False}, {"analyser_id": "content_analyser"}, {"analyser_id": "asset_analyser"}]
    f, errors = assessment.analyse(tables, r, configs)
    told = spark.createDataFrame([(-1, name, text.split(":")[0], 0) for name, text in errors], "place int, analyser_id string, ac_code string, n long")
    return f.groupBy("place", "analyser_id", "ac_code").agg(F.count(F.lit(1)).alias("n")).unionByName(told)


# Folders of students by the variant's names.
@query("""WITH x AS (SELECT o_custkey AS student_id, CASE o_orderkey % 3 WHEN 0 THEN '2024' WHEN 1 THEN '2023' ELSE 'Unknown' END AS year, CASE o_orderkey % 2 WHEN 0 THEN 'INT' ELSE 'py' END AS v FROM orders GROUP BY 1, 2, 3),
l AS (SELECT 'ipp' || y || '/' || f || '/' || c_custkey AS path FROM customer, (SELECT unnest(['2023', '2024']) AS y), (SELECT unnest(['interpret', 'int', 'py']) AS f) WHERE (c_custkey + length(f)) % 4 > 0)
SELECT CAST(student_id AS VARCHAR) AS student_id, year, v AS task_variant, coalesce(CASE WHEN v = 'INT' THEN (SELECT path FROM l WHERE path = 'ipp' || year || '/interpret/' || student_id) END, (SELECT path FROM l WHERE path = 'ipp' || year || '/' || lower(v) || '/' || student_id)) AS path FROM x
WHERE year <> 'Unknown' AND path IS NOT NULL""")
def q172_student_folders(spark, d):
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("student_id"), pick(("2024", "2023", "Unknown"), k % 3).alias("year"), pick(("INT", "py"), k % 2).alias("task_variant")).distinct()
    c = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.lit("2023"), F.lit("2024"))).alias("y")).select("c_custkey", "y", F.explode(F.array(F.lit("interpret"), F.lit("int"), F.lit("py"))).alias("f")).filter((F.col("c_custkey") + F.length("f")) % 4 > 0)
    folders = c.select(F.concat(F.lit("ipp"), "y", F.lit("/"), "f", F.lit("/"), F.col("c_custkey").cast("string")).alias("path"))
    return W.student_folders(x, folders).select("student_id", "year", "task_variant", "path")


# Images that a document shows and that are there, inside its folder.
@query("""WITH x AS (SELECT p_partkey AS doc_id, 'd' || p_partkey % 9 AS folder, CASE p_size % 6 WHEN 0 THEN 'img/../a.png' WHEN 1 THEN '../d1/a.png' WHEN 2 THEN 'file://b.SVG' WHEN 3 THEN 'c.txt' WHEN 4 THEN '/a.png' ELSE 'missing.png' END AS uri FROM part) SELECT doc_id, folder || CASE WHEN uri LIKE 'img%' THEN '/a.png' ELSE '/b.SVG' END AS file FROM x WHERE uri LIKE 'img%' OR uri LIKE 'file%'""")
def q173_shown_images(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("d"), (F.col("p_partkey") % 9).cast("string")).alias("folder"), pick(("img/../a.png", "../d1/a.png", "file://b.SVG", "c.txt", "/a.png", "missing.png"), F.col("p_size") % 6).alias("uri"))
    listing = x.select(F.explode(F.array(*[F.concat("folder", F.lit(f"/{n}")) for n in ("a.png", "b.SVG", "c.txt")])).alias("path")).distinct()
    return W.inside_listing(x, listing, "folder", "uri").select("doc_id", "file")


# Lines that sum up an evaluation (E5, K7).
@query(f"""WITH {GOLD_SQL}, o AS (SELECT count(*) AS n, sum(overlap_count) AS ov, sum(gold_code_count) AS g FROM st), x AS (SELECT unnest(list_filter(string_split(missed_codes, '|'), lambda c: c <> '')) AS code FROM st), y AS (SELECT unnest(list_filter(string_split(added_codes, '|'), lambda c: c <> '')) AS code FROM st)
SELECT 0 AS part, 'Students evaluated: ' || n AS line FROM o UNION ALL SELECT 0, 'Code overlap vs gold: ' || printf('%.1f', round_even(round(ov / g::DOUBLE, 4) * 100, 1)) || '% (' || ov || '/' || g || ' instances)' FROM o
UNION ALL SELECT 1, 'Top missed codes: ' || string_agg(code || '(' || n || ')', ', ' ORDER BY n DESC, code) FROM (SELECT code, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, code LIMIT 5) UNION ALL SELECT 2, 'Top added codes:  ' || string_agg(code || '(' || n || ')', ', ' ORDER BY n DESC, code) FROM (SELECT code, count(*) AS n FROM y GROUP BY 1 ORDER BY n DESC, code LIMIT 5)""")
def q174_summary_lines(spark, d):
    s = students(spark, d)
    lines = W.summary_lines(G.evaluate(s, {}), G.code_stats(s, []))
    return lines.filter("part > 0 OR place < 2").select("part", "line")


# Variants there are, in the fixed order (R4), and words with the codes that have them most.
@query(r"""WITH w AS (SELECT event, unnest(list_filter(regexp_extract_all(lower(text), '\p{L}{3,}'), lambda x: NOT list_contains(['ale','atp','bez','být','jak','jen','není','nebo','např','pro','také','tak','ten'], x))) AS word FROM (SELECT text, 'c' || conv_id % 5 AS event FROM conversations)),
n AS (SELECT word, event, count(*) AS n FROM w GROUP BY 1, 2), t AS (SELECT word, sum(n) AS total FROM n GROUP BY 1 ORDER BY total DESC, word LIMIT 30), s AS (SELECT word, event, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, event) AS pos FROM n)
SELECT t.word AS keyword, CAST(any_value(total) AS BIGINT) AS count, string_agg(event, ', ' ORDER BY pos) AS top_codes FROM t LEFT JOIN s ON s.word = t.word AND pos <= 3 GROUP BY 1""")
def q175_keyword_codes(spark, d):
    x = table(spark, d, "conversations").select(F.concat(F.lit("c"), (F.col("conv_id") % 5).cast("string")).alias("code"), "text")
    return W.keyword_codes(x, "code", "text", 30)


@query("SELECT CAST(CASE v WHEN 'par' THEN 0 ELSE 1 END AS INT) AS place, v AS task_variant FROM (SELECT DISTINCT CASE WHEN o_orderpriority < '3' THEN 'par' WHEN o_orderpriority < '5' THEN 'int' ELSE 'other' END AS v FROM orders) WHERE v <> 'other'")
def q176_ordered_variants(spark, d):
    """R4."""
    p = F.col("o_orderpriority")
    return W.ordered_variants(table(spark, d, "orders").select(F.when(p < "3", "par").when(p < "5", "int").otherwise("other").alias("task_variant")), "task_variant").select("place", "task_variant")


# Records of documents in an evaluation's columns.
@query("""WITH x AS (SELECT o_orderkey AS doc_id, o_custkey AS c FROM orders)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'md' END AS doc_type, CASE WHEN c % 5 > 0 THEN c / 8.0::DOUBLE END AS cost_eur, CASE WHEN c % 4 > 0 THEN (c % 7) / 4.0::DOUBLE + CASE WHEN c % 4 = 1 THEN (c % 3) / 2.0::DOUBLE ELSE 0 END END AS generator_cost_eur, CASE WHEN c % 2 = 0 THEN (c % 3) / 2.0::DOUBLE END AS judge_cost_eur,
c * 10 AS prompt_tokens, NULL::BIGINT AS completion_tokens, c % 9 AS cached_tokens, CAST(c % 6 + 2 AS BIGINT) AS n_api_calls, 1.5::DOUBLE AS elapsed_seconds, 0.25::DOUBLE AS parse_time, nullif(c % 3 + 0.5 * (c % 2), 0)::DOUBLE AS analyser_time, CASE WHEN c % 2 = 0 THEN 3.5::DOUBLE END AS judge_time, CASE WHEN c % 3 > 0 THEN c END AS total_words, NULL::BIGINT AS total_pictures FROM x""")
def q177_info_fields(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    model = lambda calls, cost: F.struct(calls.alias("calls"), cost.alias("cost_eur"))
    info = F.struct(
        F.struct(F.struct(pick(("application/pdf", "text/markdown", "text/plain"), k % 3).alias("mimetype")).alias("origin")).alias("input"),
        F.struct(F.when(c % 5 > 0, c / 8).alias("total_cost_eur"), (c * 10).alias("total_prompt_tokens"), (c % 9).alias("total_cached_tokens"), F.struct(model(c % 6, (c % 7) / 4).alias("m1"), model(F.lit(2).cast("long"), (c % 3) / 2).alias("m2")).alias("by_model")).alias("usage"),
        F.struct(F.lit(0.25).alias("parse"), (c % 3).cast("double").alias("content_analyser"), (c % 2 * 0.5).alias("score"), F.when(c % 2 == 0, 3.5).alias("judge")).alias("stage_times"), F.lit(1.5).alias("elapsed_seconds"), F.when(c % 3 > 0, F.struct(c.alias("total_words"))).alias("document"),
    )
    x = table(spark, d, "orders").select(k.alias("doc_id"), F.to_json(info).alias("info"), F.when(c % 4 == 1, "m1, m2").when(c % 4 > 1, "m1").otherwise("").alias("generator_models"), F.when(c % 2 == 0, "m2").alias("judge_models"))
    return D.operational_fields(x)


# Pages as a vision model is shown them.
@query("""WITH x AS (SELECT conv_id AS doc_id, turn AS page_no, text FROM conversations WHERE turn % 3 > 0 OR conv_id % 4 = 0) SELECT doc_id, CAST(count(*) AS INT) AS images_sent, md5('[' || string_agg('{"type":"text","text":"[Ref: #/pages/' || page_no || ']"},{"type":"image_url","image_url":{"url":"data:image/png;base64,' || to_base64(encode(text)) || '"}}', ',' ORDER BY page_no) || ',{"type":"text","text":"End."}]') AS content FROM x WHERE doc_id % 5 > 0 GROUP BY 1""")
def q178_page_payload(spark, d):
    shown = (F.col("conv_id") % 5 > 0) & ((F.col("turn") % 3 > 0) | (F.col("conv_id") % 4 == 0))
    x = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.when(shown, F.col("text").cast("binary")).alias("content"))
    p = D.page_payload(x, "End.")
    return p.select("doc_id", "images_sent", F.md5("content").alias("content"))


# Rules that a strict reader takes or not (SRC11, R19).
@query("""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'missing title,missing analyser_id' WHEN 2 THEN 'type ac_code,type is_legacy' WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'value severity_weight' ELSE '' END WHEN 4 THEN 'value course,value backend' WHEN 5 THEN 'unknown extra,unknown other' WHEN 6 THEN 'type severity_weight' ELSE 'no object' END AS errors FROM part""")
def q179_rule_errors(spark, d):
    s = F.col("p_size")
    base = '"title": "t", "ac_code": "C", "prompt_instruction": "p", "analyser_id": "a"'
    signed = F.concat(F.lit("{" + base + ', "severity_weight": '), F.when(s % 2 == 0, F.concat(F.lit("-"), (s + 1).cast("string"))).otherwise(s.cast("string")), F.lit(".5}"))
    texts = [
        F.lit("{" + base + ', "course": null, "language": "en", "requires_pages": true}'), F.lit('{"ac_code": "C", "prompt_instruction": "p", "title": null}'), F.lit('{"title": "t", "ac_code": 7, "prompt_instruction": "p", "analyser_id": "a", "is_legacy": "no"}'), signed,
        F.lit("{" + base + ', "course": "xyz", "backend": "magic"}'), F.lit("{" + base + ', "other": 1, "extra": {}}'), F.lit("{" + base + ', "severity_weight": "1"}'), F.lit("[1]"), F.lit("{broken"),
    ]
    return table(spark, d, "part").select("p_partkey", F.array_join(D.rule_errors(F.get(F.array(*texts), (F.col("p_partkey") % 9).cast("int"))), ",").alias("errors"))
