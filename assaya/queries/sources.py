r"""Queries q140-q155: sources and sinks by round trips through written files, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaya import fixed_values as V
from assaya.operators import analytics as A
from assaya.operators import training as R
from assaya.queries.core import F_SQL, found, query, table
from assaya.sources import files, runs
from assaya.sources.scratch import scratch


def pick(names, index):
    return F.get(F.array(*[F.lit(x) for x in names]), index.cast("int"))


# Grader files to events: all cases of the comments' grammar (SRC5, SNK2, E6, E7, J14, O10, R9, W5, W6, X1, X2, X4, X5).
_COMMENTS = ("STRUCT –@ (note), SHORT", "-@ CH, STYLE (-@ long sentences)", "STRUCT/SHORT −@", "HOV (see CH)", "ok ch", "STYLE (-@ and -3)", "IR (0) fine", "+@ styl", "UML & EX: -@", "ČCH -@", "Block -@. nv")
_EVENTS_SQL = """SELECT * FROM (VALUES (0, 'STRUCT', 'suffix', -1, true, false), (0, 'SHORT', NULL, NULL, NULL, false), (1, 'CH', 'prefix', -1, true, false), (1, 'STYLE', 'paren', -1, true, false), (2, 'STRUCT', 'suffix', -1, true, true), (2, 'SHORT', 'suffix', -1, true, true), (3, 'HOV', NULL, NULL, NULL, false),
(5, 'STYLE', NULL, NULL, NULL, false), (6, 'IR', 'paren', 0, false, false), (7, 'STYLE', 'prefix', 1, true, false), (8, 'UML', 'suffix', -1, true, true), (8, 'EX', 'suffix', -1, true, true), (10, 'BLOK', 'suffix', -1, true, false)) AS e(t, code, source, factor, has_sign, shared)"""


@query(f"""WITH {F_SQL}, e AS ({_EVENTS_SQL}) SELECT CAST(event_id AS VARCHAR) AS id, '2024' AS year, 'int' AS task_variant, code, (factor * k)::DOUBLE AS impact, source AS impact_source, coalesce(has_sign, false) AS impact_has_sign, shared AS impact_shared, 'ipp2024-int.csv' AS source_file,
CASE WHEN event_id % 3 = 0 THEN NULL ELSE k / 2.0::DOUBLE END AS doc_points FROM f JOIN e ON event_id % 11 = t""")
def q140_grader_events(spark, d):
    text = F.replace(pick(_COMMENTS, F.col("event_id") % 11), F.lit("@"), F.col("k").cast("string"))
    rows = found(spark, d).select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 3 == 0, "bad").otherwise((F.col("k") / 2).cast("string")).alias("points"), text.alias("comment"), F.lit("pdf").alias("doc_type"), F.lit("").alias("bonus_points"), F.lit("x").alias("left_out"))
    path = scratch(spark, "graders")
    files.write_csv(rows, f"{path}/ipp2024-int.csv", ["id", "points", "comment", "doc_type", "bonus_points"])
    e = files.grader_events(spark, f"{path}/ipp*.csv")
    return e.select("id", "year", "task_variant", "code", F.col("impact").cast("double").alias("impact"), "impact_source", F.coalesce("impact_has_sign", F.lit(False)).alias("impact_has_sign"), "impact_shared", "source_file", "doc_points")


# Documents of the folders of a run, and placeholders (SRC1).
_LISTING_SQL = "l AS (SELECT p_partkey AS k, '/in/' || CASE WHEN p_partkey % 50 = 49 THEN 'deep/er/' ELSE '' END || 's' || p_partkey % 40 || '/' || CASE p_partkey % 6 WHEN 0 THEN 'b' WHEN 1 THEN 'doc' WHEN 2 THEN 'a' ELSE 'z' || p_partkey END || CASE p_partkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' WHEN 2 THEN '.MD' ELSE '.png' END AS path FROM part)"


@query(f"""WITH {_LISTING_SQL}, p AS (SELECT path, string_split(substring(path, 5), '/') AS parts FROM l), r AS (SELECT path, parts[1] AS folder, len(parts) - 1 AS depth, parts[-1] AS name FROM p),
x AS (SELECT *, CASE WHEN depth > 1 THEN NULL WHEN regexp_replace(name, '\\.[^.]*$', '') = 'doc' THEN 0 WHEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) IN ('.pdf', '.md') THEN 1 END AS rank FROM r)
SELECT folder AS student_id, coalesce(arg_min(path, (rank, name)) FILTER (WHERE rank IS NOT NULL), '/in/' || folder || '/doc') AS path FROM x GROUP BY 1""")
def q141_case_discovery(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 6 == 0, "b").when(k % 6 == 1, "doc").when(k % 6 == 2, "a").otherwise(F.concat(F.lit("z"), k.cast("string"))), pick((".pdf", ".txt", ".MD", ".png"), k % 4))
    path = F.concat(F.lit("/in/"), F.when(k % 50 == 49, "deep/er/").otherwise(""), F.lit("s"), (k % 40).cast("string"), F.lit("/"), name)
    allowed = spark.range(1).select(files.extensions(F.array(F.lit("PDF"), F.lit(".md"), F.lit(" pdf"))).alias("x")).first()["x"]
    return files.discover(table(spark, d, "part").select(path.alias("path")), "/in", "doc", allowed).select("student_id", "path")


# Extensions as they are compared (SRC2).
@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md,.' || p_size ELSE '.txt,.pdf' END AS extensions FROM part")
def q142_extensions(spark, d):
    s = F.col("p_size")
    names = F.when(s % 3 == 0, F.array(F.lit("PDF"), F.lit(".pdf"))).when(s % 3 == 1, F.array(F.lit(" Md"), F.concat(F.lit("."), s.cast("string")), F.lit("md"))).otherwise(F.array(F.lit("TXT"), F.lit("pdf")))
    return table(spark, d, "part").select("p_partkey", F.array_join(files.extensions(names), ",").alias("extensions"))


# Stage files of a run: five for a student, defaults for those that aren't there, students without final findings (SRC7, SRC10, SRC12, SNK1).
@query(f"""WITH {F_SQL}, n AS (SELECT user_id, count(*) AS n FROM f GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS student_id, user_id % 7 = 3 AS skipped, CASE WHEN user_id % 7 <> 3 THEN CASE WHEN user_id % 7 = 1 THEN 0 ELSE n END END AS n_final, CASE WHEN user_id % 7 <> 3 THEN CASE WHEN user_id % 2 = 0 THEN n ELSE 0 END END AS n_raw, CASE WHEN user_id % 7 <> 3 THEN CASE WHEN user_id % 3 = 0 THEN 'sk' END END AS language,
array_to_string(list_filter([CASE WHEN user_id % 2 = 0 THEN 'raw' END, CASE WHEN user_id % 7 <> 3 THEN 'final' END, CASE WHEN user_id % 3 = 0 THEN 'ir' END], lambda x: x IS NOT NULL), ',') AS stages FROM n""")
def q143_run_stages(spark, d):
    one = F.struct(F.concat(F.lit("A-"), F.col("event_id").cast("string")).alias("finding_id"), F.col("event_type").alias("ac_code"), (F.col("k") / 99).alias("severity"))
    by = found(spark, d).groupBy(F.col("user_id").alias("student_id")).agg(F.to_json(F.collect_list(one)).alias("list"))
    u = F.col("student_id")
    written = by.select(u, F.explode(F.array_compact(F.array(
        F.when(u % 7 == 1, F.struct(F.lit("findings.json").alias("file"), F.lit("[]").alias("value"))).when(u % 7 != 3, F.struct(F.lit("findings.json").alias("file"), F.col("list").alias("value"))),
        F.when(u % 2 == 0, F.struct(F.lit("raw_findings.json").alias("file"), F.col("list").alias("value"))), F.when(u % 3 == 0, F.struct(F.lit("ir.json").alias("file"), F.lit('{"language": "sk"}').alias("value"))), F.struct(F.lit("notes.txt").alias("file"), F.lit("x").alias("value")),
    ))).alias("x")).select("student_id", "x.file", "x.value")
    path = scratch(spark, "stages")
    written.write.partitionBy("student_id", "file").text(path)
    stages = runs.stage_files(spark, path, folders=True)
    students = by.select(u.cast("string").alias("student_id"))
    loaded, skipped = runs.runs(stages, students)
    got = loaded.select("student_id", F.lit(False).alias("skipped"), F.size("final").cast("long").alias("n_final"), F.size("raw").cast("long").alias("n_raw"), F.get_json_object("ir", "$.language").alias("language"))
    every = got.unionByName(skipped.select("student_id", F.lit(True).alias("skipped")), allowMissingColumns=True)
    return every.join(runs.available(stages), "student_id", "left").select("student_id", "skipped", "n_final", "n_raw", "language", F.coalesce(F.array_join("stages", ","), F.lit("")).alias("stages"))


# An earlier run's findings, or null where the file isn't a list of findings (SRC12).
@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 3 THEN 0 END AS n FROM events")
def q144_existing_findings(spark, d):
    ok = F.concat(F.lit('[{"finding_id":"A-'), F.col("event_id").cast("string"), F.lit('","ac_code":"CH"}]'))
    text = F.when(F.col("event_id") % 5 == 0, ok).when(F.col("event_id") % 5 == 1, '{"finding_id": "A-1"}').when(F.col("event_id") % 5 == 2, '[{"ac_code": "CH"}]').when(F.col("event_id") % 5 == 3, " []").otherwise("[{broken")
    return table(spark, d, "events").select("event_id", F.size(files.existing_findings(text)).alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


# Evaluation rows from CSV: numbers, flags, names of models, percentages (SRC8, F19, X28).
@query("""SELECT CAST(o_orderkey AS VARCHAR) AS student_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 400)::DOUBLE END AS doc_points, (o_custkey % 3 * 100)::DOUBLE AS max_doc_points, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_gold_bonus, CASE o_orderkey % 2 WHEN 0 THEN 'Model One, m2' ELSE 'm2' END AS generator_models,
round(CASE WHEN o_custkey % 3 > 0 AND o_orderkey % 9 <> 0 THEN (o_orderkey % 400) / (o_custkey % 3 * 100.0::DOUBLE) * 100 END, 6) AS doc_points_pct FROM orders""")
def q145_evaluation_csv(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        k.alias("student_id"), F.when(k % 9 == 0, "n/a").otherwise((k % 400).cast("string")).alias("doc_points"), (F.col("o_custkey") % 3 * 100).alias("max_doc_points"), pick(("True", "False", "?"), k % 3).alias("has_gold_bonus"), pick(("m1, m2", "m2"), k % 2).alias("generator_models"),
    )
    path = scratch(spark, "evaluation")
    files.write_csv(o, path)
    e = runs.evaluation_csv(spark, path, {"m1": "Model One"})
    return e.select("student_id", "doc_points", "max_doc_points", "has_gold_bonus", "generator_models", F.round("doc_points_pct", 6).alias("doc_points_pct"))


# Timings of a parser with the order of its modes (SRC9, A27).
@query("""WITH x AS (SELECT list_extract(['base', 'tables', 'ocr', 'both', 'other'], CAST(l_linenumber % 5 AS INT) + 1) AS mode, l_quantity AS s FROM lineitem)
SELECT mode, CASE mode WHEN 'base' THEN 1 WHEN 'tables' THEN 2 WHEN 'ocr' THEN 3 WHEN 'both' THEN 4 END::INT AS mode_order, count(*) AS n, round(avg(s), 4) AS mean, round(quantile_cont(s, 0.95), 4) AS p95 FROM x GROUP BY 1, 2""")
def q146_parser_timings(spark, d):
    path = scratch(spark, "timings")
    files.write_csv(table(spark, d, "lineitem").select(pick(("base", "tables", "ocr", "both", "other"), F.col("l_linenumber") % 5).alias("mode"), F.col("l_quantity").alias("elapsed_seconds")), path)
    t = runs.parser_timings(spark, path)
    return A.timing_stats(t, ["mode", "mode_order"], "elapsed_seconds", {"p95": 0.95})


# A manifest of images in JSON lines without those whose file is missing (SRC13, SNK6, X35); nulls aren't written.
@query("SELECT 's' || item_id AS student_id, '/img/' || item_id || '.png' AS image_path, CASE WHEN item_id % 2 = 0 THEN 'a' || item_id END AS analysis, item_id % 2 = 0 AS line_has_analysis FROM benchmark WHERE item_id % 3 <> 0")
def q147_manifest(spark, d):
    k = F.col("item_id").cast("string")
    b = table(spark, d, "benchmark").select(F.concat(F.lit("s"), k).alias("student_id"), F.concat(F.lit("/img/"), k, F.lit(".png")).alias("image_path"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("a"), k)).alias("analysis"))
    path = scratch(spark, "manifest")
    files.write_json(b, path)
    there = b.filter("cast(substring(student_id, 2) AS bigint) % 3 <> 0").select(F.col("image_path").alias("path"))
    lines = spark.read.text(path).select(F.get_json_object("value", "$.image_path").alias("image_path"), F.contains("value", F.lit('"analysis"')).alias("line_has_analysis"))
    return files.manifest(spark, path, there).select("student_id", "image_path", "analysis").join(lines, "image_path").select("student_id", "image_path", "analysis", "line_has_analysis")


# Results of a batch, lines that are no JSON, and the audit's counters (SRC14, X34, A39, J10, E10).
_RESULT_SQL = "r AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'broken' WHEN event_id % 11 = 0 THEN 'blank' ELSE 'ok' END AS line, list_extract(['GOODUML', 'BADUML', 'INVALID', 'odd'], CAST(event_id % 4 AS INT) + 1) AS label, event_id % 7 <> 0 AS mapped, event_id % 5 <> 0 AS there, CASE event_id % 3 WHEN 0 THEN 'BADUML' ELSE 'gooduml' END AS old FROM events)"


@query(f"""WITH {_RESULT_SQL} SELECT count(*) FILTER (WHERE line <> 'blank') AS processed, count(*) FILTER (WHERE line = 'broken' OR line = 'ok' AND label = 'odd') AS parse_failures, count(*) FILTER (WHERE line = 'ok' AND label = 'INVALID') AS invalid, count(*) FILTER (WHERE line = 'ok' AND label IN ('GOODUML', 'BADUML') AND NOT (mapped AND there)) AS unresolved,
count(*) FILTER (WHERE line = 'ok' AND label = 'GOODUML' AND mapped AND there) AS good, count(*) FILTER (WHERE line = 'ok' AND label = 'BADUML' AND mapped AND there) AS bad, count(*) FILTER (WHERE line = 'ok' AND label IN ('GOODUML', 'BADUML') AND mapped AND there AND upper(old) <> label) AS conflicts FROM r""")
def q148_audit(spark, d):
    k = F.col("event_id")
    content = F.to_json(F.struct(pick(("gooduml", " BADUML", "INVALID", "odd"), k % 4).alias("classification"), F.lit("why").alias("analysis")))
    body = F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))
    ok = F.to_json(F.struct(F.concat(F.lit("r"), k.cast("string")).alias("custom_id"), F.struct(body.alias("body")).alias("response")))
    path = scratch(spark, "batch")
    table(spark, d, "events").select(F.when(k % 13 == 0, "{broken").when(k % 11 == 0, " ").otherwise(ok).alias("value")).write.text(path)
    ids = table(spark, d, "events").filter(k % 7 != 0).select(F.concat(F.lit("r"), k.cast("string")).alias("custom_id"), F.concat(F.lit("/src/"), k.cast("string")).alias("source_path"), F.when(k % 3 == 0, "BADUML").otherwise("gooduml").alias("label"))
    there = table(spark, d, "events").filter(k % 5 != 0).select(F.concat(F.lit("/src/"), k.cast("string")).alias("path"))
    return R.audit_counts(R.audited(runs.batch_results(spark, path), ids, there))


# Vectors of a specification, kept by model and content (SRC15).
@query("SELECT vec_id AS unit_idx, 'u' || vec_id AS text, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings WHERE label = 3")
def q149_vector_cache(spark, d):
    path = scratch(spark, "vectors")
    e = table(spark, d, "embeddings").select(F.lit("chunk").alias("kind"), F.col("vec_id").alias("unit_idx"), F.lit("#/texts/1").alias("cref"), F.concat(F.lit("u"), F.col("vec_id").cast("string")).alias("text"), F.col("embedding").alias("vec"), "label")
    for label in (2, 3):
        runs.write_vectors(e.filter(F.col("label") == label), path, "m", f"h{label}")
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return runs.cached_vectors(spark, path, "m", "h3").select("unit_idx", "text", F.round(total, 5).alias("total"))


# Images of a listing with their folder's label (SRC16, R6).
@query("""WITH l AS (SELECT p_partkey AS k, list_extract(['baduml', 'gooduml/deep', 'else', '__MACOSX', 'gooduml/__MACOSX', 'gooduml'], CAST(p_partkey % 6 AS INT) + 1) || '/' || CASE WHEN p_partkey % 5 = 0 THEN '.' ELSE '' END || 'x' || p_partkey || list_extract(['.png', '.JPG', '.pdf'], CAST(p_size % 3 AS INT) + 1) AS name, p_size AS length FROM part)
SELECT name, CASE WHEN name LIKE 'baduml/%' THEN 'BADUML' ELSE 'GOODUML' END AS label, CAST(length AS BIGINT) AS length FROM l WHERE (name LIKE 'baduml/%' OR name LIKE 'gooduml/%') AND name NOT LIKE '%__MACOSX/%' AND name NOT LIKE '%/.%' AND lower(name) NOT LIKE '%.pdf'""")
def q150_labelled_images(spark, d):
    k = F.col("p_partkey")
    name = F.concat(pick(("baduml", "gooduml/deep", "else", "__MACOSX", "gooduml/__MACOSX", "gooduml"), k % 6), F.lit("/"), F.when(k % 5 == 0, ".").otherwise(""), F.lit("x"), k.cast("string"), pick((".png", ".JPG", ".pdf"), F.col("p_size") % 3))
    listing = table(spark, d, "part").select(F.concat(F.lit("file:/data/images/"), name).alias("path"), F.col("p_size").cast("long").alias("length"))
    return runs.labelled(listing, "/data/images", {"baduml": "BADUML", "gooduml": "GOODUML"}).select("name", "label", "length")


# Text in three encodings (SRC4).
@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7Féáíóúüöäç]', '?', 'g') AS text FROM documents) SELECT doc_id, md5(text) AS text, CASE doc_id % 3 WHEN 1 THEN 'utf-16' WHEN 2 THEN CASE WHEN regexp_matches(text, '[éáíóúüöäç]') THEN 'windows-1250' ELSE 'utf-8' END ELSE 'utf-8' END AS encoding FROM t""")
def q151_charsets(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^\\x00-\\x7Féáíóúüöäç]", "?").alias("text"))
    utf8, utf16, central = F.encode("text", "UTF-8"), F.encode("text", "UTF-16"), F.encode(F.translate("text", files._CENTRAL, files._LATIN), "ISO-8859-1")
    got = files.decoded(F.when(F.col("doc_id") % 3 == 0, utf8).when(F.col("doc_id") % 3 == 1, utf16).otherwise(central))
    return t.select("doc_id", got.alias("x")).select("doc_id", F.md5("x.text").alias("text"), "x.encoding")


# Clean events from CSV (SRC6, J1, F3, X6).
_MAXIMA = ", ".join(f"('{y}', '{v}', {p})" for y, v, p in V.MAX_DOC_POINTS)


@query(f"""WITH m AS (SELECT * FROM (VALUES {_MAXIMA}) AS m(year, task_variant, max_doc_points)), x AS (SELECT o_orderkey AS id, list_extract(['2013', '2021', '2024', 'Unknown'], CAST(o_custkey % 4 AS INT) + 1) AS token, list_extract(['int', 'par', 'php'], CAST(o_orderkey % 3 AS INT) + 1) AS task_variant, CASE WHEN o_orderkey % 5 > 0 THEN -(o_orderkey % 50)::DOUBLE END AS impact, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM orders),
y AS (SELECT *, CASE WHEN token = '2021' THEN '2020' ELSE token END AS year FROM x) SELECT CAST(id AS VARCHAR) AS id, y.year, y.task_variant, impact, flag AS impact_shared, CAST(max_doc_points AS INT) AS max_doc_points, round(impact / max_doc_points, 8) AS impact_normalised FROM y LEFT JOIN m ON y.year = m.year AND y.task_variant = m.task_variant""")
def q152_clean_events(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("id"), pick(("2013", "2021", "2024", "Unknown"), F.col("o_custkey") % 4).alias("year"), pick(("int", "par", "php"), k % 3).alias("task_variant"), F.when(k % 5 > 0, (-(k % 50)).cast("string")).otherwise("x").alias("impact"), pick(("True", "False", "", "n/a"), k % 4).alias("impact_shared"))
    path = scratch(spark, "clean")
    files.write_csv(o, path)
    return files.clean_events(spark, path).select("id", "year", "task_variant", "impact", "impact_shared", "max_doc_points", F.round("impact_normalised", 8).alias("impact_normalised"))


# JSON documents for readers: two blanks a level, no nulls (SNK1, X35).
@query("""SELECT event_id, '{' || chr(10) || '  "finding_id": "A-' || event_id || '",' || chr(10) || CASE WHEN event_id % 2 = 0 THEN '  "summary": "é ' || event_type || '",' || chr(10) ELSE '' END || '  "anchors": [' || chr(10) || '    {' || chr(10) || '      "page": ' || event_id % 7 || chr(10) || '    }' || chr(10) || '  ]' || chr(10) || '}' AS text FROM events""")
def q153_json_documents(spark, d):
    k = F.col("event_id")
    one = F.struct(F.concat(F.lit("A-"), k.cast("string")).alias("finding_id"), F.when(k % 2 == 0, F.concat(F.lit("é "), F.col("event_type"))).alias("summary"), F.array(F.struct((k % 7).alias("page"))).alias("anchors"))
    return table(spark, d, "events").select("event_id", files.indented(F.to_json(one)).alias("text"))


# Requests that show a model an image, and conversations of a training file (R7, R8, SNK6, E11).
@query("""WITH x AS (SELECT item_id, 'data:' || CASE item_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'image/webp' END || ';base64,' || to_base64(encode(text)) AS url FROM benchmark WHERE octet_length(encode(text)) > 0 AND octet_length(encode(text)) <= 300)
SELECT item_id, md5('{"custom_id":"r' || item_id || '","method":"POST","url":"/v1/chat/completions","body":{"model":"m","temperature":0,"response_format":{"type":"json_object"},"messages":[{"role":"system","content":"Say \\"x\\""},{"role":"user","content":[{"type":"text","text":"Judge."},{"type":"image_url","image_url":{"url":"' || url || '","detail":"high"}}]}]}}') AS request,
md5('{"messages":[{"role":"system","content":"Say \\"x\\""},{"role":"user","content":[{"type":"text","text":"Judge."},{"type":"image_url","image_url":{"url":"' || url || '","detail":"high"}}]},{"role":"assistant","content":"' || CASE WHEN item_id % 2 = 0 THEN 'BADUML' ELSE 'GOODUML' END || '"}]}') AS entry FROM x""")
def q154_image_requests(spark, d):
    k = F.col("item_id")
    b = table(spark, d, "benchmark").select(k, F.concat(F.lit("r"), k.cast("string")).alias("custom_id"), F.concat(F.lit("/i/"), k.cast("string"), pick((".PNG", ".jpg", ".webp"), k % 3)).alias("path"), F.col("text").cast("binary").alias("content"))
    b = R.within_size(b.withColumn("length", F.length("content")), 300)
    say, prompt = 'Say "x"', "Judge."
    r = files.image_requests(b, "m", say, prompt, '{"type":"json_object"}')
    url = F.regexp_extract("value", r'"url":"(data:[^"]*)"', 1)
    both = r.join(b.select("custom_id", "item_id"), "custom_id")
    return both.select("item_id", F.md5("value").alias("request"), F.md5(files.training_entry(url, F.when(k % 2 == 0, "BADUML").otherwise("GOODUML"), say, prompt)).alias("entry"))


# Paths of images: tokens, the gate of small sides and the sizes after shrinking, folders of students.
@query("""WITH x AS (SELECT p_partkey AS k, 'Docs\\' || CASE WHEN p_partkey % 3 = 0 THEN 'A b-' ELSE '_x' END || p_partkey || '.PNG' AS path, p_size * 97 + 50 AS w, p_partkey % 40 * 83 + 60 AS h FROM part)
SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN 'a_b_' || k ELSE 'x' || k END AS stem, CASE WHEN greatest(w, h) > 2048 THEN CAST(trunc(w * (2048.0::DOUBLE / greatest(w, h))) AS BIGINT) ELSE w END AS width, CASE WHEN greatest(w, h) > 2048 THEN CAST(trunc(h * (2048.0::DOUBLE / greatest(w, h))) AS BIGINT) ELSE h END AS height FROM x WHERE least(w, h) >= 128""")
def q155_image_paths(spark, d):
    k = F.col("p_partkey")
    x = table(spark, d, "part").select(k, F.concat(F.lit("Docs\\"), F.when(k % 3 == 0, "A b-").otherwise("_x"), k.cast("string"), F.lit(".PNG")).alias("path"), (F.col("p_size") * 97 + 50).alias("w"), (k % 40 * 83 + 60).alias("h"))
    kept = R.large_enough(x, "w", "h")
    return kept.select(k, F.regexp_extract(R.path_token(F.col("path")), "^(.*)_[0-9a-f]{8}$", 1).alias("stem"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
