"""Queries q100-q111 over whole tables, each with its SQL twin: text repair, identifiers, paths, notes, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaya.functions import columns as C
from assaya.operators import analytics as A
from assaya.operators import training as R
from assaya.queries.core import query, table


# Texts as a PDF gives them: marks before their letters, some with a space between.
@query("""WITH x AS (SELECT doc_id, replace(replace(replace(text, 'ó', '´o'), 'í', '´ i'), 'ö', '¨o') AS text FROM documents),
t AS (SELECT doc_id, translate(text, 'ıˇ´˚¨ˆ', 'i' || chr(780) || chr(769) || chr(778) || chr(776) || chr(770)) AS text FROM x),
j AS (SELECT doc_id, regexp_replace(text, '([' || chr(780) || chr(769) || chr(778) || chr(776) || chr(770) || '])\\s+', '\\1', 'g') AS text FROM t),
r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(' || chr(780) || ')([cCdDeEnNrRsStTzZ])', '\\2\\1', 'g'), '(' || chr(769) || ')([aAeEiIyYoOuUlLrR])', '\\2\\1', 'g'), '(' || chr(778) || ')([uU])', '\\2\\1', 'g'), '(' || chr(776) || ')([aA])', '\\2\\1', 'g'), '(' || chr(770) || ')([oO])', '\\2\\1', 'g') AS text FROM j)
SELECT doc_id, sha256(nfc_normalize(text)) AS digest, CAST(length(nfc_normalize(text)) AS BIGINT) AS n_chars FROM r WHERE text IS NOT NULL""".replace("\\\\", "\\"))
def q100_repaired_marks(spark, d):
    """X10."""
    broken = F.replace(F.replace(F.replace("text", F.lit("ó"), F.lit("´o")), F.lit("í"), F.lit("´ i")), F.lit("ö"), F.lit("¨o"))
    x = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", C.repaired_marks(broken).alias("text"))
    return x.select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query(rf"""WITH x AS (SELECT p_partkey, 'the ' || replace(p_name, ' ', '_') || ' MAX_SIZE ( camelCase ) call()x plain' || chr(9) || ' ' AS text FROM part)
SELECT p_partkey, CAST(len(regexp_extract_all(text, '{C.IDENTIFIER}')) AS INT) AS n_names, list_aggregate(regexp_extract_all(text, '{C.IDENTIFIER}'), 'string_agg', ' ') AS names,
CAST(len(regexp_extract_all(text, '\( | \)')) AS INT) AS n_brackets, CAST(len(regexp_extract_all(text, '(?m)[ ]+$')) + len(regexp_extract_all(text, chr(9))) AS INT) AS n_trailing FROM x""")
def q101_identifiers(spark, d):
    """X12, T7."""
    x = table(spark, d, "part").select("p_partkey", F.concat(F.lit("the "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" MAX_SIZE ( camelCase ) call()x plain\t ")).alias("text"))
    text, names = F.col("text"), C.identifiers(F.col("text"))
    return x.select("p_partkey", F.size(names).alias("n_names"), F.array_join(names, " ").alias("names"), C.loose_brackets(text).alias("n_brackets"), C.trailing_space(text).alias("n_trailing"))


@query(r"""WITH x AS (SELECT p_partkey, 'a ![one](img' || p_size || '%20b\c+d.png "title") b ![](<' || p_brand || '>) c [no](link) ![x]()' AS text FROM part)
SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(text, '!\[[^\]]*\]\(\s*<?([^)\s>]+)', 1), lambda u: replace(url_decode(replace(u, '+', '%2B')), '\', '/')), 'string_agg', '|') AS uris FROM x""")
def q102_image_uris(spark, d):
    """X11."""
    text = F.concat(F.lit("a ![one](img"), F.col("p_size").cast("string"), F.lit('%20b\\c+d.png "title") b ![](<'), F.col("p_brand"), F.lit(">) c [no](link) ![x]()"))
    return table(spark, d, "part").select("p_partkey", F.array_join(C.image_uris(text), "|").alias("uris"))


@query(r"""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a/./b//c.png' WHEN 1 THEN 'a/../' || o_orderstatus || '.png' WHEN 2 THEN 'a/../../b.png' ELSE '/etc/x.png' END AS path FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a/b/c.png' WHEN 1 THEN regexp_replace(path, '^a/\.\./', '') END AS resolved FROM x""")
def q103_resolved_paths(spark, d):
    """A path that leaves its folder has none."""
    k = F.col("o_orderkey") % 4
    path = F.when(k == 0, "a/./b//c.png").when(k == 1, F.concat(F.lit("a/../"), F.col("o_orderstatus"), F.lit(".png"))).when(k == 2, "a/../../b.png").otherwise("/etc/x.png")
    return table(spark, d, "orders").select("o_orderkey", C.resolved_path(path).alias("resolved"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) * 4 AS c, CAST(l_tax AS DOUBLE) * 12 AS m, CAST(l_quantity AS INT) % 5 AS s, l_linenumber % 3 AS h, l_suppkey % 3 AS k, l_partkey % 2 AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN m >= 0.95 THEN printf('Near-verbatim chunk detected (sim=%.3f)', m) END, CASE WHEN c >= 0.25 THEN printf('Contamination triggered: %.3f >= 0.25', c) END,
CASE WHEN h > 0 THEN printf('%d hard sentence match(es) (max_sim=%.3f)', h, m) END, CASE WHEN n > 0 AND s >= 2 THEN printf('Localised trigger: %d flagged chunk(s) + %d soft sentence(s)', n, s) END,
CASE WHEN s >= 3 THEN printf('Soft-sentence cluster: %d sentence(s) above 0.75', s) END, CASE WHEN k > 0 THEN printf('%d chunk(s) corroborated by sentence-level evidence', k) END,
CASE WHEN c >= 0.24 THEN printf('Spec coverage triggered: %.3f >= 0.24', c) END) AS notes FROM x""")
def q104_copy_notes(spark, d):
    """X22."""
    c, m = F.col("l_discount").cast("double") * 4, F.col("l_tax").cast("double") * 12
    s, h, k, n = F.col("l_quantity").cast("int") % 5, F.col("l_linenumber") % 3, F.col("l_suppkey") % 3, F.col("l_partkey") % 2
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(C.copy_notes(m, n, c, c, s, h, m, k), "; ").alias("notes"))


@query("""WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_suppkey % 4 AS tool, l_partkey % 4 AS gold, CAST(l_discount AS DOUBLE) - 0.05 AS delta, l_returnflag FROM lineitem)
SELECT l_orderkey, line, CASE WHEN tool > 0 THEN least(tool, gold) / tool::DOUBLE END AS student_precision, CASE WHEN gold > 0 THEN least(tool, gold) / gold::DOUBLE END AS student_recall, round(abs(delta), 6) AS abs_points_delta,
coalesce(nullif(l_returnflag, 'A'), '') || ' | ' || l_returnflag AS grader_judge_pair FROM x""")
def q105_student_metrics(spark, d):
    """F20."""
    tool, gold = F.col("l_suppkey") % 4, F.col("l_partkey") % 4
    delta = F.col("l_discount").cast("double") - 0.05
    x = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("line"), tool.alias("tool_code_count"), gold.alias("gold_code_count"), F.least(tool, gold).alias("overlap_count"),
        delta.alias("points_delta"), delta.alias("points_delta_pct"), F.nullif("l_returnflag", F.lit("A")).alias("generator_models"), F.col("l_returnflag").alias("judge_models"),
    )
    return C.student_metrics(x).select("l_orderkey", "line", "student_precision", "student_recall", F.round("abs_points_delta", 6).alias("abs_points_delta"), "grader_judge_pair")


@query("""SELECT l_orderkey, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag IN ('A', 'N')), 0), 2)::DOUBLE AS generator_cost, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 0), 2)::DOUBLE AS judge_cost FROM lineitem GROUP BY 1""")
def q106_role_cost(spark, d):
    """Costs by the role of a model (X30); the sums combine before the shuffle."""
    cost = lambda *models: F.round(F.coalesce(F.sum(F.when(F.col("l_returnflag").isin(*models), F.col("l_extendedprice"))), F.lit(0)), 2).cast("double")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(cost("A", "N").alias("generator_cost"), cost("R").alias("judge_cost"))


@query("""SELECT o_orderkey, coalesce(labels, 'n/a') AS labels FROM orders LEFT JOIN (SELECT l_orderkey, string_agg('p.' || page, ', ' ORDER BY page) AS labels FROM (SELECT DISTINCT l_orderkey, CAST(l_quantity AS INT) % 4 AS page FROM lineitem WHERE l_returnflag <> 'N') GROUP BY 1) ON o_orderkey = l_orderkey""")
def q107_page_labels(spark, d):
    """R22."""
    pages = table(spark, d, "lineitem").filter("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.collect_set(F.col("l_quantity").cast("int") % 4).alias("pages"))
    return table(spark, d, "orders").join(pages, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", C.page_labels(F.coalesce("pages", F.array().cast("array<int>"))).alias("labels"))


@query("""SELECT r_name, left(string_agg('- ' || n_name || ': ' || n_nationkey, chr(10) ORDER BY n_nationkey), 300) AS prompt, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def q108_rule_prompt(spark, d):
    """Rules of an analyser as text in their order, cut at 300 characters (X39); the rules are a short table."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit("- "), F.col("n_name"), F.lit(": "), F.col("n_nationkey").cast("string"))
    rows = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("rules"), F.count(F.lit(1)).alias("n"))
    return rows.select("r_name", F.left(F.array_join("rules.line", "\n"), F.lit(300)).alias("prompt"), "n")


@query("""SELECT CASE WHEN page_id % 2 = 0 THEN 'GOODUML' ELSE 'BADUML' END AS label, count(*) AS n, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM pages WHERE octet_length(encode(html)) BETWEEN 1 AND 4096 GROUP BY 1""")
def q109_size_gate(spark, d):
    """Records small enough for a training request, by label."""
    x = table(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, "GOODUML").otherwise("BADUML").alias("label"), F.octet_length("html").cast("long").alias("length"))
    return R.within_size(x, 4096).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


_NAMES = {"A": "Air freight", "R": "Road"}


@query("""WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_returnflag || ' ,RAIL' AS models FROM lineitem)
SELECT l_orderkey, line, CASE WHEN models = 'A ,RAIL' THEN 'Air freight' WHEN models = 'R ,RAIL' THEN 'Road' ELSE replace(models, ' ,RAIL', '') END || ', RAIL' AS models FROM x""")
def q110_model_names(spark, d):
    """X28."""
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), C.model_names(F.concat("l_returnflag", F.lit(" ,RAIL")), _NAMES).alias("models"))


@query("""WITH u AS (UNPIVOT (SELECT l_quantity::DOUBLE AS quantity, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax FROM lineitem) ON quantity, discount, tax INTO NAME metric VALUE v)
SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS least, quantile_cont(v, 0.5) AS median, max(v) AS most FROM u GROUP BY 1""")
def q111_describe(spark, d):
    """Count, mean, deviation, bounds and median of every metric in one pass."""
    x = table(spark, d, "lineitem").select(*[F.col(f"l_{n}").cast("double").alias(n) for n in ("quantity", "discount", "tax")])
    v = x.unpivot([], ["quantity", "discount", "tax"], "metric", "v")
    sums = v.groupBy("metric").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))
    return sums.join(A.percentiles(v, ["metric"], F.col("v"), [0.5]), "metric").select("metric", "n", "mean", "std", "least", F.col("q")[0].alias("median"), "most")
