r"""Queries q112-q123: documents to items and findings, each with its SQL twin. Markdown is made from the documents' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaya import fixed_values as V
from assaya.operators import analysers as Y
from assaya.operators import text as T
from assaya.queries.core import query, table
from assaya.queries.more import _EVIDENCE_SQL, CONFIDENCE_SQL, LIMITS, evidence, similarities
from assaya.sources.scratch import spread

NL = "chr(10)"
#: Markdown in the words of both dialects: headings, underlined ones, lists, code, pictures, identifiers, brackets, tabs, blanks at ends.
MD = f"""'# Document ' || CAST(doc_id AS STRING) || {NL}
|| replace(replace(replace(replace(replace(replace(text, '. ', '.' || {NL} || {NL}), ', ', ',' || {NL}), {NL} || 'The ', {NL} || '## The '), {NL} || 'And ', {NL} || '#### And '), {NL} || 'Is ', {NL} || '- Is '), {NL} || 'For ', {NL} || '---' || {NL} || 'For ')
|| CASE WHEN doc_id % 3 = 0 THEN {NL} || {NL} || '![a](d/' || CAST(doc_id % 7 AS STRING) || '.png)' || {NL} || 'runAll and MAX_LEN, see ( there )  ' || {NL} || 'tail ' ELSE '' END
|| CASE WHEN doc_id % 5 = 0 THEN {NL} || '```' || {NL} || '# no_heading  ' || {NL} || '```' || {NL} || 'after `in_code` out_code ' ELSE '' END
|| CASE WHEN doc_id % 4 = 0 THEN {NL} || '| a_b | c |' || {NL} || '| d | e |' || {NL} || chr(9) || 'tab' || {NL} || '===' || {NL} ELSE '' END
|| CASE WHEN doc_id % 6 = 0 THEN {NL} || '***' || {NL} || '2) second ' || {NL} || 'goes on' || {NL} || '## ' || {NL} || '### Last ##' ELSE '' END"""

LINES_SQL = rf"""md AS (SELECT doc_id, {MD} AS text FROM documents), l0 AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM md),
l1 AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, line, regexp_replace(line, '^[ \t]+|[ \t]+$', '', 'g') AS bare FROM l0),
l2 AS (SELECT *, starts_with(bare, '```') AS fence, sum(starts_with(bare, '```')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM l1),
l3 AS (SELECT *, CASE WHEN fence OR fences % 2 = 1 THEN 'code' WHEN bare = '' THEN 'blank' WHEN regexp_matches(bare, '^#{{1,6}}([ \t]|$)') THEN 'heading' WHEN regexp_matches(bare, '^(=+|-+)$') THEN 'line'
 WHEN regexp_matches(bare, '^(-[ \t]*){{3,}}$|^(\*[ \t]*){{3,}}$|^(_[ \t]*){{3,}}$') THEN 'rule' WHEN regexp_matches(bare, '^!\[[^\]]*\]\(') THEN 'picture' WHEN starts_with(bare, '|') THEN 'table' WHEN regexp_matches(bare, '^([-*+]|\d+[.)])[ \t]') THEN 'list' ELSE 'text' END AS k0 FROM l2),
l4 AS (SELECT *, CASE WHEN k0 <> 'line' THEN k0 WHEN lag(k0) OVER (PARTITION BY doc_id ORDER BY line_no) = 'text' THEN 'underline' WHEN regexp_matches(bare, '^-{{3,}}$') THEN 'rule' ELSE 'text' END AS kind FROM l3),
l5 AS (SELECT *, NOT (kind = 'underline' OR kind = 'text' AND coalesce(lag(kind) OVER w, '') IN ('text', 'list') OR kind = 'table' AND coalesce(lag(kind) OVER w, '') = 'table' OR kind = 'code' AND NOT (fence AND fences % 2 = 1)) AS starts FROM l4 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
l6 AS (SELECT *, sum(starts::INT) OVER w AS item_no, max(CASE WHEN starts THEN line_no END) OVER w AS start_line FROM l5 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""
ITEMS_SQL = (
    LINES_SQL
    + r""", i0 AS (SELECT doc_id, item_no, arg_min(kind, line_no) AS k, max(CASE WHEN kind = 'heading' THEN length(regexp_extract(bare, '^(#{1,6})', 1)) WHEN kind = 'underline' THEN CASE WHEN starts_with(bare, '=') THEN 1 ELSE 2 END END) AS level,
 list(CASE WHEN kind = 'heading' THEN regexp_replace(regexp_replace(bare, '^#{1,6}[ \t]*', ''), '[ \t]+#+$', '') WHEN kind = 'list' THEN regexp_replace(bare, '^([-*+]|\d+[.)])[ \t]+', '') WHEN kind = 'code' THEN line ELSE bare END ORDER BY line_no) FILTER (WHERE kind <> 'underline' AND NOT fence) AS said
 FROM l6 WHERE kind NOT IN ('blank', 'rule') GROUP BY 1, 2),
i1 AS (SELECT doc_id, item_no, CASE WHEN level IS NOT NULL THEN 'heading' ELSE k END AS kind, level, coalesce(CASE WHEN level IS NULL AND k IN ('code', 'table') THEN array_to_string(said, chr(10)) ELSE array_to_string(said, ' ') END, '') AS text FROM i0),
items AS (SELECT *, '#/' || CASE kind WHEN 'picture' THEN 'pictures' WHEN 'table' THEN 'tables' ELSE 'texts' END || '/' || (row_number() OVER (PARTITION BY doc_id, CASE kind WHEN 'picture' THEN 1 WHEN 'table' THEN 2 ELSE 3 END ORDER BY item_no) - 1) AS cref FROM i1)"""
)


def markdown(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.expr(MD).alias("text"))


# Items with their section paths (SRC3, T13, W3).
@query(
    "WITH RECURSIVE "
    + ITEMS_SQL
    + r""", h AS (SELECT doc_id, item_no, level, trim(text) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY item_no) AS n FROM items WHERE kind = 'heading' AND trim(text) <> ''),
s AS (SELECT doc_id, n, [text] AS stack FROM h WHERE n = 1 UNION ALL SELECT h.doc_id, h.n, list_append(list_slice(s.stack, 1, h.level - 1), h.text) FROM s JOIN h ON h.doc_id = s.doc_id AND h.n = s.n + 1),
x AS (SELECT *, count(*) FILTER (WHERE kind = 'heading' AND trim(text) <> '') OVER (PARTITION BY doc_id ORDER BY item_no) AS n FROM items)
SELECT x.doc_id, CAST(item_no AS BIGINT) AS seq, cref, kind, CAST(level AS INT) AS level, md5(x.text) AS text, coalesce(array_to_string(stack, ' > '), '') AS section_path FROM x LEFT JOIN s ON x.doc_id = s.doc_id AND x.n = s.n"""
)
def q112_markdown_items(spark, d):
    i = T.section_paths(T.markdown_items(markdown(spark, d)), "doc_id", "seq")
    return i.select("doc_id", "seq", "cref", "kind", "level", F.md5("text").alias("text"), "section_path")


# Counters and the language of documents (A34, X9); the detector's answer is the table's language, sure in two of three.
@query(
    "WITH "
    + ITEMS_SQL
    + r""", c AS (SELECT doc_id, CAST(coalesce(sum(CASE WHEN kind IN ('text', 'list', 'heading', 'code') THEN len(regexp_extract_all(text, '\S+')) END), 0) AS BIGINT) AS words, CAST(coalesce(sum(CASE WHEN kind IN ('text', 'list', 'heading', 'code') AND trim(text) <> '' THEN length(text) END), 0) AS BIGINT) AS chars,
 count(*) FILTER (WHERE kind = 'text') AS paragraphs, count(*) FILTER (WHERE kind = 'heading' AND trim(text) <> '') AS headings, CAST(sum(CASE WHEN kind <> 'code' THEN len(regexp_extract_all(text, '!\[[^\]]*\]\(')) ELSE 0 END) AS BIGINT) AS pictures FROM items GROUP BY 1)
SELECT c.*, CASE WHEN words >= 20 AND (CASE lang WHEN 'fr' THEN 'cs' WHEN 'de' THEN 'sk' ELSE lang END) IN ('cs', 'sk', 'en') AND doc_id % 3 <> 0 THEN CASE lang WHEN 'fr' THEN 'cs' WHEN 'de' THEN 'sk' ELSE lang END ELSE 'en' END AS language FROM c JOIN documents USING (doc_id)"""
)
def q113_document_counts(spark, d):
    c = T.document_counts(T.markdown_items(markdown(spark, d)))
    said = F.when(F.col("lang") == "fr", "cs").when(F.col("lang") == "de", "sk").otherwise(F.col("lang"))
    x = c.join(table(spark, d, "documents").select("doc_id", said.alias("said")), "doc_id")
    return x.withColumn("language", Y.document_language(F.col("words"), F.col("said"), F.when(F.col("doc_id") % 3 != 0, 0.9).otherwise(0.7))).drop("said")


# One typesetting finding for a document.
@query(
    "WITH "
    + LINES_SQL
    + r""", p AS (SELECT '\b(?:[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-zA-Z_][a-zA-Z0-9]*_[a-zA-Z][a-zA-Z0-9]*|[A-Z]{2,}(?:_[A-Z0-9]+)+|[a-z][a-zA-Z0-9_]*\(\))\b' AS names), s AS (SELECT *, regexp_replace(line, '`[^`]*`', '', 'g') AS shown, length(regexp_extract(line, '( *)$', 1)) AS blanks FROM l6),
v0 AS (SELECT doc_id, line_no, 0 AS g, 0 AS nth, 'Line ' || line_no || ': [MD009] Trailing spaces' AS m FROM s WHERE kind <> 'code' AND blanks > 0 AND blanks <> 2
 UNION ALL SELECT doc_id, line_no, 0, 1, 'Line ' || line_no || ': [MD010] Hard tabs' FROM s WHERE kind <> 'code' AND contains(line, chr(9))
 UNION ALL SELECT doc_id, line_no, 1, nth, 'Line ' || start_line || ': Identifier ''' || name || ''' should use monospace formatting' FROM (SELECT doc_id, line_no, start_line, unnest(found) AS name, unnest(range(1, len(found) + 1)) AS nth FROM (SELECT *, regexp_extract_all(shown, names) AS found FROM s, p WHERE kind IN ('text', 'heading', 'list', 'table', 'picture')))
 UNION ALL SELECT doc_id, line_no, 1, 1000000, 'Line ' || start_line || ': Incorrect spacing around bracket' FROM s WHERE kind IN ('text', 'heading', 'list', 'table', 'picture') AND regexp_matches(shown, '\( | \)')),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g, line_no, nth) AS place FROM v0), n AS (SELECT doc_id, count(*) AS n, string_agg(m, '; ' ORDER BY place) FILTER (WHERE place <= 20) AS ms FROM v GROUP BY 1)
SELECT doc_id, 'ASSET_ANALYSER:TYPESET-1' AS finding_id, n || ' typography/formatting issue(s) found: ' || ms || CASE WHEN n > 20 THEN '; ... and ' || (n - 20) || ' more' ELSE '' END AS summary,
 least(greatest(round(n / greatest(len(regexp_extract_all(text, '\S+')), 1)::DOUBLE * 100, 3), 0.1), 1.0)::DOUBLE AS severity, 'not_to_be_judged' AS judge_status FROM n JOIN md USING (doc_id)"""
)
def q114_typeset_findings(spark, d):
    md = markdown(spark, d)
    words = md.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("words"))
    return Y.typeset(T.markdown_lines(md), words).select("doc_id", "finding_id", "summary", "severity", "judge_status")


EVENT_ITEMS_SQL = """i AS (SELECT user_id AS doc_id, event_id AS seq, k, CASE WHEN k % 6 < 3 THEN 'heading' WHEN k % 6 = 5 THEN 'picture' ELSE 'text' END AS kind, CASE WHEN k % 12 = 4 THEN 'footnote' ELSE 'body' END AS label, 1 + k % 3 AS level, CASE WHEN k % 10 = 3 THEN ' ' ELSE 'H' || k END AS text, k % 5 + 1 AS page_no
 FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def event_items(spark, d):
    """Events as items of a user's document."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), k.alias("k"))
    kind = F.when(F.col("k") % 6 < 3, "heading").when(F.col("k") % 6 == 5, "picture").otherwise("text")
    text = F.when(F.col("k") % 10 == 3, " ").otherwise(F.concat(F.lit("H"), F.col("k").cast("string")))
    return e.withColumns({"kind": kind, "label": F.when(F.col("k") % 12 == 4, "footnote").otherwise("body"), "level": F.col("k") % 3 + 1, "text": text, "page_no": F.col("k") % 5 + 1, "cref": F.concat(F.lit("#/texts/"), F.col("seq").cast("string"))})


# Empty sections and short documents as findings.
@query(f"""WITH {EVENT_ITEMS_SQL}, t AS (SELECT * FROM i WHERE kind = 'heading' OR kind = 'text' AND label <> 'footnote' AND trim(text) <> ''),
n AS (SELECT *, lead(kind) OVER w AS nk, lead(level) OVER w AS nl FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
e AS (SELECT doc_id, 'CONSEC_HEADINGS' AS ac_code, seq, text, page_no, nl IS NULL AS at_end, CASE WHEN nl IS NULL OR nl = level THEN 0.8 WHEN nl > level THEN 0.6 ELSE 0.9 END::DOUBLE AS severity FROM n WHERE kind = 'heading' AND coalesce(nk, 'heading') = 'heading'),
c AS (SELECT doc_id, CAST(sum(k) AS BIGINT) AS words, CAST(sum(k) * 7 AS BIGINT) AS chars, count(*) FILTER (WHERE kind = 'text') AS blocks FROM i GROUP BY 1),
r AS (SELECT *, least(words / 3400.0::DOUBLE, chars / 24000.0::DOUBLE, blocks / 22.0::DOUBLE) AS low FROM c),
u AS (SELECT doc_id, ac_code, seq, CASE WHEN at_end THEN 'Empty section at end of document' ELSE 'Empty section detected' END AS title, CASE severity WHEN 0.8 THEN 'Empty section (sibling heading follows with no content)' WHEN 0.6 THEN 'Section has no introductory text before its subsections' ELSE 'Empty subsection at end of its block' END || ': ''' || text || '''.' AS summary, severity, CASE WHEN page_no <= 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, text AS snippet FROM e
 UNION ALL SELECT doc_id, 'SHORT', 1099511627776, 'Document is too short', 'Content is insufficient (' || words || ' words, ' || chars || ' chars, ' || blocks || ' blocks).', CASE WHEN low < 0.5 THEN 0.9 WHEN low < 0.75 THEN 0.7 ELSE 0.5 END::DOUBLE, 0.8::DOUBLE, NULL FROM r WHERE low < 1)
SELECT doc_id, 'STRUCTURE_ANALYSER:' || ac_code || '-' || row_number() OVER (PARTITION BY doc_id, ac_code ORDER BY seq) AS finding_id, title, summary, severity, confidence, snippet, 'to_be_judged' AS judge_status FROM u""")
def q115_structure_findings(spark, d):
    i = event_items(spark, d)
    counts = i.groupBy("doc_id").agg(F.sum("k").cast("long").alias("words"), (F.sum("k") * 7).cast("long").alias("chars"), F.count_if(F.col("kind") == "text").alias("blocks"))
    return Y.structure(i, counts, minima={"words": 3400, "chars": 24000, "blocks": 22}).select("doc_id", "finding_id", "title", "summary", "severity", "confidence", "snippet", "judge_status")


# Files that a parser can't or shouldn't take.
@query("""WITH f AS (SELECT p_partkey AS doc_id, 'in/' || p_partkey || '/' || CASE WHEN p_partkey % 4 = 0 THEN 'doc' ELSE 'my.report' END || CASE p_partkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.MD' WHEN 2 THEN '.docx' WHEN 3 THEN '' ELSE '.md' END AS path,
 CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN 0 ELSE p_size END AS length, CASE WHEN p_size % 7 = 2 THEN 'bad header' WHEN p_size % 7 = 3 THEN 'no origin' END AS error FROM part),
g AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM f), h AS (SELECT *, regexp_extract(name, '[^.](\\.[^.]*)$', 1) AS suffix FROM g), j AS (SELECT *, CASE WHEN suffix = '' THEN name ELSE left(name, length(name) - length(suffix)) END AS stem FROM h),
u AS (SELECT doc_id, 0 AS seq, 'MISSING' AS ac_code, 'Input file missing' AS title, 'Input file does not exist: ' || path AS summary FROM j WHERE length IS NULL
 UNION ALL SELECT doc_id, 0, 'DOCTYPE', 'Unsupported file type', 'Cannot parse unsupported suffix: ' || suffix FROM j WHERE length IS NOT NULL AND lower(suffix) NOT IN ('.pdf', '.md')
 UNION ALL SELECT doc_id, 0, CASE error WHEN 'no origin' THEN 'PARSE_NO_ORIGIN' ELSE 'PARSE_ERROR' END, CASE error WHEN 'no origin' THEN 'Missing document origin' ELSE 'Parse failed' END, CASE error WHEN 'no origin' THEN 'The converter did not populate document origin.' ELSE 'Parser failed: ' || error END FROM j WHERE length > 0 AND lower(suffix) IN ('.pdf', '.md') AND error IS NOT NULL
 UNION ALL SELECT doc_id, 0, 'DOCTYPE', 'Incorrect Document Type', 'Document extension ''' || suffix || ''' is not among the allowed extensions [''.md''].' FROM j WHERE length IS NOT NULL AND lower(suffix) = '.pdf' AND (length = 0 OR error IS NULL)
 UNION ALL SELECT doc_id, 1, 'DOCTYPE', 'Incorrect Document Name', 'Document was expected to be named ''doc'', but found ''' || name || '''.' FROM j WHERE length IS NOT NULL AND lower(suffix) IN ('.pdf', '.md') AND stem <> 'doc' AND (length = 0 OR error IS NULL)
 UNION ALL SELECT doc_id, 2, 'MISSING', 'Empty Document', 'File is 0 bytes and therefore counts as missing documentation.' FROM j WHERE length = 0 AND lower(suffix) IN ('.pdf', '.md'))
SELECT doc_id, 'PARSER:' || ac_code || '-' || row_number() OVER (PARTITION BY doc_id, ac_code ORDER BY seq) AS finding_id, title, summary, 'not_to_be_judged' AS judge_status FROM u""")
def q116_parser_findings(spark, d):
    name = F.concat(F.when(F.col("p_partkey") % 4 == 0, "doc").otherwise("my.report"), F.get(F.array(*[F.lit(x) for x in (".pdf", ".MD", ".docx", "", ".md")]), (F.col("p_partkey") % 5).cast("int")))
    s = F.col("p_size") % 7
    f = table(spark, d, "part").select(
        F.col("p_partkey").alias("doc_id"), F.concat(F.lit("in/"), F.col("p_partkey").cast("string"), F.lit("/"), name).alias("path"), F.when(s == 1, 0).when(s > 1, F.col("p_size")).alias("length"), F.when(s == 2, "bad header").when(s == 3, "no origin").alias("error"),
    )
    return Y.parser_findings(f, "doc", [".md"]).select("doc_id", "finding_id", "title", "summary", "judge_status")


# Lines that are no evidence.
_UNIT_SQL = "CASE doc_id % 6 WHEN 0 THEN 'Dokumentace ' || left(text, 60) WHEN 1 THEN ' 1.2.' || CASE WHEN doc_id % 4 = 1 THEN ' ' ELSE ' x' END WHEN 2 THEN 'ipp 2024 ' || left(text, CAST(doc_id % 100 AS INT)) WHEN 3 THEN '  ' || left(text, CAST(doc_id % 60 AS INT)) || ' ' WHEN 4 THEN '2023 / 2024' ELSE left(text, 200) END"


@query(rf"""WITH u AS (SELECT doc_id, regexp_replace({_UNIT_SQL}, '^\s+|\s+$', '', 'g') AS t FROM documents), b AS (SELECT *, t = '' OR regexp_matches(t, '{V.TITLE_LINE}') OR regexp_matches(t, '{V.CONTENTS_LINE}') OR regexp_matches(t, '{V.YEAR_LINE}') AND length(t) < 80 AS noise FROM u)
SELECT doc_id, noise, length(t) >= 40 AND NOT noise AS usable FROM b""")
def q117_evidence_noise(spark, d):
    unit = F.expr(_UNIT_SQL.replace("left(text, CAST(", "left(text, CAST("))
    u = table(spark, d, "documents").select("doc_id", unit.alias("t"))
    return u.select("doc_id", Y.boilerplate(F.regexp_replace("t", r"^\s+|\s+$", "")).alias("noise"), Y.usable(F.col("t"), 40).isNotNull().alias("usable"))


# The finding that a document copies its specification.
@query(CONFIDENCE_SQL + f""", {_EVIDENCE_SQL}, w AS (SELECT label, max(CASE WHEN nth = 1 THEN 'u' || vec_id END) AS snippet, max(CASE WHEN nth = 1 THEN '#/texts/' || place END) AS cref, string_agg(CASE rank WHEN 0 THEN 'sim' ELSE 'sent_sim' END || ' ' || printf('%.4f', round(sim, 4)) || ' s' || sid, '; ' ORDER BY nth) AS evals FROM v2 GROUP BY 1)
SELECT x9.label AS doc_id, 'INTEGRITY_ANALYSER:COPY-1' AS finding_id, 'Detected similarity with the official specification: contamination=' || printf('%.2f', round_even(c, 2)) || ', coverage=' || printf('%.2f', round_even(cov, 2)) || ', ' || f || '/' || n || ' chunks flagged, ' || h || ' hard sentence matches' AS summary,
round(confidence, 6) AS confidence, round(severity, 6) AS severity, cref, snippet, evals, (m >= 0.95)::INT + (c >= 0.25)::INT + (h > 0)::INT + (f > 0 AND s >= 2)::INT + (s >= 3)::INT + (k > 0)::INT + (cov >= 0.24)::INT AS n_notes, round(c, 4) AS stat_contamination FROM x9 LEFT JOIN w ON w.label = x9.label WHERE (f > 0 OR s > 0) AND confidence >= 0.2""")
def q118_copy_findings(spark, d):
    chunks, sentences, coverage = similarities(spark, d)
    f = Y.copy_findings(Y.copy_signals(chunks, sentences, coverage, LIMITS), evidence(chunks, sentences))
    evals = F.array_join(F.transform("model_evals", lambda x: F.concat_ws(" ", x["label"], F.format_string("%.4f", x["score"]), x["raw"]["spec_text"])), "; ")
    return f.select("doc_id", "finding_id", "summary", F.round("confidence", 6).alias("confidence"), F.round("severity", 6).alias("severity"), "cref", "snippet", evals.alias("evals"), F.size("notes").alias("n_notes"), F.col("stats")[0]["value"].alias("stat_contamination"))


# Answers of a grammar checker as findings: sections, ignored words, codes by type, places, at most so many.
_ISSUES = ["grammar", "misspelling", "style", "grammar", "misspelling", "typographical", "grammar", "grammar"]
_QUOTED_SQL = r"""CASE WHEN contains(@, '''') AND NOT contains(@, '"') THEN '"' || replace(replace(@, '\', '\\'), chr(10), '\n') || '"' ELSE '''' || replace(replace(replace(@, '\', '\\'), chr(10), '\n'), '''', '\''') || '''' END"""


@query(rf"""WITH i AS (SELECT conv_id AS doc_id, turn AS seq, role AS section_path, '#/texts/' || turn AS cref, regexp_replace(text || ' JSON', '^\s+|\s+$', '', 'g') AS t FROM conversations),
g AS (SELECT doc_id, section_path, string_agg(t, ' ' ORDER BY seq) AS combined, min(seq) AS first_seq FROM i GROUP BY 1, 2), p AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY doc_id, section_path ORDER BY seq) - length(t) - 1 AS a FROM i),
s AS (SELECT g.*, CASE WHEN j = 7 THEN length(combined) - 4 ELSE length(combined) * j // 7 END AS o, CASE WHEN j = 7 THEN 4 ELSE 5 END AS n, list_extract({_ISSUES}, j + 1) AS kind, list_slice(['x', 'it''s', 'y"', 'z'], 1, j % 5) AS others FROM g, (SELECT unnest(range(0, 8)) AS j) WHERE len(regexp_extract_all(combined, '\S+')) >= 10),
c AS (SELECT *, substring(combined, o + 1, n) AS snippet, CASE kind WHEN 'grammar' THEN 'GRAMMAR' ELSE 'CH' END AS code FROM s WHERE kind IN ('grammar', 'misspelling')),
q AS (SELECT c.*, row_number() OVER (PARTITION BY doc_id ORDER BY first_seq, o, kind) AS place FROM c WHERE lower(snippet) NOT IN ({", ".join(f"'{w}'" for w in V.IGNORED_WORDS)})),
f AS (SELECT q.*, coalesce(p.cref, z.cref) AS cref, coalesce(p.t, z.t) AS t FROM q LEFT JOIN p ON p.doc_id = q.doc_id AND p.section_path = q.section_path AND o >= p.a AND o < p.a + length(p.t) JOIN p z ON z.doc_id = q.doc_id AND z.section_path = q.section_path AND z.seq = q.first_seq WHERE place <= 12)
SELECT doc_id, 'GRAMMAR_ANALYSER:' || code || '-' || row_number() OVER (PARTITION BY doc_id, code ORDER BY place) AS finding_id, CASE code WHEN 'CH' THEN 'Errors' ELSE 'Grammar' END AS title,
CASE kind WHEN 'grammar' THEN 'Grammar Error' ELSE 'Spelling Error' END || ': ' || {_QUOTED_SQL.replace("@", "snippet")} || CASE WHEN len(others) > 0 THEN '. Maybe: ' || array_to_string(list_transform(list_slice(others, 1, 3), lambda y: {_QUOTED_SQL.replace("@", "y")}), ', ') ELSE '' END AS summary,
0.4::DOUBLE AS severity, 0.75::DOUBLE AS confidence, cref, md5(CASE WHEN contains(t, snippet) THEN snippet ELSE t END) AS snippet, CASE WHEN NOT contains(t, snippet) THEN snippet END AS model_snippet, section_path FROM f""")
def q119_grammar_findings(spark, d):
    i = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("role").alias("section_path"), F.concat(F.lit("#/texts/"), F.col("turn").cast("string")).alias("cref"), F.lit("text").alias("kind"), F.concat("text", F.lit(" JSON")).alias("text"))
    j, size = F.col("j"), F.length("combined")
    issues = Y.grammar_sections(i).select("doc_id", "section_path", "combined", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    issues = issues.select(
        "doc_id", "section_path", F.when(j == 7, size - 4).otherwise(F.floor(size * j / 7)).cast("int").alias("offset"), F.when(j == 7, 4).otherwise(5).alias("length"),
        F.get(F.array(*[F.lit(x) for x in _ISSUES]), j).alias("issue_type"), F.slice(F.array(*[F.lit(x) for x in ("x", "it's", 'y"', "z")]), F.lit(1), j % 5).alias("replacements"),
    )
    f = Y.grammar(i, issues, {"GRAMMAR": "Grammar", "CH": "Errors"}, most=12)
    return f.select("doc_id", "finding_id", "title", "summary", "severity", "confidence", "cref", F.md5("snippet").alias("snippet"), F.col("meta")["model_snippet"].alias("model_snippet"), "section_path")


# A model's answers as findings: unknown codes, FIL0, titles of which the last counts, snippets that the item has or not.
_ANSWER_SQL = """t AS (SELECT user_id AS doc_id, event_id AS seq, k, 'H' || k AS text, list_extract(['STYLE', 'FIL0', 'zz', 'COPY', 'CH', 'FILO', 'BADUML', 'own  dif', 'UML_BAD', 'OWN DIF'], CAST(k % 10 AS INT) + 1) AS code, CASE WHEN k % 4 <> 0 THEN '#/texts/' || event_id ELSE '#/none' END AS cref,
 'Because ' || k AS reason, CASE k % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'nope' END AS said, CASE WHEN k % 5 > 0 THEN 'm' || k % 2 END AS model FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def answers(spark, d):
    k = F.col("k")
    i = event_items(spark, d).withColumns({"text": F.concat(F.lit("H"), k.cast("string")), "section_path": F.concat(F.lit("S"), (k % 9).cast("string"))})
    codes = F.array(*[F.lit(x) for x in ("STYLE", "FIL0", "zz", "COPY", "CH", "FILO", "BADUML", "own  dif", "UML_BAD", "OWN DIF")])
    told = i.select(
        "doc_id", "seq", F.get(codes, (k % 10).cast("int")).alias("code"), F.when(k % 4 != 0, F.col("cref")).otherwise("#/none").alias("cref"), F.concat(F.lit("Because "), k.cast("string")).alias("reason"), F.when(k % 3 == 0, "H").when(k % 3 == 1, "nope").alias("snippet"),
        (k / 99).alias("severity"), F.lit(0.5).alias("confidence"), F.when(k % 5 > 0, F.concat(F.lit("m"), (k % 2).cast("string"))).alias("model_name"), F.concat(F.lit("raw "), k.cast("string")).alias("raw_response"),
    )
    return told, i


@query(f"""WITH {_ANSWER_SQL}, r AS (SELECT *, CASE code WHEN 'FIL0' THEN 'FILO' ELSE code END AS ac_code FROM t), f AS (SELECT *, CASE ac_code WHEN 'STYLE' THEN 'Style, new' WHEN 'FILO' THEN 'Philosophy' ELSE 'Copied' END AS title, cref <> '#/none' AS here FROM r WHERE ac_code IN ('STYLE', 'FILO', 'COPY'))
SELECT doc_id, seq, 'CONTENT_ANALYSER:' || ac_code || '-' || row_number() OVER (PARTITION BY doc_id, ac_code ORDER BY seq) AS finding_id, title, reason AS summary, round(k / 99.0::DOUBLE, 6) AS severity, model AS generator_model, CASE WHEN here THEN CASE WHEN said = 'H' THEN 'H' ELSE text END END AS snippet, CASE WHEN here THEN 'S' || k % 9 END AS section_path,
ac_code AS label, CASE WHEN here AND said = 'nope' THEN 'nope' END AS model_snippet FROM f""")
def q120_model_findings(spark, d):
    told, items = answers(spark, d)
    rules = spark.createDataFrame([("STYLE", "Style, old", 1), ("FILO", "Philosophy", 2), ("COPY", "Copied", 3), ("STYLE", "Style, new", 4)], "ac_code string, title string, position int")
    f = Y.model_findings(told, rules, items, "content_analyser", model="grader")
    one = F.col("model_evals")[0]
    return f.select("doc_id", "seq", "finding_id", "title", "summary", F.round("severity", 6).alias("severity"), "generator_model", "snippet", "section_path", one["label"].alias("label"), one["raw"]["model_snippet"].alias("model_snippet"))


# Answers of a vision model: codes by alias, evaluations with the raw answer, the code that was mapped.
@query(f"""WITH {_ANSWER_SQL}, r AS (SELECT *, CASE WHEN code IN ('BADUML', 'UML_BAD') THEN 'UML_BAD' WHEN code IN ('own  dif', 'OWN DIF') THEN 'UML_OWNDIF' ELSE code END AS ac_code FROM t), f AS (SELECT *, cref <> '#/none' AS here FROM r WHERE ac_code IN ('UML_BAD', 'UML_OWNDIF'))
SELECT doc_id, seq, 'ASSET_ANALYSER:' || ac_code || '-' || row_number() OVER (PARTITION BY doc_id, ac_code ORDER BY seq) AS finding_id, CASE ac_code WHEN 'UML_BAD' THEN 'Bad diagram' ELSE 'Own differences' END AS title, CASE WHEN here THEN text END AS snippet,
CASE WHEN model IS NOT NULL THEN code END AS label, CASE WHEN model IS NOT NULL THEN 'raw ' || k END AS raw, CASE WHEN model IS NOT NULL AND here THEN reason END AS model_snippet, CASE WHEN code <> ac_code THEN code END AS internal_code, CASE WHEN model IS NULL AND here THEN reason END AS meta_snippet FROM f""")
def q121_vision_findings(spark, d):
    told, items = answers(spark, d)
    rules = spark.createDataFrame([("UML_BAD", "Bad diagram", 1), ("UML_OWNDIF", "Own differences", 2)], "ac_code string, title string, position int")
    f = Y.model_findings(told, rules, items, "asset_analyser", vision=True)
    one = F.col("model_evals")[0]
    return f.select("doc_id", "seq", "finding_id", "title", "snippet", one["label"].alias("label"), one["raw"]["classifier_raw_response"].alias("raw"), one["raw"]["model_snippet"].alias("model_snippet"), F.col("meta")["internal_ac_code"].alias("internal_code"), F.col("meta")["model_snippet"].alias("meta_snippet"))


# Documents without a diagram, and diagrams that a classifier calls bad.
@query("""WITH x AS (SELECT p_partkey AS doc_id, p_size % 3 AS n_pages, p_size % 4 AS pictures, p_partkey % 5 = 0 AS md, p_partkey % 7 <> 0 AS client, p_partkey % 2 AS sent FROM part)
SELECT doc_id, 'ASSET_ANALYSER:UML_MISSING-1' AS finding_id, 'No diagram' AS title FROM x WHERE CASE WHEN NOT (pictures > 0 OR n_pages = 0 AND md) THEN true WHEN n_pages = 0 THEN NOT client OR sent = 0 ELSE client AND sent = 0 END
UNION ALL SELECT p_partkey, 'ASSET_ANALYSER:UML_BAD-1', 'Bad diagram' FROM part WHERE p_partkey % 11 IN (0, 1)""")
def q122_diagram_findings(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    x = part.select(k.alias("doc_id"), (F.col("p_size") % 3).alias("n_pages"), (F.col("p_size") % 4).alias("pictures"), (k % 5 == 0).alias("md_images"), (k % 7 != 0).alias("has_client"), (k % 2).alias("images_sent"))
    labels = part.select(k.alias("doc_id"), F.lit(0).alias("seq"), F.lit("#/pictures/0").alias("cref"), F.when(k % 11 == 0, " baduml ").when(k % 11 == 2, "GOODUML").alias("label"), F.when(k % 11 == 1, "it is BadUML.").when(k % 11 == 3, "fine").alias("raw"))
    rules = spark.createDataFrame([("UML_BAD", "Bad diagram", 1)], "ac_code string, title string, position int")
    pictures = labels.select("doc_id", "cref", F.lit(None).cast("string").alias("text"), F.lit(1).alias("page_no"), F.lit(None).cast("string").alias("section_path"))
    bad = Y.model_findings(Y.classifier_answers(labels, "classifier"), rules, pictures, "asset_analyser", vision=True)
    return Y.missing_diagrams(x, "No diagram").unionByName(bad, allowMissingColumns=True).select("doc_id", "finding_id", "title")


# Languages of comments and of sentences (X8, R3, R12); the detector's answer is played by the table's language.
@query(r"""WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN left(text, CAST(doc_id % 8 AS INT)) WHEN 1 THEN '  12 34 ' ELSE text END AS t, CASE lang WHEN 'fr' THEN 'cs' WHEN 'de' THEN 'sk' ELSE lang END AS l FROM documents)
SELECT doc_id, CASE WHEN length(regexp_replace(t, '^\s+|\s+$', '', 'g')) >= 5 AND regexp_matches(t, '[A-Za-zÀ-ž]') AND l IN ('cs', 'sk', 'en') THEN l ELSE 'unknown' END AS comment_language, CASE WHEN doc_id % 3 = 0 THEN 'cs' WHEN l IN ('cs', 'sk', 'en') THEN l ELSE 'en' END AS sentence_language FROM x""")
def q123_comment_language(spark, d):
    k = F.col("doc_id")
    t = F.when(k % 4 == 0, F.expr("left(text, CAST(doc_id % 8 AS INT))")).when(k % 4 == 1, "  12 34 ").otherwise(F.col("text"))
    said = F.when(F.col("lang") == "fr", "cs").when(F.col("lang") == "de", "sk").otherwise(F.col("lang"))
    x = table(spark, d, "documents").select("doc_id", t.alias("t"), said.alias("l"))
    return x.select("doc_id", Y.comment_language(F.col("t"), F.col("l")).alias("comment_language"), Y.sentence_language(F.when(k % 3 == 0, "cs").when(k % 3 == 1, "xx"), F.col("l")).alias("sentence_language"))
