"""Analysers: documents to findings (T1-T12, X14, X15, X24, F10, F21, R10-R15). What models and checkers answer comes in as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaya import fixed_values as V
from assaya.functions import columns as C
from assaya.operators import findings as O
from assaya.operators import text as T

#: Columns that an analyser may set of a finding; the others are null.
FIELDS = {
    "doc_id": "string", "seq": "long", "ac_code": "string", "title": "string", "summary": "string", "severity": "double", "confidence": "double", "judge_status": "string", "generator_model": "string",
    "cref": "string", "item_text": "string", "snippet_override": "string", "page_no": "int", "section_path": "string",
    "stats": "array<struct<name: string, value: double, unit: string>>", "model_evals": "array<struct<model_name: string, label: string, score: double, raw: map<string, string>>>", "notes": "array<string>", "meta": "map<string, string>",
}


def finding(rows: DataFrame, analyser: str, doc: str = "doc_id") -> DataFrame:
    """Findings of one analyser from rows that have some of FIELDS.

    The anchor's snippet is the model's where the item holds it word for word, else
    the item's own text, and the model's goes to meta (X14). Ids count up within a
    document, analyser and code (W8), in the order of seq and code.
    """
    have = dict(rows.dtypes)
    key = have[doc]
    rows = rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(key if c == doc else kind).alias(c) for c, kind in {**{doc: key}, **FIELDS}.items() if c == doc or c != "doc_id"])
    override, item = F.col("snippet_override"), F.col("item_text")
    told = F.col("cref").isNotNull() & override.isNotNull() & ~F.coalesce(F.contains(item, override) & (item != ""), F.lit(False))
    snippet = F.when(F.col("cref").isNotNull(), F.when(override.isNotNull() & ~told, override).otherwise(item))
    meta = F.when(told, F.map_concat(F.coalesce("meta", F.create_map().cast("map<string, string>")), F.create_map(F.lit("model_snippet"), override))).otherwise(F.col("meta"))
    rows = rows.withColumns({"analyser_id": F.lit(analyser), "snippet": snippet, "meta": meta, "judge_status": F.coalesce("judge_status", F.lit("to_be_judged")), "human_status": F.lit("proposed"), "impact": F.lit(None).cast("double"), "judge_model": F.lit(None).cast("string")})
    prefix = F.concat(F.upper("analyser_id"), F.lit(":"), F.col("ac_code"))
    at = F.row_number().over(Window.partitionBy(doc, "ac_code").orderBy("seq", "summary"))
    return rows.withColumn("finding_id", F.concat(prefix, F.lit("-"), at.cast("string"))).drop("item_text", "snippet_override")


def stat(name: str, value: Column, unit: str | None = None) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(unit).cast("string").alias("unit"))


def page_confidence(page: Column) -> Column:
    """Headings of the first two pages may be of a cover or a table of contents."""
    return F.when(page <= 2, 0.5).otherwise(1.0)


NOISE = ("page_header", "page_footer", "footnote")


def empty_heading_findings(items: DataFrame, code: str, doc: str = "doc_id") -> DataFrame:
    """Rows for headings that nothing follows before the next heading or the end.

    Only text counts: pictures and tables neither fill a section nor end one, nor do
    headers, footers, footnotes and blank text.
    """
    heading = F.col("kind") == "heading"
    text = items.filter(heading | ((F.col("kind") == "text") & ~F.coalesce(F.col("label").isin(*NOISE), F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != "")))
    found = T.empty_sections(text.withColumn("trailing", F.lead(F.lit(1)).over(Window.partitionBy(doc).orderBy("seq")).isNull()), doc, "seq", heading, F.col("level"))
    reason = F.when(F.col("severity") == 0.8, V.EMPTY_SECTION["sibling"]).when(F.col("severity") == 0.6, V.EMPTY_SECTION["child"]).otherwise(V.EMPTY_SECTION["parent"])
    return found.select(
        doc, "seq", F.lit(code).alias("ac_code"), F.when(F.col("trailing"), V.EMPTY_SECTION["end title"]).otherwise(V.EMPTY_SECTION["title"]).alias("title"),
        F.concat(reason, F.lit(": '"), F.coalesce("text", F.lit("")), F.lit("'.")).alias("summary"), "severity", page_confidence(F.col("page_no")).alias("confidence"), "cref", F.col("text").alias("item_text"), "page_no",
    )


def short_findings(counts: DataFrame, minima: dict[str, int] | None = None, doc: str = "doc_id") -> DataFrame:
    """Rows for documents under any of the minima (T1, X23): ``counts`` has words, chars and blocks."""
    w, c, b = F.col("words"), F.col("chars"), F.col("blocks")
    rows = counts.withColumn("severity", C.short_severity(w, c, b, minima)).filter("severity IS NOT NULL")
    return rows.select(
        doc, F.lit(1 << 40).alias("seq"), F.lit("SHORT").alias("ac_code"), F.lit("Document is too short").alias("title"), F.format_string("Content is insufficient (%d words, %d chars, %d blocks).", w, c, b).alias("summary"),
        "severity", F.lit(0.8).alias("confidence"), F.array(stat("word_count", w, "words"), stat("char_count", c, "chars"), stat("structure_count", b, "blocks")).alias("stats"),
    )


def structure(items: DataFrame, counts: DataFrame, codes: set[str] | None = None, minima: dict[str, int] | None = None, doc: str = "doc_id") -> DataFrame:
    """Which checks run depends on all codes of the rulebook, whatever its courses and disabled codes."""
    codes = {"CONSEC_HEADINGS", "SHORT"} if codes is None else codes
    parts = [empty_heading_findings(items, code, doc) for code in ("CONSEC_HEADINGS", "KAPTXT") if code in codes][:1]
    parts += [short_findings(counts, minima, doc)] if "SHORT" in codes else []
    if not parts:
        return finding(empty_heading_findings(items, "", doc).limit(0), "structure_analyser", doc)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return finding(rows, "structure_analyser", doc)


def parser_findings(files: DataFrame, expected: str | None, allowed: list[str], doc: str = "doc_id") -> DataFrame:
    """Files (path, length, null if absent; error, if parsing failed) to findings, each document's in the parser's order.

    A file that is absent, of an unknown type, without an origin or broken gives that
    one finding and no document; an empty one has its other findings too.
    """
    path = F.col("path")
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    low = F.lower(suffix)
    stem = F.when(suffix == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(suffix)))
    wanted = F.lit(expected.rsplit("/", 1)[-1] if expected else None).cast("string")
    wanted = F.regexp_replace(wanted, r"(?<=[^.])\.[^.]*$", "")
    names = "[" + ", ".join(repr(x) for x in allowed) + "]"
    told = lambda code, title, summary: F.struct(F.lit(code).alias("ac_code"), F.lit(title).alias("title"), summary.alias("summary"))
    absent, unknown = F.col("length").isNull(), ~low.isin(*V.PARSED_TYPES)
    type_ = F.when(~low.isin(*[x if x.startswith(".") else f".{x}" for x in (a.lower() for a in allowed)]), told("DOCTYPE", "Incorrect Document Type", F.format_string(f"Document extension '%s' is not among the allowed extensions {names}.", suffix))) if allowed else F.lit(None)
    named = F.when(stem != wanted, told("DOCTYPE", "Incorrect Document Name", F.format_string("Document was expected to be named '%s', but found '%s'.", wanted, name)))
    empty = F.when(F.col("length") == 0, told("MISSING", "Empty Document", F.lit("File is 0 bytes and therefore counts as missing documentation.")))
    broken = F.when(F.col("error") == "no origin", F.array(told("PARSE_NO_ORIGIN", "Missing document origin", F.lit("The converter did not populate document origin.")))).when(
        F.col("error").isNotNull(), F.array(told("PARSE_ERROR", "Parse failed", F.concat(F.lit("Parser failed: "), F.col("error"))))
    )
    some = F.array_compact(F.array(type_, named, empty) if allowed else F.array(named, empty))
    found = (
        F.when(absent, F.array(told("MISSING", "Input file missing", F.concat(F.lit("Input file does not exist: "), path))))
        .when(unknown, F.array(told("DOCTYPE", "Unsupported file type", F.concat(F.lit("Cannot parse unsupported suffix: "), suffix))))
        .when((F.col("length") > 0) & F.col("error").isNotNull(), broken)
        .otherwise(some)
    )
    rows = files.select(doc, F.posexplode(found).alias("seq", "x")).select(doc, "seq", "x.*", F.lit("not_to_be_judged").alias("judge_status"))
    return finding(rows, "PARSER", doc)


def parsed(files: DataFrame) -> Column:
    """Whether a file gives a document."""
    low = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"[^.](\.[^.]*)$", 1))
    return F.coalesce(F.col("length") > 0, F.lit(False)) & low.isin(*V.PARSED_TYPES) & F.col("error").isNull()


def boilerplate(text: Column) -> Column:
    """Titles, lines of a table of contents, and short lines that begin with a year."""
    bare = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return (bare == "") | bare.rlike(V.TITLE_LINE) | bare.rlike(V.CONTENTS_LINE) | (bare.rlike(V.YEAR_LINE) & (F.length(bare) < 80))


def usable(text: Column, least: int) -> Column:
    """The repaired text of a unit of evidence, null if it is too short or noise."""
    clean = F.regexp_replace(C.repaired_marks(text), r"^\s+|\s+$", "")
    return F.when((F.length(clean) >= least) & ~boilerplate(clean), clean)


def quoted(text: Column) -> Column:
    """A string as a quoted literal: single quotes, double ones if only those help."""
    body = F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def issue_message(kind: Column, snippet: Column, replacements: Column) -> Column:
    """Title, the snippet quoted, up to three alternatives."""
    title = C.lookup(V.ISSUE_TITLES, kind)
    alternatives = F.array_join(F.transform(F.slice(replacements, 1, 3), quoted), ", ")
    return F.concat(title, F.when(F.coalesce(snippet, F.lit("")) != "", F.concat(F.lit(": "), quoted(snippet))).otherwise(""), F.when(F.size(replacements) > 0, F.concat(F.lit(". Maybe: "), alternatives)).otherwise(""))


def grammar_sections(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Text of each section of at least ten words, and where its items begin and end in it."""
    text = items.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter(F.col("kind").isin("text", "heading") & (F.col("text") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "cref", "text")))
    groups = text.withColumn("section_path", F.coalesce("section_path", F.lit(""))).groupBy(doc, "section_path").agg(ordered.alias("parts"))
    groups = groups.withColumn("combined", F.array_join(F.transform("parts", lambda x: x["text"]), " "))
    return groups.filter(F.size(F.regexp_extract_all("combined", F.lit(r"\S+"), F.lit(0))) >= 10).withColumn("first_seq", F.col("parts")[0]["seq"])


def grammar(items: DataFrame, issues: DataFrame, titles: dict[str, str], language: str = "en", doc: str = "doc_id", most: int = 100) -> DataFrame:
    """T4: ``issues`` (doc, section_path, offset, length, issue_type, replacements) are a checker's answers on grammar_sections.

    Issues of other types and ignored words go (F21); an issue's code is that of its
    type where the rules have it, else CH; its item is the one that its offset falls
    into (J13); of a document the first ``most`` findings stay.
    """
    sections = grammar_sections(items, doc)
    rows = sections.join(issues, [doc, "section_path"]).filter(F.lit(language == "en"))
    snippet = F.substring("combined", F.col("offset") + 1, F.col("length"))
    rows = rows.withColumns({"snippet": snippet, "severity": C.lookup(V.ISSUE_SEVERITY, F.col("issue_type"))}).filter(F.col("severity").isNotNull() & ~F.lower("snippet").isin(*V.IGNORED_WORDS))
    own = C.lookup(V.ISSUE_CODES, F.col("issue_type"))
    rows = rows.withColumn("ac_code", F.when(own.isin(*titles), own).when(F.lit("CH" in titles), "CH")).filter("ac_code IS NOT NULL")
    # Items up to the offset: the lengths before it, a blank after each.
    ends = F.transform("parts", lambda x, k: F.length(x["text"]) + F.coalesce(F.aggregate(F.slice("parts", F.lit(1), k), F.lit(0), lambda s, y: s + F.length(y["text"]) + 1), F.lit(0)))
    at = F.array_position(F.transform(ends, lambda e: F.col("offset") < e), True)
    item = F.get("parts", F.greatest(at - 1, F.lit(0)).cast("int"))
    inside = F.col("offset") >= F.get(ends, (at - 1).cast("int")) - F.length(item["text"])
    item = F.when((at > 0) & inside, item).otherwise(F.col("parts")[0])
    rows = rows.withColumn("item", item).withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("first_seq", "offset", "issue_type"))).filter(F.col("place") <= most)
    rows = rows.select(
        doc, F.col("place").alias("seq"), "ac_code", C.lookup(titles, F.col("ac_code")).alias("title"), issue_message(F.col("issue_type"), F.col("snippet"), F.col("replacements")).alias("summary"), "severity",
        F.lit(0.75).alias("confidence"), F.col("item.cref").alias("cref"), F.col("item.text").alias("item_text"), F.nullif("snippet", F.lit("")).alias("snippet_override"), "section_path",
    )
    return finding(rows, "grammar_analyser", doc)


def resolved_code(code: Column, known: DataFrame, rows: DataFrame) -> DataFrame:
    """The code that a model's answer stands for among the codes of ``known``: its own, else the first alias there is."""
    own = F.coalesce(C.lookup(V.CLASSIFIER_CODES, code), code)
    wide = rows.withColumn("__own", own).withColumn("__key", F.upper(F.trim(F.regexp_replace("__own", r"\s+", " "))))
    codes = known.agg(F.collect_set("ac_code").alias("__codes"))  # one row of a rulebook's codes
    alias = F.coalesce(*[F.when((F.col("__key") == key) & F.array_contains("__codes", x), F.lit(x)) for key, names in V.VISION_ALIASES.items() for x in names])
    wide = wide.join(F.broadcast(codes), F.lit(True)).withColumn("ac_code", F.when(F.array_contains("__codes", F.col("__own")), F.col("__own")).otherwise(F.coalesce(alias, F.col("__own"))))
    return wide.filter(F.array_contains("__codes", F.col("ac_code"))).drop("__own", "__key", "__codes")


def model_findings(answers: DataFrame, rules: DataFrame, items: DataFrame, analyser: str, vision: bool = False, model: str | None = None, doc: str = "doc_id") -> DataFrame:
    """A model's ``answers`` (doc, seq, code, cref, reason, snippet, severity, confidence, model_name, raw_response) as findings.

    Codes that the rules don't have go (F11); FIL0 is FILO. Titles are the rules'. A
    model's name gives an evaluation, which takes the model's snippet from meta; of a
    vision model it also has the raw answer, and meta keeps a code that was mapped.
    """
    titles = O.first_by(rules.withColumn("__at", F.monotonically_increasing_id() if "position" not in rules.columns else F.col("position")), ["ac_code"], [F.desc("__at")]).select("ac_code", "title")
    if vision:
        rows = resolved_code(F.col("code"), rules, answers)
    else:
        rows = answers.withColumn("ac_code", F.when(F.col("code") == "FIL0", "FILO").otherwise(F.col("code")))
    rows = rows.join(titles, "ac_code").join(items.select(doc, "cref", F.col("text").alias("item_text"), "page_no", "section_path"), [doc, "cref"], "left")
    known = F.col("section_path").isNotNull() | F.col("item_text").isNotNull() | F.col("page_no").isNotNull()
    said = F.col("reason") if vision else F.col("snippet")
    rows = rows.withColumns({"cref": F.when(known, F.col("cref")), "snippet_override": said, "summary": F.col("reason"), "generator_model": F.col("model_name")})
    mapped = F.when(F.col("code") != F.col("ac_code"), F.create_map(F.lit("internal_ac_code"), F.col("code"))) if vision else F.lit(None).cast("map<string, string>")
    rows = rows.withColumns({"meta": mapped, "code": F.col("code")})
    made = finding(rows, analyser, doc).join(rows.select(doc, "seq", "code", F.col("raw_response") if "raw_response" in rows.columns else F.lit(None).cast("string").alias("raw_response")), [doc, "seq"])
    name = F.col("generator_model") if vision else F.lit(model).cast("string")
    told = F.filter(F.map_entries(F.coalesce("meta", F.create_map().cast("map<string, string>"))), lambda x: x["key"] == "model_snippet")
    raw = F.map_from_entries(F.concat(told, F.array(F.struct(F.lit("classifier_raw_response").alias("key"), F.col("raw_response").alias("value")))) if vision else told)
    evaluated = F.array(F.struct(name.alias("model_name"), F.when(F.lit(vision), F.col("code")).otherwise(F.col("ac_code")).alias("label"), F.lit(None).cast("double").alias("score"), F.when(F.size(raw) > 0, raw).alias("raw")))
    left = F.map_filter("meta", lambda k, _: k != "model_snippet")
    return made.withColumns({"model_evals": F.when(name.isNotNull(), evaluated), "meta": F.when(name.isNotNull(), F.when(F.size(left) > 0, left)).otherwise(F.col("meta"))}).drop("code", "raw_response")


def typeset_violations(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Single violations of a Markdown document's typesetting in order (T7): ``lines`` as of text.markdown_lines.

    Trailing blanks but the two of a line break, and tabs, are looked for in all lines
    outside of code; identifiers and brackets in text, which has the number of its
    block's first line, without code spans.
    """
    line, shown = F.col("line"), F.regexp_replace("line", r"`[^`]*`", "")
    blanks = F.length(F.regexp_extract(line, r"( *)$", 1))
    at = lambda n, text: F.concat(F.lit("Line "), n.cast("string"), F.lit(": "), text)
    is_text = F.col("kind").isin("text", "heading", "list", "table", "picture")
    lint = F.array_compact(F.array(F.when((F.col("kind") != "code") & (blanks > 0) & (blanks != 2), F.struct(F.lit(0).alias("kind"), at(F.col("line_no"), F.lit("[MD009] Trailing spaces")).alias("message"))), F.when((F.col("kind") != "code") & F.contains(line, F.lit("\t")), F.struct(F.lit(0).alias("kind"), at(F.col("line_no"), F.lit("[MD010] Hard tabs")).alias("message")))))
    names = F.transform(C.identifiers(shown), lambda x: F.struct(F.lit(1).alias("kind"), at(F.col("start_line"), F.concat(F.lit("Identifier '"), x, F.lit("' should use monospace formatting"))).alias("message")))
    bracket = F.array_compact(F.array(F.when(C.loose_brackets(shown) > 0, F.struct(F.lit(1).alias("kind"), at(F.col("start_line"), F.lit("Incorrect spacing around bracket")).alias("message")))))
    every = F.concat(lint, F.when(is_text, F.concat(names, bracket)).otherwise(F.array().cast(lint_type())))
    rows = lines.select(doc, "line_no", F.posexplode(every).alias("nth", "x"))
    return rows.select(doc, F.struct(F.col("x.kind").alias("kind"), "line_no", "nth").alias("place"), F.col("x.message").alias("message"))


def lint_type() -> str:
    return "array<struct<kind: int, message: string>>"


def typeset(lines: DataFrame, words: DataFrame, title: str = "Typesetting", doc: str = "doc_id", most: int = 20) -> DataFrame:
    """At most one finding for a document, which names its first violations. ``words`` has doc and words."""
    found = typeset_violations(lines, doc)
    counts = found.groupBy(doc).agg(F.count(F.lit(1)).alias("n"))
    first = found.withColumn("at", F.row_number().over(Window.partitionBy(doc).orderBy("place"))).filter(F.col("at") <= most)
    named = first.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("at", F.regexp_replace("message", r"\s+", " ").alias("m")))).alias("ms"))
    rows = counts.join(named, doc).join(words.select(doc, "words"), doc)
    rest = F.when(F.col("n") > most, F.concat(F.lit("; ... and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    summary = F.concat(F.col("n").cast("string"), F.lit(" typography/formatting issue(s) found: "), F.array_join(F.transform("ms", lambda x: x["m"]), "; "), rest)
    severity = C.typeset_severity(F.col("n"), F.greatest(F.col("words"), F.lit(1)))
    rows = rows.select(doc, F.lit(0).alias("seq"), F.lit("TYPESET").alias("ac_code"), F.lit(title).alias("title"), summary.alias("summary"), severity.alias("severity"), F.lit(1.0).alias("confidence"), F.lit("not_to_be_judged").alias("judge_status"))
    return finding(rows, "asset_analyser", doc)


def missing_diagrams(docs: DataFrame, title: str, doc: str = "doc_id") -> DataFrame:
    """The finding that a document shows no diagram (T6): ``docs`` has n_pages, pictures, md_images, has_client and images_sent.

    Without a picture it stands; with pictures only if a model was asked and no image
    could be sent to it. Markdown has no pages, and its images count as pictures.
    """
    shown = (F.col("pictures") > 0) | ((F.col("n_pages") == 0) & F.col("md_images"))
    asked = F.col("has_client") & (F.col("images_sent") == 0)
    missing = F.when(~shown, True).when(F.col("n_pages") == 0, ~F.col("has_client") | asked).otherwise(asked)
    rows = docs.filter(missing).select(doc, F.lit(1 << 20).alias("seq"), F.lit("UML_MISSING").alias("ac_code"), F.lit(title).alias("title"), F.lit("No UML Class Diagram was found in the document.").alias("summary"), F.lit(1.0).alias("severity"), F.lit(1.0).alias("confidence"))
    return finding(rows, "asset_analyser", doc)


def classifier_answers(labels: DataFrame, model: str, doc: str = "doc_id") -> DataFrame:
    """A picture classifier's labels (doc, seq, cref, label, raw) that say a diagram is bad, as answers of a vision model."""
    said = F.upper(F.trim(F.coalesce("label", F.lit("")))), F.trim(F.coalesce("raw", F.lit("")))
    bad = labels.filter(F.contains(said[0], F.lit("BADUML")) | F.contains(F.upper(said[1]), F.lit("BADUML")))
    return bad.select(doc, "seq", F.lit("BADUML").alias("code"), "cref", F.lit(V.BAD_DIAGRAM).alias("reason"), F.lit(None).cast("string").alias("snippet"), F.lit(1.0).alias("severity"), F.lit(1.0).alias("confidence"), F.lit(model).alias("model_name"), said[1].alias("raw_response"))


def copy_signals(chunks: DataFrame, sentences: DataFrame, coverage: DataFrame, limits: dict[str, float] | None = None, doc: str = "doc_id") -> DataFrame:
    """Signals of overlap with a specification (A37): ``chunks`` and ``sentences`` (doc, unit, cref, sim) have their nearest specification
    unit's similarity, ``coverage`` (doc, spec_id, sim) the nearest chunk's of each specification chunk."""
    at = {**V.COPY_LIMITS, **(limits or {})}
    flagged = F.col("sim") > at["chunk"]
    per = chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("f"), F.max("sim").alias("m"))
    covered = coverage.groupBy(doc).agg(F.avg((F.col("sim") > at["cover"]).cast("double")).alias("cov"))
    hard = F.col("sim") > at["hard"]
    said = sentences.groupBy(doc).agg(F.count_if(F.col("sim") > at["soft"]).alias("s"), F.count_if(hard).alias("h"), F.max("sim").alias("ms"))
    places = sentences.filter(hard & F.col("cref").isNotNull()).select(doc, "cref").distinct()
    backed = chunks.filter(flagged).join(places, [doc, "cref"], "left_semi").groupBy(doc).agg(F.count(F.lit(1)).alias("k"))
    rows = per.join(covered, doc, "left").join(said, doc, "left").join(backed, doc, "left")
    rows = rows.fillna(0, ["s", "h", "k"]).fillna(0.0, ["ms", "cov"])
    enough = F.col("n") >= V.LEAST_CHUNKS
    zero = {c: F.when(enough, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in ("f", "s", "h", "k")}
    return rows.select(doc, "n", *zero.values(), *[F.when(enough, F.col(c)).otherwise(0.0).alias(c) for c in ("m", "ms", "cov")], F.when(enough, F.try_divide("f", "n")).otherwise(0.0).alias("c"))


def copy_findings(signals: DataFrame, evidence: DataFrame, doc: str = "doc_id", most: int = 5) -> DataFrame:
    """One finding for a document with evidence and a confidence of at least .2.

    ``evidence`` (doc, cref, text, sim, label, spec_text) are flagged chunks, label sim,
    and hard sentences, label sent_sim; each place counts once, chunks first, nearest
    first, and ``most`` places are named (K5).
    """
    v = {x: F.col(x) for x in ("m", "f", "c", "cov", "s", "h", "ms", "k")}
    sure = C.copy_confidence(v["m"], v["f"], v["c"], v["cov"], v["s"], v["h"], v["ms"], v["k"])
    rows = signals.withColumn("confidence", sure).filter(((v["f"] > 0) | (v["s"] > 0)) & (F.col("confidence") >= 0.2))
    order = [F.when(F.col("label") == "sim", 0).otherwise(1), F.desc("sim"), F.col("text")]
    one = O.first_by(evidence.filter("cref IS NOT NULL"), [doc, "cref"], order)
    top = one.withColumn("at", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).filter(F.col("at") <= most)
    held = top.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("at", "cref", "text", "label", "sim", "spec_text"))).alias("places"))
    rows = rows.join(held, doc, "left")
    summary = F.format_string("Detected similarity with the official specification: contamination=%.2f, coverage=%.2f, %d/%d chunks flagged, %d hard sentence matches", F.bround(v["c"], 2), F.bround(v["cov"], 2), v["f"], F.col("n"), v["h"])
    r = lambda c: F.round(c, 4)
    stats = F.array(stat("contamination_score", r(v["c"])), stat("spec_coverage_score", r(v["cov"])), stat("n_flagged_chunks", v["f"]), stat("n_total_chunks", F.col("n")), stat("max_chunk_sim", r(v["m"])), stat("n_hard_sentences", v["h"]), stat("n_corroborated", v["k"]), stat("max_sentence_sim", r(v["ms"])))
    models = F.transform("places", lambda x: F.struct(F.lit(V.EMBEDDING_MODEL).alias("model_name"), x["label"].alias("label"), F.round(x["sim"], 4).alias("score"), F.create_map(F.lit("spec_text"), x["spec_text"]).alias("raw")))
    rows = rows.select(
        doc, F.lit(0).alias("seq"), F.lit("COPY").alias("ac_code"), F.lit("Specification text detected").alias("title"), summary.alias("summary"), C.copy_severity(v["m"], v["c"], v["k"], v["h"]).alias("severity"), "confidence",
        F.get("places", F.lit(0))["cref"].alias("cref"), F.substring(F.get("places", F.lit(0))["text"], 1, 300).alias("item_text"), stats.alias("stats"), models.alias("model_evals"),
        C.copy_notes(v["m"], v["f"], v["c"], v["cov"], v["s"], v["h"], v["ms"], v["k"]).alias("notes"),
    )
    return finding(rows, "integrity_analyser", doc)


def sentence_language(preferred: Column, detected: Column) -> Column:
    """The document's language, else the detected one, else English."""
    return F.when(preferred.isin(*V.LANGUAGES), preferred).when(detected.isin(*V.LANGUAGES), detected).otherwise("en")


def document_language(words: Column, detected: Column, probability: Column) -> Column:
    """English for short texts, other languages, and where the detector isn't sure."""
    sure = detected.isin(*V.LANGUAGES) & (probability >= 0.8)
    return F.when((words >= 20) & sure, detected).otherwise("en")


def comment_language(text: Column, detected: Column) -> Column:
    """Unknown for short comments, without letters, and in other languages."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    judged = (F.length(bare) >= 5) & bare.rlike("[A-Za-zÀ-ž]") & detected.isin(*V.LANGUAGES)
    return F.when(F.coalesce(judged, F.lit(False)), detected).otherwise("unknown")
