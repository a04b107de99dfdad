"""Documents as ordered items: Markdown lines and items, counters, headings, section paths, offsets, words shared with a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


RULE_LINE = r"^(-[ \t]*){3,}$|^(\*[ \t]*){3,}$|^(_[ \t]*){3,}$"


def markdown_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of Markdown with their kind, and the item they belong to with its first line (T13, a subset of CommonMark).

    Kinds are code (fenced), blank, heading, underline (of a heading above it), rule,
    picture, table, list and text. Text goes on with the paragraph or list item before.
    """
    lines = docs.select(doc, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).withColumns({"line_no": F.col("line_no") + 1, "line": F.regexp_replace("line", "\r$", "")})
    w = Window.partitionBy(doc).orderBy("line_no")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    bare = F.regexp_replace("line", r"^[ \t]+|[ \t]+$", "")
    lines = lines.withColumns({"bare": bare, "fence": F.startswith(bare, F.lit("```"))}).withColumn("fences", F.sum(F.col("fence").cast("int")).over(running))
    b = F.col("bare")
    kind = (
        F.when(F.col("fence") | (F.col("fences") % 2 == 1), "code").when(b == "", "blank").when(b.rlike(r"^#{1,6}([ \t]|$)"), "heading").when(b.rlike(r"^(=+|-+)$"), "line").when(b.rlike(RULE_LINE), "rule")
        .when(b.rlike(r"^!\[[^\]]*\]\("), "picture").when(F.startswith(b, F.lit("|")), "table").when(b.rlike(r"^([-*+]|\d+[.)])[ \t]"), "list").otherwise("text")
    )
    lines = lines.withColumn("kind", kind).withColumn("before", F.lag("kind").over(w))
    plain = F.when(b.rlike(r"^-{3,}$"), "rule").otherwise("text")
    lines = lines.withColumn("kind", F.when(F.col("kind") != "line", F.col("kind")).when(F.col("before") == "text", "underline").otherwise(plain)).withColumn("before", F.lag("kind").over(w))
    k, before = F.col("kind"), F.coalesce("before", F.lit(""))
    goes_on = (k == "underline") | ((k == "text") & before.isin("text", "list")) | ((k == "table") & (before == "table")) | ((k == "code") & ~(F.col("fence") & (F.col("fences") % 2 == 1)))
    lines = lines.withColumn("starts", ~goes_on)
    return lines.withColumns({"item_no": F.sum(F.col("starts").cast("int")).over(running), "start_line": F.max(F.when(F.col("starts"), F.col("line_no"))).over(running)}).drop("before", "starts", "fences")


def markdown_items(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Items of Markdown in order: headings with levels, paragraphs as text, list items, code, tables, pictures."""
    lines = markdown_lines(docs, doc, text).filter(~F.col("kind").isin("blank", "rule"))
    b = F.col("bare")
    said = F.when(F.col("kind") == "heading", F.regexp_replace(F.regexp_replace(b, r"^#{1,6}[ \t]*", ""), r"[ \t]+#+$", "")).when(F.col("kind") == "list", F.regexp_replace(b, r"^([-*+]|\d+[.)])[ \t]+", "")).when(F.col("kind") == "code", F.col("line")).otherwise(b)
    own = F.when((F.col("kind") != "underline") & ~F.col("fence"), F.struct("line_no", said.alias("said")))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(b, r"^(#{1,6})", 1))).when(F.col("kind") == "underline", F.when(F.startswith(b, F.lit("=")), 1).otherwise(2))
    items = lines.groupBy(doc, "item_no").agg(F.min_by("kind", "line_no").alias("kind"), F.max(level).alias("level"), F.array_sort(F.collect_list(own)).alias("said"), F.min("line_no").alias("start_line"))
    items = items.withColumn("kind", F.when(F.col("level").isNotNull(), "heading").otherwise(F.col("kind")))
    own = F.transform("said", lambda x: x["said"])
    joined = F.when(F.col("kind").isin("code", "table"), F.array_join(own, "\n")).otherwise(F.array_join(own, " "))
    family = F.when(F.col("kind") == "picture", "pictures").when(F.col("kind") == "table", "tables").otherwise("texts")
    items = items.withColumns({"text": joined, "family": family})
    at = F.row_number().over(Window.partitionBy(doc, "family").orderBy("item_no")) - 1
    return items.select(doc, F.col("item_no").alias("seq"), F.concat(F.lit("#/"), F.col("family"), F.lit("/"), at.cast("string")).alias("cref"), "kind", "level", "text", "start_line")


def document_counts(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Counters of documents by their items (A34): words and characters of all text, paragraphs, headings, pictures.

    Pictures inside of text count too; what tables hold is no text.
    """
    text = F.col("kind").isin("text", "list", "heading", "code") & (F.trim("text") != "")
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    inside = F.when(F.col("kind") != "code", F.regexp_count("text", F.lit(r"!\[[^\]]*\]\(")))
    return items.groupBy(doc).agg(
        F.coalesce(F.sum(F.when(text, words)), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(text, F.length("text"))), F.lit(0)).cast("long").alias("chars"), F.count_if(F.col("kind") == "text").alias("paragraphs"),
        F.count_if((F.col("kind") == "heading") & (F.trim("text") != "")).alias("headings"), F.coalesce(F.sum(inside), F.lit(0)).cast("long").alias("pictures"),
    )


def empty_sections(items: DataFrame, doc: str, seq: str, is_heading: Column, level: Column) -> DataFrame:
    """Headings that the next item doesn't fill: equal .8, deeper .6, shallower .9, trailing .8."""
    w = Window.partitionBy(doc).orderBy(seq)
    marked = items.withColumns({"__h": is_heading, "__l": level}).withColumns({"next_heading": F.lead("__h").over(w), "next_level": F.lead("__l").over(w)})
    found = marked.filter(F.col("__h") & F.coalesce("next_heading", F.lit(True)))
    severity = F.when(F.col("next_level").isNull() | (F.col("next_level") == F.col("__l")), 0.8).when(F.col("next_level") > F.col("__l"), 0.6).otherwise(0.9)
    return found.withColumn("severity", severity).drop("__h", "__l", "next_heading", "next_level")


def section_paths(items: DataFrame, doc: str, seq: str) -> DataFrame:
    """The stack of headings above each item, joined by " > " (W3).

    A heading of level n keeps n - 1 of the stack and goes on top; blank headings
    don't count. Only a document's headings are put together; items then take the
    path of the last heading before them.
    """
    heading = (F.col("kind") == "heading") & (F.trim("text") != "")
    running = Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    numbered = items.withColumn("__h", F.count_if(heading).over(running))
    own = items.filter(heading).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), "level", F.trim("text").alias("text")))).alias("hs"))
    nothing = F.expr("named_struct('stack', cast(array() as array<string>), 'paths', cast(array() as array<string>))")

    def push(state: Column, h: Column) -> Column:
        stack = F.concat(F.slice(state["stack"], F.lit(1), F.greatest(h["level"] - 1, F.lit(0))), F.array(h["text"]))
        return F.struct(stack.alias("stack"), F.concat(state["paths"], F.array(F.array_join(stack, " > "))).alias("paths"))

    paths = own.select(doc, F.posexplode(F.aggregate("hs", nothing, push)["paths"]).alias("__n", "section_path")).select(doc, (F.col("__n") + 1).cast("long").alias("__h"), "section_path")
    return numbered.join(paths, [doc, "__h"], "left").withColumn("section_path", F.coalesce("section_path", F.lit(""))).drop("__h")


def offsets(items: DataFrame, doc: str, seq: str, text: str) -> DataFrame:
    """Where each item's text starts and ends when they are joined by one character."""
    w = Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(F.coalesce(F.col(text), F.lit(""))) + 1).over(w), F.lit(0))
    return items.withColumn("start", start).withColumn("end", F.col("start") + F.length(F.coalesce(F.col(text), F.lit(""))))


def counters(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, characters and lines with text."""
    return docs.select(doc, F.size(F.regexp_extract_all(text, F.lit(r"[^\s]+"), F.lit(0))).cast("long").alias("words"), F.length(text).cast("long").alias("chars"), F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("long").alias("blocks"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def shingles(words: Column, size: int) -> Column:
    """Runs of ``size`` words, distinct (X41). ``words`` should be a column of its own: lambdas work their arguments out for each element."""
    starts = F.sequence(F.lit(1), F.size(words) - (size - 1))
    return F.array_distinct(F.when(F.size(words) >= size, F.transform(starts, lambda k: F.array_join(F.slice(words, k, F.lit(size)), " "))).otherwise(F.array().cast("array<string>")))


#: Shingles of a source that are broadcast at most, so that documents aren't shuffled.
BROADCAST_SHINGLES = 1_000_000


def shared_shingles(docs: DataFrame, spec: DataFrame, doc: str, item: str, size: int = 8) -> DataFrame:
    """How many shingles each document shares with each source item (J11): documents meet the source's shingles by a hash, then word for word.

    The source's shingles are broadcast if they are few enough, so only matches are
    ever shuffled; otherwise both sides are dealt out by the hash.
    """
    cut = lambda df, key: df.select(key, words_of(F.col("text")).alias("w")).select(key, F.explode(shingles(F.col("w"), size)).alias("g")).select(key, "g", F.xxhash64("g").alias("h"))
    a, b = cut(docs, doc), cut(spec, item)
    if b.count() <= BROADCAST_SHINGLES:
        b = F.broadcast(b)
    return a.join(b, ["h", "g"]).groupBy(doc, item).agg(F.count(F.lit(1)).alias("shared"))
