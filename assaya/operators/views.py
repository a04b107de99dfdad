"""What reports and readers see: impacts by scope, visible findings, scopes, matrices, correlations, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaya import fixed_values as V
from assaya.functions import columns as C
from assaya.operators import analytics as A
from assaya.operators import findings as O


def validated(df: DataFrame, needs: list[str]) -> DataFrame | None:
    """The rows that have all of ``needs``, None if a column is absent."""
    return df.dropna(subset=needs) if set(needs) <= set(df.columns) else None


def known_maximum(df: DataFrame) -> DataFrame:
    """Rows with a known maximum of points."""
    return df.dropna(subset=["max_doc_points", "impact_normalised"])


def impact_rows(df: DataFrame, without_shared: bool = True) -> DataFrame:
    """Rows with an impact; without shared ones rows where that isn't known go too (F2)."""
    rows = df.filter(F.col("impact").isNotNull())
    return rows.filter(~F.col("impact_shared")) if without_shared else rows


def shared_effect(df: DataFrame, n: int, code: str = "code", value: str = "impact_normalised") -> DataFrame:
    """Mean impacts of the ``n`` codes that shared penalties shift most, a row for each scope."""
    own = impact_rows(df, False).groupBy(code).agg(F.avg(F.when(~F.col("impact_shared"), F.col(value))).alias("excl_shared"), F.avg(value).alias("incl_shared")).dropna(subset=["excl_shared", "incl_shared"])
    top = own.withColumn("diff", F.abs(F.col("incl_shared") - F.col("excl_shared"))).orderBy(F.desc("diff"), code).limit(n)
    return top.unpivot([code], ["excl_shared", "incl_shared"], "scope", value)


def dismissed_candidates(judged: DataFrame, final: DataFrame, run: str) -> DataFrame:
    """What the judge dismissed and the final findings don't have."""
    dismissed = judged.filter((F.col("judge_status") == "judged_dismissed") & (F.coalesce(F.col("finding_id").cast("string"), F.lit("")) != ""))
    return dismissed.join(final.select(run, "finding_id"), [run, "finding_id"], "left_anti").withColumn("is_dismissed_candidate", F.lit(True))


def visible(final: DataFrame, dismissed: DataFrame | None, state: DataFrame, run: str, code: str | None = None, show_excluded: bool = False) -> DataFrame:
    """The findings that a reader sees (F12, R21): ``dismissed`` if those are shown too, without hidden codes, without what the reader took out, of one code if asked for."""
    rows = final.withColumn("is_dismissed_candidate", F.lit(False))
    rows = rows if dismissed is None else rows.unionByName(dismissed, allowMissingColumns=True)
    rows = rows.filter(~F.upper(F.trim(F.coalesce("ac_code", F.lit("")))).isin(V.HIDDEN_CODES))
    rows = rows.join(state.select(run, "finding_id", "include"), [run, "finding_id"], "left").withColumn("include", F.coalesce("include", F.lit(True)))
    rows = rows if show_excluded else rows.filter("include")
    return rows if code is None else rows.filter(F.coalesce("ac_code", F.lit("-")) == code)


def reading_order(by_confidence: bool = False) -> Column:
    """Largest deduction first, or highest confidence; unknown ones count as none (K8)."""
    return F.desc(F.coalesce(F.col("confidence") if by_confidence else F.abs("impact"), F.lit(0.0)))


def code_options(rows: DataFrame) -> DataFrame:
    """All, and the codes there are in order."""
    codes = rows.agg(F.sort_array(F.collect_set(F.coalesce("ac_code", F.lit("-")))).alias("c"))
    return codes.select(F.concat(F.array(F.lit("All")), F.col("c")).alias("options"))


def criterion_title(code: Column, rubric: Column, title: Column) -> Column:
    """A finding's title for readers: its rubric's, its own, its code; without a code its own or a remark."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.when(F.coalesce(code, F.lit("")) == "", F.coalesce(some(title), F.lit("Untitled finding"))).otherwise(F.coalesce(some(rubric), some(title), code))


def run_of_prefix(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """The first run by name whose student's first six characters are those of what is ``asked`` for."""
    prefix = lambda c: F.substring(F.trim(c), 1, 6)
    first = runs.groupBy(prefix("run").alias("prefix")).agg(F.min("run").alias("run"))
    return asked.filter(F.trim("student_id") != "").withColumn("prefix", prefix("student_id")).join(first, "prefix").select("student_id", "run")


def stage_means(df: DataFrame, model: str = "generator_models") -> DataFrame | None:
    """Mean times of parsing, analysing and judging by model, the slowest judge first."""
    rows = validated(df, ["parse_time", "analyser_time", "judge_time", model])
    return None if rows is None else rows.groupBy(model).agg(*[F.avg(c).alias(c) for c in ("parse_time", "analyser_time", "judge_time")]).orderBy(F.desc("judge_time"), model)


SCOPE = ["directory_alias", "task_variant", "doc_type", "generator_models", "judge_models"]


def scope_counts(df: DataFrame) -> DataFrame | None:
    """Students of each alias, variant, format and models, unknown ones as empty text."""
    rows = validated(df, SCOPE[:3])
    if rows is None:
        return None
    keys = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in SCOPE]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_students")).orderBy(F.desc("n_students"), *SCOPE)


def describe_all(df: DataFrame) -> DataFrame:
    """Each column's count and, of numbers, mean, deviation and quartiles, of others distinct values and the most frequent.

    Two passes over unpivoted columns; of equally frequent values the smallest counts.
    """
    numbers = [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")]
    others = [c for c in df.columns if c not in numbers]
    out = []
    if numbers:
        v = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "column", "v")
        sums = v.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
        out.append(sums.join(A.percentiles(v, ["column"], F.col("v"), [0.25, 0.5, 0.75]), "column", "left").select("column", "count", "mean", "std", "min", *[F.col("q")[k].alias(n) for k, n in enumerate(("p25", "p50", "p75"))], "max"))
    if others:
        v = df.select(*[F.col(c).cast("string").alias(c) for c in others]).unpivot([], others, "column", "v")
        counts = v.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        best = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("back"), "v")))
        out.append(counts.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("count"), F.count("v").alias("unique"), best.alias("b")).select("column", "count", "unique", F.col("b.v").alias("top"), (-F.col("b.back")).alias("freq")))
    rows = out[0] if len(out) == 1 else out[0].unionByName(out[1], allowMissingColumns=True)
    names = ["column", "count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max"]
    kinds = {"unique": "long", "freq": "long", "top": "string"}
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in names])


def audit_cost(images: DataFrame, width: str, height: str, rate_in: float = 1.25, rate_out: float = 5.0) -> DataFrame:
    """What judging images in a batch would take and cost (A38): 350 tokens of text and 100 of answer each, rates for a million."""
    tokens = C.image_tokens(F.col(width), F.col(height))
    sums = images.agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("image_tokens"))
    into, out = F.col("image_tokens") + 350 * F.col("images"), 100 * F.col("images")
    cost = lambda n, rate: F.round(n / 1e6 * rate, 4)
    return sums.select("images", into.alias("input_tokens"), out.alias("output_tokens"), cost(into, rate_in).alias("input_cost"), cost(out, rate_out).alias("output_cost"), F.round(into / 1e6 * rate_in + out / 1e6 * rate_out, 4).alias("total_cost"))


def presence_matrix(df: DataFrame, unit: str, code: str, codes: list[str]) -> DataFrame:
    """Whether each unit has each of ``codes``, a column for each."""
    return df.groupBy(unit).agg(*[F.coalesce(F.max(F.col(code) == x), F.lit(False)).alias(x) for x in codes])


def score_correlations(df: DataFrame, scores: DataFrame, unit: str, code: str, score: str, n: int) -> DataFrame:
    """The ``n`` most frequent codes with the correlation of their presence and the score, the weakest first.

    Only counts and sums of the units with a code are kept; those without it follow from the totals.
    """
    top = df.groupBy(code).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), code).limit(n)
    own = df.join(top, code).select(unit, code).distinct().join(scores.select(unit, score), unit)
    units = df.select(unit).distinct().join(scores.select(unit, score), unit).filter(F.col(score).isNotNull())
    total = units.agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"))
    per = own.filter(F.col(score).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("k"), F.avg(score).alias("own"))
    p = F.col("k") / F.col("n")
    r = F.try_divide((F.col("own") - F.col("mean")) * p, F.col("sd") * F.sqrt(p * (1 - p)))
    rows = per.join(F.broadcast(total), F.lit(True)).select(F.col(code).alias("code"), F.round(r, 6).alias("correlation"), C.category(F.col(code)).alias("code_category"))  # total is one row
    return rows.orderBy(F.abs("correlation"), "code")


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each value of ``keys``."""
    return O.first_by(df, keys, order)


def ordered_variants(values: DataFrame, column: str) -> DataFrame:
    """The variants there are, in the fixed order."""
    names = [(k, v) for k, v in enumerate(("par", "int"))]
    return values.sparkSession.createDataFrame(names, f"place int, {column} string").join(values.select(column).distinct(), column, "left_semi").orderBy("place")


def student_folders(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """The folder of each student's submission (E9): the first name of the variant's that there is below the year's cohort.

    ``rows`` have student_id, year and task_variant, ``folders`` the paths there are below the root; without a folder a student has no row.
    """
    names = F.create_map(*[x for k, v in V.VARIANT_FOLDERS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    asked = rows.filter(~F.coalesce("year", F.lit("")).isin("", "Unknown", "nan")).select("*", F.posexplode(F.element_at(names, F.lower("task_variant"))).alias("rank", "folder"))
    asked = asked.withColumn("path", F.concat_ws("/", F.concat(F.lit("ipp"), F.col("year")), "folder", "student_id"))
    there = asked.join(folders.select("path").distinct(), "path", "left_semi")
    return O.first_by(there, ["student_id", "year", "task_variant"], [F.col("rank")]).drop("rank")


def inside_listing(paths: DataFrame, files: DataFrame, folder: str, path: str) -> DataFrame:
    """Paths that stay in their document's folder and are there as image files."""
    rows = paths.withColumn("resolved", C.resolved_path(F.regexp_replace(path, "^file://", ""))).filter("resolved IS NOT NULL AND resolved <> ''")
    rows = rows.withColumn("file", F.concat_ws("/", folder, "resolved")).filter(F.lower(F.regexp_extract("resolved", r"(\.[^./]*)$", 1)).isin(*V.DIAGRAM_IMAGES))
    return rows.join(files.select(F.col("path").alias("file")), "file", "left_semi")


def summary_lines(report: DataFrame, codes: DataFrame) -> DataFrame:
    """Lines that sum up an evaluation (E5, K7): of the report's row for all students, and the five codes most missed and most added."""
    one = report.filter("section = 'overall'")
    b = lambda x, d: F.bround(x, d)
    lines = one.select(F.array(
        F.format_string("Students evaluated: %d", "n"), F.format_string("Code overlap vs gold: %.1f%% (%d/%d instances)", b(F.col("overlap_rate") * 100, 1), "total_overlap", "total_gold"),
        F.format_string("Points MAE: %.1f pts (%.2f%% pts) | mean delta: %+.1f pts (%+.2f%% pts)", b(F.col("points_mae"), 1), "points_mae_pct", b(F.col("points_mean_delta"), 1), "points_mean_delta_pct"),
        F.format_string("Macro P/R/F1: %.3f / %.3f / %.3f", *[b(F.col(f"macro_{c}"), 3) for c in ("precision", "recall", "f1")]),
    ).alias("lines"))

    def top(column: str, label: str) -> DataFrame:
        best = codes.filter(F.col(column) > 0).orderBy(F.desc(column), "code").limit(5)
        said = F.array_sort(F.collect_list(F.struct((-F.col(column)).alias("back"), "code", F.concat("code", F.lit("("), F.col(column).cast("string"), F.lit(")")).alias("s"))))
        return best.agg(F.array(F.concat(F.lit(label), F.array_join(F.transform(said, lambda x: x["s"]), ", "))).alias("lines"))

    parts = [lines, top("missed_by_tool", "Top missed codes: "), top("added_by_tool", "Top added codes:  ")]
    every = parts[0].withColumn("part", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("part", F.lit(k)))
    return every.select("part", F.posexplode("lines").alias("place", "line"))


def found_snippets(pages: DataFrame, doc: str = "doc_id", html: str = "html", ranges: str = "ranges") -> DataFrame:
    """Where the snippets of a page's findings stand in its markup, in their order.

    Words may have tags and white space between them; each search starts where the
    last one ended, so that equal snippets are told apart. Image references and marks
    around a snippet don't count; a snippet that isn't there has no row.
    """
    import re

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, text, snippets in zip(rows[doc], rows[html], rows[ranges], strict=True):
                cursor = 0
                for place, snippet in enumerate(snippets if snippets is not None else []):
                    words = re.sub(r"!\[.*?\]\(.*?\)", "", snippet or "").strip("*_`# \n").split()
                    found = re.compile(r"(?:<[^>]+>|\s)*".join(map(re.escape, words))).search(text or "", cursor) if words else None
                    if found:
                        cursor = found.end()
                        out.append((key, place, found.start(), found.end()))
            yield pd.DataFrame(out, columns=[doc, "place", "start", "stop"])

    return pages.select(doc, html, ranges).mapInPandas(run, f"{doc} {dict(pages.dtypes)[doc]}, place int, start int, stop int")


def chunks(items: DataFrame, most: int, doc: str = "doc_id") -> DataFrame:
    """Items of a section that follow each other, put together up to ``most`` words (X41): doc, chunk, cref of the first, text.

    A longer item is a chunk of its own. The work is a document's at a time.
    """
    rows = items.withColumn("__n", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).filter("__n > 0").select(doc, "seq", "cref", "section_path", "text", "__n")

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out: list[list] = []
        section, size = None, 0
        for cref, path, text, n in zip(pdf["cref"], pdf["section_path"], pdf["text"], pdf["__n"], strict=True):
            if not out or path != section or size + n > most:
                out.append([cref, path, []])
                section, size = path, 0
            out[-1][2].append(text)
            size += n
        return pd.DataFrame({doc: pdf[doc].iloc[0], "chunk": range(len(out)), "cref": [x[0] for x in out], "section_path": [x[1] for x in out], "text": ["\n".join(x[2]) for x in out]})

    return rows.groupBy(doc).applyInPandas(put, f"{doc} {dict(items.dtypes)[doc]}, chunk int, cref string, section_path string, text string")


def keyword_codes(df: DataFrame, code: str, text: str, n: int, most: int = 3) -> DataFrame:
    """The ``n`` most frequent words of comments with the ``most`` codes that have them most often."""
    words = C.keyword_rows(df, [code], text)
    top = words.groupBy("keyword").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "keyword").limit(n)
    pairs = words.join(F.broadcast(top.select("keyword")), "keyword").groupBy("keyword", code).agg(F.count(F.lit(1)).alias("n"))  # n rows are broadcast
    best = A.top_by(pairs, ["keyword"], [F.desc("n"), F.col(code)], most)
    names = best.groupBy("keyword").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(code).alias("c")))), lambda x: x["c"]), ", ").alias("top_codes"))
    return top.join(names, "keyword", "left")
