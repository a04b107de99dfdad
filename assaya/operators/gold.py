"""Evaluation of a tool's findings against gold grading (E1-E5, A13-A22, J6, F1, X32, X33): students, groups, operational figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaya import fixed_values as V
from assaya.functions import columns as C
from assaya.operators import analytics as A

KEYS = ["student_id", "task_variant"]


def gold_rows(events: DataFrame) -> DataFrame:
    """Events of documentation codes, by alias."""
    return events.filter(C.alias_code(F.col("code")).isin(V.DOC_CODES))


def bonus_students(events: DataFrame) -> DataFrame:
    """Students with a signed positive impact of a bonus code (A18, J8), from events of all codes."""
    return events.filter(F.col("code").isin(V.BONUS_CODES) & F.coalesce("impact_has_sign", F.lit(False)) & (F.col("impact") > 0)).select("student_id").distinct()


def _codes(sets: Column) -> Column:
    return F.array_join(F.array_sort(sets), "|")


def compare_students(gold: DataFrame, final: DataFrame, raw: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """A row for each gold student whose final findings there are, with 28 columns.

    ``gold`` has KEYS, seq, code, impact, impact_normalised, impact_has_sign, impact_shared,
    raw_text, doc_points and max_points; ``final`` and ``raw`` have KEYS, ac_code, judge_status,
    impact, generator_model and judge_model. A shared event counts once for each raw_text,
    with its first row. ``present`` are students with final findings, also with none of them.
    """
    signed, shared = F.col("impact").isNotNull() & F.coalesce("impact_has_sign", F.lit(False)), F.coalesce("impact_shared", F.lit(False))
    texts = gold.withColumns({"__s": shared, "__v": F.when(signed, F.col("impact_normalised"))}).groupBy(*KEYS, "__s", F.when(shared, F.col("raw_text")).alias("__t")).agg(
        F.when(F.first("__s"), F.min_by("__v", F.when(F.col("__v").isNotNull(), F.col("seq")))).otherwise(F.sum("__v")).alias("v"),
        F.collect_set(C.canonical_code(F.col("code"))).alias("codes"), F.min(F.struct("seq", F.col("doc_points").cast("long").alias("points"), "max_points")).alias("first"),
    )
    ours = texts.groupBy(*KEYS).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("gold_sum"), F.array_distinct(F.flatten(F.collect_set("codes"))).alias("gold"), F.min("first").alias("first"))
    live = ~F.col("judge_status").eqNullSafe(F.lit("judged_dismissed"))
    named = lambda c, when: F.collect_set(F.when(when & (F.coalesce(F.col(c), F.lit("")) != ""), F.col(c)))
    tool = final.groupBy(*KEYS).agg(named("ac_code", live).alias("tool"), F.coalesce(F.sum(F.when(live, F.col("impact"))), F.lit(0.0)).alias("tool_sum"), named("judge_model", F.lit(True)).alias("judges"))
    first = raw.groupBy(*KEYS).agg(named("ac_code", F.lit(True)).alias("raw"), named("generator_model", F.lit(True)).alias("generators"))
    rows = ours.join(tool, KEYS, "inner" if present is None else "left").join(first, KEYS, "left")
    if present is not None:
        rows = rows.join(present.select(*KEYS).distinct(), KEYS, "left_semi")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({**{c: F.coalesce(c, none) for c in ("tool", "raw", "judges", "generators")}, "tool_sum": F.coalesce("tool_sum", F.lit(0.0)), "points": F.col("first.points"), "most": F.col("first.max_points")})
    rows = rows.withColumns({"overlap": F.array_intersect("gold", "tool"), "missed": F.array_except("gold", "tool"), "added": F.array_except("tool", "gold"), "estimate": F.bround(F.round(F.col("most") + F.col("tool_sum"), 9)).cast("long")})
    pct = lambda x: F.when(F.col("most") > 0, C.rounded(x / F.col("most") * 100, 2))
    size = lambda x, name: F.size(x).cast("long").alias(name)
    normal = F.when(F.col("most") > 0, F.col("tool_sum") / F.col("most")).otherwise(0.0)
    return rows.select(
        *KEYS, F.col("points").alias("doc_points"), F.col("most").alias("max_doc_points"), F.col("estimate").alias("tool_raw_points"), pct(F.col("points")).alias("doc_score_pct"), pct(F.col("estimate")).alias("tool_score_pct"),
        (F.col("estimate") - F.col("points")).alias("points_delta"), pct(F.col("estimate") - F.col("points")).alias("points_delta_pct"),
        F.array_join(F.array_sort("generators"), ", ").alias("generator_models"), F.array_join(F.array_sort("judges"), ", ").alias("judge_models"),
        size("gold", "gold_code_count"), size("tool", "tool_code_count"), size("raw", "raw_code_count"), size("overlap", "overlap_count"), size("missed", "missed_count"), size("added", "added_count"),
        size(F.array_intersect("gold", "raw"), "raw_overlap_count"), size(F.array_except("gold", "raw"), "raw_missed_count"), size(F.array_except("raw", "gold"), "raw_added_count"),
        C.rounded(F.col("gold_sum"), 4).alias("gold_impact_sum"), C.rounded(normal, 4).alias("tool_impact_sum"), C.rounded(normal - F.col("gold_sum"), 4).alias("impact_delta"),
        _codes(F.col("gold")).alias("gold_codes"), _codes(F.col("tool")).alias("tool_codes"), _codes(F.col("overlap")).alias("overlap_codes"), _codes(F.col("missed")).alias("missed_codes"), _codes(F.col("added")).alias("added_codes"),
    )


def code_stats(students: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement, misses and additions of each code within ``keys`` (A13), from the students' joined lists."""
    parts = lambda c: F.when(F.col(c) != "", F.split(c, r"\|")).otherwise(F.array().cast("array<string>"))
    flat = students.select(*keys, *[parts(f"{x}_codes").alias(x) for x in ("gold", "tool")]).select(*keys, F.explode(F.array_union("gold", "tool")).alias("code"), "gold", "tool")
    has = lambda c: F.array_contains(c, F.col("code")).cast("int")
    flat = flat.withColumns({"g": has("gold"), "t": has("tool")})
    counts = flat.groupBy(*keys, "code").agg(
        F.sum(F.col("g") * F.col("t")).alias("agreement"), F.sum(F.col("g") * (1 - F.col("t"))).alias("missed_by_tool"), F.sum(F.col("t") * (1 - F.col("g"))).alias("added_by_tool"), F.sum("g").alias("total_in_gold"), F.sum("t").alias("total_in_tool"),
    )
    counts = counts.withColumns({"precision": F.round(F.try_divide("agreement", "total_in_tool"), 4), "recall": F.round(F.try_divide("agreement", "total_in_gold"), 4)})
    p, r = F.col("precision"), F.col("recall")
    return counts.withColumn("f1", F.when((p > 0) & (r > 0), F.round(2 * p * r / (p + r), 4)))


#: Groups of the evaluation's report: section and column of the students.
SECTIONS = {"per_variant": "task_variant", "per_format": "doc_type", "per_language": "doc_language", "per_generator_model": "generator_models", "per_judge_model": "judge_models"}


def evaluate(students: DataFrame, sections: dict[str, str] | None = None) -> DataFrame:
    """The report's figures for all students and for each group of each section, in one pass.

    Points, macro averages of codes, the correlation of scores with its p-value, and
    instances of codes. Groups without a name are left out.
    """
    sections = SECTIONS if sections is None else sections
    of = [F.struct(F.lit("overall").alias("section"), F.lit("").alias("grp")), *[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.lit(s).alias("section"), F.col(c).cast("string").alias("grp"))) for s, c in sections.items() if c in students.columns]]
    rows = students.withColumn("__g", F.explode(F.array_compact(F.array(*of)))).select("*", "__g.section", "__g.grp").drop("__g")
    keys = ["section", "grp"]
    avg = lambda c: C.rounded(F.avg(c), 2)
    points = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), avg(F.abs("points_delta")).alias("points_mae"), avg("points_delta").alias("points_mean_delta"), avg(F.abs("points_delta_pct")).alias("points_mae_pct"), avg("points_delta_pct").alias("points_mean_delta_pct"),
        F.sum("gold_code_count").alias("total_gold"), F.sum("tool_code_count").alias("total_tool"), F.sum("overlap_count").alias("total_overlap"),
    )
    known = rows.filter("doc_points IS NOT NULL AND tool_raw_points IS NOT NULL").withColumns({"x": F.col("doc_points").cast("double"), "y": F.col("tool_raw_points").cast("double")})
    known = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_scored"), A.safe_corr("x", "y").alias("r"))
    macro = code_stats(rows, keys).groupBy(*keys).agg(*[C.rounded(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    out = points.join(known, keys, "left").join(macro, keys, "left")
    return out.select(
        *keys, "n", "points_mae", "points_mean_delta", "points_mae_pct", "points_mean_delta_pct", "macro_precision", "macro_recall", "macro_f1", F.round("r", 4).alias("pearson_r"), F.round(C.correlation_p("r", "n_scored"), 4).alias("pearson_p"),
        "total_gold", "total_tool", "total_overlap", F.round(F.try_divide("total_overlap", "total_gold"), 4).alias("overlap_rate"),
    )


def operational(students: DataFrame) -> DataFrame:
    """Costs, tokens and times of all students, and the costs of the variants par and int, which are listed also without students."""
    r = lambda c, d=4: C.rounded(c, d)
    cost, took = F.avg("cost_eur"), F.avg("elapsed_seconds")
    total, found = F.nullif(F.coalesce(F.sum("cost_eur"), F.lit(0.0)), F.lit(0.0)), F.nullif(F.sum(F.col("overlap_count") + F.col("added_count")), F.lit(0))
    every = students.agg(
        F.lit("all").alias("scope"), F.count("cost_eur").alias("n"), r(cost).alias("mean_cost_eur"), r(total).alias("total_cost_eur"), r(cost * 600, 2).alias("projected_cohort_cost_eur"), r(F.try_divide(total, found), 6).alias("cost_per_finding_eur"),
        r(F.avg("prompt_tokens")).alias("mean_prompt_tokens"), r(F.avg("completion_tokens")).alias("mean_completion_tokens"), r(F.avg("cached_tokens")).alias("mean_cached_tokens"), r(F.avg(F.try_divide("cached_tokens", "prompt_tokens"))).alias("mean_cache_hit_rate"),
        r(F.avg("n_api_calls")).alias("mean_api_calls"), r(took).alias("mean_elapsed_seconds"), r(F.max("elapsed_seconds")).alias("max_elapsed_seconds"), r(F.try_divide(F.lit(3600.0), took), 1).alias("estimated_docs_per_hour"),
    )
    variants = students.filter(F.col("task_variant").isin("par", "int")).groupBy(F.col("task_variant").alias("scope")).agg(F.count("cost_eur").alias("n"), r(cost).alias("mean_cost_eur"), r(F.sum("cost_eur")).alias("total_cost_eur"))
    listed = students.sparkSession.createDataFrame([("par",), ("int",)], "scope string").join(variants, "scope", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return every.unionByName(listed, allowMissingColumns=True)


def pipeline_stats(raw: DataFrame, judged: DataFrame, final: DataFrame) -> DataFrame:
    """How many findings of each code each stage has; all raw and final ones count, dismissed and adjusted are the judge's (A14). The most raw first."""
    stage = lambda df, name: df.filter(F.coalesce("ac_code", F.lit("")) != "").select("ac_code", F.lit(name).alias("stage"))
    told = judged.withColumn("stage", F.when(F.col("judge_status") == "judged_dismissed", "dismissed").when(F.col("judge_status") == "judged_adjusted", "adjusted")).filter("stage IS NOT NULL AND coalesce(ac_code, '') <> ''").select("ac_code", "stage")
    names = ["raw", "dismissed", "adjusted", "final"]
    wide = stage(raw, "raw").unionByName(told).unionByName(stage(final, "final")).groupBy(F.col("ac_code").alias("code")).pivot("stage", names).count().fillna(0, names)
    return wide.withColumn("survival_rate", F.round(F.try_divide("final", "raw"), 4)).orderBy(F.desc("raw"), "code")
