"""Findings: rule selection, judge verdicts with their audit, rule engine, scoring, exports (F4, F9, G1-G4, J3, J4, W7, W8, W10, SNK4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaya.functions import columns as C


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key (W7, W10, J19); with descending order, the last one wins."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__at", at).filter("__at = 1").drop("__at")


def select_rules(rules: DataFrame, config: DataFrame) -> DataFrame:
    """Rules of an analyser for a course and language, without disabled codes; null in a rule means any."""
    c, r = config.alias("c"), rules.alias("r")
    fits = (F.col("r.analyser_id") == F.col("c.analyser_id")) & (F.col("r.course").isNull() | (F.col("r.course") == F.col("c.course")))
    fits &= F.col("r.language").isNull() | (F.col("r.language") == F.col("c.language"))
    return r.join(c, fits).filter(~F.array_contains("c.disabled_codes", F.col("r.ac_code")))


def judge_batch(findings: DataFrame) -> DataFrame:
    """Findings without any evidence are not to be judged."""
    evidence = F.coalesce(F.size("anchors"), F.lit(0)) + F.coalesce(F.size("stats"), F.lit(0)) + F.coalesce(F.size("model_evals"), F.lit(0))
    waiting = F.col("judge_status") == "to_be_judged"
    return findings.withColumn("judge_status", F.when(waiting & (evidence <= 0), "not_to_be_judged").otherwise(F.col("judge_status")))


AUDITED = ("summary", "severity", "confidence", "snippet")


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, seq: str, judge_model: str, reasoning: str | None = None) -> DataFrame:
    """Status by decision; only an adjustment changes severity, confidence, summary and the first snippet; of two verdicts the last counts.

    A snippet is that of the first of ``anchors``, or a column of its own. Where there is
    a verdict, the column judge holds the decision, the rationale and, if anything
    changed, the names of what did and the values before and after.
    """
    last = first_by(verdicts, ["finding_id"], [F.desc(seq)]).drop(seq).withColumn("__verdict", F.lit(True))
    last = last.select("finding_id", "__verdict", *[c if c in last.columns else F.lit(None).cast("string").alias(c) for c in ("decision", "rationale")], *[c for c in last.columns if c.startswith("adjusted_")])
    rows = findings.join(last, "finding_id", "left")
    nested = "anchors" in findings.columns and "struct" in dict(findings.dtypes)["anchors"] and "snippet" in dict(findings.dtypes)["anchors"]
    if nested:
        rows = rows.withColumn("snippet", F.get("anchors", F.lit(0))["snippet"])
    audited = [c for c in AUDITED if c in rows.columns]
    adjusted = F.col("decision") == "adjusted"
    new = {}
    for name in audited:
        old = F.col(name)
        if f"adjusted_{name}" in last.columns:
            # A finding without an anchor has no snippet that could change.
            has = F.size("anchors") > 0 if name == "snippet" and nested else F.col("cref").isNotNull() if name == "snippet" and "cref" in rows.columns else F.lit(True)
            new[name] = F.when(adjusted & has, F.coalesce(f"adjusted_{name}", name)).otherwise(old)
        else:
            new[name] = old
    changed = F.array_compact(F.array(*[F.when(~x.eqNullSafe(F.col(c)), F.lit(c)) for c, x in new.items()], F.lit(None).cast("string")))
    any_ = F.size(changed) > 0
    before, after = F.struct(*[F.col(c).alias(c) for c in audited]), F.struct(*[x.alias(c) for c, x in new.items()])
    audit = F.struct("decision", "rationale", F.lit(reasoning).cast("string").alias("reasoning_chain"), F.when(any_, changed).alias("fields"), F.when(any_, before).alias("before"), F.when(any_, after).alias("after")) if audited else F.struct("decision", "rationale")
    told = F.coalesce(F.col("__verdict"), F.lit(False))
    status = F.when(told & F.col("decision").isin("dismissed", "approved", "adjusted"), F.concat(F.lit("judged_"), F.col("decision"))).otherwise(F.col("judge_status"))
    judge = F.when(told, F.lit(judge_model))
    rows = rows.withColumns({**{f"__new_{c}": x for c, x in new.items()}, "judge": F.when(told, audit), "judge_status": status, "judge_model": judge})
    rows = rows.withColumns({c: F.col(f"__new_{c}") for c in new})
    if nested:
        rows = rows.withColumn("anchors", F.transform("anchors", lambda a, k: F.when(k == 0, a.withField("snippet", F.col("snippet"))).otherwise(a)))
    return rows.select(*dict.fromkeys([*findings.columns, "judge_model", "judge"]))


def rule_engine(findings: DataFrame, doc: str, seq: str) -> DataFrame:
    """Dismissed findings go first, then repeats of an id in a document."""
    return first_by(findings.filter(F.coalesce(F.col("judge_status") != "judged_dismissed", F.lit(True))), [doc, "finding_id"], [F.col(seq)])


def number_ids(findings: DataFrame, doc: str, prefix: str, order: list[str]) -> DataFrame:
    """PREFIX-n within each document."""
    at = F.row_number().over(Window.partitionBy(doc, prefix).orderBy(*order))
    return findings.withColumn("finding_no", F.concat_ws("-", F.upper(F.col(prefix)), at.cast("string")))


def last_rules(rules: DataFrame) -> DataFrame:
    """One rule for each code, the last in position, or in order where rules have none."""
    order = F.col("position") if "position" in rules.columns else F.monotonically_increasing_id()
    return first_by(rules.withColumn("__position", order), ["ac_code"], [F.desc("__position")]).drop("__position")


def score(findings: DataFrame, rules: DataFrame, code: str, max_points: Column | None) -> DataFrame:
    """Impact by the rule of a finding's code, null without one; of two rules of a code the last counts."""
    one = last_rules(rules).drop("position").withColumnRenamed("ac_code", "__rule")
    return findings.join(one, findings[code] == one["__rule"], "left").drop("__rule").withColumn("impact", C.impact(F.col("severity_weight"), F.col("severity"), max_points))


def csv_rows(findings: DataFrame, doc: str, max_points: float) -> DataFrame:
    """Each finding with its document's points (SNK3)."""
    total = F.coalesce(F.sum("impact").over(Window.partitionBy(doc)), F.lit(0.0))
    return findings.withColumn("doc_points", C.rounded(F.lit(max_points) + total, 2))


def grader_rows(findings: DataFrame, doc: str, seq: str, label: Column) -> DataFrame:
    """One row for each document, its findings joined in order (SNK4)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), label.alias("t"))))
    return findings.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ", ").alias("comment"))
