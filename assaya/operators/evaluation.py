"""Agreement of two sets of codes for each unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_sets(rows: DataFrame, unit: str, code: str, is_tool: Column, is_gold: Column) -> DataFrame:
    """For each unit the codes of both sides, and what they share, miss and add (O1)."""
    sets = rows.groupBy(unit).agg(F.collect_set(F.when(is_tool, F.col(code))).alias("tool"), F.collect_set(F.when(is_gold, F.col(code))).alias("gold"))
    return sets.withColumns({"overlap": F.array_intersect("tool", "gold"), "missed": F.array_except("gold", "tool"), "added": F.array_except("tool", "gold")})


def per_code(sets: DataFrame) -> DataFrame:
    """Counts of units by code with precision, recall and F1, which is null if either is 0 or unknown."""
    flat = sets.select(F.explode(F.array_union("tool", "gold")).alias("code"), "tool", "gold")
    has = lambda c: F.array_contains(c, F.col("code")).cast("int")
    counts = flat.select("code", has("tool").alias("t"), has("gold").alias("g")).groupBy("code").agg(F.sum("t").alias("n_tool"), F.sum("g").alias("n_gold"), F.sum(F.col("t") * F.col("g")).alias("n_agree"))
    counts = counts.withColumns({"precision": F.round(F.try_divide("n_agree", "n_tool"), 4), "recall": F.round(F.try_divide("n_agree", "n_gold"), 4)})
    p, r = F.col("precision"), F.col("recall")
    return counts.withColumn("f1", F.when((p > 0) & (r > 0), F.round(2 * p * r / (p + r), 4)))


def macro(codes: DataFrame) -> DataFrame:
    """Means over codes of the rounded values that are known; the strict mean counts unknown F1 as 0."""
    return codes.agg(F.round(F.avg("precision"), 4).alias("macro_precision"), F.round(F.avg("recall"), 4).alias("macro_recall"), F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(F.avg(F.coalesce("f1", F.lit(0.0))), 4).alias("macro_f1_strict"))


def micro(sets: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Ratios of sums in groups of at least ``least`` units; blank groups are left out."""
    groups = sets.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("overlap")).alias("n_overlap"), F.sum(F.size("tool")).alias("n_tool"), F.sum(F.size("gold")).alias("n_gold"))
    return groups.filter(F.col("n") >= least).withColumns({"precision": F.round(F.try_divide("n_overlap", "n_tool"), 4), "recall": F.round(F.try_divide("n_overlap", "n_gold"), 4)})
