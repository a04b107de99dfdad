"""Rules of single analysers, and where a rule is run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Codes that only Czech and Slovak prose is judged by, and the codes into which CH is split.
LANGUAGE_CODES = ["CH", "GRAMMAR", "SPELLING"]
SPLIT_CODES = ["GRAMMAR", "SPELLING"]


def content_rules(selected: DataFrame) -> DataFrame:
    """Selected rules without those of language, but for Czech and Slovak."""
    return selected.filter(F.coalesce(F.col("language").isin("cs", "sk"), F.lit(False)) | ~F.col("ac_code").isin(LANGUAGE_CODES))


def grammar_rules(fitting: DataFrame, config: str) -> DataFrame:
    """English configurations take the split codes where they have any, else CH, of whichever analyser."""
    rows = fitting.filter((F.col("language") == "en") & F.col("ac_code").isin("CH", *SPLIT_CODES)).withColumn("__split", F.col("ac_code").isin(SPLIT_CODES))
    return rows.withColumn("__any", F.max("__split").over(Window.partitionBy(config))).filter(F.col("__split") == F.col("__any")).drop("__split", "__any")


def integrity_rules(selected: DataFrame, engine: Column) -> DataFrame:
    """A local engine finds copies by itself, so that rule isn't asked of a model."""
    return selected.filter((F.col("ac_code") != "COPY") | F.coalesce(engine != "local", F.lit(True)))


def backend_route(backend: Column, needs_pages: Column, n_pages: Column) -> Column:
    """classifier, pages, diagrams, or skipped where page rules meet no page (F8)."""
    return F.when(backend == "classifier", "classifier").when(needs_pages & (F.coalesce(n_pages, F.lit(0)) == 0), "skipped").when(needs_pages, "pages").otherwise("diagrams")


def known_codes(findings: DataFrame, rules: DataFrame, code: str) -> DataFrame:
    """Findings whose code the rulebook has."""
    return findings.join(rules.select(F.col("ac_code").alias(code)).distinct(), code, "left_semi")
