"""A corpus pipeline of five stages: language ID, exact dedup, near-dedup, secret scans, packing.

Each stage reads what the one before it kept, as a written table; what a stage keeps
is told in assaya.llm.stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaya.llm.common import read_table, written
from assaya.llm.stages import exact_copies, languages, near_copies, packing, secrets

STAGES = [
    ("language ID", languages),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("secret scans", secrets),
    ("packing", packing),
]
#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
