"""The stages of the corpus pipeline: language ID, exact dedup, near-dedup, secret scans, packing.

Each reads what the one before it kept, and its decision takes effect: documents
without a language go, of equal texts the one with the largest doc_id stays, of
near copies the one with the smallest doc_id, secrets are masked, and what is left
is packed into sequences. All but the last return the columns of documents, further
ones included. Rows that repeat a doc_id are told apart by their text among exact
copies, and one row stays of those that repeat both, also without a doc_id; among
near copies all rows of a doc_id stay if one of them does. A row without a doc_id
stays unless it is a copy of one with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaya.llm.common import ascii_lower, small_batches
from assaya.llm.exact_dedup import exact_dedup
from assaya.llm.language_id import held_out, predict, train
from assaya.llm.packing import pack
from assaya.llm.secrets import redact, vocabulary_words
from assaya.llm.simhash import similar_documents

#: A document is rejected if no language has at least this probability, or if it has no letters.
LEAST_SCORE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language; all, if there is no labelled text to learn languages from."""
    small_batches(spark)
    model = train(docs.filter(~held_out(docs["doc_id"])))
    if model is None:
        return docs
    judged = predict(docs, model, docs.columns, ("__lang_pred", "__score"))
    return judged.filter((F.col("__lang_pred") != "und") & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def only(docs: DataFrame, kept: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are among the rows of ``kept``; nulls are equal."""
    named = kept.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = [x.eqNullSafe(F.col(f"__{k}")) for k, x in keys.items()]
    return docs.join(named, same, "left_semi")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of equal texts, and one row of those that repeat it with its text."""
    small_batches(spark)
    digest = F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)
    kept = exact_dedup(docs).filter("kept").groupBy(F.col("doc_id").alias("__doc_id"), F.col("text_sha256").alias("__digest")).agg(F.count(F.lit(1)).alias("__rows"))
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__doc_id")) & (digest == F.col("__digest")))
    once = rows.filter(F.col("__rows") == 1)
    again = rows.filter(F.col("__rows") > 1).dropDuplicates(["__doc_id", "__digest"])  # few, so texts aren't shuffled for them
    return once.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near copies: texts whose five-word shingles have a similarity of 0.8 or more."""
    small_batches(spark)
    return only(docs, similar_documents(docs).filter("doc_id <=> component_id"), {"doc_id": docs["doc_id"]})


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; the count of characters follows the text."""
    import public_tokenizers

    small_batches(spark)
    columns = docs.columns
    masked = redact(docs, words=vocabulary_words(public_tokenizers.path("word_bpe_49k.json")))
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents into sequences."""
    import public_tokenizers

    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
