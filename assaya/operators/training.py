"""Training sets: exact dedup, splits, audits (W11, W13, E9-E11, SNK7)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assaya.operators.findings import first_by


def dedup_by_content(rows: DataFrame, content: str, order: list[Column]) -> DataFrame:
    """The first row of each content hash over all sources."""
    return first_by(rows.withColumn("content_hash", F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256)), ["content_hash"], order)


def group_split(groups: DataFrame, key: str, seed: str, train: float = 0.8, valid: float = 0.2, rounded_up: bool = False) -> DataFrame:
    """Each group to train, valid or test by its place in the order of a salted hash (W13): cuts at whole numbers.

    Places are counted within the 4096 first parts of a hash; only the counts of these parts are added up in one task.
    """
    hashed = groups.select(key).distinct().withColumn("h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("part", F.substring("h", 1, 3))
    sizes = hashed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    whole = Window.orderBy("part")
    before = sizes.select("part", (F.sum("size").over(whole) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("n"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("h", key)) - 1 + F.col("before")
    placed = hashed.join(F.broadcast(before), "part").withColumn("at", at)
    if rounded_up:  # of two parts the second
        return placed.select(key, F.when(F.col("at") < F.col("n") - F.ceil(F.col("n") * valid), "train").otherwise("test").alias("split"))
    cut_1, cut_2 = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + valid))
    return placed.select(key, F.when(F.col("at") < cut_1, "train").when(F.col("at") < cut_2, "valid").otherwise("test").alias("split"))


def unique_names(rows: DataFrame, folder: str, name: str, order: list[str]) -> DataFrame:
    """A suffix _2, _3, ... where names meet in a folder, the lowest that no earlier row has taken (SNK7).

    Only names that differ in such a suffix can meet, so each of their families is named
    by itself, row by row; a family of one name, the usual case, is numbered by a window.
    """
    at = F.row_number().over(Window.partitionBy(folder, name).orderBy(*order))
    stem, ext = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r".(\.[^.]*)$", 1)
    root = F.regexp_replace(stem, r"(_\d+)+$", "")
    marked = rows.withColumns({"__root": root, "__stem": stem, "__ext": ext})
    family = marked.groupBy(folder, "__root", "__ext").agg((F.min(name) != F.max(name)).alias("__mixed"))
    marked = marked.join(family, [folder, "__root", "__ext"])
    plain = marked.filter("NOT __mixed").withColumn("unique_name", F.when(at == 1, F.col(name)).otherwise(F.concat("__stem", F.lit("_"), at.cast("string"), "__ext")))

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        taken, names, last = set(), [], {}
        for own, stem, ext in zip(pdf[name], pdf["__stem"], pdf["__ext"], strict=True):
            new, n = own, last.get(own, 1)
            while new in taken:
                n += 1
                new = f"{stem}_{n}{ext}"
            last[own] = n
            taken.add(new)
            names.append(new)
        return pdf.assign(unique_name=names)

    mixed = marked.filter("__mixed")
    named = mixed.groupBy(folder, "__root", "__ext").applyInPandas(put, mixed.withColumn("unique_name", F.lit("")).schema)
    return plain.unionByName(named).drop("__root", "__stem", "__ext", "__mixed")


def audit_results(results: DataFrame) -> DataFrame:
    """Label and analysis from a batch result's nested JSON; without a known label both are null (X34, SRC14)."""
    content = F.get_json_object("value", "$.response.body.choices[0].message.content")
    label = F.upper(F.trim(F.get_json_object(content, "$.classification")))
    known = label.isin("GOODUML", "BADUML", "INVALID")
    return results.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.when(known, label).alias("label"), F.when(known, F.coalesce(F.trim(F.get_json_object(content, "$.analysis")), F.lit(""))).alias("analysis"))


def within_size(files: DataFrame, most: int = 10 * 1024 * 1024) -> DataFrame:
    """Images that a training request may hold (E11); ``length`` is what a listing gives, so no content is read."""
    return files.filter((F.col("length") > 0) & (F.col("length") <= most))


def random_split(rows: DataFrame, key: str, seed: str, test: float = 0.2) -> DataFrame:
    """Single rows to train or test by the place in the order of a salted hash (W14); the share of the test part is rounded up."""
    return group_split(rows, key, seed, 1 - test, test, rounded_up=True)


def token_counts(docs: DataFrame, most: int, tokenizer: str | None = None) -> DataFrame:
    """Tokens of the first ``most`` documents of each format md and pdf (E8): by a tokenizer's file, else words."""
    some = docs.filter(F.col("format").isin("md", "pdf")).withColumn("__at", F.row_number().over(Window.partitionBy("format").orderBy("doc_id"))).filter(F.col("__at") <= most).drop("__at")
    if tokenizer is None:
        return some.withColumn("tokens", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))))
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(model)
        for texts in batches:
            yield pd.Series([len(x.ids) for x in own.encode_batch_fast(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return some.withColumn("tokens", F.pandas_udf(count, "long")("text"))


def audited(lines: DataFrame, mapping: DataFrame, files: DataFrame) -> DataFrame:
    """Results of a batch with what becomes of each: parse_failure, invalid, unresolved, good or bad, and whether the label changed.

    ``lines`` are a batch's results, ``mapping`` has custom_id, source_path and label, ``files`` the paths there are.
    """
    told = audit_results(lines.filter("parsed")).withColumn("parsed", F.lit(True))
    rows = told.select("custom_id", "label", "analysis", "parsed").unionByName(lines.filter("NOT parsed").select(F.lit(False).alias("parsed")), allowMissingColumns=True)
    known = mapping.join(files.select(F.col("path").alias("source_path")), "source_path", "left_semi").withColumnRenamed("label", "original_label")
    rows = rows.join(known, "custom_id", "left")
    fate = F.when(~F.col("parsed") | F.col("custom_id").isNull() | F.col("label").isNull(), "parse_failure").when(F.col("label") == "INVALID", "invalid").when(F.col("source_path").isNull(), "unresolved").when(F.col("label") == "GOODUML", "good").otherwise("bad")
    return rows.withColumn("fate", fate).withColumn("conflict", F.col("fate").isin("good", "bad") & (F.upper("original_label") != F.col("label")))


def audit_counts(rows: DataFrame) -> DataFrame:
    """Counters of an audit."""
    of = lambda x, name: F.count_if(F.col("fate") == x).alias(name)
    return rows.agg(F.count(F.lit(1)).alias("processed"), of("parse_failure", "parse_failures"), of("invalid", "invalid"), of("unresolved", "unresolved"), of("good", "good"), of("bad", "bad"), F.count_if(F.coalesce("conflict", F.lit(False))).alias("conflicts"))


@F.pandas_udf(StringType())
def _blake(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else hashlib.blake2b(x.encode(), digest_size=4).hexdigest())


def path_token(path: Column) -> Column:
    """A file's stem in letters and digits with a short digest of its path."""
    flat = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    stem = F.regexp_replace(F.element_at(F.split(flat, "/"), -1), r"(?<=.)\.[^.]*$", "")
    clean = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}]", "_"), r"^_+|_+$", "")
    return F.concat(F.coalesce(F.nullif(clean, F.lit("")), F.lit("file")), F.lit("_"), _blake(flat))


def large_enough(images: DataFrame, width: str, height: str, least: int = 128, most: int = 2048) -> DataFrame:
    """Images whose shorter side is long enough, with their size once the longer one is cut to ``most``."""
    w, h = F.col(width), F.col(height)
    ratio = F.lit(float(most)) / F.greatest(w, h)
    cut = lambda x: F.when(F.greatest(w, h) > most, (x * ratio).cast("long")).otherwise(x.cast("long"))
    return images.filter(F.least(w, h) >= least).withColumns({"width": cut(w), "height": cut(h)})
