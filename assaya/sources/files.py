"""Sources and sinks: discovery, grader CSV, run JSON, manifests, batch results; CSV, JSON and JSONL writers (SRC*, SNK*)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from assaya import fixed_values as V
from assaya import schemas
from assaya.functions.columns import year_token
from assaya.functions.spans import comment_events


def extensions(names: Column) -> Column:
    """Lower case with a leading dot, each once (SRC2)."""
    return F.array_distinct(F.transform(names, lambda x: F.concat(F.lit("."), F.regexp_replace(F.lower(F.trim(x)), r"^\.", ""))))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime", "length")


def discover(files: DataFrame, root: str, expected: str | None, allowed: list[str]) -> DataFrame:
    """The best file of each folder at the root or one level below: the expected stem, then an allowed suffix, then by name (SRC1).

    A match at the root ends the search there. Folders without one get a placeholder,
    so that they are still assessed, and the root itself if there is no folder below.
    """
    below = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + root.rstrip("/") + "/", "")
    parts = F.split(below, "/")
    name = F.element_at(parts, -1)
    rows = files.withColumns({"depth": F.size(parts) - 1, "folder": F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("")), "name": name})
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    rank = F.when(stem == F.lit(expected or ""), 0).when(suffix.isin(allowed), 1)
    # Deeper files only tell that their folder is there.
    best = rows.withColumn("rank", F.when(F.col("depth") <= 1, rank)).groupBy("folder").agg(F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "name", "path"))).alias("best"))
    top = best.agg(F.max((F.col("folder") == "") & F.col("best").isNotNull()).alias("at_root"), F.max(F.col("folder") != "").alias("has_folders"))
    every = best.join(top, F.lit(True))
    found = F.when(F.col("at_root"), F.col("folder") == "").otherwise((F.col("folder") != "") | ~F.col("has_folders"))
    missing = F.concat_ws("/", F.lit(root.rstrip("/")), F.nullif("folder", F.lit("")), F.lit(expected or "missing_document"))
    own = F.regexp_replace("best.name", r"\.[^.]*$", "")
    student = F.when(F.col("folder") != "", F.col("folder")).otherwise(F.coalesce(own, F.lit(root.rstrip("/").rsplit("/", 1)[-1])))
    return every.filter(found).select(F.coalesce("best.path", missing).alias("path"), student.alias("student_id"))


def grader_events(spark: SparkSession, path: str) -> DataFrame:
    """Grader CSV files to events, a row for each code (SRC5, E6, O10)."""
    raw = spark.read.schema(schemas.GRADER_CSV).option("header", "true").option("multiLine", "true").option("mode", "PERMISSIVE").csv(path)
    path_ = F.input_file_name()  # a table that was written as one has its name from the folder
    file = F.coalesce(F.nullif(F.regexp_extract(path_, r"/(ipp[^/]*\.csv)(/|$)", 1), F.lit("")), F.element_at(F.split(path_, "/"), -1))
    year, variant = F.regexp_extract(file, r"(\d{4})-([^.]+)", 1), F.regexp_extract(file, r"(\d{4})-([^.]+)", 2)
    rows = raw.withColumns({"source_file": file, "year": F.coalesce(F.nullif(year, F.lit("")), F.lit("Unknown")), "task_variant": F.coalesce(F.nullif(variant, F.lit("")), F.lit("Unknown"))})
    return explode_events(rows)


def explode_events(rows: DataFrame) -> DataFrame:
    """Comments to event rows of the clean schema."""
    events = rows.withColumn("e", F.explode(comment_events(F.col("comment")))).withColumn("code", F.explode("e.codes"))
    return events.select(
        "id", "year", "task_variant", "code", F.col("e.impact").alias("impact"), F.col("e.has_sign").alias("impact_has_sign"), F.col("e.source").alias("impact_source"),
        (F.size("e.codes") > 1).alias("impact_shared"), F.col("e.comment").alias("comment"), F.col("comment").alias("raw_text"), "source_file",
        F.expr("try_cast(points AS double)").alias("doc_points"), "doc_type", F.expr("try_cast(bonus_points AS double)").alias("bonus_points"),
    )


def findings_json(spark: SparkSession, path: str) -> DataFrame:
    """Findings of runs; what isn't a finding goes to _corrupt_record (SRC7, SRC10, SRC12)."""
    schema = spark.createDataFrame([], schemas.FINDING).schema.add("_corrupt_record", "string")
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)


def unknown_keys(text: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that a strict schema doesn't have (SRC11)."""
    return F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in allowed]))


def manifest(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """Image records, without those whose file is missing (SRC13)."""
    rows = spark.read.schema(schemas.MANIFEST).json(path)
    return rows if files is None else rows.join(files.select(F.col("path").alias("image_path")), "image_path", "left_semi")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """SNK2: a fixed header; other columns are left out."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """SNK1, SNK6: one object a line, nulls left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def base64(content: Column) -> Column:
    """Base64 on one line."""
    return F.translate(F.base64(content), "\r\n", "")


def data_urls(files: DataFrame) -> DataFrame:
    """Images as base64 requests."""
    return files.select("path", F.to_json(F.struct(F.col("path").alias("custom_id"), F.concat(F.lit("data:image/png;base64,"), base64(F.col("content"))).alias("url"))).alias("value"))


def existing_findings(text: Column) -> Column:
    """Findings of an earlier run's file, null if it isn't a list of findings (SRC12)."""
    kind = ArrayType(StructType.fromDDL(schemas.FINDING))
    found = F.from_json(F.when(F.startswith(F.trim(text), F.lit("[")), text), kind)
    return F.when(F.forall(found, lambda x: x.isNotNull() & x["finding_id"].isNotNull() & x["ac_code"].isNotNull()), found)


#: Characters of windows-1250 beside those of the same bytes in ISO-8859-1.
_LATIN = bytes(range(128, 256)).decode("latin-1")
_CENTRAL = bytes(range(128, 256)).decode("cp1250", errors="replace")


def decoded(content: Column) -> Column:
    """Text and encoding of a file's bytes (SRC4): by a byte order mark UTF-16, else UTF-8 where it is valid, else windows-1250, which takes any bytes."""
    start = F.hex(F.substring(content, 1, 2))
    wide, valid = start.isin("FEFF", "FFFE"), F.is_valid_utf8(content.cast("string"))
    central = F.translate(F.decode(content, "ISO-8859-1"), _LATIN, _CENTRAL)
    text = F.when(wide, F.decode(content, "UTF-16")).when(valid, F.regexp_replace(content.cast("string"), "^\ufeff", "")).otherwise(central)
    return F.struct(text.alias("text"), F.when(wide, "utf-16").when(valid, "utf-8").otherwise("windows-1250").alias("encoding"))


def clean_events(spark: SparkSession, path: str) -> DataFrame:
    """Clean events with numbers and flags coerced, academic years, known maxima and impacts as shares of them (SRC6, J1, X6)."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    number = {c: F.expr(f"try_cast(`{c}` AS double)") for c in ("impact", "doc_points", "bonus_points") if c in rows.columns}
    flag = {c: F.expr(f"try_cast(lower(`{c}`) AS boolean)") for c in ("impact_has_sign", "impact_shared") if c in rows.columns}
    rows = rows.withColumns({**number, **flag, "year": year_token(F.col("year"))})
    maxima = spark.createDataFrame([(str(y), v, p) for y, v, p in V.MAX_DOC_POINTS], "year string, task_variant string, max_doc_points int")
    return rows.join(maxima, ["year", "task_variant"], "left").withColumn("impact_normalised", F.try_divide("impact", "max_doc_points"))


@F.pandas_udf(StringType())
def indented(text: pd.Series) -> pd.Series:
    """A JSON value as a document with two blanks a level, as it is written for readers (SNK1)."""
    return text.map(lambda x: x if x is None else json.dumps(json.loads(x), indent=2, ensure_ascii=False))


def image_requests(files: DataFrame, model: str, system: str, prompt: str, schema: str) -> DataFrame:
    """Batch requests that show a model an image each (R7, SNK6): ``files`` has custom_id, path and content; ``schema`` is JSON."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {"jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml"}.items() for x in kv]), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))
    url = F.concat(F.lit("data:"), F.coalesce(kind, F.lit("image/png")), F.lit(";base64,"), base64(F.col("content")))
    q = lambda x: F.lit(json.dumps(x, ensure_ascii=False))
    body = F.concat(
        F.lit('{"custom_id":'), F.to_json(F.array("custom_id")).substr(F.lit(2), F.length(F.to_json(F.array("custom_id"))) - 2), F.lit(',"method":"POST","url":"/v1/chat/completions","body":{"model":'), q(model), F.lit(',"temperature":0,"response_format":'), F.lit(schema),
        F.lit(',"messages":[{"role":"system","content":'), q(system), F.lit('},{"role":"user","content":[{"type":"text","text":'), q(prompt), F.lit('},{"type":"image_url","image_url":{"url":"'), url, F.lit('","detail":"high"}}]}]}}'),
    )
    return files.select("custom_id", body.alias("value"))


def training_entry(url: Column, label: Column, system: str, prompt: str) -> Column:
    """One conversation of a fine-tuning file."""
    q = lambda x: F.lit(json.dumps(x, ensure_ascii=False))
    told = F.to_json(F.array(label))
    return F.concat(
        F.lit('{"messages":[{"role":"system","content":'), q(system), F.lit('},{"role":"user","content":[{"type":"text","text":'), q(prompt), F.lit('},{"type":"image_url","image_url":{"url":"'), url, F.lit('","detail":"high"}}]},{"role":"assistant","content":'),
        told.substr(F.lit(2), F.length(told) - 2), F.lit("}]}"),
    )
