"""Outputs of earlier runs and evaluations as tables (SRC7-SRC9, SRC14-SRC16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from assaya import schemas
from assaya.functions.columns import model_names, score_pct

#: Files of a run's stages, and the order of the parser's modes.
STAGES = {"findings.json": "final", "raw_findings.json": "raw", "judged_findings.json": "judged", "info.json": "info", "ir.json": "ir"}
MODES = ("base", "tables", "ocr", "both")
NUMBERS = "doc_points max_doc_points tool_raw_points points_delta gold_impact_sum tool_impact_sum impact_delta cost_eur prompt_tokens completion_tokens cached_tokens n_api_calls elapsed_seconds".split()


def stage_files(spark: SparkSession, root: str, folders: bool = False) -> DataFrame:
    """student_id, stage and text of each stage file below ``root``/<student>; with ``folders`` a stage is a folder of its file's name that holds one file."""
    reader = spark.read.option("recursiveFileLookup", "true")
    files = (reader if folders else reader.option("pathGlobFilter", "{" + ",".join(STAGES) + "}")).text(root, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    at = -2 if folders else -1
    name = lambda k: F.regexp_replace(F.url_decode(F.element_at(parts, k)), "^[a-z_]+=", "")
    stage = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])[name(at)]
    return files.select(name(at - 1).alias("student_id"), stage.alias("stage"), F.col("value").alias("text")).filter("stage IS NOT NULL")


def available(files: DataFrame) -> DataFrame:
    """Runs by name with the stages they have, in a run's order (SRC10)."""
    order = F.array(*[F.lit(x) for x in ("raw", "judged", "final", "info", "ir")])
    return files.groupBy("student_id").agg(F.filter(order, lambda x: F.array_contains(F.collect_set("stage"), x)).alias("stages")).orderBy("student_id")


def runs(files: DataFrame, students: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row with the five stages for each expected student, and the students skipped as they have no final findings (SRC7).

    What is absent or of the wrong kind counts as an empty list or object.
    """
    kind = ArrayType(StructType.fromDDL(schemas.FINDING))
    wide = files.groupBy("student_id").pivot("stage", list(STAGES.values())).agg(F.first("text"))
    list_ = lambda c: F.from_json(F.when(F.startswith(F.trim(c), F.lit("[")), F.col(c)).otherwise(F.lit("[]")), kind)
    object_ = lambda c: F.when(F.startswith(F.trim(c), F.lit("{")), F.col(c)).otherwise(F.lit("{}"))
    found = students.join(wide.filter("final IS NOT NULL"), "student_id")
    loaded = found.withColumns({**{c: list_(c) for c in ("final", "raw", "judged")}, **{c: object_(c) for c in ("info", "ir")}})
    return loaded, students.join(wide.filter("final IS NOT NULL"), "student_id", "left_anti")


def evaluation_csv(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Rows of students with numbers and flags coerced, models prettified and percentages added (SRC8, F19, X28)."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    new: dict[str, Column] = {c: F.expr(f"try_cast(`{c}` AS double)") for c in NUMBERS if c in rows.columns}
    if "has_gold_bonus" in rows.columns:
        new["has_gold_bonus"] = F.when(F.col("has_gold_bonus") == "True", True).when(F.col("has_gold_bonus") == "False", False)
    new |= {c: model_names(F.col(c), names or {}) for c in ("generator_models", "judge_models") if c in rows.columns}
    rows = rows.withColumns(new)
    points = [c for c in ("doc_points", "tool_raw_points", "points_delta") if c in rows.columns and "max_doc_points" in rows.columns]
    return rows.withColumns({f"{c}_pct": score_pct(F.col(c), F.col("max_doc_points")) for c in points if f"{c}_pct" not in rows.columns})


def parser_timings(spark: SparkSession, path: str) -> DataFrame:
    """Timings with the place of each mode in the fixed order, null for others (SRC9)."""
    rows = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    place = F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col("mode")).cast("int")
    return rows.withColumn("mode_order", F.nullif(place, F.lit(0)))


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a batch's results with a flag for those that are JSON objects; blank lines are left out (SRC14)."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.withColumn("parsed", F.json_object_keys("value").isNotNull())


def write_vectors(units: DataFrame, path: str, model: str, content_hash: str) -> None:
    """Embeddings of one specification under its model and content hash (SRC15)."""
    rows = units.select("kind", "unit_idx", "cref", "text", F.col("vec").cast("array<float>").alias("vec"))
    rows.withColumns({"model": F.lit(model), "content_hash": F.lit(content_hash)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "content_hash").parquet(path)


def cached_vectors(spark: SparkSession, path: str, model: str, content_hash: str) -> DataFrame:
    """Cached embeddings, no rows if there are none; only their own partition is read (SRC15)."""
    schema = "kind string, unit_idx long, cref string, text string, vec array<float>, model string, content_hash string"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).filter((F.col("model") == model) & (F.col("content_hash") == content_hash))


IMAGES = (".png", ".jpg", ".jpeg")


def labelled(files: DataFrame, root: str, labels: dict[str, str]) -> DataFrame:
    """Images of a listing by the label of their top folder, without hidden and archive folders (SRC16, R6)."""
    below = F.element_at(F.split(F.col("path"), "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", 2), 2)
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.split(below, "/")[0]]
    image = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*IMAGES)
    return files.filter(image).select("path", "length", label.alias("label"), below.alias("name")).filter(F.col("label").isNotNull() & ~F.col("name").rlike(r"(^|/)(\.|__MACOSX/)"))


def labelled_images(spark: SparkSession, root: str, labels: dict[str, str]) -> DataFrame:
    """Image files below ``root`` with their label (SRC16, R8)."""
    return labelled(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(root), root, labels)
