"""Sources of earlier runs, and column functions, on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from assaya.functions import columns as C
from assaya.operators import training as R
from assaya.sources import runs


def test_stage_files_and_skipped_students(spark, tmp_path):
    finding = {"finding_id": "A-1", "ac_code": "KAPTXT", "severity": 0.5, "unknown": 1}
    for student, files in {"a b": {"findings.json": [finding], "info.json": {"x": 1}, "raw_findings.json": {"no": "list"}}, "b": {"findings.json": [], "ir.json": []}, "c": {"info.json": {}}}.items():
        (tmp_path / student).mkdir()
        for name, value in files.items():
            (tmp_path / student / name).write_text(json.dumps(value, indent=2))
    students = spark.createDataFrame([("a b",), ("b",), ("c",), ("d",)], "student_id string")
    loaded, skipped = runs.runs(runs.stage_files(spark, str(tmp_path)), students)
    got = {r.student_id: r for r in loaded.collect()}
    assert set(got) == {"a b", "b"} and sorted(r.student_id for r in skipped.collect()) == ["c", "d"]
    assert [(f.finding_id, f.ac_code, f.severity) for f in got["a b"].final] == [("A-1", "KAPTXT", 0.5)]
    assert got["a b"].raw == [] and got["a b"].judged == [] and json.loads(got["a b"].info) == {"x": 1}
    assert got["b"].final == [] and got["b"].ir == "{}"


def test_evaluation_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text('student_id,doc_points,max_doc_points,tool_raw_points,has_gold_bonus,generator_models,cost_eur\n1,30,40,bad,True,"m1, m2",0.5\n2,10,0,5,False,,x\n3,,,,?,m2,\n')
    got = {r.student_id: r for r in runs.evaluation_csv(spark, str(tmp_path / "e.csv"), {"m1": "Model One"}).collect()}
    assert (got["1"].doc_points_pct, got["1"].tool_raw_points, got["1"].has_gold_bonus, got["1"].generator_models) == (75.0, None, True, "Model One, m2")
    assert (got["2"].doc_points_pct, got["2"].cost_eur, got["2"].has_gold_bonus, got["2"].generator_models) == (None, None, False, None)
    assert got["3"].has_gold_bonus is None


def test_parser_timings(spark, tmp_path):
    (tmp_path / "t.csv").write_text("mode,seconds\nocr,2.5\nbase,1\nother,3\nboth,4\n")
    rows = runs.parser_timings(spark, str(tmp_path / "t.csv")).orderBy(F.col("mode_order").asc_nulls_last()).collect()
    assert [(r.mode, r.mode_order, r.seconds) for r in rows] == [("base", 1, 1.0), ("ocr", 3, 2.5), ("both", 4, 4.0), ("other", None, 3.0)]


def test_batch_results_and_labels(spark, tmp_path):
    content = lambda c, a: json.dumps({"response": {"body": {"choices": [{"message": {"content": json.dumps({"classification": c, "analysis": a})}}]}}, "custom_id": c})
    (tmp_path / "b.jsonl").write_text("\n".join([content(" goodUML ", " fine "), "{broken", "", content("other", "x"), content("INVALID", "y")]) + "\n")
    lines = runs.batch_results(spark, str(tmp_path / "b.jsonl"))
    assert lines.filter("NOT parsed").count() == 1 and lines.count() == 4
    got = [(r.label, r.analysis) for r in R.audit_results(lines.filter("parsed")).collect()]
    assert got == [("GOODUML", "fine"), (None, None), ("INVALID", "y")]


def test_cached_vectors(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert runs.cached_vectors(spark, path, "m", "h").count() == 0
    units = spark.createDataFrame([("chunk", 0, "#/texts/1", "a", [0.5, 1.0])], "kind string, unit_idx long, cref string, text string, vec array<float>")
    runs.write_vectors(units, path, "m", "h")
    runs.write_vectors(units.withColumn("text", F.lit("b")), path, "m", "other")
    assert [(r.text, list(r.vec)) for r in runs.cached_vectors(spark, path, "m", "h").collect()] == [("a", [0.5, 1.0])]
    plan = runs.cached_vectors(spark, path, "m", "h")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan


def test_labelled_images(spark, tmp_path):
    for name in ("bad/x.png", "good/sub/y.jpg", "good/__MACOSX/z.png", "good/.hidden.png", "else/w.png", "good/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    got = runs.labelled_images(spark, str(tmp_path), {"bad": "BADUML", "good": "GOODUML"})
    assert sorted((r.name, r.label, r.length) for r in got.collect()) == [("bad/x.png", "BADUML", 3), ("good/sub/y.jpg", "GOODUML", 3)]
    assert R.within_size(got, 2).count() == 0


def test_text_columns(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    assert one("ˇcas ´ a ˚u ¨a ˆo ˇx ı", C.repaired_marks) == "čas á ů ä ô ̌x i" and one(None, C.repaired_marks) is None and one("", C.repaired_marks) == ""
    assert one("![a](x%20y.png) ![](b\\c+d.jpg 't') ![z]()", C.image_uris) == ["x y.png", "b/c+d.jpg"] and one(None, C.image_uris) is None
    for path, want in {"a/../b": "b", "../b": None, "a/../../a/b": None, "./a//b": "a/b", "/a": None, "": "", "a\\..\\b": "b"}.items():
        assert one(path, C.resolved_path) == want, path
    assert one("camelCase snake_case MAX_LEN run() Plain", C.identifiers) == ["camelCase", "snake_case", "MAX_LEN"]
    with pytest.raises(ValueError, match="judge_models"):
        C.student_metrics(spark.createDataFrame([(1,)], "tool_code_count long"))
