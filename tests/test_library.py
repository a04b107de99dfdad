"""Golden values and fixtures of the assessment domain; sources, sinks and the incremental run."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from assaya import fixed_values as V
from assaya.functions import columns as C
from assaya.functions.spans import parse_comment
from assaya.operators import analytics as A
from assaya.operators import findings as O
from assaya.operators import text as T
from assaya.operators import training as R
from assaya.plans import assessment
from assaya.sources import files
from assaya.streaming.incremental import assess_new_files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_golden_scores(spark):
    assert one(spark, C.impact(F.lit(0.066667), F.lit(0.8), F.lit(400))) == -21.3334
    assert one(spark, C.impact(F.lit(0.166667), F.lit(0.7), F.lit(400))) == -46.6668
    assert one(spark, C.impact(F.lit(0.0), F.lit(0.7), F.lit(400))) == 0.0
    assert one(spark, C.impact(F.lit(None).cast("double"), F.lit(0.7), F.lit(400))) is None
    assert one(spark, C.token_cost(*[F.lit(float(x)) for x in (117362, 19200, 8908, 2.5, 0.25, 15)])) == 0.353119
    assert one(spark, C.year_token(F.lit("2021"))) == "2020"
    assert one(spark, C.year_token(F.lit("2024"))) == "2024"


@pytest.mark.parametrize(
    "text, want",
    [
        ("STRUCT -10 (comment), SHORT", [(["STRUCT"], -10, "suffix"), (["SHORT"], None, None)]),
        ("-20 CH, STYLE (-5 long sentences)", [(["CH"], -20, "prefix"), (["STYLE"], -5, "paren")]),
        ("STRUCT/SHORT -10", [(["STRUCT", "SHORT"], -10, "suffix")]),
        ("HOV (see CH)", [(["HOV"], None, None)]),
        ("ok ch", []),
        ("STYLE (-5 and -3)", [(["STYLE"], None, None)]),
        ("ČCH", []),
        ("IR (0) fine", [(["IR"], 0, "paren")]),
        ("", []),
        (None, []),
    ],
)
def test_span_grammar(text, want):
    assert [(e["codes"], e["impact"], e["source"]) for e in parse_comment(text)] == want


def test_clean_comment(spark):
    for text, want in ((" ;a \n b, ", "a b"), ("( x )", "x"), ("(a) (b)", "(a) (b)"), (" ,; ", None), (None, None)):
        assert one(spark, C.clean_comment(F.lit(text).cast("string"))) == want


def test_rule_engine_counts(spark):
    rows = [("d", 1, "a", "judged_dismissed"), ("d", 2, "a", "judged_approved"), ("d", 3, "a", "judged_approved"), ("d", 4, "b", None), ("e", 1, "a", "judged_adjusted")]
    f = spark.createDataFrame(rows, "doc_id string, seq int, finding_id string, judge_status string")
    assert sorted((r.doc_id, r.seq) for r in O.rule_engine(f, "doc_id", "seq").collect()) == [("d", 2), ("d", 4), ("e", 1)]


def test_assessment_run(spark):
    f = spark.createDataFrame([("d", 1, "1", "X", 0.8, "to_be_judged"), ("d", 2, "2", "Y", None, "to_be_judged")], "doc_id string, seq int, finding_id string, ac_code string, severity double, judge_status string")
    rules = spark.createDataFrame([("X", 0.066667)], "ac_code string, severity_weight double")
    v = spark.createDataFrame([("2", "adjusted", 0.5, 1), ("1", "approved", 0.1, 1)], "finding_id string, decision string, adjusted_severity double, seq int")
    got = {r.finding_id: r for r in assessment.run(f, rules, v, 400.0)["scored"].collect()}
    assert got["1"].impact == -21.3334 and got["1"].severity == 0.8
    assert got["2"].impact is None and got["2"].severity == 0.5


def test_section_paths(spark):
    docs = spark.createDataFrame([(1, "# A\ntext\n### B\n## C\n\n![x](y)")], "doc_id long, text string")
    got = [(r.kind, r.section_path) for r in T.section_paths(T.markdown_items(docs), "doc_id", "seq").orderBy("seq").collect()]
    assert got == [("heading", "A"), ("text", "A"), ("heading", "A > B"), ("heading", "A > C"), ("picture", "A > C")]


def test_copy_confidence(spark):
    x = [F.lit(float(v)) for v in (0.97, 3, 0.5, 0.3, 4, 2, 0.96, 1)]
    assert one(spark, C.copy_confidence(*x)) == 1.0
    none = [F.lit(0.0)] * 8
    assert one(spark, C.copy_confidence(*none)) == 0.0
    assert one(spark, C.copy_severity(F.lit(0.96), F.lit(0.5), F.lit(1), F.lit(2))) == pytest.approx(0.925)


def test_split(spark):
    got = R.group_split(spark.range(10).withColumnRenamed("id", "k"), "k", "1").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 8, "valid": 2}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "ipp2023-int.csv").write_text('id,points,comment,doc_type,bonus_points\n1,x,"STRUCT/SHORT -10",pdf,\n2,5,,md,1\n')
    got = {(r.id, r.year, r.task_variant, r.code, r.impact, r.impact_shared, r.doc_points) for r in files.grader_events(spark, f"{tmp_path}/ipp*.csv").collect()}
    assert got == {("1", "2023", "int", "STRUCT", -10.0, True, None), ("1", "2023", "int", "SHORT", -10.0, True, None)}
    (tmp_path / "in" / "s1").mkdir(parents=True)
    for name in ("b.md", "readme.md", "z.txt"):
        (tmp_path / "in" / "s1" / name).write_text("x")
    found = files.discover(files.listing(spark, str(tmp_path / "in")), str(tmp_path / "in"), "readme", [".md"]).collect()
    assert [(r.student_id, r.path.rsplit("/", 1)[1]) for r in found] == [("s1", "readme.md")]
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "findings.json").write_text(json.dumps([{"finding_id": "a", "severity": 0.5}, {"finding_id": "b"}]))
    assert {r.finding_id for r in files.findings_json(spark, str(tmp_path / "run")).collect()} == {"a", "b"}
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    files.write_json(df, str(tmp_path / "json"))
    assert [r.value for r in spark.read.text(str(tmp_path / "json")).collect()] == ['{"a":1,"c":"x"}']
    files.write_csv(df, str(tmp_path / "csv"), ["c", "a"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["c", "a"]
    assert one(spark, files.extensions(F.array(F.lit("MD"), F.lit(".md"), F.lit(" pdf")))) == [".md", ".pdf"]


def test_incremental(spark, tmp_path):
    def step(n):
        spark.range(n, n + 3).write.mode("append").parquet(str(tmp_path / "in"))
        assess_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: df.withColumn("x", F.lit(n))).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert [step(0), step(3)] == [3, 6]
    assert len(V.DOC_CODES) == 40


def test_rule_overrides_on_nulls(spark):
    from assaya.operators import rules as U

    rows = spark.createDataFrame([(1, None, "CH"), (1, "cs", "CH"), (1, None, "STYLE"), (2, "en", "CH"), (2, "en", "SPELLING"), (3, "en", "CH")], "config_id int, language string, ac_code string")
    assert sorted((r.config_id, r.language or "", r.ac_code) for r in U.content_rules(rows).collect()) == [(1, "", "STYLE"), (1, "cs", "CH")]
    assert sorted((r.config_id, r.ac_code) for r in U.grammar_rules(rows, "config_id").collect()) == [(2, "SPELLING"), (3, "CH")]
    copies = spark.createDataFrame([("COPY", "local"), ("COPY", None), ("STYLE", "local")], "ac_code string, engine string")
    assert U.integrity_rules(copies, F.col("engine")).count() == 2
    assert U.known_codes(copies, spark.createDataFrame([("COPY",), ("COPY",)], "ac_code string"), "ac_code").count() == 2


def test_first_in_order_over_ties_and_nulls(spark):
    rows = [(k, None if k % 9 == 0 else float(k % 4) / 3) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, score double")
    order = [k for k, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    for wanted in (0, 1, 7, 52, 100):
        one = spark.createDataFrame([(wanted,)], "wanted long")
        assert {r.id for r in A.first_in_order(df, "score", "id", one).collect()} == set(order[:wanted])


def test_split_cuts_at_whole_numbers(spark):
    ids = [str(k) for k in range(57)]
    got = {r.id: r.split for r in R.group_split(spark.createDataFrame([(k,) for k in ids * 2], "id string"), "id", "s", 0.8, 0.1).collect()}
    order = sorted(ids, key=lambda k: (hashlib.md5(("s" + k).encode()).hexdigest(), k))
    assert [got[k] for k in order] == ["train"] * 45 + ["valid"] * 6 + ["test"] * 6


def test_image_tokens_and_boxes(spark):
    sizes = [(100, 100), (512, 513), (1024, 1024), (4096, 1000), (3000, 3000)]

    def tokens(w, h):
        for side, limit in ((max, 2048), (min, 768)):
            if side(w, h) > limit:
                scale = limit / side(w, h)
                w, h = int(w * scale), int(h * scale)
        return -(-w // 512) * -(-h // 512) * 170 + 85

    df = spark.createDataFrame(sizes, "w int, h int")
    assert {(r.w, r.h): r.t for r in df.select("w", "h", C.image_tokens(F.col("w"), F.col("h")).alias("t")).collect()} == {(w, h): tokens(w, h) for w, h in sizes}


def test_unique_names_that_meet_a_suffix(spark):
    names = ["a.png", "a_2.png", "a.png", "a.png", "b.png", "a_2.png", "a_2_2.png", ".hidden", "c", "c"]
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate(names)] + [(2, 99, "a.png")], "folder int, k int, name string")
    got = {r.k: r.unique_name for r in R.unique_names(rows, "folder", "name", ["k"]).collect()}
    taken: set = set()
    for k, name in enumerate(names):
        new, n = name, 1
        stem, dot, ext = name.rpartition(".") if name.rfind(".") > 0 else (name, "", "")
        while new in taken:
            n += 1
            new = f"{stem}_{n}{dot}{ext}"
        taken.add(new)
        assert got[k] == new, (k, name)
    assert got[99] == "a.png"


def test_markdown_items(spark):
    text = "Intro line\nmore `x`\n\n# Title ##\ntext_name\n===\n- one\n  two\n* three\n\n```py\n# no heading\n\n```\n| a |\n| b |\n***\n![p](x.png)\n## \nlast"
    items = [(r.kind, r.level, r.text, r.start_line) for r in T.markdown_items(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("seq").collect()]
    assert items == [("text", None, "Intro line more `x`", 1), ("heading", 1, "Title", 4), ("heading", 1, "text_name", 5), ("list", None, "one two", 7), ("list", None, "three", 9), ("code", None, "# no heading\n", 11), ("table", None, "| a |\n| b |", 15), ("picture", None, "![p](x.png)", 18), ("heading", 2, "", 19), ("text", None, "last", 20)]


def test_last_rule_and_stages(spark, tmp_path):
    f = spark.createDataFrame([("d", 1, "1", "X", 0.5, "to_be_judged"), ("e", 1, "1", "X", 1.0, "to_be_judged")], "doc_id string, seq int, finding_id string, ac_code string, severity double, judge_status string")
    rules = spark.createDataFrame([("X", 0.5, 1), ("X", 0.1, 2)], "ac_code string, severity_weight double, position int")
    failed = spark.createDataFrame([("e", 0, "P-1", "MISSING", "not_to_be_judged")], "doc_id string, seq int, finding_id string, ac_code string, judge_status string")
    stages = assessment.run(f, rules, None, 100.0, failed=failed, sink=f"file://{tmp_path}/run")
    got = {(r.doc_id, r.ac_code): r.impact for r in stages["scored"].collect()}
    assert got == {("d", "X"): -5.0, ("e", "MISSING"): None}
    assert {p.name for p in (tmp_path / "run").iterdir()} == {"raw", "judged", "final", "scored"}


def test_similarity_maxima(spark, monkeypatch):
    import numpy as np

    from assaya.operators import similarity as S

    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((90, 5)), rng.standard_normal((50, 5))
    b[7] = b[3]
    units = spark.createDataFrame([(k % 4, k, v.tolist()) for k, v in enumerate(a)], "doc_id long, unit long, vec array<double>")
    spec = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(b)], "spec_id long, vec array<double>")
    rows, columns = S.similarity_maxima(units, spec, over=0.5)
    sims = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    for r in rows.collect():
        assert (r.spec_id, r.n_over) == (int(sims[r.unit].round(12).argmax()), int((sims[r.unit] > 0.5).sum())) and abs(r.sim - sims[r.unit].max()) < 1e-12
    got = {(r.doc_id, r.spec_id): r.sim for r in columns.collect()}
    assert len(got) == 200 and all(abs(s - sims[d::4, k].max()) < 1e-12 for (d, k), s in got.items())


def test_correlation_p_values():
    for r, n, want in ((0.5, 10, 0.14111), (0.0, 5, 1.0), (0.9, 3, 0.28713), (-0.2, 102, 0.04386), (1.0, 4, 0.0)):
        assert abs(C.beta_share(1 - r * r, (n - 2) / 2, 0.5) - want) < 5e-5


def test_config_hash_ignores_order_and_run(spark):
    texts = ['{"b": [1, {"y": 2, "x": "é"}], "a": null, "run_id": "1"}', '{"run_id":"2","a":null,"b":[1,{"x":"é","y":2}]}', '{"a":null,"b":[1,{"x":"e","y":2}]}']
    from assaya.operators import records as D

    got = [one(spark, D.config_hash(F.lit(t))) for t in texts]
    assert got[0] == got[1] != got[2]


def test_issue_messages(spark):
    from assaya.operators import analysers as Y

    message = lambda s, r: one(spark, Y.issue_message(F.lit("misspelling"), F.lit(s).cast("string"), F.array(*[F.lit(x) for x in r]).cast("array<string>")))
    for s in ("word", "it's", 'say "x"', "a'b\"c", "tab\tnew\nline", "back\\slash"):
        assert message(s, []) == f"Spelling Error: {s!r}"
    assert message("x", ["a", "b'", "c", "d"]) == "Spelling Error: 'x'. Maybe: 'a', \"b'\", 'c'"
    assert message(None, []) == "Spelling Error"


def test_percentiles_and_shares(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(k, None if rng.random() < 0.1 else float(v)) for k in ("a", "b", None) for v in [*rng.standard_normal(200).round(2), *rng.integers(0, 5, 200), 1e9]] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: list(r.q) for r in A.percentiles(df, ["k"], F.col("v"), [0.0, 0.25, 0.5, 0.95, 1.0]).collect()}
    shares = {(r.k, r.v): r.share for r in A.shares(df.filter("v IS NOT NULL"), ["k"], "v").collect()}
    for k in ("a", "b", None, "one"):
        own = np.array([v for key, v in rows if key == k and v is not None])
        assert np.allclose(got[k], np.quantile(own, [0.0, 0.25, 0.5, 0.95, 1.0]))
        assert all(abs(shares[k, v] - (own <= v).mean()) < 1e-12 for v in own)
    assert "none" not in got
    assert list(A.percentiles(df.filter("k = 'one'"), [], F.col("v"), [0.5]).first()["q"]) == [3.0]


def test_registered_analysers(spark):
    """All analysers over small tables, by one rulebook; engines that are off leave their findings out."""
    long = "word " * 12 + "teh end"
    items = spark.createDataFrame([("d", 1, "#/texts/0", "heading", "body", 1, "Head", 3, "Head"), ("d", 2, "#/texts/1", "text", "body", None, long, 3, "Head"), ("d", 3, "#/texts/2", "heading", "body", 1, "Last", 1, "Last")], "doc_id string, seq long, cref string, kind string, label string, level int, text string, page_no int, section_path string")
    answer = "doc_id string, seq long, code string, cref string, reason string, snippet string, severity double, confidence double, model_name string, raw_response string"
    answers = lambda code: spark.createDataFrame([("d", 1, code, "#/texts/1", "so", "teh", 0.5, 0.5, "m", "raw")], answer)
    tables = {
        "items": items, "counts": spark.createDataFrame([("d", 15, 70, 1)], "doc_id string, words int, chars int, blocks int"), "lines": T.markdown_lines(spark.createDataFrame([("d", "a snake_name ")], "doc_id string, text string")),
        "issues": spark.createDataFrame([("d", "Head", 65, 3, "misspelling", ["the"])], "doc_id string, section_path string, offset int, length int, issue_type string, replacements array<string>"),
        "grammar_answers": answers("CH"), "integrity_answers": answers("COPY"), "content_answers": answers("FIL0"), "asset_answers": answers("BADUML"),
        "pictures": spark.createDataFrame([("d", 0, 0, False, False, 0)], "doc_id string, n_pages int, pictures int, md_images boolean, has_client boolean, images_sent int"),
    }
    rules = spark.createDataFrame([(c, f"T {c}", a, None, lang) for c, a, lang in (("CONSEC_HEADINGS", "structure_analyser", None), ("SHORT", "structure_analyser", None), ("CH", "content_analyser", None), ("SPELLING", "grammar_analyser", "cs"), ("COPY", "integrity_analyser", None), ("FILO", "content_analyser", None), ("UML_BAD", "asset_analyser", None), ("UML_MISSING", "asset_analyser", None), ("TYPESET", "asset_analyser", None))], "ac_code string, title string, analyser_id string, course string, language string")
    names = ["structure_analyser", "grammar_analyser", "integrity_analyser", "content_analyser", "asset_analyser"]
    configs = [{"analyser_id": n, "params": {"language": "en", "copy_engine": "llm"}} for n in names]
    found, errors = assessment.analyse(tables, rules, configs)
    assert not errors
    got = {(r.place, r.finding_id, r.snippet) for r in found.collect()}
    assert got == {(0, "STRUCTURE_ANALYSER:CONSEC_HEADINGS-1", "Last"), (0, "STRUCTURE_ANALYSER:SHORT-1", None), (1, "GRAMMAR_ANALYSER:CH-1", "teh"), (2, "INTEGRITY_ANALYSER:COPY-1", "teh"), (3, "CONTENT_ANALYSER:FILO-1", "teh"), (4, "ASSET_ANALYSER:TYPESET-1", None), (4, "ASSET_ANALYSER:UML_MISSING-1", None), (4, "ASSET_ANALYSER:UML_BAD-1", long)}
    llm = assessment.analyse(tables, rules, [{"analyser_id": "grammar_analyser", "params": {"language": "en", "grammar_engine": "llm"}}, {"analyser_id": "integrity_analyser", "params": {}}])[0]
    assert {r.finding_id for r in llm.collect()} == {"GRAMMAR_ANALYSER:CH-1"}
