"""Explicit schemas of the assessment tables."""

FINDING = """finding_id string, ac_code string, title string, summary string, severity double, confidence double, impact double,
judge_status string, human_status string, generator_model string, judge_model string,
analyser struct<analyser_id: string, name: string, run_id: string, config_hash: string>,
document struct<source_path: string, student_id: string, origin: struct<mimetype: string, binary_hash: decimal(20,0), filename: string>, binary_hash: decimal(20,0)>,
anchors array<struct<target: struct<`$ref`: string>, snippet: string, section_path: string,
 prov: array<struct<page_no: int, bbox: struct<l: double, t: double, r: double, b: double, coord_origin: string>, charspan: array<int>>>>>,
stats array<struct<name: string, value: string, unit: string>>, model_evals array<struct<model_name: string, label: string, score: double>>,
notes array<string>"""
RULE = "title string, ac_code string, severity_weight double, is_legacy boolean, prompt_instruction string, judge_instruction string, analyser_id string, course string, language string, backend string, requires_pages boolean"
VERDICT = "finding_id string, decision string, adjusted_summary string, adjusted_snippet string, adjusted_severity double, adjusted_confidence double, rationale string"
GRADER_CSV = "id string, points string, comment string, doc_type string, bonus_points string"
EVENT = "id string, year string, task_variant string, code string, impact double, impact_has_sign boolean, impact_source string, impact_shared boolean, comment string, raw_text string, source_file string, doc_points double, doc_type string, bonus_points double"
MANIFEST = "student_id string, image_path string, image_file string, label string, cohort_year string, task_variant string, source_doc string, analysis string"
DOC_ITEM = "doc_id string, seq long, cref string, kind string, label string, level int, text string, page_no int"
USAGE = "doc_id string, model string, calls long, prompt_tokens long, completion_tokens long, cached_tokens long, cost_eur double"
STATUSES = ("to_be_judged", "not_to_be_judged", "judged_approved", "judged_adjusted", "judged_dismissed")
