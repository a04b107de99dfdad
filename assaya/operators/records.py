"""Records of documents and runs: exports, information, usage, hashes (SNK3-SNK5, A29-A31, R17-R19, X25, X35, X39)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from assaya import fixed_values as V
from assaya.functions import columns as C


def export_rows(findings: DataFrame, max_points: Column | None, doc: str = "doc_id", path: str = "path") -> DataFrame:
    """Findings in the columns of the graders' events (SNK3); what a run doesn't know is null. A document's points stand in each row."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    total = F.coalesce(F.sum("impact").over(Window.partitionBy(doc)), F.lit(0.0))
    points = F.lit(None).cast("double") if max_points is None else C.rounded(max_points + total, 2)
    none = {c: F.lit(None).cast("string") for c in ("year", "task_variant", "impact_source")}
    own = {
        "id": F.col(doc).cast("string"), "code": F.col("ac_code"), "impact_has_sign": F.lit(False), "impact_shared": F.lit(False), "comment": F.col("summary"), "raw_text": F.col("summary"), "source_file": name,
        "doc_points": points, "doc_type": F.nullif(F.lower(F.regexp_replace(suffix, r"^\.", "")), F.lit("")), "bonus_points": F.lit(None).cast("double"), **none,
    }
    return findings.select(*[own.get(c, F.col(c)).alias(c) for c in V.EXPORT_COLUMNS])


def usage_summary(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over models, a cost of null if any is, and each model's cost (A30, R18): ``usage`` has a row for each model, null cost if its price isn't known."""
    costs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "cost_eur"))))
    return usage.groupBy(*keys).agg(
        *[F.sum(c).alias(f"total_{c}") for c in ("prompt_tokens", "completion_tokens", "cached_tokens")], F.round(F.when(F.count_if(F.col("cost_eur").isNull()) == 0, F.sum("cost_eur")), 6).alias("total_cost_eur"), costs.alias("costs_by_model_eur"),
    )


def stage_summary(times: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and seconds of each stage (A31): ``times`` has a row for each call."""
    r = lambda c, n: F.round(c, 4).alias(n)
    return times.groupBy(*keys, "stage").agg(F.count(F.lit(1)).alias("calls"), r(F.sum("seconds"), "total_seconds"), r(F.avg("seconds"), "avg_seconds"), r(F.min("seconds"), "min_seconds"), r(F.max("seconds"), "max_seconds"))


def document_info(docs: DataFrame, usage: DataFrame, times: DataFrame, findings: DataFrame, errors: DataFrame, run: dict[str, object], doc: str = "doc_id") -> DataFrame:
    """One JSON record for each document (SNK5, R17).

    ``docs`` has parsed_ok, elapsed_seconds and, for parsed ones, words, paragraphs and
    pictures; ``findings`` those of the parser and the final ones, ``errors`` messages by
    analyser. Parts that a document doesn't have are left out, as nulls are.
    """
    r = lambda c: F.round(c, 4)
    totals = usage_summary(usage, [doc])
    stages = times.groupBy(doc, "stage").agg(r(F.sum("seconds")).alias("seconds")).groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "seconds")))).alias("stage_times"))
    counts = findings.groupBy(doc).agg(F.count_if(F.col("analyser_id") == "PARSER").alias("n_parser"), F.count(F.lit(1)).alias("n_all"))
    told = errors.groupBy(doc, "analyser_id").agg(F.array_sort(F.collect_list("message")).alias("messages")).groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("analyser_id", "messages")))).alias("analyser_errors"))
    rows = docs.join(totals, doc, "left").join(stages, doc, "left").join(counts, doc, "left").join(told, doc, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    record = F.struct(
        F.struct(F.lit(run["run_id"]).alias("run_id"), F.lit(run["config_hash"]).alias("config_hash")).alias("run"), F.struct(F.lit(run.get("course")).alias("course"), F.lit(run.get("max_doc_points")).alias("max_doc_points")).alias("config"),
        F.struct("parsed_ok").alias("parse"), F.struct(zero("n_parser").alias("n_parser_findings"), zero("n_all").alias("n_findings")).alias("counts"), F.coalesce("stage_times", F.create_map().cast("map<string, double>")).alias("stage_times"),
        F.struct(zero("total_prompt_tokens").alias("total_prompt_tokens"), zero("total_completion_tokens").alias("total_completion_tokens"), zero("total_cached_tokens").alias("total_cached_tokens"), "total_cost_eur", "costs_by_model_eur").alias("usage"),
        r(F.col("elapsed_seconds")).alias("elapsed_seconds"), F.when(F.col("parsed_ok"), F.struct(F.col("words").alias("total_words"), F.col("paragraphs").alias("total_paragraphs"), F.col("pictures").alias("total_pictures"))).alias("document"), "analyser_errors",
    )
    return rows.select(doc, F.to_json(record).alias("info"))


def run_summary(docs: DataFrame, usage: DataFrame, times: DataFrame, run: dict[str, object]) -> DataFrame:
    """One JSON record for a run (SNK5): counts of documents, usage by model and times by stage over all of them."""
    by_model = usage.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens", "cached_tokens")], F.round(F.when(F.count_if(F.col("cost_eur").isNull()) == 0, F.sum("cost_eur")), 6).alias("cost_eur"))
    total = usage_summary(by_model, [])
    stages = stage_summary(times, [])
    tracked = times.agg(F.round(F.sum("seconds"), 4).alias("total_tracked_seconds"), F.count(F.lit(1)).alias("total_stage_invocations"))
    staged = stages.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.struct("calls", "total_seconds", "avg_seconds", "min_seconds", "max_seconds").alias("s"))))).alias("by_stage"))
    counts = docs.agg(F.count(F.lit(1)).alias("docs_total"), F.count_if("parsed_ok").alias("docs_parsed"), F.count_if(~F.col("parsed_ok")).alias("docs_failed_parse"), F.round(F.sum("elapsed_seconds"), 4).alias("elapsed_seconds"))
    one = counts
    for row in (total, staged, tracked):  # one row each
        one = one.join(F.broadcast(row), F.lit(True))
    record = F.struct(
        F.struct(F.lit(run["run_id"]).alias("run_id"), F.lit(run["config_hash"]).alias("config_hash")).alias("run"), F.struct("docs_total", "docs_parsed", "docs_failed_parse").alias("counts"),
        F.struct("by_stage", "total_tracked_seconds", "total_stage_invocations").alias("stage_times"), F.struct("total_prompt_tokens", "total_completion_tokens", "total_cached_tokens", "total_cost_eur", "costs_by_model_eur").alias("usage"), "elapsed_seconds",
    )
    return one.select(F.to_json(record).alias("summary"))


def file_digest(content: Column) -> Column:
    """X25."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def config_hash(text: Column) -> Column:
    """Digest of a configuration's JSON, whatever the order of its keys and its white space, without its run_id.

    Numbers without a fraction are written as whole ones.
    """
    top = F.from_json(text, "map<string, variant>")
    keys = F.filter(F.sort_array(F.map_keys(top)), lambda k: k != "run_id")
    parts = F.transform(keys, lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.to_json(F.element_at(top, k))))
    return file_digest(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def short_text(snippet: Column, most: int = 500) -> Column:
    """A snippet on one line, cut with dots."""
    flat = F.replace(snippet, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def finding_summary(findings: DataFrame) -> Column:
    """A finding in a few lines (X39): id, summary, figures, statistics, evidence, notes."""
    figure = lambda c, pattern: F.when(F.col(c).isNotNull(), F.format_string(pattern, F.bround(c, 2)))
    figures = F.concat_ws(", ", figure("severity", "severity=%.2f"), figure("confidence", "confidence=%.2f"), figure("impact", "impact=%+.2fpts"), F.concat(F.lit("judge_status="), F.col("judge_status")), F.concat(F.lit("human_status="), F.col("human_status")))
    evidence = F.when(F.col("cref").isNotNull(), F.coalesce(F.concat(F.lit('  Evidence [1]: "'), short_text(F.col("snippet")), F.lit('"')), F.lit("  Evidence [1]: (No snippet provided)")))
    notes = F.when(F.size("notes") > 0, F.concat(F.lit("  Notes: "), F.array_join("notes", ", ")))
    return F.concat_ws("\n", F.concat(F.lit("["), F.col("finding_id"), F.lit("]:")), F.col("summary"), figures, evidence, notes)


def operational_fields(info: DataFrame, doc: str = "doc_id", text: str = "info", generators: str = "generator_models", judges: str = "judge_models") -> DataFrame:
    """A document's record in the columns of an evaluation (E2, X29-X31): ``text`` is its JSON, the models are lists joined by ", ".

    Costs by role are sums over the models of that role, null where none is named or a
    cost isn't known; the analysers' time is that of all stages but parsing and judging.
    """
    get = lambda path, kind: F.get_json_object(text, f"$.{path}").cast(kind)
    models = F.from_json(F.get_json_object(text, "$.usage.by_model"), "map<string, struct<calls: bigint, cost_eur: double>>")
    stages = F.from_json(F.coalesce(F.get_json_object(text, "$.stage_times"), F.lit("{}")), "map<string, double>")
    mime = F.coalesce(get("input.origin.mimetype", "string"), F.lit(""))

    def of(names: str):
        named = F.split(F.col(names), ", ")
        own = F.filter(F.map_entries(F.coalesce(models, F.create_map().cast("map<string, struct<calls: bigint, cost_eur: double>>"))), lambda x: F.array_contains(named, x["key"]))
        return F.when(F.coalesce(F.col(names), F.lit("")) != "", F.aggregate(own, F.lit(0.0), lambda s, x: s + x["value"]["cost_eur"]))

    calls = F.aggregate(F.map_values(models), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["calls"], F.lit(0)))
    analysing = F.aggregate(F.filter(F.map_entries(stages), lambda x: ~x["key"].isin("parse", "judge")), F.lit(0.0), lambda s, x: s + x["value"])
    return info.select(
        doc, F.when(F.contains(mime, F.lit("pdf")), "pdf").when(F.contains(mime, F.lit("markdown")), "md").alias("doc_type"), get("usage.total_cost_eur", "double").alias("cost_eur"), of(generators).alias("generator_cost_eur"), of(judges).alias("judge_cost_eur"),
        *[get(f"usage.total_{c}", "long").alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens")], F.when(F.size(models) > 0, calls).alias("n_api_calls"), get("elapsed_seconds", "double").alias("elapsed_seconds"),
        stages["parse"].alias("parse_time"), F.nullif(F.round(analysing, 2), F.lit(0.0)).alias("analyser_time"), stages["judge"].alias("judge_time"), get("document.total_words", "long").alias("total_words"), get("document.total_pictures", "long").alias("total_pictures"),
    )


def page_payload(pages: DataFrame, footer: str, doc: str = "doc_id") -> DataFrame:
    """What a vision model is shown of a document without diagrams: its pages in order, each with its reference, then the footer.

    ``pages`` have page_no and content, a PNG or null; documents without a page image have no row, as no call is made for them.
    """
    url = F.concat(F.lit("data:image/png;base64,"), F.translate(F.base64("content"), "\r\n", ""))
    shown = pages.filter("content IS NOT NULL").select(doc, F.struct("page_no", F.concat(F.lit("[Ref: #/pages/"), F.col("page_no").cast("string"), F.lit("]")).alias("ref"), url.alias("url")).alias("page"))
    blocks = shown.groupBy(doc).agg(F.array_sort(F.collect_list("page")).alias("pages"))  # a document's own pages
    text = lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"), F.lit(None).cast("struct<url: string>").alias("image_url"))
    image = lambda x: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(x.alias("url")).alias("image_url"))
    content = F.concat(F.flatten(F.transform("pages", lambda p: F.array(text(p["ref"]), image(p["url"])))), F.array(text(F.lit(footer))))
    return blocks.select(doc, F.size("pages").alias("images_sent"), F.to_json(content).alias("content"))


def rule_errors(text: Column) -> Column:
    """What is wrong with a rule's JSON, in order of its keys; none if it may be used (SRC11): unknown and missing keys, types, values."""
    rule = F.from_json(text, "map<string, variant>")
    kind = lambda k: F.regexp_extract(F.schema_of_variant(F.element_at(rule, k)), r"^([A-Z]+)", 1)
    value = lambda k, as_: F.try_variant_get(F.element_at(rule, k), "$", as_)
    has = lambda k: F.map_contains_key(rule, F.lit(k)) & (F.coalesce(kind(F.lit(k)), F.lit("VOID")) != "VOID")
    told = [F.when(~has(k), F.lit(f"missing {k}")) for k in V.RULE_TEXTS]
    told += [F.when(has(k) & (kind(F.lit(k)) != "STRING"), F.lit(f"type {k}")) for k in (*V.RULE_TEXTS, "judge_instruction", "language", "course", "backend")]
    number = kind(F.lit("severity_weight")).isin("BIGINT", "DOUBLE", "DECIMAL", "INT", "TINYINT", "SMALLINT")
    told.append(F.when(has("severity_weight") & ~number, F.lit("type severity_weight")).when(has("severity_weight") & (value(F.lit("severity_weight"), "double") < 0), F.lit("value severity_weight")))
    told += [F.when(has(k) & (kind(F.lit(k)) != "BOOLEAN"), F.lit(f"type {k}")) for k in ("is_legacy", "requires_pages")]
    told += [F.when(has(k) & (kind(F.lit(k)) == "STRING") & ~value(F.lit(k), "string").isin(*some), F.lit(f"value {k}")) for k, some in (("course", ["ifj", "ipp"]), ("backend", ["vision", "classifier", "deterministic"]))]
    unknown = F.transform(F.filter(F.sort_array(F.map_keys(rule)), lambda k: ~k.isin(V.RULE_KEYS)), lambda k: F.concat(F.lit("unknown "), k))
    return F.when(rule.isNull() | ~F.startswith(F.trim(text), F.lit("{")), F.array(F.lit("no object"))).otherwise(F.concat(F.array_compact(F.array(*told)), unknown))
