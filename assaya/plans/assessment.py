"""The assessment run over tables: analysers, raw findings, verdicts, rule engine, scores, stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaya.operators import analysers as Y
from assaya.operators import findings as O
from assaya.operators import rules as U

#: What documents are to analysers: items, counts, lines, and the answers of models and checkers, by name.
Tables = dict[str, DataFrame]
Analyser = Callable[[Tables, DataFrame, dict], DataFrame]
_ANALYSERS: dict[str, Analyser] = {}


def analyser(name: str) -> Callable[[Analyser], Analyser]:
    """Registers a function (tables, rules, parameters) -> findings."""

    def keep(f: Analyser) -> Analyser:
        _ANALYSERS[name] = f
        return f

    return keep


def codes_of(rules: DataFrame) -> set[str]:
    """Codes of a rulebook, a dimension of at most some hundred rows."""
    return {r["ac_code"] for r in rules.select("ac_code").distinct().collect()}


def titles_of(rules: DataFrame) -> dict[str, str]:
    return {r["ac_code"]: r["title"] for r in O.last_rules(rules).select("ac_code", "title").collect()}


def fitting(rules: DataFrame, analyser_id: str, params: dict) -> DataFrame:
    """Rules of an analyser for the parameters' course, language and disabled codes."""
    course, language, off = params.get("course"), params.get("language"), params.get("disabled_codes") or []
    fits = (F.col("analyser_id") == analyser_id) & (F.col("course").isNull() | F.col("course").eqNullSafe(F.lit(course))) & (F.col("language").isNull() | F.col("language").eqNullSafe(F.lit(language)))
    return rules.filter(fits & ~F.col("ac_code").isin(*off) if off else fits)


@analyser("structure_analyser")
def structure(tables: Tables, rules: DataFrame, params: dict) -> DataFrame:
    minima = {"words": params.get("min_words", 486), "chars": params.get("min_chars", 3422), "blocks": params.get("min_struct", 7)}
    return Y.structure(tables["items"], tables["counts"], codes_of(rules), minima)


@analyser("grammar_analyser")
def grammar(tables: Tables, rules: DataFrame, params: dict) -> DataFrame:
    """A local checker's issues, or a model's answers."""
    course, language, off = params.get("course"), params.get("language"), params.get("disabled_codes") or []
    own = rules.filter((F.col("course").isNull() | F.col("course").eqNullSafe(F.lit(course))) & (F.col("language").isNull() | F.col("language").eqNullSafe(F.lit(language))))
    own = own.filter(~F.col("ac_code").isin(*off)) if off else own
    own = U.grammar_rules(own.withColumns({"language": F.lit(language).cast("string"), "config": F.lit(0)}), "config")
    if params.get("grammar_engine", "local") == "local":
        return Y.grammar(tables["items"], tables["issues"], titles_of(own), params.get("language") or "en")
    return Y.model_findings(tables["grammar_answers"], own, tables["items"], "grammar_analyser", model=params.get("model"))


@analyser("integrity_analyser")
def integrity(tables: Tables, rules: DataFrame, params: dict) -> DataFrame:
    """A model's answers and, with a local engine, what similarity to the specification tells; a local engine's COPY isn't asked of the model."""
    local = params.get("copy_engine", "local") == "local"
    own = U.integrity_rules(fitting(rules, "integrity_analyser", params), F.lit("local" if local else "llm"))
    told = Y.model_findings(tables["integrity_answers"], own, tables["items"], "integrity_analyser", model=params.get("model")) if "integrity_answers" in tables else None
    copies = Y.copy_findings(tables["copy_signals"], tables["copy_evidence"]) if local and "copy_signals" in tables else None
    if told is None or copies is None:
        return told if copies is None else copies
    return told.unionByName(copies)


@analyser("content_analyser")
def content(tables: Tables, rules: DataFrame, params: dict) -> DataFrame:
    own = U.content_rules(fitting(rules, "content_analyser", params).withColumn("language", F.lit(params.get("language"))))
    return Y.model_findings(tables["content_answers"], own, tables["items"], "content_analyser", model=params.get("model"))


@analyser("asset_analyser")
def asset(tables: Tables, rules: DataFrame, params: dict) -> DataFrame:
    own = fitting(rules, "asset_analyser", params)
    titles, parts = titles_of(own), []
    if "TYPESET" in titles and "lines" in tables:
        parts.append(Y.typeset(tables["lines"], tables["counts"], titles["TYPESET"]))
    if "UML_MISSING" in titles and "pictures" in tables:
        parts.append(Y.missing_diagrams(tables["pictures"], titles["UML_MISSING"]))
    if "asset_answers" in tables:
        parts.append(Y.model_findings(tables["asset_answers"], own, tables["items"], "asset_analyser", vision=True))
    if not parts:
        raise ValueError("no rule of the assets' analyser can be looked at")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def analyse(tables: Tables, rules: DataFrame, configs: list[dict]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Findings of all enabled analysers in the order of the configuration, and what those said that couldn't be planned.

    One analyser's failure costs its own findings only. Ids and the column place keep
    the configuration's order.
    """
    out, errors = None, []
    for place, config in enumerate(configs):
        if not config.get("enabled", True):
            continue
        name = config["analyser_id"]
        if name not in _ANALYSERS:
            errors.append((name, "not registered"))
            continue
        try:
            got = _ANALYSERS[name](tables, rules, config.get("params", {}))
            got = got.withColumn("place", F.lit(place))
        except Exception as error:  # what can't be planned; a task that fails fails the run
            errors.append((name, f"{type(error).__name__}: {error}"))
            continue
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out, errors


def run(
    raw: DataFrame, rules: DataFrame, verdicts: DataFrame | None, max_points: float | Column | None, doc: str = "doc_id", seq: str = "seq", judge_model: str = "judge", judge: bool = True, failed: DataFrame | None = None, sink: str | None = None
) -> dict[str, DataFrame]:
    """Raw, judged, final and scored findings.

    The judge is skipped without verdicts or if the configuration doesn't want it (G5).
    ``failed`` are the parser's findings of documents that couldn't be parsed: they are
    raw and final as they are, and their impact stays null (G6). With a ``sink`` each
    stage is written below it and the next one reads it from there.
    """

    def stage(name: str, df: DataFrame) -> DataFrame:
        if sink is None:
            return df
        df.write.mode("overwrite").parquet(f"{sink}/{name}")
        return df.sparkSession.read.parquet(f"{sink}/{name}")

    def with_failed(df: DataFrame) -> DataFrame:
        return df if failed is None else df.unionByName(failed, allowMissingColumns=True)

    own = raw if failed is None else raw.join(failed.select(doc).distinct(), doc, "left_anti")
    every = stage("raw", with_failed(own))
    judged = stage("judged", own if verdicts is None or not judge else O.apply_verdicts(O.judge_batch(own) if "anchors" in own.columns else own, verdicts, seq, judge_model))
    final = O.rule_engine(judged, doc, seq)
    points = max_points if max_points is None or isinstance(max_points, Column) else F.lit(max_points)
    base = final.drop("impact") if "impact" in final.columns else final
    scored = O.score(base, rules, "ac_code", points)
    return {"raw": every, "judged": judged, "final": stage("final", with_failed(final)), "scored": stage("scored", with_failed(scored))}


def unseen(docs: DataFrame, done: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents without results so far."""
    return docs.join(done.select(doc), doc, "left_anti")
