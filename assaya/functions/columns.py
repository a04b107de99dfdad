"""Scalar column functions: codes, scores, costs, text measures, bands."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from assaya import fixed_values as V


def rounded(value: Column, digits: int) -> Column:
    """Rounded by decimals, whatever the order that a sum was added up in: noise beyond nine digits goes first."""
    return F.round(F.round(value, 9), digits)


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of ``key`` in a fixed table, null if none."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def alias_code(code: Column) -> Column:
    """Upper case, then aliases."""
    return F.coalesce(lookup(V.CODE_ALIASES, F.upper(code)), F.upper(code))


def canonical_code(code: Column) -> Column:
    """Alias, then legacy code to the one in use."""
    return F.coalesce(lookup(V.LEGACY_TO_CANONICAL, alias_code(code)), alias_code(code))


def impact(weight: Column, severity: Column, max_points: Column | None) -> Column:
    """Points lost: weight zero gives 0, no weight null, null severity counts as 1."""
    lost = -weight * F.coalesce(severity, F.lit(1.0))
    full = F.round(lost, 6) if max_points is None else F.when(max_points.isNull(), F.round(lost, 6)).otherwise(F.round(lost * max_points, 4))
    return F.when(weight == 0, F.lit(0.0)).otherwise(full)


def token_cost(prompt: Column, cached: Column, completion: Column, rate_in: Column, rate_cached: Column, rate_out: Column) -> Column:
    """Euros for a call."""
    usd = (prompt - cached) * rate_in + cached * rate_cached + completion * rate_out
    return F.round(usd / F.lit(1e6) * F.lit(V.USD_TO_EUR), 6)


def year_token(token: Column) -> Column:
    """A four-digit academic year, whose halves follow on each other, to the year it starts in."""
    first, second = F.substring(token, 1, 2).try_cast("int"), F.substring(token, 3, 2).try_cast("int")
    academic = token.rlike(r"^\d{4}$") & (F.pmod(first + 1, F.lit(100)) == second)
    return F.when(academic, F.concat(F.lit("20"), F.substring(token, 1, 2))).otherwise(token)


def clean_comment(text: Column) -> Column:
    """One blank for white space, marks off the ends, one pair of outer parentheses off, empty to null."""
    flat = F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" ,;:"))
    peeled = F.when(flat.rlike(r"^\([^()]*\)$"), F.btrim(F.substring(flat, F.lit(2), F.length(flat) - 2), F.lit(" ,;:"))).otherwise(flat)
    return F.nullif(peeled, F.lit(""))


def short_severity(words: Column, chars: Column, blocks: Column, minima: dict[str, int] | None = None) -> Column:
    """Severity by the lowest ratio to the minima, null if none is missed."""
    minima = minima or V.SHORT_MINIMA
    ratios = [x / F.lit(float(m)) if m > 0 else F.lit(1.0) for x, m in ((words, minima["words"]), (chars, minima["chars"]), (blocks, minima["blocks"]))]
    low = F.least(*ratios)
    return F.when(low < 0.5, 0.9).when(low < 0.75, 0.7).when(low < 1, 0.5)


def confidence_band(value: Column) -> Column:
    """F15."""
    return F.when(value.isNull(), "unknown").when(value >= 0.85, "very_high").when(value >= 0.7, "high").when(value >= 0.5, "medium").when(value >= 0.3, "low").otherwise("very_low")


def impact_kind(value: Column) -> Column:
    """Warning, bonus or penalty."""
    return F.when(F.coalesce(value, F.lit(0.0)) == 0, "Warning").when(value > 0, "Bonus").otherwise("Penalty")


def category(code: Column) -> Column:
    """F14."""
    return F.when(code.isin(V.DOC_CODES), "Doc").otherwise("Other")


def score_pct(points: Column, maximum: Column) -> Column:
    """null where there is no positive maximum."""
    return F.try_divide(points, F.when(maximum > 0, maximum)) * 100


def keyword_rows(df: DataFrame, keep: list[str], text: str, name: str = "keyword", stop: list[str] | None = None) -> DataFrame:
    """A row for each lower-cased word of three letters or more that is no stop word (X7): words are exploded first, so that the filter is compiled."""
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0)))
    return df.select(*keep, words.alias(name)).filter(~F.col(name).isin(stop or V.STOP_WORDS))


def dot(a: Column, b: Column) -> Column:
    """X42 for vectors of length one."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(vector: Column) -> Column:
    """A vector of length one; null for a zero vector."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(vector, lambda x: x.cast("double") / size))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def copy_confidence(m: Column, n_flag: Column, c: Column, cov: Column, s: Column, h: Column, ms: Column, k: Column) -> Column:
    """The additive and maximum steps that turn overlap signals into a confidence (X20), capped at 1."""
    ct, vt, some = c >= 0.25, cov >= 0.24, n_flag > 0
    evidence = some | ct
    b = F.least(0.08 * h, F.lit(0.3))
    steps = (
        lambda x: F.when(ct, F.greatest(x, F.lit(0.3) + 0.4 * F.least(c, F.lit(1.0)))).otherwise(x),
        lambda x: F.when(some & ~ct, F.greatest(x, F.lit(0.05) + (m - 0.8))).otherwise(x),
        lambda x: F.when((h > 0) & evidence, x + 0.1 + b).when((h > 0) & (ms >= 0.95), F.greatest(x, 0.2 + b)).otherwise(x),
        lambda x: F.when(some & (s >= 1), F.greatest(x, 0.15 + F.least(0.05 * (s - 1), F.lit(0.2)))).otherwise(x),
        lambda x: F.when((s >= 3) & (evidence | (s >= 6)), F.greatest(x, 0.12 + F.least(0.04 * (s - 3), F.lit(0.18)))).otherwise(x),
        lambda x: F.when((k > 0) & (ct | (n_flag >= 2)), x + F.least(0.1 * k, F.lit(0.25))).otherwise(x),
        lambda x: F.when(vt, x + 0.05).otherwise(x),
    )
    x = F.when(m >= 0.95, 0.8).otherwise(F.lit(0.0))
    for step in steps:
        x = bound(x, step)
    tiers = sum((t.cast("int") for t in (ct, (h > 0) & evidence, k > 0, m >= 0.95, some & (s >= 1), (s >= 3) & evidence)), F.lit(0))
    return F.least(bound(tiers, lambda t: F.when(t >= 3, 1.1 * 1.1).when(t >= 2, 1.1).otherwise(1.0)) * x, F.lit(1.0))


def copy_severity(m: Column, c: Column, k: Column, h: Column) -> Column:
    """X21."""
    ct = c >= 0.25
    return (
        F.when(m >= 0.95, F.least(0.85 + 0.15 * c, F.lit(1.0)))
        .when(ct & (k > 0), F.least(0.6 + 0.3 * c, F.lit(0.9)))
        .when(ct, F.least(0.4 + 0.3 * c, F.lit(0.75)))
        .when(h > 0, F.least(0.3 + 0.05 * h, F.lit(0.6)))
        .otherwise(F.lit(0.2))
    )


def image_tokens(width: Column, height: Column) -> Column:
    """Tokens of an image (A38): the long side at most 2048, then the short one at most 768, then tiles of 512 at 170 each, and 85."""

    def fit(w: Column, h: Column, side: Column, limit: int) -> tuple[Column, Column]:
        scale = F.lit(float(limit)) / side
        return tuple(F.when(side > limit, (x * scale).cast("long")).otherwise(x.cast("long")) for x in (w, h))

    w, h = fit(width, height, F.greatest(width, height), 2048)
    w, h = fit(w, h, F.least(w, h), 768)
    return F.ceil(w / 512) * F.ceil(h / 512) * 170 + 85


def classifier_label(text: Column) -> Column:
    """X16."""
    return F.when(F.contains(text, F.lit("BADUML")), "BADUML").when(F.contains(text, F.lit("GOODUML")), "GOODUML").otherwise("UNKNOWN")


def document_type(mimetype: Column) -> Column:
    """Null for what is neither."""
    return F.when(F.contains(mimetype, F.lit("pdf")), "pdf").when(F.contains(mimetype, F.lit("markdown")), "md")


def typeset_severity(hits: Column, words: Column) -> Column:
    """Hits for each hundred words, within 0.1 and 1."""
    return F.least(F.greatest(F.round(F.try_divide(hits, words) * 100, 3), F.lit(0.1)), F.lit(1.0))


def kept_snippet(snippet: Column, item: Column) -> Column:
    """A model's snippet where the item holds it word for word, else the item's text."""
    return F.when(F.contains(item, snippet), snippet).otherwise(item)


def upper_left_box(left: Column, top: Column, right: Column, bottom: Column, page_height: Column, from_bottom: Column) -> Column:
    """x, y, w and h from the upper left corner, for boxes measured from either end of a page."""
    y = F.when(from_bottom, page_height - F.greatest(top, bottom)).otherwise(F.least(top, bottom))
    return F.struct(F.least(left, right).alias("x"), y.alias("y"), F.abs(right - left).alias("w"), F.abs(bottom - top).alias("h"))


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


#: Marks that stand alone in extracted text, the combining ones, and the letters that take each in Czech and Slovak.
SPACING, COMBINING = "\u02c7\u00b4\u02da\u00a8\u02c6", "\u030c\u0301\u030a\u0308\u0302"
BEARERS = ("cCdDeEnNrRsStTzZ", "aAeEiIyYoOuUlLrR", "uU", "aA", "oO")


def repaired_marks(text: Column) -> Column:
    """Marks that came out before their letters, put onto them (X10); composed in Arrow batches, as no built-in function does."""
    x = F.translate(text, "\u0131" + SPACING, "i" + COMBINING)
    x = F.regexp_replace(x, f"([{COMBINING}])(?U:\\s)+", "$1")
    for mark, letters in zip(COMBINING, BEARERS, strict=True):
        x = F.regexp_replace(x, f"({mark})([{letters}])", "$2$1")
    return _composed(x)


#: Names of a program's parts: camel case, with underscores, constants, calls before a letter.
IDENTIFIER = r"\b(?:[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-zA-Z_][a-zA-Z0-9]*_[a-zA-Z][a-zA-Z0-9]*|[A-Z]{2,}(?:_[A-Z0-9]+)+|[a-z][a-zA-Z0-9_]*\(\))\b"


def identifiers(text: Column) -> Column:
    """X12."""
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def loose_brackets(text: Column) -> Column:
    """Brackets with a space on their inner side."""
    return F.regexp_count(text, F.lit(r"\( | \)"))


def trailing_space(text: Column) -> Column:
    """Lines that end in a space, and tabs."""
    return F.regexp_count(text, F.lit(r"(?m)[ ]+$")) + F.regexp_count(text, F.lit("\t"))


def image_uris(text: Column) -> Column:
    """Sources of Markdown images in order, decoded, with forward slashes (X11); a title after the source is left out."""
    found = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(\s*<?([^)\s>]+)"), F.lit(1))
    # A plus sign is no space in a path.
    clean = lambda x: F.replace(F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x), F.lit("\\"), F.lit("/"))
    return F.filter(F.transform(found, clean), lambda x: x != "")


def resolved_path(path: Column) -> Column:
    """A relative path without ., .. and empty parts; null if it leaves its folder."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    none = F.lit(None).cast("array<string>")
    step = lambda s, x: F.when(x.isin("", "."), s).when(x == "..", F.when(F.size(s) > 0, F.slice(s, 1, F.size(s) - 1)).otherwise(none)).otherwise(F.concat(s, F.array(x)))
    return F.when(~F.startswith(path, F.lit("/")), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def copy_notes(m: Column, n_flag: Column, c: Column, cov: Column, s: Column, h: Column, ms: Column, k: Column) -> Column:
    """One note for each signal of overlap that fired (X22), in a fixed order."""
    said = lambda pattern, *values: F.format_string(pattern, *values)
    notes = (
        F.when(m >= 0.95, said("Near-verbatim chunk detected (sim=%.3f)", m)),
        F.when(c >= 0.25, said("Contamination triggered: %.3f >= 0.25", c)),
        F.when(h > 0, said("%d hard sentence match(es) (max_sim=%.3f)", h, ms)),
        F.when((n_flag > 0) & (s >= 2), said("Localised trigger: %d flagged chunk(s) + %d soft sentence(s)", n_flag, s)),
        F.when(s >= 3, said("Soft-sentence cluster: %d sentence(s) above 0.75", s)),
        F.when(k > 0, said("%d chunk(s) corroborated by sentence-level evidence", k)),
        F.when(cov >= 0.24, said("Spec coverage triggered: %.3f >= 0.24", cov)),
    )
    return F.array_compact(F.array(*notes))


def page_labels(pages: Column) -> Column:
    """Page numbers as sorted labels, each once; n/a without any."""
    labels = F.array_join(F.transform(F.array_sort(F.array_distinct(F.array_compact(pages))), lambda p: F.concat(F.lit("p."), p.cast("string"))), ", ")
    return F.coalesce(F.nullif(labels, F.lit("")), F.lit("n/a"))


def model_names(text: Column, names: dict[str, str]) -> Column:
    """Names of models in a comma list, prettified where known."""
    return F.array_join(F.transform(F.split(text, r"\s*,\s*"), lambda x: F.coalesce(lookup(names, F.trim(x)), F.trim(x))), ", ")


def student_metrics(df: DataFrame) -> DataFrame:
    """Precision, recall, absolute errors and the pair of models of each student's row."""
    needs = ["tool_code_count", "gold_code_count", "overlap_count", "points_delta", "points_delta_pct", "generator_models", "judge_models"]
    if missing := sorted(set(needs) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    number = {n: F.expr(f"try_cast(`{n}` AS double)") for n in needs[:5]}
    share = lambda of: F.when(number[of] > 0, number["overlap_count"] / number[of])
    pair = F.concat(F.coalesce("generator_models", F.lit("")), F.lit(" | "), F.coalesce("judge_models", F.lit("")))
    return df.withColumns({"student_precision": share("tool_code_count"), "student_recall": share("gold_code_count"), "abs_points_delta": F.abs(number["points_delta"]), "abs_points_delta_pct": F.abs(number["points_delta_pct"]), "grader_judge_pair": pair})


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for k in range(2000):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + term * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + term / c if k else 1e300
        c = c if abs(c) > 1e-300 else 1e-300
        value *= c * d if k else d
        if k > 2 and abs(1 - c * d) < 1e-14:
            break
    return front * value


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """The two-sided p-value of Pearson's r over n pairs (A16), of aggregated rows; null below three pairs."""
    known = lambda r, n: not pd.isna(r) and not pd.isna(n) and n >= 3
    return pd.Series([beta_share(max(0.0, 1 - a * a), (m - 2) / 2, 0.5) if known(a, m) else None for a, m in zip(r, n, strict=True)], dtype="float64")
