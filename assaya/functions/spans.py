"""The span grammar of grader comments (E7): codes, the impacts that belong to them, and comments.

Offsets, nesting and precedence make this the one row-wise function; it runs as an
Arrow UDF that returns an array of structs.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from assaya import fixed_values as V

EVENTS = "array<struct<codes: array<string>, impact: double, has_sign: boolean, source: string, comment: string>>"
_NAMES = sorted({*V.DOC_CODES, *V.OTHER_CODES, *V.CODE_ALIASES}, key=lambda c: (-len(c), c))
_KNOWN = {*V.DOC_CODES, *V.OTHER_CODES}
_LONG = [n for n in _NAMES if len(n) >= 3 or any(ch.isdigit() for ch in n)]
_SHORT = [n for n in _NAMES if n not in _LONG]
_TOKEN = re.compile(r"(?<!\w)(?:(?i:" + "|".join(map(re.escape, _LONG)) + ")|" + "|".join(map(re.escape, _SHORT)) + r")(?!\w)")
_BEFORE = re.compile(r"([+-]\d+(?:\.\d+)?)\s*$")
_INSIDE = re.compile(r"(?<![\w.])([+-]\s*\d+(?:\.\d+)?)(?:\s*mb)?(?!\w)")
_AFTER = re.compile(r"(?:(?<=^)|(?<=[\s,:;.(\[]))([+-]\s*\d+(?:\.\d+)?)(?:\s*mb)?(?=$|[\s,:;.)\]])")
LOOK_BACK = 40


def _number(text: str) -> float:
    return float(re.sub(r"\s", "", text))


def clean(text: str) -> str | None:
    flat = re.sub(r"\s+", " ", text).strip(" ,;:")
    if re.fullmatch(r"\([^()]*\)", flat):
        flat = flat[1:-1].strip(" ,;:")
    return flat or None


def _pairs(text: str) -> list[tuple[int, int]]:
    out, open_ = [], []
    for k, ch in enumerate(text):
        if ch == "(":
            open_.append(k)
        elif ch == ")" and open_:
            out.append((open_.pop(), k))
    return out


def _prefix(text: str, start: int, least: int) -> re.Match | None:
    """A signed number that stands right before ``start`` and belongs to what follows."""
    low = max(least, start - LOOK_BACK)
    m = _BEFORE.search(text[low:start])
    if not m:
        return None
    lead = text[low : low + m.start()]
    bare = lead.rstrip(" \t")
    return m if (low == 0 and not lead.strip()) or bare.endswith((",", ";", ":", ".", "\n")) else None


def parse_comment(text: str | None) -> list[dict]:
    """The events of one comment, in order."""
    if not text:
        return []
    text = re.sub("[−–—]", "-", text)
    pairs = _pairs(text)
    tokens = []
    for m in _TOKEN.finditer(text):
        code = V.CODE_ALIASES.get(m[0].upper(), m[0].upper())
        if code in _KNOWN and not any(a < m.start() < b for a, b in pairs):
            tokens.append((m.start(), m.end(), code))
    groups: list[list[tuple[int, int, str]]] = []
    for t in tokens:
        if groups and re.fullmatch(r"\s*[/+&]\s*", text[groups[-1][-1][1] : t[0]]):
            groups[-1].append(t)
        else:
            groups.append([t])
    out = []
    for k, group in enumerate(groups):
        start, end = group[0][0], group[-1][1]
        stop = groups[k + 1][0][0] if k + 1 < len(groups) else len(text)
        if k + 1 < len(groups):
            ahead = _prefix(text, stop, end)
            if ahead:
                stop = max(end, stop - LOOK_BACK) + ahead.start()
        suffix = text[end:stop]
        impact, sign, source, noted, rest = None, False, None, None, suffix
        paren = re.match(r"\s*\(([^()]*)\)", suffix)
        if paren:  # a number inside counts if there is just one; otherwise the text is a comment and later rules go on behind it
            inside, rest = _INSIDE.findall(paren[1]), suffix[paren.end() :]
            if len(inside) == 1:
                impact, sign, source, noted = _number(inside[0]), True, "paren", clean(_INSIDE.sub("", paren[1], count=1))
            elif not inside and paren[1].strip() == "0":
                impact, source = 0.0, "paren"
            else:
                noted = clean(paren[1])
        after = None if source else _AFTER.search(rest)
        if after and after.start() <= LOOK_BACK:
            impact, sign, source = _number(after[1]), True, "suffix"
            rest = rest[: after.start()] + " " + rest[after.end() :]
        before = None if source else _prefix(text, start, groups[k - 1][-1][1] if k else 0)
        if before:
            impact, sign, source = _number(before[1]), True, "prefix"
            comment = clean(suffix)
        else:
            comment = " ".join(x for x in (noted, clean(rest)) if x) or None
        out.append({"codes": [t[2] for t in group], "impact": impact, "has_sign": sign, "source": source, "comment": comment})
    return out


def comment_events(text: Column) -> Column:
    """``parse_comment`` as a column."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(parse_comment)

    return F.pandas_udf(run, EVENTS)(text)
