"""Secret scans: fixed patterns, and guess costs of values in a credential context.

The patterns give the base spans. A value that stands where a credential would
(a wider set of names and separators) is added as a span of kind ``guess`` if
the cheapest way to build it from words, dates, repeats, sequences, keyboard
walks and brute force still takes at least 10**MIN_LOG10 guesses.

Cases: a null text counts as empty; texts and values of any length are read
whole, in time linear in their length; what segments cost is stated at the
constants, and the minimum is taken over all segmentations; spans of several kinds may overlap or be
equal and all stay; repeated rows give repeated rows; an empty table gives an
empty result; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from assaya.llm.common import read_table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A name of a credential, what joins it to its value (after "bearer" blanks alone, unless a plain word of prose follows), and the value.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|secret|auth|encryption|client)[_-]?(?:key|token|secret)|bearer)["']?[ \t]*+(?::=|=>|[:=])[ \t]*+"""
    r"""|authorization["']?[ \t]*+(?::=|=>|[:=])[ \t]*+["'`]?bearer[ \t]++|bearer[ \t]++(?!(?-i:[A-Z]?[a-z'-]++)[.,;:!?)\]]*+(?:\s|$)))["'`]?([^\s"'`<>,;(){}\[\]]{8,})""",
    re.A | re.I,
)
BEARER = re.compile("bearer[ \t]", re.A | re.I)
MIN_LOG10 = 10.0

#: Common words of passwords, most common first; a list of ranked words follows them where one is given.
WORDS = """password the and you secret love welcome admin dragon monkey letmein master login hello shadow sunshine
princess football baseball superman batman summer winter spring autumn flower freedom whatever trustno computer
internet account server access system user root test guest default changeme example sample token key private public
null none true false your here change me my this that for with pass word""".split()
#: Rows of a keyboard, which are shifted by half a key, and of a keypad.
KEYBOARD, KEYPAD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"), ("789", "456", "123")
LEET = str.maketrans("@430$5!17", "aaeossilt")
Ranks = dict[str, float]


def _adjacent(rows: tuple[str, ...], steps: tuple[tuple[int, int], ...]) -> frozenset[tuple[str, str]]:
    near = set()
    for y, row in enumerate(rows):
        for x, key in enumerate(row):
            for dy, dx in steps:
                if y + dy < len(rows) and 0 <= x + dx < len(rows[y + dy]):
                    other = rows[y + dy][x + dx]
                    near |= {(key, other), (other, key)}
    return frozenset(near)


ON_KEYBOARD = _adjacent(KEYBOARD, ((0, 1), (1, 0), (1, -1), (1, 1)))
ON_KEYPAD = _adjacent(KEYPAD, ((0, 1), (1, 0), (1, -1), (1, 1)))


def _alphabet(char: str) -> float:
    """log10 of the guesses for one character."""
    if char.isdigit():
        return 1.0
    return math.log10(26) if char.isalpha() and char.isascii() else math.log10(33) if char.isascii() else 2.0


def ranked(words: Iterable[str]) -> Ranks:
    """log10 of each word's place, WORDS first."""
    return {w: math.log10(k + 2) for k, w in enumerate(dict.fromkeys([*WORDS, *words]))}


@lru_cache(maxsize=1)
def vocabulary_words(path: str) -> tuple[str, ...]:
    """Whole words of three letters and more in a word vocabulary file, by their ids: tokens that were merged earlier are more common."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    words = sorted((i, t.removesuffix(end)) for t, i in model["vocab"].items() if t.endswith(end))
    return tuple(w for _, w in words if len(w) >= 3 and w.isascii() and w.isalpha() and w.islower())


DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/._]?\d\d(?:[-/._]?\d\d)?)?|\d{1,2}[-/._]\d{1,2}[-/._](?:\d\d){1,2}|\d\d\d\d(?:19|20)\d\d)")
DATE_SIZES = (4, 6, 7, 8, 9, 10)
UNITS = (2, 3, 4)


def word_cost(value: str, low: str, plain: str, start: int, stop: int, ranks: Ranks) -> float:
    """A word, also with letters replaced or in capitals; infinite if it isn't one."""
    rank = ranks.get(low[start:stop])
    if rank is None:
        rank = ranks.get(plain[start:stop], math.inf) + 0.6
    if rank < math.inf:
        upper = sum(c.isupper() for c in value[start:stop])
        rank += 0.3 if upper in (0, 1, stop - start) else 1.0
    return rank


class Stretch:
    """Cheapest use of any suffix of a run: of all starts, best[start] + fixed + slope * length + bend * log10(length).

    The last term grows ever slower, so a start that is no dearer than a later one
    at some end stays so at every later end, and the later one is dropped. Few
    starts are left at any time, and a run takes time in proportion to its length.
    """

    def __init__(self, least: int, fixed: float, slope: float, bend: float):
        self.least, self.fixed, self.slope, self.bend = least, fixed, slope, bend
        self.starts: list[tuple[int, float]] = []

    def cost(self, length: int) -> float:
        return self.fixed + self.slope * length + self.bend * math.log10(length)

    def extend(self, best: list[float], end: int, length: int) -> float:
        """The least cost up to ``end`` when the run that ends there has ``length`` characters."""
        first, start = end - length, end - self.least
        if start < first:
            self.starts.clear()
            return math.inf
        if self.starts and self.starts[0][0] < first:
            self.starts = [x for x in self.starts if x[0] >= first]
        self.starts.append((start, best[start] - self.slope * start))
        values = [b + self.bend * math.log10(end - j) for j, b in self.starts]
        least = min(values)
        del self.starts[values.index(least) + 1 :]
        return least + self.fixed + self.slope * end


def stretches() -> tuple[Stretch, ...]:
    """Repeats of one character, sequences by one step, walks on a keyboard and on a keypad (4.4 ways on at a key)."""
    return Stretch(3, 0.0, 0.0, 1.0), Stretch(3, 1.0, 0.0, 1.0), Stretch(4, math.log10(47 * 4), 0.3, 0.5), Stretch(4, math.log10(9), math.log10(4.4), 0.0)


def run_lengths(value: str, low: str) -> Iterator[tuple[int, int, int, int]]:
    """For each character how long the run of each kind in ``stretches`` is that ends there."""
    same = step = walk = pad = 1
    way = 0
    for i in range(len(value)):
        if i:
            gap = ord(value[i]) - ord(value[i - 1])
            same = same + 1 if gap == 0 else 1
            step = step + 1 if abs(gap) == 1 and gap == way else 2 if abs(gap) == 1 else 1
            way = gap
            pair = (low[i - 1], low[i])
            walk = walk + 1 if pair in ON_KEYBOARD else 1
            pad = pad + 1 if pair in ON_KEYPAD else 1
        yield same, step, walk, pad


def guess_cost(value: str, ranks: Ranks | None = None) -> float:
    """log10 of the guesses for the cheapest of all segmentations of ``value``."""
    ranks = ranks or ranked(())
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, longest = low.translate(LEET), max(map(len, ranks))
    best, kinds = [0.0], stretches()
    for i, lengths in enumerate(run_lengths(value, low)):
        end, own = i + 1, _alphabet(value[i])
        cost = best[i] + own
        for k, (kind, length) in enumerate(zip(kinds, lengths, strict=True)):
            cost = min(cost, kind.extend(best, end, length) + (0.0 if k else own))
        for start in range(max(0, end - longest), end - 2):
            cost = min(cost, best[start] + word_cost(value, low, plain, start, end, ranks))
        for size in DATE_SIZES:
            if size <= end and DATE.fullmatch(value, end - size, end):
                cost = min(cost, best[end - size] + (2.1 if size == 4 else 4.6))
        for unit in UNITS:  # the last unit again
            if end >= 2 * unit and value[end - unit : end] == value[end - 2 * unit : end - unit]:
                cost = min(cost, best[end - unit] + 0.4)
        best.append(cost)
    return best[-1]


def spans(text: str, least: float = MIN_LOG10, ranks: Ranks | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans, in that order."""
    found = []
    if "=" in text or ":" in text or BEARER.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".!?:")
            if len(value) >= 8 and guess_cost(value, ranks) >= least:
                found.append((m.start(1), 3, m.start(1) + len(value)))
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str, found: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """``text`` with every stretch of overlapping spans replaced."""
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, least: float = MIN_LOG10, words: Iterable[str] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; ``words`` by how common they are."""
    shared = docs.sparkSession.sparkContext.broadcast(ranked(words))  # a word list, not data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = spans(text.as_py() or "", least, shared.value)
                base = [x for x in found if x[1] < 3]
                rows.append((*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, column: str = "text", least: float = MIN_LOG10, words: Iterable[str] = ()) -> DataFrame:
    """``docs`` with the secrets of a text column masked; other columns as they are, null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(ranked(words))  # a word list, not data
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x if x is None else redacted(x, spans(x, least, shared.value)) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan(read_table(spark, sf_dir, "documents"), words=vocabulary_words(public_tokenizers.path("word_bpe_49k.json")))
