"""Substring dedup with automata of repeated phrases.

A window is WINDOW consecutive words. In each window one phrase of PHRASE words
is its mark: the one with the smallest hash, which equal windows choose alike.
Consecutive windows with one mark are a run, and the run's words its context.

1. Every text is read once: its word count, a digest of its words, and the hashes
   of its runs' marks and contexts are written. Texts of equal words are one text
   from here on, that of the smallest doc_id.
2. Marks of two or more texts are found, combined before the shuffle. A run whose
   whole context a smaller doc_id has recurs as a whole. Where a mark stands in
   several contexts, the first text of each gives the hashes of the windows in
   that run, and windows of two or more texts are the other recurring passages.
3. The first document of a mark spells its phrase out. Documents are dealt into
   shards; each shard compiles the phrases that its documents share with others
   into one Aho-Corasick automaton, and every different text of at least a window
   is streamed through its shard's. Removal comes from the automaton's hits alone:
   around each place where a phrase stands, the recurring passages of that phrase
   are laid on the text, and words of those that are there are removed.

A document is streamed through the automaton of its own shard and not through
all, so the work grows with the text and not with text times shards; the joins of
step 2 see to it that this automaton has all phrases the document shares. Windows
count as equal if 122 bits of their hashes are (a context: 52 bits of a hash of its
words beside 64 of its mark) and the phrase stands at the same place in them. Marks,
contexts, windows and texts that hold over a ten-thousandth of the rows are joined
by broadcast, so that no task gets all rows of one.

Cases: null texts have no words; texts with fewer words than a window lose none;
texts of any length are read whole; every row gives a row, also where rows repeat a
doc_id, with the same text or with another: neither has the smaller id, so they
take nothing from each other; rows whose doc_id is null take no part and keep all
words, unless a row with an id has the same ones; an empty table gives an empty
result; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaya.llm.common import join_groups, read_table, written

WINDOW, PHRASE = 50, 8
#: Phrases that one automaton holds, on average.
SHARD_PHRASES = 20_000
#: Bytes of a phrase that may be broadcast if it is hot.
HOT_PHRASE = 1024
MASK = (1 << 64) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def phrase_hashes(words: list[bytes], size: int = PHRASE) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    seen: dict[bytes, int] = {}
    short = xxhash.xxh64_intdigest
    for w in words:
        if w not in seen:
            seen[w] = short(w)
    own = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _BASE + own[k : k + n]
    return _mixed(total)


def mark_places(hashes: np.ndarray, window: int = WINDOW, size: int = PHRASE) -> np.ndarray:
    """For each window the place of its mark, the leftmost phrase of smallest hash."""
    span = window - size + 1
    return np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(1) + np.arange(len(hashes) - span + 1)


def offsets(words: list[bytes]) -> np.ndarray:
    """Where each word starts in the words joined by one space, and where one more would."""
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])


def spread(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words joined by spaces, and their offsets."""
    return b" ".join(words), offsets(words)


def context_key(body: memoryview, shape: int) -> int:
    """A signed hash of a run's words whose last 12 bits are its shape: words before its mark, and words from there on."""
    value = xxhash.xxh3_64_intdigest(body) >> 12 << 12 | shape
    return value - (1 << 64) if value >> 63 else value


def window_key(body: memoryview, left: int) -> int:
    """A hash of a window's words whose last 6 bits say how many stand before its mark."""
    return xxhash.xxh3_128_intdigest(body) >> 6 << 6 | left


def runs(words: list[bytes], window: int = WINDOW) -> tuple[memoryview, np.ndarray, list[tuple[int, int, int, int]]]:
    """The words joined by spaces, their offsets, and (place of the mark, first window, end of windows, mark) of each run."""
    body, at = spread(words)
    if len(words) < window:
        return memoryview(body), at, []
    hashes = phrase_hashes(words)
    places = mark_places(hashes, window)
    first = np.flatnonzero(np.diff(places, prepend=-1))
    end = np.append(first[1:], len(places))
    signed = hashes[places[first]].astype(np.int64).tolist()
    return memoryview(body), at, list(zip(places[first].tolist(), first.tolist(), end.tolist(), signed, strict=True))


def surveyed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, n_words, digest of the words, marks and contexts of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                body, at, found = runs(words, window)
                at = at.tolist()
                pairs = dict.fromkeys((mark, context_key(body[at[first] : at[end - 1 + window] - 1], place - first << 6 | end - 1 + window - place)) for place, first, end, mark in found)
                rows.append((len(words), hashlib.sha256(body).digest(), [x[0] for x in pairs], [x[1] for x in pairs]))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=["doc_id", "key", "n_words", "digest", "marks", "contexts"])

    return docs.mapInArrow(run, "doc_id long, key long, n_words long, digest binary, marks array<long>, contexts array<long>")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """Hashes of the windows in a text's open runs, and the phrases that this document is to spell out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, open_, owned in zip(*(batch.column(c) for c in ("doc_id", "text", "open", "owned")), strict=True):
                body, at, found = runs(words_of(text.as_py()), window)
                open_, owned = set(open_.as_py()), set(owned.as_py())
                at = at.tolist() if found else []
                keys, phrases = [], {}
                for place, first, end, mark in found:
                    if mark in open_:
                        keys += [window_key(body[at[k] : at[k + window] - 1], place - k).to_bytes(16, "little") for k in range(first, end)]
                    if mark in owned:
                        phrases[mark] = bytes(body[at[place] : at[place + PHRASE] - 1])
                pairs = np.frombuffer(b"".join(dict.fromkeys(keys)), "<i8").reshape(-1, 2)
                rows.append((doc_id.as_py(), pairs[:, 0], pairs[:, 1], list(phrases), list(phrases.values())))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(x, k) for x, k in zip(columns[1:], kinds[1:], strict=True))], names=["doc_id", "key", "w1", "w2", "spelled", "phrases"])

    return texts.mapInArrow(run, "doc_id long, key long, w1 array<long>, w2 array<long>, spelled array<long>, phrases array<binary>")


def automaton_of(phrases: Iterable[tuple[int, bytes]]) -> ahocorasick.Automaton:
    """An automaton of (mark, phrase), each phrase between blanks."""
    automaton = ahocorasick.Automaton()
    for mark, phrase in phrases:
        automaton.add_word(" " + phrase.decode("latin-1") + " ", mark)
    automaton.make_automaton()
    return automaton


def covered(words: list[bytes], automaton: ahocorasick.Automaton, whole: dict[int, set[int]], opened: set[int], passages: set[int], window: int = WINDOW) -> np.ndarray:
    """Which words stand in a recurring passage around a hit of the automaton.

    ``whole`` has the contexts that recur as a whole by mark, ``passages`` the windows
    that recur in runs of the marks ``opened``.
    """
    gone = np.zeros(len(words) + 1, np.int64)
    if len(words) >= window and len(automaton):
        body, at = spread(words)
        hits = list(automaton.iter((b" " + body + b" ").decode("latin-1")))
        if hits and (whole or passages):
            view, n = memoryview(body), len(words)
            # A phrase with a blank on each side ends where a word does.
            places = (np.searchsorted(at, [end for end, _ in hits]) - PHRASE).tolist()
            at = at.tolist()
            shapes = {mark: sorted({c & 0xFFF for c in own}) for mark, own in whole.items()}
            lefts = sorted({x & 63 for x in passages})
            for place, (_, mark) in zip(places, hits, strict=True):
                for shape in shapes.get(mark, ()):
                    a, b = place - (shape >> 6), place + (shape & 63)
                    if a >= 0 and b <= n and context_key(view[at[a] : at[b] - 1], shape) in whole[mark]:
                        gone[a] += 1
                        gone[b] -= 1
                if mark in opened:
                    for left in lefts:
                        a, b = place - left, place - left + window
                        if a >= 0 and b <= n and window_key(view[at[a] : at[b] - 1], left) in passages:
                            gone[a] += 1
                            gone[b] -= 1
    return np.cumsum(gone)[:-1] > 0


def _removed(dealt: DataFrame, window: int) -> DataFrame:
    """Streams each shard's documents through the automaton of the shard's phrases; a row for each document that loses words."""

    def shards(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start, held = 0, 0
        for k, own in enumerate(batch.column("phrases")):
            held += len(own) if own.is_valid else 0
            if held >= SHARD_PHRASES or k + 1 == batch.num_rows:
                yield batch.slice(start, k + 1 - start)
                start, held = k + 1, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (s for batch in batches for s in shards(batch)):
            phrases: dict[int, bytes] = {}
            for own in shard.column("phrases").to_pylist():
                phrases.update((x["mark"], x["phrase"]) for x in own or [])
            automaton = automaton_of(phrases.items())
            rows = []
            for doc_id, key, text, marks, contexts, opened, w1, w2 in zip(*(shard.column(c) for c in ("doc_id", "key", "text", "marks", "contexts", "open", "w1", "w2")), strict=True):
                words = words_of(text.as_py())
                whole: dict[int, set[int]] = {}
                for mark, context in zip(marks.as_py() or [], contexts.as_py() or [], strict=True):
                    whole.setdefault(mark, set()).add(context)
                passages = {(a & MASK) | (b & MASK) << 64 for a, b in zip(w1.as_py() or [], w2.as_py() or [], strict=True)}
                gone = covered(words, automaton, whole, set(opened.as_py() or []), passages, window)
                if gone.any():
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    rows.append((doc_id.as_py(), key.as_py(), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["doc_id", "key", "n_removed", "kept_sha256"])

    return dealt.mapInArrow(run, "doc_id long, key long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    if not PHRASE <= window <= 50:
        raise ValueError(f"a window has {PHRASE} to 50 words")  # what a shape's six bits can say
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    # Rows of one doc_id are told apart by a hash of their text.
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    doc = ["doc_id", "key"]
    rows = written(surveyed(texts, window), "substring-survey")
    total = rows.count()
    # Texts of equal words: the one with the smallest id stands for all.
    groups = rows.groupBy("digest").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("first"), F.min("n_words").alias("n_words"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"), "n_words", "n"), "substring-groups")
    judged = join_groups(rows.filter(F.col("n_words") >= window).drop("n_words"), groups, ["digest"], "n", total, "inner")
    firsts = judged.filter((F.col("doc_id") == F.col("first_id")) & (F.col("key") == F.col("first_key")))
    held = firsts.select(*doc, F.explode(F.arrays_zip("marks", "contexts")).alias("x")).select(*doc, F.col("x.marks").alias("mark"), F.col("x.contexts").alias("context"))
    held = written(held, "substring-runs")

    # Marks of several texts, the first text of each of their contexts, and how many contexts there are.
    n = F.count(F.lit(1)).alias("n")
    shared = held.groupBy("mark").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("top"), n).filter("owner < top").select("mark", "owner", "n")
    held = written(join_groups(held, written(shared, "substring-marks"), ["mark"], "n", held.count(), "inner").drop("n"), "substring-shared")
    n_held = held.count()
    contexts = written(held.groupBy("mark", "context").agg(F.min("doc_id").alias("first_doc"), n), "substring-contexts")
    several = contexts.groupBy("mark").agg(F.count(F.lit(1)).alias("n_contexts"))
    contexts = written(join_groups(contexts, several, ["mark"], "n_contexts", contexts.count(), "inner"), "substring-several")
    marked = join_groups(held, contexts, ["mark", "context"], "n", n_held, "inner")
    later, first = F.col("first_doc") < F.col("doc_id"), F.col("first_doc") == F.col("doc_id")
    lists = marked.groupBy(*doc).agg(
        F.collect_set(F.when(later, F.struct("mark", "context"))).alias("whole"),
        F.collect_set(F.when(first & (F.col("n_contexts") > 1), F.col("mark"))).alias("open"),
        F.collect_set(F.when(F.col("owner") == F.col("doc_id"), F.col("mark"))).alias("owned"),
    )
    lists = written(lists.select(*doc, F.col("whole.mark").alias("marks"), F.col("whole.context").alias("contexts"), "open", "owned"), "substring-lists")

    # Phrases of the marks, and the windows that recur although their context doesn't.
    wanted = lists.filter("size(open) > 0 OR size(owned) > 0").select(*doc, "open", "owned")
    looked = written(_windows(texts.join(wanted, doc), window), "substring-windows")
    opened = written(looked.select(*doc, F.explode(F.arrays_zip("w1", "w2")).alias("w")).select(*doc, "w.w1", "w.w2"), "substring-opened")
    recurring = opened.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("top"), n).filter("owner < top").select("w1", "w2", "owner", "n")
    passages = join_groups(opened, written(recurring, "substring-recurring"), ["w1", "w2"], "n", opened.count(), "inner").filter("owner < doc_id")
    passages = passages.groupBy(*doc).agg(F.collect_set(F.struct("w1", "w2")).alias("w"))
    passages = written(passages.select(*doc, F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2")), "substring-passages")

    plan = written(lists.select(*doc, "marks", "contexts", "open").join(passages, doc, "left").filter("size(marks) > 0 OR w1 IS NOT NULL"), "substring-plan")
    needed = plan.select(*doc, F.explode(F.array_distinct(F.when(F.col("w1").isNotNull(), F.concat("marks", "open")).otherwise(F.col("marks")))).alias("mark"))
    needed = written(needed, "substring-needed")
    spelled = looked.select(F.explode(F.arrays_zip("spelled", "phrases")).alias("x")).select(F.col("x.spelled").alias("mark"), F.col("x.phrases").alias("phrase")).dropDuplicates(["mark"])
    spelled = written(spelled.join(needed.groupBy("mark").agg(n), "mark"), "substring-spelled")
    phrases = join_groups(needed, spelled, ["mark"], "n", needed.count(), "inner", F.length("phrase") <= HOT_PHRASE)
    phrases = phrases.groupBy(*doc).agg(F.collect_list(F.struct("mark", "phrase")).alias("phrases"))

    # Every different text of at least a window meets its shard's automaton.
    streams = groups.filter((F.col("n_words") >= window) & F.col("first_id").isNotNull()).select(F.col("first_id").alias("doc_id"), F.col("first_key").alias("key"))
    streams = streams.join(plan.join(phrases, doc), doc, "left")
    streamed = _removed(texts.join(streams, doc), window).distinct()
    streamed = written(streamed.select(F.col("doc_id").alias("first_id"), F.col("key").alias("first_key"), "n_removed", "kept_sha256"), "substring-streamed")

    # All of a text is gone if a smaller id has the same words.
    copy = (F.col("n_words") >= window) & F.coalesce(F.col("doc_id") > F.col("first_id"), F.col("first_id").isNotNull())
    settled = written(groups.drop("n_words").join(streamed, ["first_id", "first_key"], "left"), "substring-settled")
    return join_groups(rows.select("doc_id", "n_words", "digest"), settled, ["digest"], "n", total).select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM t WHERE len(w) >= 50
), h AS (
  SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos, pos + 49), ' ')) AS passage FROM s
), f AS (
  SELECT passage, min(doc_id) AS first_id FROM h GROUP BY passage
), g AS (
  SELECT h.doc_id, h.pos FROM h JOIN f USING (passage) WHERE f.first_id < h.doc_id
), u AS (
  SELECT t.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM t
), v AS (
  SELECT u.doc_id, u.word, u.place,
         max(g.pos) OVER (PARTITION BY u.doc_id ORDER BY u.place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.place = g.pos
), k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT gone) AS kept
  FROM v GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""
