"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of L tokens costs ``linear * L + quadratic * L**2``, an estimate of its
dense and attention work. Each group of about GROUP_TOKENS tokens is packed by
itself: its documents, longest first, go to the sequence of lowest cost that
still has room. What no sequence has room for as a whole is cut over the room
that is left, so that a group has less than one sequence of padding.

Documents are tokenized once. A piece's CRC-32 after a cut comes from prefix
sums that were taken every STEP tokens, by the linearity of the CRC.

Ids are those of the library's plain call, so the string of a special token in a
text becomes that token.

Cases: a null or empty text is one document of its end token alone; long texts
are tokenized whole and cut at full sequences; repeated rows are packed as rows
of their own, in any groups; an empty table gives an empty result; further input
columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaya.llm.common import read_table, written

CAPACITY, STEP, END_ID = 4096, 32, 2
GROUP_TOKENS = 1 << 21
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
#: Entries of each of a worker's two memos, about 110 MB each, before the newer replaces the older; longer words are not kept.
MEMO_WORDS, MEMO_CHARS = 500_000, 64
#: Bytes of rows that are tokenized together, so that a word is looked up once for them.
BATCH_BYTES = 8 << 20
#: Fixed marks, none of them a letter, a digit, white space or the apostrophe.
MARKS = ".,;:!?%$#&*()-"
ONLY_MARKS = frozenset(MARKS)
#: A letter up to U+017F, U+0130 aside, marks, and the word's end.
MARKS_AT_END = "([A-Za-zÀ-ÖØ-öø-įı-ſ])([" + re.escape(MARKS) + r"]+)([ \t-\r]|$)"
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokens:
    """Ids of whole texts by the words between ASCII white space, which this vocabulary drops.

    Common marks after a letter, at the end of a word, are set apart, as they are
    pieces of their own there. Distinct words are told by Arrow, and new ones
    encoded many in one text and told apart by their last tokens, which carry the
    vocabulary's end-of-word suffix. The string of a special token in a text gets
    that token's id, as the library gives it, unless ``special_as_text``.
    """

    def __init__(self, data: bytes, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = special_as_text
        # Special tokens are told before letters are lowered, so words that may hold one are looked up as they are.
        self.special = "|".join(re.escape(x["content"]) for x in json.loads(data).get("added_tokens", [])) or "$^"
        suffix = json.loads(data)["model"].get("end_of_word_suffix") or "\0"
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        # Ids of words: those of late, and those that were replaced when the memo was full.
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def plain(word: str) -> bool:
        """Whether a word is one piece whatever the tokenizer's rules for digits, marks and contractions."""
        if not word.isalpha():
            return bool(word) and ONLY_MARKS.issuperset(word)
        # What isn't a letter once it is composed and lower-cased would go with the marks; up to U+017F that is U+0130 alone.
        return word.isascii() or (max(word) <= "\u017f" and "\u0130" not in word) or unicodedata.normalize("NFC", word).lower().isalpha()

    def each(self, words: list[str]) -> None:
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            for word, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.memo[word] = np.array(got.ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if self.plain(w)]
        self.each([w for w in words if not self.plain(w)])
        for k in range(0, len(plain), 2000):
            some = plain[k : k + 2000]
            raw = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[raw]) * 4 + 4).tolist()
            if len(stops) == len(some):
                ids = raw.tobytes()
                self.memo.update((w, ids[a:b]) for w, a, b in zip(some, [0, *stops[:-1]], stops, strict=True))
            else:
                self.each(some)

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; none may be null."""
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, MARKS_AT_END, r"\1 \2 "))
        words = lists.flatten().dictionary_encode()
        known = words.dictionary
        lower = pc.and_(pc.string_is_ascii(known), pc.invert(pc.match_substring_regex(known, self.special, ignore_case=True)))
        known = pc.if_else(lower, pc.ascii_lower(known), known).to_numpy(zero_copy_only=False).tolist()
        if len(self.memo) > MEMO_WORDS:
            self.old, self.memo = self.memo, {}
        memo, new = self.memo, []
        for word in dict.fromkeys(known):
            if word not in memo:
                ids = self.old.get(word)
                if ids is None:
                    new.append(word)
                else:
                    memo[word] = ids
        self.learn(new)
        parts = [memo[w] for w in known]
        for word in new:
            if len(word) > MEMO_CHARS:
                del memo[word]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, at, which = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size, words.indices.to_numpy()
        length = size[which]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = flat[np.repeat(at[which] - ends[:-1], length) + np.arange(ends[-1])]
        stops = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])].tolist()
        for a, b in zip(stops[:-1], stops[1:], strict=True):
            yield ids[a:b].tobytes()


def larger(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``least`` bytes and more, in order."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@lru_cache(maxsize=1)
def _word_tokens(data: bytes) -> WordTokens:
    return WordTokens(data)


@lru_cache(maxsize=1)
def _shifts() -> list[list[int]]:
    """Images of the 32 bits of a CRC when 1, 2, 4, ... zero bytes follow."""

    def times(matrix: list[int], value: int) -> int:
        out = 0
        for bit in range(32):
            if value >> bit & 1:
                out ^= matrix[bit]
        return out

    bit = [0xEDB88320] + [1 << k for k in range(31)]
    for _ in range(3):
        bit = [times(bit, x) for x in bit]
    out = [bit]
    for _ in range(20):
        out.append([times(out[-1], x) for x in out[-1]])
    return out


def crc_of_rest(whole: int, head: int, rest_bytes: int) -> int:
    """CRC-32 of what follows ``head``, from those of head with rest and of head alone."""
    k = 0
    while rest_bytes:
        if rest_bytes & 1:
            matrix, moved = _shifts()[k], 0
            for bit in range(32):
                if head >> bit & 1:
                    moved ^= matrix[bit]
            head = moved
        rest_bytes >>= 1
        k += 1
    return whole ^ head


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each full sequence of a document and one for what remains, with CRCs of its prefixes."""
    with open(tokenizer_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed size, about 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = _word_tokens(model.value), 0
        part = TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in larger(batches, BATCH_BYTES):
            rows = []
            texts = pc.fill_null(batch.column("text"), "")
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.batch(texts), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    marks, crc = [0], 0
                    for k in range(0, len(piece), 4 * STEP):
                        crc = zlib.crc32(piece[k : k + 4 * STEP], crc)
                        marks.append(crc)
                    full = len(piece) == 4 * capacity
                    rows.append((doc_id, start, len(piece) // 4, crc, n, b"" if full else np.array(marks[:-1], "<u4").tobytes(), part * 2_654_435_761 + seen))
                    seen += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "crc", "doc_tokens", "marks", "salt"])

    def quietly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collects, threads = gc.isenabled(), pa.cpu_count()
        gc.disable()  # nothing here makes cycles, and passes over the memos are slow
        pa.set_cpu_count(1)
        try:
            yield from run(batches)
        finally:  # the worker goes on to other tasks
            pa.set_cpu_count(threads)
            if collects:
                gc.enable()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(quietly, "doc_id long, start long, length long, crc long, doc_tokens long, marks binary, salt long")


def pack_group(rows: pd.DataFrame, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple]:
    """(doc_id, start, length, crc, doc_tokens, sequence, offset) of one group."""
    rows = rows.sort_values(["length", "doc_id", "start", "salt"], ascending=[False, True, True, True])
    out, count = [], int((rows["length"] == capacity).sum())
    for k, r in enumerate(rows.head(count).itertuples(index=False)):
        out.append((r.doc_id, r.start, r.length, r.crc, r.doc_tokens, k, 0))
    rest = rows.iloc[count:]
    bins = -(-int(rest["length"].sum()) // capacity)
    cost, room = np.zeros(bins), np.full(bins, capacity)

    def put(r, at: int, length: int, bin_: int) -> None:
        marks = np.frombuffer(r.marks, "<u4")
        whole = r.crc if at + length == r.length else int(marks[(at + length) // STEP])
        crc = crc_of_rest(whole, int(marks[at // STEP]), 4 * length) if at else whole
        out.append((r.doc_id, r.start + at, length, crc, r.doc_tokens, count + bin_, capacity - int(room[bin_])))
        room[bin_] -= length
        cost[bin_] += linear * length + quadratic * length * length

    for r in rest.itertuples(index=False):
        at = 0
        while at < r.length:
            need = r.length - at
            fits = np.flatnonzero(room >= need)
            if len(fits):
                put(r, at, need, int(fits[np.argmin(cost[fits])]))
                break
            most = int(np.argmax(room))
            cut = int(room[most]) // STEP * STEP
            if cut:
                put(r, at, cut, most)
                at += cut
            else:
                cost, room = np.append(cost, 0.0), np.append(room, capacity)
    return out


def pack(docs: DataFrame, tokenizer_path: str, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = written(tokenized(docs, tokenizer_path), "packing-pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = pd.DataFrame(pack_group(pdf), columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        got["sequence_id"] += int(pdf["group"].iloc[0]) << 32
        return got

    return pieces.withColumn("group", F.pmod(F.xxhash64("salt"), F.lit(groups))).groupBy("group").applyInPandas(run, OUT)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
