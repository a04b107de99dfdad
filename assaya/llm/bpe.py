"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its
encoding. That token is found from those of the shorter prefixes: a token fits
if the encoding of the rest ends in a token that stays apart from it, which is
asked of each pair of tokens once. The encoding is read backwards from the last
prefix. Since a prefix's token depends on nothing that follows, bytes can be
appended exactly, and after an edit only the prefixes near it are looked at.

Cases: a null or empty text has no tokens; texts and pieces of any length are
encoded whole, in time linear in their bytes; every row gives one row; an empty
table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from assaya.llm.common import read_table

#: Entries that a worker's memos hold before they are emptied: words of texts, and pairs of tokens; longer words are not kept.
MEMO_WORDS, MEMO_PAIRS, PAIR_SLOTS, MEMO_CHARS = 400_000, 200_000, 1 << 21, 64
#: Longer pieces are worked out one by one.
MANY_LONGEST = 64
#: Texts that are encoded together have about so many characters.
CHUNK = 4 << 20
#: Fixed marks, none of them a letter, a digit, white space or the apostrophe.
MARKS = ".,;:!?%$#&*()-"
HASH, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Tables:
    """Numpy look-ups of tokens by a hash of their bytes and of pairs of tokens."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe = bpe
        ids = np.array(list(bpe.tokens))
        self.size = np.zeros(bpe.span, np.int64)
        self.made = np.zeros(bpe.span, bool)
        keys = np.zeros(len(ids), np.uint64)
        for k, i in enumerate(ids.tolist()):
            value = 0
            for byte in bpe.tokens[i]:
                value = (value * int(HASH) + byte + 1) & 0xFFFFFFFFFFFFFFFF
            keys[k] = value
            self.size[i] = len(bpe.tokens[i])
            self.made[i] = bpe.halves(i)[0] != -2
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens have one hash")
        self.levels = []
        while len(ids):  # what finds its place taken goes on to the next, smaller level
            bits = max(8, int(len(ids)).bit_length() + 4)
            place = (keys * SPREAD >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(place, return_index=True)
            held, token = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1)
            held[place[first]], token[place[first]] = keys[first], ids[first]
            self.levels.append((np.uint64(64 - bits), held, token))
            keys, ids = np.delete(keys, first), np.delete(ids, first)
        self._clear()

    def token(self, keys: np.ndarray) -> np.ndarray:
        """The token with each hash, -1 if none has."""
        found = np.full(len(keys), -1)
        spread = keys * SPREAD
        for shift, held, token in self.levels:
            place = (spread >> shift).astype(np.int64)
            same = held[place] == keys
            found[same] = token[place[same]]
        return found

    def _clear(self) -> None:
        self.pairs, self.answers, self.n_pairs = np.full(PAIR_SLOTS, -1), np.zeros(PAIR_SLOTS, bool), 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free slot where it would go."""
        shift = np.uint64(65 - PAIR_SLOTS.bit_length())
        place = (keys.astype(np.uint64) * SPREAD >> shift).astype(np.int64)
        wait = np.flatnonzero((self.pairs[place] != keys) & (self.pairs[place] >= 0))
        while len(wait):
            place[wait] = (place[wait] + 1) & (PAIR_SLOTS - 1)
            got = self.pairs[place[wait]]
            wait = wait[(got != keys[wait]) & (got >= 0)]
        return place

    def apart(self, keys: np.ndarray) -> np.ndarray:
        """PrefixBPE.apart for each key left * span + right."""
        place = self._place(keys)
        new = np.flatnonzero(self.pairs[place] < 0)
        if len(new):
            unknown = np.unique(keys[new])
            if self.n_pairs + len(unknown) > PAIR_SLOTS // 2:
                self._clear()
            for key in unknown.tolist():
                slot = int(self._place(np.array([key]))[0])
                self.pairs[slot], self.answers[slot] = key, self.bpe.keeps_apart(*divmod(key, self.bpe.span))
            self.n_pairs += len(unknown)
            return self.apart(keys) if self.n_pairs == len(unknown) else self.answers[self._place(keys)]
        return self.answers[place]


class PrefixBPE:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        self._apart: dict[int, bool] = {}  # by left * span + right
        self.span = max(self.tokens) + 1
        ends = ahocorasick.Automaton()
        for data, i in ranks.items():
            ends.add_word(data.decode("latin-1"), i)
        ends.make_automaton()
        self._ends = ends.iter
        self._arrays: Tables | None = None

    def _merged(self, data: bytes) -> list[bytes]:
        """Plain merging by lowest rank; asked only for the bytes of single tokens, of two parts at the end."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get, none = self.ranks.get, 1 << 60
        while len(parts) > 2:
            rank, at = min((get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if rank == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge joins to this one; (-1, -1) for a byte, (-2, -2) if merging never makes it."""
        got = self._halves.get(token)
        if got is None:
            data = self.tokens[token]
            if len(data) == 1:
                got = (-1, -1)
            else:
                parts = self._merged(data)
                got = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-2, -2)
                if got[0] >= 0 and (self.halves(got[0])[0] == -2 or self.halves(got[1])[0] == -2):
                    got = (-2, -2)
            self._halves[token] = got
        return got

    def apart(self, left: int, right: int) -> bool:
        """``keeps_apart``, asked once for each pair."""
        known = self._apart.get(left * self.span + right)
        if known is None:
            if len(self._apart) >= MEMO_PAIRS:
                self._apart.clear()
            known = self._apart[left * self.span + right] = self.keeps_apart(left, right)
        return known

    def keeps_apart(self, left: int, right: int) -> bool:
        """Whether merging never joins bytes of the two tokens when they stand next to each other.

        The merges are undone from the last: at each time one token ends on the
        left of the border and one starts on its right. A merge of those two, in
        rank before both merges that they go into, would have crossed the border;
        of merges with the same rank the one further left comes first.
        """
        tokens, rank_of, halves = self.tokens, self.ranks.get, self.halves
        a, b, next_a, next_b = left, right, 1 << 60, 1 << 60
        if halves(a)[0] == -2 or halves(b)[0] == -2:
            return False
        while True:
            joint = rank_of(tokens[a] + tokens[b])
            if joint is not None and joint < next_a and joint <= next_b:
                return False
            split_a, split_b = halves(a)[1], halves(b)[0]
            if split_a < 0 and split_b < 0:
                return True
            if split_b < 0 or (split_a >= 0 and a > b):  # undo the later of the two merges
                next_a, a = a, split_a
            else:
                next_b, b = b, split_b

    def extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Adds the last tokens of the prefixes up to ``stop`` bytes; ``last[i]`` is that of ``i + 1`` bytes."""
        done, known, apart, sizes, span = len(last), self._apart.get, self.apart, self.sizes, self.span
        base = max(0, done + 1 - self.longest)
        for end, token in self._ends(data[base:stop].decode("latin-1")):  # of tokens with one end the longest comes first
            end += base
            if end != done:
                continue
            start = end + 1 - sizes[token]
            if start > 0:
                before = last[start - 1]
                fits = known(before * span + token)
                if fits or fits is None and apart(before, token):
                    last.append(token)
                    done += 1
            elif start == 0 and self.halves(token)[0] != -2:
                last.append(token)
                done += 1
        if done < stop:
            raise ValueError(f"byte {data[done]} is not in the vocabulary")

    def read(self, last: list[int], end: int) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        out = []
        while end:
            token = last[end - 1]
            out.append(token)
            end -= self.sizes[token]
        return out[::-1]

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        last: list[int] = []
        self.extend(data, last, len(data))
        return tuple(self.read(last, len(data)))

    def encode_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece; the same dynamic programme, over all pieces at once, a prefix length at a time."""
        out: list = [None] * len(pieces)
        todo = []
        for k, data in enumerate(pieces):
            whole = self.ranks.get(data)
            if whole is not None:
                out[k] = (whole,)
            elif len(data) > MANY_LONGEST:
                out[k] = self.encode_piece(data)
            else:
                todo.append(k)
        if not todo:
            return out
        todo.sort(key=lambda k: -len(pieces[k]))
        sizes = np.array([len(pieces[k]) for k in todo])
        width = int(sizes[0])
        data = np.frombuffer(b"".join([pieces[k].ljust(width, b"\0") for k in todo]), np.uint8).reshape(len(todo), width)
        last = np.full((len(todo), width), -1, np.int64)
        tables = self._tables()
        hashes: list[np.ndarray] = []
        for end in range(width):
            n = int(np.searchsorted(-sizes, -end))  # pieces with more than ``end`` bytes
            byte = data[:n, end].astype(np.uint64) + np.uint64(1)
            hashes = [byte, *(h[:n] * HASH + byte for h in hashes[: self.longest - 1])]
            open_ = np.arange(n)
            for size in range(len(hashes), 0, -1):
                token = tables.token(hashes[size - 1][open_])
                hit = np.flatnonzero(token >= 0)
                if not len(hit):
                    continue
                rows, token = open_[hit], token[hit]
                if size == end + 1:
                    fits = tables.made[token]
                else:
                    fits = tables.apart(last[rows, end - size] * self.span + token)
                last[rows[fits], end] = token[fits]
                open_ = np.delete(open_, hit[fits])
                if not len(open_):
                    break
            if len(open_):
                raise ValueError("a byte is not in the vocabulary")
        at, rows, columns = sizes - 1, np.arange(len(todo)), []
        while len(rows):
            column = np.full(len(todo), -1)
            column[rows] = token = last[rows, at]
            columns.append(column)
            at = at - tables.size[token]
            rows, at = rows[at >= 0], at[at >= 0]
        grid = np.stack(columns[::-1], 1)
        blank = (grid < 0).sum(1)
        for skip in np.unique(blank).tolist():
            own = np.flatnonzero(blank == skip)
            for k, ids in zip(own.tolist(), grid[own, skip:].tolist(), strict=True):
                out[todo[k]] = tuple(ids)
        return out

    def _tables(self) -> Tables:
        if self._arrays is None:
            self._arrays = Tables(self)
        return self._arrays

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """One piece that grows and is edited; its ids are always those of encoding it anew."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, []
        bpe.extend(data, self.last, len(data))

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` for bytes ``start`` to ``end``; returns how many prefixes were worked out anew."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        last = old[:start]
        self.bpe.extend(self.data, last, start + len(new))
        same, at = 0, start + len(new)
        while at < len(self.data) and same < self.bpe.longest:
            self.bpe.extend(self.data, last, at + 1)
            same = same + 1 if last[at] == old[at - shift] and len(self.bpe.tokens[last[at]]) <= at + 1 - start - len(new) else 0
            at += 1
        anew = at - start
        self.last = last + old[at - shift :]
        return anew

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.data)
        return [whole] if whole is not None else self.bpe.read(self.last, len(self.data))


class TextBPE:
    """Whole texts: pieces by a pattern of the usual form (words with at most one blank before them), each encoded by itself.

    Ids are kept as decimals joined by commas, one string for each word, since
    that is what a text's digest is taken from.
    """

    def __init__(self, data: bytes, pattern: str):
        self.bpe = PrefixBPE(parse_ranks(data))
        self.pieces = regex.compile(pattern).findall
        self.gaps = re.compile(r"\s\s").search
        self.memo: dict[str, str] = {}
        self.decimal = {i: str(i) for i in self.bpe.tokens}
        order = sorted(self.bpe.tokens)
        self.bytes = np.frombuffer(b"".join(self.bpe.tokens[i] for i in order), np.uint8)
        self.size, self.start = np.zeros(self.bpe.span, np.int64), np.zeros(self.bpe.span, np.int64)
        self.size[order] = [self.bpe.sizes[i] for i in order]
        self.start[order] = np.cumsum(self.size[order]) - self.size[order]

    def _cut(self, word: str) -> list[str]:
        """The pieces of a blank and a word; without the pattern's help if it is letters and then common marks."""
        stem = word.rstrip(MARKS)
        if stem.isalpha():
            return [" " + stem] if len(stem) == len(word) else [" " + stem, word[len(stem) :]]
        return self.pieces(" " + word)

    def encode_decimal(self, texts: list[str]) -> list[str]:
        """Ids of each text, in decimals joined by commas. Where no two white-space characters meet, each blank starts a piece, so what stands between blanks is remembered as a whole."""
        memo, gaps, decimal = self.memo, self.gaps, self.decimal.__getitem__
        split = [None if gaps(x) else x.split(" ") for x in texts]
        heads = [x if s is None else s.pop(0) for x, s in zip(texts, split, strict=True)]
        words = set().union(*(s for s in split if s))
        missing = words.difference(memo)
        if len(memo) + len(missing) > MEMO_WORDS:
            memo.clear()
            missing = words
        cut = {x: self._cut(x) for x in missing}
        head_cut = [self.pieces(x) for x in heads]
        names = set(chain.from_iterable(cut.values()))
        names.update(chain.from_iterable(head_cut))
        names = list(names)
        found = {x: ",".join(map(decimal, ids)) for x, ids in zip(names, self.bpe.encode_many([x.encode() for x in names]), strict=True)}
        for x, own in cut.items():
            memo[x] = found[own[0]] if len(own) == 1 else ",".join([found[p] for p in own])
        out = []
        for own, s in zip(head_cut, split, strict=True):
            head = [found[p] for p in own]
            out.append(",".join(chain(head, map(memo.__getitem__, s)) if s else head))
        for x in missing:
            if len(x) > MEMO_CHARS:
                del memo[x]
        return out

    def encode_chunks(self, texts: list[str]) -> Iterator[str]:
        """``encode_decimal`` for any number of texts, about CHUNK characters at a time."""
        start, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size > CHUNK or k + 1 == len(texts):
                yield from self.encode_decimal(texts[start : k + 1])
                start, size = k + 1, 0

    def encode(self, text: str) -> list[int]:
        return ids_of(self.encode_decimal([text])[0]).tolist()

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - ends + size, size)
        return self.bytes[at].tobytes()


def ids_of(decimals: str) -> np.ndarray:
    return np.fromstring(decimals, np.int64, sep=",") if decimals else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def _text_bpe(data: bytes, pattern: str) -> TextBPE:
    return TextBPE(data, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded bytes.

    The driver reads the vocabulary file and broadcasts it: its size is fixed
    (about 1 MB), and executors need no such file.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    extra = ", ids array<int>, decoded binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _text_bpe(ranks.value, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for decimals in bpe.encode_chunks([x or "" for x in batch.column("text").to_pylist()]):
                ids = ids_of(decimals)
                decoded = bpe.decode(ids)
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(decimals.encode()).hexdigest())
                out[2].append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    out[3].append(ids)
                    out[4].append(decoded)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()][: 5 if with_ids else 3]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=False))], names=names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
