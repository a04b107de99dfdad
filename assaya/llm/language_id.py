"""Language ID by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters counts as one blank, and n-grams of
one to three characters are hashed to 2**BITS buckets. The log-probability matrix
(buckets by languages, under MAX_MODEL_MB) is broadcast; a batch of texts is
scored at once by gathering rows and adding them up between text boundaries. The
languages' prior is uniform.

The classifier learns from a bounded sample: at most about SAMPLE_PER_LANG
documents of each language, chosen by a hash of doc_id.

Cases: a null text and one without letters are ``und`` with score 0; texts of any
length are scored whole; ties go to the language first in order; where nothing is
left to learn from, all are ``und``; repeated rows give repeated rows; a null
doc_id counts as held out; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaya.llm.common import read_table

BITS, ORDERS = 15, 3
SAMPLE_PER_LANG = 4000
MAX_MODEL_MB = 64
#: Characters that are scored together; longer texts are scored in segments.
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _segments(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Lower-cased texts between blanks, cut to segments of at most CHUNK characters, about CHUNK of them at a time.

    Gives the number of each segment's text, the segment after the characters that
    stand before it, and how many of its first characters only serve as those.
    """
    owners, parts, leads, size = [], [], [], 0
    for k, text in enumerate(texts):
        whole = f" {text.lower()} "
        for start in range(1, len(whole), CHUNK):
            lead = min(start, ORDERS - 1)
            part = whole[start - lead : start + CHUNK]
            if size and size + len(part) > CHUNK:
                yield owners, parts, leads
                owners, parts, leads, size = [], [], [], 0
            owners.append(k)
            parts.append(part)
            leads.append(lead)
            size += len(part)
    if parts:
        yield owners, parts, leads


def grams(parts: list[str], leads: list[int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket at each character but the leads; where each part starts among them; how many letters it has.

    Each text begins after a blank and ends with one, so no n-gram spans two texts.
    """
    sizes, lead = np.array([len(x) for x in parts]), np.array(leads)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    own = np.ones(len(codes), bool)
    for k in range(ORDERS - 1):
        own[begins[lead > k] + k] = False
    starts = np.concatenate([[0], np.cumsum(sizes - lead)[:-1]]).astype(np.int64)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint32)
    n_letters = np.add.reduceat(letter[own].astype(np.int64), starts)
    out, value = [], codes.copy()
    for order in range(ORDERS):
        if order:
            before = np.concatenate([np.full(order, 32, np.uint32), codes[:-order]])
            value = value * np.uint32(0x9E3779B1) + before
        mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(order)
        out.append(((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)).astype(np.int32)[own])
    return out, starts, n_letters


class Model:
    """Log probabilities, a row for each bucket and a column for each language."""

    def __init__(self, langs: list[str], matrix: np.ndarray):
        self.langs, self.matrix = langs, matrix

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        total, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for owners, parts, leads in _segments(texts):
            buckets, starts, n_letters = grams(parts, leads)
            np.add.at(letters, owners, n_letters)
            for x in buckets:
                np.add.at(total, owners, np.add.reduceat(self.matrix[x], starts, axis=0, dtype=np.float64))
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        names = [self.langs[k] if n else "und" for k, n in zip(total.argmax(1), letters, strict=True)]
        return names, np.where(letters > 0, score, 0.0).tolist()


def train(rows: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """Learns from doc_id, text and lang of ``rows``; None if there is nothing to learn from."""
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    if len(langs) * (1 << BITS) * 4 > MAX_MODEL_MB << 20:
        raise ValueError(f"{len(langs)} languages need a matrix of over {MAX_MODEL_MB} MB; lower BITS")
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, per_lang / sizes[k])])
    some = rows.filter(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1 << 30)) < share[F.col("lang")] * F.lit(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in set(names):
                own = [t for t, x in zip(texts, names, strict=True) if x == lang]
                sums = held.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for _, parts, leads in _segments(own):
                    for x in grams(parts, leads)[0]:
                        sums += np.bincount(x, minlength=1 << BITS)
        for lang, sums in held.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})

    # The sample is bounded, so a fixed number of tasks can count it; each emits a bounded number of sums.
    counted = some.select("text", "lang").repartition(12).mapInArrow(count, "lang string, bucket long, n long")
    table = np.zeros((1 << BITS, len(langs)))
    place = {x: k for k, x in enumerate(langs)}
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        table[r.bucket, place[r.lang]] = r.n
    table += 0.5
    return Model(langs, np.log(table / table.sum(0)).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of ``docs`` named in ``keep`` (doc_id if None), then the language and its score under ``names``; only text is looked at."""
    keep = keep if keep is not None else ["doc_id"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.langs, model.matrix))  # at most MAX_MODEL_MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value) if shared.value else None
        for batch in batches:
            texts = [x or "" for x in batch.column("__text").to_pylist()]
            langs, scores = own.predict(texts) if own and texts else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    return docs.select(*keep, docs["text"].cast("string").alias("__text")).mapInArrow(run, f"{schema}, {names[0]} string, {names[1]} double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of the others."""
    model = train(docs.filter(~held_out(docs["doc_id"])).withColumn("text", F.col("text").cast("string")))
    got = predict(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
