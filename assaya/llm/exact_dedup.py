"""Exact dedup against immutable snapshots screened by static binary-fuse filters.

A snapshot is a table of digest buckets plus one binary-fuse filter for each
shard of the digest space. A batch is first grouped by its own digests; one row
for each distinct digest is then screened by the filter of its shard. Only what
the filter lets through is joined to the snapshot's exact buckets, and digests
with more than one row have their whole normalised texts compared byte by byte.

Cases: a null text counts as empty; texts of any length are hashed whole; rows
that repeat a doc_id are rows of their own, the one row that stays is the one
with the largest doc_id (with equal doc_ids, each of those rows is marked kept);
a row whose doc_id is null stays only if its group has no other id; an empty
table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaya.llm.common import ascii_lower, join_groups, read_table, scratch, written

#: Digests that one filter holds at most, on average.
SHARD_KEYS = 50_000
#: Repeated digests that are broadcast at most: 32 MB.
BROADCAST_KEYS = 2_000_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class BinaryFuse8:
    """A static 3-wise binary-fuse filter with 8-bit fingerprints: no false negatives, about 1/256 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, seed)
        first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        mask, g = np.uint64(segment - 1), _mix(h, 0x9E3779B97F4A7C15)
        at = np.stack([(first + k) * segment + ((g >> np.uint64(20 * k)) & mask).astype(np.int64) for k in range(3)])
        return at, ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        """keys: any uint64 values; repeats count once."""
        keys = np.unique(keys)
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25))))
        grow = 1.125 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, -(-int(n * grow + 16) // segment) - 2)
        for seed in range(1, 1000):
            if seed % 20 == 0:
                segments += 1 + segments // 10
            at, prints = cls._places(keys, seed, segment, segments)
            order = cls._peel(at, (segments + 2) * segment)
            if order is not None:
                break
        else:
            raise ValueError("no seed gives a filter for these keys")
        table = np.zeros((segments + 2) * segment, np.uint8)
        for layer, free in reversed(order):  # each layer's free cells are no other key's, so it is set as a whole
            cells = at[:, layer]
            value = prints[layer] ^ table[cells[0]] ^ table[cells[1]] ^ table[cells[2]] ^ table[free]
            table[free] = value
        return cls(seed, segment, segments, table)

    @staticmethod
    def _peel(at: np.ndarray, cells: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Layers of keys, each with a cell that no key still there shares; None if a core is left."""
        n = at.shape[1]
        count = np.bincount(at.ravel(), minlength=cells)
        xor = np.zeros(cells, np.int64)
        for row in at:
            np.bitwise_xor.at(xor, row, np.arange(n))
        layers, left = [], n
        alone = np.flatnonzero(count == 1)
        while len(alone):
            keys, where = np.unique(xor[alone], return_index=True)
            layers.append((keys, alone[where]))
            left -= len(keys)
            gone = at[:, keys]
            for row in gone:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(xor, row, keys)
            touched = np.unique(gone)
            alone = touched[count[touched] == 1]
        return None if left else layers

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self._places(keys, self.seed, self.segment, self.segments)
        return (self.table[at[0]] ^ self.table[at[1]] ^ self.table[at[2]]) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<i8").tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse8:
        seed, segment, segments = np.frombuffer(data[:24], "<i8").tolist()
        return cls(seed, segment, segments, np.frombuffer(data[24:], np.uint8))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of each whole normalised text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.sha2(ascii_lower(text), 256)).alias("digest"))


def buckets(rows: DataFrame) -> DataFrame:
    """One row for each digest: how many rows have it and the largest id; combined before the shuffle."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("top_id"), F.count(F.lit(1)).alias("n"))


def _key(shards: int) -> list:
    """The filter's 64-bit key and shard of a digest: different parts of it."""
    return [F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long").alias("part"), F.hex(F.substring("digest", 5, 8)).alias("key"), F.lit(shards).alias("shards")]


def _with_shard(rows: DataFrame, shards: int) -> DataFrame:
    part, key, _ = _key(shards)
    return rows.withColumns({"shard": F.pmod(part, F.lit(shards)), "key": key})


def _uint64(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(keys)), ">u8").astype(np.uint64)


class Snapshot:
    """An immutable set of digest buckets with one filter for each shard, which can be written once and read for every batch."""

    def __init__(self, buckets: DataFrame, filters: DataFrame, shards: int):
        self.buckets, self.filters, self.shards = buckets, filters, shards

    @classmethod
    def build(cls, rows: DataFrame, n_rows: int) -> Snapshot:
        shards = max(1, -(-n_rows // SHARD_KEYS))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "shards": [shards], "filter": [BinaryFuse8.build(_uint64(pdf["key"])).to_bytes()]})

        held = buckets(rows)
        keyed = _with_shard(held, shards).select("shard", "key")
        return cls(held, keyed.groupBy("shard").applyInPandas(build, "shard long, shards long, filter binary"), shards)

    def write(self, path: str) -> None:
        self.buckets.write.parquet(f"{path}/buckets")
        self.filters.write.parquet(f"{path}/filters")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Snapshot:
        filters = spark.read.parquet(f"{path}/filters")
        one = filters.select("shards").limit(1).collect()
        return cls(spark.read.parquet(f"{path}/buckets"), filters, one[0]["shards"] if one else 1)

    def screen(self, batch: DataFrame) -> DataFrame:
        """The buckets of a batch whose digest the snapshot may hold; a digest that it holds is never missing."""

        def test(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            if not len(theirs) or not len(ours):
                return ours[["digest", "top_id", "n"]].iloc[:0]
            hit = BinaryFuse8.from_bytes(theirs["filter"].iloc[0]).contains(_uint64(ours["key"]))
            return ours.loc[hit, ["digest", "top_id", "n"]]

        return _with_shard(batch, self.shards).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(test, "digest binary, top_id long, n long")


def _only_repeated(hashed: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``hashed`` whose digest is one of ``groups``.

    Up to BROADCAST_KEYS groups, 64 bits of each digest are broadcast (16 bytes a
    key), so texts that have no copy are never shuffled; a row too many does no
    harm, as texts are compared next. Beyond that, rows are dealt out by digest.
    """
    if groups.count() > BROADCAST_KEYS:
        return hashed.join(groups.select("digest"), "digest", "left_semi")
    keys = groups.select(F.xxhash64("digest").alias("key")).distinct()
    return hashed.withColumn("key", F.xxhash64("digest")).join(F.broadcast(keys), "key", "left_semi").drop("key")


def exact_dedup(docs: DataFrame, snapshot: DataFrame | None = None, stored: Snapshot | None = None) -> DataFrame:
    """One row per row of ``docs`` (and of ``snapshot``): doc_id, keep_id, group_size, kept, text_sha256.

    Without a ``snapshot``, the lower half of the id range of ``docs`` stands for
    the immutable snapshot and the upper half for the batch that comes in. ``stored``
    are the buckets and filters of ``snapshot``, if they were written before.
    """
    spark = docs.sparkSession
    if snapshot is None:
        marked = digests(docs)
        low, high = docs.select(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
        edge = 0 if low is None else low + (high - low) // 2
        marked = marked.withColumn("incoming", F.coalesce(F.col("doc_id") > edge, F.lit(False)))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    else:
        marked = digests(snapshot).withColumn("incoming", F.lit(False)).unionByName(digests(docs).withColumn("incoming", F.lit(True)))
        texts = snapshot.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    marked = written(marked, "exact-digests")
    total = marked.count()
    if not total:
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")

    if stored is None:
        path = scratch(spark, "exact-snapshot")
        Snapshot.build(marked.filter("not incoming"), total).write(path)
        stored = Snapshot.read(spark, path)
    old = stored
    new = buckets(marked.filter("incoming"))
    positive = old.screen(new)
    met = positive.join(old.buckets.select("digest", F.col("top_id").alias("old_id"), F.col("n").alias("old_n")), "digest")
    met = written(met.select("digest", F.greatest("top_id", "old_id").alias("top_id"), (F.col("n") + F.col("old_n")).alias("n")), "exact-met")
    own = old.buckets.unionByName(new).filter("n > 1").join(met.select("digest"), "digest", "left_anti")
    groups = written(met.unionByName(own), "exact-groups")

    # The byte check: whole texts of one digest, grouped by their bytes. Equal texts combine before the shuffle.
    body = ascii_lower(F.coalesce(texts["text"].cast("string"), F.lit("")))
    hashed = texts.select("doc_id", body.alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    repeated = _only_repeated(hashed, groups)
    classes = repeated.groupBy("digest", "body").agg(F.max("doc_id").alias("top_id"), F.count(F.lit(1)).alias("n"))
    checked = written(classes.select("digest", "top_id", "n", F.md5("body").alias("mark")), "exact-classes")
    clashing = checked.groupBy("digest").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("digest")
    rows = marked.select("doc_id", "digest")
    if clashing.isEmpty():  # so it is with SHA-256
        every = join_groups(rows, checked.select("digest", "top_id", "n"), ["digest"], "n", total)
    else:
        clear = checked.join(clashing, "digest", "left_anti").select("digest", "top_id", "n")
        plain = join_groups(rows.join(clashing, "digest", "left_anti"), clear, ["digest"], "n", total)
        split = hashed.join(clashing, "digest").select("doc_id", "digest", F.md5("body").alias("mark")).join(checked, ["digest", "mark"]).select("digest", "doc_id", "top_id", "n")
        every = plain.select("digest", "doc_id", "top_id", "n").unionByName(split)
    return every.select(
        "doc_id",
        F.coalesce("top_id", "doc_id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.coalesce("top_id", "doc_id"), F.col("top_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
"""
