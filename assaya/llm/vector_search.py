"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are rotated at random, so that the first dimensions of a difference are a
fair sample of all of them. Inside each probed list, distances are taken a block
of dimensions at a time; after each block a hypothesis test compares the partial
distance with the best found so far: the share of a distance that d of D rotated
dimensions hold is beta distributed around d / D, and candidates that lie EPSILON
standard deviations or more beyond the limit are abandoned. What is left is
measured on the original vectors in double precision.

Lists are the cells of centroids that are fitted on a bounded sample (SAMPLE_BYTES);
every row is indexed. Their number grows with the root of the rows (up to
MOST_LISTS). How many of them a query probes is measured on the sample: the least
number of nearest lists that hold TARGET of the neighbours of vectors held out. A
query first searches FIRST of those lists, nearest first, and then the others with
the limit it has from there, which tightens further inside each list.

Equal vectors are one candidate with its K + 1 smallest ids, and equal queries are
searched for once. Lists are put together to parts of about PART_BYTES, larger ones
are split over several; a query's vector goes once to each part that has lists it
probes, and a part's queries are dealt out in chunks of the same size.

Cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; ties go to the smaller vec_id; a repeated
vec_id counts once for each different vector; with fewer than K other vectors all
are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaya.llm.common import join_groups, read_table, written

K, QUERY_EVERY = 10, 100
SAMPLE_BYTES, MOST_LISTS, LISTS_PER_ROOT, PER_LIST = 32 << 20, 4096, 4, 32
#: Share of a sample's nearest neighbours that the probed lists are to hold; share of the probed lists that set the first limit.
TARGET, FIRST = 0.96, 0.1
BLOCK, EPSILON = 8, 2.6
PART_BYTES, PAIRS = 16 << 20, 1 << 20
#: Vectors of the sample that are no part of the fit and tell how many lists to probe.
HELD_OUT = 256
SEED = 7
OUT = "query_id long, rank int, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float64).reshape(-1, dim)
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Centroids by Lloyd's rounds."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.permutation(len(sample))[:lists]]
    for _ in range(rounds):
        near = nearest_lists(sample, centres, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        count = np.bincount(near, minlength=len(centres))
        held = np.flatnonzero(count)
        sums = np.add.reduceat(sample[order], (np.cumsum(count) - count)[held], axis=0)
        centres = centres.copy()
        centres[held] = sums / count[held, None]
    return centres


def nearest_lists(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row, nearest first."""
    out = []
    for k in range(0, len(rows), 2048):
        far = (centres**2).sum(1) - 2 * rows[k : k + 2048] @ centres.T
        some = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(far), 1))
        out.append(np.take_along_axis(some, np.take_along_axis(far, some, 1).argsort(1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def probes_for(asked: np.ndarray, sample: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET) -> int:
    """The least number of nearest lists that hold ``target`` of the ``k`` nearest neighbours that ``asked`` have in ``sample``."""
    own = nearest_lists(sample, centres, 1)[:, 0]
    far = (sample**2).sum(1) - 2 * asked @ sample.T
    near = np.argpartition(far, min(k, len(sample)) - 1, axis=1)[:, :k]
    order = nearest_lists(asked, centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], 1)
    places = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))))]) + 1


def limit_factor(done: int, dim: int, epsilon: float = EPSILON) -> float:
    """How far the distance estimated from ``done`` of ``dim`` rotated dimensions may be above the limit."""
    return 1 + epsilon * np.sqrt(2 * (dim - done) / (done * (dim + 2))) if done < dim else 1 + 1e-9


class Found:
    """The ``k`` nearest of each query so far, ties to the smaller key, and the limit that they set."""

    def __init__(self, worst: np.ndarray, keys: np.ndarray, k: int):
        self.worst, self.keys, self.k = worst.copy(), keys, k
        self.query, self.place, self.far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, query: np.ndarray, place: np.ndarray, far: np.ndarray) -> None:
        self.new.append((query, place, far))
        self.waiting += len(query)
        if self.waiting >= max(1024, len(self.query) // 2):
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        query, place, far = (np.concatenate([a, *b]) for a, b in zip((self.query, self.place, self.far), zip(*self.new, strict=True), strict=True))
        order = np.lexsort((self.keys[place], far, query))
        query, place, far = query[order], place[order], far[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last = nth == self.k - 1
        self.worst[query[last]] = np.minimum(self.worst[query[last]], far[last])
        keep = nth < self.k
        self.query, self.place, self.far = query[keep], place[keep], far[keep]
        self.new, self.waiting = [], 0


def scan_list(found: Found, asking: np.ndarray, rows: range, queries: np.ndarray, turned_queries: np.ndarray, vectors: np.ndarray, turned: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
    """Scans the candidates in ``rows`` for the queries ``asking``; how many pairs there were, and how many were measured in full."""
    dim, counts = vectors.shape[1], np.zeros(2, np.int64)
    step = max(1, PAIRS // max(1, len(rows)))
    for k in range(0, len(asking), step):
        some = asking[k : k + step]
        ours, theirs = turned[rows.start : rows.stop, :BLOCK], turned_queries[some, :BLOCK]
        partial = np.maximum((theirs**2).sum(1)[:, None] + (ours**2).sum(1)[None, :] - 2 * theirs @ ours.T, 0)
        counts[0] += partial.size
        done = min(BLOCK, dim)
        limit = found.worst[some] * limit_factor(done, dim, epsilon) * (done / dim) + 1e-9
        query, place = np.nonzero(partial <= limit[:, None])
        partial, query, place = partial[query, place], some[query], place + rows.start
        while done < dim and len(query):
            stop = min(done + BLOCK, dim)
            partial = partial + ((turned[place, done:stop] - turned_queries[query, done:stop]) ** 2).sum(1)
            done = stop
            keep = partial <= found.worst[query] * limit_factor(done, dim, epsilon) * (done / dim) + 1e-9
            if done == dim:
                counts[1] += len(query)
            partial, query, place = partial[keep], query[keep], place[keep]
        if len(query):
            found.add(query, place, ((vectors[place] - queries[query]) ** 2).sum(1))
    return counts


def search_part(lists: np.ndarray, vectors: np.ndarray, keys: np.ndarray, queries: np.ndarray, probed: list[np.ndarray], worst: np.ndarray, spin: np.ndarray, k: int, epsilon: float = EPSILON, rows_at_once: int = 2048) -> tuple[Found, np.ndarray]:
    """The ``k`` nearest that each query has in the lists it probes, of a part whose rows are sorted by list."""
    turned, turned_queries = vectors @ spin, queries @ spin
    found, counts = Found(worst, keys, k), np.zeros(2, np.int64)
    asking = np.repeat(np.arange(len(queries)), [len(x) for x in probed])
    asked = np.concatenate(probed) if len(probed) else np.zeros(0, np.int64)
    order = np.argsort(asked, kind="stable")
    asking, asked = asking[order], asked[order]
    names, starts = np.unique(lists, return_index=True)
    for name, start, stop in zip(names, starts, [*starts[1:], len(lists)], strict=True):
        own = asking[np.searchsorted(asked, name) : np.searchsorted(asked, name, "right")]
        for a in range(start, stop, rows_at_once) if len(own) else ():
            counts += scan_list(found, own, range(a, min(a + rows_at_once, stop)), queries, turned_queries, vectors, turned, epsilon)
    found.settle()
    return found, counts


def parts_of(sizes: dict[int, int], lists: int, most: int) -> np.ndarray:
    """For each list its first part and over how many it is dealt: small lists share one, large ones have several."""
    out, part, held = np.zeros((lists, 2), np.int64), 0, 0
    for k in range(lists):
        size = sizes.get(k, 0)
        if size > most:
            part += held > 0
            out[k] = part, -(-size // most)
            part, held = part + out[k, 1], 0
            continue
        if held and held + size > most:
            part, held = part + 1, 0
        out[k] = part, 1
        held += size
    return out


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, target: float = TARGET, lists: int | None = None) -> DataFrame:
    """The ``k`` nearest other rows of each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], OUT)
    dim = lengths[0]["dim"]
    rows = rows.filter(F.size("vector") == dim)
    most = max(256, PART_BYTES // (8 * dim))

    # One row for each different vector: only k + 1 ids of each map task's share of it are ever shuffled.
    ranked = rows.select("vec_id", "vector").selectExpr("*", "row_number() OVER (PARTITION BY vector ORDER BY vec_id) AS nth").filter(F.col("nth") <= k + 1)
    distinct = ranked.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("key", F.col("ids")[0])
    distinct = written(distinct, "vectors-distinct")
    n = distinct.count()

    lists = lists or (int(min(MOST_LISTS, LISTS_PER_ROOT * np.sqrt(n), n // 16)) if n > 256 else 1)
    sampled = min(SAMPLE_BYTES // (8 * dim), PER_LIST * lists)
    some = distinct.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(int(min(1.0, sampled / n) * (1 << 30)) + 1)).limit(2 * sampled).select("key", "vector")
    sample = matrix(some.toPandas().sort_values("key")["vector"], dim) if lists > 1 else np.zeros((0, dim))
    sample = sample[np.random.default_rng(SEED).permutation(len(sample))]
    lists = max(1, min(lists, len(sample) // 8))
    apart = min(HELD_OUT, len(sample) // 8)
    centres = fit_lists(sample[apart:], lists) if lists > 1 else np.zeros((1, dim))
    probes = min(lists, probes_for(sample[:apart], sample[apart:], centres, k, target)) if lists > 1 else 1
    first = max(1, int(np.ceil(probes * FIRST)))
    model = spark.sparkContext.broadcast((centres, rotation(dim)))  # at most MOST_LISTS + dim vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = nearest_lists(matrix(batch.column("vector"), dim), model.value[0], 1)[:, 0]
            yield batch.append_column("list", pa.array(near.astype(np.int64)))

    indexed = written(distinct.select("key", "ids", "vector").mapInArrow(assign, "key long, ids array<long>, vector array<double>, list long"), "vectors-indexed")
    sizes = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    table = parts_of(sizes, lists, most)
    places = spark.sparkContext.broadcast(table)
    place = F.broadcast(spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(table)], "list long, part long, over long"))
    dealt = indexed.join(place, "list").withColumn("part", F.col("part") + F.pmod(F.xxhash64("key"), F.col("over"))).drop("over")

    wanted = rows.filter(F.col("vec_id") % every == 0)
    queries = written(wanted.groupBy("vector").agg(F.min("vec_id").alias("query"), F.count(F.lit(1)).alias("n_asks")), "vectors-queries")

    def probe(begin: int, end: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = nearest_lists(matrix(batch.column("vector"), dim), model.value[0], end)[:, begin:]
                at, parts, own = [], [], []
                for q, names in enumerate(near):
                    held: dict[int, list[int]] = {}
                    for name in names.tolist():
                        part, over = places.value[name].tolist()
                        for x in range(part, part + over):
                            held.setdefault(x, []).append(name)
                    at += [q] * len(held)
                    parts += held
                    own += held.values()
                sent = batch.take(pa.array(at, pa.int64()))
                yield sent.append_column("part", pa.array(parts, pa.int64())).append_column("lists", pa.array(own, pa.list_(pa.int64())))

        return run

    def find(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = {"query": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "far": np.zeros(0)}
        if len(ours) and len(theirs):
            ours = ours.sort_values("list", kind="stable")
            keys, ids, names = ours["key"].to_numpy(), ours["ids"].to_numpy(), theirs["query"].to_numpy()
            found, _ = search_part(ours["list"].to_numpy(), matrix(ours["vector"], dim), keys, matrix(theirs["vector"], dim), [np.asarray(x) for x in theirs["lists"]], theirs["worst"].to_numpy(), model.value[1], k + 1)
            held = [ids[x] for x in found.place]
            times = [len(x) for x in held]
            out = {"query": np.repeat(names[found.query], times), "vec_id": np.concatenate(held) if held else out["vec_id"], "far": np.repeat(found.far, times)}
        return pd.DataFrame(out).sort_values(["query", "far", "vec_id"]).groupby("query").head(k + 1)

    def searched(asked: DataFrame, begin: int, end: int) -> DataFrame:
        """What ``asked`` (query, vector, worst) finds in its lists from place ``begin`` to ``end``."""
        sent = written(asked.select("query", "vector", "worst").mapInArrow(probe(begin, end), "query long, vector array<double>, worst double, part long, lists array<long>"), "vectors-sent")
        meet = written(sent.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.ceil(F.col("n") / F.lit(most)).cast("int")), "vectors-chunks")
        theirs = join_groups(sent, meet, ["part"], "n", sent.count(), "inner").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int"))
        ours = dealt.join(meet, "part").select("key", "ids", "vector", "list", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        found = ours.groupBy("part", "chunk").cogroup(theirs.groupBy("part", "chunk")).applyInPandas(find, "query long, vec_id long, far double")
        return written(found, "vectors-found")

    def nearest(found: DataFrame) -> DataFrame:
        best = found.selectExpr("*", "row_number() OVER (PARTITION BY query ORDER BY far, vec_id) AS nth").filter(F.col("nth") <= k + 1)
        return written(best.select("query", "vec_id", "far", "nth"), "vectors-best")

    best = nearest(searched(queries.withColumn("worst", F.lit(float("inf"))), 0, first))
    if first < probes:
        limits = best.filter(F.col("nth") == k + 1).select("query", F.col("far").alias("worst"))
        asked = queries.join(limits, "query", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        best = nearest(best.drop("nth").unionByName(searched(asked, first, probes)))

    # Each query's own row goes out here; equal queries share what was found for one of them.
    n_wanted = wanted.count()
    asks = join_groups(wanted, queries, ["vector"], "n_asks", n_wanted, "inner").select(F.col("vec_id").alias("query_id"), "query", "n_asks").distinct()
    lists_of = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("far", "vec_id"))).alias("near"))  # at most k + 1 each
    lists_of = lists_of.join(queries.select("query", "n_asks"), "query")
    every_one = join_groups(asks.drop("n_asks"), written(lists_of, "vectors-lists"), ["query"], "n_asks", n_wanted, "inner")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ordered = every_one.select("query_id", F.posexplode(others).alias("rank", "x"))
    return ordered.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.sqrt("x.far").alias("score"))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"))
