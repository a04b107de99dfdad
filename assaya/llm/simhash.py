"""SimHash near-dedup by a segment-popcount embedding and a grid range join.

A fingerprint of 64 bits is mapped to the bit counts of its SEGMENTS segments.
The Manhattan distance of two such points is never above the number of bits in
which the fingerprints differ. The points are laid out in BANDS bands of segments:
within distance RADIUS at most RADIUS bands can differ, so two linked points share
a cell of at least one grid over BANDS - RADIUS of the bands. Inside a cell, only
points whose whole bit counts are within RADIUS are compared, and exactly. A cell
of more than TILE points is dealt out in pairs of tiles. Each task returns the
links of a spanning forest of what it compared, never all pairs.

Equal fingerprints are one point from the start, whatever the number of rows.

Cases: null and empty texts and texts without words have fingerprint zero, which
is linked like any other; texts of any length are read whole; rows that repeat a
doc_id each give a row; rows whose doc_id is null are no points of their own but
get the component of their fingerprint; an empty table gives an empty result;
further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaya.llm.common import join_groups, read_table, written

SHINGLE, SEED, RADIUS = 4, 42, 4
SEGMENTS, BANDS = 32, 6
TILE = 2048
#: Cells of more than a tile that are broadcast at most: 1 MB.
BROADCAST_CELLS = 100_000
#: Edges between what is not yet drawn together that one task joins: 160 kB.
LAST_EDGES = 10_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text's shingles of lower-cased words, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = (ends - [len(w) + 1 for w in words])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
    digest = xxhash.xxh64_digest
    ones, every = np.zeros(64, np.int64), 0
    for k in range(0, n, 1 << 16):
        hashes = b"".join([digest(body[a:b], SEED) for a, b in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
        every += len(bits)
    return int.from_bytes(np.packbits(2 * ones > every).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py() or "", shingle) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(values, np.uint64).astype(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def bands_for(points: int) -> int:
    """More bands make more grids of smaller cells; every choice finds all links."""
    return BANDS + (points > 1 << 24) + (points > 1 << 28)


def cells(fps: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(grids, points): the cell of each point in the grid of each choice of ``bands`` - RADIUS bands."""
    width = 64 // SEGMENTS
    counts = np.stack([np.bitwise_count(fps >> np.uint64(s * width) & np.uint64((1 << width) - 1)) for s in range(SEGMENTS)]).astype(np.uint64)
    edges = [SEGMENTS * b // bands for b in range(bands + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(bands), bands - RADIUS)):
        value = np.full(len(fps), number, np.uint64)
        for b in chosen:
            for s in range(edges[b], edges[b + 1]):
                value = value * np.uint64(width + 1) + counts[s]
        out.append(value)
    return np.stack(out)


def links(cell: np.ndarray, own: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """(n, 2) places of a spanning forest of the links inside each cell.

    Rows are sorted by cell and then by whole bit count; ``fps`` has a row of 64-bit
    words for each. ``own`` is the tile of a row, -1 where a cell is compared as a
    whole; rows of one tile aren't compared. A cell whose rows are all connected
    already is compared no further.
    """
    fps = fps.reshape(len(cell), -1)
    new_cell = np.concatenate([[True], cell[1:] != cell[:-1]])
    starts, number = np.flatnonzero(new_cell), np.cumsum(new_cell) - 1
    count = np.bitwise_count(fps).astype(np.int64).sum(1)
    parent = np.arange(len(fps))
    out: list[tuple[int, int]] = []

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            x = up

    i, gap = np.arange(len(fps) - 1), 1
    while len(i):
        j = i + gap
        i = i[(cell[j] == cell[i]) & (count[j] - count[i] <= radius)]  # the lower bound, over one segment of all bits
        j = i + gap
        near = (np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64) <= radius) & ((own[i] != own[j]) | (own[i] < 0))
        a, b = i[near], j[near]
        apart = roots(a) != roots(b)
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            u, v = int(roots(np.array([x]))[0]), int(roots(np.array([y]))[0])
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((x, y))
        gap += 1
        i = i[i + gap < len(fps)]
        if gap & (gap - 1) == 0 and len(i):
            label = roots(np.arange(len(fps)))
            whole = np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts)
            i = i[~whole[number[i]]]
    return np.array(out, np.int64).reshape(-1, 2)


def stars(ids: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each id to the smallest it is connected to, for a forest of ``pairs`` of places: forests of one group in several cells then have the same few edges."""
    places, flat = np.unique(pairs, return_inverse=True)
    ends, parent = flat.reshape(-1, 2), np.arange(len(places))
    own = np.asarray(ids)[places]
    for x, y in ends.tolist():
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        if own[y] < own[x]:
            x, y = y, x
        parent[y] = x
    while (parent[parent] != parent).any():
        parent = parent[parent]
    apart = own != own[parent]
    return own[apart].astype(np.int64), own[parent][apart].astype(np.int64)


def contracted(edges: DataFrame) -> DataFrame:
    """As few edges as connect the same: one from each id to its smallest neighbour, and from its other neighbours to that one.

    ``edges`` go to the centres of stars, of which an id has at most one for each task that compared it.
    """
    near = edges.groupBy("a").agg(F.collect_set("b").alias("bs")).select("a", "bs", F.array_min("bs").alias("b"))
    others = near.filter(F.size("bs") > 1).select(F.explode(F.array_remove("bs", F.col("b"))).alias("a"), "b")
    return near.select("a", "b").unionByName(others).distinct()


def in_pairs_of_tiles(rows: DataFrame, tiles: Column, by: Column) -> DataFrame:
    """``rows`` of a group dealt into ``tiles`` tiles and once to each pair of tiles (t1, t2) with theirs; ``own`` is -1 in (t, t), else the row's tile."""
    names = rows.columns
    dealt = rows.withColumn("tiles", tiles).withColumn("own", F.when(F.col("tiles") > 1, F.pmod(by, "tiles").cast("int")).otherwise(F.lit(0)))
    dealt = dealt.select(*names, "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with"))
    return dealt.select(*names, F.least("own", "with").alias("t1"), F.greatest("own", "with").alias("t2"), F.when(F.col("own") == F.col("with"), F.lit(-1)).otherwise(F.col("own")).alias("own"))


def linked_in_cells(laid: DataFrame, words: list[str], radius: int) -> DataFrame:
    """(a, b) links between points of a cell: ``laid`` has cell, v and the fingerprint's ``words``; a point may lie in many cells."""
    large = laid.groupBy("cell").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > TILE)
    large = written(large.select("cell", F.ceil(F.col("held") / F.lit(TILE)).cast("int").alias("parts")), "cells-large")
    bits = F.lit(0)
    for w in words:
        bits = bits + F.bit_count(w)
    if large.count() <= BROADCAST_CELLS:
        large = F.broadcast(large)
    parts = laid.join(large, "cell", "left")
    dealt = in_pairs_of_tiles(parts, F.coalesce("parts", F.lit(1)), F.xxhash64("v")).withColumn("bits", bits)
    dealt = dealt.repartition("cell", "t1", "t2").sortWithinPartitions("cell", "t1", "t2", "bits", *words)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("cell", "t1", "t2", "own", "v", *words)
        rest = {c: np.zeros(0, np.int64) for c in names}
        for batch in chain(batches, [None]):
            if batch is not None:
                rest = {c: np.concatenate([rest[c], np.asarray(batch.column(c)).astype(np.int64)]) for c in names}
            n = len(rest["v"])
            if not n:
                continue
            new = np.concatenate([[True], np.any([rest[c][1:] != rest[c][:-1] for c in names[:3]], axis=0)])
            cut = n if batch is None else int(np.flatnonzero(new)[-1])  # a cell may go on in the next batch
            if cut:
                pairs = links(np.cumsum(new)[:cut], rest["own"][:cut], np.stack([rest[w][:cut].astype(np.uint64) for w in words], 1), radius)
                a, b = stars(rest["v"][:cut], pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            rest = {c: x[cut:] for c, x in rest.items()}

    return contracted(dealt.mapInArrow(compare, "a long, b long"))


def linked(points: DataFrame, radius: int = RADIUS, bands: int | None = None) -> DataFrame:
    """(a, b) links between ids of ``points`` (v: its id, fp: its fingerprint), enough to connect what is linked."""
    bands = bands or bands_for(points.count())

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, fp = np.asarray(batch.column("v")), np.asarray(batch.column("fp"))
            grid = cells(fp.astype(np.uint64), bands)
            n = len(grid)
            yield pa.RecordBatch.from_arrays([pa.array(grid.astype(np.int64).ravel()), pa.array(np.tile(v, n)), pa.array(np.tile(fp, n))], names=["cell", "v", "fp"])

    return linked_in_cells(points.select("v", "fp").mapInArrow(lay_out, "cell long, v long, fp long"), ["fp"], radius)


def joined_here(edges: DataFrame) -> DataFrame:
    """v and c, the smallest id that can be reached, for every end of a few edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([np.asarray(batch.column(c)) for c in ("a", "b")], 1) for batch in batches]
        ids, flat = np.unique(np.concatenate(parts) if parts else np.zeros((0, 2), np.int64), return_inverse=True)
        a, b = stars(ids, flat.reshape(-1, 2))
        low = ids.copy()
        low[np.searchsorted(ids, a)] = b
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(low.astype(np.int64))], names=["v", "c"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "v long, c long")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """v and component, the smallest id that can be reached, for every end of an edge.

    Each round draws an id together with the first of its neighbours and itself, in
    the order of ids in the first round (edges mostly go to centres of small ids), then
    in an order by hash, which no chain of ids can slow down. What is drawn together is
    one id from then on, and edges inside it go, so the rounds shrink: all of them join
    a small multiple of the edges. The last few edges are joined in one task. Then ids
    take what their names became, round by round back. Every round ends in a written
    table; nothing but a count goes to the driver.
    """
    left, steps = written(edges.select("a", "b"), "components-edges"), []
    while (held := left.count()) > LAST_EDGES:
        if len(steps) == rounds:
            raise RuntimeError(f"components have not settled in {rounds} rounds")

        def place(c: str, number: int = len(steps)) -> Column:
            return F.struct((F.xxhash64(c, F.lit(number)) if number else F.col(c)).alias("at"), F.col(c).alias("id"))

        both = left.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(left.select(F.col("b").alias("v"), F.col("a").alias("w")))
        near = both.groupBy("v").agg(F.min(place("w")).alias("w"), F.count(F.lit(1)).alias("degree"))
        step = written(near.select("v", F.least(place("v"), "w")["id"].alias("m"), "degree"), "components-step")
        steps.append(step)
        for end in ("a", "b"):  # ids of many edges are no hot keys
            left = join_groups(left, step.select(F.col("v").alias(end), "m", "degree"), [end], "degree", held, "inner").drop(end, "degree").withColumnRenamed("m", end)
        left = written(left.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components-edges")
    label = written(joined_here(left), "components-labels")
    for step in reversed(steps):
        hop = step.groupBy("m").agg(F.count(F.lit(1)).alias("held")).join(label.select(F.col("v").alias("m"), "c"), "m", "left").select("m", "held", F.coalesce("c", "m").alias("c"))
        label = written(join_groups(step.select("v", "m"), hop, ["m"], "held", step.count(), "inner").select("v", "c"), "components-labels")
    if not steps:
        return label.select("v", F.col("c").alias("component"))
    low = label.groupBy("c").agg(F.min("v").alias("component"), F.count(F.lit(1)).alias("held"))
    return join_groups(label, low, ["c"], "held", label.count(), "inner").select("v", "component")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    rows = written(fingerprints(docs, shingle), "simhash-rows")
    total = rows.count()
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("n")), "simhash-points")
    found = components(linked(points.filter("v IS NOT NULL"), radius))
    groups = points.join(found, "v", "left").select("fp", "n", F.coalesce("component", "v").alias("component_id"))
    return join_groups(rows, groups, ["fp"], "n", total).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Documents of a given similarity. A fingerprint's bits differ in a share of arccos(c) / pi for sets whose cosine is c, 0.15 at a Jaccard
# similarity of 0.8: about ten bits of 64, which no small radius finds. So fingerprints have 256 bits here, and what is laid out is not
# only a segment's count of bits but the counts behind them: of each segment the bit that the shingles agree on most, which similar sets share.
SIMILAR_SHINGLE, SIMILAR, WIDE_WORDS, SEGMENT = 5, 0.8, 4, 8
#: Words of a fingerprint that go with its cells. Differing bits up to which two sets are worth verifying (of 128 bits, 0.8 differ in 19 with a deviation of 4), and beyond which they never are.
KEPT_WORDS, WIDE_RADIUS, NEVER = 2, 36, 56
#: Chance of two sets of similarity 0.8 to share a segment's extreme, measured; points that a cell may have on average.
SHARED, CELL_POINTS = 0.64, 64
#: Shingles of a tile in which similarities are verified.
TILE_SHINGLES = 1 << 20
FPS = [f"f{k}" for k in range(KEPT_WORDS)]


def shingle_set(text: str, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's different shingles of lower-cased words; a shorter text is one shingle, none if it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    body, sizes = b" ".join(words), [len(w) + 1 for w in words]
    ends = np.cumsum(sizes)
    n = max(1, len(words) - shingle + 1)
    starts, stops = (ends - sizes)[:n].tolist(), (ends[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(body[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def wide_sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 256 bits of a set, and of each segment its most agreed bit and that bit's value."""
    sums = np.zeros(64 * WIDE_WORDS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        wide = np.empty((len(hashes[k : k + (1 << 14)]), WIDE_WORDS), np.uint64)
        for w in range(WIDE_WORDS):  # further words of a hash, by mixing
            x = hashes[k : k + (1 << 14)] + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            wide[:, w] = x ^ (x >> np.uint64(31))
        sums += np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    balance = (2 * sums - len(hashes)).reshape(-1, SEGMENT)
    top = np.abs(balance).argmax(1)
    extreme = 2 * top + (np.take_along_axis(balance, top[:, None], 1)[:, 0] > 0)
    return np.packbits(balance.ravel() > 0).view("<u8"), extreme.astype(np.uint8)


def choices(points: int) -> list[tuple[int, ...]]:
    """Choices of segments that make the cells: as many segments as keep cells small, as many choices as similar sets need to share one (of sets between 0.80 and 0.87, 99.5 % with three segments, 98.6 % with four)."""
    segments = 64 * WIDE_WORDS // SEGMENT
    size = int(np.clip(np.ceil(np.log2(max(points / CELL_POINTS, 1)) / np.log2(2 * SEGMENT)), 3, 8))
    rng = np.random.default_rng(SEED)
    return [tuple(sorted(rng.permutation(segments)[:size].tolist())) for _ in range(int(np.ceil(10 / SHARED**size)))]


def verified(hashes: list[np.ndarray], fps: np.ndarray, own: np.ndarray, least: float = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is at least ``least``; rows of one tile aren't compared, -1 is none.

    A set is compared with those not connected to it yet, the nearest fingerprint first.
    """
    size = np.array([len(x) for x in hashes])
    label, out = np.arange(len(hashes)), []
    for i in range(1, len(hashes)):
        far = np.bitwise_count(fps[:i] ^ fps[i]).sum(1, dtype=np.int64)
        able = (far <= NEVER) & ((own[:i] != own[i]) | (own[:i] < 0)) & (np.minimum(size[:i], size[i]) >= least * np.maximum(size[:i], size[i]) - 1e-9)
        order = np.flatnonzero(able)
        for j in order[np.argsort(far[order], kind="stable")].tolist():
            if label[j] != label[i]:
                shared = len(np.intersect1d(hashes[i], hashes[j], assume_unique=True))
                if shared >= least * (size[i] + size[j] - shared) - 1e-9:
                    label[label == label[i]] = label[j]
                    out.append((i, j))
    return out


def similar_documents(docs: DataFrame, least: float = SIMILAR, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """doc_id and component_id of every row: documents whose sets of ``shingle``-word shingles have a Jaccard similarity of ``least`` (0.8 and more) are linked.

    Candidates share a cell and differ in few bits; each group of candidates is then
    verified on its sets themselves, a large one in pairs of tiles. Equal sets are one
    point from the start. Texts without words are linked to nothing but their equals.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    wide = ", ".join(f"{f} long" for f in FPS)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column("text"):
                hashes = shingle_set(value.as_py(), shingle)
                fp, extreme = wide_sketch(hashes)
                out.append((xxhash.xxh3_64_intdigest(hashes.tobytes()), len(hashes), *fp[:KEPT_WORDS].tolist(), extreme.tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * (3 + KEPT_WORDS)
            longs = [pa.array(np.array(c, np.uint64).astype(np.int64)) for c in columns[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, pa.array(columns[-1], pa.binary())], names=["doc_id", "key", "n", *FPS, "extreme"])

    rows = written(texts.mapInArrow(sketch, f"doc_id long, key long, n long, {wide}, extreme binary"), "similar-rows")
    total = rows.count()
    same = ["key", "n", *FPS]  # a set's digest, size and fingerprint
    points = written(rows.groupBy(*same, "extreme").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("held")), "similar-points")
    known = points.filter("v IS NOT NULL AND n > 0")
    picked = choices(known.count())

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            extreme = np.frombuffer(b"".join(batch.column("extreme").to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.uint64)
            cell = []
            for number, chosen in enumerate(picked):
                value = np.full(batch.num_rows, number, np.uint64)
                for segment in chosen:
                    value = value * np.uint64(2 * SEGMENT) + extreme[:, segment]
                cell.append(value)
            tiled = [pa.array(np.tile(np.asarray(batch.column(c)), len(picked))) for c in ("v", *FPS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell).astype(np.int64)), *tiled], names=["cell", "v", *FPS])

    laid = known.select("v", *FPS, "extreme").mapInArrow(lay_out, f"cell long, v long, {wide}")
    groups = components(linked_in_cells(laid, FPS, WIDE_RADIUS))

    # The sets themselves, of documents that have candidates.
    sizes = groups.join(known.select("v", "key", "n", *FPS), "v")
    parts = F.greatest(F.sum("n") / F.lit(TILE_SHINGLES), F.count(F.lit(1)) / F.lit(TILE // 2))
    total_of = sizes.groupBy("component").agg(F.ceil(parts).cast("int").alias("parts"))
    wanted = written(sizes.join(total_of, "component").select(F.col("v").alias("doc_id"), "key", "component", "parts", *FPS), "similar-wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_set(x.as_py(), shingle) for x in batch.column("text")]
            own = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in hashes], np.uint64).astype(np.int64)
            keep = pa.array(own == np.asarray(batch.column("key")))  # another text of that doc_id may be another point
            done = batch.drop_columns(["text"]).append_column("hashes", pa.array([x.astype(np.int64) for x in hashes], pa.list_(pa.int64())))
            yield done.filter(keep)

    held = texts.join(wanted, "doc_id").mapInArrow(sets, f"doc_id long, key long, component long, parts int, {wide}, hashes array<long>").dropDuplicates(["doc_id", "key"])
    dealt = in_pairs_of_tiles(held, F.col("parts"), F.xxhash64("doc_id", "key"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "key"])
        found = verified([np.asarray(x, np.int64).astype(np.uint64) for x in pdf["hashes"]], pdf[FPS].to_numpy().astype(np.uint64), pdf["own"].to_numpy(), least)
        a, b = stars(pdf["doc_id"].to_numpy(), np.array(found, np.int64).reshape(-1, 2))
        return pd.DataFrame({"a": a, "b": b})

    found = components(contracted(dealt.groupBy("component", "t1", "t2").applyInPandas(verify, "a long, b long")))
    names = points.join(found, "v", "left").select(*same, "held", F.coalesce("component", "v").alias("component_id"))
    return join_groups(rows.select("doc_id", *same), names, same, "held", total).select("doc_id", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
