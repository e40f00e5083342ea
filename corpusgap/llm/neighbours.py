"""Approximate nearest neighbours by largest inner product, over shifted Hilbert curves.

Vectors are lifted to one sphere (a further coordinate takes up what a vector lacks
to the greatest length), so the largest inner product is the least distance.  Each
of several orderings projects them by its own rotation to a few dimensions, shifts, and
takes their place on a Hilbert curve.  Spark range-partitions an ordering by key (and by
a hash of the id where keys are equal) into blocks; a query visits the blocks of the
window around its own key, every visited block gives its best, and the windows of all
orderings are merged and ranked by the exact inner product.

How many orderings (two or four) and how wide a window: measured on a bounded sample
against brute force, the cheapest choice that reaches ``TARGET``.  Where vectors
cluster, windows are narrow; on vectors without structure only wide ones reach it.
Equal vectors are one entry with its least ids.

Defined cases: vectors null, zero, with null or non-finite parts, or of another than
the table's commonest size take no part, be they candidates or queries; repeated rows of
one id and vector count once; ties go to the lesser id; fewer candidates than asked give
all; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import Scratch

DIMS, DEPTH = 6, 10
ORDERINGS = (2, 4)
SHARES = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9)
TARGET = 0.97
#: The bound of the sample that windows are measured on, and of its queries.
SAMPLE, SAMPLE_QUERIES = 8192, 256
#: Vectors of a block; an ordering has at least so many blocks and at most so many (then blocks are larger, and split by id).
BLOCK, QUERY_BLOCK = 4096, 4096
LEAST_BLOCKS, MOST_BLOCKS = 32, 8192


def hilbert_keys(cells: np.ndarray, depth: int) -> np.ndarray:
    """Places of integer cells (rows of coordinates below 2**depth) on a Hilbert curve.

    The Gray-code transform works on all rows at once, one bit plane after another.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(depth - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(depth - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(depth - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


@dataclass
class Curves:
    """The orderings: a rotation to DIMS dimensions, a centre, a scale and a shift each."""

    longest: float
    rotations: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shifts: np.ndarray

    def lift(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        if query:
            return np.hstack([vectors * (self.longest / length), np.zeros_like(length)])
        return np.hstack([vectors, np.sqrt(np.maximum(self.longest**2 - length**2, 0))])

    def keys(self, vectors: np.ndarray, query: bool, ordering: int) -> np.ndarray:
        flat = self.lift(vectors, query) @ self.rotations[ordering]
        part = (flat - self.low[ordering]) / np.maximum(self.high[ordering] - self.low[ordering], 1e-12)
        # The shift moves the grid by up to a third of the whole, inside a grid half as large again.
        cells = np.clip((part + self.shifts[ordering]) / 1.5, 0, 1 - 1e-9) * (1 << DEPTH)
        return hilbert_keys(cells.astype(np.int64), DEPTH)


def fit_curves(sample: np.ndarray, longest: float, seed: int = 11) -> Curves:
    rng = np.random.default_rng(seed)
    size = sample.shape[1] + 1
    dims = min(DIMS, size)
    rotations = np.array([np.linalg.qr(rng.standard_normal((size, dims)))[0] for _ in range(max(ORDERINGS))])
    curves = Curves(longest, rotations, np.zeros((len(rotations), dims)), np.ones((len(rotations), dims)), rng.uniform(0, 0.5, (len(rotations), dims)))
    lifted = curves.lift(sample, False)
    for o, rotation in enumerate(rotations):
        flat = lifted @ rotation
        curves.low[o], curves.high[o] = np.quantile(flat, 0.005, axis=0), np.quantile(flat, 0.995, axis=0)
    return curves


def choose_windows(curves: Curves, sample: np.ndarray, k: int) -> tuple[int, float, float]:
    """(orderings, share of an ordering that a window covers, recall on the sample) of the cheapest choice."""
    queries = np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    products = sample[queries] @ sample.T
    products[np.arange(len(queries)), queries] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return ORDERINGS[-1], SHARES[-1], 1.0
    truth = np.argpartition(-products, k - 1, axis=1)[:, :k]
    at, place = np.empty((len(curves.rotations), len(queries), 1)), np.empty((len(curves.rotations), len(queries), k))
    for o in range(len(curves.rotations)):
        keys = np.sort(curves.keys(sample, False, o))
        place[o] = (np.searchsorted(keys, curves.keys(sample, False, o)) / len(sample))[truth]
        at[o] = (np.searchsorted(keys, curves.keys(sample[queries], True, o)) / len(sample))[:, None]
    best = (ORDERINGS[-1], SHARES[-1], 0.0)
    for _, r, s in sorted((r * s, r, s) for r in ORDERINGS for s in SHARES):
        start = np.clip(at - s / 2, 0, 1 - s)
        recall = float(((place >= start) & (place <= start + s))[:r].any(axis=0).mean())
        if recall >= TARGET:
            return r, s, recall
        best = max(best, (r, s, recall), key=lambda x: x[2])
    return best


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def valid_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows without null, zero or non-finite vectors; floats stay floats."""
    kind = "float" if df.select(vector).schema[0].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vector")).filter("vec_id IS NOT NULL AND size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def _keyed(rows: DataFrame, curves, orderings: int, query: bool) -> DataFrame:
    """Each vector once an ordering, with its key."""
    kind = rows.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1))
            for o in range(orderings):
                keys = curves.value.keys(vectors, query, o)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), o, np.int32)), pa.array(keys), batch.column(0), batch.column(1)], ["ordering", "key", "id", "vector"])

    return rows.mapInArrow(run, f"ordering int, key long, id long, vector {kind}")


def _windows(asked: DataFrame, ends: list[np.ndarray], share: float) -> DataFrame:
    """Each keyed query once for every block of the window around its key; windows keep their width at a curve's ends."""
    kind = asked.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordering, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for o, end in enumerate(ends):
                mine = np.flatnonzero(ordering == o)
                if not len(mine):
                    continue
                width = min(len(end), int(np.ceil(share * len(end))) + 1)
                home = np.minimum(np.searchsorted(end, key[mine]), len(end) - 1)
                start = np.clip(home - width // 2, 0, len(end) - width)
                for step in range(width):
                    rows = batch.take(pa.array(mine))
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array((start + step).astype(np.int32)), rows.column(2), rows.column(3)], ["ordering", "block", "id", "vector"])

    return asked.mapInArrow(run, f"ordering int, block int, id long, vector {kind}")


def _best(k: int):
    """The k best candidates of each query in one block."""

    def run(key: tuple[pa.Scalar, ...], candidates: pa.Table, queries: pa.Table) -> pa.Table:
        names, lists = [], []
        if candidates.num_rows and queries.num_rows:
            vectors, ids = _matrix(candidates["vector"].combine_chunks()), candidates["id"].to_numpy()
            asked = _matrix(queries["vector"].combine_chunks())
            names = queries["id"].to_numpy()
            for a in range(0, len(names), 256):
                products = asked[a : a + 256] @ vectors.T
                top = np.argpartition(-products, k - 1, axis=1)[:, :k] if products.shape[1] > k else np.broadcast_to(np.arange(products.shape[1]), products.shape)
                for row, at in zip(products, top, strict=True):
                    # What ties with the last kept is kept too, so that the lesser id can win later.
                    at = at if products.shape[1] <= k else np.flatnonzero(row >= row[at].min())
                    lists.append([{"id": int(ids[i]), "score": float(row[i])} for i in at[np.lexsort((ids[at], -row[at]))][:k]])
        return pa.table({"query": pa.array(names, pa.int64()), "hits": pa.array(lists, pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())])))})

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", query_id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows of ``df`` other than its own id."""
    spark = df.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows, asked = valid_vectors(df, vec_id, vector), valid_vectors(queries, query_id, vector)
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = (x.filter(F.size("vector") == sizes[0]["size"]) for x in (rows, asked))
    # Equal vectors: one entry, by its least id; of its ids the k + 1 least decide every answer.
    within = Window.partitionBy("vector").orderBy("vec_id")
    least = rows.distinct().withColumn("place", F.row_number().over(within)).filter(F.col("place") <= k + 1)
    entries = scratch.settle(least.groupBy("vector").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, longest = entries.agg(F.count("*"), F.sqrt(F.max(squares))).first()
    sample = _matrix(entries.select("vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["vector"].combine_chunks())
    curves = fit_curves(sample, float(longest))
    orderings, share, _ = choose_windows(curves, sample, k)
    shared = spark.sparkContext.broadcast(curves)

    # Queries with equal vectors are asked once, under the entry's id.
    asked = scratch.settle(asked.join(entries.select("vector", "id"), "vector", "left").select(F.coalesce("id", -1 - F.col("vec_id")).alias("id"), F.col("vec_id").alias("query_id"), "vector"))
    once = asked.groupBy("id").agg(F.any_value("vector").alias("vector"))
    blocks = min(max(-(-total // BLOCK), LEAST_BLOCKS), MOST_BLOCKS) * orderings
    placed = _keyed(entries.select("id", "vector"), shared, orderings, False).repartitionByRange(blocks, "ordering", "key", F.xxhash64("id"))
    placed = scratch.settle(placed.withColumn("range", F.spark_partition_id()))
    # A range that holds the end of one ordering and the start of the next is a block of each.
    spans = placed.groupBy("ordering", "range").agg(F.max("key").alias("end"), F.count("*").alias("size")).orderBy("ordering", "range").collect()
    ends = [np.array([r["end"] for r in spans if r["ordering"] == o]) for o in range(orderings)]
    numbers, made = [], [0] * orderings
    for r in spans:
        numbers.append((r["ordering"], r["range"], made[r["ordering"]], -(-r["size"] // (2 * BLOCK))))
        made[r["ordering"]] += 1
    numbered = spark.createDataFrame(numbers, "ordering int, range int, block int, shards int")  # at most MOST_BLOCKS an ordering
    windows = scratch.settle(_windows(_keyed(once.select("id", "vector"), shared, orderings, True), ends, share))
    visits = windows.groupBy("ordering", "block").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    visits = scratch.settle(visits.join(numbered, ["ordering", "block"]))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    candidates = placed.join(visits, ["ordering", "range"]).withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int")).withColumn("part", upto("parts"))
    searching = windows.join(visits, ["ordering", "block"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("shard", upto("shards"))
    by = ["ordering", "block", "shard", "part"]
    candidates, searching = (x.select(*by, "id", "vector") for x in (candidates, searching))
    hits = candidates.groupBy(*by).cogroup(searching.groupBy(*by)).applyInArrow(_best(k + 1), "query long, hits array<struct<id: long, score: double>>")
    # Merge the windows: the best of all hits, each entry once.
    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    merged = hits.select("query", F.inline("hits")).groupBy("query", "id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    merged = scratch.settle(merged.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k + 1))
    scratch.drop(placed, windows, visits)
    named = merged.join(entries.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k + 1)
    lists = named.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", F.col("vec_id").alias("id"))), order).alias("hits"))
    found = asked.select("id", "query_id").join(lists, F.col("id") == F.col("query"))
    own = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    return found.select("query_id", F.posexplode(own).alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
