"""Density clusters of each topic from its Euclidean minimum spanning forest.

With one neighbour for a core point (what the clusters here ask for) the mutual
reachability of two points is their distance, so the forest holds all that density
clusters need: its edges up to a radius join what that radius joins, and the order in
which its edges fall makes the hierarchy that adaptive clusters are cut from.

The forest is made without comparing all points.  Equal points count once.  The others
are sorted along a space-filling order by Spark, in even ranges, and cut into chunks of
at most ``CHUNK`` near points.  The forest lies in the union of the forests of chunks
taken two by two; and two chunks need not be taken together where a chain of chunks
joins them by shorter steps than the gap between their boxes, as the longest edge of a
cycle is in no forest.  So a dense place costs its chunks and their neighbours, not the
square of its points.

What one task holds: two chunks; a topic's chunks as boxes; a topic's candidate edges,
three numbers each (a few a paper).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import settled, shuffle_partitions

#: Points of a chunk.
CHUNK = 128
#: Bits of a dimension in the space-filling order.
_BITS = 10
#: The shortest distance that counts as one: densities stay finite.
_LEAST = 1e-12


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all points of ``a`` to all of ``b``, from their differences (no cancellation)."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += (a[:, d, None] - b[None, :, d]) ** 2
    return out


def spanning_tree(points: np.ndarray, names: np.ndarray) -> list[tuple[float, int, int]]:
    """(distance, least name, greatest name) of the edges of the points' minimum spanning tree, by Prim."""
    n = len(points)
    if n < 2:
        return []
    far = _squared(points, points)
    best, towards, at = np.full(n, np.inf), np.zeros(n, np.int64), 0
    out = []
    for _ in range(n - 1):
        far[:, at] = np.inf  # taken points are no one's goal
        best[at] = np.inf
        row = far[at]
        towards[row < best] = at
        np.minimum(best, row, out=best)
        at = int(best.argmin())
        out.append((best[at], at, towards[at]))
    a, b = (names[[e[k] for e in out]] for k in (1, 2))
    return list(zip(np.sqrt([e[0] for e in out]).tolist(), np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))


def _cut(points: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """``rows`` cut at medians of their widest dimension into pieces of at most ``CHUNK``."""
    stack = [rows]
    while stack:
        some = stack.pop()
        if len(some) <= CHUNK:
            yield some
            continue
        widest = np.ptp(points[some], axis=0).argmax()
        order = some[np.argsort(points[some, widest], kind="stable")]
        stack += [order[: len(order) // 2], order[len(order) // 2 :]]


_CHUNKS = "topic_id string, chunk long, names array<long>, flat array<double>, low array<double>, high array<double>, longest double, edges array<struct<d: double, a: long, b: long>>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the topics of one sorted range, with their own trees."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    topics = table.column("topic_id").to_numpy(zero_copy_only=False)
    names = table.column("node").to_numpy()
    dims = len(table.column("coordinates")[0])
    points = table.column("coordinates").combine_chunks().flatten().to_numpy().reshape(-1, dims)
    first = np.flatnonzero(np.append(True, topics[1:] != topics[:-1]))
    number = TaskContext.get().partitionId() << 32
    for lo, hi in zip(first, np.append(first[1:], len(topics))):
        found = []
        for rows in _cut(points, np.arange(lo, hi)):
            own, at = points[rows], names[rows]
            edges = spanning_tree(own, at)
            found.append((topics[lo], number, at.tolist(), own.ravel().tolist(), own.min(axis=0).tolist(), own.max(axis=0).tolist(), max((e[0] for e in edges), default=0.0), [{"d": d, "a": a, "b": b} for d, a, b in edges]))
            number += 1
        columns = list(zip(*found))
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3, pa.float64(), pa.list_(pa.struct([("d", pa.float64()), ("a", pa.int64()), ("b", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["topic_id", "chunk", "names", "flat", "low", "high", "longest", "edges"])


def _near_pairs(chunks: pd.DataFrame) -> pd.DataFrame:
    """(chunk, other): the chunks of a topic whose forests may share an edge.

    A tree over the chunks, by the distance of one point of each and their own longest
    edges, bounds the longest step between any two; in the order in which the tree's
    edges merge, that bound is the largest height between their places.
    """
    n = len(chunks)
    at = chunks["chunk"].to_numpy()
    low, high, one = (np.array(chunks[c].tolist()) for c in ("low", "high", "one"))
    longest = chunks["longest"].to_numpy()
    step, towards, inside = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    edges, i = [], 0
    for _ in range(n - 1):
        inside[i] = True
        d = np.maximum(np.sqrt(((one - one[i]) ** 2).sum(axis=1)), np.maximum(longest, longest[i]))
        nearer = d < step
        step, towards = np.where(nearer, d, step), np.where(nearer, i, towards)
        i = int(np.where(inside, np.inf, step).argmin())
        edges.append((step[i], i, towards[i]))
    # The runs that merge, in the order of the edges; each run is its places in a row and the heights between them.
    run_of, runs = np.arange(n), [([k], []) for k in range(n)]
    for d, a, b in sorted(edges, key=lambda e: e[0]):
        a, b = run_of[a], run_of[b]
        if len(runs[a][0]) < len(runs[b][0]):
            a, b = b, a
        run_of[runs[b][0]] = a
        runs[a][1].extend([d, *runs[b][1]])
        runs[a][0].extend(runs[b][0])
        runs[b] = ([], [])
    order, heights = runs[run_of[0]]
    order, heights = np.array(order), np.array(heights)
    low, high, at = low[order], high[order], at[order]
    found = []
    for k in range(n - 1):
        bound = np.maximum.accumulate(heights[k:])
        gap = np.maximum(0, np.maximum(low[k + 1 :] - high[k], low[k] - high[k + 1 :]))
        near = np.flatnonzero(np.sqrt((gap**2).sum(axis=1)) <= bound * (1 + 1e-9))
        found.append((np.full(len(near), at[k]), at[k + 1 + near]))
    chunk, other = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(2))
    return pd.DataFrame({"chunk": chunk, "other": other})


def _crossing(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics, out = [], []
            for i in range(batch.num_rows):
                names, flat, others, others_flat = (batch.column(k)[i].values.to_numpy() for k in range(1, 5))
                own = set(names.tolist())
                found = spanning_tree(np.concatenate([flat, others_flat]).reshape(-1, dims), np.concatenate([names, others]))
                found = [e for e in found if (e[1] in own) != (e[2] in own)]
                topics += [batch.column(0)[i].as_py()] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(topics, pa.string()), *(pa.array([e[k] for e in out], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64())))], ["topic_id", "d", "a", "b"])

    return run


def _place_in_order(coordinate: Column, q: Column) -> Column:
    """A coordinate as ``_BITS`` bits, by the quartiles of its topic, so that far points don't crush the others together."""
    spread = F.greatest(q[2] - q[0], F.lit(_LEAST))
    return F.floor((F.atan((coordinate - q[1]) / spread) / F.pi() + 0.5) * ((1 << _BITS) - 1)).cast("long")


def candidate_edges(points: DataFrame, dims: int) -> DataFrame:
    """(topic_id, d, a, b), a < b: edges among which the minimum spanning tree of each topic is, and not many more.

    points (topic_id, node long, coordinates array<double> of ``dims``), each place of a topic once.
    """
    spread = points.groupBy("topic_id").agg(*[F.percentile_approx(F.col("coordinates")[d], [0.25, 0.5, 0.75], 1000).alias(f"q{d}") for d in range(dims)])
    rows = points.join(spread, "topic_id")
    bits = [F.shiftleft(F.shiftright(_place_in_order(F.col("coordinates")[d], F.col(f"q{d}")), bit).bitwiseAND(F.lit(1)), bit * dims + d) for d in range(dims) for bit in range(_BITS) if bit * dims + d < 62]
    key = bits[0]
    for b in bits[1:]:
        key = key.bitwiseOR(b)
    rows = rows.select("topic_id", "node", "coordinates", key.alias("key")).repartitionByRange(shuffle_partitions(points.sparkSession), "topic_id", "key", "node").sortWithinPartitions("topic_id", "key", "node")
    chunks = settled(rows.mapInArrow(_chunks, _CHUNKS))
    own = chunks.select("topic_id", F.inline("edges"))
    boxes = chunks.select("topic_id", "chunk", "low", "high", "longest", F.slice("flat", 1, dims).alias("one"))
    near = boxes.groupBy("topic_id").applyInPandas(_near_pairs, "chunk long, other long")
    sides = chunks.select("topic_id", "chunk", "names", "flat")
    met = near.join(sides, "chunk").join(sides.drop("topic_id").withColumnsRenamed({"chunk": "other", "names": "others", "flat": "others_flat"}), "other")
    return own.unionByName(met.select("topic_id", "names", "flat", "others", "others_flat").mapInArrow(_crossing(dims), "topic_id string, d double, a long, b long"))


def _kruskal(edges: pd.DataFrame) -> list[tuple[float, int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for d, a, b in edges.sort_values(["d", "a", "b"])[["d", "a", "b"]].itertuples(index=False):
        x, y = root(a), root(b)
        if x != y:
            parent[y] = x
            out.append((d, a, b))
    return out


def stable_clusters(tree: list[tuple[float, int, int]], size: dict[int, int], least: int) -> dict[int, int]:
    """{node: least node of its cluster} from a topic's spanning tree (edges in order); nodes of no cluster are left out.

    ``size`` counts the points of a node.  The hierarchy of the tree is cut into clusters of at least ``least``
    points: a cluster lives while its rest has so many, and splits where both sides do.  Of a cluster and
    those that it splits into, the more stable are taken: stability sums how much longer (in density) points
    stay than the cluster is old.  The whole topic is no cluster.
    """
    nodes = list(size)
    index = {v: i for i, v in enumerate(nodes)}
    n = len(nodes)
    children: list[tuple[int, int] | None] = [None] * n
    weight, height = [size[v] for v in nodes], [0.0] * n
    top = list(range(n))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for d, a, b in tree:
        x, y = root(index[a]), root(index[b])
        top += [len(top)]
        top[x] = top[y] = len(top) - 1
        children.append((x, y))
        weight.append(weight[x] + weight[y])
        height.append(d)
    whole = len(children) - 1
    density = lambda d: 1.0 / max(d, _LEAST)
    # Clusters: (birth, parent); each dendrogram node of enough points is walked down once.
    birth, parent, stability, kids, start = [0.0], [-1], [0.0], [[]], [whole]
    stack = [(whole, 0)] if children[whole] is not None else []
    while stack:
        node, cluster = stack.pop()
        pair = children[node]
        if pair is None:  # equal points only: they stay as long as densities go
            stability[cluster] += weight[node] * (density(0.0) - birth[cluster])
            continue
        at = density(height[node])
        big = [c for c in pair if weight[c] >= least]
        if len(big) == 2:
            for c in big:
                stability[cluster] += weight[c] * (at - birth[cluster])
                birth.append(at)
                parent.append(cluster)
                stability.append(0.0)
                kids.append([])
                start.append(c)
                kids[cluster].append(len(birth) - 1)
                stack.append((c, len(birth) - 1))
            continue
        for c in pair:
            if c in big:
                stack.append((c, cluster))
            else:
                stability[cluster] += weight[c] * (at - birth[cluster])
    chosen = [False] * len(birth)
    best = list(stability)
    for c in range(len(birth) - 1, 0, -1):
        below = sum(best[k] for k in kids[c])
        if kids[c] and below > stability[c]:
            best[c] = below
        else:
            chosen[c] = True
    out: dict[int, int] = {}
    walk = list(kids[0])
    while walk:
        c = walk.pop()
        if not chosen[c]:
            walk += kids[c]
            continue
        members, down = [], [start[c]]
        while down:
            node = down.pop()
            pair = children[node]
            if pair is None:
                members.append(nodes[node])
            else:
                down += pair
        out.update(dict.fromkeys(members, min(members)))
    return out


def _placed(points: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """(rows (topic_id, item, node), places (topic_id, node, coordinates, n)): items by their place; of a topic's equal coordinates one node stands for all."""
    rows = points.filter(F.col("coordinates").isNotNull()).select("topic_id", item, F.transform("coordinates", lambda x: x.cast("double") + F.lit(0.0)).alias("coordinates"))
    places = rows.groupBy("topic_id", "coordinates").agg(F.count("*").alias("n"))
    places = settled(places.select(F.monotonically_increasing_id().alias("node"), "topic_id", "coordinates", "n"))
    return rows.join(places.drop("n"), ["topic_id", "coordinates"]).select("topic_id", item, "node"), places


def _numbered(rows: DataFrame, item: str) -> DataFrame:
    """Clusters of (topic_id, item, label) from 0 by their least item; no label is -1; a topic without any cluster is one."""
    least = rows.filter("label IS NOT NULL").groupBy("topic_id", "label").agg(F.min(item).alias("first"))
    lists = least.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("first", "label"))).alias("order"))  # at most a topic's clusters
    number = lists.select("topic_id", F.posexplode(F.col("order.label")).alias("cluster", "label"))
    out = rows.join(number, ["topic_id", "label"], "left").join(lists.select("topic_id", F.lit(True).alias("any")), "topic_id", "left")
    return out.select("topic_id", item, F.when(F.col("any").isNull(), 0).otherwise(F.coalesce("cluster", F.lit(-1))).alias("cluster"))


def adaptive_clusters(points: DataFrame, dims: int, item: str = "item", share: float = 0.1, fewest: int = 3) -> DataFrame:
    """(topic_id, item, cluster) of points (topic_id string, item, coordinates): density clusters whose radius follows the data.

    A cluster has at least max(``fewest``, ``share`` of its topic's points), but never more than all.  Points of no
    cluster have -1; a topic in which none is found, or of one point, is cluster 0.  Null coordinates take no part.
    """
    rows, places = _placed(points, item)
    edges = candidate_edges(places.drop("n"), dims)

    def cut(topic: pd.DataFrame) -> pd.DataFrame:
        size = topic[topic["n"] > 0].set_index("a")["n"].to_dict()
        n = sum(size.values())
        found = stable_clusters(_kruskal(topic[topic["n"] == 0]), size, max(2, min(n, max(fewest, int(n * share)))))
        return pd.DataFrame({"node": list(found), "label": list(found.values())}, dtype="int64")

    both = edges.withColumn("n", F.lit(0).cast("long")).unionByName(places.select("topic_id", F.lit(0.0).alias("d"), F.col("node").alias("a"), F.col("node").alias("b"), "n"))
    labels = both.groupBy("topic_id").applyInPandas(cut, "node long, label long")
    return _numbered(rows.join(labels, "node", "left"), item)


def radius_clusters(points: DataFrame, dims: int, eps: float, least: int = 2, item: str = "item") -> DataFrame:
    """(topic_id, item, cluster): what steps of at most ``eps`` join, in groups of at least ``least`` points.

    Points of smaller groups have -1; a topic without any group is cluster 0.  With ``least`` 2 these are the
    density clusters of two neighbours.
    """
    from .clusters import components

    rows, places = _placed(points, item)
    links = candidate_edges(places.drop("n"), dims).filter(F.col("d") <= eps)
    labels = components(links.select("topic_id", "a", "b"), ["topic_id"]).drop("topic_id")
    rows = rows.join(labels, "node", "left").select("topic_id", item, F.coalesce("label", "node").alias("label"))
    sizes = rows.groupBy("topic_id", "label").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return _numbered(rows.join(sizes.select("topic_id", "label", F.lit(True).alias("kept")), ["topic_id", "label"], "left").withColumn("label", F.when(F.col("kept"), F.col("label"))).drop("kept"), item)
