"""SimHash fingerprints and their near-duplicate groups by a hierarchical index in Gray order.

A fingerprint has as many bits as its shingles' hashes; a bit is set where more than
half of the hashes, repeats included, have it.  Texts whose fingerprints differ in at
most ``distance`` bits are linked, and linked groups are closed under links.

The index works on distinct fingerprints.  Links of at most ``distance`` differing
bits leave one of ``distance + 1`` blocks of bits alike, so the fingerprints are turned
until each block has led once.  Every turned order is sorted by Gray rank: neighbours
in it differ in few bits, and those that agree in the leading block, a root, are
neighbours in a row.  Over each root stands a tree.  A node holds the bits that all
below it share and that its parent doesn't hold already; a search adds up the bits in
which a fingerprint differs from the nodes on its way down and leaves a whole group as
soon as the sum passes ``distance``.

Spark cuts every order into even ranges, so a root with very many fingerprints spans
several.  Such roots become segments of at most ``SEGMENT`` fingerprints; pairs of
ranges, then of segments, are dropped by the bits that each shares before the rest of
the pairs meet.  A search emits the star of each group that it finds linked, not its
pairs; components are closed by Spark joins.

Defined cases: null and empty texts, and those of white space, have fingerprint zero,
which is linked like any other.  A text with fewer words than a shingle is hashed
whole.  Rows with a null id take part and get the component's least id that isn't
null (null, if there is none); repeated rows and ids come back as often as they came.
An empty table gives an empty one.  Columns other than id and text are ignored.
A text is read in pieces of about 1 MB; memory follows one text, not an Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import connected_components
from .session import Scratch, shuffle_partitions

SEED = 42
#: Children of a node.
FAN = 8
#: Fingerprints of a segment of a root that more than one task holds.
SEGMENT = 1024
#: Fingerprints that a task looks at together, and pairs of a fingerprint and a node.
BLOCK, FRONTIER = 1 << 17, 1 << 19
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
U64 = np.uint64
_ALL = U64(0xFFFFFFFFFFFFFFFF)


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of about a megabyte at a time, A-Z lowered."""
    at = 0
    while at < len(data):
        space = _SPACE.search(data, at + _PIECE)
        to = space.start() if space else len(data)
        yield data[at:to].lower().split()
        at = to


def _add_hashes(words: list[bytes], width: int, bits: np.ndarray) -> int:
    """Adds the bits of every shingle of ``width`` words to ``bits``; returns the number of shingles."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    for at in range(0, n, 1 << 15):
        to = min(n, at + (1 << 15))
        spans = map(slice, starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), U64, to - at)
        bits += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return n


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit fingerprint of one whole text (UTF-8)."""
    bits, shingles, last = np.zeros(64, np.int64), 0, []
    for words in _pieces(text):
        words = last + words
        if len(words) >= width:
            shingles += _add_hashes(words, width, bits)
        last = words[len(words) - min(width - 1, len(words)) :]
    if not shingles and last:
        shingles = _add_hashes(last, len(last), bits)
    return int(np.packbits(2 * bits > shingles, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) of every row: a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((fingerprint(texts[i].as_py() or b"", width) for i in range(len(texts))), U64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("fingerprint", LongType())]))


class GrayTrees:
    """Trees over fingerprints in Gray order, one for each root.

    ``starts`` are the places where roots begin.  ``levels[0]`` are the fingerprints;
    a node of a later level has up to ``FAN`` children of the level before.
    """

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        self.values = values
        ones, zeros = values, ~values
        tree_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
        first, last = np.arange(len(values)), np.arange(len(values))
        self.levels = [{"pattern": values, "mask": np.full(len(values), _ALL), "last": last}]
        while len(tree_of) > len(starts):
            begin = np.searchsorted(tree_of, np.arange(len(starts)))
            place = np.arange(len(tree_of)) - begin[tree_of]
            heads = np.flatnonzero(place % FAN == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, heads), np.bitwise_and.reduceat(zeros, heads)
            tails = np.append(heads[1:], len(tree_of))
            below = self.levels[-1]
            mask = ones | zeros
            self.levels.append({"pattern": ones, "mask": mask, "last": below["last"][tails - 1], "child": heads, "children": tails - heads})
            below["mask"] = below["mask"] & ~np.repeat(mask, tails - heads)
            tree_of = tree_of[heads]

    def _differing(self, level: int, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        at = self.levels[level]
        return np.bitwise_count((q ^ at["pattern"][node]) & at["mask"][node])

    def pairs(self, queries: np.ndarray, tree: np.ndarray, distance: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, place) of all fingerprints within ``distance``, some at a time.

        ``tree`` is the root to search for each query.  With ``own`` the queries are the
        fingerprints themselves, and only places after the query's own are looked for.
        """
        top = len(self.levels) - 1
        n = np.arange(len(queries))
        stack = [(top, n, tree, self._differing(top, queries, tree).astype(np.int64))]
        while stack:
            level, q, node, sum_ = stack.pop()
            keep = sum_ <= distance
            if own:
                keep &= self.levels[level]["last"][node] > q
            q, node, sum_ = q[keep], node[keep], sum_[keep]
            if not len(q):
                continue
            if not level:
                yield q, node
                continue
            most = FRONTIER // FAN
            if len(q) > most:
                stack.append((level, q[most:], node[most:], sum_[most:]))
                q, node, sum_ = q[:most], node[:most], sum_[:most]
            count = self.levels[level]["children"][node]
            parent = np.repeat(np.arange(len(count)), count)
            child = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count) + self.levels[level]["child"][node][parent]
            asked = q[parent]
            stack.append((level - 1, asked, child, sum_[parent] + self._differing(level - 1, queries[asked], child)))


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each place's least linked place so far) after the links (a, b)."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


def _stars(values: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(values[moved].view(np.int64)), pa.array(values[label[moved]].view(np.int64))], ["a", "b"])


def links_within(values: np.ndarray, starts: np.ndarray, distance: int) -> pa.RecordBatch:
    """Stars (a, b) of the fingerprints of the same root that are linked."""
    trees, label = GrayTrees(values, starts), np.arange(len(values))
    tree = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    for q, place in trees.pairs(values, tree, distance, own=True):
        label = _united(label, q, place)
    return _stars(values, label)


def links_between(a: np.ndarray, b: np.ndarray, distance: int) -> pa.RecordBatch:
    """Stars over two segments; only links between them are looked for."""
    trees, label = GrayTrees(b, np.zeros(1, np.int64)), np.arange(len(a) + len(b))
    for q, place in trees.pairs(a, np.zeros(len(a), np.int64), distance, own=False):
        label = _united(label, q, place + len(a))
    return _stars(np.concatenate([a, b]), label)


def _blocks(distance: int) -> list[tuple[int, int]]:
    """(first bit from the left, bits) of the ``distance + 1`` blocks."""
    cuts = [64 * k // (distance + 1) for k in range(distance + 2)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _turned(prints: DataFrame, distance: int) -> DataFrame:
    """(turn, rank, fingerprint): every fingerprint in every turned order; ``rank`` sorts as an unsigned Gray rank."""
    x = F.col("fingerprint")
    turns = [F.struct(F.lit(t).alias("turn"), F.shiftleft(x, lo).bitwiseOR(F.shiftrightunsigned(x, 64 - lo) if lo else F.lit(0).cast("long")).alias("rank")) for t, (lo, _) in enumerate(_blocks(distance))]
    rows = prints.select("fingerprint", F.explode(F.array(*turns)).alias("t")).select("t.turn", "t.rank", "fingerprint")
    for shift in (1, 2, 4, 8, 16, 32):
        rows = rows.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", shift)))
    return rows.withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))


_SEGMENTS = "a long, b long, turn int, root long, range int, number int, ones long, zeros long, members array<long>"


def _segment_batch(turn: int, root: int, number: int, values: np.ndarray) -> pa.RecordBatch:
    cuts = range(0, len(values), SEGMENT)
    parts = [values[i : i + SEGMENT] for i in cuts]
    ones = np.array([np.bitwise_and.reduce(p) for p in parts], U64)
    zeros = np.array([np.bitwise_and.reduce(~p) for p in parts], U64)
    n, here = len(parts), TaskContext.get().partitionId()
    columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([turn] * n, pa.int32()), pa.array([root] * n, pa.int64()), pa.array([here] * n, pa.int32())]
    columns += [pa.array(range(number, number + n), pa.int32()), pa.array(ones.view(np.int64)), pa.array(zeros.view(np.int64)), pa.array([p.view(np.int64) for p in parts], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SEGMENTS.split(", ")])


def _with_segments(links: pa.RecordBatch) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([*links.columns, *(pa.nulls(links.num_rows, k) for k in kinds)], [c.split()[0] for c in _SEGMENTS.split(", ")])


def _search_ranges(distance: int):
    """The task over one range of the orders: stars of the roots that it holds whole, segments of the others."""
    widths = [w for _, w in _blocks(distance)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, number = [], 0, 0
        open_root = None  # the root that began in an earlier range or block

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, size, number, open_root
            turn, rank, value = (np.concatenate([k[i] for k in kept]) for i in range(3))
            rank = rank.view(U64) ^ U64(1 << 63)
            root = (rank >> (U64(64) - np.array(widths, U64)[turn])).view(np.int64)
            change = np.flatnonzero((turn[1:] != turn[:-1]) | (root[1:] != root[:-1])) + 1
            starts = np.concatenate([[0], change])
            ends = np.append(change, len(turn))
            held = 0 if final or len(turn) >= 2 * BLOCK else len(turn) - starts[-1]
            keys = list(zip(turn[starts[[0, -1]]].tolist(), root[starts[[0, -1]]].tolist()))
            border = np.zeros(len(starts), bool)
            border[0] = open_root is None or keys[0] == open_root
            border[-1] = True
            if held:
                starts, ends, border = starts[:-1], ends[:-1], border[:-1]
            for at in np.flatnonzero(border).tolist():
                key = (int(turn[starts[at]]), int(root[starts[at]]))
                found = _segment_batch(*key, number, value[starts[at] : ends[at]])
                number += found.num_rows
                yield found
            closed = np.flatnonzero(~border & (ends - starts > 1))
            if len(closed):
                count = (ends - starts)[closed]
                first = np.cumsum(count) - count
                take = np.arange(count.sum()) - np.repeat(first, count) + np.repeat(starts[closed], count)
                links = links_within(value[take], first, distance)
                if links.num_rows:
                    yield _with_segments(links)
            if len(starts):
                open_root = keys[-1] if not held else (-1, -1)
            kept = [tuple(column[len(turn) - held :] for column in (turn, (rank ^ U64(1 << 63)).view(np.int64), value))] if held else []
            size = held

        for batch in batches:
            turn, rank, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            kept.append((turn, rank, value.view(U64)))
            size += len(turn)
            if size >= BLOCK:
                yield from flush(False)
        if size:
            yield from flush(True)

    return run


def _apart(a: str, b: str):
    """Bits in which all below the one node differ from all below the other."""
    return F.bit_count(F.col(f"{a}.ones").bitwiseAND(F.col(f"{b}.zeros"))) + F.bit_count(F.col(f"{a}.zeros").bitwiseAND(F.col(f"{b}.ones")))


def _search_pairs(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(k)[i].values.to_numpy().view(U64) for k in (1, 2))
                links = links_within(a, np.zeros(1, np.int64), distance) if batch.column(0)[i].as_py() else links_between(a, b, distance)
                if links.num_rows:
                    yield links

    return run


def gray_links(scratch: Scratch, prints: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b) over distinct fingerprints (``fingerprint`` long): closed under links, the pairs at most ``distance`` bits apart.

    Stars stand for the links of a group, so that a dense group gives as many rows as it has members.
    """
    order = _turned(prints, distance).repartitionByRange(shuffle_partitions(scratch.spark), "turn", "rank").sortWithinPartitions("turn", "rank")
    found = scratch.settle(order.select("turn", "rank", "fingerprint").mapInArrow(_search_ranges(distance), _SEGMENTS))
    segments = found.filter("a IS NULL").drop("a", "b")
    # Upper nodes: what a range holds of a root; then its segments.
    uppers = segments.groupBy("turn", "root", "range").agg(F.bit_and("ones").alias("ones"), F.bit_and("zeros").alias("zeros"))
    near = uppers.alias("x").join(uppers.alias("y"), (F.col("x.turn") == F.col("y.turn")) & (F.col("x.root") == F.col("y.root")) & (F.col("x.range") <= F.col("y.range")) & (_apart("x", "y") <= distance))
    near = near.select("x.turn", "x.root", F.col("x.range").alias("rx"), F.col("y.range").alias("ry"))
    nodes = segments.drop("members")
    pairs = near.join(nodes.withColumnRenamed("range", "rx").withColumnRenamed("number", "nx").withColumnsRenamed({"ones": "ox", "zeros": "zx"}), ["turn", "root", "rx"])
    other = nodes.withColumnRenamed("range", "ry").withColumnRenamed("number", "ny").withColumnsRenamed({"ones": "oy", "zeros": "zy"})
    apart = F.bit_count(F.col("ox").bitwiseAND(F.col("zy"))) + F.bit_count(F.col("zx").bitwiseAND(F.col("oy")))
    pairs = pairs.join(other, ["turn", "root", "ry"]).filter((apart <= distance) & ((F.col("rx") < F.col("ry")) | (F.col("nx") <= F.col("ny"))))
    pairs = pairs.select("rx", "nx", "ry", "ny")
    one = segments.select(F.col("range").alias("rx"), F.col("number").alias("nx"), F.col("members").alias("mx"))
    two = segments.select(F.col("range").alias("ry"), F.col("number").alias("ny"), F.col("members").alias("my"))
    met = pairs.join(one, ["rx", "nx"]).join(two, ["ry", "ny"])
    met = met.select(((F.col("rx") == F.col("ry")) & (F.col("nx") == F.col("ny"))).alias("same"), "mx", "my")
    return found.filter("a IS NOT NULL").select("a", "b").unionByName(met.mapInArrow(_search_pairs(distance), "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; ``fingerprint`` as 16 hexadecimal digits."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.settle(fingerprints(docs, doc_id, text, width))
    prints = scratch.settle(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    labels = connected_components(scratch, gray_links(scratch, prints.select("fingerprint"), distance)).withColumnRenamed("node", "fingerprint")
    moved = prints.join(labels, "fingerprint")
    groups = moved.groupBy("label").agg(F.min("least").alias("component_id"))
    moved = moved.join(groups, "label").select("fingerprint", F.struct("component_id").alias("to"))
    prints = prints.join(moved, "fingerprint", "left").select("fingerprint", F.when(F.col("to").isNull(), F.col("least")).otherwise(F.col("to.component_id")).alias("component_id"))
    # Settled, so that the last join stands alone and Spark can split the rows of a fingerprint that very many have.
    out = rows.join(scratch.settle(prints), "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
