"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Scratch


def _directed(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, label) of every node that ``links`` (a long, b long) names; label: its component's least node.

    Every round is a few joins and minima over the link table, settled in the checkpoint
    folder; no component is ever gathered.  A node with very many links is split by the
    skew handling of the joins and by partial minima.  An empty table gives an empty one.
    """
    edges = scratch.settle(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = _directed(edges)
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: a node and its lesser neighbours all point to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b"))
        before, edges = edges, scratch.settle(small.filter("a <> b").distinct())
        scratch.drop(before)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def merged_labels(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after more ``links`` (label_a, label_b) between components; a node alone is its own label."""
    moved = connected_components(scratch, links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    moved = moved.withColumnRenamed("label", "to")
    old = labels.join(moved.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    added = moved.join(labels.select("node"), "node", "left_anti").select("node", F.col("to").alias("label"))
    return scratch.settle(old.unionByName(added))
