"""Density clusters against plain searches over all pairs."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from corpusgap.operators import density


def plain_tree(points):
    """Kruskal over all pairs; ties by the places of the points."""
    n = len(points)
    label = list(range(n))
    out = []
    for d, a, b in sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(points[a], points[b]))), a, b) for a in range(n) for b in range(a + 1, n)):
        if label[a] != label[b]:
            label = [label[a] if v == label[b] else v for v in label]
            out.append((d, a, b))
    return out


def pieces(nodes, edges):
    label = {v: v for v in nodes}
    for _, a, b in edges:
        x, y = label[a], label[b]
        label = {v: x if c == y else c for v, c in label.items()}
    groups = {}
    for v, c in label.items():
        groups.setdefault(c, set()).add(v)
    return list(groups.values())


def plain_adaptive(points, least):
    """The hierarchy from above: drop the longest edge, look at what falls apart; the more stable of a cluster and its parts."""
    tree = plain_tree(points)

    def live(nodes, edges, birth):
        """(stability, the best clusters inside: a list of (set, ...), their total)."""
        whole, stability = set(nodes), 0.0
        while True:
            if not edges:
                return whole, stability + len(nodes) * (1e12 - birth), []
            longest = max(edges)
            at = 1 / max(longest[0], 1e-12)
            edges = [e for e in edges if e != longest]
            parts = pieces(nodes, edges)
            big = [p for p in parts if len(p) >= least]
            stability += sum(len(p) * (at - birth) for p in parts if len(big) != 1 or p is not big[0])
            if len(big) == 2:
                return whole, stability, [live(p, [e for e in edges if e[1] in p], at) for p in big]
            if not big:
                return whole, stability, []
            nodes, edges = big[0], [e for e in edges if e[1] in big[0]]

    def best(cluster):
        whole, stability, parts = cluster
        inner = [best(p) for p in parts]
        below = sum(s for s, _ in inner)
        return (below, [c for _, found in inner for c in found]) if parts and below > stability else (stability, [whole])

    _, _, parts = live(set(range(len(points))), tree, 0.0)
    return [c for p in parts for c in best(p)[1]]


def named(groups, items):
    """{item: cluster}: clusters numbered by their least item, -1 outside, 0 where there is none."""
    out = dict.fromkeys(items, -1 if groups else 0)
    for k, g in enumerate(sorted(groups, key=lambda g: min(items[i] for i in g))):
        out.update({items[i]: k for i in g})
    return out


def blobs(n, dims, seed, repeated=0.2):
    rng = random.Random(seed)
    centres = [[rng.uniform(0, 10) for _ in range(dims)] for _ in range(4)]
    out = []
    for _ in range(n):
        if out and rng.random() < repeated:
            out.append(rng.choice(out))
        else:
            c = rng.choice(centres)
            out.append([rng.gauss(x, 0.4) for x in c] if rng.random() < 0.85 else [rng.uniform(-5, 60) for _ in range(dims)])
    return out


@pytest.fixture(scope="module")
def topics():
    made = {"a": blobs(90, 2, 1), "b": blobs(40, 2, 2, 0.0), "c": [[1.0, 2.0]], "d": [[3.0, 3.0]] * 12, "e": blobs(7, 2, 5), "f": [[float(i % 5), float(i // 5)] for i in range(25)], "g": [[0.0, 0.0], [5.0, 5.0]]}
    return {t: (p, [f"{t}{i:03d}" for i in range(len(p))]) for t, p in made.items()}


@pytest.fixture(scope="module")
def points(spark, topics):
    rows = [(t, i, x) for t, (p, items) in topics.items() for i, x in zip(items, p)] + [("a", "none", None)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "topic_id string, item string, coordinates array<double>").repartition(3)


@pytest.fixture(params=[128, 5])
def chunk(request, monkeypatch):
    run, size = density._chunks, request.param

    def small(batches):
        density.CHUNK = size
        yield from run(batches)

    monkeypatch.setattr(density, "_chunks", small)


def test_forest_is_among_the_candidates(spark, topics, points, chunk):
    """Kruskal over the candidates gives the lengths of the whole graph's forest."""
    _, places = density._placed(points, "item")
    found = {}
    for r in density.candidate_edges(places.drop("n"), 2).collect():
        found.setdefault(r["topic_id"], []).append(r)
    import pandas as pd

    for t, (p, _) in topics.items():
        want = [d for d, _, _ in plain_tree(list(map(list, {tuple(x) for x in p})))]
        edges = found.get(t, [])
        got = [d for d, _, _ in density._kruskal(pd.DataFrame([tuple(e)[1:] for e in edges], columns=["d", "a", "b"]))]
        assert got == pytest.approx(sorted(want))


def test_adaptive_clusters(spark, topics, points, chunk):
    found = density.adaptive_clusters(points, 2).collect()
    got = {r["item"]: r["cluster"] for r in found}
    assert len(got) == len(found)
    for t, (p, items) in topics.items():
        if t in ("f", "e"):  # ties: which of equal edges falls first is open
            continue
        want = named(plain_adaptive(p, max(2, min(len(p), max(3, len(p) // 10)))) if len(p) > 1 else [], items)
        assert {i: got[i] for i in items} == want
    assert density.adaptive_clusters(points.limit(0), 2).count() == 0


def test_radius_clusters(spark, topics, points, chunk):
    got = {r["item"]: r["cluster"] for r in density.radius_clusters(points, 2, 1.0).collect()}
    for t, (p, items) in topics.items():
        near = [(0, a, b) for a in range(len(p)) for b in range(a + 1, len(p)) if sum((x - y) ** 2 for x, y in zip(p[a], p[b])) <= 1.0]
        assert {i: got[i] for i in items} == named([g for g in pieces(range(len(p)), near) if len(g) > 1], items)


def test_five_dimensions(spark):
    p = blobs(120, 5, 9)
    rows = spark.createDataFrame([("t", i, x) for i, x in enumerate(p)], "topic_id string, item long, coordinates array<double>")
    got = {r["item"]: r["cluster"] for r in density.adaptive_clusters(rows, 5).collect()}
    assert got == named(plain_adaptive(p, 12), range(len(p))) and max(got.values()) > 0


def test_one_dense_place_needs_no_square(spark):
    """12,000 points within one radius: chunks meet their neighbours only."""
    from pyspark.sql import functions as F

    rows = spark.range(12_000).select(F.lit("t").alias("topic_id"), F.col("id").alias("item"), F.array(F.rand(1), F.rand(2)).alias("coordinates"))
    _, places = density._placed(rows, "item")
    edges = density.candidate_edges(places.drop("n"), 2)
    n = edges.count()
    assert 11_999 <= n < 4 * 12_000
    assert Counter(r["cluster"] for r in density.radius_clusters(rows, 2, 2.0).collect()) == {0: 12_000}


def test_near_pairs_bound():
    """Boxes in a row: only neighbours are near."""
    import pandas as pd

    low = [[10.0 * i, 0.0] for i in range(50)]
    chunks = pd.DataFrame({"chunk": range(50), "low": low, "high": [[x + 9, 1.0] for x, _ in low], "one": low, "longest": 1.0})
    assert len(density._near_pairs(chunks)) <= 2 * 50
    assert np.isfinite(density.spanning_tree(np.zeros((3, 2)), np.arange(3))[0][0])
