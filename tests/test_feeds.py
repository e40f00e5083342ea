"""Feeds, profiles and affinities on small written tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgap.functions import scores
from corpusgap.operators import corpus, feeds, profiles


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_ranking_by_similarity(spark):
    """Near before mid before far; without a vector or already seen: left out."""
    papers = [(1, "near", 2024, 10, [0.95, 0.05, 0.0]), (1, "mid", 2024, 10, [0.7, 0.7, 0.0]), (1, "far", 2024, 10, [0.0, 1.0, 0.0]), (1, "none", 2024, 10, None), (1, "old", 2024, 10, [1.0, 0.0, 0.0])]
    pool = spark.createDataFrame(papers, "user_id long, external_id string, year int, citation_count long, embedding array<double>")
    pool = feeds.without_seen(pool, spark.createDataFrame([(1, "old")], "user_id long, external_id string"))
    asked = spark.createDataFrame([(1, "a", 1.0, [1.0, 0.0, 0.0]), (1, "b", -1.0, [0.0, 1.0, 0.0])], "user_id long, label string, weight double, vector array<double>")
    out = feeds.ranked_by_similarity(pool, asked, None, 2025).orderBy("place")
    assert [x for x, in rows(out, "external_id")] == ["near", "mid", "far"]
    assert feeds.ranked_by_similarity(pool, asked, None, 2025, 2).count() == 2


def test_seen_papers_stay_if_nothing_else_is_left(spark):
    pool = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "user_id long, external_id string")
    seen = spark.createDataFrame([(1, "a"), (2, "a")], "user_id long, external_id string")
    assert sorted(rows(feeds.without_seen(pool, seen, True), "user_id", "external_id")) == [(1, "a"), (2, "b")]
    assert sorted(rows(feeds.without_seen(pool, seen), "user_id", "external_id")) == [(2, "b")]


@pytest.mark.parametrize(
    ("lists", "weights", "limit", "want"),
    [
        ([["a1", "a2", "a3", "a4"], ["b1", "b2"]], [2.0, 1.0], 6, {"a": 4, "b": 2}),
        ([["x", "a1"], ["x", "b1"]], [1.0, 1.0], 4, {"x": 1, "a": 1, "b": 1}),
        ([[f"a{i}" for i in range(10)]], [1.0], 3, {"a": 3}),
        ([], [], 3, {}),
    ],
)
def test_interleaving(lists, weights, limit, want):
    out = feeds.interleaved(lists, weights, limit)
    assert len(out) == len(set(out)) and {k: sum(x.startswith(k) for x in out) for k in want} == want
    assert len(out) == sum(want.values())


def test_interleaving_by_user(spark):
    table = [(u, name, w, r, f"{name}{r}") for u in (1, 2) for name, w in (("a", 2.0), ("b", 1.0)) for r in range(1, 7)]
    df = spark.createDataFrame(table, "user_id long, list string, weight double, rank int, external_id string")
    out = feeds.interleave(df, 6).orderBy("user_id", "place")
    assert [x for x, in rows(out.filter("user_id = 2"), "external_id")] == ["a1", "a2", "b1", "a3", "a4", "b2"]


def test_diversification_by_force():
    rng = np.random.default_rng(2)
    x, s = rng.standard_normal((12, 4)), rng.uniform(0, 1, 12)
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    picked = [int(np.argmax(s))]
    while len(picked) < 5:
        value = {i: 0.7 * s[i] - 0.3 * max(cosine(x[i], x[j]) for j in picked) for i in range(12) if i not in picked}
        picked.append(max(value, key=value.get))
    assert feeds.diverse_order(s, x, 5) == picked


def test_affinity_scores(spark):
    papers = [(1, "both", ["Alice", "Bob"], "NeurIPS 2024"), (1, "none", ["Carl"], None), (1, "clamp", ["Alice"], "neurips"), (2, "cold", ["Alice"], "neurips")]
    pool = spark.createDataFrame(papers, "user_id long, external_id string, authors array<string>, venue string")
    authors = spark.createDataFrame([(1, "alice", 1.0), (1, "bob", 0.5)], "user_id long, author string, weight double")
    venues = spark.createDataFrame([(1, "neurips", 1.0), (1, "acl", 0.2)], "user_id long, venue string, weight double")
    out = dict(rows(profiles.affinity_scores(pool, authors, venues), "external_id", "score"))
    assert out == {"both": 1.0, "none": 0.0, "clamp": 1.0, "cold": 0.0}
    small = authors.withColumn("weight", F.col("weight") * 0.1)
    assert dict(rows(profiles.affinity_scores(pool, small, venues), "external_id", "score"))["both"] == pytest.approx(0.15 * 0.6 + 0.4)


@pytest.mark.parametrize(("page", "cap", "want"), [(4, 2, {"NeurIPS": 2, "ICML": 2})])
def test_popular_page_is_spread_over_venues(spark, page, cap, want):
    table = [("t", f"{v}{i}", v, 2020 + i % 5, 100 - i, n * 10 + i) for n, v in enumerate(("NeurIPS", "ICML")) for i in range(5)]
    df = spark.createDataFrame(table, "topic_id string, external_id string, venue string, year int, citation_count long, pos long")
    got = [v for v, in rows(profiles.popular(df, 2025, page, cap), "venue")]
    assert {v: got.count(v) for v in want} == want
    one = df.withColumn("venue", F.lit("NeurIPS"))
    assert profiles.popular(one, 2025, 5, 2).count() == 5


def test_profile_parts(spark):
    seeds = spark.createDataFrame([(1, "seed one", "1"), (2, "seed two", "2")], "user_id long, topic string, item string")
    searches = spark.createDataFrame([(1, f"s{i}", 0.5, "3") for i in range(5)], "user_id long, topic string, weight double, item string")
    gaps = spark.createDataFrame([(1, "g", -0.6, "4")], "user_id long, gap_id string, weight double, item string")
    acts = spark.createDataFrame([(2, "p", "save", 0.9)], "user_id long, external_id string, kind string, weight double")
    out = profiles.profile_components(seeds, searches, gaps, acts)
    assert sorted(rows(out.groupBy("user_id", "kind").count(), "user_id", "kind", "count")) == [(1, "gap_negative", 1), (1, "search", 5), (2, "interaction_positive", 1), (2, "seed", 1)]
    assert rows(profiles.top_labels(out).filter("user_id = 2").orderBy("place"), "label") == [("p",), ("seed two",)]


def test_scores(spark):
    df = spark.createDataFrame([("2026", 0), ("2020", 10), ("bad", 1000), (None, 10**8)], "year string, c long")
    out = rows(df.select(scores.recency_score(F.col("year"), 2026).alias("r"), scores.citation_score(F.col("c")).alias("c")), "r", "c")
    assert [r for r, _ in out] == [1.0, 0.0, 0.0, 0.0]
    assert out[0][1] == 0.0 and 0.2 < out[1][1] < 0.3 and 0.7 < out[2][1] < 0.8 and out[3][1] == 1.0


def test_a_page_with_missing_vectors(spark):
    ranked = [(1, "a", 1, 0.9, [1.0, 0.0]), (1, "b", 2, 0.8, None), (1, "c", 3, 0.7, [1.0, 0.0]), (1, "d", 4, 0.6, [0.0]), (2, "e", 1, 0.5, None)]
    df = spark.createDataFrame(ranked, "user_id long, external_id string, place int, score double, embedding array<double>")
    assert sorted(rows(feeds.diversified(df, 3), "user_id", "place", "external_id")) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "d"), (2, 1, "e")]


def test_chain_of_strategies(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    matched = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9)], "user_id long, external_id string, score double")
    cited = spark.createDataFrame([("x", 1), ("y", 2)], "external_id string, place int")
    topics, seen = spark.createDataFrame([(1,), (2,)], "user_id long"), spark.createDataFrame([(3, "x")], "user_id long, external_id string")
    out = feeds.feed_chain(users, matched, cited, topics, seen, 2)
    assert sorted(rows(out, "user_id", "external_id", "place", "approach")) == [
        (1, "a", 2, "tfidf"), (1, "b", 1, "tfidf"), (2, "x", 1, "highly_cited_fallback"), (2, "y", 2, "highly_cited_fallback"), (3, "y", 1, "highly_cited"),
    ]


def test_history_keeps_an_older_report(spark):
    table = [(1, 1, "t", "r1", "2024-01-01"), (2, 1, "t", None, "2024-01-02")]
    df = spark.createDataFrame(table, "search_id long, user_id long, topic string, report_id string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert rows(corpus.latest_history(df), "search_id", "searches", "report_id") == [(2, 2, "r1")]
