"""Cluster reports, network repairs and evidence rules on written rows."""

from __future__ import annotations

import pytest

from corpusgap.operators import clusters, density, evidence, gaps, network, usage


def test_gap_explorer(spark):
    df = spark.createDataFrame([(1, 0, "Noise", "sensors fail", 0.9), (2, 1, "Scale", "agents", 0.4), (3, 1, "Abc", "x", 0.6)], "gap_id long, cluster int, title string, description string, confidence double")
    ids = lambda rows: [r["gap_id"] for r in rows.collect()]
    assert ids(clusters.explored(df)) == [1, 3, 2] and ids(clusters.explored(df, order="title")) == [3, 1, 2] and ids(clusters.explored(df, order="cluster")) == [1, 3, 2]
    assert ids(clusters.explored(df, low=0.5, cluster=1)) == [3] and ids(clusters.explored(df, text="SENSORS")) == [1]


def test_cluster_reports(spark):
    members = spark.createDataFrame([(0, "a", "T a", "long", 3), (0, "b", "T b", None, 9), (1, "c", "T c", "x", 1)], "cluster int, paper_id string, title string, abstract string, citation_count long")
    themes = spark.createDataFrame([(0, "One"), (1, "Two")], "cluster int, theme string")
    assert {(r["cluster"], r["papers"], r["theme"]) for r in clusters.distribution(members, themes).collect()} == {(0, 2, "One"), (1, 1, "Two")}
    context = {r["cluster"]: r for r in clusters.model_context(members, themes, 1, 2).collect()}
    assert context[0]["context"] == "Title: T b\nAbstract: " and context[1]["context"].endswith("Abstract: x") and context[0]["other_themes"] == ["Two"]
    found = spark.createDataFrame([(7, 0, 0.3, ["a", "T C"]), (8, 0, 0.8, ["b"])], "gap_id long, cluster int, confidence double, supporting array<string>")
    assert {(r["gap_id"], r["paper_id"]) for r in clusters.gap_papers(found, members).collect()} == {(7, "a"), (7, "c"), (8, "b")}
    assert [(r["gap_id"], r["gaps"]) for r in clusters.best_gap_per_cluster(found).collect()] == [(8, 2)]


def test_radius_and_silhouette(spark):
    rows = [("t", i, [float(i // 5 * 10), 0.1 * (i % 5)]) for i in range(10)]
    points = spark.createDataFrame(rows, "topic_id string, item long, coordinates array<double>")
    found = density.radius_clusters(points, 2, 0.1 + 1e-9)
    assert {r["item"]: r["cluster"] for r in found.collect()} == {i: i // 5 for i in range(10)}
    assert clusters.silhouette(found.join(points, ["topic_id", "item"])) > 0.9
    assert [r["cluster"] for r in density.radius_clusters(points.filter("item = 0"), 2, 1.0).collect()] == [0]


def test_network_repairs(spark):
    net = spark.createDataFrame([(1, 2, "reference")], "seed long, paper long, role string")
    sparse = network.sparse_seeds(net, spark.createDataFrame([(1, 50), (9, 2)], "seed long, citation_count long"))
    assert [r["seed"] for r in sparse.collect()] == [1]
    more = spark.createDataFrame([(1, 3, "citer"), (4, 5, "citer")], "seed long, paper long, role string")
    assert network.enriched(net, sparse, more).count() == 2
    nodes = spark.createDataFrame([("n", "old", 2000, None, "u")], "node string, title string, year int, doi string, url string")
    fresh = spark.createDataFrame([("n", "new", None, "10.1/x", None)], "node string, title string, year int, doi string, url string")
    r = network.overridden(nodes, fresh).first()
    assert (r["title"], r["year"], r["doi"], r["url"]) == ("new", 2000, "10.1/x", "u")


def test_evidence_rules_and_canonical_names(spark):
    text = "A key limitation is a noisy sensor in the fully observable case. We assume full observability here. In future work we look at teams. Reward and data efficiency on SMAC and ABCD."
    rows = spark.createDataFrame([("t", "p", "A Transformer", text, 2024, 3)], "topic_id string, external_id string, title string, abstract string, year int, citation_count long")
    got = {}
    for r in evidence.evidence_long(rows).collect():
        got.setdefault(r["kind"], set()).add(r["term"])
    assert "a key limitation is a sensor noise in the full observability case" in got["limitation"]
    assert got["assumption"] == {"full_observability"} and got["metric"] == {"reward", "sample_efficiency"} and got["dataset"] == {"smac", "abcd"} and got["method"] == {"transformer"}
    assert any("future work" in t for t in got["future_work"])


def test_detectors_by_hand(spark):
    table = [("t", f"p{i}", "x", 2024, 100 * i, kind, term) for i in range(4) for kind, term in (("limitation", "poor robustness"), ("assumption", "full_observability"), ("metric", "reward"), ("dataset", "smac"))]
    table += [("t", "p0", "x", 2024, 0, "limitation", "only here")]
    df = spark.createDataFrame(table, "topic_id string, paper_id string, title string, year int, citation_count long, kind string, term string")
    papers = spark.createDataFrame([("t", f"p{i}", 2024, 100 * i) for i in range(4)], "topic_id string, external_id string, year int, citation_count long")
    out = {r["kind"]: r for r in gaps.described(gaps.ranked(df, papers, 2025, 9)).collect()}
    assert set(out) == {"limitation", "assumption", "metric", "dataset", "baseline"}
    assert out["limitation"]["category"] == "evaluation" and out["limitation"]["severity"] == pytest.approx(3.3) and out["assumption"]["category"] == "deployment"
    assert out["metric"]["items"] == ["robustness", "safety", "sample_efficiency", "transfer"] and out["metric"]["actionability"] == pytest.approx(2.6)
    assert "sparse baselines" in out["baseline"]["statement"] and out["dataset"]["title"] == "Benchmark concentration on smac"
    assert out["limitation"]["action"].startswith("Build a robustness benchmark") and out["assumption"]["breakdown"]["overall"] > 0


def test_auc_of_any_scale(spark):
    rows = [(float(i * i) - 50, int(i % 3 == 0 or i > 70)) for i in range(100)] + [(7.0, 1), (7.0, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    won = sum((a > b) + 0.5 * (a == b) for a, x in rows for b, y in rows if x == 1 and y == 0)
    ones = sum(x for _, x in rows)
    assert usage.roc_auc(df, 8).first()["auc"] == pytest.approx(won / ones / (len(rows) - ones))
