"""Column functions and evidence rules on written examples."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from corpusgap.functions import scores, text
from corpusgap.operators import corpus, evidence, profiles, usage


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [("  A \n b ", "A b"), ("", None), (None, None)])
def test_clean_text(spark, given, wanted):
    assert one(spark, text.clean_text(F.col("c").cast("string")), c=given) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("Proceedings of the 40th International Conference on Machine Learning (ICML 2023)", "international conference on machine learning"), ("NeurIPS 2024", "neurips"), (None, "")],
)
def test_venue_key(spark, given, wanted):
    assert one(spark, text.venue_key(F.col("c").cast("string")), c=given) == wanted


def test_year_range(spark):
    assert tuple(one(spark, text.year_range(F.col("c")), c="2019-2021")) == (2019, 2021, False)
    assert tuple(one(spark, text.year_range(F.col("c")), c="all")) == (None, None, False)
    assert one(spark, text.year_range(F.col("c")), c="2021-2019")["bad"]
    assert one(spark, text.year_range(F.col("c")), c="soon")["bad"]


def test_cited_sentences(spark):
    found = one(spark, text.cited_sentences(F.col("c")), c="A sentence that cites two works [1][3]. Short [2]. Nothing is cited here at all.")
    assert [(r["sentence"], r["numbers"]) for r in found] == [("A sentence that cites two works .", [1, 3])]


def test_evidence_rules(spark):
    t = "A key challenge is the noise of sensors. In this work we limit nothing. Agents assume full observability here. Results on SMAC and QMIX and XYZ-9 hold. Future work includes scaling up."
    assert one(spark, evidence.limitations(F.col("c")), c=t) == [
        "A key challenge is the noise of sensors", "robustness under noise or partial observability is underexplored", "scaling to more agents remains underexplored",
    ]
    assert one(spark, evidence.future_work(F.col("c")), c=t) == ["Future work includes scaling up"]
    assert one(spark, evidence.assumptions(F.col("c")), c=t) == ["Full observability"]
    assert one(spark, evidence.datasets(F.col("c")), c=t) == ["SMAC", "XYZ-9"]
    assert one(spark, evidence.method(F.col("c"), F.lit("with policy gradient")), c="A title") == "Policy Gradient"
    assert one(spark, evidence.canonical(F.col("c")), c="Average Reward") == "reward"


@pytest.mark.parametrize(("kind", "weight"), [("open", 0.3), ("like", 1.0), ("save", 1.0), ("dislike", -0.8), ("hide", -0.5), ("unknown", 0.0), (None, 0.0)])
def test_kind_weight(spark, kind, weight):
    assert one(spark, scores.kind_weight(F.col("c").cast("string")), c=kind) == weight


@pytest.mark.parametrize(("year", "score"), [("2026", 1.0), ("2020", 0.0), ("bad", 0.0), ("1990", 0.0)])
def test_recency_score(spark, year, score):
    assert one(spark, scores.recency_score(F.col("c"), 2026), c=year) == score


def test_citation_score(spark):
    assert one(spark, scores.citation_score(F.col("c")), c=10) == pytest.approx(math.log10(11) / 4)
    assert one(spark, scores.citation_score(F.col("c")), c=10**8) == 1.0


def test_cosine_guards_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(scores.cosine(F.col("a"), F.col("b")).alias("x")).first()["x"] == 0.0


def test_deduplicate_is_idempotent_and_prefers_sources(spark):
    df = spark.createDataFrame(
        [(0, "t", "arxiv", "1", "A Title!", ""), (1, "t", "openalex", "2", "a title", "x"), (2, "t", "tavily", "3", "???", None)],
        "pos long, topic_id string, source string, external_id string, title string, abstract string",
    )
    once = corpus.deduplicate(df)
    assert {r["external_id"] for r in once.collect()} == {"2", "3"}
    assert corpus.deduplicate(once.drop("title_key")).count() == 2


def test_popular_caps_venues_then_fills(spark):
    rows = [(i, "t", "NeurIPS", 2025, 100 - i) for i in range(5)] + [(5 + i, "t", "ICML", 2025, 50 - i) for i in range(5)]
    df = spark.createDataFrame(rows, "pos long, topic_id string, venue string, year int, citation_count long")
    assert [r["venue"] for r in profiles.popular(df, 2025, 4, 2).orderBy("place").collect()] == ["NeurIPS", "NeurIPS", "ICML", "ICML"]
    assert profiles.popular(df.filter("venue = 'NeurIPS'"), 2025, 5, 2).count() == 5


def test_paper_key(spark):
    assert one(spark, text.paper_key(F.col("s"), F.col("i")), s="arxiv", i="2401.1:2") == "arxiv:2401.1:2"
    back = one(spark, text.split_key(F.col("k")), k="arxiv:2401.1:2")
    assert (back["source"], back["external_id"]) == ("arxiv", "2401.1:2")
    with pytest.raises(Exception, match="source and an id"):
        one(spark, text.paper_key(F.col("s"), F.col("i")), s="", i="1")


def test_papers_without_title_are_told_by_address(spark):
    rows = [(0, "t", "arxiv", "1", "", "", "http://a"), (1, "t", "openalex", "2", None, "x", "http://a"), (2, "t", "arxiv", "3", "", "", " "), (3, "t", "arxiv", "4", "!", "", None)]
    df = spark.createDataFrame(rows, "pos long, topic_id string, source string, external_id string, title string, abstract string, url string")
    assert {r["external_id"] for r in corpus.deduplicate(df).collect()} == {"2", "3", "4"}


def test_engagement(spark):
    votes = spark.createDataFrame([("up",), ("up",), ("down",), (None,)], "vote string")
    r = usage.positive_ratio(votes, []).first()
    assert (r["rated"], r["positive"]) == (3, pytest.approx(2 / 3))
    log = spark.createDataFrame([(1, "made", 1), (1, "export", 3), (2, "made", 5), (2, "share", 4), (3, "export", 1)], "user_id long, kind string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    r = usage.export_rate(log, "made", ("export", "share")).first()
    assert (r["users"], r["rate"]) == (2, 0.5)
    seen = spark.createDataFrame([(1, "a", 0), (1, "b", 60), (1, "b", 120), (1, "c", 9000)], "user_id long, gap string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    r = usage.examined_per_session(seen, "gap").first()
    assert (r["sessions"], r["examined"]) == (2, 1.5)
