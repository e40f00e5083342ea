"""Results that must not depend on the size of the tables, on written or counted rows."""

from __future__ import annotations

import datetime as dt
import math
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusgap.operators import feeds, matching, usage
from corpusgap.streaming import jobs


def test_stage_latencies_are_exact(spark):
    n = 60_000
    runs = spark.range(n).select(F.col("id").alias("run"), F.explode(F.array(F.lit(0), (F.col("id") * 7919 % 60013) ** 2 % 1_000_003)).alias("s"))
    runs = runs.select("run", F.when(F.col("s") == 0, "a").otherwise("b").alias("stage"), F.timestamp_seconds("s").alias("ts"))
    took = sorted((i * 7919 % 60013) ** 2 % 1_000_003 for i in range(1, n))
    got = usage.stage_latency(runs.filter("run > 0")).filter("stage = 'a'").first()
    assert (got["runs"], got["p50"], got["p95"]) == (n - 1, took[math.ceil((n - 1) / 2) - 1], took[math.ceil((n - 1) * 95 / 100) - 1])


def test_quantiles_of_few_and_negative_numbers(spark):
    rows = spark.createDataFrame([("a", -5000), ("a", 3), ("a", None), ("b", 9), ("c", None)], "k string, v long")
    got = usage.discrete_quantiles(rows, ["k"], "v", {"low": "0", "half": "0.5", "most": "1"})
    assert sorted(tuple(r) for r in got.collect()) == [("a", 2, -5000, -5000, 3), ("b", 1, 9, 9, 9)]


def test_feedback_is_an_aggregate_in_any_state_store(spark, tmp_path):
    schema = "user_id long, gap_id string, vote string, pursue boolean, updated_at timestamp, event_id long, clear array<string>"
    at = lambda day: dt.datetime(2024, 1, day)
    rows = [(u, "g", "up", False, at(1), 1, None) for u in range(50)] + [(u, "g", None, None, at(2), 2, [None, "vote"] if u % 2 else [None]) for u in range(50)] + [(7, "g", "down", True, at(3), 3, ["note"])]
    for i, part in enumerate((rows[:60], rows[60:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    jobs.drained(jobs.feedback_fold(source), f"{tmp_path}/state", f"{tmp_path}/out", "update")
    last = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect():
        last[r["user_id"]] = (r["vote"], r["pursue"], r["updated_at"])
    assert last == {u: (None if u % 2 else "up", False, at(2)) for u in range(50)} | {7: ("down", True, at(3))}


def test_a_ring_is_read_and_written_once_a_batch():
    calls = []
    state = SimpleNamespace(get=lambda: calls.append("get"), update=lambda value: calls.append(value))
    handle = SimpleNamespace(getValueState=lambda *a: state, registerTimer=lambda t: calls.append(t))
    ring = jobs._SeenRing(1000, 21)
    ring.init(handle)
    rows = [Row(external_id=f"p{i:04}", at=i * 1_000_000) for i in range(3000)]
    out = list(ring.handleInputRows((1,), iter(rows), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert len(calls) == 3 and len(calls[2][0]) == len(out) == 1000 and out[0]["external_id"] == "p2999" and out[-1]["external_id"] == "p2000"


def test_users_meet_papers_without_their_texts(spark):
    """Of copies the best of all of a user's topics stays, and titles and abstracts don't travel with it."""
    papers = [("s", "arxiv", 1, "a", "A Title", ""), ("s", "openalex", 2, "b", "a  title!", ""), ("t", "openalex", 3, "c", "A title", "told"), ("t", "arxiv", 4, "d", "", "x"), ("t", "arxiv", 5, "e", None, "x"), ("u", "arxiv", 6, "f", "A title", "")]
    landed = spark.createDataFrame(papers, "topic string, source string, pos long, external_id string, title string, abstract string")
    recent = spark.createDataFrame([(1, "s", 1), (1, "t", 2), (1, "u", 3), (2, "s", 1), (2, "t", 4), (3, "u", 1)], "user_id long, topic string, place int")
    out = feeds.topic_candidates(recent, landed)
    assert out.columns == ["user_id", "source", "pos", "external_id"]
    assert sorted((r["user_id"], r["external_id"]) for r in out.collect()) == [(1, "c"), (1, "d"), (1, "e"), (2, "b"), (3, "f")]


def test_terms_are_counted_where_their_text_is(spark):
    papers = spark.createDataFrame([("1", "big cats and big dogs"), ("2", None), ("3", "a"), ("4", "cats")], "external_id string, text string")
    topics = spark.createDataFrame([(8, "big cats"), (9, "dogs")], "topic_no long, text string")
    counts = matching._term_counts(matching._terms(papers.selectExpr("'paper' AS kind", "external_id AS id", "text"), ["and"]))
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["tf"]) for r in counts.collect()) == [("1", 1)] * 5 + [("1", 2)] + [("4", 1)]
    got = {r["external_id"]: r for r in matching.tfidf_match(papers, topics, ["and"]).collect()}
    assert set(got) == {"1", "4"} and got["1"]["best_topic"] == 8 and got["4"]["best_topic"] == 8
    one = {r["external_id"]: r["score"] for r in matching.tfidf_match(papers, topics, ["and"], features=1).collect()}
    assert one == {"1": 1.0}  # "big" alone: the commonest, before "cats" by name
