"""Payload readers, identifiers, model outputs and sinks on written rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpusgap.functions import text as T
from corpusgap.operators import clusters, grounding, network
from corpusgap.sources import payloads, tables


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_semantic_scholar_items(spark):
    data = {"data": [{"paperId": "p1", "title": " A  title ", "venue": "", "publicationVenue": {"name": "ICML"}, "authors": [{"name": "Ann"}, {"name": None}]}, {"paperId": "p2", "title": None}]}
    df = spark.createDataFrame([(json.dumps(data),), ("no json",), (None,)], "payload string")
    rows = payloads.semantic_scholar_papers(df).collect()
    assert [(r["external_id"], r["title"], r["venue"], r["authors"]) for r in rows] == [("p1", "A title", "ICML", ["Ann"])]


def test_inverted_abstract_takes_the_later_word(spark):
    data = {"results": [{"id": "W1", "display_name": "x", "abstract_inverted_index": {"one": [0, 2], "two": [1], "three": [2]}}]}
    df = spark.createDataFrame([(json.dumps(data),)], "payload string")
    assert payloads.openalex_papers(df).first()["abstract"] == "one two three"


def test_arxiv_entries(spark):
    feed = (
        '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A &amp; B</title><published>2024-01-01T00:00:00Z</published>'
        "<author><name>Ann</name></author><arxiv:journal_ref>Proc. of the International Conference on Learning Representations</arxiv:journal_ref></entry><entry><id>x</id></entry></feed>"
    )
    rows = payloads.arxiv_papers(spark.createDataFrame([(feed,)], "payload string")).collect()
    assert [(r["external_id"], r["title"], r["year"], r["venue"], r["authors"]) for r in rows] == [("2401.00001v2", "A & B", 2024, "ICLR", ["Ann"])]


def test_web_years(spark):
    assert one(spark, payloads.first_year(F.lit("no"), F.lit("in 2021 and 1999"), F.lit("2000"))) == 2021
    assert one(spark, payloads.first_year(F.lit("120210"), F.lit(None).cast("string"))) is None


def test_identifiers(spark):
    cases = {
        "10.1234/AbC": ("doi", "10.1234/abc"), "https://doi.org/10.1234/x/": ("doi", "10.1234/x"), "https://arxiv.org/pdf/2401.00001v3.pdf": ("arxiv", "2401.00001"),
        "2401.12345": ("arxiv", "2401.12345"), "W1234567": ("openalex", "W1234567"), "https://www.semanticscholar.org/paper/A-b/" + "a" * 40: ("semantic_scholar", "a" * 40), "what": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", T.identified(F.col("c")).alias("i"))
    assert {r["c"]: r["i"] and (r["i"]["source"], r["i"]["external_id"]) for r in df.collect()} == cases
    assert one(spark, T.node_reference(F.lit("DOI:10.1/x"))["source"]) == "doi" and one(spark, T.node_reference(F.lit("b" * 40))["source"]) == "semantic_scholar"


def test_model_outputs(spark):
    raws = ['```json\n{"gap_title": "g", "what_fails": "x [3]", "confidence_score": "0.8"}\n```', '[{"gap_title": "a"}, {"gap_title": "n/a"}]', '{"theme_label": "T", "gaps": [{"gap_title": "b"}]} and so on', "nothing"]
    df = spark.createDataFrame([("t", i, r) for i, r in enumerate(raws)], "topic_id string, cluster int, raw string")
    good, bad = grounding.parsed_gaps(df)
    got = sorted((r["cluster"], r["pos"], r["gap_title"], r["confidence"], r["theme_label"]) for r in good.collect())
    assert got == [(0, 0, "g", 0.8, None), (1, 0, "a", None, None), (1, 1, "", None, None), (2, 0, "b", None, "T")]
    assert [r["cluster"] for r in bad.collect()] == [3]
    verdicts = spark.createDataFrame([(1, '{"status": "Valid", "confidence": 0.9}'), (2, "?")], "gap_id long, raw string")
    assert sorted((r["gap_id"], r["status"], r["confidence"]) for r in grounding.verdicts(verdicts).collect()) == [(1, "valid", 0.9), (2, "error", 0.5)]


def test_citations_are_renumbered(spark):
    text = F.lit("a [7] b [3], c [9] d [3]")
    positions = grounding.cited_positions(text, F.lit(8))
    assert one(spark, positions) == [3, 7] and one(spark, grounding.cited_positions(F.lit("none"), F.lit(5))) == [1, 2]
    assert one(spark, grounding.renumbered(text, positions)) == "a [2] b [1], c  d [1]"


def test_statuses(spark):
    gaps = spark.createDataFrame([(1, "x [1]."), (2, "x [1]."), (3, "x [2]."), (4, "none"), (5, "x [1].")], "gap_id long, text string")
    scores = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.2), (5, 1, 0.1)], "gap_id long, n int, score double")
    cites = spark.createDataFrame([(g, 1, 2) for g in (1, 2, 3, 4, 5)], "gap_id long, n int, evidence_count int")
    out = {r["gap_id"]: r["status"] for r in grounding.statuses(gaps, scores, cites).collect()}
    assert out == {1: "grounded", 2: "weakly_supported", 3: "needs_review", 4: "needs_review", 5: "hallucinated"}


def test_cross_check(spark):
    gaps = spark.createDataFrame([(1, 0, "a long enough gap text"), (2, 0, "short"), (3, 0, "another long gap text"), (4, 9, "a gap without any papers")], "gap_id long, cluster int, text string")
    matches = spark.createDataFrame([(1, "p", 0.9), (1, "q", 0.8)], "gap_id long, paper_id string, similarity double")
    out = {r["gap_id"]: (r["status"], r["conflicts"]) for r in grounding.cross_checked(gaps, matches, spark.createDataFrame([(0,)], "cluster int")).collect()}
    assert out == {1: ("potentially_addressed", ["p", "q"]), 2: ("unvalidated", None), 3: ("validated", None), 4: ("unvalidated", None)}


def test_text_helpers(spark):
    assert one(spark, T.shortened_theme(F.lit("However, the main Limits of all methods remain"))) == "The main limits of"
    assert one(spark, T.scrub(F.lit(" undefined "), "paper")) is None and one(spark, T.scrub(F.lit("N/A"), "model")) is None and one(spark, T.scrub(F.lit("ok"), "report")) == "ok"
    assert [one(spark, T.listed(F.array(*map(F.lit, x)))) for x in (["a_b"], ["a", "b"], ["a", "b", "c", "d"])] == ["a b", "a and b", "a, b, and c"]
    assert one(spark, T.embedding_text(F.lit("Deep deep nets"), F.lit("A title"), F.array(F.lit("m")), F.array(F.lit("lim lim")), F.lit(None).cast("array<string>"))) == "deep nets. a title. m. lim"
    assert one(spark, T.split_key(F.lit("arxiv:a:b"))["external_id"]) == "a:b"
    assert one(spark, grounding.paper_context(F.lit("T"), F.array(F.lit("a"), F.lit(""), F.lit("b")))) == "T. a. b"


def test_merged_nodes(spark):
    table = [(1, "OA:W1", "10.1/a", "Short", 2020, ["A"], ["openalex"]), (2, "f" * 40, "10.1/a", "Short and long", None, [], ["semantic_scholar"]), (3, "OA:W3", None, "short", 2020, ["B"], ["openalex"]), (4, "OA:W4", None, "other", 2020, ["B"], ["openalex"])]
    nodes = spark.createDataFrame([(*r, 5) for r in table], "row long, node string, doi string, title string, year int, authors array<string>, sources array<string>, citation_count long")
    labels = clusters.components(network.identity_links(nodes).withColumn("all", F.lit(1)), ["all"]).select(F.col("node").alias("row"), "label")
    out = {r["label"]: (r["node"], r["title"], r["year"], r["authors"], r["sources"], r["rows"]) for r in network.merged_nodes(nodes, labels).collect()}
    assert out == {1: ("f" * 40, "Short and long", 2020, ["A"], ["openalex", "semantic_scholar"], 3), 4: ("OA:W4", "other", 2020, ["B"], ["openalex"], 1)}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(0, i, i + 1) for i in range(60)] + [(1, 5, 9)], "t int, a long, b long")
    out = {(r["t"], r["node"]): r["label"] for r in clusters.components(links, ["t"]).collect()}
    assert all(out[0, i] == 0 for i in range(61)) and out[1, 9] == 5


def test_circle_and_pca(spark):
    df = spark.createDataFrame([("t", i) for i in range(4)], "topic_id string, i int")
    assert [(r["x"], r["y"]) for r in clusters.on_a_circle(df, ["topic_id"], "i").orderBy("i").collect()] == [(0.5, 0.0), (0.0, 0.5), (-0.5, 0.0), (0.0, -0.5)]
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(6)], "vec_id long, embedding array<double>")
    rows = clusters.pca_coordinates(flat, 3).collect()
    assert all(len(r["coordinates"]) == 3 and abs(r["coordinates"][1]) < 1e-9 and r["coordinates"][2] == 0 for r in rows)


def test_tables_and_reports(spark, tmp_path):
    tables.append_table(spark.createDataFrame([(1, "x", "open")], "user_id long, external_id string, kind string").withColumn("ts", F.current_timestamp()), str(tmp_path), "paper_interactions")
    assert tables.read_table(spark, str(tmp_path), "paper_interactions").count() == 1
    gaps = spark.createDataFrame([("r", "t", 1, "A", "d", "e", 0.5, "grounded"), ("r", "t", 2, "B", "d", "e", 0.5, "hallucinated")], "report_id string, topic string, pos int, title string, description string, direction string, confidence double, status string")
    text = tables.markdown(gaps).first()["text"]
    assert "## A" in text and "## B" not in text and "50 %" in text
    tables.append_runs(gaps, f"{tmp_path}/runs")
    assert spark.read.json(f"{tmp_path}/runs").count() == 2
    papers = spark.createDataFrame([("a", [1.0]), ("bb", None)], "text string, embedding array<float>")
    out = tables.backfilled(papers, lambda texts: [[float(len(t))] for t in texts]).collect()
    assert [(r["text"], r["embedding"]) for r in out] == [("bb", [2.0])]
