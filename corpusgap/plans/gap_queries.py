"""Queries over papers, evidence, gaps, patterns and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters, corpus, density, evidence, gaps, grounding, model_gaps, patterns, pivots, usage, vectors
from .catalog import _PRIORITY, _TITLE_KEY, EVIDENCE, GAPS, query, rounded, text_evidence
from .fixtures import AS_OF_YEAR, LEXICON


@query("papers", "deduplicated", sql="SELECT topic_id, title_key, source, external_id, year FROM deduplicated")
def dedup_papers(f):
    return corpus.deduplicate(f.papers).select("topic_id", "title_key", "source", "external_id", "year")


@query("papers", sql="SELECT external_id, topic_id, year, venue FROM papers WHERE (topic_id = 'en' AND year BETWEEN 2019 AND 2022 AND venue IN ('ICML', 'Proceedings of the 40th International Conference on Machine Learning')) OR (topic_id = 'fr' AND year BETWEEN 2020 AND 2025 AND venue = 'NeurIPS 2023')")
def filter_year_venue(f):
    asked = f.spark.sql("SELECT * FROM VALUES ('en', '2019-2022', 'icml'), ('fr', '2020 - 2025', 'neurips'), ('de', '2024-2020', 'acl') AS t(topic_id, years, venue)")
    wanted = asked.withColumn("y", T.year_range(F.col("years"))).filter("NOT y.bad").select("topic_id", "y.low", "y.high", "venue")
    return corpus.filter_papers(f.papers, wanted).select("external_id", "topic_id", "year", "venue")


@query("papers", sql="SELECT external_id FROM papers WHERE topic_id = 'en' AND venue = 'ICML'")
def filter_strict_venue(f):
    wanted = f.spark.sql("SELECT 'en' AS topic_id, CAST(NULL AS INT) AS low, CAST(NULL AS INT) AS high, 'icml' AS venue")
    return corpus.filter_papers(f.papers, wanted, strict=True).filter("venue = 'ICML'").select("external_id")


@query("papers", sql=f"""
WITH pool AS (SELECT * FROM papers WHERE source <> 'tavily'), one AS (
  SELECT *, row_number() OVER (PARTITION BY topic_id, coalesce(nullif({_TITLE_KEY}, ''), external_id) ORDER BY {_PRIORITY} DESC, (length(coalesce(abstract, '')) > 0) DESC, pos) AS rn FROM pool)
SELECT topic_id, external_id, citation_count, place FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY citation_count DESC, year DESC, pos) AS place FROM one WHERE rn = 1) WHERE place <= 50""")
def top_papers_per_topic(f):
    return corpus.top_papers(f.papers, 50).select("topic_id", "external_id", "citation_count", "place")


@query("papers", sql="SELECT topic_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS papers FROM papers WHERE source <> 'tavily' GROUP BY topic_id")
def sources_used(f):
    return corpus.sources_used(f.papers).withColumn("sources", F.array_join("sources", ","))


@query("papers", sql="SELECT topic_id, source, external_id, place FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, source ORDER BY pos) AS place FROM papers WHERE year BETWEEN 2018 AND 2022) WHERE place <= 15")
def source_limits(f):
    wanted = f.papers.select("topic_id").distinct().select("topic_id", F.lit(2018).alias("low"), F.lit(2022).alias("high"), F.lit(None).cast("string").alias("venue"))
    return corpus.per_source(corpus.filter_papers(f.papers, wanted), 15).select("topic_id", "source", "external_id", "place")


@query("papers", sql="SELECT topic_id, external_id, place, total > 30 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY pos) AS place, count(*) OVER (PARTITION BY topic_id) AS total FROM papers WHERE year >= 2020) WHERE place BETWEEN 21 AND 30")
def cursor_page(f):
    return corpus.cursor_page(f.papers.filter("year >= 2020"), ["topic_id"], ["pos"], 20, 10).select("topic_id", "external_id", "place", "has_more")


@query("papers", sql="SELECT external_id, min(pool) AS pool FROM (SELECT external_id, 0 AS pool FROM papers WHERE year >= 2023 UNION ALL SELECT external_id, 1 FROM papers WHERE citation_count >= 100) GROUP BY external_id")
def merge_unique(f):
    p = f.papers
    return corpus.ordered_union([p.filter("year >= 2023"), p.filter("citation_count >= 100")], ["external_id"], "pos").select("external_id", "pool")


@query("search_history", sql="SELECT user_id, topic, max(created_at) AS created_at, arg_max(search_id, (created_at, search_id)) AS search_id, count(*) AS searches FROM search_history GROUP BY ALL")
def latest_history(f):
    return corpus.latest_history(f.search_history).drop("report_id")


@query("papers", sql="SELECT external_id FROM papers WHERE external_id NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings)")
def fresh_candidates(f):
    known = f.embeddings.select(F.col("vec_id").cast("string").alias("external_id"))
    return corpus.fresh_rows(f.papers, known, ["external_id"]).select("external_id")


@query("search_history", sql="SELECT topic, venue, min(search_id) AS report, count(*) AS requests FROM search_history GROUP BY ALL")
def reused_requests(f):
    rows = f.search_history.withColumn("fingerprint", T.request_fingerprint(topic=F.lower("topic"), venue=F.coalesce("venue", F.lit(""))))
    return corpus.reused(rows, "fingerprint", "search_id").select("topic", "venue", "report", "requests")


@query("interactions", sql="SELECT user_id, external_id, arg_max(kind, (ts, kind)) AS kind, max(ts) AS ts, min(ts) AS first_seen_at FROM interactions GROUP BY ALL")
def upsert_interactions(f):
    rows = f.interactions.drop("event_id").withColumn("first_seen_at", F.col("ts"))
    middle = F.lit("2024-01-15").cast("timestamp")
    keys, order = ["user_id", "external_id"], F.struct("ts", "kind")
    return corpus.upsert(rows.filter(F.col("ts") < middle), rows.filter(F.col("ts") >= middle), keys, order, "first_seen_at")


@query(*EVIDENCE, sql="SELECT topic_id, kind, term, count(*) AS papers, min(year) AS first_year FROM evidence GROUP BY ALL")
def evidence_terms(f):
    return text_evidence(f).groupBy("topic_id", "kind", "term").agg(F.count("*").alias("papers"), F.min("year").alias("first_year"))


@query(*EVIDENCE, sql="""
SELECT p.external_id, array_to_string(coalesce(e.limitations, []), '|') AS limitations, array_to_string(coalesce(e.metrics, []), '|') AS metrics, array_to_string(coalesce(e.assumptions, []), '|') AS assumptions, array_to_string(coalesce(e.datasets, []), '|') AS datasets, e.method, array_to_string(coalesce(e.baselines, []), '|') AS baselines
FROM papers p LEFT JOIN (SELECT paper_id, list_sort(list(term) FILTER (kind = 'limitation')) AS limitations, list_sort(list(term) FILTER (kind = 'metric')) AS metrics, list_sort(list(term) FILTER (kind = 'assumption')) AS assumptions,
  list_sort(list(term) FILTER (kind = 'dataset')) AS datasets, max(term) FILTER (kind = 'method') AS method, list_sort(list(term) FILTER (kind = 'baseline')) AS baselines FROM evidence GROUP BY paper_id) e ON e.paper_id = p.external_id""")
def normalized_evidence(f):
    """Each paper's evidence in canonical terms."""
    rows = evidence.normalized(evidence.extract(f.papers, LEXICON))
    names = ("limitations", "metrics", "assumptions", "datasets", "baselines")
    return rows.select("external_id", *[F.array_join(F.array_sort(f"normalized_{c}"), "|").alias(c) for c in names], F.nullif("normalized_method", F.lit("")).alias("method"))


@query("papers", sql="SELECT external_id, len(list_filter(string_split(replace(abstract, chr(10), ' '), '.'), lambda p: length(trim(p, ' .')) > 10)) AS sentences FROM papers")
def sentence_counts(f):
    return f.papers.select("external_id", F.size(T.sentences(F.col("abstract"))).cast("long").alias("sentences"))


@query("papers")
def extracted_evidence(f):
    """The default lexicons over whole texts; the rules are tested on written sentences."""
    rows = evidence.extract(f.papers)
    return rows.select("external_id", "limitations", "future_work", "metrics", "assumptions", "datasets", "method")


def _recurring(f, kind):
    rows = gaps.recurring(text_evidence(f, kind), kind, AS_OF_YEAR).drop("kind")
    return rounded(rows, "support_score", "citation_confidence", "novelty")


_SCORES = "supporting, recent, influential, round(support_score, 6) AS support_score, round(citation_confidence::DOUBLE, 6) AS citation_confidence, round(novelty::DOUBLE, 6) AS novelty"
_RECURRING = f"SELECT topic_id, term, {_SCORES} FROM term_scores WHERE kind = '{{}}' AND supporting >= 2"
_TERMS = (*EVIDENCE, "weights", "term_scores")
_PROFILE = (*_TERMS, "profile")


@query(*_TERMS, sql=_RECURRING.format("limitation"))
def recurring_limitation_gaps(f):
    return _recurring(f, "limitation")


@query(*_TERMS, sql=_RECURRING.format("future_work"))
def future_work_gaps(f):
    return _recurring(f, "future_work")


def _terms(f, *kinds):
    return gaps.term_scores(text_evidence(f, *kinds), AS_OF_YEAR)


def _topics(f):
    return f.papers.groupBy("topic_id").agg(*[c.alias(n) for n, c in gaps.paper_set_scores(AS_OF_YEAR).items()])


@query(*_PROFILE, sql="SELECT s.topic_id, s.term, s.supporting AS holders, p.papers FROM term_scores s JOIN profile p USING (topic_id) WHERE s.kind = 'assumption' AND s.supporting >= greatest(2, floor(p.papers * 0.3 + 0.999))")
def assumption_concentration(f):
    return gaps.concentrated(_terms(f, "assumption"), _topics(f)).select("topic_id", "term", F.col("supporting").alias("holders"), "papers")


@query(*_PROFILE, sql="SELECT topic_id, metric AS term, round(metric_share, 6) AS share, array_to_string(missing_metrics, '|') AS missing_metrics FROM profile WHERE metric_share >= 0.5")
def metric_dominance(f):
    return rounded(gaps.dominant(_terms(f, "metric"), "metric", 0.5), "share").withColumn("missing_metrics", F.array_join("missing_metrics", "|"))


@query(*_PROFILE, sql="SELECT topic_id, dataset AS term, round(dataset_share, 6) AS share FROM profile WHERE dataset_share >= 0.3")
def dataset_concentration(f):
    return rounded(gaps.dominant(_terms(f, "dataset"), "dataset", 0.3), "share")


@query(*_PROFILE, sql="SELECT topic_id, papers, baselines, coalesce(baseline, 'sparse baselines') AS baseline, array_to_string(missing_baselines, '|') AS missing_baselines FROM profile WHERE baselines <= 1 AND papers >= 3")
def baseline_weakness(f):
    strong = F.array(*map(F.lit, gaps.STRONG_BASELINES))
    rows = _topics(f).join(gaps.evaluation_profile(_terms(f, "baseline")), "topic_id", "left").filter("coalesce(baselines, 0) <= 1 AND supporting >= 3")
    return rows.select("topic_id", F.col("supporting").alias("papers"), F.coalesce("baselines", F.lit(0)).alias("baselines"), F.coalesce("baseline", F.lit("sparse baselines")).alias("baseline"), F.array_join(F.coalesce("missing_baselines", strong), "|").alias("missing_baselines"))


def _ranked(f, k=20) -> DataFrame:
    return gaps.ranked(text_evidence(f, "limitation", "future_work", "assumption", "metric", "dataset", "baseline"), f.papers, AS_OF_YEAR, k, 0.5, 0.3)


@query(*GAPS, sql="SELECT topic_id, kind, category, text, supporting, round(severity::DOUBLE, 6) AS severity, round(actionability::DOUBLE, 6) AS actionability, round(overall::DOUBLE, 6) AS overall, place FROM best_gaps WHERE place <= 20")
def ranked_gaps(f):
    return rounded(_ranked(f).select("topic_id", "kind", "category", "text", "supporting", "severity", "actionability", "overall", "place"), "severity", "actionability", "overall")


@query(*GAPS, sql="""
SELECT topic_id, slug, upper(substring(text, 1, 1)) || lower(substring(text, 2)) AS title, CASE kind
  WHEN 'limitation' THEN 'A recurring limitation in the literature is ' || replace(term, '_', ' ') || ', appearing across ' || supporting || ' papers.'
  WHEN 'future_work' THEN 'Multiple papers identify ' || replace(term, '_', ' ') || ' as a remaining open direction.'
  WHEN 'assumption' THEN 'The literature is heavily concentrated around the assumption of ' || replace(term, '_', ' ') || ', limiting evidence for more realistic settings.'
  WHEN 'metric' THEN 'Evaluation is dominated by ' || replace(term, '_', ' ') || ' style reporting, with limited evidence on ' || replace(items, ' ', ', ') || '.'
  WHEN 'dataset' THEN 'Most studies rely on ' || term || ', limiting evidence for cross benchmark generalization.' END AS statement,
  'Supported by ' || supporting || ' papers (' || recent || ' recent, ' || influential || ' influential).' AS support FROM best_gaps WHERE place <= 10 AND kind <> 'baseline'""")
def gap_report(f):
    """Titles, statements and summaries of the ranked gaps."""
    rows = gaps.described(_ranked(f, 10)).filter("kind <> 'baseline'")
    return rows.select("topic_id", "slug", "title", "statement", F.regexp_extract("summary", r"(Supported by [^)]*\)\.) Why it matters: .+ Action: .+", 1).alias("support"))


_TOP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, kind ORDER BY papers DESC, term) AS place FROM (SELECT topic_id, kind, term, count(*) AS papers FROM evidence WHERE kind IN ({}) GROUP BY ALL)) WHERE place <= {}"


@query(*EVIDENCE, sql=_TOP.format("'method', 'dataset', 'metric', 'assumption', 'limitation', 'future_work'", 5))
def evidence_summary(f):
    return gaps.top_terms(text_evidence(f), 5, ("method", "dataset", "metric", "assumption", "limitation", "future_work"))


@query(*EVIDENCE, sql=_TOP.format("'method', 'dataset', 'metric', 'limitation', 'future_work'", 8))
def top_terms(f):
    return gaps.top_terms(text_evidence(f, *patterns.PATTERN_KINDS), 8, patterns.PATTERN_KINDS)


@query(*EVIDENCE, sql="SELECT topic_id, term, place, paper_id, title, citation_count, year FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, term ORDER BY citation_count DESC, year DESC, paper_id) AS place FROM evidence WHERE kind = 'limitation') WHERE place <= 5")
def supporting_papers(f):
    return gaps.supporting_papers(text_evidence(f, "limitation"), "limitation")


@query("papers", sql="SELECT topic_id, year, count(*) AS papers FROM papers WHERE year BETWEEN 1900 AND 2100 GROUP BY ALL")
def year_histogram(f):
    return patterns.year_histogram(f.papers)


@query("papers", sql="SELECT topic_id, min(year) AS first_year, max(year) AS last_year FROM papers WHERE year BETWEEN 1500 AND 2100 GROUP BY ALL")
def year_extent(f):
    return patterns.year_extent(f.papers, ["topic_id"])


@query(*EVIDENCE, sql="SELECT topic_id, year, term, count(*) AS papers FROM evidence WHERE kind = 'method' GROUP BY ALL")
def method_trend(f):
    return patterns.terms_by_year(text_evidence(f, "method"), "method")


@query(*EVIDENCE, sql="SELECT topic_id, kind, term, papers FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, kind ORDER BY papers DESC, term) AS rn FROM (SELECT topic_id, kind, term, count(*) AS papers FROM evidence WHERE kind IN ('dataset', 'metric') GROUP BY ALL)) WHERE rn <= 10")
def term_frequencies(f):
    return patterns.frequencies(text_evidence(f, "dataset", "metric")).select("topic_id", "kind", F.explode("frequency").alias("term", "papers"))


@query(*EVIDENCE, sql="SELECT topic_id, term, papers FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY papers DESC, term) AS rn FROM (SELECT topic_id, term, count(*) AS papers FROM evidence WHERE kind IN ('limitation', 'future_work') AND year >= 2023 GROUP BY ALL)) WHERE rn <= 4")
def emerging_terms(f):
    return patterns.emerging(text_evidence(f, "limitation", "future_work"), AS_OF_YEAR)


@query(*EVIDENCE, sql="SELECT topic_id, term, papers, round(recent_share, 6) AS recent_share FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY papers DESC, term) AS rn FROM (SELECT topic_id, term, count(*) AS papers, avg((year >= 2024)::INT) AS recent_share FROM evidence WHERE kind = 'method' GROUP BY ALL)) WHERE rn <= 8 AND papers >= 3 AND recent_share < 0.2")
def saturated_methods(f):
    """As of one year later, when under a fifth of the papers are recent."""
    return rounded(patterns.saturated(text_evidence(f, "method"), AS_OF_YEAR + 1), "recent_share")


@query(*EVIDENCE, "paper_labels", sql="""
WITH s AS (SELECT topic_id, paper_id, list(DISTINCT term) AS names FROM evidence WHERE kind = 'baseline' GROUP BY ALL), f AS (SELECT topic_id, arg_min(names, paper_id) AS first FROM s GROUP BY topic_id)
SELECT topic_id, count(*) AS papers, count(*) >= 2 AND bool_and(len(list_intersect(names, first)) / len(list_distinct(list_concat(names, first))) >= 0.7) AS stagnant FROM s JOIN f USING (topic_id) GROUP BY topic_id""")
def baseline_stagnation(f):
    return patterns.baseline_stagnation(text_evidence(f, "baseline"))


_MEMBERS = "SELECT p.topic_id, v.label AS cluster, p.external_id AS paper_id, p.title, p.abstract, p.year, p.citation_count, v.vec_id FROM papers p JOIN paper_labels v USING (external_id)"


def _members(f):
    """Every paper with the label of its vector as its cluster."""
    v = f.paper_labels.select(F.col("external_id").alias("paper_id"), F.col("label").alias("cluster"), "vec_id")
    return f.papers.withColumnRenamed("external_id", "paper_id").join(v, "paper_id").select("topic_id", "cluster", "paper_id", "title", "abstract", "year", "citation_count", "vec_id")


@query("papers", "paper_labels", sql="""
WITH m AS (SELECT label, count(*) AS papers, count(year) AS dated, sum((year >= 2023)::INT)::BIGINT AS recent, max(year) AS latest FROM papers JOIN paper_labels USING (external_id) GROUP BY label)
SELECT *, CASE WHEN dated = 0 THEN 'Established' WHEN recent / dated > 0.6 AND dated >= 3 THEN 'Emerging' WHEN recent = 0 AND latest < 2022 THEN 'Stagnant' WHEN dated >= 10 AND recent / dated < 0.2 THEN 'Saturated' WHEN recent / dated > 0.3 THEN 'Active' ELSE 'Established' END AS trend FROM m""")
def cluster_trend(f):
    return patterns.cluster_trend(_members(f).withColumnRenamed("cluster", "label"), ["label"], AS_OF_YEAR)


@query(*EVIDENCE, "paper_labels", sql=f"""
WITH m AS ({_MEMBERS}), c AS (SELECT cluster, kind, term, count(*) AS n FROM evidence JOIN m USING (paper_id) WHERE kind IN ('limitation', 'future_work') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster, kind ORDER BY n DESC, term) AS rn FROM c)
SELECT cluster, string_agg(term, '|' ORDER BY rn) FILTER (kind = 'limitation' AND rn <= 5) AS top_limitations, string_agg(term, '|' ORDER BY rn) FILTER (kind = 'future_work' AND rn <= 5) AS top_future_work, sum(n) FILTER (kind = 'limitation' AND rn <= 10)::BIGINT AS limitation_mentions FROM r GROUP BY cluster""")
def cluster_themes(f):
    rows = patterns.cluster_themes(_members(f), text_evidence(f), AS_OF_YEAR)
    mentions = F.aggregate(F.map_values("limitation_freq"), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("cluster", F.array_join("top_limitations", "|").alias("top_limitations"), F.array_join("top_future_work", "|").alias("top_future_work"), mentions.alias("limitation_mentions"))


@query(*EVIDENCE, "paper_labels", sql=f"""
WITH m AS ({_MEMBERS}), c AS (SELECT cluster, term, count(*) AS papers FROM evidence JOIN m USING (paper_id) WHERE kind IN ('method', 'dataset', 'metric', 'limitation') GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY papers DESC, term) AS place FROM c) WHERE place <= 5""")
def cluster_top_terms(f):
    return clusters.cluster_terms(_members(f), text_evidence(f, "method", "dataset", "metric", "limitation"))


@query("papers", "paper_labels", sql=f"""
WITH m AS (SELECT topic_id, CASE WHEN cluster = 9 THEN -1 ELSE cluster END AS cluster, year, e.embedding[1]::DOUBLE AS x, e.embedding[2]::DOUBLE AS y FROM ({_MEMBERS}) b JOIN embeddings e USING (vec_id))
SELECT topic_id, cluster, count(*) AS paper_count, round(avg(round(x, 4)), 4) AS x, round(avg(round(y, 4)), 4) AS y, min(year) AS first_year, max(year) AS last_year FROM m WHERE cluster >= 0 GROUP BY ALL""")
def cluster_dashboard(f):
    rows = _members(f).join(f.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")), "vec_id")
    return clusters.dashboard(rows.withColumn("cluster", F.when(F.col("cluster") == 9, -1).otherwise(F.col("cluster"))))


@query(*EVIDENCE, "gap_feedback", "paper_labels", sql=f"""
WITH m AS ({_MEMBERS}), g AS (SELECT CAST(label AS INT) AS cluster, vec_id AS gap_id, (vec_id * 37 % 101) / 101.0 AS confidence FROM embeddings), s AS (SELECT cluster, count(*) AS paper_count FROM m GROUP BY ALL),
b AS (SELECT cluster, arg_max(gap_id, (confidence, gap_id)) AS gap_id FROM g GROUP BY ALL)
SELECT s.cluster, s.paper_count, b.gap_id FROM s LEFT JOIN b USING (cluster)""")
def cluster_summaries(f):
    themes = patterns.cluster_themes(_members(f), text_evidence(f), AS_OF_YEAR)
    found = f.embeddings.select(F.col("label").alias("cluster"), F.col("vec_id").alias("gap_id"), ((F.col("vec_id") * 37 % 101) / 101.0).alias("confidence"))
    return clusters.summaries(themes, found).select("cluster", "paper_count", "gap_id")


@query(*EVIDENCE, "paper_labels", sql=f"""
WITH m AS ({_MEMBERS}), own AS (SELECT topic_id, cluster, count(*) AS papers, avg(CASE WHEN 2025 - year <= 2 THEN 1.0 WHEN 2025 - year <= 4 THEN 0.8 WHEN 2025 - year <= 6 THEN 0.6 ELSE 0.4 END) AS recency,
  avg(1 - least(greatest(citation_count, 0) / greatest(2025 - year, 1), 100) / 100) AS novelty FROM m GROUP BY ALL),
a AS (SELECT topic_id, sum(papers) AS all_papers FROM own GROUP BY ALL), k AS (SELECT m.topic_id, m.cluster, e.kind, e.term FROM evidence e JOIN m ON m.paper_id = e.paper_id WHERE e.kind IN ('limitation', 'future_work')),
t AS (SELECT topic_id, cluster, count(DISTINCT term) AS tokens, count(DISTINCT term) FILTER (kind = 'future_work') AS own_future FROM k GROUP BY ALL), u AS (SELECT topic_id, count(DISTINCT term) AS all_future FROM k WHERE kind = 'future_work' GROUP BY ALL)
SELECT topic_id, cluster, round(least(0.99, greatest(0.05, 0.35 * least(1.0, papers / all_papers * 1.5) + 0.25 * least(1.0, ln(1 + coalesce(tokens, 0)) / ln(11)) + 0.15 * recency
  + 0.15 * CASE WHEN coalesce(all_future, 0) = 0 THEN 0.5 ELSE coalesce(own_future / all_future, 0) END + 0.10 * novelty)), 6) AS score FROM own JOIN a USING (topic_id) LEFT JOIN t USING (topic_id, cluster) LEFT JOIN u USING (topic_id)""")
def cluster_gap_score(f):
    return rounded(clusters.cluster_gap_score(_members(f), text_evidence(f, "limitation", "future_work"), AS_OF_YEAR).select("topic_id", "cluster", "score"), "score")


@query("papers", "paper_labels", sql=f"SELECT topic_id, cluster, count(*) AS papers, row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, cluster) AS place, row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, cluster) <= 3 AS to_model FROM ({_MEMBERS}) GROUP BY topic_id, cluster")
def cluster_priority(f):
    return clusters.cluster_priority(_members(f), ["topic_id"], 3)


@query(*EVIDENCE, "paper_labels", sql=f"""
WITH m AS ({_MEMBERS}), c AS (SELECT m.topic_id, m.cluster, e.kind, e.term, count(*) AS n FROM evidence e JOIN m ON m.paper_id = e.paper_id WHERE e.kind IN ('limitation', 'future_work') GROUP BY ALL),
b AS (SELECT topic_id, cluster, arg_max(term, n) FILTER (rn = 1 AND kind = 'limitation') AS lim, arg_max(term, n) FILTER (rn = 1 AND kind = 'future_work') AS fw FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, cluster, kind ORDER BY n DESC, term) AS rn FROM c) GROUP BY ALL),
s AS (SELECT topic_id, cluster, count(*) AS papers FROM m GROUP BY ALL)
SELECT topic_id, cluster, 'Unresolved gap in ' || topic_id || ': ' || substring(coalesce(lim, 'unclear limitations'), 1, 60) AS title, coalesce(lim, 'unclear limitations') AS what_fails, coalesce(fw, 'unspecified future work') AS missing_piece,
  'Across ' || papers || ' papers in this cluster, a recurring limitation is ''' || coalesce(lim, 'unclear limitations') || '''. Authors frequently cite ''' || coalesce(fw, 'unspecified future work') || ''' as open future work.' AS description
FROM s LEFT JOIN b USING (topic_id, cluster)""")
def heuristic_gaps(f):
    return clusters.heuristic_gaps(_members(f), text_evidence(f, "limitation", "future_work")).select("topic_id", "cluster", "title", "what_fails", "missing_piece", "description")


@query("papers", "paper_labels", sql=f"SELECT g.vec_id AS gap_id, m.paper_id FROM (SELECT vec_id, label FROM embeddings WHERE vec_id % 100 = 0) g JOIN ({_MEMBERS}) m ON m.cluster = g.label")
def paper_gap_matrix(f):
    found = f.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("gap_id"), F.col("label").alias("cluster"))
    return clusters.paper_gap_matrix(_members(f), found)


@query("papers", sql="SELECT topic_id, count(*) AS papers, sum((year >= 2023)::INT)::BIGINT AS recent, sum((ln(1 + citation_count) / power(1 + 2025 - year, 0.7) >= 1)::INT)::BIGINT AS influential_by_weight, sum((citation_count > 10)::INT)::BIGINT AS influential_by_count FROM papers GROUP BY ALL")
def influential_counts(f):
    return clusters.influential_counts(f.papers, ["topic_id"], AS_OF_YEAR)


@query(sql="""
WITH m AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT label, pos::INT AS pos, round(avg(x::DOUBLE), 6) AS centre FROM m GROUP BY ALL""")
def cluster_centres(f):
    return f.embeddings.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("centre"))


@query()
def pca_coords(f):
    """Two principal components of all vectors (their signs are free)."""
    rows = clusters.pca_coordinates(f.embeddings.select("vec_id", "embedding"), 2)
    return rows.select("vec_id", *[F.round(F.col("coordinates")[i], 6).alias(n) for i, n in enumerate("xy")])


_POINTS = "SELECT label AS topic_id, vec_id AS item, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings"


@query(sql=f"""
WITH RECURSIVE p AS ({_POINTS}), links AS (SELECT p.topic_id, p.item AS a, q.item AS b FROM p JOIN p q ON p.topic_id = q.topic_id AND p.item <> q.item AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 0.02 * 0.02),
reach AS (SELECT DISTINCT topic_id, a AS item, a AS seen FROM links UNION SELECT r.topic_id, r.item, l.b FROM reach r JOIN links l ON l.topic_id = r.topic_id AND l.a = r.seen),
c AS (SELECT topic_id, item, min(seen) AS label FROM reach GROUP BY ALL), n AS (SELECT topic_id, label, row_number() OVER (PARTITION BY topic_id ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT topic_id, label FROM c))
SELECT p.topic_id, p.item, CASE WHEN max(n.cluster) OVER (PARTITION BY p.topic_id) IS NULL THEN 0 ELSE coalesce(n.cluster, -1) END AS cluster FROM p LEFT JOIN c USING (topic_id, item) LEFT JOIN n ON n.topic_id = p.topic_id AND n.label = c.label""")
def eps_clusters(f):
    """Density clusters of the vectors' first two components, within each label."""
    points = f.embeddings.select(F.col("label").cast("string").alias("topic_id"), F.col("vec_id").alias("item"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("coordinates"))
    return density.radius_clusters(points, 2, 0.02).withColumn("topic_id", F.col("topic_id").cast("int"))


def _paper_points(f, dims):
    """Papers of all topics with the principal components of their vectors."""
    places = clusters.pca_coordinates(f.embeddings.select("vec_id", "embedding"), dims)
    papers = f.papers.select("topic_id", "external_id", "title", "year").join(f.paper_labels.select("external_id", "vec_id"), "external_id")
    return papers.join(places, "vec_id").withColumnRenamed("external_id", "item")


@query()
def adaptive_clusters(f):
    """Each topic's papers in density clusters of their five principal components, a tenth of the topic at least; tested by force."""
    return density.adaptive_clusters(_paper_points(f, 5).select("topic_id", "item", "coordinates"), 5)


@query()
def fine_clusters(f):
    """The same with clusters of three papers or more, told by theme and trend."""
    points = _paper_points(f, 5)
    found = density.adaptive_clusters(points.select("topic_id", "item", "coordinates"), 5, share=0.0)
    members = found.join(points.select("item", "title", "year"), "item").filter("cluster >= 0")
    members = members.select(F.concat_ws("/", "topic_id", "cluster").alias("cluster"), F.col("item").alias("paper_id"), "title", "year")
    rows = patterns.cluster_themes(members, text_evidence(f, "limitation", "future_work"), AS_OF_YEAR)
    return rows.select("cluster", "theme", "paper_count", "trend", F.array_join("top_limitations", "|").alias("top_limitations"))


_COSINE = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"
_PAIRS = f"""v AS (SELECT vec_id, embedding AS e FROM embeddings), z AS (SELECT count(*) AS z FROM embeddings), c AS (
  SELECT gap_id, n, {_COSINE.format("a.e", "b.e")} AS s FROM gap_claims CROSS JOIN z JOIN v a ON a.vec_id = (gap_id * 31 + n) % z JOIN v b ON b.vec_id = (gap_id + n * 17) % z)"""


def _claim_pairs(f):
    v = f.embeddings.select("vec_id", "embedding")
    claims = f.gap_claims.crossJoin(F.broadcast(v.agg(F.count("*").alias("z"))))  # one row
    claims = claims.withColumns({"a": F.expr("(gap_id * 31 + n) % z"), "b": F.expr("(gap_id + n * 17) % z")})
    return claims.join(v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("vector_a")), "a").join(v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vector_b")), "b")


@query("gap_claims", sql=f"""
WITH {_PAIRS}
SELECT gap_id, round(avg(s), 6) AS score, count(*) AS claims, CASE WHEN avg(s) >= 0.30 THEN 'grounded' WHEN avg(s) >= 0.18 THEN 'weakly_supported' ELSE 'hallucinated' END AS status FROM c GROUP BY gap_id""")
def gap_grounding(f):
    return rounded(vectors.grounding(_claim_pairs(f)), "score")


@query("gap_claims", sql=f"""
WITH {_PAIRS}, p AS (SELECT gap_id, n, avg(s) AS s FROM c GROUP BY ALL), g AS (SELECT gap_id, count(*) AS cited, max(n) AS most FROM gap_claims GROUP BY gap_id),
m AS (SELECT gap_id, count(*) FILTER (s < 0.18) AS bad, count(*) FILTER (s >= 0.18 AND s < 0.30) AS weak, count(*) FILTER (s >= 0.30) AS good FROM p WHERE n <= 5 GROUP BY gap_id)
SELECT gap_id, CASE WHEN coalesce(bad, 0) > 0 THEN 'hallucinated' WHEN most > 5 THEN 'needs_review' WHEN coalesce(weak, 0) > 0 AND coalesce(good, 0) = 0 THEN 'weakly_supported' ELSE 'grounded' END AS status,
  coalesce(bad, 0) AS hallucinated, (SELECT count(DISTINCT n) FROM gap_claims i WHERE i.gap_id = g.gap_id AND i.n > 5) AS invalid FROM g LEFT JOIN m USING (gap_id)""")
def grounding_status(f):
    """Claims of a conversation as one gap text, with five citations attached to each."""
    texts = f.gap_claims.groupBy("gap_id").agg(F.array_join(F.collect_list("sentence"), " ").alias("text"))
    cites = texts.select("gap_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"), F.lit(1).alias("evidence_count"))
    scores = grounding.citation_scores(_claim_pairs(f).select("gap_id", F.col("n").cast("int").alias("n"), "vector_a", "vector_b"))
    marks = f.gap_claims.groupBy("gap_id").agg(F.sort_array(F.collect_set(F.col("n").cast("int"))).alias("numbers"))
    texts = texts.join(marks, "gap_id").select("gap_id", F.array_join(F.transform("numbers", lambda n: F.concat(F.lit("claim ["), n.cast("string"), F.lit("]."))), " ").alias("text"))
    rows = grounding.statuses(texts, scores, cites)
    return rows.select("gap_id", "status", F.size("hallucinated").cast("long").alias("hallucinated"), F.size("invalid").cast("long").alias("invalid"))


@query("gap_claims", sql="SELECT gap_id, n, count(*) AS claims FROM gap_claims WHERE length(regexp_replace(sentence, '\\[\\d+\\]', '', 'g')) > 15 GROUP BY ALL")
def cited_claims(f):
    """Sentences with the numbers they cite; each row of the table is one sentence."""
    texts = f.gap_claims.select(F.struct("gap_id", "n").alias("gap_id"), F.regexp_replace("sentence", r"[.!?]\s+", "; ").alias("text"))
    return grounding.claims(texts).groupBy("gap_id.gap_id", F.col("n").cast("long").alias("n")).agg(F.count("*").alias("claims"))


@query(sql=f"""
WITH p AS (
  SELECT a.vec_id AS q, b.vec_id, {_COSINE.format("a.embedding", "b.embedding")} AS s FROM embeddings a JOIN embeddings b ON b.label = a.label AND b.vec_id <> a.vec_id WHERE a.vec_id % 5 = 0)
SELECT q AS gap, vec_id, round(s, 6) AS similarity, s > 0.30 AS addressed, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, vec_id) AS place FROM p) WHERE place <= 3""")
def cross_paper_check(f):
    e = f.embeddings.select("label", "vec_id", F.col("embedding").alias("vector"))
    rows = pivots.top_k(e.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query"), e.withColumnRenamed("vec_id", "item"), 3, ("label",))
    return rows.select(F.col("query").alias("gap"), F.col("item").alias("vec_id"), F.round("similarity", 6).alias("similarity"), (F.col("similarity") > 0.30).alias("addressed"), "place")


@query(sql=f"""
WITH p AS (SELECT a.vec_id AS q, b.vec_id AS item, {_COSINE.format("a.embedding", "b.embedding")} AS s FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0)
SELECT q AS query, item, round(s, 6) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, item) AS place FROM p) WHERE place <= 10""")
def vector_topk(f):
    e = f.embeddings.select("vec_id", F.col("embedding").alias("vector"))
    rows = pivots.top_k(e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query"), e.withColumnRenamed("vec_id", "item"), 10)
    return rows.select("query", "item", F.round("similarity", 6).alias("similarity"), "place")


@query(sql=f"""
WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COSINE.format("a.embedding", "b.embedding")} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT a, b, round(s, 6) AS similarity FROM p WHERE s > 0.30""")
def near_duplicate_pairs(f):
    """All pairs of vectors with cosine above .3; blocks that pivots hold too far apart don't meet."""
    return rounded(pivots.similar_pairs(f.embeddings.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), 0.30), "similarity")


@query("papers", sql="""
SELECT external_id, md5(t) AS fingerprint, length(t) AS chars FROM (SELECT external_id, trim(concat_ws('. ', nullif(title, ''), nullif(abstract, '')), ' .') AS t FROM papers)""")
def text_fingerprints(f):
    text = T.short_text(F.col("title"), F.col("abstract"))
    return f.papers.select("external_id", T.fingerprint(text).alias("fingerprint"), F.length(text).cast("long").alias("chars"))


@query("papers")
def embedding_texts(f):
    """The text that each paper's vector is made from."""
    rows = evidence.normalized(evidence.extract(f.papers, LEXICON))
    text = T.embedding_text(F.col("abstract"), F.col("title"), F.filter(F.array("normalized_method"), lambda m: m != ""), F.col("normalized_limitations"), F.col("normalized_future_work"))
    return rows.select("external_id", text.alias("text"))


_MODEL_GAPS = f"""
m AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY citation_count DESC, paper_id) AS place FROM ({_MEMBERS})),
o AS (SELECT gap_id, cluster, CASE WHEN contains(raw, '{{') THEN replace(raw, '}} and so on', '}}') END AS j FROM model_outputs),
g AS (SELECT gap_id, cluster, coalesce(json_extract_string(j, '$.description'), '') AS d, json_extract_string(j, '$.what_fails') AS f, coalesce(nullif(json_extract_string(j, '$.why_it_exists'), 'null'), '') AS y, try_cast(json_extract_string(j, '$.confidence_score') AS DOUBLE) AS conf FROM o WHERE j IS NOT NULL),
k AS (SELECT cluster, count(*) AS papers, count(*) * 0.5 + sum(w) * 0.3 + sum((r >= 1.0)::INT) * 0.2 AS support, count(*) * 0.4 + sum((w >= 1.0)::INT) * 0.4 + sum((r >= 1.0)::INT) * 0.2 AS cite, avg(r) * 1.2 + sum((coalesce(citation_count, 0) < 50)::INT) / count(*) * 0.8 AS novelty
  FROM (SELECT *, ln(1 + greatest(coalesce(citation_count, 0), 0)) / power(1 + CASE WHEN year IS NOT NULL AND year <> 0 THEN greatest(2025 - year, 0) ELSE 5 END, 0.7) AS w,
    CASE WHEN year IS NULL OR year = 0 THEN 0.5 WHEN greatest(2025 - year, 0) <= 2 THEN 1.0 WHEN 2025 - year <= 4 THEN 0.8 WHEN 2025 - year <= 6 THEN 0.6 ELSE 0.4 END AS r FROM m) GROUP BY cluster),
e AS (SELECT m.cluster, m.paper_id, m.place, v.kind, v.term FROM evidence v JOIN m USING (paper_id)),
x AS (SELECT cluster, max((kind IN ('limitation', 'future_work', 'assumption', 'metric') AND regexp_matches(lower(term), 'robust|scal|deploy|partial_observability|safety|transfer'))::INT) AS urgent,
  max((kind = 'metric')::INT) + 0.8 * max((kind = 'dataset')::INT) + 0.8 * max((kind = 'baseline')::INT) + 0.8 * max((kind = 'assumption')::INT) + 0.6 * max((kind = 'future_work')::INT) AS had FROM e GROUP BY cluster),
q AS (SELECT gap_id, cluster, papers, conf, d, f, y, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(d || ' ' || f || ' ' || y, '\\[(\\d+)\\]', 1), lambda n: n::INT), lambda n: n >= 1 AND n <= papers))) AS named FROM g JOIN k USING (cluster)),
b AS (SELECT q.*, CASE WHEN len(named) > 0 THEN named ELSE list_filter([1, 2], lambda n: n <= q.papers) END AS positions, f || ' A proof' AS text,
  round(least(0.99, greatest(0.1, 1 / (1 + exp(-0.5 * (support * 0.30 + (1.8 + 1.5 * coalesce(urgent, 0)) * 0.20 + (1.6 + coalesce(had, 0)) * 0.20 + novelty * 0.15 + cite * (0.7 + 0.3 * len(named) / q.papers) * 0.15 - 2.5))))), 2) AS base FROM q JOIN k USING (cluster) LEFT JOIN x USING (cluster)),
z AS (SELECT count(*) AS z FROM embeddings),
s AS (SELECT b.gap_id, m.paper_id, list_cosine_similarity(a.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS s FROM b CROSS JOIN z JOIN embeddings a ON a.vec_id = b.gap_id % z.z JOIN m ON m.cluster = b.cluster JOIN embeddings p ON p.vec_id = m.vec_id),
t AS (SELECT gap_id, count(*) AS conflicts FROM s WHERE s > 0.30 GROUP BY gap_id),
c AS (SELECT gap_id, unnest(positions) AS pos, generate_subscripts(positions, 1) AS n, cluster FROM b),
r AS (SELECT c.gap_id, c.n, m.paper_id, m.vec_id, (SELECT least(count(DISTINCT term) FILTER (kind = 'limitation'), 2) + least(count(DISTINCT term) FILTER (kind = 'future_work'), 2) FROM e WHERE e.paper_id = m.paper_id) AS pieces FROM c JOIN m ON m.cluster = c.cluster AND m.place = c.pos),
h AS (SELECT r.gap_id, r.n, list_cosine_similarity(a.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS s FROM r CROSS JOIN z JOIN embeddings a ON a.vec_id = (r.gap_id * 31 + r.n) % z.z JOIN embeddings p ON p.vec_id = r.vec_id),
u AS (SELECT gap_id, count(*) FILTER (s < 0.18) AS bad, count(*) FILTER (s >= 0.18 AND s < 0.30) AS weak, count(*) FILTER (s >= 0.30) AS good FROM h GROUP BY gap_id),
p AS (SELECT gap_id, sum(pieces)::BIGINT AS evidence FROM r GROUP BY gap_id),
w AS (SELECT b.gap_id, b.cluster, array_to_string(positions, ',') AS positions, base, CASE WHEN base < 0.3 THEN 'validated' WHEN length(': ' || text) < 20 THEN 'unvalidated' WHEN t.conflicts > 0 THEN 'potentially_addressed' ELSE 'validated' END AS "check",
  round(0.6 * base + 0.4 * coalesce(conf, base), 2) AS blend, CASE WHEN u.bad > 0 THEN 'hallucinated' WHEN coalesce(p.evidence, 0) = 0 THEN 'needs_review' WHEN u.weak > 0 AND u.good = 0 THEN 'weakly_supported' ELSE 'grounded' END AS status, coalesce(p.evidence, 0) AS evidence
  FROM b LEFT JOIN t USING (gap_id) LEFT JOIN u USING (gap_id) LEFT JOIN p USING (gap_id)),
scored AS (SELECT gap_id, cluster, positions, round(base, 2) AS base, CASE WHEN "check" = 'potentially_addressed' THEN round(blend * 0.85, 2) ELSE blend END AS confidence, "check", status, evidence FROM w)"""
_SCORED = (*EVIDENCE, "paper_labels", "model_outputs")


def _model_gaps(f):
    """The answers of a text model about clusters (labels), scored and grounded; vectors stand for those of the texts by id."""
    members = model_gaps.with_places(_members(f).select("cluster", "paper_id", "year", "citation_count", "vec_id"), [F.desc("citation_count"), "paper_id"])
    v = f.embeddings.select("vec_id", F.col("embedding").alias("vector"))
    of_id = lambda rows, number: rows.crossJoin(F.broadcast(v.agg(F.count("*").alias("z")))).withColumn("vec_id", F.expr(f"({number}) % z")).join(v, "vec_id")  # noqa: E731  one row
    papers = members.select("paper_id", "vec_id").join(v, "vec_id").select("paper_id", "vector")
    encode = lambda claims: of_id(claims, "gap_id * 31 + n").withColumnRenamed("vector", "vector_a")
    evidence_of = text_evidence(f).select("paper_id", "kind", "term")
    return model_gaps.scored(f.model_outputs, members.drop("vec_id"), evidence_of, AS_OF_YEAR, encode, of_id(f.model_outputs.select("gap_id"), "gap_id").select("gap_id", "vector"), papers, 0.30)


@query(*_SCORED, sql=f"WITH {_MODEL_GAPS} SELECT * FROM scored")
def model_gap_scores(f):
    """From landed model answers to citations, confidence, check and grounding."""
    return _model_gaps(f).select("gap_id", "cluster", F.array_join("positions", ",").alias("positions"), "base", "confidence", "check", "status", F.col("evidence").cast("long").alias("evidence"))


@query(*_SCORED, sql=f"""
WITH {_MODEL_GAPS}
SELECT cluster, count(*) AS n, round(avg((status IN ('grounded', 'weakly_supported'))::INT), 6) AS grounded, round(avg((status = 'hallucinated')::INT), 6) AS hallucinated, round(avg((("check" = 'potentially_addressed') = (gap_id % 3 = 0))::INT), 6) AS check_accuracy FROM scored GROUP BY cluster""")
def grounding_rates(f):
    """Shares of grounded and of hallucinated gaps a cluster, and how often the check says what is known of a gap (every third is addressed)."""
    rows = _model_gaps(f)
    right = (F.col("check") == "potentially_addressed") == (F.col("gap_id") % 3 == 0)
    found = usage.rates(rows, ["cluster"], grounded=F.col("is_grounded"), hallucinated=F.col("status") == "hallucinated", check_accuracy=right)
    return rounded(found, "grounded", "hallucinated", "check_accuracy")


@query(*_PROFILE, sql="""
WITH l AS (SELECT topic_id, string_agg(title, '; ' ORDER BY place) FILTER (title <> '') AS examples FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY coalesce(citation_count, 0) DESC, coalesce(year, 0) DESC, external_id) AS place FROM papers) WHERE place <= 3 GROUP BY topic_id)
SELECT topic_id, 'That makes it hard to tell whether the gains reflect genuine progress or just wins against weak comparison points. This pattern shows up across papers like ' || coalesce(examples, '') || '.' AS why_it_matters,
  'The retrieved literature does not compare methods against a convincing spread of strong baselines. Most papers only report results against ' || replace(coalesce(baseline, 'sparse baselines'), '_', ' ') || ', while alternatives such as ' ||
  CASE len(missing_baselines) WHEN 1 THEN missing_baselines[1] WHEN 2 THEN missing_baselines[1] || ' and ' || missing_baselines[2] ELSE missing_baselines[1] || ', ' || missing_baselines[2] || ', and ' || missing_baselines[3] END || ' are usually absent.' AS statement
FROM profile JOIN l USING (topic_id) WHERE baselines <= 1 AND papers >= 3""")
def baseline_gap_texts(f):
    """Why weak baselines matter, with the leading papers of the topic as examples."""
    terms = _terms(f, "metric", "dataset", "baseline")
    rows = gaps.scored(gaps.candidates(terms, _topics(f))).filter("kind = 'baseline'")
    return gaps.described(rows, gaps.leading_titles(f.papers)).select("topic_id", "why_it_matters", "statement")
