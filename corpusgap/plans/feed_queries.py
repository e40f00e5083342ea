"""Queries over interests, affinities and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import settled
from ..operators import corpus, feeds, matching, profiles, vectors
from .catalog import _list, POOL, query, rounded
from .fixtures import AS_OF, AS_OF_YEAR

_AGE = f"(epoch(TIMESTAMP '{AS_OF}') - floor(epoch({{}}))) / 86400.0"


@query("interactions", "signals", sql="SELECT user_id, external_id, kind, round(weight, 9) AS weight, count(*) AS n FROM signals GROUP BY ALL")
def interaction_signals(f):
    rows = profiles.interaction_signals(f.interactions, AS_OF)
    return rows.groupBy("user_id", "external_id", "kind", F.round("weight", 9).alias("weight")).agg(F.count("*").alias("n"))


_SEARCHES = f"SELECT user_id, search_id, topic, item_id, exp(-{_AGE.format('created_at')} / 14.0) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, search_id) AS rn FROM search_history WHERE {_AGE.format('created_at')} BETWEEN 0 AND 30) WHERE rn <= 50"
_FEEDBACK = """SELECT user_id, gap_id, CASE WHEN pursue OR vote = 'up' THEN 1.0 WHEN vote = 'down' THEN -0.6 ELSE 0.0 END AS weight, updated_at FROM (
  SELECT user_id, gap_id, arg_max(vote, (updated_at, event_id)) FILTER (vote IS NOT NULL) AS vote, arg_max(pursue, (updated_at, event_id)) AS pursue, max(updated_at) AS updated_at FROM gap_feedback GROUP BY ALL)"""
_COMPONENTS = f"""searches AS ({_SEARCHES}), marks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, gap_id) AS rn FROM ({_FEEDBACK})) WHERE rn <= 50 AND weight <> 0),
components AS (
  SELECT s.user_id, 'seed' AS kind, s.topic AS label, 0.5 * greatest(0.0, 1 - coalesce(c.n, 0) / 5.0) AS weight FROM seed_topics s LEFT JOIN (SELECT user_id, count(*) AS n FROM searches GROUP BY ALL) c USING (user_id)
  UNION ALL SELECT user_id, 'search', topic, weight FROM searches
  UNION ALL SELECT user_id, CASE WHEN weight > 0 THEN 'gap_positive' ELSE 'gap_negative' END, gap_id, weight FROM marks
  UNION ALL SELECT user_id, CASE WHEN weight > 0 THEN 'interaction_positive' ELSE 'interaction_negative' END, external_id, weight FROM signals)"""
_INPUTS = ("interactions", "search_history", "seed_topics", "gap_feedback", "signals")


def _components(f):
    searches = profiles.search_signals(f.search_history, AS_OF).withColumn("item", F.col("item_id").cast("string"))
    gaps = profiles.gap_signals(profiles.feedback_state(f.gap_feedback)).withColumn("item", F.col("gap_id"))
    seeds = f.seed_topics.withColumn("item", F.col("vec").cast("string"))
    return profiles.profile_components(seeds, searches, gaps, profiles.interaction_signals(f.interactions, AS_OF))


@query(*_INPUTS, sql=f"WITH {_COMPONENTS} SELECT user_id, kind, count(*) AS n, round(sum(weight), 6) AS weight FROM components WHERE weight <> 0 GROUP BY ALL")
def profile_components(f):
    return rounded(_components(f).groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), "weight")


@query(*_INPUTS, sql=f"WITH {_COMPONENTS} SELECT user_id, kind, count(*) AS n FROM components WHERE weight <> 0 GROUP BY ALL")
def component_counts(f):
    return profiles.component_counts(_components(f)).select("user_id", F.explode("kinds").alias("kind", "n"))


@query(*_INPUTS, sql=f"""WITH {_COMPONENTS}, l AS (SELECT user_id, lower(trim(label)) AS label, max(weight) AS weight FROM components WHERE weight > 0 GROUP BY ALL)
SELECT user_id, label, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, label) AS place FROM l) WHERE place <= 5""")
def top_interests(f):
    return profiles.top_labels(_components(f)).select("user_id", F.lower(F.btrim("label")).alias("label"), "place")


@query("interactions", "signals", "paper_vectors", sql="""
WITH l AS (SELECT user_id, weight, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM signals JOIN paper_vectors USING (external_id)),
s AS (SELECT user_id, pos, sum(weight * x) / sum(abs(weight)) AS x FROM l GROUP BY ALL)
SELECT user_id, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY user_id)), 5) AS x FROM s""")
def profile_vectors(f):
    rows = vectors.profile_vectors(profiles.interaction_signals(f.interactions, AS_OF), f.paper_vectors)
    return rows.select("user_id", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 5))


def _names(f):
    return f.paper_authors.groupBy("external_id").agg(F.collect_list("author").alias("authors"))


def _library(f):
    return f.library.join(_names(f), "external_id")


def _authors(f):
    return profiles.author_affinity(_library(f), AS_OF)


def _venues(f):
    return profiles.venue_affinity(f.library, f.search_history, AS_OF)


@query("library", "paper_authors", "library_age", "author_weights", sql="SELECT user_id, author, round(weight, 6) AS weight FROM author_weights")
def affinity(f):
    return rounded(_authors(f), "weight")


@query("library", "search_history", "library_age", "venue_weights", sql="SELECT user_id, venue, round(weight, 6) AS weight FROM venue_weights")
def venue_affinity(f):
    return rounded(_venues(f), "weight")


def _seen(f):
    return profiles.seen_ids(f.interactions, AS_OF)


def _pool(f, authors=False):
    """Each user's candidates; with ``authors`` they carry what affinities are worked out from."""
    recent = f.search_history.groupBy("user_id", "item_id").agg(F.max("created_at").alias("created_at"))
    recent = corpus.cursor_page(recent, ["user_id"], [F.desc("created_at"), "item_id"], 0, 3).select("user_id", F.col("item_id").alias("topic"), "place")
    # Of an abstract a candidate only needs whether there is one; the pool is worked out once for all that reads it.
    papers = f.papers.drop("topic_id").withColumn("abstract", F.substring("abstract", 1, 1))
    landed = f.topic_papers.select(F.col("item_id").alias("topic"), "external_id").join(papers, "external_id")
    kept = ["user_id", "external_id", "year", "citation_count"]
    if authors:
        landed, kept = landed.join(_names(f), "external_id"), [*kept, "venue", "authors"]
    return settled(feeds.without_seen(feeds.topic_candidates(recent, landed).select(*kept), _seen(f)))


@query(*POOL, sql="SELECT user_id, external_id, year, citation_count FROM candidates")
def topic_candidates(f):
    return _pool(f).select("user_id", "external_id", "year", "citation_count")


_AFFINE = (*POOL[:4], "library", "paper_authors", *POOL[4:], "library_age", "author_weights", "venue_weights", "candidate_affinity")


def _affinities(f, pool):
    return profiles.affinity_scores(pool, _authors(f), _venues(f))


@query(*_AFFINE, sql="SELECT user_id, external_id, round(score, 6) AS score FROM candidate_affinity")
def affinity_scores(f):
    return rounded(_affinities(f, _pool(f, True)), "score")


_RANKED = f"""top AS (SELECT * FROM (SELECT s.user_id, s.external_id AS label, s.weight, v.embedding, row_number() OVER (PARTITION BY s.user_id ORDER BY round(s.weight, 9) DESC, s.external_id) AS rn FROM signals s JOIN paper_vectors v USING (external_id) WHERE s.weight > 0) WHERE rn <= 5),
sims AS (SELECT c.user_id, c.external_id, c.year, c.citation_count, greatest(0.0, max(list_cosine_similarity(v.embedding::DOUBLE[], t.embedding::DOUBLE[]))) AS similarity FROM candidates c JOIN paper_vectors v USING (external_id) JOIN top t USING (user_id) GROUP BY ALL),
scored AS (SELECT s.*, 0.65 * similarity + 0.15 * least(greatest((year - 2020) / 5.0, 0), 1) + 0.10 * least(log10(1 + greatest(citation_count, 0)) / 4, 1) + 0.10 * coalesce(a.score, 0) AS score FROM sims s LEFT JOIN candidate_affinity a ON a.user_id = s.user_id AND a.external_id = s.external_id)"""
_FEED = (*_AFFINE, "signals", "paper_vectors")


def _queries(f):
    """The strongest interactions with their vectors; the centroid has its own list in ``interleave_feed``."""
    rows = profiles.interaction_signals(f.interactions, AS_OF).join(f.paper_vectors, "external_id")
    rows = rows.select("user_id", F.col("external_id").alias("label"), "weight", F.col("embedding").alias("vector"))
    return rows, feeds.profile_queries(rows, rows.select("user_id", "vector").limit(0))


def _ranked(f, page):
    pool = _pool(f, True)
    return feeds.ranked_by_similarity(pool.drop("venue", "authors").join(f.paper_vectors, "external_id"), _queries(f)[1], _affinities(f, pool), AS_OF_YEAR, page)


@query(*_FEED, sql=f"WITH {_RANKED} SELECT user_id, external_id, round(similarity, 6) AS similarity, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, external_id) AS place FROM scored) WHERE place <= 20")
def rank_by_similarity(f):
    return rounded(_ranked(f, 20).select("user_id", "external_id", "similarity", "score", "place"), "similarity", "score")


@query()
def reasoned_feed(f):
    """The ranked page with the reason for each paper."""
    parts = _components(f).select("user_id", "label", "kind")
    return feeds.with_reasons(_ranked(f, 10), parts).select("user_id", "external_id", "place", "label", "reason")


@query()
def mmr_feed(f):
    """Each user's page by maximal marginal relevance."""
    rows = _ranked(f, feeds.MMR_PAGES * 10).join(f.paper_vectors, "external_id")
    return feeds.diversified(rows, 10)


@query()
def interleave_feed(f):
    """One list for each of a user's strongest interests and the centroid, interleaved by weight."""
    parts, _ = _queries(f)
    centroids = vectors.profile_vectors(parts.select("user_id", F.col("label").alias("external_id"), "weight"), f.paper_vectors)
    asked = feeds.profile_queries(parts.withColumn("vector", F.transform("vector", lambda x: x.cast("double"))), centroids)
    asked = asked.withColumn("list", F.coalesce("label", F.lit("~")))
    pool = _pool(f).select("user_id", "external_id").join(f.paper_vectors, "external_id")
    from ..functions.scores import cosine

    rows = pool.join(asked, "user_id").withColumn("s", cosine(F.col("embedding"), F.col("vector")))
    ranked = corpus.cursor_page(rows, ["user_id", "list"], [F.desc(F.round("s", 9)), "external_id"], 0, 40)
    return feeds.interleave(ranked.withColumn("rank", F.col("place")), 40)


@query("papers", sql="""
WITH s AS (SELECT *, 0.55 * least(greatest((year - 2020) / 5.0, 0), 1) + 0.45 * least(log10(1 + greatest(citation_count, 0)) / 4, 1) AS score FROM papers),
v AS (SELECT *, row_number() OVER (PARTITION BY topic_id, coalesce(venue, '') ORDER BY round(score, 9) DESC, pos) AS in_venue FROM s)
SELECT topic_id, external_id, place, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY (in_venue <= 3) DESC, round(score, 9) DESC, pos) AS place FROM v) WHERE place <= 20""")
def popular_feed(f):
    return rounded(profiles.popular(f.papers, AS_OF_YEAR, 20).select("topic_id", "external_id", "place", "score"), "score")


@query("papers", sql="SELECT external_id, place FROM (SELECT external_id, row_number() OVER (ORDER BY (citation_count <= 0), CASE WHEN citation_count > 0 THEN citation_count END DESC, year DESC, external_id) AS place FROM (SELECT external_id, coalesce(citation_count, 0) AS citation_count, CASE WHEN citation_count > 0 THEN 0 ELSE year END AS year FROM papers)) WHERE place <= 30")
def highly_cited(f):
    rows = f.papers.select("external_id", "citation_count", "year")
    return feeds.highly_cited(rows, 30).select("external_id", "place")


@query("interactions", sql=f"SELECT user_id, external_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, external_id) AS rn FROM (SELECT user_id, external_id, max(ts) AS ts FROM interactions WHERE {_AGE.format('ts')} BETWEEN 0 AND 21 GROUP BY ALL)) WHERE rn <= 30")
def seen_sets(f):
    return _seen(f)


@query("interactions", sql="SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, external_id) AS rn FROM interactions) WHERE rn <= 25")
def compacted_impressions(f):
    return profiles.compacted_log(f.interactions, 25).select("user_id", "event_id")


@query("interactions", sql="SELECT user_id, newest FROM (SELECT user_id, max(ts) AS newest, max(ts) FILTER (ts < TIMESTAMP '2024-01-20') AS built FROM interactions GROUP BY ALL) WHERE built IS NULL OR newest > built")
def stale_profiles(f):
    built = f.interactions.filter("ts < TIMESTAMP '2024-01-20'").groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    return profiles.stale_profiles(built, f.interactions.select("user_id", "ts"))


@query("search_history", sql="SELECT user_id, topic, created_at, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, topic) AS place FROM (SELECT user_id, lower(topic) AS topic, max(created_at) AS created_at FROM search_history GROUP BY ALL)) WHERE place <= 5")
def recent_topics(f):
    return profiles.recent_topics(f.search_history)


@query("gap_feedback", sql="""
WITH s AS (SELECT user_id, gap_id, arg_max(vote, (updated_at, event_id)) FILTER (vote IS NOT NULL) AS vote, arg_max(pursue, (updated_at, event_id)) AS pursue, max(updated_at) AS updated_at FROM gap_feedback GROUP BY ALL)
SELECT *, CASE WHEN pursue OR vote = 'up' THEN 1.0 WHEN vote = 'down' THEN -0.6 ELSE 0.0 END AS weight FROM s""")
def feedback_state(f):
    return profiles.feedback_state(f.gap_feedback)


_STOP = ("the", "of", "and", "der", "die", "und", "los", "les", "est")


@query("papers", sql=f"""WITH texts AS (
  SELECT 'paper' AS kind, external_id AS id, abstract AS text FROM papers
  UNION ALL SELECT 'topic', item_id::VARCHAR, text FROM benchmark
), words AS (
  SELECT kind, id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_list(_STOP)}, w)) AS words FROM texts
), terms AS (
  SELECT kind, id, unnest(words) AS term FROM words
  UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM words
), counts AS (
  SELECT kind, id, term, count(*) AS tf FROM terms GROUP BY ALL
), idf AS (
  SELECT term, ln((1 + (SELECT count(*) FROM texts)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY term
), weights AS (
  SELECT kind, id, term, tf * idf AS w FROM counts JOIN idf USING (term)
), units AS (
  SELECT kind, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY kind, id)) AS w FROM weights
), cosines AS (
  SELECT p.id, t.id::BIGINT AS topic, sum(p.w * t.w) AS cosine FROM units p JOIN units t ON p.term = t.term AND p.kind = 'paper' AND t.kind = 'topic' GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, topic) AS place FROM cosines
)
SELECT id AS external_id, round(sum(cosine), 4) AS score, max(topic) FILTER (place = 1) AS best_topic FROM ranked GROUP BY id""")
def tfidf_feed(f):
    """Papers against all benchmark passages as topics."""
    rows = matching.tfidf_match(f.papers.select("external_id", F.col("abstract").alias("text")), f.benchmark.select(F.col("item_id").alias("topic_no"), "text"), _STOP)
    return rounded(rows, "score", places=4)


_USERS = "SELECT DISTINCT user_id FROM events"
_MATCHED = "matched AS (SELECT c.user_id, c.external_id, c.citation_count / 1000.0 AS score FROM candidates c WHERE c.user_id % 3 <> 0)"
_CITED = "cited AS (SELECT external_id, row_number() OVER (ORDER BY citation_count DESC, external_id) AS nth FROM papers WHERE citation_count > 0 ORDER BY nth LIMIT 60)"


@query(*POOL, sql=f"""
WITH {_MATCHED}, {_CITED}, own AS (SELECT * FROM (SELECT user_id, external_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, external_id) AS place FROM matched) WHERE place <= 10),
rest AS (SELECT user_id, external_id, row_number() OVER (PARTITION BY user_id ORDER BY nth) AS place FROM ({_USERS}) u CROSS JOIN cited WHERE user_id NOT IN (SELECT user_id FROM own) AND (user_id, external_id) NOT IN (SELECT (user_id, external_id) FROM seen))
SELECT user_id, external_id, place, 'tfidf' AS approach FROM own UNION ALL
SELECT user_id, external_id, place, CASE WHEN user_id IN (SELECT user_id FROM search_history) THEN 'highly_cited_fallback' ELSE 'highly_cited' END FROM rest WHERE place <= 10""")
def recommend_chain(f):
    """The strategy of each user: matches, or highly cited papers (users whose number is a multiple of three have no matches here)."""
    users = f.events.select("user_id").distinct()
    matched = _pool(f).filter("user_id % 3 <> 0").select("user_id", "external_id", (F.col("citation_count") / 1000.0).alias("score"))
    cited = feeds.highly_cited(f.papers.select("external_id", "citation_count", "year"), 60).select("external_id", "place")
    return feeds.feed_chain(users, matched, cited, f.search_history.select("user_id").distinct(), _seen(f), 10)


@query()
def vector_feed(f):
    """The ranked page, filled from fresh papers where thin; the popular page for users without either."""
    ranked = settled(_ranked(f, 10).select("user_id", "external_id", "place", "score"))  # read three times
    popular = corpus.cursor_page(profiles.popular(f.papers, AS_OF_YEAR, 10).drop("place"), [], [F.desc(F.round("score", 9)), "pos"], 0, 10)
    return feeds.vector_feed(f.events.select("user_id").distinct(), ranked.filter("user_id % 2 = 0"), ranked.filter("user_id % 4 = 1"), popular.select("external_id", "place"), 10)


@query(*_INPUTS, "papers", "seen", sql=f"WITH {_COMPONENTS} SELECT (SELECT count(*) FROM papers) AS papers, (SELECT count(*) FROM embeddings) AS embedded, (SELECT min(len(embedding)) FROM embeddings) AS least_dims, (SELECT max(len(embedding)) FROM embeddings) AS most_dims, count(DISTINCT user_id) AS profiles, count(*) AS components, (SELECT count(*) FROM seen) AS seen FROM components WHERE weight <> 0")
def feed_diagnostics(f):
    return profiles.diagnostics(f.papers, f.embeddings, _components(f), _seen(f))


@query(*_INPUTS, sql=f"""
WITH {_COMPONENTS}, l AS (SELECT user_id, lower(trim(label)) AS label, max(weight) AS weight FROM components WHERE weight > 0 GROUP BY ALL),
t AS (SELECT user_id, string_agg(label, '|' ORDER BY place) AS top_topics FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, label) AS place FROM l) WHERE place <= 5 GROUP BY user_id),
c AS (SELECT user_id, string_agg(kind || '=' || n, '|' ORDER BY kind) AS counts FROM (SELECT user_id, kind, count(*) AS n FROM components WHERE weight <> 0 GROUP BY ALL) GROUP BY user_id),
u AS (SELECT user_id, max(ts) AS updated_at FROM interactions GROUP BY user_id), s AS (SELECT user_id, string_agg(DISTINCT topic, '|' ORDER BY topic) AS seed_topics FROM seed_topics GROUP BY user_id)
SELECT a.user_id, coalesce(t.top_topics, '') AS top_topics, coalesce(s.seed_topics, '') AS seed_topics, u.updated_at, c.counts FROM (SELECT user_id FROM components WHERE weight <> 0 UNION SELECT user_id FROM seed_topics UNION SELECT user_id FROM interactions) a LEFT JOIN t USING (user_id) LEFT JOIN s USING (user_id) LEFT JOIN u USING (user_id) LEFT JOIN c USING (user_id)""")
def profile_summaries(f):
    """What every user is told of the profile."""
    rows = profiles.profile_summary(_components(f), f.seed_topics, f.interactions.groupBy("user_id").agg(F.max("ts").alias("updated_at")))
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("component_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    return rows.select("user_id", F.array_join(F.transform("top_topics", lambda t: F.lower(F.btrim(t))), "|").alias("top_topics"), F.array_join("seed_topics", "|").alias("seed_topics"), "updated_at", counts.alias("counts"))


@query(*_INPUTS, "paper_vectors", "library", "paper_authors", "library_age", "author_weights", "venue_weights", "seen", sql=f"""
WITH {_COMPONENTS}, t AS (SELECT user_id, string_agg(kind || ':' || label, '|' ORDER BY place) AS top_components FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, kind, label) AS place FROM components WHERE weight <> 0) WHERE place <= 8 GROUP BY user_id),
a AS (SELECT user_id, string_agg(author, '|' ORDER BY place) AS top_authors FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, author) AS place FROM author_weights) WHERE place <= 5 GROUP BY user_id),
v AS (SELECT user_id, string_agg(venue, '|' ORDER BY place) AS top_venues FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, venue) AS place FROM venue_weights) WHERE place <= 5 GROUP BY user_id),
s AS (SELECT user_id, count(*) AS seen FROM seen GROUP BY user_id), d AS (SELECT DISTINCT user_id, len(embedding) AS dims FROM signals JOIN paper_vectors USING (external_id))
SELECT u.user_id, CASE WHEN t.top_components IS NULL THEN 'cold_start' ELSE 'ready' END AS state, d.dims, coalesce(s.seen, 0) AS seen, t.top_components, a.top_authors, v.top_venues
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN t USING (user_id) LEFT JOIN a USING (user_id) LEFT JOIN v USING (user_id) LEFT JOIN s USING (user_id) LEFT JOIN d USING (user_id)""")
def user_diagnostics(f):
    """Every user's profile state, strongest components and affinities."""
    of_user = vectors.profile_vectors(profiles.interaction_signals(f.interactions, AS_OF), f.paper_vectors)
    rows = profiles.user_diagnostics(f.events.select("user_id"), _components(f), _seen(f), of_user, _authors(f), _venues(f))
    parts = F.array_join(F.transform("top_components", lambda c: F.concat(c["kind"], F.lit(":"), c["label"])), "|")
    return rows.select("user_id", "state", "dims", "seen", parts.alias("top_components"), F.array_join("top_authors", "|").alias("top_authors"), F.array_join("top_venues", "|").alias("top_venues"))
