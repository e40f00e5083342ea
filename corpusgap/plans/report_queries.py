"""Queries over citation networks, usage logs and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as T
from ..operators import clusters, corpus, network, usage
from .catalog import _TITLE_KEY, query, rounded
from .fixtures import AS_OF, AS_OF_YEAR


def _hops(f):
    seeds = f.documents.filter("source = 'src1'").select(F.col("doc_id").alias("seed"))
    return f.citation_edges, seeds, network.one_hop(f.citation_edges, seeds)


_HOPS = ("citation_edges", "seeds", "hops")


@query(*_HOPS, sql="SELECT * FROM hops")
def one_hop(f):
    return _hops(f)[2]


@query(*_HOPS, sql="SELECT paper, CASE min(r) WHEN 0 THEN 'seed' WHEN 1 THEN 'reference' ELSE 'citer' END AS role FROM (SELECT seed AS paper, 0 AS r FROM hops UNION ALL SELECT paper, CASE role WHEN 'reference' THEN 1 ELSE 2 END FROM hops) GROUP BY paper")
def node_roles(f):
    return network.node_roles(_hops(f)[2])


@query(*_HOPS, sql="SELECT DISTINCT CASE role WHEN 'reference' THEN seed ELSE paper END AS source, CASE role WHEN 'reference' THEN paper ELSE seed END AS target, CASE role WHEN 'reference' THEN 'ref' ELSE 'cite' END AS kind FROM hops")
def typed_edges(f):
    return network.typed_edges(_hops(f)[2])


@query(*_HOPS, sql="""
WITH known AS (SELECT paper FROM hops UNION SELECT seed FROM hops)
SELECT DISTINCT paper, neighbour FROM (SELECT citing AS paper, cited AS neighbour FROM citation_edges UNION ALL SELECT cited, citing FROM citation_edges) WHERE paper IN (SELECT paper FROM known) AND neighbour NOT IN (SELECT paper FROM known)""")
def expand_node(f):
    edges, _, hops = _hops(f)
    return network.expand(hops, edges).select("paper", "neighbour")


@query(*_HOPS, sql="""
WITH known AS (SELECT paper FROM hops UNION SELECT seed FROM hops)
SELECT DISTINCT citing AS paper, cited AS neighbour, 'ref' AS kind FROM citation_edges WHERE citing IN (SELECT paper FROM known) AND cited NOT IN (SELECT paper FROM known)""")
def expand_references(f):
    edges, _, hops = _hops(f)
    return network.expand_by_direction(hops, edges, "references")


@query("citation_edges", "seeds", sql="SELECT cited AS paper, count(*) AS citations FROM citation_edges WHERE cited NOT IN (SELECT seed FROM seeds) GROUP BY cited ORDER BY citations DESC, paper LIMIT 10")
def top_cited(f):
    edges, seeds, _ = _hops(f)
    return network.top_cited(edges, seeds)


@query("citation_edges", sql="SELECT node, count(*) AS neighbours FROM (SELECT citing AS node, cited AS neighbour FROM citation_edges UNION SELECT cited, citing FROM citation_edges) GROUP BY node")
def node_degrees(f):
    return network.degrees(f.citation_edges)


@query(*_HOPS, "papers", sql="""
WITH n AS (SELECT r.paper AS node, min(CASE r.role WHEN 'seed' THEN 0 WHEN 'reference' THEN 1 ELSE 2 END) AS r FROM (SELECT paper, role FROM hops UNION ALL SELECT seed, 'seed' FROM hops) r GROUP BY ALL),
v AS (SELECT n.node, n.r FROM n JOIN papers p ON p.pos = n.node WHERE n.r = 0 OR (n.r = 1 AND p.citation_count >= 100 AND p.year BETWEEN 2018 AND 2022))
SELECT DISTINCT source, target FROM (SELECT CASE role WHEN 'reference' THEN seed ELSE paper END AS source, CASE role WHEN 'reference' THEN paper ELSE seed END AS target FROM hops) WHERE source IN (SELECT node FROM v) AND target IN (SELECT node FROM v)""")
def visible_edges(f):
    hops = _hops(f)[2]
    nodes = network.node_roles(hops).withColumnRenamed("paper", "node").join(f.papers.select(F.col("pos").alias("node"), "citation_count", "year"), "node")
    return network.visible(nodes, network.typed_edges(hops), ["reference"], 100, (2018, 2022))[1].select("source", "target").distinct()


@query(*_HOPS, sql="""
WITH c AS (SELECT seed, count(*) FILTER (role = 'reference') AS refs, count(*) FILTER (role = 'citer') AS citers FROM hops GROUP BY seed)
SELECT d.doc_id AS seed FROM documents d LEFT JOIN c ON c.seed = d.doc_id WHERE d.source = 'src1' AND coalesce(refs, 0) < 3 AND coalesce(citers, 0) < 3 AND d.n_chars % 500 > 3""")
def sparse_seeds(f):
    _, seeds, hops = _hops(f)
    counts = f.documents.filter("source = 'src1'").select(F.col("doc_id").alias("seed"), (F.col("n_chars") % 500).alias("citation_count"))
    return network.sparse_seeds(hops, counts, 3)


@query(*_HOPS, sql="SELECT source, target, kind, bool_and(is_new) AS is_new FROM (SELECT citing AS source, cited AS target, 'ref' AS kind, false AS is_new FROM citation_edges WHERE citing % 2 = 0 UNION ALL SELECT citing, cited, 'ref', true FROM citation_edges WHERE citing % 3 = 0) GROUP BY ALL")
def merged_graph(f):
    edges = f.citation_edges.select(F.col("citing").alias("source"), F.col("cited").alias("target"), F.lit("ref").alias("kind"))
    return network.merged_graph(edges.filter("source % 2 = 0"), edges.filter("source % 3 = 0"))


_NODES = """SELECT doc_id AS row, CASE WHEN doc_id % 2 = 0 THEN 'OA:W' || doc_id ELSE substring(sha256(CAST(doc_id AS VARCHAR)), 1, 40) END AS node, CASE WHEN doc_id % 5 = 0 THEN '10.1/' || CAST(floor(doc_id / 10) AS BIGINT) END AS doi,
  split_part(text, chr(10), 1) AS title, CAST(2016 + doc_id % 2 AS INT) AS year, n_chars % 500 AS citation_count, CASE WHEN doc_id % 2 = 0 THEN 'openalex' ELSE 'semantic_scholar' END AS source FROM documents"""


def _nodes(f):
    d = f.documents
    even = F.col("doc_id") % 2 == 0
    return d.select(
        F.col("doc_id").alias("row"), F.when(even, F.concat(F.lit("OA:W"), F.col("doc_id").cast("string"))).otherwise(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 40)).alias("node"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("10.1/"), F.floor(F.col("doc_id") / 10).cast("string"))).alias("doi"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        (2016 + F.col("doc_id") % 2).cast("int").alias("year"), (F.col("n_chars") % 500).alias("citation_count"), F.array(F.lit("someone")).alias("authors"),
        F.array(F.when(even, "openalex").otherwise("semantic_scholar")).alias("sources"),
    )


@query(sql=f"""
WITH RECURSIVE n AS ({_NODES}), keys AS (SELECT row, 'id:' || node AS key FROM n UNION ALL SELECT row, 'doi:' || doi FROM n WHERE doi IS NOT NULL UNION ALL SELECT row, 'title:' || lower(trim(title)) || '|' || year FROM n WHERE trim(title) <> ''),
links AS (SELECT DISTINCT x.row AS a, y.row AS b FROM keys x JOIN keys y USING (key)), reach AS (SELECT row, row AS seen FROM n UNION SELECT r.row, l.b FROM reach r JOIN links l ON l.a = r.seen),
c AS (SELECT row, min(seen) AS label FROM reach GROUP BY row)
SELECT label, arg_min(node, (starts_with(node, 'OA:'), n.row)) AS node, arg_min(year, n.row) AS year, arg_min(citation_count, n.row) AS citation_count, count(*) AS rows FROM c JOIN n USING (row) GROUP BY label""")
def merge_nodes(f):
    """Nodes of two sources as papers: identity by id, DOI, or title and year, closed over chains."""
    nodes = _nodes(f)
    labels = clusters.components(network.identity_links(nodes).withColumn("all", F.lit(1)), ["all"]).select(F.col("node").alias("row"), "label")
    return network.merged_nodes(nodes, labels).select("label", "node", "year", "citation_count", "rows")


@query("papers", sql="""
WITH r AS (SELECT pos AS ref, lower(trim(title)) AS t, CASE WHEN pos % 3 > 0 THEN year END AS y FROM papers WHERE pos % 2 = 1 AND trim(title) <> ''), w AS (SELECT pos AS work, lower(trim(title)) AS u, year + 1 AS v FROM papers WHERE pos % 2 = 0 AND trim(title) <> ''),
e AS (SELECT ref, min(work) AS work FROM r JOIN w ON t = u AND (y IS NULL OR y = v) GROUP BY ref)
SELECT ref, work, true AS exact FROM e UNION ALL
SELECT ref, min(work), false FROM r JOIN w ON contains(t, u) OR contains(u, t) WHERE ref NOT IN (SELECT ref FROM e) GROUP BY ref""")
def matched_references(f):
    """References of the odd papers in the even ones (a third of them without a year): equal titles, else one within the other."""
    refs = f.papers.filter("pos % 2 = 1").select(F.col("pos").alias("ref"), "title", F.when(F.col("pos") % 3 > 0, F.col("year")).alias("year"))
    works = f.papers.filter("pos % 2 = 0").select(F.col("pos").alias("work"), "title", (F.col("year") + 1).alias("year"))
    low = lambda c: F.lower(F.btrim(c))
    named = network.matched_by_title(refs, works).join(refs.select("ref", low("title").alias("t"), F.col("year").alias("y")), "ref").join(works.select("work", low("title").alias("u"), F.col("year").alias("v")), "work")
    return named.select("ref", "work", ((F.col("t") == F.col("u")) & (F.col("y").isNull() | (F.col("y") == F.col("v")))).alias("exact"))


@query(sql="SELECT 'https://doi.org/10.1234/x' || doc_id AS input, 'OA:W' || (1000000 + doc_id) AS paper_id, 'openalex' AS source FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'https://arxiv.org/abs/2401.' || (10000 + doc_id % 80000), 'ARX:2401.' || (10000 + doc_id % 80000), 'arxiv' FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT 'W' || (1000000 + doc_id), CASE WHEN doc_id % 2 = 0 THEN 'OA:W' || (1000000 + doc_id) ELSE 'OA:W' || (1000000 + doc_id) END, 'openalex' FROM documents WHERE doc_id % 3 = 2")
def resolved_identifiers(f):
    """Addresses and ids of papers looked up in a table of known works."""
    n = F.col("doc_id").cast("string")
    work = F.concat(F.lit("W"), (1000000 + F.col("doc_id")).cast("string"))
    arxiv = F.concat(F.lit("https://arxiv.org/abs/2401."), (10000 + F.col("doc_id") % 80000).cast("string"))
    inputs = f.documents.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1234/x"), n)).when(F.col("doc_id") % 3 == 1, arxiv).otherwise(work).alias("input"))
    known = f.documents.filter("doc_id % 3 <> 1").select(F.lit("openalex").alias("source"), work.alias("external_id"), F.concat(F.lit("OA:"), work).alias("paper_id"), F.concat(F.lit("10.1234/x"), n).alias("doi"))
    return network.resolved(inputs, known)


@query(*_HOPS, sql="SELECT count(*) AS alive FROM hops WHERE seed % 2 = 0")
def live_snapshots(f):
    hops = _hops(f)[2]
    taken = network.snapshots(hops.filter("seed % 2 = 0"), "2024-01-10 00:00:00").unionByName(network.snapshots(hops.filter("seed % 2 = 1"), "2023-12-10 00:00:00"))
    return network.unexpired(taken, AS_OF).agg(F.count("*").alias("alive"))


@query("search_history", sql="SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM search_history GROUP BY ALL")
def daily_searches(f):
    return usage.daily_counts(f.search_history, "created_at")


@query("search_history", sql="SELECT topic, count(*) AS searches FROM search_history WHERE trim(topic) <> '' GROUP BY topic ORDER BY searches DESC, topic LIMIT 10")
def trending(f):
    return usage.trending(f.search_history)


@query(sql="SELECT (SELECT count(*) FROM documents) AS papers, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM events WHERE event_type IN ('view', 'click')) AS searches, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'signup') AS verified, (SELECT count(*) FROM conversations) AS messages")
def system_stats(f):
    events = f.events.agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type").isin("view", "click")).alias("searches"), F.count_distinct(F.when(F.col("event_type") == "signup", F.col("user_id"))).alias("verified"))
    return f.documents.agg(F.count("*").alias("papers")).crossJoin(events).crossJoin(f.conversations.agg(F.count("*").alias("messages")))


@query(sql=f"SELECT event_type AS kind, count(*) AS total, count(*) FILTER (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts)) BETWEEN 0 AND 86400) AS last_day, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def usage_by_kind(f):
    return usage.daily_reports(f.events.withColumnRenamed("event_type", "kind"), AS_OF)


@query(sql="SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used, greatest(3 - count(*), 0) AS remaining, count(*) > 3 AS over FROM events GROUP BY ALL")
def quota_use(f):
    return usage.quota_use(f.events, "ts", 3)


@query(sql="SELECT user_id, event_id, number, number <= 10 AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events WHERE event_type = 'view')")
def lifetime_limit(f):
    return usage.over_limit(f.events.filter("event_type = 'view'"), "ts")


@query(sql="SELECT conv_id, count(*) AS turns, substring(arg_min(text, turn), 1, 50) AS title FROM conversations GROUP BY conv_id")
def chat_sessions(f):
    return usage.chat_sessions(f.conversations)


@query(sql="SELECT conv_id, md5(string_agg(role || ':' || text, '|' ORDER BY turn, role, text)) AS messages FROM conversations GROUP BY conv_id")
def session_messages(f):
    rows = usage.session_messages(f.conversations)
    return rows.select("conv_id", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|").cast("binary")).alias("messages"))


@query("search_history", sql="SELECT user_id, search_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, search_id) AS place FROM search_history) WHERE place BETWEEN 6 AND 15")
def history_page(f):
    return usage.paged(f.search_history, ["user_id"], [F.desc("created_at"), "search_id"], 10, 5).select("user_id", "search_id", "place")


@query("search_history", sql="SELECT user_id, report_id, gaps FROM (SELECT user_id, CAST(search_id AS VARCHAR) AS report_id, search_id % 4 AS gaps, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, CAST(search_id AS VARCHAR)) AS rn FROM search_history) WHERE rn <= 20")
def report_listing(f):
    gaps = F.transform(F.slice(F.array(*map(F.lit, range(3))), 1, (F.col("search_id") % 4).cast("int")), lambda g: g)
    reports = f.search_history.select("user_id", F.col("search_id").cast("string").alias("report_id"), "topic", gaps.alias("gaps"), "created_at")
    return usage.report_listing(reports).select("user_id", "report_id", F.col("gaps").cast("long").alias("gaps"))


@query("papers", sql="""
WITH c AS (SELECT topic_id, source, count(*) AS n FROM papers GROUP BY ALL), p AS (SELECT topic_id, n / sum(n) OVER (PARTITION BY topic_id) AS p FROM c)
SELECT topic_id, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS kinds FROM p GROUP BY topic_id""")
def source_entropy(f):
    return rounded(usage.entropy(f.papers, ["topic_id"], "source"), "entropy")


@query(sql="SELECT round((SELECT avg((label = 9)::INT) FROM embeddings), 6) AS noise, count(*) AS clusters, min(size) AS least, max(size) AS most, round(avg(size), 6) AS mean, round(median(size), 6) AS median, round(stddev(size) / avg(size), 6) AS cv FROM (SELECT label, count(*) AS size FROM embeddings WHERE label <> 9 GROUP BY label)")
def cluster_size_stats(f):
    """Label 9 stands for noise."""
    return rounded(usage.noise_and_sizes(f.embeddings.select(F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("label")), "label"), "noise", "mean", "median", "cv")


_SCORED = "WITH s AS (SELECT l.quality AS label, (d.n_chars % 997) / 997.0 AS score FROM labels l JOIN documents d USING (doc_id)) "


def _scored(f):
    return f.labels.join(f.documents, "doc_id").select(F.col("quality").alias("label"), ((F.col("n_chars") % 997).cast("double") / 997.0).alias("score"))


@query(sql=_SCORED + ", b AS (SELECT score, sum(label) AS ones, sum(1 - label) AS zeros FROM s GROUP BY score), w AS (SELECT *, ones * (coalesce(sum(zeros) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + zeros / 2) AS won FROM b) SELECT round(sum(won) / (sum(ones) * sum(zeros)), 6) AS auc FROM w")
def roc_auc(f):
    return rounded(usage.roc_auc(_scored(f)), "auc")


@query(sql=_SCORED + """, t AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label <> 1) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn FROM s, t GROUP BY threshold)
SELECT threshold, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""")
def threshold_sweep(f):
    return rounded(usage.threshold_sweep(_scored(f), [0.25, 0.5, 0.75]), "precision", "recall", "f1")


@query(sql="SELECT count(*) AS n, round((avg((quality = toxic)::INT) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) / (1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))), 6) AS kappa FROM labels")
def kappa(f):
    return rounded(usage.kappa(f.labels, "quality", "toxic"), "kappa")


@query(sql="WITH g AS (SELECT floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT AS gap FROM events) SELECT round(quantile_disc(gap, 0.5), 3)::DOUBLE AS p50, round(quantile_disc(gap, 0.95), 3)::DOUBLE AS p95, round(quantile_disc(gap, 0.99), 3)::DOUBLE AS p99 FROM g WHERE gap IS NOT NULL")
def latency_percentiles(f):
    return rounded(usage.gaps_between(f.events, "user_id", "ts"), "p50", "p95", "p99", places=3)


@query(sql="""
WITH r AS (SELECT event_type AS stage, floor(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type)))::BIGINT - floor(epoch(ts))::BIGINT AS took FROM events)
SELECT stage, count(*) AS runs, quantile_disc(took, 0.5) AS p50, quantile_disc(took, 0.95) AS p95 FROM r WHERE took IS NOT NULL GROUP BY stage""")
def stage_latency(f):
    return usage.stage_latency(f.events.select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), "ts"))


@query(sql="SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY user_id")
def browsing_sessions(f):
    return usage.sessions(f.events, "86400 seconds 1 microsecond").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


@query(sql="SELECT source AS variant, count(*) AS n, round(avg(quality), 6) AS mean, round(stddev(quality), 6) AS sd FROM labels JOIN documents USING (doc_id) GROUP BY source")
def variant_comparison(f):
    rows = f.labels.join(f.documents.select("doc_id", F.col("source").alias("variant")), "doc_id")
    return rounded(usage.compared(rows, "variant", "quality"), "mean", "sd")


@query(sql="SELECT lang, count(*) AS n, round(avg(quality), 6) AS good, round(avg(toxic), 6) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def label_rates(f):
    rows = f.labels.join(f.documents.select("doc_id", "lang"), "doc_id")
    return rounded(usage.rates(rows, ["lang"], good=F.col("quality") == 1, toxic=F.col("toxic") == 1), "good", "toxic")


@query(sql="""
WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents)
SELECT r.lang, round(count(l.doc_id) / count(*), 6) AS precision FROM r LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id) WHERE place <= 10 GROUP BY r.lang""")
def precision_at_10(f):
    ranked = corpus.cursor_page(f.documents.select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), "doc_id"], 0, 10)
    good = f.labels.filter("quality = 1").join(f.documents.select("doc_id", "lang"), "doc_id")
    return rounded(usage.precision_at(ranked, good, ["lang"], "doc_id"), "precision")


@query("papers", sql="SELECT topic_id, round(avg((year >= 2022)::INT), 6) AS recent, round(avg((year BETWEEN 2016 AND 2025)::INT), 6) AS in_range FROM papers GROUP BY topic_id")
def coverage_rates(f):
    rows = usage.rates(f.papers, ["topic_id"], recent=F.col("year") >= AS_OF_YEAR - 3, in_range=F.col("year").between(2016, 2025))
    return rounded(rows.drop("n"), "recent", "in_range")


@query("papers", sql=f"""
WITH k AS (SELECT pos, topic_id, coalesce(nullif({_TITLE_KEY}, ''), external_id) AS key, md5(abstract) AS body FROM papers), b AS (SELECT topic_id, body, min(pos) AS a FROM k GROUP BY ALL), p AS (SELECT b.a, k.pos AS b FROM k JOIN b USING (topic_id, body) WHERE k.pos <> b.a)
SELECT count(*) AS pairs, round(avg((x.key = y.key)::INT), 6) AS accuracy FROM p JOIN k x ON x.pos = p.a JOIN k y ON y.pos = p.b""")
def dedup_accuracy(f):
    """Pairs of equal texts that deduplication puts under one key."""
    rows = f.papers.select(F.col("pos").alias("item"), "topic_id", F.coalesce(F.nullif(T.title_key(F.col("title")), F.lit("")), F.col("external_id")).alias("group"), F.md5(F.col("abstract").cast("binary")).alias("body"))
    first = rows.groupBy("topic_id", "body").agg(F.min("item").alias("a"))
    pairs = rows.join(first, ["topic_id", "body"]).filter("item <> a").select("a", F.col("item").alias("b"))
    return rounded(usage.pairs_together(pairs, rows.select("item", "group")), "accuracy")


@query("gap_claims", sql="""
WITH c AS (SELECT gap_id, list_distinct(list_filter(regexp_split_to_array(lower(sentence), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 4)) AS s, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 4)) AS t
  FROM gap_claims g CROSS JOIN (SELECT count(*) AS z FROM benchmark) z JOIN benchmark b ON b.item_id = g.gap_id % z.z)
SELECT gap_id, round(avg(len(list_intersect(s, t)) / len(s)), 6) AS coverage FROM c WHERE len(s) > 0 GROUP BY gap_id""")
def claim_coverage(f):
    claims = f.gap_claims.crossJoin(F.broadcast(f.benchmark.agg(F.count("*").alias("z"))))  # one row
    claims = claims.join(f.benchmark, F.col("item_id") == F.col("gap_id") % F.col("z")).select("gap_id", "sentence", F.col("text").alias("context"))
    return rounded(usage.term_coverage(claims), "coverage")


@query(sql="SELECT lang, round(avg((regexp_matches(lower(text), 'evaluate|measure|compare|benchmark|ablat|train|test|design|implement|dataset|%|parameter') OR regexp_matches(text, '[0-9]'))::INT), 6) AS concrete FROM documents GROUP BY lang")
def concrete_directions(f):
    return rounded(usage.concrete_share(f.documents, ["lang"], "text"), "concrete")


@query(sql="SELECT user_id AS run, count(*) AS calls, sum(floor(value))::BIGINT AS tokens, round(avg((event_type <> 'error')::INT), 6) AS success, round(avg((event_type = 'error')::INT), 6) AS error, round(avg((event_id % 5 = 0)::INT), 6) AS cache_hit, round(avg((event_id % 7 = 0)::INT), 6) AS fallback FROM events GROUP BY user_id")
def token_costs(f):
    calls = f.events.select(F.col("user_id").alias("run"), F.floor("value").alias("tokens"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), (F.col("event_id") % 5 == 0).alias("cached"), (F.col("event_id") % 7 == 0).alias("fallback"))
    return rounded(usage.token_costs(calls), "success", "error", "cache_hit", "fallback")


@query("papers", sql="SELECT external_id, round(1 / (1 + exp(-0.5 * (citation_count / 100.0 - 2.5))), 6) AS confidence FROM papers WHERE 1 / (1 + exp(-0.5 * (citation_count / 100.0 - 2.5))) BETWEEN 0.1 AND 0.99")
def confidences(f):
    value = scores.logistic_confidence(F.col("citation_count") / 100.0)
    return rounded(f.papers.select("external_id", value.alias("confidence")), "confidence").filter("confidence > 0.1 AND confidence < 0.99")


@query("gap_feedback", sql="""
WITH r AS (SELECT count(*) AS rated, avg((vote = 'up')::INT) AS positive FROM gap_feedback WHERE vote IN ('up', 'down')),
s AS (SELECT user_id, s, count(DISTINCT gap_id) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY updated_at, event_id) AS s FROM (SELECT *, CASE WHEN lag(updated_at) OVER (PARTITION BY user_id ORDER BY updated_at, event_id) >= updated_at - INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM gap_feedback)) GROUP BY ALL),
e AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS made, max(ts) FILTER (event_type IN ('purchase', 'signup')) AS done FROM events GROUP BY user_id)
SELECT rated, round(positive, 6) AS positive, (SELECT count(*) FROM s) AS sessions, (SELECT round(avg(n), 6) FROM s) AS examined, (SELECT count(*) FROM e WHERE made IS NOT NULL) AS users, (SELECT round(avg(coalesce(done >= made, false)::INT), 6) FROM e WHERE made IS NOT NULL) AS rate FROM r""")
def engagement(f):
    """Positive ratings, gaps examined a session, and users that export after a run."""
    votes, log = f.gap_feedback, f.events.select("user_id", F.col("event_type").alias("kind"), "ts")
    rows = usage.positive_ratio(votes, []).crossJoin(usage.examined_per_session(votes.withColumnRenamed("updated_at", "ts"), "gap_id", "43200 seconds 1 microsecond")).crossJoin(usage.export_rate(log, "view", ("purchase", "signup")))  # one row each
    return rows.select("rated", F.round("positive", 6).alias("positive"), "sessions", F.round("examined", 6).alias("examined"), "users", F.round("rate", 6).alias("rate"))
