"""The catalog of queries and the SQL views that their twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import AS_OF, LEXICON, VIEWS, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(*views: str, sql: str | None = None):
    """Registers a function of ``Fixtures`` and its SQL, which sees the named derived tables."""

    def register(f: Callable[[Fixtures], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            tables = [f"{v} AS ({ {**VIEWS, **SQL_VIEWS}[v]})" for v in views]
            body = sql.strip()
            if body.upper().startswith("WITH "):
                tables.append(body[5:])
                ORACLE_SQL[f.__name__] = "WITH " + ",\n".join(tables)
            else:
                ORACLE_SQL[f.__name__] = ("WITH " + ",\n".join(tables) + "\n" if tables else "") + body
        return f

    return register


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TITLE_KEY = "trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_PRIORITY = "CASE source WHEN 'semantic_scholar' THEN 4 WHEN 'openalex' THEN 3 WHEN 'arxiv' THEN 2 WHEN 'tavily' THEN 1 ELSE 0 END"
_TOKEN = "trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_SENTENCES = "list_filter(list_transform(string_split(replace(abstract, chr(10), ' '), '.'), lambda p: trim(p, ' .')), lambda p: length(p) > 10)"


def listed(words) -> str:
    return _list(words)


_ALIKE = "replace(replace(replace(x, 'fully observable', 'full observability'), 'partial observation', 'partial observability'), 'noisy sensor', 'sensor noise')"
_PAPER = "topic_id, external_id AS paper_id, title, year, citation_count"


def _cued(cues) -> str:
    return f"list_filter({_SENTENCES}, lambda s: len(list_filter({_list(cues)}, lambda c: contains(lower(s), c))) > 0)"


def _phrases(kind: str, cues) -> str:
    tokens = f"list_filter(list_transform({_cued(cues)}, lambda x: {_TOKEN}), lambda x: x <> '')"
    return f"SELECT {_PAPER}, '{kind}' AS kind, unnest(list_distinct(list_transform({tokens}, lambda x: {_ALIKE}))) AS term FROM papers"


def _any(text: str, cues) -> str:
    return "(" + " OR ".join(f"contains({text}, '{c}')" for c in cues) + ")"


def _named(kind: str, cues: dict, name) -> str:
    items = ", ".join(f"CASE WHEN {_any('lower(abstract)', c)} THEN '{name(n)}' END" for n, c in cues.items())
    return f"SELECT {_PAPER}, '{kind}', unnest(list_filter([{items}], lambda x: x IS NOT NULL)) FROM papers"


_METRIC_NAMES = {"reward": "reward", "robustness": "robustness"}
_ASSUMED = ", ".join(f"CASE WHEN len({_cued(c)}) > 0 THEN '{n.lower().replace(' ', '_')}' END" for n, c in LEXICON.assumptions.items())
_METHOD = "CASE " + " ".join(f"WHEN contains(lower(concat_ws('. ', title, abstract)), '{m}') THEN '{m}'" for m in LEXICON.methods) + " END"
_ACRONYMS = f"list_filter(regexp_extract_all(abstract, '[\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)*'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}(?:-[A-Z0-9]+)*') AND length(w) BETWEEN 3 AND 12 AND NOT list_contains({_list([*LEXICON.no_datasets, *LEXICON.datasets])}, w))"
_DATASETS = f"list_distinct(list_concat(list_filter({_list(LEXICON.datasets)}, lambda d: contains(lower(abstract), d)), list_transform({_ACRONYMS}, lambda w: lower(w))))"

SQL_VIEWS = {
    "deduplicated": f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, title_key ORDER BY {_PRIORITY} DESC, (length(coalesce(abstract, '')) > 0) DESC, pos) AS rn
  FROM (SELECT *, coalesce(nullif({_TITLE_KEY}, ''), external_id) AS title_key FROM papers)) WHERE rn = 1""",
    "evidence": f"""
{_phrases("limitation", LEXICON.limitations)} UNION ALL {_phrases("future_work", LEXICON.future_work)} UNION ALL
{_named("metric", LEXICON.metrics, str)} UNION ALL {_named("baseline", LEXICON.baselines, str)} UNION ALL
SELECT {_PAPER}, 'assumption', unnest(list_filter([{_ASSUMED}], lambda x: x IS NOT NULL)) FROM papers UNION ALL
SELECT {_PAPER}, 'dataset', unnest({_DATASETS}) FROM papers UNION ALL
SELECT {_PAPER}, 'method', {_METHOD} FROM papers WHERE {_METHOD} IS NOT NULL""",
    "weights": """
SELECT *, ln(1 + greatest(coalesce(citation_count, 0), 0)) / power(1 + CASE WHEN year IS NOT NULL AND year <> 0 THEN greatest(2025 - year, 0) ELSE 5 END, 0.7) AS w,
  CASE WHEN year IS NULL OR year = 0 THEN 0.5 WHEN greatest(2025 - year, 0) <= 2 THEN 1.0 WHEN 2025 - year <= 4 THEN 0.8 WHEN 2025 - year <= 6 THEN 0.6 ELSE 0.4 END AS r
FROM (SELECT topic_id, paper_id, year, citation_count, kind, term FROM evidence UNION ALL SELECT topic_id, external_id, year, citation_count, 'topic', '' FROM papers)""",
    "term_scores": """
SELECT topic_id, kind, term, count(*) AS supporting, sum((year >= 2023)::INT)::BIGINT AS recent, sum((w >= 1.0)::INT)::BIGINT AS influential,
  count(*) * 0.5 + sum(w) * 0.3 + sum((r >= 1.0)::INT) * 0.2 AS support_score,
  count(*) * 0.4 + sum((w >= 1.0)::INT) * 0.4 + sum((r >= 1.0)::INT) * 0.2 AS citation_confidence,
  avg(r) * 1.2 + sum((coalesce(citation_count, 0) < 50)::INT) / count(*) * 0.8 AS novelty
FROM weights GROUP BY ALL""",
    "profile": """
SELECT t.topic_id, t.supporting AS papers, m.term AS metric, m.share AS metric_share, d.term AS dataset, d.share AS dataset_share, coalesce(b.n, 0) AS baselines, b.first AS baseline,
  list_filter(['robustness', 'safety', 'sample_efficiency', 'transfer'], lambda x: NOT list_contains(coalesce(a.have, []), x)) AS missing_metrics,
  list_filter(['independent learners', 'value decomposition', 'centralized critic', 'transformer coordination'], lambda x: NOT list_contains(coalesce(b.have, []), x)) AS missing_baselines
FROM (SELECT * FROM term_scores WHERE kind = 'topic') t
LEFT JOIN (SELECT topic_id, term, supporting / sum(supporting) OVER (PARTITION BY topic_id) AS share, row_number() OVER (PARTITION BY topic_id ORDER BY supporting DESC, term) AS rn FROM term_scores WHERE kind = 'metric') m ON m.topic_id = t.topic_id AND m.rn = 1
LEFT JOIN (SELECT topic_id, term, supporting / sum(supporting) OVER (PARTITION BY topic_id) AS share, row_number() OVER (PARTITION BY topic_id ORDER BY supporting DESC, term) AS rn FROM term_scores WHERE kind = 'dataset') d ON d.topic_id = t.topic_id AND d.rn = 1
LEFT JOIN (SELECT topic_id, list(term) AS have FROM term_scores WHERE kind = 'metric' GROUP BY ALL) a ON a.topic_id = t.topic_id
LEFT JOIN (SELECT topic_id, count(*) AS n, min(term) AS first, list(term) AS have FROM term_scores WHERE kind = 'baseline' GROUP BY ALL) b ON b.topic_id = t.topic_id""",
    "candidate_gaps": """
SELECT topic_id, kind, term AS text, term, '' AS items, supporting, recent, influential, support_score, citation_confidence, novelty FROM term_scores WHERE kind IN ('limitation', 'future_work') AND supporting >= 2
UNION ALL
SELECT s.topic_id, s.kind, 'over reliance on ' || replace(s.term, '_', ' '), s.term, '', s.supporting, s.recent, s.influential, s.support_score, s.citation_confidence, s.novelty
FROM term_scores s JOIN profile p USING (topic_id) WHERE s.kind = 'assumption' AND s.supporting >= greatest(2, floor(p.papers * 0.3 + 0.999))
UNION ALL
SELECT topic_id, g.kind, g.text, g.term, g.items, supporting, recent, influential, support_score, citation_confidence, novelty FROM (
  SELECT s.*, unnest(list_filter([
    CASE WHEN p.metric_share >= 0.5 AND len(p.missing_metrics) > 0 THEN {'kind': 'metric', 'text': 'narrow evaluation beyond ' || replace(p.metric, '_', ' '), 'term': p.metric, 'items': array_to_string(p.missing_metrics, ' ')} END,
    CASE WHEN p.dataset_share >= 0.3 THEN {'kind': 'dataset', 'text': 'benchmark concentration on ' || p.dataset, 'term': p.dataset, 'items': ''} END,
    CASE WHEN p.baselines <= 1 AND p.papers >= 3 THEN {'kind': 'baseline', 'text': 'missing strong baseline comparisons', 'term': coalesce(p.baseline, 'sparse baselines'), 'items': array_to_string(p.missing_baselines, ' ')} END
  ], lambda x: x IS NOT NULL)) AS g FROM (SELECT * EXCLUDE (kind, term) FROM term_scores WHERE kind = 'topic') s JOIN profile p USING (topic_id))""",
    "scored_gaps": """
SELECT *, support_score * 0.30 + severity * 0.20 + actionability * 0.20 + novelty * 0.15 + citation_confidence * 0.15 AS overall,
  regexp_replace(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), '^over-reliance-on-', '') AS slug FROM (
  SELECT *, 1.0 + CASE WHEN regexp_matches(CASE kind WHEN 'metric' THEN items WHEN 'dataset' THEN '' WHEN 'baseline' THEN '' ELSE term END, 'robust|scal|deploy|partial_observability|safety|transfer') THEN 1.5 ELSE 0 END
      + CASE WHEN category IN ('deployment', 'evaluation') THEN 0.8 ELSE 0 END AS severity,
    1.0 + CASE kind WHEN 'metric' THEN 1.0 WHEN 'dataset' THEN 0.8 WHEN 'baseline' THEN 0.8 WHEN 'assumption' THEN 0.8 WHEN 'future_work' THEN 0.6 ELSE 0 END + CASE WHEN category = 'evaluation' THEN 0.6 ELSE 0 END AS actionability
  FROM (SELECT *, CASE WHEN kind IN ('metric', 'dataset', 'baseline') THEN 'evaluation'
      WHEN kind = 'assumption' THEN CASE WHEN contains(term, 'observability') OR contains(term, 'stationary') THEN 'deployment' ELSE 'methodology' END
      WHEN regexp_matches(text, 'robust|metric|benchmark|baseline|evaluation|reward|transfer') THEN 'evaluation'
      WHEN regexp_matches(text, 'deploy|real world|scal|sensor|partial observability|communication') THEN 'deployment' ELSE 'methodology' END AS category FROM candidate_gaps))""",
    "best_gaps": """
SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(overall::DOUBLE, 9) DESC, category, slug) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_id, category, slug ORDER BY round(overall::DOUBLE, 9) DESC, kind, term) AS rn FROM scored_gaps) WHERE rn = 1""",
    "signals": f"""
SELECT *, CASE kind WHEN 'open' THEN 0.3 WHEN 'like' THEN 1.0 WHEN 'save' THEN 1.0 WHEN 'dislike' THEN -0.8 WHEN 'hide' THEN -0.5 ELSE 0 END * exp(-age / 21.0) AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, external_id, kind) AS rn
  FROM (SELECT *, (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 86400.0 AS age FROM interactions) WHERE age >= 0 AND age <= 30) WHERE rn <= 200""",
    "library_age": f"""
SELECT *, CASE WHEN added_at IS NULL THEN 0.4 ELSE greatest(0.2, exp(-((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(added_at))) / 86400.0) / 60)) END AS w FROM library""",
    "author_weights": """
SELECT user_id, author, total / max(total) OVER (PARTITION BY user_id) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(total, 9) DESC, author) AS rn FROM (
    SELECT user_id, author, sum(w) AS total FROM library_age JOIN paper_authors USING (external_id) GROUP BY ALL)) WHERE rn <= 25""",
    "venue_weights": f"""
SELECT user_id, venue, total / max(total) OVER (PARTITION BY user_id) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(total, 9) DESC, venue) AS rn FROM (
    SELECT user_id, lower(venue) AS venue, sum(w) AS total FROM (
      SELECT user_id, venue, w FROM library_age WHERE venue IS NOT NULL UNION ALL
      SELECT user_id, venue, 0.5 * greatest(0.2, exp(-((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(created_at))) / 86400.0) / 60)) FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, search_id) AS rn FROM search_history WHERE venue IS NOT NULL AND (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(created_at))) / 86400.0 <= 60) WHERE rn <= 100) GROUP BY ALL)) WHERE rn <= 25""",
    "recent_items": """
SELECT user_id, item_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, item_id) AS place FROM (SELECT user_id, item_id, max(created_at) AS created_at FROM search_history GROUP BY ALL)) WHERE place <= 3""",
    "seen": f"""
SELECT DISTINCT user_id, external_id FROM (SELECT user_id, external_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, external_id) AS rn FROM (
  SELECT user_id, external_id, max(ts) AS ts FROM interactions WHERE (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 86400.0 BETWEEN 0 AND 21 GROUP BY ALL)) WHERE rn <= 30""",
    "candidates": f"""
SELECT user_id, external_id, title, year, venue, citation_count FROM (
  SELECT r.user_id, p.*, row_number() OVER (PARTITION BY r.user_id, coalesce(nullif({_TITLE_KEY}, ''), external_id) ORDER BY {_PRIORITY} DESC, (length(coalesce(abstract, '')) > 0) DESC, pos) AS rn
  FROM recent_items r JOIN (SELECT t.item_id, q.*, row_number() OVER (PARTITION BY t.item_id, q.source ORDER BY q.pos, q.external_id) AS landed FROM topic_papers t JOIN papers q USING (external_id)) p USING (item_id) WHERE landed <= 20)
WHERE rn = 1 AND (user_id, external_id) NOT IN (SELECT (user_id, external_id) FROM seen)""",
    "candidate_affinity": """
SELECT c.user_id, c.external_id, least(1.0, 0.6 * coalesce(a.w, 0) + 0.4 * coalesce(v.w, 0)) AS score FROM candidates c
LEFT JOIN (SELECT c.user_id, c.external_id, sum(weight) AS w FROM candidates c JOIN paper_authors p USING (external_id) JOIN author_weights w ON w.user_id = c.user_id AND w.author = p.author GROUP BY ALL) a ON a.user_id = c.user_id AND a.external_id = c.external_id
LEFT JOIN (SELECT c.user_id, c.external_id, max(weight) AS w FROM candidates c JOIN venue_weights w ON w.user_id = c.user_id
  AND (w.venue = lower(c.venue) OR (length(w.venue) >= 4 AND length(c.venue) >= 4 AND (contains(lower(c.venue), w.venue) OR contains(w.venue, lower(c.venue))))) GROUP BY ALL) v ON v.user_id = c.user_id AND v.external_id = c.external_id""",
    "seeds": "SELECT doc_id AS seed FROM documents WHERE source = 'src1'",
    "hops": """
SELECT seed, paper, role FROM (SELECT *, row_number() OVER (PARTITION BY seed, role ORDER BY paper) AS rn FROM (
  SELECT DISTINCT seed, cited AS paper, 'reference' AS role FROM citation_edges JOIN seeds ON citing = seed
  UNION ALL
  SELECT DISTINCT c.seed, c.citing, 'citer' FROM (SELECT seed, citing FROM citation_edges JOIN seeds ON cited = seed) c
  WHERE NOT EXISTS (SELECT 1 FROM citation_edges e WHERE e.citing = c.seed AND e.cited = c.citing))) WHERE rn <= 200""",
}


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def text_evidence(f: Fixtures, *kinds: str) -> DataFrame:
    """The evidence of some kinds, of all without any."""
    from ..operators import evidence

    return evidence.evidence_long(f.papers, LEXICON, kinds or evidence.KINDS)


EVIDENCE = ("papers", "evidence")
GAPS = (*EVIDENCE, "weights", "term_scores", "profile", "candidate_gaps", "scored_gaps", "best_gaps")
POOL = ("papers", "search_history", "interactions", "topic_papers", "recent_items", "seen", "candidates")
