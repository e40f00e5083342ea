"""Derived tables: the given tables read as papers, interactions, searches, feedback, citations and claims.

The statements run unchanged in Spark and in DuckDB, so a query and its SQL twin see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.runtime import share_package
from ..operators.evidence import Lexicon

AS_OF_YEAR = 2025
AS_OF = "2024-01-31 00:00:00"

#: Words of the invented texts that stand for the evidence lexicons.
LEXICON = Lexicon(
    limitations=("thble", "erble", "nicht", "mente", "ément"), limitation_intros=(), triggered={},
    future_work=("thtion", "attion", "ersch", "ciónas", "étion"), future_intros=(),
    metrics={"reward": ("thing",), "robustness": ("ertion",)}, assumptions={"Full observability": ("thble",), "Stationary environment": ("ersch", "étion")},
    datasets=("thnt", "erin"), no_datasets=("THE", "AND", "DER", "WAS", "QUE"), methods=("thre", "thth", "thes"), baselines={"value decomposition": ("thed",), "independent learners": ("thhe",)},
)

VIEWS = {
    "papers": """
SELECT doc_id AS pos, lang AS topic_id,
  CASE doc_id % 4 WHEN 0 THEN 'semantic_scholar' WHEN 1 THEN 'openalex' WHEN 2 THEN 'arxiv' ELSE 'tavily' END AS source,
  CAST(doc_id AS STRING) AS external_id, split_part(text, chr(10), 1) AS title, text AS abstract,
  CAST(2016 + doc_id % 10 AS INT) AS year,
  CASE doc_id % 6 WHEN 0 THEN 'NeurIPS 2023' WHEN 1 THEN 'ICML'
    WHEN 2 THEN 'Proceedings of the 40th International Conference on Machine Learning'
    WHEN 3 THEN 'ACL' WHEN 4 THEN 'arXiv' END AS venue,
  n_chars % 500 AS citation_count
FROM documents""",
    "paper_authors": """
SELECT d.doc_id AS pos, CAST(d.doc_id AS STRING) AS external_id, concat('author ', CAST(CASE m.k WHEN 1 THEN d.doc_id % n.a ELSE n.a + (d.doc_id * 7) % (n.a + 3) END AS STRING)) AS author
FROM documents d CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) m CROSS JOIN (SELECT CAST(floor(count(*) / 20) AS BIGINT) + 1 AS a FROM documents) n""",
    "paper_vectors": """
SELECT CAST(d.doc_id AS STRING) AS external_id, e.embedding FROM documents d CROSS JOIN (SELECT count(*) AS n FROM embeddings) n
JOIN embeddings e ON e.vec_id = d.doc_id % n.n""",
    "paper_labels": """
SELECT CAST(d.doc_id AS STRING) AS external_id, e.vec_id, e.label FROM documents d CROSS JOIN (SELECT count(*) AS n FROM embeddings) n
JOIN embeddings e ON e.vec_id = d.doc_id % n.n""",
    "interactions": """
SELECT e.event_id, e.user_id, CAST(e.event_id % n.n AS STRING) AS external_id,
  CASE e.event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'like' WHEN 'purchase' THEN 'save'
    WHEN 'error' THEN 'dislike' ELSE 'hide' END AS kind, e.ts
FROM events e CROSS JOIN (SELECT count(*) AS n FROM documents) n""",
    "search_history": """
SELECT e.event_id AS search_id, e.user_id, b.text AS topic, b.item_id, e.ts AS created_at,
  CASE e.event_id % 4 WHEN 0 THEN 'ICML' WHEN 1 THEN 'ACL' END AS venue
FROM events e CROSS JOIN (SELECT count(*) AS n FROM benchmark) n
JOIN benchmark b ON b.item_id = e.event_id % n.n WHERE e.event_type IN ('view', 'click')""",
    "library": """
SELECT e.user_id, CAST(e.event_id % n.n AS STRING) AS external_id, CASE WHEN e.event_id % 9 = 0 THEN NULL ELSE e.ts END AS added_at,
  CASE (e.event_id % n.n) % 6 WHEN 0 THEN 'NeurIPS 2023' WHEN 1 THEN 'ICML'
    WHEN 2 THEN 'Proceedings of the 40th International Conference on Machine Learning'
    WHEN 3 THEN 'ACL' WHEN 4 THEN 'arXiv' END AS venue
FROM events e CROSS JOIN (SELECT count(*) AS n FROM documents) n WHERE e.event_type = 'purchase'""",
    "seed_topics": """
SELECT u.user_id, b.text AS topic, u.user_id % n.n AS vec FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT count(*) AS n FROM embeddings) n
CROSS JOIN (SELECT count(*) AS m FROM benchmark) m JOIN benchmark b ON b.item_id = u.user_id % m.m""",
    "topic_papers": """
SELECT d.doc_id % n.n AS item_id, d.doc_id AS pos, CAST(d.doc_id AS STRING) AS external_id FROM documents d CROSS JOIN (SELECT count(*) AS n FROM benchmark) n""",
    "gap_feedback": """
SELECT e.event_id, e.user_id, CAST(e.event_id % n.n AS STRING) AS gap_id,
  CASE e.event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' END AS vote,
  e.event_type = 'signup' AS pursue, e.ts AS updated_at
FROM events e CROSS JOIN (SELECT count(*) AS n FROM conversations) n WHERE e.event_type IN ('purchase', 'error', 'signup')""",
    "citation_edges": """
SELECT d.doc_id AS citing, (d.doc_id * m.k + 1) % n.n AS cited
FROM documents d CROSS JOIN (SELECT 3 AS k UNION ALL SELECT 7) m CROSS JOIN (SELECT count(*) AS n FROM documents) n
WHERE d.doc_id <> (d.doc_id * m.k + 1) % n.n""",
    "model_outputs": """
SELECT conv_id * 100 + turn AS gap_id, CAST(conv_id % 10 AS INT) AS cluster, CASE WHEN turn % 7 = 5 THEN 'no answer' ELSE concat(chr(123), '"gap_title": "Gap ', CAST(conv_id AS STRING), '", "description": "',
  replace(replace(replace(text, chr(10), ' '), chr(34), ' '), chr(92), ' '), ' This is said of it too [', CAST(1 + turn AS STRING), '].", "what_fails": "Nobody has shown that it holds [', CAST(1 + conv_id % 12 AS STRING), '][999999].", "why_it_exists": "',
  CASE WHEN conv_id % 2 = 0 THEN 'null' ELSE 'The costs of it are high [2].' END, '", "missing_piece": "A proof", "proposed_direction": "", "confidence_score": ', CASE WHEN conv_id % 5 = 0 THEN '"high"' ELSE concat('0.', CAST(conv_id % 10 AS STRING)) END, chr(125), ' and so on') END AS raw
FROM conversations WHERE role = 'assistant'""",
    "gap_claims": """
SELECT conv_id AS gap_id, turn + 1 AS n, concat(text, ' [', CAST(turn + 1 AS STRING), '].') AS sentence
FROM conversations WHERE role = 'assistant'""",
}

_TABLES = ("documents", "events", "benchmark", "conversations", "embeddings", "labels", "pages", "orders")


class Fixtures:
    """Reads given and derived tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        share_package(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.given(name)
        statement, frames = VIEWS[name], {}
        for table in _TABLES:
            for before in ("FROM", "JOIN"):
                if f"{before} {table}" in statement:
                    statement = statement.replace(f"{before} {table}", f"{before} {{{table}}}")
                    frames[table] = self.given(table)
        return self.spark.sql(statement, **frames)
