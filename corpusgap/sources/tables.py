"""Reading and writing the library's tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables of the data model with their fixed schemas.
SCHEMAS = {
    "papers": "source string, external_id string, title string, abstract string, authors array<string>, year int, venue string, url string, pdf_url string, citation_count bigint, doi string, references array<string>, citing_papers array<string>",
    "embeddings": "source string, external_id string, embedding array<float>, embedding_model string, embedding_text_fingerprint string, embedded_at timestamp, first_seen_at timestamp, last_seen_at timestamp",
    "search_history": "user_id bigint, topic string, filters struct<year: string, venue: string>, results_count int, report_id string, created_at timestamp",
    "gap_feedback_signals": "user_id bigint, report_id string, gap_id string, vote string, pursue boolean, addressed_by string, note string, updated_at timestamp",
    "paper_interactions": "user_id bigint, external_id string, kind string, ts timestamp",
    "user_profiles": "user_id bigint, vector array<float>, components array<struct<kind: string, label: string, weight: double>>, updated_at timestamp",
    "impressions": "user_id bigint, external_id string, ts timestamp",
    "gap_reports": "report_id string, user_id bigint, topic string, gaps array<struct<gap_id: string, title: string, confidence: double, status: string>>, created_at timestamp",
    "citation_nodes": "node string, title string, year int, authors array<string>, citation_count bigint, doi string, url string, sources array<string>",
    "citation_edges": "source string, target string, kind string",
    "network_snapshots": "seed string, node string, role string, expires_at timestamp",
    "projects": "project_id string, user_id bigint, name string, created_at timestamp",
    "library_items": "user_id bigint, source string, external_id string, status string, added_at timestamp, updated_at timestamp",
    "activities": "user_id bigint, action string, detail string, created_at timestamp",
    "chat_messages": "session_id string, user_id bigint, role string, text string, created_at timestamp",
    "users": "user_id bigint, verified boolean, daily_used int, used_on date, searches int",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table under ``folder`` with its fixed schema; columns that the files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def append_table(df: DataFrame, folder: str, name: str) -> None:
    columns = [f"CAST({f.split()[0]} AS {f.split(None, 1)[1]}) AS {f.split()[0]}" for f in _fields(SCHEMAS[name])]
    df.selectExpr(*columns).write.mode("append").parquet(f"{folder}/{name}")


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return out


def append_runs(runs: DataFrame, path: str) -> None:
    """One JSON line a synthesis run."""
    runs.write.mode("append").json(path)


def markdown(gaps: DataFrame) -> DataFrame:
    """(report_id, text): a report a row; gaps (report_id, topic, pos, title, description, direction, confidence, status), ungrounded ones left out."""
    rows = gaps.filter(F.coalesce(F.lower("status"), F.lit("")) != "hallucinated")
    body = F.concat(
        F.lit("## "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("description", F.lit("")), F.lit("\n\n**Direction:** "), F.coalesce("direction", F.lit("")),
        F.lit("\n\n**Confidence:** "), F.format_number(F.col("confidence") * 100, 0), F.lit(" %\n"),
    )
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", body.alias("body")))), lambda x: x["body"])
    rows = rows.groupBy("report_id", "topic").agg(parts.alias("parts"))
    return rows.select("report_id", F.concat(F.lit("# Research gaps: "), F.coalesce("topic", F.lit("")), F.lit("\n\n"), F.array_join("parts", "\n")).alias("text"))


def write_markdown(gaps: DataFrame, path: str) -> None:
    """One text file part for each task; a report's text stays in one row."""
    markdown(gaps).select("text").write.mode("append").text(path)


def cleaned_history(history: DataFrame) -> DataFrame:
    """Old rows brought to one form: topic from query, results_count from result_count; blank topics are dropped."""
    have = set(history.columns)
    topic = F.coalesce(*[F.nullif(F.btrim(c), F.lit("")) for c in ("topic", "query") if c in have])
    counts = F.coalesce(*[F.col(c) for c in ("results_count", "result_count") if c in have], F.lit(0))
    rows = history.withColumns({"topic": topic, "results_count": counts}).filter("topic IS NOT NULL")
    return rows.drop("query", "result_count")


def embedded(papers: DataFrame, encoder, text: str = "text", fallback=None) -> DataFrame:
    """Adds ``embedding`` to rows by a caller's ``encoder`` (list of texts to a matrix), 32 texts at a time.

    Where the encoder fails on a batch, ``fallback`` takes it if there is one.
    """
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 32):
                part = batch.slice(a, 32)
                texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                try:
                    vectors = encoder(texts)
                except Exception:
                    if fallback is None:
                        raise
                    vectors = fallback(texts)
                yield part.append_column("embedding", pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32())))

    return papers.mapInArrow(run, StructType([*papers.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def backfilled(papers: DataFrame, encoder, text: str = "text") -> DataFrame:
    """The rows without a vector, with one; ``papers`` may have null vectors in ``embedding``."""
    return embedded(papers.filter(F.col("embedding").isNull()).drop("embedding"), encoder, text)
