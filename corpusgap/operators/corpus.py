"""Filtering, deduplication, upserts and ranking of paper tables, for all topics at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_key, venue_matches

# Which source wins when several have a paper.
SOURCE_PRIORITY = {"semantic_scholar": 4, "openalex": 3, "arxiv": 2, "tavily": 1}


def first_per(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; the filter next to the window lets Spark prune before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def source_priority(source: Column) -> Column:
    out = F.lit(0)
    for name, p in SOURCE_PRIORITY.items():
        out = F.when(source == name, p).otherwise(out)
    return out


def paper_identity(papers: DataFrame) -> Column:
    """A paper's title key, else its address (where the input has ``url``), else its id."""
    address = [F.nullif(F.btrim("url"), F.lit(""))] if "url" in papers.columns else []
    return F.coalesce(F.nullif(title_key(F.col("title")), F.lit("")), *address, F.col("external_id"))


def paper_rank(papers: DataFrame) -> dict[str, Column]:
    """What decides, before the order, which of a paper's copies is kept: the source's priority, and whether there is an abstract."""
    return {"priority": source_priority(papers["source"]), "told": F.coalesce(F.length("abstract"), F.lit(0)) > 0}


def deduplicate(papers: DataFrame) -> DataFrame:
    """One paper per topic and title key (else address, where the input has ``url``, else id), by source priority, then abstract, then order."""
    order = [*(c.desc() for c in paper_rank(papers).values()), F.col("pos")]
    return first_per(papers.withColumn("title_key", paper_identity(papers)), ["topic_id", "title_key"], order)


def filter_papers(papers: DataFrame, filters: DataFrame, strict: bool = False) -> DataFrame:
    """Papers by each topic's year range and venue: filters (topic_id, low, high, venue).

    An equi join on the topic, so nothing is broadcast by hand; rows without a year are excluded by a range.
    """
    rows = papers.join(filters.withColumnRenamed("venue", "_target"), "topic_id")
    in_range = F.col("low").isNull() | F.coalesce(F.col("year").between(F.col("low"), F.col("high")), F.lit(False))
    return rows.filter(in_range & venue_matches(F.col("venue"), F.col("_target"), strict)).drop("low", "high", "_target")


def top_papers(papers: DataFrame, n: int) -> DataFrame:
    """The papers of each topic by citations and year; the web source only where the others have none."""
    primary = papers.filter("source <> 'tavily'")
    web = papers.filter("source = 'tavily'").join(primary.select("topic_id").distinct(), "topic_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("citation_count"), F.desc("year"), "pos"))
    return deduplicate(primary.unionByName(web)).withColumn("place", place).filter(F.col("place") <= n)


def ordered_union(pools: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Rows of several pools, each key once, from the first pool that has it."""
    rows = None
    for i, pool in enumerate(pools):
        pool = pool.withColumn("pool", F.lit(i))
        rows = pool if rows is None else rows.unionByName(pool)
    return first_per(rows, keys, ["pool", order])


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], ts: str | Column, keep_first: str) -> DataFrame:
    """The latest row of each key, with the first value of ``keep_first`` ever seen."""
    rows = current.unionByName(changes)
    firsts = F.min(keep_first).over(Window.partitionBy(*keys))
    return first_per(rows.withColumn(keep_first, firsts), keys, [F.desc(ts)])


def latest_history(history: DataFrame, keys: tuple[str, ...] = ("user_id", "topic")) -> DataFrame:
    """The latest search of each key (user and topic, and filters where ``keys`` name them), with how often it was made.

    A ``report_id`` of an earlier search is kept where the latest has none.
    """
    order = F.struct("created_at", "search_id")
    if "report_id" not in history.columns:
        history = history.withColumn("report_id", F.lit(None).cast("string"))
    report = F.max_by("report_id", F.when(F.col("report_id").isNotNull(), order))
    rows = history.groupBy(*keys).agg(F.max(order).alias("m"), F.count("*").alias("searches"), report.alias("report_id"))
    return rows.select(*keys, "m.created_at", "m.search_id", "searches", "report_id")


def sources_used(papers: DataFrame) -> DataFrame:
    """(topic_id, sources, papers) of what ``top_papers`` draws from."""
    primary = papers.filter("source <> 'tavily'")
    web = papers.filter("source = 'tavily'").join(primary.select("topic_id").distinct(), "topic_id", "left_anti")
    return primary.unionByName(web).groupBy("topic_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("papers"))


def per_source(papers: DataFrame, limit: int) -> DataFrame:
    """The first papers of each topic and source in the source's order, each id once."""
    rows = first_per(papers, ["topic_id", "source", F.coalesce("external_id", "title")], ["pos"])
    place = F.row_number().over(Window.partitionBy("topic_id", "source").orderBy("pos"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def cursor_page(rows: DataFrame, keys: list[str], order: list, cursor: int, size: int) -> DataFrame:
    """The page after ``cursor`` rows of each key, with ``place``, ``next_cursor`` and ``has_more``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    page = rows.withColumn("place", place).filter(F.col("place") <= cursor + size + 1)
    page = page.withColumn("has_more", F.max("place").over(Window.partitionBy(*keys)) > cursor + size).filter(F.col("place").between(cursor + 1, cursor + size))
    return page.withColumn("next_cursor", F.max("place").over(Window.partitionBy(*keys)))


def reused(requests: DataFrame, fingerprint: str, item: str) -> DataFrame:
    """One row a fingerprint: the first request makes the ``report``, later ones reuse it."""
    others = [c for c in requests.columns if c not in (fingerprint, item)]
    return requests.groupBy(fingerprint).agg(F.min(item).alias("report"), F.count("*").alias("requests"), *[F.min_by(c, item).alias(c) for c in others])


def fresh_rows(candidates: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(known.select(*keys).distinct(), keys, "left_anti")
