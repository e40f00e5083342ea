"""Topic patterns and cluster trends, from the tall evidence table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shortened_theme
from .corpus import first_per
from .gaps import top_terms

PATTERN_KINDS = ("method", "dataset", "metric", "limitation", "future_work")


def year_histogram(papers: DataFrame, low: int = 1900, high: int = 2100) -> DataFrame:
    return papers.filter(F.col("year").between(low, high)).groupBy("topic_id", "year").agg(F.count("*").alias("papers"))


def year_extent(papers: DataFrame, keys: list[str], low: int = 1500, high: int = 2100) -> DataFrame:
    """First and last plausible year of each key."""
    return papers.filter(F.col("year").between(low, high)).groupBy(*keys).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def terms_by_year(evidence: DataFrame, kind: str) -> DataFrame:
    """How often each term of a kind is named in each year; the list of a year is these terms, repeated so often."""
    return evidence.filter((F.col("kind") == kind) & (F.col("year") > 0)).groupBy("topic_id", "year", "term").agg(F.count("*").alias("papers"))


def frequencies(evidence: DataFrame, kinds: tuple[str, ...] = ("dataset", "metric"), k: int = 10) -> DataFrame:
    """(topic_id, kind, frequency): a map of the ``k`` commonest terms to how many papers name them."""
    rows = top_terms(evidence, k, kinds)
    return rows.groupBy("topic_id", "kind").agg(F.map_from_entries(F.collect_list(F.struct("term", "papers"))).alias("frequency"))


def emerging(evidence: DataFrame, as_of: int, k: int = 4) -> DataFrame:
    """The commonest limitations and future work among papers at most two years old."""
    rows = evidence.filter(F.col("kind").isin("limitation", "future_work") & (F.col("year") >= as_of - 2))
    counts = rows.groupBy("topic_id", "term").agg(F.count("*").alias("papers"))
    return first_per(counts, ["topic_id"], [F.desc("papers"), "term"], k)


def saturated(evidence: DataFrame, as_of: int, kind: str = "method", among: int = 8) -> DataFrame:
    """Of the commonest methods of a topic those of at least three papers, under a fifth of them recent."""
    recent = F.avg((F.coalesce("year", F.lit(0)) >= as_of - 2).cast("double"))
    rows = evidence.filter(F.col("kind") == kind).groupBy("topic_id", "term").agg(F.count("*").alias("papers"), recent.alias("recent_share"))
    return first_per(rows, ["topic_id"], [F.desc("papers"), "term"], among).filter("papers >= 3 AND recent_share < 0.2")


def baseline_stagnation(evidence: DataFrame, order: str = "paper_id", share: float = 0.7) -> DataFrame:
    """(topic_id, papers, stagnant): whether every paper's baselines overlap those of the topic's first paper by ``share``.

    Topics with fewer than two papers that name baselines aren't stagnant.
    """
    sets = evidence.filter("kind = 'baseline'").groupBy("topic_id", "paper_id").agg(F.collect_set("term").alias("names"))
    first = sets.groupBy("topic_id").agg(F.min_by("names", order).alias("first_names"))
    rows = sets.join(first, "topic_id")
    overlap = F.size(F.array_intersect("names", "first_names")) / F.size(F.array_union("names", "first_names"))
    return rows.groupBy("topic_id").agg(F.count("*").alias("papers"), ((F.count("*") >= 2) & F.every(overlap >= share)).alias("stagnant"))


def cluster_trend(members: DataFrame, keys: list[str], as_of: int) -> DataFrame:
    """Unknown, Established, Emerging, Stagnant, Saturated or Active, in this order of tests."""
    rows = members.groupBy(*keys).agg(F.count("*").alias("papers"), F.count("year").alias("dated"), F.count_if(F.col("year") >= as_of - 2).alias("recent"), F.max("year").alias("latest"))
    share = F.col("recent") / F.nullif(F.col("dated"), F.lit(0))
    trend = (
        F.when(F.col("papers") == 0, "Unknown").when(F.col("dated") == 0, "Established").when((share > 0.6) & (F.col("dated") >= 3), "Emerging")
        .when((F.col("recent") == 0) & (F.col("latest") < as_of - 3), "Stagnant").when((F.col("dated") >= 10) & (share < 0.2), "Saturated")
        .when(share > 0.3, "Active").otherwise("Established")
    )
    return rows.withColumn("trend", trend)


def cluster_themes(members: DataFrame, evidence: DataFrame, as_of: int) -> DataFrame:
    """(cluster, top_limitations, top_future_work, limitation_freq, theme, paper_count, trend) of members (cluster, paper_id, title, year).

    The theme is the commonest limitation, else future work, else the two commonest title words.
    """
    rows = evidence.filter(F.col("kind").isin("limitation", "future_work")).join(members.select("cluster", "paper_id"), "paper_id")
    counts = rows.groupBy("cluster", "kind", "term").agg(F.count("*").alias("papers"))
    place = F.row_number().over(Window.partitionBy("cluster", "kind").orderBy(F.desc("papers"), "term"))
    counts = counts.withColumn("place", place).filter("place <= 10")
    listed = lambda kind, k: F.transform(F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & (F.col("place") <= k), F.struct("place", "term")))), lambda x: x["term"])
    freq = F.map_from_entries(F.collect_list(F.when(F.col("kind") == "limitation", F.struct("term", "papers"))))
    tops = counts.groupBy("cluster").agg(listed("limitation", 5).alias("top_limitations"), listed("future_work", 5).alias("top_future_work"), freq.alias("limitation_freq"))
    trend = cluster_trend(members, ["cluster"], as_of).select("cluster", F.col("papers").alias("paper_count"), "trend")
    bare = trend.select("cluster").join(tops.select("cluster"), "cluster", "left_anti")
    words = members.join(bare, "cluster").select("cluster", F.explode(F.split(F.lower("title"), r"\s+")).alias("word")).filter(F.length("word") > 3)
    words = first_per(words.groupBy("cluster", "word").agg(F.count("*").alias("n")), ["cluster"], [F.desc("n"), "word"], 2)
    words = words.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct(-F.col("n"), "word"))).alias("w"))
    words = words.select("cluster", F.concat(F.lit("Study of "), F.array_join(F.transform("w", lambda x: x["word"]), " ")).alias("of_titles"))
    out = trend.join(tops, "cluster", "left").join(words, "cluster", "left")
    label = F.coalesce(F.try_element_at("top_limitations", F.lit(1)), F.try_element_at("top_future_work", F.lit(1)), "of_titles", F.lit("unspecified gap"))
    return out.select("cluster", "top_limitations", "top_future_work", "limitation_freq", shortened_theme(label).alias("theme"), "paper_count", "trend")
