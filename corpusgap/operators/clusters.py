"""Reduction, density clusters and what is reported of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import settled
from ..functions.scores import citation_weight, recency_weight
from ..functions.text import category
from .corpus import first_per


def pca_coordinates(vectors: DataFrame, dims: int = 2, item: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(item, coordinates): the first principal components, fitted by Spark on all rows; short ranks are padded with 0.

    The covariance matrix is dims x dims of the vector, whatever the number of rows.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.filter(F.col(vector).isNotNull()).select(item, array_to_vector(F.col(vector).cast("array<double>")).alias("_vector"))
    size = vectors.select(F.max(F.size(vector))).first()[0] or 0
    k = min(dims, size)
    if k < 1 or rows.limit(2).count() < 2:
        return rows.select(item, F.array_repeat(F.lit(0.0), dims).alias("coordinates"))
    model = PCA(k=k, inputCol="_vector", outputCol="_reduced").fit(rows)
    reduced = vector_to_array("_reduced")
    return model.transform(rows).select(item, F.concat(reduced, F.array_repeat(F.lit(0.0), dims - k)).alias("coordinates"))


def components(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, label): the least node of each node's component, for links (keys, a, b).

    In turns every node hands its greater neighbours, then itself and its lesser neighbours, to the least
    of them, so that chains of any length become stars in a few rounds; each round is kept in the
    cluster's checkpoint folder, which cuts lineage.
    """
    pair = lambda a, b: [*keys, a.alias("a"), b.alias("b")]
    edges = settled(links.filter("a <> b").select(*pair(F.greatest("a", "b"), F.least("a", "b"))).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(*pair(F.col("b"), F.col("a"))))
        least = both.groupBy(*keys, "a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, [*keys, "a"]).select(*pair(F.col("b"), F.col("m"))).filter("a <> b").distinct()
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(least, [*keys, "a"]).select(*keys, F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        edges = settled(small.select(*pair(F.col("e.a"), F.col("e.m"))).filter("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "a", "b"))).first())
        if now == state:
            break
        state = now
    roots = edges.select(*keys, F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def silhouette(points: DataFrame, item_vector: str = "coordinates") -> float | None:
    """Mean silhouette (squared Euclidean) over the points that are no noise; None with fewer than two clusters."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = points.filter("cluster >= 0").select(F.col("cluster").cast("double").alias("prediction"), array_to_vector(F.col(item_vector).cast("array<double>")).alias("features"))
    if rows.select("prediction").distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(metricName="silhouette").evaluate(rows)


def dashboard(members: DataFrame) -> DataFrame:
    """(topic_id, cluster, paper_count, x, y, first_year, last_year) of members (topic_id, cluster, paper_id, x, y, year); noise only where nothing else is."""
    only_noise = F.max("cluster").over(Window.partitionBy("topic_id")) < 0
    rows = members.withColumn("only_noise", only_noise).filter((F.col("cluster") >= 0) | F.col("only_noise"))
    place = lambda c: F.round(F.avg(F.round(c, 4)), 4)
    return rows.groupBy("topic_id", F.greatest(F.lit(0), F.col("cluster")).alias("cluster")).agg(
        F.count("*").alias("paper_count"), place("x").alias("x"), place("y").alias("y"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


def on_a_circle(papers: DataFrame, keys: list[str], order: str, radius: float = 0.5) -> DataFrame:
    """Coordinates for papers that have none: evenly on a circle, in order."""
    place, n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1, F.count("*").over(Window.partitionBy(*keys))
    angle = 2 * F.pi() * place / n
    return papers.withColumns({"x": F.round(radius * F.cos(angle), 4), "y": F.round(radius * F.sin(angle), 4)})


def cluster_terms(members: DataFrame, evidence: DataFrame, k: int = 5) -> DataFrame:
    """(cluster, term, papers, place): the ``k`` commonest methods, datasets, metrics and limitations of each cluster."""
    rows = evidence.filter(F.col("kind").isin("method", "dataset", "metric", "limitation")).join(members.select("cluster", "paper_id"), "paper_id")
    counts = rows.groupBy("cluster", "term").agg(F.count("*").alias("papers"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("papers"), "term"))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def summaries(themes: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row a cluster, noise joined to cluster 0: healed labels and limitations, and the cluster's gap.

    themes as of ``patterns.cluster_themes``; gaps (cluster, gap_id, confidence): the best of a cluster is named.
    """
    healed = F.when(F.col("theme").isNull() | (F.col("theme") == "") | F.lower("theme").contains("unspecified"), F.concat(F.lit("Research Theme #"), F.greatest(F.lit(0), F.col("cluster")).cast("string"))).otherwise(F.col("theme"))
    known = F.when(F.size(F.coalesce("top_limitations", F.array())) > 0, F.col("top_limitations")).otherwise(F.array(F.lit("Insufficient data available for targeted analysis.")))
    rows = themes.withColumns({"theme": healed, "top_limitations": known}).withColumn("own", F.greatest(F.lit(0), F.col("cluster")))
    first = lambda c: F.max_by(c, "cluster").alias(c)
    rows = rows.groupBy("own").agg(first("theme"), F.sum("paper_count").alias("paper_count"), first("top_limitations"), first("top_future_work"), first("trend")).withColumnRenamed("own", "cluster")
    best = gaps.groupBy("cluster").agg(F.max_by("gap_id", F.struct("confidence", "gap_id")).alias("gap_id"))
    return rows.join(best, "cluster", "left")


def paper_gap_matrix(members: DataFrame, gaps: DataFrame) -> DataFrame:
    """(gap_id, paper_id): papers that support a gap by standing in its cluster; ``pivot`` makes it a matrix."""
    return gaps.select("gap_id", "cluster").join(members.select("cluster", "paper_id"), "cluster").select("gap_id", "paper_id")


def distribution(members: DataFrame, themes: DataFrame) -> DataFrame:
    return members.groupBy("cluster").agg(F.count("*").alias("papers")).join(themes.select("cluster", "theme"), "cluster", "left")


def gap_papers(gaps: DataFrame, papers: DataFrame) -> DataFrame:
    """(gap_id, paper_id, title): the supporting papers of gaps, named by id or by title in ``supporting``."""
    named = gaps.select("gap_id", F.explode("supporting").alias("name"))
    by_id = named.join(papers.select("paper_id", "title"), named["name"] == papers["paper_id"]).select("gap_id", "paper_id", "title")
    by_title = named.join(papers.select("paper_id", "title"), F.lower("name") == F.lower("title")).select("gap_id", "paper_id", "title")
    return by_id.unionByName(by_title).distinct()


def best_gap_per_cluster(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("cluster").agg(F.max_by("gap_id", F.struct("confidence", "gap_id")).alias("gap_id"), F.count("*").alias("gaps"))


def cluster_gap_score(members: DataFrame, evidence: DataFrame, as_of: int, keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """(topic_id, cluster, score and its five parts): recurrence, evidence, recency, coverage and novelty, within .05 and .99."""
    by = [*keys, "cluster"]
    age = F.when(F.col("year") > 0, F.greatest(F.lit(as_of) - F.col("year"), F.lit(1))).otherwise(5)
    rate = F.least(F.greatest(F.coalesce("citation_count", F.lit(0)), F.lit(0)) / age, F.lit(100.0))
    own = members.groupBy(*by).agg(F.count("*").alias("papers"), F.avg(recency_weight(F.col("year"), as_of)).alias("recency"), F.avg(1 - rate / 100).alias("novelty"))
    sizes = own.groupBy(*keys).agg(F.sum("papers").alias("all_papers"))
    marks = evidence.filter(F.col("kind").isin("limitation", "future_work")).join(members.select(*by, "paper_id"), [*keys, "paper_id"])
    tokens = marks.groupBy(*by).agg(F.count_distinct("term").alias("tokens"), F.count_distinct(F.when(F.col("kind") == "future_work", F.col("term"))).alias("own_future"))
    future = marks.filter("kind = 'future_work'").groupBy(*keys).agg(F.count_distinct("term").alias("all_future"))
    rows = own.join(sizes, list(keys)).join(tokens, by, "left").join(future, list(keys), "left")
    rows = rows.withColumns({
        "recurrence": F.least(F.lit(1.0), F.col("papers") / F.col("all_papers") * 1.5),
        "evidence": F.least(F.lit(1.0), F.log1p(F.coalesce("tokens", F.lit(0))) / F.log1p(F.lit(10.0))),
        "coverage": F.when(F.coalesce("all_future", F.lit(0)) == 0, 0.5).otherwise(F.coalesce(F.col("own_future") / F.col("all_future"), F.lit(0.0))),
    })
    raw = 0.35 * F.col("recurrence") + 0.25 * F.col("evidence") + 0.15 * F.col("recency") + 0.15 * F.col("coverage") + 0.10 * F.col("novelty")
    return rows.select(*by, F.least(F.lit(0.99), F.greatest(F.lit(0.05), raw)).alias("score"), "recurrence", "evidence", "recency", "coverage", "novelty")


def cluster_priority(members: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """Clusters by size, the largest first; ``to_model`` marks those that a text model gets."""
    sizes = members.filter("cluster >= 0").groupBy(*keys, "cluster").agg(F.count("*").alias("papers"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("papers"), "cluster"))
    return sizes.withColumn("place", place).withColumn("to_model", F.col("place") <= most)


def model_context(members: DataFrame, themes: DataFrame, papers_per_cluster: int = 8, chars: int = 300) -> DataFrame:
    """(cluster, context, other_themes): what a text model is told of a cluster (the cut is the feature)."""
    rows = first_per(members, ["cluster"], [F.desc("citation_count"), "paper_id"], papers_per_cluster)
    line = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nAbstract: "), F.substring(F.coalesce("abstract", F.lit("")), 1, chars))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("paper_id", line.alias("line")))), lambda x: x["line"]), "\n")
    rows = rows.groupBy("cluster").agg(text.alias("context"))
    every = themes.agg(F.sort_array(F.collect_set("theme")).alias("all_themes"))  # one row, a label a cluster
    own = themes.select("cluster", "theme")
    return rows.join(own, "cluster", "left").crossJoin(every).select("cluster", "context", F.array_except("all_themes", F.array("theme")).alias("other_themes"))


def heuristic_gaps(members: DataFrame, evidence: DataFrame, topic: str = "topic_id") -> DataFrame:
    """One gap a cluster in fixed words, from its commonest limitation and future work."""
    rows = evidence.filter(F.col("kind").isin("limitation", "future_work")).select("paper_id", "kind", "term").join(members.select(topic, "cluster", "paper_id"), "paper_id")
    counts = first_per(rows.groupBy(topic, "cluster", "kind", "term").agg(F.count("*").alias("n")), [topic, "cluster", "kind"], [F.desc("n"), "term"])
    most = counts.groupBy(topic, "cluster").agg(F.max(F.when(F.col("kind") == "limitation", F.col("term"))).alias("lim"), F.max(F.when(F.col("kind") == "future_work", F.col("term"))).alias("fw"))
    sizes = members.groupBy(topic, "cluster").agg(F.count("*").alias("papers"))
    rows = sizes.join(most, [topic, "cluster"], "left").withColumns({"lim": F.coalesce("lim", F.lit("unclear limitations")), "fw": F.coalesce("fw", F.lit("unspecified future work"))})
    return rows.select(
        topic, "cluster", "papers",
        F.concat(F.lit("Unresolved gap in "), F.col(topic), F.lit(": "), F.substring("lim", 1, 60)).alias("title"),
        F.format_string("Across %s papers in this cluster, a recurring limitation is '%s'. Authors frequently cite '%s' as open future work.", F.col("papers").cast("string"), "lim", "fw").alias("description"),
        F.col("lim").alias("what_fails"), F.col("fw").alias("missing_piece"), category(F.concat_ws(" ", "lim", "fw")).alias("category"),
        F.format_string("Address '%s' through a targeted study focused on '%s'.", "lim", "fw").alias("direction"),
    )


def influential_counts(papers: DataFrame, keys: list[str], as_of: int) -> DataFrame:
    """Papers, recent ones, influential by weight and by more than ten citations (two readings of the word)."""
    weight = citation_weight(F.col("citation_count"), F.col("year"), as_of)
    return papers.groupBy(*keys).agg(F.count("*").alias("papers"), F.count_if(F.col("year") >= as_of - 2).alias("recent"), F.count_if(weight >= 1.0).alias("influential_by_weight"), F.count_if(F.col("citation_count") > 10).alias("influential_by_count"))


EXPLORED_FIELDS = ("title", "description", "what_fails", "why_it_exists", "missing_piece", "direction", "theme")


def explored(gaps: DataFrame, low: float = 0.0, high: float = 1.0, cluster: int | None = None, text: str | None = None, order: str = "confidence") -> DataFrame:
    """Gaps by confidence range, cluster and a text that one of seven fields holds; ordered by confidence, cluster or title."""
    rows = gaps.filter(F.col("confidence").between(low, high))
    if cluster is not None:
        rows = rows.filter(F.col("cluster") == cluster)
    if text:
        hay = F.lower(F.concat_ws("\n", *[c for c in EXPLORED_FIELDS if c in gaps.columns]))
        rows = rows.filter(F.contains(hay, F.lit(text.lower())))
    ways = {"confidence": [F.desc("confidence"), "gap_id"], "cluster": ["cluster", F.desc("confidence"), "gap_id"], "title": [F.lower("title"), "gap_id"]}
    return rows.orderBy(*ways[order])
