"""Candidate pools and ranked feeds, for all users at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import shuffle_partitions
from ..functions.scores import citation_score, composite, cosine, recency_score
from .corpus import first_per, paper_identity, paper_rank

# Queries per user, the centroid's weight, pages that diversification looks at, its share of relevance.
TOP_COMPONENTS, CENTROID_SHARE, CENTROID_LEAST, MMR_PAGES, MMR_RELEVANCE = 5, 0.3, 0.5, 4, 0.7


def topic_candidates(recent: DataFrame, landed: DataFrame, topics: int = 3, per_source: int = 20) -> DataFrame:
    """(user_id, paper columns but title and abstract): papers landed for each user's newest topics, ``per_source`` a topic and source, each paper once.

    recent (user_id, topic, place), landed (topic, source, pos, paper columns with external_id, title and abstract).
    Users meet papers only with what ranks them; title keys travel as digests, whatever the titles' length.
    """
    address = ["url"] if "url" in landed.columns else []
    columns = [c for c in landed.columns if c not in ("topic", "title", "abstract", *address)]
    first = first_per(landed, ["topic", "source"], ["pos", "external_id"], per_source)
    slim = first.select("topic", *columns, F.unhex(F.md5(paper_identity(first))).alias("identity"), *[c.alias(n) for n, c in paper_rank(first).items()])
    order = [F.desc("priority"), F.desc("told"), "pos"]
    # What is not the best of a topic is not the best of a user that has the topic.
    slim = first_per(slim, ["topic", "identity"], order)
    rows = recent.filter(F.col("place") <= topics).select("user_id", "topic").join(slim, "topic").drop("topic")
    # The rows of a topic's users are so alike that their compressed size, by which small partitions are joined, tells nothing.
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "user_id")
    return first_per(rows, ["user_id", "identity"], order).select("user_id", *columns)


def without_seen(candidates: DataFrame, seen: DataFrame, keep_if_empty: bool = False) -> DataFrame:
    """Candidates (user_id, external_id) that a user hasn't seen; ``keep_if_empty``: all of a user's if none would be left."""
    marks = seen.select("user_id", "external_id", F.lit(True).alias("was_seen")).distinct()
    rows = candidates.join(marks, ["user_id", "external_id"], "left")
    if not keep_if_empty:
        return rows.filter("was_seen IS NULL").drop("was_seen")
    left = F.count_if(F.col("was_seen").isNull()).over(Window.partitionBy("user_id"))
    return rows.withColumn("left", left).filter("was_seen IS NULL OR left = 0").drop("was_seen", "left")


def profile_queries(components: DataFrame, centroids: DataFrame, k: int = TOP_COMPONENTS) -> DataFrame:
    """(user_id, label, weight, vector): the ``k`` strongest positive components and the centroid (label null).

    components (user_id, label, weight, vector), centroids (user_id, vector).
    """
    positive = components.filter("weight > 0")
    top = first_per(positive, ["user_id"], [F.desc(F.round("weight", 9)), "label"], k).select("user_id", "label", "weight", "vector")
    sums = positive.groupBy("user_id").agg(F.sum("weight").alias("sum"))
    weight = F.greatest(F.lit(CENTROID_LEAST), F.coalesce("sum", F.lit(0.0)) * CENTROID_SHARE)
    return top.unionByName(centroids.join(sums, "user_id", "left").select("user_id", F.lit(None).cast("string").alias("label"), weight.alias("weight"), "vector"))


def _final(similarity: Column, as_of: int, affinity: Column) -> Column:
    return composite(similarity, recency_score(F.col("year"), as_of), citation_score(F.col("citation_count")), affinity)


def ranked_by_similarity(candidates: DataFrame, queries: DataFrame, affinities: DataFrame | None, as_of: int, page: int | None = None) -> DataFrame:
    """Candidates by composite score; ``similarity`` is the best cosine with a query of positive weight, at least 0.

    candidates (user_id, external_id, year, citation_count, embedding), queries (user_id, label, weight, vector),
    affinities (user_id, external_id, score).  ``label`` names the nearest query.  Candidates without a vector are left out.
    """
    rows = candidates.filter(F.size("embedding") > 0).join(queries.filter("weight > 0").select("user_id", "label", "vector"), "user_id")
    rows = rows.withColumn("s", cosine(F.col("embedding"), F.col("vector")))
    best = rows.groupBy("user_id", "external_id").agg(
        F.greatest(F.max("s"), F.lit(0.0)).alias("similarity"), F.max_by("label", F.struct(F.round("s", 9), "label")).alias("label"), F.first("year").alias("year"), F.first("citation_count").alias("citation_count")
    )
    affinity = F.lit(0.0)
    if affinities is not None:
        best = best.join(affinities.select("user_id", "external_id", F.col("score").alias("affinity")), ["user_id", "external_id"], "left")
        affinity = F.coalesce("affinity", F.lit(0.0))
    best = best.withColumn("score", _final(F.col("similarity"), as_of, affinity))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 9)), "external_id"))
    best = best.withColumn("place", place)
    return best if page is None else best.filter(F.col("place") <= page)


def with_reasons(ranked: DataFrame, components: DataFrame) -> DataFrame:
    """Adds ``reason``: what the nearest positive component was; components (user_id, label, kind)."""
    kinds = components.groupBy("user_id", "label").agg(F.min("kind").alias("kind"))
    rows = ranked.join(kinds, ["user_id", "label"], "left")
    text = (
        F.when(F.col("kind") == "search", F.concat(F.lit("Because you searched '"), "label", F.lit("'")))
        .when(F.col("kind") == "seed", F.concat(F.lit("Matches your interest in '"), "label", F.lit("'")))
        .when(F.startswith("kind", F.lit("gap")), F.concat(F.lit("Related to the gap '"), "label", F.lit("'")))
        .when(F.startswith("kind", F.lit("interaction")), F.lit("Similar to papers you liked"))
        .otherwise("Matches your profile")
    )
    return rows.withColumn("reason", text)


def interleaved(lists: list[list], weights: list[float], limit: int) -> list:
    """Items of ranked lists in proportion to weights: next is the list with the greatest weight / (1 + picks) that isn't used up; repeats are passed over."""
    queues, picks, seen, out = [iter(x) for x in lists], [0] * len(lists), set(), []
    open_lists = list(range(len(lists)))
    while open_lists and len(out) < limit:
        i = max(open_lists, key=lambda j: (weights[j] / (1 + picks[j]), -j))
        item = next((x for x in queues[i] if x not in seen), None)
        if item is None:
            open_lists.remove(i)
            continue
        seen.add(item)
        out.append(item)
        picks[i] += 1
    return out


def interleave(ranked: DataFrame, limit: int) -> DataFrame:
    """(user_id, external_id, place): each user's ranked lists (user_id, list, weight, rank, external_id) as one.

    The pick depends on all picks before it, so each user's capped lists are handled in one call.
    """

    def run(rows: pa.Table) -> pa.Table:
        order = sorted(zip(*(rows.column(c).to_pylist() for c in ("list", "rank", "external_id", "weight")), strict=True))
        lists: dict = {}
        for name, _, item, weight in order:
            lists.setdefault(name, ([], weight))[0].append(item)
        out = interleaved([x for x, _ in lists.values()], [w for _, w in lists.values()], limit)
        user = rows.column("user_id")[0].as_py()
        return pa.table({"user_id": pa.array([user] * len(out), pa.int64()), "external_id": pa.array(out, pa.string()), "place": pa.array(range(1, len(out) + 1), pa.int32())})

    capped = ranked.filter(F.col("rank") <= limit).select("user_id", "list", "weight", "rank", "external_id")
    return capped.groupBy("user_id").applyInArrow(run, "user_id long, external_id string, place int")


def diverse_order(scores: np.ndarray, vectors: np.ndarray, page: int, relevance: float = MMR_RELEVANCE) -> list[int]:
    """Places of the items picked one by one by relevance less the greatest similarity to what is picked."""
    n = len(scores)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    units = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 1e-9)
    picked, closest = [], np.full(n, -np.inf)
    left = np.ones(n, bool)
    while left.any() and len(picked) < page:
        value = scores if not picked else relevance * scores - (1 - relevance) * closest
        at = int(np.argmax(np.where(left, value, -np.inf)))
        picked.append(at)
        left[at] = False
        closest = np.maximum(closest, units @ units[at])
    return picked


def diversified(ranked: DataFrame, page: int) -> DataFrame:
    """(user_id, external_id, place): each user's page by maximal marginal relevance over the first ``MMR_PAGES`` pages of ``ranked``.

    ranked (user_id, external_id, place, score, embedding); the greedy pick runs in one call a user, on a bounded list.
    Papers without a vector, or with one shorter than the list's longest, are like no other.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("place").to_numpy(), kind="stable")))
        given = rows.column("embedding").to_pylist()
        size = max((len(v) for v in given if v), default=1)
        vectors = np.zeros((len(given), size))  # no vector, or one of another length: like nothing
        for i, v in enumerate(given):
            if v and len(v) == size and None not in v:
                vectors[i] = v
        scores = rows.column("score").to_numpy()
        order = list(range(len(scores))) if len(scores) <= page else diverse_order(scores, vectors, page)
        rows = rows.take(pa.array(order))
        return pa.table({"user_id": rows.column("user_id"), "external_id": rows.column("external_id"), "place": pa.array(range(1, len(order) + 1), pa.int32())})

    pool = ranked.filter(F.col("place") <= MMR_PAGES * page).select("user_id", "external_id", "place", "score", "embedding")
    return pool.groupBy("user_id").applyInArrow(run, "user_id long, external_id string, place int")


def highly_cited(papers: DataFrame, page: int) -> DataFrame:
    """(external_id, place, reason): cited papers by citations, then the newest of the others, until the page is full."""
    cited = papers.filter("citation_count > 0").orderBy(F.desc("citation_count"), "external_id").limit(page).withColumn("pool", F.lit(0))
    recent = papers.filter("coalesce(citation_count, 0) <= 0").orderBy(F.desc_nulls_last("year"), "external_id").limit(page).withColumn("pool", F.lit(1))
    rows = cited.unionByName(recent)
    place = F.row_number().over(Window.orderBy("pool", F.desc(F.when(F.col("pool") == 0, F.col("citation_count"))), F.desc_nulls_last(F.when(F.col("pool") == 1, F.col("year"))), "external_id"))  # at most two pages of rows
    reason = F.when(F.col("pool") == 0, F.concat(F.lit("Highly cited ("), F.col("citation_count").cast("string"), F.lit(" citations)"))).otherwise("Recent on arXiv")
    return rows.withColumn("place", place).filter(F.col("place") <= page).select("external_id", "place", reason.alias("reason"))


def feed_chain(users: DataFrame, matched: DataFrame, cited: DataFrame, topics: DataFrame, seen: DataFrame, page: int) -> DataFrame:
    """(user_id, external_id, place, approach): matches with the user's topics; highly cited papers where there are none or no topics.

    matched (user_id, external_id, score), cited (external_id, place: a longer list), topics (user_id), seen (user_id, external_id).
    """
    own = matched.join(seen.select("user_id", "external_id"), ["user_id", "external_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 6)), "external_id"))
    own = own.withColumn("place", place).filter(F.col("place") <= page).select("user_id", "external_id", "place", F.lit("tfidf").alias("approach"))
    bare = users.select("user_id").join(own.select("user_id").distinct(), "user_id", "left_anti").join(topics.select("user_id", F.lit(True).alias("asked")).distinct(), "user_id", "left")
    rest = bare.join(F.broadcast(cited.select("external_id", F.col("place").alias("at"))))  # the list is a few pages long, whatever the corpus
    rest = rest.join(seen.select("user_id", "external_id"), ["user_id", "external_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("at"))
    rest = rest.withColumn("place", place).filter(F.col("place") <= page)
    return own.unionByName(rest.select("user_id", "external_id", "place", F.when(F.col("asked"), "highly_cited_fallback").otherwise("highly_cited").alias("approach")))


def vector_feed(users: DataFrame, ranked: DataFrame, fresh: DataFrame, popular: DataFrame, page: int) -> DataFrame:
    """(user_id, external_id, place, origin): the ranked page; under half a page is filled from the ranked fresh papers; users without either get the popular page.

    ranked and fresh (user_id, external_id, place, score), popular (external_id, place: one page).
    """
    have = ranked.filter(F.col("place") <= page)
    thin = users.select("user_id").join(have.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").filter(F.coalesce("n", F.lit(0)) < page * 0.5)
    more = fresh.join(thin.select("user_id"), "user_id", "left_semi").select("user_id", "external_id", "place", F.lit("fresh").alias("origin"), F.lit(1).alias("pool"))
    rows = have.select("user_id", "external_id", "place", F.lit("ranked").alias("origin"), F.lit(0).alias("pool")).unionByName(more)
    rows = first_per(rows, ["user_id", "external_id"], ["pool", "place"])
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("pool", "place", "external_id"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= page).select("user_id", "external_id", "place", "origin")
    cold = users.select("user_id").join(rows.select("user_id").distinct(), "user_id", "left_anti")
    return rows.unionByName(cold.join(F.broadcast(popular.select("external_id", "place"))).select("user_id", "external_id", "place", F.lit("popular").alias("origin")))
