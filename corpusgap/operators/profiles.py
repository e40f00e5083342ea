"""Interest signals, profiles and affinities, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import citation_score, decay, kind_weight, recency_score, vote_weight
from .corpus import first_per

# Weight of seed topics and how many searches end it; windows of signals; affinity of searches, authors and venues.
SEED_WEIGHT, SEED_SEARCHES = 0.5, 5
SEARCH_WEIGHT, AUTHOR_SHARE, VENUE_SHARE = 0.5, 0.6, 0.4


def days_before(ts: str, as_of: str) -> Column:
    return (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts)) / 86400.0


def interaction_signals(interactions: DataFrame, as_of: str, days: int = 30, newest: int = 200, tau: float = 21.0) -> DataFrame:
    """(user_id, external_id, kind, weight) of each user's newest interactions in the window."""
    age = days_before("ts", as_of)
    rows = first_per(interactions.filter((age >= 0) & (age <= days)), ["user_id"], [F.desc("ts"), "external_id", "kind"], newest)
    return rows.withColumn("weight", kind_weight(F.col("kind")) * decay(age, tau))


def search_signals(history: DataFrame, as_of: str, days: int = 30, newest: int = 50, tau: float = 14.0) -> DataFrame:
    """(user_id, search_id, topic, created_at, weight) of each user's newest searches in the window; blank topics don't count."""
    age = days_before("created_at", as_of)
    rows = history.filter((age >= 0) & (age <= days) & (F.btrim("topic") != ""))
    return first_per(rows, ["user_id"], [F.desc("created_at"), "search_id"], newest).withColumn("weight", decay(age, tau))


def feedback_state(feedback: DataFrame) -> DataFrame:
    """The state of each (user, gap) after all patches: last vote, pursuit, note and address that were set.

    A vote of '' clears; where the input has no ``note`` or ``addressed_by`` they are left out.
    """
    order = F.struct("updated_at", "event_id")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    extra = [last(c) for c in ("note", "addressed_by") if c in feedback.columns]
    rows = feedback.groupBy("user_id", "gap_id").agg(last("vote"), F.max_by("pursue", order).alias("pursue"), F.max("updated_at").alias("updated_at"), *extra)
    rows = rows.withColumn("vote", F.nullif("vote", F.lit("")))
    return rows.withColumn("weight", vote_weight(F.col("vote"), F.col("pursue")))


def gap_signals(state: DataFrame, newest: int = 50) -> DataFrame:
    """(user_id, gap_id, weight) of each user's newest feedback that isn't neutral."""
    return first_per(state, ["user_id"], [F.desc("updated_at"), "gap_id"], newest).filter("weight <> 0").select("user_id", "gap_id", "weight")


def profile_components(seeds: DataFrame, searches: DataFrame, gaps: DataFrame, interactions: DataFrame) -> DataFrame:
    """(user_id, kind, label, weight, item): what a profile is made of.

    seeds (user_id, topic, item), searches as of ``search_signals`` with item, gaps (user_id, gap_id,
    weight, item), interactions as of ``interaction_signals``; ``item`` names the vector.  Seeds fade
    with the number of searches and are gone after five.
    """
    counts = searches.groupBy("user_id").agg(F.count("*").alias("searches"))
    fade = F.greatest(F.lit(0.0), 1 - F.coalesce("searches", F.lit(0)) / SEED_SEARCHES)
    parts = [
        seeds.join(counts, "user_id", "left").select("user_id", F.lit("seed").alias("kind"), F.col("topic").alias("label"), (fade * SEED_WEIGHT).alias("weight"), "item"),
        searches.select("user_id", F.lit("search").alias("kind"), F.col("topic").alias("label"), "weight", "item"),
        gaps.select("user_id", F.when(F.col("weight") > 0, "gap_positive").otherwise("gap_negative").alias("kind"), F.col("gap_id").cast("string").alias("label"), "weight", "item"),
        interactions.select("user_id", F.when(F.col("weight") > 0, "interaction_positive").otherwise("interaction_negative").alias("kind"), F.col("external_id").alias("label"), "weight", F.col("external_id").alias("item")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part.withColumn("item", F.col("item").cast("string")))
    return rows.filter("weight <> 0")


def top_labels(components: DataFrame, k: int = 5) -> DataFrame:
    """(user_id, label, place): the strongest positive labels, each once whatever its case."""
    rows = components.filter("weight > 0").groupBy("user_id", F.lower(F.btrim("label")).alias("key")).agg(F.max_by("label", F.struct(F.round("weight", 9), "label")).alias("label"), F.max("weight").alias("weight"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("weight", 9)), "key"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).select("user_id", "label", "place")


def component_counts(components: DataFrame) -> DataFrame:
    """(user_id, kinds): a map of component kinds to their number."""
    counts = components.groupBy("user_id", "kind").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("kinds"))


def _affinity(weights: DataFrame, name: str, k: int) -> DataFrame:
    sums = weights.groupBy("user_id", name).agg(F.sum("weight").alias("total"))
    sums = first_per(sums, ["user_id"], [F.desc(F.round("total", 9)), name], k)
    peak = F.max("total").over(Window.partitionBy("user_id"))
    return sums.select("user_id", name, F.when(peak > 0, F.col("total") / peak).otherwise(F.col("total")).alias("weight"))


def _recency(ts: str, as_of: str, days: int) -> Column:
    age = days_before(ts, as_of)
    return F.when(F.col(ts).isNull(), 0.4).otherwise(F.greatest(F.lit(0.2), F.exp(-age / days)))


def author_affinity(library: DataFrame, as_of: str, days: int = 60, k: int = 25, first: int = 8) -> DataFrame:
    """(user_id, author, weight): authors of the user's library, newer items count more, scaled by the peak; the top ``k``.

    library (user_id, authors array, venue, added_at).
    """
    rows = library.select("user_id", F.explode(F.slice("authors", 1, first)).alias("author"), _recency("added_at", as_of, days).alias("weight"))
    return _affinity(rows.select("user_id", F.lower(F.btrim("author")).alias("author"), "weight").filter("author <> ''"), "author", k)


def venue_affinity(library: DataFrame, history: DataFrame, as_of: str, days: int = 60, newest: int = 100, k: int = 25) -> DataFrame:
    """(user_id, venue, weight): venues of the library, and at half weight those that recent searches asked for."""
    age = days_before("created_at", as_of)
    asked = first_per(history.filter((age <= days) & F.col("venue").isNotNull()), ["user_id"], [F.desc("created_at"), "search_id"], newest)
    asked = asked.select("user_id", "venue", (_recency("created_at", as_of, days) * SEARCH_WEIGHT).alias("weight"))
    rows = library.select("user_id", "venue", _recency("added_at", as_of, days).alias("weight")).unionByName(asked)
    return _affinity(rows.select("user_id", F.lower(F.btrim("venue")).alias("venue"), "weight").filter("venue <> ''"), "venue", k)


def affinity_scores(candidates: DataFrame, authors: DataFrame, venues: DataFrame, first: int = 5) -> DataFrame:
    """(user_id, external_id, score) of candidates (user_id, external_id, authors array, venue), at most 1.

    .6 times the weights of a paper's first authors, .4 times that of the strongest known venue that
    is the paper's, holds it or is held by it (four characters at least).  Each candidate comes once; it
    meets one row a user, which lists the user's at most 25 authors and 25 venues.
    """
    listed = lambda rows, name: rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("minus"), name))).alias(f"known_{name}"))
    known = listed(authors, "author").join(listed(venues, "venue"), "user_id", "full")
    names, own = F.transform(F.slice("authors", 1, first), lambda a: F.lower(F.btrim(a))), F.lower(F.btrim("venue"))
    by_author = F.aggregate(F.filter("known_author", lambda k: F.array_contains(names, k["author"])), F.lit(0.0), lambda s, k: s - k["minus"])
    long = lambda v: (F.length(v) >= 4) & (F.length(own) >= 4) & (F.contains(own, v) | F.contains(v, own))
    fit = F.filter("known_venue", lambda k: (k["venue"] == own) | long(k["venue"]))
    by_venue = F.when(own != "", -F.try_element_at(fit, F.lit(1))["minus"])
    score = F.coalesce(by_author, F.lit(0.0)) * AUTHOR_SHARE + F.coalesce(by_venue, F.lit(0.0)) * VENUE_SHARE
    rows = candidates.select("user_id", "external_id", "authors", "venue").join(known, "user_id", "left")
    return rows.select("user_id", "external_id", F.least(score, F.lit(1.0)).alias("score"))


def popular(papers: DataFrame, as_of: int, page: int, per_venue: int = 3) -> DataFrame:
    """Each topic's page by recency and citations; at most ``per_venue`` of a venue until the page can't be filled otherwise."""
    score = 0.55 * recency_score(F.col("year"), as_of) + 0.45 * citation_score(F.col("citation_count"))
    best = [F.desc(F.round("score", 9)), "pos"]
    in_venue = F.row_number().over(Window.partitionBy("topic_id", F.coalesce("venue", F.lit(""))).orderBy(*best))
    # No page holds more than ``page`` papers of a venue, so the rest of a venue goes before anything is sorted.
    rows = papers.withColumn("score", score).withColumn("in_venue", in_venue).filter(F.col("in_venue") <= page)
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy((F.col("in_venue") <= per_venue).desc(), *best))
    return rows.withColumn("place", place).filter(F.col("place") <= page)


def seen_ids(interactions: DataFrame, as_of: str, days: int = 21, newest: int | None = 30) -> DataFrame:
    """(user_id, external_id, ts): what a user saw in the window, and what has no date; the newest ones."""
    latest = interactions.filter(F.col("ts").isNull() | days_before("ts", as_of).between(0, days)).groupBy("user_id", "external_id").agg(F.max("ts").alias("ts"))
    return latest if newest is None else first_per(latest, ["user_id"], [F.desc_nulls_last("ts"), "external_id"], newest)


def compacted_log(log: DataFrame, newest: int = 1000) -> DataFrame:
    """The newest rows of each user's impression log (the cap is the feature)."""
    return first_per(log, ["user_id"], [F.desc("ts"), "external_id"], newest)


def stale_profiles(built: DataFrame, signals: DataFrame) -> DataFrame:
    """(user_id, newest): users with signals (user_id, ts) newer than their profile (user_id, updated_at), or without one."""
    newest = signals.groupBy("user_id").agg(F.max("ts").alias("newest"))
    return newest.join(built, "user_id", "left").filter("updated_at IS NULL OR newest > updated_at").select("user_id", "newest")


def recent_topics(history: DataFrame, k: int = 5, client: DataFrame | None = None) -> DataFrame:
    """(user_id, topic, created_at, place): a user's newest topics, each once; then those the client sent (user_id, topic, pos)."""
    rows = history.filter(F.btrim("topic") != "").groupBy("user_id", F.lower("topic").alias("topic")).agg(F.max("created_at").alias("created_at")).withColumns({"pool": F.lit(0), "pos": F.lit(0)})
    if client is not None:
        sent = client.groupBy("user_id", F.lower(F.btrim("topic")).alias("topic")).agg(F.min("pos").cast("int").alias("pos")).filter("topic <> ''")
        sent = sent.join(rows.select("user_id", "topic"), ["user_id", "topic"], "left_anti")
        rows = rows.unionByName(sent.select("user_id", "topic", F.lit(None).cast("timestamp").alias("created_at"), F.lit(1).alias("pool"), "pos"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("pool", F.desc("created_at"), "pos", "topic"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).select("user_id", "topic", "created_at", "place")


def diagnostics(papers: DataFrame, vectors: DataFrame, components: DataFrame, seen: DataFrame) -> DataFrame:
    """One row: papers, embedded papers, sizes of vectors, users with a profile, seen marks."""
    return (
        papers.agg(F.count("*").alias("papers"))
        .crossJoin(vectors.agg(F.count("*").alias("embedded"), F.min(F.size("embedding")).alias("least_dims"), F.max(F.size("embedding")).alias("most_dims")))
        .crossJoin(components.agg(F.count_distinct("user_id").alias("profiles"), F.count("*").alias("components")))
        .crossJoin(seen.agg(F.count("*").alias("seen")))
    )  # each side is one row


def profile_summary(components: DataFrame, seeds: DataFrame, updated: DataFrame) -> DataFrame:
    """(user_id, top_topics, seed_topics, updated_at, component_counts): what a user is told of the profile.

    seeds (user_id, topic), updated (user_id, updated_at); users of any of the three have a row.
    """
    ordered = lambda rows, c, by: rows.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(by, c))), lambda x: x[c]).alias("list"))
    tops = ordered(top_labels(components), "label", "place").withColumnRenamed("list", "top_topics")
    own = seeds.groupBy("user_id").agg(F.sort_array(F.collect_set("topic")).alias("seed_topics"))
    counts = component_counts(components).withColumnRenamed("kinds", "component_counts")
    users = components.select("user_id").unionByName(seeds.select("user_id")).unionByName(updated.select("user_id")).distinct()
    rows = users.join(tops, "user_id", "left").join(own, "user_id", "left").join(updated, "user_id", "left").join(counts, "user_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("user_id", F.coalesce("top_topics", none).alias("top_topics"), F.coalesce("seed_topics", none).alias("seed_topics"), "updated_at", "component_counts")


def user_diagnostics(users: DataFrame, components: DataFrame, seen: DataFrame, vectors: DataFrame, authors: DataFrame, venues: DataFrame, parts: int = 8, names: int = 5) -> DataFrame:
    """One row a user: (user_id, state, dims, seen, top_components, top_authors, top_venues).

    vectors (user_id, vector), authors and venues as of the affinities; the strongest ``parts`` components
    come with kind, label and weight, the strongest ``names`` of the others by name.
    """
    def strongest(rows: DataFrame, k: int, name: str, shown: list) -> DataFrame:
        best = first_per(rows, ["user_id"], [F.desc(F.round("weight", 9)), *shown], k)
        place = F.struct((-F.round("weight", 9)).alias("minus"), *shown)
        value = (lambda x: x[shown[0]]) if len(shown) == 1 else (lambda x: F.struct(*[x[c].alias(c) for c in shown], F.round(-x["minus"], 3).alias("weight")))
        return best.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(place)), value).alias(name))

    marks = seen.groupBy("user_id").agg(F.count("*").alias("seen"))
    rows = users.select("user_id").distinct().join(vectors.select("user_id", F.size("vector").alias("dims")), "user_id", "left").join(marks, "user_id", "left")
    for part in (strongest(components, parts, "top_components", ["kind", "label"]), strongest(authors, names, "top_authors", ["author"]), strongest(venues, names, "top_venues", ["venue"])):
        rows = rows.join(part, "user_id", "left")
    state = F.when(F.col("top_components").isNull(), "cold_start").otherwise("ready")
    return rows.select("user_id", state.alias("state"), "dims", F.coalesce("seen", F.lit(0)).alias("seen"), "top_components", "top_authors", "top_venues")
