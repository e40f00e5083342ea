"""Similarity between stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import cosine


def profile_vectors(signals: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, vector): sum of weight * vector over the sum of absolute weights, at length 1.

    signals (user_id, external_id, weight).  The sums run by user and position, so partial
    sums are made before the shuffle and no user's signals are gathered.
    """
    rows = signals.join(vectors.select("external_id", "embedding"), "external_id")
    long = rows.select("user_id", "weight", F.posexplode("embedding").alias("pos", "x"))
    sums = long.groupBy("user_id", "pos").agg(F.sum(F.col("weight") * F.col("x").cast("double")).alias("s"), F.sum(F.abs("weight")).alias("w"))
    lists = sums.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("s") / F.col("w")).alias("x")))).alias("v"), F.max("w").alias("w"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e["x"] * e["x"]))
    return lists.filter((F.col("w") > 0) & (norm >= 1e-6)).select("user_id", F.transform("v", lambda e: e["x"] / norm).alias("vector"))


def grounding(claims: DataFrame) -> DataFrame:
    """(gap_id, score, status): mean cosine of claims and cited papers; claims (gap_id, vector_a, vector_b)."""
    rows = claims.withColumn("similarity", cosine(F.col("vector_a"), F.col("vector_b"))).groupBy("gap_id").agg(F.avg("similarity").alias("score"), F.count("*").alias("claims"))
    status = F.when(F.col("score") >= 0.30, "grounded").when(F.col("score") >= 0.18, "weakly_supported").otherwise("hallucinated")
    return rows.withColumn("status", status)
