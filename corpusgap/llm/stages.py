"""The filters of the cleaning pipeline.  Each returns rows of ``docs`` with its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join, quality, toxicity
from .session import Scratch, fresh


def _with_score(docs: DataFrame, text: str, score, model) -> tuple[DataFrame, str]:
    """``docs`` with a score."""
    name = fresh(docs, "stage_score")
    return score(docs, model, text=text, name=name, keep_text=True).select(*[F.col(f"`{c}`") for c in docs.columns], name), name


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, text: str = "text") -> DataFrame:
    """The documents that the quality classifier scores ``least`` or more; it is fitted on labelled rows of ``docs``."""
    rows, name = _with_score(docs, text, quality.score, quality.fit(docs, labels))
    return rows.filter(F.col(name) >= least).drop(name)


def drop_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.3, text: str = "text") -> DataFrame:
    """The documents that the toxicity classifier scores under ``most``; it is fitted on labelled rows of ``docs``."""
    rows, name = _with_score(docs, text, toxicity.score, toxicity.fit(docs, labels))
    return rows.filter(F.col(name) < most).drop(name)


def one_per_group(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id") -> DataFrame:
    """The row with the least id of each group of near duplicates; ids may be null (the last in order) or name many rows.

    Rows are told by a key of their own, settled with them, so that every reading of ``docs`` has the same keys.
    """
    key = fresh(docs, "stage_row")
    rows = Scratch(docs.sparkSession, "one-per-group").settle(docs.withColumn(key, F.monotonically_increasing_id()))
    groups = ngram_join.similar_groups(rows, width=width, num=num, den=den, doc_id=key).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(key).alias("row"), F.col(doc_id).alias("id"))
    order = F.struct(F.col("id").isNull(), "id", "row")
    chosen = groups.join(ids.hint("shuffle_hash"), "row").groupBy("component_id").agg(F.min_by("row", order).alias(key))
    return rows.join(chosen.select(key).hint("shuffle_hash"), key, "left_semi").select(*docs.columns)
