"""Bounded labelled samples and hashed n-grams for the two classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import U64, Texts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column | None, per_class: int, doc_id: str = "doc_id", text: str = "text") -> pa.Table:
    """At most ``per_class`` labelled texts of each class, the same ones at every run.

    ``learn`` says which label rows may be used.  Two sorted-limit jobs over the label
    table fix at most 2 * per_class ids; only those, of proven size, are broadcast.
    Null labels and null ids are left out; of repeated ids one row counts.
    """
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    if learn is not None:
        rows = rows.filter(learn)
    # Only ids that ``docs`` has: a stage before may have taken labelled rows away.
    rows = rows.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    pick = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = pick[0].unionByName(pick[1]).dropDuplicates(["doc_id"])
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()


def class_shares(labels: DataFrame, label: str, learn: Column | None) -> float:
    """Share of label 1 among all label rows that may be learnt from; 0.5 if there are none."""
    rows = labels.filter(F.col(label).isin(0, 1))
    if learn is not None:
        rows = rows.filter(learn)
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum(F.col(label)), F.lit(0))).first()
    return (ones + 1) / (n + 2)


def gram_buckets(texts: Texts, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of every run of ``size`` characters (code points) inside a document; place: its first byte."""
    first = np.flatnonzero((texts.bytes & 0xC0) != 0x80)
    n = len(first) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    after = np.append(first[1:], len(texts.bytes))
    start, end = first[:n], after[size - 1 :]
    # A run is inside a document if no document ends in it before its own end.
    ends = np.unique(texts.ends[texts.ends > texts.starts])
    ok = ends[np.minimum(np.searchsorted(ends, start, side="right"), len(ends) - 1)] >= end
    return start[ok], (texts.range_hash(start[ok], end[ok]) >> U64(64 - bits)).astype(np.int64)


def scored(df: DataFrame, text: str, name: str, score, keep_text: bool = False) -> DataFrame:
    """``df`` with ``score(text column) -> doubles``, without ``text`` unless it is to be kept; a narrow map."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    columns = [c for c in df.columns if c != text] + [text]
    out = columns if keep_text else columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(out)], pa.array(score(batch.columns[-1]))], [*out, name])

    schema = StructType([*(df.schema[c] for c in out), StructField(name, DoubleType())])
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
