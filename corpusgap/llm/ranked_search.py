"""Ranked lexical search: range-maximum tables over posting lists, best intervals first.

Scores are integers: a term's weight times its impact in a document, summed over the
terms of the query.  Documents are read once per block of queries.  That pass keeps, of
every whole text, its length and the occurrences of the block's terms; document counts
and frequencies are taken over all documents from the table it writes.

A task then turns some thousand documents at a time into posting lists with a sparse
table each, which answers in constant time where the largest impact of any stretch of a
list stands.  A query begins with the interval of all documents.  An interval's bound is
the sum of its lists' largest contributions; the intervals of the largest bounds are
split at the document of their largest contribution, which is scored in full, and short
ones are scored whole.  What can't reach the k-th best score that the task has found so
far, over all its documents, is left.  A task hands on at most k rows a query.

Terms are maximal runs of ASCII letters, digits and all code points beyond ASCII; only
A-Z is lowered.

Defined cases: null and empty texts have no terms, count nowhere and aren't found.
Equal scores are ordered by id, null ids last; rows of one id are ranked each.  Every
row of the queries is a query of its own, so that repeated rows and item ids give their
ranks again; one without known terms gives no rows.  Empty tables give empty ones.
Columns other than id and text are ignored.  Memory follows one text, one query, or one
shard of at most ``SHARD`` documents and about ``POSTINGS`` postings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import Scratch

#: Terms of the queries that one pass over the documents looks for, about.
BLOCK_TERMS = 1 << 17
#: Documents and postings of a shard.
SHARD, POSTINGS = 1 << 13, 1 << 20
#: Documents of an interval that is scored whole; intervals that are looked at together, at first and at most.
LEAF, FIRST, MOST = 16, 16, 256
_PIECE = 1 << 22
_TERM = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
#: All ASCII but letters and digits becomes a space, A-Z is lowered.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
_NO_ID = np.int64((1 << 63) - 1)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text (UTF-8), some megabytes at a time."""
    at = 0
    while at < len(text):
        gap = _TERM.search(text, at + _PIECE)
        to = gap.start() if gap else len(text)
        yield text[at:to].translate(_PLAIN).split()
        at = to


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Shard:
    """Posting lists of some documents (in the order of their ids), with their range-maximum tables."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int, documents: int, total: int):
        self.size = len(lengths)
        doc = np.repeat(np.arange(self.size), counts)
        self.key = term.astype(np.int64) * self.size + doc
        order = np.argsort(self.key)
        self.key, self.doc = self.key[order], doc[order]
        slack = 75 + 25 * lengths.astype(np.int64) * documents // max(1, total)
        tf = tf.astype(np.int64)[order]
        self.impact = 1_000_000_000 * tf // (1000 * tf + 12 * slack[self.doc])
        self.ends = np.cumsum(np.bincount(term, minlength=n_terms))
        self.starts = self.ends - np.bincount(term, minlength=n_terms)
        # levels[k][i]: where the largest impact of the 2**k postings from i on stands, the first of equals.
        at = np.arange(len(tf), dtype=np.int32)
        self.levels = [at]
        longest = int((self.ends - self.starts).max(initial=0))
        while 2 << len(self.levels) - 1 <= longest:
            step = 1 << len(self.levels) - 1
            left, right = self.levels[-1][:-step], self.levels[-1][step:]
            below = self.levels[-1].copy()
            below[: len(left)] = np.where(self.impact[left] >= self.impact[right], left, right)
            self.levels.append(below)
        self.levels = np.stack(self.levels)

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the largest impact of the postings lo to hi stands (lo < hi)."""
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        a, b = self.levels[k, lo], self.levels[k, hi - (1 << k)]
        return np.where(self.impact[a] >= self.impact[b], a, b)


class Best:
    """The k best (score, id) so far."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, id_: np.ndarray) -> None:
        if len(self.score) == self.k:
            enough = (score > self.score[-1]) | ((score == self.score[-1]) & (id_ <= self.id[-1]))
            score, id_ = score[enough], id_[enough]
        if len(score):
            score, id_ = np.concatenate([self.score, score]), np.concatenate([self.id, id_])
            order = np.lexsort((id_, -score))[: self.k]
            self.score, self.id = score[order], id_[order]

    def hopeless(self, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Of intervals with these bounds and least ids: those that can't change the k best."""
        if len(self.score) < self.k:
            return bound <= 0
        return (bound < self.score[-1]) | (bound <= 0) | ((bound == self.score[-1]) & (least_id > self.id[-1]))


def search(shard: Shard, ids: np.ndarray, term: np.ndarray, worth: np.ndarray, best: Best) -> None:
    """Puts the shard's best documents for one query (terms, and weight times repeats of each) into ``best``."""
    there = shard.starts[term] < shard.ends[term]
    term, worth = term[there], worth[there]
    if not len(term):
        return

    def bounds(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bound, document of the largest contribution) of intervals, by the stretches of their posting lists."""
        full = left < right
        value, at = np.zeros(left.shape, np.int64), np.zeros(left.shape, np.int64)
        at[full] = shard.largest(left[full], right[full])
        value[full] = np.broadcast_to(worth, left.shape)[full] * shard.impact[at[full]]
        top = value.argmax(axis=1)
        return value.sum(axis=1), shard.doc[at[np.arange(len(top)), top]]

    lo, hi = np.zeros(1, np.int64), np.array([shard.size])
    left, right = shard.starts[term][None, :], shard.ends[term][None, :]
    bound, middle = bounds(left, right)
    scores, many = np.zeros(shard.size, np.int64), FIRST
    while len(lo):
        keep = ~best.hopeless(bound, ids[lo])
        lo, hi, left, right, bound, middle = (x[keep] for x in (lo, hi, left, right, bound, middle))
        if not len(lo):
            return
        chosen = np.zeros(len(lo), bool)
        chosen[np.argpartition(-bound, min(many, len(lo)) - 1)[:many]] = True
        many = min(MOST, 2 * many)
        short = chosen & (hi - lo <= LEAF)
        if short.any():
            counts = (right[short] - left[short]).ravel()
            first = np.cumsum(counts) - counts
            at = np.arange(counts.sum()) - np.repeat(first - left[short].ravel(), counts)
            np.add.at(scores, shard.doc[at], np.repeat(np.tile(worth, int(short.sum())), counts) * shard.impact[at])
            seen = np.unique(shard.doc[at])
            best.add(scores[seen], ids[seen])
        rest = [x[~chosen] for x in (lo, hi, left, right, bound, middle)]
        split = chosen & ~short
        if split.any():
            a, b, d, l, r = lo[split], hi[split], middle[split], left[split], right[split]
            wanted = term[None, :] * shard.size + d[:, None]
            cut = np.clip(np.searchsorted(shard.key, wanted), l, r)
            held = (cut < r) & (shard.key[np.minimum(cut, len(shard.key) - 1)] == wanted)
            best.add((held * worth * shard.impact[np.minimum(cut, len(shard.key) - 1)]).sum(axis=1), ids[d])
            after = cut + held
            new = [np.concatenate(x) for x in ((a, d + 1), (d, b), (l, after), (cut, r))]
            new = [x[new[0] < new[1]] for x in new]
            rest = [np.concatenate(x) for x in zip(rest, [*new, *bounds(new[2], new[3])])]
        lo, hi, left, right, bound, middle = rest


def _query_terms(items: DataFrame) -> DataFrame:
    """(row, item_id, terms array<string>, repeats array<long>) of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(t.decode() for some in terms(text or b"") for t in some) for text in batch.column(2).to_pylist()]
            columns = [pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["row", "item_id", "terms", "repeats"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("row", "item_id", F.col("text").cast("binary")).mapInArrow(run, f"row long, item_id {kind}, terms array<string>, repeats array<long>")


def _occurrences(docs: DataFrame, place) -> DataFrame:
    """(id, length, terms array<int>, tfs array<int>) of every document with terms; only the terms of ``place`` are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.value
        for batch in batches:
            ids, lengths, terms_, tfs, sizes = [], [], [], [], []
            for i, id_ in enumerate(batch.column(0).to_pylist()):
                n, count = 0, Counter()
                for some in terms(batch.column(1)[i].as_py() or b""):
                    n += len(some)
                    count.update(map(known.get, some))
                if n:
                    count.pop(None, None)
                    ids.append(id_)
                    lengths.append(n)
                    sizes.append(len(count))
                    terms_ += count
                    tfs += count.values()
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms_, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], ["id", "length", "terms", "tfs"])

    return docs.mapInArrow(run, "id long, length long, terms array<int>, tfs array<int>")


def _best_of_shards(queries, n_terms: int, documents: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        best = [Best(k) for _ in asked]
        kept: list[tuple[np.ndarray, ...]] = []

        def settle() -> None:
            ids, length, count, term, tf = (np.concatenate([x[i] for x in kept]) for i in range(5))
            kept.clear()
            order = np.argsort(ids, kind="stable")
            first = np.cumsum(count) - count
            take = np.arange(count.sum()) - np.repeat(np.cumsum(count[order]) - count[order] - first[order], count[order])
            shard = Shard(length[order], count[order], term[take], tf[take], n_terms, documents, total)
            for (_, wanted, worth), found in zip(asked, best):
                search(shard, ids[order], wanted, worth, found)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                ids = some.column(0).fill_null(int(_NO_ID)).to_numpy()
                terms_, tfs = some.column(2), some.column(3)
                kept.append((ids, some.column(1).to_numpy(), np.diff(terms_.offsets.to_numpy()), terms_.flatten().to_numpy(), tfs.flatten().to_numpy()))
                if sum(len(x[0]) for x in kept) >= SHARD or sum(len(x[3]) for x in kept) >= POSTINGS:
                    settle()
        if kept:
            settle()
        rows = np.repeat(np.array([row for row, _, _ in asked], np.int64), [len(b.id) for b in best])
        ids = np.concatenate([b.id for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ids, mask=ids == _NO_ID), pa.array(np.concatenate([b.score for b in best]))], ["row", "doc_id", "score"])

    return run


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``k`` documents of the highest scores above 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked-search")
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    items = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    queries = scratch.settle(_query_terms(items))
    blocks = max(1, math.ceil((queries.agg(F.sum(F.size("terms"))).first()[0] or 0) / BLOCK_TERMS))
    found = None
    for block in range(blocks):
        # About BLOCK_TERMS terms of queries at a time: the driver and the tasks hold no more of them.
        some = queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "terms", "repeats").collect()
        place = {t: n for n, t in enumerate(sorted({t for q in some for t in q["terms"]}))}
        if not place:
            continue
        known = spark.sparkContext.broadcast({t.encode(): n for t, n in place.items()})
        postings = scratch.settle(_occurrences(docs, known))
        documents, total = postings.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        holding = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        asked = []
        for q in some:
            term = np.array([place[t] for t in q["terms"]], np.int64)
            worth = np.array([weight(documents, holding.get(n, 0)) for n in term.tolist()], np.int64) * np.array(q["repeats"], np.int64)
            asked.append((q["row"], term, worth))
        task = _best_of_shards(spark.sparkContext.broadcast(asked), len(place), documents, total, k)
        part = scratch.settle(postings.mapInArrow(task, "row long, doc_id long, score long"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "row long, doc_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
    return ranked.join(queries.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
