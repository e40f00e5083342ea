"""Ranked search against plain scoring of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusgap.llm import ranked_search
from corpusgap.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, k):
    found = [(i, t) for i, text in docs if (t := Counter(plain_terms(text)))]
    n_docs, total = len(found), sum(t.total() for _, t in found)
    df = Counter(w for _, t in found for w in t)
    out = []
    for item, text in items:
        scores = []
        for i, t in found:
            m = 75 + 25 * t.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * t[w] // (1000 * t[w] + 12 * m)) for w in plain_terms(text) if w in t)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    lexicon = ["Ab", "ab", "x1", "été", "中文", "q", "_", "don't"] + ["w%d" % int(rng.expovariate(0.05)) for _ in range(150)]
    docs = [(0, None), (1, ""), (2, " -- \n"), (3, "AB ab-x1"), (None, "été q"), (None, "été q"), (5, "q " * 20_000 + "Ab")]
    while len(docs) < n:
        docs.append(rng.choice(docs) if rng.random() < 0.3 else (len(docs), rng.choice(" ,\n-").join(rng.choices(lexicon, k=rng.randint(1, 90)))))
    items = [(0, None), (1, "--"), (2, "unknownword"), (3, "ab AB été"), (3, "ab AB été"), (None, "q w1 w2"), (4, "w3 w4 " * 40)]
    items += [(10 + j, " ".join(rng.choices(lexicon, k=rng.randint(1, 45)))) for j in range(20)]
    return docs, items


@pytest.mark.parametrize(("shard", "postings", "block", "leaf", "piece"), [(1 << 13, 1 << 20, 1 << 17, 16, 1 << 22), (50, 1 << 20, 40, 1, 64), (1000, 900, 30, 4, 1)])
def test_equals_plain_scores(spark, monkeypatch, shard, postings, block, leaf, piece):
    docs, items = corpus(700, shard)
    task = ranked_search._best_of_shards

    def small(*args):
        run = task(*args)

        def inner(batches):
            ranked_search.SHARD, ranked_search.POSTINGS, ranked_search.LEAF = shard, postings, leaf
            yield from run(batches)

        return inner

    monkeypatch.setattr(ranked_search, "_best_of_shards", small)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(ranked_search, "_PIECE", piece)
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, item_id string, rank int").repartition(3)
    q = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_id int").repartition(2)
    assert got(ranked_search.top_documents(d, q, k=7)) == expected(docs, items, 7)
    assert got(ranked_search.top_documents(d.limit(0), q)) == [] and got(ranked_search.top_documents(d, q.limit(0))) == []


def test_terms_in_pieces(monkeypatch):
    text = "Aé-b c_D中 " * 50 + "e"
    for size in (1, 5, 100, 1 << 22):
        monkeypatch.setattr(ranked_search, "_PIECE", size)
        assert [t.decode() for some in ranked_search.terms(text.encode()) for t in some] == plain_terms(text)


def test_bounds_leave_documents_out():
    """On lists with a few large impacts the search looks at a part of the documents only, and finds the same."""
    rng = np.random.default_rng(1)
    n, lengths = 4000, np.full(4000, 100)
    counts = np.full(n, 3)
    term = np.tile([0, 1, 2], n)
    tf = np.ones(3 * n, np.int64)
    tf[rng.choice(3 * n, 60, replace=False)] = rng.integers(20, 90, 60)
    shard = ranked_search.Shard(lengths, counts, term, tf, 3, n, 100 * n)
    asked = []
    largest = shard.largest
    shard.largest = lambda lo, hi: asked.append(len(lo)) or largest(lo, hi)
    best = ranked_search.Best(10)
    ranked_search.search(shard, np.arange(n), np.arange(3), np.array([5, 3, 2]), best)
    score = np.zeros(n, np.int64)
    np.add.at(score, shard.doc, np.repeat([5, 3, 2], n) * shard.impact)
    order = np.lexsort((np.arange(n), -score))[:10]
    assert best.id.tolist() == order.tolist() and best.score.tolist() == score[order].tolist()
    assert sum(asked) < 1500


def test_op11(spark):
    read = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()]
    found = got(QUERIES["op11_ranked_search"](spark, FOLDER))
    assert found == expected(read("documents", "doc_id"), read("benchmark", "item_id"), 20)
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    rows = duck.execute(ORACLE_SQL["op11_ranked_search"])
    assert [d[0] for d in rows.description] == ["item_id", "rank", "doc_id", "score"] and sorted(rows.fetchall(), key=str) == found
