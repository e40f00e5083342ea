"""SimHash groups against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from corpusgap.llm import simhash
from corpusgap.llm.queries import QUERIES
from corpusgap.llm.session import Scratch

FOLDER = "/root/testdata/sf0.001"


def plain(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance=3):
    """Least linked fingerprint of each, over all pairs."""
    prints = sorted(set(prints))
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {p: root(p) for p in prints}


def expected(rows, width=3, distance=3):
    prints = [plain(t, width) for _, t in rows]
    label = groups(prints, distance)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    return sorted(((i, f"{p:016x}", least.get(label[p])) for (i, _), p in zip(rows, prints)), key=str)


def clusters(n, seed):
    """Fingerprints in chains of few differing bits, so that roots are large."""
    rng = random.Random(seed)
    found = [0, (1 << 64) - 1]
    while len(found) < n:
        p = rng.choice(found[-40:]) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 4)):
            p ^= 1 << rng.randrange(64)
        found.append(p)
    return sorted(set(found))


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize(("segment", "block", "distance"), [(1024, 1 << 17, 3), (8, 1 << 17, 3), (5, 16, 3), (1024, 1 << 17, 0), (7, 40, 2), (16, 64, 5)])
def test_links_equal_all_pairs(spark, monkeypatch, segment, block, distance):
    """Large and small segments and blocks; components of the links are those of all pairs."""
    from corpusgap.llm.components import connected_components

    prints = clusters(700, segment)
    search = simhash._search_ranges

    def small(d):
        run = search(d)

        def task(batches):
            simhash.SEGMENT, simhash.BLOCK = segment, block
            yield from run(batches)

        return task

    monkeypatch.setattr(simhash, "_search_ranges", small)
    rows = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    scratch = Scratch(spark, "simhash-test")
    links = simhash.gray_links(scratch, rows, distance)
    assert all((r["a"] - r["b"]) for r in links.collect())
    found = {r["node"] % (1 << 64): r["label"] for r in connected_components(scratch, links).collect()}
    want = groups(prints, distance)
    by_label = {}
    for p in prints:
        by_label.setdefault(found.get(p, signed(p)), set()).add(p)
    by_root = {}
    for p, r in want.items():
        by_root.setdefault(r, set()).add(p)
    assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, by_root.values()))


def test_defined_cases(spark):
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(400)]
    rows = [(5, None), (4, ""), (None, " \t\n"), (7, "One"), (8, "one"), (8, "one"), (9, "Two words"), (None, "alone here now then"), (1 << 40, " ".join(base))]
    for i in range(30):
        w = list(base)
        w[rng.randrange(400)] = f"x{i}"
        rows.append((100 + i, " ".join(w)))
    rows.append((3, " ".join(base) * 40))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, fingerprint string, component_id int").repartition(3)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == expected(rows)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_pieces_of_long_texts(monkeypatch):
    text = " ".join(random.Random(1).choices(["A", "bc", "dé", "　x", "longer"], k=5000))
    whole = simhash.fingerprint(text.encode())
    assert whole == plain(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "_PIECE", size)
        assert simhash.fingerprint(text.encode()) == whole and simhash.fingerprint(b"a B") == plain("a b") and simhash.fingerprint(b" a\x0bB c ") == plain("a b c")


def test_tree_finds_all_pairs():
    values = np.array(sorted((p ^ p >> 1) for p in clusters(300, 9)), np.uint64)
    found = {tuple(sorted(p)) for q, i in simhash.GrayTrees(values, np.array([0, 120])).pairs(values, np.repeat([0, 1], [120, len(values) - 120]), 3, True) for p in zip(q.tolist(), i.tolist())}
    assert found == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (i < 120) == (j < 120) and int(values[i] ^ values[j]).bit_count() <= 3}


def test_op12(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op12_simhash_groups"](spark, FOLDER).collect()), key=str)
    assert got == expected(docs)
