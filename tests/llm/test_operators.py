"""The training-data operators against brute force, libraries and round trips on small tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusgap.llm.session import Scratch
from corpusgap.llm.textkit import Texts
from corpusgap.llm import chat, components, fingerprints, neighbours, ngram_join, packing, quality, sentence_pieces, stages, suffix_tree_lm, token_counts, toxicity
from corpusgap.llm.queries import vocabulary

BPE, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
DOCS = "doc_id long, text string, fingerprint string, n_tokens int, score double"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(300)]
    texts: list[str | None] = [None, "", "  \n", "One", "one two three", "ONE two three"]
    while len(texts) < n:
        if len(texts) > 20 and rng.random() < 0.5:
            w = (rng.choice(texts) or "x y").split(" ")
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(lexicon)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choices(lexicon, k=rng.randint(1, 120))))
    return [(i, t, "clash", 7, 0.5) for i, t in enumerate(texts)] + [(3, texts[3], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, empty):
    assert fingerprints.edited_fingerprints(empty).count() == 0
    assert token_counts.token_counts(empty, BPE).count() == 0
    assert packing.pack_documents(empty, BPE).count() == 0
    assert ngram_join.similar_groups(empty).count() == 0
    assert sentence_pieces.round_trip(empty, PIECES).count() == 0
    assert suffix_tree_lm.suffix_tree_scores(empty.withColumn("learn", F.lit(True)), "learn", ["doc_id"]).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert stages.keep_good(empty, labels).count() == 0
    assert stages.drop_toxic(empty, labels).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(vectors, vectors).count() == 0
    assert chat.chat_format(spark.createDataFrame([], "tree long, node long, parent long, role string, text string, score double")).count() == 0


def test_fingerprints(docs):
    rows = sorted(corpus(), key=lambda r: (-r[0], r[1] or ""))
    out = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    errors = []
    for i, r in enumerate(rows):
        own, after = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        if r[0] == 3:
            continue
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        a, b = shingles(own, 5), shingles(edited, 5)
        errors.append(abs((len(a & b) / len(a | b) if a | b else 1.0) - out[r[0]]["near_edited"]))
    assert np.mean(errors) < 0.05 and max(errors) < 0.3
    assert out[1]["fingerprint"] == out[2]["fingerprint"] == ""
    assert out[4]["fingerprint"] == out[5]["fingerprint"]


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(BPE), random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "\x1c", "\x85", "<|endoftext|>", "é", "'s", "1", "!", "　", "𝄞", "don't", "the"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(800)] + ["ab " * 20000, "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, BPE).collect()}
    assert all(got[i] == len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts))


def test_packing(docs):
    from tokenizers import Tokenizer

    library, capacity = Tokenizer.from_file(BPE), 64
    out = packing.pack_documents(docs, BPE, capacity, group_pieces=50).toPandas()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in corpus()}
    for (doc, _), g in out.sort_values("piece").groupby(["doc_id", "copy"]):
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
            assert r.length == capacity or r.piece == 0
        assert at == len(ids[doc])
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= capacity and list(g.offset) == list(np.cumsum(g.length) - g.length)
    assert out.sequence_id.nunique() <= 1.08 * -(-out.length.sum() // capacity)


def test_packing_of_long_runs(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    texts = [" " * 300_000, "\n" * 300_000, "x" * 200_000, "a" + " " * 100_000 + "b \n\n\n c", "<|endoftext|> x  <|endoftext|>", None, ""]
    out = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BPE).toPandas()
    for i, t in enumerate(texts):
        ids, rows = [*library.encode(t or "", add_special_tokens=False).ids, 0], out[out.doc_id == i].sort_values("piece")
        assert rows.length.sum() == len(ids)
        assert [r.ids_crc32 for r in rows.itertuples()] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in rows.itertuples()]


def test_tightest_room():
    tree, rng, rooms = packing.RoomTree(40), random.Random(5), Counter()
    for _ in range(500):
        room = rng.randint(1, 40)
        if rooms[room] and rng.random() < 0.6:
            rooms[room] -= 1
            tree.add(room, -1)
        else:
            rooms[room] += 1
            tree.add(room, 1)
        ask = rng.randint(1, 40)
        assert tree.tightest(ask) == min((r for r, n in rooms.items() if n and r >= ask), default=None)


def components_by_force(rows, width, num):
    sets = {i: shingles(t, width) for i, t, *_ in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("width", "num"), [(4, 85), (2, 60)])
def test_ngram_join(docs, width, num):
    out = ngram_join.similar_groups(docs, width, num, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == components_by_force(corpus(), width, num)
    assert len(out) == len(corpus())


@pytest.mark.parametrize("dense", [0, 32])
def test_ngram_join_checks_large_families_in_tiles(spark, monkeypatch, dense):
    """Families whose pairs lie on both sides of the threshold, met in large groups of several blocks."""
    monkeypatch.setattr(ngram_join, "_FEW", 4)
    monkeypatch.setattr(ngram_join, "_BLOCK_SETS", 20)
    monkeypatch.setattr(ngram_join, "_DENSE", dense)
    rng, rows = random.Random(11), []
    for _ in range(2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(110):
            w = list(base)
            for _ in range(rng.choice((1, 2, 2, 3, 4))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    tiled, tile_links = [], ngram_join._tiled
    monkeypatch.setattr(ngram_join, "_tiled", lambda *a: tiled.append(1) or tile_links(*a))
    out = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = components_by_force(rows, 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert bool(tiled) == (dense == 0) and len({c for _, c in want.values()}) > 2


def test_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(8)
    left = far = 0
    for size in [1, 2, 5, 30, 63, 64, 65, 260, 1000, 5000]:
        for _ in range(40):
            one = rng.integers(0, 2**63, size).astype(np.uint64)
            gone = rng.integers(0, size + 1)
            two = np.concatenate([one[gone:], rng.integers(0, 2**63, rng.integers(0, gone + 1)).astype(np.uint64)])
            if not len(two):
                continue
            sides = [(len(x), np.frombuffer(ngram_join.parity_sketch(x), np.uint64)) for x in (one, two)]
            inter = size - gone
            hopeful = ngram_join.may_be_similar(*sides, 80, 100)
            similar = 100 * inter >= 80 * (len(one) + len(two) - inter)
            assert hopeful or not similar
            i, _ = ngram_join.hopeful_pairs(np.array([s for s, _ in sides]), [x for _, x in sides], np.arange(2), 80, 100)
            assert len(i) or not similar
            far, left = far + (inter < 0.6 * size), left + (hopeful and inter < 0.6 * size)
    assert left < 0.2 * far


@pytest.mark.parametrize("size", [1, 2, 3])
def test_shared_signatures_with_repeats_at_batch_ends(spark, size):
    rows = [(1, 1), (1, 1), (1, 2), (2, 1), (2, 1), (2, 1), (3, 3), (4, 4), (4, 5), (4, 5), (5, 6), (5, 6), (5, 6), (5, 7)]
    rng = random.Random(5)
    rows += [(sig, rng.randrange(3)) for sig in range(10, 60) for _ in range(rng.randrange(1, 6))]
    members = {sig: {p for s, p in rows if s == sig} for sig, _ in rows}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        out = ngram_join._shared(spark.createDataFrame(rows, "sig long, print long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["sig"], r["print"], r["first"]) for r in out) == sorted((s, p, min(ps)) for s, ps in members.items() if len(ps) > 1 for p in ps)


@pytest.mark.parametrize(("num", "den"), [(85, 100), (60, 100)])
def test_similar_sets_share_a_signature(num, den):
    """Pairs as far apart as they may be, of sizes on both sides of one and two levels of partitions."""
    rng, bands = np.random.default_rng(3), ngram_join.Bands(num, den)
    for size in [*range(1, 60), 100, 400]:
        for _ in range(12):
            one = rng.integers(0, 2**63, size).astype(np.uint64)
            gone = rng.integers(0, (den - num) * size // den + 1)
            new = rng.integers(0, 2**63, 0 if gone == 0 else rng.integers(0, gone + 1)).astype(np.uint64)
            two = np.concatenate([one[gone:], new])
            inter = len(one) - gone
            if not len(two) or den * inter < num * (len(one) + len(two) - inter):
                continue
            sizes = np.array([len(one), len(two)])
            sig, owner = ngram_join.signatures(sizes, np.array([0, 1]), np.repeat([0, 1], sizes), np.concatenate([one, two]), bands)
            assert set(sig[owner == 0]) & set(sig[owner == 1])


@pytest.mark.parametrize("together", [None, 1, 2, 3])
def test_similar_sets_agree_in_three_groups(together):
    """By signatures and empty pairs, whichever way empty pairs are written; of bands of one level by one signature."""
    rng, bands, one_only = np.random.default_rng(4), ngram_join.Bands(80, 100), 0
    bands.together = bands.together if together is None else np.full(len(bands.together), together)
    for size in [*range(1, 60), 100, 200]:
        for _ in range(8):
            one = rng.integers(0, 2**63, size).astype(np.uint64)
            gone = rng.integers(0, 20 * size // 100 + 1)
            two = np.concatenate([one[gone:], rng.integers(0, 2**63, rng.integers(0, gone + 1)).astype(np.uint64)])
            if 100 * (size - gone) < 80 * (len(two) + gone):
                continue
            sets = np.array([size, len(two)]), np.repeat([0, 1], [size, len(two)]), np.concatenate([one, two])
            sig, owner = ngram_join.signatures(sets[0], np.array([0, 1]), *sets[1:], bands)
            both, empty = set(sig[owner == 0]) & set(sig[owner == 1]), ngram_join.empty_pairs(*sets, bands).to_pylist()
            deep = min(int(x) & 255 for x in both) >= bands.deep
            assert not deep or len(both) + len(set(empty[0]) & set(empty[1])) >= 3
            one_only += not deep
    assert one_only


def test_pairs_that_share_one_signature_alone_are_not_compared(spark, monkeypatch):
    """Texts of 200 words with 25 of a common passage each: some signatures are shared, but no text is like another."""
    rng, checked, check = random.Random(2), [], ngram_join._Join.check
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(300):
        at = rng.randrange(35)
        rows.append((i, " ".join([*passage[at : at + 25], *(f"w{rng.randrange(10**6)}" for _ in range(175))])))
    monkeypatch.setattr(ngram_join._Join, "check", lambda self, pairs: checked.append(pairs.count()) or check(self, pairs))
    out = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert all(r["component_id"] == r["doc_id"] for r in out) and sum(checked) < 300


def test_a_family_about_the_threshold_makes_rows_in_proportion_to_members(spark, monkeypatch):
    """All pairs of 60 sets may be similar by their sketches and only neighbours are: they aren't shipped pair by pair."""
    rng = np.random.default_rng(6)
    base, own = rng.integers(0, 2**63, 400).astype(np.uint64), rng.integers(0, 2**63, (61, 20)).astype(np.uint64)
    far = rng.integers(0, 2**63, (60, 40)).astype(np.uint64)
    sets = [np.sort(np.concatenate([base, own[k], own[k + 1]] if k < 20 else [base, far[k]])) for k in range(60)]
    rows = [(k, len(x), bytearray(ngram_join.packed_items(x)), bytearray(ngram_join.parity_sketch(x))) for k, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "print long, size long, items binary, sketch binary")
    num, den = 401, 480  # neighbours have 420 of 460 in common, others 400 of 480
    made, sketched = [], ngram_join._sketched
    monkeypatch.setattr(ngram_join, "_sketched", lambda dealt, *a: made.append((dealt.count(), sketched(dealt, *a).count())) or sketched(dealt, *a))
    join = ngram_join._Join(Scratch(spark, "test"), table, num, den)
    join.check_tiles(table.select(F.lit(1).cast("long").alias("sig"), "print"))
    assert {r["node"]: r["label"] for r in join.labels.collect()} == dict.fromkeys(range(20), 0)
    assert made and all(pairs <= 2 * members for members, pairs in made)


def test_pair_links():
    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([rng.choice(40, rng.integers(34, 41), replace=False), rng.integers(100, 9999, 2)])).astype(np.uint64) for _ in range(50)]
    i, j = np.triu_indices(50, 1)
    parts = []
    for a, b in (ngram_join.tile_links(np.arange(50), sets, 85, 100), ngram_join.pair_links(np.arange(50), sets, i, j, 85, 100)):
        label = list(range(50))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            low, high = sorted((label[x], label[y]))
            label = [low if k == high else k for k in label]
        parts.append(label)
        assert len(a) < 50
    assert parts[0] == parts[1] and 1 < len(set(parts[0])) < 50
    none = ngram_join.pair_links(np.arange(50), sets, i[:0], j[:0], 85, 100)
    assert not len(none[0]) and not len(none[1])


def test_tile_links():
    rng = np.random.default_rng(2)
    base = np.arange(40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(30, 41), replace=False), rng.integers(100, 9999, 3).astype(np.uint64)])) for _ in range(60)]
    prints = np.arange(60)
    a, b = ngram_join.tile_links(prints, sets, 85, 100)
    label = {i: i for i in range(60)}
    label.update(zip(b.tolist(), a.tolist(), strict=True))
    want = list(range(60))
    before = None
    while want != before:
        before = list(want)
        for i in range(60):
            for j in range(60):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    want[i] = want[j] = min(want[i], want[j])
    assert [label[i] for i in range(60)] == want


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    out = {r["node"]: r["label"] for r in components.connected_components(Scratch(spark, "test"), spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[100] == out[95] == out[90] == 90


def labelled(spark, column):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        text = " ".join("".join(rng.choices("aeinrst", k=rng.randint(2, 7))) for _ in range(rng.randint(8, 60)))
        y = i % 3 == 0
        if column == "toxic":
            text += f" you {rng.choice(['clownish', 'clown', 'clowns'])} " + text if y else ""
        else:
            text = text if y else " | ".join(text.split(" "))
        rows.append((i, text))
        labels.append((i, int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {column} int")


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, module, column):
    rows, labels = labelled(spark, column)
    model = module.fit(rows, labels, F.col("doc_id") % 4 != 0, column)
    out = module.score(rows, model).join(labels, "doc_id").filter("doc_id % 4 = 0").collect()
    assert sum((r["score"] >= 0.3) == bool(r[column]) for r in out) >= 0.95 * len(out)
    scores = model.score(pa.array(["", None]))
    assert scores[0] == scores[1] and 0 <= scores[0] <= 1
    flat = module.train(pa.table({"text": ["a b", "c"], "label": [1, 1]}), 0.9)
    assert np.allclose(flat.score(pa.array(["a b", ""])), 0.9)


def test_language_model(spark):
    rows = [(i, t, i % 4 != 0) for i, t, *_ in corpus()[:-1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    out = {r["doc_id"]: r for r in suffix_tree_lm.suffix_tree_scores(df, "learn", ["doc_id"]).collect()}
    counts = Counter(w for _, t, learn in rows if learn for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in rows:
        tokens = [*words(t), None]
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), abs=1e-6)
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert out[i]["score"] < 0


def tree_scores(train, texts, depth, least):
    """The model by plain recursion over lists: log10 scores of ``texts``."""
    counts = Counter(w for t in train for w in words(t))
    frequent = {w for w, n in counts.items() if n >= least}
    hashed = Texts(pa.array([" ".join(counts) or "x"]))
    of_class = dict(zip(counts, suffix_tree_lm.word_classes(hashed).tolist(), strict=False))

    def symbol(w):
        if w in frequent:
            return w
        if w not in of_class:
            of_class[w] = int(suffix_tree_lm.word_classes(Texts(pa.array([w])))[0])
        return of_class[w]

    def tokens(t):
        return [*(symbol(w) for w in words(t)), "<end>"]

    unigrams = Counter({c: 0 for c in range(256)})
    unigrams.update(frequent)
    unigrams["<end>"] = 0
    unigrams = Counter({s: 0 for s in unigrams})
    for t in train:
        unigrams.update(tokens(t))
    whole = sum(unigrams.values()) + len(unigrams)
    following = {}
    for t in train:
        row = tokens(t)
        for i in range(len(row)):
            for d in range(1, min(i, depth) + 1):
                following.setdefault(tuple(row[i - d : i]), Counter())[row[i]] += 1
    kept = {}

    def p(context, s):
        for d in range(len(context), 0, -1):
            if context[-d:] in kept:
                n = kept[context[-d:]]
                return (n[s] + len(n) * p(context[-d:][1:], s)) / (sum(n.values()) + len(n))
        return (unigrams[s] + 1) / whole

    for context in sorted(following, key=len):
        n = following[context]
        total = sum(n.values())
        if total < least:
            continue
        gain = sum(c * (math.log(c - 1) - math.log(p(context[1:], s))) if c > 1 else math.log(len(n)) for s, c in n.items())
        if gain - total * math.log(total - 1 + len(n)) >= suffix_tree_lm.LEAST_GAIN * total:
            kept[context] = n
    in_class = Counter()
    for w, n in counts.items():
        if w not in frequent:
            in_class[symbol(w), 0] += n
            in_class[symbol(w), 1] += 1
    out = []
    for t in texts:
        row, score = tokens(t), 0.0
        for i, s in enumerate(row):
            score += math.log10(p(tuple(row[max(0, i - depth) : i]), s))
        for w in words(t):
            if w not in frequent:
                c = symbol(w)
                score += math.log10((counts[w] + 1) / (in_class[c, 0] + in_class[c, 1] + 1))
        out.append(score)
    return out, kept


@pytest.mark.parametrize(("head", "least", "gain", "rows"), [(1 << 19, 6, 0.05, 1 << 22), (40, 6, 0.05, 1 << 22), (1 << 19, suffix_tree_lm.LEAST_COUNT, suffix_tree_lm.LEAST_GAIN, 1 << 22), (1 << 19, 6, 0.0, 40)])
def test_language_model_by_force(spark, monkeypatch, head, least, gain, rows):
    """Repeated phrases among noise, with the shipped constants too; with a small head the words beyond it come by joins; few rows a round make many."""
    monkeypatch.setattr(suffix_tree_lm, "HEAD", head)
    monkeypatch.setattr(suffix_tree_lm, "LEAST_COUNT", least)
    monkeypatch.setattr(suffix_tree_lm, "HOT_TOKENS", 5)
    monkeypatch.setattr(suffix_tree_lm, "LEAST_GAIN", gain)
    monkeypatch.setattr(suffix_tree_lm, "ROUND_ROWS", rows)
    monkeypatch.setattr(suffix_tree_lm, "ROUND_SHARE", 1 / 4 if rows > 40 else 0)
    rng = random.Random(7)
    lexicon = [f"w{i}" for i in range(30)] + [f"rare{i}" for i in range(60)]
    phrases = [" ".join(rng.choices(lexicon[:30], k=6)) for _ in range(4)]
    texts = [" ".join(rng.choice(phrases) if rng.random() < 0.4 else rng.choice(lexicon) for _ in range(rng.randint(0, 12))) for _ in range(240)]
    texts[7] = texts[8] = texts[9]
    learn = [i % 5 != 0 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, y, 3) for i, (t, y) in enumerate(zip(texts, learn, strict=True))], "doc_id long, text string, learn boolean, score int").repartition(3)
    out = {r["doc_id"]: r for r in suffix_tree_lm.suffix_tree_scores(df, "learn", ["doc_id"]).collect()}
    want, kept = tree_scores([t for t, y in zip(texts, learn, strict=True) if y], texts, suffix_tree_lm.MAX_DEPTH, least)
    assert {len(c) for c in kept} >= ({1, 2} if least == 6 else {1})
    if head > 40:
        assert [out[i]["score"] for i in range(len(texts))] == pytest.approx(want, abs=1e-6)
    counts = Counter(w for t, y in zip(texts, learn, strict=True) if y for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]) for t in texts]
    assert [out[i]["base_score"] for i in range(len(texts))] == pytest.approx(base, abs=1e-6)
    assert [out[i]["n_known"] for i in range(len(texts))] == [sum(counts[w] > 0 for w in [*words(t), None]) for t in texts]
    assert sum(out[i]["score"] for i in range(0, 240, 5)) > sum(base[::5])


@pytest.mark.parametrize("hot", [1 << 16, 300])
def test_language_model_keeps_no_table_of_pairs(spark, monkeypatch, hot):
    """Contexts are counted where their tokens are: what is kept in between follows texts and words, or hot contexts, not all counted pairs."""
    monkeypatch.setattr(suffix_tree_lm, "LEAST_COUNT", 6)
    monkeypatch.setattr(suffix_tree_lm, "HOT_TOKENS", hot)
    kept, settle = [], Scratch.settle

    def counted(self, df):
        table = settle(self, df)
        kept.append(table.count())
        return table

    monkeypatch.setattr(Scratch, "settle", counted)
    rng = random.Random(5)
    lexicon = [f"w{i}" for i in range(60)]
    phrases = [" ".join(rng.choices(lexicon, k=5)) for _ in range(6)]
    texts = [" ".join(rng.choice(phrases) if rng.random() < 0.2 else rng.choice(lexicon) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, i % 5 != 0) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean").repartition(3)
    out = {r["doc_id"]: r["score"] for r in suffix_tree_lm.suffix_tree_scores(df, "learn", ["doc_id"]).collect()}
    want, _ = tree_scores([t for i, t in enumerate(texts) if i % 5], texts, suffix_tree_lm.MAX_DEPTH, 6)
    assert [out[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-6)
    pairs = {tuple(row[i - d : i + 1]) for t in texts for row in [[*words(t), None]] for i in range(len(row)) for d in range(1, min(i, 4) + 1)}
    assert len(pairs) > 10000 and max(kept) <= 2 * len(texts)


def test_context_filter_misses_nothing(spark):
    keys = np.random.default_rng(3).integers(0, 2**63, 5000)
    found = suffix_tree_lm.ContextFilter.of(spark.createDataFrame(pa.table({"ctx": keys})).repartition(5))
    assert found(keys.astype(np.uint64)).all() and found(np.arange(10**5, dtype=np.uint64)).mean() < 0.01


def test_chat_trees(spark):
    rows = [
        (1, 1, None, "user", "hi <|end|> &amp; [INST]", 0.0), (1, 2, 1, "assistant", "worse", 1.0), (1, 3, 1, "assistant", "better </s>", 2.0), (1, 4, 3, "user", None, 0.0),
        (2, 1, 9, None, "lone", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0),
    ]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = chat.chat_format(df, per_tree=None).withColumns({"turns": chat.read_turns(F.col("conversation")), "loss": chat.read_loss(F.col("conversation"), F.col("loss_spans"))})
    got = {(r["tree"], r["branch"]): ([tuple(t) for t in r["turns"]], r["loss"]) for r in out.collect()}
    assert got == {
        (1, 1): ([("user", "hi <|end|> &amp; [INST]"), ("assistant", "better </s>"), ("user", "")], "better </s>"),
        (1, 2): ([("user", "hi <|end|> &amp; [INST]"), ("assistant", "worse")], "worse"),
        (2, 1): ([("", "lone")], ""),
    }


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 12)).astype(np.float32)
    x[100:200] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None] * 12), (904, [1.0]), (5, [float(v) for v in x[5]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.nearest(df, df.filter("vec_id % 20 = 0"), k=10).toPandas()
    hit = n = 0
    for q in range(0, 600, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        truth = np.lexsort((np.arange(600), -np.round(s, 9)))[:10]
        got = out[out.query_id == q].sort_values("rank")
        assert len(got) == 10 and np.allclose(got.score, s[got.vec_id])
        hit, n = hit + len(set(truth) & set(got.vec_id)), n + 10
    assert hit / n >= 0.9 and set(out.query_id) == set(range(0, 600, 20))


def recall(found, x, queries, k):
    hit = 0
    for q in queries:
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:k].tolist()) & set(found[found.query_id == q].vec_id))
    return hit / len(queries) / k


@pytest.mark.parametrize("clusters", [0, 60])
def test_neighbours_over_many_blocks(spark, monkeypatch, clusters):
    """Vectors without structure and clustered ones; the answers come through windows of several orderings."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 24))
    if clusters:
        x = (rng.standard_normal((clusters, 24)) * 3)[rng.integers(0, clusters, 4000)] + 0.3 * x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(4000), "embedding": list(x)}))
    curves = neighbours.fit_curves(x.astype(float), float(np.linalg.norm(x, axis=1).max()))
    orderings, share, _ = neighbours.choose_windows(curves, x.astype(float), 10)
    assert orderings > 1 and (share < 0.3 if clusters else share < 1)
    out = neighbours.nearest(df, df.filter("vec_id % 20 = 0"), k=10).toPandas()
    assert recall(out, x, range(0, 4000, 20), 10) >= 0.9


def test_neighbours_of_two_sizes(spark):
    """Queries of another size than the table's commonest take no part."""
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(1, 30)] + [(40, [1.0, 2.0]), (60, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest(df, df.filter("vec_id IN (20, 40, 60)"), k=3).toPandas()
    assert set(out.query_id) == {20} and list(out.sort_values("rank").vec_id) == [29, 28, 27]


def test_hilbert_steps_are_neighbours():
    cells = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    keys = neighbours.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_sentence_pieces_match_the_library(spark):
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "é", "<s>", "▁", "ﬁ", "€", "𝄞", "the", "<0x41>", "\0", "ab" * 40]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(800)] + ["the end " * 5000]
    enc = sentence_pieces.PieceEncoder(PIECES)
    assert [list(np.frombuffer(x, "<i4")) for x in enc.encode(texts)] == library.encode(texts)
    plain = [(i, t) for i, t in enumerate(texts) if "▁" not in t] + [(9999, None)]
    assert sentence_pieces.round_trip(spark.createDataFrame(plain, "doc_id long, text string"), PIECES).filter("NOT round_trip").count() == 0


def test_pipeline_keeps_columns_and_one_of_each_group(docs):
    kept = stages.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 1, 2, 4} <= set(ids) and 5 not in ids


def test_one_of_each_group_with_null_and_reused_ids(spark):
    rng = random.Random(13)
    a, b, c, d, e = (" ".join(f"{name}{rng.randrange(900)}" for _ in range(60)) for name in "abcde")
    rows = [(None, a), (None, b), (None, c), (7, c), (7, d), (None, e), (None, e), (9, d + " more"), (8, None), (None, "")]
    kept = stages.one_per_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = sorted(((r["doc_id"], r["text"]) for r in kept), key=str)
    assert found == sorted([(None, a), (None, b), (7, c), (7, d), (None, e), (8, None), (None, "")], key=str)
