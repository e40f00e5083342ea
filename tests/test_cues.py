"""The one-pass matcher against a test for each cue."""

from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from corpusgap.operators import cues
from corpusgap.operators.cues import FIELDS, CueMatcher
from corpusgap.operators.evidence import Lexicon
from corpusgap.plans.fixtures import LEXICON


def plain(lexicon, title, text):
    text = text or ""
    low = text.lower()
    parts = [p.strip(" .") for p in text.replace("\n", " ").split(".")]
    sentences = [p for p in parts if len(p) > 10]
    any_of = lambda t, cues: any(c in t.lower() for c in cues)
    cued = lambda cues, intros: [s for s in sentences if any_of(s, cues) and not any_of(s, intros)]
    named = lambda t, table: [n for n, cues in table.items() if any_of(t, cues)]
    once = lambda x: list(dict.fromkeys(x))
    known = [d for d in lexicon.datasets if d.lower() in low]
    acronyms = [a for a in re.findall(r"\b([A-Z]{2,}(?:-[A-Z0-9]+)*)\b", text) if 2 < len(a) <= 12 and a not in lexicon.datasets and a not in lexicon.no_datasets]
    head = ". ".join(x for x in (title, text) if x is not None).lower()
    return [
        once(cued(lexicon.limitations, lexicon.limitation_intros) + named(text, lexicon.triggered)), cued(lexicon.future_work, lexicon.future_intros), named(text, lexicon.metrics),
        once(n for s in sentences for n in named(s, lexicon.assumptions)), once(known + acronyms), named(text, lexicon.baselines), next((m for m in lexicon.methods if m in head), None),
    ]


def texts(lexicon, n, seed):
    rng = random.Random(seed)
    cues = [*lexicon.limitations, *lexicon.future_work, *lexicon.limitation_intros, *lexicon.future_intros, *lexicon.datasets, *lexicon.methods, "QMIX", "XYZ-9", "AB"]
    for table in (lexicon.triggered, lexicon.metrics, lexicon.assumptions, lexicon.baselines):
        cues += [c for group in table.values() for c in group]
    words = [*cues, *"the of and İstanbul ΟΔΟΣ Straße a".split(), *[c.upper() for c in cues], *[c[: len(c) // 2] for c in cues], *[c.replace(" ", "\n") for c in cues]]
    for _ in range(n):
        yield rng.choice([None, "A title", rng.choice(words)]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "", ". ", ".", "\n", " .. "]) for _ in range(rng.randint(0, 40)))


def test_equals_a_test_for_each_cue():
    odd = Lexicon(limitations=("a.b", " x", "limit ", "limit", "imit"), triggered={"t": ("two\nlines", "one two")}, methods=("a. b", "policy"), baselines={"q": ("q learning", "q")})
    for lexicon in (Lexicon(), LEXICON, odd):
        matcher = CueMatcher(lexicon, tuple(FIELDS))
        found = [(t, x) for t, x in texts(lexicon, 1500, 3)] + [(None, None), ("a", ""), (None, "İ limit x. two\nlines of one two. a limit x .limit"), ("in a", " b. the limit. a.b")]
        for title, text in found:
            assert matcher.evidence(title, text) == plain(lexicon, title, text), (title, text)


def test_only_the_asked_kinds_are_looked_for():
    matcher = CueMatcher(Lexicon(), ("metric",))
    assert set(matcher.automaton.keys()) == {c for cues in Lexicon().metrics.values() for c in cues}
    assert matcher.evidence("x", "Robustness and delay.") == [["robustness", "latency"]]
    assert CueMatcher(Lexicon(metrics={}), ("metric",)).evidence(None, "x") == [[]]


def test_pieces_bound_what_is_held(monkeypatch):
    monkeypatch.setattr(cues, "_PIECE", 10)
    texts = pa.array(["abcd", None, "", "abcdef", "x" * 50, "é" * 5, "a", "b"])
    assert list(cues.pieces(texts)) == [(0, 4), (4, 5), (5, 6), (6, 8)]
    assert list(cues.pieces(texts.slice(4))) == [(0, 1), (1, 2), (2, 4)] and list(cues.pieces(texts[:0])) == []


def test_a_batch_of_many_texts_gives_its_rows_in_order(spark):
    """Three million characters in one batch come as several pieces."""
    text = F.concat(F.lit("A robust way no. "), F.col("id").cast("string"), F.lit(". "), F.repeat(F.lit("plain words "), 250))
    df = spark.range(0, 1000, 1, 1).select("id", cues.matched(F.lit(None).cast("string"), text, Lexicon(), ("limitation", "metric")).alias("e"))
    got = df.collect()
    assert [(r["id"], r["e"]["metrics"]) for r in got] == [(i, ["robustness"]) for i in range(1000)]
    assert all(r["e"]["limitations"][0] == "A robust way no" for r in got)
