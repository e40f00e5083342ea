"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusgap.llm import repair
from corpusgap.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Least (cost, audit, repaired) by relaxing all edits until nothing changes."""
    faults = plain_faults(rows)
    best = {(0, ""): (0, "", [])}
    changed = True
    while changed:
        changed = False
        for (i, order), (cost, audit, out) in list(best.items()):
            steps = []
            follow = {"": "su", "s": "u", "u": "a", "a": "u"}[order]
            for initial, role in (("u", "user"), ("a", "assistant")):
                if initial in follow:
                    steps.append((3, "I", i, initial, [f"{role}:"]))
            if i < len(rows):
                role, text = rows[i]
                steps.append((4, "D", i + 1, order, []))
                if faults[i] in ("", "truncated"):
                    more = 3 if faults[i] else 0
                    if role[:1] and role[:1] in follow:
                        steps.append((more, "K", i + 1, role[:1], [f"{role}:{text}"]))
                    for initial, other in (("u", "user"), ("a", "assistant")):
                        if initial in follow:
                            steps.append((3 + more, "R", i + 1, initial, [f"{other}:{text}"]))
            for more, edit, j, to, said in steps:
                label = (cost + more, audit + edit, out + said)
                if label[0] <= 4 * len(rows) and ((j, to) not in best or label[:2] < best[j, to][:2]):
                    best[j, to], changed = label, True
    return min((best[len(rows), e] for e in ("", "a") if (len(rows), e) in best), key=lambda x: x[:2])


def expected(rows, roster):
    out = {}
    for conv in roster:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        turns = [r[1] for r in own if r[1] is not None]
        said = [(r[2], r[3]) for r in own]
        faults = plain_faults(said)
        cost, audit, done = plain_repair(said)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def collected(df):
    rows = df.collect()
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


def spoken(rng):
    return rng.choice(["", " \n", "Yes.", "yes", "No!", "Why? ", "and so", "…", "Ends.\t", "a" + str(rng.randint(0, 9)) + "."])


def made(n, most, seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, most)):
            row = (conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", " "]), spoken(rng))
            rows += [row] * (1 + (rng.random() < 0.1))
    return rows


def test_search_from_both_ends():
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), spoken(rng)) for _ in range(rng.randint(1, 9))]
        faults = [{"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f] for f in plain_faults(rows)]
        found = repair.Lattice([(r[0] if r[0] in "sua" else "-", f) for (r, _), f in zip(rows, faults)]).cheapest(repair.START, repair.ENDS)
        assert found == plain_repair(rows)[:2]


def test_all_short_orders():
    for n in (1, 2, 3, 4):
        for rows in itertools.product([("s", 0), ("u", 0), ("a", 0), ("u", 3), ("a", 2), ("-", 0)], repeat=n):
            said = [({"s": "system", "u": "user", "a": "assistant", "-": "tool"}[i], f"{k}." if f == 0 else f"{k}" if f == 3 else " ") for k, (i, f) in enumerate(rows)]
            assert repair.Lattice(list(rows)).cheapest(0, repair.ENDS) == plain_repair(said)[:2]


@pytest.mark.parametrize(("chunk", "parts"), [(256, 4), (1, 7), (3, 5)])
def test_chunks_and_ranges(spark, monkeypatch, chunk, parts):
    """Conversations that span chunks and ranges give what one look at them gives."""
    rows = made(25, 14, chunk) + made(0, 60, 8)
    cut = repair._cut

    def small(schema):
        run = cut(schema)

        def task(batches):
            repair.CHUNK = chunk
            yield from run(batches)

        return task

    monkeypatch.setattr(repair, "_cut", small)
    monkeypatch.setattr(repair, "shuffle_partitions", lambda _: parts)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"audit": F.lit("clash"), "first": F.lit(1), "part": F.lit(2)}).repartition(3)
    roster = [*range(25), None, 99]
    found = collected(repair.repair(df, spark.createDataFrame([(c, "x") for c in roster], "conv_id long, audit string")))
    assert found == expected(rows, roster)
    assert found[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage_and_defined_cases(spark):
    rows = made(60, 6, 3) + [(7, None, None, None), (None, 3, None, "A. B! C?"), (8, 1, "user", "word " * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    bad = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            bad += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    assert sorted(map(tuple, repair.damaged(df).collect()), key=str) == sorted(bad, key=str)
    assert collected(repair.repair(repair.damaged(df), roster=df)) == expected(bad, {r[0] for r in rows})
    assert repair.repair(repair.damaged(df.limit(0)), roster=df.limit(0)).collect() == []
    assert len(repair.repair(df.limit(0), roster=df).collect()) == 61


def test_op13(spark):
    rows = [tuple(r) for r in repair.damaged(spark.read.parquet(f"{FOLDER}/conversations.parquet")).collect()]
    roster = {r[0] for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").collect()}
    assert collected(QUERIES["op13_conversation_repair"](spark, FOLDER)) == expected(rows, roster)
