"""Repair of conversations: the cheapest edits that give an order of roles that a chat model can learn from.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``: an optional
system row, then user and assistant in turns, or nothing at all.  Rows may be kept,
given the role user or assistant, or deleted, and rows without text may be put in.  The
states of an edit lattice are (rows read, state of the order); Dijkstra's search runs
from both of its ends at once until their heaps meet, ends all crossings of equal cost,
and takes the one whose edits' initials, joined, are least in ASCII order.

The rows are sorted once over all conversations by Spark, in even ranges, so that one
conversation may span many tasks.  A task cuts what it holds of a conversation into
chunks of at most ``CHUNK`` rows and solves each for every state that it may begin and
end with (one start, if the whole conversation is the chunk).  A conversation's chunks
are then joined like links of a chain, without texts: what a task holds of one
conversation is a few strings as long as its audit.  Texts pass once more, chunk after
chunk, into the digest of the repaired conversation.

Defined cases: a null role or text is one space; a null turn comes first; rows of one
turn follow role, then a digest of their text, so equal rows stand side by side.  A
null conversation id is one conversation.  Repeated rows are duplicates.  Roles count
by their first character; an empty role has none and fits nowhere.  A conversation of
which no row is left has zeros, an empty audit and the digest of the empty string.  An
empty table gives an empty one.  Columns other than the four are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .session import Scratch, fresh, shuffle_partitions

#: Rows and characters of a chunk.
CHUNK, CHUNK_CHARS = 256, 1 << 22
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: States of the order: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
FINE, BLANK, DUPLICATE, CUT = range(4)
_SOLID = re.compile(r"[^\x20\x09-\x0D]")
_ENDED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
_LEGAL = {"su", "ua", "au"}

Label = tuple[int, str]


def _next_turn(state: int) -> int:
    """The state after a row of the role that may follow: user after an assistant row, assistant after a user row."""
    return ASSISTANT if state == USER else USER


def _kept_from(initial: str, state: int) -> int | None:
    """The state after a kept row, None where it can't stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


class Lattice:
    """The edits of some rows, given as (initial, fault)."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.rows = rows

    def _across(self, i: int, state: int) -> Iterator[tuple[int, str, int]]:
        """(cost, edit, state after) of the edits that read row ``i``."""
        initial, fault = self.rows[i]
        yield DELETE, "D", state
        if fault in (BLANK, DUPLICATE):
            return
        more = TRUNCATED if fault == CUT else 0
        after = _kept_from(initial, state)
        if after is not None:
            yield KEEP + more, "K", after
        yield REROLE + more, "R", _next_turn(state)

    def forward(self, i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        """(cost, edit, rows read, state) of the nodes that follow."""
        yield INSERT, "I", i, _next_turn(state)
        if i < len(self.rows):
            for cost, edit, after in self._across(i, state):
                yield cost, edit, i + 1, after

    def backward(self, i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        """(cost, edit, rows read, state) of the nodes before."""
        for before in range(4):
            if _next_turn(before) == state:
                yield INSERT, "I", i, before
            if i:
                for cost, edit, after in self._across(i - 1, before):
                    if after == state:
                        yield cost, edit, i - 1, before

    def cheapest(self, start: int, ends: tuple[int, ...]) -> Label | None:
        """(cost, audit) from ``start`` before all rows to one of ``ends`` after them.

        Two edit strings of equal cost that lead to one node are never each other's
        prefix (the rest would be a loop, and loops cost), so the least string to a node
        and the least string from it make the least string through it.
        """
        n = len(self.rows)
        found: list[dict[tuple[int, int], Label]] = [{(0, start): (0, "")}, {(n, end): (0, "") for end in ends}]
        heaps = [[(0, "", node) for node in side] for side in found]
        for heap in heaps:
            heapq.heapify(heap)
        best: int | None = None
        for node, (cost, _) in found[0].items():
            if node in found[1]:
                best = cost
        while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
            side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
            cost, audit, node = heapq.heappop(heaps[side])
            if found[side][node] != (cost, audit):
                continue
            for step, edit, i, state in (self.backward if side else self.forward)(*node):
                label = (cost + step, edit + audit if side else audit + edit)
                to = (i, state)
                if to not in found[side] or label < found[side][to]:
                    found[side][to] = label
                    heapq.heappush(heaps[side], (*label, to))
                    other = found[1 - side].get(to)
                    if other is not None and (best is None or label[0] + other[0] < best):
                        best = label[0] + other[0]
        if best is None:
            return None
        crossings = found[0].keys() & found[1].keys()
        return best, min(found[0][x][1] + found[1][x][1] for x in crossings if found[0][x][0] + found[1][x][0] == best)


def _solved(rows: list[tuple[str, int]], whole: bool) -> tuple[list[int | None], list[str | None]]:
    """Costs and audits from each state (row) to each state (column) through ``rows``; only what a whole conversation needs, if it is one."""
    lattice, found = Lattice(rows), []
    for start in range(4):
        for end in range(4):
            found.append(lattice.cheapest(start, (end,)) if not whole or (start == START and end in ENDS) else None)
    return [x and x[0] for x in found], [x and x[1] for x in found]


_CHUNK = "seq int, part int, n long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, costs array<int>, audits array<string>, initials string, roles array<string>, texts array<string>"


class _Chunks:
    """Cuts a sorted range of rows into chunks of one conversation each."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.part, self.seq = schema, TaskContext.get().partitionId(), 0
        self.conv, self.before, self.open = None, None, False
        self.runs = 0  # conversations of this range so far
        self.empty()

    def empty(self) -> None:
        self.rows, self.roles, self.texts, self.turns, self.chars = [], [], [], [], 0

    def close(self, last: bool, range_end: bool) -> dict | None:
        """The chunk; ``last`` if its conversation ends with it as far as this range shows."""
        if not self.rows:
            return None
        whole = last and not range_end and not self.open and self.runs > 1
        costs, audits = _solved(self.rows, whole)
        known = [t for t in self.turns if t is not None]
        count = [sum(f == fault for _, f in self.rows) for fault in (BLANK, DUPLICATE, CUT)]
        illegal = sum(a[0] + b[0] not in _LEGAL for a, b in zip(self.rows, self.rows[1:]))
        chunk = {
            "conv_id": self.conv, "seq": self.seq, "part": self.part, "n": len(self.rows), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len(set(known)),
            "blank": count[0], "duplicate": count[1], "truncated": count[2], "illegal": illegal, "first_initial": self.rows[0][0], "last_initial": self.rows[-1][0],
            "costs": costs, "audits": audits, "initials": "".join(a for a, _ in self.rows), "roles": self.roles, "texts": self.texts,
        }
        self.seq += 1
        self.open = not last
        self.empty()
        return chunk

    def add(self, conv, turn, role: str, text: str, again: bool) -> dict | None:
        """Takes a row; gives the chunk that ends before it."""
        done = None
        if self.runs == 0 or conv != self.conv:
            done = self.close(last=True, range_end=False)
            self.conv, self.before, self.open, self.runs = conv, None, False, self.runs + 1
        elif len(self.rows) >= CHUNK or self.chars >= CHUNK_CHARS:
            done = self.close(last=False, range_end=False)
        row = (turn, role, text)
        fault = BLANK if not _SOLID.search(text) else DUPLICATE if again or row == self.before else FINE if _ENDED.search(text) else CUT
        self.before = row
        self.rows.append((role[0] if role.startswith(("s", "u", "a")) else "-", fault))
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.chars += len(text) + len(role)
        return done

    def batch(self, chunks: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(chunks, schema=self.schema)


def _cut(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, out = _Chunks(schema), []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                done = cutter.add(*row)
                if done:
                    out.append(done)
            if out:
                yield cutter.batch(out)
                out = []
        done = cutter.close(last=True, range_end=True)
        if done:
            yield cutter.batch([done])

    return run


def _joined(chunks: list[dict]) -> Label:
    """The cheapest way through a chain of chunks, least in ASCII order among those of equal cost."""
    ways: dict[int, Label] = {START: (0, "")}
    for c in chunks:
        after: dict[int, Label] = {}
        for start, (cost, audit) in ways.items():
            for end in range(4):
                step = c["costs"][4 * start + end]
                if step is None or (end in after and cost + step > after[end][0]):
                    continue
                label = (cost + step, audit + c["audits"][4 * start + end])
                if end not in after or label < after[end]:
                    after[end] = label
        ways = after
    return min(ways[e] for e in ENDS if e in ways)


_SUMS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _summary(conv, chunks: list[dict]) -> dict:
    cost, audit = _joined(chunks)
    turns, illegal, last_turn, last = 0, 0, None, None
    for c in chunks:
        turns += c["turns"] - (last_turn is not None and c["first_turn"] == last_turn)
        illegal += c["illegal"] + (last is not None and last + c["first_initial"] not in _LEGAL)
        last_turn, last = c["last_turn"] if c["last_turn"] is not None else last_turn, c["last_initial"]
    known = [c["first_turn"] for c in chunks if c["first_turn"] is not None]
    sums = {k: sum(c[k] for c in chunks) for k in ("blank", "duplicate", "truncated")}
    return {"conv_id": conv, "gaps": last_turn - known[0] + 1 - turns if known else 0, **sums, "illegal": illegal, "cost": cost, "audit": audit}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """The rows of each conversation of a partition that is sorted by it."""
    rows = (row for batch in batches for i in range(0, batch.num_rows, 64) for row in batch.slice(i, 64).to_pylist())
    return groupby(rows, key=lambda row: row["conv_id"])


def _solve(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, rows in _runs(batches):
            out.append(_summary(conv, [r for r in rows if r["costs"] is not None]))
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def repaired(chunk: dict, audit: str, at: int, state: int) -> tuple[list[str], int, int]:
    """The rows of a chunk after the edits from ``at`` on, as ``role:text``; the place and state after them."""
    out, i, n = [], 0, len(chunk["roles"])
    while at < len(audit) and (i < n or audit[at] == "I"):
        edit = audit[at]
        at += 1
        if edit == "I":
            state = _next_turn(state)
            out.append(("user:", "assistant:")[state == ASSISTANT])
            continue
        role, text = chunk["roles"][i], chunk["texts"][i]
        initial = chunk["initials"][i]
        i += 1
        if edit == "K":
            state = _kept_from(initial, state)
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = _next_turn(state)
            out.append(("user:", "assistant:")[state == ASSISTANT] + text)
    return out, at, state


def _digest(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, rows in _runs(batches):
            summary = next(rows)  # the audit comes before the chunks
            sha, at, state, first = hashlib.sha256(), 0, START, True
            for chunk in rows:
                turns, at, state = repaired(chunk, summary["audit"], at, state)
                for turn in turns:
                    sha.update(turn.encode() if first else b"\n" + turn.encode())
                    first = False
            out.append({k: summary[k] for k in ("conv_id", *_SUMS, "audit")} | {"repaired_sha256": sha.hexdigest()})
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with the faults that crc32(``conv_id:turn``) % 20 names: dropped (0), emptied (1), without ``[.!?]`` (2), twice (3), as user (4)."""
    kept = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kept = kept.withColumn("fate", F.crc32(key.cast("binary")) % 20).filter("fate <> 0")
    kept = kept.withColumn("text", F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    kept = kept.withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))).drop("fate", "copy")


def repair(rows: DataFrame, roster: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: its faults, the cost and audit of the cheapest repair, the digest of the repaired rows.

    ``roster`` (with ``conv_id``) names conversations to answer for even if ``rows`` has none of theirs.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    repeats = rows.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    names = {c: fresh(rows, f"{c}_of_first") for c in ("conv_id", "digest")}
    repeats = repeats.withColumnsRenamed(names)
    met = rows.join(repeats, rows["conv_id"].eqNullSafe(repeats[names["conv_id"]]) & (rows["digest"] == repeats[names["digest"]]), "left")
    met = met.withColumn("again", F.coalesce(F.col("first") != place, F.lit(False)))
    order = ["conv_id", "turn", "role", "digest"]
    ranges = met.select(*order, "text", "again").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    key = StructField("conv_id", rows.schema["conv_id"].dataType)
    chunk_schema = StructType([key, *StructType.fromDDL(_CHUNK).fields])
    ranges = ranges.select("conv_id", "turn", "role", "text", "again")
    chunks = Scratch(spark, "repair").settle(ranges.mapInArrow(_cut(to_arrow_schema(chunk_schema)), chunk_schema))
    # Chains of chunks without texts; a conversation of the roster has a row of its own before them.
    slim = chunks.drop("roles", "texts", "initials")
    if roster is not None:
        named = roster.select(F.col(conv_id).alias("conv_id")).distinct().withColumns({"part": F.lit(-1), "seq": F.lit(0)})
        slim = slim.unionByName(named, allowMissingColumns=True)
    slim = slim.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    sums = StructType([key, *(StructField(c, LongType()) for c in _SUMS), StructField("audit", StringType())])
    summaries = slim.mapInArrow(_solve(to_arrow_schema(sums)), sums).withColumns({"part": F.lit(-1), "seq": F.lit(0)})
    spoken = chunks.select("conv_id", "part", "seq", "initials", "roles", "texts")
    both = summaries.unionByName(spoken, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    out = StructType([*sums.fields, StructField("repaired_sha256", StringType())])
    return both.mapInArrow(_digest(to_arrow_schema(out)), out)
