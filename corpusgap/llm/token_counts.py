"""Token counts by heap-and-linked-list byte-pair merging.

Each distinct pre-token starts as a linked list of byte symbols.  A heap holds
its adjacent pairs by merge rank, then place; the lowest is popped again and
again, its two symbols are joined, and the pairs that arise are pushed.  The
count is the number of initial symbols minus the number of merges.  Identifiers
are never made.

Defined cases: null or empty text has 0 tokens; each special string inside a
text is one token, as the library's default has it; equal rows count alike;
columns of the input other than those named don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe_text import PATTERN, CutText, PieceCache, byte_letters, load_vocabulary
from .session import fresh

_PRETOKEN = regex.compile(PATTERN)


class MergeCounter:
    """Counts the tokens of texts under one vocabulary file."""

    def __init__(self, path: str):
        vocab, merges, special = load_vocabulary(path)
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.letter = byte_letters()
        self.cut = CutText(list(special))
        self.words = PieceCache(self.merged)
        self.pieces = PieceCache(lambda piece: self.whole(" " + piece))

    def merged(self, pretoken: str) -> int:
        """Initial symbols minus merges, by heap and linked list."""
        symbols = [self.letter[b] for b in pretoken.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        rank = self.rank
        heap = []
        for i in range(n - 1):
            r = rank.get((symbols[i], symbols[i + 1]))
            if r is not None:
                heap.append((r, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, ""
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                r = rank.get((symbols[i], symbols[k]))
                if r is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0:
                r = rank.get((symbols[h], symbols[i]))
                if r is not None:
                    heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return n - merges

    def whole(self, text: str) -> int:
        return sum(map(self.words.__getitem__, _PRETOKEN.findall(text)))

    def plain(self, text: str) -> int:
        if not text:
            return 0
        if not self.cut.simple(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + sum(map(self.pieces.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        spans = self.cut.spans(text)
        return len(spans) // 2 + sum(map(self.plain, spans[::2]))

    def trim(self) -> None:
        self.words.trim()
        self.pieces.trim()


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter a worker and file, so that its cache serves many tasks."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """``df`` without ``text``, with the number of tokens of each whole text.

    A narrow map: no shuffle, and memory of one Arrow batch and the bounded cache.
    """
    n_tokens = fresh(df.drop(text), n_tokens)
    kept = [c for c in df.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            texts = batch.column(len(kept))
            counts = [c.count(texts[i].as_py()) for i in range(len(texts))]
            c.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*kept, n_tokens])

    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text))
    schema = StructType([*(f for f in df.schema.fields if f.name != text), StructField(n_tokens, LongType())])
    return rows.mapInArrow(count, schema)
