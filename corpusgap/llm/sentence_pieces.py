"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut where no piece of the vocabulary can cross (before each
run of the space mark) and their distinct segments are concatenated.  A suffix array
of that string, ordered by as many characters as the longest piece has, is searched
in binary for every piece of the vocabulary at once; each range gives that piece's
occurrences, which are edges (place, length, piece).  Sorted by place they form a
table that is then relaxed: as this vocabulary is a merge vocabulary, the relaxation
joins, in each segment, the leftmost of the best-ranked edges over two neighbouring
symbols until none is left.  Characters that are no piece fall back to bytes.

Defined cases: null or empty text has no pieces and decodes to ""; a space mark in a
text reads as a space, as in the library; repeated rows are encoded each; extra
columns pass through.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .session import fresh

MARK = "▁"
#: Characters of distinct segments that one suffix array covers.
INDEX_CHARS = 1 << 18
#: Segments that a worker remembers at most.
KNOWN_SEGMENTS = 500_000
#: Longer segments are relaxed one by one with a heap.
LONG_SEGMENT = 64

_SEGMENT = regex.compile(f"{MARK}+[^{MARK}]*")


class PieceEncoder:
    """Encodes and decodes under one model file; segments once worked out are kept."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        scores = [model.get_score(i) for i in range(len(pieces))]
        plain = [i for i in range(len(pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        if any(MARK in pieces[i].lstrip(MARK) for i in plain) or not any(model.is_byte(i) for i in range(len(pieces))):
            raise ValueError(f"{path}: pieces cross words, or there are no byte pieces")
        self.byte_id = {int(pieces[i][3:5], 16): i for i in range(len(pieces)) if model.is_byte(i)}
        self.longest = max(len(pieces[i]) for i in plain)
        letters = sorted({c for i in plain for c in pieces[i]})
        # A letter's two-byte code: its second byte is never 0, so no key ends in a zero that counts.
        codes = np.zeros(0x110000, np.uint16)
        codes[[ord(c) for c in letters]] = [((i // 255) << 8) | (i % 255 + 1) for i in range(len(letters))]
        self.codes = codes
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-scores[i], i)))}
        self.ids = np.array(sorted(plain, key=rank.get), np.int32)
        self.pieces = [pieces[i] for i in self.ids]
        raw = [self._key(p) for p in self.pieces]
        self.lengths = np.array([len(p) for p in self.pieces])
        width = 2 * self.longest
        self.low = np.array(raw, f"S{width}")
        self.high = np.array([k + b"\xff" * (width - len(k)) for k in raw], f"S{width}")
        self.known: dict[str, bytes] = {}
        self.text_of = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in self.byte_id.items():
            self.text_of[i] = bytes([b])
        for i in range(len(pieces)):
            if model.is_control(i) or model.is_unknown(i):
                self.text_of[i] = b""

    def _key(self, text: str) -> bytes:
        return self.codes[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(">u2").tobytes()

    def edges(self, points: np.ndarray) -> np.ndarray:
        """table[place, length]: rank of the piece that stands there, or -1."""
        n, width = len(points), self.longest
        code = np.zeros(n + width, ">u2")
        code[:n] = self.codes[points]
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(code, width)[:n]).view(f"S{2 * width}").ravel()
        suffixes = np.argsort(keys, kind="stable")
        ordered = keys[suffixes]
        first, last = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        count = last - first
        piece = np.repeat(np.arange(len(count)), count)
        at = suffixes[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        table = np.full((n + 1, width + 1), -1, np.int32)
        order = np.argsort(at, kind="stable")
        table[at[order], self.lengths[piece[order]]] = piece[order]
        return table

    def learn(self, segments: list[str]) -> None:
        """Works out segments, an index of INDEX_CHARS characters at a time."""
        batch, size = [], 0
        for s in segments:
            batch.append(s)
            size += len(s) + 1
            if size >= INDEX_CHARS:
                self._learn(batch)
                batch, size = [], 0
        if batch:
            self._learn(batch)

    def _table(self, points: np.ndarray) -> np.ndarray:
        """The edges of all points; an index holds about INDEX_CHARS of them, as an edge reaches no further than the longest piece."""
        if len(points) <= 2 * INDEX_CHARS:
            return self.edges(points)
        return np.concatenate([self.edges(points[a : a + INDEX_CHARS + self.longest])[: len(points) - a][:INDEX_CHARS] for a in range(0, len(points), INDEX_CHARS)])

    def _learn(self, segments: list[str]) -> None:
        points = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le"), np.uint32)
        table = self._table(points)
        sizes = np.array([len(s) for s in segments])
        starts = np.cumsum(sizes + 1) - sizes - 1
        short = sizes <= LONG_SEGMENT
        at, length, owner = self._relax(table, starts[short], sizes[short])
        cut = np.searchsorted(owner, np.arange(short.sum() + 1))
        names = np.flatnonzero(short)
        ranks = table[at, np.minimum(length, self.longest)]
        ids = np.where(ranks >= 0, self.ids[np.maximum(ranks, 0)], -1)
        for j, i in enumerate(names):
            self.known[segments[i]] = self._written(points, at[cut[j] : cut[j + 1]], ids[cut[j] : cut[j + 1]])
        for i in np.flatnonzero(~short):
            at, length = self._relax_long(table, int(starts[i]), int(sizes[i]))
            ranks = table[at, length]
            self.known[segments[i]] = self._written(points, at, np.where(ranks >= 0, self.ids[np.maximum(ranks, 0)], -1))

    def _written(self, points: np.ndarray, at: np.ndarray, ids: np.ndarray) -> bytes:
        if len(ids) and ids.min() < 0:
            out = []
            for place, i in zip(at.tolist(), ids.tolist(), strict=True):
                out += [i] if i >= 0 else [self.byte_id[b] for b in chr(points[place]).encode()]
            ids = np.array(out)
        return ids.astype("<i4").tobytes()

    def _relax(self, table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, segment) of the symbols left, for all segments in step."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        length = np.ones(len(at), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        far = np.iinfo(np.int32).max
        while len(at):
            rank = np.full(len(at), far, np.int64)
            pair = np.flatnonzero(owner[1:] == owner[:-1])
            joined = length[pair] + length[pair + 1]
            pair, joined = pair[joined <= self.longest], joined[joined <= self.longest]
            found = table[at[pair], joined]
            rank[pair] = np.where(found >= 0, found, far)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, first)
            spread = np.diff(np.append(first, len(at)))
            open_ = np.repeat(best < far, spread)
            if not open_.all():
                done.append((at[~open_], length[~open_], owner[~open_]))
            hit = np.flatnonzero(open_ & (rank == np.repeat(best, spread)))
            if not len(hit):
                break
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]
            length[hit] += length[hit + 1]
            open_[hit + 1] = False
            at, length, owner = at[open_], length[open_], owner[open_]
        if not done:
            return at, length, owner
        at, length, owner = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.lexsort((at, owner))
        return at[order], length[order], owner[order]

    def _relax_long(self, table: np.ndarray, start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long segment, with a heap over a linked list."""
        length, after, before = [1] * size, list(range(1, size + 1)), list(range(-1, size - 1))
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < size and length[i] + length[j] <= self.longest:
                rank = int(table[start + i, length[i] + length[j]])
                if rank >= 0:
                    heapq.heappush(heap, (rank, i, length[i] + length[j]))

        for i in range(size):
            push(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if not length[i] or j >= size or length[i] + length[j] != whole:
                continue
            length[i], length[j] = whole, 0
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        left = np.flatnonzero(np.array(length))
        return start + left, np.array(length)[left]

    @staticmethod
    def segments(text: str | None) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked:
            return _SEGMENT.findall(marked)
        return [MARK + s for s in marked.split(MARK)[1:]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > KNOWN_SEGMENTS:
            self.known.clear()
        cut = [self.segments(t) for t in texts]
        self.learn([s for s in dict.fromkeys(chain.from_iterable(cut)) if s not in self.known])
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode(df: DataFrame, model: str, text: str = "text", name: str = "piece_ids", rows: int = 500) -> DataFrame:
    """``df`` with the piece ids of each whole text, little-endian 32-bit; a narrow map."""
    name, columns = fresh(df, name), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                ids = enc.encode(part.column(columns.index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [*columns, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, BinaryType())]))


def decode(df: DataFrame, model: str, ids: str = "piece_ids", name: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df``, without the columns ``drop``, with the text that each row's ids stand for; a narrow map."""
    kept = [f for f in df.schema.fields if f.name not in drop]
    name, columns = fresh(df, name), df.columns
    places = [columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            texts = [enc.decode(x.as_buffer()) if x.is_valid else "" for x in batch.column(columns.index(ids))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], pa.array(texts, pa.string())], [*[columns[i] for i in places], name])

    return df.mapInArrow(run, StructType([*kept, StructField(name, StringType())]))


def round_trip(df: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip) of every whole text."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = encode(rows, model).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "piece_ids")
    rows = rows.withColumns({"n_pieces": F.floor(F.octet_length("piece_ids") / 4).cast("long"), "ids_crc32": F.crc32("piece_ids")})
    rows = decode(rows, model, drop=("piece_ids",))
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return rows.select("doc_id", "n_pieces", "ids_crc32", decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("round_trip"))
