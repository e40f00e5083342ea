"""Best-fit-decreasing packing of tokenised documents into sequences.

A document is its token ids and a closing id.  One longer than a sequence is cut
into whole sequences, its first piece taking what is left over.  Pieces are dealt
by hash into groups of a few thousand; each group is sorted by falling length and
every piece goes to the open sequence with the least room that still holds it,
found in logarithmic time by a segment tree over the possible remaining rooms.
A group of thousands of pieces ends with about one sequence that isn't full, so
the groups cost next to nothing against packing all at once, and no group grows
with the data.

Defined cases: null or empty text is the closing id alone; equal rows are packed
separately (each is its own document, told apart by ``copy``); an empty table
gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe_text import PieceCache, load_vocabulary
from .session import Scratch

GROUP_PIECES = 4096
#: Longer pieces between white space aren't remembered.
LONGEST_CACHED = 128
#: White space that follows something else; ASCII only, as engines differ on other white space.
_CUTS = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])")


class IdEncoder:
    """Texts to token ids by the tokenizers library, as little-endian unsigned 32-bit bytes.

    A text is cut before white space that follows something else, where a pre-token always
    begins; the library encodes each distinct piece once, whatever its length.  Texts with
    special strings, or under a vocabulary that changes texts first, are encoded whole.
    """

    def __init__(self, path: str):
        _, _, special = load_vocabulary(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = list(special)
        self.uncut = self.library.normalizer is not None
        self.pieces = PieceCache(self.whole)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.uncut or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join([self.pieces[p] if len(p) <= LONGEST_CACHED else self.whole(p) for p in _CUTS.split(text)])


_encoders: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    if path not in _encoders:
        _encoders[path] = IdEncoder(path)
    return _encoders[path]


class RoomTree:
    """Counts of open sequences by remaining room, in a segment tree."""

    def __init__(self, most: int):
        self.size = 1
        while self.size <= most:
            self.size *= 2
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i //= 2

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that an open sequence has."""
        i = length + self.size
        if self.count[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; ``lengths`` must fall."""
    tree, rooms = RoomTree(capacity), [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i, length in enumerate(lengths.tolist()):
        room = tree.tightest(length)
        if room is None:
            at, room = made, capacity
            made += 1
        else:
            at = rooms[room].pop()
            tree.add(room, -1)
        sequence[i], offset[i] = at, capacity - room
        if room > length:
            rooms[room - length].append(at)
            tree.add(room - length, 1)
    return sequence, offset


_PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"


def token_pieces(df: DataFrame, vocabulary: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece of each tokenised document; a narrow map.

    Ids are made, digested and let go document by document; only numbers leave.
    """
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for name, copy, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = memoryview(enc.encode(t.as_py()) + end)
                n = len(ids) // 4
                start, length = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    out.append((name, copy, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, length = start + length, capacity
            enc.pieces.trim()
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "copy", "piece", "start", "length", "ids_crc32"],
            )

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, _PIECES)


def pack(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``.  ``pieces`` must be settled: it is counted first.

    A group holds about ``group_pieces`` rows of six numbers whatever the table's size.
    """
    groups = max(1, -(-pieces.count() // group_pieces))

    def fit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        length = rows["length"].to_numpy()
        order = np.lexsort((rows["piece"].to_numpy(), rows["copy"].to_numpy(), -length))
        rows = rows.take(pa.array(order))
        sequence, offset = best_fit(length[order], capacity)
        rows = rows.drop(["pack_group"])
        return rows.append_column("sequence_id", pa.array(key[0].as_py() + sequence * groups)).append_column("offset", pa.array(offset))

    return pieces.withColumn("pack_group", F.pmod(F.xxhash64("copy", "piece"), F.lit(groups))).groupBy("pack_group").applyInArrow(fit, _PACKED)


def pack_documents(df: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Tokenises, cuts and packs every document of ``df`` (``doc_id``, ``text``).

    The tokenised pieces (numbers only) are settled once in the checkpoint folder,
    so a lost executor costs no second tokenisation of everything.
    """
    pieces = Scratch(df.sparkSession, "packing").settle(token_pieces(df, vocabulary, capacity, end_id))
    return pack(pieces, capacity, group_pieces)
