"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once; the hash names a bin and a value and each
bin keeps its least value.  Empty bins are filled by optimal densification: a
fixed 2-universal sequence of probes per bin, the first non-empty probed bin
lends its value.  The lowest ``bits`` bits of every bin are packed.  The likeness
of two fingerprints is the share of equal bins, corrected for the 2**-bits chance
that different values agree.

Defined cases: null or empty text, or white space alone, has the fingerprint ""
(like another "": 1, like any other: 0); fewer words than a shingle are one
shingle; equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import StringType, StructField, StructType

from .session import fresh, shuffle_partitions
from .textkit import U64, Texts, chunks, mix64

WIDTH, BINS, BITS = 5, 256, 4


def _probes(bins: int, attempts: int) -> np.ndarray:
    """probes[a, b]: the bin that empty bin b looks at in its a-th attempt."""
    seed = np.arange(attempts, dtype=U64)[:, None] * U64(0x9E3779B97F4A7C15) + np.arange(bins, dtype=U64)[None, :] * U64(0xC2B2AE3D27D4EB4F)
    return (mix64(seed) % U64(bins)).astype(np.int64)


def densify(values: np.ndarray, filled: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Fills the empty bins of rows that have at least one full bin."""
    out = values.copy()
    sole = filled.sum(axis=1) == 1
    if sole.any():
        out[sole] = np.where(filled[sole], values[sole], U64(0)).sum(axis=1, dtype=U64)[:, None]
    row, hole = np.nonzero(~filled & ~sole[:, None])
    attempt = 0
    while len(row):
        source = probes[attempt % len(probes)][hole]
        if attempt >= len(probes):
            source = (source + attempt // len(probes)) % values.shape[1]
        hit = filled[row, source]
        out[row[hit], hole[hit]] = values[row[hit], source[hit]]
        row, hole = row[~hit], hole[~hit]
        attempt += 1
    return out


def signatures(column: pa.Array, width: int, bins: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(low-order values of the bins, whether the text has words) for each text."""
    low = np.zeros((len(column), bins), np.uint8)
    there = np.zeros(len(column), bool)
    probes = _probes(bins, 1024)
    own = mix64(np.arange(1, bins + 1, dtype=U64))[None, :]
    for a, b in chunks(column):
        texts = Texts(column.slice(a, b - a))
        doc, hashed = texts.shingles(width)
        values = np.full((b - a) * bins, ~U64(0))
        slot = doc * bins + (hashed >> U64(32)).astype(np.int64) % bins
        np.minimum.at(values, slot, mix64(hashed))
        values = values.reshape(b - a, bins)
        has = texts.n_words > 0
        filled = np.zeros(values.size, bool)
        filled[slot] = True
        filled = filled.reshape(values.shape)
        values[has] = densify(values[has], filled[has], probes)
        salted = mix64(values + own)  # else a lent value would agree by chance in all its bins at once
        low[a:b] = (salted & U64((1 << bits) - 1)).astype(np.uint8)
        there[a:b] = has
    return low, there


def packed(low: np.ndarray, there: np.ndarray, bits: int) -> list[str]:
    """Bins as hexadecimal text, ``bits`` bits each."""
    planes = ((low[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1).reshape(len(low), -1).astype(np.uint8)
    rows = np.packbits(planes, axis=1)
    return [r.tobytes().hex() if t else "" for r, t in zip(rows, there, strict=True)]


def unpacked(prints: list[str], bins: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``packed``."""
    size = bins * bits // 8
    there = np.array([bool(p) for p in prints], bool)
    raw = np.frombuffer(b"".join(bytes.fromhex(p) if p else bytes(size) for p in prints), np.uint8).reshape(len(prints), size)
    planes = np.unpackbits(raw, axis=1).reshape(len(prints), bins, bits)
    return (planes << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8), there


def likeness(a: np.ndarray, a_there: np.ndarray, b: np.ndarray, b_there: np.ndarray, bits: int) -> np.ndarray:
    """Estimated Jaccard similarity, from 0 to 1, with the chance matches taken out."""
    chance = 2.0**-bits
    share = (a == b).mean(axis=1)
    out = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_there & b_there, out, (a_there == b_there).astype(float))


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``df`` with the fingerprint of each whole text; a narrow map."""
    if (bins * bits) % 8:
        raise ValueError("bins * bits must be a multiple of 8")
    name, columns = fresh(df, name), df.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = packed(*signatures(batch.column(columns.index(text)), width, bins, bits), bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], [*columns, name])

    return df.mapInArrow(add, StructType([*df.schema.fields, StructField(name, StringType())]))


def _id(doc_id: str):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def range_ends(df: DataFrame, doc_id: str) -> list[int]:
    """Upper ends of even ranges of ``doc_id``: ids that occur, a few a shuffle partition."""
    ranges = max(8, shuffle_partitions(df.sparkSession))
    shares = [(i + 1) / ranges for i in range(ranges)]
    found = df.select(_id(doc_id).alias("key")).agg(F.percentile_approx("key", shares, 100 * ranges).alias("ends"), F.max("key").alias("top")).first()
    return [] if found["top"] is None else sorted({*found["ends"], found["top"]})


def next_rows(df: DataFrame, ends: list[int], doc_id: str, carried: dict[str, str], tie: str) -> DataFrame:
    """Adds to each row values of the row after it in descending ``doc_id`` (the last row: the first).

    carried: new name -> column.  Rows are dealt into ranges of ``doc_id`` whose upper ends
    are ids that occur, so each range's first row is known beforehand and is also sent to
    the range above: one shuffle, no window over the whole table.  Nulls come last; rows
    with one id are ordered by ``tie``.
    """
    if not ends:
        return df.select("*", *[F.col(c).alias(n) for n, c in carried.items()])
    key = _id(doc_id)
    span = _search(key, ends)
    own = F.struct(span.alias("span"), F.lit(0).alias("copy"))
    above = F.when(key.isin(ends) & (key < ends[-1]), F.struct((span + 1).alias("span"), F.lit(1).alias("copy")))
    around = F.when(key == ends[-1], F.struct(F.lit(0).alias("span"), F.lit(2).alias("copy")))
    at = fresh(df, "dealt")
    rows = df.withColumn(at, F.explode(F.array_compact(F.array(own, above, around))))
    order = Window.partitionBy(f"{at}.span").orderBy((F.col(f"{at}.copy") == 2).asc(), key.desc(), F.col(f"{at}.copy"), F.col(tie))
    rows = rows.withColumns({n: F.lead(c).over(order) for n, c in carried.items()})
    return rows.filter(F.col(f"{at}.copy") == 0).drop(at)


def _search(key, ends: list[int]):
    """Number of ``ends`` below ``key``, by a tree of comparisons over the sorted list."""
    if not ends:
        return F.lit(0)
    mid = len(ends) // 2
    return F.when(key > ends[mid], F.lit(mid + 1) + _search(key, ends[mid + 1 :])).otherwise(_search(key, ends[:mid]))


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text is the text with its last floor(n/2) code points replaced by
    as many first ones (or all) of the next document in descending ``doc_id``.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ends = range_ends(rows, "doc_id")
    rows = fingerprints(rows, "text", "fingerprint", width, bins, bits)
    rows = next_rows(rows, ends, "doc_id", {"next_text": "text", "next_fingerprint": "fingerprint"}, "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, there = signatures(batch.column("edited"), width, bins, bits)
            own = unpacked(batch.column("fingerprint").to_pylist(), bins, bits)
            following = unpacked(batch.column("next_fingerprint").to_pylist(), bins, bits)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("n_chars"),
                    batch.column("edited_sha256"),
                    batch.column("fingerprint"),
                    pa.array(packed(low, there, bits), pa.string()),
                    pa.array(likeness(*own, low, there, bits)),
                    pa.array(likeness(*own, *following, bits)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return rows.mapInArrow(compare, schema)
