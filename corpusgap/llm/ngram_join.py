"""N-gram Jaccard self-join by PartEnum signatures, and its components.

A document's set is its distinct word shingles.  Two sets of at least similarity
g differ in at most k = (1-g)/(1+g) * (|r|+|s|) elements.  Sets are put in size
bands so that similar sets are in one band or in neighbouring ones; a set writes
signatures for its own band and, if a similar set may be there, for the next.
For a band the feature domain is partitioned by hash, and subsets of partitions
are enumerated so that sets differing in at most k elements agree on one whole
subset, hence on one signature:

* k = 0: one partition; * k <= 3: k + 2 partitions, every pair of them a subset;
* k > 3: two levels.  The first has so many groups that similar sets differ in at most
  one element in some group (``_AGREE`` groups at least); the second cuts each group into
  three partitions and enumerates the pairs of them, one of which has no difference.

Signatures are shuffled with a 64-bit fingerprint of the set, so exact copies are
one member.  Pairs of partitions without elements are written by threes, as one
signature each; where that would be very many by twos, or one by one if three groups have such pairs.

Inside a group of equal signatures every member is paired with the group's first and
pairs are checked exactly on the sets, member by member against the first.  Groups
whose members are then still in different components are checked once more: those of
at most ``_FEW`` members pair by pair, so pairs stay in proportion to members; larger
ones in tiles of two blocks of members each.  Where there are two levels, similar sets
agree in ``_AGREE`` groups at least, so pairs that share fewer signatures and empty pairs
of partitions together are left out.  Large groups that share members are tiled
as one family where that compares fewer pairs.  Before sets meet, their parity sketches
do, which are about a twentieth as long: the bits in which they differ are no more than
the elements in which the sets do, so no similar pair is lost, and few others are left.
A tile that leaves many pairs is checked in one place, pair by pair as long as they aren't
joined, or, if pairs are very many, by one matrix product that gives all intersections; no
more links than members are returned, so rows stay in proportion to members.

Defined cases: null, empty or white-space text: no shingles, no links; fewer words
than a shingle: the whole sequence is the one shingle; repeated rows are exact
copies; an empty table gives an empty table; extra columns are ignored; a null
``doc_id`` takes part in links and is never the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, merged_labels
from .session import Scratch
from .textkit import U64, Texts, chunks, mix64

_BAND_BITS = 8
_FEW = 32
#: Groups, of a band of two levels, in which similar sets differ in at most one element.
_AGREE = 3
#: Pairs a member that sketches may leave of a tile; a tile that leaves more is checked where its sets are.
_DENSE = 2
#: There pairs are checked one by one up to so many a member, and beyond by one matrix product.
_WHOLE = 32
_BLOCK_SETS = 1024
_STAR_BLOCK = 512
_SHARES = 2
_BLOCK_ITEMS = 1 << 20


class Bands:
    """Size bands and signature plans for the similarity ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        starts = [1]
        while starts[-1] < 1 << 33 and len(starts) < 1 << _BAND_BITS:
            starts.append(starts[-1] * den // num + 1)
        self.starts = np.array(starts)
        most = self.starts[1:] - 1
        self.apart = 2 * most * (den - num) // (den + num)
        # So many empty pairs of partitions get one signature: as many as don't make more signatures than there are pairs.
        pairs = 3.0 * (self.apart // 2 + _AGREE)
        empty = pairs * np.exp(-2 * self.starts[:-1] * num / den / pairs)
        self.together = np.select([empty**3 / 6 <= pairs, empty**2 / 2 <= pairs], [_AGREE, 2], 1)

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, size, side="right") - 1

    def reaches_next(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        return size * self.den // self.num >= self.starts[band + 1]

    @staticmethod
    def parts(k: np.ndarray) -> np.ndarray:
        """Partitions of a band whose sets differ in at most k elements; for k > 3 three in each group."""
        return np.where(k == 0, 1, np.where(k <= 3, k + 2, 3 * (k // 2 + _AGREE)))

    @property
    def deep(self) -> int:
        """The first band of two levels."""
        return int(np.searchsorted(self.apart, 3, side="right"))


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(from row, to row, sizes, fingerprints, documents, sorted distinct shingles) by chunks."""
    for a, b in chunks(column):
        texts = Texts(column.slice(a, b - a))
        doc, hashed = texts.shingles(width)
        cut = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            hashed[cut[i] : cut[i + 1]].sort()
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
        doc, hashed = doc[new], hashed[new]
        size = np.bincount(doc, minlength=b - a)
        total = np.zeros(b - a, U64)
        np.add.at(total, doc, mix64(hashed ^ U64(0x5851F42D4C957F2D)))
        yield a, b, size, mix64(total + size.astype(U64)).view(np.int64), doc, hashed


def partitions(size: np.ndarray, doc: np.ndarray, hashed: np.ndarray, bands: Bands, step: int) -> tuple[np.ndarray, ...]:
    """Of some sets in their own band (``step`` 0) or the next (1): band, whether they write it, k, first partition, the
    owner of each partition; then the hash and the partition of each element."""
    own = bands.band(np.maximum(size, 1))
    use = (size > 0) & (bands.reaches_next(size, own) if step else True)
    band = own + step
    k = np.where(use, bands.apart[band], 0)
    parts = np.where(use, bands.parts(k), 0)
    base = np.cumsum(parts) - parts
    mine = use[doc]
    d, h = doc[mine], hashed[mine]
    salt = mix64(band.astype(U64) + U64(77))
    spread = mix64(h ^ salt[d])
    slot = base[d] + ((spread >> U64(33)).astype(np.int64) % parts[d])
    return band, use, k, base, np.repeat(np.arange(len(size)), parts), spread, slot


def empty_pairs(size: np.ndarray, doc: np.ndarray, hashed: np.ndarray, bands: Bands) -> pa.Array:
    """Of each set its pairs of partitions without elements (band and place), in bands of two levels; what similar sets may
    agree on without a signature for it."""
    out = []
    for step in (0, 1):
        band, use, k, base, owner, _, slot = partitions(size, doc, hashed, bands, step)
        count = np.bincount(slot, minlength=len(owner))
        deep = np.flatnonzero((use & (k > 3))[owner])[::3]
        for j, (x, y) in enumerate(combinations(range(3), 2)):
            at = deep[count[deep + x] + count[deep + y] == 0]
            out.append(np.stack([owner[at], (at - base[owner[at]] + j) << _BAND_BITS | band[owner[at]]]))
    of, place = np.concatenate(out, axis=1)
    order = np.argsort(of, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[order], np.arange(len(size) + 1)).astype(np.int32)), pa.array(place[order]))


def empty_signatures(owner: np.ndarray, place: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of each ``many`` empty pairs of one owner in different groups; rows are sorted by owner and place."""
    whose, sig = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for steps in combinations(range(1, int(np.bincount(owner).max(initial=0))), many - 1):
        at = np.flatnonzero(owner[: -steps[-1]] == owner[steps[-1] :])
        places = np.stack([place[at + step] for step in (0, *steps)])
        apart = (places[1:] // 3 != places[:-1] // 3).all(axis=0)
        mixed = np.full(int(apart.sum()), 0x2545F4914F6CDD1D, U64)
        for row in places[:, apart]:
            mixed = mix64(mixed + row.astype(U64))
        whose.append(owner[at[apart]])
        sig.append(mixed)
    return np.concatenate(whose), np.concatenate(sig)


def signatures(size: np.ndarray, prints: np.ndarray, doc: np.ndarray, hashed: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, fingerprint) rows of some sets; the low bits of a signature are its band."""
    out_sig, out_print = [], []
    for step in (0, 1):
        band, use, k, base, owner, spread, slot = partitions(size, doc, hashed, bands, step)
        total, count = np.zeros(len(owner), U64), np.zeros(len(owner), np.int64)
        np.add.at(total, slot, mix64(spread + U64(0xA0761D6478BD642F)))
        np.add.at(count, slot, 1)
        whole = np.flatnonzero((use & (k == 0))[owner])
        groups = [(owner[whole], total[whole], count[whole], np.zeros(len(whole), np.int64))]
        for few in (1, 2, 3):
            rows = np.flatnonzero(use & (k == few))
            for j, (x, y) in enumerate(combinations(range(few + 2), 2) if len(rows) else ()):
                p, q = base[rows] + x, base[rows] + y
                groups.append((rows, total[p] + total[q], count[p] + count[q], np.full(len(rows), j)))
        first = np.flatnonzero((use & (k > 3))[owner])[::3]
        for j, (x, y) in enumerate(combinations(range(3), 2)):
            p, q = first + x, first + y
            groups.append((owner[first], total[p] + total[q], count[p] + count[q], first - base[owner[first]] + j))
        owner, total, count, place = (np.concatenate(c) for c in zip(*groups, strict=True))
        # _AGREE of a set's groups at least must agree with a similar set's: in one pair that isn't empty, or all in empty ones,
        # which have signatures so many together as it needs (where that would be very many: fewer together or one by one).
        together = np.where(k > 3, bands.together[band], 1)
        for many in (2, _AGREE):
            none = np.flatnonzero((count == 0) & (together == many)[owner])
            none = none[np.lexsort((place[none], owner[none]))]
            whose, sig = empty_signatures(owner[none], place[none], many)
            out_sig.append(((sig << U64(_BAND_BITS)) | band[whose].astype(U64)).view(np.int64))
            out_print.append(prints[whose])
        lacking = np.unique((owner[count == 0] << 32) | (place[count == 0] // 3))
        lacking = np.bincount(lacking >> 32, minlength=len(size))
        keep = (count > 0) | ((lacking > np.where(k > 3, _AGREE - 1, 0)) & (together == 1))[owner]
        owner, total, count, place = owner[keep], total[keep], count[keep], place[keep]
        sig = mix64(total + mix64(count.astype(U64) * U64(0x9FB21C651E98DF25) + place.astype(U64)))
        sig = (sig << U64(_BAND_BITS)) | band[owner].astype(U64)
        out_sig.append(sig.view(np.int64))
        out_print.append(prints[owner])
    return np.concatenate(out_sig), np.concatenate(out_print)


def _digests(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, print); print is null for a set without elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, size, prints, _, _ in shingle_sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), pa.array(prints, mask=size == 0)], ["doc_id", "n_shingles", "print"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, print long")


def _signature_rows(docs: DataFrame, width: int, num: int, den: int, part: int, parts: int) -> DataFrame:
    """(sig, print) of every set, one set's once a task; of the signatures only the ``part``-th of ``parts`` shares by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in batches:
            for _, _, size, prints, doc, hashed in shingle_sets(batch.column(1), width):
                new = np.array([not (p in seen or seen.add(p)) for p in prints.tolist()], bool) & (size > 0)
                keep = new[doc]
                sig, owner = signatures(np.where(new, size, 0), prints, doc[keep], hashed[keep], bands)
                mine = (sig.view(U64) >> U64(40)) % U64(parts) == part
                yield pa.RecordBatch.from_arrays([pa.array(sig[mine]), pa.array(owner[mine])], ["sig", "print"])

    return docs.mapInArrow(run, "sig long, print long")


def _shared(rows: DataFrame) -> DataFrame:
    """(sig, print, first) of every distinct member of a signature that several sets have; first: its least.

    Rows are dealt and sorted by signature and read as a stream; what is carried from
    batch to batch is one row and its group's first, however many share the signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        before = None
        for batch in chain(batches, [None]):
            columns = held if batch is None else [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            sig, member = columns
            if not len(sig):
                continue
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])
            sig, member = sig[fresh], member[fresh]
            # The last distinct row waits for what follows it; later repeats of it go.
            end = len(sig) - (batch is not None)
            linked = np.zeros(len(sig), bool)
            same = sig[1:] == sig[:-1]
            linked[1:] |= same
            linked[:-1] |= same
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            first = np.repeat(member[head], np.diff(np.append(head, len(sig))))
            if before is not None and before[0] == sig[0]:
                linked[0] = True
                first[: head[1] if len(head) > 1 else len(sig)] = before[1]
            out = np.flatnonzero(linked[:end])
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(member[out]), pa.array(first[out])], ["sig", "print", "first"])
            if end:
                before = (sig[end - 1], first[end - 1])
            held = [sig[end:], member[end:]]

    sorted_rows = rows.repartition("sig").sortWithinPartitions("sig", "print")
    return sorted_rows.mapInArrow(run, "sig long, print long, first long")


def packed_items(hashed: np.ndarray) -> bytes:
    """The high 48 bits of each hash; they tell the few thousand shingles of two texts apart."""
    return np.ascontiguousarray(hashed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def read_items(items: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(items.as_buffer(), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def parity_sketch(hashed: np.ndarray) -> bytes:
    """Of each of some bins whether an odd number of a set's elements falls there: at least two bins an element, a power of two.

    Two sets differ in at least as many elements as their sketches do in bits; folding a sketch
    (the XOR of its halves) gives that of half as many bins.
    """
    bits = 1 << max(7, int(2 * len(hashed) - 1).bit_length())
    odd = np.bincount(((hashed >> U64(16)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def read_sketch(size: int, sketch: pa.Scalar) -> tuple[int, np.ndarray]:
    return size, np.frombuffer(sketch.as_buffer(), U64)


def similar_sets(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets, each without repeats, are similar."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return den * inter >= num * (len(x) + len(y) - inter)


def may_be_similar(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], num: int, den: int) -> bool:
    """False only for sets (size, sketch) that aren't similar."""
    (size_a, x), (size_b, y) = a, b
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (den + num) <= (size_a + size_b) * (den - num)


def _sets(docs: DataFrame, wanted: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(print, size, empty, items, sketch) of the wanted sets (wanted_id, print): sorted shingle hashes of 48 bits as bytes, and their parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            asked = batch.column(0).to_numpy()
            for a, b, size, prints, doc, hashed in shingle_sets(batch.column(1), width):
                empty = empty_pairs(size, doc, hashed, bands)
                cut = np.concatenate([[0], np.cumsum(size)])
                rows = np.flatnonzero(prints == asked[a:b])
                items = [packed_items(hashed[cut[i] : cut[i + 1]]) for i in rows]
                sketches = [parity_sketch(hashed[cut[i] : cut[i + 1]]) for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(prints[rows]), pa.array(size[rows]), empty.take(pa.array(rows)), pa.array(items, pa.binary()), pa.array(sketches, pa.binary())], ["print", "size", "empty", "items", "sketch"])

    rows = docs.join(wanted.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(wanted["wanted_id"])).select("print", "text")
    return rows.mapInArrow(run, "print long, size long, empty array<long>, items binary, sketch binary")


def _stars(pairs: DataFrame, sets: DataFrame, column: str, read, keep) -> DataFrame:
    """The pairs (a, b) of which ``keep`` holds, by what ``read`` makes of (size, ``column``) of their sets.

    The members of a star around ``a`` come as blocks of about ``_STAR_BLOCK``, each behind the
    set of ``a``, which alone is held; every set moves once a star.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, None
        for batch in batches:
            out = []
            for a, name, size, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if a == name:
                    hub, held = a, read(size, raw)
                elif a == hub and keep(held, read(size, raw)):
                    out.append((a, name))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / _STAR_BLOCK).alias("blocks"))
    dealt = pairs.select("a", "b").join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), F.col("b").alias("print"))
    dealt = dealt.unionByName(dealt.select("a", "block", F.col("a").alias("print")).distinct())
    rows = dealt.join(sets.select("print", "size", column), "print").repartition("a", "block").sortWithinPartitions("a", "block", (F.col("print") != F.col("a")))
    return rows.select("a", "print", "size", column).mapInArrow(run, "a long, b long")


def _hopeful(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out: no similar pair is lost, and few others are left."""
    return _stars(pairs, sets, "sketch", read_sketch, lambda x, y: may_be_similar(x, y, num, den))


def _checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by exact intersection."""

    return _stars(pairs, sets, "items", lambda _, raw: read_items(raw), lambda x, y: similar_sets(x, y, num, den))


def tile_links(prints: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) fingerprints that join the sets of a tile as its similar pairs do: at most one row a set."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    place = (np.cumsum(shared) - 1)[column]
    owner, place = owner[shared[column]], place[shared[column]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    inter = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(place, [start, start + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[a:b], place[a:b] - start] = 1
        inter += (has @ has.T).astype(np.int64)
    similar = den * inter >= num * (size[:, None] + size[None, :] - inter)
    label = np.arange(len(sets))
    while True:
        least = np.minimum(np.where(similar, label[None, :], len(sets)).min(axis=1), label)
        least = least[least]
        if (least == label).all():
            break
        label = least
    linked = np.flatnonzero(label != np.arange(len(sets)))
    return prints[label[linked]], prints[linked]


def pair_links(prints: np.ndarray, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) fingerprints that join the sets of a tile as the similar ones of its pairs (i, j) do: fewer rows than sets."""
    top = list(range(len(sets)))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    joined = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        at, to = root(x), root(y)
        if at != to and similar_sets(sets[x], sets[y], num, den):
            top[at] = to
            joined.append((x, y))
    a, b = np.array(joined, np.int64).reshape(-1, 2).T
    return prints[a], prints[b]


def hopeful_pairs(size: np.ndarray, sketches: list[np.ndarray], label: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the sets of a tile in different components that their sketches don't rule out.

    The sketches of similar sets have equally many bins or twice as many, so each length is
    compared with itself and, folded, with the next.
    """
    words = np.array([len(x) for x in sketches])
    out = [np.zeros((0, 2), np.int64)]
    for n in np.unique(words):
        own, longer = np.flatnonzero(words == n), np.flatnonzero(words == 2 * n)
        place = np.concatenate([own, longer])
        bits = np.stack([sketches[i] for i in own] + [sketches[i][:n] ^ sketches[i][n:] for i in longer])
        step = max(1, (1 << 21) // (len(place) * int(n)))
        for lo in range(0, len(own), step):
            rows = own[lo : lo + step]
            apart = np.bitwise_count(bits[lo : lo + len(rows), None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
            near = apart * (den + num) <= (size[rows][:, None] + size[place][None, :]) * (den - num)
            near &= label[rows][:, None] != label[place][None, :]
            near &= np.arange(lo, lo + len(rows))[:, None] < np.arange(len(place))[None, :]
            i, j = np.nonzero(near)
            out.append(np.stack([rows[i], place[j]], axis=1))
    found = np.concatenate(out)
    return found[:, 0], found[:, 1]


def _dealt(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(sig, print, label, low, high): the members (sig, print, label) of each group dealt to tiles of two of its blocks."""
    sizes = sets.select("print", "size")
    blocks = F.ceil(F.greatest(F.count("*") / _BLOCK_SETS, F.sum("size") / _BLOCK_ITEMS)).cast("long")
    groups = rows.join(sizes, "print").groupBy("sig").agg(blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("print"), "blocks")
    dealt = rows.select("sig", "print", "label").join(groups, "sig").select("sig", "print", "label", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return dealt.select("sig", "print", "label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def _sketched(dealt: DataFrame, sets: DataFrame, num: int, den: int, dense: int) -> DataFrame:
    """(sig, low, high, a, b): the pairs of each tile that sketches leave; a tile that leaves more than ``dense`` a member gives one row without a pair."""

    def run(tile: pa.Table) -> pa.Table:
        names, label = tile.column("print").to_numpy(), tile.column("label").to_numpy()
        sketches = [np.frombuffer(x.as_buffer(), U64) for x in tile.column("sketch")]
        i, j = hopeful_pairs(tile.column("size").to_numpy(), sketches, label, num, den)
        a, b = (pa.nulls(1, pa.int64()),) * 2 if len(i) > dense * len(names) else (pa.array(np.minimum(names[i], names[j])), pa.array(np.maximum(names[i], names[j])))
        return pa.table({n: pa.array([tile.column(n)[0].as_py()] * len(a), pa.int64()) for n in ("sig", "low", "high")} | {"a": a, "b": b})

    rows = dealt.join(sets.select("print", "size", "sketch"), "print")
    return rows.groupBy("sig", "low", "high").applyInArrow(run, "sig long, low long, high long, a long, b long")


def _tiled(dealt: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among the members of each tile, fewer than members; no task sees more than two blocks of a group."""

    def run(tile: pa.Table) -> pa.Table:
        names, items = tile.column("print").to_numpy(), [read_items(x) for x in tile.column("items")]
        sketches = [np.frombuffer(x.as_buffer(), U64) for x in tile.column("sketch")]
        i, j = hopeful_pairs(tile.column("size").to_numpy(), sketches, tile.column("label").to_numpy(), num, den)
        a, b = tile_links(names, items, num, den) if len(i) > _WHOLE * len(names) else pair_links(names, items, i, j, num, den)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.join(sets.select("print", "size", "items", "sketch"), "print").groupBy("sig", "low", "high").applyInArrow(run, "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame, member: str, name: str) -> DataFrame:
    own = labels.select(F.col("node").alias(member), F.col("label").alias(name))
    return rows.join(own.hint("shuffle_hash"), member, "left").withColumn(name, F.coalesce(name, member))


class _Join:
    """The state of one join: sets and the labels that the links found so far give."""

    def __init__(self, scratch: Scratch, sets: DataFrame, num: int, den: int):
        self.scratch, self.sets, self.num, self.den = scratch, sets, num, den
        self.labels = scratch.spark.createDataFrame([], "node long, label long")

    def check(self, pairs: DataFrame) -> None:
        """Checks pairs whose sizes and sketches allow it, in so many rounds that none moves more elements than all sets have."""
        sizes = self.sets.select("print", "size")
        for side in "ab":
            pairs = pairs.join(sizes.select(F.col("print").alias(side), F.col("size").alias(f"size_{side}")), side)
        pairs = pairs.filter(self.den * F.least("size_a", "size_b") >= self.num * F.greatest("size_a", "size_b"))
        pairs = self.scratch.settle(_hopeful(pairs.select("a", "b"), self.sets, self.num, self.den))
        moved = pairs.join(sizes.select(F.col("print").alias("b"), "size"), "b").agg(F.sum("size")).first()[0] or 0
        whole = self.sets.agg(F.sum("size")).first()[0] or 1
        rounds = max(1, -(-moved // whole))
        mine = F.pmod(F.xxhash64("b", "a"), F.lit(rounds))
        found = [self.scratch.settle(_checked(pairs.filter(mine == i), self.sets, self.num, self.den)) for i in range(rounds)]
        self.add(reduce(DataFrame.unionByName, found))
        self.scratch.drop(pairs, *found)

    def check_tiles(self, rows: DataFrame) -> None:
        """Checks the groups (sig, print) in tiles: by sketches, then the pairs that are left; tiles with very many of them whole."""
        dealt = self.scratch.settle(_dealt(_labelled(rows, self.labels, "print", "label"), self.sets))
        left = self.scratch.settle(_sketched(dealt, self.sets, self.num, self.den, _DENSE))
        pairs = left.filter("a IS NOT NULL").select("a", "b").distinct()
        if not pairs.isEmpty():
            self.check(pairs)
        dense = left.filter("a IS NULL").select("sig", "low", "high")
        if not dense.isEmpty():
            self.add(_tiled(dealt.join(dense, ["sig", "low", "high"], "left_semi"), self.sets, self.num, self.den))
        self.scratch.drop(dealt, left)

    def add(self, links: DataFrame) -> None:
        found = self.scratch.settle(links)
        if not found.isEmpty():
            self.labels = merged_labels(self.scratch, self.labels, self.pending(found, keep=True))
        self.scratch.drop(found)

    def pending(self, pairs: DataFrame, keep: bool = False) -> DataFrame:
        """Pairs (a, b, ...) whose members are still in different components, with their labels if wanted."""
        rows = _labelled(_labelled(pairs, self.labels, "a", "label_a"), self.labels, "b", "label_b").filter("label_a <> label_b")
        return rows if keep else rows.drop("label_a", "label_b")

    def mixed(self, rows: DataFrame) -> DataFrame:
        """(sig, print, first, label, label_first, members) of the groups whose members are in different components."""
        rows = _labelled(rows.select("sig", "print", "first"), self.labels, "print", "label")
        group = rows.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"), F.min_by("label", "print").alias("label_first"))
        return self.scratch.settle(rows.join(group.filter("low <> high").select("sig", "members", "label_first"), "sig"))


def similar_groups(df: DataFrame, width: int = 4, num: int = 85, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: links are den * |r & s| >= num * |r | s|.

    Shuffled are the signatures (about 0.5 a shingle, in ``_SHARES`` rounds so that less of
    them is on disk at once), the texts once, and the sets of documents that share a
    signature; nothing is collected or broadcast.  Tables are
    deleted when no later step reads them.
    """
    scratch = Scratch(df.sparkSession, "ngram-join")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    digests = scratch.settle(_digests(docs, width))
    shares = [scratch.settle(_shared(_signature_rows(docs, width, num, den, part, _SHARES))) for part in range(_SHARES)]
    shared = reduce(DataFrame.unionByName, shares)
    members = shared.select("print").distinct()
    ids = digests.filter("print IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("wanted_id"))
    sets = scratch.settle(_sets(docs, ids.join(members, "print"), width, num, den))
    join = _Join(scratch, sets, num, den)
    # First every member with the first that it meets most often; then, in large groups that are still mixed, with every other first.
    met = shared.filter("print <> first").groupBy(F.col("first").alias("a"), F.col("print").alias("b")).agg(F.count("*").alias("shared"))
    best = scratch.settle(met.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b"))
    join.check(best)
    rows = join.mixed(shared)
    scratch.drop(*shares)
    stars = scratch.settle(rows.filter((F.col("members") > _FEW) & (F.col("label") != F.col("label_first"))).select(F.col("first").alias("a"), F.col("print").alias("b")).distinct().join(best, ["a", "b"], "left_anti"))
    if not stars.isEmpty():
        join.check(stars)
        before, rows = rows, join.mixed(rows)
        scratch.drop(before)
    _rest(join, rows, best.unionByName(stars))
    scratch.drop(best, stars, rows, sets)
    return _components(digests, join.labels)


def _families(scratch: Scratch, large: DataFrame) -> DataFrame:
    """(sig, print, family) of the members of large groups; groups that share members are of one family if its sets,
    each pair compared once, are fewer pairs than those of its groups; otherwise family is null."""
    links = large.filter("print <> first").select(F.col("first").alias("a"), F.col("print").alias("b"))
    of = connected_components(scratch, links).select(F.col("node").alias("print"), F.col("label").alias("family"))
    rows = scratch.settle(large.select("sig", "print").join(of, "print"))
    prints = rows.select("family", "print").distinct()
    apart = rows.groupBy("family", "sig").agg(F.count("*").cast("double").alias("m")).groupBy("family").agg(F.sum(F.col("m") * F.col("m")).alias("apart"))
    whole = prints.groupBy("family").agg(F.count("*").cast("double").alias("n"))
    chosen = whole.join(apart, "family").filter(F.col("n") * F.col("n") <= F.col("apart")).select("family")
    together = prints.join(chosen, "family").select("print", F.col("family").alias("own"))
    out = scratch.settle(rows.join(together, "print", "left").select("sig", "print", F.col("own").alias("family")))
    scratch.drop(rows)
    return out


def _rest(join: _Join, rows: DataFrame, checked: DataFrame) -> None:
    """Pairs of members that aren't their group's first and are still in different components; ``rows`` as of ``mixed``."""
    if rows.isEmpty():
        return
    scratch = join.scratch
    large = rows.filter(F.col("members") > _FEW)
    families = None
    if not large.isEmpty():
        families = _families(scratch, large)
        together = families.filter("family IS NOT NULL").select(F.col("family").alias("sig"), "print").distinct()
        join.check_tiles(together.unionByName(families.filter("family IS NULL").select("sig", "print")))
    few = _labelled(rows.filter(F.col("members") <= _FEW).select("sig", "print"), join.labels, "print", "label").join(join.sets.select("print", "empty"), "print")
    one, two = (few.select("sig", F.col("print").alias(side), F.col("label").alias(f"label_{side}"), F.col("empty").alias(f"empty_{side}")) for side in "ab")
    # Similar sets of a band of two levels share so many signatures and empty pairs at least.
    enough = (F.count("*") + F.max(F.size(F.array_intersect("empty_a", "empty_b"))) >= _AGREE) | (F.min(F.col("sig").bitwiseAND((1 << _BAND_BITS) - 1)) < Bands(join.num, join.den).deep)
    across = one.join(two, "sig").filter("a < b AND label_a <> label_b").groupBy("a", "b").agg(enough.alias("enough")).filter("enough").select("a", "b")
    across = across.join(checked, ["a", "b"], "left_anti")
    if families is not None:
        met = families.filter("family IS NOT NULL").select("print", "family").distinct()
        for side in "ab":
            across = across.join(met.select(F.col("print").alias(side), F.col("family").alias(f"family_{side}")), side, "left")
        across = across.filter(F.coalesce(F.col("family_a") != F.col("family_b"), F.lit(True))).select("a", "b")
    across = scratch.settle(across)
    if not across.isEmpty():
        join.check(across)
    scratch.drop(across, *([families] if families is not None else []))


def _components(digests: DataFrame, labels: DataFrame) -> DataFrame:
    """The least doc_id of each document's component."""
    prints = digests.filter("print IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("least"))
    linked = prints.join(labels.withColumnRenamed("node", "print"), "print")
    least = linked.groupBy("label").agg(F.min("least").alias("least_linked"))
    linked = linked.select("print", "label").join(least, "label").select("print", "least_linked")
    prints = prints.join(linked, "print", "left").select("print", F.coalesce("least_linked", "least").alias("component_id"))
    rows = digests.join(prints, "print", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
