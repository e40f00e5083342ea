"""Language-model scores by a probabilistic suffix tree over words.

Symbols are the words that occur ``LEAST_COUNT`` times (at most ``HEAD`` of them, the
commonest), classes of all other words by their last three bytes, and the end of a text.
The nodes of the tree are contexts: the last one to ``max_depth`` symbols.  Every context
that occurs ``LEAST_COUNT`` times in the training texts is counted, so their number grows
with the corpus; it is kept if its next-symbol distribution diverges from that of its
longest kept suffix: each of its tokens, left out in turn, must be foretold better from
the others by ``LEAST_GAIN`` nats in the mean.  A kept distribution is smoothed into its suffix's (Witten and Bell), and each token is scored in the state of
the longest kept suffix; a word of a class also takes its smoothed share in the class.
With counts c + 1 at the root and in classes, all probabilities of a state sum to 1.

A token goes, with the symbols before it, to a bucket by the last of them.  So a bucket has all
tokens of its contexts, whatever their depth, and a task grows that part of the tree level by level:
it sorts the tokens by context and next symbol, keeps contexts, and passes each token's
probability on to the context one longer; what is left at the end is that in the longest
kept context.  Tokens that don't learn are carried along, so they are scored on the way.
The states of a hot context (one with more tokens than a bucket should hold) are counted
beforehand as a Spark table, met by their probabilities in the context one shorter, and
sent to the buckets over which its tokens are dealt by the context one longer.
Tokens move once, in rounds of a quarter of the buckets each, so that little of them is on
disk at once; texts are read twice, to count words and to write them as symbols (about
two bytes a token); each round reads these.

Beside it stands the base: the words' own add-one shares.  Word counts cover all
training texts: the commonest words, a bounded number, are handed to every task,
the counts of all others are joined by a shuffle.  Words, contexts and equal texts
are told by 64-bit hashes.

Defined cases: null or empty text is the end alone; repeated rows are scored alike;
without training texts every count is 0; very long texts are read in one task each;
a null ``train`` doesn't learn; extra columns are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Scratch
from .textkit import U64, Texts, chunks, mix64

CLASS_BITS = 8
MAX_DEPTH = 4
LEAST_COUNT = 20
LEAST_GAIN = 0.02
#: Rows of one shuffle: at most this share of all tokens (or so many), the rest follows in further rounds.
ROUND_SHARE, ROUND_ROWS = 1 / 4, 1 << 22
#: So many words at most are handed to every task with their counts; it bounds 8 MB.
HEAD = 1 << 19
#: Bits of a filter of contexts, whatever their number, and tasks that write parts of it.
FILTER_BITS, FILTER_PARTS = 1 << 25, 8
#: A context of more tokens than this, and than this share of all, is dealt over several buckets; so is any of more than ``HOT_MOST``.
#: With a share of all, hot contexts are as many whatever the corpus; the bound is for the memory of a bucket, which has half as many tokens in the mean.
HOT_TOKENS, HOT_SHARE, HOT_MOST = 1 << 16, 1 / 256, 1 << 21
#: Tokens that are dealt to buckets at a time (or one document).
CHUNK_TOKENS = 1 << 20


class Lookup:
    """Places of 64-bit keys in a sorted array, through an index on their top bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys)).bit_length())
        self.first = np.searchsorted(keys >> U64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U64))

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        out = np.full(len(asked), -1, np.int64)
        top = (asked >> U64(64 - self.bits)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == asked[left]
            out[left[hit]] = at[left[hit]]
            at[left] += 1
            left = left[~hit]
            left = left[at[left] < end[left]]
        return out


def word_classes(texts: Texts) -> np.ndarray:
    """A class of each word by its last three bytes."""
    start = np.maximum(texts.word_start, texts.word_end - 3)
    return (texts.range_hash(start, texts.word_end) >> U64(64 - CLASS_BITS)).astype(np.int64)


@dataclass
class Symbols:
    """The head words (sorted hashes, counts) and the symbol of each, or -1; ``words`` of them are symbols."""

    keys: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    words: int

    def __post_init__(self):
        self.find = Lookup(self.keys)

    def __getstate__(self):
        return self.keys, self.counts, self.symbol, self.words

    def __setstate__(self, state):
        self.keys, self.counts, self.symbol, self.words = state
        self.__post_init__()

    @property
    def end(self) -> int:
        return self.words + (1 << CLASS_BITS)

    def read(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the words of some texts: hash, head place or -1, class; for their tokens with ends: symbol, document."""
        hashed, classes = texts.word_hashes(), word_classes(texts)
        place = self.find(hashed)
        own = np.where(place >= 0, self.symbol[np.maximum(place, 0)] if len(self.symbol) else -1, -1)
        own = np.where(own >= 0, own, self.words + classes)
        sizes = texts.n_words + 1
        symbol = np.full(int(sizes.sum()), self.end, np.int64)
        is_word = np.ones(len(symbol), bool)
        is_word[np.cumsum(sizes) - 1] = False
        symbol[is_word] = own
        return hashed, place, classes, symbol, np.repeat(np.arange(texts.n), sizes)


def packed_symbols(symbol: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """Each document's symbols as bytes: all low bytes, all middle bytes, all high bytes."""
    cut = np.searchsorted(doc, np.arange(n + 1))
    raw = symbol.astype("<u4").view(np.uint8).reshape(-1, 4)
    return pa.array([np.ascontiguousarray(raw[a:b, :3].T).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())


def token_chunks(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, symbols, row of each) of packed documents, about ``most`` tokens at a time or one document."""
    parts, held, start = [], 0, 0
    for i in range(len(column) + 1):
        if held and (i == len(column) or held >= most):
            sizes = [len(x) for x in parts]
            yield start, np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
            parts, held, start = [], 0, i
        if i < len(column):
            low, middle, high = np.frombuffer(column[i].as_buffer(), np.uint8).reshape(3, -1).astype(np.int64)
            parts.append(low | (middle << 8) | (high << 16))
            held += len(low)


def extended(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The key of a context with one more symbol behind it; a single symbol is its own key."""
    return mix64(context.astype(U64) * U64(0x9E3779B97F4A7C15) + mix64(symbol.astype(U64) + U64(0x632BE59BD9B4E019)))


def contexts(symbol: np.ndarray, doc: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth from 1: (key of the symbols before each token, whether its document has so many)."""
    out, n = [], len(symbol)
    key = np.zeros(n, U64)
    key[1:] = symbol[:-1].astype(U64)
    for d in range(1, depth + 1):
        inside = np.zeros(n, bool)
        inside[d:] = doc[d:] == doc[: max(n - d, 0)]
        out.append((key, inside))
        longer = np.zeros(n, U64)
        longer[1:] = extended(key[:-1], symbol[:-1])
        key = longer
    return out


class ContextFilter:
    """A Bloom filter of ``FILTER_BITS`` bits over context keys: no key is missed, whatever their number."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    @staticmethod
    def places(keys: np.ndarray) -> list[np.ndarray]:
        mixed = mix64(keys + U64(0x8CB92BA72F3D8DD7))
        return [(mixed >> U64(shift)) & U64(FILTER_BITS - 1) for shift in (0, 19, 39)]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        for place in self.places(keys):
            ok &= (self.packed[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1
        return ok

    @classmethod
    def of(cls, rows: DataFrame, extend: bool = False) -> ContextFilter:
        """Over the column ``ctx`` of some rows, or over (ctx, next) as one longer context; a few megabytes reach the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(FILTER_BITS, bool)
            for batch in batches:
                keys = batch.column(0).to_numpy().view(U64)
                for place in cls.places(extended(keys, batch.column(1).to_numpy()) if extend else keys):
                    bits[place] = True
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)], pa.binary())], ["bits"])

        packed = np.zeros(FILTER_BITS // 8, np.uint8)
        for row in rows.coalesce(FILTER_PARTS).mapInArrow(run, "bits binary").toLocalIterator():
            packed |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        return cls(packed)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, class) over every text of the column ``text``: partial sums in tasks, then one shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, classes = [], [], []
            for a, b in chunks(batch.column(0)):
                t = Texts(batch.column(0).slice(a, b - a))
                key, first, n = np.unique(t.word_hashes(), return_index=True, return_counts=True)
                keys.append(key)
                counts.append(n)
                classes.append(word_classes(t)[first])
            if keys:
                key, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
                n = np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(np.concatenate(classes)[first].astype(np.int32))], ["word", "n", "class"])

    return texts.mapInArrow(run, "word long, n long, class int").groupBy("word").agg(F.sum("n").alias("n"), F.first("class").alias("class"))


def rounds_for(rows: int, tokens: int) -> int:
    return max(1, -(-rows // max(ROUND_ROWS, int(tokens * ROUND_SHARE))))


def smoothed(first: np.ndarray, n: np.ndarray, lower: np.ndarray, least: int, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether contexts occur ``least`` times, and the log10 probability of each of their next symbols in the longest kept context.

    ``n`` are the counts of a context's next symbols (0: asked, not seen), ``lower`` their log10 probabilities in
    its longest kept suffix; a context's symbols stand together, from its place in ``first`` on.
    """
    summed = lambda x: np.add.reduceat(x, first)
    whole, kinds, single = summed(n), summed((n > 0).astype(np.int64)), summed((n == 1).astype(np.int64))
    # What is foretold of a token by the others: n - 1 of them if there are such, else only the state's share for new symbols.
    own, many = np.zeros(len(n)), np.flatnonzero(n > 1)
    own[many] = n[many] * (np.log(n[many] - 1) - lower[many] * np.log(10))
    better = summed(own) + single * np.log(np.maximum(kinds, 1)) - whole * np.log(np.maximum(whole - 1 + kinds, 1))
    frequent = whole >= least
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n))))
    at = np.flatnonzero((frequent & (better >= gain * whole))[of])
    of, out = of[at], lower.copy()
    out[at] = np.log10((n[at] + kinds[of] * 10.0 ** lower[at]) / (whole[of] + kinds[of]))
    return frequent, out


def context_key(symbols: list[np.ndarray]) -> np.ndarray:
    """The key of contexts whose symbols are given, the last one first."""
    key = symbols[-1].astype(U64)
    for symbol in symbols[-2::-1]:
        key = extended(key, symbol)
    return key


@dataclass
class Deal:
    """The bucket of each token: that of its last symbol, or of the symbol before its longest hot context.

    All tokens of one context are in one bucket, but those of a hot one are in ``parts`` of them, by the
    context one longer (or by text where there is none).  ``hot`` has (keys, parts) for each depth, up to the first without any.
    """

    buckets: int
    symbols: int
    hot: list[tuple[np.ndarray, np.ndarray]]

    def __post_init__(self):
        self.own = (mix64(np.arange(self.symbols, dtype=U64)) % U64(self.buckets)).astype(np.int64)
        self.find = []
        for depth, (keys, parts) in enumerate(self.hot):
            order = np.argsort(keys)
            keys, parts = keys[order].astype(U64), parts[order].astype(U64)
            if depth == 0:  # single symbols are their own keys
                places = np.full(self.symbols, -1, np.int64)
                places[keys.astype(np.int64)] = np.arange(len(keys))
                self.find.append((lambda asked, places=places: places[asked.astype(np.int64)], keys, parts))
            else:
                self.find.append((Lookup(keys), keys, parts))

    def __getstate__(self):
        return self.buckets, self.symbols, self.hot

    def __setstate__(self, state):
        self.buckets, self.symbols, self.hot = state
        self.__post_init__()

    def start(self, key: np.ndarray) -> np.ndarray:
        return mix64(key + U64(0x8CB92BA72F3D8DD7))

    def __call__(self, symbol: np.ndarray, at: np.ndarray, have: np.ndarray, name: np.ndarray, max_depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, length of the longest hot context) of the tokens ``at`` with ``have`` symbols before them, one at least, in texts ``name``."""
        bucket, longest = self.own[symbol[at - 1]], np.zeros(len(at), np.int64)
        if not self.find:
            return bucket, longest
        key = symbol[at - 1].astype(U64)
        place = self.find[0][0](key)
        left = np.flatnonzero(place >= 0)
        key, place = key[left], place[left]
        for depth in range(1, max_depth + 1):
            if not len(left):
                break
            _, _, parts = self.find[depth - 1]
            spread = mix64(name[left])
            longer = np.flatnonzero(have[left] > depth) if depth < max_depth else np.zeros(0, np.int64)
            on = np.full(len(left), -1, np.int64)
            if len(longer):
                own = at[left[longer]]
                keys = context_key([symbol[own - j] for j in range(1, depth + 2)])
                spread[longer] = mix64(keys)
                if depth < len(self.find):
                    on[longer] = self.find[depth][0](keys)
            bucket[left] = ((self.start(key) + spread % parts[place]) % U64(self.buckets)).astype(np.int64)
            longest[left] = depth
            follow = on >= 0
            if not follow.any():
                break
            left, place = left[follow], on[follow]
            key = self.find[depth][1][place]
        return bucket, longest

    def model_buckets(self, depth: int, key: int) -> np.ndarray:
        """The buckets that hold tokens of a hot context."""
        find, _, parts = self.find[depth - 1]
        own = np.array([key], np.int64).view(U64)
        # The same sum as for tokens, whose 64 bits may run over.
        return np.unique((self.start(own) + np.arange(int(parts[find(own)[0]]), dtype=U64)) % U64(self.buckets)).astype(np.int64)


def hot_symbols(rows: DataFrame, tokens: int, often: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tokens) of about all symbols with more than ``often`` tokens; a batch tells only of those with an eighth of that share in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, symbol, _ in token_chunks(batch.column(0)):
                n = np.bincount(symbol)
                at = np.flatnonzero(n > len(symbol) * often / tokens / 8)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["symbol", "n"])

    found = rows.select("symbols").mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).filter(F.col("n") > often).toArrow()  # at most tokens / often rows
    return found["symbol"].to_numpy(), found["n"].to_numpy()


def hot_states(scratch: Scratch, rows: DataFrame, log_root, end: int, tokens: int, often: int, max_depth: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[DataFrame]]:
    """The hot contexts (keys, parts) of each depth, and for each depth a table (ctx, next, prob) of all next symbols they meet.

    A level after the other is counted: a counted pair meets one row, its probability in the context one shorter.
    """
    if tokens <= often:
        return [], []
    least, gain = LEAST_COUNT, LEAST_GAIN

    def level(first: bool):
        def run(table: pa.Table) -> pa.Table:
            lower = log_root.value[table["next"].to_numpy()] if first else table["lower"].to_numpy()
            _, prob = smoothed(np.zeros(1, np.int64), table["n"].to_numpy(), lower, least, gain)
            return pa.table([table["ctx"], table["next"], table["m"], pa.array(prob)], ["ctx", "next", "m", "prob"])

        return run

    keys, sizes = hot_symbols(rows, tokens, often)
    keep = keys != end
    keys, sizes = keys[keep].astype(U64), sizes[keep]
    hot, tables = [], []
    sc = scratch.spark.sparkContext
    for depth in range(1, max_depth + 1):
        if not len(keys):
            break
        hot.append((keys, 2 * -(-sizes // often)))
        known = sc.broadcast(np.sort(mix64(keys)))

        def run(batches: Iterator[pa.RecordBatch], depth=depth, known=known) -> Iterator[pa.RecordBatch]:
            find = Lookup(known.value)
            for batch in batches:
                learns = batch.column(1).to_numpy(zero_copy_only=False)
                for start, symbol, doc in token_chunks(batch.column(0), CHUNK_TOKENS):
                    found = contexts(symbol, doc, depth)
                    key, inside = found[-1]
                    at = np.flatnonzero(inside)
                    at = at[find(mix64(key[at])) >= 0]
                    order = at[np.lexsort((symbol[at], key[at]))]
                    key, after = key[order], symbol[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (key[1:] != key[:-1]) | (after[1:] != after[:-1])
                    first = np.flatnonzero(new)
                    if len(first):
                        learnt = np.add.reduceat(learns[start + doc[order]].astype(np.int64), first)
                        below = found[-2][0][order[first]] if depth > 1 else np.zeros(len(first), U64)
                        columns = [key[first].view(np.int64), after[first].astype(np.int32), learnt, np.diff(np.append(first, len(key))), below.view(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["ctx", "next", "n", "m", "below"])

        pairs = rows.select("symbols", "lm_learn").mapInArrow(run, "ctx long, next int, n long, m long, below long")
        pairs = pairs.groupBy("ctx", "next").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.first("below").alias("below"))
        if tables:
            lower = tables[-1].select(F.col("ctx").alias("below"), "next", F.col("prob").alias("lower"))
            pairs = pairs.join(lower, ["below", "next"])
        else:
            pairs = pairs.withColumn("lower", F.lit(0.0))

        # A group has at most as many rows as there are symbols.
        pairs = pairs.select("ctx", "next", "n", "m", "lower").groupBy("ctx").applyInArrow(level(not tables), "ctx long, next int, m long, prob double")
        tables.append(scratch.settle(pairs))
        more = tables[-1].filter((F.col("m") > often) & (F.col("next") != end)).select("ctx", "next", "m").toArrow()  # at most tokens / often rows
        keys, sizes = extended(more["ctx"].to_numpy().view(U64), more["next"].to_numpy()), more["m"].to_numpy()
    return hot, tables


def bucket_scores(max_depth: int, log_root, least: int, gain: float):
    """For ``applyInArrow``: one bucket's tokens (and the states of hot contexts) to (lm_key, more), a row for each run of a text's tokens."""

    def run(table: pa.Table) -> pa.Table:
        held, names, model = [], [], []
        for n, packed, name in zip(table["n"].to_pylist(), table["packed"].to_pylist(), table["names"].to_pylist(), strict=True):
            if n < 0:
                model.append((np.frombuffer(name, U64), np.frombuffer(packed, np.uint8)[: -4 * n].view("<i4"), np.frombuffer(packed, np.uint8)[-4 * n :].view("<f8")))
            else:
                held.append(np.frombuffer(packed, np.uint8).reshape(-1, n))
                names.append(np.frombuffer(name, np.int64))
        if not held:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64())], ["lm_key", "more"])
        raw = np.concatenate(held, axis=1)
        del held
        symbol = [raw[3 * j].astype(np.int64) | (raw[3 * j + 1].astype(np.int64) << 8) | (raw[3 * j + 2].astype(np.int64) << 16) for j in range(max_depth + 1)]
        flags = raw[-1]
        del raw
        after, before = symbol[0], symbol[1:]
        have, longest, learn = flags & 7, (flags >> 3) & 7, (flags >> 6 & 1).astype(np.int64)
        root = log_root.value[after]
        prob = root.copy()
        if model:
            pair = np.concatenate([extended(np.repeat(key, len(s)), s) for key, s, _ in model])
            values, order = np.concatenate([v for _, _, v in model]), np.argsort(pair)
            pair, values = pair[order], values[order]
            for depth in range(1, max_depth + 1):
                at = np.flatnonzero(longest == depth)
                if len(at):
                    asked = extended(context_key([x[at] for x in before[:depth]]), after[at])
                    prob[at] = values[np.searchsorted(pair, asked)]
        left, group = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for depth in range(1, max_depth + 1):
            entering = np.flatnonzero((longest == depth - 1) & (have >= depth))
            if depth == 1:
                fresh = np.zeros(len(entering), np.int64)
            else:
                fresh = np.unique(context_key([x[entering] for x in before[: depth - 1]]), return_inverse=True)[1] if len(entering) else entering
                stay = np.flatnonzero(have[left] >= depth)
                left, group = left[stay], group[stay]
            # Numbers of groups of frequent contexts first, then those of hot ones.
            shift = int(group.max()) + 1 if len(group) else 0
            left, group = np.concatenate([left, entering]), np.concatenate([group, fresh + shift])
            if not len(left):
                continue
            key = (group << 40) | (before[depth - 1][left] << 20) | after[left]
            order = np.argsort(key)
            key, left = key[order], left[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            context = key[first] >> 20
            start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            frequent, found = smoothed(start, np.add.reduceat(learn[left], first), prob[left[first]], least, gain)
            size = np.diff(np.append(first, len(key)))
            prob[left] = np.repeat(found, size)
            of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(first))))
            of = np.repeat(of, size)
            keep = np.flatnonzero(frequent[of])
            left, group = left[keep], (np.cumsum(frequent) - 1)[of[keep]]
        run_of = np.cumsum((flags >> 7).astype(np.int64)) - 1
        names = np.concatenate(names)
        return pa.table([pa.array(names), pa.array(np.bincount(run_of, weights=prob - root, minlength=len(names)))], ["lm_key", "more"])

    return run


def context_scores(scratch: Scratch, rows: DataFrame, log_root: np.ndarray, max_depth: int) -> DataFrame:
    """(lm_key, more): what the kept contexts add to the root's log10 probabilities of the rows (symbols, lm_key, lm_learn, n_tokens) with one key.

    Tokens go to buckets by their contexts; a bucket has all tokens of its contexts, so it counts them, level by
    level, and tells its tokens' probabilities at once.  A few buckets' tokens move at a time.
    """
    sc = scratch.spark.sparkContext
    tokens = rows.agg(F.sum("n_tokens")).first()[0] or 0
    often = min(HOT_MOST, max(HOT_TOKENS, int(tokens * HOT_SHARE)))
    buckets = max(1, -(-2 * tokens // often))
    rounds = min(buckets, rounds_for(tokens, tokens))
    end, root = len(log_root) - 1, sc.broadcast(log_root)
    hot, tables = hot_states(scratch, rows, root, end, tokens, often, max_depth)
    deal = sc.broadcast(Deal(buckets, len(log_root), hot))
    kinds, names = "bucket int, n int, packed binary, names binary", ["bucket", "n", "packed", "names"]

    def asked(share: int):
        return lambda batches: asked_of(share, batches)

    def asked_of(share: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, learns = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for start, symbol, doc in token_chunks(batch.column(0), CHUNK_TOKENS):
                have = np.minimum(np.arange(len(symbol)) - np.searchsorted(doc, np.arange(doc[-1] + 1))[doc], max_depth)
                at = np.flatnonzero(have)
                bucket, longest = deal.value(symbol, at, have[at], every[start + doc[at]].view(U64), max_depth)
                own = np.flatnonzero(bucket % rounds == share)
                if not len(own):
                    continue
                order = own[np.sort((bucket[own] << 32) | np.arange(len(own))) & 0xFFFFFFFF]
                at, bucket, longest = at[order], bucket[order], longest[order]
                of = doc[at]
                new = np.ones(len(at), bool)
                new[1:] = bucket[1:] != bucket[:-1]
                cut = np.append(np.flatnonzero(new), len(at))
                new[1:] |= of[1:] != of[:-1]
                learnt = learns[start + of]
                raw = np.ascontiguousarray(symbol.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T)
                packed = np.concatenate([*(raw[:, np.maximum(at - j, 0)] for j in range(max_depth + 1)), (have[at] | (longest << 3) | (learnt.astype(np.int64) << 6) | (new.astype(np.int64) << 7)).astype(np.uint8)[None]])
                runs = np.flatnonzero(new)
                keys, run_cut = every[start + of[runs]], np.searchsorted(runs, cut)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(np.diff(cut).astype(np.int32)),
                        pa.array([packed[:, a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        pa.array([keys[a:b].tobytes() for a, b in zip(run_cut[:-1], run_cut[1:], strict=True)], pa.binary()),
                    ],
                    names,
                )

    def modelled(depth: int, share: int):
        return lambda batches: modelled_of(depth, share, batches)

    def modelled_of(depth: int, share: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, states = batch.column(0)[row].as_py(), batch.column(1)[row].values
                to = deal.value.model_buckets(depth, key)
                to = to[to % rounds == share]
                if len(to):
                    packed = states.field("next").to_numpy().astype("<i4").tobytes() + states.field("prob").to_numpy().astype("<f8").tobytes()
                    for bucket in to:
                        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([-len(states)], pa.int32()), pa.array([packed], pa.binary()), pa.array([np.int64(key).tobytes()], pa.binary())], names)

    states = [t.groupBy("ctx").agg(F.collect_list(F.struct("next", "prob")).alias("states")) for t in tables]
    states = [scratch.settle(s) for s in states]
    found = []
    for share in range(rounds):
        parts = [rows.select("symbols", "lm_key", "lm_learn").mapInArrow(asked(share), kinds)]
        parts += [s.mapInArrow(modelled(depth, share), kinds) for depth, s in enumerate(states, 1)]
        scored = reduce(DataFrame.unionByName, parts).groupBy("bucket").applyInArrow(bucket_scores(max_depth, root, LEAST_COUNT, LEAST_GAIN), "lm_key long, more double")
        found.append(scratch.settle(scored.groupBy("lm_key").agg(F.sum("more").alias("more"))))
    scratch.drop(*tables, *states)
    return reduce(DataFrame.unionByName, found).groupBy("lm_key").agg(F.sum("more").alias("more"))


def head_words(vocabulary: DataFrame) -> pa.Table:
    """At most HEAD words (word, n, class) that no other word exceeds in count, and their share of all."""
    level = F.floor(F.log2("n") * 64).cast("int")
    levels = sorted(((r["level"], r["words"]) for r in vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, held = None, 0
    for at, words in levels:
        if held + words > HEAD:
            break
        least, held = at, held + words
    return vocabulary.filter(level >= F.lit(least) if least is not None else F.lit(False)).toArrow()


def suffix_tree_scores(docs: DataFrame, train: str, keep: list[str], text: str = "text", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Scores every whole text, learning from the rows where the boolean column ``train`` holds.

    Returns the columns ``keep`` and n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-tree")
    learn = docs.filter(F.col(train)).select(F.coalesce(text, F.lit("")).alias("text"))
    vocabulary = scratch.settle(word_counts(learn))
    ends = learn.count()
    head = head_words(vocabulary)
    key, n, of = head["word"].to_numpy().view(U64), head["n"].to_numpy(), head["class"].to_numpy().astype(np.int64)
    order = np.argsort(key)
    key, n, of = key[order], n[order], of[order]
    symbol = np.full(len(key), -1, np.int64)
    common = np.lexsort((key, -n))[: int((n >= LEAST_COUNT).sum())]
    symbol[common] = np.arange(len(common))
    class_n, class_words = np.zeros(1 << CLASS_BITS, np.int64), np.zeros(1 << CLASS_BITS, np.int64)
    for row in vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        class_n[row["class"]], class_words[row["class"]] = row["n"], row["words"]
    tokens = int(class_n.sum()) + ends
    distinct = int(class_words.sum()) + (ends > 0)
    np.subtract.at(class_n, of[common], n[common])
    np.subtract.at(class_words, of[common], 1)
    unigrams = np.concatenate([n[common], class_n, [ends]])
    log_root = np.log10((unigrams + 1) / (unigrams.sum() + len(unigrams)))

    symbols = spark.sparkContext.broadcast(Symbols(key, n, symbol, len(common)))
    base_whole = np.log10(tokens + distinct + 1)
    class_whole = np.log10(class_n + class_words + 1)
    end_base, end_root = np.log10(ends + 1) - base_whole, log_root[-1]
    kept_fields = [f for f in docs.select(*keep).schema.fields]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept_fields)
    partial = f"{kinds}lm_key long, n_tokens long, n_known long, base_score double, score double, lm_learn boolean, symbols binary, rare array<struct<word: long, n: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_symbols = symbols.value
        head_log = np.log10(known_symbols.counts + 1)
        for batch in batches:
            column = batch.columns[-1]
            for a, b in chunks(column):
                texts = Texts(column.slice(a, b - a))
                hashed, place, classes, of_token, doc = known_symbols.read(texts)
                head, of = place >= 0, texts.word_doc
                own = of_token[of_token != known_symbols.end]
                count_log = np.where(head, head_log[np.maximum(place, 0)] if len(head_log) else 0.0, 0.0)
                base = np.bincount(of, weights=count_log - base_whole, minlength=texts.n) + end_base
                in_class = own >= known_symbols.words
                score = np.bincount(of, weights=log_root[own] + np.where(in_class, count_log - class_whole[classes], 0.0), minlength=texts.n) + end_root
                known = np.bincount(of[head], minlength=texts.n) + int(ends > 0)
                # Words beyond the head: their counts come by a join, here only their places in the sums are kept.
                rare = np.flatnonzero(~head)
                order = rare[np.lexsort((hashed[rare], of[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (of[order][1:] != of[order][:-1]) | (hashed[order][1:] != hashed[order][:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(order))).astype(np.int32)
                offsets = np.searchsorted(of[order][at], np.arange(texts.n + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(hashed[order][at].view(np.int64)), pa.array(times)], ["word", "n"])
                name = texts.range_hash(texts.starts, texts.ends).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(a, b - a) for c in batch.columns[:-2]], pa.array(name), pa.array(texts.n_words + 1), pa.array(known), pa.array(base), pa.array(score), batch.columns[-2].slice(a, b - a), packed_symbols(of_token, doc, texts.n), pa.ListArray.from_arrays(pa.array(offsets), pairs)],
                    [*keep, "lm_key", "n_tokens", "n_known", "base_score", "score", "lm_learn", "symbols", "rare"],
                )

    texts = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(train, F.lit(False)).alias("lm_learn"), F.coalesce(text, F.lit("")).alias("lm_text"))
    rows = scratch.settle(texts.mapInArrow(run, partial))
    # Sums are by text: those of equal texts are divided by their number.
    counts = vocabulary.select("word", F.col("n").alias("count"))
    rare = rows.select("lm_key", F.inline("rare")).withColumnRenamed("n", "times").join(counts.hint("merge"), "word")
    rare = rare.groupBy("lm_key").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("count") + 1)).alias("add"))
    sums = scratch.settle(context_scores(scratch, rows, log_root, max_depth))
    copies = rows.groupBy("lm_key").agg(F.count("*").alias("copies")).join(rare, "lm_key", "left").join(sums, "lm_key", "left")
    copies = copies.select("lm_key", *[(F.coalesce(c, F.lit(0)) / F.col("copies")).alias(c) for c in ("known", "add", "more")])
    out = rows.drop("rare", "symbols", "lm_learn").join(copies, "lm_key").select(
        *[F.col(f"`{c}`") for c in keep],
        "n_tokens",
        (F.col("n_known") + F.col("known").cast("long")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("add")).alias("base_score"),
        (F.col("score") + F.col("add") + F.col("more")).alias("score"),
    )
    return out
