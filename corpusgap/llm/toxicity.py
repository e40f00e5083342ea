"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios.

A document's features are the character n-grams that occur in it (once each, ASCII
letters lowered).  Each is scaled by the log ratio of its smoothed share among
toxic and among other training documents, and a logistic regression is fitted on
the scaled features.  N-grams that hardly separate the classes are dropped, so a
long clean document collects no weight by its length.

Defined cases: null or empty text scores the bias; a sample with one class only
gives that class's prior; repeated rows score alike; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .labelled import class_shares, gram_buckets, labelled_sample, scored
from .session import fresh
from .textkit import Texts, chunks

BITS = 20
GRAMS = (4, 5, 6)
EPOCHS = 12
RATE = 0.05
DECAY = 1e-4
#: An n-gram counts if it occurs in so many training documents, and its log ratio is so far from 0.
LEAST_DOCUMENTS, LEAST_RATIO = 6, 1.5
#: The bound of the training sample: so many labelled texts of each class at most.
PER_CLASS = 2000


def _buckets(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    return [gram_buckets(texts, size, BITS) for size in GRAMS]


@dataclass
class ToxicityModel:
    """weights[b]: ratio times fitted weight of n-gram bucket b, mostly 0."""

    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for a, b in chunks(column):
            texts = Texts(column.slice(a, b - a))
            seen = []
            for place, bucket in _buckets(texts):
                telling = np.flatnonzero(self.weights[bucket])
                doc = np.searchsorted(texts.ends, place[telling], side="right")
                seen.append((doc << BITS) | bucket[telling])
            seen = np.unique(np.concatenate(seen))
            out[a:b] += np.bincount(seen >> BITS, weights=self.weights[seen & ((1 << BITS) - 1)], minlength=texts.n)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


#: Training looks at so many bytes at a time, to keep the driver small.
TRAIN_CHUNK = 1 << 18


def _bags(column: pa.Array, telling: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Distinct buckets of each text, or those of them that are telling."""
    for a, b in chunks(column, TRAIN_CHUNK):
        texts = Texts(column.slice(a, b - a))
        keys = []
        for place, bucket in _buckets(texts):
            if telling is not None:
                kept = telling[bucket]
                place, bucket = place[kept], bucket[kept]
            keys.append((np.searchsorted(texts.ends, place, side="right") << BITS) | bucket)
        seen = np.unique(np.concatenate(keys))
        cut = np.searchsorted(seen >> BITS, np.arange(texts.n + 1))
        for i in range(texts.n):
            yield (seen[cut[i] : cut[i + 1]] & ((1 << BITS) - 1)).astype(np.int32)


def train(sample: pa.Table, prior: float, seed: int = 7) -> ToxicityModel:
    """Naive Bayes ratios, then logistic regression by stochastic gradient descent."""
    label = sample["label"].to_numpy().astype(np.int64)
    ones = int(label.sum())
    flat = ToxicityModel(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))
    if not 0 < ones < len(label):
        return flat
    column = sample["text"].combine_chunks()
    count = np.zeros((2, 1 << BITS))
    for bag, y in zip(_bags(column), label, strict=True):
        count[y, bag] += 1
    ratio = np.log((count[1] + 1) / (ones + 2)) - np.log((count[0] + 1) / (len(label) - ones + 2))
    ratio[(count.sum(axis=0) < LEAST_DOCUMENTS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    bags = list(_bags(column, ratio != 0))
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(1 << BITS), 0.0
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 5)
        for i in rng.permutation(len(bags)):
            bag = bags[i]
            z = bias + float(weights[bag] @ ratio[bag])
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[i]
            weights[bag] -= rate * (g * ratio[bag] + DECAY * weights[bag])
            bias -= rate * g
    own = (ones + 1) / (len(label) + 2)
    shift = bias + np.log(prior / (1 - prior)) - np.log(own / (1 - own))
    return ToxicityModel((weights * ratio).astype(np.float32), float(shift))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    """A model from at most ``per_class`` labelled texts of each class."""
    return train(labelled_sample(docs, labels, label, learn, per_class), class_shares(labels, label, learn))


def score(df: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score", keep_text: bool = False) -> DataFrame:
    """``df`` with the probability of label 1, without the text unless it is to be kept; a narrow map.

    The model is one number a bucket (4 MB whatever the corpus) and is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    return scored(df, text, fresh(df.drop(text), name), lambda column: shared.value.score(column), keep_text)
