"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed to learned vectors; a document is the average
of its vectors; a softmax layer gives the class.  Besides word vectors there is
one for a word that repeats the word before it and one for a word that doesn't,
so that stuttering text can be told.  Trained by plain stochastic gradient
descent in numpy on a bounded sample; as everything after training is linear up
to the softmax, each vector is then folded into the one number it adds.

Defined cases: null or empty text scores what training leaves for a text without features; a sample with one class
only gives that class's prior; repeated rows score alike; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .labelled import class_shares, gram_buckets, labelled_sample, scored
from .session import fresh
from .textkit import U64, Texts, chunks

BITS = 18
GRAMS = (3, 4)
DIMS = 8
EPOCHS = 6
RATE = 0.3
#: The bound of the training sample: so many labelled texts of each class at most.
PER_CLASS = 1000
#: Training looks at so many bytes at a time, to keep the driver small.
TRAIN_CHUNK = 1 << 18


def feature_groups(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of each feature, in three or more groups."""
    words = texts.word_hashes()
    same = np.zeros(len(words), np.int64)
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (texts.word_doc[1:] == texts.word_doc[:-1])
    out = [(texts.word_doc, (words >> U64(64 - BITS)).astype(np.int64)), (texts.word_doc, (1 << BITS) + same)]
    for size in GRAMS:
        place, bucket = gram_buckets(texts, size, BITS)
        out.append((np.searchsorted(texts.ends, place, side="right"), bucket))
    return out


def _bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their shares) of each text."""
    bags = []
    for a, b in chunks(column, TRAIN_CHUNK):
        texts = Texts(column.slice(a, b - a), lower=False)
        groups = feature_groups(texts)
        doc, bucket = np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups])
        order = np.argsort(doc, kind="stable")
        cut = np.searchsorted(doc[order], np.arange(texts.n + 1))
        for i in range(texts.n):
            ids, counts = np.unique(bucket[order[cut[i] : cut[i + 1]]], return_counts=True)
            bags.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    return bags


@dataclass
class QualityModel:
    """weights[b]: what bucket b adds to the log odds; bias: of a text without features."""

    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for a, b in chunks(column):
            texts = Texts(column.slice(a, b - a), lower=False)
            total, count = np.zeros(texts.n), np.zeros(texts.n)
            for doc, bucket in feature_groups(texts):
                total += np.bincount(doc, weights=self.weights[bucket], minlength=texts.n)
                count += np.bincount(doc, minlength=texts.n)
            out[a:b] = total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def train(sample: pa.Table, prior: float, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent over single documents, rate falling to 0.

    ``prior`` is the share of label 1 among all rows that may be learnt from; the
    sample has its own share, so the bias is moved by the difference of log odds.
    """
    rng = np.random.default_rng(seed)
    label = sample["label"].to_numpy().astype(np.int64)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, ((1 << BITS) + 2, DIMS)).astype(np.float32)
    out, bias = np.zeros((2, DIMS), np.float32), np.zeros(2, np.float32)
    own = (label.sum() + 1) / (len(label) + 2)
    if 0 < label.sum() < len(label):
        bags = _bags(sample["text"].combine_chunks())
        step, steps = 0, EPOCHS * len(bags)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(bags)):
                rate = RATE * (1 - step / steps)
                step += 1
                ids, share = bags[i]
                if not len(ids):
                    continue
                rows = vectors[ids]
                hidden = share @ rows
                z = out @ hidden + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label[i]] -= 1
                back = p @ out
                out -= rate * np.outer(p, hidden)
                bias -= rate * p
                # Shares are tiny, so vectors take a step as if each document were a few dozen features.
                vectors[ids] = rows - (30 * rate) * share[:, None] * back[None, :]
        weights = vectors @ (out[1] - out[0])
        shift = float(bias[1] - bias[0]) + np.log(prior / (1 - prior)) - np.log(own / (1 - own))
        return QualityModel(weights.astype(np.float32), float(shift))
    return QualityModel(np.zeros((1 << BITS) + 2, np.float32), float(np.log(prior / (1 - prior))))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """A model from at most ``per_class`` labelled texts of each class."""
    return train(labelled_sample(docs, labels, label, learn, per_class), class_shares(labels, label, learn))


def score(df: DataFrame, model: QualityModel, text: str = "text", name: str = "score", keep_text: bool = False) -> DataFrame:
    """``df`` with the probability of label 1, without the text unless it is to be kept; a narrow map.

    The model is one number a bucket (1 MB whatever the corpus) and is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    return scored(df, text, fresh(df.drop(text), name), lambda column: shared.value.score(column), keep_text)
