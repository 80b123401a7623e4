"""Quality classifier: logistic regression on hashed word n-grams, scored as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_classes, held_out, mix64, slices, word_hashes
from .ftrl import labelled_sample, train

_KIND = byte_classes(punctuation=True)
BITS = 18
#: Weight of a whole text: each n-gram counts as its share of the text's n-grams times this.
SCALE = 32.0


def _slots(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, slot) of each word and each pair of neighbouring words; runs of punctuation are words of their own.

    A pair of two equal words is one n-gram whatever the word: a repeated word.
    """
    counts, words = word_hashes(texts, _KIND)
    owner = np.repeat(np.arange(len(texts)), counts)
    pairs = owner[1:] == owner[:-1]
    again = words[:-1] == words[1:]
    two = mix64(np.where(again, np.uint64(1), words[:-1] * np.uint64(3) + words[1:]))[pairs] if len(words) else words
    slot = np.concatenate([words, two]) >> np.uint64(64 - bits)
    return np.concatenate([owner, owner[:-1][pairs]]), slot.astype(np.int64)


def _features(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for text in texts:
        _, slot = _slots([text], bits)
        at, n = np.unique(slot, return_counts=True)
        out.append((at, n * (SCALE / max(len(slot), 1))))
    return out


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 12_000, bits: int = BITS) -> np.ndarray:
    """Weights learned from at most about `max_rows` labelled rows (the documented bound), whole texts, none held out."""
    return train(labelled_sample(docs, labels, label, max_rows), lambda t: _features(t, bits), 1 << bits)


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """Adds `score` to every row of docs: the probability of label 1 for its whole text.

    Null and empty texts hold no n-grams and get the intercept's probability. Only the weights, 2^18 + 1
    numbers, are sent to the tasks. Other columns pass through as they are; a column named score is replaced.
    """
    bits = (len(weights) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = sent.value
        for array in texts:
            made = []
            batch = array.to_pylist()
            for lo, hi in slices(batch):
                owner, slot = _slots(batch[lo:hi], bits)
                n = np.bincount(owner, minlength=hi - lo)
                total = np.bincount(owner, w[slot], minlength=hi - lo)
                made.append(1 / (1 + np.exp(-np.clip(w[-1] + SCALE * total / np.maximum(n, 1), -35, 35))))
            yield pa.array(np.concatenate(made) if made else [], pa.float64())

    return docs.withColumn("score", F.arrow_udf(run, "double")(F.col(text_col)))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """docs with held_out, score and predicted (1 where the score is at least `threshold`)."""
    scored = score_quality(docs, train_quality(docs, labels, **options))
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})
