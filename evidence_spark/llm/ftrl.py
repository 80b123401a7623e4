"""Logistic regression on hashed features, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, written


class Ftrl:
    """FTRL-proximal with per-coordinate rates (McMahan et al., 2013). The last weight is the intercept."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n, self.w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def step(self, slots: np.ndarray, values: np.ndarray, label: float, weight: float = 1.0) -> None:
        p = 1 / (1 + np.exp(-np.clip(self.w[slots] @ values, -35, 35)))
        g = weight * (p - label) * values
        n = self.n[slots]
        more = n + g * g
        self.z[slots] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * self.w[slots]
        self.n[slots] = more
        z = self.z[slots]
        bias = slots == len(self.w) - 1
        free = np.abs(z) - np.where(bias, 0.0, self.l1)
        self.w[slots] = np.where(free <= 0, 0.0, -np.sign(z) * free / ((self.beta + np.sqrt(more)) / self.alpha + self.l2))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y, _shard): about `max_rows` labelled rows at most, none of them held out, chosen by a hash of the id.

    Only the ids and labels of the sample are broadcast: about `max_rows` rows, whatever the input.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))
    )
    n = known.count()
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(n, 1))))
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")


def train(
    sample: DataFrame,
    features: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]],
    size: int,
    shard_rows: int = 3_000,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.5,
    l2: float = 0.0,
    positive: float = 1.0,
) -> np.ndarray:
    """Weights and, last, the intercept. The sample is dealt to a task for each `shard_rows` rows; their models are averaged.

    What comes to the driver is one sum for each non-zero weight: `size` + 1 numbers at most. Rows are visited
    in the order of a hash of their id, so reruns agree; rows of label 1 count `positive` times. An empty sample gives weights of 0.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_order", kind="stable")
        made = features([t or "" for t in rows["text"]])
        model = Ftrl(size, alpha, beta, l1, l2)
        for _ in range(epochs):
            for (slots, values), y in zip(made, rows["y"], strict=True):
                model.step(np.append(slots, size), np.append(values, 1.0), float(y), positive if y else 1.0)
        at = np.flatnonzero(model.w)
        return pd.DataFrame({"slot": at.astype(np.int64), "w": model.w[at]})

    sample = written(sample, "labelled")
    shards = max(1, round(sample.count() / shard_rows))
    dealt = sample.select(
        "text", "y", F.xxhash64(F.lit(7), "_id").alias("_order"), F.pmod(F.xxhash64(F.lit(9), "_id"), F.lit(shards)).alias("_shard")
    )
    sums = dealt.groupBy("_shard").applyInPandas(fit, "slot long, w double").groupBy("slot").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    out = np.zeros(size + 1)
    rows = sums.toPandas()
    out[rows["slot"].to_numpy(int)] = rows["w"].to_numpy(float) / shards
    return out
