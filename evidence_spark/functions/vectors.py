"""Hash embeddings and vector rules."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_embed(text: Column, dim: int = 256) -> Column:
    """Normalised sums of signed slots of character bigrams; a text of one character or none is its own bigram."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, tuple[int, float]] = {}

        def slot(gram: str) -> tuple[int, float]:
            if gram not in seen:
                d = hashlib.md5(gram.encode("utf-8", "replace")).digest()
                seen[gram] = int.from_bytes(d[:4], "big") % dim, 1.0 if d[4] % 2 == 0 else -1.0
            return seen[gram]

        for texts in batches:
            rows, made = [t or "" for t in texts], []
            for lo in range(0, len(rows), 512):
                part = rows[lo : lo + 512]
                length = np.array([len(t) for t in part])
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                owner = np.repeat(np.arange(len(part)), length)
                inside = owner[1:] == owner[:-1]
                grams, at = np.unique(((codes[:-1] << 21) | codes[1:])[inside], return_inverse=True)
                told = [slot(chr(g >> 21) + chr(g & 0x1FFFFF)) for g in grams.tolist()]
                place, sign = np.array([s for s, _ in told], np.int64), np.array([w for _, w in told])
                v = np.bincount(owner[:-1][inside] * dim + place[at], sign[at], len(part) * dim).reshape(len(part), dim) if len(at) else np.zeros((len(part), dim))
                for k in np.flatnonzero(length < 2):
                    s, w = slot(part[k])
                    v[k, s] = w
                norm = np.linalg.norm(v, axis=1)
                made += list((v / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32))
            yield pd.Series(made, dtype=object)

    return run(text)


def faults(vector: Column, dim: int) -> Column:
    """Names of the rules that a vector breaks: dimension, finite, zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.array_compact(F.array(
        F.when(F.coalesce(F.size(vector), F.lit(-1)) != dim, "dimension"),
        F.when(~F.coalesce(finite, F.lit(False)), "finite"),
        F.when(~F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False)), "zero"),
    ))


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda z, x: z + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))
