"""Embedding near-duplicates: inverted lists, residual product codes, table-lookup distances, exact cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

#: Rows of one side of a block of pairs.
BLOCK = 256
#: Names of vectors that no id names lie above all ids.
ABOVE = 1 << 62
#: How many standard deviations of a neighbour's offset along one direction the probes reach.
DEVIATIONS = 2.5


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centers**2).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (x[i : i + 4096] @ centers.T - half).argmax(axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centers)
        total = np.zeros_like(centers)
        np.add.at(total, at, x)
        n = np.bincount(at, minlength=len(centers))
        centers[n > 0] = total[n > 0] / n[n > 0, None]
    return centers


class Quantiser:
    """Coarse centres and, for each part of the residual, a code book."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, words: int):
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        d = sample.shape[1]
        parts = next(p for p in range(min(parts, d), 0, -1) if d % p == 0)
        spread = np.linalg.eigvalsh(rest.T @ rest)
        #: in how many directions vectors differ from their centres
        self.dimension = float(spread.sum() ** 2 / max((spread**2).sum(), 1e-300))
        self.books = np.stack([kmeans(np.ascontiguousarray(r), words) for r in np.split(rest, parts, axis=1)])

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the length of what the codes leave out."""
        rest = x - self.coarse[at]
        codes = np.stack([_nearest(r, b) for r, b in zip(np.split(rest, len(self.books), axis=1), self.books, strict=True)], axis=1)
        made = np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(rest - made, axis=1)

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """(codes, queries) squared distances: one table of part distances for each query, summed over the codes; whole rows of tables are read."""
        rest = queries - self.coarse[at]
        out = np.zeros((len(codes), len(queries)))
        for p, (r, b) in enumerate(zip(np.split(rest, len(self.books), axis=1), self.books, strict=True)):
            table = (r**2).sum(axis=1)[None] + (b**2).sum(axis=1)[:, None] - 2 * b @ r.T
            out += table.take(codes[:, p], axis=0)
        return out

    def crosses(self, far: np.ndarray, near: np.ndarray, gap: np.ndarray, reach: float) -> np.ndarray:
        """Whether a point within `reach` can lie nearer to the farther centre: squared distances to both, and their gap."""
        return far - near <= 2 * reach * np.sqrt(np.maximum(gap, 1e-24))

    def probes(self, x: np.ndarray, at: np.ndarray, reach: float) -> list[np.ndarray]:
        """Lists whose cell a point within `reach` of each vector can lie in, but for the home list.

        Of two lists, only one sends its vectors to the other, so a pair of vectors meets once; a list sends to about half of the others.
        """
        own, size = self.coarse[at], (self.coarse**2).sum(axis=1)
        far = (x**2).sum(axis=1)[:, None] + size[None] - 2 * x @ self.coarse.T
        gap = size[at][:, None] + size[None] - 2 * own @ self.coarse.T
        hit = self.crosses(far, far[np.arange(len(x)), at][:, None], gap, reach)
        lists = np.arange(len(self.coarse))[None]
        hit &= (at[:, None] < lists) == ((at[:, None] + lists) % 2 == 0)
        hit[np.arange(len(x)), at] = False
        return [np.flatnonzero(h) for h in hit]


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, mask) of vectors of one length: rows that are null, zero or not finite are masked out."""
    rows = column.to_pylist()
    d = max((len(r) for r in rows if r), default=0)
    out = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        if r is not None and len(r) == d and None not in r:
            out[i] = r
    good = np.isfinite(out).all(axis=1)
    out[~good] = 0
    top = np.abs(out).max(axis=1, initial=0)
    out /= np.where(top > 0, top, 1)[:, None]
    norm = np.sqrt((out**2).sum(axis=1))
    return out / np.where(norm > 0, norm, 1)[:, None], norm > 0


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.95,
    sample_rows: int = 20_000,
    per_list: int = 256,
    max_lists: int = 4096,
    parts: int = 8,
    words: int = 16,
    probe_share: float | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors.

    The quantiser is fitted on about `sample_rows` vectors, chosen by a hash (the documented bound); every vector is
    indexed. Each vector is kept in its list's blocks and sent to the lists that a vector within `probe_share` of the
    threshold's distance can lie in. 1.0 makes the search exact. By default the share is DEVIATIONS / sqrt(d), at most 1, where d is
    the number of directions in which vectors spread around their centres: a neighbour's offset in any one direction has
    about 1 / sqrt(d) of the whole as its standard deviation, so few neighbours lie farther across a list's border. In a
    block, table lookups drop pairs whose distance, less what the code leaves out, is over the threshold (no true pair), and the
    exact cosine decides. Blocks return counts of links and a spanning forest of them, so rows do not grow with the square of
    a group. Equal vectors are searched once, with their number as weight, so copies never meet each other; each copy gets the
    links of all of them and the other copies.
    Null, empty and zero vectors and those that hold nulls or non-finite numbers link with nothing. Vectors of each length are
    indexed by themselves, in jobs of their own. Rows with null ids take part but name no component; an id with several vectors
    takes part with each. A repeated row is one more copy. Ids are below 2^62.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    fit = F.coalesce((F.size("v") > 0) & ~odd, F.lit(False))
    found = rows.filter(fit).groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    found = written(found, "distinct-vectors")
    several = found.groupBy("least_id").agg(F.min(F.xxhash64("v")).alias("first"), F.count(F.lit(1)).alias("n")).filter("least_id is not null and n > 1")
    named = found.join(several.select("least_id", "first"), "least_id", "left")
    other = F.col("least_id").isNull() | F.coalesce(F.col("first") != F.xxhash64("v"), F.lit(False))
    name = F.when(other, F.lit(ABOVE) + F.pmod(F.xxhash64("v"), F.lit(ABOVE - 1))).otherwise(F.col("least_id"))
    good = written(named.select(name.alias("vec_id"), "least_id", "copies", "v"), "vectors")
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("total")).orderBy("d").collect()
    alone = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not sizes:
        return alone
    links = None
    for size in sizes:
        own = good if len(sizes) == 1 else good.filter(F.size("v") == size["d"])
        one = _links(own, size["n"], cosine, sample_rows, per_list, max_lists, parts, words, probe_share)
        links = one if links is None else links.unionByName(one)
    total = sum(size["total"] for size in sizes)
    counts = links.filter("n > 0").groupBy("vec_id").agg(F.sum("n").alias("n"))
    label = connected_components(links.filter("n = 0").select(F.col("vec_id").alias("a"), "b"), "a", "b")
    out = good.join(counts, "vec_id", "left").join(label, good["vec_id"] == label["node"], "left")
    out = out.select("v", "copies", "vec_id", "least_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("comp"))
    # vectors of hashed names count by their ids
    hashed = out.filter(F.col("vec_id") >= ABOVE).groupBy("comp").agg(F.min("least_id").alias("hashed_id"))
    component = F.least(F.when(F.col("comp") < ABOVE, F.col("comp")), F.col("hashed_id"))
    found = written(out.join(hashed, "comp", "left").select("v", "copies", "least_id", "n_links", component.alias("component_id")), "vector-classes")
    single = found.filter("copies = 1").select(F.col("least_id").alias("vec_id"), "n_links", "component_id")
    # fewer than 200 vectors have so many copies; they are broadcast, so that no task gets all rows of one
    many = F.col("copies") > max(1000, total // 200)
    classes = found.filter("copies > 1").drop("least_id")
    hot, rest = F.broadcast(classes.filter(many)), classes.filter(~many)
    shared = rows.filter(fit).join(hot, "v").unionByName(rows.filter(fit).join(rest, "v")).select("vec_id", "n_links", "component_id")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return single.unionByName(shared).withColumn("kept", kept).unionByName(alone)


def _links(good: DataFrame, n: int, cosine: float, sample_rows: int, per_list: int, max_lists: int, parts: int, words: int, probe_share: float | None) -> DataFrame:
    """(vec_id, n, b) for distinct vectors of one length: numbers of links that a block has found (n > 0), and links (n = 0, vec_id to b)."""
    spark = good.sparkSession
    share = int(1_000_000 * min(1.0, sample_rows / n))
    picked = good.filter(F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(1_000_000)) < share).select("v").toArrow()
    if not len(picked):  # so few vectors that a hash may pick none
        picked = good.limit(sample_rows).select("v").toArrow()
    x = _matrix(picked["v"].combine_chunks())[0]
    order = np.lexsort(x.T[:1])
    made = Quantiser(x[order], int(np.clip(n // per_list, 1, max_lists)), parts, words)
    sent = spark.sparkContext.broadcast(made)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    probe_share = min(1.0, DEVIATIONS / max(made.dimension, 1.0) ** 0.5) if probe_share is None else probe_share

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            ids, copies, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))[0]
            for i in range(0, len(x), 512):
                part, own, weight = x[i : i + 512], ids[i : i + 512], copies[i : i + 512]
                home = _nearest(part, q.coarse)
                others = q.probes(part, home, probe_share * reach)
                times = np.array([len(o) for o in others]) + 1
                at = np.concatenate([np.concatenate([[h], o]) for h, o in zip(home, others, strict=True)]).astype(np.int64)
                row = np.repeat(np.arange(len(part)), times)
                first = np.zeros(len(at), bool)
                first[np.cumsum(times) - times] = True
                codes, left_out = q.encode(part, home)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own[row]), pa.array(weight[row]), pa.array(at), pa.array(home[row]), pa.array(first),
                        pa.array([part[r].tobytes() for r in row], pa.binary()),
                        pa.array([codes[r].tobytes() if f else None for r, f in zip(row, first, strict=True)], pa.binary()),
                        pa.array(left_out[row]),
                    ],
                    names=["vec_id", "copies", "list", "home", "own", "v", "codes", "left_out"],
                )

    dealt = written(good.select("vec_id", "copies", "v").mapInArrow(deal, "vec_id long, copies long, list long, home long, own boolean, v binary, codes binary, left_out double"), "lists")
    # members of a list are cut into blocks; every vector sent to it and every member meets each block of members once
    blocks = dealt.filter("own").groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks"))
    cut = dealt.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    probing = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("slices"))
    cut = cut.join(probing, "list").withColumn("slice", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.col("slices")).cast("int"))
    as_member = cut.filter("own").select("list", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("member"), "vec_id", "copies", "home", "v", "codes", "left_out")
    as_query = cut.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "slice", F.lit(False).alias("member"), "vec_id", "copies", "home", "v", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("left_out"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        q, at = sent.value, int(g["list"].iloc[0])
        x = np.frombuffer(b"".join(g["v"]), np.float64).reshape(len(g), -1)
        ids, copies, member, home = (g[c].to_numpy() for c in ("vec_id", "copies", "member", "home"))
        m, s = np.flatnonzero(member), np.flatnonzero(~member)
        if not len(m) or not len(s):
            return pd.DataFrame({"vec_id": [], "n": [], "b": []}).astype("int64")
        codes = np.frombuffer(b"".join(g["codes"].iloc[m]), np.uint8).reshape(len(m), -1)
        left_out = g["left_out"].to_numpy()[m]
        near = q.distances(x[s], at, codes) <= ((reach + 1e-6 + left_out) ** 2)[:, None]
        j, i = np.nonzero(near & (ids[m][:, None] != ids[s][None]))
        keep = np.einsum("ij,ij->i", x[s[i]], x[m[j]]) >= cosine
        i, j = s[i[keep]], m[j[keep]]
        n = np.bincount(i, copies[j], len(g))
        # a pair across lists meets only here, so it counts for its member too
        across = home[i] != at
        n += np.bincount(j[across], copies[i[across]], len(g))
        at_n = np.flatnonzero(n)
        tree = _forest(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]))
        return pd.DataFrame({
            "vec_id": np.concatenate([ids[at_n], tree[0]]),
            "n": np.concatenate([n[at_n].astype(np.int64), np.zeros(len(tree[0]), np.int64)]),
            "b": np.concatenate([ids[at_n], tree[1]]),
        })

    groups = as_member.unionByName(as_query).groupBy("list", "block", "slice")
    return written(groups.applyInPandas(compare, "vec_id long, n long, b long"), "vector-links")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that keep the components of all links given, at most one fewer than there are nodes."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, r = root(x), root(y)
        if p != r:
            up[max(p, r)] = min(p, r)
            kept.append((x, y))
    return (np.array([k[0] for k in kept], np.int64), np.array([k[1] for k in kept], np.int64))
