"""Hard-negative mining: exact integer inner products of anchor and candidate tiles, kept as bounded heaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

#: Components of the candidates of one tile, and anchors and candidates at most.
TILE, ANCHORS, CANDIDATES = 1 << 21, 2048, 4096
LOW, HIGH = -(2**63), 2**63 - 1


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 32) -> np.ndarray:
    """The matrix product of two integer matrices: seven products of halves instead of eight, odd sides padded by zeros.

    Only ring operations are used, so 64-bit sums that wrap on the way still end right if the product itself fits.
    """
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    if n % 2 or k % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
    if k % 2 or m % 2:
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), p1.dtype)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two int64 matrices; where one may leave the range of a long, by Python's integers, held at its ends."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    largest = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    if width * largest[0] * largest[1] <= HIGH:
        return strassen(a, b.T)
    exact = strassen(a.astype(object), b.T.astype(object))
    return np.clip(exact, LOW, HIGH).astype(np.int64)


def _matrix(lists: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows, short ones filled up with zeros."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(ends)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


class _Side:
    """One side of a cell in the order of (vec_id, tag), repeated rows once."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        ids, tags = (table[c].to_numpy() for c in ("vec_id", "tag"))
        order = np.lexsort((tags, ids))
        if len(order):
            order = order[np.concatenate([[True], np.diff(ids[order]) != 0]) | np.concatenate([[True], np.diff(tags[order]) != 0])]
        self.ids, self.tags, self.labels = ids[order], tags[order], table["label"].to_numpy()[order]
        self.table = table.take(pa.array(order)).combine_chunks()
        self.vectors = _matrix(self.table["v"].chunk(0)) if len(order) else np.zeros((0, 0), np.int64)


def heaps(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k highest allowed scores of each row, in that order; of equal scores the first columns."""
    width = scores.shape[1]
    keep = allowed
    if width > k:
        held = np.where(allowed, scores, LOW)
        keep = allowed & (held >= np.partition(held, width - k, axis=1)[:, width - k][:, None])
    rows, columns = np.nonzero(keep)
    order = np.lexsort((columns, ~scores[rows, columns], rows))  # ~x falls as x rises, without leaving the range
    rows, columns = rows[order], columns[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], columns[first]


def _cells(rows: DataFrame, anchors: DataFrame, compare, schema: str, *keys: str) -> DataFrame:
    """Compares each anchor part with each candidate part: a cell holds at most about ANCHORS x CANDIDATES rows, whatever the key.

    Both sides have `across` and `down`, the numbers of anchor and candidate parts. A row is sent once for each ANCHORS anchors that it
    is compared with, which is what a given set of queries against all rows needs.
    """

    def part(salt: int, count: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "vec_id", "tag"), F.col(count)).cast("int")

    def all_of(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = anchors.withColumn("a", part(1, "across")).withColumn("c", all_of("down")).drop("across", "down")
    right = rows.withColumn("c", part(2, "down")).withColumn("a", all_of("across")).drop("across", "down")
    both = left.withColumn("anchor", F.lit(True)).unionByName(right.withColumn("anchor", F.lit(False)), allowMissingColumns=True)

    def sides(cell: pa.Table) -> pa.Table:
        return compare(_Side(cell.filter(cell["anchor"])), _Side(cell.filter(pc.invert(cell["anchor"]))))

    return both.groupBy(*keys, "a", "c").applyInArrow(sides, schema)


def mine_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Anchors are the rows whose id is divisible by `every`. A score is the exact inner product of the components floor(scale * x); higher
    ones come first, ties by smaller id. An anchor's positives are its first `positives` other rows of its label; the negatives of a positive
    are the first `negatives` rows of other labels whose score is from low to high percent of the positive's.

    Two passes over cells of bounded size. Anchors meet their own label's rows for the heaps of positives, labels split into
    parts by their counts; then all rows for the heaps of windows. A cell multiplies its tiles by Strassen's recursion and keeps heaps
    of k rows for each anchor; heaps of all cells are merged by a window that keeps k of each task before it shuffles.
    Broadcast by hand: nothing. To the driver: two counts and the longest vector's length.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Components beyond the range of a long are held at
    its ends, and so are scores. Short vectors count as filled up with zeros. Rows equal in id, label and vector count once; rows of one
    id that differ elsewhere each take part, in the order of a hash. An anchor without positives, or a positive without
    negatives, gives no rows; an empty table gives none. Further columns are ignored.
    """
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    items = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"),
    )
    items = items.withColumn("tag", F.xxhash64("label", "v"))
    asked = F.col("vec_id") % every == 0
    counts = items.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("asked"), F.max(F.size("v")).alias("width"))
    counts = written(counts, "labels")
    total = counts.agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"), F.max("width").alias("width")).first()
    tall = max(256, min(CANDIDATES, TILE // max(total["width"] or 1, 1)))
    wide = min(ANCHORS, tall)

    def parts(n: Column, size: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / size)).cast("int")

    # first pass: positives, within each label
    sized = items.join(counts.filter("asked > 0").select("label", parts(F.col("asked"), wide).alias("across"), parts(F.col("n"), tall).alias("down")), "label")
    schema = "anchor_id long, anchor_tag long, positive_id long, positive_tag long, score long"

    def nearest(a: _Side, c: _Side) -> pa.Table:
        s = products(a.vectors, c.vectors)
        rows, cols = heaps(s, (a.ids[:, None] != c.ids[None]) | (a.tags[:, None] != c.tags[None]), positives)
        return pa.table([a.ids[rows], a.tags[rows], c.ids[cols], c.tags[cols], s[rows, cols]], names=["anchor_id", "anchor_tag", "positive_id", "positive_tag", "score"])

    found = _cells(sized, sized.filter(asked), nearest, schema, "label")
    best = Window.partitionBy("anchor_id", "anchor_tag").orderBy(F.desc("score"), "positive_id", "positive_tag")
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    pairs = found.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_tag").alias("tag")).agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("p")
    )
    pairs = pairs.select("vec_id", "tag", F.transform("p", lambda x: x["positive_id"]).alias("positive_ids"), F.transform("p", lambda x: x["score"]).alias("scores"))
    # second pass: windows, against all rows
    grid = {"across": parts(F.lit(total["asked"] or 0), wide), "down": parts(F.lit(total["n"] or 0), tall)}
    anchors = written(items.filter(asked).join(pairs, ["vec_id", "tag"]), "anchors").withColumns(grid)
    columns = ["anchor_id", "anchor_tag", "place", "positive_id", "positive_score", "negative_id", "negative_tag", "negative_score"]
    empty = pa.schema([(name, pa.int64()) for name in columns]).empty_table()

    def windows(a: _Side, c: _Side) -> pa.Table:
        s = products(a.vectors, c.vectors)
        unlike = a.labels[:, None] != c.labels[None]
        names, scores = (a.table[x].to_pylist() for x in ("positive_ids", "scores"))
        out = []
        for j in range(max(map(len, scores), default=0)):
            at = np.array([i for i, own in enumerate(scores) if len(own) > j])
            own = [scores[i][j] for i in at]
            # low * own <= 100 * s <= high * own in whole numbers
            least = np.array([min(-(-low * x // 100), HIGH) for x in own], np.int64)[:, None]
            most = np.array([max(high * x // 100, LOW) for x in own], np.int64)[:, None]
            rows, cols = heaps(s[at], unlike[at] & (s[at] >= least) & (s[at] <= most), negatives)
            who = at[rows]
            out.append(pa.table([
                a.ids[who], a.tags[who], np.full(len(who), j), np.array([names[i][j] for i in who], np.int64), np.array(own, np.int64)[rows],
                c.ids[cols], c.tags[cols], s[who, cols],
            ], names=columns))
        return pa.concat_tables(out) if out else empty

    mined = _cells(items.withColumns(grid), anchors, windows, ", ".join(f"{name} long" for name in columns))
    best = Window.partitionBy("anchor_id", "anchor_tag", "place").orderBy(F.desc("negative_score"), "negative_id", "negative_tag")
    mined = mined.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return mined.select("anchor_id", "positive_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "negative_id", "positive_score", "negative_score")
