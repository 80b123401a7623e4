"""Contiguous shards of nearly equal bytes, by global prefix sums from per-partition totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def with_prefix(df: DataFrame, order: list, sums: dict[str, str], name: str, parts: int | None = None) -> DataFrame:
    """Adds, for each name -> column of `sums`, the sum over all rows before this one in the global order.

    `_rank` is the row's place from 0. Rows are dealt out by ranges of the whole order, so equal keys
    do not meet in one task unless the rows are equal in every order column. Each range sums its own rows;
    only one total per range is summed in order and joined back. The range number is written with
    the rows, so a task that runs again cannot deal rows out anew.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_rank", F.count(F.lit(1)).over(before))
    for out, col in sums.items():
        local = local.withColumn(out, F.coalesce(F.sum(col).over(before), F.lit(0).cast("long")))
    local = written(local, name)
    totals = local.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(col).alias(f"_t_{out}") for out, col in sums.items()]
    )
    # one row per range, so the window below holds no more rows than there are partitions
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        F.col("_part"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{out}").over(earlier), F.lit(0)).alias(f"_s_{out}") for out in sums],
    )
    return (
        local.join(F.broadcast(shift), "_part")
        .withColumn("_rank", F.col("_rank") + F.col("_n0"))
        .withColumns({out: F.col(out) + F.col(f"_s_{out}") for out in sums})
        .drop("_part", "_n0", *[f"_s_{out}" for out in sums])
    )


def shard_by_bytes(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", whole_share: float = 0.01
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): contiguous shards cut at equal byte targets.

    Size is the UTF-8 bytes of the text plus 1; a null text counts as empty. Rows are ordered by the
    hash of their text, then id, so equal texts stand together; a cut that falls into a group of
    equal texts moves to the group's start if the group is smaller than `whole_share` of a
    shard, and else splits it, so that a hot group cannot unbalance the shards. Null ids come first; equal rows
    keep separate slots. An empty table gives no rows. Only the id, size and hashes are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
    )
    placed = with_prefix(rows, ["_text", "doc_id", "text_crc32"], {"_start": "size"}, "shard-sizes")
    total = placed.agg(F.sum("size")).first()[0]
    if total is None:
        return placed.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    targets = [total * k // shards for k in range(1, shards)]
    hit = reduce(lambda x, y: x | y, [(F.col("_start") <= t) & (F.col("_start") + F.col("size") > t) for t in targets], F.lit(False))
    crossing = placed.filter(hit).select("_text").distinct()  # a row at most for each cut
    groups = (
        placed.join(F.broadcast(crossing), "_text", "left_semi")
        .groupBy("_text")
        .agg(F.min("_start").alias("lo"), F.max(F.col("_start") + F.col("size")).alias("hi"))
        .collect()
    )
    cuts = []
    for t in targets:
        lo, hi = next(((g.lo, g.hi) for g in groups if g.lo <= t < g.hi), (t, t))
        cuts.append(lo if hi - lo <= whole_share * total / shards else t)
    shard = reduce(lambda x, y: x + y, [(F.col("_start") >= c).cast("int") for c in cuts], F.lit(0))
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot")
    )
