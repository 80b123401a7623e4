"""Comparisons of chunkers and of retrieval policies over the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions import chunks
from evidence_spark.operators import sections
from evidence_spark.operators.evaluation import anchor_coverage


def aligned(text: Column, pieces: Column) -> Column:
    """Array of the places (from 0) of pieces in their text, each sought behind the start of the one before; null where a piece isn't found."""
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))

    def place(z: Column, piece: Column) -> Column:
        found = F.position(piece, text, z["next"])
        return F.struct(F.when(found > 0, found + 1).otherwise(z["next"]).alias("next"), F.array_append(z["at"], F.when(found > 0, found - 1)).alias("at"))

    return F.aggregate(pieces, start, place)["at"]


def compare_chunkers(docs: DataFrame, size: int = 600, overlap: int = 60, parent: int = 1800) -> DataFrame:
    """(policy, chunks, max_chars, located): flat and structured chunks of the same blocks, how long they get and how many have a place.

    `docs`: doc_id (a row for each), blocks (array of block_no, kind, level, text, page). Documents without blocks have no chunks.
    """
    flat = docs.select("doc_id", F.explode("blocks").alias("b")).select(F.col("b.text").alias("t"), chunks.chunk_flat(F.col("b.text"), size, overlap).alias("pieces"))
    flat = flat.select(F.explode(F.arrays_zip("pieces", aligned(F.col("t"), F.col("pieces")).alias("at"))).alias("x"))
    flat = flat.select(F.lit("flat").alias("policy"), F.length("x.pieces").alias("n"), F.col("x.at").isNotNull().alias("placed"))
    tree = sections.structured_chunks(docs.select("doc_id", F.inline("blocks")), size, parent).filter("not is_parent")
    tree = tree.select(F.lit("structured").alias("policy"), F.length("text").alias("n"), (F.size("spans") > 0).alias("placed"))
    return flat.unionByName(tree).groupBy("policy").agg(F.count(F.lit(1)).alias("chunks"), F.max("n").alias("max_chars"), F.count_if("placed").alias("located"))


def retrieval_grid(hits: DataFrame, windows: DataFrame, gold: DataFrame, policies: list[str], contexts: list[str], k: int) -> DataFrame:
    """(policy, context, recall, complete, scored, chars) of each candidate policy with each context policy; null stands for all.

    `hits`: query_id, policy, rank, chunk_id; `windows`: chunk_id, context, doc_id, page, s_start, s_end; `gold`: query_id, doc_id, page,
    g_start, g_end. A query without hits in a cell counts as not covered.
    """
    cell = F.struct("policy", "context", "query_id").alias("query_id")
    spans = hits.filter(F.col("rank") <= k).join(windows, "chunk_id").withColumn("query_id", cell)
    every = lambda names: F.explode(F.array(*map(F.lit, names)))
    asked = gold.withColumn("policy", every(policies)).withColumn("context", every(contexts)).withColumn("query_id", cell).drop("policy", "context")
    chars = spans.groupBy("query_id").agg(F.sum(F.col("s_end") - F.col("s_start")).alias("chars"))
    each = anchor_coverage(asked, spans.select("query_id", "rank", "doc_id", "page", "s_start", "s_end"), (k,)).join(chars, "query_id", "left")
    each = each.select("query_id.policy", "query_id.context", "recall", "complete", F.coalesce("chars", F.lit(0)).alias("chars"))
    return each.cube("policy", "context").agg(F.round(F.avg("recall"), 6).alias("recall"), F.count_if("complete").alias("complete"), F.count(F.lit(1)).alias("scored"), F.round(F.avg("chars"), 6).alias("chars"))
