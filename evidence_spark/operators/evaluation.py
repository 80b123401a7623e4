"""Metrics of retrieval runs and training rows from judged candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...], total: DataFrame | None = None) -> DataFrame:
    """(k, recall, mrr, ndcg, n_queries): means over queries with relevant ids, rounded to six decimals.

    `ranked`: query_id, id, rank from 1; `relevant`: query_id, id. With `total` (query_id, total), the numbers of relevant
    ids, `relevant` may leave out ids that are not ranked.
    """
    if total is None:
        total = relevant.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    hits = ranked.join(relevant.distinct(), ["query_id", "id"], "left_semi").select("query_id", "rank")
    cut = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    grid = total.select("query_id", "total", cut)
    found = hits.join(grid, "query_id").filter("rank <= k").groupBy("query_id", "k").agg(
        F.count(F.lit(1)).alias("hit"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", "k").cast("int")), F.lit(0.0), lambda z, i: z + 1 / F.log2(i + 1))
    each = grid.join(found, ["query_id", "k"], "left").select(
        "k", (F.coalesce("hit", F.lit(0)) / F.col("total")).alias("r"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("m"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("g")
    )
    return each.groupBy("k").agg(
        F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg("m"), 6).alias("mrr"), F.round(F.avg("g"), 6).alias("ndcg"), F.count(F.lit(1)).alias("n_queries")
    )


def anchor_coverage(gold: DataFrame, spans: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(query_id, k, recall, complete): gold spans that the union of the top-k spans of the same document and page covers.

    `gold`: query_id, doc_id, page, g_start, g_end; `spans`: query_id, rank, doc_id, page, s_start, s_end.
    """
    top = spans.filter(F.col("rank") <= max(ks)).select("query_id", "doc_id", "page", "rank", F.col("s_start").cast("double").alias("s_start"), F.col("s_end").cast("double").alias("s_end"))
    touching = F.when((F.col("s_start") < F.col("g_end")) & (F.col("s_end") > F.col("g_start")), F.struct("s_start", "s_end", "rank"))
    # a gold span meets the few spans that touch it in one join and one sum, which are in the same tasks
    key = ["query_id", "doc_id", "page", "g_start", "g_end"]
    met = gold.distinct().join(top, ["query_id", "doc_id", "page"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(touching)).alias("spans"))
    grid = met.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    first = F.filter("spans", lambda s: s["rank"] <= F.col("k"))
    # how far the spans reach from the beginning without a gap; those behind a gap add nothing
    reach = F.aggregate(first, F.col("g_start").cast("double"), lambda z, s: F.when(s["s_start"] <= z, F.greatest(z, s["s_end"])).otherwise(z))
    ok = (F.size(first) > 0) & (reach >= F.col("g_end"))
    each = grid.groupBy("query_id", "k").agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("recall"))
    return each.select("query_id", "k", F.round("recall", 6).alias("recall"), (F.col("recall") == 1).alias("complete"))


def training_rows(judged: DataFrame, max_neg: int = 4) -> tuple[DataFrame, DataFrame]:
    """(triplets, pairs) from query_id, id, text, label, score: positives with the hardest `max_neg` negatives."""
    valid = judged.filter("id is not null and trim(coalesce(text, '')) <> ''")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "id"))
    neg = valid.filter("label = false").withColumn("n", rank).filter(F.col("n") <= max_neg)
    pos = valid.filter("label = true")
    triplets = pos.select("query_id", F.col("id").alias("pos_id")).join(neg.select("query_id", F.col("id").alias("neg_id")), "query_id")
    pairs = pos.select("query_id", "id", F.lit(1.0).alias("target")).unionByName(neg.select("query_id", "id", F.lit(0.0).alias("target")))
    return triplets, pairs
