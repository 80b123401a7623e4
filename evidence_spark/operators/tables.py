"""Index tables, claims, relations and usage figures: joins and sums over keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.operators.search import most_shared


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of `new` in place of those with equal keys."""
    return current.join(new, keys, "left_anti").unionByName(new)


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that are missing, extra or changed."""
    a, b = expected.select(*keys, F.col(value).alias("_e"), F.lit(True).alias("_in_e")), actual.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    state = F.when(F.col("_in_a").isNull(), "missing").when(F.col("_in_e").isNull(), "extra").when(~F.col("_e").eqNullSafe(F.col("_a")), "changed")
    return a.join(b, keys, "full").select(*keys, state.alias("state")).filter("state is not null")


def exact_slice(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """claims with ok: the cited slice of the text equals the quote (offsets from 0, end exclusive)."""
    cut = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    inside = (F.col("char_end") <= F.length("text")) & (cut == F.col("quote"))
    return claims.join(texts, "doc_id", "left").withColumn("ok", F.coalesce(inside, F.lit(False))).drop("text")


def comparison(claims: DataFrame, facets: tuple[str, ...]) -> DataFrame:
    """(doc_id, facet, state): conflict, supported, uncertain or missing for each document and facet.

    `claims`: doc_id, facet, statement, status.
    """
    grid = claims.select("doc_id").distinct().withColumn("facet", F.explode(F.array(*[F.lit(f) for f in facets])))
    sums = claims.groupBy("doc_id", "facet").agg(
        F.bool_or(F.col("status") == "contradicted").alias("bad"),
        F.count_distinct(F.when(F.col("status") == "supported", F.col("statement"))).alias("told"),
    )
    state = F.when(F.col("bad") | (F.col("told") > 1), "conflict").when(F.col("told") == 1, "supported").when(F.col("told") == 0, "uncertain").otherwise("missing")
    return grid.join(sums, ["doc_id", "facet"], "left").select("doc_id", "facet", state.alias("state"))


def relations_for_query(queries: DataFrame, relations: DataFrame, n: int) -> DataFrame:
    """(query_id, relation_id, overlap): the n relations that share most words with a query, ties by id."""
    return most_shared(queries, relations.withColumnRenamed("relation_id", "id"), n).withColumnRenamed("id", "relation_id")


def remove_document_relations(relations: DataFrame, removed: DataFrame) -> DataFrame:
    """The relations without those of a tenant's removed documents, in every corpus. `relations`: tenant, doc_id; `removed`: tenant, doc_id."""
    return relations.join(removed.select("tenant", "doc_id"), ["tenant", "doc_id"], "left_anti")


def two_hop_paths(edges: DataFrame, seeds: DataFrame, degree: int | None = None) -> DataFrame:
    """(seed, mid, node): undirected simple paths of two relations, all of them or, with `degree`, those over each node's first neighbours.

    Parallel relations of two nodes are summed up before the join: their least and greatest ids tell if two differ.
    """
    near = edges.select("relation_id", "a", "b").unionByName(edges.select("relation_id", F.col("b").alias("a"), F.col("a").alias("b")))
    if degree is not None:
        first = Window.partitionBy("a").orderBy("relation_id", "b")
        near = near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= degree).drop("_n")
    near = near.filter("a != b").groupBy("a", "b").agg(F.min("relation_id").alias("lo"), F.max("relation_id").alias("hi"))
    one = near.join(seeds.select(F.col("seed").alias("a")), "a", "left_semi").select(F.col("a").alias("seed"), F.col("b").alias("mid"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    two = near.select(F.col("a").alias("mid"), F.col("b").alias("node"), "lo", "hi")
    return one.join(two, "mid").filter("node != seed and (lo1 != hi or hi1 != lo)").select("seed", "mid", "node")


def usage_by_event(logs: DataFrame, since: Column) -> DataFrame:
    """(event_type, calls, tokens, failures, failure_rate): one row for each type and one, with null, for all."""
    recent = logs.filter(F.col("created_at") >= since)
    sums = recent.rollup("event_type").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("tokens_used", F.lit(0))).cast("long").alias("tokens"), F.count_if(~F.col("is_success")).alias("failures")
    )
    return sums.withColumn("failure_rate", F.format_string("%.2f%%", F.when(F.col("calls") > 0, 100.0 * F.col("failures") / F.col("calls")).otherwise(0.0)))


def latest(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The value of each key's last row: an aggregate, so a busy key is summed up before the shuffle."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, value))[value].alias(value))


def recent_history(messages: DataFrame, rounds: int) -> DataFrame:
    """The last 2 * rounds messages of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2 * rounds).drop("_n")


def explore_paths(edges: DataFrame, seeds: DataFrame, limit: int = 20) -> DataFrame:
    """(seed, place, mid, node, first, second): the first `limit` undirected simple paths of one or two relations of each seed.

    Breadth first: paths of one relation (mid and second are null) by its id, then those of two by the ids of both. A node in the
    middle needs `limit` relations to each neighbour and, as a seed shuts out one neighbour only, twice as many in all; further
    ones can't be among the first `limit` paths, so hot nodes are cut before the join and before the shuffle.
    `edges`: relation_id, a, b; `seeds`: seed.
    """
    near = edges.select("relation_id", "a", "b").unionByName(edges.select("relation_id", F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b")

    def first(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")

    one = near.join(seeds.select(F.col("seed").alias("a")).distinct(), "a", "left_semi")
    one = first(one, ["a"], ["relation_id", "b"], limit).select(F.col("a").alias("seed"), F.col("b").alias("mid"), F.col("relation_id").alias("first"))
    via = first(first(near, ["a", "b"], ["relation_id"], limit), ["a"], ["relation_id", "b"], 2 * limit)
    two = one.join(via.select(F.col("a").alias("mid"), F.col("b").alias("node"), F.col("relation_id").alias("second")), "mid").filter("node != seed and first != second")
    none = F.lit(None)
    single = one.select("seed", none.cast(dict(one.dtypes)["mid"]).alias("mid"), F.col("mid").alias("node"), "first", none.cast(dict(one.dtypes)["first"]).alias("second"))
    paths = single.unionByName(two.select(single.columns))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.col("mid").isNotNull(), "first", F.col("second").asc_nulls_first(), "node"))
    return paths.withColumn("place", place).filter(F.col("place") <= limit)
