"""Mixing sources to target weights: exact block quotas, split among output shards by a tree of draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written


#: Most rows of blocks (about 100 bytes each) that are broadcast: 1,024 for each of 200 sources.
BROADCAST_BLOCKS = 1024 * 200


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """Adds each source's target: weighted shares of `share` times all sizes, none above `limit` times its own.

    `sources` has a row for each source. The fair level x, at which targets are min(limit * size,
    x * weight), is found in one pass over the sources in the order of limit * size / weight.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    w = F.element_at(cycle, (F.col("_place") % len(weights) + 1).cast("int")).cast("double")
    by_code = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("_place", F.row_number().over(by_code) - 1).withColumn("_w", w)
    ranked = ranked.withColumn("_cap", F.lit(limit) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_ratio", "_place")
    every = Window.partitionBy()
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("_capped", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
        .withColumn("_above", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_above"))
    )
    # the first source in this order that its cap does not stop sets the level for all after it
    free = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_place", "_level"))).over(every)
    level = free["_level"]
    return ranked.withColumn("target", F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap")))).select(
        "source", "source_size", "target", "_place"
    )


def _uniform(*cols: Column) -> Column:
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Splits each source's number of blocks among the shards: (source, ends array<long>), the running ends.

    `quotas`: (source, _place, units), one row for each source. From the root down, a node's blocks are
    drawn without replacement into its left half, to the exact size of that half: selection sampling over the
    node's counts, which gives a multivariate-hypergeometric vector. All nodes hold one count
    for each source, so the row that is folded is as long as the list of sources and no longer.
    """
    row = quotas.agg(F.sort_array(F.collect_list(F.struct("_place", "units"))).alias("s"))
    # a node is (first shard, number of shards, counts); `nodes` holds the nodes of one level
    nodes = row.select(F.transform("s", lambda x: x["_place"]).alias("places"), F.array(F.struct(F.lit(0).alias("lo"), F.lit(shards).alias("n"), F.transform("s", lambda x: x["units"].cast("long")).alias("c"))).alias("nodes"))
    width, level = shards, 0
    while width > 1:
        nodes = nodes.withColumn("nodes", F.flatten(F.transform("nodes", lambda x: _halves(x, seed, level))))
        width, level = (width + 1) // 2, level + 1
    leaves = nodes.select("places", F.explode("nodes").alias("x")).select(
        F.explode(F.arrays_zip(F.col("places"), F.col("x.c").alias("c"))).alias("y"), F.col("x.lo").alias("lo")
    )
    leaves = leaves.select(F.col("y.places").alias("_place"), F.col("y.c").alias("c"), "lo")
    ends = leaves.groupBy("_place").agg(F.sort_array(F.collect_list(F.struct("lo", "c"))).alias("a"))
    zero = F.array().cast("array<bigint>")
    return ends.select(
        "_place",
        F.aggregate("a", zero, lambda z, x: F.concat(z, F.array(F.coalesce(F.try_element_at(z, F.lit(-1)), F.lit(0).cast("long")) + x["c"]))).alias("ends"),
    )


def _halves(node: Column, seed: int, level: int) -> Column:
    """The two children of a node of more than one shard; a node of one shard stays."""
    left_n = F.floor((node["n"] + 1) / 2).cast("int")
    total = F.aggregate(node["c"], F.lit(0).cast("long"), lambda z, x: z + x)
    take = F.round(total * left_n / node["n"]).cast("long")
    start = F.struct(take.alias("need"), total.alias("rest"), F.array().cast("array<bigint>").alias("out"))

    def source(z: Column, k: Column) -> Column:
        def unit(u: Column, i: Column) -> Column:
            hit = F.when(_uniform(F.lit(seed), F.lit(level), node["lo"], u["rest"], i) * u["rest"] < u["need"], F.lit(1)).otherwise(F.lit(0)).cast("long")
            return F.struct((u["need"] - hit).alias("need"), (u["rest"] - 1).alias("rest"), (u["got"] + hit).alias("got"))

        drawn = F.aggregate(
            F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
            F.struct(z["need"].alias("need"), z["rest"].alias("rest"), F.lit(0).cast("long").alias("got")),
            unit,
        )
        # one pass over the units; the struct is folded once and read three times
        return F.element_at(F.transform(F.array(drawn), lambda d: F.struct(d["need"].alias("need"), d["rest"].alias("rest"), F.concat(z["out"], F.array(d["got"])).alias("out"))), 1)

    left = F.aggregate(node["c"], start, source)["out"]
    two = F.transform(
        F.array(left),
        lambda got: F.array(
            F.struct(node["lo"].alias("lo"), left_n.alias("n"), got.alias("c")),
            F.struct((node["lo"] + left_n).alias("lo"), (node["n"] - left_n).alias("n"), F.zip_with(node["c"], got, lambda a, b: a - b).alias("c")),
        ),
    )
    return F.when(node["n"] > 1, F.element_at(two, 1)).otherwise(F.array(F.struct(node["lo"].alias("lo"), node["n"].alias("n"), node["c"].alias("c"))))


def _source_key(source: Column) -> list[Column]:
    """Two columns that are never null and equal for equal sources."""
    return [F.coalesce(source, F.lit("")).alias("_s"), source.isNull().alias("_null")]


def _drawn_blocks(slim: DataFrame, weights: tuple[int, ...], share: float, limit: float, shards: int, seed: int) -> DataFrame:
    """(_s, _null, _block, source_size, target, units, cut): each source's blocks with their draws (repeat, shard, unit, left).

    `cut` marks the block in which a source's mix ends: only a part of it is drawn. `slim`: source, size, _block of every row.
    Only sums by block, and rows of sources, are shuffled.
    """
    per_block = slim.groupBy("source", "_block").agg(F.sum("size").alias("words"))
    sources = per_block.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = written(_targets(sources, weights, share, limit), "mix-targets")

    # the blocks that are drawn: (source, repeat, block, words left to take)
    by_pass = Window.partitionBy("_place", "repeat").orderBy("_key", "_block").rowsBetween(Window.unboundedPreceding, -1)
    passes = per_block.join(sources, per_block["source"].eqNullSafe(sources["source"])).select(
        "_place", "_block", "words", "target", "source_size",
        F.explode(F.sequence(F.lit(0), F.ceil(F.lit(limit)).cast("int") - 1)).alias("repeat"),
    )
    units = (
        passes.filter("words > 0")
        .withColumn("_key", F.xxhash64(F.lit(seed), "_place", "repeat", "_block"))
        .withColumn("_done", F.coalesce(F.sum("words").over(by_pass), F.lit(0)))
        .withColumn("left", F.col("target") - F.col("repeat") * F.col("source_size") - F.col("_done"))
        .filter("left > 0")
    )
    listed = Window.partitionBy("_place").orderBy("repeat", "_key", "_block")
    units = written(units.withColumn("unit", F.row_number().over(listed) - 1), "mix-blocks")
    tree = _split_tree(units.groupBy("_place").agg(F.count(F.lit(1)).alias("units")), shards, seed)
    # a shard takes the next blocks of each source's permuted list, as many as its leaf of the tree says
    drawn = units.join(tree, "_place").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("unit"))))
    # a list of `limit` entries at most for each source and block
    drawn = drawn.groupBy("_place", "_block").agg(F.sort_array(F.collect_list(F.struct("repeat", "shard", "unit", "left"))).alias("units"))
    drawn = per_block.join(sources, per_block["source"].eqNullSafe(sources["source"])).select(
        per_block["source"], "_block", "words", "source_size", "target", "_place"
    ).join(drawn, ["_place", "_block"], "left")
    cut = F.exists("units", lambda u: u["left"] < F.col("words"))
    return written(drawn.select(*_source_key(F.col("source")), "_block", "source_size", "target", "units", F.coalesce(cut, F.lit(False)).alias("cut")), "mix-draws")


def _placed(docs: DataFrame, carried: Column, weights, share, limit, shards, blocks, seed, id_col, text_col, source_col, keep: bool) -> DataFrame:
    """(row, source, size, source_size, target, draws): `carried` of each row with the places that the mix gives it."""
    perm = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col))
    rows = docs.select(
        carried.alias("row"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), perm.alias("_perm"), F.pmod(perm, F.lit(blocks)).cast("int").alias("_block")
    )
    rows = written(rows, "mix-sizes") if keep else rows
    slim = rows if keep else written(rows.groupBy("source", "_block").agg(F.sum("size").alias("size")), "mix-sizes")
    drawn = _drawn_blocks(slim, weights, share, limit, shards, seed)
    # a row for each block of a source; broadcast if it is known to be small, else joined on its key
    drawn = F.broadcast(drawn) if drawn.count() <= BROADCAST_BLOCKS else drawn
    rows = rows.select("*", *_source_key(F.col("source"))).join(drawn, ["_s", "_null", "_block"])
    none = F.array().cast("array<struct<repeat:int,shard:int,unit:int,left:double>>")
    some = F.when(F.col("size") > 0, F.coalesce("units", none)).otherwise(none)
    # only in the block where a source's mix ends does a row's place count; equal rows have places of their own
    inside = Window.partitionBy("_s", "_null", "_block").orderBy("_perm").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.filter(~F.col("cut")).withColumn("taken", some)
    ends = rows.filter("cut").withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ends = ends.withColumn("taken", F.filter(some, lambda u: F.col("_at") + F.col("size") / 2 <= u["left"])).drop("_at")
    draws = F.transform(
        "taken",
        lambda u: F.struct(u["repeat"].alias("repeat"), u["shard"].alias("shard"), F.col("_block").alias("block"), u["unit"].alias("unit"), F.xxhash64(F.lit(seed + 1), "_perm", u["repeat"]).alias("order")),
    )
    return whole.unionByName(ends).select("row", "source", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), "target", draws.alias("draws"))


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    shards: int = 16,
    blocks: int = 1024,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, draws): a row for each document with the places it takes in the mix.

    Size is the number of words (null text: 0). A seeded hash permutes each source's documents and deals
    them into `blocks` blocks. A source's quota is its target in words: whole passes over its blocks,
    then blocks of one more pass in a permuted order, the last of them cut at the document nearest to the
    target. The quotas, in blocks, are split among the output shards by the tree; a shard draws the next
    blocks of the source's permuted list, so draws are disjoint, and `draws` holds (repeat, shard, block, unit, order):
    sorting a shard by `order` shuffles it locally. Reruns agree, as all draws hash seed and row.

    Null sources form one source, last in order. Null ids are documents like others; equal rows are each taken, and which of
    them takes which place makes no difference. Sources without words have target 0. An empty table gives no rows.
    """
    placed = _placed(docs, F.col(id_col).cast("long"), weights, share, limit, shards, blocks, seed, id_col, text_col, source_col, True)
    return placed.withColumnRenamed("row", "doc_id")


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    shards: int = 16,
    blocks: int = 1024,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of the mix: documents' own columns, once for each draw of mix_plan, with `_shard` and `_order`.

    Each row carries its own draws, so equal rows, null ids and any other columns come through as they are; columns of
    the names `_shard` and `_order` are replaced.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("_shard", "_order")])
    placed = _placed(docs, carried, weights, share, limit, shards, blocks, seed, id_col, text_col, source_col, False)
    drawn = placed.select("row", F.explode("draws").alias("d"))
    return drawn.select("row.*", F.col("d.shard").alias("_shard"), F.col("d.order").alias("_order"))


def shuffled(mix: DataFrame, slices: int = 64) -> DataFrame:
    """The rows of a mix, dealt by shard and a slice of its order, each in shuffled order: written out, a file holds parts of few shards.

    `_shard` and `_order` are dropped.
    """
    parts = int(mix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = mix.withColumn("_slice", F.pmod("_order", F.lit(slices))).repartition(parts, "_shard", "_slice")
    return dealt.sortWithinPartitions("_shard", "_slice", "_order").drop("_shard", "_slice", "_order")
