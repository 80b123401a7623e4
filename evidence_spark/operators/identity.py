"""Recomputed ids of chunks and reviews, and digests of record sets as trees."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.functions.canonical import canonical_json, float_bits, nested_id
from evidence_spark.operators.evidence import index_gaps
from evidence_spark.sources.scratch import scratch_folder

# --- chunks

#: Columns that a chunk's id covers, beside its input and its parent's id.
CHUNK = ("doc_id", "is_parent", "chunk_index", "parent_index", "title", "section_path", "text", "tokens", "page_start", "page_end", "spans")


def _named(rows: DataFrame, prefix: str, *columns: str) -> Column:
    kept = rows.select(*columns)
    return nested_id(prefix, F.struct(*columns), kept.schema)


def _families(chunks: DataFrame) -> DataFrame:
    """Names a column by which chunks meet their parents, so that windows over it share a sort."""
    return chunks if "_family" in chunks.columns else chunks.withColumn("_family", F.coalesce("parent_index", "chunk_index"))


def _of_parent(value: Column) -> Column:
    """What a chunk's parent has; of chunks from `_families`."""
    return F.max(F.when(F.col("is_parent"), value)).over(Window.partitionBy("doc_id", "_family"))


def expected_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Adds expected_parent and expected_id: a chunk's id covers its input, all that it says and its parent's id.

    `chunks`: what `structured_chunks` gives, with input_id. A parent and its children share a window, so nothing is joined.
    """
    chunks = _families(chunks).withColumn("_none", F.lit(None).cast("string"))
    first = chunks.withColumn("_own", F.when(F.col("is_parent"), _named(chunks, "chunk_", *CHUNK, "input_id", "_none")))
    known = first.withColumn("expected_parent", F.when(~F.col("is_parent"), _of_parent(F.col("_own"))))
    own = _named(known.withColumnRenamed("expected_parent", "_p").withColumn("_none", F.col("_p")), "chunk_", *CHUNK, "input_id", "_none")
    return known.withColumn("_none", F.col("expected_parent")).withColumn("expected_id", F.when(F.col("is_parent"), F.col("_own")).otherwise(own)).drop("_none", "_own", "_family")


def chunk_stats(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, input_blocks, parent_count, child_count, parent_tokens, child_tokens): a row for each document of `blocks`."""
    given = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("input_blocks"))
    kind = F.col("is_parent")
    sums = chunks.groupBy("doc_id").agg(
        F.count_if(kind).alias("parent_count"), F.count_if(~kind).alias("child_count"), F.sum(F.when(kind, F.col("tokens"))).alias("parent_tokens"), F.sum(F.when(~kind, F.col("tokens"))).alias("child_tokens")
    )
    numbers = ("parent_count", "child_count", "parent_tokens", "child_tokens")
    return given.join(sums, "doc_id", "left").select("doc_id", "input_blocks", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


#: Numbers of `chunk_stats`, and faults of `chunk_faults` in their order.
STATS, FAULTS = ("input_blocks", "parent_count", "child_count", "parent_tokens", "child_tokens"), ("id", "duplicate", "index", "budget", "parent", "stats")


def chunk_rules(chunks: DataFrame, child: int, parent: int, told: str | None = None) -> DataFrame:
    """(doc_id, id, duplicate, index, budget, parent, parent_count, child_count, parent_tokens, child_tokens): rules that chunks break, and their numbers.

    `chunks`: those of `chunk_faults`. `told`: a column of tokens, whose sums are told_parent_tokens and told_child_tokens. Chunks that are
    dealt by document, as those of `structured_chunks`, are read once and not shuffled.
    """
    seen = expected_chunk_ids(_families(chunks).withColumns({"_path": _of_parent(F.col("section_path")), "_text": _of_parent(F.col("text")), "_above": _of_parent(F.col("chunk_id"))}))
    kind = F.col("is_parent")
    orphan = ~kind & ~F.coalesce((F.col("_path") == F.col("section_path")) & F.contains("_text", "text") & (F.col("_above") == F.col("parent_chunk_id")), F.lit(False))
    over = F.col("tokens") > F.when(kind, parent).otherwise(child)
    sizes = {"tokens": F.col("tokens")} | ({"told": F.col(told)} if told else {})
    slim = seen.select(
        "doc_id", "is_parent", "chunk_index", "chunk_id", (~F.col("chunk_id").eqNullSafe(F.col("expected_id"))).alias("id"), over.alias("budget"), orphan.alias("parent"), *[c.alias(k) for k, c in sizes.items()]
    )
    twice = F.col("chunk_id").isNull() | (F.count(F.lit(1)).over(Window.partitionBy("doc_id", "chunk_id")) > 1)
    flags = ("id", "duplicate", "budget", "parent")
    each = {c: F.bool_or(c) for c in flags} | {k: F.sum(k) for k in sizes}
    number = lambda k, c: F.coalesce(F.sum(F.when(k, F.col(c))), F.lit(0))
    totals = {"parent_count": number(kind, "n"), "child_count": number(~kind, "n"), "parent_tokens": number(kind, "tokens"), "child_tokens": number(~kind, "tokens")}
    totals |= {"told_parent_tokens": number(kind, "told"), "told_child_tokens": number(~kind, "told")} if told else {}
    return index_gaps(slim.withColumn("duplicate", twice), each, {c: F.bool_or(c) for c in flags} | totals).withColumnRenamed("gap", "index")


def name_faults(rules: DataFrame, told: Mapping[str, Column]) -> DataFrame:
    """(doc_id, problems) of `chunk_rules` with input_blocks, if what is told of their numbers (null: nothing) is other than these."""
    same = lambda now, then: F.struct(*[now[c].cast("long").alias(c) for c in STATS]).eqNullSafe(F.struct(*[then[c].cast("long").alias(c) for c in STATS]))
    none = lambda numbers: numbers["input_blocks"].isNull()
    now = {"input_blocks": F.col("input_blocks")} | {c: F.coalesce(c, F.lit(0)) for c in STATS[1:]}
    stats = F.when(none(now) | none(told), none(now) != none(told)).otherwise(~same(now, told))
    found = rules.withColumn("stats", stats)
    return found.select("doc_id", F.array_compact(F.array(*[F.when(F.col(c), c) for c in FAULTS])).alias("problems")).filter("size(problems) > 0")


def chunk_faults(chunks: DataFrame, stored: DataFrame, blocks: DataFrame, child: int, parent: int) -> DataFrame:
    """(doc_id, problems): rules that a document's chunks break: id, duplicate, index, budget, parent, stats.

    `chunks`: those of `structured_chunks` with input_id, chunk_id and parent_chunk_id; `stored`: statistics as in `chunk_stats`. Ids are
    recomputed from contents, so any change of a chunk, its parent or its input shows. A child needs a parent with the same path and
    a text that holds its own. Documents that are not stored, or stored without chunks, break stats.
    """
    given = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("input_blocks"))
    told = stored.select("doc_id", *[F.col(c).alias(f"_told_{c}") for c in STATS])
    found = chunk_rules(chunks, child, parent).join(given, "doc_id", "full").join(told, "doc_id", "full")
    return name_faults(found, {c: F.col(f"_told_{c}") for c in STATS})


# --- reviews


def expected_event_id(events: DataFrame, prefix: str = "claim_review_") -> Column:
    """The id of each event: the digest of its other columns."""
    return _named(events, prefix, *[c for c in events.columns if c != "event_id"])


def event_faults(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, event_id, sequence, faults): events of a review history that break a rule: id, task, actor, artifact, claim, sequence, previous, revision.

    `events`: event_id, task_id, source_artifact_id, claim_id, actor_id, sequence, task_revision, previous_event_id and what else the id
    covers; `tasks`: task_id, user_id, artifact_id, claims (array), revision. The last event has the task's revision. A history
    holds 100 events at most, a rule of its own, so a window over a task is small.
    """
    order = Window.partitionBy("task_id").orderBy("sequence", "event_id")
    last = F.lead("event_id").over(order).isNull()
    full = events.withColumn("_expected", expected_event_id(events)).withColumns({
        "_n": F.row_number().over(order), "_before": F.lag("event_id").over(order), "_revision": F.lag("task_revision").over(order), "_last": last,
    }).join(tasks.withColumnRenamed("revision", "_now"), "task_id", "left")
    wrong = {
        "id": ~F.col("event_id").eqNullSafe(F.col("_expected")), "task": F.col("claims").isNull(), "actor": F.col("actor_id") != F.col("user_id"),
        "artifact": F.col("source_artifact_id") != F.col("artifact_id"), "claim": ~F.array_contains("claims", F.col("claim_id")), "sequence": (F.col("sequence") != F.col("_n")) | (F.col("_n") > 100),
        "previous": ~F.col("previous_event_id").eqNullSafe(F.col("_before")), "revision": (F.col("task_revision") != F.col("_revision") + 1) | (F.col("_last") & (F.col("task_revision") != F.col("_now"))),
    }
    faults = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in wrong.items()]))
    return full.select("task_id", "event_id", "sequence", faults.alias("faults")).filter("size(faults) > 0")


# --- digests of record sets


def record_digests(index: DataFrame, build: str, key: str, vector: str, told: list[str]) -> DataFrame:
    """(build, id, record): each record's SHA-256 over its id, the columns told, and the 32-bit floats of its vector."""
    rows = index.select(F.col(build).alias("build"), F.col(key).cast("string").alias("id"), *told, float_bits(F.col(vector)).alias("vector"))
    return rows.select("build", "id", F.sha2(canonical_json(F.struct("id", *told, "vector"), rows.select("id", *told, "vector").schema), 256).alias("record"))


def digest_tree(records: DataFrame, depth: int | None = None, per_leaf: int = 256) -> DataFrame:
    """(build, depth, prefix, records, digest): the nodes of a tree of digests for each build; depth 0 is the digest of the build.

    A record lies in the leaf of the first hex digits of its id's SHA-256, so the tree is the same however the table is partitioned or
    ordered, and a changed, new or lost record changes the digests on one path only. A leaf digests its records in the order of these
    hashes, a node its children, 16 at most. By default a build is so deep that a leaf holds about `per_leaf` records; give both sides
    of a comparison the same depth. No build is gathered, and none is sorted as a whole.
    `records`: build, id, record; null builds are a build, records of one id are in the order of their digests.
    """
    hashed = records.select("build", F.sha2(F.coalesce("id", F.lit("")), 256).alias("_key"), "record")
    if depth is None:
        sizes = records.groupBy("build").agg(F.count(F.lit(1)).alias("n"))
        levels = sizes.select(F.col("build").alias("_build"), F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n") / per_leaf))).cast("int").alias("depth"))
        deepest = levels.agg(F.max("depth")).first()[0] or 0
        hashed = hashed.join(levels, F.col("build").eqNullSafe(F.col("_build"))).drop("_build")
    else:
        deepest, hashed = depth, hashed.withColumn("depth", F.lit(depth))

    def node(rows: DataFrame, part: Column, count: Column) -> DataFrame:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: F.concat(x["_key"], x["record"])), "")
        return rows.groupBy("build", "depth", "prefix").agg(count.alias("records"), F.sha2(joined, 256).alias("digest"))

    leaves = node(hashed.withColumn("prefix", F.expr("substring(_key, 1, depth)")), F.struct("_key", "record"), F.count(F.lit(1)))
    if deepest:  # the levels above read the leaves again and again
        path = scratch_folder(records.sparkSession, "digest-leaves")
        leaves.write.parquet(path)
        leaves = records.sparkSession.read.schema(leaves.schema).parquet(path)
    levels, out = leaves, leaves
    for k in range(deepest, 0, -1):
        level = levels.filter(F.col("depth") == k)
        above = level.select("build", F.lit(k - 1).alias("depth"), F.substring("prefix", 1, k - 1).alias("prefix"), F.struct(F.col("prefix").alias("_key"), F.col("digest").alias("record")).alias("_part"), "records")
        made = node(above, F.col("_part"), F.sum("records"))
        out = out.unionByName(made)
        levels = leaves.filter(F.col("depth") == k - 1).unionByName(made)
    return out


def tree_differences(one: DataFrame, other: DataFrame, records: DataFrame, others: DataFrame, depth: int) -> DataFrame:
    """(build, id, state): records that are missing, extra or changed between two sets with trees of one depth.

    The trees are read from their roots, only below nodes whose digests differ, and records only in the leaves that are left.
    """
    a = one.select(F.coalesce(F.col("build").cast("string"), F.lit("")).alias("_b"), F.col("build").isNull().alias("_null"), "depth", "prefix", F.col("digest").alias("_one"))
    b = other.select(F.coalesce(F.col("build").cast("string"), F.lit("")).alias("_b"), F.col("build").isNull().alias("_null"), "depth", "prefix", F.col("digest").alias("_other"))
    keys = ["_b", "_null", "depth", "prefix"]
    unlike = a.join(b, keys, "full").filter(~F.col("_one").eqNullSafe(F.col("_other"))).select(*keys)
    front = unlike.filter("depth = 0")
    for k in range(1, depth + 1):
        below = unlike.filter(F.col("depth") == k).withColumn("_up", F.substring("prefix", 1, k - 1))
        front = below.join(front.select("_b", "_null", F.col("prefix").alias("_up")), ["_b", "_null", "_up"], "left_semi").drop("_up")

    def held(rows: DataFrame, name: str) -> DataFrame:
        keyed = rows.select("build", F.coalesce(F.col("build").cast("string"), F.lit("")).alias("_b"), F.col("build").isNull().alias("_null"), F.coalesce("id", F.lit("")).alias("id"), F.col("record").alias(name))
        return keyed.withColumn("prefix", F.substring(F.sha2("id", 256), 1, depth)).join(front.select("_b", "_null", "prefix"), ["_b", "_null", "prefix"], "left_semi")

    left, right = held(records, "_one"), held(others, "_other").withColumnRenamed("build", "_build")
    state = F.when(F.col("_other").isNull(), "missing").when(F.col("_one").isNull(), "extra").when(F.col("_one") != F.col("_other"), "changed")
    met = left.join(right, ["_b", "_null", "id"], "full").select(F.coalesce("build", "_build").alias("build"), "id", state.alias("state"))
    return met.filter("state is not null")
