"""Versions of an index: records, digests, checks of coverage, switches and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.functions.vectors import faults as vector_faults


def build_records(chunks: DataFrame, vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with their vectors and document data; a chunk without a vector keeps null, so that a check can refuse it.

    `chunks`: doc_id, chunk_index, text and chunk_id, if it has ids; `vectors`: doc_id, chunk_index, vector; `docs`: doc_id, file_name, user_id.
    """
    own = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    named = chunks.withColumn("id", F.coalesce(F.col("chunk_id"), own) if "chunk_id" in chunks.columns else own)
    full = named.join(docs, "doc_id").join(vectors, ["doc_id", "chunk_index"], "left")
    return full.withColumn("metadata", F.to_json(F.struct("chunk_index", "doc_id", "file_name", "user_id")))


def verify_records(expected: DataFrame, actual: DataFrame, dim: int, rel: float = 1e-5, tiny: float = 1e-7) -> DataFrame:
    """(id, fault): records missing, extra, with another text or other metadata, or with a vector of another length or not close.

    Both: id, text, vector and, if both have it, metadata.
    """
    told = ["text", "vector", *(["metadata"] if "metadata" in expected.columns and "metadata" in actual.columns else [])]
    a = expected.select("id", F.struct(*told).alias("a"))
    b = actual.select("id", F.struct(*told).alias("b"))
    other = ~F.col("a.metadata").eqNullSafe(F.col("b.metadata")) if "metadata" in told else F.lit(False)
    near = F.forall(
        F.zip_with(F.col("a.vector"), F.col("b.vector"), lambda x, y: F.coalesce(F.abs(x.cast("double") - y) <= tiny + rel * F.abs(y.cast("double")), F.lit(False))),
        lambda ok: ok,
    )
    fault = (
        F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(~F.col("a.text").eqNullSafe(F.col("b.text")), "text").when(other, "metadata")
        .when(F.coalesce(F.size("b.vector"), F.lit(-1)) != dim, "dimension").when(~F.coalesce(near, F.lit(False)), "vector")
    )
    return a.join(b, "id", "full").select("id", fault.alias("fault")).filter("fault is not null")


def index_manifest(index: DataFrame, build: str, columns: list[str]) -> DataFrame:
    """(build, records, digest): a digest of each build's records that does not depend on their order.

    Each record has a SHA-256; the digest hashes the sums of its eight 32-bit words. Sums combine before the shuffle, so no
    build is sorted or gathered, whatever its size.
    """
    record = F.sha2(F.concat_ws("|", *[F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("null")) for c in columns]), 256)
    word = [F.conv(F.substring("_r", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = index.select(build, record.alias("_r")).groupBy(build).agg(F.count(F.lit(1)).alias("records"), *[F.sum(w).alias(f"_{i}") for i, w in enumerate(word)])
    parts = [F.col("records").cast("string"), *[F.col(f"_{i}").cast("string") for i in range(8)]]
    return sums.select(build, "records", F.sha2(F.concat_ws(",", *parts), 256).alias("digest"))


def build_summary(index: DataFrame, build: str, key: str, vector: str, versions: list[str]) -> DataFrame:
    """(build, records, dimension, ids_digest, versions): what a manifest says of each build. A build of several dimensions has none.

    The digest covers the ids in no order, as in `index_manifest`; versions are the distinct values of the named columns, in order.
    """
    ids = index_manifest(index, build, [key]).select(F.col(build).alias("_build"), F.col("digest").alias("ids_digest"))
    size = F.size(vector)
    told = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in versions])
    sums = index.groupBy(build).agg(
        F.count(F.lit(1)).alias("records"), F.when(F.min(size) == F.max(size), F.max(size)).alias("dimension"), F.array_sort(F.collect_set(told)).alias("versions")
    )
    return sums.join(ids, F.col(build).eqNullSafe(F.col("_build"))).select(build, "records", "dimension", "ids_digest", "versions")


def seal_version(builds: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, problem): documents that keep a version from being sealed. `builds`: doc_id, build_id, state, spec; `docs`: doc_id.

    Every document needs one validated build, and all builds one embedding spec.
    """
    spec = builds.agg(F.count_distinct("spec").alias("specs"))
    each = builds.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("state") == "validated", F.lit(False))).alias("valid"))
    joined = docs.select("doc_id", F.lit(True).alias("known")).join(each, "doc_id", "full").crossJoin(F.broadcast(spec))  # spec is one row
    problem = (
        F.when(F.col("known").isNull(), "unknown document").when(F.col("n").isNull(), "no build").when(F.col("n") > 1, "several builds")
        .when(~F.col("valid"), "not validated").when(F.col("specs") > 1, "mixed specs")
    )
    return joined.select("doc_id", problem.alias("problem")).filter("problem is not null")


def list_versions(versions: DataFrame, members: DataFrame, pointers: DataFrame) -> DataFrame:
    """Versions of each owner, newest first, with the active flag and the number of documents.

    `versions`: owner, version_id, created_at; `members`: version_id, doc_id; `pointers`: owner, active_id.
    """
    n = members.groupBy("version_id").agg(F.count_distinct("doc_id").alias("documents"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("created_at"), F.desc("version_id")))
    full = versions.join(n, "version_id", "left").join(pointers, "owner", "left")
    active = F.coalesce(F.col("active_id") == F.col("version_id"), F.lit(False))
    return full.select("owner", "version_id", place.alias("place"), active.alias("active"), F.coalesce("documents", F.lit(0)).alias("documents"))


def with_integrity(versions: DataFrame, faults: DataFrame) -> DataFrame:
    """Adds integrity: invalid for versions whose stored manifest has a fault, whose number of documents is then unknown; valid for others.

    `versions`: what `list_versions` gives; `faults`: version_id and fault, as `audits.manifest_faults` gives them.
    """
    broken = faults.groupBy("version_id").agg(F.lit(True).alias("_broken"))
    joined = versions.join(broken, "version_id", "left")
    documents = F.when(F.col("_broken").isNull(), F.col("documents"))
    return joined.withColumns({"documents": documents, "integrity": F.when(F.col("_broken"), "invalid").otherwise("valid")}).drop("_broken")


def replay_switches(events: DataFrame) -> DataFrame:
    """(owner, active, revision, valid): the version at the highest revision; valid if revisions rise by one and each names the version before.

    `events`: owner, revision, previous, version.
    """
    w = Window.partitionBy("owner").orderBy("revision")
    before = F.lag("version").over(w)
    ok = (F.col("revision") == F.coalesce(F.lag("revision").over(w), F.lit(0)) + 1) & F.col("previous").eqNullSafe(before)
    return events.withColumn("ok", ok).groupBy("owner").agg(
        F.max_by("version", "revision").alias("active"), F.max("revision").alias("revision"), F.bool_and("ok").alias("valid")
    )


def stale_switches(requests: DataFrame, pointers: DataFrame) -> DataFrame:
    """Adds conflict: the revision that a request expects isn't that of its owner's pointer (0 for none). `requests`: owner, expected; `pointers`: owner, revision."""
    now = pointers.select("owner", F.col("revision").alias("_revision"))
    stale = ~F.coalesce(F.col("expected"), F.lit(-1)).eqNullSafe(F.coalesce("_revision", F.lit(0)))
    return requests.join(now, "owner", "left").withColumn("conflict", stale).drop("_revision")


def corpus_changes(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, change): added, removed, content or renamed. Both: doc_id, file_name, sha256."""
    a = frozen.select("doc_id", F.struct("file_name", "sha256").alias("a"))
    b = current.select("doc_id", F.struct("file_name", "sha256").alias("b"))
    change = (
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
        .when(~F.col("a.sha256").eqNullSafe(F.col("b.sha256")), "content").when(~F.col("a.file_name").eqNullSafe(F.col("b.file_name")), "renamed")
    )
    return a.join(b, "doc_id", "full").select("doc_id", change.alias("change")).filter("change is not null")


def pending_documents(docs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Documents without a committed checkpoint."""
    return docs.join(checkpoints.filter("state = 'committed'").select("doc_id"), "doc_id", "left_anti")


def resolve_requests(requests: DataFrame) -> DataFrame:
    """Adds outcome: first, replay (equal fingerprint) or conflict, by owner and key. `requests`: request_id, owner, key, fingerprint, arrived.

    The first request of a key is found by an aggregate, so a key repeated very often is summed up before the shuffle.
    """
    first = requests.groupBy("owner", "key").agg(F.min(F.struct("arrived", "request_id", "fingerprint")).alias("_f"))
    outcome = F.when(F.col("_f.request_id") == F.col("request_id"), "first").when(F.col("_f.fingerprint").eqNullSafe(F.col("fingerprint")), "replay").otherwise("conflict")
    return requests.join(first, ["owner", "key"]).withColumn("outcome", outcome).drop("_f")


def admit_by_quota(tasks: DataFrame, limit: int = 8) -> DataFrame:
    """Adds admitted: fewer than `limit` earlier tasks of the owner are open. `tasks`: owner, task_id, state, created_at."""
    earlier = Window.partitionBy("owner").orderBy("created_at", "task_id").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.count_if(F.col("state").isin("pending", "running", "failed")).over(earlier)
    return tasks.withColumn("admitted", F.coalesce(open_, F.lit(0)) < limit)


def delete_document(index: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """The index without the records of removed documents, in the versions that the keys name."""
    return index.join(removed.select(*keys), keys, "left_anti")


def drop_owners(index: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """The index without all records of some owners, in every version."""
    return index.join(owners.select(owner), owner, "left_anti")


def read_records(index: DataFrame, versions: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """All records of the versions named by keys, with the columns asked for: a full read for checks, not a search.

    Versions without records have none, and nothing is left out; a record of a version that is named twice comes once.
    """
    return index.join(versions.select(*keys).distinct(), keys, "left_semi").select(*keys, *columns)


def vector_set_faults(inputs: DataFrame, vectors: DataFrame, build: str, dim: int) -> DataFrame:
    """(build, inputs, vectors, faulty, problem): each build's inputs and vectors; their numbers must be equal and every vector valid.

    `inputs`: build, a row for each text; `vectors`: build, vector. Builds that only one side has are named too.
    """
    bad = F.size(vector_faults(F.col("vector"), dim)) > 0
    given = inputs.groupBy(build).agg(F.count(F.lit(1)).alias("inputs"))
    made = vectors.groupBy(build).agg(F.count(F.lit(1)).alias("vectors"), F.count_if(bad).alias("faulty"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("inputs", "vectors", "faulty")]
    full = given.join(made, build, "full").select(build, *zero)
    return full.withColumn("problem", F.when(F.col("inputs") != F.col("vectors"), "count").when(F.col("faulty") > 0, "vectors"))


def count_index(index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, records, documents): the numbers of records and of documents in each index. `index`: keys, doc_id."""
    return index.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("doc_id").alias("documents"))
