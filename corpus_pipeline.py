"""A corpus made ready for training: filter by quality, drop near copies, hide personal data, mix sources, pack windows."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.llm import minhash, mixing, packing, pii, quality
from evidence_spark.llm.common import discard, recorded, remove_paths, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Tables that the last stage has written on its way.
_LEFT: list[str] = []


#: Bytes after which an Arrow batch ends. Python workers serve all stages and keep what their largest batches took.
BATCH = "4m"


def _stage(make):
    """A stage begins when the rows of the stage before are stored, so the tables which that one was made from go first.

    The session's Arrow batches are bounded from then on, as a stage's rows are made when they are asked for.
    """

    @wraps(make)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        remove_paths(spark, _LEFT)
        with recorded(_LEFT):
            return make(spark, docs, sf_dir)

    return begun


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of these documents.

    A null or empty text is scored by the intercept alone; repeated rows are each kept or rejected alike. Without any labels no
    document is rejected by evidence: all get a score of 0.5 and stay. An empty table gives no rows.
    """
    scored = quality.classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)
    return scored.filter("predicted = 1").select(*COLUMNS)


#: Keys of rows that their id does not name lie above all ids.
ABOVE = 1 << 61


def keyed(docs: DataFrame) -> DataFrame:
    """Adds _key: the id, or a hash above all ids for rows without one and for the further texts of an id that has several."""
    hashes = docs.select("doc_id", F.xxhash64("text").alias("h")).filter("doc_id is not null")
    first = hashes.groupBy("doc_id").agg(F.min("h").alias("_first"), F.max("h").alias("_last")).filter("_first != _last").drop("_last")
    known = docs.join(written(first, "repeated-ids"), "doc_id", "left")
    other = F.col("doc_id").isNull() | (F.xxhash64("text") != F.col("_first"))
    key = F.when(other, F.lit(ABOVE) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(ABOVE - 1))).otherwise(F.col("doc_id").cast("long"))
    return known.withColumn("_key", key).drop("_first")


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more.

    Rows without ids and all texts of an id with several take part, and one row of each group stays, also of rows that are equal
    throughout. Null, empty and blank texts have no shingles, so all their rows stay. An empty table gives no rows.
    """
    rows = keyed(docs.select(*COLUMNS))
    found = minhash.near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text"), words=5, percent=80).filter("kept")
    # a key of several equal rows is kept several times
    kept = found.groupBy(F.col("doc_id").alias("_key")).agg((F.count(F.lit(1)) > 1).alias("_many"), F.max("n_shingles").alias("_n"))
    kept = written(kept, "kept")
    twice = rows.join(kept.filter("_many and _n > 0").select("_key"), "_key", "left_semi").dropDuplicates(["_key"])
    return rows.join(kept.filter("not _many or _n = 0").select("_key"), "_key", "left_semi").select(*COLUMNS).unionByName(twice.select(*COLUMNS))


@_stage
def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars is counted anew. Null texts stay null, and every row stays."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares of their sources; a row for each time that the mix takes a document, shuffled within its shards.

    The written files hold the shards in their shuffled order, so the packer reads mixed sources. Documents without words (null,
    empty, blank) take no place; equal rows are each drawn; null sources form one source. An empty table gives no rows.
    """
    return mixing.shuffled(mixing.mixed(docs.select(*COLUMNS))).select(*COLUMNS)


@_stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token documents in context windows. A null or empty text is one end-of-text token; repeated rows are each packed."""
    import public_tokenizers

    # the workers have served the other stages before and hold some of their memory
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=200_000)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Training, MinHash and tokenizing have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again, and goes once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
