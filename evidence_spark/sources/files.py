"""Readers and writers of text and JSON files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, starts) of text files: lines with file, block, place; starts has the number of the line before each block's first.

    A line's number is `before + place - first + 1` of the row of `starts` with its file and block, so files may be split at any byte, and
    only the lines that need a number are joined. Lines end at LF, CR or CR LF, as universal newlines do.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
    )
    # one row for each block of a file: the lines are counted where they are read
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines, blocks.select("file", "block", "first", before.alias("before"))


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of files of JSON objects: blank lines are skipped, other lines that are no object are errors (file, line, value)."""
    lines, starts = numbered_lines(spark, path)
    lines = lines.filter(~F.col("value").rlike(r"(?U)^\s*\z"))
    parsed = lines.withColumn("_row", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_row").isNull() | F.col("_row._bad").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    errors = parsed.filter(bad).select("file", "block", "place", "value").join(starts, ["file", "block"])
    number = F.col("before") + F.col("place") - F.col("first") + 1
    return parsed.filter(~bad).select("_row.*").drop("_bad"), errors.select("file", number.alias("line"), "value")


def write_jsonl(df: DataFrame, path: str) -> int:
    """Writes one JSON object for each row and returns how many."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.json(path)
    return seen.get["n"]


def admit_files(files: DataFrame, allowed: tuple[str, ...], max_bytes: int, max_per_batch: int | None = None) -> DataFrame:
    """files (name, size and, for a limit on batches, batch) with the reason for which each is turned away, or null.

    A batch of more files than the limit is turned away as a whole.
    """
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    reason = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "blank name").when(~ext.isin(*allowed), "extension").when(F.col("size") == 0, "empty").when(F.col("size") > max_bytes, "too large")
    if max_per_batch is None:
        return files.withColumn("reason", reason)
    crowded = files.groupBy("batch").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_per_batch).select(F.col("batch").alias("_batch"), F.lit(True).alias("_crowded"))
    joined = files.join(crowded, F.col("batch").eqNullSafe(F.col("_batch")), "left")
    return joined.withColumn("reason", F.when(F.col("_crowded"), "too many files").otherwise(reason)).drop("_batch", "_crowded")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, text) of the .txt, .md and .markdown files below a path; other files are left out."""
    from evidence_spark.functions.structure import decode_bytes

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(F.lower("path").rlike(r"\.(txt|md|markdown)$")).select(F.col("path").alias("file"), F.col("length").alias("size"), decode_bytes(F.col("content")).alias("text"))


def tree_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of all files below a path, names relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = re.sub(r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "", path).rstrip("/") + "/"
    name = F.substring("path", F.locate(root, F.col("path")) + len(root), F.length("path"))
    return files.select(name.alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def directory_digests(manifest: DataFrame) -> DataFrame:
    """(directory, files, digest) of each directory below the root and of the root itself (an empty name), over all files beneath it.

    The digest hashes the sums of the eight words of each file's own hash (of its name, size and contents), so a directory of any number of
    files is summed up where its rows are read. Store it with a manifest: `diff_manifest` then compares directories first.
    """
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = F.sha2(F.concat_ws("|", "file", F.col("size").cast("string"), "sha256"), 256)
    rows = manifest.select(F.explode(above).alias("directory"), own.alias("_own"))
    words = [F.sum(F.conv(F.substring("_own", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"_{i}") for i in range(8)]
    sums = rows.groupBy("directory").agg(F.count(F.lit(1)).alias("files"), *words)
    return sums.select("directory", "files", F.sha2(F.concat_ws(",", F.col("files").cast("string"), *[F.col(f"_{i}").cast("string") for i in range(8)]), 256).alias("digest"))


def diff_manifest(expected: DataFrame, actual: DataFrame, expected_dirs: DataFrame | None = None, actual_dirs: DataFrame | None = None) -> DataFrame:
    """(file, state): files that are missing, extra or changed (in size or contents) between two manifests of file, size, sha256.

    Files in directories whose digests are equal on both sides are left out before the files are joined; give the digests that were
    stored with the manifests, else they are made here.
    """
    one = directory_digests(expected) if expected_dirs is None else expected_dirs
    other = directory_digests(actual) if actual_dirs is None else actual_dirs
    same = one.join(other, ["directory", "files", "digest"], "left_semi").select(F.col("directory").alias("_directory"))

    def open_files(manifest: DataFrame, name: str) -> DataFrame:
        told = manifest.select("file", F.struct("size", "sha256").alias(name), F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("_directory"))
        return told.join(same, "_directory", "left_anti").drop("_directory")

    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_e") != F.col("_a"), "changed")
    met = open_files(expected, "_e").join(open_files(actual, "_a"), "file", "full")
    return met.select("file", state.alias("state")).filter("state is not null")
