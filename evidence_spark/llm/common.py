"""Shared pieces: the shared folder, written tables, and word hashes of whole batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[^\x20\x09-\x0D]+"
_OWN: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_RECORDS: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a session in one local process (tests) gets a folder of its own; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="evidence-spark-"))
    return f"{folder.rstrip('/')}/evidence_spark/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again.

    A lost executor then costs one task of a later stage, never the work before this table. The table stays until
    `discard` or `clear`, as results read it lazily.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _RECORDS:
        paths.append(path)
    made = spark.read.schema(df.schema).parquet(path)
    _PATHS[made] = path
    return made


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Removes a written table that nothing will read again."""
    path = _PATHS.pop(table, None)
    if path:
        _remove(table.sparkSession, path)


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Appends to `paths` the tables written meanwhile, for `remove_paths` once the results that read them are stored."""
    _RECORDS.append(paths)
    try:
        yield
    finally:
        _RECORDS.pop()


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Removes the listed tables, if they are still there, and empties the list."""
    while paths:
        _remove(spark, paths.pop())


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application has written. Call it once the results that read them are stored."""
    _remove(spark, shared_folder(spark))


def word_count(text) -> F.Column:
    """Number of words `[^\\x20\\x09-\\x0D]+` of a string column; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long")


# --- word hashes, computed for a whole batch of texts at once -----------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SEGMENT = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_classes(punctuation: bool) -> np.ndarray:
    """Class of each byte: 0 white space, 1 word, 2 punctuation (only if asked for, else word too)."""
    kind = np.ones(256, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    if punctuation:
        kind[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 2
    return kind


def fold_table() -> np.ndarray:
    """Bytes with A-Z in lower case."""
    fold = np.arange(256, dtype=np.uint8)
    fold[0x41:0x5B] += 32
    return fold


def _segments(data: bytes, kind: np.ndarray) -> Iterator[bytes]:
    """Cuts at white space, so that a word is never cut; a word longer than a segment stays whole."""
    start = 0
    while len(data) - start > _SEGMENT:
        end = start + _SEGMENT
        gaps = np.flatnonzero(kind[np.frombuffer(data, np.uint8, end - start, start)] == 0)
        if len(gaps):
            end = start + int(gaps[-1]) + 1
        else:
            while end < len(data) and kind[data[end]]:
                end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def word_spans(arr: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of bytes of one class other than white space."""
    c = np.empty(len(arr) + 2, np.uint8)
    c[0] = c[-1] = 0
    c[1:-1] = kind[arr]
    edge = np.flatnonzero(c[1:] != c[:-1])
    at = c[edge + 1]
    return edge[at != 0], edge[c[edge] != 0]


def span_hashes(arr: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    p, inv = _tables(len(arr) + 1)
    run = np.empty(len(arr) + 1, np.uint64)
    run[0] = 0
    np.cumsum((arr.astype(np.uint64) + np.uint64(1)) * p[: len(arr)], out=run[1:])
    return mix64((run[ends] - run[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[str], kind: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, hashes of all their words in order)."""
    counts = np.zeros(len(texts), np.int64)
    parts: list[np.ndarray] = []
    group: list[bytes] = []
    members: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        arr = np.frombuffer(b"\n".join(group), np.uint8)
        starts, ends = word_spans(arr, kind)
        parts.append(span_hashes(arr if fold is None else fold[arr], starts, ends))
        offsets = np.cumsum([0] + [len(g) + 1 for g in group])
        np.add.at(counts, np.asarray(members), np.diff(np.searchsorted(starts, offsets)))
        group.clear()
        members.clear()
        size = 0

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        for piece in _segments(data, kind):
            if size + len(piece) > _SEGMENT:
                flush()
            group.append(piece)
            members.append(i)
            size += len(piece) + 1
    flush()
    return counts, np.concatenate(parts) if parts else np.empty(0, np.uint64)


def slices(texts: list[str | None], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of about `limit` characters each, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def held_out(doc_id) -> F.Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
