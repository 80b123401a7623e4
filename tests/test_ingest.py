"""Documents that pass through their states: crashes between them, late and repeated files, steps that never report."""

import time

import pytest

from evidence_spark.streaming import ingest as module
from evidence_spark.streaming.ingest import EVENT, Held, document_moves, ingest_steps, latest_states, moves


def final(spark, out):
    return {r.doc_id: (r.state, r.attempt, r.reason) for r in latest_states(spark.read.parquet(f"{out}/status")).collect()}


def test_moves_of_one_document():
    held, made = moves(Held(), "submitted", None, None, None)
    assert held == Held("parsing", 1, 0) and [m[0] for m in made] == ["pending", "parsing"]
    for kind, attempt, n in (("submitted", None, None), ("parsed", 2, 3), ("vectorized", 1, 3)):
        assert moves(held, kind, attempt, n, None) == (held, [])  # a repeat, another attempt's report, a report out of turn
    held, made = moves(held, "parsed", 1, 3, None)
    assert held == Held("vectorizing", 1, 3) and made == [("vectorizing", None)]
    assert moves(held, "parsed", 1, 3, None) == (held, [])
    assert moves(held, "vectorized", 1, 2, None)[1] == [("failed", "2 vectors for 3 chunks")]
    ready, made = moves(held, "vectorized", 1, 3, None)
    assert made == [("ready", None)] and moves(ready, "timeout", None, None, None) == moves(ready, "submitted", None, None, None) == (ready, [])
    failed, made = moves(held, "timeout", None, None, None)
    assert made == [("failed", "timed out in vectorizing")] and moves(failed, "submitted", None, None, None)[0] == Held("parsing", 2)
    assert moves(Held("parsing", 1), "error", 1, None, "no OCR")[1] == [("failed", "no OCR")]


@pytest.fixture
def files(spark, tmp_path):
    new = str(tmp_path / "new")

    def arrive(rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(new)

    def run(out, times=1):
        for _ in range(times):
            ingest_steps(spark.readStream.schema("doc_id long, text string").parquet(new), out, f"{out}/cp").awaitTermination()

    return arrive, run


def test_crash_between_states(spark, tmp_path, files, monkeypatch):
    arrive, run = files
    out = str(tmp_path / "out")
    arrive([(1, "one. " * 300), (2, None), (3, "three"), (None, "no id")])
    run(out)
    assert {d: s[0] for d, s in final(spark, out).items()} == {1: "parsing", 2: "parsing", 3: "parsing"}
    real = module.hash_embed

    def broken(text):
        raise RuntimeError("the executor is gone")

    monkeypatch.setattr(module, "hash_embed", broken)
    with pytest.raises(Exception, match="the executor is gone"):
        run(out)  # the status of the batch is written, its vectors and reports are not
    monkeypatch.setattr(module, "hash_embed", real)
    arrive([(1, "repeated"), (4, "late"), (4, "late"), (2, "now a text")])
    run(out, 5)
    assert final(spark, out) == {1: ("ready", 1, None), 2: ("ready", 2, None), 3: ("ready", 1, None), 4: ("ready", 1, None)}
    chunks, vectors = spark.read.parquet(f"{out}/chunks").filter("chunk is not null"), spark.read.parquet(f"{out}/vectors")
    key = ["doc_id", "attempt", "chunk_index"]
    assert sorted(map(tuple, chunks.select(key).collect())) == sorted(map(tuple, vectors.select(key).collect()))
    assert chunks.select(key).distinct().count() == chunks.count() > 4
    told = sorted((r.doc_id, r.attempt, r.state) for r in spark.read.parquet(f"{out}/status").collect())
    assert len(set(told)) == len(told)
    assert [s for d, a, s in told if d == 2 and a == 1] == ["failed", "parsing", "pending"]


def test_steps_that_never_report(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.createDataFrame([(1, "submitted", None, None, None, None, "a"), (2, "submitted", None, None, None, None, "b"), (2, "parsed", 1, 2, 0, None, None)], EVENT).coalesce(1).write.parquet(path)
    moved = document_moves(spark.readStream.schema(EVENT).parquet(path), "2 seconds")
    run = moved.writeStream.format("memory").queryName("moves").outputMode("append").start()

    def told():
        return sorted((r.doc_id, r.attempt, r.state, r.reason) for r in spark.table("moves").collect())

    try:
        end = time.time() + 60
        while sum(t[2] == "failed" for t in told()) < 2 and time.time() < end:
            time.sleep(0.5)
        # a report that comes after the timer is late; a new file starts the second attempt
        spark.createDataFrame([(1, "parsed", 1, 5, 0, None, None), (2, "submitted", None, None, None, None, "b")], EVENT).coalesce(1).write.mode("append").parquet(path)
        while len(told()) < 8 and time.time() < end:
            time.sleep(0.5)
        found = told()
    finally:
        run.stop()
    assert [t for t in found if t[0] == 1] == [(1, 1, "failed", "timed out in parsing"), (1, 1, "parsing", None), (1, 1, "pending", None)]
    assert {(t[1], t[2]) for t in found if t[0] == 2} >= {(1, "failed"), (2, "pending"), (2, "parsing")}


def test_documents_of_a_bucket_have_states_of_their_own(spark, tmp_path):
    """All documents in one bucket: some report in time, one never does, and a file of a third comes while the second waits."""
    path = str(tmp_path / "events")

    def arrive(rows):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)

    arrive([(2**60 + d, "submitted", None, None, None, None, "t") for d in range(40)])
    moved = document_moves(spark.readStream.schema(EVENT).parquet(path), "8 seconds", buckets=1)
    run = moved.writeStream.format("memory").queryName("bucket_moves").outputMode("append").start()

    def told():
        return sorted((r.doc_id - 2**60, r.attempt, r.step, r.state, r.reason) for r in spark.table("bucket_moves").collect())

    try:
        end = time.time() + 90
        while len(told()) < 80 and time.time() < end:
            time.sleep(0.5)
        arrive([(2**60 + d, kind, 1, 3, 0, None, None) for d in range(1, 40) for kind in ("vectorized", "parsed")])
        while sum(t[3] in ("ready", "failed") for t in told()) < 40 and time.time() < end:
            time.sleep(0.5)
            arrive([(2**60 + 1, "submitted", None, None, None, None, "again")])  # a repeat that keeps the bucket busy
        found = told()
    finally:
        run.stop()
    assert [t[3:] for t in found if t[0] == 0] == [("pending", None), ("parsing", None), ("failed", "timed out in parsing")] or [t[3:] for t in found if t[0] == 0] == [("failed", "timed out in parsing"), ("pending", None), ("parsing", None)]
    assert all(sorted(t[3] for t in found if t[0] == d) == ["parsing", "pending", "ready", "vectorizing"] for d in range(1, 40))


def test_calls_do_not_grow_with_documents(spark, tmp_path):
    """The state is keyed by buckets, so a bucket's documents cost one call."""
    path = str(tmp_path / "many")
    spark.range(500).selectExpr("id AS doc_id", "'submitted' AS kind", "CAST(NULL AS int) AS attempt", "CAST(NULL AS int) AS n", "CAST(NULL AS long) AS place", "CAST(NULL AS string) AS message", "'t' AS text").write.parquet(path)
    moved = document_moves(spark.readStream.schema(EVENT).parquet(path), buckets=8)
    run = moved.writeStream.format("memory").queryName("few_calls").outputMode("append").start()
    try:
        end = time.time() + 60
        while spark.table("few_calls").count() < 1000 and time.time() < end:
            time.sleep(0.5)
        states = max((op["numRowsTotal"] for p in run.recentProgress for op in p["stateOperators"]), default=0)
    finally:
        run.stop()
    assert 0 < states <= 8
