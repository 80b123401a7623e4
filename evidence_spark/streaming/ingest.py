"""Documents that arrive as files: one keyed state for each takes it from pending to ready or failed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidence_spark.functions.chunks import chunk_flat
from evidence_spark.functions.text import clean_text
from evidence_spark.functions.vectors import hash_embed

#: States in which a document waits for the report of a step.
WAITING = ("parsing", "vectorizing")
#: What is told of a document, in the order in which what comes together is taken: reports of steps, then new files.
KINDS = ("parsed", "vectorized", "error", "submitted")

EVENT = "doc_id long, kind string, attempt int, n int, place long, message string, text string"
STATE = "status string, attempt int, n int"
#: The states of the documents of a bucket, and until when (in milliseconds) those that wait will do so.
BUCKET = "ids array<long>, status array<string>, attempt array<int>, n array<int>, due array<long>"
#: Buckets into which documents are dealt by the hash of their ids; a checkpoint keeps to the number it began with.
BUCKETS = 1024
MOVE = "doc_id long, step int, state string, attempt int, reason string, place long, text string"


class Held(NamedTuple):
    """A document's state: status (null: not seen yet), number of the attempt, and chunks of it."""

    status: str | None = None
    attempt: int = 0
    n: int = 0


def moves(held: Held, kind: str, attempt: int | None, n: int | None, message: str | None) -> tuple[Held, list[tuple[str, str | None]]]:
    """The state after an event, and the (state, reason) pairs on the way.

    A new or failed document starts a new attempt; files of others are repeats and change nothing. Reports of a step count only for the
    attempt and the state that wait for them, so late and repeated ones change nothing either.
    """
    if kind == "submitted":
        if held.status not in (None, "failed"):
            return held, []
        return Held("parsing", held.attempt + 1), [("pending", None), ("parsing", None)]
    if held.status not in WAITING or (attempt != held.attempt and kind != "timeout"):
        return held, []
    failed = None
    if kind == "timeout":
        failed = f"timed out in {held.status}"
    elif kind == "error":
        failed = message or "error"
    elif kind == "parsed" and held.status == "parsing":
        if n:
            return held._replace(status="vectorizing", n=n), [("vectorizing", None)]
        failed = "no text"
    elif kind == "vectorized" and held.status == "vectorizing":
        if n == held.n:
            return held._replace(status="ready"), [("ready", None)]
        failed = f"{n} vectors for {held.n} chunks"
    return (held._replace(status="failed"), [("failed", failed)]) if failed else (held, [])


def document_moves(events: DataFrame, patience: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """A stream of events (see EVENT) as a stream of moves (see MOVE); `step` orders the moves of a document.

    The state of a document is its status, three numbers and its id, whatever its texts. A keyed state holds the documents of a bucket, as
    a call for a key costs some ten milliseconds however little it holds; so a batch costs what its events and the states of their
    buckets cost. A document that waits longer than `patience` (processing time) for a report fails, and its next file starts
    a new attempt. A move to parsing carries the text; of several texts that come together the least is taken.
    """
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)
    names = ["doc_id", "kind", "attempt", "n", "message", "place", "text"]

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        ids, *held, due = state.get if state.exists else ([], [], [], [], [])
        docs = {d: (Held(*h), until) for d, *h, until in zip(ids, *held, due, strict=True)}
        told: dict[int | None, list[tuple]] = {}
        if not state.hasTimedOut:
            seen = pd.concat(list(frames))[names]
            whole = lambda c: [None if pd.isna(x) else int(x) for x in seen[c].tolist()]
            plain = lambda c: [x if isinstance(x, str) else None for x in seen[c].tolist()]
            for doc, *event in zip(*((plain if c in ("kind", "message", "text") else whole)(c) for c in names), strict=True):
                told.setdefault(doc, []).append(tuple(event))
            for found in told.values():
                found.sort(key=lambda e: (KINDS.index(e[0]), e[1] or 0, e[5] or ""))
        for doc, (_, until) in docs.items():  # reports that come with the end of the wait are in time
            if until is not None and until <= now and doc not in told:
                told[doc] = [("timeout", None, None, None, None, None)]
        rows: list[tuple] = []
        for doc, found in told.items():
            one, step = docs.get(doc, (Held(), None))[0], 0
            for kind, attempt, n, message, place, text in found:
                one, made = moves(one, kind, attempt, n, message)
                for name, reason in made:
                    rows.append((doc, step, name, one.attempt, reason, place, text if name == "parsing" else None))
                    step += 1
            if one.status:
                docs[doc] = (one, now + wait if one.status in WAITING else None)
        if docs:
            state.update((list(docs), *map(list, zip(*(h for h, _ in docs.values()), strict=True)), [until for _, until in docs.values()]))
            first = min((until for _, until in docs.values() if until is not None), default=None)
            if first is not None:
                state.setTimeoutDuration(max(1, first - now))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in MOVE.split(", ")]).astype({"doc_id": "Int64", "place": "Int64"})

    dealt = events.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(buckets))))
    return dealt.groupBy("bucket").applyInPandasWithState(advance, MOVE, BUCKET, "append", GroupStateTimeout.ProcessingTimeTimeout)


def ingest(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream of (doc_id, text) into out/chunks and out/status (ready, or failed for texts that are empty), all steps in one batch.

    A batch has its own folder, so one that runs again after a failure replaces its rows. The keyed state of a document lets it pass if it
    is new or has failed before; documents that are ready are skipped, and no folder of an earlier batch is read.
    """

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text = min(t or "" for frame in frames for t in frame["text"])
        held = Held(*state.get) if state.exists else Held()
        held, made = moves(held, "submitted", None, None, None)
        n = 0 if not text else 1
        for kind in ("parsed", "vectorized") if made else ():
            held, more = moves(held, kind, held.attempt, n, None)
            made += more
        if made:
            state.update(tuple(held))
            yield pd.DataFrame({"doc_id": [key[0]], "text": [text], "attempt": [held.attempt], "moves": [[name for name, _ in made]]})

    cleaned = docs.filter("doc_id is not null").select("doc_id", clean_text(F.coalesce("text", F.lit(""))).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, attempt int, moves array<string>"
    admitted = cleaned.groupBy("doc_id").applyInPandasWithState(admit, schema, STATE, "append", GroupStateTimeout.NoTimeout)

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("chunks", chunk_flat(F.col("text"))).persist()
        batch.select("doc_id", F.posexplode("chunks").alias("chunk_index", "chunk")).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        states = batch.select("doc_id", F.element_at("moves", -1).alias("state"), F.size("chunks").alias("n"), "attempt", "moves")
        states.write.mode("overwrite").parquet(f"{out}/status/batch={number}")
        batch.unpersist()

    return admitted.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_steps(docs: DataFrame, out: str, checkpoint: str, patience: str = "10 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Starts a stream of files (doc_id, text) into out/status, out/chunks and out/vectors; rows without ids are left out.

    Each batch moves documents by one step: what a step has done is reported in out/acks, which the stream itself reads. A batch
    writes folders of its own number, so one that runs again after a crash replaces its rows, and no report is counted twice;
    nothing that earlier batches wrote is read again but the chunks of documents whose vectors are due, from the batches that
    cut them. `trigger`: arguments of DataStreamWriter.trigger. By default a run is one batch (once), and reports are read by the next
    run; a query with timers has always another batch to run, so availableNow would not end. A text that is empty after cleaning fails; a failed document may come again.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], EVENT)
    empty.drop("text").write.mode("ignore").parquet(f"{out}/acks/begin")
    none = F.lit(None)
    files = docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit("submitted").alias("kind"), none.cast("int").alias("attempt"), none.cast("int").alias("n"),
        none.cast("long").alias("place"), none.cast("string").alias("message"), F.coalesce("text", F.lit("")).alias("text"),
    )
    acks = spark.readStream.schema(empty.drop("text").schema).option("recursiveFileLookup", "true").parquet(f"{out}/acks")
    told = files.unionByName(acks.withColumn("text", none.cast("string")))

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch = batch.persist()
        batch.drop("text", "place").write.mode("overwrite").parquet(f"{out}/status/batch={number}")
        due = {r["state"] for r in batch.filter(F.col("state").isin(*WAITING)).select("state").distinct().collect()}
        reports = []
        if "parsing" in due:
            cut = batch.filter("state = 'parsing'").select("doc_id", "attempt", chunk_flat(clean_text(F.col("text"))).alias("chunks"))
            cut.select("doc_id", "attempt", F.posexplode_outer("chunks").alias("chunk_index", "chunk")).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
            done = session.read.parquet(f"{out}/chunks/batch={number}").groupBy("doc_id", "attempt").agg(F.count("chunk").cast("int").alias("n"))
            reports.append(done.withColumns({"kind": F.lit("parsed"), "place": F.lit(number).cast("long")}))
        if "vectorizing" in due:
            wanted = batch.filter("state = 'vectorizing'").select("doc_id", "attempt", "place")
            places = [r["place"] for r in wanted.select("place").distinct().collect()]  # batches whose steps are under way
            chunks = session.read.parquet(*[f"{out}/chunks/batch={p}" for p in places]).filter("chunk is not null")
            made = chunks.join(wanted.select("doc_id", "attempt"), ["doc_id", "attempt"]).withColumn("vector", hash_embed(F.col("chunk")))
            made.drop("chunk").write.mode("overwrite").parquet(f"{out}/vectors/batch={number}")
            done = session.read.parquet(f"{out}/vectors/batch={number}").groupBy("doc_id", "attempt").agg(F.count(F.lit(1)).cast("int").alias("n"))
            reports.append(done.withColumns({"kind": F.lit("vectorized"), "place": none.cast("long")}))
        for i, report in enumerate(reports):
            report.withColumn("message", none.cast("string")).select("doc_id", "kind", "attempt", "n", "place", "message").write.mode("overwrite").parquet(f"{out}/acks/batch={number}/step={i}")
        batch.unpersist()

    moved = document_moves(told, patience)
    return moved.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"once": True})).start()


def latest_states(status: DataFrame) -> DataFrame:
    """(doc_id, state, attempt, reason): the last move of each document. `status`: what `ingest_steps` wrote to out/status, with its batch."""
    last = F.max(F.struct("batch", "step", "state", "attempt", "reason")).alias("m")
    return status.groupBy("doc_id").agg(last).select("doc_id", "m.state", "m.attempt", "m.reason")
