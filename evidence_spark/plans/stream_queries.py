"""Queries that run a stream over a given table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.plans.base import query, table
from evidence_spark.sources.scratch import scratch_folder
from evidence_spark.streaming import ingest


@query(r"""SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'failed' ELSE 'ready' END AS state,
 CASE WHEN doc_id % 9 = 0 OR trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'no text' END AS reason, 1 AS attempt, 1 AS pendings FROM documents""")
def st_ingest_steps(spark, d):
    """Documents arrive as files, every ninth without text and every fifth twice; three runs take them through all states."""
    out = scratch_folder(spark, "ingest")
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("text")).alias("text"))
    docs.write.parquet(f"{out}/files/first")
    docs.filter("doc_id % 5 = 0").write.parquet(f"{out}/files/again")
    for _ in ("files", "reports of chunks", "reports of vectors"):
        stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").parquet(f"{out}/files")
        ingest.ingest_steps(stream, out, f"{out}/checkpoint").awaitTermination()
    status = spark.read.parquet(f"{out}/status")
    pendings = status.filter("state = 'pending'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pendings"))
    return ingest.latest_states(status).join(pendings, "doc_id").select("doc_id", "state", "reason", "attempt", "pendings")
