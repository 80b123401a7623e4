"""Queries of readers: tables are written as files first, with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.plans.base import query, table
from evidence_spark.sources import files
from evidence_spark.sources.scratch import scratch_folder


@query("""WITH l AS (SELECT conv_id % 16 AS part, conv_id, turn, (conv_id + turn) % 11 = 0 AS blank, (conv_id + turn) % 7 = 0 AS broken,
   row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, turn, role, text) AS line FROM conversations),
 g AS (SELECT part, count(*) AS good FROM l WHERE NOT blank AND NOT broken GROUP BY part)
 SELECT part, line, 'broken ' || conv_id || chr(9) || turn AS value, good FROM l JOIN g USING (part) WHERE broken AND NOT blank""")
def src_read_jsonl(spark, d):
    """Turns as JSON lines in files by conversation, some lines blank or broken: each error with its line, and the rows read beside it."""
    out = scratch_folder(spark, "lines")
    line = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, " ").when(
        (F.col("conv_id") + F.col("turn")) % 7 == 0, F.concat(F.lit("broken "), F.col("conv_id").cast("string"), F.lit("\t"), F.col("turn").cast("string"))
    )
    rows = table(spark, d, "conversations").withColumn("part", F.col("conv_id") % 16)
    told = rows.select("part", "conv_id", "turn", "role", "text", F.coalesce(line, F.to_json(F.struct("conv_id", "turn", "text"))).alias("value"))
    ordered = told.repartition("part").sortWithinPartitions("part", "conv_id", "turn", "role", "text")
    ordered.select("part", "value").write.partitionBy("part").text(out)
    good, bad = files.read_jsonl_strict(spark, out, "conv_id long, turn long, text string")
    counts = good.groupBy((F.col("conv_id") % 16).alias("part")).agg(F.count(F.lit(1)).alias("good"))
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("long")
    return bad.select(part.alias("part"), "line", "value").join(counts, "part").select("part", "line", "value", "good")


@query("""WITH f AS (SELECT doc_id, source || '/' || lang || '/' || (doc_id % 20) || '/' || doc_id || '.txt' AS file FROM documents)
 SELECT file, CASE WHEN doc_id % 20 = 1 THEN 'missing' WHEN doc_id % 20 = 2 THEN 'changed' END AS state FROM f WHERE doc_id % 40 IN (1, 2)
 UNION ALL SELECT file || '.new', 'extra' FROM f WHERE doc_id % 40 = 3""")
def src_diff_manifest(spark, d):
    """Files in directories by source, language and the rest of their number; some are lost, changed or new, most directories are as they were."""
    n = F.col("doc_id")
    file = F.concat_ws("/", "source", "lang", (n % 20).cast("string"), F.concat(n.cast("string"), F.lit(".txt")))
    told = table(spark, d, "documents").select("doc_id", file.alias("file"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha256"))
    kept = told.filter(n % 40 != 1).withColumn("sha256", F.when(n % 40 == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    new = told.filter(n % 40 == 3).withColumn("file", F.concat("file", F.lit(".new")))
    return files.diff_manifest(told.drop("doc_id"), kept.unionByName(new).drop("doc_id"))


@query("""WITH f AS (SELECT doc_id % 256 AS part, string_agg(doc_id || ' ' || lang || ' é', chr(10) ORDER BY doc_id, lang) || chr(10) AS text FROM documents GROUP BY doc_id % 256)
 SELECT part, octet_length(encode(text)) AS size, text FROM f""")
def src_read_text_files(spark, d):
    """Lines of documents in text files by the rest of their number, read back as whole files; files of other kinds are left out."""
    out = scratch_folder(spark, "texts")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(" "), "lang", F.lit(" é"))
    rows = table(spark, d, "documents").select((F.col("doc_id") % 256).alias("part"), "doc_id", "lang", line.alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id", "lang").select("part", "value").write.partitionBy("part").text(out)
    rows.select("value").write.mode("append").option("compression", "gzip").text(f"{out}/packed")
    found = files.read_text_files(spark, out)
    return found.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part"), "size", "text")


@query("""SELECT count(*) AS told, count(*) AS read, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT doc_id) AS ids FROM documents""")
def src_write_jsonl(spark, d):
    """The number of lines that writing tells, and what a strict reader finds in them."""
    out = scratch_folder(spark, "jsonl")
    told = files.write_jsonl(table(spark, d, "documents").select("doc_id", "text"), out)
    rows, _ = files.read_jsonl_strict(spark, out, "doc_id long, text string")
    return rows.agg(F.count(F.lit(1)).alias("read"), F.sum(F.length("text")).alias("chars"), F.count_distinct("doc_id").alias("ids")).select(F.lit(told).cast("long").alias("told"), "read", "chars", "ids")
