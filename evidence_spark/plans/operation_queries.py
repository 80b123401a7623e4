"""Queries of lists, logs and the life of an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.operators import lifecycle, operations
from evidence_spark.plans.base import query, table

# --- lists and logs


@query("""SELECT o_custkey, o_orderkey, place, total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders WHERE o_orderstatus = 'F') WHERE place BETWEEN 3 AND 7""")
def ops_list_documents(spark, d):
    rows = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_orderdate")
    return operations.page(rows, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 5, 2).select("o_custkey", "o_orderkey", "place", "total")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, place, total FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS place, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem) WHERE place <= 10""")
def ops_list_tasks(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    order = [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_partkey")]
    return operations.page(rows, "l_suppkey", order, 10).select("l_suppkey", "l_orderkey", "l_linenumber", "place", "total")


@query("""SELECT log_id, ref_id, coalesce('file_' || c_custkey, '（已删除）') AS file_name, coalesce(nullif(err, ''), '未知错误') AS error FROM
 (SELECT event_id AS log_id, CASE WHEN event_id % 5 > 0 THEN user_id END AS ref_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN props END AS err FROM events WHERE event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 50)
 LEFT JOIN customer ON c_custkey = ref_id AND c_custkey % 2 = 0 WHERE ref_id IS NOT NULL""")
def ops_failed_queue(spark, d):
    error = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("props"))
    logs = table(spark, d, "events").select(
        F.col("event_id").alias("id"), "event_type", F.lit(False).alias("is_success"), F.when(F.col("event_id") % 5 > 0, F.col("user_id")).alias("ref_id"), error.alias("error_message"), F.col("ts").alias("created_at")
    )
    docs = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("file_"), F.col("c_custkey").cast("string")).alias("file_name"))
    return operations.failed_queue(logs, docs, ("error", "purchase")).drop("created_at")


@query("""SELECT request_id, email, c_custkey AS user_id FROM (SELECT event_id AS request_id, 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS email FROM events WHERE event_type = 'signup' AND value >= 50 ORDER BY ts DESC, event_id DESC LIMIT 200) LEFT JOIN customer ON c_name = email AND c_custkey % 3 > 0""")
def ops_reset_requests(spark, d):
    email = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    asked = table(spark, d, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("request_id"), email.alias("email"), (F.col("value") < 50).alias("handled"), F.col("ts").alias("created_at"))
    users = table(spark, d, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    return operations.reset_requests(asked, users)


@query("""SELECT conv_id, right(string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || '：' || substring(coalesce(text, ''), 1, 200), chr(10) ORDER BY turn), 600) AS history FROM conversations GROUP BY conv_id""")
def ops_history_text(spark, d):
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.lit(0).alias("id"), "role", F.col("text").alias("content"))
    return operations.history_text(m).withColumnRenamed("session_id", "conv_id")


@query("""SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN CAST(json_extract(props, '$.k') AS INT) END, 0) AS tokens_used, coalesce(CASE WHEN value > 100 THEN CAST(floor(value) AS BIGINT) END, 0) AS duration_ms, CAST(coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE event_type <> 'error' END, false) AS INT) AS is_success, substring(repeat(props, 60), 1, 512) AS error_message FROM events""")
def ops_normalize_usage(spark, d):
    raw = table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("int")).alias("tokens_used"),
        F.when(F.col("value") > 100, F.floor("value")).alias("duration_ms"),
        F.when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("event_type") != "error").alias("is_success"),
        F.repeat("props", 60).alias("error_message"),
    )
    return operations.normalize_usage(raw)


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, CAST(CASE WHEN event_id % 4 > 0 THEN json_extract(props, '$.k') END AS INT) AS k FROM events""")
def ops_message_log(spark, d):
    cited = F.when(F.col("event_id") % 4 > 0, F.col("props")).otherwise("no json")
    m = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), cited.alias("citations"))
    return operations.message_log(m, "k int").select(F.col("session_id").alias("user_id"), F.col("id").alias("event_id"), "place", F.col("citations.k").alias("k"))


# --- life of an index


@query("""SELECT CAST(doc_id AS VARCHAR) || ':0' AS id, embedding IS NOT NULL AS has_vector, '{"chunk_index":0,"doc_id":' || doc_id || ',"file_name":"doc_' || doc_id || '.txt","user_id":"' || source || '"}' AS metadata FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def idx_build_records(spark, d):
    docs = table(spark, d, "documents")
    chunks = docs.select("doc_id", F.lit(0).alias("chunk_index"), "text")
    named = docs.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.col("source").alias("user_id"))
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col("embedding").alias("vector"))
    return lifecycle.build_records(chunks, vecs, named).select("id", F.col("vector").isNotNull().alias("has_vector"), "metadata")


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN 'missing' WHEN vec_id % 10 = 1 THEN 'text' WHEN vec_id % 10 = 2 THEN 'dimension' WHEN vec_id % 10 = 3 THEN 'vector' END AS fault FROM embeddings WHERE vec_id % 10 < 4 UNION ALL SELECT -1 - vec_id, 'extra' FROM embeddings WHERE vec_id % 10 = 5""")
def idx_verify_records(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("text"), F.col("embedding").alias("vector"))
    digit = F.col("id") % 10
    moved = e.filter(digit != 0).select(
        "id",
        F.when(digit == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"),
        F.when(digit == 2, F.slice("vector", 1, 63)).when(digit == 3, F.transform("vector", lambda x: (x * 2 + 1).cast("float"))).otherwise(F.transform("vector", lambda x: (x * 1.000001).cast("float"))).alias("vector"),
    )
    return lifecycle.verify_records(e, moved.unionByName(e.filter(digit == 5).withColumn("id", -1 - F.col("id"))), 64)


_WORDS = ", ".join(f"CAST(sum(CAST('0x' || substring(r, {1 + 8 * i}, 8) AS UBIGINT)) AS VARCHAR) AS w{i}" for i in range(8))


@query(f"""WITH r AS (SELECT source, sha256(sha256(CAST(doc_id AS VARCHAR)) || '|' || coalesce(sha256(text), 'null') || '|' || coalesce(sha256(lang), 'null')) AS r FROM documents),
 s AS (SELECT source, count(*) AS records, {_WORDS} FROM r GROUP BY source)
 SELECT source, records, sha256(CAST(records AS VARCHAR) || ',' || {" || ',' || ".join(f"w{i}" for i in range(8))}) AS digest FROM s""")
def idx_manifest(spark, d):
    return lifecycle.index_manifest(table(spark, d, "documents"), "source", ["doc_id", "text", "lang"])


@query("""WITH b AS (SELECT l_orderkey AS doc_id, count(*) AS n, bool_and(l_returnflag <> 'R') AS ok FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 13 > 0 GROUP BY l_orderkey), o AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 17 > 0)
 SELECT coalesce(o.doc_id, b.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'unknown document' WHEN n IS NULL THEN 'no build' WHEN n > 1 THEN 'several builds' WHEN NOT ok THEN 'not validated' END AS problem FROM o FULL JOIN b ON o.doc_id = b.doc_id WHERE o.doc_id IS NULL OR n IS NULL OR n > 1 OR NOT ok""")
def idx_seal_version(spark, d):
    builds = table(spark, d, "lineitem").filter("l_linenumber = 1 and l_orderkey % 13 > 0").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("build_id"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("validated").alias("state"), F.lit("v1").alias("spec")
    )
    return lifecycle.seal_version(builds, table(spark, d, "orders").filter("o_orderkey % 17 > 0").select(F.col("o_orderkey").alias("doc_id")))


@query("""WITH n AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS documents FROM lineitem GROUP BY l_orderkey), p AS (SELECT o_custkey, max(o_orderkey) AS a FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
 SELECT o.o_custkey AS owner, o_orderkey AS version_id, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, coalesce(a = o_orderkey, false) AS active, coalesce(documents, 0) AS documents FROM orders o LEFT JOIN n ON l_orderkey = o_orderkey LEFT JOIN p ON p.o_custkey = o.o_custkey""")
def idx_list_versions(spark, d):
    o = table(spark, d, "orders")
    versions = o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("created_at"))
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_partkey").alias("doc_id"))
    pointers = o.filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("owner")).agg(F.max("o_orderkey").alias("active_id"))
    return lifecycle.list_versions(versions, members, pointers)


@query("""WITH r AS (SELECT user_id AS owner, row_number() OVER w AS n, lag(event_type) OVER w AS p, event_type AS version, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 e AS (SELECT owner, CASE WHEN value > 480 THEN n + 1 ELSE n END AS revision, p AS previous, version FROM r WHERE value > 5),
 c AS (SELECT *, revision = coalesce(lag(revision) OVER v, 0) + 1 AND previous IS NOT DISTINCT FROM lag(version) OVER v AS ok FROM (SELECT owner, revision, min(previous) AS previous, min(version) AS version FROM e GROUP BY owner, revision) WINDOW v AS (PARTITION BY owner ORDER BY revision))
 SELECT owner, arg_max(version, revision) AS active, max(revision) AS revision, bool_and(ok) AS valid FROM c GROUP BY owner""")
def idx_replay_switches(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(w)
    e = table(spark, d, "events").withColumns({"n": n, "previous": F.lag("event_type").over(w)}).filter("value > 5")
    e = e.groupBy(F.col("user_id").alias("owner"), F.when(F.col("value") > 480, F.col("n") + 1).otherwise(F.col("n")).alias("revision"))
    return lifecycle.replay_switches(e.agg(F.min("previous").alias("previous"), F.min("event_type").alias("version")))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 10 = 1 THEN 'removed' WHEN doc_id % 10 = 2 THEN 'content' ELSE 'renamed' END AS change FROM documents WHERE doc_id % 10 < 4""")
def idx_corpus_changes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file_name"), F.sha2("text", 256).alias("sha256"))
    digit = F.col("doc_id") % 10
    now = docs.filter(digit != 1).select("doc_id", F.when(digit == 3, "other").otherwise(F.col("file_name")).alias("file_name"), F.when(digit == 2, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    return lifecycle.corpus_changes(docs.filter(digit != 0), now)


@query("""SELECT o_orderkey AS doc_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')""")
def idx_pending_documents(spark, d):
    state = F.when(F.col("l_linestatus") == "F", "committed").otherwise("open")
    return lifecycle.pending_documents(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), state.alias("state")))


@query("""SELECT event_id AS request_id, CASE WHEN event_id = first_value(event_id) OVER w THEN 'first' WHEN event_type = first_value(event_type) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id, props ORDER BY ts, event_id)""")
def idx_resolve_requests(spark, d):
    asked = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("owner"), F.col("props").alias("key"), F.col("event_type").alias("fingerprint"), F.col("ts").alias("arrived"))
    return lifecycle.resolve_requests(asked).select("request_id", "outcome")


@query("""SELECT event_id AS task_id, count(*) FILTER (event_type IN ('click', 'view', 'error')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 8 AS admitted FROM events""")
def idx_admit_by_quota(spark, d):
    state = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("ready")
    tasks = table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("task_id"), state.alias("state"), F.col("ts").alias("created_at"))
    return lifecycle.admit_by_quota(tasks).select("task_id", "admitted")


@query("""SELECT vec_id FROM embeddings WHERE NOT (vec_id % 7 = 0 AND label < 5)""")
def src_delete_document(spark, d):
    index = table(spark, d, "embeddings").select("vec_id", "label")
    return lifecycle.delete_document(index, index.filter("vec_id % 7 = 0 and label < 5"), ["vec_id", "label"]).select("vec_id")
