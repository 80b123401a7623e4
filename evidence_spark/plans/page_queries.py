"""Queries of pages of lists, search within scopes, bounded paths, and checks of plans, batches and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import structure, text
from evidence_spark.operators import lifecycle, operations, review, search, tables
from evidence_spark.plans.base import query, table
from evidence_spark.sources import files


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
 p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC) AS place, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer WHERE c_name LIKE '%7%')
 SELECT c_nationkey AS tenant, c_custkey AS user_id, place, total, coalesce(n, 0) AS documents FROM p LEFT JOIN n ON o_custkey = c_custkey WHERE place BETWEEN 3 AND 7""")
def ops_users_page(spark, d):
    users = table(spark, d, "customer").select(F.col("c_nationkey").alias("tenant"), F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"), F.col("c_acctbal").alias("created_at"))
    return operations.users_page(users, table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")), "tenant", "7", limit=5, offset=2)


@query("""WITH s AS (SELECT conv_id, conv_id % 5 AS owner, max(turn) AS updated, min(length(text)) AS created, max(role || ': ' || text) AS title FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
 l AS (SELECT conv_id, replace(coalesce(text, ''), chr(10), ' ') AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, substring(replace(coalesce(text, ''), chr(10), ' '), 1, 60) DESC) AS n FROM conversations WHERE role = 'assistant'),
 p AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY updated DESC NULLS LAST, created DESC NULLS LAST, conv_id DESC) AS place, count(*) OVER (PARTITION BY owner) AS total FROM s WHERE conv_id % 7 > 0 AND title LIKE '%e%')
 SELECT owner, p.conv_id AS session_id, place, total, coalesce(substring(said, 1, 60), '') AS preview FROM p LEFT JOIN l ON l.conv_id = p.conv_id AND n = 1 WHERE place <= 20""")
def ops_sessions_page(spark, d):
    rows = table(spark, d, "conversations").filter("conv_id is not null")
    sessions = rows.groupBy(F.col("conv_id").alias("session_id")).agg(
        F.max("turn").alias("updated_at"), F.min(F.length("text")).alias("created_at"), F.max(F.concat("role", F.lit(": "), "text")).alias("title")
    )
    sessions = sessions.withColumns({"owner": F.col("session_id") % 5, "is_deleted": F.col("session_id") % 7 == 0})
    said = rows.select(F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").alias("created_at"), F.lit(0).alias("id"))
    return operations.sessions_page(sessions, said, "owner", "e")


@query("""WITH c AS (SELECT doc_id, doc_id || ':' || i AS chunk_id, regexp_extract_all(replace(lower(line), 'ß', 'ss'), '[a-z0-9]+') AS tokens
   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
 q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+')) AS term FROM benchmark),
 s AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark JOIN documents ON doc_id % 40 = item_id % 40),
 st AS (SELECT query_id, count(*) AS n, avg(len(tokens)) AS mean FROM s JOIN c USING (doc_id) GROUP BY query_id),
 t AS (SELECT doc_id, chunk_id, len(tokens) AS size, unnest(tokens) AS term FROM c),
 tf AS (SELECT doc_id, chunk_id, term, count(*) AS tf, any_value(size) AS size FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, chunk_id, term),
 m AS (SELECT query_id, chunk_id, term, tf, size FROM tf JOIN s USING (doc_id) JOIN q USING (query_id, term)),
 f AS (SELECT query_id, term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM m JOIN st USING (query_id) GROUP BY query_id, term)
 SELECT query_id, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM m JOIN f USING (query_id, term) JOIN st USING (query_id) GROUP BY query_id, chunk_id""")
def lex_bm25_scoped(spark, d):
    """Each passage of `benchmark` asks the lines of the documents whose id leaves the same rest."""
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    chunks = lines.select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("chunk_id"), text.words(F.col("line")).alias("tokens"))
    q = asked.select(F.col("item_id").alias("query_id"), text.words(F.col("text")).alias("terms"))
    scope = asked.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("rest")).join(docs.select("doc_id", (F.col("doc_id") % 40).alias("rest")), "rest")
    return search.bm25_scoped(q, chunks, scope).withColumn("score", F.round("score", 6))


@query("""WITH e AS (SELECT o_orderkey AS rid, 'c' || o_custkey AS a, o_orderpriority AS b FROM orders), n AS (SELECT rid, a, b FROM e UNION ALL SELECT rid, b, a FROM e),
 x AS (SELECT a AS seed, b AS mid, rid AS first FROM n WHERE a IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 100 = 0)),
 p AS (SELECT seed, 1 AS hops, NULL AS mid, mid AS node, first, NULL AS second FROM x UNION ALL SELECT seed, 2, mid, b, first, rid FROM x JOIN n ON a = mid WHERE b <> seed AND rid <> first),
 r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, first, second NULLS FIRST, node) AS place FROM p)
 SELECT seed, place, mid, node, first, second FROM r WHERE place <= 20""")
def grf_explore_paths(spark, d):
    """Every hundredth customer; five priorities are the hot nodes in the middle."""
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("relation_id"), name("o_custkey").alias("a"), F.col("o_orderpriority").alias("b"))
    return tables.explore_paths(edges, table(spark, d, "customer").filter("c_custkey % 100 = 0").select(name("c_custkey").alias("seed")))


@query("""WITH q AS (SELECT o_orderkey AS question_id, unnest(['flat', 'structured']) AS variant FROM orders WHERE o_orderkey % 9 > 0),
 h AS (SELECT l_orderkey AS question_id, unnest(['flat', 'structured']) AS variant, l_linenumber AS rank, l_partkey % 50 AS id, CAST(l_quantity AS BIGINT) AS size FROM lineitem WHERE l_suppkey % 7 > 0),
 s AS (SELECT question_id, variant, count(*) FILTER (rank <= 2) AS n, count(DISTINCT id) FILTER (rank <= 2) AS ids, coalesce(sum(size) FILTER (rank <= 2), 0) AS chars FROM h GROUP BY question_id, variant),
 f AS (SELECT coalesce(q.question_id, s.question_id) AS question_id, coalesce(q.variant, s.variant) AS variant,
   CASE WHEN q.question_id IS NULL THEN 'foreign' WHEN n IS NULL THEN 'missing' WHEN n <> 2 OR ids <> 2 THEN 'hits' WHEN chars > 60 THEN 'budget' END AS fault FROM q FULL JOIN s ON q.question_id = s.question_id AND q.variant = s.variant)
 SELECT * FROM f WHERE fault IS NOT NULL""")
def evl_paired_faults(spark, d):
    names = ("flat", "structured")
    hits = table(spark, d, "lineitem").filter("l_suppkey % 7 > 0").select(
        F.col("l_orderkey").alias("question_id"), F.explode(F.array(*map(F.lit, names))).alias("variant"), F.col("l_linenumber").alias("rank"), (F.col("l_partkey") % 50).alias("id"),
        F.expr("repeat('x', cast(l_quantity as int))").alias("text"),
    )
    return review.paired_faults(table(spark, d, "orders").filter("o_orderkey % 9 > 0").select(F.col("o_orderkey").alias("question_id")), hits, names, 2, 60)


@query("""SELECT doc_id, 'block-' || (i) AS block_id, 'paragraph' AS kind, block AS text, (i - 1) // 5 + 1 AS page_start, (i - 1) // 5 + 1 AS page_end
 FROM (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS block FROM documents)""")
def txt_flat_block_rows(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return structure.flat_blocks(lines.select("doc_id", (F.col("n") + 1).alias("place"), (F.floor(F.col("n") / 5) + 1).alias("page"), "text"))


@query("""WITH b AS (SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1) // 5 + 1 AS page, unnest(string_split(text, chr(10))) AS block FROM documents),
 p AS (SELECT doc_id, page, sum(length(block)) AS n FROM b GROUP BY doc_id, page)
 SELECT doc_id, count(*) AS pages, count(*) FILTER (n < 40) AS low_pages, bool_or(n < 40) AS used_ocr, CASE WHEN sum(n) = 0 THEN 'no text' END AS fault FROM p GROUP BY doc_id""")
def txt_ocr_flags(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "block"))
    pages = lines.groupBy("doc_id", F.floor(F.col("n") / 5).alias("page")).agg(F.array_join(F.collect_list("block"), "").alias("text"))
    return structure.low_text_pages(pages)


@query("""SELECT source, lang, count(*) AS records, count(DISTINCT doc_id) AS documents FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND 'src' || (l.doc_id % 3) = documents.source) GROUP BY source, lang""")
def src_count_index(spark, d):
    """Records by owner and version, without the owners that were dropped."""
    gone = table(spark, d, "labels").filter("toxic = 1").select(F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string")).alias("source")).distinct()
    return lifecycle.count_index(lifecycle.drop_owners(table(spark, d, "documents"), gone, "source"), ["source", "lang"])


@query("""WITH n AS (SELECT page_id // 12 AS batch, count(*) AS n FROM pages WHERE page_id % 5 > 0 OR page_id % 24 < 12 GROUP BY 1)
 SELECT page_id, CASE WHEN n > 10 THEN 'too many files' WHEN length(html) = 0 THEN 'empty' WHEN length(html) > 4000 THEN 'too large' END AS reason FROM pages JOIN n ON page_id // 12 = batch WHERE page_id % 5 > 0 OR page_id % 24 < 12""")
def src_admit_batches(spark, d):
    named = table(spark, d, "pages").filter("page_id % 5 > 0 or page_id % 24 < 12").select(
        "page_id", F.expr("page_id div 12").alias("batch"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.length("html").alias("size")
    )
    return files.admit_files(named, (".html",), 4000, max_per_batch=10).select("page_id", "reason")


@query("""WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') % 4 AS revision FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') % 4 > 0)
 SELECT event_id, (event_id % 4) <> coalesce(revision, 0) AS conflict FROM events LEFT JOIN p USING (user_id)""")
def idx_stale_switches(spark, d):
    """Events as requests to switch; an owner's revision is the rest of the number of its purchases by 4, so that both outcomes occur."""
    events = table(spark, d, "events").withColumnRenamed("user_id", "owner")
    pointers = events.groupBy("owner").agg((F.count_if(F.col("event_type") == "purchase") % 4).alias("revision")).filter("revision > 0")
    return lifecycle.stale_switches(events.select("event_id", "owner", (F.col("event_id") % 4).alias("expected")), pointers).select("event_id", "conflict")
