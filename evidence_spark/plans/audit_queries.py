"""Queries of audits and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.operators import audits, comparisons, conditions
from evidence_spark.plans.base import query, table
from evidence_spark.plans.evidence_queries import _LABEL, labels_asked, nearest


def _text(c: str):
    return F.array_join(c, ",").alias(c)


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_quantity <= 10 THEN 'empty span' WHEN l_suppkey % 7 = 0 THEN 'one page' WHEN l_suppkey % 4 = 0 THEN 'page order' WHEN l_returnflag = 'A' AND l_suppkey % 11 = 0 THEN 'parent' WHEN l_tax > 0.05 THEN 'page range' END AS fault FROM lineitem""")
def val_spans(spark, d):
    p, k, parent = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_returnflag") == "A"
    span = lambda *cs: F.struct(*[c.alias(n) for c, n in zip(cs, ("char_start", "char_end", "page_start", "page_end"))])
    spans = F.array(span(F.lit(10.0), F.col("l_quantity"), p, F.when(k % 7 > 0, F.when(k % 4 == 0, p - 1).otherwise(p))), span(F.lit(100.0), F.lit(150.0), p + 1, p + 1))
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", parent.alias("is_parent"), F.when(~parent | (k % 11 == 0), "x").alias("parent_id"), p.alias("page_start"), F.when(F.col("l_tax") > 0.05, p + 2).otherwise(p + 1).alias("page_end"), spans.alias("spans")
    )
    return audits.span_faults(rows).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "fault")


@query("""WITH q AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'fact' WHEN 'O' THEN 'comparison' ELSE 'unanswerable' END AS c FROM orders),
 p AS (SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 AND count(*) OVER (PARTITION BY p_size % 9 = 0) > 1 THEN 'duplicate file' WHEN p_size % 5 = 0 THEN 'url' WHEN p_size % 7 = 0 THEN 'file name' WHEN p_size % 11 = 0 THEN 'digest' WHEN p_size <= 3 THEN 'pages' END AS fault FROM part)
 SELECT 'paper' AS part, CAST(id AS VARCHAR) AS id, fault FROM p WHERE fault IS NOT NULL
 UNION ALL SELECT 'question', CAST(id AS VARCHAR), 'gold' FROM q WHERE (c = 'unanswerable') <> (id NOT IN (SELECT l_orderkey FROM lineitem))
 UNION ALL SELECT 'gold', CAST(l_orderkey AS VARCHAR), CASE WHEN l_linenumber = 7 THEN 'unknown document' ELSE 'anchor' END FROM lineitem WHERE l_linenumber = 7 OR l_linenumber < 3
 UNION ALL SELECT 'category', c, 'mix' FROM (VALUES ('fact', 8), ('comparison', 6), ('multihop', 2), ('unanswerable', 4)) v(c, n) WHERE n <> (SELECT count(*) FROM q WHERE q.c = v.c)""")
def val_pilot(spark, d):
    size, name = F.col("p_size"), F.concat(F.lit("f_"), "p_partkey")
    papers = table(spark, d, "part").select(
        F.col("p_partkey").alias("doc_id"), F.when(size % 5 == 0, "http://x").otherwise("https://x").alias("url"),
        F.when(size % 9 == 0, "same.pdf").when(size % 7 == 0, F.concat(name, F.lit(".txt"))).otherwise(F.concat(name, F.lit(".pdf"))).alias("file_name"), F.when(size % 11 == 0, "x").otherwise(F.sha2("p_name", 256)).alias("sha256"), (size - 3).alias("pages"),
    )
    status = F.col("o_orderstatus")
    questions = table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.when(status == "F", "fact").when(status == "O", "comparison").otherwise("unanswerable").alias("category"))
    n = F.col("l_linenumber")
    gold = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.when(n == 7, -1).otherwise(F.col("l_partkey")).alias("doc_id"), n.alias("page"), F.expr("repeat('a', l_linenumber)").alias("anchor"))
    return audits.pilot_faults(papers, questions, gold, {"fact": 8, "comparison": 6, "multihop": 2, "unanswerable": 4})


@query("""WITH s AS (SELECT k, max(n) > 1 AS twice FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey) GROUP BY k), t AS (SELECT k, max(n) > 1 AS twice FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY k)
 SELECT * FROM (SELECT o_orderkey AS task_id, concat_ws(',', CASE WHEN s.twice THEN 'duplicate source' END, CASE WHEN t.twice THEN 'duplicate step' END, CASE WHEN o_orderkey % 12 > 10 THEN 'model calls' END, CASE WHEN o_custkey % 15 > 12 THEN 'tool calls' END) AS faults FROM orders LEFT JOIN s ON s.k = o_orderkey LEFT JOIN t ON t.k = o_orderkey) WHERE faults <> ''""")
def val_tasks(spark, d):
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 12).alias("model_calls"), F.lit(10).alias("max_model_calls"), (F.col("o_custkey") % 15).alias("tool_calls"), F.lit(12).alias("max_steps"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("step_id"))
    return audits.task_faults(tasks, rows, rows).select("task_id", _text("faults"))


@query("""SELECT doc_id, fault FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR text IS NULL THEN 'missing' WHEN doc_id % 6 = 0 THEN 'digest' WHEN doc_id % 5 = 0 THEN 'pages' WHEN doc_id % 7 = 0 THEN 'ocr' END AS fault FROM documents) WHERE fault IS NOT NULL""")
def val_sources(spark, d):
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    lines = F.split("text", "\n")
    papers = docs.select("doc_id", F.sha2(F.concat("text", F.when(k % 6 == 0, "x").otherwise("")), 256).alias("sha256"), (F.size(lines) + F.when(k % 5 == 0, 1).otherwise(0)).alias("pages"))
    files = docs.filter("doc_id % 9 > 0").select("doc_id", F.col("text").alias("content"), (k % 7 == 0).alias("ocr"))
    return audits.source_faults(papers, files, docs.select("doc_id", F.posexplode(lines).alias("page", "line")))


@query("""WITH i AS (SELECT a.doc_id, a.text AS t, length(a.text) AS len, substring(b.text, 11, 40) AS kid, CASE WHEN a.doc_id % 3 = 0 THEN 20 ELSE 0 END AS s, CASE WHEN a.doc_id % 2 = 0 THEN 120 ELSE length(a.text) END AS e, a.doc_id % 3 = 0 OR a.doc_id % 2 = 0 AS part FROM documents a LEFT JOIN documents b ON b.doc_id = CASE WHEN a.doc_id % 5 = 0 THEN a.doc_id + 1 ELSE a.doc_id END)
 SELECT * FROM (SELECT doc_id AS item_id, concat_ws(',', CASE WHEN doc_id % 11 = 0 THEN 'chunk' END, CASE WHEN doc_id % 7 = 0 THEN 'channel' END, CASE WHEN NOT (s < e AND e <= len) THEN 'window' END, CASE WHEN doc_id % 5 = 0 THEN 'foreign child' END,
 CASE WHEN part AND (length(kid) = 0 OR instr(t, kid) = 0 OR length(t) - length(replace(t, kid, '')) > length(kid) OR instr(t, kid) - 1 < s OR instr(t, kid) - 1 + length(kid) > e) THEN 'lost child' END) AS faults FROM i) WHERE faults <> ''""")
def fus_verify_evidence(spark, d):
    docs, k = table(spark, d, "documents").select("doc_id", "text"), F.col("doc_id")
    own = F.concat(F.lit("p"), "doc_id")
    kid = docs.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), "doc_id", F.lit(False).alias("is_parent"), own.alias("parent_id"), F.substring("text", 11, 40).alias("text"))
    chunks = docs.select(own.alias("chunk_id"), "doc_id", F.lit(True).alias("is_parent"), F.lit(None).cast("string").alias("parent_id"), "text").unionByName(kid)
    items = docs.select(
        k.alias("item_id"), own.alias("chunk_id"), F.when(k % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"), F.when(k % 3 == 0, 20).otherwise(0).alias("context_start"), F.when(k % 2 == 0, 120).alias("context_end"),
        F.array(F.concat(F.lit("c"), F.when(k % 5 == 0, k + 1).otherwise(k))).alias("matched"), F.array(F.lit("vector"), F.when(k % 7 == 0, "web").otherwise("graph")).alias("channels"),
    )
    return audits.evidence_faults(items, chunks).select("item_id", _text("faults"))


@query("""WITH g AS (SELECT l_orderkey AS a, l_linenumber AS c, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), x AS (SELECT *, s % 13 > 0 AS cl, p % 19 > 0 AS ve, c % 2 = 0 AND p % 7 > 0 AS au, p % 6 > 0 AS co, s % 7 > 0 AS ch, p % 19 > 0 AND s % 3 > 0 AS good, a % 2 = 0 AS audited, a % 3 = 0 AS ctx FROM g),
 r AS (SELECT a, count(*) FILTER (cl) AS claims, count(*) FILTER (good) AS good, bool_or(cl <> ve) AS r1, bool_or(au AND (NOT cl OR NOT audited)) AS r2, bool_or(co AND (NOT cl OR NOT ctx)) AS r3, bool_or(ch AND NOT ve) AS r4, bool_or(good AND audited AND cl AND c % 2 = 0 AND NOT (au AND s % 4 > 0)) AS r5,
 bool_or(good AND ctx AND NOT co) AS r6, bool_or(good AND NOT (ch AND p % 9 > 0)) AS r7, bool_or(cl AND s % 11 = 0) AS r8, bool_or(cl AND p % 17 = 0) AS r9, bool_or(good AND cl AND p % 5 = 0) AS r10 FROM x GROUP BY a)
 SELECT * FROM (SELECT o_orderkey AS artifact_id, concat_ws(',', CASE WHEN coalesce(claims, 0) <> o_orderkey % 6 OR coalesce(good, 0) <> o_orderkey % 4 THEN 'counters' END, CASE WHEN r1 THEN 'coverage' END, CASE WHEN r2 THEN 'audit scope' END, CASE WHEN r3 THEN 'context scope' END, CASE WHEN r4 THEN 'assessment scope' END,
 CASE WHEN r5 THEN 'condition' END, CASE WHEN r6 THEN 'context' END, CASE WHEN r7 THEN 'assessment' END, CASE WHEN r8 THEN 'slice' END, CASE WHEN r9 THEN 'scope' END, CASE WHEN r10 THEN 'numbers' END) AS problems FROM orders LEFT JOIN r ON a = o_orderkey) WHERE problems <> ''""")
def clm_publishable(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("artifact_id"), F.col("l_linenumber").alias("claim_id")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    key, s, p, c, k = ("artifact_id", "claim_id"), F.col("s"), F.col("p"), F.col("claim_id"), F.col("o_orderkey")
    claims = g.filter("s % 13 > 0").select(*key, F.when(c % 2 == 0, "result").otherwise("method").alias("facet"), (s % 11 > 0).alias("exact"), (p % 17 > 0).alias("in_scope"), (p % 5 > 0).alias("numeric"))
    verdicts = g.filter("p % 19 > 0").select(*key, F.when(s % 3 > 0, "supported").otherwise("insufficient").alias("status"))
    looked = g.filter("claim_id % 2 = 0 and p % 7 > 0").select(*key, F.when(s % 4 > 0, "passed").otherwise("missing").alias("status"))
    checks = g.filter("s % 7 > 0").select(*key, F.lit("supported").alias("status"), (p % 9 > 0).alias("handles"))
    reports = table(spark, d, "orders").select(k.alias("artifact_id"), (k % 6).alias("total"), (k % 4).alias("supported"), (k % 2 == 0).alias("audited"), (k % 3 == 0).alias("with_context"))
    return audits.publish_faults(reports, claims, verdicts, looked, g.filter("p % 6 > 0").select(*key), checks).select("artifact_id", _text("problems"))


_FACETS = ["method", "dataset", "result", "limitation"]


@query("""WITH c AS (SELECT doc_id // 8 AS artifact_id, doc_id, (doc_id + j) % 4 AS f, (n_chars + j) % 3 AS s, 's' || (n_chars + j) AS t FROM documents, (SELECT unnest([0, 1]) AS j)),
 g AS (SELECT a.artifact_id, a.doc_id, k AS f, CASE s WHEN 0 THEN 'supported' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'conflict' ELSE 'missing' END AS s, t FROM (SELECT DISTINCT artifact_id, doc_id FROM c) a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) LEFT JOIN c ON c.doc_id = a.doc_id AND c.f = k),
 n AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, s ORDER BY doc_id, f) AS n FROM g),
 r AS (SELECT artifact_id, doc_id, '| d' || doc_id || ' | ' || string_agg(CASE s WHEN 'supported' THEN t || ' [' || n || ']' WHEN 'missing' THEN '证据未检出' WHEN 'uncertain' THEN '待核验' ELSE '证据冲突' END, ' | ' ORDER BY f) || ' |' AS line, string_agg(doc_id || ':' || ['method', 'dataset', 'result', 'limitation'][f + 1] || ':' || s, ',' ORDER BY f) FILTER (s <> 'supported') AS gaps FROM n GROUP BY 1, 2)
 SELECT artifact_id, 'partial' AS status, string_agg(gaps, ',' ORDER BY doc_id) AS gaps, string_agg(line, chr(10) ORDER BY doc_id) AS markdown FROM r GROUP BY 1""")
def clm_render_comparison(spark, d):
    cells = table(spark, d, "documents").select("doc_id", "n_chars", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    n = F.col("n_chars") + F.col("j")
    cells = cells.select(
        F.floor(F.col("doc_id") / 8).alias("artifact_id"), "doc_id", F.concat(F.lit("d"), "doc_id").alias("title"), F.get(F.array(*map(F.lit, _FACETS)), ((F.col("doc_id") + F.col("j")) % 4).cast("int")).alias("facet"),
        F.when(n % 3 == 0, "supported").when(n % 3 == 1, "uncertain").otherwise("conflict").alias("state"), F.concat(F.lit("s"), n).alias("statement"),
    )
    return audits.render_comparison(cells, _FACETS, {"missing": "证据未检出", "uncertain": "待核验", "conflict": "证据冲突"}).select("artifact_id", "status", _text("gaps"), "markdown")


@query("""SELECT o_orderkey AS slot, 'q' || o_custkey AS question_id, CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 8 = 0 THEN 'other' ELSE o_orderstatus END AS variant, CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 9 = 0 OR o_orderkey % 8 = 0 OR o_orderkey % 7 = 0 THEN 'mismatch' WHEN o_orderkey % 3 > 0 THEN 'template' ELSE 'failed' END AS state,
 CASE WHEN o_orderkey % 10 > 0 AND o_orderkey % 9 > 0 AND o_orderkey % 8 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 3 > 0 THEN 'a' || o_orderkey END AS text FROM orders WHERE o_orderkey % 90 > 0""")
def evl_annotation_rows(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    common = [k.alias("slot"), F.concat(F.lit("q"), "o_custkey").alias("question_id")]
    plan = o.filter("o_orderkey % 10 > 0").select(*common, F.col("o_orderstatus").alias("variant"), F.col("o_orderpriority").alias("request"))
    outcomes = o.filter("o_orderkey % 9 > 0").select(
        *common, F.when(k % 8 == 0, "other").otherwise(F.col("o_orderstatus")).alias("variant"), F.when(k % 7 == 0, "x").otherwise(F.sha2("o_orderpriority", 256)).alias("request_sha256"), F.when(k % 3 > 0, "succeeded").otherwise("failed").alias("status"), F.concat(F.lit("a"), k).alias("answer")
    )
    return audits.annotation_rows(plan, outcomes).select("slot", "question_id", "variant", "state", "text")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS a, l_linenumber AS c FROM lineitem WHERE l_linenumber % 2 = 1),
 au AS (SELECT l_orderkey AS a, l_linenumber AS c, count(*) AS n, max(['passed', 'missing', 'unknown', 'not_applicable'][l_suppkey % 4 + 1]) AS st FROM lineitem WHERE l_suppkey % 5 > 0 AND (l_partkey % 2 = 0) = (l_orderkey % 2 = 0) GROUP BY 1, 2),
 ve AS (SELECT l_orderkey AS a, l_linenumber AS c, count(*) AS n, bool_or(l_partkey % 3 = 0) AS b FROM lineitem WHERE l_partkey % 7 > 0 AND (l_suppkey % 2 = 0) = (l_orderkey % 2 = 0) GROUP BY 1, 2),
 f AS (SELECT coalesce(r.a, au.a, ve.a) AS a, r.a IS NOT NULL AS res, au.n AS an, st, ve.n AS vn, b FROM r FULL JOIN au ON r.a = au.a AND r.c = au.c FULL JOIN ve ON ve.a = coalesce(r.a, au.a) AND ve.c = coalesce(r.c, au.c))
 SELECT o_orderkey AS task_id, count(a) FILTER (res) AS result_claims, count(an) FILTER (res) AS audited, count(an) FILTER (res AND st = 'passed') AS passed, count(an) FILTER (res AND st = 'missing') AS missing, count(an) FILTER (res AND st = 'unknown') AS unknown, count(an) FILTER (res AND st = 'not_applicable') AS not_applicable,
 count(a) FILTER (res AND b) AS blocked, count(a) FILTER (res AND an IS NULL) AS unaudited, count(a) FILTER (res AND vn IS NULL) AS pending, count(a) FILTER (an > 1 OR vn > 1 OR (an IS NOT NULL AND NOT res)) AS faults FROM orders LEFT JOIN f ON a = o_orderkey GROUP BY 1""")
def evl_condition_summary(spark, d):
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 2 == 0).alias("merged"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("claim_id"), "l_suppkey", "l_partkey")
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    claims = rows.select("task_id", "claim_id", F.when(F.col("claim_id") % 2 == 1, "result").otherwise("method").alias("facet"))
    looked = rows.filter(s % 5 > 0).select("task_id", "claim_id", (p % 2 == 0).alias("merged"), F.get(F.array(*map(F.lit, audits.STATUSES)), (s % 4).cast("int")).alias("status"))
    judged = rows.filter(p % 7 > 0).select("task_id", "claim_id", (s % 2 == 0).alias("merged"), F.when(p % 3 == 0, "result_condition_missing").otherwise("ok").alias("reason"))
    return audits.condition_summary(tasks, claims, looked, judged)


@query("""SELECT version_id, fault FROM (SELECT doc_id AS version_id, CASE WHEN doc_id % 19 = 0 THEN 'digest' WHEN doc_id % 17 = 0 THEN 'identity' WHEN doc_id % 23 = 0 THEN 'coverage' WHEN doc_id % 13 = 0 THEN 'member' WHEN doc_id % 11 = 0 THEN 'member digest' WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'members' END AS fault FROM documents) WHERE fault IS NOT NULL""")
def idx_manifest_faults(spark, d):
    k = F.col("doc_id")
    first, second = F.concat(F.lit("d"), k), F.concat(F.lit("e"), k)
    docs = F.when(k % 23 == 0, F.create_map(first, F.lit("c"))).otherwise(F.create_map(first, F.lit("c"), second, F.lit("c")))

    def member(build, doc, space):
        sha = F.when(k % 11 == 0, "short").otherwise(F.sha2("lang", 256))
        return F.struct(build.alias("build_id"), doc.alias("document_id"), F.lit("c").alias("chunk_set_id"), space.alias("namespace"), sha.alias("records_sha256"))

    members = F.array(member(F.lit("b1"), first, F.lit("n1")), member(F.when(k % 5 == 0, "b1").otherwise("b2"), F.when(k % 7 == 0, F.lit("z")).otherwise(second), F.when(k % 13 == 0, "").otherwise("n2")))
    body = F.to_json(F.struct(F.lit("user-index-v1").alias("schema"), F.when(k % 17 == 0, k + 1).otherwise(k).alias("user_id"), docs.alias("documents"), members.alias("members")))
    rows = table(spark, d, "documents").select(k.alias("version_id"), k.alias("user_id"), body.alias("manifest_json"), F.when(k % 19 == 0, "x").otherwise(F.sha2(body, 256)).alias("manifest_sha256"))
    return audits.manifest_faults(rows)


# --- comparisons


@query()
def chk_compare_chunkers(spark, d):
    blocks = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda t, i: F.struct(i.alias("block_no"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), t.alias("text"), (i + 1).alias("page")))
    return comparisons.compare_chunkers(table(spark, d, "documents").select("doc_id", blocks.alias("blocks")))


@query(_LABEL + """, p AS (SELECT query_id, id, 'near' AS policy, row_number() OVER (PARTITION BY query_id ORDER BY far, id) AS rank FROM h UNION ALL SELECT query_id, id, 'far', row_number() OVER (PARTITION BY query_id ORDER BY far DESC, id) FROM h),
 w AS (SELECT vec_id AS id, context, vec_id % 9 AS doc_id, vec_id % 20 * 10 - wide AS s, vec_id % 20 * 10 + 30 + wide AS e FROM embeddings, (VALUES ('child', 0), ('window', 10)) v(context, wide)),
 g AS (SELECT DISTINCT query_id, query_id % 9 AS doc_id, query_id * 7 % 100 AS lo, query_id * 7 % 100 + 20 AS hi FROM h), top AS (SELECT p.query_id, policy, w.* FROM p JOIN w USING (id) WHERE rank <= 10),
 c AS (SELECT policy, context, g.query_id, (SELECT count(DISTINCT x) FROM (SELECT unnest(range(greatest(s, lo), least(e, hi))) AS x FROM top t WHERE t.query_id = g.query_id AND t.policy = a.policy AND t.context = b.context AND t.doc_id = g.doc_id)) = 20 AS ok,
 (SELECT coalesce(sum(e - s), 0) FROM top t WHERE t.query_id = g.query_id AND t.policy = a.policy AND t.context = b.context) AS chars FROM g, (VALUES ('near'), ('far')) a(policy), (VALUES ('child'), ('window')) b(context))
 SELECT policy, context, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) FILTER (ok) AS complete, count(*) AS scored, round(avg(chars), 6) AS chars FROM c GROUP BY CUBE (policy, context)""")
def fus_retrieval_grid(spark, d, asked="vec_id % 100 = 0"):
    from evidence_spark.operators.search import best

    e, q = labels_asked(spark, d, asked)
    # one window for both ends: a join over a union of two windows failed where it was no broadcast
    ways = e.select("label", "vec_id", F.posexplode(F.array("vec_id", F.bitwise_not("vec_id"))).alias("way", "at"))
    ends = best(ways, ["label", "way"], ["at"], 11).select("label", F.col("vec_id").alias("chunk_id")).distinct()
    rows = nearest(spark, d, asked, 10).select("query_id", F.col("id").alias("chunk_id"), "far")
    away = q.join(ends, "label").filter("query_id != chunk_id").select("query_id", "chunk_id", F.abs(F.col("chunk_id") - F.col("query_id")).alias("far"))
    hits = best(rows, ["query_id"], ["far", "chunk_id"], 10).withColumn("policy", F.lit("near")).unionByName(best(away, ["query_id"], [F.desc("far"), "chunk_id"], 10).withColumn("policy", F.lit("far")))
    at, wide = F.col("vec_id") % 20 * 10, F.when(F.col("context") == "window", 10).otherwise(0)
    windows = table(spark, d, "embeddings").select("vec_id", F.explode(F.array(F.lit("child"), F.lit("window"))).alias("context"))
    windows = windows.select(F.col("vec_id").alias("chunk_id"), "context", (F.col("vec_id") % 9).alias("doc_id"), F.lit(1).alias("page"), (at - wide).alias("s_start"), (at + 30 + wide).alias("s_end"))
    lo = F.col("query_id") * 7 % 100
    gold = rows.select("query_id").distinct().select("query_id", (F.col("query_id") % 9).alias("doc_id"), F.lit(1).alias("page"), lo.alias("g_start"), (lo + 20).alias("g_end"))
    return comparisons.retrieval_grid(hits, windows, gold, ["near", "far"], ["child", "window"], 10)


@query("""SELECT o_orderkey AS claim_id, CASE o_orderkey % 6 WHEN 0 THEN 'passed' WHEN 1 THEN 'missing' WHEN 2 THEN 'unknown' WHEN 3 THEN 'unknown' ELSE 'not_applicable' END AS status,
 CASE o_orderkey % 6 WHEN 0 THEN 'all_explicit_row_assignments_retained' WHEN 1 THEN 'explicit_row_condition_omitted' WHEN 2 THEN 'condition_occurrence_not_affirmed' WHEN 3 THEN 'numeric_row_not_located' ELSE 'not_a_numeric_result' END AS reason, CASE WHEN o_orderkey % 6 = 1 THEN 'Corpus' || o_orderstatus ELSE '' END AS missing FROM orders""")
def clm_audit_conditions(spark, d):
    k, corpus = F.col("o_orderkey") % 6, F.concat(F.lit("Corpus"), "o_orderstatus")
    number = F.when(k == 3, F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey"))
    said = F.when(k == 5, "Net reaches many").otherwise(F.concat(F.lit("Net reaches "), number, F.when(k == 1, "").when(k == 2, F.concat(F.lit(" not on "), corpus)).otherwise(F.concat(F.lit(" on "), corpus))))
    quote = F.concat(F.lit("Net (X = "), corpus, F.lit(")\r\n  "), "o_custkey", F.lit("\r\n"), F.col("o_totalprice").cast("string"), F.lit("\r\nOther\r\n-1"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(k == 4, "method").otherwise("result").alias("facet"), said.alias("statement"), quote.alias("quote"))
    return conditions.audit_conditions(rows).select("claim_id", "audit.status", "audit.reason", F.array_join("audit.missing", ",").alias("missing"))
