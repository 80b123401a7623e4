"""Queries of checks, claims and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.operators import claims, review
from evidence_spark.plans.base import query, table

# --- quotes


def lines(spark, d):
    """Numbered lines of documents that are not blank."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "block"))
    return rows.filter("trim(block) <> ''").withColumn("page", (F.floor(F.col("block_no") / 5) + 1).cast("int"))


@query(r"""WITH b AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_no, unnest(string_split(text, chr(10))) AS t FROM documents),
 q AS (SELECT doc_id, text, block_no, array_to_string(list_transform(list_filter(regexp_split_to_array(substring(t, 1, 60), '\s+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '\s+') AS p FROM b WHERE trim(t) <> ''),
 f AS (SELECT doc_id, block_no, p, len(regexp_extract_all(text, p)) AS n, length(regexp_extract(text, '(?s)^(.*?)(' || p || ')', 1)) AS before, length(regexp_extract(text, p)) AS found FROM q)
 SELECT doc_id, block_no, CASE WHEN n = 1 AND p <> '' THEN before END AS char_start, CASE WHEN n = 1 AND p <> '' THEN before + found END AS char_end,
 CASE WHEN p = '' OR n = 0 THEN 'quote_not_found' WHEN n > 1 THEN 'ambiguous_quote' END AS reason FROM f""")
def cit_locate_quote(spark, d):
    """The first words of each line, with other white space, in the whole text, which is read once for all its lines."""
    split = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("long").alias("block_no"), x.alias("block")))
    rows = table(spark, d, "documents").select("doc_id", "text", F.filter(split, lambda x: F.trim(x["block"]) != "").alias("b"))
    quotes = F.transform("b", lambda x: F.replace(F.substring(x["block"], 1, 60), F.lit(" "), F.lit("\n  ")))
    found = rows.select("doc_id", F.explode(F.arrays_zip(F.col("b.block_no").alias("block_no"), claims.locate_quotes(quotes, F.col("text")).alias("x"))).alias("z"))
    return found.select("doc_id", "z.block_no", "z.x.*")


@query()
def cit_locate_anchors(spark, d):
    pages = lines(spark, d).select("doc_id", F.col("block_no").alias("page"), F.col("block").alias("text"))
    gold = pages.select(F.col("doc_id").alias("anchor_id"), "doc_id", "page", F.upper(F.substring("text", 1, 50)).alias("anchor"))
    return claims.locate_anchors(gold, pages).select("doc_id", "page", "found.*")


@query(r"""WITH b AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS t FROM documents), q AS (SELECT doc_id, n, t, CASE WHEN n % 4 = 0 THEN substring(t, 1, 2) WHEN n % 4 = 1 THEN substring(t, 1, 9) || '~~' WHEN n % 4 = 2 THEN replace(substring(t, 1, 20), ' ', '') ELSE '  ' || replace(substring(t, 2, 20), ' ', '   ') END AS q FROM b WHERE trim(t) <> ''),
 f AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(t, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> ''), ' ') AS ft, array_to_string(list_filter(regexp_split_to_array(q, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> ''), ' ') AS fq FROM q)
 SELECT doc_id, n - 1 AS page, length(fq) >= 3 AND contains(ft, fq) AS ok FROM f""")
def cit_quote_on_page(spark, d):
    rows = lines(spark, d).select("doc_id", F.col("block_no").cast("long").alias("page"), F.col("block").alias("text"))
    n = (F.col("page") + 1) % 4
    quote = F.when(n == 0, F.substring("text", 1, 2)).when(n == 1, F.concat(F.substring("text", 1, 9), F.lit("~~"))).when(n == 2, F.replace(F.substring("text", 1, 20), F.lit(" "), F.lit(""))).otherwise(F.concat(F.lit("  "), F.replace(F.substring("text", 2, 20), F.lit(" "), F.lit("   "))))
    return claims.quote_on_page(rows.select("doc_id", "page", quote.alias("quote")), rows).select("doc_id", "page", "ok")


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
 w AS (SELECT doc_id, 0 AS start, 0 AS "end", text, n FROM t UNION ALL
  SELECT doc_id, "end", "end" + CASE WHEN n - "end" <= 800 THEN n - "end" WHEN length(cut) > 0 AND 2 * length(cut) >= 800 THEN length(cut) ELSE 800 END, text, n
  FROM (SELECT *, regexp_extract(substring(text, "end" + 1, 800), '(?s)^.*(\n\s*\n|[.!?。！？](\s+|$))') AS cut FROM w WHERE "end" < n))
 SELECT doc_id, start, "end" FROM w WHERE "end" > start""")
def cit_windows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(claims.citation_windows(F.col("text"), 800)).alias("w"))
    return rows.select("doc_id", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))


@query("""WITH p AS (SELECT l_orderkey AS claim_id, l_linenumber AS w FROM lineitem), s AS (SELECT claim_id, min(w) * 400 AS s, max(w) * 400 + 400 AS e, bool_or(w > 6) AS unknown, count(*) > count(DISTINCT w) AS twice FROM p GROUP BY claim_id),
 r AS (SELECT *, CASE WHEN unknown THEN 'unknown_window' WHEN twice THEN 'duplicate_window' WHEN e - s > 1600 THEN 'too_long' END AS reason FROM s)
 SELECT claim_id, CASE WHEN reason IS NULL THEN s END AS char_start, CASE WHEN reason IS NULL THEN e END AS char_end, reason FROM r""")
def cit_resolve_support(spark, d):
    picks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("window_id"))
    windows = picks.select("window_id").distinct().filter("window_id <= 6").select("window_id", (F.col("window_id") * 400).alias("start"), (F.col("window_id") * 400 + 400).alias("end"))
    return claims.resolve_support(picks, windows)


@query("""WITH b AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS t FROM documents), p AS (SELECT doc_id, n, length(t) AS c, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM b WHERE trim(t) <> '')
 SELECT doc_id AS claim_id, n AS block_no, greatest(50, s) - s AS char_start, least(450, s + c) - s AS char_end FROM p WHERE 50 < s + c AND 450 > s""")
def cit_source_spans(spark, d):
    blocks = lines(spark, d).select("doc_id", "block_no", F.length("block").alias("chars"), "page")
    quotes = blocks.select("doc_id").distinct().select(F.col("doc_id").alias("claim_id"), "doc_id", F.lit(50).alias("q_start"), F.lit(450).alias("q_end"))
    return claims.source_spans(quotes, blocks).drop("page")


# --- claims


@query("""WITH c AS (SELECT event_id AS draft_no, user_id AS doc_id, event_type AS facet, CASE WHEN value < 50 THEN 'quote_not_found' END AS reason FROM events)
 SELECT draft_no, CASE WHEN reason IS NULL AND draft_no > min(draft_no) FILTER (reason IS NULL) OVER (PARTITION BY doc_id, facet) THEN 'duplicate_facet' ELSE reason END AS reason FROM c""")
def clm_dedupe(spark, d):
    drafts = table(spark, d, "events").select(F.col("event_id").alias("draft_no"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("facet"), F.when(F.col("value") < 50, "quote_not_found").alias("reason"))
    return claims.dedupe_claims(drafts).select("draft_no", "reason")


@query("""SELECT event_id, CASE WHEN event_type <> 'error' AND event_type <> 'click' AND value >= 20 THEN 'supported' WHEN event_type = 'error' AND value >= 20 THEN 'contradicted' ELSE 'insufficient' END AS status FROM events""")
def clm_assess(spark, d):
    check = lambda bad, verdict, grounded: F.struct(F.when(bad, verdict).otherwise("pass").alias("verdict"), grounded.alias("grounded"), F.lit("why").alias("reason"))
    firm = F.col("value") >= 20
    rows = table(spark, d, "events").select("event_id", check(F.col("event_type") == "error", "contradicted", firm).alias("attribution"), check(F.col("event_type") == "click", "fail", F.lit(True)).alias("conditions"), check(F.lit(False), "fail", firm).alias("entailment"))
    return claims.assess(rows).select("event_id", "status")


@query("""WITH j AS (SELECT l_orderkey AS k, count(*) AS n, min(l_returnflag) AS s FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
 r AS (SELECT o_orderkey AS claim_id, s, CASE WHEN o_orderkey % 5 = 0 THEN 'quote_not_exact' WHEN o_orderstatus = 'P' THEN 'numeric_value_not_in_quote' WHEN o_orderkey % 7 = 0 THEN 'condition_not_affirmed' WHEN n > 1 THEN 'duplicate_judgment' WHEN n IS NULL THEN 'judge_did_not_verify_claim' END AS reason FROM orders LEFT JOIN j ON k = o_orderkey)
 SELECT claim_id, CASE WHEN reason IS NULL THEN s ELSE 'insufficient' END AS status, reason FROM r""")
def clm_verify(spark, d):
    told = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), (F.col("o_orderkey") % 5 != 0).alias("exact"), (F.col("o_orderstatus") != "P").alias("numeric"), F.when(F.col("o_orderkey") % 7 == 0, False).alias("condition"))
    judged = table(spark, d, "lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("claim_id"), F.col("l_returnflag").alias("status"))
    return claims.verify_claims(told, judged)


@query("""WITH e AS (SELECT l_orderkey AS doc_id, count(DISTINCT l_linestatus) AS n, max(l_linenumber) AS c FROM lineitem WHERE l_orderkey % 9 > 0 GROUP BY 1), s AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 8 > 0)
 SELECT doc_id, problem FROM (SELECT coalesce(s.doc_id, e.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'foreign' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN c > 4 THEN 'too_many_claims' END AS problem FROM s FULL JOIN e ON s.doc_id = e.doc_id) WHERE problem IS NOT NULL""")
def clm_merge_reports(spark, d):
    reports = table(spark, d, "lineitem").filter("l_orderkey % 9 > 0").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("report_id"), F.col("l_linenumber").alias("claims"))
    return claims.merge_reports(reports, table(spark, d, "orders").filter("o_orderkey % 8 > 0").select(F.col("o_orderkey").alias("doc_id")))


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2), p AS (SELECT k, count(*) AS n, max(n) AS m, bool_or(f = 'R') AS bad, bool_and(f = 'N') AS good FROM a GROUP BY k)
 SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 10 = 0 THEN 'contradicted' WHEN p.n IS NULL OR p.n <> m OR m <> 1 + o_orderkey % 4 THEN 'insufficient' WHEN bad THEN 'contradicted' WHEN good THEN 'supported' ELSE 'insufficient' END AS status FROM orders LEFT JOIN p ON k = o_orderkey""")
def clm_review_assertions(spark, d):
    told = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), ((F.col("o_orderkey") % 4 + 1) * 10).alias("length"), F.when(F.col("o_orderkey") % 10 == 0, "contradicted").otherwise("supported").alias("baseline"))
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id"), "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    status = F.when(F.col("f") == "R", "contradicted").when(F.col("f") == "N", "supported").otherwise("unclear")
    return claims.review_assertions(told, parts.select("claim_id", (F.col("l_linenumber") * 10 - 10).alias("start"), (F.col("l_linenumber") * 10).alias("end"), status.alias("status")))


@query("""WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS e FROM events GROUP BY 1) SELECT c_custkey AS claim_id, CASE e WHEN 'click' THEN 'retained' WHEN 'error' THEN 'withdrawn' ELSE 'unreviewed' END AS review, CASE WHEN e = 'error' THEN 'insufficient' ELSE 'supported' END AS status FROM customer LEFT JOIN l ON user_id = c_custkey""")
def clm_review_overlay(spark, d):
    decision = F.when(F.col("event_type") == "click", "retain").when(F.col("event_type") == "error", "withdraw").otherwise("reset")
    events = table(spark, d, "events").select(F.col("user_id").alias("claim_id"), F.col("event_id").alias("sequence"), decision.alias("decision"))
    return claims.review_overlay(table(spark, d, "customer").select(F.col("c_custkey").alias("claim_id"), F.lit("supported").alias("status")), events)


@query("""WITH e AS (SELECT user_id AS task_id, event_id, row_number() OVER w + CASE WHEN value > 300 THEN 1 ELSE 0 END AS s, lag(event_id) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 c AS (SELECT *, s = row_number() OVER v AND p IS NOT DISTINCT FROM lag(event_id) OVER v AND s = coalesce(lag(s) OVER v + 1, s) AS ok FROM e WINDOW v AS (PARTITION BY task_id ORDER BY s, event_id)) SELECT task_id, count(*) AS events, count(*) FILTER (NOT ok) AS broken FROM c GROUP BY 1""")
def clm_event_chain(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    s = F.row_number().over(w) + F.when(F.col("value") > 300, 1).otherwise(0)
    events = table(spark, d, "events").select(F.col("user_id").alias("task_id"), "event_id", s.alias("sequence"), s.alias("revision"), F.lag("event_id").over(w).alias("previous"))
    return claims.check_event_chain(events)


@query("""SELECT o_orderkey AS claim_id, CASE WHEN c_nationkey < 12 AND o_orderkey % 3 > 0 THEN o_orderstatus ELSE 'insufficient' END AS status, CASE WHEN c_nationkey < 12 AND o_orderkey % 3 > 0 THEN NULL WHEN c_nationkey % 2 = 0 THEN 'stopped' WHEN c_nationkey IS NULL THEN 'batch_missing' ELSE 'batch_not_committed' END AS reason FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 6 > 0""")
def clm_partial_report(spark, d):
    o = table(spark, d, "orders")
    batches = table(spark, d, "customer").filter("c_custkey % 6 > 0").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_nationkey") < 12, "committed").otherwise("open").alias("state"), F.when(F.col("c_nationkey") % 2 == 0, "stopped").alias("reason"))
    verdicts = o.filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderstatus").alias("status"))
    return claims.partial_report(o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("doc_id")), verdicts, batches)


@query("""SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY lang) AS n, source || ':' || lang || ':missing' AS gap FROM (SELECT source, lang FROM documents GROUP BY 1, 2 HAVING count(*) % 2 = 0)""")
def clm_gap_list(spark, d):
    n = table(spark, d, "documents").groupBy(F.col("source").alias("doc_id"), F.col("lang").alias("facet")).agg(F.count(F.lit(1)).alias("n"))
    return claims.gap_list(n.withColumn("state", F.when(F.col("n") % 2 == 0, "missing").otherwise("supported")))


@query("""WITH c AS (SELECT doc_id, n_chars, source, lag(doc_id) OVER w AS i1, lag(n_chars) OVER w AS c1, lag(doc_id, 2) OVER w AS i2, lag(n_chars, 2) OVER w AS c2 FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
 SELECT doc_id AS claim_id, CASE WHEN n_chars + c1 + c2 <= 4000 THEN i2 || ' ' ELSE '' END || CASE WHEN n_chars + c1 <= 4000 THEN i1 || ' ' ELSE '' END || doc_id AS chunks FROM c""")
def clm_preceding_context(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"), F.col("n_chars").alias("chars"))
    told = chunks.select(F.col("chunk_id").alias("claim_id"), "chunk_id")
    return claims.preceding_context(told, chunks).select("claim_id", F.array_join(F.transform("chunks", lambda x: x.cast("string")), " ").alias("chunks"))


# --- relations


@query("""WITH r AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id AS relation_id, CASE WHEN doc_id % 6 = 0 THEN 'quote' WHEN doc_id % 6 = 1 THEN 'entity' ELSE 'too_many' END AS problem FROM r WHERE doc_id % 6 < 2 OR n > 100""")
def grf_validate_relations(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("Alpha meets BETA; "), "text").alias("text"))
    six = F.col("doc_id") % 6
    rel = docs.select(F.col("doc_id").alias("relation_id"), F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), F.when(six == 1, "gamma").otherwise("alpha").alias("subject"), F.lit("Beta").alias("object"), F.when(six == 0, "Alpha meets Beta").otherwise("Alpha meets BETA").alias("quote"), F.lit(0).alias("char_start"), F.lit(16).alias("char_end"))
    return claims.validate_relations(rel, docs.select(F.col("doc_id").alias("chunk_id"), "text"))


@query("""WITH r AS (SELECT p_size % 3 AS tenant, p_partkey AS relation_id, unnest([p_name || '  X', ' ' || p_type]) AS name FROM part), e AS (SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS entity FROM r)
 SELECT tenant, entity, (arg_min(name, relation_id)) AS label, count(DISTINCT relation_id) AS mentions FROM e GROUP BY 1, 2""".replace("\\\\s", "\\s"))
def grf_entity_mentions(spark, d):
    return claims.entity_mentions(table(spark, d, "part").select((F.col("p_size") % 3).alias("tenant"), F.col("p_partkey").alias("relation_id"), F.concat("p_name", F.lit("  X")).alias("subject"), F.concat(F.lit(" "), "p_type").alias("object")))


# --- evaluation


@query("""SELECT o_orderstatus AS variant, o_orderkey % 3 AS k, round(avg(CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 5 / 4.0 END), 6) AS recall, count(*) FILTER (o_orderkey % 7 > 0 AND o_orderkey % 5 = 4) AS complete, count(*) FILTER (o_orderkey % 7 > 0) AS scored, count(*) FILTER (o_orderkey % 7 = 0) AS unscored, round(avg(o_custkey), 6) AS chars FROM orders GROUP BY 1, 2""")
def evl_aggregate_variants(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("variant"), (F.col("o_orderkey") % 3).alias("k"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 5 / 4).alias("recall"), F.col("o_custkey").alias("context_chars"))
    return review.aggregate_variants(rows)


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'covered' WHEN value < 100 AND event_id % 2 = 1 THEN 'anchor_retrieval_gap' WHEN event_id % 2 = 0 AND user_id > 5 THEN 'parent_context_budget' ELSE 'selection_policy_gap' END AS cause FROM events""")
def evl_diagnose_gaps(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("event_type") == "click").alias("covered"), (F.col("value") >= 100).alias("retrieved"), (F.col("event_id") % 2 == 0).alias("in_parent"), (F.col("user_id") - 5).alias("additional_chars"))
    return review.diagnose_gaps(rows).select("event_id", "cause")


@query("""SELECT doc_id % 3 AS round, count(*) FILTER (contains('doc_' || doc_id || '.txt', '7') AND contains(text, 'a') AND contains(text, '.')) AS passed, count(*) AS total, round(sum(CASE WHEN n_chars % 10 > 4 THEN n_chars % 10 - 4 ELSE 0 END) / count(*)::DOUBLE, 6) AS mean_elapsed FROM documents GROUP BY 1""")
def evl_score_answers(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 3).alias("round"), F.col("text").alias("answer"), F.array(F.lit("a"), F.lit(".")).alias("expected"), F.array(F.lit("other"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))).alias("cited"), F.lit("7").alias("expected_doc"), (F.col("n_chars") % 10 - 4).cast("double").alias("elapsed"))
    return review.score_answers(rows)


@query("""WITH a AS (SELECT o_custkey AS pack_id, o_orderkey % 4 > 0 AS answerable, o_orderkey % 11 > 0 AS answered, o_orderkey % 13 = 0 AS abstained, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 17 > 0 END AS correct, o_orderkey % 10 AS supported FROM orders),
 s AS (SELECT pack_id, count(*) AS questions, count(*) FILTER (NOT answered) AS missing, count(*) FILTER (answered AND correct IS NULL) AS pending, CAST(sum(supported) AS BIGINT) AS supported, count(*) * 10 AS claims, count(*) FILTER (correct) AS correct, count(*) FILTER (answerable AND abstained) AS shy FROM a GROUP BY 1)
 SELECT pack_id, questions, missing, pending, supported, claims, correct, CASE WHEN missing > 0 OR pending > 0 THEN 'incomplete' WHEN correct = questions AND shy = 0 AND supported * 10 >= claims * 9 THEN 'passed' ELSE 'failed' END AS status FROM s""")
def evl_acceptance_score(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("pack_id"), (k % 4 > 0).alias("answerable"), (k % 11 > 0).alias("answered"), (k % 13 == 0).alias("abstained"), F.when(k % 9 > 0, k % 17 > 0).alias("correct"), F.lit(True).alias("gap_correct"), (k % 10).alias("supported"), F.lit(10).alias("claims"))
    return review.acceptance_score(rows)


@query("""SELECT l_linestatus AS policy, count(*) FILTER (l_returnflag = o_orderstatus) AS exact, count(*) FILTER (l_returnflag <> 'R' AND o_orderstatus = 'P') AS false_accepts, count(*) FILTER (l_returnflag = 'R' AND o_orderstatus <> 'P') AS false_rejects, count(*) AS total FROM (SELECT l_linestatus, l_orderkey, CASE l_returnflag WHEN 'R' THEN 'R' ELSE 'x' END AS l_returnflag FROM lineitem) JOIN (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE o_orderstatus END AS o_orderstatus FROM orders) ON l_orderkey = o_orderkey GROUP BY 1""".replace("l_returnflag = o_orderstatus", "l_returnflag = CASE o_orderstatus WHEN 'P' THEN 'R' ELSE o_orderstatus END"))
def evl_verdict_confusion(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "supported").when(F.col("o_orderstatus") == "F", "x").otherwise(F.col("o_orderstatus")).alias("actual"))
    rows = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return review.verdict_confusion(rows.select(F.col("l_linestatus").alias("policy"), F.when(F.col("l_returnflag") == "R", "supported").otherwise("x").alias("expected"), "actual"))


@query("""SELECT user_id AS run_id, count(*) AS attempted, count(*) FILTER (value < 480) AS succeeded, CAST(sum(CASE WHEN event_type = 'view' THEN 0 ELSE CAST(json_extract(props, '$.k') AS INT) END) AS BIGINT) AS tokens, count(*) FILTER (value < 480 AND event_type = 'view') AS without_usage, CASE WHEN count(*) FILTER (value < 480) = count(*) THEN 'completed' ELSE 'incomplete' END AS status FROM events GROUP BY 1""")
def evl_request_ledger(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.col("value") < 480).alias("ok"), F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("int")).alias("tokens"))
    return review.request_ledger(rows)


@query("""WITH q AS (SELECT source AS pack_id, doc_id AS question_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) % 2 AS odd FROM documents) SELECT pack_id, question_id, s AS slot, CASE WHEN (odd = 1) = (s = 0) THEN 'flat' ELSE 'tree' END AS variant FROM q, (SELECT unnest([0, 1]) AS s)""")
def evl_paired_plan(spark, d):
    return review.paired_plan(table(spark, d, "documents").select(F.col("source").alias("pack_id"), F.col("doc_id").alias("question_id")), ("flat", "tree"))


# --- training rows and rules


def judged(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select(F.concat_ws("/", "lang", "source").alias("query_id"), F.col("doc_id").cast("string").alias("id"), "text", (F.col("quality") == 1).alias("label"), F.col("n_chars").cast("double").alias("score"))


_JUDGED = "WITH j AS (SELECT lang || '/' || source AS query_id, CAST(doc_id AS VARCHAR) AS id, quality = 1 AS label, n_chars AS score FROM documents JOIN labels USING (doc_id))"


@query(_JUDGED + " SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place, id, label FROM j")
def trn_ranking_rows(spark, d):
    """A row for every valid id of a query."""
    return review.ranking_places(judged(spark, d))


@query(_JUDGED + " SELECT query_id, CASE WHEN count(*) FILTER (label) = 0 THEN 'no positive' ELSE 'no negative' END AS reason FROM j GROUP BY 1 HAVING count(*) FILTER (label) = 0 OR count(*) FILTER (NOT label) = 0")
def trn_reject_queries(spark, d):
    return review.reject_queries(judged(spark, d))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'blank' WHEN doc_id % 3 = 1 THEN 'label' END AS pair_fault, CASE WHEN doc_id % 2 = 0 THEN 'blank' END AS triplet_fault FROM documents""")
def val_training_rows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, "query").alias("query"), F.lit("p").alias("passage"), F.when(F.col("doc_id") % 3 == 1, "yes").otherwise("1").alias("label"), F.lit("a").alias("anchor"), F.lit("b").alias("positive"), F.when(F.col("doc_id") % 2 == 0, "  ").otherwise("n").alias("negative"))
    return rows.select("doc_id", review.training_faults("pair").alias("pair_fault"), review.training_faults("triplet").alias("triplet_fault"))


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS block_id, fault FROM (SELECT *, CASE WHEN l_returnflag = 'R' AND l_linenumber > 3 THEN 'level' WHEN l_returnflag = 'R' AND l_suppkey % 5 = 0 THEN 'blank heading' WHEN l_suppkey % 7 = 0 THEN 'one page' WHEN l_quantity < 10 THEN 'page order' WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 THEN 'duplicate' END AS fault FROM lineitem) WHERE fault IS NOT NULL""")
def val_blocks(spark, d):
    head = F.col("l_returnflag") == "R"
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block_id"), F.when(head, "heading").otherwise("paragraph").alias("kind"), F.when(head & (F.col("l_linenumber") <= 3), 1).alias("level"),
        F.when(F.col("l_suppkey") % 5 > 0, "t").alias("text"), F.lit(10).alias("page_start"), F.when(F.col("l_suppkey") % 7 > 0, F.col("l_quantity")).alias("page_end"),
    )
    return review.block_faults(rows)


@query("""WITH a AS (SELECT event_id, event_id // 2 * 2 + CASE WHEN value < 400 THEN event_id % 2 ELSE 0 END AS question_id, event_type FROM events), b AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM a)
 SELECT question_id, fault FROM (SELECT *, CASE WHEN question_id % 9 = 0 THEN 'unknown' WHEN n > 1 THEN 'duplicate' WHEN event_type = 'view' THEN 'blank' WHEN event_type = 'click' THEN 'abstained with claims' WHEN event_type = 'error' THEN 'no claims' WHEN event_type = 'signup' THEN 'claim ids' END AS fault FROM b) WHERE fault IS NOT NULL""")
def val_submission(spark, d):
    e = table(spark, d, "events")
    ids = F.when(F.col("event_type") == "signup", F.array(F.lit("a"), F.lit("a"))).when(F.col("event_type") != "error", F.array(F.lit("a"), F.lit("b")))
    question = F.floor(F.col("event_id") / 2) * 2 + F.when(F.col("value") < 400, F.col("event_id") % 2).otherwise(0)
    rows = e.select(question.alias("question_id"), (F.col("event_type") == "click").alias("abstained"), F.when(F.col("event_type") != "view", "said").alias("text"), ids.alias("claim_ids"))
    return review.submission_faults(rows, rows.select("question_id").distinct().filter("question_id % 9 != 0"))
