"""All registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.functions import chunks, text, vectors
from evidence_spark.operators import claims, evaluation, search, tables
from evidence_spark.plans import audit_queries, evidence_queries, identity_queries, operation_queries, page_queries, rule_queries, source_queries, stream_queries, verify_queries  # noqa: F401  (they register themselves)
from evidence_spark.plans.base import ORACLES, QUERIES, query, table  # noqa: F401
from evidence_spark.sources import files
from evidence_spark.streaming import usage

def usage_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", "user_id", "event_type", F.col("ts").alias("created_at"), F.get_json_object("props", "$.k").cast("int").alias("tokens_used"), (F.col("event_type") != "error").alias("is_success")
    )


AS_OF = "2024-01-31"


# --- text


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x{00a0}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cleaned FROM documents""")
def txt_clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query(r"""SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ff65}\x{0000}-\x{007f}]', '', 'g')) / length(text)::DOUBLE ELSE 0 END, 6) AS share FROM documents""")
def txt_plausibility(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.plausibility(F.col("text")), 6).alias("share"))


@query(r"""SELECT item_id, list_aggregate(regexp_extract_all(replace(lower(regexp_replace(text, '([A-Za-z])-\s*\n\s*([A-Za-z])', '\1\2', 'g')), 'ß', 'ss'), '[a-z0-9]+'), 'string_agg', ' ') AS tokens FROM benchmark""")
def txt_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.words(F.col("text")), " ").alias("tokens"))


@query(r"""SELECT doc_id, substring(replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10), ' '), 1, 220) AS snippet, substring(replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10), ' '), 1, 60) AS title FROM documents""")
def txt_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.snippet(F.col("text"), 60).alias("title"))


@query(r"""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\|'), chr(10), ' ') AS escaped FROM documents""")
def txt_markdown_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", text.markdown_escape(F.col("text")).alias("escaped"))


@query("""SELECT doc_id, block_no - 1 AS block_no, (block_no - 1) // 5 + 1 AS page, block FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS block_no, unnest(string_split(text, chr(10))) AS block FROM documents) WHERE trim(block) <> ''""")
def txt_flat_blocks(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "block"))
    return lines.filter("trim(block) <> ''").select("doc_id", F.col("block_no").cast("long").alias("block_no"), (F.floor(F.col("block_no") / 5) + 1).alias("page"), "block")


@query("""WITH b AS (SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1) // 5 + 1 AS page, unnest(string_split(text, chr(10))) AS block FROM documents), p AS (SELECT doc_id, page, sum(length(block)) AS n FROM b GROUP BY doc_id, page) SELECT doc_id, count(*) AS pages, CAST(sum(CASE WHEN n < 40 THEN 1 ELSE 0 END) AS BIGINT) AS low_pages FROM p GROUP BY doc_id""")
def txt_low_text_pages(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "block"))
    pages = lines.groupBy("doc_id", F.floor(F.col("n") / 5).alias("page")).agg(F.sum(F.length("block")).alias("chars"))
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("chars") < 40).alias("low_pages"))


@query("""SELECT doc_id, list_count(list_filter(string_split(regexp_replace(text, '([。！？!?；;.\n])', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS sentences FROM documents""".replace("\\\\1", "\\1"))
def chk_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"))


# --- chunks


def chunk_rows(spark, d, ids: DataFrame | None = None) -> DataFrame:
    docs = table(spark, d, "documents")
    docs = docs if ids is None else docs.join(ids, "doc_id", "left_semi")
    docs = docs.select("doc_id", "source", F.posexplode(chunks.chunk_flat(text.clean_text(F.col("text")))).alias("chunk_index", "chunk"))
    return docs.withColumn("chunk_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))


@query()
def chk_chunk_flat(spark, d):
    return chunk_rows(spark, d).select("doc_id", "chunk_index", "chunk")


@query()
def chk_chunk_stats(spark, d):
    return chunk_rows(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.max(F.length("chunk")).alias("longest"))


@query("""SELECT doc_id, sha256('{"lang":"' || lang || '","n":' || n_chars || '}') AS id FROM documents""")
def chk_content_id(spark, d):
    row = text.content_id("", lang=F.col("lang"), n=F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", row.alias("id"))


# --- sources


@query("""SELECT page_id, CASE WHEN length(html) = 0 THEN 'empty' WHEN length(html) > 4000 THEN 'too large' END AS reason FROM pages""")
def src_admit_files(spark, d):
    named = table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.length("html").alias("size"))
    return files.admit_files(named, (".html",), 4000).select("page_id", "reason")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0""")
def src_upsert_index(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return tables.upsert(o.filter("o_orderkey % 2 = 0").withColumn("version", F.lit("old")), o.filter("o_orderkey % 3 = 0").withColumn("version", F.lit("new")), ["o_orderkey"])


@query(r"""SELECT doc_id, 'col_user_' || doc_id || '_' || substring(CASE WHEN s = '' THEN 'index' ELSE s END, 1, 32) || '_' || substring(sha256(v), 1, 8) AS name FROM (SELECT doc_id, v, lower(regexp_replace(regexp_replace(v, '[^A-Za-z0-9_-]+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g')) AS s FROM (SELECT doc_id, source || ' / ' || lang AS v FROM documents))""")
def src_collection_name(spark, d):
    return table(spark, d, "documents").select("doc_id", text.collection_name(F.col("doc_id"), F.concat("source", F.lit(" / "), "lang")).alias("name"))


# --- vectors and search


@query("""SELECT vec_id, len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS ok FROM embeddings""")
def val_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.size(vectors.faults(F.col("embedding"), 64)) == 0).alias("ok"))


_COS = """WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
 s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(a::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings WHERE vec_id <> query_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def dense_hits(spark, d, n: int, asked: str = "vec_id % 100 = 0") -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.filter(asked.replace("vec_id", "id")).select(F.col("id").alias("query_id"), "vector")
    found = search.cosine_topn(q, e, n + 1).filter("query_id != id").drop("rank")
    return search.best(found, ["query_id"], [F.desc("score"), "id"], n)


@query(_COS + " SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 20")
def vec_cosine_topn(spark, d, asked="vec_id % 100 = 0"):
    return dense_hits(spark, d, 20, asked).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query()
def emb_hash_embed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.transform(vectors.hash_embed(F.col("text")), lambda x: F.round(x, 6)).alias("vector"))


def lexical(spark, d, n=None):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), text.words(F.col("text")).alias("tokens"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.words(F.col("text")).alias("terms"))
    return search.bm25(q, docs, n=n)


_BM25 = """WITH c AS (SELECT doc_id AS chunk_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+') AS tokens FROM documents),
 q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+')) AS term FROM benchmark),
 st AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_len FROM c),
 t AS (SELECT chunk_id, len(tokens) AS len, unnest(tokens) AS term FROM c),
 tf AS (SELECT chunk_id, term, count(*) AS tf, any_value(len) AS len FROM t WHERE term IN (SELECT term FROM q) GROUP BY chunk_id, term),
 idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term),
 r AS (SELECT query_id, chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM tf JOIN idf USING (term) JOIN q USING (term), st GROUP BY query_id, chunk_id)"""


@query(_BM25 + " SELECT query_id, chunk_id, round(score, 6) AS score FROM r WHERE score > 0")
def lex_bm25(spark, d):
    return lexical(spark, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(_BM25 + " SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS n FROM r WHERE score > 0) WHERE n <= 20")
def lex_bm25_best(spark, d):
    """The first 20 chunks of each query: frequent words are looked up only where they can matter."""
    return lexical(spark, d, 20).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def channel_hits(spark, d, asked: str = "vec_id % 100 = 0") -> DataFrame:
    dense = dense_hits(spark, d, 20, asked).select("query_id", F.col("id").alias("chunk_id"), F.lit("vector").alias("channel"), (F.col("rank") - 1).alias("rank"))
    label = table(spark, d, "embeddings").select("vec_id", "label")
    q = label.filter(asked).select(F.col("vec_id").alias("query_id"), "label")
    first = search.best(label, ["label"], ["vec_id"], 21).drop("rank")  # one of them can be the query
    same = q.join(first, "label").filter("vec_id != query_id")
    lex = search.best(same, ["query_id"], ["vec_id"], 20).select("query_id", F.col("vec_id").alias("chunk_id"), F.lit("lexical").alias("channel"), (F.col("rank") - 1).alias("rank"))
    return dense.unionByName(lex)


_HITS = _COS + """, x AS (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
 h AS (SELECT query_id, id, rank FROM r WHERE rank <= 20 UNION ALL SELECT query_id, id, rank FROM x WHERE rank <= 20),
 f AS (SELECT query_id, id AS chunk_id, sum(1.0 / (60 + rank)) AS score, count(*) AS n_channels FROM h GROUP BY query_id, id)"""


@query(_HITS + " SELECT query_id, chunk_id, round(score, 9) AS score, n_channels FROM f")
def fus_rrf(spark, d, asked="vec_id % 100 = 0"):
    return search.rrf(channel_hits(spark, d, asked)).withColumn("score", F.round("score", 9))


@query(_HITS + """, g AS (SELECT *, chunk_id % 4 AS doc_id FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 9) DESC, chunk_id) AS round FROM g)
 SELECT query_id, chunk_id, round, row_number() OVER (PARTITION BY query_id ORDER BY round, doc_id) AS place FROM o""")
def fus_round_robin(spark, d, asked="vec_id % 100 = 0"):
    hits = search.rrf(channel_hits(spark, d, asked)).withColumns({"score": F.round("score", 9), "doc_id": F.col("chunk_id") % 4})
    return search.round_robin(hits.withColumn("doc_order", F.col("doc_id"))).select("query_id", "chunk_id", "round", "place")


# --- evaluation and training


@query(_COS + """, g AS (SELECT r.query_id, r.rank, k FROM r JOIN embeddings a ON a.vec_id = r.query_id JOIN embeddings b ON b.vec_id = r.id AND a.label = b.label, (SELECT unnest([1, 5, 10]) AS k) WHERE r.rank <= k),
 t AS (SELECT a.vec_id AS query_id, count(*) AS total FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY a.vec_id),
 e AS (SELECT t.query_id, k, total, (SELECT count(*) FROM g WHERE g.query_id = t.query_id AND g.k = ks.k) AS hit, (SELECT min(rank) FROM g WHERE g.query_id = t.query_id AND g.k = ks.k) AS first,
   (SELECT coalesce(sum(1 / log2(rank + 1)), 0) FROM g WHERE g.query_id = t.query_id AND g.k = ks.k) AS dcg, (SELECT sum(1 / log2(i + 1)) FROM range(1, least(total, k) + 1) x(i)) AS ideal FROM t, (SELECT unnest([1, 5, 10]) AS k) ks)
 SELECT k, round(avg(hit / total::DOUBLE), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(dcg / ideal), 6) AS ndcg, count(*) AS n_queries FROM e GROUP BY k""")
def evl_ranking_metrics(spark, d, asked="vec_id % 100 = 0"):
    label = table(spark, d, "embeddings").select("vec_id", "label")
    q = label.filter(asked).select(F.col("vec_id").alias("query_id"), "label")
    total = q.join(label.groupBy("label").agg((F.count_distinct("vec_id") - 1).alias("total")), "label").filter("total > 0").select("query_id", "total")
    hits = dense_hits(spark, d, 20, asked).select("query_id", "id", "rank")
    relevant = hits.join(q, "query_id").join(label.withColumnRenamed("vec_id", "id"), ["id", "label"]).select("query_id", "id")
    return evaluation.ranking_metrics(hits, relevant, (1, 5, 10), total)


@query("""WITH j AS (SELECT d.lang AS query_id, CAST(d.doc_id AS VARCHAR) AS id, l.quality = 1 AS label, d.n_chars AS score FROM documents d JOIN labels l USING (doc_id)),
 n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM j WHERE NOT label)
 SELECT p.query_id, p.id AS pos_id, n.id AS neg_id FROM j p JOIN n USING (query_id) WHERE p.label AND r <= 4""")
def trn_embedding_triplets(spark, d):
    return evaluation.training_rows(judged(spark, d))[0]


@query("""WITH j AS (SELECT d.lang AS query_id, CAST(d.doc_id AS VARCHAR) AS id, l.quality = 1 AS label, d.n_chars AS score FROM documents d JOIN labels l USING (doc_id)),
 n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM j WHERE NOT label)
 SELECT query_id, id, 1.0::DOUBLE AS target FROM j WHERE label UNION ALL SELECT query_id, id, 0.0::DOUBLE FROM n WHERE r <= 4""")
def trn_reranker_pairs(spark, d):
    return evaluation.training_rows(judged(spark, d))[1]


def judged(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select(F.col("lang").alias("query_id"), F.col("doc_id").cast("string").alias("id"), "text", (F.col("quality") == 1).alias("label"), F.col("n_chars").cast("double").alias("score"))


@query("""SELECT l_orderkey % 7 AS query_id, 5 AS k, round(avg(CASE WHEN l_linenumber <= 2 THEN 1.0 ELSE 0.0 END), 6) AS recall, avg(CASE WHEN l_linenumber <= 2 THEN 1.0 ELSE 0.0 END) = 1 AS complete FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey % 7""")
def evl_anchor_coverage(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    gold = lines.select((F.col("l_orderkey") % 7).alias("query_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(10).alias("g_start"), F.lit(20).alias("g_end"))
    halves = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(s).alias("s_start"), F.lit(e).alias("s_end")) for r, s, e in ((1, 5, 15), (2, 15, 30), (9, 0, 99))])).alias("x")
    spans = gold.select("query_id", "doc_id", "page", halves).select("query_id", "doc_id", "page", "x.*")
    spans = spans.withColumn("s_start", F.when((F.col("page") > 2) & (F.col("rank") == 2), 16).otherwise(F.col("s_start")))
    return evaluation.anchor_coverage(gold, spans, (5,))


# --- claims, relations, index life cycle


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN length(text) < 2 ELSE length(text) >= 12 END AS ok FROM documents""")
def cit_exact_slice(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    quote = F.substring("text", 1, 12)
    claims = docs.select("doc_id", F.lit(0).alias("char_start"), F.lit(12).alias("char_end"), F.when(F.col("doc_id") % 3 == 0, F.concat(quote, F.lit("~"))).otherwise(quote).alias("quote"))
    return tables.exact_slice(claims, docs).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("ok") | (F.length("quote") < 3)).otherwise(F.col("ok")).alias("ok"))


_SAID = ("'T5 has ' || n_chars || '.50 of 1' || lpad((n_chars % 1000)::VARCHAR, 3, '0') || ' in v2.1, 3e2.'", "CASE doc_id % 6 WHEN 0 THEN n_chars || '.5' WHEN 1 THEN '1,' || lpad((n_chars % 1000)::VARCHAR, 3, '0') WHEN 2 THEN 'T6 300' WHEN 3 THEN n_chars || '.51' WHEN 4 THEN '2.1' ELSE text END")


@query(rf"""WITH t AS (SELECT doc_id, {_SAID[0]} AS quote, {_SAID[1]} AS said FROM documents),
 x AS (SELECT doc_id, unnest([[0, 1], [1, 2]]) AS k, quote, said FROM t), w AS (SELECT doc_id, k[1] AS side, string_split_regex(CASE k[1] WHEN 0 THEN quote ELSE said END, '[^A-Za-z0-9_.,+-]') AS parts FROM x),
 p AS (SELECT doc_id, side, unnest(parts) AS part FROM w),
 m AS (SELECT doc_id, side, unnest(regexp_extract_all(' ' || part || ' ', '[^A-Za-z0-9_.]([+-]?[0-9]+(,[0-9][0-9][0-9])*(\.[0-9]+)?([eE][+-]?[0-9]+)?)[^A-Za-z0-9_.]', 1)) AS v FROM p),
 n AS (SELECT DISTINCT doc_id, side, CAST(replace(v, ',', '') AS DOUBLE) AS v FROM m),
 bad AS (SELECT DISTINCT doc_id FROM n a WHERE side = 1 AND NOT EXISTS (SELECT 1 FROM n b WHERE b.doc_id = a.doc_id AND b.side = 0 AND b.v = a.v))
 SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM bad) THEN 'numeric_value_not_in_quote' END AS gate FROM documents""")
def clm_numeric_gate(spark, d):
    told = table(spark, d, "documents").select("doc_id", F.expr(_SAID[0].replace("::VARCHAR", "::STRING")).alias("quote"), F.expr(_SAID[1].replace("::VARCHAR", "::STRING")).alias("said"))
    return told.select("doc_id", claims.numeric_gate(F.col("said"), F.col("quote")).alias("gate"))


@query("""WITH c AS (SELECT source AS doc_id, doc_id % 3 AS f, lang AS statement, CASE WHEN doc_id % 5 = 0 THEN 'contradicted' WHEN doc_id % 5 < 3 THEN 'insufficient' ELSE 'supported' END AS status FROM documents),
 s AS (SELECT doc_id, f, bool_or(status = 'contradicted') AS bad, count(DISTINCT CASE WHEN status = 'supported' THEN statement END) AS told FROM c GROUP BY doc_id, f)
 SELECT g.doc_id, CASE g.f WHEN 0 THEN 'method' WHEN 1 THEN 'dataset' WHEN 2 THEN 'result' ELSE 'limitation' END AS facet, CASE WHEN bad OR told > 1 THEN 'conflict' WHEN told = 1 THEN 'supported' WHEN told = 0 THEN 'uncertain' ELSE 'missing' END AS state
 FROM (SELECT DISTINCT doc_id, unnest([0, 1, 2, 3]) AS f FROM c) g LEFT JOIN s USING (doc_id, f)""")
def clm_comparison_table(spark, d):
    facets = ("method", "dataset", "result", "limitation")
    claims = table(spark, d, "documents").select(
        F.col("source").alias("doc_id"), F.element_at(F.array(*map(F.lit, facets)), (F.col("doc_id") % 3 + 1).cast("int")).alias("facet"), F.col("lang").alias("statement"),
        F.when(F.col("doc_id") % 5 == 0, "contradicted").when(F.col("doc_id") % 5 < 3, "insufficient").otherwise("supported").alias("status"),
    )
    return tables.comparison(claims, facets)


_ANY = r"regexp_split_to_array(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]+')"


@query(f"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter({_ANY}, lambda w: w <> ''))) AS word FROM benchmark),
 r AS (SELECT doc_id AS relation_id, unnest(list_distinct(list_filter({_ANY}, lambda w: w <> ''))) AS word FROM documents),
 h AS (SELECT query_id, relation_id, count(*) AS overlap FROM q JOIN r USING (word) GROUP BY query_id, relation_id)
 SELECT query_id, relation_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, relation_id) AS n FROM h) WHERE n <= 10""")
def grf_relations_for_query(spark, d):
    """Words of any script: here runs are taken out, in the SQL texts are split at what is none."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.any_words(F.col("text")).alias("tokens"))
    r = table(spark, d, "documents").select(F.col("doc_id").alias("relation_id"), text.any_words(F.col("text")).alias("tokens"))
    return tables.relations_for_query(q, r, 10)


@query("""WITH e AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS rid, l_partkey AS a, -1 - l_suppkey AS b FROM lineitem), s AS (SELECT rid, a, b FROM e UNION ALL SELECT rid, b, a FROM e),
 n AS (SELECT rid, a, b FROM s)
 SELECT DISTINCT x.a AS seed, x.b AS mid, y.b AS node FROM n x JOIN n y ON x.b = y.a WHERE x.a IN (SELECT p_partkey FROM part WHERE p_partkey % 100 = 0) AND y.b <> x.a AND y.b <> x.b AND x.rid <> y.rid""")
def grf_two_hop_paths(spark, d):
    """Paths from every part whose id is divisible by 100."""
    e = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_id"), F.col("l_partkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b")).distinct()
    seeds = table(spark, d, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("seed"))
    return tables.two_hop_paths(e, seeds)


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderkey % 11 AS v FROM orders), b AS (SELECT DISTINCT l_orderkey AS k, l_orderkey % 11 + CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS v FROM lineitem)
 SELECT k, state FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS state FROM a FULL JOIN b ON a.k = b.k) WHERE state IS NOT NULL""")
def idx_reconcile(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 11).alias("v"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_orderkey") % 11 + F.when(F.col("l_orderkey") % 50 == 0, 1).otherwise(0)).alias("v")).distinct()
    return tables.reconcile(a, b, ["k"], "v")


# --- usage figures and chats


@query(f"""SELECT event_type, count(*) AS calls, CAST(sum(coalesce(CAST(json_extract(props, '$.k') AS INT), 0)) AS BIGINT) AS tokens, count(*) FILTER (event_type = 'error') AS failures, printf('%.2f%%', 100.0 * count(*) FILTER (event_type = 'error') / count(*)) AS failure_rate
 FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY ROLLUP (event_type)""")
def ops_usage_by_event(spark, d):
    return tables.usage_by_event(usage_logs(spark, d), F.expr(f"timestamp '{AS_OF}' - interval 14 days"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1, 2""")
def st_daily_usage(spark, d):
    return usage.daily_usage(usage_logs(spark, d))


@query("""SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def ops_users_with_doc_counts(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(n, c["c_custkey"] == n["o_custkey"], "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("""SELECT conv_id, substring(arg_max(text, turn), 1, 60) AS preview FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def ops_sessions_with_preview(spark, d):
    said = table(spark, d, "conversations").filter("role = 'assistant'")
    return tables.latest(said, "conv_id", ["turn"], "text").select("conv_id", F.substring("text", 1, 60).alias("preview"))


@query("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6""")
def ops_recent_history(spark, d):
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.lit(0).alias("id"))
    return tables.recent_history(m, 3).select(F.col("session_id").alias("conv_id"), F.col("created_at").alias("turn"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts over flat chunks of documents: hash embeddings, exact cosine, citations."""
    rows = chunk_rows(spark, sf_dir)
    index = rows.select(F.col("chunk_id").alias("id"), vectors.hash_embed(F.col("chunk")).alias("vector"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), vectors.hash_embed(F.col("text")).alias("vector"))
    hits = search.cosine_topn(asked, index, 5)
    # only documents with hits are cut into chunks again
    hit = hits.select(F.split("id", ":")[0].cast("long").alias("doc_id")).distinct()
    shown = chunk_rows(spark, sf_dir, hit)
    cited = hits.join(shown.select(F.col("chunk_id").alias("id"), "doc_id", "chunk_index", F.col("chunk").alias("text")), "id")
    return search.build_citations(cited).select("query_id", "index", "doc_id", "chunk_index", F.round("score", 6).alias("score"), "snippet")


@query()
def w2_retrieve_and_cite(spark, d):
    return flagship(spark, d)


