"""Queries of rules over sets: members of an index, contexts, stored hits, training sets, builds, full reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import vectors
from evidence_spark.operators import evidence, lifecycle, review, tables
from evidence_spark.plans.base import query, table
from evidence_spark.plans.operation_queries import _WORDS


def member_hits(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") % 4).alias("member"), (F.col("l_partkey") % 4 + F.when(F.col("l_suppkey") % 50 == 0, 10).otherwise(0)).alias("doc_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("chunk_index"), F.col("l_quantity").cast("double").alias("score"),
    )


def members(spark):
    return spark.range(3).select(F.col("id").alias("member"), F.col("id").alias("document_id"))


_HITS = """WITH h AS (SELECT l_orderkey AS query_id, l_partkey % 4 AS member, l_partkey % 4 + CASE WHEN l_suppkey % 50 = 0 THEN 10 ELSE 0 END AS doc_id, l_partkey * 10 + l_linenumber AS chunk_index, CAST(l_quantity AS DOUBLE) AS score FROM lineitem),
 bad AS (SELECT query_id FROM h WHERE member = 3 OR doc_id <> member)"""


@query(_HITS + """, g AS (SELECT * FROM h WHERE query_id NOT IN (SELECT query_id FROM bad))
 SELECT query_id, doc_id, chunk_index, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rank FROM g) WHERE rank <= 3""")
def vec_search_whole_members(spark, d):
    """Lines of orders as hits of three members; a fourth is not named, and some hits are of another document than their member's."""
    found, _ = evidence.search_whole_members(member_hits(spark, d), members(spark), 3)
    return found.select("query_id", "doc_id", "chunk_index", "score", "rank")


@query(_HITS + " SELECT query_id, member, doc_id, count(*) AS n FROM h WHERE member = 3 OR doc_id <> member GROUP BY ALL")
def vec_foreign_hits(spark, d):
    return evidence.search_whole_members(member_hits(spark, d), members(spark), 3)[1]


@query("""WITH s AS (SELECT o_orderkey AS query_id, unnest([0, 1, 2]) AS doc_id FROM orders), h AS (SELECT l_orderkey AS query_id, l_partkey % 5 AS doc_id, length(l_returnflag || l_partkey) AS n FROM lineitem WHERE l_orderkey % 8 > 0),
 c AS (SELECT query_id, count(*) AS items, sum(n) AS chars FROM h GROUP BY query_id),
 w AS (SELECT s.query_id, string_agg('no_context_for_document:' || s.doc_id, ',' ORDER BY s.doc_id) AS warnings FROM s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = s.query_id AND h.doc_id = s.doc_id) GROUP BY s.query_id)
 SELECT o_orderkey AS query_id, coalesce(items, 0) AS items, CAST(coalesce(chars, 0) AS BIGINT) AS chars, coalesce(warnings, '') AS warnings FROM orders LEFT JOIN c ON c.query_id = o_orderkey LEFT JOIN w ON w.query_id = o_orderkey""")
def fus_context_report(spark, d):
    scopes = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("doc_id"))
    chosen = table(spark, d, "lineitem").filter("l_orderkey % 8 > 0").select(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") % 5).alias("doc_id"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"))
    return evidence.context_report(chosen, scopes).withColumn("warnings", F.array_join("warnings", ","))


@query("""SELECT l_orderkey AS question_id, v AS variant, l_linenumber AS rank, fault FROM (SELECT l_orderkey, l_linenumber, v, CASE WHEN l_partkey % 9 = 0 THEN 'unknown' WHEN l_partkey % 7 = 0 AND v = 'flat' THEN 'changed' WHEN l_linenumber > 3 THEN 'pages' END AS fault
  FROM lineitem, (SELECT unnest(['flat', 'structured']) AS v)) WHERE fault IS NOT NULL""")
def evl_present_hit_faults(spark, d):
    """Hits on parts; some parts are gone, some say something else in one variant, some hits have two spans or none with a page."""
    n = F.col("l_linenumber")
    spans = F.when(n > 5, F.array(F.struct(F.lit(1).alias("page")), F.struct(F.lit(2).alias("page")))).otherwise(F.array(F.struct(F.when(n <= 3, 1).alias("page"))))
    variant = F.explode(F.array(F.lit("flat"), F.lit("structured"))).alias("variant")
    hits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), variant, n.alias("rank"), F.col("l_partkey").alias("id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"), spans.alias("spans"))
    changed = F.when((F.col("id") % 7 == 0) & (F.col("variant") == "flat"), "!").otherwise("")
    parts = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct().filter("id % 9 > 0").select("id", variant)
    chunks = parts.withColumn("text", F.concat(F.lit("part "), F.col("id").cast("string"), changed))
    return review.present_hit_faults(hits, chunks)


@query("""WITH r AS (SELECT source || '/' || lang AS set_id, doc_id FROM documents WHERE doc_id % 6 > 0), s AS (SELECT DISTINCT source || '/' || lang AS set_id FROM documents UNION ALL SELECT 'nothing here')
 SELECT s.set_id, count(r.doc_id) AS rows, count(*) FILTER (r.doc_id % 10 = 0) AS faulty, CASE WHEN count(r.doc_id) = 0 THEN 'empty' WHEN count(*) FILTER (r.doc_id % 10 = 0) > 0 THEN 'rows' END AS problem FROM s LEFT JOIN r USING (set_id) GROUP BY s.set_id""")
def val_training_sets(spark, d):
    docs = table(spark, d, "documents").withColumn("set_id", F.concat_ws("/", "source", "lang"))
    rows = docs.filter("doc_id % 6 > 0").select("set_id", F.lit("a").alias("anchor"), F.lit("p").alias("positive"), F.when(F.col("doc_id") % 10 == 0, " ").otherwise("n").alias("negative"))
    sets = docs.select("set_id").unionByName(spark.createDataFrame([("nothing here",)], "set_id string"))
    return review.training_set_faults(rows, "triplet", sets)


@query("""WITH v AS (SELECT label AS build, vec_id, vec_id % 50 = 3 AS bad FROM embeddings WHERE label IS NOT NULL), i AS (SELECT build, count(*) + CASE WHEN build = 4 THEN 1 ELSE 0 END AS inputs FROM v GROUP BY build),
 m AS (SELECT build, count(*) AS vectors, count(*) FILTER (bad) AS faulty FROM v WHERE build <> 6 GROUP BY build)
 SELECT build, inputs, coalesce(vectors, 0) AS vectors, coalesce(faulty, 0) AS faulty, CASE WHEN inputs <> coalesce(vectors, 0) THEN 'count' WHEN faulty > 0 THEN 'vectors' END AS problem FROM i LEFT JOIN m USING (build)""")
def val_vector_sets(spark, d):
    """Builds by label: one has a text more than vectors, one no vectors, and some vectors have lost a component."""
    rows = table(spark, d, "embeddings").filter("label is not null").select(F.col("label").alias("build"), "vec_id", "embedding")
    more = rows.filter("build = 4").groupBy("build").agg(F.min("vec_id").alias("vec_id"), F.min_by("embedding", "vec_id").alias("embedding"))  # a text without a vector
    hurt = F.when(F.col("vec_id") % 50 == 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return lifecycle.vector_set_faults(rows.unionByName(more), rows.filter("build != 6").withColumn("vector", hurt), "build", 64)


@query("""SELECT source, lang, doc_id, text FROM documents WHERE source || lang IN (SELECT source || lang FROM documents WHERE doc_id % 97 = 5)""")
def src_read_records(spark, d):
    index = table(spark, d, "documents")
    return lifecycle.read_records(index, index.filter("doc_id % 97 = 5"), ["source", "lang"], ["doc_id", "text"])


@query("""SELECT o_orderkey AS relation_id, o_custkey % 7 AS tenant, o_custkey AS doc_id, o_orderpriority AS corpus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c_custkey = o_custkey AND c_nationkey % 7 = o_custkey % 7)""")
def grf_remove_document(spark, d):
    """A tenant's document goes from every corpus; the same document of another tenant stays."""
    key = F.col("o_custkey")
    relations = table(spark, d, "orders").select(F.col("o_orderkey").alias("relation_id"), (key % 7).alias("tenant"), key.alias("doc_id"), F.col("o_orderpriority").alias("corpus"))
    removed = table(spark, d, "customer").select((F.col("c_nationkey") % 7).cast("long").alias("tenant"), F.col("c_custkey").alias("doc_id"))
    return tables.remove_document_relations(relations, removed).select("relation_id", "tenant", "doc_id", "corpus")


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: pow(CAST(x AS DOUBLE), 2)))), 6) > 0 AS known, round(list_sum(list_transform(embedding, lambda x: pow(CAST(x AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 2))), 6) AS length2,
  round(CAST(embedding[1] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first FROM embeddings""")
def emb_l2_normalize(spark, d):
    unit = vectors.l2_normalize(F.col("embedding"))
    rows = table(spark, d, "embeddings").select("vec_id", (F.size(unit) > 0).alias("known"), unit.alias("u"))
    squares = F.aggregate("u", F.lit(0.0), lambda z, x: z + x * x)
    return rows.select("vec_id", "known", F.round(squares, 6).alias("length2"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query("""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, CAST(abs(e.vec_id - q.vec_id) % 13 AS DOUBLE) AS score FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
 SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 4""")
def vec_rank_pairs(spark, d):
    """Pairs of one label, in salted groups, as labels are few; the injected scorer reads both texts of a pair, which are numbers here."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"))
    # a stated number of tasks, as the input of a join is small and its output is not
    e = e.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)).cast("int")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "salt")
    pairs = e.join(q, ["label", "salt"]).filter("vec_id != query_id").select("query_id", F.col("vec_id").alias("id"), F.col("query_id").cast("string").alias("query"), F.col("vec_id").cast("string").alias("passage"))
    return evidence.rank_pairs(pairs, lambda a, b: (a.astype("int64") - b.astype("int64")).abs() % 13, 4)


@query("""SELECT doc_id, length(text) AS first, doc_id % 7 AS second, 2 AS size FROM documents""")
def emb_embed_batches(spark, d):
    """The injected embedder gets texts in batches and tells their lengths and last numbers."""
    rows = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("|"), (F.col("doc_id") % 7).cast("string")).alias("text"))
    made = evidence.embed_batches(rows, lambda texts: [[float(len(t.rsplit("|", 1)[0])), float(t.rsplit("|", 1)[1])] for t in texts], 2)
    return made.select("doc_id", F.get("vector", F.lit(0)).cast("long").alias("first"), F.get("vector", F.lit(1)).cast("long").alias("second"), F.size("vector").alias("size"))


@query("""SELECT CAST(vec_id AS VARCHAR) AS id, CASE vec_id % 20 WHEN 1 THEN 'missing' WHEN 2 THEN 'metadata' WHEN 3 THEN 'dimension' WHEN 4 THEN 'text' END AS fault FROM embeddings WHERE vec_id % 20 BETWEEN 1 AND 4
 UNION ALL SELECT 'x' || vec_id, 'extra' FROM embeddings WHERE vec_id % 20 = 5""")
def idx_verify_metadata(spark, d):
    n = F.col("vec_id") % 20
    kept = table(spark, d, "embeddings").select(
        "vec_id", F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("text"), F.col("embedding").alias("vector"), F.to_json(F.struct("label", "vec_id")).alias("metadata")
    )
    found = kept.filter(n != 1).withColumns({
        "metadata": F.when(n == 2, "{}").otherwise(F.col("metadata")), "vector": F.when(n == 3, F.slice("vector", 1, 60)).otherwise(F.col("vector")), "text": F.when(n == 4, "other").otherwise(F.col("text")),
    })
    more = kept.filter(n == 5).withColumn("id", F.concat(F.lit("x"), "id"))
    return lifecycle.verify_records(kept, found.unionByName(more), 64)


@query(f"""WITH r AS (SELECT label, sha256(sha256(CAST(vec_id AS VARCHAR))) AS r FROM embeddings), s AS (SELECT label, count(*) AS records, {_WORDS} FROM r GROUP BY label),
 m AS (SELECT label, CASE WHEN min(n) = max(n) THEN max(n) END AS dimension, string_agg(DISTINCT v, ',' ORDER BY v) AS versions FROM (SELECT label, 64 - CASE WHEN label = 3 AND vec_id % 2 = 0 THEN 1 ELSE 0 END AS n, 'v' || (vec_id % 3) || '/c' || (label % 2) AS v FROM embeddings) GROUP BY label)
 SELECT s.label, records, CAST(dimension AS INTEGER) AS dimension, sha256(CAST(records AS VARCHAR) || ',' || {" || ',' || ".join(f"w{i}" for i in range(8))}) AS ids_digest, versions FROM s JOIN m ON s.label IS NOT DISTINCT FROM m.label""")
def idx_build_summary(spark, d):
    """Builds by label; one has vectors of two lengths."""
    short = (F.col("label") == 3) & (F.col("vec_id") % 2 == 0)
    rows = table(spark, d, "embeddings").select(
        "label", "vec_id", F.when(short, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"),
        F.concat(F.lit("v"), (F.col("vec_id") % 3).cast("string")).alias("model"), F.concat(F.lit("c"), (F.col("label") % 2).cast("string")).alias("chunking"),
    )
    return lifecycle.build_summary(rows, "label", "vec_id", "vector", ["model", "chunking"]).withColumn("versions", F.array_join("versions", ","))
