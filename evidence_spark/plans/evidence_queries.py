"""Queries of retrieval, selection of evidence and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import structure, text
from evidence_spark.operators import evidence, search, sections
from evidence_spark.plans.base import query, table

_TOK = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+')"

# --- text and structured chunks


@query(r"""SELECT doc_id, 'Head ' || doc_id || chr(10) || '# kept_*' || chr(10) || '• ' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[ \t]{0,3}#{1,6}[ \t]+', '', 'g'), '(?m)^[ \t]{0,3}>[ \t]?', '', 'g'), '(?m)^[ \t]*[-*+][ \t]+', '• ', 'g'), '!\[[^\]\n]*\]\([^)\n]*\)', '', 'g'), '\[([^\]\n]*)\]\([^)\n]*\)', '\1', 'g'), '[*_`]', '', 'g') AS plain FROM documents""")
def txt_markdown_to_text(spark, d):
    marked = F.concat(F.lit("## *Head* "), F.col("doc_id").cast("string"), F.lit("\n```py\n# kept_*\n```\n- "), "text")
    return table(spark, d, "documents").select("doc_id", structure.markdown_to_text(marked).alias("plain"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


def _markdown_sql(marked: str) -> str:
    """Blocks by lines: a count of fence lines tells code, flags of headings and blank lines tell where blocks begin, a line before an underline is a heading."""
    marks = (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", r"(?m)^[ \t]{0,3}>[ \t]?")
    plain = "t"
    for mark in marks:
        plain = f"regexp_replace({plain}, '{mark}', '', 'g')"
    for mark, new in ((r"(?m)^[ \t]*[-*+][ \t]+", "• "), (r"!\[[^\]\n]*\]\([^)\n]*\)", ""), (r"\[([^\]\n]*)\]\([^)\n]*\)", r"\1"), ("[*_`]", ""), (r"[ \t\x{00a0}]+", " ")):
        plain = f"regexp_replace({plain}, '{mark}', '{new}', 'g')"
    plain = f"trim(regexp_replace({plain}, '\n{{3,}}', chr(10) || chr(10), 'g'), {_WS})"
    return rf"""WITH l AS (SELECT doc_id, unnest(string_split(m, chr(10))) AS line, generate_subscripts(string_split(m, chr(10)), 1) AS n FROM (SELECT doc_id, {marked} AS m FROM documents)),
 f AS (SELECT *, regexp_matches(line, '^[ \t]{{0,3}}(```|~~~)') AS fence FROM l),
 c AS (SELECT *, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS inside FROM f),
 k AS (SELECT *, CASE WHEN fence THEN 'fence' WHEN inside THEN 'code' WHEN regexp_matches(line, '^[ \t]{{0,3}}#{{1,6}}[ \t]+.+$') THEN 'heading' WHEN trim(line, {_WS}) = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM c),
 u AS (SELECT *, kind = 'paragraph' AND coalesce(lag(kind) OVER w, 'blank') <> 'paragraph' AND lead(kind) OVER w = 'paragraph' AND regexp_matches(lead(line) OVER w, '^[ \t]{{0,3}}(=+|-+)[ \t]*$') AS under FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
 v AS (SELECT *, coalesce(lag(under) OVER (PARTITION BY doc_id ORDER BY n), false) AS skip FROM u),
 s AS (SELECT *, CASE WHEN under THEN 'heading' ELSE kind END AS sort, under OR skip OR kind IN ('heading', 'blank', 'fence') OR coalesce(lag(CASE WHEN under OR skip OR kind IN ('heading', 'blank', 'fence') THEN 'x' ELSE kind END) OVER (PARTITION BY doc_id ORDER BY n), 'x') <> kind AS begins FROM v),
 g AS (SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM s),
 b AS (SELECT doc_id, grp, any_value(sort) AS kind, max(CASE WHEN under THEN 0 WHEN sort = 'heading' THEN length(regexp_extract(line, '#+')) END) AS marks, string_agg(line, chr(10) ORDER BY n) AS raw,
   any_value(n) AS n FROM g WHERE sort NOT IN ('fence', 'blank') AND NOT skip GROUP BY doc_id, grp),
 t AS (SELECT doc_id, grp, kind, raw, CASE WHEN marks > 0 THEN regexp_replace(regexp_replace(raw, '^[ \t]{{0,3}}#{{1,6}}[ \t]+', ''), '[ \t]+#+[ \t]*$', '') ELSE raw END AS t,
   CASE WHEN marks = 0 THEN (SELECT CASE WHEN line LIKE '%=%' THEN 1 ELSE 2 END FROM l WHERE l.doc_id = b.doc_id AND l.n = b.n + 1) ELSE marks END AS level FROM b),
 p AS (SELECT doc_id, grp, kind, level, CASE WHEN kind = 'code' THEN raw ELSE {plain} END AS text FROM t)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INTEGER) AS block_no, kind, CAST(level AS INTEGER) AS level, text FROM p WHERE trim(text, {_WS}) <> ''"""


@query(_markdown_sql("'# Top' || chr(10) || replace(text, '. ', '.' || chr(10) || chr(10) || '## Part ')"))
def txt_markdown_blocks(spark, d):
    marked = F.concat(F.lit("# Top\n"), F.replace("text", F.lit(". "), F.lit(".\n\n## Part ")))
    rows = table(spark, d, "documents").select("doc_id", F.explode(structure.markdown_blocks(marked)).alias("b"))
    return rows.select("doc_id", "b.block_no", "b.kind", "b.level", "b.text")


@query(_markdown_sql("'Top' || chr(10) || '===' || chr(10) || '```py' || chr(10) || '# code' || chr(10) || chr(10) || doc_id || chr(10) || '````' || chr(10) || '#  ' || chr(10) || replace(text, chr(10), chr(10) || '~~~' || chr(10))"))
def txt_markdown_fences(spark, d):
    """An underlined heading, a fence that a longer one closes, a heading without a title, and fences between all lines."""
    head = F.concat(F.lit("Top\n===\n```py\n# code\n\n"), F.col("doc_id").cast("string"), F.lit("\n````\n#  \n"))
    rows = table(spark, d, "documents").select("doc_id", F.explode(structure.markdown_blocks(F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n~~~\n"))))).alias("b"))
    return rows.select("doc_id", "b.block_no", "b.kind", "b.level", "b.text")


@query("""SELECT doc_id, trim(source) || ' | ' || CAST(n_chars AS VARCHAR) || CASE WHEN trim(lang) <> '' THEN ' | ' || trim(lang) ELSE '' END AS row_text FROM documents""")
def txt_table_rows(spark, d):
    cells = F.array(F.concat(F.lit(" "), "source", F.lit("\n")), F.lit("  "), F.col("n_chars").cast("string"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", structure.table_rows_to_text(cells).alias("row_text"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'clicked' WHEN 'view' THEN 'viewed' END AS reply FROM events""")
def txt_smalltalk(spark, d):
    said = F.concat(F.lit(" 。"), F.upper("event_type"), F.when(F.col("event_type") == "signup", " and much more").otherwise("！? "))
    presets = F.create_map(F.lit("click"), F.lit("clicked"), F.lit("view"), F.lit("viewed"))
    return table(spark, d, "events").select("event_id", F.try_element_at(presets, F.coalesce(structure.smalltalk_key(said), F.lit(""))).alias("reply"))


@query("""SELECT doc_id, text AS decoded FROM documents""")
def txt_decode_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", structure.decode_bytes(F.encode("text", "utf-8")).alias("decoded"))


@query("""SELECT doc_id, text AS decoded FROM documents""")
def txt_decode_utf16(spark, d):
    """Every second text of plain characters only comes as UTF-16, others as UTF-8."""
    said = F.col("text")
    plain = said.rlike(r"\A[\x01-\x7f]+\z")
    raw = F.when(plain & (F.col("doc_id") % 2 == 0), F.encode(said, "UTF-16")).otherwise(F.encode(said, "UTF-8"))
    return table(spark, d, "documents").select("doc_id", structure.decode_bytes(raw).alias("decoded"))


def line_blocks(spark, d):
    """The lines of documents as blocks of several kinds."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    i = F.col("block_no")
    return table(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("block_no", "text")).select(
        "doc_id", "block_no", F.when(i % 7 == 0, "heading").when(i % 11 == 5, "code").otherwise("paragraph").alias("kind"),
        F.when(i % 7 == 0, i % 3 + 1).cast("int").alias("level"), "text", (F.floor(i / 5) + 1).cast("int").alias("page"))


_LINES = rf"""WITH l AS (SELECT doc_id, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS block_no FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: trim(t) <> '') AS x FROM documents)),
 b AS (SELECT *, CASE WHEN block_no % 7 = 0 THEN 'heading' WHEN block_no % 11 = 5 THEN 'code' ELSE 'paragraph' END AS kind, CASE WHEN block_no % 7 = 0 THEN block_no % 3 + 1 END AS level FROM l WHERE trim(text, {_WS}) <> ''),
 h AS (SELECT doc_id, block_no, level, trim(text, {_WS}) AS title, (SELECT min(o.block_no) FROM b o WHERE o.doc_id = b.doc_id AND o.block_no > b.block_no AND o.level <= b.level) AS until FROM b WHERE level IS NOT NULL),
 p AS (SELECT b.doc_id, b.block_no, any_value(b.kind) AS kind, any_value(b.text) AS text, coalesce(string_agg(title, ' / ' ORDER BY h.level), '') AS path FROM b LEFT JOIN h ON h.doc_id = b.doc_id AND h.block_no <= b.block_no AND (until IS NULL OR b.block_no < until) GROUP BY b.doc_id, b.block_no),
 n AS (SELECT *, CAST(kind <> 'paragraph' OR coalesce(lag(kind) OVER w, 'code') = 'code' OR lag(path) OVER w <> path AS INTEGER) AS begins FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
 g AS (SELECT doc_id, block_no, text, path, CAST(sum(begins) OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS BIGINT) AS group_no FROM n)"""


@query(_LINES + " SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, group_no, path AS section_path FROM g")
def chk_section_groups(spark, d):
    """Here the titles that are still open are found by what ends them, in the operator by the last heading of each level."""
    found = sections.section_groups(line_blocks(spark, d))
    return found.select("doc_id", "block_no", "group_no", F.array_join("section_path", " / ").alias("section_path"))


@query(_LINES + """, o AS (SELECT *, sum(length(text) + 2) OVER (PARTITION BY doc_id, group_no ORDER BY block_no) - length(text) - 2 AS a FROM g),
 z AS (SELECT doc_id, group_no, sum(length(text) + 2) - 2 AS size FROM g GROUP BY doc_id, group_no),
 c AS (SELECT doc_id, group_no, size, unnest(range(0, CAST(size AS BIGINT), 450)) AS s FROM z)
 SELECT doc_id || ':' || c.group_no || ':' || s AS chunk_id, doc_id, c.group_no, CAST(block_no AS INTEGER) AS block_no, CAST(greatest(s, a) - a AS BIGINT) AS char_start, CAST(least(s + 500, a + length(text)) - a AS BIGINT) AS char_end
 FROM c JOIN o USING (doc_id) WHERE o.group_no = c.group_no AND greatest(s, a) < least(s + 500, size, a + length(text))""")
def chk_chunk_spans(spark, d):
    """Windows of 500 characters over each section, every 450, traced back to its blocks."""
    offsets = sections.block_offsets(sections.section_groups(line_blocks(spark, d)))
    size = offsets.groupBy("doc_id", "group_no").agg(F.max("char_end").alias("size"))
    chunks = size.select("doc_id", "group_no", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(450))).alias("start"))
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in ("doc_id", "group_no", "start")])
    return sections.chunk_spans(chunks.select(name.alias("chunk_id"), "doc_id", "group_no", "start", F.least(F.col("start") + 500, "size").alias("end")), offsets)


def structured(spark, d):
    return sections.structured_chunks(line_blocks(spark, d))


@query()
def chk_chunk_structured(spark, d):
    return structured(spark, d).drop("spans").withColumn("section_path", F.array_join("section_path", " / "))


@query("""SELECT doc_id, CAST(sum(length(regexp_replace(b, '\\s', '', 'g'))) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS b FROM documents) WHERE trim(b) <> '' AND length(regexp_replace(b, '\\s', '', 'g')) > 0 GROUP BY doc_id""".replace("\\\\s", r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"))
def chk_children_cover(spark, d):
    """Children hold every character of the blocks that is no white space, once."""
    kids = structured(spark, d).filter("not is_parent")
    return kids.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]", ""))).alias("chars"))


@query("""SELECT doc_id, 'x' AS problems FROM documents WHERE false""")
def chk_verify_chunks(spark, d):
    return evidence.verify_chunks(structured(spark, d), 256, 1024).select("doc_id", F.array_join("problems", ",").alias("problems"))


# --- retrieval

_LABEL = """WITH h AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.vec_id % 4 AS member, e.vec_id % 9 AS doc_id, abs(e.vec_id - q.vec_id) AS far FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)"""


def labels_asked(spark, d, asked: str):
    e = table(spark, d, "embeddings").select("vec_id", "label").filter("label is not null")
    return e, e.filter(asked).select(F.col("vec_id").alias("query_id"), "label")


def _row(hits):
    return hits.filter("query_id != id").select("query_id", "id", (F.col("id") % 4).alias("member"), (F.col("id") % 9).alias("doc_id"), F.abs(F.col("id") - F.col("query_id")).alias("far"))


def labelled(spark, d, asked: str = "vec_id % 100 = 0"):
    e, q = labels_asked(spark, d, asked)
    return _row(q.join(e.withColumnRenamed("vec_id", "id"), "label"))


def nearest(spark, d, asked: str, n: int, by: str | None = None):
    """The rows of `labelled` that can be among the n of least `far` of a query (and of each value of `by`)."""
    e, q = labels_asked(spark, d, asked)
    e = e.withColumnRenamed("vec_id", "id")
    if by is None:
        return _row(search.nearest_ids(q.withColumnRenamed("label", "key"), e.withColumnRenamed("label", "key"), n))
    e = e.withColumn("by", F.expr(by))
    q = q.crossJoin(e.select("by").distinct())  # the members of an index are few
    key = F.concat_ws(":", "label", "by").alias("key")
    return _row(search.nearest_ids(q.select("query_id", key), e.select("id", key), n))


@query(_LABEL + """, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, member ORDER BY far, doc_id, id) AS m FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY far, doc_id, id) AS rank FROM a WHERE m <= 8) SELECT query_id, member, id, rank FROM b WHERE rank <= 8""")
def vec_search_members(spark, d, asked="vec_id % 100 = 0"):
    hits = nearest(spark, d, asked, 8, "id % 4").select("query_id", "member", "doc_id", F.col("id").alias("chunk_index"), (-F.col("far")).alias("score"))
    return evidence.search_members(hits, 8).select("query_id", "member", F.col("chunk_index").alias("id"), "rank")


@query(_LABEL + """, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY far, id) - 1 AS position FROM h), t AS (SELECT * FROM p WHERE position < 12),
 s AS (SELECT *, CASE WHEN query_id % 3 > 0 AND position % 2 = 0 THEN id % 7 END AS sc FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC NULLS LAST, position) AS rank FROM s WHERE query_id % 3 = 0 OR sc IS NOT NULL)
 SELECT query_id, id, rank, CASE WHEN query_id % 3 = 0 THEN 'rerank_unavailable' END AS warning FROM r WHERE rank <= 5""")
def vec_apply_rerank(spark, d, asked="vec_id % 100 = 0"):
    hits = evidence.best(nearest(spark, d, asked, 12), ["query_id"], ["far", "id"], 12).select("query_id", (F.col("rank") - 1).alias("position"), "id")
    scores = hits.filter("query_id % 3 > 0 and position % 2 = 0").select("query_id", "position", (F.col("id") % 7).alias("score"))
    lost = scores.select("query_id", (F.col("position") + 100).alias("position"), "score")
    return evidence.apply_rerank(hits, scores.unionByName(lost), 5).select("query_id", "id", "rank", "warning")


@query("""SELECT event_id, 0 AS position, CAST(value AS DOUBLE) AS score FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, 1, 0.0::DOUBLE FROM events WHERE event_id % 3 < 2""")
def vec_parse_rerank(spark, d):
    items = F.concat(F.lit('[{"index":0,"relevance_score":'), F.col("value").cast("string"), F.lit('},{"relevance_score":1},{"index":"1","score":"none"}]'))
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"results":'), items, F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"output":{"results":'), items, F.lit("}}"))).otherwise("[broken")
    return table(spark, d, "events").select("event_id", F.explode(evidence.parse_rerank_payload(body)).alias("x")).select("event_id", "x.*")


@query(_LABEL + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY far, id) AS rank FROM h)
 SELECT query_id, string_agg('[' || rank || '] 《f' || doc_id || '》—— ' || CASE WHEN id % 2 = 0 THEN '第 ' || id || ' 页' ELSE '第 ' || id + 1 || ' 个片段' END || chr(10) || 't' || id, chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 5 GROUP BY query_id""")
def vec_build_context(spark, d, asked="vec_id % 100 = 0"):
    hits = evidence.best(nearest(spark, d, asked, 5), ["query_id"], ["far", "id"], 5)
    return evidence.build_context(hits.select("query_id", "rank", F.concat(F.lit("f"), "doc_id").alias("file_name"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("page"), F.col("id").alias("chunk_index"), F.concat(F.lit("t"), "id").alias("text")))


@query(f"""WITH t AS (SELECT item_id, text, list_distinct({_TOK} || CASE WHEN contains(text, 'the') THEN ['definite', 'article'] ELSE [] END) AS x FROM benchmark)
 SELECT item_id, array_to_string(list_sort(x)[1:64], ' ') AS terms, text LIKE '%索引%' OR regexp_matches(text, '(?i)\\bindex(es|ing)?\\b') AS about_index FROM t""")
def lex_expand_concepts(spark, d):
    terms = evidence.expand_concepts(F.col("text"), text.words(F.col("text")), {"the": ["definite", "article"], "索引": ["index"]})
    return table(spark, d, "benchmark").select("item_id", F.array_join(terms, " ").alias("terms"), evidence.index_intent(F.col("text")).alias("about_index"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 1 WHEN doc_id % 5 = 0 THEN 2 WHEN doc_id % 5 = 1 AND NOT list_has_any(t, ['we', 'our']) THEN 0 ELSE CASE WHEN list_has_any(t, ['we', 'our']) AND list_has_any(t, ['apply', 'encode', 'build', 'refresh', 'update', 'offline', 'inference']) THEN 2 WHEN list_has_all(t, ['et', 'al']) AND list_has_any(t, ['their', 'they']) AND NOT list_has_any(t, ['we', 'our']) THEN 0 ELSE 1 END END AS role
 FROM (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+') AS t FROM documents)""")
def lex_source_role(spark, d):
    more = F.when(F.col("doc_id") % 5 == 0, " we build").when(F.col("doc_id") % 5 == 1, " et al they").otherwise("")
    asked = F.when(F.col("doc_id") % 5 == 4, "Which latency?").otherwise("how")
    return table(spark, d, "documents").select("doc_id", evidence.source_role(asked, text.words(F.concat("text", more))).alias("role"))


@query()
def lex_repair_dense(spark, d, asked="vec_id % 100 = 0"):
    ranked = evidence.best(nearest(spark, d, asked, 40), ["query_id"], ["far", "id"], 40)
    hits = ranked.select("query_id", F.when(F.col("rank") % 2 == 0, "dense").otherwise("sparse").alias("channel"), "rank", F.col("id").alias("chunk_id"), "doc_id", F.col("doc_id").alias("doc_order"), (F.col("id") % 3 == 0).alias("about_index"))
    return evidence.repair_dense(hits, 10)


# --- bounded evidence


@query(_LABEL + " SELECT query_id, id FROM h WHERE doc_id IN (query_id % 9, (query_id + 1) % 9)")
def fus_scope_filter(spark, d, asked="vec_id % 100 = 0"):
    hits = labelled(spark, d, asked)
    scopes = labels_asked(spark, d, asked)[1].select("query_id").distinct().select("query_id", F.explode(F.array(F.col("query_id") % 9, (F.col("query_id") + 1) % 9)).alias("doc_id"))
    return evidence.scope_filter(hits, scopes).select("query_id", "id")


def candidates(spark, d, asked="vec_id % 100 = 0"):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 400 + 1).alias("chars"))
    places = evidence.best(nearest(spark, d, asked, 20), ["query_id"], ["far", "id"], 20).withColumnRenamed("rank", "place")
    return places.join(docs, "id").select("query_id", "place", F.col("id").alias("chunk_id"), "doc_id", "chars")


@query(_LABEL.replace("WITH", "WITH RECURSIVE") + """, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY far, id) AS place FROM h), c AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n, id, n_chars % 400 + 1 AS chars FROM p JOIN documents d ON d.doc_id = p.id WHERE place <= 20),
 w AS (SELECT query_id, 0::BIGINT AS n, 0::BIGINT AS total, 0::BIGINT AS items, ''::VARCHAR AS ids, CASE WHEN query_id % 2 = 0 THEN 800 ELSE 1000 END AS seed FROM (SELECT DISTINCT query_id FROM c)
 UNION ALL SELECT w.query_id, c.n, CASE WHEN ok THEN total + chars ELSE total END, CASE WHEN ok THEN items + 1 ELSE items END, CASE WHEN ok THEN ids || c.id || ' ' ELSE ids END, seed FROM w JOIN c ON c.query_id = w.query_id AND c.n = w.n + 1, LATERAL (SELECT items < 6 AND total + chars <= 1000 AND (items = 0 OR total + chars <= seed) AS ok))
 SELECT query_id, trim(ids) AS items, total AS chars FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC) AS z FROM w) WHERE z = 1""")
def fus_select_evidence(spark, d, asked="vec_id % 100 = 0"):
    hits = candidates(spark, d, asked)
    got = evidence.select_evidence(hits, 6, 1000, F.col("query_id") % 2 == 0)
    return got.select("query_id", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"), "chars")


@query()
def fus_expand_parents(spark, d, asked="vec_id % 100 = 0"):
    """Children are sentences, parents the documents; windows hold the chosen sentences and a near one."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.transform(text.sentences(F.col("text")), lambda s, i: F.struct(i.alias("chunk_index"), s.alias("text"))).alias("kids"))
    got = candidates(spark, d, asked).join(docs.withColumnRenamed("doc_id", "chunk_id"), "chunk_id").filter("size(kids) > 1")
    chosen = F.array(F.lit(0), F.lit(1))
    groups = got.select(
        "query_id", "place", F.col("chunk_id").alias("parent_id"), F.length(F.concat(F.col("kids")[0]["text"], F.col("kids")[1]["text"])).alias("old_chars"), F.length("text").alias("parent_chars"),
        evidence.compact_windows(F.col("text"), F.col("kids"), chosen).alias("windows"),
    )
    totals = groups.groupBy("query_id").agg(F.sum("old_chars").alias("total"))
    out = evidence.expand_parents(groups.join(totals, "query_id"), 6000)
    return out.select("query_id", "chars", F.to_json("parents").alias("parents"), F.array_join("warnings", ",").alias("warnings"))


@query(_LABEL + """ SELECT query_id, string_agg('no_context_for_document:' || s, ',' ORDER BY 'no_context_for_document:' || s) AS warnings FROM (SELECT DISTINCT query_id, unnest(range(0, 12)) AS s FROM h) x WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = x.query_id AND h.doc_id = s AND far < 60) GROUP BY query_id""")
def fus_coverage_warnings(spark, d, asked="vec_id % 100 = 0"):
    e, q = labels_asked(spark, d, asked)
    ids = q.select("query_id", "label", F.explode(F.sequence(F.col("query_id") - 59, F.col("query_id") + 59)).alias("id"))
    near = _row(ids.join(e.withColumnRenamed("vec_id", "id"), ["label", "id"]))
    shared = e.groupBy("label").agg(F.count_distinct("vec_id").alias("n")).filter("n > 1")  # a query needs another row of its label
    scopes = q.join(shared, "label", "left_semi").select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("doc_id"))
    return evidence.coverage_warnings(near, scopes).withColumn("warnings", F.array_join("warnings", ","))
