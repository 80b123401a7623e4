"""Selection of evidence for a batch of queries under budgets, and checks of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.operators.search import best

# Words that tell whose procedure a text describes, and words about an index.
OWN, PROCEDURE = ("we", "our"), ("apply", "encode", "build", "refresh", "update", "offline", "inference")
OTHERS, INDEX = ("their", "they"), ("index", "indexes", "indices", "indexing")


def search_members(hits: DataFrame, n: int) -> DataFrame:
    """The n best of each query over members of an index. `hits`: query_id, member, doc_id, chunk_index, score.

    First n of each member, which are few, then n of all, so no query gathers all its hits.
    """
    order = [F.desc("score"), "doc_id", "chunk_index"]
    return best(best(hits, ["query_id", "member"], order, n).drop("rank"), ["query_id"], order, n)


def foreign_hits(hits: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, member, doc_id, n): hits that a member's own document did not give; each makes the search of its query an error.

    `hits`: query_id, member, doc_id; `members`: member, document_id. Hits of members that the index doesn't name are foreign too.
    """
    named = members.select("member", F.col("document_id").alias("_own"))
    other = ~F.coalesce(F.col("doc_id") == F.col("_own"), F.lit(False))
    return hits.join(named, "member", "left").filter(other).groupBy("query_id", "member", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def search_whole_members(hits: DataFrame, members: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(found, errors): `search_members` for the queries all of whose hits lie in the document of their member, and the hits that do not.

    A query with a foreign hit gets no rows, as its index is not what it says.
    """
    errors = foreign_hits(hits, members)
    return search_members(hits.join(errors.select("query_id").distinct(), "query_id", "left_anti"), n), errors


def apply_rerank(hits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The k first candidates in the order of a reranker; queries it gave nothing for keep their dense order, with a warning.

    `hits`: query_id, position (from 0), id; `scores`: query_id, position, score. Scores of unknown positions are left out.
    """
    joined = hits.join(scores.groupBy("query_id", "position").agg(F.max("score").alias("rerank_score")), ["query_id", "position"], "left")
    any_ = F.count("rerank_score").over(Window.partitionBy("query_id"))
    joined = joined.withColumn("warning", F.when(any_ == 0, "rerank_unavailable")).filter("rerank_score is not null or warning is not null")
    return best(joined, ["query_id"], [F.desc_nulls_last("rerank_score"), "position"], k)


def parse_rerank_payload(payload: Column) -> Column:
    """Array of (position, score) from a reranker's JSON: `results` or `output.results`; items without a position go."""
    item = "array<struct<index:string,relevance_score:string,score:string>>"
    read = F.from_json(payload, f"struct<results:{item},output:struct<results:{item}>>")
    found = F.coalesce(read["results"], read["output"]["results"], F.array().cast(item))
    pairs = F.transform(found, lambda x: F.struct(
        x["index"].try_cast("int").alias("position"),
        F.coalesce(F.coalesce(x["relevance_score"], x["score"], F.lit("0")).try_cast("double"), F.lit(0.0)).alias("score"),
    ))
    return F.filter(pairs, lambda x: x["position"].isNotNull())


#: Scored pairs that a task holds before it keeps the first k of each query; what is still more than half goes on to the window.
HELD_PAIRS = 1 << 18


def rank_pairs(pairs: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], k: int) -> DataFrame:
    """The k passages of each query that a scoring function likes best. `pairs`: query_id, id, query, passage.

    Each task keeps the k best of its queries as pairs pass, so a window sorts these and not all pairs.
    """
    most = HELD_PAIRS

    def first(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts).sort_values("id", na_position="first").sort_values("score", ascending=False, kind="stable")
        return rows.groupby("query_id", sort=False, dropna=False).head(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, least = [], 0, None
        for rows in batches:
            rows = pd.DataFrame({"query_id": rows["query_id"], "id": rows["id"], "score": score(rows["query"], rows["passage"]).astype("float64")})
            held.append(rows if least is None else rows[~(rows["score"] < rows["query_id"].map(least))])
            n += len(held[-1])
            if n > most:
                held = [first(held)]
                n, least = len(held[0]), held[0].groupby("query_id").nth(k - 1).set_index("query_id")["score"]
                if 2 * n > most:
                    yield held[0]
                    held, n = [], 0
        if held:
            yield first(held)

    kinds = dict(pairs.dtypes)
    scored = pairs.select("query_id", "id", "query", "passage").mapInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    return best(scored, ["query_id"], [F.desc("score"), "id"], k)


def embed_batches(rows: DataFrame, embed: Callable[[list[str]], list], dim: int, batch: int = 16) -> DataFrame:
    """Adds vector by an injected function that gets at most `batch` texts; a wrong number or length is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = part["text"].fillna("").tolist()
            vecs = [v for i in range(0, len(texts), batch) for v in embed(texts[i : i + batch])]
            if len(vecs) != len(texts) or any(len(v) != dim for v in vecs):
                raise ValueError("the embedder gave a wrong number or length of vectors")
            yield part.assign(vector=vecs)

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, vector array<double>")


def build_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): numbered texts with file name and page or place. `hits`: query_id, rank, file_name, page, chunk_index, text."""
    where = F.when(F.col("page").isNotNull(), F.format_string("第 %d 页", "page")).otherwise(F.format_string("第 %d 个片段", F.col("chunk_index") + 1))
    block = F.concat(F.format_string("[%d] 《%s》—— ", "rank", "file_name"), where, F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda x: x["b"]), "\n\n").alias("context"))


def expand_concepts(text: Column, tokens: Column, concepts: dict[str, list[str]], n: int = 64) -> Column:
    """The first n distinct tokens in order, with the synonyms of concepts that occur in the text."""
    extra = [F.when(text.contains(key), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for key, words in concepts.items()]
    return F.slice(F.array_sort(F.array_distinct(F.concat(tokens, *extra))), 1, n)


def index_intent(text: Column) -> Column:
    """Whether a query is about an index."""
    return text.contains("索引") | text.rlike(r"(?i)\bindex(es|ing)?\b")


def source_role(query: Column, tokens: Column) -> Column:
    """2: own procedure; 0: cited work of others; else 1, also for all texts of queries about speed."""
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    cited = F.array_contains(tokens, "et") & F.array_contains(tokens, "al") & has(OTHERS)
    role = F.when(has(OWN) & has(PROCEDURE), 2).when(cited & ~has(OWN), 0).otherwise(1)
    return F.when(query.rlike(r"(?i)速度|延迟|性能|\b(speed|latency|performance)\b"), 1).otherwise(role)


def repair_dense(hits: DataFrame, k: int) -> DataFrame:
    """Dense hits of each query, with one sparse hit about an index for each document whose own hits name none.

    `hits`: query_id, channel (dense or sparse), rank, chunk_id, doc_id, doc_order, about_index. A document's hit is appended while there
    is room, in the order of documents, and else replaces the document's last dense hit. Room is shared in order, which a window counts.
    """
    dense = best(hits.filter("channel = 'dense'").groupBy("query_id", "chunk_id", "doc_id", "doc_order").agg(F.min("rank").alias("at"), F.bool_or("about_index").alias("about_index")), ["query_id"], ["at", "chunk_id"], k)
    poor = dense.groupBy("query_id", "doc_id", "doc_order").agg(F.bool_or("about_index").alias("good"), F.max("rank").alias("last")).filter("not good").drop("good")
    sparse = hits.filter("channel = 'sparse' and about_index").select("query_id", "doc_id", "chunk_id", F.col("rank").alias("s"))
    fresh = sparse.join(dense, ["query_id", "chunk_id"], "left_anti").join(poor, ["query_id", "doc_id"])
    one = best(fresh, ["query_id", "doc_id"], ["s", "chunk_id"], 1).drop("rank", "s")
    used = dense.groupBy("query_id").agg(F.count(F.lit(1)).alias("used"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_order", "doc_id"))
    placed = one.join(used, "query_id").withColumn("place", F.col("used") + nth)
    placed = placed.withColumn("place", F.when(F.col("place") <= k, F.col("place")).otherwise(F.col("last"))).select("query_id", "place", "chunk_id")
    kept = dense.select("query_id", F.col("rank").alias("place"), "chunk_id").join(placed.select("query_id", "place"), ["query_id", "place"], "left_anti")
    return kept.unionByName(placed)


def scope_filter(hits: DataFrame, scopes: DataFrame) -> DataFrame:
    """Hits of documents in the scope of their query."""
    return hits.join(scopes, ["query_id", "doc_id"], "left_semi")


def select_evidence(hits: DataFrame, max_items: int, max_chars: int, reserve: Column | None = None) -> DataFrame:
    """(query_id, items, chars, warnings): candidates taken in their order (place) while budgets last.

    `hits`: query_id, place, chunk_id, chars. A candidate over the budget is lost for good. Where `reserve` (a column of the query, true
    or false) holds, a fifth of the characters is kept for later, but for the first item. The candidates of a query come from a top-k,
    so its list is small; the walk is a fold over it.
    """
    held = F.coalesce(F.first(reserve), F.lit(False)) if reserve is not None else F.lit(False)
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", F.col("chars").cast("long").alias("chars")))).alias("c"), held.alias("held"))
    kind = dict(hits.dtypes)["chunk_id"]
    seed = F.when(F.col("held"), F.greatest(F.lit(1), F.lit(max_chars * 4 // 5))).otherwise(F.lit(max_chars))
    start = F.struct(F.lit(0).cast("long").alias("chars"), F.array().cast(f"array<{kind}>").alias("items"), F.array().cast("array<string>").alias("warnings"))

    def step(acc: Column, c: Column) -> Column:
        full = F.size(acc["items"]) >= max_items
        over = acc["chars"] + c["chars"] > max_chars
        late = (F.size(acc["items"]) > 0) & (acc["chars"] + c["chars"] > seed)
        warn = F.when(over, "candidate_budget_exceeded").when(late, "context_expansion_budget_reserved")
        take = ~full & ~over & ~late
        return F.struct(
            (acc["chars"] + F.when(take, c["chars"]).otherwise(0)).alias("chars"),
            F.when(take, F.array_append(acc["items"], c["chunk_id"])).otherwise(acc["items"]).alias("items"),
            F.when(~full & (over | late), F.array_union(acc["warnings"], F.array(warn))).otherwise(acc["warnings"]).alias("warnings"),
        )

    walked = lists.select("query_id", F.aggregate("c", start, step).alias("x"))
    return walked.select("query_id", "x.items", "x.chars", F.array_sort("x.warnings").alias("warnings"))


def expand_parents(groups: DataFrame, max_chars: int) -> DataFrame:
    """(query_id, chars, parents, warnings): selected children replaced by their parent, or a window of it, while the budget lasts.

    `groups`: query_id, place (of the first child), parent_id, old_chars (of its selected children), parent_chars, total (of all the
    query's items), windows (array of start and end, nearest sibling first). `parents` has parent_id, start and end.
    """
    kind = dict(groups.dtypes)["parent_id"]
    lists = groups.groupBy("query_id").agg(F.first("total").cast("long").alias("total"), F.array_sort(F.collect_list(F.struct("place", "parent_id", "old_chars", "parent_chars", "windows"))).alias("g"))
    start = F.struct(F.col("total").alias("chars"), F.array().cast(f"array<struct<parent_id:{kind},start:int,end:int>>").alias("parents"), F.array().cast("array<string>").alias("warnings"))

    def step(acc: Column, g: Column) -> Column:
        room = F.lit(max_chars) - acc["chars"] + g["old_chars"]
        fit = F.filter(g["windows"], lambda w: w["end"] - w["start"] <= room)
        whole = g["parent_chars"] <= room
        lo = F.when(whole, 0).otherwise(F.get(fit, F.lit(0))["start"]).cast("int")
        hi = F.when(whole, g["parent_chars"]).otherwise(F.get(fit, F.lit(0))["end"]).cast("int")
        warn = F.array_compact(F.array(F.when(~whole, "parent_budget_exceeded"), F.when(~whole & hi.isNotNull(), "compact_parent_window")))
        return F.struct(
            (acc["chars"] + F.coalesce(hi - lo - g["old_chars"], F.lit(0))).cast("long").alias("chars"),
            F.when(hi.isNull(), acc["parents"]).otherwise(F.array_append(acc["parents"], F.struct(g["parent_id"].alias("parent_id"), lo.alias("start"), hi.alias("end")))).alias("parents"),
            F.array_union(acc["warnings"], warn).alias("warnings"),
        )

    walked = lists.select("query_id", F.aggregate("g", start, step).alias("x"))
    return walked.select("query_id", "x.chars", "x.parents", F.array_sort("x.warnings").alias("warnings"))


def sibling_windows(parent: str | None, children, chosen) -> list[dict]:
    """Windows of one parent that hold all chosen children and one sibling, the nearest by index first."""
    parent = parent or ""
    at = {c["chunk_index"]: (s, s + len(c["text"])) for c in children if c["text"] and (s := parent.find(c["text"])) >= 0 and parent.find(c["text"], s + 1) < 0}
    picked = [i for i in chosen if i in at]
    if not picked or len(picked) < len(chosen):
        return []
    left, right = min(at[i][0] for i in picked), max(at[i][1] for i in picked)
    others = sorted((min(abs(i - j) for j in picked), i) for i in at if i not in set(picked))
    return [{"start": min(left, at[i][0]), "end": max(right, at[i][1])} for _, i in others]


def compact_windows(parent: Column, children: Column, chosen: Column) -> Column:
    """Array of windows (start, end) of a parent that hold all chosen children and one sibling, nearest first; empty if a chosen one is not unique.

    `children`: array of chunk_index and text; `chosen`: array of chunk_index. A child that stands twice in its parent, also overlapping
    itself, counts as not unique.
    """

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for parents, kids, picks in batches:
            yield pd.Series([sibling_windows(p, [] if k is None else k, [] if c is None else list(c)) for p, k, c in zip(parents, kids, picks)], dtype=object)

    return run(parent, children, chosen)


def coverage_warnings(selected: DataFrame, scopes: DataFrame) -> DataFrame:
    """(query_id, warnings): documents of each scope that have no item. `selected`: query_id, doc_id."""
    lost = scopes.join(selected, ["query_id", "doc_id"], "left_anti")
    text = F.concat(F.lit("no_context_for_document:"), F.col("doc_id").cast("string"))
    return lost.groupBy("query_id").agg(F.array_sort(F.collect_set(text)).alias("warnings"))


def context_report(selected: DataFrame, scopes: DataFrame) -> DataFrame:
    """(query_id, items, chars, warnings): what a query's context holds in all, and the sorted distinct warnings of documents without an item.

    `selected`: query_id, doc_id, text; `scopes`: query_id, doc_id. A row for each query of `scopes`.
    """
    sums = selected.groupBy("query_id").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    asked = scopes.select("query_id").distinct().join(sums, "query_id", "left").join(coverage_warnings(selected, scopes), "query_id", "left")
    none = F.array().cast("array<string>")
    return asked.select("query_id", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("warnings", none).alias("warnings"))


def verify_chunks(chunks: DataFrame, child: int, parent: int) -> DataFrame:
    """(doc_id, problems): rules that a document's chunks break: index, budget, parent.

    `chunks`: doc_id, is_parent, chunk_index, parent_index, section_path, text, tokens.
    """
    place = Window.partitionBy("doc_id", F.when(F.col("is_parent"), F.col("chunk_index")).otherwise(F.col("parent_index")))
    own = F.collect_list(F.when(F.col("is_parent"), F.struct("section_path", "text"))).over(place)
    seen = chunks.select("doc_id", "is_parent", "chunk_index", "parent_index", "section_path", "text", "tokens", own.alias("_own"))
    whole = lambda p: F.coalesce((p["section_path"] == F.col("section_path")) & F.contains(p["text"], F.col("text")), F.lit(False))
    orphan = ~F.col("is_parent") & (F.col("parent_index").isNull() | (F.size("_own") == 0) | ~F.forall("_own", whole))
    over = F.col("tokens") > F.when(F.col("is_parent"), parent).otherwise(child)
    rules = index_gaps(seen, {"orphan": F.bool_or(orphan), "over": F.bool_or(over)}, {"orphan": F.bool_or("orphan"), "over": F.bool_or("over")})
    found = F.array_compact(F.array(F.when(F.col("gap"), "index"), F.when(F.col("over"), "budget"), F.when(F.col("orphan"), "parent")))
    return rules.select("doc_id", found.alias("problems")).filter("size(problems) > 0")


def index_gaps(chunks: DataFrame, each: dict[str, Column], all_: dict[str, Column]) -> DataFrame:
    """(doc_id, gap, ...): whether the indexes of a document's parents, or those of its children, are other than 0, 1, 2 and so on, each once.

    Sums go by index (`each`: their other columns) and then by document (`all_`: sums of these), so chunks that are dealt by document are
    not shuffled, and others are not by document alone. The first sums have is_parent and n, the number of chunks.
    """
    kind = F.col("is_parent")
    sums = chunks.groupBy("doc_id", "is_parent", "chunk_index").agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in each.items()])

    def gap(k: Column) -> Column:
        n = F.coalesce(F.sum(F.when(k, F.col("n"))), F.lit(0))
        return (n != F.coalesce(F.max(F.when(k, F.col("chunk_index"))) + 1, F.lit(0))) | (n != F.count_if(k & F.col("chunk_index").isNotNull()))

    return sums.groupBy("doc_id").agg((gap(kind) | gap(~kind)).alias("gap"), *[c.alias(name) for name, c in all_.items()])
