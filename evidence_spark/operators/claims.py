"""Quotes, claims, reviews and relations: gates as joins and sums over keys."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.functions import text

# Ends of a paragraph or sentence, with the white space after them, where a window may be cut.
WINDOW_END = re.compile(r"\n\s*\n|[.!?。！？](?:\s+|$)")


@lru_cache(maxsize=16)  # quotes of a document stand together, so its text is read once
def normal_form(text: str) -> tuple[str, np.ndarray]:
    """The text in NFKC, character by character, and for each of its characters the place it comes from."""
    if text.isascii():
        return text, np.arange(len(text))
    parts = [unicodedata.normalize("NFKC", c) for c in text]
    return "".join(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


# Fixed value: characters whose letter case is one character each way; compared in lower case they match as a pattern without case does.
PLAIN_CASE = re.compile(r"[\x00-\xb4\xb6-\u012f\u0132-\u0148\u014a-\u017e\u2010-\u2027\u2030-\u205e\u3000-\u30ff\u4e00-\u9fff]*")


@lru_cache(maxsize=16)
def flat_form(plain: str, fold: bool) -> str | None:
    """The text with single blanks between its words and, with `fold`, in lower case; null where that doesn't match as a pattern does."""
    if fold and not PLAIN_CASE.fullmatch(plain):
        return None
    flat = " ".join(plain.split())
    return flat.lower() if fold else flat


def located(quote: str | None, text: str | None, fold: bool = False) -> tuple[int | None, int | None, str | None]:
    """(start, end, reason): the one place of a quote in a text; offsets are those of the text.

    The quote's words must follow each other with white space of any kind and length between them; matches do not overlap.
    """
    if text is None:
        return None, None, "unknown_evidence"
    words = unicodedata.normalize("NFKC", quote or "").split()
    if not words:
        return None, None, "quote_not_found"
    plain, place = normal_form(text)
    flat, sought = flat_form(plain, fold), flat_form(" ".join(words), fold)
    if flat is not None and sought is not None:  # most quotes need no pattern, which takes longer to make than to use
        at = flat.find(sought)
        if at < 0:
            return None, None, "quote_not_found"
        if flat.find(sought, at + len(sought)) >= 0:
            return None, None, "ambiguous_quote"
        if len(flat) == len(plain):  # blanks stand alone, so places are the same
            return int(place[at]), int(place[at + len(sought) - 1]) + 1, None
    found = re.compile(r"\s+".join(map(re.escape, words)), re.IGNORECASE if fold else 0).finditer(plain)
    first, second = next(found, None), next(found, None)
    if first is None or second is not None:
        return None, None, "ambiguous_quote" if first else "quote_not_found"
    return int(place[first.start()]), int(place[first.end() - 1]) + 1, None


def locate_quote(quote: Column, text: Column, fold: bool = False) -> Column:
    """Struct of char_start, char_end and reason: where a quote stands, white space and compatibility forms aside; it must be unique."""

    @F.pandas_udf("char_start int, char_end int, reason string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for quotes, texts in batches:
            rows = [located(q, t, fold) for q, t in zip(quotes, texts)]
            yield pd.DataFrame(rows, columns=["char_start", "char_end", "reason"]).astype({"char_start": "Int32", "char_end": "Int32", "reason": "object"})

    return run(quote, text)


def _lists(values: Iterable[list[tuple] | None], kind: pa.StructType) -> pa.Array:
    """Arrow lists of structs from lists of tuples, one value at a time: only its numbers are kept, neither texts nor objects of rows."""
    columns: list[list] = [[] for _ in kind]
    ends: list[int | None] = [0]
    for value in values:
        for row in value or ():
            for column, x in zip(columns, row, strict=True):
                column.append(x)
        if value is None:
            ends[-1] = None  # a null list begins nowhere
        ends.append(len(columns[0]))
    made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)


def locate_quotes(quotes: Column, text: Column, fold: bool = False) -> Column:
    """locate_quote for an array of quotes of one text, in their order; the text is read once. Null arrays give null."""

    kind = pa.struct([("char_start", pa.int32()), ("char_end", pa.int32()), ("reason", pa.string())])

    @F.arrow_udf("array<struct<char_start:int,char_end:int,reason:string>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for many, texts in batches:
            rows = ((qs.as_py(), t.as_py()) for qs, t in zip(many, texts, strict=True))
            yield _lists((None if qs is None else [located(q, t, fold) for q in qs] for qs, t in rows), kind)

    return run(quotes, text)


def locate_anchors(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """gold (anchor_id, doc_id, page, anchor) with the place of each anchor on its page; letter case does not count."""
    one = gold.join(pages.select("doc_id", "page", F.col("text").alias("_t")), ["doc_id", "page"], "left")
    return one.withColumn("found", locate_quote(F.col("anchor"), F.col("_t"), True)).drop("_t")


def quote_on_page(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """citations (citation_id, doc_id, page, quote) with ok: the page holds the quote, of three characters or more.

    Both are in compatibility form with each run of white space as one blank.
    """
    flat = lambda c: text.strip(F.regexp_replace(text.nfkc(c), r"(?U)\s+", " "))
    joined = citations.join(pages.select("doc_id", "page", F.col("text").alias("_t")), ["doc_id", "page"], "left")
    ok = (F.length(flat(F.col("quote"))) >= 3) & F.contains(flat(F.col("_t")), flat(F.col("quote")))
    return joined.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_t")


def window_ranges(text: str | None, width: int) -> list[tuple[int, int]]:
    """Windows that follow each other over the whole text, cut after the last end of a sentence or paragraph in their second half, else hard."""
    out, at, text = [], 0, text or ""
    while at < len(text):
        end = len(text)
        if at + width < end:
            end = at + width
            last = max((m.end() for m in WINDOW_END.finditer(text[at:end])), default=0)
            end = at + last if 2 * last >= width else end
        out.append((at, end))
        at = end
    return out


def citation_windows(text: Column, width: int = 1600) -> Column:
    """Array of windows (start, end) of a text."""

    kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _lists((window_ranges(t.as_py(), width) for t in texts), kind)

    return run(text)


#: Parts into which the picks of one window are dealt by their claim, so that a window that many claims name is in no single task.
SALTS = 32


def resolve_support(picks: DataFrame, windows: DataFrame, limit: int = 1600) -> DataFrame:
    """(claim_id, char_start, char_end, reason): the interval that encloses a claim's windows, if all are known, differ and it is short.

    `picks`: claim_id, window_id; `windows`: window_id, start, end. Picks of a hot window are dealt into salted parts.
    """
    known = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # equal picks are counted first, so no claim's distinct windows are kept beside its sums
    named = picks.groupBy("claim_id", "window_id").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", F.pmod(F.xxhash64("claim_id"), F.lit(SALTS)).cast("int"))
    joined = named.join(known, ["window_id", "salt"], "left").groupBy("claim_id").agg(
        F.min("start").alias("s"), F.max("end").alias("e"), F.bool_or(F.col("start").isNull()).alias("unknown"), (F.max("n") > 1).alias("twice")
    )
    reason = F.when(F.col("unknown"), "unknown_window").when(F.col("twice"), "duplicate_window").when(F.col("e") - F.col("s") > limit, "too_long")
    return joined.select("claim_id", F.when(reason.isNull(), F.col("s")).alias("char_start"), F.when(reason.isNull(), F.col("e")).alias("char_end"), reason.alias("reason"))


def source_spans(quotes: DataFrame, blocks: DataFrame, gap: int = 2) -> DataFrame:
    """(claim_id, block_no, char_start, char_end, page): the parts of a quote in the blocks of its document, joins left out.

    `quotes`: claim_id, doc_id, q_start, q_end; `blocks`: doc_id, block_no, chars, page.
    """
    start = F.coalesce(F.sum(F.col("chars") + gap).over(Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("s", start)
    lo, hi = F.greatest("q_start", "s") - F.col("s"), F.least(F.col("q_end"), F.col("s") + F.col("chars")) - F.col("s")
    cut = quotes.join(placed, "doc_id").filter((F.col("q_start") < F.col("s") + F.col("chars")) & (F.col("q_end") > F.col("s")))
    return cut.select("claim_id", "block_no", lo.alias("char_start"), hi.alias("char_end"), "page")


def numeric_gate(statement: Column, quote: Column) -> Column:
    """Null where each number of a statement stands in its quote, as an equal decimal, else `numeric_value_not_in_quote`. Null texts hold no numbers."""
    told, shown = (text.numbers(F.coalesce(c, F.lit(""))) for c in (statement, quote))
    return F.when(F.size(F.array_except(told, shown)) > 0, "numeric_value_not_in_quote")


def dedupe_claims(drafts: DataFrame) -> DataFrame:
    """drafts (draft_no, doc_id, facet, reason) with duplicate_facet as the reason of all valid ones but the first of a document's facet.

    The first is found by an aggregate, so a busy document is summed up before the shuffle.
    """
    first = drafts.filter("reason is null").groupBy("doc_id", "facet").agg(F.min("draft_no").alias("_first"))
    reason = F.when(F.col("reason").isNull() & (F.col("draft_no") > F.col("_first")), "duplicate_facet").otherwise(F.col("reason"))
    return drafts.join(first, ["doc_id", "facet"], "left").withColumn("reason", reason).drop("_first")


def assess(checks: DataFrame, names: tuple[str, ...] = ("attribution", "conditions", "entailment")) -> DataFrame:
    """checks with status and reason: supported if all pass; contradicted if a failed one says so and is grounded in the quote; else insufficient.

    Each check is a struct column of its name: verdict (pass, fail, contradicted), grounded, reason.
    """
    failed = F.array_compact(F.array(*[F.when(F.coalesce((F.col(n)["verdict"] != "pass") | ~F.col(n)["grounded"], F.lit(True)), F.concat(F.lit(n + ":"), F.coalesce(F.col(n)["reason"], F.lit("")))) for n in names]))
    against = F.lit(False)
    for n in names:
        against = against | F.coalesce((F.col(n)["verdict"] == "contradicted") & F.col(n)["grounded"], F.lit(False))
    status = F.when(F.size(failed) == 0, "supported").when(against, "contradicted").otherwise("insufficient")
    return checks.withColumns({"status": status, "reason": F.substring(F.array_join(failed, "; "), 1, 400)})


def verify_claims(claims: DataFrame, judgments: DataFrame) -> DataFrame:
    """(claim_id, status, reason): gates first, then the one judgment of the claim. `claims`: claim_id, exact, numeric, condition (booleans).

    `judgments`: claim_id, status. Several judgments of one claim count as none.
    """
    one = judgments.groupBy("claim_id").agg(F.min("status").alias("j"), F.count(F.lit(1)).alias("n"))
    gate = F.when(~F.coalesce("exact", F.lit(False)), "quote_not_exact").when(~F.coalesce("numeric", F.lit(False)), "numeric_value_not_in_quote").when(~F.coalesce("condition", F.lit(True)), "condition_not_affirmed")
    reason = F.coalesce(gate, F.when(F.col("n") > 1, "duplicate_judgment"), F.when(F.col("j").isNull(), "judge_did_not_verify_claim"))
    return claims.join(one, "claim_id", "left").select("claim_id", F.when(reason.isNull(), F.col("j")).otherwise("insufficient").alias("status"), reason.alias("reason"))


def merge_reports(reports: DataFrame, sources: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, problem): what keeps reports of single documents from being one. `reports`: doc_id, report_id, claims; `sources`: doc_id."""
    each = reports.groupBy("doc_id").agg(F.count_distinct("report_id").alias("n"), F.max("claims").alias("claims"))
    joined = sources.select("doc_id", F.lit(True).alias("known")).join(each, "doc_id", "full")
    problem = F.when(F.col("known").isNull(), "foreign").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("claims") > most, "too_many_claims")
    return joined.select("doc_id", problem.alias("problem")).filter("problem is not null")


def review_assertions(claims: DataFrame, assertions: DataFrame) -> DataFrame:
    """(claim_id, status): contradicted if a part is, insufficient if a part is missing or not supported, else supported; never better than the baseline.

    `claims`: claim_id, length, baseline; `assertions`: claim_id, start, end, status. The parts must cover the statement without gaps.
    """
    before = F.coalesce(F.lag("end").over(Window.partitionBy("claim_id").orderBy("start", "end")), F.lit(0))
    parts = assertions.withColumn("joins", (before == F.col("start")) & (F.col("end") > F.col("start"))).groupBy("claim_id").agg(
        F.bool_and("joins").alias("whole"), F.max("end").alias("last"), F.bool_or(F.col("status") == "contradicted").alias("bad"), F.bool_and(F.coalesce(F.col("status") == "supported", F.lit(False))).alias("good"), F.count(F.lit(1)).alias("n")
    )
    full = F.col("whole") & (F.col("last") == F.col("length")) & (F.col("n") <= 8)
    found = F.when(~F.coalesce(full, F.lit(False)), "insufficient").when(F.col("bad"), "contradicted").when(F.col("good"), "supported").otherwise("insufficient")
    status = F.when(F.col("baseline") == "supported", found).otherwise(F.col("baseline"))
    return claims.join(parts, "claim_id", "left").select("claim_id", status.alias("status"))


def review_overlay(claims: DataFrame, events: DataFrame) -> DataFrame:
    """claims (claim_id, status) with the last decision of a reviewer; a withdrawn claim is insufficient. `events`: claim_id, sequence, decision."""
    last = events.groupBy("claim_id").agg(F.max_by("decision", "sequence").alias("_d"))
    review = F.when(F.col("_d") == "retain", "retained").when(F.col("_d") == "withdraw", "withdrawn").otherwise("unreviewed")
    joined = claims.join(last, "claim_id", "left").withColumn("review", review).drop("_d")
    return joined.withColumn("status", F.when(F.col("review") == "withdrawn", "insufficient").otherwise(F.col("status")))


def check_event_chain(events: DataFrame) -> DataFrame:
    """(task_id, events, broken): events whose sequence, revision or link to the one before is wrong. `events`: task_id, event_id, sequence, revision, previous."""
    w = Window.partitionBy("task_id").orderBy("sequence", "event_id")
    ok = (F.col("sequence") == F.row_number().over(w)) & F.col("previous").eqNullSafe(F.lag("event_id").over(w)) & (F.col("revision") == F.coalesce(F.lag("revision").over(w) + 1, F.col("revision")))
    return events.withColumn("ok", F.coalesce(ok, F.lit(False))).groupBy("task_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.col("ok")).alias("broken"))


def partial_report(claims: DataFrame, verdicts: DataFrame, batches: DataFrame) -> DataFrame:
    """(claim_id, status, reason): committed verdicts stay; other claims are insufficient, with the reason of their batch.

    `claims`: claim_id, doc_id; `verdicts`: claim_id, status; `batches`: doc_id, state, reason.
    """
    joined = claims.join(batches.select("doc_id", "state", "reason"), "doc_id", "left").join(verdicts, "claim_id", "left")
    kept = F.coalesce(F.col("state") == "committed", F.lit(False)) & F.col("status").isNotNull()
    why = F.when(~kept, F.coalesce("reason", F.when(F.col("state").isNull(), "batch_missing").otherwise("batch_not_committed")))
    return joined.select("claim_id", F.when(kept, F.col("status")).otherwise("insufficient").alias("status"), why.alias("reason"))


def gap_list(cells: DataFrame) -> DataFrame:
    """Cells of a comparison that are not supported, as doc:facet:state, numbered in order within each document."""
    gap = F.concat_ws(":", F.col("doc_id").cast("string"), "facet", "state")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("facet"))
    return cells.filter("state != 'supported'").select("doc_id", n.alias("n"), gap.alias("gap"))


def preceding_context(claims: DataFrame, chunks: DataFrame, budget: int = 4000) -> DataFrame:
    """(claim_id, chunks): the cited chunk and up to two before it, nearest first, until one exceeds the budget.

    `claims`: claim_id, chunk_id; `chunks`: chunk_id, doc_id, chunk_index, chars.
    """
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    near = chunks.select("chunk_id", "chars", *[F.lag(F.struct("chunk_id", "chars"), i).over(w).alias(f"b{i}") for i in (1, 2)])
    one = F.col("b1").isNotNull() & (F.col("chars") + F.col("b1.chars") <= budget)
    two = one & F.col("b2").isNotNull() & (F.col("chars") + F.col("b1.chars") + F.col("b2.chars") <= budget)
    ids = F.array_compact(F.array(F.when(two, F.col("b2.chunk_id")), F.when(one, F.col("b1.chunk_id")), F.col("chunk_id")))
    return claims.join(near, "chunk_id").select("claim_id", ids.alias("chunks"))


def validate_relations(relations: DataFrame, chunks: DataFrame, most: int = 100) -> DataFrame:
    """(relation_id, problem). `relations`: relation_id, doc_id, chunk_id, subject, object, quote, char_start, char_end; `chunks`: chunk_id, text."""
    count = relations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    twice = relations.groupBy("relation_id").agg(F.count(F.lit(1)).alias("same"))
    joined = relations.join(chunks, "chunk_id", "left").join(count, "doc_id").join(twice, "relation_id")
    exact = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("quote")
    named = F.contains(F.lower("quote"), F.lower("subject")) & F.contains(F.lower("quote"), F.lower("object"))
    problem = F.when(~F.coalesce(exact, F.lit(False)), "quote").when(~F.coalesce(named, F.lit(False)), "entity").when(F.col("same") > 1, "duplicate").when(F.col("n") > most, "too_many")
    return joined.select("relation_id", problem.alias("problem")).filter("problem is not null")


def entity_mentions(relations: DataFrame) -> DataFrame:
    """(tenant, entity, label, mentions): names in compatibility form with blanks squeezed and without letter case, their first label and in how many relations they occur."""
    rows = relations.select("tenant", "relation_id", F.explode(F.array("subject", "object")).alias("name"))
    entity = text.strip(F.regexp_replace(text.folded(F.col("name")), r"(?U)\s+", " "))
    return rows.withColumn("entity", entity).groupBy("tenant", "entity").agg(F.min_by("name", F.struct("relation_id", "name")).alias("label"), F.count_distinct("relation_id").alias("mentions"))
