"""Scores of answers and rules for evaluation and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregate_variants(rows: DataFrame) -> DataFrame:
    """(variant, k, recall, complete, scored, unscored, chars). `rows`: variant, k, recall (null: not scored), context_chars."""
    return rows.groupBy("variant", "k").agg(
        F.round(F.avg("recall"), 6).alias("recall"), F.count_if(F.col("recall") == 1).alias("complete"), F.count("recall").alias("scored"), F.count_if(F.col("recall").isNull()).alias("unscored"), F.round(F.avg("context_chars"), 6).alias("chars")
    )


def diagnose_gaps(gold: DataFrame) -> DataFrame:
    """gold with its cause: covered, no hit, only in a parent over the budget, or left out by selection. Columns: covered, retrieved, in_parent, additional_chars."""
    cause = F.when(F.col("covered"), "covered").when(~F.col("retrieved") & ~F.col("in_parent"), "anchor_retrieval_gap").when(F.col("in_parent") & (F.col("additional_chars") > 0), "parent_context_budget").otherwise("selection_policy_gap")
    return gold.withColumn("cause", cause)


def score_answers(rows: DataFrame) -> DataFrame:
    """(round, passed, total, mean_elapsed). `rows`: round, answer, expected (array), cited (array of names), expected_doc, elapsed.

    The mean is the sum of positive times over all rows.
    """
    doc = F.exists("cited", lambda c: F.contains(c, F.col("expected_doc")))
    said = F.forall("expected", lambda e: F.contains(F.col("answer"), e))
    ok = F.coalesce(doc & said, F.lit(False))
    spent = F.sum(F.when(F.col("elapsed") > 0, F.col("elapsed")).otherwise(0.0))
    return rows.groupBy("round").agg(F.count_if(ok).alias("passed"), F.count(F.lit(1)).alias("total"), F.round(spent / F.count(F.lit(1)), 6).alias("mean_elapsed"))


def acceptance_score(answers: DataFrame) -> DataFrame:
    """(pack_id, questions, missing, pending, supported, claims, correct, status) of each pack.

    `answers`: pack_id, answerable, answered, abstained, correct (null: not reviewed), gap_correct, supported, claims. A pack passes if
    nothing is missing or pending, all answers are right, none abstains from an answerable question, nine of ten claims are supported
    and all gaps are right; it fails if it is complete and does not pass.
    """
    no = F.lit(False)
    given = F.coalesce("answered", no)
    sums = answers.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(~given).alias("missing"), F.count_if(given & F.col("correct").isNull()).alias("pending"),
        F.sum(F.coalesce("supported", F.lit(0))).cast("long").alias("supported"), F.sum(F.coalesce("claims", F.lit(0))).cast("long").alias("claims"), F.count_if(F.coalesce("correct", no)).alias("correct"),
        F.count_if(F.col("answerable") & F.coalesce("abstained", no)).alias("_shy"), F.bool_and(F.col("answerable") | F.coalesce("gap_correct", no)).alias("_gaps"),
    )
    ready = (F.col("missing") == 0) & (F.col("pending") == 0)
    good = (F.col("correct") == F.col("questions")) & (F.col("_shy") == 0) & (F.col("supported") * 10 >= F.col("claims") * 9) & F.col("_gaps")
    return sums.withColumn("status", F.when(~ready, "incomplete").when(good, "passed").otherwise("failed")).drop("_shy", "_gaps")


def verdict_confusion(rows: DataFrame) -> DataFrame:
    """(policy, exact, false_accepts, false_rejects, total). `rows`: policy, expected, actual."""
    want, got = F.col("expected") == "supported", F.coalesce(F.col("actual") == "supported", F.lit(False))
    return rows.groupBy("policy").agg(F.count_if(F.col("expected").eqNullSafe(F.col("actual"))).alias("exact"), F.count_if(~want & got).alias("false_accepts"), F.count_if(want & ~got).alias("false_rejects"), F.count(F.lit(1)).alias("total"))


def request_ledger(rows: DataFrame) -> DataFrame:
    """(run_id, attempted, succeeded, tokens, without_usage, status). `rows`: run_id, ok, tokens."""
    sums = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("succeeded"), F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"), F.count_if(F.col("ok") & F.col("tokens").isNull()).alias("without_usage"))
    return sums.withColumn("status", F.when(F.col("attempted") == F.col("succeeded"), "completed").otherwise("incomplete"))


def paired_plan(questions: DataFrame, variants: tuple[str, str]) -> DataFrame:
    """(question_id, slot, variant): both variants of each question, their order changing from one question to the next. `questions`: pack_id, question_id."""
    odd = (F.row_number().over(Window.partitionBy("pack_id").orderBy("question_id")) % 2) == 1
    pair = F.when(odd, F.array(*map(F.lit, variants))).otherwise(F.array(*map(F.lit, reversed(variants))))
    return questions.select("pack_id", "question_id", pair.alias("v")).select("pack_id", "question_id", F.posexplode("v").alias("slot", "variant"))


def paired_faults(questions: DataFrame, hits: DataFrame, variants: tuple[str, str], k: int, budget: int) -> DataFrame:
    """(question_id, variant, fault) of pairs that are missing or foreign, lack k unique first hits, or exceed the budget of characters.

    `questions`: question_id; `hits`: question_id, variant, rank (from 1), id, text.
    """
    asked = questions.select("question_id").distinct().select("question_id", F.explode(F.array(*map(F.lit, variants))).alias("variant"), F.lit(True).alias("asked"))
    first = F.col("rank") <= k
    sums = hits.groupBy("question_id", "variant").agg(
        F.count_if(first).alias("n"), F.count_distinct(F.when(first, F.col("id"))).alias("ids"), F.coalesce(F.sum(F.when(first, F.length("text"))), F.lit(0)).alias("chars")
    )
    fault = (
        F.when(F.col("asked").isNull(), "foreign").when(F.col("n").isNull(), "missing").when((F.col("n") != k) | (F.col("ids") != k), "hits").when(F.col("chars") > budget, "budget")
    )
    return asked.join(sums, ["question_id", "variant"], "full").select("question_id", "variant", fault.alias("fault")).filter("fault is not null")


def present_hit_faults(hits: DataFrame, chunks: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """(question_id, variant, rank, fault): stored hits that differ from the chunks of today.

    unknown: the variant has no chunk of this id; changed: one of the columns differs; pages: a hit has not exactly one span, with a page.
    `hits`: question_id, variant, rank, id, spans (array of structs with page) and the columns; `chunks`: variant, id and the columns.
    """
    now = chunks.select("variant", "id", F.struct(*columns).alias("_now"))
    paged = (F.coalesce(F.size("spans"), F.lit(0)) == 1) & F.try_element_at("spans", F.lit(1))["page"].isNotNull()
    fault = F.when(F.col("_now").isNull(), "unknown").when(~F.struct(*columns).eqNullSafe(F.col("_now")), "changed").when(~paged, "pages")
    return hits.join(now, ["variant", "id"], "left").select("question_id", "variant", "rank", fault.alias("fault")).filter("fault is not null")


def training_set_faults(rows: DataFrame, kind: str, sets: DataFrame) -> DataFrame:
    """(set_id, rows, faulty, problem): each named set with its rows and those with a fault; a set without rows is empty, which is an error.

    `rows`: set_id and the columns that `training_faults` reads; `sets`: set_id.
    """
    sums = rows.withColumn("_fault", training_faults(kind)).groupBy("set_id").agg(F.count(F.lit(1)).alias("rows"), F.count("_fault").alias("faulty"))
    joined = sets.select("set_id").distinct().join(sums, "set_id", "left")
    problem = F.when(F.col("rows").isNull(), "empty").when(F.col("faulty") > 0, "rows")
    return joined.select("set_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("faulty", F.lit(0)).alias("faulty"), problem.alias("problem"))


def ranking_rows(judged: DataFrame, keep: int) -> DataFrame:
    """(query_id, relevant, ranked): the number of relevant ids, and the first `keep` valid ids by score, joined by blanks; `keep` bounds what a row holds."""
    valid = judged.filter("id is not null and trim(coalesce(text, '')) <> ''").select("query_id", "id", "label", F.coalesce("score", F.lit(0.0)).alias("score"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    first = valid.withColumn("at", at).filter(F.col("at") <= keep)
    ranked = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("r"))
    relevant = valid.filter("label").groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    return ranked.join(relevant, "query_id", "left").select("query_id", F.coalesce("relevant", F.lit(0)).alias("relevant"), F.array_join(F.transform("r", lambda x: x["id"]), " ").alias("ranked"))


def ranking_places(judged: DataFrame, cuts: int = 128) -> DataFrame:
    """(query_id, place, id, label): all valid ids of each query by score, places from 1.

    Rows go to ranges of (query_id, score, id) between sampled keys; the numbers of the ranges before are added to the place
    within a range, so a busy query is spread over many tasks.
    """
    valid = judged.filter("id is not null and trim(coalesce(text, '')) <> ''").select("query_id", "id", "label", F.coalesce("score", F.lit(0.0)).alias("score"))
    key = F.struct("query_id", (-F.col("score")).alias("down"), "id")
    some = max(1, valid.count() // (32 * cuts))
    keys = [r["k"] for r in valid.filter(F.pmod(F.xxhash64("query_id", "id"), F.lit(some)) == 0).select(key.alias("k")).orderBy("k").collect()]
    keys = keys[:: max(1, len(keys) // cuts)]
    bounds = F.array(*[F.struct(F.lit(k["query_id"]).alias("query_id"), F.lit(k["down"]).alias("down"), F.lit(k["id"]).alias("id")) for k in keys])
    ranged = valid.withColumn("range", F.size(F.filter(bounds, lambda x: x <= key)) if keys else F.lit(0))
    before = Window.partitionBy("query_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("query_id", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    at = F.row_number().over(Window.partitionBy("query_id", "range").orderBy(F.desc("score"), "id"))
    sums = F.broadcast(sums.select(F.col("query_id").alias("_q"), F.col("range").alias("_r"), "before"))  # at most queries + cuts rows
    placed = ranged.withColumn("at", at).join(sums, F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("range") == F.col("_r")))
    return placed.select("query_id", (F.col("before") + F.col("at")).alias("place"), "id", "label")


def reject_queries(judged: DataFrame) -> DataFrame:
    """(query_id, reason) of queries that give no training rows."""
    sums = judged.groupBy("query_id").agg(F.count_if(F.col("label").eqNullSafe(F.lit(True))).alias("pos"), F.count_if(F.col("label").eqNullSafe(F.lit(False))).alias("neg"))
    reason = F.when(F.trim(F.coalesce(F.col("query_id").cast("string"), F.lit(""))) == "", "blank").when(F.col("pos") == 0, "no positive").when(F.col("neg") == 0, "no negative")
    return sums.select("query_id", reason.alias("reason")).filter("reason is not null")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def training_faults(kind: str) -> Column:
    """Null, or what is wrong with a row of triplets (anchor, positive, negative), pairs (query, passage, label) or chats (messages, text)."""
    if kind == "triplet":
        return F.when(_blank(F.col("anchor")) | _blank(F.col("positive")) | _blank(F.col("negative")), "blank")
    if kind == "chat":
        return F.when((F.coalesce(F.size("messages"), F.lit(0)) < 1) & _blank(F.col("text")), "no messages or text")
    value = F.col("label").cast("string").try_cast("double")
    return F.when(_blank(F.col("query")) | _blank(F.col("passage")), "blank").when(~F.coalesce(value.isin(0.0, 1.0), F.lit(False)), "label")


def block_faults(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, fault). `blocks`: doc_id, block_id, kind, level, text, page_start, page_end and, if pages are to lie within it, page_count."""
    same = blocks.groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("same"))
    head = F.col("kind") == "heading"
    fault = (
        F.when(head != F.col("level").isNotNull(), "level").when(head & _blank(F.col("text")), "blank heading").when(F.col("page_start").isNull() != F.col("page_end").isNull(), "one page")
        .when(F.col("page_end") < F.col("page_start"), "page order").when(F.col("same") > 1, "duplicate")
    )
    if "page_count" in blocks.columns:
        fault = fault.when(F.col("page_end") > F.col("page_count"), "page count")
    return blocks.join(same, ["doc_id", "block_id"]).select("doc_id", "block_id", fault.alias("fault")).filter("fault is not null")


def submission_faults(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, fault). `answers`: question_id, abstained, text, claim_ids (array); `questions`: question_id."""
    n = answers.groupBy("question_id").agg(F.count(F.lit(1)).alias("same"))
    known = questions.select("question_id", F.lit(True).alias("known"))
    claims = F.coalesce(F.size("claim_ids"), F.lit(0))
    fault = (
        F.when(F.col("known").isNull(), "unknown").when(F.col("same") > 1, "duplicate").when(_blank(F.col("text")), "blank").when(F.col("abstained") & (claims > 0), "abstained with claims")
        .when(~F.col("abstained") & (claims < 1), "no claims").when(F.size(F.array_distinct("claim_ids")) < claims, "claim ids")
    )
    return answers.join(n, "question_id").join(known, "question_id", "left").select("question_id", fault.alias("fault")).filter("fault is not null")
