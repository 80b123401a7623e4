"""Audits of chunks, pilots, tasks, evidence, reports and manifests, as joins and sums over keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _times(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _named(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules.items()]))


def span_faults(chunks: DataFrame) -> DataFrame:
    """Adds fault: null, or the first rule that a chunk's spans break.

    `chunks`: is_parent, parent_id, page_start, page_end, spans (array of char_start, char_end, page_start, page_end). Spans are not
    empty, have both pages or none, in order; the chunk's pages are those of its spans; children and only they name a parent.
    """
    some = lambda rule: F.exists("spans", lambda x: _yes(rule(x)))
    first = F.array_min(F.transform("spans", lambda x: x["page_start"]))
    last = F.array_max(F.transform("spans", lambda x: x["page_end"]))
    fault = (
        F.when(F.coalesce(F.size("spans"), F.lit(0)) < 1, "no span").when(some(lambda x: x["char_end"] <= x["char_start"]), "empty span")
        .when(some(lambda x: x["page_start"].isNull() != x["page_end"].isNull()), "one page").when(some(lambda x: x["page_end"] < x["page_start"]), "page order")
        .when(F.col("is_parent") != F.col("parent_id").isNull(), "parent").when(~(F.col("page_start").eqNullSafe(first) & F.col("page_end").eqNullSafe(last)), "page range")
    )
    return chunks.withColumn("fault", fault)


def pilot_faults(papers: DataFrame, questions: DataFrame, gold: DataFrame, mix: dict[str, int]) -> DataFrame:
    """(part, id, fault): what is wrong with the papers, questions and gold anchors of a pilot; `mix` has the number of questions of each category.

    `papers`: doc_id, url, file_name, sha256, pages; `questions`: question_id, category; `gold`: question_id, doc_id, page, anchor.
    """
    like = lambda c, pattern: _yes(F.col(c).rlike(pattern))

    def found(rows: DataFrame, part: str, key: str, fault: Column) -> DataFrame:
        return rows.select(F.lit(part).alias("part"), F.col(key).cast("string").alias("id"), fault.alias("fault")).filter("fault is not null")

    sheets = papers.join(_times(papers, ["doc_id"], "_ids"), "doc_id", "left").join(_times(papers, ["file_name"], "_files"), "file_name", "left")
    paper = (
        F.when(F.col("_ids") > 1, "duplicate id").when(F.col("_files") > 1, "duplicate file").when(~like("url", "^https://"), "url").when(~like("file_name", r"^[A-Za-z0-9_-]+\.pdf\z"), "file name")
        .when(~like("sha256", r"^[0-9a-f]{64}\z"), "digest").when(~_yes(F.col("pages") > 0), "pages")
    )
    asked = questions.join(_times(questions, ["question_id"], "_ids"), "question_id", "left").join(_times(gold, ["question_id"], "_gold"), "question_id", "left")
    question = F.when(F.col("_ids") > 1, "duplicate id").when(~_yes(F.col("category").isin(*mix)), "category").when((F.col("category") == "unanswerable") != F.col("_gold").isNull(), "gold")
    known = gold.join(papers.select("doc_id", F.lit(True).alias("_known")).distinct(), "doc_id", "left")
    anchor = F.when(F.col("_known").isNull(), "unknown document").when(~_yes(F.length("anchor") >= 3), "anchor").when(~_yes(F.col("page") > 0), "page")
    want = F.create_map(*[F.lit(x) for pair in mix.items() for x in pair])
    every = questions.sparkSession.createDataFrame([(k,) for k in mix], "category string").join(_times(questions, ["category"], "_n"), "category", "left")
    share = F.when(F.coalesce("_n", F.lit(0)) != want[F.col("category")], "mix")
    return found(sheets, "paper", "doc_id", paper).unionByName(found(asked, "question", "question_id", question)).unionByName(found(known, "gold", "question_id", anchor)).unionByName(found(every, "category", "category", share))


def task_faults(tasks: DataFrame, sources: DataFrame, steps: DataFrame) -> DataFrame:
    """(task_id, faults): repeated sources or steps, and calls over the frozen budget.

    `tasks`: task_id, model_calls, max_model_calls, tool_calls, max_steps; `sources`: task_id, doc_id; `steps`: task_id, step_id.
    """
    twice = lambda rows, key, name: _times(rows, ["task_id", key], "_n").groupBy("task_id").agg((F.max("_n") > 1).alias(name))
    joined = tasks.join(twice(sources, "doc_id", "_source"), "task_id", "left").join(twice(steps, "step_id", "_step"), "task_id", "left")
    rules = {"duplicate source": F.col("_source"), "duplicate step": F.col("_step"), "model calls": F.col("model_calls") > F.col("max_model_calls"), "tool calls": F.col("tool_calls") > F.col("max_steps")}
    return joined.select("task_id", _named(rules).alias("faults")).filter("size(faults) > 0")


def source_faults(papers: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, fault): papers without a file, or whose digest, number of pages or OCR differs from what was frozen.

    `papers`: doc_id, sha256, pages; `files`: doc_id, content, ocr; `pages`: doc_id, page. Only digests and counts are shuffled.
    """
    own = files.select("doc_id", F.sha2("content", 256).alias("_sha"), "ocr")
    joined = papers.join(own, "doc_id", "left").join(_times(pages, ["doc_id"], "_pages"), "doc_id", "left")
    fault = (
        F.when(F.col("_sha").isNull(), "missing").when(~_yes(F.col("_sha") == F.col("sha256")), "digest")
        .when(F.coalesce("_pages", F.lit(0)) != F.col("pages"), "pages").when(_yes(F.col("ocr")), "ocr")
    )
    return joined.select("doc_id", fault.alias("fault")).filter("fault is not null")


CHANNELS = ("vector", "graph", "lexical")


def evidence_faults(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, faults): items that differ from their stored chunk, or whose window, channels or matched children can't be right.

    `items`: item_id, chunk_id, text, context_start, context_end (null: to the end), matched (array of chunk_id), channels; `chunks`:
    chunk_id, doc_id, is_parent, parent_id, text. Only parents have windows; a matched child must stand once in its parent, in the window.
    """
    full = items.withColumnRenamed("text", "_said").join(chunks.select("chunk_id", "doc_id", "is_parent", F.col("text").alias("_t")), "chunk_id", "left")
    end = F.coalesce("context_end", F.length("_t"))
    part = (F.col("context_start") != 0) | F.col("context_end").isNotNull()
    full = full.withColumns({"_end": end, "_part": part})
    kids = chunks.select(F.col("chunk_id").alias("_m"), F.col("doc_id").alias("_doc"), "parent_id", F.col("text").alias("_kid"))
    each = full.select("item_id", "chunk_id", "doc_id", "_t", "context_start", "_end", "_part", F.explode("matched").alias("_m")).join(kids, "_m", "left")
    at = F.position("_kid", "_t")
    again = F.position("_kid", "_t", at + F.length("_kid"))
    foreign = F.col("_doc").isNull() | (F.col("_doc") != F.col("doc_id")) | ~((F.col("_m") == F.col("chunk_id")) | F.col("parent_id").eqNullSafe(F.col("chunk_id")))
    lost = F.col("_part") & ((at == 0) | (again > 0) | (at - 1 < F.col("context_start")) | (at - 1 + F.length("_kid") > F.col("_end")))
    found = each.groupBy("item_id").agg(F.bool_or(_yes(foreign)).alias("_foreign"), F.bool_or(_yes(lost)).alias("_lost"))
    bad_window = ~((F.col("context_start") >= 0) & (F.col("context_start") < F.col("_end")) & (F.col("_end") <= F.length("_t"))) | (F.col("_part") & ~F.col("is_parent"))
    rules = {
        "chunk": ~_yes(F.col("_t") == F.col("_said")), "channel": (F.coalesce(F.size("channels"), F.lit(0)) > 0) & (F.size(F.array_except("channels", F.array(*map(F.lit, CHANNELS)))) > 0),
        "window": bad_window, "unmatched": F.coalesce(F.size("matched"), F.lit(0)) < 1, "foreign child": F.col("_foreign"), "lost child": F.col("_lost"),
    }
    return full.join(found, "item_id", "left").select("item_id", _named(rules).alias("faults")).filter("size(faults) > 0")


def publish_faults(reports: DataFrame, claims: DataFrame, verdicts: DataFrame, audits: DataFrame, contexts: DataFrame, assessments: DataFrame) -> DataFrame:
    """(artifact_id, problems): what keeps an artifact from being published.

    `reports`: artifact_id, total, supported, audited, with_context; the others have artifact_id and claim_id, `claims` also facet,
    exact, in_scope and numeric, `verdicts` status, `audits` status, `assessments` status and handles (all checks name their sources).
    Verdicts cover the claims exactly once, counts agree, and each supported claim passes every gate that its report asks for.
    """
    key = ["artifact_id", "claim_id"]

    def each(rows: DataFrame, name: str, *kept: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.count(F.lit(1)).alias(f"n_{name}"), *[F.min(c).alias(f"{name}_{c}") for c in kept])

    full = each(claims, "claim", "facet", "exact", "in_scope", "numeric")
    for more in (each(verdicts, "verdict", "status"), each(audits, "audit", "status"), each(contexts, "context"), each(assessments, "check", "status", "handles")):
        full = full.join(more, key, "full")
    full = full.join(reports.select("artifact_id", "audited", "with_context"), "artifact_id", "left")
    n = {x: F.coalesce(f"n_{x}", F.lit(0)) for x in ("claim", "verdict", "audit", "context", "check")}
    good, audited, context = _yes(F.col("verdict_status") == "supported"), _yes(F.col("audited")), _yes(F.col("with_context"))
    rules = {
        "coverage": (n["claim"] + n["verdict"] > 0) & ((n["claim"] != 1) | (n["verdict"] != 1)),
        "audit scope": (n["audit"] > 0) & ((n["claim"] == 0) | (n["audit"] > 1) | ~audited),
        "context scope": (n["context"] > 0) & ((n["claim"] == 0) | (n["context"] > 1) | ~context),
        "assessment scope": (n["check"] > 0) & ((n["verdict"] == 0) | (n["check"] > 1)),
        "condition": good & audited & (F.col("claim_facet") == "result") & ~_yes(F.col("audit_status").isin("passed", "not_applicable")),
        "context": good & context & (n["context"] == 0), "assessment": good & ~_yes((F.col("check_status") == "supported") & F.col("check_handles")),
        "slice": (n["claim"] > 0) & ~_yes(F.col("claim_exact")), "scope": (n["claim"] > 0) & ~_yes(F.col("claim_in_scope")), "numbers": good & (n["claim"] > 0) & ~_yes(F.col("claim_numeric")),
    }
    sums = full.groupBy("artifact_id").agg(F.sum(n["claim"]).alias("_claims"), F.count_if(good & (n["verdict"] > 0)).alias("_good"), *[F.bool_or(_yes(r)).alias(f"_{k}") for k, r in rules.items()])
    joined = reports.select("artifact_id", "total", "supported", F.lit(True).alias("_known")).join(sums, "artifact_id", "full")
    counters = F.col("_known").isNull() | (F.coalesce("_claims", F.lit(0)) != F.col("total")) | (F.coalesce("_good", F.lit(0)) != F.col("supported"))
    problems = _named({"counters": counters} | {k: F.col(f"_{k}") for k in rules})
    return joined.select("artifact_id", problems.alias("problems")).filter("size(problems) > 0")


def render_comparison(cells: DataFrame, facets: list[str], labels: dict[str, str]) -> DataFrame:
    """(artifact_id, status, gaps, markdown): each artifact's table of documents by facets, with numbered statements.

    `cells`: artifact_id, doc_id, title, facet, state, statement; facets without a cell are missing, cells of other facets are left out. Supported statements are
    numbered in the order of rows and facets; all other states show their label and make a gap. An artifact's table must fit a row.
    """
    place = F.array_position(F.array(*map(F.lit, facets)), F.col("facet"))
    cells = cells.filter(F.col("facet").isin(*facets))
    good = cells.filter("state = 'supported'").withColumn("n", F.row_number().over(Window.partitionBy("artifact_id").orderBy("doc_id", place)))
    rows = cells.select("artifact_id", "doc_id", "title", "facet", "state", "statement").join(good.select("artifact_id", "doc_id", "facet", "n"), ["artifact_id", "doc_id", "facet"], "left")
    label = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]).cast("map<string,string>")
    state = lambda f: F.coalesce(F.max(F.when(F.col("facet") == f, F.col("state"))), F.lit("missing"))
    shown = F.concat("statement", F.lit(" ["), F.col("n").cast("string"), F.lit("]"))
    wide = rows.groupBy("artifact_id", "doc_id").agg(F.min("title").alias("title"), *[state(f).alias(f"s_{i}") for i, f in enumerate(facets)], *[F.max(F.when(F.col("facet") == f, shown)).alias(f"t_{i}") for i, f in enumerate(facets)])
    text = [F.when(F.col(f"s_{i}") == "supported", F.col(f"t_{i}")).otherwise(F.coalesce(label[F.col(f"s_{i}")], F.col(f"s_{i}"))) for i in range(len(facets))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "title", *text), F.lit(" |"))
    gaps = F.array_compact(F.array(*[F.when(F.col(f"s_{i}") != "supported", F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(f), F.col(f"s_{i}"))) for i, f in enumerate(facets)]))
    made = wide.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line"), gaps.alias("gaps")))).alias("x"))
    made = made.select("artifact_id", F.flatten(F.transform("x", lambda x: x["gaps"])).alias("gaps"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("markdown"))
    return made.select("artifact_id", F.when(F.size("gaps") > 0, "partial").otherwise("ready_for_review").alias("status"), "gaps", "markdown")


def annotation_rows(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(slot, question_id, variant, state, text, abstained, claims): a blank template for each succeeded answer, failures kept.

    `plan`: slot, question_id, variant, request; `outcomes`: slot, question_id, variant, request_sha256, status, answer. A slot whose two
    sides differ, or that one side lacks, is a mismatch.
    """
    asked = plan.select("slot", F.struct("question_id", "variant", F.sha2("request", 256).alias("sha")).alias("_p"))
    got = outcomes.select("slot", F.struct("question_id", "variant", F.col("request_sha256").alias("sha")).alias("_o"), "status", "answer")
    joined = asked.join(got, "slot", "full")
    state = F.when(~_yes(F.col("_p") == F.col("_o")), "mismatch").when(F.col("status") == "succeeded", "template").otherwise("failed")
    return joined.withColumn("state", state).select(
        "slot", F.coalesce("_p.question_id", "_o.question_id").alias("question_id"), F.coalesce("_p.variant", "_o.variant").alias("variant"), "state",
        F.when(F.col("state") == "template", F.col("answer")).alias("text"), F.lit(None).cast("boolean").alias("abstained"), F.array().cast("array<string>").alias("claims"),
    )


STATUSES = ("passed", "missing", "unknown", "not_applicable")


def condition_summary(tasks: DataFrame, claims: DataFrame, audits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A row for each task: its result claims, how many are audited, counts of every status, blocked, unaudited and pending claims, and faults.

    `tasks`: task_id, merged; `claims`: task_id, claim_id, facet; `audits`: task_id, claim_id, merged, status; `verdicts`: task_id,
    claim_id, merged, reason. The rows of the merged report count if the task has one, else those of single documents, never both.
    Foreign or repeated audits and repeated verdicts are faults.
    """
    key = ["task_id", "claim_id"]
    mine = lambda rows: rows.join(tasks.select("task_id", "merged"), ["task_id", "merged"], "left_semi")
    told = claims.filter("facet = 'result'").select(*key).distinct().withColumn("_result", F.lit(True))
    looked = mine(audits).groupBy(*key).agg(F.count(F.lit(1)).alias("_a"), F.max("status").alias("status"))
    judged = mine(verdicts).groupBy(*key).agg(F.count(F.lit(1)).alias("_v"), F.bool_or(_yes(F.col("reason").startswith("result_condition_"))).alias("_blocked"))
    full = told.join(looked, key, "full").join(judged, key, "full")
    result = _yes(F.col("_result"))
    seen = result & F.col("_a").isNotNull()
    sums = full.groupBy("task_id").agg(
        F.count_if(result).alias("result_claims"), F.count_if(seen).alias("audited"), *[F.count_if(seen & (F.col("status") == s)).alias(s) for s in STATUSES],
        F.count_if(result & _yes(F.col("_blocked"))).alias("blocked"), F.count_if(result & F.col("_a").isNull()).alias("unaudited"), F.count_if(result & F.col("_v").isNull()).alias("pending"),
        F.count_if(_yes((F.col("_a") > 1) | (F.col("_v") > 1)) | (F.col("_a").isNotNull() & ~result)).alias("faults"),
    )
    names = [c for c in sums.columns if c != "task_id"]
    return tasks.select("task_id").join(sums, "task_id", "left").select("task_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


MANIFEST = "schema string, user_id long, documents map<string,string>, members array<struct<build_id:string,document_id:string,chunk_set_id:string,namespace:string,records_sha256:string>>"


def manifest_faults(manifests: DataFrame, schema: str = "user-index-v1") -> DataFrame:
    """(version_id, fault): stored manifests that are not whole. `manifests`: version_id, user_id, manifest_json, manifest_sha256."""
    rows = manifests.withColumn("m", F.from_json("manifest_json", MANIFEST))
    members, docs = F.col("m.members"), F.col("m.documents")
    fields = ("build_id", "document_id", "chunk_set_id", "namespace", "records_sha256")
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    part = lambda name: F.transform(members, lambda x: x[name])
    hollow = F.exists(members, lambda x: x.isNull() | F.array_contains(F.array(*[empty(x[f]) for f in fields]), True))
    twice = lambda name: F.size(F.array_distinct(part(name))) < F.size(members)
    blank = F.exists(F.map_entries(docs), lambda e: empty(e["key"]) | empty(e["value"]))
    fault = (
        F.when(~_yes(F.sha2("manifest_json", 256) == F.col("manifest_sha256")), "digest").when(~_yes((F.col("m.schema") == schema) & (F.col("m.user_id") == F.col("user_id"))), "identity")
        .when(~_yes((F.size(docs) > 0) & (F.size(members) == F.size(docs)) & ~blank), "coverage").when(_yes(hollow), "member")
        .when(F.exists(members, lambda x: ~x["records_sha256"].rlike(r"^[0-9a-f]{64}\z")), "member digest")
        .when((F.size(F.array_except(F.map_keys(docs), part("document_id"))) > 0) | twice("document_id") | twice("build_id") | twice("namespace"), "members")
    )
    return rows.select("version_id", fault.alias("fault")).filter("fault is not null")
