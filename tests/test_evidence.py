"""Goldens of structure, selection and checks."""

import random

from pyspark.sql import functions as F

from evidence_spark.functions import structure
from evidence_spark.operators import evidence
from evidence_spark.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_queries_without_sql_run(spark):
    for name in ("txt_markdown_blocks", "chk_chunk_structured", "fus_expand_parents", "lex_repair_dense"):
        assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_markdown_blocks():
    rows = structure.markdown_rows("Title\n===\n\nOne\ntwo [x](y)\n# A b ##\n~~~~\n# code\n~~~\n~~~~\n- item\n\n---\n")
    assert [(r["kind"], r["level"], r["text"]) for r in rows] == [
        ("heading", 1, "Title"), ("paragraph", None, "One\ntwo x"), ("heading", 1, "A b"), ("code", None, "# code\n~~~"), ("paragraph", None, "• item"), ("paragraph", None, "---"),
    ]
    assert structure.markdown_rows(None) == structure.markdown_rows(" \n") == []


def test_markdown_text(spark):
    df = spark.createDataFrame([("# A\n```\n# x_y\n```",), ("> q **b** ![i](u)[l](v)",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(structure.markdown_to_text(F.col("t"))).collect()] == ["A\n# x_y", "q b l", "", None]


def test_token_ranges():
    text = "Para one.\n\nPara two is long. It ends here."
    cuts = [text[a:b] for a, b in structure.token_ranges(text, 20)]
    assert cuts[0] == "Para one." and all(len(c) <= 20 for c in cuts) and "".join("".join(cuts).split()) == "".join(text.split())
    assert structure.token_ranges("  \n ", 5) == [] and structure.token_ranges("abc" * 10, 7)[0] == (0, 7)
    words = [text[a:b] for a, b in structure.token_ranges(text, 3, lambda t: len(t.split()))]
    assert all(len(w.split()) <= 3 for w in words) and " ".join(words).split() == text.split()


def test_structured_chunks():
    kinds = [("heading", 1, "Top"), ("paragraph", None, "a" * 50), ("code", None, "  x = 1"), ("heading", 2, "Sub"), ("paragraph", None, "b" * 30), ("heading", 1, "Next")]
    blocks = [{"block_no": i, "kind": k, "level": lv, "text": t, "page": i + 1} for i, (k, lv, t) in enumerate(kinds)]
    rows = structure.structured_rows(blocks, 20, 60)
    parents = [r for r in rows if r["is_parent"]]
    assert [p["section_path"] for p in parents] == [["Top"], ["Top"], ["Top", "Sub"], ["Next"]]
    assert parents[1]["text"] == "  x = 1" and parents[0]["page_start"] == 1 and parents[0]["page_end"] == 2
    assert [r["chunk_index"] for r in rows if not r["is_parent"]] == list(range(sum(not r["is_parent"] for r in rows)))
    for r in rows:
        assert "".join(blocks[s["block_no"]]["text"][s["char_start"] : s["char_end"]] for s in r["spans"]) == r["text"].replace("\n\n", "")


def test_decode():
    assert structure.decoded("中文文本".encode("gb18030")) == "中文文本" and structure.decoded(b"") == "" and structure.decoded(None) is None


def test_evidence_budget(spark):
    hits = spark.createDataFrame([("q", 1, "a", 50), ("q", 2, "b", 60), ("q", 3, "c", 40), ("z", 1, "a", 200)], "query_id string, place int, chunk_id string, chars int")
    got = {r.query_id: (r["items"], r.chars, r.warnings) for r in evidence.select_evidence(hits, 5, 100).collect()}
    assert got == {"q": (["a", "c"], 90, ["candidate_budget_exceeded"]), "z": ([], 0, ["candidate_budget_exceeded"])}


def test_parents_and_windows(spark):
    df = spark.createDataFrame([("q", "AA. BB. CC. DD.", 30), ("r", "AA. BB. CC. DD.", 9), ("s", "AA. BB. CC. DD.", 5)], "query_id string, text string, budget int")
    kids = F.array(*[F.struct(F.lit(i).alias("chunk_index"), F.lit(t).alias("text")) for i, t in enumerate(("AA.", "BB.", "CC.", "DD."))])
    rows = df.select("query_id", "budget", F.lit(1).alias("place"), F.lit("p").alias("parent_id"), F.lit(3).alias("old_chars"), F.length("text").alias("parent_chars"), F.lit(3).alias("total"), evidence.compact_windows(F.col("text"), kids, F.array(F.lit(2))).alias("windows"))
    for q, budget, want in (("q", 30, (15, [("p", 0, 15)])), ("r", 9, (7, [("p", 4, 11)])), ("s", 5, (3, []))):
        r = evidence.expand_parents(rows.filter(F.col("query_id") == q), budget).first()
        assert (r.chars, [tuple(p) for p in r.parents]) == want


def test_repair(spark):
    hits = spark.createDataFrame(
        [("q", "dense", 0, "a", "x", 1, False), ("q", "dense", 1, "b", "y", 2, True), ("q", "dense", 2, "c", "z", 3, False), ("q", "sparse", 0, "d", "x", 1, True), ("q", "sparse", 1, "e", "z", 3, True)],
        "query_id string, channel string, rank int, chunk_id string, doc_id string, doc_order int, about_index boolean",
    )
    assert [r.chunk_id for r in evidence.repair_dense(hits, 4).orderBy("place").collect()] == ["a", "b", "e", "d"]
    assert [r.chunk_id for r in evidence.repair_dense(hits, 3).orderBy("place").collect()] == ["d", "b", "e"]


def test_injected_models(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    assert [r.vector for r in evidence.embed_batches(rows, lambda ts: [[float(len(t))] for t in ts], 1, 1).orderBy("id").collect()] == [[2.0], [0.0]]
    pairs = spark.createDataFrame([(1, 7, "q", "long one"), (1, 8, "q", "x"), (1, 9, "q", "yy")], "query_id long, id long, query string, passage string")
    assert [r.id for r in evidence.rank_pairs(pairs, lambda q, p: p.str.len(), 2).orderBy("rank").collect()] == [7, 9]


def test_broken_chunks(spark):
    rows = [(1, True, 0, None, ["a"], "xyz", 3), (1, False, 0, 0, ["a"], "xy", 2), (2, True, 1, None, ["a"], "xyz", 3), (2, False, 0, 1, ["b"], "xy", 9)]
    df = spark.createDataFrame(rows, "doc_id int, is_parent boolean, chunk_index int, parent_index int, section_path array<string>, text string, tokens int")
    assert [tuple(r) for r in evidence.verify_chunks(df, 5, 5).collect()] == [(2, ["index", "budget", "parent"])]


def test_pairs_are_ranked_as_they_pass(spark, monkeypatch):
    """With few or many pairs held at once, over several tasks and batches, ties by id and unscored pairs last."""
    rnd = random.Random(3)
    rows = [(q, i, str(rnd.randint(0, 4)) if i % 9 else "nan", "1") for q in range(40) for i in rnd.sample(range(500), rnd.randint(1, 60))] + [(99, None, "4", "1")]
    want = set()
    for q in {r[0] for r in rows}:
        own = sorted(((r for r in rows if r[0] == q)), key=lambda r: (r[2] == "nan", -float(r[2]) if r[2] != "nan" else 0, r[1] or -1))[:5]
        want |= {(q, r[1], k + 1) for k, r in enumerate(own)}
    pairs = spark.createDataFrame([(q, None if i is None else str(i).zfill(3), a, b) for q, i, a, b in rows], "query_id long, id string, query string, passage string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for held in (10, 150, 1 << 18):
            monkeypatch.setattr(evidence, "HELD_PAIRS", held)
            got = evidence.rank_pairs(pairs, lambda a, b: a.astype("float64") * b.astype("float64"), 5).collect()
            assert {(r.query_id, None if r.id is None else int(r.id), r["rank"]) for r in got} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
