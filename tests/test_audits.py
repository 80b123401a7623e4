"""Goldens of audits, conditions and comparisons."""

import duckdb
from pyspark.sql import functions as F

from evidence_spark.functions.chunks import flat_pieces
from evidence_spark.functions.structure import structured_rows
from evidence_spark.operators import audits, comparisons, conditions
from evidence_spark.plans import registry

QUOTE = "Model (X = CorpusA)\r\n 12.5%\r\n1,300\n\nModel (X = CorpusB, Y = High beam)\n7e1\n"


def audited(spark, rows):
    """(status, reason, missing) of claims (facet, statement, quote), in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "claim_id int, facet string, statement string, quote string")
    return [(r.audit.status, r.audit.reason, list(r.audit.missing)) for r in conditions.audit_conditions(df).orderBy("claim_id").collect()]


TWO = "Model (X = CorpusA, Z = CorpusB)\n38.5\n52.0"
CASES = [  # statement, quote, status, reason, missing
    ("12.5 on CorpusA", QUOTE, "passed", "all_explicit_row_assignments_retained", []),
    ("1300 and 12.5 on corpusa", QUOTE, "passed", "all_explicit_row_assignments_retained", []),
    ("70 on CorpusB", QUOTE, "missing", "explicit_row_condition_omitted", ["High beam"]),
    ("70 with high beam on CorpusB", QUOTE, "passed", "all_explicit_row_assignments_retained", []),
    ("70 with high beam, CorpusB除外", QUOTE, "unknown", "condition_occurrence_not_affirmed", []),
    ("12.5 on CorpusA2", QUOTE, "missing", "explicit_row_condition_omitted", ["CorpusA"]),
    ("12.5 on CorpusA with X = CorpusC", QUOTE, "unknown", "explicit_condition_assignment_differs", []),
    ("12.5 and 12.5 on CorpusA", QUOTE, "unknown", "numeric_row_not_located", []),
    ("5 ok", "A (b=c)\n5\nA (b=d)\n5", "unknown", "ambiguous_numeric_rows", []),
    ("5 c", "A (b=c, d=)\n5", "unknown", "explicit_assignments_unavailable", []),
    ("5 c", "A\n5", "unknown", "explicit_assignments_unavailable", []),
    ("3x better", QUOTE, "unknown", "numeric_notation_unsupported", []),
    ("better", QUOTE, "not_applicable", "not_a_numeric_result", []),
    ("5", None, "unknown", "numeric_row_not_located", []),
    (None, None, "not_applicable", "not_a_numeric_result", []),
    ("CorpusA yields 38.5 and 52.0.", TWO, "missing", "explicit_row_condition_omitted", ["CorpusB"]),
    ("X = CorpusB, Z = CorpusA yield 38.5 and 52.0.", TWO, "unknown", "explicit_condition_assignment_differs", []),
    ("CorpusA yields 38.5 and 52.0.", "Table results\r\n  Model (X = CorpusA)\r\n 38.5\r\n 52.0", "passed", "all_explicit_row_assignments_retained", []),
    ("CorpusA yields 38.5 and 52.0.", "Model (X = CorpusA)\n3.85e1\n5.2E1", "passed", "all_explicit_row_assignments_retained", []),
    ("CorpusA has 38m.", "Model (X = CorpusA)\n38", "unknown", "numeric_notation_unsupported", []),
    ("模型没有使用CorpusA，38.5。", "Model (X = CorpusA)\n38.5", "unknown", "condition_occurrence_not_affirmed", []),
    ("38.5 without CorpusA", "Model (X = CorpusA)\n38.5", "unknown", "condition_occurrence_not_affirmed", []),
    ("38.5 cannot hold for CorpusA", "Model (X = CorpusA)\n38.5", "passed", "all_explicit_row_assignments_retained", []),
    ("38.5 using CorpusA.", "Model (X = CorpusA)\n38.5", "passed", "all_explicit_row_assignments_retained", []),
    ("38.5 using CorpusA.Extra.", "Model (X = CorpusA)\n38.5", "missing", "explicit_row_condition_omitted", ["CorpusA"]),
    ("３８.５ on ＣorpusA", "Model (X = CorpusA)\n38.5", "passed", "all_explicit_row_assignments_retained", []),
]


def test_conditions(spark):
    got = audited(spark, [("result", said, quote) for said, quote, *_ in CASES])
    for case, found in zip(CASES, got, strict=True):
        assert found == tuple(case[2:]), case
    assert audited(spark, [(None, "12.5 on CorpusA", QUOTE), ("method", "12.5", QUOTE)]) == [("not_applicable", "not_a_numeric_result", [])] * 2


def test_conditions_keep_other_columns(spark):
    df = spark.createDataFrame([("result", "12.5 on CorpusA", QUOTE, 1, "x")], "facet string, statement string, quote string, `a.b` int, audit string")
    got = conditions.audit_conditions(df)
    assert got.columns == ["facet", "statement", "quote", "a.b", "audit"] and got.first().audit.status == "passed"


def test_aligned(spark):
    df = spark.createDataFrame([("abcabc", ["ab", "bc", "ab", "zz", "c"]), ("x", []), (None, ["a"])], "t string, p array<string>")
    assert [r[0] for r in df.select(comparisons.aligned(F.col("t"), F.col("p"))).collect()] == [[0, 1, 3, None, 5], [], [None]]


def test_compare_chunkers(spark):
    texts = ["One two. " * 100, "Three four five; " * 60, "short"]
    blocks = [{"block_no": i, "kind": "paragraph", "level": None, "text": t, "page": 1} for i, t in enumerate(texts)]
    df = spark.createDataFrame([(1, blocks), (2, [])], "doc_id int, blocks array<struct<block_no:int,kind:string,level:int,text:string,page:int>>")
    got = {r.policy: (r.chunks, r.max_chars, r.located) for r in comparisons.compare_chunkers(df).collect()}
    flat = [p for t in texts for p in flat_pieces(t, 600, 60)]
    kids = [r["text"] for r in structured_rows(blocks, 600, 1800) if not r["is_parent"]]
    assert got == {"flat": (len(flat), max(map(len, flat)), len(flat)), "structured": (len(kids), max(map(len, kids)), len(kids))}


def test_manifests(spark):
    rows = [(1, 1, "{", None), (2, 2, None, None), (3, 3, "[]", None)]
    df = spark.createDataFrame(rows, "version_id int, user_id long, manifest_json string, manifest_sha256 string").withColumn("manifest_sha256", F.sha2("manifest_json", 256))
    assert {r.version_id: r.fault for r in audits.manifest_faults(df).collect()} == {1: "identity", 2: "digest", 3: "identity"}


def test_spans_with_nulls(spark):
    kind = "id int, is_parent boolean, parent_id string, page_start int, page_end int, spans array<struct<char_start:int,char_end:int,page_start:int,page_end:int>>"
    rows = [(1, True, None, None, None, [(0, 1, None, None)]), (2, True, None, None, None, None), (3, False, "p", 1, 2, [(0, 1, 1, 1), (3, 4, 2, 2), (5, 6, None, None)]), (4, False, None, 1, 1, [(0, 1, 1, 1)])]
    got = {r.id: r.fault for r in audits.span_faults(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: None, 2: "no span", 3: None, 4: "parent"}


def test_rendered_order(spark):
    cells = spark.createDataFrame([(1, 1, "A", "x", "supported", "s1"), (1, 1, "A", "y", "supported", "s2"), (1, 2, "B", "x", "supported", "s3"), (1, 2, "B", "y", "supported", "s4")], "artifact_id int, doc_id int, title string, facet string, state string, statement string")
    r = audits.render_comparison(cells, ["y", "x"], {}).first()
    assert (r.status, r.gaps, r.markdown) == ("ready_for_review", [], "| A | s2 [1] | s1 [2] |\n| B | s4 [3] | s3 [4] |")


def test_grid_without_broadcasts(spark):
    """Tables beyond the size of a broadcast, which fus_retrieval_grid meets at 1 GB."""
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{at}/embeddings.parquet'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, registry.QUERIES["fus_retrieval_grid"](spark, at).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(con.execute(registry.ORACLES["fus_retrieval_grid"]).fetchall(), key=repr)
