"""Whole forms of queries against brute force; their SQL is compared in test_library."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from evidence_spark.operators import review, search, tables
from evidence_spark.plans import registry, whole_queries  # noqa: F401

SMALL = "/root/testdata/sf0.001"

ASKED = [
    "vec_cosine_topn", "fus_rrf", "fus_round_robin", "vec_search_members", "vec_apply_rerank", "vec_build_context", "lex_repair_dense", "fus_scope_filter", "fus_select_evidence", "fus_coverage_warnings",
]


@pytest.mark.parametrize("name", ASKED)
def test_every_hundredth_id_is_asked(spark, name):
    ids = {r[0] for r in duckdb.sql(f"select vec_id from '{SMALL}/embeddings.parquet' where vec_id % 100 = 0").fetchall()}
    if name == "fus_select_evidence":
        ids -= {i for i in ids if i > 250}  # their neighbours are no ids of the 200 documents
    assert {r.query_id for r in registry.QUERIES[f"{name}_whole"](spark, SMALL).select("query_id").distinct().collect()} == ids


def test_cosine_ties_batches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 4096)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rng = np.random.default_rng(5)
        kinds = np.eye(6)[rng.integers(0, 6, 500)]  # many equal scores, which are exact
        rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(500), kinds)], "id long, vector array<double>").repartition(3)
        asked = rows.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
        got = sorted((r.query_id, r["rank"], r.id) for r in search.cosine_topn(asked, rows, 9).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    v = {r.id: np.array(r.vector) for r in rows.collect()}
    want = [(q, k + 1, i) for q in v if q % 20 == 0 for k, i in enumerate(sorted(v, key=lambda i: (-(v[q] @ v[i]), i))[:9])]
    assert got == sorted(want)


def test_whole_texts_count(spark, tmp_path):
    texts = {1: "a b c d e f g h late", 2: "late late words", 3: "nothing here", 4: "x " * 60 + "late", 5: "a a b"}
    asked = {7: "a b c d e f g h late words", 8: "here"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = {k: Counter(t.split()) for k, t in texts.items()}
    mean, n = sum(c.total() for c in words.values()) / 5, {w: sum(w in c for c in words.values()) for w in " ".join(texts.values()).split()}
    score = lambda q, c: sum(math.log(1 + (5 - n[w] + 0.5) / (n[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in set(asked[q].split()) if w in c)
    want = {(q, k): round(score(q, c), 6) for q in asked for k, c in words.items() if score(q, c) > 0}
    assert {(r.query_id, r.chunk_id): r.score for r in registry.QUERIES["lex_bm25_whole"](spark, str(tmp_path)).collect()} == want
    shared = {(q, k): len(set(asked[q].split()) & set(c)) for q in asked for k, c in words.items() if set(asked[q].split()) & set(c)}
    assert shared[7, 4] == 1 and {(r.query_id, r.relation_id): r.overlap for r in registry.QUERIES["grf_relations_for_query_whole"](spark, str(tmp_path)).collect()} == shared


def test_hot_node_passes_on_all_neighbours(spark):
    # a hot node -1, parallel relations, an id shared by two relations, a loop
    rows = [(i, i, -1) for i in range(1, 41)] + [(50, 1, -2), (51, 2, -2), (52, 2, -2), (60, 1, -3), (60, 3, -3), (70, 5, 5)]
    edges = spark.createDataFrame(rows, "relation_id long, a long, b long")
    got = tables.two_hop_paths(edges, spark.createDataFrame([(1,), (5,), (-1,)], "seed long"))
    both = rows + [(r, b, a) for r, a, b in rows]
    want = {(a, b, d) for r, a, b in both for s, c, d in both if a in (1, 5, -1) and b == c and r != s and len({a, b, d}) == 3}
    assert sorted(map(tuple, got.collect())) == sorted(want) and (1, -1, 40) in want and (1, -3, 3) not in want


def test_every_id_of_a_busy_query_is_ranked(spark):
    rows = [("hot", str(i), "t", i % 3 == 0, float(i % 7) if i < 300 else 3.0) for i in range(900)] + [("b", "x", "t", None, None), ("b", "y", " ", True, 1.0), ("b", None, "t", True, 2.0), (None, "z", "t", True, 1.0)]
    got = review.ranking_places(spark.createDataFrame(rows, "query_id string, id string, text string, label boolean, score double"), 16).collect()
    order = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[4], r[1]))
    assert sorted((r.query_id, r.place, r.id, r.label) for r in got if r.query_id == "hot") == [("hot", k + 1, r[1], r[3]) for k, r in enumerate(order)]
    assert [(r.place, r.id) for r in got if r.query_id == "b"] == [(1, "x")] and [(r.place, r.id) for r in got if r.query_id is None] == [(1, "z")]
