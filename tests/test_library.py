"""Goldens of the library's functions and the registered queries against DuckDB."""

import random

import duckdb
import pytest

from evidence_spark.functions import chunks
from evidence_spark.operators import evaluation, search
from evidence_spark.plans import registry
from evidence_spark.sources import files

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SMALL)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cur = con.execute(registry.ORACLES[name])
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == sorted(df.columns)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def test_flat_chunks():
    two = chunks.flat_pieces("a" * 100 + "。" + "b" * 99, 100, 10)
    assert [len(x) for x in two] == [100, 11, 109] or sum(map(len, two)) >= 200
    assert chunks.flat_pieces("  short  ", 600, 60) == ["short"] and chunks.flat_pieces(" \n ", 600, 60) == []
    many = chunks.flat_pieces("One two three. " * 200, 600, 60)
    assert all(len(x) <= 660 for x in many) and all(a[-20:].strip() in b for a, b in zip(many, many[1:]))
    assert max(map(len, chunks.flat_pieces("x" * 1000, 100, 10))) <= 110


def test_union_coverage(spark):
    gold = spark.createDataFrame([("q", "a", 1, 10, 20), ("q", "b", 1, 10, 20)], "query_id string, doc_id string, page int, g_start int, g_end int")
    hits = spark.createDataFrame([("q", 1, "a", 1, 10, 15), ("q", 2, "a", 1, 15, 20), ("q", 3, "b", 1, 10, 20)], "query_id string, rank int, doc_id string, page int, s_start int, s_end int")
    got = {r.k: (r.recall, r.complete) for r in evaluation.anchor_coverage(gold, hits, (1, 2, 3)).collect()}
    assert got == {1: (0.0, False), 2: (0.5, False), 3: (1.0, True)}


def test_coverage_needs_one_join_and_no_window(spark):
    """Gaps, neighbours, spans in one another and below k, against sets of places."""
    rnd = random.Random(6)
    gold = [(q, d, 1, a, a + rnd.randint(1, 12)) for q in range(6) for d in range(4) for a in (rnd.randint(0, 20), 30)] + [(9, None, 1, 0, 4)]
    hits = [(q, r, rnd.randint(0, 3), 1, a, a + rnd.randint(1, 14)) for q in range(6) for r in range(1, 30) for a in [rnd.randint(0, 38)]] + [(9, 1, None, 1, 0, 9)]
    found = evaluation.anchor_coverage(
        spark.createDataFrame(gold + gold[:3], "query_id int, doc_id int, page int, g_start int, g_end int"), spark.createDataFrame(hits, "query_id int, rank int, doc_id int, page int, s_start int, s_end int"), (3, 12, 25)
    )
    want = {}
    for q in {g[0] for g in gold}:
        for k in (3, 12, 25):
            told = [set(range(a, e)) <= {x for h in hits if h[0] == q and h[1] <= k and d is not None and h[2] == d for x in range(h[4], h[5])} for p, d, _, a, e in set(gold) if p == q]
            want[q, k] = (round(sum(told) / len(told), 6), all(told))
    assert {(r.query_id, r.k): (r.recall, r.complete) for r in found.collect()} == want and len({r for r, _ in want.values()}) > 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" not in plan


def test_ranking_golden(spark):
    ranked = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "c", 3)], "query_id string, id string, rank int")
    got = {r.k: (r.recall, r.mrr) for r in evaluation.ranking_metrics(ranked, spark.createDataFrame([("q", "a")], "query_id string, id string"), (1, 2)).collect()}
    assert got == {1: (0.0, 0.0), 2: (1.0, 0.5)}


def test_search_keeps_tenants_apart(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [1.0, 0.0, 0.0], "a"), (4, [0.6, 0.8], "a")], "id long, vector array<double>, user string")
    asked = spark.createDataFrame([(7, [2.0, 0.0], "a")], "query_id long, vector array<double>, user string")
    assert [(r.id, round(r.score, 6)) for r in search.cosine_topn(asked, index, 5, "user").orderBy("rank").collect()] == [(1, 1.0), (4, 0.6)]


def test_jsonl_round_trip(spark, tmp_path):
    out = str(tmp_path / "rows")
    assert files.write_jsonl(spark.range(5).selectExpr("id", "'é' as t"), out) == 5
    (tmp_path / "rows" / "part-x.json").write_text('\n[1]\n{"id": 9}\nnot json\n')
    good, bad = files.read_jsonl_strict(spark, out, "id long, t string")
    assert sorted(r.id for r in good.collect()) == [0, 1, 2, 3, 4, 9] and bad.count() == 2


def test_daily_usage_streams(spark, tmp_path):
    logs = registry.usage_logs(spark, SMALL)
    path = str(tmp_path / "logs")
    logs.write.parquet(path)
    from evidence_spark.streaming.usage import daily_usage

    stream = daily_usage(spark.readStream.schema(logs.schema).parquet(path))
    run = stream.writeStream.format("memory").queryName("daily").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(str, spark.table("daily").collect())) == sorted(map(str, daily_usage(logs).collect()))
