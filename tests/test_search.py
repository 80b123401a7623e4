"""Lexical search and shared words against plain loops."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from evidence_spark.functions import text
from evidence_spark.operators import search, tables


def test_words_of_any_script(spark):
    said = ["中文 查询，关系", "Café ÉCOLE straße", "Σίσυφος ΣΊΣΥΦΟΣ", "a_b 1½ x²", "नमस्ते", "", None, "İstanbul ſ ﬁ"]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    got = [r[0] for r in df.select(text.any_words(F.col("t"))).collect()]
    assert got == [None if t is None else re.findall(r"\w+", t.casefold()) for t in said]


def test_relations_in_chinese_and_with_accents(spark):
    asked = spark.createDataFrame([(1, "索引 更新 如何"), (2, "L’École des Étoiles")], "query_id long, t string")
    held = spark.createDataFrame([(10, "索引 编码"), (11, "更新 索引"), (12, "école étoiles"), (13, "ECOLE"), (14, "ÉTOILES")], "relation_id long, t string")
    q, r = (x.withColumn("tokens", text.any_words(F.col("t"))) for x in (asked, held))
    got = {(x.query_id, x.relation_id): x.overlap for x in tables.relations_for_query(q, r, 5).collect()}
    assert got == {(1, 11): 2, (1, 10): 1, (2, 12): 2, (2, 14): 1}


def test_most_shared_prunes_nothing_away(spark):
    rnd = random.Random(8)
    often, rare = [f"o{i}" for i in range(6)], [f"r{i}" for i in range(300)]
    rows = [(i, rnd.sample(often, rnd.randint(0, 6)) + rnd.choices(rare, k=rnd.randint(0, 25))) for i in range(900)]
    asked = [(q, rnd.sample(often, rnd.randint(0, 6)) + rnd.choices(rare, k=k)) for q, k in enumerate([0, 1, 2, 5, 20, 60, 120] * 3)] + [(99, []), (98, ["nowhere"])]
    df, qs = spark.createDataFrame(rows, "id long, tokens array<string>"), spark.createDataFrame(asked, "query_id long, tokens array<string>")
    for n in (1, 10):
        want = set()
        for q, words in asked:
            found = sorted(((-len(set(words) & set(own)), i) for i, own in rows if set(words) & set(own)))[:n]
            want |= {(q, i, -s) for s, i in found}
        for frequent in (5, 20, 10_000):
            assert {tuple(r) for r in search.most_shared(qs, df, n, frequent).collect()} == want


def test_bm25_best(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, rnd.choices([f"w{j}" for j in range(40)], k=rnd.randint(0, 30))) for i in range(300)] + [(900, None)]
    asked = [(q, rnd.choices([f"w{j}" for j in range(50)], k=rnd.randint(0, 12))) for q in range(12)]
    n, mean = len(rows), sum(len(t or []) for _, t in rows) / len(rows)
    df = Counter(w for _, t in rows for w in set(t or []))
    want = {}
    for q, terms in asked:
        for i, tokens in rows:
            tf = Counter(tokens or [])
            score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(tokens) / mean)) for w in set(terms) if tf[w])
            if score > 0:
                want[q, i] = round(score, 9)
    chunks, queries = spark.createDataFrame(rows, "chunk_id long, tokens array<string>"), spark.createDataFrame(asked, "query_id long, terms array<string>")
    for limit in (32 << 20, 0):  # sent to every task, or joined
        monkeypatch.setattr(search, "ASKED_BYTES", limit)
        assert {(r.query_id, r.chunk_id): round(r.score, 9) for r in search.bm25(queries, chunks).collect()} == want
    for frequent in (2, 20, 10_000):
        best = {(r.query_id, r.chunk_id) for r in search.bm25(queries, chunks, n=3, frequent=frequent).collect()}
        assert best == {(q, i) for q, _ in asked for _, i in sorted((-round(s, 7), i) for (p, i), s in want.items() if p == q)[:3]}


def test_sums_are_dealt_by_their_pairs(spark, monkeypatch):
    """Not by the bytes of postings, which don't tell how many queries ask for a word; also where words are null or rows span slices."""
    rnd = random.Random(4)
    rows = [(i, [rnd.choice(["a", "b", "c", "d", None]) for _ in range(rnd.randint(0, 9))]) for i in range(700)]
    chunks = spark.createDataFrame(rows, "chunk_id long, tokens array<string>")
    queries = spark.createDataFrame([(q, ["a", "b", "c"]) for q in range(20)], "query_id long, terms array<string>")
    pairs = 20 * sum(len(set(t) & {"a", "b", "c"}) for _, t in rows)
    want = {(r.query_id, r.chunk_id): round(r.score, 9) for r in search.bm25(queries, chunks).collect()}
    monkeypatch.setattr(search, "TASK_PAIRS", 1000)
    found = search.bm25(queries, chunks)
    assert found.rdd.getNumPartitions() == -(-pairs // 1000)
    assert {(r.query_id, r.chunk_id): round(r.score, 9) for r in found.collect()} == want
    assert set(want) == {(q, i) for q in range(20) for i, t in rows if set(t) & {"a", "b", "c"}}
    held = search.postings(chunks, queries.selectExpr("explode(terms) as term"), ["chunk_id"], "tokens").collect()
    assert sorted((r.chunk_id, r["size"], r.term, r.tf) for r in held if r.term) == sorted((i, len(t), w, t.count(w)) for i, t in rows for w in {"a", "b", "c"} & set(t))
    assert sorted((r.chunk_id, r["size"]) for r in held if not r.term) == [(i, len(t)) for i, t in rows]
