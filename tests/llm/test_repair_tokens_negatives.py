"""Operators 11 to 13 against SQL, brute force, the tokenizer's library and hand-made edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from evidence_spark.llm import negatives, queries, repair, tokens

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows(df):
    return [r.asDict() for r in df.collect()]


def oracle(name, sf_dir):
    con = duckdb.connect()
    for table in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = con.sql(queries.ORACLES[name])
    return [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]


def same(found, want):
    return sorted(map(repr, (sorted(r.items()) for r in found))) == sorted(map(repr, (sorted(r.items()) for r in want)))


# --- repair


def brute_edits(initials, faults):
    """All sequences of edits that cost no more than deleting every row."""
    out, n = [], len(initials)
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def go(i, state, cost, audit):
        if cost > 2 * n:
            return
        if i == n and state in (0, 3):
            out.append((cost, audit))
        want = "uuau"[state]
        go(i, step[state, want], cost + 5, audit + "I")
        if i < n:
            go(i + 1, state, cost + 2, audit + "D")
            if faults[i] not in (1, 2):
                late = 5 * (faults[i] == 3)
                go(i + 1, step[state, want], cost + 1 + late, audit + "R")
                if (state, initials[i]) in step:
                    go(i + 1, step[state, initials[i]], cost + late, audit + "K")

    go(0, 0, 0, "")
    return min(out)


def test_lightest_derivation_against_all_edits():
    rnd = random.Random(5)
    for _ in range(3000):
        n = rnd.randint(0, 6)
        initials, faults = [rnd.choice("suuaax") for _ in range(n)], bytearray(rnd.choice((0, 0, 0, 1, 2, 3)) for _ in range(n))
        assert repair.cheapest_edits(initials, faults) == brute_edits(initials, faults)
    assert repair.cheapest_edits([], bytearray()) == (0, "")
    assert repair.cheapest_edits(list("ua") * 20_000 + ["a"], bytearray(40_001)) == (2, "K" * 39_999 + "DK")


def brute_repair(given):
    """Rows of one conversation as (turn, role, text) in order -> the operator's columns but conv_id."""
    solid = [re.sub(r"[\x20\x09-\x0D]+\Z", "", t) for _, _, t in given]
    faults, seen, initials = bytearray(), set(), [r[:1] for _, r, _ in given]
    for (_, role, text), s in zip(given, solid, strict=True):
        faults.append(1 if not s else 2 if (role, text) in seen else 3 if s[-1] not in ".!?" else 0)
        seen.add((role, text))
    cost, audit = brute_edits(initials, faults) if len(given) < 9 else repair.cheapest_edits(initials, faults)
    lines, rest = [], iter(given)
    for edit in audit:
        want = "assistant" if lines and lines[-1][0] == "u" else "user"
        if edit == "I":
            lines.append(want + ":")
        else:
            _, role, text = next(rest)
            if edit != "D":
                lines.append(f"{role if edit == 'K' else want}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and next(rest, None) is None
    turns = {t for t, _, _ in given if t is not None}
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3),
        "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def brute_op11(table):
    by = defaultdict(list)
    for conv, turn, role, text in table:
        own = by[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    # rows of equal turn by role, then digest of the conversation, role and text
    digest = lambda c, r, t: hashlib.sha256(f"{' ' if c is None else c}:{len(r)}:{r}{t}".encode()).digest()
    return [{"conv_id": c} | brute_repair(sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest(c, x[1], x[2])))) for c, own in by.items()]


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01"])
def test_repair_equals_sql(spark, sf_dir):
    assert same(rows(queries.op11_repair(spark, sf_dir)), oracle("op11_repair", sf_dir))


def test_repair_equals_brute_force(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert same(rows(queries.op11_repair(spark, SMALL)), brute_op11(table))


def test_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string, gaps string, _text int, audit int"
    table = [(None, t, r, x) for t, r, x in ((None, None, None), (0, "user", "a."), (None, "user", "a."), (5, "", "b!"))]
    table += [(1, 3, "user", "Same."), (1, 3, "user", "Same."), (1, 3, "assistant", "Same."), (1, 1, "system", "\x1c."), (1, 2, "tool", "x \t\r\n")]
    table += [(c, t, r, f"{c} {t}.") for c in range(2, 60) for t, r in enumerate(("system", "user", "assistant", "user"))]
    table += [(99, t, ("user", "assistant")[t % 2], f"long {t} " + "é€😀 " * 3000 + ".") for t in range(700)]
    table += [(98, -(2**63), "user", "a."), (98, 2**63 - 1, "assistant", "b.")]
    found = rows(queries.repair.repair_conversations(repair.damaged(spark.createDataFrame([(*r, "x", 1, 2) for r in table], schema))))
    want = brute_op11(table)
    for r in want:
        r["gaps"] = min(r["gaps"], 2**63 - 1)
    assert same(found, want)
    gone = [(c, t, "user", "a.") for c in range(100) for t in range(30) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    found = rows(repair.repair_conversations(repair.damaged(spark.createDataFrame([(*r, "x", 1, 2) for r in gone], schema))))
    assert len(found) == len({r[0] for r in gone}) and all(r["audit"] == "" and r["cost"] == r["gaps"] == 0 and r["repaired_sha256"] == hashlib.sha256().hexdigest() for r in found)
    assert repair.repair_conversations(repair.damaged(spark.createDataFrame([], schema))).count() == 0


def test_repair_plain_rows(spark):
    """The operator without damage, over a string id."""
    made = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 2, "user", "Hi."), ("a", 3, "assistant", "cut")], "conv_id string, turn int, role string, text string")
    (r,) = rows(repair.repair_conversations(made))
    assert (r["conv_id"], r["gaps"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == ("a", 1, 1, 1, 1, 6, "DDD")


# --- token counts


def test_token_counts_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = rows(queries.op12_tokens(spark, SMALL))
    assert len(found) == len(text)
    for r in found:
        n = len(library.encode(text[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text[r["doc_id"]].encode()), n, n > 4096)


def test_token_counts_of_odd_texts():
    counter = tokens.PieceCounter(MODEL, keep=50)
    odd = ["", " ", "  a ", "\n", "a\nb", "<s> </s> <0x0A>", "▁▁x", "ﬁ ①　x", "m².", "½.a", "\x00", "é", "﻿", "न्याय", "a" * 30_000, " " * 5000, "中" * 5000, "the" * 9000, "\n" * 999]
    rnd = random.Random(3)
    odd += ["".join(rnd.choice("aàe \n▁ 12中ﬁ①😀\x00<s>.\tthein½²_x") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    assert [counter.count(t) for t in odd] == [len(counter.model.encode(t)) for t in odd]


def test_token_counts_edges(spark):
    made = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "no id", 1), (3, "same", 2), (3, "same", 2), (4, "long " * 20_000, 3)], "doc_id long, text string, n_tokens int")
    found = rows(tokens.token_counts(made, MODEL))
    assert [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found] == [
        (1, 0, 0, False), (2, 0, 0, False), (None, 5, 2, False), (3, 4, 1, False), (3, 4, 1, False), (4, 100_000, 20_001, True)
    ]
    assert tokens.token_counts(made.limit(0), MODEL).count() == 0


# --- hard negatives


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01"])
def test_negatives_equal_sql(spark, sf_dir):
    assert same(rows(queries.op13_negatives(spark, sf_dir)), oracle("op13_negatives", sf_dir))


def test_strassen():
    rnd = np.random.default_rng(1)
    for n, k, m in ((1, 1, 1), (5, 7, 9), (16, 16, 16), (33, 64, 47), (2, 100, 3)):
        a, b = rnd.integers(-(2**25), 2**25, (n, k)), rnd.integers(-(2**25), 2**25, (k, m))
        assert (negatives.strassen(a, b, leaf=1) == a @ b).all() and (negatives.strassen(a, b) == a @ b).all()
    big = np.array([[2**62, -3], [5, 2**40]])
    assert (negatives.products(big, big) == 2**63 - 1).all() and negatives.products(big, -big)[0, 0] == -(2**63)
    assert negatives.products(np.zeros((0, 0), np.int64), big).shape == (0, 2)


def brute_negatives(table, every, k, n):
    """table: (id, label, ints), one row for each id."""
    out = []
    order = lambda s: (-s[0], s[1])
    for a, label, v in table:
        if a % every:
            continue
        score = [(sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in table if i != a]
        for p, pid, _ in sorted((s for s in score if s[2] == label), key=order)[:k]:
            good = sorted((s for s in score if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:n]
            out += [{"anchor_id": a, "positive_id": pid, "rank": r, "negative_id": i, "positive_score": p, "negative_score": s} for r, (s, i, _) in enumerate(good, 1)]
    return out


def test_negatives_in_many_cells(spark, monkeypatch):
    """Ties, copies of one vector, a hot label, vectors of unlike lengths; tiles so small that every key is split."""
    monkeypatch.setattr(negatives, "TILE", 256 * 3)
    rnd = random.Random(4)
    made = [(i, 1 if rnd.random() < 0.5 else rnd.randint(0, 4), [float(rnd.randint(-1, 3)) for _ in range(rnd.choice((2, 3)))]) for i in range(1500)]
    made += [(2000 + i, i % 3, [2.0, 1.0, 0.0]) for i in range(400)]
    df = spark.createDataFrame(made, "vec_id long, label int, embedding array<float>")
    found = rows(negatives.mine_negatives(df, every=50, scale=1.0))
    assert found and same(found, brute_negatives([(i, label, list(map(int, v))) for i, label, v in made], 50, 5, 10))


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(100, 1, [1.0, 0.5]), (101, 1, [1.0, 0.5]), (102, 2, [0.5, 0.25]), (103, 2, []), (104, 3, [0.0, 1.0]), (200, 9, [1.0]), (0, 2, [-1.0, -1.0])]
    bad = [(105, None, [1.0, 1.0]), (106, 1, None), (107, 1, [1.0, None]), (108, 2, [nan, 1.0]), (109, 2, [inf, 1.0]), (None, 1, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 7) for r in good + bad + good[:3]], "vec_id long, label int, embedding array<double>, score int")
    whole = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in good]
    assert same(rows(negatives.mine_negatives(df)), brute_negatives(whole, 100, 5, 10))
    assert negatives.mine_negatives(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, 1, [3e38]), (1, 1, [3e38]), (2, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert rows(negatives.mine_negatives(huge)) == []
    # an id with two vectors: both take part
    two = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0]), (1, 1, [0.9]), (2, 2, [0.5])], "vec_id long, label int, embedding array<double>")
    assert [(r["positive_id"], r["positive_score"]) for r in rows(negatives.mine_negatives(two).orderBy("positive_score"))] == [(1, 256 * 230), (1, 256 * 256)]
