"""Pages, scopes, bounded paths and checks against small cases and brute force; their SQL is compared in test_library."""

import random

from evidence_spark.operators import lifecycle, operations, review, search, tables
from evidence_spark.sources import files


def brute_paths(edges, seed, limit):
    near = {}
    for rid, a, b in sorted(edges):
        near.setdefault(a, []).append((b, rid))
        near.setdefault(b, []).append((a, rid))
    one = [(b, None, b, rid, None) for b, rid in near.get(seed, []) if b != seed]
    two = [(b, b, c, rid, r2) for b, _, _, rid, _ in one for c, r2 in near[b] if c not in (seed, b) and r2 != rid]
    return [x[1:] for x in (one + two)][:limit]


def test_explore_paths_is_breadth_first(spark):
    rng = random.Random(3)
    # node 0 is hot, nodes 1 and 2 have many parallel relations to it, and some relations end where they start
    edges = [(i, rng.randrange(12), 0 if i % 3 else rng.randrange(12)) for i in range(150)] + [(200 + i, 0, 1 + i % 2) for i in range(60)] + [(1000 + i, 50 + i, 1) for i in range(8)]
    rows = spark.createDataFrame(edges, "relation_id long, a long, b long").repartition(5)
    seeds = spark.createDataFrame([(s,) for s in [0, 1, 5, 11, 51, 51, 57, 99]], "seed long")
    for limit in (1, 4, 20):
        got = {}
        for r in tables.explore_paths(rows, seeds, limit).orderBy("seed", "place").collect():
            got.setdefault(r.seed, []).append((r.mid, r.node, r["first"], r.second))
        want = {s: brute_paths(edges, s, limit) for s in (0, 1, 5, 11, 51, 57)}
        assert got == want


def test_scoped_bm25_counts_within_scope(spark):
    chunks = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 1, ["y"]), ("c", 2, ["x"] * 3), ("d", 3, [])], "chunk_id string, doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["x", "x"]), (2, ["x"]), (3, [])], "query_id long, terms array<string>")
    scope = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (2, 3), (3, 1)], "query_id long, doc_id long")
    got = {(r.query_id, r.chunk_id): r.score for r in search.bm25_scoped(asked, chunks, scope).collect()}

    def score(n, df, tf, size, mean):
        import math

        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))

    want = {(1, "a"): score(2, 1, 1, 2, 1.5), (2, "a"): score(4, 2, 1, 2, 1.5), (2, "c"): score(4, 2, 3, 3, 1.5)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_pages_of_lists(spark):
    users = spark.createDataFrame([("t", i, f"u{i}@x.org", 10 - i) for i in range(6)] + [("s", 9, "z", 1)], "tenant string, user_id long, email string, created_at long")
    docs = spark.createDataFrame([(2,), (2,), (7,)], "user_id long")
    got = operations.users_page(users, docs, "tenant", " @x ", limit=2, offset=1).orderBy("place").collect()
    assert [tuple(r) for r in got] == [("t", 1, 2, 6, 0), ("t", 2, 3, 6, 2)]
    assert operations.users_page(users.limit(0), docs, "tenant").count() == 0

    sessions = spark.createDataFrame([("t", 1, "ab", False, 1, 5), ("t", 2, "ab", True, 1, 6), ("t", 3, "b", False, 2, 5), ("t", 4, None, False, 1, 9)], "owner string, session_id long, title string, is_deleted boolean, created_at long, updated_at long")
    said = spark.createDataFrame([(1, "assistant", "old", 1, 1), (1, "assistant", "new\nline " + "x" * 90, 1, 2), (1, "user", "later", 9, 9)], "session_id long, role string, content string, created_at long, id long")
    got = operations.sessions_page(sessions, said, "owner", "b").orderBy("place").collect()
    assert [(r.session_id, r.place, r.total, r.preview) for r in got] == [(3, 1, 2, ""), (1, 2, 2, ("new line " + "x" * 90)[:60])]


def test_faults_of_pairs_chats_and_batches(spark):
    asked = spark.createDataFrame([(1,), (2,)], "question_id long")
    hits = spark.createDataFrame([(1, "a", 1, "h", "xx"), (1, "a", 2, "i", "xx"), (1, "a", 3, "i", "x" * 99), (1, "b", 1, "h", "x"), (1, "b", 2, "h", "x"), (2, "a", 1, "h", "x" * 9), (2, "a", 2, "i", "x"), (3, "a", 1, "h", "x")], "question_id long, variant string, rank int, id string, text string")
    got = {(r.question_id, r.variant): r.fault for r in review.paired_faults(asked, hits, ("a", "b"), 2, 9).collect()}
    assert got == {(1, "b"): "hits", (2, "a"): "budget", (2, "b"): "missing", (3, "a"): "foreign"}

    chats = spark.createDataFrame([(["m"], None), ([], " "), (None, "t"), (None, None)], "messages array<string>, text string")
    assert [r[0] for r in chats.select(review.training_faults("chat")).collect()] == [None, "no messages or text", None, "no messages or text"]

    named = spark.createDataFrame([(1, "a.txt", 1), (1, "b.txt", 1), (2, "c.txt", 0), (None, "d.txt", 1), (None, "e.txt", 1)], "batch long, name string, size long")
    got = {r.name: r.reason for r in files.admit_files(named, (".txt",), 9, max_per_batch=1).collect()}
    assert got == {"a.txt": "too many files", "b.txt": "too many files", "c.txt": "empty", "d.txt": "too many files", "e.txt": "too many files"}


def test_page_counts_and_stale_switches(spark):
    blocks = spark.createDataFrame([(1, "a", 1, 3, 3), (1, "b", 1, 4, 3), (2, "a", None, None, 1)], "doc_id long, block_id string, page_start int, page_end int, page_count int")
    blocks = blocks.selectExpr("*", "'paragraph' as kind", "cast(null as int) as level", "'t' as text")
    assert [tuple(r) for r in review.block_faults(blocks).collect()] == [(1, "b", "page count")]
    assert review.block_faults(blocks.drop("page_count")).count() == 0

    asked = spark.createDataFrame([("u", 2), ("u", 1), ("v", 0), ("v", 1), ("v", None), (None, 0)], "owner string, expected long")
    got = lifecycle.stale_switches(asked, spark.createDataFrame([("u", 2)], "owner string, revision long")).collect()
    assert {(r.owner, r.expected): r.conflict for r in got} == {("u", 2): False, ("u", 1): True, ("v", 0): False, ("v", 1): True, ("v", None): True, (None, 0): False}
