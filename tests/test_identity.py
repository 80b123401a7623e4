"""Canonical JSON, recomputed ids and digest trees against plain functions."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence_spark.functions.canonical import canonical_json, float_bits, nested_id
from evidence_spark.operators import identity


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_canonical_json(spark):
    schema = "z string, a long, `m` map<string,array<int>>, s struct<y:boolean,b:string,n:array<struct<q:string,c:int>>>, empty array<string>"
    odd = 'quote " back \\ slash / tab\t line\n feed\x0c bell\x07 unit\x1f del\x7f é 😀  '
    rows = [
        (odd, -(2**63), {"é": [1, None], "b": [], "a\n": [3], "B": [2]}, (True, None, [("x", 1), (None, None)]), []),
        (None, None, None, None, None),
        ("", 0, {}, (None, "", []), ["", None]),
    ]
    df = spark.createDataFrame(rows, schema)
    whole = F.struct(*df.columns)
    got = [tuple(r) for r in df.select(canonical_json(whole, df.schema), nested_id("id_", whole, df.schema)).collect()]

    def plain(row):
        z, a, m, s, empty = row
        s = None if s is None else {"y": s[0], "b": s[1], "n": [{"q": q, "c": c} for q, c in s[2]]}
        return canonical({"z": z, "a": a, "m": m, "s": s, "empty": empty})

    assert got == [(plain(r), "id_" + sha(plain(r))) for r in rows]
    with pytest.raises(TypeError):
        canonical_json(F.lit(1.0), T.DoubleType())


def test_float_bits(spark):
    values = [0.0, -0.0, 1.0, -2.5, 0.1, 1e-45, 3.4e38, float("inf")]
    df = spark.createDataFrame([(values,), ([],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(float_bits(F.col("v"))).collect()] == [[struct.pack("!f", x).hex() for x in values], [], None]


def fold(records, depth):
    """The nodes of one build's tree: a plain fold over sorted records."""
    keyed = sorted((sha(i), r) for i, r in records)
    nodes, level = {}, {}
    for k, r in keyed:
        level.setdefault(k[:depth], []).append(k + r)
    for d in range(depth, -1, -1):
        made = {p: sha("".join(parts)) for p, parts in level.items()}
        nodes |= {(d, p): x for p, x in made.items()}
        level = {}
        for p in sorted(made):
            level.setdefault(p[: d - 1] if d else "", []).append(p + made[p])
    return nodes


def test_tree_equals_a_fold_however_it_is_partitioned(spark):
    rnd = random.Random(6)
    rows = [(b, f"id{rnd.randint(0, 400)}", sha(str(rnd.random()))) for b in ("x", "y", None) for _ in range(300)]
    df = spark.createDataFrame(rows, "build string, id string, record string")
    for depth in (0, 1, 2):
        want = {(b, *k): v for b in ("x", "y", None) for k, v in fold([(i, r) for c, i, r in rows if c == b], depth).items()}
        for parts in (1, 7):
            tree = identity.digest_tree(df.orderBy(F.rand(parts)).repartition(parts), depth)
            assert {(r.build, r.depth, r.prefix): r.digest for r in tree.collect()} == want
    # each build has the depth of its own size
    deep = identity.digest_tree(df.filter("build = 'x' or id < 'id2'"), per_leaf=20).groupBy("build").agg(F.max("depth").alias("depth")).collect()
    assert all(r.depth == 1 for r in deep)
    roots = identity.digest_tree(df, per_leaf=20).filter("depth = 0").select("build", "records").collect()
    assert {r.build: r.records for r in roots} == {"x": 300, "y": 300, None: 300}


def test_a_component_below_a_float_is_no_change(spark):
    schema = "build string, id string, v array<double>"
    one = spark.createDataFrame([("b", str(i), [0.1 * i, 1.0]) for i in range(1, 51)], schema)
    tiny = spark.createDataFrame([("b", str(i), [0.1 * i + 1e-12, 1.0]) for i in range(1, 51)], schema)
    moved = spark.createDataFrame([("b", str(i), [0.1 * i + (1e-6 if i == 7 else 0), 1.0]) for i in range(1, 50)], schema)
    digests = [identity.record_digests(x, "build", "id", "v", []) for x in (one, tiny, moved)]
    trees = [identity.digest_tree(x, 1) for x in digests]
    root = [t.filter("depth = 0").first().digest for t in trees]
    assert root[0] == root[1] != root[2]
    assert identity.tree_differences(trees[0], trees[1], digests[0], digests[1], 1).count() == 0
    assert sorted((r.id, r.state) for r in identity.tree_differences(trees[0], trees[2], digests[0], digests[2], 1).collect()) == [("50", "missing"), ("7", "changed")]


def test_chunk_ids_follow_their_parents(spark):
    schema = "doc_id long, is_parent boolean, chunk_index int, parent_index int, title string, section_path array<string>, text string, tokens int, page_start int, page_end int, spans array<struct<block_no:int,char_start:int,char_end:int>>, input_id string"
    rows = [(1, True, 0, None, "T", ["T"], "abc", 3, 1, 1, [(0, 0, 3)], "i"), (1, False, 0, 0, "T", ["T"], "ab", 2, 1, 1, [(0, 0, 2)], "i")]

    def ids(given):
        return {r.is_parent: r.expected_id for r in identity.expected_chunk_ids(spark.createDataFrame(given, schema)).collect()}

    def plain(row, parent):
        names = [c.split()[0] for c in schema.replace("struct<block_no:int,char_start:int,char_end:int>", "struct").split(", ")]
        value = dict(zip(names, row)) | {"_none": parent}
        value["spans"] = [dict(zip(("block_no", "char_start", "char_end"), s)) for s in value["spans"]]
        return "chunk_" + sha(canonical(value))

    parent = plain(rows[0], None)
    assert ids(rows) == {True: parent, False: plain(rows[1], parent)}
    other = [(*rows[0][:4], "U", *rows[0][5:]), rows[1]]
    assert ids(other)[True] != parent and ids(other)[False] != ids(rows)[False]


def test_a_changed_component_is_always_another_number(spark, tmp_path):
    """Components between -0.55 and -0.36 stayed as they were, so their rows were not found."""
    from evidence_spark.plans.identity_queries import idx_tree_differences

    values = [-0.7, -0.5, -0.42, -0.4, -0.36, -0.1, -1e-9, 0.0, 0.3, 0.42, 1.0]
    rows = [(97 * k + 2, [0.1] * 7 + [v] + [0.2] * 3, k % 3) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {(r.id, r.state) for r in idx_tree_differences(spark, str(tmp_path)).collect()} == {(str(r[0]), "changed") for r in rows}


def test_chunks_are_not_shuffled_for_their_rules(spark):
    """Ids, rules and statistics of chunks are found where these are made: texts move once, as blocks, and no chunk is stored between."""
    from evidence_spark.operators import sections

    blocks = [(d, i, "heading" if i % 4 == 0 else "paragraph", 1 if i % 4 == 0 else None, f'Say "{i}"\x1f \\u00 ' * 9, None) for d in range(6) for i in range(9)]
    df = spark.createDataFrame(blocks, "doc_id long, block_no int, kind string, level int, text string, page int")
    chunks = identity.expected_chunk_ids(sections.structured_chunks(df, 30, 100).withColumn("input_id", F.lit("i")))
    named = chunks.withColumnsRenamed({"expected_id": "chunk_id", "expected_parent": "parent_chunk_id"})
    rules = identity.chunk_rules(named, 30, 100, "tokens")
    plan = rules._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "EvalPython" not in plan
    flags = ("id", "duplicate", "index", "budget", "parent")
    for r in rules.collect():
        assert not any(r[f] for f in flags) and r.told_parent_tokens == r.parent_tokens > 0 and r.told_child_tokens == r.child_tokens > 0
    twice = named.withColumn("chunk_id", F.expr("if(doc_id = 1 and not is_parent, 'x', if(doc_id = 2 and chunk_index = 0, null, chunk_id))"))
    assert {r.doc_id for r in identity.chunk_rules(twice, 30, 100).filter("duplicate").collect()} == {1, 2}


def test_json_of_rows_written_at_once(spark):
    """Rows without maps are written at once, with keys in order at each level, small digits of codes and nulls."""
    rows = [(t, [(1, t), (None, None)], [t, None], None) for t in (*map(chr, range(128)), "\\u001F", "\\u00", "é中😀 /", None)]
    df = spark.createDataFrame(rows, "b string, a array<struct<y:int,x:string>>, d array<string>, c boolean")
    for r in df.select(canonical_json(F.struct(*df.columns), df.schema).alias("j"), "b").collect():
        want = {"b": r.b, "a": [{"y": 1, "x": r.b}, {"y": None, "x": None}], "d": [r.b, None], "c": None}
        assert r.j == json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
