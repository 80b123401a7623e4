"""Sections, offsets, spans and structured chunks against plain functions."""

import random

from pyspark.sql import functions as F

from evidence_spark.functions.structure import section_groups as plain_groups
from evidence_spark.functions.structure import structured_rows
from evidence_spark.operators import scan, sections

SCHEMA = "doc_id long, block_no int, kind string, level int, text string, page int, section_path array<string>"


def made(docs=30, blocks=60, seed=1):
    rnd, rows = random.Random(seed), []
    for d in range(docs):
        for i in range(rnd.randint(0, blocks)):
            kind = rnd.choice(("heading", "paragraph", "paragraph", "paragraph", "code", "table", "formula"))
            text = rnd.choice(("", " \n\x1f", " Title ", "One. Two! Three", "x" * rnd.randint(1, 90), "Wörter 😀 und. " * rnd.randint(1, 9)))
            own = rnd.choice((None, None, None, [], ["given"], ["given", "path"]))
            rows.append((d, i, kind, rnd.randint(1, 6) if kind == "heading" else None, text, rnd.choice((None, i // 5 + 1)), own))
    return rows


def by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(dict(zip(("doc_id", "block_no", "kind", "level", "text", "page", "section_path"), r)))
    return out


def test_running_in_segments(spark):
    rnd = random.Random(2)
    rows = [(k, p, rnd.choice((None, rnd.randint(-9, 9)))) for k in range(4) for p in rnd.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "k int, p int, v int")
    for before in (False, True):
        found = {"total": ("sum", F.col("v")), "top": ("max", F.struct("v", "p"))}
        plain, cut = (sorted(map(str, scan.running(df, ["k"], "p", found, before, n).collect())) for n in (None, 16))
        assert plain == cut


def test_section_groups(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for d, blocks in by_doc(rows).items():
        for n, (path, own) in enumerate(plain_groups(blocks)):
            want |= {(d, b["block_no"]): (n, list(path)) for b in own}
    for segment in (None, 7):
        assert {(r.doc_id, r.block_no): (r.group_no, r.section_path) for r in sections.section_groups(df, segment).collect()} == want
    assert sections.section_groups(df.limit(0)).count() == 0


def test_chunk_spans(spark):
    rows = made(docs=12)
    placed = sections.block_offsets(sections.section_groups(spark.createDataFrame(rows, SCHEMA)), segment=5)
    rnd, given = random.Random(3), {}
    for r in placed.collect():
        given.setdefault((r.doc_id, r.group_no), []).append((r.block_no, r.char_start, r.char_end, r.text))
    chunks, want = [], set()
    for (d, g), own in given.items():
        own.sort()
        whole = "\n\n".join(x[3] for x in own)
        assert all(whole[a:b] == t for _, a, b, t in own)
        for _ in range(4):
            a = rnd.randint(0, len(whole))
            b = rnd.randint(a, len(whole))
            chunks.append((len(chunks), d, g, a, b))
            want |= {(len(chunks) - 1, d, g, n, max(a, s) - s, min(b, e) - s) for n, s, e, _ in own if max(a, s) < min(b, e)}
    df = spark.createDataFrame(chunks, "chunk_id int, doc_id long, group_no long, start int, end int")
    for width in (3, 4096):
        found = [tuple(r) for r in sections.chunk_spans(df, placed, width).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_structured_chunks(spark):
    rows = made(docs=25, seed=4)
    want = {}
    for d, blocks in by_doc(rows).items():
        for c in structured_rows(blocks, 30, 100):
            want[d, c["is_parent"], c["chunk_index"]] = c
    found = {(r.doc_id, r.is_parent, r.chunk_index): r.asDict(recursive=True) for r in sections.structured_chunks(spark.createDataFrame(rows, SCHEMA), 30, 100).collect()}
    assert found.keys() == want.keys() and len(found) > 100
    for k, c in want.items():
        assert {n: found[k][n] for n in c} == c


def test_slices_of_characters_need_no_table_of_stops(monkeypatch):
    """Slices counted in characters are those of the general way, which finds all stops of a text first."""
    import random

    from evidence_spark.functions import structure

    rng = random.Random(5)
    cases = [("".join(rng.choices(alphabet, k=rng.randrange(0, 90))), rng.randrange(1, 30), keep) for alphabet in ("a \n", "ab .\n\t", "a\u3000\x1c\u0085。\n", "abc\n\n\n  ", "abcdef.") for _ in range(400) for keep in (False, True)]
    slow = [structure.token_ranges(t, limit, lambda x: len(x), keep) for t, limit, keep in cases]
    monkeypatch.setattr(structure, "Stops", None)
    assert [structure.token_ranges(t, limit, keep_space=keep) for t, limit, keep in cases] == slow


def test_flat_chunks_leave_python_in_parts(spark, monkeypatch):
    """A batch of more characters than are kept as objects gives the same chunks; a batch is one Arrow array in the function."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from evidence_spark.functions import chunks

    monkeypatch.setattr(chunks, "PIECE", 500)
    texts = ["one. two. " * 80, None, "", " ", "three", "中文。" * 200, "x" * 900, None]
    batches = []
    real = pa.concat_arrays
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: lambda column: batches.append(f) or column)
    chunks.chunk_flat(F.col("t"), 100, 10)
    assert len(batches) == 1
    parts = []
    monkeypatch.setattr(chunks.pa, "concat_arrays", lambda arrays: parts.append(len(arrays)) or real(arrays))
    (made,) = batches[0](iter([pa.array(texts)]))
    assert parts[0] > 2 and made.to_pylist() == [chunks.flat_pieces(t or "", 100, 10) for t in texts]


def test_slices_by_patterns(spark):
    """Slices that a pattern finds are those of the plain function, also in code, where white space stays."""
    from evidence_spark.functions import structure

    rng = random.Random(5)
    alphabets = ("a \n", "ab .\n\t", "a　\x1c\u0085。\n", "abc\n\n\n  ", "abcdef.", "a😀 \n.", "\n ", " .\n")
    df = spark.createDataFrame([("".join(rng.choices(x, k=rng.randrange(90))),) for x in alphabets for _ in range(150)], "t string").cache()
    for limit in (1, 2, 7, 29):
        for keep in (False, True):
            for r in df.select("t", structure.slices(F.col("t"), limit, keep).alias("x")).collect():
                at, found = 0, []
                for x in r.x:
                    assert r.t[at : at + len(x)] == x
                    shown, lo = (x, at) if keep else (x.strip(), at + len(x) - len(x.lstrip()))
                    found.append((lo, lo + len(shown)))
                    at += len(x)
                assert found == structure.token_ranges(r.t, limit, keep_space=keep)


def exchanges(df):
    """Shuffles of a plan; Python functions would lose how rows are dealt."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    return plan.count("Exchange ")


def test_chunks_are_not_shuffled_to_be_verified(spark):
    """Texts move once, as blocks; chunks, which hold them twice with their titles, stay where they are made."""
    from evidence_spark.operators import evidence

    chunks = sections.structured_chunks(spark.createDataFrame(made(docs=25, seed=4), SCHEMA), 30, 100)
    assert exchanges(chunks) == 1 and exchanges(evidence.verify_chunks(chunks, 30, 100)) == 1
    assert evidence.verify_chunks(chunks, 30, 100).count() == 0
    bad = chunks.filter("not (doc_id = 3 and not is_parent and chunk_index = 1)").withColumn("section_path", F.expr("if(doc_id = 5 and not is_parent, array('other'), section_path)"))
    bad = bad.withColumn("tokens", F.expr("if(doc_id = 6 and is_parent, 101, tokens)")).unionByName(bad.filter("doc_id = 7 and is_parent and chunk_index = 0"))
    found = {r.doc_id: r.problems for r in evidence.verify_chunks(bad, 30, 100).collect()}
    assert found == {3: ["index"], 5: ["parent"], 6: ["budget"], 7: ["index"]}
