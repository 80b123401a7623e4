"""The pipeline's stages keep what they must and take effect."""

import re
from collections import Counter

import pytest


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as p
    from evidence_spark.llm.common import written

    docs, out = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), {}
    out["start"] = docs
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, "/root/testdata/sf0.01"), f"test-{name}")
        out[name] = docs
    return out


def test_stages(stages, spark):
    names = ["start", "quality", "near_copies", "personal_data", "mixing"]
    for name in names:
        assert stages[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    n = {k: v.count() for k, v in stages.items()}
    assert n["start"] > n["quality"] > n["near_copies"] == n["personal_data"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in stages["quality"].select("doc_id").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    texts = [r.text for r in stages["personal_data"].collect()]
    assert not any(re.search(r"[\w.+-]+@[\w-]+\.\w+", t) for t in texts) and any("[EMAIL]" in t for t in texts)
    before = sum(len(r.text.split()) for r in stages["personal_data"].collect())
    after = sum(len(r.text.split()) for r in stages["mixing"].collect())
    assert abs(after - 1.5 * before) < 0.03 * before
    mixed = stages["mixing"].select("doc_id").distinct().count()
    assert stages["packing"].select("doc_id").distinct().count() == mixed


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(e.oracle_sql()) <= set(names)


def test_near_copies_keep_rows_without_ids(spark):
    import corpus_pipeline as p

    from test_operators import EDGE, SCHEMA

    edge = spark.createDataFrame(EDGE, SCHEMA)
    got = p.drop_near_copies(spark, edge, "").collect()
    said = {r.text for r in got}
    assert {r.text for r in edge.filter("doc_id is null").collect()} <= said | {r.text for r in edge.filter("doc_id is not null").collect()}

    clean, near = " ".join(f"alone{i}" for i in range(60)), [f"shared{i}" for i in range(60)]
    twin, other = " ".join(near), " ".join([*near[:-1], "changed"])
    second = " ".join(f"second{i}" for i in range(60))
    rows = [(None, clean), (None, twin), (None, twin), (None, other), (4, "an id with two texts " + " ".join(f"w{i}" for i in range(50))), (4, second), (9, second + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in p.drop_near_copies(spark, docs, "").collect()]
    assert (None, clean) in got and sum(t in (twin, other) for _, t in got) == 1
    assert rows[4] in got and sum(t.startswith("second0 ") for _, t in got) == 1 and len(got) == 4


# --- each stage on edge cases, and against brute force

LONG = " ".join(f"long{i % 977}" for i in range(30_000)) + " é€😀"
CASES = [
    (1, None, "en", None, 0), (2, "", "en", "b", 0), (3, " \n\t ", None, "b", 3), (4, "one", "en", "b", 3), (None, "a text without an id", "de", "é", 1),
    (None, None, None, None, None), (7, "the same row twice in a table of documents", "en", "a", 9), (7, "the same row twice in a table of documents", "en", "a", 9),
    (8, LONG, "fr", "a", 1), (9, "mail a.b@c.org from 10.0.0.1 today", "en", "a", 5), (None, "a text without an id", "de", "é", 1),
]
NAMES = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = ["quality", "near_copies", "personal_data", "mixing", "packing"]


@pytest.fixture(scope="module")
def cases(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(CASES, NAMES).withColumns({n: F.lit("x") for n in ("score", "_key", "_shard", "spans", "cls", "key", "size")})


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(4, 1, 0), (7, 0, 0), (9, 1, 0), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


@pytest.mark.parametrize("name", STAGES)
def test_stage_takes_edges(spark, cases, labelled, name):
    import corpus_pipeline as p

    stage = dict(p.STAGES)[name]
    got = stage(spark, cases, labelled).collect()
    none = stage(spark, cases.limit(0), labelled)
    assert none.count() == 0
    if name != "packing":
        assert none.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = Counter((r[0], r[1]) for r in CASES)
    if name == "quality":
        assert set((r.doc_id, r.text) for r in got) <= set(rows)
        same = [r for r in got if r.doc_id == 7]
        assert len(same) in (0, 2)
    elif name == "near_copies":
        assert Counter((r.doc_id, r.text) for r in got) == Counter(set(rows))  # one row of each
    elif name == "personal_data":
        assert len(got) == len(CASES) and {r.text for r in got if r.doc_id == 9} == {"mail [EMAIL] from [IP] today"}
        assert Counter(r.text for r in got if r.doc_id != 9) == Counter(r[1] for r in CASES if r[0] != 9)
        assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in got)
    elif name == "mixing":
        assert {(r.doc_id, r.text) for r in got} <= {k for k in rows if (k[1] or "").split()}
        assert all(n <= 2 * rows[k] for k, n in Counter((r.doc_id, r.text) for r in got).items())
    else:
        assert Counter(r.doc_id for r in got if r.start == 0) == Counter(r[0] for r in CASES)
        assert all(r.doc_tokens == 1 for r in got if r.doc_id in (1, 2))


def test_near_copies_equal_brute_force(spark, stages):
    from test_operators import brute_components, shingles

    before = stages["quality"].collect()
    texts = {r.doc_id: r.text for r in before}
    assert len(texts) == len(before)
    want = brute_components({d: shingles(t, 5) for d, t in texts.items()}, 80)
    assert sorted(r.doc_id for r in stages["near_copies"].collect()) == sorted(d for d, c in want.items() if d == c)


def test_personal_data_equals_brute_force(stages):
    """Every base match is replaced, whatever the model says, and texts without any candidate stay as they are."""
    from evidence_spark.llm import pii

    after = {r.doc_id: r.text for r in stages["personal_data"].collect()}
    for r in stages["near_copies"].collect():
        found = pii.candidates(r.text)
        if not found:
            assert after[r.doc_id] == r.text
        for s, e, kind, _, _ in found:
            if kind in pii.KINDS[:4]:
                assert r.text[s:e] not in after[r.doc_id]


def test_mixing_equals_brute_force(stages):
    from test_operators import WORD, brute_targets

    size = lambda t: len(WORD.findall(t or ""))
    words, taken, longest = Counter(), Counter(), Counter()
    before = {r.doc_id: r for r in stages["personal_data"].collect()}
    for r in before.values():
        words[r.source] += size(r.text)
        longest[r.source] = max(longest[r.source], size(r.text))
    for r in stages["mixing"].collect():
        assert tuple(r) == tuple(before[r.doc_id])
        taken[r.source] += size(r.text)
    target = brute_targets(dict(words))
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in words)
    ids = [r.doc_id for r in stages["mixing"].collect()]
    assert ids != sorted(ids) and len({r.source for r in stages["mixing"].limit(40).collect()}) > 1


def test_packing_equals_the_tokenizer(stages):
    import public_tokenizers
    from test_operators import check_packs

    rows = [(r.doc_id, r.text) for r in stages["mixing"].collect()]
    check_packs([r.asDict() for r in stages["packing"].collect()], rows, public_tokenizers.path("word_bpe_49k.json"))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from evidence_spark.llm import common

    class Cluster:
        class sparkContext:
            master, applicationId = "spark://head:7077", "app"

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError):
        common.shared_folder(Cluster())
    table = common.written(spark.range(3), "gone")
    path = table.inputFiles()[0].removeprefix("file://")
    common.discard(table)
    import os

    assert not os.path.exists(path)


def test_batches_of_a_stage_are_bounded(spark):
    import corpus_pipeline as p
    import pyarrow as pa
    from pyspark.sql import functions as F

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    stage = p._stage(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long"))
    docs = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("some text "), 1000).alias("text"))
    found = [r.n for r in stage(spark, docs, "").collect()]
    assert sum(found) >= 30_000_000 and max(found) < 5_000_000
