"""Goldens of quotes, windows, files and the stream of documents."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from evidence_spark.operators import claims
from evidence_spark.sources import files
from evidence_spark.streaming.ingest import ingest


def test_located():
    assert claims.located("ab cd", "x a b\nc d y")[2] == "quote_not_found" and claims.located("in form", "We inform you")[2] == "quote_not_found"
    assert claims.located("a b c", "x a\n\t b\u00a0c y") == (2, 9, None)
    assert claims.located("ﬁne", "so ﬁne.") == (3, 6, None) and claims.located("fine", "so ﬁne.") == (3, 6, None)
    assert claims.located("AB", "ab")[2] == "quote_not_found" and claims.located("AB", "ab", True) == (0, 2, None)
    assert claims.located("aa", "xaaa") == (1, 3, None) and claims.located("aa", "aa aa")[2] == "ambiguous_quote" and claims.located("", "a")[2] == "quote_not_found" and claims.located("a", None)[2] == "unknown_evidence"


def test_windows():
    assert claims.window_ranges("", 10) == claims.window_ranges(None, 10) == []
    text = "One two. Three four five. " * 5
    cut = claims.window_ranges(text, 30)
    assert "".join(text[a:b] for a, b in cut) == text and all(text[a:b].endswith((".", ". ")) or b == len(text) for a, b in cut)
    half = "a" * 900
    assert claims.window_ranges(f"{half}. {half}", 1600) == [(0, 902), (902, 1802)] and claims.window_ranges(f"{half}; {half}", 1600)[0] == (0, 1600)
    assert claims.window_ranges("x" * 25, 10) == [(0, 10), (10, 20), (20, 25)]


def test_quotes_with_nulls(spark):
    df = spark.createDataFrame([(1, "b c", "a b c"), (2, None, "a"), (3, "a", None)], "id int, q string, t string")
    got = df.select("id", claims.locate_quote(F.col("q"), F.col("t")).alias("x")).select("id", "x.*").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 2, 5, None), (2, None, None, "quote_not_found"), (3, None, None, "unknown_evidence")]


def test_numeric_gate(spark):
    rows = [("1,200", "1200.0"), ("1e3", "1,000"), ("52", "T5 52."), ("５２", "52"), ("-0.50", "-.5 -0.5"), ("3", "T3 3.1"), ("BERT-3 has 7", "7"), (None, None), ("1", None), ("0", "0.00"), ("1e-2", "0.01")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, q string")
    got = [r[0] for r in df.select(claims.numeric_gate(F.col("s"), F.col("q"))).collect()]
    bad = "numeric_value_not_in_quote"
    assert got == [None, None, bad, None, None, bad, bad, None, bad, None, None]


def test_quotes_on_pages(spark):
    pages = spark.createDataFrame([(1, 1, "We  inform\n you: ﬁne"), (1, 2, None)], "doc_id int, page int, text string")
    rows = [(1, 1, 1, "inform you"), (2, 1, 1, "in form"), (3, 1, 1, "fine"), (4, 1, 1, "We"), (5, 1, 2, "abc"), (6, 2, 1, "abc"), (7, 1, 1, None)]
    got = claims.quote_on_page(spark.createDataFrame(rows, "citation_id int, doc_id int, page int, quote string"), pages).orderBy("citation_id").collect()
    assert [r.ok for r in got] == [True, False, True, False, False, False, False]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("# 你好".encode("gb18030"))
    (tmp_path / "b.TXT").write_text("plain")
    (tmp_path / "c.pdf").write_text("no")
    assert sorted(r.text for r in files.read_text_files(spark, str(tmp_path)).collect()) == ["# 你好", "plain"]
    rows = {r.file: r.size for r in files.tree_manifest(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.md", "b.TXT", "c.pdf"} and rows["b.TXT"] == 5


def test_stream_of_documents(spark, tmp_path):
    new, out = str(tmp_path / "new"), str(tmp_path / "out")

    def arrive(rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(new)
        ingest(spark.readStream.schema("doc_id long, text string").parquet(new), out, str(tmp_path / "cp")).awaitTermination()

    arrive([(1, "one. " * 300), (2, None)])
    arrive([(1, "again"), (2, "now"), (3, "three")])
    status = sorted((r.doc_id, r.state) for r in spark.read.parquet(f"{out}/status").collect())
    assert status == [(1, "ready"), (2, "failed"), (2, "ready"), (3, "ready")]
    chunks = spark.read.parquet(f"{out}/chunks")
    assert {r.doc_id for r in chunks.collect()} == {1, 2, 3} and chunks.filter("doc_id = 1").count() > 1


def test_quotes_and_windows_leave_python_as_columns(spark):
    """Lists of null, empty and filled values in one batch; no list of rows is held as objects."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from evidence_spark.operators import claims

    kind = pa.struct([("a", pa.int32()), ("b", pa.string())])
    values = [None, [], [(1, None)], None, [(2, "x"), (None, "y")], None]
    assert claims._lists(iter(values), kind).to_pylist() == [None if v is None else [{"a": a, "b": b} for a, b in v] for v in values]
    rows = [(0, "one two. three", ["two.", "one   three", "", None]), (1, None, ["a"]), (2, "a", None), (3, "a a", ["a"]), (4, "", [])]
    table = spark.createDataFrame(rows, "id int, t string, q array<string>").coalesce(1)
    found = table.select("id", claims.locate_quotes(F.col("q"), F.col("t")).alias("x"), claims.citation_windows(F.col("t"), 4).alias("w")).collect()
    for (_, t, q), r in zip(rows, sorted(found), strict=True):
        assert r.x == (None if q is None else [claims.located(s, t) for s in q])
        assert r.w == claims.window_ranges(t, 4)


def test_hot_windows_are_dealt_into_parts(spark):
    """Nine in ten claims name one window, which is too much for one task at size; twice, unknown and null windows keep their reasons."""
    rows = [(c, 0) for c in range(4000)] + [(c, 1) for c in range(0, 4000, 10)] + [(1, 0), (2, 9), (2, 9), (3, None), (5, 2), (6, 1), (6, 1)]
    picks = spark.createDataFrame(rows, "claim_id long, window_id long")
    windows = spark.createDataFrame([(0, 0, 800), (1, 800, 1600), (2, 1600, 2400)], "window_id long, start int, end int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = claims.resolve_support(picks, windows)
        got = {r.claim_id: (r.char_start, r.char_end, r.reason) for r in found.collect()}
        met = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(window_id" in x]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {c: (0, 800, None) if c % 10 else (0, 1600, None) for c in range(4000)}
    want |= {1: (None, None, "duplicate_window"), 2: (None, None, "unknown_window"), 3: (None, None, "unknown_window"), 5: (None, None, "too_long"), 6: (None, None, "duplicate_window")}
    assert got == want
    assert met and all("salt" in x for x in met)  # no join deals picks by their window alone


def test_quotes_without_a_pattern():
    """The quick way gives what the pattern gives, for all characters it is meant for, and takes no pattern for most lines."""
    plain = [chr(c) for c in range(0x3100) if claims.PLAIN_CASE.fullmatch(chr(c))]
    assert all(len(c.lower()) == 1 for c in plain)
    cased = [c for c in plain if c.lower() != c or c.upper() != c]
    for c in cased:
        assert set(re.findall(re.escape(c), "".join(cased), re.IGNORECASE)) == {x for x in cased if x.lower() == c.lower()}

    def by_pattern(quote, text, fold):
        form, place = claims.normal_form(text)
        found = list(re.finditer(r"\s+".join(map(re.escape, unicodedata.normalize("NFKC", quote).split())), form, re.IGNORECASE if fold else 0))
        return (int(place[found[0].start()]), int(place[found[0].end() - 1]) + 1, None) if len(found) == 1 else (None, None, "ambiguous_quote" if found else "quote_not_found")

    rnd = random.Random(2)
    parts = ["a", "B", "ab", " ", " ", "  ", "\n", "\t", "É", "é", "ß", "ﬁ", "İ", "ſ", "s", "中", ".", "\x1f", "ΣΑΣ", "½"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        at = rnd.randint(0, len(text) - 1)
        quote = rnd.choice([str.upper, str.lower, str])(text[at : at + rnd.randint(1, 5)])
        for fold in (False, True):
            if quote.split():
                assert claims.located(quote, text, fold) == by_pattern(quote, text, fold), (quote, text, fold)
