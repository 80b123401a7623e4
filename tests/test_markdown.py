"""Blocks of Markdown: goldens, and the column against the plain function."""

import random
import time

import pytest

from evidence_spark.functions import markdown
from pyspark.sql import functions as F

GOLDEN = [
    ("# Paper\n\nBody **bold**.\n\n## Method\n\nText.\n\n```python\n# code, not heading\n```\n\nResults\n-------\nFinding.",
     [("heading", 1, "Paper"), ("paragraph", None, "Body bold."), ("heading", 2, "Method"), ("paragraph", None, "Text."), ("code", None, "# code, not heading"), ("heading", 2, "Results"), ("paragraph", None, "Finding.")]),
    ("# C#\n\n## Details ###\n\n```python\ndef f():\n    if True:\n        return 1\n```\n", [("heading", 1, "C#"), ("heading", 2, "Details"), ("code", None, "def f():\n    if True:\n        return 1")]),
    # headings without a title are no blocks, and their marks go from paragraphs
    ("#  \n\n# \n\n## \nx\n", [("paragraph", None, "x")]),
    ("####### seven\n #six\n", [("paragraph", None, "####### seven\n #six")]),
    ("a\n===\nb\n---\nc\nd\n---\n", [("heading", 1, "a"), ("heading", 2, "b"), ("paragraph", None, "c\nd\n---")]),
    ("---\n---\n\n===\n", [("heading", 2, "---"), ("paragraph", None, "===")]),
    ("~~~~\n```\n~~~\n~~~~~ \nafter\n``` open\n  kept  \n\n", [("code", None, "```\n~~~"), ("paragraph", None, "after"), ("code", None, "  kept  \n")]),
    ("```\n```\n```\n \n```\nx", [("paragraph", None, "x")]),
    ("one\r\ntwo\rthree # four #\n> q\n- i\n![x](y)[l](m)", [("paragraph", None, "one\ntwo\nthree"), ("heading", 1, "four"), ("paragraph", None, "q\n• i\nl")]),
    ("", []), (None, []), (" \n\t\n", []),
]


def blocks(rows):
    return [(b["kind"], b["level"], b["text"]) for b in rows]


@pytest.mark.parametrize("n", range(len(GOLDEN)))
def test_plain_function(n):
    assert blocks(markdown.markdown_rows(GOLDEN[n][0])) == GOLDEN[n][1]


def test_column(spark):
    rnd = random.Random(7)
    parts = ["# ", "## h", "###", "\n", "\n", "\n\n", "===", "---", "```", "~~~", "~~~~", "    ```", " x", "word [a](b)", "*b*", "- ", "> ", "\r\n", " ", "\t", " #", "\x1f", "\x0b"]
    texts = [t for t, _ in GOLDEN] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(1500)]
    texts += ["line\n" * 20_000, "```\n" + "code\n" * 20_000, "# h\n\n" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.b for r in df.select("i", markdown.markdown_blocks(F.col("t")).alias("b")).collect()}
    for i, (_, want) in enumerate(GOLDEN):
        assert blocks(got[i]) == want
    for i, t in enumerate(texts):
        assert [b.asDict() for b in got[i]] == markdown.markdown_rows(t), repr(t)


def test_many_fences_take_no_square_time(spark):
    """All code of a text was once cut out again for each of its fences."""
    texts = [f"line {i}\n~~~\n" * 12_000 for i in range(2)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    began = time.time()
    got = df.select(F.size(markdown.markdown_blocks(F.col("t"))).alias("n")).collect()
    assert [r.n for r in got] == [len(markdown.markdown_rows(t)) for t in texts]
    assert time.time() - began < 60
