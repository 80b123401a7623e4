"""Readers of files against plain readers."""

import json
import random

import pytest

from evidence_spark.sources import files


@pytest.mark.parametrize("cut", [7, 64, 1000, 1 << 20])
def test_line_numbers_of_split_files(spark, tmp_path, cut):
    """Errors name the line that a plain reader counts, wherever the files are cut."""
    rnd, want, good = random.Random(cut), [], []
    for name, ends in (("a.jsonl", ["\n"]), ("b.jsonl", ["\r\n"]), ("c.jsonl", ["\n", "\r\n", "\r"])):
        text = ""
        for i in range(150):
            kind = rnd.random()
            line = "" if kind < 0.1 else " \t" if kind < 0.2 else rnd.choice(("[1]", "not json", '{"id": ', "7", '"é"')) if kind < 0.4 else json.dumps({"id": i, "t": "é" * rnd.randint(0, 9)}, ensure_ascii=False)
            text += line + rnd.choice(ends)
        (tmp_path / name).write_bytes((text + '{"id": -1}').encode())
        with open(tmp_path / name, encoding="utf-8") as stream:
            for number, line in enumerate(stream, 1):
                if line.strip():
                    try:
                        good.append(json.loads(line)["id"])
                    except (ValueError, TypeError):
                        want.append((name, number, line.rstrip("\r\n")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows, errors = files.read_jsonl_strict(spark, str(tmp_path), "id long, t string")
        got = [(r.file.rsplit("/", 1)[1], r.line, r.value) for r in errors.collect()]
        ids = [r.id for r in rows.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(want) and sorted(ids) == sorted(good) and want


def test_manifests_differ_as_a_walk_says(spark, tmp_path):
    import hashlib
    import shutil
    from pathlib import Path

    one, other = tmp_path / "one", tmp_path / "other"
    for name, text in (("a.txt", "1"), ("d/b.txt", "2"), ("d/e/c.txt", "3"), ("d/e/x.txt", "4"), ("same/y.txt", "5"), ("same/deep/z.txt", "6"), ("d/é ü.txt", "7")):
        (one / name).parent.mkdir(parents=True, exist_ok=True)
        (one / name).write_text(text)
    shutil.copytree(one, other)
    (other / "d/e/c.txt").write_text("33")
    (other / "a.txt").write_text("9")
    (other / "d/b.txt").unlink()
    (other / "d/e/new").mkdir()
    (other / "d/e/new/n.txt").write_text("8")

    def walk(root):
        return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(root).rglob("*") if p.is_file()}

    a, b = walk(one), walk(other)
    want = {f: "missing" if f not in b else "extra" if f not in a else "changed" for f in a.keys() | b.keys() if a.get(f) != b.get(f)}
    rows = [spark.createDataFrame([(f, len(h), h) for f, h in m.items()], "file string, size long, sha256 string") for m in (a, b)]
    assert {r.file: r.state for r in files.diff_manifest(*rows).collect()} == want and len(want) == 4
    read = [files.tree_manifest(spark, f"file://{p}") for p in (one, other)]
    assert {r.file for r in files.diff_manifest(*read).collect()} >= {"a.txt", "d/b.txt", "d/e/c.txt", "d/e/new/n.txt"}
    same = [{(r.directory, r.files): r.digest for r in files.directory_digests(m).collect()} for m in rows]
    assert same[0]["same", 2] == same[1]["same", 2] and same[0]["same/deep", 1] == same[1]["same/deep", 1] and same[0]["d", 4] != same[1]["d", 4]
