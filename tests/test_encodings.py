"""Guessed encodings, and the reading that is taken."""

import pytest
from pyspark.sql import functions as F

from evidence_spark.functions.encodings import decode_bytes, decoded, guess_encoding

SIMPLE, TRADITIONAL = "知识图谱的构建依赖于大量的标注数据，因此成本很高。", "知識圖譜的構建依賴於大量的標註資料，因此成本很高。"
TEXTS = {
    "gb18030": SIMPLE, "big5": TRADITIONAL, "shift_jis": "知識グラフの構築には大量のデータが必要です。", "euc_jp": "知識グラフの構築には大量のデータが必要です。",
    "euc_kr": "지식 그래프를 구축하려면 많은 데이터가 필요하다.", "koi8-r": "Для построения графа знаний нужны большие данные.", "cp1251": "Для построения графа знаний нужны большие данные.",
    "cp1252": "Les élèves étudient à l'école près de la forêt.", "cp1253": "Η γνώση είναι δύναμη για όλους.", "utf-16-be": SIMPLE, "utf-16-le": TRADITIONAL, "utf-32-be": SIMPLE, "utf-32-le": TRADITIONAL,
}


@pytest.mark.parametrize("name", TEXTS)
def test_guess(name):
    assert guess_encoding(TEXTS[name].encode(name)) == name


def test_texts_are_read(spark):
    """UTF-8 first; GBK, Big5, both kinds of UTF-16 and cp1252 come back; a guess counts only if its text is plainer than all others."""
    rows = [(SIMPLE, "utf-8"), (SIMPLE, "gbk"), (TRADITIONAL, "big5"), (SIMPLE, "utf-16"), (SIMPLE, "utf-16-be"), (TRADITIONAL, "utf-16-le"), (SIMPLE, "utf-32-be"), (TEXTS["cp1252"], "cp1252"), ("plain", "ascii")]
    df = spark.createDataFrame([(i, bytearray(t.encode(e))) for i, (t, e) in enumerate(rows)] + [(90, bytearray(b"")), (91, None), (92, bytearray(b"\xff"))], "i int, raw binary")
    got = {r.i: r.t for r in df.select("i", decode_bytes(F.col("raw")).alias("t")).collect()}
    assert [got[i] for i in range(len(rows))] == [t for t, _ in rows]
    assert got[90] == "" and got[91] is None and got[92] == "ÿ"
    assert decoded(TEXTS["koi8-r"].encode("koi8-r")) != TEXTS["koi8-r"]  # no CJK and hardly any ASCII: another reading is plainer


def test_utf8_stays_in_the_jvm(spark, monkeypatch):
    """Only bytes that are no UTF-8 go to Python; overlong forms, surrogates and cut characters are none."""
    from pyspark.sql import functions as F

    from evidence_spark.functions import encodings

    rows = [b"", "héllo 中文 😀".encode(), b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"abc\xe4\xb8", "中文".encode("utf-16"), None]
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, raw binary")
    found = {r.id: r.t for r in table.select("id", encodings.decode_bytes(F.col("raw")).alias("t")).collect()}
    assert found == {i: encodings.decoded(r) for i, r in enumerate(rows)}

    def broken(raw):
        if raw is not None:
            raise RuntimeError("sent to Python")

    monkeypatch.setattr(encodings, "decoded", broken)
    assert table.filter("id < 2").select(encodings.decode_bytes(F.col("raw")).alias("t")).count() == 2
    assert [r.t for r in table.filter("id < 2").orderBy("id").select(encodings.decode_bytes(F.col("raw")).alias("t")).collect()] == ["", "héllo 中文 😀"]
