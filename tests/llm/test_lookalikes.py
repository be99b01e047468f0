from __future__ import annotations

import unicodedata

from loomstone.llm import lookalikes as L

CASES = {
    "ＡＢＣ　１２": "ABC 12",
    "㎏": "kg",
    "⾹薰": "香薰",
    "éa": "éa",
    "a​b­c﻿": "abc",
    "a b c": "a b c",
    " x ": "x",
    "Рro": "Pro",
    "ΕΧР": "EXP",
    "Rеd": "Red",
    "ﬁ": "fi",
    "ｶﾞ": "ガ",
    "": "",
}
SAME = ["Журнал", "Λόγος", "日本語ラベル", "Ω系列", "Édition limitée", "Дизайн", "Größe", "Жизнь", "【正品】 a b", "plain", "it's 'quoted' @ \\0"]


def test_canonical(spark):
    rows = [(i, t) for i, t in enumerate([*CASES, *SAME, None])]
    df = spark.createDataFrame(rows, "k long, v string")
    got = {r.k: r.v_canonical for r in L.canonical(df, ["k"], ["v"]).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())
    assert [got[len(CASES) + i] for i in range(len(SAME))] == SAME
    assert got[len(rows) - 1] is None


def test_disguised(spark):
    rows = [(i, t, "x") for i, t in enumerate([*CASES, *SAME, None])]
    df = spark.createDataFrame(rows, "k long, v string, field string").selectExpr("k", "v", "field as w")
    got = {(r.k, r.field) for r in L.disguised(df, "k", ["v", "w"]).collect()}
    assert got == {(i, "v") for i, t in enumerate(CASES) if t}


def test_every_compatibility_form(spark):
    one, many = L.compatibility_forms()
    chars = [c for c in (one | many) if not unicodedata.category(c).startswith("Z")]
    df = spark.createDataFrame([(i, f"x{c}y") for i, c in enumerate(chars)], "k long, v string")
    got = {r.k: r.v_canonical for r in L.canonical(df, ["k"], ["v"]).collect()}
    wrong = [c for i, c in enumerate(chars) if got[i] == f"x{c}y"]
    assert not wrong


def test_idempotent_on_data(spark, data):
    df = spark.read.parquet(f"{data}/taobao.parquet")
    once = L.canonical(df, ["row_id"], ["商品标题"]).withColumnRenamed("商品标题_canonical", "t")
    assert L.disguised(once, "row_id", ["t"]).count() == 0


def test_long_and_empty(spark):
    df = spark.createDataFrame([(1, "Рro " * 100_000)], "k long, v string")
    assert L.canonical(df, ["k"], ["v"]).first().v_canonical == ("Pro " * 100_000).strip()
    assert L.canonical(df.limit(0), ["k"], ["v"]).collect() == []


def test_canonical_in_process(spark):
    """The form made within a Python process is that of the SQL, also for texts that never reach the SQL."""
    odd = ["", " ", " a ", None, "ＡＢ１２", "　米\xa0", "a​b", "été", "Ѕоny", "Рhone дом", "㎏", "ｶﾞ", "ᅠ", "ﾠx", "¨", "中­文", "ﬁn", "Åx", "각"]
    probes = odd + [f"{p}{chr(c)}{s}" for c in [*range(0x20, 0x600), *range(0x2000, 0x2100), *range(0x3000, 0x3040), *range(0x4E00, 0x4E40), *range(0xFF00, 0xFFF0)] for p, s in (("", ""), (" a", " "), ("", "é中"))]
    want = L.canonical(spark.createDataFrame(list(enumerate(probes)), "i long, t string"), ["i"], ["t"]).orderBy("i").collect()
    form = L.Canonical(*L.Canonical.plan())
    assert form(probes) == [r.t_canonical for r in want]
    form.connection = None
    assert form(["中文 Title", "ＡＢ１２ ", "a​b"]) == ["中文 Title", "AB12", "ab"] and form.connection is None
