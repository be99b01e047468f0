from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.operators.packed import _CUT, Lattice, shape_of, split, split_values

LATTICE = Lattice({}, 1e-4, 1e-4)
CASES = {
    "店铺券45元、国家补贴10%、包邮": ["店铺券45元", "国家补贴10%", "包邮"],
    '第2件8.5折 , "口令""开学季""立减9元", ,满8,900减79,“赠品:充电头,试用装”': ["第2件8.5折", '口令"开学季"立减9元', "满8,900减79", "赠品:充电头,试用装"],
    "'颜色黑/白任选,赠试用装'": ["颜色黑/白任选,赠试用装"],
    '["满290减14", "赠收纳袋、贴纸"]': ["满290减14", "赠收纳袋、贴纸"],
    '["口令\\"好运来\\"立减8元","店铺券21元"]': ['口令"好运来"立减8元', "店铺券21元"],
    "会员9折|'口令\"开学季\"立减4元'": ["会员9折", '口令"开学季"立减4元'],
    "大促7/22返场": ["大促7/22返场"],
    "包邮;": ["包邮"],
    "包邮;包邮": ["包邮", "包邮"],
    "a<br>b\nc\td": ["a", "b", "c", "d"],
    " ;, ": [],
    "": [],
}


def test_cases():
    for text, want in CASES.items():
        assert split(text, LATTICE, {}) == want, text


def test_column(spark):
    rows = [(i, t) for i, t in enumerate([*CASES, None, "x" * 100_000, ";".join(["v"] * 3000)])]
    df = spark.createDataFrame(rows, "k long, v string").selectExpr("k", "v", "k as pos", "v as n_values")
    out = split_values(df.select("k", "v"), "k", "v").orderBy("k", "pos").collect()
    by: dict[int, list[str]] = {}
    for r in out:
        by.setdefault(r.k, []).append(r.value)
        assert r.pos == len(by[r.k])
    assert [by.get(i, []) for i in range(len(CASES))] == list(CASES.values())
    assert len(by[len(CASES) + 1]) == 1 and len(by[len(CASES) + 2]) == 3000 and len(CASES) not in by


def test_empty_table(spark):
    assert split_values(spark.createDataFrame([], "k long, v string"), "k", "v").collect() == []


def test_nothing_but_separators(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([";", " ", "", ",,", None] * 3)], "k long, v string")
    assert split_values(df, "k", "v").collect() == []


def test_learned_value_with_a_sign(spark):
    """A value that holds a separating sign and whose parts never stand alone stays whole once it is learned."""
    rows = [(i, "黑/白") for i in range(40)] + [(100 + i, f"v{i % 7};w{i % 5}") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, v string")
    whole = {r.value for r in split_values(df, "k", "v", inside=0.2).where("k < 100").collect()}
    assert whole == {"黑/白"}


def test_many_plain_values_agree_with_rule(spark, data):
    out = split_values(spark.read.parquet(f"{data}/taobao.parquet"), "row_id", "优惠信息")
    got: dict[int, list[str]] = {}
    for r in out.orderBy("row_id", "pos").collect():
        got.setdefault(r.row_id, []).append(r.value)
    for r in spark.read.parquet(f"{data}/taobao.parquet").select("row_id", "优惠信息").collect():
        text = r["优惠信息"]
        if text and not re.search("[\"'“‘「\\[<]", text):
            plain = [p.strip() for p in re.split(r"(?<!\d)[;；,，|、/+\n\t]|[;；,，|、/+\n\t](?!\d)", text) if p.strip()]
            assert got.get(r.row_id, []) == plain, text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc12", min_size=1, max_size=5).map(str.strip).filter(bool), min_size=1, max_size=8), st.sampled_from([";", "，", " | ", "<br>"]))
def test_round_trip(values, sign):
    if sign.strip() in (";", "，", "|"):
        values = [f"x{v}y" for v in values]  # a sign between two digits does not separate
    assert split(sign.join(values), LATTICE, {}) == values
    assert shape_of(sign.join(values))


def test_known_values_of_any_length():
    """A value the column is known to hold stays whole, however many signs it has; unknown ones come apart."""
    value = "满300,减40,限时,一次,每人,全店"
    lattice = Lattice({shape_of(value).replace(_CUT, ""): -0.7}, 1e-4, 1e-4)
    assert lattice.longest == 6 and lattice.reach == 4
    assert split(f"{value};包邮", lattice, {}) == [value, "包邮"]
    assert split(value, LATTICE, {}) == value.split(",")


def test_learning_decides_with_the_defaults(spark):
    """Signs that stand between values met in every company separate, a sign whose sides are never met apart does not."""
    offers = [f"{a}{b}" for a in "满减券礼" for b in "甲乙丙丁戊"]
    rows = [f"{offers[i % 20]};{offers[(7 * i + i // 20) % 20]}/{offers[(3 * i + i // 7) % 20]}" for i in range(2000)]
    rows += [f"{offers[i % 20]};黑,白" for i in range(60)] + ["新人礼;首单减"] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "k long, v string")
    got: dict[int, list[str]] = {}
    for r in split_values(df, "k", "v").orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r.value)
    assert list(got.values()) == [re.split("[;/]", t) for t in rows]
