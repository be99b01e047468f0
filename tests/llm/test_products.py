from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomstone.llm import products as P

SCHEMA = "row_id long, title string, sku string, seller string, received long"
ARGS = ("row_id", "title", "sku", "seller", "received")
# Real listings: brand in two scripts, model, kinds of goods, sizes and colours as shops write them.
REAL = [
    ("苹果", "Apple", "iPhone", ("15", "15 Pro", "15 Pro Max", "14", "14 Plus"), ("手机", "智能手机"), ("128GB", "256GB"), ("黑色", "白色")),
    ("华为", "Huawei", "Mate", ("60", "60 Pro", "50", "50 Pro"), ("手机", "智能手机"), ("256GB", "512GB"), ("黑色", "白色")),
    ("小米", "Xiaomi", "Redmi", ("K70", "K70 Pro", "Note 13", "K60"), ("手机", "智能手机"), ("256GB",), ("黑色", "蓝色")),
    ("索尼", "Sony", "", ("WH-1000XM5", "WH-1000XM4", "WF-1000XM5", "WH-CH720N"), ("头戴式耳机", "降噪耳机"), ("",), ("黑色", "银色")),
    ("博士", "Bose", "QuietComfort", ("QC45", "QC35", "NC700"), ("头戴式耳机", "降噪耳机"), ("",), ("黑色", "白色")),
    ("耐克", "Nike", "AIR", ("FORCE 1", "MAX 90", "JORDAN 4"), ("运动鞋", "板鞋"), ("42码", "43码"), ("白色", "黑色")),
    ("新百伦", "NewBalance", "NB", ("574", "990", "2002R"), ("运动鞋", "跑步鞋"), ("42码", "41码"), ("灰色", "藏青")),
    ("飞利浦", "Philips", "", ("HD-1522", "HP8230", "BHD350"), ("吹风机", "电吹风"), ("1200W", "2.1kW"), ("黑色", "粉色")),
]
TALK = "包邮 正品 现货 官方旗舰 热卖 新款 特惠 次日达 假一赔十 全国联保 学生价 送礼".split()
ALIKE = {"128GB": ["128GB", "128G", "131072MB"], "256GB": ["256GB", "256 G"], "1200W": ["1200W", "1.2千瓦"], "黑色": ["黑色", "黑", "Black"], "白色": ["白", "White", "纯白"], "2.1kW": ["2.1kW", "2100瓦"]}


def catalogue(seed: int, copies: int = 6) -> list[tuple]:
    """Rows as a test table and the true product of each."""
    rng, rows = random.Random(seed), []
    for han, latin, line, models, goods, sizes, colours in REAL:
        for model in models:
            for size in sizes:
                for colour in colours:
                    for _ in range(copies):
                        name = rng.choice([han, latin, f"{han}/{latin}", f"{latin}({han})"])
                        spelled = rng.choice([model, model.lower(), model.replace("-", " ") if "-" in model else model])
                        words = [name, f"{line} {spelled}".strip(), rng.choice(goods), *rng.sample(TALK, rng.randint(0, 3))]
                        if rng.random() < 0.3:
                            words.insert(0, f"【{rng.choice(TALK)}】")
                        say = lambda v: rng.choice(ALIKE.get(v, [v]))
                        sku = rng.choice([" ", " + ", ";"]).join(filter(None, [say(colour), say(size) if size else ""]))
                        rows.append((len(rows), " ".join(words), sku, f"s{rng.randint(0, 40)}", len(rows), (latin, line, model, size, colour)))
    return rows


def test_real_listings(spark):
    rows = catalogue(3)
    df = spark.createDataFrame([r[:5] for r in rows], SCHEMA)
    got = {tuple(r) for r in P.pairs(P.classes(df, *ARGS)).collect()}
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if a[5] == b[5] and a[3] != b[3]}
    # Only these wordings, which the reader cannot know to be one, may cost recall.
    recall, precision = len(got & want) / len(want), len(got & want) / len(got)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)


ONE = [
    ("Sony WH-1000XM5 头戴式耳机 黑色", None),
    ("索尼/SONY wh 1000xm5 降噪耳机", "颜色:Black"),
    ("【现货】 索尼 WH1000XM5 耳机 包邮", "纯黑 1个装"),
]
OTHER = [
    ("Sony WH-1000XM4 头戴式耳机 黑色", None),  # another model
    ("Sony WH-1000XM5 头戴式耳机", "深灰"),  # a shade
    ("Sony WH-1000XM5 头戴式耳机 黑色 2只装", None),  # two
    ("适用 Sony WH-1000XM5 头戴式耳机 黑色 支架", None),  # an accessory
    ("Sony WH-1000XM5 {{title}} 黑色", None),  # residue
    ("", ""), (None, None), (" ", "黑"),
]


def test_same_and_other(spark):
    rows = [r[:4] for r in catalogue(5)]
    first = len(rows)
    rows += [(first + i, t, s, f"x{i}") for i, (t, s) in enumerate([*ONE, *OTHER])]
    again = (len(rows), ONE[0][0], ONE[0][1], "x0")  # redelivered: equal in all but number and arrival
    df = spark.createDataFrame([(*r, r[0]) for r in [*rows, again]], SCHEMA)
    df = df.union(spark.createDataFrame([(10_000, ONE[0][0], None, None, 1)], SCHEMA))  # no seller
    got = {tuple(r) for r in P.pairs(P.classes(df, *ARGS)).collect()}
    new = {p for p in got if p[0] >= first}
    assert new == set(combinations(range(first, first + 3), 2))


def test_links_and_clashing_columns(spark):
    df = spark.createDataFrame([r[:5] for r in catalogue(4, 3)], SCHEMA)
    pairs = P.pairs(P.classes(df, *ARGS)).collect()
    df = df.withColumns({"tokens": F.lit("x"), "class_id": F.lit(1), "code": F.lit(None).cast("string"), "set_id": F.lit(2)})
    got = {r["_key"]: r.n_links for r in P.links(P.classes(df, *ARGS)).collect()}
    counted = dict.fromkeys(got, 0)
    for p in pairs:
        counted[p.row_a] += 1
        counted[p.row_b] += 1
    assert got == counted and max(got.values()) > 0


def test_hot_class_is_whole(spark):
    rows = [r[:5] for r in catalogue(4, 3)]
    hot = [(1000 + i, "索尼/Sony WH-CH720N 降噪耳机", "蓝", f"h{i}", i) for i in range(60)]
    members = P.classes(spark.createDataFrame(rows + hot, SCHEMA), *ARGS)
    got = {tuple(r) for r in P.pairs(members, hot=7).where("row_a >= 1000").collect()}
    assert got == set(combinations(range(1000, 1060), 2))


def test_titles_that_single_out_nothing(spark):
    rows = [(i, "补差价专用链接 邮费差价 多退少补", "补差 5 元", f"s{i}", i) for i in range(20)]
    assert P.pairs(P.classes(spark.createDataFrame(rows, SCHEMA), *ARGS)).collect() == []
    assert P.pairs(P.classes(spark.createDataFrame([], SCHEMA), *ARGS)).collect() == []


def test_very_long_title(spark):
    rows = [r[:5] for r in catalogue(4, 3)] + [(5000 + i, "索尼/Sony " + "热卖 " * 20_000 + "WH-CH720N", "蓝", f"h{i}", i) for i in range(2)]
    got = {tuple(r) for r in P.pairs(P.classes(spark.createDataFrame(rows, SCHEMA), *ARGS)).collect()}
    assert (5000, 5001) in got


def test_advertising_is_worth_nothing(spark):
    df = spark.createDataFrame([r[:5] for r in catalogue(3, 12)], SCHEMA)
    read = P.offers(df, *ARGS).cache()
    by_number = {r.token: r for r in P.weights(P.lists(read), P.spellings(read)).collect()}
    w = lambda word: by_number[P.number(word)]
    assert max(w(t).w for t in TALK) < min(w(t).w for t in ("sony", "philips", "bose", "wh1000xm5", "iphone15pro")) / 3
    assert w("索尼").plain == P.number("sony") and w("索尼").w == w("sony").w and w("索尼").is_name
    lists = P.lists(read).collect()
    han = {r.han: r["_latin"] for r in P.spellings(read).collect()}
    for token in map(P.number, ("sony", "降噪耳机", "包邮", "iphone15")):
        assert by_number[token].df == sum(token in {han.get(t, t) for t in r.tokens} for r in lists)


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_containment_like_brute_force(spark, data, threshold):
    df = spark.read.parquet(f"{data}/taobao.parquet")
    read = P.offers(df, "row_id", "商品标题", "sku名称", "卖家昵称", "received_at").cache()
    members = P.token_sets(P.lists(read), P.weights(P.lists(read), P.spellings(read)))
    sets = P.placed(members.groupBy("set_id").agg(F.first("_set").alias("_set"), F.count("*").alias("n"))).cache()
    held = {r.set_id: (r["_w"], {t.token: t.w for t in r["_set"]}, {t.token for t in r["_set"] if t.is_name}) for r in sets.collect()}
    want, shared = set(), 0
    for a, (wa, ta, na) in held.items():
        for b, (wb, tb, _) in held.items():
            if (wb, b) > (wa, a) and ta.keys() & tb.keys():
                shared += 1
                if sum(w for t, w in ta.items() if t in tb) >= threshold * wa and na <= tb.keys():
                    want.add((a, b))
    got = [(r.a_id, r.b_id) for r in P.contained(sets, threshold).collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < shared


def test_stars(spark):
    sets = spark.createDataFrame([(i, 1) for i in range(1, 8)], "set_id long, n long")
    # 2 and 3 lie in 1; 5 lies in 1 and 4 alike; 7 and 5 lie in one another's star of the undecided.
    links = [(2, 1, 1, 9, 1.0), (3, 1, 1, 9, 0.8), (3, 2, 1, 1, 0.9), (5, 1, 1, 9, 0.8), (5, 4, 1, 9, 0.8), (7, 5, 1, 1, 1.0), (7, 1, 1, 9, 0.8), (7, 4, 1, 9, 0.8)]
    df = spark.createDataFrame(links, "a_id long, b_id long, a_n long, b_n long, held double")
    got = {r.set_id: r["product"] for r in P.stars(sets, df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 5}
