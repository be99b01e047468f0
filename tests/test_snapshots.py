from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from loomstone.operators import snapshots as S


def test_number(spark):
    cases = {"80.10元": "80.10", "¥ 1,299.00": "1299", "CNY 5": "5", " 7 ": "7", "库存12": "12", "12 件": "12", "1.01万": "10100", "售罄": "0", "已售完": "0", "--": None, "": None, None: None, "暂无": None, "１２": "12", "3.0": "3"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.n for r in df.select("t", S.number(F.col("t")).alias("n")).collect()}
    assert got == {k: None if v is None else Decimal(v) for k, v in cases.items()}


def brute(rows):
    held: dict[int, dict] = {}
    for no, a, b, p, q, at, i in sorted(rows, key=lambda r: (r[5], r[6])):
        held.setdefault(no, {})[(a, b)] = (p, q)
    order, out = sorted(held), set()
    for x, y in zip(order, order[1:]):
        for k in held[x].keys() | held[y].keys():
            if k not in held[x]:
                out.add((y, *k, "added", ""))
            elif k not in held[y]:
                out.add((y, *k, "removed", ""))
            elif held[x][k] != held[y][k]:
                fields = [n for n, u, v in zip("pq", held[x][k], held[y][k]) if u != v]
                out.add((y, *k, "changed", ",".join(fields)))
    return out


def test_like_brute_force(spark):
    rng, start, rows = random.Random(3), datetime(2025, 1, 1), []
    for no in (1, 2, 4, 9):
        for i in range(300):
            a, b = ("hot" if i % 3 == 0 else str(rng.randrange(20))), rng.choice(["0", "1", None])
            rows.append((no, a, b, rng.choice([None, "1", "2"]), rng.choice([None, "5"]), start + timedelta(days=no, seconds=rng.randrange(3)), len(rows)))
    schema = "no int, a string, b string, p string, q string, at timestamp_ntz, id long"
    df = spark.createDataFrame(rows, schema).withColumn("change_kind", F.lit("x"))
    out = S.changes(df, "no", ["a", "b"], ["p", "q"], ["at", "id"]).collect()
    assert {tuple(r) for r in out} == brute(rows) and len(out) == len(brute(rows))


def test_small_inputs(spark):
    schema = "no int, a string, p string, at long"
    for rows in ([], [(1, "x", "1", 1)], [(None, "x", "1", 1)]):
        out = S.changes(spark.createDataFrame(rows, schema), "no", ["a"], ["p"], ["at"])
        assert out.columns == ["no", "a", "change_kind", "changed_fields"] and out.collect() == []
