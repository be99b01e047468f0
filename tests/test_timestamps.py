from __future__ import annotations

import os
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from loomstone.operators import timestamps as T

US = 1_000_000
HOSTS = [("sha", "Asia/Shanghai", "YMD"), ("ber", "Europe/Berlin", "DMY"), ("nyc", "America/New_York", "MDY")]


def micros(*args, tz="UTC"):
    return int(datetime(*args, tzinfo=ZoneInfo(tz)).timestamp()) * US


def run(spark, rows):
    hosts = spark.createDataFrame(HOSTS, "crawl_host string, tz_name string, date_order string")
    df = spark.createDataFrame([(i, t, h, None) for i, (t, h) in enumerate(rows)], "id long, text string, host string, seen long").withColumn("tbl", F.lit("t"))
    out = T.normalise(df, "text", "host", hosts, "tbl", "id", "seen")
    return [r.utc_us for r in out.orderBy("id").collect()]


CASES = [
    ("2025-02-16 10:00:00", "sha", micros(2025, 2, 16, 2)),
    ("2025-02-16T10:00:00.123456+00:00", "sha", micros(2025, 2, 16, 10) + 123456),
    ("20250216T041910Z", "ber", micros(2025, 2, 16, 4, 19, 10)),
    ("20250216041910", "sha", micros(2025, 2, 15, 20, 19, 10)),
    ("02/16/2025 02:12:46 PM", "nyc", micros(2025, 2, 16, 14, 12, 46, tz="America/New_York")),
    ("16/02/2025 12:12:46 a.m.", "ber", micros(2025, 2, 16, 0, 12, 46, tz="Europe/Berlin")),
    ("16.02.2025, 14:24 Uhr", "ber", micros(2025, 2, 16, 14, 24, tz="Europe/Berlin")),
    ("2025年2月16日 凌晨0:07:10", "sha", micros(2025, 2, 15, 16, 7, 10)),
    ("2025年2月16日晚上7:31:02", "sha", micros(2025, 2, 16, 11, 31, 2)),
    ("2025年2月16日 中午12:20:31", "sha", micros(2025, 2, 16, 4, 20, 31)),
    ("２０２５年２月１６日０８：１３：０５", "sha", micros(2025, 2, 16, 0, 13, 5)),
    ("Sun, 02 Mar 2025 00:06:31 GMT", "sha", micros(2025, 3, 2, 0, 6, 31)),
    ("16-Feb-2025 09:02:50", "sha", micros(2025, 2, 16, 1, 2, 50)),
    ("Feb 16, 2025 3:47:06 PM", "sha", micros(2025, 2, 16, 7, 47, 6)),
    ("2025-02-16 09:23:02 GMT+8", "nyc", micros(2025, 2, 16, 1, 23, 2)),
    ("2025-02-16 09:23:02 UTC+5:30", "nyc", micros(2025, 2, 16, 3, 53, 2)),
    ("2025-03-10 08:48:15 EDT", "nyc", micros(2025, 3, 10, 12, 48, 15)),
    ("2025-02-17T01:32:43.205+08:00[Asia/Shanghai]", "nyc", micros(2025, 2, 16, 17, 32, 43) + 205000),
    ("1739692311.387", "nyc", 1739692311387000),
    ("1739665020768", "nyc", 1739665020768000),
    ("1739770364075050", None, 1739770364075050),
    ("2025-02-16 10:00:00", None, micros(2025, 2, 16, 10)),
    ("  2025-02-16  10:00 ", None, micros(2025, 2, 16, 10)),
]
NONE = [None, "", " ", "-", "昨天", "just now", "31分钟前", "2025年2月", "2025-02-17", "08:42:36", "2025-02-30 10:00:00", "2025-02-16 26:08:28", "13/13/2025 10:00:00", "{{crawl_time}}", "NaT", "x" * 5000]


def test_instants(spark):
    assert run(spark, [(t, h) for t, h, _ in CASES]) == [want for *_, want in CASES]


def test_no_instant(spark):
    assert run(spark, [(t, "sha") for t in NONE]) == [None] * len(NONE)


def test_skipped_and_repeated_hours(spark):
    rows = [("2025-03-30 02:30:00", "ber"), ("2025-10-26 02:30:00", "ber"), ("2025-10-26 02:30:00 CET", "ber"), ("2025-10-26 02:30:00 CEST", "ber"), ("2025-11-02 01:10:00", "nyc")]
    assert run(spark, rows) == [None, None, micros(2025, 10, 26, 1, 30), micros(2025, 10, 26, 0, 30), None]


def test_to_utc_like_zoneinfo(spark):
    zones = ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "Australia/Lord_Howe"]
    rows = []
    for z in zones:
        tz = ZoneInfo(z)
        for h in range(0, 24 * 366, 7):
            naive = datetime(2025, 1, 1) + timedelta(hours=h, minutes=13)
            both = {naive.replace(tzinfo=tz, fold=f).astimezone(timezone.utc) for f in (0, 1)}
            real = [b for b in both if b.astimezone(tz).replace(tzinfo=None) == naive]
            want = int(real[0].timestamp()) * US if len(real) == 1 else None
            rows.append((z, int(naive.replace(tzinfo=timezone.utc).timestamp()) * US, want))
    df = spark.createDataFrame(rows, "zone string, local long, want long")
    assert df.where(~T.to_utc(F.col("local"), F.col("zone")).eqNullSafe(F.col("want"))).count() == 0


@pytest.mark.parametrize("by", ["ingestion", "arrival"])
@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kathmandu", "Australia/Lord_Howe"])
def test_unknown_zone_is_estimated(spark, by, zone):
    """Readings over a change of the offset, every twentieth one delivered a week late; half of all rows tell their instant."""
    tz, rows, want = ZoneInfo(zone), [], {}
    step = timedelta(hours=12) if by == "ingestion" else timedelta(seconds=40)
    for day in (0, 90, 180, 270):
        for i in range(300):
            at = datetime(2025, 1, 10, tzinfo=timezone.utc) + timedelta(days=day) + i * step
            late = timedelta(days=7) if i // 2 % 20 == 0 else timedelta(seconds=7 * (i % 60))
            text = at.astimezone(tz).strftime("%Y-%m-%d %H:%M:%S") if i % 2 else at.strftime("%Y-%m-%dT%H:%M:%SZ")
            key = day * 512 + i
            want[key] = int(at.timestamp()) * US
            rows.append((key, text, "lost", int((at + late).timestamp()) * US if by == "ingestion" else None))
    hosts = spark.createDataFrame([*HOSTS, ("lost", None, None)], "crawl_host string, tz_name string, date_order string")
    df = spark.createDataFrame(rows, "id long, text string, host string, seen long").withColumn("tbl", F.lit("t"))
    found = T.host_zones(df, "text", "host", hosts, "tbl", "id", "seen").collect()
    assert [r["_host"] for r in found] == ["lost"] and zone in found[0].zones and found[0].readings == 600
    out = T.normalise(df, "text", "host", hosts, "tbl", "id", "seen")
    assert {r.id: r.utc_us for r in out.collect()} == want
    report = {r.crawl_host: r for r in T.zone_report(df, "text", "host", hosts, "tbl", "id", "seen").collect()}
    assert report["lost"].declared is None and report["lost"].agrees is None and report["sha"].readings is None


def test_declared_zone_corrects_and_is_reported(spark):
    rows = [(i, (datetime(2025, 2, 1) + timedelta(hours=9 * i)).strftime("%Y-%m-%d %H:%M:%S"), "ber", micros(2025, 2, 1) + 9 * i * 3600 * US + 60 * US) for i in range(200)]
    hosts = spark.createDataFrame(HOSTS, "crawl_host string, tz_name string, date_order string")
    df = spark.createDataFrame(rows, "id long, text string, host string, seen long").withColumn("tbl", F.lit("t"))
    report = {r.crawl_host: r for r in T.zone_report(df, "text", "host", hosts, "tbl", "id", "seen").collect()}
    assert report["ber"].agrees is False and report["ber"].declared == "Europe/Berlin" and report["ber"].violations == 0
    assert T.normalise(df, "text", "host", hosts, "tbl", "id", "seen").where("id = 0").first().utc_us == micros(2025, 1, 31, 23)


def test_all_zones_blanked(spark, data):
    """At least 99 % of the rows; the smallest tables have too few readings a host to tell its zone."""
    from loomstone.plans import data_queries

    data = os.path.join(os.path.dirname(data), "sf0.01")
    if not os.path.isdir(data):
        pytest.skip("no larger test tables here")
    hosts = spark.read.parquet(f"{data}/crawl_hosts.parquet")
    texts = data_queries._time_texts(spark, data).where("crawl_host is not null").cache()
    both = [T.normalise(texts, "text", "crawl_host", h, "tbl", "row_key", "received_us").select("tbl", "row_key", "utc_us") for h in (hosts, hosts.withColumn("tz_name", F.lit(None).cast("string")))]
    same = both[0].join(both[1].withColumnRenamed("utc_us", "other"), ["tbl", "row_key"]).where("utc_us <=> other").count()
    assert same >= 0.99 * texts.count()


def test_long_texts(spark):
    rows = [(" " * 3000 + "2025-02-16 10:00:00" + "\u200b" * 3000, "sha"), ("2025-02-16 10:00:00 " + "x" * 100_000, "sha"), ("1" * 100_000, "sha"), ("Sunday, " * 20_000, "sha")]
    assert run(spark, rows) == [micros(2025, 2, 16, 2), None, None, None]


def test_clashing_columns(spark):
    hosts = spark.createDataFrame(HOSTS, "crawl_host string, tz_name string, date_order string")
    df = spark.createDataFrame([(1, "2025-02-16 10:00:00", "sha")], "id long, text string, host string").withColumns({n: F.lit("x") for n in ("abbr", "zone", "local_us", "count_us", "_host", "_t", "crawl_host", "tbl", "utc_us", "_row")})
    df = df.withColumn("seen", F.lit(None).cast("long"))
    out = T.normalise(df, "text", "host", hosts, "tbl", "id", "seen").first()
    assert (out.utc_us, out.zone, out.abbr, out.local_us, out["_host"], out["_row"]) == (micros(2025, 2, 16, 2), "Asia/Shanghai", "x", "x", "x", "x")


def test_empty_and_other_columns(spark):
    hosts = spark.createDataFrame(HOSTS, "crawl_host string, tz_name string, date_order string")
    df = spark.createDataFrame([], "id long, text string, host string, seen long, tbl string, crawl_host string, tz_name string")
    assert T.normalise(df, "text", "host", hosts, "tbl", "id", "seen").collect() == []
