"""Queries of the general data problems: time texts (1), packed fields (4) and snapshots (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import packed, snapshots, timestamps
from loomstone.session import ntz_micros, spread, table


def _time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    shop = table(spark, sf_dir, "taobao").select(F.lit("taobao").alias("tbl"), F.col("row_id").alias("row_key"), F.col("爬取时间").alias("text"), "crawl_host", ntz_micros(F.col("received_at")).alias("received_us"))
    runs = table(spark, sf_dir, "crawler_cli").select(F.lit("crawler_cli"), "record_id", "crawl_time", "crawl_host", none.cast("bigint"))
    events = table(spark, sf_dir, "repair_events").select(F.lit("repair_events"), "id", "created_at", none.cast("string"), none.cast("bigint"))
    return spread(shop.union(runs).union(events))


def p1_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone of each host as its own readings show it, beside the declared one."""
    return timestamps.zone_report(_time_texts(spark, sf_dir), "text", "crawl_host", table(spark, sf_dir, "crawl_hosts"), "tbl", "row_key", "received_us")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time texts that denote one instant and are not yet in canonical form, with that instant."""
    rows = timestamps.normalise(_time_texts(spark, sf_dir), "text", "crawl_host", table(spark, sf_dir, "crawl_hosts"), "tbl", "row_key", "received_us")
    return rows.where(F.col("utc_us").isNotNull() & ~F.col("text").rlike(timestamps.CANONICAL)).select("tbl", "row_key", "utc_us")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single promotions of fields that hold two or more."""
    return packed.split_values(spread(table(spark, sf_dir, "taobao").select("row_id", "优惠信息")), "row_id", "优惠信息", "offer_text").where("n_values >= 2").select("row_id", "pos", "offer_text")


def p6_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed from each snapshot to the next, with the names of the changed fields."""
    fields = ["页面价", "库存"]
    return snapshots.changes(table(spark, sf_dir, "taobao_snapshots"), "snapshot_no", ["itemid", "skuid"], fields, ["delivered_at", "snap_row_id"], dict.fromkeys(fields, snapshots.number))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions, removals and changes between consecutive snapshots."""
    return p6_changes(spark, sf_dir).select("snapshot_no", "itemid", "skuid", "change_kind")


QUERIES = {"p1_found": p1_found, "p1_zones": p1_zones, "p4_found": p4_found, "p6_found": p6_found, "p6_changes": p6_changes}

_NUMBER = """CASE WHEN b IN ('售罄','已售完','已售罄','售完','无货','缺货','soldout','outofstock') THEN 0
  ELSE TRY_CAST(replace(regexp_extract(b, '^[^0-9.-]*(-?[0-9][0-9,]*(\\.[0-9]+)?|-?\\.[0-9]+)[^0-9]*$', 1), ',', '') AS DECIMAL(30,6))
    * CASE WHEN contains(b, '万') THEN 10000 WHEN contains(b, '亿') THEN 100000000 ELSE 1 END END"""

_OFFERS = f"""WITH t AS (
  SELECT snapshot_no, itemid, skuid, lower(regexp_replace("页面价", '\\s+', '', 'g')) AS pb, lower(regexp_replace("库存", '\\s+', '', 'g')) AS sb,
         row_number() OVER (PARTITION BY snapshot_no, itemid, skuid ORDER BY delivered_at DESC, snap_row_id DESC) AS rn
  FROM taobao_snapshots),
n AS (SELECT snapshot_no, itemid, skuid, {_NUMBER.replace("b IN", "pb IN").replace("(b,", "(pb,")} AS price, {_NUMBER.replace("b IN", "sb IN").replace("(b,", "(sb,")} AS stock FROM t WHERE rn = 1),
steps AS (SELECT snapshot_no AS later, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS earlier FROM (SELECT DISTINCT snapshot_no FROM n)),
a AS (SELECT later, itemid, skuid, price, stock FROM n JOIN steps ON snapshot_no = later WHERE earlier IS NOT NULL),
o AS (SELECT later, itemid, skuid, price, stock FROM n JOIN steps ON snapshot_no = earlier),
d AS (SELECT coalesce(a.later, o.later) AS snapshot_no, coalesce(a.itemid, o.itemid) AS itemid, coalesce(a.skuid, o.skuid) AS skuid,
        CASE WHEN o.itemid IS NULL THEN 'added' WHEN a.itemid IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
        a.price IS DISTINCT FROM o.price AS dp, a.stock IS DISTINCT FROM o.stock AS ds
      FROM a FULL JOIN o ON a.later = o.later AND a.itemid = o.itemid AND a.skuid = o.skuid)"""

ORACLES: dict[str, str] = {
    "p6_found": _OFFERS + " SELECT snapshot_no, itemid, skuid, change_kind FROM d WHERE change_kind <> 'changed' OR dp OR ds",
    "p6_changes": _OFFERS
    + """ SELECT snapshot_no, itemid, skuid, change_kind, CASE WHEN change_kind <> 'changed' THEN '' ELSE concat_ws(',', CASE WHEN ds THEN '库存' END, CASE WHEN dp THEN '页面价' END) END AS changed_fields
          FROM d WHERE change_kind <> 'changed' OR dp OR ds""",
}
