"""Differences between consecutive full snapshots of a table.

Every row is unpivoted into signed cells: ``+1`` for the step that leads to its snapshot and ``-1`` for the step that
leads away from it, one cell per field and one that marks the presence of the key. Cells that are equal on both sides
cancel in a grouped sum; what remains classifies the key and names the fields that changed.

One shuffle carries the narrow rows, hash partitioned by the key. All later groupings contain that key, so neither
the choice of the valid row nor the sums shuffle again, and no key is ever gathered beyond its own few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Writings of "sold out", which stand for the number 0.
SOLD_OUT = ("售罄", "已售完", "已售罄", "售完", "无货", "缺货", "soldout", "outofstock")
_WIDE, _PLAIN = "０１２３４５６７８９．，￥－", "0123456789.,¥-"


def number(text: Column) -> Column:
    """The number a price or stock text denotes, as ``decimal(30,6)``; null for null, blanks, marks and other text.

    Currency signs, units, blanks and digit grouping do not count, ``万`` multiplies by 10,000, ``亿`` by
    100,000,000, and the writings of "sold out" are 0.
    """
    bare = F.lower(F.regexp_replace(F.translate(text, _WIDE, _PLAIN), r"[\s 　​﻿]+", ""))
    digits = F.regexp_extract(bare, r"^(?:[^0-9.\-]*)(-?[0-9][0-9,]*(?:\.[0-9]+)?|-?\.[0-9]+)(?:[^0-9]*)$", 1)
    plain = F.regexp_replace(digits, ",", "").try_cast("decimal(30,6)")
    scaled = F.when(bare.contains("万"), plain * 10_000).when(bare.contains("亿"), plain * 100_000_000).otherwise(plain)
    return F.when(bare.isin(*SOLD_OUT), F.lit(0)).otherwise(scaled).cast("decimal(30,6)")


def latest(df: DataFrame, snapshot: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per snapshot and key the row with the greatest ``order``."""
    w = Window.partitionBy(*key, snapshot).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def changes(df: DataFrame, snapshot: str, key: Sequence[str], fields: Sequence[str], order: Sequence[str], normalise: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``snapshot``, ``key``, ``change_kind`` (added, removed, changed) and ``changed_fields`` per step and key.

    ``snapshot`` is the later one; the step leads from the snapshot delivered before it, so gaps in the numbers do not
    matter. Within a snapshot the row with the greatest ``order`` holds; rows equal in ``order`` too are
    indistinguishable and any of them is taken. Null equals null and differs from any value, in fields and in keys.
    Rows without a snapshot number are left out. ``changed_fields`` is a sorted list joined by commas, empty for
    additions and removals. ``normalise`` maps fields to what makes their values comparable. An empty table gives no rows, and so does a single snapshot. Other columns of the input
    are not read.
    """
    rows = df.where(F.col(snapshot).isNotNull())
    numbers = sorted(r[0] for r in rows.select(snapshot).distinct().collect())  # one number per delivery
    following = {a: b for a, b in zip(numbers, numbers[1:])}
    kind = dict(df.dtypes)[snapshot]
    if not following:
        return df.sparkSession.createDataFrame([], df.select(snapshot, *key).schema).withColumns({"change_kind": F.lit(""), "changed_fields": F.lit("")}).limit(0)
    after = F.create_map(*[F.lit(x).cast(kind) for pair in following.items() for x in pair])
    parted = rows.select(snapshot, *key, *fields, *order).repartition(*key)
    for field, make in (normalise or {}).items():
        parted = parted.withColumn(field, make(F.col(f"`{field}`")))
    held = latest(parted, snapshot, key, order)
    text = [F.col(f).cast("string") for f in fields]
    presence = F.struct(F.lit(0).alias("_field"), F.lit(None).cast("string").alias("_value"))
    cells = F.array(presence, *[F.struct(F.lit(i).alias("_field"), c.alias("_value")) for i, c in enumerate(text, 1)])
    steps = F.array(
        F.struct(F.col(snapshot).alias("_step"), F.lit(1).alias("_sign")),
        F.struct(after[F.col(snapshot)].alias("_step"), F.lit(-1).alias("_sign")),
    )
    signed = (
        held.select(snapshot, *key, F.inline(steps), cells.alias("_cells"))
        .where(F.col("_step").isNotNull() & ((F.col("_sign") == -1) | (F.col("_step") != numbers[0])))
        .select(*key, "_step", "_sign", F.inline("_cells"))
    )
    left = signed.groupBy(*key, "_step", "_field", "_value").agg(F.sum("_sign").alias("_sum")).where("_sum <> 0")
    field_names = F.array(*[F.lit(f) for f in fields])
    per_key = left.groupBy(*key, "_step").agg(
        F.max(F.when(F.col("_field") == 0, F.col("_sum"))).alias("_presence"),
        *[F.max(F.when(F.col("_field") == i, True)).alias(f"_f{i}") for i in range(1, len(fields) + 1)],
    )
    touched = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_f{i}"), field_names[i - 1]) for i in range(1, len(fields) + 1)])))
    return per_key.select(
        F.col("_step").alias(snapshot),
        *key,
        F.when(F.col("_presence") > 0, "added").when(F.col("_presence") < 0, "removed").otherwise("changed").alias("change_kind"),
        F.when(F.col("_presence").isNull(), F.array_join(touched, ",")).otherwise("").alias("changed_fields"),
    )
