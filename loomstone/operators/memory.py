"""Memory of repairs: an append-only log, its statistics and the best repair for a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.text import parse_json

SCHEMA = "at string, page_pattern string, page_url string, field string, old string, new string, ok variant, approved variant"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON-lines logs with ``line_no``, their order by file, then by place in it; blank and malformed lines are
    skipped. The number grows along a file but counts no lines: a file is read in splits, whose rows are numbered each
    from the split's first byte.

    ``ok`` and ``approved`` are true only for the literal ``true``.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    # Rows of a split have ascending ids, and no split holds more lines than bytes.
    first = F.broadcast(lines.groupBy("source", "_block").agg(F.min("_id").alias("_first")))  # one row a split
    lines = lines.join(first, ["source", "_block"]).withColumn("line_no", F.col("_block") + F.col("_id") - F.col("_first"))
    parsed = lines.withColumn("_v", parse_json(F.col("value"))).where("_v is not null and schema_of_variant(_v) like 'OBJECT%'")
    text = lambda name: F.coalesce(F.try_variant_get("_v", f"$.{name}", "string"), F.lit("")).alias(name)
    literal = lambda name: F.coalesce((F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant")) == "BOOLEAN") & F.try_variant_get("_v", f"$.{name}", "boolean"), F.lit(False)).alias(name)
    return parsed.select("source", "line_no", *[text(n) for n in ("at", "page_pattern", "page_url", "field", "old", "new")], literal("ok"), literal("approved"))


def best_repairs(log: DataFrame, pages: DataFrame, field: str = "field", pattern: str = "page_pattern", at: str = "at", line: str = "line_no", new: str = "new") -> DataFrame:
    """The best usable repair for each (field, pattern) of ``pages``: one of the same pattern, else of the field.

    Usable is what is both ``ok`` and ``approved``. The latest wins, of equal times the earliest line. Both stages
    aggregate before they shuffle, so a field with very many repairs stays small. Rows of ``pages`` without any
    usable repair come with a null ``selector``; null fields and patterns never match.
    """
    usable = log.where("ok and approved")
    order = F.struct(F.col(at), -F.col(line))
    same = usable.groupBy(field, pattern).agg(F.max_by(new, order).alias("_same"))
    any_page = usable.groupBy(field).agg(F.max_by(new, order).alias("_any"))
    joined = pages.join(same, [field, pattern], "left").join(any_page, [field], "left")
    score = F.when(F.col("_same").isNotNull(), 3).when(F.col("_any").isNotNull(), 2)
    return joined.select(*pages.columns, F.coalesce("_same", "_any").alias("selector"), score.alias("match_score"))


def stats(log: DataFrame, *by: str) -> DataFrame:
    """``total``, ``success`` and ``rate`` (0 for no rows), over all or by columns."""
    success = F.count_if(F.coalesce(F.col("ok"), F.lit(False)))
    total = F.count("*")
    return log.groupBy(*by).agg(total.alias("total"), success.alias("success"), (success / F.greatest(total, F.lit(1))).alias("rate"))


def cache_key(url: Column, field: Column, selector: Column, context: Column) -> Column:
    """Key of a repair request: address, field, selector and the hash of the context; nulls count as ``''``."""
    parts = [F.coalesce(c, F.lit("")) for c in (url, field, selector)]
    return F.concat_ws("::", *parts, F.substring(F.sha2(F.coalesce(context, F.lit("")), 256), 1, 16))
