"""Open records: one table from several kinds of sources, duplicates folded, tables and manifests for people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import first_number, markdown_cell
from loomstone.session import cut_lineage


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """Sources one below the other by column name, with ``_rank`` for their fixed order; missing columns are null."""
    ranked = [p.withColumn("_rank", F.lit(i)) for i, p in enumerate(parts)]
    out = ranked[0]
    for p in ranked[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 of a record's fields by sorted name, nulls included; names that begin with ``_`` do not count."""
    kept = sorted(c for c in columns if not c.startswith("_"))
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept]), {"ignoreNullFields": "false"}), 256)


def deduplicate(df: DataFrame, order: Sequence[str], source: str = "_source") -> DataFrame:
    """The first of equal records with ``_sources``, the distinct non-empty sources in order of first arrival.

    Equal is decided on all columns that do not begin with ``_``. Rows are reduced to one per record and source in
    the first, partially aggregated step, so a record that stands for a third of all rows stays small.
    """
    payload = [c for c in df.columns if not c.startswith("_")]
    marked = df.withColumn("_fingerprint", fingerprint(df.columns)).withColumn("_order", F.struct(*order))
    per_source = marked.groupBy("_fingerprint", source).agg(F.min("_order").alias("_first"), F.min_by(F.struct(*payload), "_order").alias("_record"), F.count("*").alias("_n"))
    named = F.when(F.coalesce(F.col(source), F.lit("")) != "", F.struct("_first", F.col(source).alias("name")))
    folded = per_source.groupBy("_fingerprint").agg(
        F.min_by("_record", "_first").alias("_record"), F.min("_first").alias("_first"), F.transform(F.array_sort(F.collect_list(named)), lambda x: x["name"]).alias("_sources"), F.sum("_n").alias("_copies")
    )
    return folded.select("_record.*", "_fingerprint", "_sources", "_copies", "_first")


def numbered(df: DataFrame, order: Sequence, name: str = "position") -> DataFrame:
    """``df`` with ``name``, the place of each row in the whole ``order`` from 1.

    Numbered in blocks: the place within its partition of the order, shifted by the sizes of those before it, so no
    task ever holds more than its part.
    """
    from pyspark.sql import Window

    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_block": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("_block").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(starts), "_block").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_row") + 1).alias(name))


def stable_distinct(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Non-empty stripped values once each with ``_o``, where they first came, and ``position``, their order (from 1)."""
    text = F.trim(F.col(value))
    first = df.select(text.alias(value), F.struct(*order).alias("_o")).where(F.col(value) != "").groupBy(value).agg(F.min("_o").alias("_o"))
    return numbered(first, ["_o", value])


def first_seen_columns(df: DataFrame, key: str, fields: str) -> DataFrame:
    """Names of a map column in the order they are first met: ``name``, ``row``, ``pos``."""
    seen = df.select(F.col(key).alias("row"), F.posexplode(F.map_keys(fields)).alias("pos", "name"))
    return seen.groupBy("name").agg(F.min(F.struct("row", "pos")).alias("_at")).select("name", "_at.row", "_at.pos")


def clean_numbers(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A ``<field>_num`` beside each field: its first number, null where there is none."""
    return df.withColumns({f"{f}_num": first_number(F.col(f"`{f}`")) for f in fields})


def markdown_rows(df: DataFrame, order: Sequence[str], max_rows: int = 50, max_columns: int = 12) -> DataFrame:
    """``line`` per row of a Markdown table, at most ``max_rows`` (held between 1 and 200), with ``row_no`` from 1."""
    columns = [c for c in df.columns if not c.startswith("_")][:max_columns]
    limit = max(1, min(int(max_rows), 200))
    body = F.concat(F.lit("| "), F.array_join(F.array(*[markdown_cell(F.col(f"`{c}`")) for c in columns]), " | "), F.lit(" |"))
    top = df.orderBy(*order).limit(limit).select(body.alias("line"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(*[f"_o{i}" for i in range(len(order))]))  # at most 200 rows
    return top.select(rank.alias("row_no"), "line")


def source_manifest(df: DataFrame, source: str, url: str, title: str) -> DataFrame:
    """Sources with what they are called: address, else title, else the source itself."""
    return df.groupBy(source).agg(F.count("*").alias("n_records"), F.max(F.coalesce(F.nullif(F.col(url), F.lit("")), F.nullif(F.col(title), F.lit("")), F.col(source))).alias("label"))


def report(df: DataFrame, source: str) -> DataFrame:
    """``line_no`` and ``line`` of a report: the number of records and of sources, then one line per source by size.

    Sources are counted before they are ordered; null sources come as ``unknown``.
    """
    counts = df.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias("_s")).agg(F.count("*").alias("_n"))
    head = counts.agg(F.lit(1).alias("line_no"), F.concat(F.lit("Records: "), F.coalesce(F.sum("_n"), F.lit(0)).cast("string"), F.lit("; sources: "), F.count("*").cast("string")).alias("line"))
    lines = numbered(counts, [F.desc("_n"), "_s"], "_at").select((F.col("_at") + 1).cast("int").alias("line_no"), F.concat(F.lit("- "), "_s", F.lit(": "), F.col("_n").cast("string")).alias("line"))
    return head.unionByName(lines)


def sample(df: DataFrame, order: Sequence[str], rows: int = 10, clip: int = 2000) -> DataFrame:
    """The first ``rows`` records with texts clipped to ``clip`` characters: what a summary is written from."""
    texts = {n: F.substring(F.col(f"`{n}`"), 1, clip) for n, kind in df.dtypes if kind == "string"}
    return df.orderBy(*order).limit(rows).withColumns(texts)


def input_groups(df: DataFrame, path: str) -> DataFrame:
    """Paths with the groups their suffix puts them in: YAML, documents, Markdown, tables and text."""
    suffix = F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]+)$", 1))
    groups = {"yaml": ("yaml", "yml"), "document": ("docx", "pdf", "md", "markdown", "txt"), "markdown": ("md", "markdown"), "table": ("csv", "json"), "text": ("txt", "md", "markdown")}
    return df.withColumns({f"is_{g}": suffix.isin(*s) for g, s in groups.items()})
