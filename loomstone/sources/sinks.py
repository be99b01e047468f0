"""Sinks: JSON, JSON lines, CSV and Markdown, and enrichment before writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators.records import markdown_rows


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls kept, in part files."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header each; nulls are empty cells, quotes are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, by columns where named; Spark's commit protocol makes the write all or nothing."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Further rows of an append-only log."""
    df.write.mode("append").parquet(path)


def enrich(df: DataFrame, name: str, value: str) -> DataFrame:
    """The column ``name`` with a constant, unless the table has it already (nulls in it stay)."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def markdown_table(df: DataFrame, order: Sequence[str], max_rows: int = 50) -> str:
    """A Markdown table of at most 200 rows and 12 columns, for people."""
    columns = [c for c in df.columns if not c.startswith("_")][:12]
    lines = [r.line for r in markdown_rows(df, order, max_rows).orderBy("row_no").collect()]  # at most 200 rows
    return "\n".join(["| " + " | ".join(columns) + " |", "| " + " | ".join(["---"] * len(columns)) + " |", *lines])


def json_array(df: DataFrame, order: Sequence[str], most: int = 100_000) -> str:
    """A small table as one indented JSON array; more than ``most`` rows are refused (write JSON lines instead)."""
    import json

    rows = df.orderBy(*order).limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write JSON lines")
    return json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False)
