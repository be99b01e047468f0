"""Sources: CSV, JSON, text, address lists, page snapshots, Word documents and configuration files."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.text import page_title, parse_json, public_url, strip_html
from loomstone.operators import jsonpath

#: Largest text file and document read, in bytes.
TEXT_BYTES, DOCUMENT_BYTES = 5 * 1024 * 1024, 30 * 1024 * 1024


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row; every value is text, a byte order mark is dropped, quoted line ends stay in their cell."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def read_text(spark: SparkSession, path: str, limit: int = TEXT_BYTES) -> DataFrame:
    """``path`` and whole ``text`` per file of at most ``limit`` bytes, without a byte order mark."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= limit)
    return files.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("text"))


def read_json(spark: SparkSession, path: str, limit: int = TEXT_BYTES) -> DataFrame:
    """``path``, ``pos`` and ``record`` (VARIANT): the elements of a list, or the whole as one record."""
    return jsonpath.records(read_text(spark, path, limit), "path", "text")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One VARIANT ``record`` per line that is JSON; other lines are left out."""
    return spark.read.text(path).select(parse_json(F.col("value")).alias("record")).where("record is not null")


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``format``, ``size_bytes`` and ``readable`` of documents, from file metadata only."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("format"), F.col("length").alias("size_bytes"), (F.col("length") <= DOCUMENT_BYTES).alias("readable"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes) -> list[tuple[str, str]]:
    """Paragraphs and tables of a Word document in order, as Markdown; the number of images comes as a last block."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        images = sum(n.startswith("word/media/") for n in archive.namelist())
        body = ET.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    blocks: list[tuple[str, str]] = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            if text := words(node):
                level = int(name[-1]) if name.lower().startswith("heading") and name[-1:].isdigit() else 0
                blocks.append(("paragraph", ("#" * level + " " if level else "- " if "list" in name.lower() else "") + text))
        elif node.tag == f"{_W}tbl":
            rows = [[words(c).replace("|", "\\|") for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            blocks.append(("table", table_markdown(rows)))
    return [*blocks, ("images", str(images))]


def table_markdown(rows: list[list[str]]) -> str:
    """Rows as a Markdown table; short rows are filled up, the first is the header; no rows give ``''``."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    full = [r + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(full[0]), line(["---"] * width), *map(line, full[1:])])


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``pos``, ``kind`` (paragraph, table, images, error) and ``text`` of Word documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    blocks = docx_blocks(bytes(content))
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as error:
                    blocks = [("error", type(error).__name__)]
                rows += [(name, i, k, t) for i, (k, t) in enumerate(blocks)]
            yield pd.DataFrame(rows, columns=["path", "pos", "kind", "text"])

    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= DOCUMENT_BYTES)
    return files.select("path", "content").mapInPandas(run, "path string, pos int, kind string, text string")


URL = r"https?://[^\s<>\"'\\)\]}|]+"


def urls(df: DataFrame, key: str, text: str, limit: int | None = None) -> DataFrame:
    """Public addresses in texts, each once: ``url`` with ``first_key`` and ``first_pos`` of its first appearance.

    Signs ``.,;:!?`` at the end do not belong to an address. With a ``limit`` (held between 1 and 200) the first ones.
    """
    found = df.select(F.col(key).alias("_k"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"({URL})"), 1)).alias("_p", "_u"))
    clean = found.select("_k", "_p", F.regexp_replace("_u", r"[.,;:!?]+$", "").alias("url")).where(public_url(F.col("url")))
    once = clean.groupBy("url").agg(F.min(F.struct("_k", "_p")).alias("_at")).select("url", F.col("_at._k").alias("first_key"), F.col("_at._p").alias("first_pos"))
    return once if limit is None else once.orderBy("first_key", "first_pos").limit(max(1, min(int(limit), 200)))


def pages(df: DataFrame, url: str, html: str, status: str | None = None) -> DataFrame:
    """Page snapshots as documents: address, title and visible text."""
    extra = [F.col(status).alias("status")] if status else []
    return df.select(F.col(url).alias("url"), page_title(F.col(html)).alias("title"), strip_html(F.col(html)).alias("text"), *extra)


def follow_pages(df: DataFrame, start: str, number: str, has_next: str, max_pages: int) -> DataFrame:
    """Pages of each start address up to the first without a next page, and at most ``max_pages`` of them."""
    ends = df.where(~F.coalesce(F.col(has_next), F.lit(False))).groupBy(start).agg(F.min(number).alias("_last"))
    return df.join(ends, start, "left").where((F.col(number) <= F.coalesce("_last", F.lit(max_pages))) & (F.col(number) <= max_pages)).drop("_last")


def source_records(df: DataFrame, kind: Column, body: Column, name: Column) -> DataFrame:
    """Envelopes of four kinds to flat records: lists, address lists, record lists and texts.

    Returns ``record`` (VARIANT) and ``_source``. Lists give their elements; ``records`` of an object theirs; ``urls``
    or ``results`` of address lists theirs; other objects stand for themselves.
    """
    value = parse_json(body)
    listed = lambda path: F.try_variant_get(value, path, "array<variant>")
    links = F.coalesce(listed("$.results"), listed("$.urls"))
    items = F.when(listed("$").isNotNull(), listed("$")).when(kind.isin("search", "url_list"), links).when(F.size(listed("$.records")) > 0, listed("$.records")).otherwise(F.array(value))
    address = F.try_variant_get(value, "$.url", "string")
    return df.select(F.coalesce(F.nullif(address, F.lit("")), name).alias("_source"), F.explode(items).alias("record"))


def read_config(path: str) -> Mapping[str, Any]:
    """A YAML configuration, on the driver; anything but a mapping is refused."""
    import yaml

    with open(path, encoding="utf-8") as file:
        loaded = yaml.safe_load(file)
    if not isinstance(loaded, dict):
        raise ValueError(f"{path}: a mapping is expected")
    return loaded
