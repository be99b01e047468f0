"""Event-sourced episodes: bundles, sequences, content-addressed bodies and imports, as set operations."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import SECRETS, SENSITIVE_KEYS, SENSITIVE_PARTS, parse_json


def bundle(episodes: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """Episodes with, per child table, the number of its rows and the last one as JSON.

    ``children`` maps a name to a table, its foreign key and the columns that order it. Each child is aggregated to
    one row per episode before it is joined, without gathering its rows.
    """
    out = episodes
    for name, (table, foreign, order) in children.items():
        body = F.to_json(F.struct(*[c for c in table.columns if c != foreign]))
        one = table.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(f"n_{name}"), F.max_by(body, F.struct(*order)).alias(f"last_{name}"))
        out = out.join(one, key, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def sequence(events: DataFrame, key: str, order: Sequence[str], block: Column | None = None) -> DataFrame:
    """Events with a gap-free ``sequence`` from 1 per key in ``order``.

    ``block`` is a coarse, order-preserving part of ``order`` (a day, say). Rows are numbered inside a block and
    shifted by the sizes of earlier blocks, so one huge key is spread over its blocks.
    """
    if block is None:
        return events.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    spread = events.withColumn("_block", block)
    sizes = spread.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    numbered = spread.withColumn("_row", F.row_number().over(inside))
    same = (numbered[key].eqNullSafe(starts[key])) & (numbered["_block"].eqNullSafe(starts["_block"]))
    joined = numbered.join(starts, same)
    return joined.select(*[numbered[c] for c in events.columns], (F.col("_before") + F.col("_row")).cast("bigint").alias("sequence"))


def latest(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Per key the ``value`` of the greatest ``order``: the current state of an append-only history."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def newest(episodes: DataFrame, limit: int, status: str | None = None) -> DataFrame:
    """The newest episodes first; ``limit`` is held between 1 and 10,000."""
    rows = episodes if status is None else episodes.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(int(limit), 10_000)))


def put_objects(rows: DataFrame, body: str, store: DataFrame | None = None) -> DataFrame:
    """Distinct bodies by SHA-256 that ``store`` does not hold yet: ``sha256``, ``size_bytes``, ``object_path``, ``body``.

    Hashes are made distinct before bodies move; null bodies are left out.
    """
    hashed = rows.where(F.col(body).isNotNull()).select(F.sha2(F.col(body).cast("binary"), 256).alias("sha256"), F.col(body).alias("body"))
    distinct = hashed.groupBy("sha256").agg(F.first("body").alias("body"))
    if store is not None:
        distinct = distinct.join(store.select("sha256"), "sha256", "left_anti")
    path = F.concat(F.lit("objects/"), F.substring("sha256", 1, 2), F.lit("/"), F.substring("sha256", 3, 2), F.lit("/"), F.col("sha256"))
    return distinct.select("sha256", F.octet_length("body").cast("bigint").alias("size_bytes"), path.alias("object_path"), "body")


def verified(objects: DataFrame) -> DataFrame:
    """Stored objects with ``intact``: the body still has its hash and size."""
    good = (F.sha2(F.col("body").cast("binary"), 256) == F.col("sha256")) & (F.octet_length("body") == F.col("size_bytes"))
    return objects.withColumn("intact", F.coalesce(good, F.lit(False)))


def import_outcomes(lines: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Log lines with ``outcome``: ``skipped`` (imported before), ``invalid`` or ``imported``.

    Valid is an object with a field, a new selector and the literal ``true`` as ``ok``.
    """
    value = parse_json(F.col("line"))
    text = lambda n: F.trim(F.coalesce(F.try_variant_get(value, f"$.{n}", "string"), F.lit("")))
    flag = F.try_variant_get(value, "$.ok", "variant")
    good = F.coalesce((text("field") != "") & (text("new") != "") & (F.schema_of_variant(flag) == "BOOLEAN") & F.try_variant_get(flag, "$", "boolean"), F.lit(False))
    seen = done.select(*key).distinct().withColumn("_seen", F.lit(True))
    outcome = F.when(F.col("_seen"), "skipped").when(good, "imported").otherwise("invalid")
    return lines.join(seen, list(key), "left").withColumn("outcome", outcome).drop("_seen")


def sanitize_payload(payload: Column) -> Column:
    """JSON with secrets removed at any depth: sensitive keys go (their names stay in ``_redacted_fields``), texts are
    redacted. Text that is not JSON is redacted as text; null stays null."""
    import re

    exact = frozenset(k.replace("_", "") for k in SENSITIVE_KEYS)
    parts, ends = tuple(SENSITIVE_PARTS), ("token", "secret", "password", "passwd")
    patterns = [(re.compile(p), "\\1[REDACTED]" if g else "[REDACTED]") for p, g in SECRETS]

    def name(key: str) -> str:
        return re.sub(r"[^a-z0-9]+", "_", key.strip().lower()).strip("_")

    def secret(key: str) -> bool:
        n = name(key)
        c = n.replace("_", "")
        return not re.search(r"(^|_)authorization_category$", n) and (c in exact or c.endswith(ends) or any(p in c for p in parts))

    def clean(x):
        if isinstance(x, str):
            for pattern, by in patterns:
                x = pattern.sub(by, x)
            return x
        if isinstance(x, list):
            return [clean(v) for v in x]
        if isinstance(x, dict):
            out = {k: clean(v) for k, v in x.items() if not secret(k)}
            gone = sorted({name(k) for k in x if secret(k)})
            return out | {"_redacted_fields": gone} if gone else out
        return x

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            try:
                out.append(json.dumps(clean(json.loads(t)), ensure_ascii=False, sort_keys=True, separators=(",", ":")))
            except (ValueError, RecursionError):
                out.append(clean(t))
        return pd.Series(out)

    return F.pandas_udf(run, "string")(payload)


def storage_mode(category: Column, full: Column, textual: Column, changed: Column) -> Column:
    """How a captured body is kept: synthetic ones in full, authorised ones on request, all others by structure."""
    synthetic = F.lower(F.regexp_replace(F.trim(category), "[ -]", "_")).isin("synthetic_local", "local_synthetic", "synthetic")
    opted = (F.lower(category) == "authorized") & full & textual
    return F.when(synthetic, F.when(textual & changed, "redacted_full").otherwise("full")).when(opted, F.when(changed, "redacted_full_opt_in").otherwise("full_opt_in")).otherwise("structure_only")


def manifest_differences(wanted: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """``key`` and ``state`` (missing, unexpected, altered) where a manifest and what is there differ."""
    a, b = wanted.select(key, F.col(digest).alias("_w"), F.lit(1).alias("_in")), actual.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_out"))
    state = F.when(F.col("_out").isNull(), "missing").when(F.col("_in").isNull(), "unexpected").when(~F.col("_w").eqNullSafe(F.col("_a")), "altered")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state is not null")


def export(episodes_: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """``key`` and ``body``: each episode as one JSON document with its child rows in order.

    A document holds all rows of its episode by definition; nothing larger than one episode is gathered.
    """
    out = episodes_.select(key, F.struct(*episodes_.columns).alias("episode"))
    for name, (table, foreign, order) in children.items():
        rest = [c for c in table.columns if c != foreign]
        listed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*rest).alias("_row"))))
        one = table.groupBy(F.col(foreign).alias(key)).agg(F.transform(listed, lambda x: x["_row"]).alias(name))
        out = out.join(one, key, "left").withColumn(name, F.coalesce(name, F.array().cast(one.schema[name].dataType)))
    return out.select(key, F.to_json(F.struct("episode", *children), {"ignoreNullFields": "false"}).alias("body"))


def artifact_objects(events: DataFrame, validations: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct artifact hashes of events and validations with their stored object; hashes without one are left out."""
    named = events.select("artifact_sha256").union(validations.select("evidence_sha256")).where("artifact_sha256 is not null").distinct()
    return named.withColumnRenamed("artifact_sha256", "sha256").join(store, "sha256")
