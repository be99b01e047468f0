"""Paths into JSON columns, over the VARIANT type."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import parse_json


def _step(base: Column, part: str) -> Column:
    key = part.replace("'", "\\'")
    by_name = F.try_variant_get(base, f"$['{key}']", "variant")
    if part.lstrip("-").isdigit():
        number = int(part)
        if number >= 0:
            return F.coalesce(F.try_variant_get(base, f"$[{number}]", "variant"), by_name)
        items = F.try_variant_get(base, "$", "array<variant>")
        return F.coalesce(F.try_element_at(items, F.lit(number)), by_name)
    return by_name


def resolve(base: Column, path: str) -> Column:
    """Text at a dotted path of a VARIANT: names for objects, numbers (also negative) for lists; ``''`` for a miss."""
    at = base
    for part in filter(None, path.split(".")):
        at = _step(at, part)
    return F.coalesce(F.try_variant_get(at, "$", "string"), F.lit(""))


def records(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``pos`` and ``record`` (VARIANT): a list gives its elements, other JSON one record, no JSON none."""
    value = parse_json(F.col(text))
    items = F.try_variant_get(value, "$", "array<variant>")
    listed = F.when(items.isNotNull(), items).when(value.isNotNull(), F.array(value))
    return df.select(F.col(key), F.posexplode(listed).alias("pos", "record"))


def leaves(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``pos``, ``leaf``: every text inside JSON, at any depth, in order of appearance."""

    def run(batches):
        for batch in batches:
            keys, at, found = [], [], []
            for k, t in zip(batch["_k"], batch["_t"]):
                try:
                    todo, n = [json.loads(t)], 0
                except (TypeError, ValueError, RecursionError):
                    continue
                while todo:
                    x = todo.pop()
                    if isinstance(x, str):
                        keys.append(k), at.append(n), found.append(x)
                        n += 1
                    elif isinstance(x, dict):
                        todo.extend(reversed(list(x.values())))
                    elif isinstance(x, list):
                        todo.extend(reversed(x))
            if keys:
                yield pd.DataFrame({"_k": keys, "pos": at, "leaf": found})

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(run, f"_k {kind}, pos int, leaf string")
    return out.withColumnRenamed("_k", key)


def shape(text: Column, hidden: Sequence[str] = (), levels: int = 6, samples: int = 5) -> Column:
    """Types of a JSON text as JSON: objects by key (without ``hidden`` keys), lists with length and samples, texts
    with length; ``{"parse_error": true}`` where it is not JSON, null for null. Keys come sorted."""
    drop = frozenset(hidden)

    def describe(x, level=0):
        if level >= levels:
            return {"type": {"dict": "object", "list": "array"}.get(type(x).__name__, type(x).__name__), "truncated": True}
        if isinstance(x, dict):
            return {k: describe(v, level + 1) for k, v in x.items() if k.lower() not in drop}
        if isinstance(x, list):
            return {"type": "array", "length": len(x), "samples": [describe(v, level + 1) for v in x[:samples]]}
        if x is None or isinstance(x, bool):
            return "null" if x is None else "boolean"
        return "number" if isinstance(x, (int, float)) else {"type": "string", "length": len(x)}

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            try:
                made = describe(json.loads(t))
            except (ValueError, RecursionError):
                made = {"parse_error": True}
            out.append(json.dumps(made, sort_keys=True, ensure_ascii=False, separators=(",", ":")))
        return pd.Series(out)

    return F.pandas_udf(run, "string")(text)
