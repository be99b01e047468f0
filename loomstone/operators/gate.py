"""Declarative quality rules for extracted values, compiled to columns when the plan is built."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.text import strip

# The grammars of the value types.
INTEGER = r"^[+-]?[0-9]+(?:_[0-9]+)*$"
FLOAT = r"(?i)^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*)?\.?(?:[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|[0-9]+(?:_[0-9]+)*\.(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"
DATE = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"
URL = r"^https?://\S+"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
#: A length range without a maximum.
NO_MAXIMUM = 999_999


def _type(text: Column, name: str) -> Column:
    if name == "price":
        value = F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")
        return F.coalesce(value > 0, F.lit(False))
    if name == "int":
        return F.regexp_replace(text, "[, ]", "").rlike(INTEGER)
    if name == "float":
        return F.regexp_replace(text, "[, ]", "").rlike(FLOAT)
    grammar = {"url": URL, "date": DATE, "email": EMAIL}.get(name)
    return text.rlike(grammar) if grammar else F.lit(True)


def check(text: Column, rule: str, params: Any) -> Column | None:
    """Whether a stripped text keeps one rule; null (the Python value) for a rule that cannot be evaluated."""
    try:
        if rule == "non_empty":
            return text != ""
        if rule == "min_length":
            return F.length(text) >= int(params)
        if rule == "max_length":
            return F.length(text) <= int(params)
        if rule == "length_range":
            return F.length(text).between(int(params.get("min") or 0), int(params.get("max") or NO_MAXIMUM))
        if rule == "type":
            return _type(text, str(params))
        if rule == "regex":
            pattern = (params or {}).get("pattern") or ""
            re.compile(pattern)
            return text.rlike(f"^(?:{pattern})") if pattern else F.lit(True)
        if rule == "enum":
            values = (params or {}).get("values")
            return text.isin(*map(str, values)) if isinstance(values, list) and values else F.lit(False)
    except (TypeError, ValueError, AttributeError, re.error):
        return None
    return F.lit(True)


def label(rule: str, params: Any) -> str:
    """How a broken rule is reported."""
    if rule == "type":
        return f"type:{params}"
    if rule == "regex":
        return f"regex:{(params or {}).get('pattern', '')}"
    if rule == "enum":
        return f"enum:{(params or {}).get('values', [])}"
    if rule == "length_range":
        return f"length_range:[{params.get('min', 0)},{params.get('max', 0)}]"
    return f"{rule}:{params}"


def validate(value: Column, rules: Mapping[str, Any] | None = None) -> Column:
    """``struct<passed, score, failed_rules>`` of a value. Null counts as ``''``; without rules it must not be empty.

    Unknown rules pass and count; a rule that cannot be evaluated fails as ``<rule>:eval_error``.
    """
    text = strip(F.coalesce(value.cast("string"), F.lit("")))
    if not rules:
        kept = text != ""
        failed = F.when(kept, F.array().cast("array<string>")).otherwise(F.array(F.lit("non_empty")))
        return F.struct(kept.alias("passed"), F.when(kept, 1.0).otherwise(0.0).alias("score"), failed.alias("failed_rules"))
    broken = []
    for rule, params in rules.items():
        kept = check(text, rule, params)
        broken.append(F.lit(f"{rule}:eval_error") if kept is None else F.when(~kept, F.lit(label(rule, params))))
    failed = F.array_compact(F.array(*broken))
    score = (F.lit(len(rules)) - F.size(failed)) / F.lit(float(len(rules)))
    return F.struct((F.size(failed) == 0).alias("passed"), score.alias("score"), failed.alias("failed_rules"))
