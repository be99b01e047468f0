"""The ranked fallback cascade: the first stage whose value is there and passes the gate wins.

Every stage is a pair of columns, so Catalyst evaluates later stages only where earlier ones fail. Values that need
Python should come from one call (``markup.select`` gives all selectors of a page at once).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import strip
from loomstone.operators import jsonpath
from loomstone.operators.gate import validate
from loomstone.operators.markup import select_first
from loomstone.session import once

# How far a stage is trusted.
CONFIDENCE = {"configured": 1.0, "fallback": 0.9, "cached_repair": 0.85, "llm_text": 0.75, "scrapling_adaptive": 0.7, "exhausted": 0.0}
#: An adaptive value below this confidence yields to an accepted candidate.
TRIGGER = 0.8


@dataclass(frozen=True)
class Stage:
    """A way to get the value: its method, its selector (text or column) and the value found there."""

    method: str
    selector: str | Column
    value: Column

    @property
    def name(self) -> Column:
        return F.lit(self.selector) if isinstance(self.selector, str) else self.selector


def run(stages: Sequence[Stage], rules: Mapping[str, Any] | None = None, gates: Sequence[Column] | None = None) -> Column:
    """``struct<selector, value, confidence, method, validated, attempts>``.

    Stages come in the order configured, fallbacks, cached repair, adaptive, candidate. A stage without a selector
    (null or ``''``) is not tried. An accepted adaptive value is kept unless a candidate is accepted as well. Where
    nothing is accepted, the method is ``exhausted``, the value ``''`` and the selector the configured one. ``gates`` may
    hold the verdicts of the stages where they are columns already.
    """
    tried, accepted, attempts = [], [], []
    configured = next((s.name for s in stages if s.method == "configured"), F.lit(""))
    for i, s in enumerate(stages):
        gate = validate(s.value, rules) if gates is None else gates[i]
        there = F.coalesce(s.name, F.lit("")) != ""
        if s.method == "scrapling_adaptive":
            there = there & (F.coalesce(configured, F.lit("")) != "")
        if s.method == "llm_text":
            there = there & (F.coalesce(s.name, F.lit("")) != F.coalesce(configured, F.lit("")))
        ok = there & (F.coalesce(s.value, F.lit("")) != "") & gate["passed"]
        tried.append(there)
        accepted.append(F.coalesce(ok, F.lit(False)))
        attempts.append(
            F.struct(
                F.lit(s.method).alias("stage"),
                s.name.alias("selector"),
                F.lit(CONFIDENCE[s.method]).alias("confidence"),
                F.coalesce(ok, F.lit(False)).alias("accepted"),
                (strip(F.coalesce(s.value, F.lit(""))) != "").alias("had_value"),
                gate.alias("quality_gate"),
            )
        )
    rank = list(range(len(stages)))
    adaptive = [i for i in rank if stages[i].method == "scrapling_adaptive"]
    candidate = [i for i in rank if stages[i].method == "llm_text"]
    early = [i for i in rank if i not in adaptive and i not in candidate]
    order = early + (candidate + adaptive if CONFIDENCE["scrapling_adaptive"] < TRIGGER else adaptive + candidate)
    result = F.struct(configured.alias("selector"), F.lit("").alias("value"), F.lit(0.0).alias("confidence"), F.lit("exhausted").alias("method"), F.lit(False).alias("validated"))
    for i in reversed(order):
        s = stages[i]
        won = F.struct(s.name.alias("selector"), s.value.alias("value"), F.lit(CONFIDENCE[s.method]).alias("confidence"), F.lit(s.method).alias("method"), F.lit(True).alias("validated"))
        result = F.when(accepted[i], won).otherwise(result)
    # The trace ends with the first early stage that is accepted; adaptive and candidate stages follow one another.
    shown, going = [], F.lit(True)
    for i in rank:
        shown.append(F.when(going & tried[i], attempts[i]))
        if i in early or i in candidate:
            going = going & ~accepted[i]
    trace = F.array_compact(F.array(*shown))
    return F.struct(*[result[c].alias(c) for c in ("selector", "value", "confidence", "method", "validated")], trace.alias("attempts"))


def apply(df: DataFrame, fields: Mapping[str, tuple[Sequence[Stage], Mapping[str, Any] | None]]) -> DataFrame:
    """``df`` with the result of :func:`run` per field; every value and every gate is computed once a row.

    Column names that begin with ``_v`` and ``_g`` must not be in use.
    """
    flat = [(n, i, s, rules) for n, (stages, rules) in fields.items() for i, s in enumerate(stages)]
    values = once(df, {f"_v{k}": s.value for k, (_, _, s, _) in enumerate(flat)}, df.columns)
    gates = once(values, {f"_g{k}": validate(F.col(f"_v{k}"), rules) for k, (*_, rules) in enumerate(flat)}, values.columns)
    results = {}
    for name, (_, rules) in fields.items():
        own = [(k, s) for k, (n, _, s, _) in enumerate(flat) if n == name]
        results[name] = run([Stage(s.method, s.selector, F.col(f"_v{k}")) for k, s in own], rules, [F.col(f"_g{k}") for k, _ in own])
    return once(gates, results, df.columns)


def low_confidence(result: Column, below: float = 0.8) -> Column:
    """Whether a result should be kept as an episode of repair: not validated, or trusted less than ``below``."""
    return ~result["validated"] | (result["confidence"] < below)


def from_context(value: Column, selected: Column, declared_capture: bool, rules: Mapping[str, Any] | None = None) -> Column:
    """A field with a source path: the value found there where it is not empty and passes the gate; otherwise the
    selected value if the path begins at a declared capture, and else what was found there."""
    good = (F.coalesce(value, F.lit("")) != "") & validate(value, rules)["passed"]
    return F.when(good, value).otherwise(F.coalesce(selected if declared_capture else value, F.lit("")))


def read_context(path: str, context: Mapping[str, Column], payload: str = "payload") -> Column:
    """Text at a dotted path of what is known of a page, ``''`` for nothing.

    ``context`` holds a variant per name. The literal prefix ``payload.`` asks the payload, whatever its name there; a
    path that begins with a name of the context asks that; any other path asks the payload. All is decided when the
    plan is built.
    """
    clean = path.strip()
    first, _, rest = clean.partition(".")
    if clean.startswith("payload.") and payload in context:
        return jsonpath.resolve(context[payload], rest)
    if first in context:
        return jsonpath.resolve(context[first], rest) if rest else F.coalesce(F.try_variant_get(context[first], "$", "string"), F.to_json(context[first]), F.lit(""))
    return jsonpath.resolve(context[payload], clean) if clean and payload in context else F.lit("")


def page_fields(item: Column, page: Column, fields: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    """Text per field from simple selectors: ``name: (selector, scope)``; the scope ``page`` reads the whole page also
    inside an item, any other the item."""
    return {name: select_first(page if scope == "page" else item, selector) for name, (selector, scope) in fields.items()}
