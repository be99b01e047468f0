"""Captures of recorded responses and embedded JSON, as batch operators."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import parse_json

# Bounds of a captured body in bytes.
DEFAULT_BYTES, MOST_BYTES = 1_000_000, 16_000_000


@dataclass(frozen=True)
class CaptureSpec:
    """What to capture: embedded JSON by selector or network JSON by address pattern."""

    name: str
    type: str
    selector: str = ""
    url_glob: str = ""
    required: bool = False
    max_bytes: int = DEFAULT_BYTES

    def problems(self) -> list[str]:
        """Why the spec is not usable; empty where it is."""
        found = []
        if not self.name or self.name == "page_url" or "." in self.name:
            found.append("name")
        if self.type not in ("embedded_json", "network_json"):
            found.append("type")
        if type(self.required) is not bool:
            found.append("required")
        if type(self.max_bytes) is not int or not 1 <= self.max_bytes <= MOST_BYTES:
            found.append("max_bytes")
        if self.type == "embedded_json" and not self.selector:
            found.append("selector")
        if self.type == "network_json" and not self.url_glob:
            found.append("url_glob")
        return found


def check_specs(specs: Sequence[CaptureSpec]) -> None:
    """Raise ``ValueError`` for unusable specs and names given twice."""
    wrong = [(s.name, s.problems()) for s in specs if s.problems()]
    if wrong or len({s.name for s in specs}) < len(specs):
        raise ValueError(f"capture specs not usable: {wrong or 'a name is given twice'}")


def glob(text: Column, pattern: str) -> Column:
    """Case-sensitive ``*``, ``?`` and ``[...]`` over the whole text."""
    inner = fnmatch.translate(pattern).removesuffix("\\z").removesuffix("\\Z")
    return text.rlike(f"^{inner}$")


def is_json_response(method: Column, kind: Column, status: Column, content_type: Column) -> Column:
    """A successful GET of script data that carries JSON."""
    return (F.upper(method) == "GET") & kind.isin("xhr", "fetch") & status.between(200, 299) & F.lower(content_type).contains("json")


def match_specs(responses: DataFrame, url: str, specs: Sequence[CaptureSpec]) -> DataFrame:
    """Each response with each spec whose pattern its address meets, as ``spec`` and ``max_bytes``.

    The specs become one array in the projection, so there is neither a join nor a shuffle.
    """
    hits = F.array_compact(F.array(*[F.when(glob(F.col(url), s.url_glob), F.struct(F.lit(s.name).alias("spec"), F.lit(s.max_bytes).alias("max_bytes"))) for s in specs]))
    return responses.select("*", F.inline(hits))


def first_matches(matched: DataFrame, page: str, order: Sequence[str], body: str) -> DataFrame:
    """One row per page and spec: the first match claims the spec, even if its body is too large or not JSON.

    Adds ``error``: null, ``too_large`` or ``not_json``. Aggregates before the shuffle (``min_by``), so a page with
    very many responses sends one row per partition.
    """
    rest = [c for c in matched.columns if c not in (page, "spec")]
    first = matched.groupBy(page, "spec").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(page, "spec", "_first.*")
    return first.withColumn("error", capture_error(F.col(body), F.col("max_bytes")))


def capture_error(body: Column, max_bytes: Column) -> Column:
    """``too_large``, ``not_json`` or null for a body; a null body is not JSON."""
    return F.when(F.octet_length(body) > max_bytes, "too_large").when(parse_json(body).isNull(), "not_json")


def missing_specs(pages: DataFrame, page: str, captured: DataFrame, specs: Sequence[CaptureSpec]) -> DataFrame:
    """``page``, ``spec``, ``required`` for every spec a page has no error-free capture of."""
    wanted = F.inline(F.array(*[F.struct(F.lit(s.name).alias("spec"), F.lit(s.required).alias("required")) for s in specs]))
    good = captured.where("error is null").select(page, "spec")
    return pages.select(page).distinct().select(page, wanted).join(good, [page, "spec"], "left_anti")


def failed_pages(missing: DataFrame, page: str) -> DataFrame:
    """Pages that fail closed: a required spec is missing."""
    return missing.groupBy(page).agg(F.bool_or("required").alias("_fail"), F.count("*").alias("n_missing")).where("_fail").drop("_fail")


def within_budget(requests: DataFrame, session: str, order: Sequence[str], limit: int) -> DataFrame:
    """Requests with ``number`` in their session and ``allowed``: the first ``limit`` of it.

    Sessions are cut into blocks of the order by a two-level count only where a window would gather one huge session:
    the number is the row number within a block plus the rows of earlier blocks.
    """
    from pyspark.sql import Window

    first = order[0]
    spread = requests.withColumn("_block", F.date_trunc("day", F.col(first)) if dict(requests.dtypes)[first].startswith("timestamp") else F.floor(F.col(first) / 65536))
    sizes = spread.groupBy(session, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(session).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(session, "_block").orderBy(*order)
    numbered = spread.withColumn("_row", F.row_number().over(inside)).join(starts, [session, "_block"])
    return numbered.withColumn("number", F.col("_before") + F.col("_row")).withColumn("allowed", F.col("number") <= limit).drop("_block", "_row", "_before")


def first_visible(snapshots: DataFrame, page: str, after_ms: str, value: str, timeout_ms: int) -> DataFrame:
    """Per page the first non-empty ``value`` that shows within ``timeout_ms``, with the time it shows at; pages where
    none shows come with null."""
    shown = F.when((F.col(after_ms) <= timeout_ms) & (F.coalesce(F.col(value), F.lit("")) != ""), F.struct(after_ms, value))
    return snapshots.groupBy(page).agg(F.min(shown).alias("_s")).select(page, f"_s.{after_ms}", f"_s.{value}")


def embedded(df: DataFrame, html: str, spec: CaptureSpec) -> DataFrame:
    """``body`` and ``error`` of the JSON embedded in a page under a simple selector: null, ``missing``, ``too_large``
    or ``not_json``; the body is null where there is an error."""
    from loomstone.operators.markup import _opening

    opening = _opening(spec.selector)
    if opening is None:
        raise ValueError(f"not a simple selector: {spec.selector!r}")
    inner = F.trim(F.regexp_extract(F.col(html), "(?is)" + opening[0] + r"(.*?)</\1\s*>", 2))
    error = F.when(F.coalesce(inner, F.lit("")) == "", "missing").otherwise(capture_error(inner, F.lit(spec.max_bytes)))
    return df.withColumn("error", error).withColumn("body", F.when(F.col("error").isNull(), inner))
