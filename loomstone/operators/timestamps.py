"""Mixed timestamp texts to one UTC instant each.

A text is split into calendar parts by a handful of grammars that run inside the JVM. A zone or offset that
stands in the text holds. Where none stands there, the zone of the writing host is *estimated*: the local clock
readings of a host are laid against a reference time (the ingestion time, or the place in the order of arrival),
and of all IANA zones -- each a whole offset history, daylight saving included -- the one with the fewest violations
gives the zone. How late a reading may be is taken from the texts whose instant is known. Where a zone is declared for
the host, it is an exact check that follows: zones that fit alike yield to it, and a differing one is corrected and
reported (:func:`host_zones`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.session import cut_lineage, once

US = 1_000_000
DAY = 86_400 * US
#: Rows of the arrival order that share one reference time.
BLOCK = 256
#: Width of the classes in which distances from the reference are counted, and how many lie on each side of nothing.
STEP = 300 * US
STEPS = 16 * 12

# Full-width forms, look-alike date signs and blanks that time texts are written with.
WIDE = "０１２３４５６７８９：／－．，＋    　\t⽇⽉"
PLAIN = "0123456789:/-.,+      日月"
#: Invisible characters, removed.
HIDDEN = "​‌‍‎‏⁠﻿­"

MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\+00:00$"

_PERIOD = r"(凌晨|清晨|早上|早晨|上午|中午|下午|傍晚|晚上|夜里)?"
_CLOCK = r" ?(\d{1,2})[:时点] ?(\d{1,2})(?:(?:[:分] ?(\d{1,2})(?:[.,](\d{1,9}))?秒?)|分)?"
_HALF = r" ?(?:(A|P)\.?M\.?|UHR)?"
_ZONE = r" ?(Z|[A-Z]{3,5})? ?([+-]\d{1,2}(?::?\d{2})?)?(?: ?\[?([A-Z][A-Z_]+(?:/[A-Z_+-]+)*)\]?)?"
_TAIL = _PERIOD + _CLOCK + _HALF + _ZONE + "$"
_MONTH = "(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*"

# Each grammar rewrites the whole text into: kind|a|b|c|period|hour|minute|second|fraction|half|name|offset|zone
_GRAMMARS = (
    ("Y", r"^(\d{4}) ?[-/.年] ?(\d{1,2}) ?[-/.月] ?(\d{1,2})日?(?:T| )? ?" + _TAIL),
    ("N", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}),?(?:T| ) ?" + _TAIL),
    ("D", r"^(?:[A-Z]{3,9}, ?)?(\d{1,2})[- ]" + _MONTH + r"[- ,]+(\d{4}),?(?:T| ) ?" + _TAIL),
    ("M", "^" + _MONTH + r" (\d{1,2}),? (\d{4}),?(?:T| ) ?" + _TAIL),
    ("C", r"^(\d{4})(\d{2})(\d{2})[T ]?()(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?()" + _ZONE + "$"),
)
_COUNT = r"^\d{9,10}(\.\d{1,9})?$|^\d{12,13}(\.\d{1,6})?$|^\d{15,16}$|^\d{18,19}$"


@lru_cache(maxsize=1000)
def _own_abbreviations(zone: str) -> dict[str, int]:
    found: dict[str, int] = {}
    tz = ZoneInfo(zone)
    for year in range(2000, 2038):
        for month in range(1, 13):
            at = datetime(year, month, 15, tzinfo=timezone.utc).astimezone(tz)
            name, offset = at.tzname() or "", at.utcoffset() or timedelta()
            if name.isalpha():
                found.setdefault(name.upper(), int(offset.total_seconds()))
    return found


def abbreviations(hosts: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """``host|ABBR`` -> offset in seconds, for every abbreviation the zones of a host used from 2000 to 2037; where
    several zones are given (they fit its readings alike) the first that has it."""
    found: dict[str, int] = {}
    for host, zones in hosts.items():
        for zone in zones:
            for name, offset in _own_abbreviations(zone).items():
                found.setdefault(f"{host}|{name}", offset)
    return found


def clean(text: Column) -> Column:
    """One upper-case ASCII spelling of digits, signs and blanks."""
    plain = F.translate(text, WIDE + HIDDEN, PLAIN)
    return F.trim(F.regexp_replace(F.upper(plain), r"\s+", " "))


def _parts(text: Column) -> Column:
    """The parts of the first grammar that covers the whole text, else null."""
    rest = "|".join(f"${i}" for i in range(1, 13))
    found = F.lit(None).cast("string")
    for kind, grammar in reversed(_GRAMMARS):
        marked = F.regexp_replace(text, grammar, f"{kind}|{rest}")
        found = F.when(marked.startswith(f"{kind}|"), marked).otherwise(found)
    return F.split(found, r"\|")


def parse(df: DataFrame, text: str, date_order: Column | None = None) -> DataFrame:
    """Add ``local_us`` (clock reading), ``count_us`` (bare count), ``offset_s``, ``zone_name`` and ``abbr``.

    All are null where the text is null, blank, vague or impossible (month 13, 30 February, hour 24).
    A date of digits only that ends in the year follows ``date_order`` (``MDY``, else day first).
    """
    order = F.lit("DMY") if date_order is None else F.coalesce(date_order, F.lit("DMY"))
    keep = df.columns
    df = df.withColumn("_t", clean(F.col(text)))
    df = once(df, {"_p": _parts(F.col("_t"))}, [*keep, "_t"])
    part = lambda i: F.try_element_at("_p", F.lit(i))
    num = lambda c: F.expr(f"try_cast({c} as int)")
    names = ["_k", "_a", "_b", "_c", "_per", "_h", "_mi", "_s", "_f", "_half", "abbr", "_off", "zone_name"]
    df = df.withColumns({n: part(i) for i, n in enumerate(names, 1)})
    month = lambda c: ((F.instr(F.lit(MONTHS), c) + 2) / 3).cast("int")
    mdy = order == "MDY"
    first, second = num("_a"), num("_b")
    df = df.withColumns(
        {
            "_y": F.when(F.col("_k").isin("Y", "C"), first).otherwise(num("_c")),
            "_mo": F.when(F.col("_k").isin("Y", "C"), second).when(F.col("_k") == "N", F.when(mdy, first).otherwise(second)).when(F.col("_k") == "D", F.expr(f"cast((instr('{MONTHS}', _b) + 2) / 3 as int)")).when(F.col("_k") == "M", month(F.col("_a"))),
            "_d": F.when(F.col("_k").isin("Y", "C"), num("_c")).when(F.col("_k") == "N", F.when(mdy, second).otherwise(first)).when(F.col("_k") == "D", first).when(F.col("_k") == "M", second),
            "_h": num("_h"),
            "_mi": num("_mi"),
            "_s": F.coalesce(num("nullif(_s, '')"), F.lit(0)),
            "_f": F.substring(F.rpad(F.coalesce("_f", F.lit("")), 6, "0"), 1, 6).cast("int"),
        }
    )
    h = F.col("_h")
    hour = (
        F.when((F.col("_half") != "") & ~h.between(1, 12), None)
        .when(F.col("_half") == "A", h % 12)
        .when(F.col("_half") == "P", h % 12 + 12)
        .when(F.col("_per").isin("下午", "傍晚", "晚上", "夜里"), F.when(h.between(1, 11), h + 12).when(h.between(13, 23), h))
        .when(F.col("_per") == "中午", F.when(h.between(1, 2), h + 12).when(h.between(11, 14), h))
        .when(F.col("_per").isin("凌晨", "清晨", "早上", "早晨", "上午"), F.when(h == 12, F.when(F.col("_per") == "凌晨", 0)).when(h < 12, h))
        .otherwise(h)
    )
    df = df.withColumn("_h", hour)
    good = F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59) & F.col("_y").between(1900, 2200)
    day = F.expr("unix_date(to_date(try_to_timestamp(format_string('%04d-%02d-%02d', _y, _mo, _d), 'yyyy-MM-dd')))")
    local = ((day.cast("bigint") * 24 + F.col("_h")) * 3600 + F.col("_mi") * 60 + F.col("_s")) * F.lit(US) + F.col("_f")
    digits = F.length(F.regexp_extract("_t", r"^\d+", 0))
    scale = F.when(digits <= 10, F.lit(US)).when(digits <= 13, F.lit(1000)).when(digits <= 16, F.lit(1)).otherwise(F.lit(0))
    count = F.when(scale > 0, F.round(F.expr("try_cast(_t as decimal(30,9))") * scale).cast("bigint")).otherwise(F.floor(F.expr("try_cast(_t as decimal(30,9))") / 1000).cast("bigint"))
    sign = F.when(F.col("_off").startswith("-"), -1).otherwise(1)
    off = F.regexp_replace("_off", "[+:-]", "")
    wide = F.lpad(F.when(F.length(off) <= 2, F.concat(off, F.lit("00"))).otherwise(off), 4, "0")
    seconds = sign * (F.substring(wide, 1, 2).cast("int") * 3600 + F.substring(wide, 3, 2).cast("int") * 60)
    offset = F.when(F.col("_off") != "", seconds).when(F.col("abbr").isin("Z", "UTC"), 0)
    usable = good & F.col("_k").isNotNull() & ~F.coalesce(F.abs(offset) > 18 * 3600, F.lit(False))
    made = {
        "count_us": F.when(F.col("_k").isNull() & F.col("_t").rlike(_COUNT), count),
        "local_us": F.when(usable, local),
        "offset_s": offset,
        "abbr": F.nullif("abbr", F.lit("")),
        "zone_name": F.nullif("zone_name", F.lit("")),
    }
    return once(df, made, keep)


def _shifted(us: Column, zone: Column) -> Column:
    """The clock reading in ``zone`` at an instant, both in microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def to_utc(local_us: Column, zone: Column) -> Column:
    """The one instant a zone's clock shows ``local_us``; null where the zone skips it or passes it twice."""
    before, after = local_us - F.lit(3 * DAY // 2), local_us + F.lit(3 * DAY // 2)
    early, late = local_us - (_shifted(before, zone) - before), local_us - (_shifted(after, zone) - after)
    holds = lambda at: _shifted(at, zone) == local_us
    one = F.when(holds(early), early)
    return F.when(early == late, one).otherwise(
        F.when(holds(early) & ~holds(late), early).when(holds(late) & ~holds(early), late)
    )


def arrival_clock(df: DataFrame, group: str, order: str, instant_us: str, block: int = BLOCK) -> DataFrame:
    """A reference time from the order of arrival: per group and block of ``order``, the median of the known instants.

    Returns ``group``, ``_block`` (``floor(order / block)``) and ``_clock``; blocks without a known instant are absent.
    """
    known = df.where(F.col(instant_us).isNotNull())
    return known.groupBy(group, F.floor(F.col(order) / block).alias("_block")).agg(F.expr(f"percentile_approx({instant_us}, 0.5, 200)").alias("_clock"))


@lru_cache(maxsize=100_000)
def _offsets(day: int, zones: tuple[str, ...]) -> tuple[tuple[int, int], ...]:
    """Of each zone the offsets, in steps, at the beginning and the end of a day of its own calendar."""
    noon = datetime(1970, 1, 1) + timedelta(days=day, hours=12)
    found = []
    for zone in zones:
        tz = ZoneInfo(zone)
        found.append(tuple(int((noon + timedelta(hours=h)).replace(tzinfo=tz).utcoffset().total_seconds() * US // STEP) for h in (-12, 12)))
    return tuple(found)


def violations(counted: pd.DataFrame, zones: Sequence[str], windows: Mapping[bool, tuple[int, int]]) -> np.ndarray:
    """For each zone, how many of the counted readings lie outside the window of their kind of reference.

    ``counted`` holds ``_seen`` (the reference is an ingestion time), ``_day`` of the reading, ``_step`` (reading less
    reference, in steps) and ``n``. A window gives the least and the greatest number of steps that the reference may
    lie behind the reading. On a day on which a zone changes its offset both offsets are right.
    """
    total = np.full(len(zones), int(counted["n"].sum()), dtype=np.int64)
    for (seen, day), part in counted.groupby(["_seen", "_day"]):
        least, most = windows[bool(seen)]
        sums = np.zeros(2 * STEPS + 3, dtype=np.int64)  # sums[i]: readings below step i - STEPS
        np.add.at(sums, part["_step"].to_numpy() + STEPS + 1, part["n"].to_numpy())
        sums = np.cumsum(sums)
        offsets = np.asarray(_offsets(int(day), tuple(zones)))
        low = np.clip(offsets - most, -STEPS, STEPS) + STEPS
        high = np.clip(offsets - least + 1, -STEPS, STEPS) + STEPS
        total -= np.max(sums[high] - sums[low], axis=1)
    return total


def estimate_zones(counted: DataFrame, host: str, zones: Sequence[str], windows: Mapping[bool, tuple[int, int]]) -> DataFrame:
    """For each ``host`` the ``zones`` with the fewest violations, as an array in the given order, with the number of
    ``violations`` and ``readings``. ``counted`` is as for :func:`violations`; its size is bounded by the calendar, not
    by the readings. A host without any reading is absent."""

    def best(part: pd.DataFrame) -> pd.DataFrame:
        wrong = violations(part, zones, windows)
        least = int(wrong.min())
        return pd.DataFrame({host: [part[host].iloc[0]], "zones": [[z for z, w in zip(zones, wrong) if w == least]], "violations": [least], "readings": [int(part["n"].sum())]})

    return counted.groupBy(host).applyInPandas(best, f"{host} string, zones array<string>, violations long, readings long")


def _windows(known: Sequence, share: float = 0.9) -> dict[bool, tuple[int, int]]:
    """Per kind of reference the narrowest window, in steps, that holds ``share`` of the known instants; rows that came
    days late fall outside.

    ``known`` holds rows of ``_seen``, ``_step`` (instant less reference) and ``n``. Without known instants a reading is
    taken for written up to an hour before it came in, or within three hours of its place in the order of arrival.
    """
    found = {True: (-1, 12), False: (-36, 36)}
    for seen in found:
        behind = sorted((-r["_step"], r["n"]) for r in known if r["_seen"] == seen)
        if behind:
            sums = np.cumsum([0, *(n for _, n in behind)])
            ends = np.searchsorted(sums[1:], sums[:-1] + share * sums[-1])  # the step at which a window that starts at each is full
            found[seen] = min(((behind[i][0], behind[j][0]) for i, j in enumerate(ends) if j < len(behind)), key=lambda w: (w[1] - w[0], w))
    return found


def _prepared(df: DataFrame, small: DataFrame) -> DataFrame:
    """The rows with what their texts hold; ``_sure`` is the instant where no zone of a host is needed for it."""
    rows = parse(df.join(F.broadcast(small), F.col("_at_host") == F.col("_host"), "left"), "_text", F.col("_order"))
    sure = F.coalesce("count_us", F.col("local_us") - F.col("offset_s").cast("bigint") * US)
    return once(rows, {"_sure": sure}, rows.columns)


def _named(df: DataFrame, text: str, host: str, group: str, order: str, reference_us: str) -> list[Column]:
    return [F.col(f"`{c}`").alias(n) for c, n in ((text, "_text"), (host, "_at_host"), (group, "_group"), (order, "_place"), (reference_us, "_when"))]


def _hosts(df: DataFrame, hosts: DataFrame) -> tuple[list, DataFrame]:
    """The list of hosts and the same as a small table."""
    known = [r for r in hosts.select("crawl_host", "tz_name", "date_order").distinct().limit(10_001).collect() if r.crawl_host]
    if len(known) > 10_000:
        raise ValueError("the list of hosts is meant to be a fixed, short one")
    return known, df.sparkSession.createDataFrame([(r.crawl_host, r.date_order) for r in known] or [(None, None)], "_host string, _order string")


def host_zones(df: DataFrame, text: str, host: str, hosts: DataFrame, group: str, order: str, reference_us: str) -> DataFrame:
    """Of each listed host with zoneless readings: ``_host``, ``zones`` (those that fit best, all alike), ``violations``
    and ``readings``. Arguments are those of :func:`normalise`; all IANA zones are candidates, declared zones are not
    looked at. Readings with neither an ingestion time nor a known instant near them in the order are left out.
    """
    _, small = _hosts(df, hosts)
    listed = df.select(*_named(df, text, host, group, order, reference_us)).join(F.broadcast(small.select(F.col("_host").alias("_at_host"))), "_at_host", "left_semi")
    free = F.col("_sure").isNull() & F.col("abbr").isNull() & F.col("zone_name").isNull() & F.col("local_us").isNotNull()
    rows = cut_lineage(_prepared(listed, small).where(F.col("_sure").isNotNull() | free).select("_host", "_group", "_place", "_when", "_sure", "local_us"))
    late = rows.where(F.col("_when").isNull()).withColumn("_block", F.floor(F.col("_place") / BLOCK))
    clock = arrival_clock(late, "_group", "_place", "_sure")
    by_order = late.join(clock, ["_group", "_block"]).select("_host", "_sure", "local_us", F.col("_clock").alias("_reference"), F.lit(False).alias("_seen"))
    by_time = rows.where(F.col("_when").isNotNull()).select("_host", "_sure", "local_us", F.col("_when").alias("_reference"), F.lit(True).alias("_seen"))
    known = F.col("_sure").isNotNull()
    step = F.floor((F.coalesce("_sure", "local_us") - F.col("_reference")) / STEP)
    step = F.least(F.greatest(step, F.lit(-STEPS)), F.lit(STEPS)).cast("int").alias("_step")
    day = F.when(~known, F.floor(F.col("local_us") / DAY)).cast("int").alias("_day")
    counted = by_order.unionByName(by_time).groupBy(F.when(~known, F.col("_host")).alias("_host"), "_seen", day, step).agg(F.count("*").alias("n"))
    counted = cut_lineage(counted)
    windows = _windows(counted.where(F.col("_host").isNull()).collect())  # at most two rows a step
    # Area/City names first: of zones that fit alike the first one is taken.
    zones = sorted(available_timezones() - {"localtime", "Factory", "posixrules"}, key=lambda z: (z.split("/")[0] not in ("Africa", "America", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific"), z))
    return estimate_zones(counted.where(F.col("_host").isNotNull()), "_host", zones, windows)


def zone_report(df: DataFrame, text: str, host: str, hosts: DataFrame, group: str, order: str, reference_us: str) -> DataFrame:
    """Each listed host with ``declared`` zone, whether it ``agrees`` with the estimate (null without either), how many
    zones fit alike, the first of them, ``violations`` and ``readings``."""
    found = host_zones(df, text, host, hosts, group, order, reference_us)
    listed = hosts.select(F.col("crawl_host").alias("_host"), F.col("tz_name").alias("declared")).where("_host is not null").distinct()
    agrees = F.array_contains("zones", F.col("declared"))
    return listed.join(found, "_host", "left").select(F.col("_host").alias("crawl_host"), "declared", agrees.alias("agrees"), F.size("zones").alias("n_zones"), F.try_element_at("zones", F.lit(1)).alias("zone"), "violations", "readings")


def normalise(df: DataFrame, text: str, host: str, hosts: DataFrame, group: str, order: str, reference_us: str, default_zone: str = "UTC") -> DataFrame:
    """Add ``utc_us`` (the one instant the text denotes, else null) and ``zone`` (the zone taken for zoneless texts).

    ``hosts`` holds ``crawl_host``, ``tz_name`` and ``date_order`` -- a fixed list of machines. The zone of a host is
    estimated from ``reference_us`` (ingestion times) or, where that is null, from the arrival order of the rows of
    the same ``group``; a declared zone decides between zones that fit alike and corrects an estimate that differs.
    Hosts with neither use ``default_zone``, as do rows without a listed host.

    Null, blank, vague and impossible texts, and zoneless readings that the zone skips or passes twice, give null.
    Rows are neither dropped nor multiplied, repeated ones come each; an empty table gives an empty one. Texts of any
    length are read whole. All columns are kept whatever their names; columns called ``utc_us`` and ``zone`` are
    replaced.
    """
    kept = [c for c in df.columns if c not in ("utc_us", "zone")]
    known, small = _hosts(df, hosts)
    found = {r["_host"]: list(r["zones"]) for r in host_zones(df, text, host, hosts, group, order, reference_us).collect()}  # one row per listed host
    fitting = {r.crawl_host: found.get(r.crawl_host, [default_zone]) for r in known}
    fitting |= {r.crawl_host: [r.tz_name] for r in known if r.tz_name}
    whole_row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
    rows = _prepared(df.select(whole_row, *_named(df, text, host, group, order, reference_us)), small)
    literal = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    own = literal(abbreviations(fitting | {"": [default_zone]}).items())[F.concat_ws("|", F.coalesce("_host", F.lit("")), "abbr")]
    offset = F.when(F.col("abbr").isNotNull(), F.coalesce(own, F.when(F.col("abbr") == "GMT", 0)))
    rows = once(rows, {"_fixed": F.coalesce("_sure", F.col("local_us") - offset.cast("bigint") * US)}, ["_row", "_host", "local_us", "abbr", "zone_name"])
    chosen = {h: zones[0] for h, zones in fitting.items()}
    zone = F.coalesce(literal(chosen.items())[F.col("_host")], F.lit(default_zone)) if chosen else F.lit(default_zone)
    names = F.expr("str_to_map('" + ",".join(f"{z.upper()}:{z}" for z in sorted(available_timezones())) + "')")
    named = F.when(F.col("zone_name").isNotNull(), names[F.col("zone_name")])
    rows = rows.withColumn("zone", F.coalesce(named, F.when(F.col("zone_name").isNull(), zone)))
    instant = F.coalesce("_fixed", F.when(F.col("abbr").isNull(), to_utc(F.col("local_us"), F.col("zone"))))
    return once(rows, {"utc_us": instant}, ["_row", "zone"]).select("_row.*", "zone", "utc_us")
