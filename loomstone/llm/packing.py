"""Filling containers of a fixed capacity with texts.

Texts longer than a container are cut into whole containers and a rest; nothing else is cut. The rests and the other
texts are dealt by hash into groups of about ``group`` items (20,000 unless given), whatever the size of the table, and each group is packed
by bin completion: around the largest unpacked item the undominated fillings are enumerated, fullest first, and
searched depth first with a bound on the waste; best-fit decreasing gives the first solution to beat. Items of
different groups never meet, so every group may leave a container partly empty.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Sequence
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import tokens
from loomstone.session import cut_lineage


def best_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that still holds it. Bins of item numbers."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_right(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(room, (left - sizes[i], b))
    return bins


def lower_bound(sizes: Sequence[int], capacity: int) -> int:
    """No packing has fewer bins: the total over the capacity, or the items above half of it with what cannot join them."""
    bound = ceil(sum(sizes) / capacity) if sizes else 0
    big = sorted(s for s in sizes if 2 * s > capacity)
    return max(bound, len(big))


def fillings(counts: dict[int, int], order: list[int], room: int, steps: int, keep: int, exact_ends: bool = True) -> tuple[list[tuple[int, ...]], int, bool]:
    """Undominated ways to fill ``room`` from the sizes left, fullest first, at most ``keep`` of them; the visits that
    took; and whether ways may be missing.

    A way is dropped if another fits one left-out item in, or if a single larger item could take the place of one of
    its own. The search visits sizes in descending order and stops after ``steps`` visits or, if ``exact_ends``, when
    the room is filled exactly.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    best = -1
    visits, cut = 0, False
    stack: list[tuple[int, int, tuple[int, ...]]] = [(bisect_right(order, room) - 1, room, ())]
    while stack and visits < steps:
        at, left, chosen = stack.pop()
        visits += 1
        while at >= 0 and (order[at] > left or counts[order[at]] <= chosen.count(order[at])):
            at -= 1
        if at < 0:
            total = room - left
            if total > best or len(found) < keep:
                found.append((total, chosen))
                best = max(best, total)
            else:
                cut = True
            if left == 0 and exact_ends:
                break
            continue
        size = order[at]
        stack.append((at - 1, left, chosen))  # without it: visited after the way that takes it
        stack.append((at, left - size, (*chosen, size)))
    cut |= bool(stack)
    ways = sorted(found, key=lambda f: (-f[0], len(f[1])))
    kept: dict[tuple[int, ...], None] = {}  # a set in order
    for _, way in ways:
        waste = room - sum(way)
        unused = lambda low, high: any(counts[s] > way.count(s) for s in order[bisect_right(order, low) : bisect_right(order, high)])  # noqa: B023, E731
        if waste and (unused(0, waste) or any(unused(s, s + waste) for s in set(way))) or way in kept:
            continue
        if len(kept) == keep:
            cut = True
            break
        kept[way] = None
    return list(kept) or [ways[0][1] if ways else ()], visits, cut


def complete(sizes: Sequence[int], capacity: int, nodes: int = 20_000, steps: int = 200, keep: int = 3) -> list[list[int]]:
    """Bin completion by branch and bound. Bins of item numbers; every item of ``sizes`` (1 .. capacity) is in one.

    ``nodes`` bounds the search for fewer bins than best fit gives; the best packing known by then is returned, so the
    bound costs quality, never items. It is the only bound: ``steps`` and ``keep`` limit the fillings of one bin at
    first, and a tree cut by them is searched again with wider ones until none is cut. A filling takes one node, and
    one more for every ``steps`` visits it took to find beyond the first. Empty input gives no bins.
    """
    incumbent = best_fit(sizes, capacity)
    least, total = lower_bound(sizes, capacity), sum(sizes)
    if len(incumbent) <= least:
        return incumbent
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    order = sorted(counts)
    left = len(sizes)
    chosen: list[tuple[int, ...]] = []
    options: list[list[tuple[int, ...]]] = []
    waste, best = 0, None
    width, cut = 1, False
    allowed = (len(incumbent) - 1) * capacity - total

    def take(way: tuple[int, ...], sign: int) -> None:
        for s in way:
            counts[s] = counts.get(s, 0) - sign
            if sign > 0 and counts[s] == 0:
                order.remove(s)
            elif sign < 0 and counts[s] == 1:
                insort(order, s)

    def undo() -> None:
        nonlocal left, waste
        way = chosen.pop()
        take(way, -1)
        left += len(way)
        waste -= capacity - sum(way)

    while nodes > 0:
        if left and len(options) == len(chosen):
            top = order[-1]
            counts[top] -= 1
            ways, visits, missing = fillings(counts, order, capacity - top, steps * min(width, max(1, nodes)), keep * width, width == 1)
            counts[top] += 1
            nodes -= (visits - 1) // steps
            cut |= missing
            options.append([(top, *w) for w in reversed(ways)])
        if not left:
            best = list(chosen)
            allowed = (len(best) - 1) * capacity - total
            if len(best) <= least:
                break
            undo()
            continue
        while options and not options[-1]:
            options.pop()
            if not options:
                break
            undo()
        if not options:
            if not cut:
                break
            width, cut = 8 * width, False  # all is unpacked again
            continue
        way = options[-1].pop()
        nodes -= 1
        if waste + capacity - sum(way) > allowed:
            continue  # no better than the incumbent, whatever follows
        take(way, 1)
        chosen.append(way)
        left -= len(way)
        waste += capacity - sum(way)
    if best is None:
        return incumbent
    items: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        items.setdefault(sizes[i], []).append(i)
    return [[items[s].pop() for s in way] for way in best]


def pack(df: DataFrame, key: str, text: str, bins: DataFrame, vocabulary: str = tokens.VOCABULARY, group: int = 20_000) -> DataFrame:
    """``bin_kind``, ``bin_id``, ``capacity_tokens``, the key, ``part`` (from 1), ``first_token`` and ``n_tokens``.

    ``bins`` holds ``bin_kind`` and ``capacity_tokens``, a fixed list. Every text is assigned once per kind; texts
    above the capacity come as several parts that follow one another. Null and empty texts need no room: they come
    with a null ``bin_id`` and 0 tokens. Repeated rows are items of their own. Kinds without a positive capacity are
    left out. An empty table gives no rows.
    """
    kinds = [(r.bin_kind, int(r.capacity_tokens)) for r in bins.select("bin_kind", "capacity_tokens").distinct().collect() if (r.capacity_tokens or 0) > 0]
    kind_rows = F.array(*[F.struct(F.lit(k).alias("bin_kind"), F.lit(c).alias("capacity_tokens")) for k, c in sorted(kinds)])
    sized = cut_lineage(df.select(F.col(key).alias("_key"), tokens.count(F.col(text), vocabulary).alias("_size")))
    groups = max(1, ceil(sized.count() / group))
    items = sized.select("_key", F.col("_size").cast("int").alias("_size"), F.inline(kind_rows))
    items = items.withColumns({"_whole": F.floor(F.col("_size") / F.col("capacity_tokens")).cast("int")})
    items = items.withColumn("_rest", F.col("_size") - F.col("_whole") * F.col("capacity_tokens"))
    full = items.where("_whole > 0").select("bin_kind", "capacity_tokens", "_key", F.explode(F.sequence(F.lit(1), F.col("_whole"))).alias("part"))
    full = full.select(
        "bin_kind",
        F.concat_ws("-", "bin_kind", F.lit("text"), F.col("_key").cast("string"), "part").alias("bin_id"),
        "capacity_tokens",
        "_key",
        "part",
        ((F.col("part") - 1) * F.col("capacity_tokens")).alias("first_token"),
        F.col("capacity_tokens").alias("n_tokens"),
    )
    none = items.where("_size = 0").select("bin_kind", F.lit(None).cast("string").alias("bin_id"), "capacity_tokens", "_key", F.lit(1).alias("part"), F.lit(0).alias("first_token"), F.lit(0).alias("n_tokens"))
    rests = items.where("_rest > 0").withColumn("_group", F.pmod(F.xxhash64("_key", F.lit(17)), F.lit(groups)))
    kind_of = dict(df.dtypes)[key]
    schema = f"bin_kind string, bin_id string, capacity_tokens int, _key {kind_of}, part int, first_token int, n_tokens int"

    def fill(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["_rest", "_key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        capacity, kind, number = int(batch.capacity_tokens[0]), batch.bin_kind[0], int(batch["_group"][0])
        packed = complete(batch["_rest"].tolist(), capacity)
        at = [i for b in packed for i in b]
        names = [f"{kind}-{number}-{j}" for j, b in enumerate(packed) for _ in b]
        out = batch.iloc[at]
        whole = out["_whole"].to_numpy()
        return pd.DataFrame({"bin_kind": kind, "bin_id": names, "capacity_tokens": capacity, "_key": out["_key"].to_numpy(), "part": whole + 1, "first_token": whole * capacity, "n_tokens": out["_rest"].to_numpy()})

    packed = rests.groupBy("bin_kind", "_group").applyInPandas(fill, schema)
    return full.unionByName(packed).unionByName(none).withColumnRenamed("_key", key)


def usage(packed: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, the least possible number of containers by total size, and the unused share."""
    held = packed.where("bin_id is not null").groupBy("bin_kind", "capacity_tokens", "bin_id").agg(F.sum("n_tokens").alias("held"))
    out = held.groupBy("bin_kind", "capacity_tokens").agg(F.count("*").alias("n_bins"), F.sum("held").alias("n_tokens"))
    room = F.col("n_bins") * F.col("capacity_tokens")
    return out.withColumns({"least_bins": F.ceil(F.col("n_tokens") / F.col("capacity_tokens")), "unused_share": F.round((room - F.col("n_tokens")) / room, 6)})
