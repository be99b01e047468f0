"""Several values packed in one field, split into one row per value.

The signs a field may be split at open a lattice: every run of neighbouring pieces is a possible value. The
frequencies of the values, and for each sign how often it stands inside a value, are learned from the whole column by
expectation maximisation over these lattices, and the Viterbi path of each field gives its values. Quoted spans are
atomic and values of their own, and a sign directly between two digits never separates.

At scale: the fields are first reduced to *shapes* (digits and quoted spans masked) and counted, so the passes of the
learning run over distinct shapes only. Every value counts in each pass; a value rarer than ``epsilon`` scores as much
as an unseen one, ``epsilon``, so only the at most ``1 / epsilon`` others need be listed, whatever the size of the
table. These and the signs are the only things sent to the executors. Splitting itself needs no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil, exp, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.session import cut_lineage, spread

#: Signs that may separate values.
DELIMITER = r"[;；,，|｜、/／+＋\n\r\t]|<br\s*/?>"
# Pairs of quotation marks.
QUOTES = {'"': '"', "“": "”", "'": "'", "‘": "’", "「": "」", "『": "』"}
_TOKEN = re.compile(
    r'(?P<q>"(?:[^"\\]|\\.|"")*"|“[^”]*”|「[^」]*」|『[^』]*』|‘[^’]*’|(?:(?<=^)|(?<=[;；,，|｜、/／+＋\n\r\t>\s\[]))\'(?:[^\'\\]|\\.|\'\')*\'(?=\s*(?:$|[;；,，|｜、/／+＋\n\r\t\]]|<br)))'
    + f"|(?P<d>{DELIMITER})",
    re.I,
)
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")
_CUT = "\x1e"
#: A quoted span in a shape, and the pieces that are never part of a longer value.
QUOTED = "Q"
ALONE = ("", QUOTED)


def pieces(text: str) -> tuple[list[str], list[str]]:
    """The smallest pieces of a field and the signs between them (one fewer)."""
    body = text.strip()
    if body[:1] == "[" and body[-1:] == "]" and body[1:].lstrip()[:1] in ('"', "'"):
        body = body[1:-1]
    found, signs, start = [], [], 0
    for m in _TOKEN.finditer(body):
        if m.lastgroup == "d":
            a, b = m.start(), m.end()
            if 0 < a and b < len(body) and b == a + 1 and body[a - 1].isdigit() and body[b].isdigit():
                continue
            found.append(body[start:a])
            signs.append(body[a:b])
            start = b
    found.append(body[start:])
    return found, signs


def unquote(piece: str) -> str:
    """The piece without blanks at its ends and without enclosing quotes, inner quotes undone."""
    piece = piece.strip()
    if len(piece) >= 2 and QUOTES.get(piece[0]) == piece[-1]:
        close, inner = piece[-1], piece[1:-1]
        bare = re.sub(r"\\.", "", inner.replace(close * 2, ""))
        if close not in bare:
            inner = inner.replace(close * 2, close) if piece[0] == close else inner
            piece = re.sub(r"\\(.)", r"\1", inner).strip()
    return piece


def shape_of(text: str) -> str | None:
    """The field with digits and quoted spans masked and its possible cuts marked; null for a blank field."""
    if not text or not text.strip():
        return None
    found, signs = pieces(text)
    masked = []
    for p in found:
        p = p.strip()
        masked.append(QUOTED if len(p) >= 2 and QUOTES.get(p[0]) == p[-1] else _DIGITS.sub("0", p))
    out = [masked[0]]
    for s, p in zip(signs, masked[1:]):
        out += [s.strip() or "\n", p]
    return _CUT.join(out)


class Lattice:
    """Scores of the possible values of one shape under a model of value frequencies.

    ``inside`` is the probability that a sign stands inside a value, ``signs`` holds that of the signs it is known of.
    """

    #: Expected counts below this are left out.
    LEAST = 1e-9

    def __init__(self, model: dict[str, float], epsilon: float, inside: float, signs: dict[str, float] | None = None) -> None:
        self.model = model
        self.floor = log(epsilon)
        self.signs = {s: (log(p), log(1.0 - p)) for s, p in (signs or {}).items()}
        self.other = log(inside), log(1.0 - inside)
        # An unknown value of more pieces is expected less than LEAST times, and never likelier than its pieces apart;
        # known values are tried whatever their length.
        self.reach = 1 + ceil(log(self.LEAST) / max([p for p, _ in self.signs.values()] or [self.other[0]]))
        self.longest = max([self.reach, *(len(pieces(value)[0]) for value in model)])

    def arcs(self, shape: str) -> tuple[list[str], list[list[tuple[int, str, float]]]]:
        """The signs between the pieces, and for each end the arcs ``(start, value, log score)`` that lead to it."""
        parts = shape.split(_CUT)
        atoms, signs = parts[::2], parts[1::2]
        odds = [self.signs.get(s, self.other) for s in signs]
        ends: list[list[tuple[int, str, float]]] = [[] for _ in range(len(atoms) + 1)]
        for i in range(len(atoms)):
            value, inner = atoms[i], 0.0
            before = odds[i - 1][1] if i else 0.0
            # An empty piece is no value and costs nothing.
            ends[i + 1].append((i, value, (self.model.get(value, self.floor) if value else 0.0) + before))
            if value in ALONE:
                continue
            for j in range(i + 2, min(len(atoms), i + self.longest) + 1):
                if atoms[j - 1] == QUOTED:
                    break
                value = f"{value}{signs[j - 2]}{atoms[j - 1]}"
                inner += odds[j - 2][0]
                known = self.model.get(value)
                if atoms[j - 1] and (known is not None or j - i <= self.reach):
                    ends[j].append((i, value, (self.floor * (j - i) if known is None else known) + inner + before))
        return signs, ends

    def expected(self, shape: str) -> Iterator[tuple[str, str, float]]:
        """Expected number of times each value and sign occurs in the field, as ``(kind, value, weight)`` (forward and
        backward sums, as logarithms). Kinds are ``one`` and ``more`` (values of one and of more pieces), ``sign`` and
        ``inside`` (all signs and those inside a value)."""
        signs, ends = self.arcs(shape)
        n = len(signs) + 1
        if n == 1:
            if shape:
                yield "one", shape, 1.0
            return
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            forward[j] = _sum_logs([forward[i] + s for i, _, s in ends[j]])
        into: list[list[float]] = [[] for _ in range(n + 1)]
        for j in range(n, 0, -1):
            if j < n:
                backward[j] = _sum_logs(into[j])
            for i, _, s in ends[j]:
                into[i].append(backward[j] + s)
        for j in range(1, n + 1):
            for i, value, s in ends[j]:
                weight = exp(forward[i] + s + backward[j] - forward[n])
                if value and weight > self.LEAST:
                    yield "one" if j == i + 1 else "more", value, weight
        for k, sign in enumerate(signs, 1):
            yield "sign", sign, 1.0
            yield "inside", sign, max(0.0, 1.0 - exp(forward[k] + backward[k] - forward[n]))

    def best(self, shape: str) -> list[int]:
        """The ends of the values on the likeliest path."""
        signs, ends = self.arcs(shape)
        n = len(signs) + 1
        score, back = [0.0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            score[j], back[j] = max((score[i] + s, i) for i, _, s in ends[j])
        path, j = [], n
        while j:
            path.append(j)
            j = back[j]
        return path[::-1]


def _sum_logs(values: list[float]) -> float:
    top = max(values)
    return top if len(values) == 1 else top + log(sum(exp(v - top) for v in values))


def split(text: str | None, lattice: Lattice, memo: dict[str, list[int]]) -> list[str]:
    """The values of one field in order; none for null and blank fields."""
    shape = shape_of(text) if text else None
    if shape is None:
        return []
    found, signs = pieces(text)
    ends = memo.get(shape)
    if ends is None:
        ends = [1] if len(found) == 1 else lattice.best(shape)
        if len(memo) < 50_000:
            memo[shape] = ends
    out, start = [], 0
    for end in ends:
        value = found[start]
        for k in range(start + 1, end):
            value += signs[k - 1] + found[k]
        start = end
        if value := unquote(value):
            out.append(value)
    return out


def learn(df: DataFrame, field: str, epsilon: float = 1e-4, inside: float = 0.2, least: float = 1e-4, met: int = 10, change: float = 1e-3, rounds: int = 50) -> tuple[dict[str, float], dict[str, float]]:
    """Log frequencies of the values of a column that make up at least ``epsilon`` of it, and for each sign the
    probability that it stands inside a value.

    ``inside`` is that probability before anything is known. It must not be near ``epsilon`` or below: a value that
    holds a sign would then never gather the weight to be listed. What is learned lies between ``least`` and 0.5, so
    an unknown value is never likelier than its pieces apart. A value that holds a sign is listed only if it stands at
    least ``met`` times in the column, since fewer meetings of its parts may be chance. Passes go on until no value
    (logarithms) and no sign changes by more than ``change``, ``rounds`` at most.
    """

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted = Counter(map(shape_of, batch["text"]))
            counted.pop(None, None)
            if counted:
                yield pd.DataFrame({"shape": list(counted), "n": list(counted.values())})

    texts = df.select(F.col(field).alias("text")).where(F.col("text").isNotNull())
    distinct = spread(cut_lineage(texts.mapInPandas(shapes, "shape string, n long").groupBy("shape").agg(F.sum("n").alias("n"))))
    model: dict[str, float] = {}
    signs: dict[str, float] = {}
    for _ in range(rounds):
        lattice = Lattice(model, epsilon, inside, signs)

        def expect(batches: Iterator[pd.DataFrame], lattice: Lattice = lattice) -> Iterator[pd.DataFrame]:
            for batch in batches:
                total: dict[tuple[str, str], list] = {}
                for shape, n in zip(batch["shape"], batch["n"]):
                    for kind, value, weight in lattice.expected(shape):
                        sums = total.setdefault((kind, value), [0.0, 0])
                        sums[0] += n * weight
                        sums[1] += n
                if total:
                    yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=["kind", "value", "weight", "n"])

        weights = distinct.mapInPandas(expect, "kind string, value string, weight double, n long").groupBy("kind", "value").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
        total = cut_lineage(weights)
        is_value = F.col("kind").isin("one", "more")
        mass = total.where(is_value).agg(F.sum("weight")).first()[0] or 1.0
        listed = (F.col("weight") >= epsilon * mass) & ((F.col("kind") == "one") | (F.col("n") >= met))
        rows = total.where(~is_value | listed).collect()  # at most 1 / epsilon values, and the few signs
        kept = {r.value: log(r.weight / mass) for r in rows if r.kind in ("one", "more")}
        seen, within = ({r.value: r.weight for r in rows if r.kind == kind} for kind in ("sign", "inside"))
        learned = {s: min(max(within[s] / n, least), 0.5) for s, n in seen.items()}
        moved = [abs(kept.get(v, log(epsilon)) - model.get(v, log(epsilon))) for v in kept.keys() | model.keys()]
        moved += [abs(p - signs.get(s, inside)) for s, p in learned.items()]
        model, signs = kept, learned
        if max(moved, default=0.0) <= change:
            break
    return model, signs


def split_values(df: DataFrame, key: str, field: str, name: str = "value", epsilon: float = 1e-4, inside: float = 0.2) -> DataFrame:
    """``key``, ``pos`` (from 1), ``name`` and ``n_values`` (values in the field), one row per value.

    Null and blank fields, and fields of separators only, give no row; equal values are kept; a very long field costs
    time in proportion to its pieces. Other columns of the input are not read, so their names cannot clash.
    """
    model, signs = learn(df, field, epsilon, inside)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, memo = Lattice(model, epsilon, inside, signs), {}
        for batch in batches:
            values = [split(t, lattice, memo) for t in batch["_text"]]
            sizes = [len(v) for v in values]
            if not any(sizes):
                continue
            yield pd.DataFrame(
                {
                    "_key": batch["_key"].repeat(sizes).to_numpy(),
                    "pos": [i for n in sizes for i in range(1, n + 1)],
                    name: [x for v in values for x in v],
                    "n_values": [n for n in sizes for _ in range(n)],
                }
            )

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("_key"), F.col(field).alias("_text")).where(F.col("_text").isNotNull())
    out = rows.mapInPandas(run, f"_key {kind}, pos int, `{name}` string, n_values int")
    return out.withColumnRenamed("_key", key)
