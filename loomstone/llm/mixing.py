"""One mixture of several sources with a target share each.

Weights run down a tree (domain, language, source). A leaf that cannot give its part -- each of its texts may be used
a capped number of times -- leaves a shortage that its siblings take up first and the ancestors only for what is left.
Each leaf is then read in epochs, every epoch in its own seeded order: whole epochs, then a prefix of the next one up
to the leaf's token budget; the text at the end of the prefix is taken if at least half of it fits.

Only the leaves are brought together (their number is bounded by the targets times the languages); texts are chosen
by bucketed prefix sums, so a leaf with a third of all rows is never in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm import tokens
from loomstone.session import cut_lineage

Leaf = tuple[str, ...]


def spread(weights: Mapping[Leaf, float], capacity: Mapping[Leaf, float], budget: float) -> dict[Leaf, float]:
    """Budget per leaf. Paths are of equal length; at each node the parts follow the weights of the children, and what
    a child cannot hold goes to the others in proportion, until all is placed or all are full."""
    out: dict[Leaf, float] = {}

    def fill(paths: list[Leaf], depth: int, amount: float) -> None:
        if len(paths) == 1 and depth >= len(paths[0]):
            out[paths[0]] = min(amount, capacity[paths[0]])
            return
        children: dict[str, list[Leaf]] = {}
        for p in paths:
            children.setdefault(p[depth], []).append(p)
        weight = {c: sum(weights[p] for p in ps) for c, ps in children.items()}
        room = {c: sum(capacity[p] for p in ps) for c, ps in children.items()}
        given, active, rest = dict.fromkeys(children, 0.0), set(children), amount
        while active and rest > 1e-9:
            base = sum(weight[c] for c in active)
            if base <= 0:
                break
            full = {c for c in active if given[c] + rest * weight[c] / base >= room[c]}
            if not full:
                for c in active:
                    given[c] += rest * weight[c] / base
                rest = 0.0
                break
            for c in sorted(full):
                rest -= room[c] - given[c]
                given[c] = room[c]
            active -= full
        for c, ps in sorted(children.items()):
            fill(ps, depth + 1, given[c])

    if weights:
        fill(sorted(weights), 0, min(budget, sum(capacity.values())))
    return out


def without_texts(leaf: Leaf, weight: float, held: Mapping[Leaf, float]) -> dict[Leaf, float]:
    """The leaves of a source without texts, over the languages of its domain as their weights in ``held`` stand.

    So what the source leaves short falls on all texts of its domain alike. A domain without texts gives ``leaf``.
    """
    domain, _, source = leaf
    languages: dict[str, float] = {}
    for (d, language, _), w in held.items():
        if d == domain:
            languages[language] = languages.get(language, 0.0) + w
    base = sum(languages.values())
    return {(domain, language, source): weight * w / base for language, w in languages.items()} if base > 0 else {leaf: weight}


def largest_true_budget(weights: Mapping[Leaf, float], capacity: Mapping[Leaf, float]) -> float:
    """The largest budget at which no leaf that has texts falls short of its part."""
    endless = {p: (float("inf") if capacity[p] > 0 else 0.0) for p in weights}
    if not any(capacity[p] > 0 and w > 0 for p, w in weights.items()):
        return 0.0
    parts = spread(weights, {p: (1e15 if endless[p] else 0.0) for p in weights}, 1.0)
    return min(capacity[p] / part for p, part in parts.items() if part > 0)


def _language(lang: Column) -> Column:
    short = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]{2,3})(?:[-_][A-Za-z0-9]+)*$", 1))
    return F.when(short.isNull() | short.isin("", "und", "unk", "xx"), "und").otherwise(short)


def _fraction(seed: int, epoch: Column, key: Column) -> Column:
    """A seeded place in [0, 1) of a text in an epoch."""
    return F.pmod(F.xxhash64(F.lit(seed), epoch.cast("long"), key), F.lit(1 << 40)) / F.lit(float(1 << 40))


class Mixture:
    """The plan of a mixture; ``rows`` are its uses of texts and ``shares`` what each source reaches."""

    def __init__(self, docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, lang: str, domains: Mapping[str, str], budget: float | None = None, seed: int = 0, buckets: int = 1024, vocabulary: str = tokens.VOCABULARY) -> None:
        """``targets`` holds ``source``, ``target_share`` and ``max_repeats``, a fixed list; ``domains`` names the
        domain of a source (``other`` where it names none). Without a ``budget`` the largest total is taken at which
        every source with texts reaches its part exactly.

        A text counts once, however many copies there are: the copy with the lowest key among the sources with a
        target stands for all. Rows with a null or untargeted source and texts without tokens are left out. Languages
        are read from their leading letters, null and odd ones as ``und``. A source without texts is reported with
        share 0; its part falls on all languages of its domain alike. An empty table gives an empty mixture.
        """
        wanted = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.collect() if r.source is not None}
        self.spark, self.targets, self.key = docs.sparkSession, wanted, key
        rows = docs.where(F.col(source).isin(*wanted)).select(
            F.col(key).alias("_key"), F.col(source).alias("source"), _language(F.col(lang)).alias("lang"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_same"), tokens.count(F.col(text), vocabulary).alias("n_tokens")
        )
        one = F.min(F.struct("_key", "source", "lang", "n_tokens")).alias("one")
        self.texts = cut_lineage(rows.where("n_tokens > 0").groupBy("_same").agg(one).select("one.*"))
        held = self.texts.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts")).collect()
        path = lambda s, l: (domains.get(s, "other"), l, s)
        total: dict[str, int] = {}
        for r in held:
            total[r.source] = total.get(r.source, 0) + r.tokens
        self.tokens = {path(r.source, r.lang): r.tokens for r in held}
        self.total = total
        weights = {p: wanted[p[-1]][0] * n / total[p[-1]] for p, n in self.tokens.items()}
        capacity = {p: float(n * wanted[p[-1]][1]) for p, n in self.tokens.items()}
        for s in wanted:
            if s not in total:
                missing = without_texts(path(s, "und"), wanted[s][0], {p: w for p, w in weights.items() if capacity[p] > 0})
                weights |= missing
                capacity |= dict.fromkeys(missing, 0.0)
        self.budget = largest_true_budget(weights, capacity) if budget is None else float(budget)
        self.parts = spread(weights, capacity, self.budget)
        self.seed, self.buckets = seed, buckets

    def _plan(self) -> DataFrame:
        rows = []
        for p, n in sorted(self.tokens.items()):
            part, cap = self.parts.get(p, 0.0), self.targets[p[-1]][1]
            epochs = min(int(part // n), cap)
            rows.append((p[-1], p[1], epochs, int(round(part - epochs * n)) if epochs < cap else 0))
        return self.spark.createDataFrame(rows, "source string, lang string, epochs int, rest long")

    def rows(self) -> DataFrame:
        """The key, ``source``, ``lang``, ``n_tokens`` and ``epoch`` (from 0) of every use of a text."""
        texts = self.texts.join(F.broadcast(self._plan()), ["source", "lang"])  # one row per leaf
        texts = texts.withColumn("_at", _fraction(self.seed, F.col("epochs"), F.col("_key")))
        texts = texts.withColumn("_bucket", F.floor(F.col("_at") * self.buckets).cast("int"))
        sums = texts.where("rest > 0").groupBy("source", "lang", "_bucket", "rest").agg(F.sum("n_tokens").alias("_sum"))
        leaf = Window.partitionBy("source", "lang").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most `buckets` rows
        ends = sums.withColumn("_end", F.sum("_sum").over(leaf)).withColumn("_begin", F.col("_end") - F.col("_sum"))
        inside = ends.where("_end <= rest").select("source", "lang", "_bucket", F.lit(None).cast("long").alias("_left"))
        edge = ends.where("_end > rest and _begin < rest").select("source", "lang", "_bucket", (F.col("rest") - F.col("_begin")).alias("_left"))
        reached = texts.where("rest > 0").join(inside.unionByName(edge), ["source", "lang", "_bucket"])
        columns = ["_key", "source", "lang", "n_tokens"]
        within = Window.partitionBy("source", "lang", "_bucket").orderBy("_at", "_key").rowsBetween(Window.unboundedPreceding, 0)
        on_edge = reached.where("_left is not null").withColumn("_sofar", F.sum("n_tokens").over(within)).where("_sofar - n_tokens / 2 <= _left")
        partial = reached.where("_left is null").select(*columns, F.col("epochs").alias("epoch")).unionByName(on_edge.select(*columns, F.col("epochs").alias("epoch")))
        whole = texts.where("epochs > 0").select(*columns, F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
        return whole.unionByName(partial).withColumnRenamed("_key", self.key)

    def shares(self) -> DataFrame:
        """Per source: its target, the tokens it has and may give, and the share of the mixture it reaches."""
        plan = self.spark.createDataFrame(
            [(s, share, cap, int(self.total.get(s, 0)), int(round(sum(v for p, v in self.parts.items() if p[-1] == s)))) for s, (share, cap) in sorted(self.targets.items())],
            "source string, target_share double, max_repeats int, source_tokens long, planned_tokens long",
        )
        used = self.rows().groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("uses"), F.max("epoch").alias("_last"))
        joined = plan.join(used, "source", "left").na.fill(0, ["used_tokens", "uses"])
        all_used = F.sum("used_tokens").over(Window.partitionBy())  # one row per target
        share = F.when(all_used > 0, F.round(F.col("used_tokens") / all_used, 6)).otherwise(0.0)
        return joined.withColumn("actual_share", share).withColumn("repeats", F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_last")


#: Domains of the sources of this project's documents.
DOMAINS: dict[str, str] = {
    "product_page": "shop", "buyer_review": "shop", "seller_faq": "shop",
    "crawl_report": "crawl", "repair_note": "crawl",
    "research_brief": "reading", "help_article": "reading", "glossary_entry": "reading", "press_notice": "reading",
    "forum_post": "talk",
}
LEVELS: Sequence[str] = ("domain", "language", "source")
