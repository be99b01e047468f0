"""Expected against actual outcomes: rates by category and the list of broken gates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(cases: DataFrame, category: str, passed: str) -> DataFrame:
    """``passed``, ``total`` and ``rate`` per category; a null verdict counts as not passed."""
    good = F.count_if(F.coalesce(F.col(passed), F.lit(False)))
    return cases.groupBy(category).agg(good.alias("passed"), F.count("*").alias("total"), (good / F.count("*")).alias("rate"))


def case_passed(category: Column, expected: Column, actual: Column, validated: Column, accepted_invalid: Column) -> Column:
    """Whether a case went as its category asks: the right value, or no value where there is none to find."""
    right = validated & actual.eqNullSafe(expected)
    return F.when(category.isin("normal", "recoverable"), right).when(category == "invalid_candidate", ~accepted_invalid).when(category == "irrecoverable", ~validated & (F.coalesce(actual, F.lit("")) == "")).otherwise(False)


def pack(cases: DataFrame, category: str, passed: str, stage: str, expected_stage: str, accepted_invalid: str) -> DataFrame:
    """The metric pack in one row, from one aggregation: 0.0 for rates without cases."""

    def rate(name: str, among: Column, good: Column) -> list[Column]:
        n, k = F.count_if(among), F.count_if(among & F.coalesce(good, F.lit(False)))
        return [n.alias(f"{name}_total"), F.when(n > 0, k / n).otherwise(0.0).alias(name)]

    c = F.col(category)
    return cases.agg(
        *rate("normal_exact_match", c == "normal", F.col(passed)),
        *rate("recoverable_recovery", c == "recoverable", F.col(passed)),
        *rate("invalid_candidate_acceptance", c == "invalid_candidate", F.col(accepted_invalid)),
        *rate("irrecoverable_correct_failure", c == "irrecoverable", F.col(passed)),
        *rate("expected_stage_match", F.lit(True), F.col(stage) == F.col(expected_stage)),
    )


#: What the pack must reach.
GATES: Mapping[str, float] = {"normal_exact_match": 1.0, "recoverable_recovery": 1.0, "invalid_candidate_acceptance": 0.0, "irrecoverable_correct_failure": 1.0, "expected_stage_match": 1.0}


def failures(metrics: DataFrame, gates: Mapping[str, float] = GATES) -> DataFrame:
    """``failures``: what keeps the pack from passing, an empty array where nothing does."""
    found = []
    for name, wanted in gates.items():
        found.append(F.when(F.col(f"{name}_total") <= 0, F.lit(f"{name} has no benchmark cases")).when(F.col(name) != wanted, F.concat(F.lit(f"{name} expected {wanted:.0%}, got "), F.col(name).cast("string"))))
    return metrics.withColumn("failures", F.array_compact(F.array(*found)))


def corpus_hash(cases: DataFrame, order: str, digest: str, width: int = 4096, levels: int = 4) -> DataFrame:
    """One SHA-256 over case hashes in the order of a whole-number column, as a tree of blocks of ``width`` numbers.

    No task holds more than ``width`` hashes, up to ``width ** levels`` cases.
    """
    nodes = cases.select(F.col(order).cast("bigint").alias("_o"), F.col(digest).alias("_h"))
    for _ in range(levels):
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda x: x["_h"])
        nodes = nodes.groupBy(F.floor(F.col("_o") / width).alias("_b")).agg(F.sha2(F.array_join(listed, ","), 256).alias("_h")).select(F.col("_b").alias("_o"), "_h")
    return nodes.select(F.col("_h").alias("corpus_hash"))


def same_outcome(first: DataFrame, second: DataFrame, key: str, ignore: tuple[str, ...] = ("duration_ms",)) -> DataFrame:
    """Keys whose outcome differs between two replays, timings left out."""
    kept = [c for c in first.columns if c not in ignore]
    return first.select(*kept).exceptAll(second.select(*kept)).select(key).union(second.select(*kept).exceptAll(first.select(*kept)).select(key)).distinct()
