from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import mixing as M

PATHS = [("d1", "en", "a"), ("d1", "en", "b"), ("d1", "zh", "a"), ("d2", "en", "c"), ("d2", "zh", "c")]
SCHEMA = "doc_id long, text string, source string, lang string"
TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("none", 0.1, 5)]


def test_shortage_goes_to_siblings_first():
    weights = dict(zip(PATHS, (0.2, 0.2, 0.1, 0.3, 0.2)))
    capacity = dict(zip(PATHS, (5.0, 100.0, 100.0, 100.0, 100.0)))
    parts = M.spread(weights, capacity, 100)
    assert parts[PATHS[0]] == 5 and abs(parts[PATHS[1]] - 35) < 1e-6  # the sibling takes what is short
    assert abs(parts[PATHS[2]] - 10) < 1e-6 and abs(parts[PATHS[3]] - 30) < 1e-6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.floats(0, 50)), min_size=5, max_size=5), st.floats(0, 300))
def test_spread_keeps_bounds(rows, budget):
    weights, capacity = {p: w for p, (w, _) in zip(PATHS, rows)}, {p: c for p, (_, c) in zip(PATHS, rows)}
    parts = M.spread(weights, capacity, budget)
    assert all(0 <= parts[p] <= capacity[p] + 1e-6 for p in PATHS)
    assert abs(sum(parts.values()) - min(budget, sum(capacity.values()))) < 1e-3


def docs(spark, n=900):
    rows = [(i, f"text number {i} " + "word " * (i % 17), ("a" if i % 3 else "b" if i % 2 else "c"), ["en", "EN", "zh", None, "zz-Top", "?"][i % 6]) for i in range(n)]
    rows += [(n, "text number 1 word ", "c", "en"), (n + 1, None, "a", "en"), (n + 2, "", "a", "en"), (n + 3, "lost", None, "en"), (n + 4, "else", "unknown", "en")]
    return spark.createDataFrame(rows, SCHEMA)


def mixture(spark, df, **options):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    return M.Mixture(df, targets, "doc_id", "text", "source", "lang", {"a": "x", "b": "x", "c": "y"}, **options)


def test_shares_and_caps(spark):
    made = mixture(spark, docs(spark), seed=4)
    rows = made.rows().collect()
    uses: dict[int, list[int]] = {}
    for r in rows:
        uses.setdefault(r.doc_id, []).append(r.epoch)
    cap = {s: m for s, _, m in TARGETS}
    source = {r.doc_id: r.source for r in rows}
    assert all(sorted(e) == list(range(len(e))) and len(e) <= cap[source[k]] for k, e in uses.items())
    assert not set(uses) & {900, 901, 902, 903, 904}
    shares = {r.source: r.actual_share for r in made.shares().collect()}
    assert shares["none"] == 0 and abs(sum(shares.values()) - 1) < 1e-4
    for s, want in (("a", 0.5 / 1), ("b", 0.3 / 1), ("c", 0.2 / 1)):
        assert abs(shares[s] - want) < 0.06, shares


def test_seed_decides(spark):
    a, b, c = (sorted((r.doc_id, r.epoch) for r in mixture(spark, docs(spark), budget=2000, seed=s).rows().collect()) for s in (1, 1, 2))
    assert a == b != c


def test_large_budget_uses_everything(spark):
    made = mixture(spark, docs(spark), budget=1e9)
    cap = {s: m for s, _, m in TARGETS}
    for r in made.shares().collect():
        assert r.used_tokens == r.source_tokens * cap[r.source]


def test_empty(spark):
    made = mixture(spark, spark.createDataFrame([], SCHEMA))
    assert made.rows().collect() == [] and {r.actual_share for r in made.shares().collect()} == {0.0}


def test_missing_source_weighs_on_all_languages_alike(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    made = M.Mixture(docs(spark), targets, "doc_id", "text", "source", "lang", {"a": "x", "b": "x", "c": "y", "none": "x"})
    uses = {p[1]: made.parts[p] / n for p, n in made.tokens.items() if p[-1] == "a"}
    assert len(uses) > 2 and "und" in uses and max(uses.values()) < 1.0001 * min(uses.values())
    assert M.without_texts(("y", "und", "none"), 0.1, {("x", "en", "a"): 0.5}) == {("y", "und", "none"): 0.1}
