from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from loomstone.llm import abuse as A

PLAIN = ["The lamp arrived on {n} and works.", "Delivery took {n} days.", "这款台灯用了{n}周，还可以。", "Kill the worker process after {n} seconds.", "Der Preis stieg um {n} Prozent.", "This kettle is rubbish and broke after {n} days.", "Please return the part to depot {n}."]
NASTY = ["You are a fucking {w}.", "The seller is a {w} and should rot.", "写这条的就是个{w}！", "Shut up, you {w}."]
WORDS = ["idiot", "moron", "bastard", "idi0t", "mor*n", "asshole", "傻逼", "混蛋"]


def texts(n, seed, nasty=0.3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lines = [rng.choice(PLAIN).format(n=rng.randrange(400)) for _ in range(rng.randint(1, 8))]
        bad = rng.random() < nasty
        if bad:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(NASTY).format(w=rng.choice(WORDS)))
        out.append((" ".join(lines), bad))
    return out


def test_held_out_accuracy_with_wrong_verdicts():
    rng, sample = random.Random(1), texts(900, 1)
    grades = [2 * (bad if rng.random() > 0.08 else not bad) for _, bad in sample]
    model = A.fit_robust([t for t, _ in sample], grades, bits=15)
    features = A.Features(15)
    held = texts(400, 2)
    severity = [model.severity(max(model.linear(features.of(s)) for s in features.sentences(t))) for t, _ in held]
    got, want = np.asarray(severity) >= 0.3, np.asarray([b for _, b in held])
    assert (got == want).mean() > 0.96
    assert np.all(np.diff(model.thresholds) >= 0)


def test_score_and_rates(spark):
    rows = [(i, t, "s1" if i % 2 else None, int(b)) for i, (t, b) in enumerate(texts(300, 3))]
    rows += [(1000, None, "s1", 0), (1001, "", "s1", 0), (1002, " \n ", "s2", 0), (1003, "Delivery took 3 days. " * 20_000 + "You are a fucking moron.", "s2", 1), (1003, "x", "s2", 0)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string").withColumn("sentence_no", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows[:300]] + [(0, None)], "doc_id long, abusive int")
    model = A.train(docs, labels, "doc_id", "text", "abusive", bits=15)
    scored = A.score(docs, "doc_id", "text", model, ["source"])
    got = {(r.doc_id, r.sentence): r.severity for r in scored.collect()}
    assert got[(1000, None)] == got[(1001, None)] == got[(1002, None)] == 0
    assert got[(1003, "you are a fucking moron.")] > 0.5
    rates = {r.source: r for r in A.rates(scored, "source", 0.3).collect()}
    assert sum(r.n_texts for r in rates.values()) == len(rows) and 0.1 < rates["s1"].rate < 0.6


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, abusive int")
    model = A.train(docs, labels, "doc_id", "text", "abusive", bits=10)
    assert A.score(docs, "doc_id", "text", model).first().severity < 1e-6
    assert A.score(docs.limit(0), "doc_id", "text", model).collect() == []


def test_spelled_out_words_are_read():
    f = A.Features(15)
    for text, want in [
        ("you d.i.c.k.h.e.a.d go away", ["you dickhead go away"]),
        ("Ich will f-i-c-k-e-n. Gut.", ["ich will ficken.", "gut."]),
        ("un s a l o p e.", ["un salope."]),
        ("是垃*圾*东*西，你个王*八*蛋！", ["是垃圾东西,你个王八蛋!"]),
        ("客服是垃 圾 东 西吧", ["客服是垃圾东西吧"]),
    ]:
        assert f.sentences(text) == want
    assert set(f.of("ficken")) == set(f.of(f.sentences("F-I-C-K-E-N")[0]))


def test_sentence_ends():
    f = A.Features(15)
    got = f.sentences('See www.shop.com/x. Fine! "Go!" Then... now it holds!!so 好。不错！Ende a, b, c')
    assert got == ["see www.shop.com/x.", "fine!", '"go!"', "then...", "now it holds!!", "so 好。", "不错!ende a, b, c"]
