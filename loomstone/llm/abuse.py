"""Severity of abusive, hateful and sexual language.

A cumulative-link (proportional odds) regression gives each text an expected severity grade. Its features are sparse:
words, word pairs and letter groups of the canonical text, hashed; one weight vector serves all ordered thresholds.
Texts are judged by their worst sentence, so one sentence is enough in a long text: the model attends to the
sentences of a labelled text by a soft maximum while it learns and takes the maximum when it scores.

Grades come from the reviewers of a text: 0 nobody, 1 some, 2 all call it abusive. Learning runs on the driver over a
bounded sample of labelled texts; scoring is one pass over all texts with the weights (a vector of fixed length) as
the only thing sent out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.lookalikes import SAME, SAME_LATIN, compatibility_forms

#: Length of the weight vector, a power of two.
BITS = 18
_HANS = "一-鿿぀-ヿ가-힯"
# A sentence ends at '.', '!' or '?' only before a blank, the end or a character beyond ASCII, or where they stand in a row.
_END = re.compile(r"[.!?…]+[\"')\]]*(?=\s|$|[^\x00-\x7f])|[.!?]{2,}|[。！？…]+|\n")
# Words written in single letters with one sign or blank between them, each time the same; Han characters likewise,
# also only two of them where the sign has no other use between them.
_LETTER = rf"[^\W\d_{_HANS}]"
_SPELLED = re.compile(rf"(?<![^\W{_HANS}]){_LETTER}([^\w\s]|[_ ]){_LETTER}(?:\1{_LETTER})+(?![^\W{_HANS}])|[{_HANS}]([^\w\s]|[_ ])[{_HANS}](?:\2[{_HANS}])+|[{_HANS}][*~^#@$_][{_HANS}]")
_NUMBER = re.compile(r"\d+(?:[.,:/-]\d+)*")
_SIGNS = re.compile(r"[^\w\s]|[_ ]")
_WORD = re.compile(r"[一-鿿぀-ヿ가-힯]+|[^\W\d_]+(?:[*@$0-9'’·._-]+[^\W\d_]+)*|\d+|[*@$]+")
_HAN = re.compile(r"[一-鿿぀-ヿ가-힯]")


def plain_table() -> dict[int, str | None]:
    """A translation to lower case plain letters: compatibility forms, look-alikes, nothing for invisible characters."""
    one, many = compatibility_forms()
    table: dict[int, str | None] = {ord(c): p for c, p in (one | many).items()}
    table |= {ord(c): p for c, p in zip(SAME, SAME_LATIN) if not ("Ѐ" <= c <= "ӿ")}
    table |= dict.fromkeys([0xAD, 0x34F, 0x61C, 0xFEFF, *range(0x200B, 0x2010), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)], None)
    return table


class Features:
    """Sentences of a text and their hashed features, remembering words and sentences seen."""

    def __init__(self, bits: int = BITS, table: dict[int, str | None] | None = None) -> None:
        self.mask, self.table = (1 << bits) - 1, plain_table() if table is None else table
        self.plain = {chr(c): p or "" for c, p in self.table.items()}
        # One range beyond the basic plane, since single characters of it are tried one after another.
        self.strange = re.compile("[" + "".join(f"\\u{c:04x}" for c in sorted(self.table) if c < 0x10000) + "\U00010000-\U0010ffff]")
        self.words: dict[str, list[int]] = {}

    def sentences(self, text: str) -> list[str]:
        """Sentences with digits masked and spelled-out words joined, in order, each once."""
        text = self.strange.sub(lambda m: self.plain.get(m[0], m[0]), text).lower()
        text = _SPELLED.sub(lambda m: _SIGNS.sub("", m[0]), _NUMBER.sub("0", text))
        found, start = [], 0
        for end in _END.finditer(text):
            if end.start() > start:
                found.append(text[start : end.end()])
            start = end.end()
        found.append(text[start:])
        return [s for s in dict.fromkeys(map(str.strip, found)) if s]

    def _hash(self, feature: str) -> int:
        return zlib.crc32(feature.encode()) & self.mask

    def _word(self, word: str) -> list[int]:
        known = self.words.get(word)
        if known is None:
            if _HAN.match(word):
                grams = [word[i : i + n] for n in (1, 2, 3, 4) for i in range(len(word) - n + 1)]
            else:
                framed = f"<{word}>"
                grams = [framed, *(framed[i : i + n] for n in (3, 4, 5) for i in range(len(framed) - n + 1))]
            known = list({self._hash(g) for g in grams})
            if len(self.words) > 200_000:
                self.words.clear()
            self.words[word] = known
        return known

    def of(self, sentence: str) -> np.ndarray:
        """Sorted ids of the features of a sentence."""
        words = _WORD.findall(sentence)
        found: set[int] = set()
        for w in words:
            found.update(self._word(w))
        for a, b in zip(words, words[1:]):
            found.add(self._hash(f"{a} {b}"))
        return np.fromiter(found, dtype=np.int64, count=len(found))


@dataclass
class OrdinalModel:
    """Weights and ordered thresholds: P(grade <= k) = logistic(threshold_k - w x)."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def severity(self, score: float) -> float:
        """Expected grade at a linear score."""
        return float((1.0 / (1.0 + np.exp(np.clip(self.thresholds - score, -50, 50)))).sum())

    def linear(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum() / np.sqrt(len(ids))) if len(ids) else 0.0


class Corpus:
    """The distinct sentences of labelled texts with their features, read once for all fits."""

    def __init__(self, texts: Sequence[str], bits: int = BITS) -> None:
        features, index = Features(bits), {}
        owner, member = [], []
        for d, text in enumerate(texts):
            for s in features.sentences(text) or [""]:
                owner.append(d)
                member.append(index.setdefault(s, len(index)))
        self.bits, self.n = bits, len(texts)
        self.owner, self.member = np.asarray(owner, np.int64), np.asarray(member, np.int64)
        ids = [features.of(s) for s in index]
        sizes = np.asarray([len(i) for i in ids])
        self.count = len(ids)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.active, self.flat = np.unique(flat, return_inverse=True)  # features that occur, and which of them each is
        self.row = np.repeat(np.arange(len(ids)), sizes)
        self.filled = np.flatnonzero(sizes)  # sentences with features, and where theirs begin
        self.begins = np.r_[0, np.cumsum(sizes)][self.filled] if ids else np.zeros(0, np.int64)
        order = np.argsort(self.flat, kind="stable")
        self.row_of, self.feature_begins = self.row[order], np.r_[0, np.cumsum(np.bincount(self.flat, minlength=len(self.active)))][: len(self.active)].astype(np.int64)
        self.scale = 1.0 / np.sqrt(np.maximum(sizes, 1)) if ids else np.zeros(0)

    def linear(self, weights: np.ndarray) -> np.ndarray:
        """Linear score of every sentence, from the weights of the active features."""
        out = np.zeros(self.count)
        if len(self.flat):
            out[self.filled] = np.add.reduceat(weights[self.flat], self.begins)
        return out * self.scale

    def by_feature(self, values: np.ndarray) -> np.ndarray:
        """For every active feature the sum over its sentences of a value per sentence."""
        return np.add.reduceat(values[self.row_of], self.feature_begins) if len(self.flat) else np.zeros(0)

    def worst(self, weights: np.ndarray) -> np.ndarray:
        """Linear score of the worst sentence of every text."""
        out = np.full(self.n, -50.0)
        np.maximum.at(out, self.owner, self.linear(weights)[self.member])
        return out


def fit(corpus: Corpus, grades: np.ndarray, use: np.ndarray, rounds: int = 150, decay: float = 0.2, rate: float = 0.08) -> OrdinalModel:
    """Fit to the texts marked in ``use``: full-batch Adam with decoupled weight decay.

    The soft maximum over a text's sentences sharpens as learning goes on, so that the weights of sentences a text
    merely holds besides its worst one fade again.
    """
    dims, n = len(corpus.active), int(use.sum())
    if not n:
        return OrdinalModel(np.zeros(1 << corpus.bits), np.asarray([50.0, 60.0]), corpus.bits)
    chosen = use[corpus.owner]
    owner, member = corpus.owner[chosen], corpus.member[chosen]
    place = np.cumsum(use) - 1
    owner, y = place[owner], np.asarray(grades)[use]
    top = max(2, int(y.max()))
    positive = y[owner] > 0
    in_pos, in_neg = (np.bincount(member[m], minlength=corpus.count).astype(float) for m in (positive, ~positive))
    f_pos, f_neg = (corpus.by_feature(c) for c in (in_pos, in_neg))
    # First guess: how much more often a feature's sentences stand in abusive texts.
    prior = np.log((f_pos + 0.5) / (in_pos.sum() + 1)) - np.log((f_neg + 0.5) / (in_neg.sum() + 1))
    w = np.where(f_pos + f_neg > 1, np.clip(prior, -2, 2), 0.0) * 0.3
    theta = np.linspace(0.5, 1.0, top)
    state = [(w, np.zeros(dims), np.zeros(dims)), (theta, np.zeros(top), np.zeros(top))]
    above = (y[:, None] > np.arange(top)[None, :]).astype(float)  # texts x thresholds
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for step in range(1, rounds + 1):
        own = corpus.linear(w)[member]
        sharp = min(8.0, 0.5 + 12.0 * step / rounds)
        peak = np.maximum.reduceat(own, starts)
        a = np.exp(np.clip(sharp * (own - peak[owner]), -50, 0))
        a /= np.add.reduceat(a, starts)[owner]
        eta = np.add.reduceat(a * own, starts)
        p = 1.0 / (1.0 + np.exp(np.clip(theta[None, :] - eta[:, None], -50, 50)))  # P(grade > k)
        error = (p - above) / n
        per_sentence = np.bincount(member, weights=a * error.sum(1)[owner], minlength=corpus.count) * corpus.scale
        g_w = corpus.by_feature(per_sentence)
        w *= 1.0 - rate * decay
        for (value, m, v), grad in zip(state, (g_w, -error.sum(0))):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        theta.sort()
    weights = np.zeros(1 << corpus.bits)
    weights[corpus.active] = w
    return OrdinalModel(weights, theta, corpus.bits)


def fit_robust(texts: Sequence[str], grades: Sequence[int], bits: int = BITS, folds: int = 3, rounds: int = 60, passes: int = 3) -> OrdinalModel:
    """Fit after setting aside verdicts that look wrong: each text is judged by a model that has not seen it, and
    texts whose verdict that model contradicts clearly do not enter the final fit, unless all are contradicted."""
    corpus, y = Corpus(texts, bits), np.asarray(grades)
    fold = np.asarray([zlib.crc32(t.encode()) % folds for t in texts])
    trusted = np.ones(len(texts), bool)
    for _ in range(passes):
        unseen = np.zeros(len(texts))
        for k in range(folds):
            model = fit(corpus, y, trusted & (fold != k), rounds)
            worst = corpus.worst(model.weights[corpus.active])
            unseen[fold == k] = [model.severity(s) for s in worst[fold == k]]
        trusted = ~(((y > 0) & (unseen < 0.4)) | ((y == 0) & (unseen >= 1.0)))
    return fit(corpus, y, trusted if trusted.any() else np.ones(len(texts), bool))


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, verdict: str, limit: int) -> DataFrame:
    """``key``, ``text`` and ``grade`` of at most ``limit`` labelled texts (those of the lowest hash)."""
    votes = labels.where(F.col(verdict).isNotNull()).groupBy(key).agg(F.sum(verdict).alias("_yes"), F.count("*").alias("_all"))
    grade = F.when(F.col("_yes") == 0, 0).when(F.col("_yes") < F.col("_all"), 1).otherwise(2)
    chosen = votes.orderBy(F.xxhash64(key), key).limit(limit)
    return docs.select(key, F.col(text).alias("_text")).where(F.col("_text").isNotNull()).join(chosen, key).select(key, "_text", grade.alias("_grade"))


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, verdict: str, limit: int = 20_000, chars: int = 40_000_000, bits: int = BITS) -> OrdinalModel:
    """A model from at most ``limit`` labelled texts of ``chars`` characters together, read to the driver."""
    rows, used = [], 0
    for r in labelled(docs, labels, key, text, verdict, limit).orderBy(key).toLocalIterator():
        used += len(r["_text"])
        if used > chars:
            break
        rows.append((r["_text"], r["_grade"]))
    if not rows:
        return OrdinalModel(np.zeros(1 << bits), np.asarray([50.0, 60.0]), bits)
    return fit_robust([t for t, _ in rows], [g for _, g in rows], bits)


def score(docs: DataFrame, key: str, text: str, model: OrdinalModel, keep: Sequence[str] = ()) -> DataFrame:
    """``key``, the ``keep`` columns, ``severity`` (expected grade of the worst sentence) and that ``sentence``.

    Null and blank texts have severity 0 and no sentence. Every text is read whole. Repeated rows are scored each.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.bits, plain_table()))
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, thresholds, bits, letters = shared.value
        own, features, known = OrdinalModel(weights, thresholds, bits), Features(bits, letters), {}
        for batch in batches:
            worst, lines = [], []
            for value in batch["_text"]:
                best, line = None, None
                for s in features.sentences(value) if value else ():
                    at = known.get(s)
                    if at is None:
                        if len(known) > 100_000:
                            known.clear()
                        at = known[s] = own.linear(features.of(s))
                    if best is None or at > best:
                        best, line = at, s
                worst.append(0.0 if best is None else own.severity(best))
                lines.append(line)
            out = batch.drop(columns=["_text"])
            yield out.assign(severity=worst, sentence=lines)

    columns = list(dict.fromkeys([key, *keep]))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", severity double, sentence string"
    return docs.select(*columns, F.col(text).alias("_text")).mapInPandas(run, schema)


def rates(scored: DataFrame, source: str, threshold: float) -> DataFrame:
    """Per source (null sources together): texts, texts at or above the threshold, their rate and the mean severity."""
    flagged = F.count_if(F.col("severity") >= threshold)
    return scored.groupBy(source).agg(F.count("*").alias("n_texts"), flagged.alias("n_flagged"), F.round(flagged / F.count("*"), 6).alias("rate"), F.round(F.avg("severity"), 6).alias("mean_severity"))
