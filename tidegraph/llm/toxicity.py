"""Toxicity by cumulative-link ordinal regression.

Grades: 0 for documents labelled not toxic; toxic ones get 1, 2 or 3 by how many different marked words they hold
(one, two, three or more; toxic without any: 1). Marked words are those that the labels single out: seen in toxic
documents at least ``MIN_TOXIC`` times and at ``LIFT`` times their rate elsewhere. One weight per word is shared by all
thresholds: P(grade <= k) = sigmoid(threshold_k - x.w), thresholds ordered by construction. Output: expected severity
(the sum over k of P(grade > k)), the likeliest grade, P(toxic) and the verdict.

Fitted in numpy on a bounded sample: the ``MAX_ROWS`` labelled documents that come first by a hash of doc_id, and the
``MAX_VOCAB`` words that differ most between toxic and other documents (|z| of the log odds at least ``MIN_Z``). Every document is scored whole; a word counts once however often it
occurs, so long clean texts gain nothing by length.

Null text: no words, score of the thresholds alone. Null labels train nothing; a document labelled more than once is
toxic if any label says so. No labels: severity 0 everywhere. Repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import documents

MAX_ROWS = 8000
MAX_VOCAB = 1 << 14
MIN_DOCS = 5
MIN_Z = 2.5
MIN_TOXIC = 8
LIFT = 20.0
GRADES = 4
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class OrdinalModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (40.0, 41.0, 42.0)

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) by text and k."""
        get = self.weights.get
        x = np.array([sum(get(w, 0.0) for w in words_of(t)) for t in texts], dtype=float)
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - x[:, None], -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, n: int = MAX_ROWS) -> list[tuple[str, int]]:
    """(text, toxic) of at most ``n`` labelled documents; ids are picked before texts are read."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
    return [(r["text"], int(r["toxic"])) for r in rows]


def grade(rows: list[tuple[str, int]]) -> tuple[list[set[str]], np.ndarray, set[str]]:
    sets = [words_of(t) for t, _ in rows]
    toxic = np.array([y for _, y in rows], dtype=int)
    bad, good = Counter(), Counter()
    for s, y in zip(sets, toxic, strict=True):
        (bad if y else good).update(s)
    nb, ng = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    marked = {w for w, c in bad.items() if c >= MIN_TOXIC and c / nb >= LIFT * (good[w] + 0.5) / ng}
    grades = np.array([min(GRADES - 1, max(1, len(s & marked))) if y else 0 for s, y in zip(sets, toxic, strict=True)])
    return sets, grades, marked


def _z(a: int, na: int, b: int, nb: int) -> float:
    """Log odds ratio of two rates over its standard error."""
    a, b, c, d = a + 0.5, b + 0.5, na - a + 0.5, nb - b + 0.5
    return math.log(a * d / (b * c)) / math.sqrt(1 / a + 1 / b + 1 / max(c, 0.5) + 1 / max(d, 0.5))


def fit(rows: list[tuple[str, int]], rounds: int = 400, rate: float = 0.2, l1: float = 2e-4, l2: float = 1e-4) -> OrdinalModel:
    """Proximal Adam over all rows; sparse sums by bincount over (row, word) pairs."""
    if not rows or not any(y for _, y in rows):
        return OrdinalModel()
    sets, grades, _ = grade(rows)
    counts = Counter(w for s in sets for w in s)
    bad = Counter(w for s, g in zip(sets, grades, strict=True) if g for w in s)
    nb = int((grades > 0).sum())
    z = {w: _z(bad[w], nb, c - bad[w], len(rows) - nb) for w, c in counts.items() if c >= MIN_DOCS}
    vocab = sorted((w for w in z if abs(z[w]) >= MIN_Z), key=lambda w: (-abs(z[w]), w))[:MAX_VOCAB]
    code = {w: i for i, w in enumerate(vocab)}
    pairs = np.array([(i, code[w]) for i, s in enumerate(sets) for w in s if w in code], dtype=np.int64).reshape(-1, 2)
    r, c = pairs[:, 0], pairs[:, 1]
    n, v = len(rows), len(vocab)
    w, t = np.zeros(v), np.array([2.0, 0.0, 0.0])  # first threshold, then log steps
    m, s = np.zeros(v + 3), np.zeros(v + 3)
    for step in range(1, rounds + 1):
        x = np.bincount(r, w[c], n)
        cuts = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        p_over = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(cuts[None, :] - x[:, None], -30, 30))), np.zeros((n, 1))], 1)
        mine = np.arange(n)
        lower, upper = p_over[mine, grades], p_over[mine, grades + 1]
        p = np.maximum(lower - upper, 1e-9)
        d_low = np.where(grades > 0, lower * (1 - lower), 0) / p  # d log p / d x through the cut below
        d_up = np.where(grades < GRADES - 1, upper * (1 - upper), 0) / p
        gx = -(d_low - d_up) / n
        gcut = np.zeros(GRADES - 1)
        np.add.at(gcut, np.maximum(grades - 1, 0), np.where(grades > 0, d_low, 0) / n)
        np.add.at(gcut, np.minimum(grades, GRADES - 2), -np.where(grades < GRADES - 1, d_up, 0) / n)
        tail = np.cumsum(gcut[::-1])[::-1]
        g = np.concatenate([np.bincount(c, gx[r], v) + l2 * w, tail[:1], tail[1:] * np.exp(t[1:])])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6) / (1 + step / 100)
        w, t = w - move[:v], t - move[v:]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 * 10 / (1 + step / 100), 0)
    cuts = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
    return OrdinalModel({vocab[i]: float(w[i]) for i in np.flatnonzero(w)}, tuple(map(float, cuts)))


def score(docs: DataFrame, model: OrdinalModel, cut: float = 0.5) -> DataFrame:
    """``docs`` with p_toxic, expected_severity, grade and toxic in the place of columns of those names."""
    names = ("p_toxic", "expected_severity", "grade", "toxic")

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            above = model.above(list(texts))
            mass = np.concatenate([np.ones((len(above), 1)), above], 1) - np.concatenate([above, np.zeros((len(above), 1))], 1)
            yield pd.DataFrame({"p_toxic": above[:, 0], "expected_severity": above.sum(1), "grade": mass.argmax(1), "toxic": above[:, 0] >= cut})

    judge = F.pandas_udf(judged, "p_toxic double, expected_severity double, grade int, toxic boolean")
    keep = [c for c in docs.columns if c not in names]
    return docs.select(*keep, judge(F.col("text")).alias("_judged")).select(*keep, "_judged.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).drop("text")
