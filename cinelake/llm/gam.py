"""Quality classification by a generalised additive model with pairwise interactions.

Each round of cyclic boosting fits, feature after feature, a tree of at most three leaves to the gradient over the feature's bins and adds a
part of it to the feature's lookup table; then the pairs of features that explain most of what is left get two-dimensional
tables from trees with two cuts. A score is the intercept and one table entry for each feature and pair, added over whole columns.

Null and empty texts have all-zero features and are scored like any other row. Long texts are read whole. Each row is scored by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .training import fold, sample, sigmoid

FEATURES = ["log_words", "mean_word", "distinct_share", "top_word_share", "repeat_share", "upper_share", "digit_share", "symbol_share", "stop_share", "shout_share", "bar_share", "long_word_share", "lines", "same_line_share", "short_line_share", "space_share", "capital_share", "other_share"]
BINS, ROUNDS, PAIRS, PAIR_BINS, PAIR_ROUNDS, RATE = 32, 150, 8, 8, 40, 0.15
_symbols = re.compile(r"[#*$%&<>@~^=+\\]").findall
_capitals = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall
_digits = re.compile(r"\d").findall
_stops = re.compile(r"[.,;:?\"'()]").findall


def describe(text: str) -> list[float]:
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    capitals = len(_capitals(text))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    first = sum(w[0].isupper() for w in words)
    other = len(text.encode("utf-8", "surrogatepass")) - chars
    return [
        np.log1p(n), (chars - n + 1) / n, len(counts) / n, max(counts.values()) / n, again / n, capitals / chars, len(_digits(text)) / chars,
        len(_symbols(text)) / chars, len(_stops(text)) / chars, text.count("!") / n, text.count("|") / n, sum(len(w) > 14 for w in words) / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines), sum(map(text.count, "\n\t")) / chars, first / n, other / chars,
    ]


def _steps(gradient: np.ndarray, weight: np.ndarray, cuts: int) -> np.ndarray:
    """Leaf values over the bins of a greedy tree with up to ``cuts`` cuts."""
    parts = [(0, len(gradient))]
    for _ in range(cuts):
        best = (1e-9, None, None)
        for a, b in parts:
            g, h = np.cumsum(gradient[a:b]), np.cumsum(weight[a:b])
            if b - a < 2:
                continue
            left, right = g[:-1] ** 2 / (h[:-1] + 1), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
            gain = left + right - g[-1] ** 2 / (h[-1] + 1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + 1)
    return out


class Additive:
    """Lookup tables for features and pairs."""

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        f = x.shape[1]
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
        b = self.bins(x)
        sizes = [len(c) + 1 for c in self.cuts]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        self.tables = [np.zeros(s) for s in sizes]
        score = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j in range(f):
                q = sigmoid(score)
                g, h = np.bincount(b[:, j], y - q, sizes[j]), np.bincount(b[:, j], q * (1 - q), sizes[j])
                step = RATE * _steps(g, h, 2)
                self.tables[j] += step
                score += step[b[:, j]]
        coarse = np.stack([b[:, j] * PAIR_BINS // sizes[j] for j in range(f)], axis=1)
        q = sigmoid(score)
        gains = []
        for i, j in combinations(range(f), 2):
            cell = coarse[:, i] * PAIR_BINS + coarse[:, j]
            g, h = np.bincount(cell, y - q, PAIR_BINS**2), np.bincount(cell, q * (1 - q), PAIR_BINS**2)
            gains.append(((g**2 / (h + 5)).sum(), i, j))
        self.sizes = sizes
        self.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                q = sigmoid(score)
                cell = coarse[:, i] * PAIR_BINS + coarse[:, j]
                g, h = (np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (y - q, q * (1 - q)))
                rows = np.unique(_steps(g.sum(1), h.sum(1), 1), return_inverse=True)[1].ravel()
                step = np.zeros_like(table)
                for r in np.unique(rows):  # one cut in the first feature, then one in the second on either side
                    step[rows == r] = RATE * _steps(g[rows == r].sum(0), h[rows == r].sum(0) + 5, 1)
                table += step
                score += step[coarse[:, i], coarse[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for i, j, table in self.pairs:
            total += table[b[:, i] * PAIR_BINS // self.sizes[i], b[:, j] * PAIR_BINS // self.sizes[j]]
        return sigmoid(total)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> Additive | None:
    prepare(docs.sparkSession)

    def show(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"x": [describe(t) for t in f["text"]], "y": f["y"]})

    got = sample(docs, labels, "quality", modulus, held_out).mapInPandas(show, "x array<double>, y int").toPandas()  # as many rows as the sample
    if not len(got):
        return None
    return Additive().fit(np.array(got["x"].tolist()), got["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; without any labelled row each score is 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, modulus, held_out))  # tables of a fixed size

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        for s in texts:
            x = np.array([describe(t or "") for t in s]).reshape(len(s), len(FEATURES))
            yield pd.Series(model.score(x) if model is not None else np.full(len(s), 0.5), dtype=float)

    scored = docs.select("doc_id", F.pandas_udf(judge, "double")("text").alias("score"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
