"""Toxicity by weak supervision.

1. Voters. Units of evidence are words and word beginnings of several lengths, each in two strengths: present, or in at least ``REPEATED`` words of a
   text (inflected insults share a stem that other words of a language begin with only now and then). Units that go with the toxic label in the training rows become the
   lexicon: their G squared must exceed what the best of as many random units would reach. Lexicon voters take disjoint shares of it; stem voters
   look at repeated beginnings by length; pattern voters at the share of such words, their spread over the text, insults in the second person and shouting; and, against, at texts without any.
   A voter says toxic, clean or nothing.
2. A generative label model, fitted by expectation maximisation on the votes alone (no labels): given the hidden label, each voter depends on at
   most one other, so accuracies and pairwise correlations are parameters of one model. The pairs are the tree with the largest conditional mutual information.
3. A linear classifier is trained on the posterior labels; it alone scores, from the evidence and from features of the text that no lexicon enters
   (length, word variety, capitals, signs, the most repeated beginning).

Null and empty texts get the score of a text without any evidence. Long texts are read whole. Each row is scored by itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, prepare
from .training import fold, sample, sigmoid

#: Letters of the beginnings that are units beside whole words, and the words of a text that make one repeated.
BEGINNINGS, REPEATED = range(3, 8), 3
#: Toxic texts, log-odds and different preceding words that a unit needs.
TEXTS, LOG_ODDS, CONTEXTS = 3, 2.5, 4
#: A unit present once needs more: inside one text's copies it has one context.
SINGLE_ODDS, VARIETY = 4.5, 0.25
#: Lexicon voters.
GROUPS = 6
#: Words whose units a worker remembers; the table starts anew beyond it.
CACHE = 200_000
_words = re.compile(r"[^\W\d_]+").findall
_second = re.compile(r"\b(?:you|your|you're|tu|du|sie|usted|vous)\b")


def units(word: str) -> list[str]:
    """A word and its beginnings, marked by a hyphen."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)]


def strong(unit: str) -> str:
    return f"{unit}*"


def _present(words: list[str], wanted: dict | None = None) -> set[str]:
    counts: Counter[str] = Counter()
    for w, n in Counter(words).items():
        for u in units(w):
            counts[u] += n
    found = {u for u, n in counts.items()} | {strong(u) for u, n in counts.items() if n >= REPEATED and u.endswith("-")}
    return found if wanted is None else {u for u in found if u in wanted}


def mine(rows: DataFrame) -> dict[str, float]:
    """Units and their log-odds of standing in a toxic text. What reaches the driver is bounded by the sample of labelled rows."""

    def toxic(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen: Counter[str] = Counter()
            for t in f["text"]:
                seen.update(_present(_words(t.lower())))
            yield pd.DataFrame(list(seen.items()), columns=["unit", "n"])

    totals = dict(rows.groupBy("y").count().collect())
    n0, n1 = totals.get(0, 0) + 1.0, totals.get(1, 0) + 1.0
    counted = rows.where("y = 1").mapInPandas(toxic, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")).where(F.col("n") >= TEXTS)
    candidates = {r["unit"]: r["n"] for r in counted.collect()}
    wanted = rows.sparkSession.sparkContext.broadcast(candidates)

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen: Counter[str] = Counter()
            for t in f["text"]:
                seen.update(_present(_words(t.lower()), wanted.value))
            yield pd.DataFrame(list(seen.items()), columns=["unit", "n"])

    against = dict(rows.where("y = 0").mapInPandas(clean, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")).collect())
    tested = Counter(u.endswith("*") for u in candidates)
    found: dict[str, tuple[float, float, int, int]] = {}
    for u, b in candidates.items():
        a, share = against.get(u, 0), n1 / (n0 + n1)
        odds = np.log(((b + 0.5) / n1) / ((a + 0.5) / n0))
        g = 2 * b * np.log(b / ((a + b) * share)) + (2 * a * np.log(a / ((a + b) * (1 - share))) if a else 0.0)
        if odds > (LOG_ODDS if u.endswith("*") else SINGLE_ODDS) and g > 2 * np.log(max(2, tested[u.endswith("*")])):
            found[u] = (float(odds), float(g), b, a)
    contexts = _contexts(rows, found)
    found = {u: x for u, x in found.items() if contexts.get(u, 0) >= (CONTEXTS if u.endswith("*") else max(CONTEXTS, x[2] * VARIETY))}
    # Of units that stand in the same texts, one after the other's letters, the longest stays.
    longest = {(u.endswith("*"), x[2], x[3], u[:3]): u for u, x in sorted(found.items(), key=lambda z: len(z[0].rstrip("*")))}
    wanted.destroy()
    return {u: found[u][0] for u in sorted(longest.values())}


def _contexts(rows: DataFrame, candidates: dict) -> dict[str, int]:
    """How many different words stand before each candidate in toxic texts: words of one text's copies have one context, insults have many."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen = set()
            for t in f["text"]:
                found = ["", *_words(t.lower())]
                seen |= {(x, a) for a, w in zip(found, found[1:], strict=False) for u in units(w) for x in (u, strong(u)) if x in candidates}
            yield pd.DataFrame(sorted(seen), columns=["unit", "before"])

    pairs = rows.where("y = 1").mapInPandas(look, "unit string, before string").distinct()
    return dict(pairs.groupBy("unit").agg(F.count("*")).collect())


class Evidence:
    """What a text shows: votes for the label model, features for the classifier."""

    FEATURES = 15

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple] = {}

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon, "known": {}}

    def _units(self, word: str) -> tuple[str, ...]:
        if (got := self.known.get(word)) is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            got = self.known[word] = tuple(u for u in units(word) if u in self.lexicon or strong(u) in self.lexicon)
        return got

    def votes_and_features(self, text: str) -> tuple[list[int], list[float]]:
        low = text.lower()
        found = _words(low)
        counts, many, stems = Counter(found), Counter(), Counter()
        for w, n in counts.items():
            for u in self._units(w):
                many[u] += n
            if len(w) > 5:
                stems[w[:5]] += n
        once = [u for u in many if u in self.lexicon]
        often = [u for u, n in many.items() if n >= REPEATED and strong(u) in self.lexicon]
        held = {*once, *often}
        places = [i for i, w in enumerate(found) if not held.isdisjoint(self._units(w))] if held else []
        hits = len(places)
        groups = [0] * GROUPS
        for u in once:
            groups[zlib.crc32(u.encode()) % GROUPS] = 1
        repeated = [int(any(len(u) - 1 in z for u in often)) for z in (range(5), (5,), range(6, 9))]
        share = hits / max(1, len(found))
        letters = sum(map(len, found))
        capitals = sum(map(str.isupper, text)) / max(1, letters)
        shout = letters >= 40 and capitals > 0.5
        spread = int(hits > 1 and places[0] < len(found) / 2 <= places[-1])
        votes = [*groups, *repeated, 1 if share > 0.01 else (-1 if len(found) >= 30 and not hits else 0), spread, int(bool(hits and _second.search(low))), int(bool(shout and hits)), int(len(held) > 1), -1 if not hits else 0]
        odds = sorted((self.lexicon[x] for u in held for x in ((strong(u),) if u in often else ()) + ((u,) if u in once else ())), reverse=True)
        top = max(stems.values(), default=0)
        evidence = [np.log1p(hits), np.log1p(len(held)), min(share * 20, 2.0), odds[0] if odds else 0.0, sum(odds[:3]) / 3, float(sum(groups)), float(sum(repeated)), float(shout), 1.0 if hits else 0.0, float(spread)]
        return votes, [*evidence, np.log1p(len(found)) / 8, len(counts) / max(1, len(found)), min(capitals, 1.0), (len(text) - letters) / max(1, len(text)), top / max(1, sum(stems.values()))]


class LabelModel:
    """P(votes | label): a tree over the voters for each label, fitted by expectation maximisation."""

    def step(self, votes: np.ndarray, q: np.ndarray) -> None:
        """Maximisation: the prior, and each voter's table given the label and, where it has one, its parent's vote."""
        self.prior = float(np.clip(q.mean(), 0.01, 0.5))
        onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        self.tables = []
        for j, parent in enumerate(self.parents):
            table = []
            for weight in (1 - q, q):
                own = (weight @ onehot[:, j] + 0.5) / (weight.sum() + 1.5)
                if parent < 0:
                    table.append(np.log(np.tile(own, (3, 1))))
                else:  # little seen of a parent's vote: the table falls back on the voter's own
                    both = (onehot[:, parent] * weight[:, None]).T @ onehot[:, j]
                    table.append(np.log((both + 5 * own) / (both.sum(1, keepdims=True) + 5)))
            self.tables.append(table)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, parent in enumerate(self.parents):
            given = votes[:, parent] + 1 if parent >= 0 else np.zeros(len(votes), int)
            odds += self.tables[j][1][given, votes[:, j] + 1] - self.tables[j][0][given, votes[:, j] + 1]
        return sigmoid(odds)

    def dependencies(self, votes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Mutual information of each two voters given the label."""
        n, m = votes.shape
        flat = np.concatenate([votes == v for v in (-1, 0, 1)], axis=1).astype(float)
        out = np.zeros((m, m))
        for weight in (1 - q, q):
            joint = (flat * weight[:, None]).T @ flat / n
            single = np.diag(joint)
            with np.errstate(divide="ignore", invalid="ignore"):
                z = joint * np.log(joint * max(weight.mean(), 1e-12) / np.outer(single, single))
            out += np.nan_to_num(z, nan=0.0, posinf=0.0, neginf=0.0).reshape(3, m, 3, m).sum((0, 2))
        return out

    def tree(self, information: np.ndarray) -> list[int]:
        """Each voter's parent in the maximal spanning tree of pairs that share more than chance; -1: none."""
        m, parents, inside = len(information), [-1] * len(information), {0}
        while len(inside) < m:
            value, i, j = max((information[i, j], -i, -j) for i in inside for j in range(m) if j not in inside)
            inside.add(-j)
            if value > 0.005:
                parents[-j] = -i
        return parents

    def fit(self, votes: np.ndarray, rounds: int = 40) -> LabelModel:
        self.parents = [-1] * votes.shape[1]
        q = sigmoid(2.0 * (votes == 1).sum(1) - 1.5 * (votes == -1).sum(1) - 0.5)
        for k in range(rounds):
            if k == rounds // 2:
                self.correlations = self.dependencies(votes, q)
                self.parents = self.tree(self.correlations)
            self.step(votes, q)
            q = self.posterior(votes)
        self.accuracy = {y: np.stack([np.exp(t[k]).mean(0) for t in self.tables]) for k, y in enumerate(("clean", "toxic"))}
        return self


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Newton's method for soft labels; the last weight is the intercept."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) / len(x) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> tuple[Evidence, LabelModel, np.ndarray]:
    prepare(docs.sparkSession)
    rows = materialize(sample(docs, labels, "toxic", modulus, held_out), "labelled")
    evidence = Evidence(mine(rows))

    def show(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            z = [evidence.votes_and_features(t) for t in f["text"]]
            yield pd.DataFrame({"votes": [v for v, _ in z], "features": [x for _, x in z]})

    got = rows.mapInPandas(show, "votes array<int>, features array<double>").toPandas()  # as many rows as the sample
    discard(rows)
    if not len(got):
        return evidence, LabelModel(), np.array([0.0] * Evidence.FEATURES + [-3.0])
    votes = np.array(got["votes"].tolist(), int)
    model = LabelModel().fit(votes)
    return evidence, model, logistic(np.array(got["features"].tolist()), model.posterior(votes), ridge=1e-3)


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    evidence, _, weights = fit(docs, labels, modulus, held_out)
    sent = docs.sparkSession.sparkContext.broadcast((evidence, weights))  # bounded by the sample

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, w = sent.value
        for s in texts:
            x = np.array([own.votes_and_features(t or "")[1] for t in s])
            yield pd.Series(sigmoid(x @ w[:-1] + w[-1]) if len(x) else [], dtype=float)

    scored = docs.select("doc_id", F.pandas_udf(judge, "double")("text").alias("score"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
