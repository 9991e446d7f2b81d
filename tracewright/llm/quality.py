"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled texts fit a small network under the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with logistic loss.  The class prior is estimated from these two kinds
of texts alone (see ``estimated_prior``); labelled negatives take no part in it, nor in the risk.  They serve, with labelled
positives, a last scaling of the network's output by two numbers, which makes scores comparable with a fixed threshold.
Inputs are shapes of the text alone.

Defined results: a null text is an empty one; where labels cover every document all documents are the unlabelled ones;
with no positive or no unlabelled rows every score is the prior, and ``kept_documents`` keeps all; equal texts are
fitted on once, in every role that one of them has, as quality 1 if any is labelled so; repeated rows are scored each for
itself; a null doc_id is in no fold; an empty table gives no rows; texts are read whole, however long; other columns,
whatever their names, are kept by ``kept_documents`` and not read.  Sampled rows are bounded by POSITIVES, UNLABELLED and
SCALING.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, in_arrow
from .labelled import chosen, fold, mapped, text_key

#: Rows that are fitted on, at most.
POSITIVES, UNLABELLED, SCALING = 3000, 6000, 3000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
SYMBOLS = re.compile(r"[^\w\s]{2,}")
LETTERS = re.compile(r"[^\W\d_]+")
ALNUM = re.compile(r"[^\W_]")
FEATURES = 12


def features(text: str | None) -> list[float]:
    """Shapes of a whole text, each about 0 to 1."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    letters = sum(map(len, LETTERS.findall(text)))
    symbols = len(SYMBOLS.findall(text))
    lower = text.lower()
    upper = sum(map(str.isupper, words))
    twice = sum(a == b for a, b in zip(words, words[1:]))
    lone = sum(k for w, k in counts.items() if not ALNUM.search(w))
    lines = text.split("\n")
    return [
        np.log1p(n) / 10,
        len(counts) / n,
        len(counts) / n**0.75 / 3,
        max(counts.values(), default=0) / n,
        twice / n,
        symbols / n,
        upper / n,
        lone / n,
        letters / chars,
        min(1.0, letters / n / 20),
        1 - len(set(lines)) / len(lines),
        sum(a != b for a, b in zip(text, lower)) / chars,
    ]


class Network:
    """One hidden layer; full-batch Adam under the non-negative risk, from a fixed seed."""

    def __init__(self, hidden: int = 16):
        random = np.random.default_rng(7)
        self.w = [random.normal(0, 0.5, (FEATURES, hidden)), np.zeros(hidden), random.normal(0, 0.5, hidden), np.zeros(1)]
        self.mean, self.std, self.scale = np.zeros(FEATURES), np.ones(FEATURES), (1.0, 0.0)

    def _forward(self, x):
        hidden = np.tanh(x @ self.w[0] + self.w[1])
        return hidden, hidden @ self.w[2] + self.w[3]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.02) -> None:
        both = np.r_[positive, unlabelled]
        self.mean, self.std = both.mean(0), both.std(0) + 1e-3
        x = np.clip((both - self.mean) / self.std, -8, 8)
        p, u = len(positive), len(unlabelled)
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, rounds + 1):
            hidden, z = self._forward(x)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            loss = np.logaddexp(0, z)  # of calling a row negative
            negative = loss[p:].mean() - prior * loss[:p].mean()
            slope = np.zeros(p + u)
            if negative >= 0:
                slope[:p] = prior * (s[:p] - 1) / p - prior * s[:p] / p
                slope[p:] = s[p:] / u
            else:  # the negative part is estimated below zero: go back up
                slope[:p] = prior * s[:p] / p
                slope[p:] = -s[p:] / u
            back = np.outer(slope, self.w[2]) * (1 - hidden**2)
            slopes = [x.T @ back + 1e-4 * self.w[0], back.sum(0), hidden.T @ slope + 1e-4 * self.w[2], slope.sum(keepdims=True)]
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.w[i] = self.w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._forward(np.clip((x - self.mean) / self.std, -8, 8))[1]

    def rescale(self, x: np.ndarray, y: np.ndarray) -> None:
        """Slope and offset of a logistic scaling, with smoothed targets."""
        z = self.raw(x)
        n1 = y.sum()
        target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
        self.scale = scaling(z[:, None], target)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rounded, for the last digits of a product depend on how rows are batched."""
        a, b = self.scale
        return np.round(1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -30, 30))), 9)


def scaling(x: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60) -> tuple[float, ...]:
    """Newton's method for a slightly damped logistic regression: slopes, then the offset."""
    x = np.c_[x, np.ones(len(x))]
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    damp = np.r_[np.full(x.shape[1] - 1, 0.05), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(damp), x.T @ (weight * (p - target)) + damp * w)
        length = np.abs(step).max()
        w = w - step * min(1.0, 2 / max(length, 1e-12))
        if length < 1e-9:
            break
    return tuple(w.tolist())


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.5) -> float:
    """The share of positives among unlabelled rows, from the features of both.

    Above any score the unlabelled rows hold at least that share of the positives' part, so the smallest ratio of the two
    parts is the share or more; a deviation of each part is allowed for, and parts below ``least`` of the positives, where
    few rows decide, aren't asked.  Rows are scored by a network that was fitted on the others, two halves in turn.
    """
    found = []
    random = np.random.default_rng(7)
    positive, unlabelled = (x[random.permutation(len(x))] for x in (positive, unlabelled))
    for half in (0, 1):
        model = Network()
        model.fit(positive[half::2], unlabelled[half::2], 0.5, rounds=150)
        p, u = np.sort(model.raw(positive[1 - half :: 2])), np.sort(model.raw(unlabelled[1 - half :: 2]))
        if not len(p) or not len(u):
            continue
        cuts = np.r_[p, u]
        p_above, u_above = (1 - np.searchsorted(x, cuts) / len(x) for x in (p, u))
        spread = lambda x, n: np.sqrt(x * (1 - x) / n) + 0.5 / n
        ratio = (u_above + spread(u_above, len(u))) / np.maximum(p_above - spread(p_above, len(p)), 1e-9)
        found.append(ratio[p_above >= least].min(initial=1.0))
    return float(np.clip(np.mean(found or [0.5]), 0.02, 0.98))


def fit(documents: DataFrame, labels: DataFrame) -> tuple[Network | None, float]:
    """The model, or none, and the class prior, from the training folds of the labels."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    train = known.filter(fold("doc_id", FOLDS) != HELD_OUT)
    totals = {r.quality: r["count"] for r in train.groupBy("quality").count().collect()}
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    every = documents.select("doc_id").filter("doc_id IS NOT NULL")
    free = every.join(labels.select("doc_id"), "doc_id", "left_anti")
    if free.isEmpty():
        free = every
    parts = {"p": chosen(train.filter("quality = 1").select("doc_id"), POSITIVES), "u": chosen(free, UNLABELLED), "s": chosen(train.select("doc_id", "quality"), SCALING)}
    ids = None
    for kind, part in parts.items():
        part = part.select("doc_id", F.lit(kind).alias("kind"), F.col("quality") if kind == "s" else F.lit(-1).alias("quality"))
        ids = part if ids is None else ids.unionByName(part)
    # a row, and so a text, may serve in several roles; at most some thousand ids are broadcast
    roles = checkpointed(ids.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"), F.max("quality").alias("quality")))
    rows = documents.select("doc_id", "text").join(F.broadcast(roles), "doc_id")
    by_text = rows.groupBy(text_key().alias("k")).agg(F.min("text").alias("text"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"), F.max("quality").alias("quality"))

    def shapes(texts, kinds, quality):
        return ((k, q, features(t)) for t, k, q in zip(texts, kinds, quality))

    found = mapped(by_text.select("text", "kinds", "quality"), shapes, "kinds array<string>, quality int, x array<double>", {"kinds": pa.list_(pa.string()), "quality": pa.int32(), "x": pa.list_(pa.float64())}).collect()
    found.sort(key=lambda r: (r.x, sorted(r.kinds), r.quality))
    of = lambda kind: np.array([r.x for r in found if kind in r.kinds]).reshape(-1, FEATURES)
    positive, unlabelled = of("p"), of("u")
    if not len(positive) or not len(unlabelled):
        return None, share
    prior = estimated_prior(positive, unlabelled) if min(len(positive), len(unlabelled)) > 1 else share
    model = Network()
    model.fit(positive, unlabelled, prior)
    y = np.array([r.quality for r in found if "s" in r.kinds])
    if len(set(y.tolist())) > 1:
        model.rescale(of("s"), y)
    return model, prior


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model, prior = fit(documents, labels)

    def run(keys, held, texts):
        scores = model.score(np.array([features(t) for t in texts]).reshape(-1, FEATURES)).tolist() if model else [prior] * len(texts)
        return ((k, h, s, int(s >= THRESHOLD)) for k, h, s in zip(keys, held, scores))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return mapped(rows, run, "doc_id long, held_out boolean, score double, predicted int", {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()})


def kept_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with the columns they had; all of them where there is no model."""
    return keep(documents, fit(documents, labels)[0], lambda m: (lambda texts: m.score(np.array([features(t) for t in texts]).reshape(-1, FEATURES)) >= THRESHOLD if m else np.full(len(texts), True)))


def keep(documents: DataFrame, model, decide) -> DataFrame:
    """Filter whole rows by a function of their texts, a batch at a time."""
    test = decide(model)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array(np.asarray(test(batch.column(at).to_pylist()), bool)))

    return in_arrow(documents, run, documents.schema)
