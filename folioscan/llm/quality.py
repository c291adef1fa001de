"""Operator 7: document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. Its features describe its bytes
(letters, capitals, digits, separators, symbols, repeated words, whether it
repeats an earlier line) and those of both neighbours. Labels exist for
documents only, so line labels are latent: a logistic model starts from the
document's label, and in bad documents the lines it finds likelier bad keep
that label (hard expectation-maximisation). The field is then fitted to these
labels by gradient ascent on its exact log-likelihood. A document's bad share
is the mean of its lines' forward-backward marginals weighted by length, and a
logistic curve over it is the score.

Fitting uses at most ``sample`` labelled documents of at most LONGEST
characters; every document is scored, whole, with memory for one Arrow batch.

Defined results: a null text is an empty one, which is one empty line; rows
with a null id are scored (held_out is false) and teach nothing; without
labels of both classes every score is the share of good labels, or 0.5.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_texts, release, sample_labels, tune
from .models import fit_logistic, sigmoid

SAMPLE, THRESHOLD, LONGEST = 4000, 0.3, 20_000
_KINDS = ("upper", "lower", "digit", "space", "bar", "loud", "symbol", "stop", "high")


def _classes() -> np.ndarray:
    kind = np.full(256, _KINDS.index("symbol"), "u1")
    for name, members in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", (9, 11, 12, 13, 32)), ("bar", b"|\\/_=~"), ("loud", b"!?"), ("stop", b".,;:'\"()-"), ("high", range(128, 256))):
        kind[list(members)] = _KINDS.index(name)
    return kind


_CLASS = _classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines with their neighbours', line lengths, first line of each document and the end)."""
    lines, starts, repeats = [], [0], []
    for text in texts:
        own = text.split("\n")
        seen: set[int] = set()
        for line in own:
            words = line.split()
            key = hash(line)
            repeats.append((len(set(words)) / len(words) if words else 1.0, float(bool(words) and key in seen)))
            seen.add(key)
        lines += own
        starts.append(len(lines))
    raw = "\n".join(lines).encode("utf-8", "replace")
    kinds = _CLASS[np.frombuffer(raw + b"\n", "u1")]
    ends = np.flatnonzero(np.frombuffer(raw + b"\n", "u1") == 10)
    kinds[ends] = len(_KINDS)
    begins = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - begins).astype("f8")
    counts = np.empty((len(ends), len(_KINDS)))
    for k in range(len(_KINDS)):  # sums over segments; each has its newline, so none is empty
        counts[:, k] = np.add.reduceat((kinds == k).view("u1"), begins, dtype="i8")
    share = counts / np.maximum(size, 1)[:, None]
    words = counts[:, _KINDS.index("space")] + 1
    own = np.column_stack([
        share, np.sqrt(share[:, [0, 4, 5, 6]]), np.log1p(size) / 5, np.minimum(size / words, 40) / 10, size == 0, np.array(repeats).reshape(-1, 2),
        counts[:, _KINDS.index("loud")] / words, counts[:, _KINDS.index("bar")] / words, counts[:, _KINDS.index("symbol")] / words,
    ])
    starts = np.array(starts)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[starts[:-1]] = 0
    after[starts[1:] - 1] = 0
    edge = np.zeros((len(own), 2))
    edge[starts[:-1], 0] = 1
    edge[starts[1:] - 1, 1] = 1
    return np.column_stack([own, 0.5 * before, 0.5 * after, edge]), size + 1, starts


def marginals(emission: np.ndarray, transition: np.ndarray, starts: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: (P(bad) of each line, pair marginals summed, log-partition of each).

    emission: lines by states; transition: states by states; chains are the
    runs of lines between ``starts``, and count in the sum by their weight.
    """
    length = np.diff(starts)
    order = np.argsort(-length, kind="stable")
    first, length = starts[:-1][order], length[order]
    share = np.ones(len(length)) if weight is None else weight[order]
    most = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(most), "left")  # chains longer than t
    forward, backward = np.zeros_like(emission), np.zeros_like(emission)
    log_z = np.zeros(len(length))
    a = np.empty((0, 2))
    for t in range(most):
        n = active[t]
        at = first[:n] + t
        if t:
            a = np.logaddexp(a[:n, 0, None] + transition[0], a[:n, 1, None] + transition[1]) + emission[at]
        else:
            a = emission[at].copy()
        forward[at] = a
    last = first + length - 1
    log_z = np.logaddexp(forward[last, 0], forward[last, 1])
    pairs = np.zeros((2, 2))
    for t in range(most - 2, -1, -1):
        n = active[t + 1]
        at = first[:n] + t
        nxt = emission[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(transition[:, 0] + nxt[:, 0, None], transition[:, 1] + nxt[:, 1, None])
        joint = forward[at][:, :, None] + transition + nxt[:, None, :] - log_z[:n, None, None]
        pairs += (np.exp(joint) * share[:n, None, None]).sum(0)
    chain = np.repeat(np.arange(len(length)), length)
    line = np.concatenate([np.arange(f, f + k) for f, k in zip(first, length, strict=True)]) if most else np.empty(0, int)
    bad = np.zeros(len(emission))
    bad[line] = np.exp(forward[line, 1] + backward[line, 1] - log_z[chain])
    return bad, pairs, log_z


class Model:
    """weights: of the features for state bad; transition: of neighbouring states; curve: (slope, bias)."""

    def __init__(self, mean, scale, weights, transition, curve):
        self.mean, self.scale, self.weights, self.transition, self.curve = mean, scale, weights, transition, curve

    def bad_share(self, texts: list[str]) -> np.ndarray:
        x, size, starts = line_features(texts)
        return self._share((x - self.mean) / self.scale, size, starts)

    def _share(self, x, size, starts) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        bad, _, _ = marginals(np.column_stack([np.zeros(len(z)), z]), self.transition, starts)
        return np.add.reduceat(bad * size, starts[:-1]) / np.add.reduceat(size, starts[:-1])

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.curve[1])
        return sigmoid(self.curve[0] * self.bad_share(texts) + self.curve[1])


def fit_field(x: np.ndarray, starts: np.ndarray, label: np.ndarray, weight: np.ndarray, begin: np.ndarray, steps: int = 120, ridge: float = 1e-3):
    """Weights and transitions that maximise the likelihood of line labels, documents by their weight, by Adam on the exact gradient."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w, trans = begin.copy(), np.zeros((2, 2))
    weight = weight / weight.mean()
    each = np.repeat(weight, np.diff(starts))
    inner = np.ones(len(x), bool)
    inner[starts[:-1]] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (label[at - 1].astype(int), label[at].astype(int)), each[at])
    moments = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    n = each.sum()
    for step in range(1, steps + 1):
        z = x1 @ w
        bad, pairs, _ = marginals(np.column_stack([np.zeros(len(z)), z]), trans, starts, weight)
        g = np.concatenate([x1.T @ (each * (label - bad)) / n - ridge * w, ((seen - pairs) / n - ridge * trans).ravel()])
        moments = [0.9 * moments[0] + 0.1 * g, 0.99 * moments[1] + 0.01 * g * g]
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[:-4], trans + move[-4:].reshape(2, 2)
    return w, trans


def train(texts: list[str], label: np.ndarray, weight: np.ndarray) -> Model:
    """label: 1 good, 0 bad."""
    if len(set(label.tolist())) < 2:
        return Model(None, None, None, None, (0.0, float(np.average(label, weights=weight)) if len(label) else 0.5))
    x, size, starts = line_features(texts)
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.05)
    x = (x - mean) / scale
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    low = label[doc] == 0
    bad = low.astype(float)
    even = np.where(low, len(low) / max(1, low.sum()), len(low) / max(1, (~low).sum())) * np.sqrt(size)
    even /= even.mean()
    for _ in range(4):
        w = fit_logistic(x, bad, even, ridge=2.0)
        p = sigmoid(x @ w[:-1] + w[-1])
        worst = np.maximum.reduceat(p, starts[:-1])[doc]
        bad = (low & ((p > 0.5) | (p >= worst))).astype(float)
    w, trans = fit_field(x, starts, bad, weight, w)
    model = Model(mean, scale, w, trans, (0.0, 0.0))
    share = model._share(x, size, starts)
    model.curve = tuple(fit_logistic(share[:, None], label, weight, ridge=1e-3))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` documents outside fold 0, none longer than LONGEST characters: at most 80 million come to the driver."""
    tune(docs.sparkSession)
    chosen = labelled_texts(docs, sample_labels(labels, "quality", sample), LONGEST).select("doc_id", "label", "weight", "text")
    got = chosen.toArrow().sort_by("doc_id").to_pydict()  # bounded by sample
    return train([t or "" for t in got["text"]], np.array(got["label"], "f8"), np.array(got["weight"], "f8"))


def scorer(docs: DataFrame, model: Model):
    """A function of the text column that gives the score column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for texts in batches:
            yield pd.Series(shared.value.score(["" if t is None else t for t in texts]))
        release()

    return score


def score_table(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    tune(docs.sparkSession)
    scored = docs.select("doc_id", held_out().alias("held_out"), scorer(docs, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
