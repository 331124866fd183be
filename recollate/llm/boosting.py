"""Gradient-boosted trees on few features, in numpy; small enough to train on the driver and to ship to workers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Logistic boosting of trees of fixed depth: each tree is (features, cuts) of its inner nodes in heap order, and leaf values."""

    depth: int = 3
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.25, depth: int = 3, ridge: float = 1.0, most_cuts: int = 12) -> Trees:
    """Second-order boosting with exact search over a few cuts of each feature.

    Which rows lie above which cut is one matrix, so a level of a tree needs one product with the gradients of its nodes.
    """
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(depth, float(np.log(share / (1 - share))))
    owner, cuts = [], []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        mids = (values[1:] + values[:-1]) / 2
        mids = mids if len(mids) <= most_cuts else np.unique(np.quantile(mids, np.linspace(0, 1, most_cuts)))
        owner += [f] * len(mids)
        cuts += mids.tolist()
    owner, cuts = np.array(owner, np.int64), np.array(cuts)
    above = np.empty((len(x), len(cuts)), np.float32)
    for j, (f, c) in enumerate(zip(owner, cuts, strict=True)):
        above[:, j] = x[:, f] > c
    score = np.full(len(x), model.base)
    inner, rows = 2**depth - 1, np.arange(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            sums = np.zeros((len(x), 2 * width), np.float32)
            sums[rows, at] = g
            sums[rows, width + at] = h
            right = (above.T @ sums).astype(np.float64)
            gt, ht = np.bincount(at, g, width), np.bincount(at, h, width)
            gr, hr = right[:, :width], right[:, width:]
            gain = (gt - gr) ** 2 / (ht - hr + ridge) + gr**2 / (hr + ridge) - gt**2 / (ht + ridge)
            for w in range(width) if len(cuts) else ():
                best = int(gain[:, w].argmax())
                if gain[best, w] > 1e-6:
                    feature[first + w], cut[first + w] = owner[best], cuts[best]
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        leaf_of = node - inner
        gl, hl = np.bincount(leaf_of, g, 2**depth), np.bincount(leaf_of, h, 2**depth)
        leaf = rate * gl / (hl + ridge)
        model.trees.append((feature, cut, leaf))
        score += leaf[leaf_of]
    return model


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the range of probabilities with the best F1 on held-out cases."""
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1.0, y.sum()))
    k = int(f1.argmax())
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + low) / 2, 0.05, 0.95))
