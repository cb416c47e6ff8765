"""Gradient-boosted trees on rows in memory, equal ones with their number (numpy); models travel to executors by value.

Trees are complete, of fixed depth, over features cut into at most BINS quantile bins; one tree a class and round on
the softmax gradient. Everything is deterministic.
"""

import numpy as np

BINS = 48


def weighted_edges(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The quantiles of fit for different values in order that occur n times each."""
    if not len(values):
        return np.zeros(0)
    upto = np.cumsum(n)
    at = np.linspace(0, 1, BINS)[1:-1] * (upto[-1] - 1)
    low = np.floor(at)
    a, b = (values[np.searchsorted(upto, np.minimum(x, upto[-1] - 1), side="right")] for x in (low, low + 1))
    t = at - low
    return np.unique(np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t)))


class Boosted:
    """Softmax boosting. Probabilities pass through a scale and offset per class fitted on a holdout (calibrate)."""

    def __init__(self, rounds: int = 30, depth: int = 3, rate: float = 0.25, l2: float = 1.0, min_rows: float = 3.0):
        self.rounds, self.depth, self.rate, self.l2, self.min_rows = rounds, depth, rate, l2, min_rows

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edge, x[:, f], side="left") for f, edge in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int) -> "Boosted":
        x = np.asarray(x, float)
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        return self.grow(self._bins(x), y, classes, self.edges, np.ones(len(x)))

    def grow(self, bins: np.ndarray, y: np.ndarray, classes: int, edges: list[np.ndarray], n: np.ndarray) -> "Boosted":
        """The trees for rows given by their places between the edges; each counts n times."""
        self.edges, self.classes = edges, classes
        self.scale, self.offset = np.ones(classes), np.zeros(classes)
        share = np.bincount(y, n, classes) + 1.0
        self.base = np.log(share / share.sum())
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        score = np.tile(self.base, (len(bins), 1))
        target = np.eye(classes)[y] if len(bins) else np.zeros((0, classes))
        for _ in range(self.rounds if len(bins) else 0):
            p = _softmax(score)
            row = []
            # Of two classes the second's trees are the first's with other signs.
            for c in range(classes) if classes > 2 else (1,):
                tree, value = self._tree(bins, n * (p[:, c] - target[:, c]), n * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6), n)
                score[:, c] += value
                if classes == 2:
                    score[:, 0] -= value
                row.append(tree)
            self.trees.append(row)
        return self

    def _tree(self, bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, times: np.ndarray):
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS + 1, np.int64)
        node = np.zeros(len(bins), np.int64)
        for level in range(self.depth):
            width = 1 << level
            best = np.full(width, 1e-9)
            total_g = np.bincount(node, grad, width)[:, None]
            total_h = np.bincount(node, hess, width)[:, None]
            total_n = np.bincount(node, times, width)[:, None]
            for f in range(bins.shape[1]):
                if not len(self.edges[f]):
                    continue
                size = len(self.edges[f]) + 1
                at = node * size + bins[:, f]
                shape = (width, size)
                g = np.bincount(at, grad, width * size).reshape(shape).cumsum(1)
                h = np.bincount(at, hess, width * size).reshape(shape).cumsum(1)
                n = np.bincount(at, times, width * size).reshape(shape).cumsum(1)
                gain = g**2 / (h + self.l2) + (total_g - g) ** 2 / (total_h - h + self.l2) - total_g**2 / (total_h + self.l2)
                gain[(n < self.min_rows) | (total_n - n < self.min_rows)] = 0
                where = gain.argmax(1)
                value = gain[np.arange(width), where]
                for k in np.flatnonzero(value > best):
                    best[k] = value[k]
                    feature[width - 1 + k], cut[width - 1 + k] = f, where[k]
            split = width - 1 + node
            node = node * 2 + (bins[np.arange(len(bins)), feature[split]] > cut[split])
        leaves = 1 << self.depth
        leaf = -self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.l2)
        return (feature, cut, leaf), leaf[node]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._scores(self._bins(np.asarray(x, float)))

    def _scores(self, bins: np.ndarray) -> np.ndarray:
        score = np.tile(self.base, (len(bins), 1))
        flat, width = bins.ravel(), bins.shape[1]
        start = np.arange(len(bins)) * width
        for row in self.trees:
            for c, (feature, cut, leaf) in enumerate(row):
                node = np.zeros(len(bins), np.int64)
                for level in range(self.depth):
                    split = (1 << level) - 1 + node
                    node = node * 2 + (flat[start + feature[split]] > cut[split])
                if self.classes == 2:
                    score[:, 1] += leaf[node]
                    score[:, 0] -= leaf[node]
                else:
                    score[:, c] += leaf[node]
        return score

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.scores(x) * self.scale + self.offset)

    def probabilities_of(self, bins: np.ndarray) -> np.ndarray:
        """The same for places between the edges."""
        return _softmax(self._scores(bins) * self.scale + self.offset)

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.05, prior: float = 0.05) -> "Boosted":
        """Vector scaling on a holdout by gradient descent; prior pulls towards no change, as the holdout is small."""
        s, target = self.scores(x), np.eye(self.classes)[y]
        for _ in range(steps):
            error = _softmax(s * self.scale + self.offset) - target
            self.scale -= rate * ((error * s).mean(0) + prior * (self.scale - 1))
            self.offset -= rate * (error.mean(0) + prior * self.offset)
        return self


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
    return e / e.sum(axis=1, keepdims=True) if len(score) else score
