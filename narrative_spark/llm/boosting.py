"""Gradient-boosted regression trees on binned features, for models small enough to fit on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class BoostedTrees:
    """Logistic boosting. Trees are complete to ``depth``: arrays of features and bin limits, and leaf values."""

    rounds: int = 60
    depth: int = 4
    bins: int = 32
    rate: float = 0.2
    ridge: float = 1.0
    start: float = 0.0
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)

    def _binned(self, x):
        import numpy as np

        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x, y) -> "BoostedTrees":
        import numpy as np

        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(width)]
        codes, b = self._binned(x), self.bins
        rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            splits = []
            for level in range(self.depth):
                k = 1 << level
                gains = np.full((width, k, b), -np.inf)
                for f in range(width):
                    cell = node * b + codes[:, f]
                    gs = np.bincount(cell, weights=g, minlength=k * b).reshape(k, b)
                    hs = np.bincount(cell, weights=h, minlength=k * b).reshape(k, b)
                    gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    ok = (hl > 1.0) & (ht - hl > 1.0)
                    gains[f] = np.where(ok, gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge), -np.inf)
                flat = gains.transpose(1, 0, 2).reshape(k, width * b)
                best = flat.argmax(axis=1)
                useful = np.isfinite(flat[np.arange(k), best])
                feature = np.where(useful, best // b, 0)
                limit = np.where(useful, best % b, b)  # all go left where no split helps
                splits.append((feature, limit))
                node = 2 * node + (codes[np.arange(n), feature[node]] > limit[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, weights=g, minlength=leaves) / (np.bincount(node, weights=h, minlength=leaves) + self.ridge)
            self.trees.append((splits, value))
            score += value[node]
        return self

    def log_odds(self, x):
        import numpy as np

        codes, out, rows = self._binned(x), np.full(len(x), self.start), np.arange(len(x))
        for splits, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for feature, limit in splits:
                node = 2 * node + (codes[rows, feature[node]] > limit[node])
            out += value[node]
        return out
