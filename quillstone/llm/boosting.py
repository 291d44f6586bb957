"""Small gradient-boosted trees for binary targets over a few numeric features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class BoostedTrees:
    """Depth-limited regression trees on logistic gradients; `platt` calibrates the margin to a probability."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    ridge: float = 1.0
    trees: list[list[tuple[int, float, float]]] = field(default_factory=list)
    platt: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        margin = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self.grow(x, cuts, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += self.walk(tree, x)
        return self

    def grow(self, x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> list[tuple[int, float, float]]:
        """Nodes in heap order as (feature, cut, value); a feature of -1 marks a leaf."""
        nodes = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
        rows = {0: np.arange(len(g))}
        for k in range(len(nodes)):
            if (at := rows.pop(k, None)) is None or not len(at):
                continue
            best = (1e-6, -1, 0.0)
            if k < 2**self.depth - 1:
                whole = g[at].sum() ** 2 / (h[at].sum() + self.ridge)
                for f, options in enumerate(cuts):
                    for c in options:
                        left = x[at, f] <= c
                        gl, hl = g[at][left].sum(), h[at][left].sum()
                        gr, hr = g[at].sum() - gl, h[at].sum() - hl
                        gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - whole
                        best = max(best, (gain, f, float(c)))
            if best[1] < 0:
                nodes[k] = (-1, 0.0, self.rate * g[at].sum() / (h[at].sum() + self.ridge))
            else:
                nodes[k] = (best[1], best[2], 0.0)
                left = x[at, best[1]] <= best[2]
                rows[2 * k + 1], rows[2 * k + 2] = at[left], at[~left]
        return nodes

    def walk(self, tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[at]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((self.walk(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling on rows that were not trained on, by a few Newton steps."""
        m = self.margin(x)
        a = np.array([1.0, 0.0])
        design = np.stack([m, np.ones_like(m)], 1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-design @ a))
            w = np.maximum(p * (1 - p), 1e-6)
            a += np.linalg.solve(design.T @ (design * w[:, None]) + 0.01 * np.eye(2), design.T @ (y - p) - 0.01 * (a - [1, 0]))
        self.platt = (float(a[0]), float(a[1]))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.platt[0] * self.margin(x) + self.platt[1])))
