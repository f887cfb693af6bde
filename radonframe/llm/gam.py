"""A generalised additive model with pairwise interactions for a 0/1 label, in numpy.

Cyclic boosting: rounds go through the features in turn, and each fits a shallow tree of one feature to the residuals, whose leaf
values add to that feature's lookup table. Of all pairs of features, those that explain most of what is left get tables of two
features, boosted the same way. The rounds stop where the loss on a held-back part of the rows is least. A score is a sum of table
entries, one addition of a gathered column per table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS, COARSE = 32, 8
RATE, RIDGE, LEAVES = 0.1, 1.0, 4
ROUNDS, PAIR_ROUNDS, PAIRS, PATIENCE = 300, 100, 6, 30


@dataclass
class Gam:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]  # coarse bin of each bin
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.empty((len(x), 0), np.int64)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            out += t[b[:, k]]
        for i, j, t in self.pairs:
            out += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of up to LEAVES leaves on one feature's histogram."""
    gs, hs = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    value = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + RIDGE)
    cuts = [0, len(g)]
    for _ in range(LEAVES - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = value(a, c) + value(c, b) - value(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(c[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best table of four quadrants on a pair's histogram, and its gain."""
    gs, hs = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (g, h))
    quads = lambda s: (s[1:-1, 1:-1], s[1:-1, -1:] - s[1:-1, 1:-1], s[-1:, 1:-1] - s[1:-1, 1:-1], s[-1, -1] - s[1:-1, -1:] - s[-1:, 1:-1] + s[1:-1, 1:-1])
    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    qg, qh = quads(gs), quads(hs)
    gain = sum(a**2 / (b + RIDGE) for a, b in zip(qg, qh, strict=True)) - gs[-1, -1] ** 2 / (hs[-1, -1] + RIDGE)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [a[i, j] / (b[i, j] + RIDGE) for a, b in zip(qg, qh, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Gam:
    """A model of the rows x with labels y; with no rows, or one label, the score is constant."""
    n = len(y)
    ones = float(y.sum())
    start = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.empty(0) for k in range(x.shape[1])]
    sizes = [len(e) + 1 for e in edges]
    coarse = [np.arange(s) * min(COARSE, s) // s for s in sizes]
    model = Gam(edges, coarse, start, [np.zeros(s) for s in sizes], [])
    if n < 20 or not 0 < ones < n:
        return model
    b = model.bins(x)
    train = np.random.default_rng(seed).random(n) >= 0.15
    f = np.full(n, start)

    def loss() -> float:
        z = np.where(y[~train] > 0, f[~train], -f[~train])
        return float(np.logaddexp(0, -z).mean()) if len(z) else 0.0

    def boost(step, tables: list[np.ndarray], rounds: int) -> None:
        best, kept, since = loss(), [t.copy() for t in tables], 0
        for _ in range(rounds):
            for k in range(len(tables)):
                step(k)
            now = loss()
            since += 1
            if now < best - 1e-6:
                best, kept, since = now, [t.copy() for t in tables], 0
            if since >= PATIENCE:
                break
        for t, v in zip(tables, kept, strict=True):
            t[...] = v

    def grads() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f[train]))
        return y[train] - p, p * (1 - p)

    def one(k: int) -> None:
        g, h = grads()
        at = b[train, k]
        add = RATE * _tree(np.bincount(at, g, sizes[k]), np.bincount(at, h, sizes[k]))
        model.tables[k] += add
        f[:] += add[b[:, k]]

    boost(one, model.tables, ROUNDS)
    f[:] = model.log_odds(x)
    wide = [c[b[:, k]] for k, c in enumerate(coarse)]
    shape = [min(COARSE, s) for s in sizes]

    def histogram(i: int, j: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(wide[i][train] * shape[j] + wide[j][train], w, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = grads()
    gains = sorted((-_pair_tree(histogram(i, j, g), histogram(i, j, h))[1], i, j) for i in range(len(sizes)) for j in range(i + 1, len(sizes)))
    model.pairs = [(i, j, np.zeros((shape[i], shape[j]))) for _, i, j in gains[:PAIRS]]

    def two(k: int) -> None:
        i, j, t = model.pairs[k]
        g, h = grads()
        add = RATE * _pair_tree(histogram(i, j, g), histogram(i, j, h))[0]
        t += add
        f[:] += add[wide[i], wide[j]]

    boost(two, [t for *_, t in model.pairs], PAIR_ROUNDS)
    return model
