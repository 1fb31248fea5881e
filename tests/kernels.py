"""Plain numpy forms of statistics, one model at a time: what distributed operators are held to."""

import math

import numpy as np
import pandas as pd


def auroc(y: np.ndarray, p: np.ndarray) -> float:
    n_pos = int(y.sum())
    n_neg = len(y) - n_pos
    if not n_pos or not n_neg:
        return float("nan")
    ranks = pd.Series(p).rank().to_numpy()
    return float((ranks[y == 1].sum() - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg))


def auprc(y: np.ndarray, p: np.ndarray) -> float:
    if not y.any():
        return float("nan")
    order = np.argsort(-p, kind="stable")
    y, p = y[order], p[order]
    tp = np.cumsum(y)
    last = np.r_[p[1:] != p[:-1], True]
    tp, n = tp[last], np.flatnonzero(last) + 1
    return float((np.diff(np.r_[0, tp]) / y.sum() * tp / n).sum())


def f1(y: np.ndarray, p: np.ndarray) -> float:
    hit = p >= 0.5
    tp = int((hit & (y == 1)).sum())
    wrong = int((hit != (y == 1)).sum())
    return 2 * tp / (2 * tp + wrong) if tp else 0.0


def logits(p: np.ndarray, clip: float = 1e-6) -> np.ndarray:
    p = np.clip(p, clip, 1 - clip)
    return np.log(p / (1 - p))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def temperature_by_descent(y: np.ndarray, p: np.ndarray, rate: float = 0.05, steps: int = 200, floor: float = 0.05) -> float:
    """Temperature by plain gradient steps; the step that would move it less than 1e-6 is not taken."""
    z, t = logits(p), 1.0
    for _ in range(steps):
        slope = ((sigmoid(z / t) - y) * (-z / t**2)).sum() / max(1.0, len(y))
        new = max(floor, t - rate * slope)
        if abs(new - t) < 1e-6:
            break
        t = new
    return t


def temperature_by_search(y: np.ndarray, p: np.ndarray, low: float = 0.05, high: float = 10.0) -> float:
    """Temperature of least negative log-likelihood, by golden sections."""
    z = logits(p, 1e-7)

    def loss(t: float) -> float:
        q = sigmoid(z / t)
        return float(-(y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7)).mean())

    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = loss(c), loss(d)
    for _ in range(80):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = loss(d)
    return (a + b) / 2


def platt(y: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit on logits, nearly without penalty."""
    x = np.column_stack([logits(p, 1e-7), np.ones(len(p))])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 5e-7 * w[0] ** 2)

    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = sigmoid(np.clip(x @ w, -35, 35))
        grad = x.T @ (q - y) + np.array([1e-6, 0.0]) * w
        hess = (x * (q * (1 - q))[:, None]).T @ x + np.diag([1e-6, 1e-9])
        step = np.linalg.solve(hess, grad)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-12:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def isotonic(y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a non-decreasing least-squares fit: pooled blocks over the sorted scores."""
    xs, where = np.unique(p, return_inverse=True)
    weight = np.bincount(where).astype(float)
    value = np.bincount(where, y) / weight
    level: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        level.append([v, w, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            (v1, w1, n1), (v2, w2, n2) = level[-2:]
            level[-2:] = [[(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]]
    return xs, np.repeat([v for v, _, _ in level], [int(n) for *_, n in level])


def ece_std(y: np.ndarray, p: np.ndarray, bins: int = 15) -> float:
    conf = np.maximum(p, 1 - p)
    at = np.clip(np.digitize(conf, np.linspace(0, 1, bins + 1)[1:-1]), 0, bins - 1)
    right = ((p >= 0.5).astype(int) == y).astype(float)
    return float(sum((at == b).mean() * abs(right[at == b].mean() - conf[at == b].mean()) for b in range(bins) if (at == b).any()))
