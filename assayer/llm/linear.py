"""Logistic regression on hashed counts, small enough to train on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: column indices and values, and where each row begins.  Products go through blocks of rows, so that
    what they hold beside the rows is bounded."""

    BLOCK = 1 << 19

    def __init__(self, index: list[np.ndarray], value: list[np.ndarray]):
        self.at = np.concatenate([[0], np.cumsum([len(i) for i in index])]).astype(np.int64)
        self.index = np.concatenate(index).astype(np.int32) if index else np.zeros(0, np.int32)
        self.value = np.concatenate(value).astype(np.float32) if value else np.zeros(0, np.float32)

    def blocks(self):
        """First and last row, indices, values and row numbers of each block."""
        a, n = 0, len(self.at) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.at, self.at[a] + self.BLOCK, side="right")) - 1)
            s = slice(self.at[a], self.at[b])
            yield a, b, self.index[s], self.value[s], np.repeat(np.arange(b - a), np.diff(self.at[a : b + 1]))
            a = b

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Products with a weight vector or matrix (columns, classes)."""
        out = np.zeros((len(self.at) - 1, *w.shape[1:]))
        for a, b, index, value, row in self.blocks():
            if w.ndim == 1:
                out[a:b] = np.bincount(row, value * w[index], minlength=b - a)
            else:
                for c in range(w.shape[1]):
                    out[a:b, c] = np.bincount(row, value * w[index, c], minlength=b - a)
        return out

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((width, *g.shape[1:]))
        for a, b, index, value, row in self.blocks():
            if g.ndim == 1:
                out += np.bincount(index, value * g[a:b][row], minlength=width)
            else:
                for c in range(g.shape[1]):
                    out[:, c] += np.bincount(index, value * g[a:b, c][row], minlength=width)
        return out


def train(x: Rows, y: np.ndarray, width: int, steps: int = 120, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of P(y = 1), by full-batch Adam; deterministic."""
    w, b = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        g = (1 / (1 + np.exp(-np.clip(x.dot(w) + b, -40, 40))) - y) / max(1, len(y))
        gw, gb = x.back(g, width) + decay * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, c so that 1 / (1 + exp(-(a * score + c))) fits held-out labels (smoothed targets, Newton steps)."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + c, -40, 40)))
        r, s = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * score).sum() + 1e-3 * (a - 1), r.sum()])
        h = np.array([[(s * score * score).sum() + 1e-3, (s * score).sum()], [(s * score).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, c = a - d[0], c - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(c)
