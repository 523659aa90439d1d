"""Linear-chain conditional random field with binary features, in numpy: training by its log-likelihood, Viterbi decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    """weights[f, y] of features, start[y], step[y, z] of transitions. Feature 0 stands for no feature."""

    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """features: (positions, slots) of feature numbers -> (positions, labels)."""
        return self.weights[features].sum(-2)

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """Best label of each position; among equal paths the lower labels."""
        emit = self.scores(features)
        n, labels = emit.shape
        if labels == 2:
            return _viterbi2(emit.tolist(), self.start.tolist(), self.step.tolist())
        back = np.zeros((n, labels), np.int64)
        v = self.start + emit[0] if n else self.start
        for t in range(1, n):
            m = v[:, None] + self.step
            back[t] = m.argmax(0)
            v = m.max(0) + emit[t]
        out = np.zeros(n, np.int64)
        if n:
            out[-1] = v.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def _viterbi2(emit: list, start: list, step: list) -> np.ndarray:
    if not emit:
        return np.zeros(0, np.int64)
    (s00, s01), (s10, s11) = step
    a, b = start[0] + emit[0][0], start[1] + emit[0][1]
    back = []
    for x, y in emit[1:]:
        p, q = a + s00 >= b + s10, a + s01 >= b + s11
        back.append((0 if p else 1, 0 if q else 1))
        a, b = (a + s00 if p else b + s10) + x, (a + s01 if q else b + s11) + y
    out = [0 if a >= b else 1]
    for p in reversed(back):
        out.append(p[out[-1]])
    return np.array(out[::-1], np.int64)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def train(sequences: list[tuple[np.ndarray, np.ndarray]], n_features: int, labels: int = 2, epochs: int = 30, rate: float = 0.15, l2: float = 1e-3, batch: int = 128) -> Crf:
    """sequences: (features (positions, slots), labels (positions,)). Adam on the mean log-likelihood of a position."""
    sequences = sorted((s for s in sequences if len(s[1])), key=lambda s: len(s[1]))
    crf = Crf(np.zeros((n_features, labels)), np.zeros(labels), np.zeros((labels, labels)))
    if not sequences:
        return crf
    slots = max(s[0].shape[1] for s in sequences)
    params = [crf.weights, crf.start, crf.step]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    starts, tick = list(range(0, len(sequences), batch)), 0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for s in rng.permutation(starts):
            part = sequences[s : s + batch]
            t_max, b = len(part[-1][1]), len(part)
            f = np.zeros((b, t_max, slots), np.int64)
            y = np.full((b, t_max), -1)
            for i, (own, marks) in enumerate(part):
                f[i, : len(marks), : own.shape[1]] = own
                y[i, : len(marks)] = marks
            grads = _gradient(crf, f, y)
            tick += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g / (y >= 0).sum() - l2 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.99**tick)) + 1e-8)
            crf.weights[0] = 0
    return crf


def _gradient(crf: Crf, f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, t_max, _ = f.shape
    labels, live = len(crf.start), y >= 0
    emit = crf.weights[f].sum(2)
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[:, 0] = crf.start + emit[:, 0]
    for t in range(1, t_max):
        new = _lse(alpha[:, t - 1, :, None] + crf.step, 1) + emit[:, t]
        alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
    total = _lse(alpha[:, -1], 1)
    for t in range(t_max - 2, -1, -1):
        new = _lse(crf.step + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(live[:, t + 1, None], new, 0.0)
    node = np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
    truth = np.eye(labels)[np.maximum(y, 0)] * live[:, :, None]
    weights = np.zeros_like(crf.weights)
    for slot in range(f.shape[2]):
        np.add.at(weights, f[:, :, slot].ravel(), (truth - node).reshape(-1, labels))
    start = (truth - node)[:, 0].sum(0)
    step = np.zeros_like(crf.step)
    if t_max > 1:
        edge = alpha[:, :-1, :, None] + crf.step + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        step = (truth[:, :-1, :, None] * truth[:, 1:, None, :]).sum((0, 1)) - (np.exp(edge) * live[:, 1:, None, None]).sum((0, 1))
    return weights, start, step
