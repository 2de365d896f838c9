"""A bidirectional LSTM over sequences of vectors in numpy: forward pass, gradients, Adam."""

from __future__ import annotations

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def steps(sizes: np.ndarray, reverse: bool) -> list[np.ndarray]:
    """Row numbers of each time step, longest sequences first, so that a step is a prefix of the one before."""
    ends = np.cumsum(sizes)
    order = np.argsort(-sizes, kind="stable")
    longest = sizes[order]
    alive = np.searchsorted(-longest, -np.arange(1, longest[0] + 1), side="right") if len(sizes) else []
    if reverse:
        return [ends[order[:n]] - 1 - t for t, n in enumerate(alive)]
    return [ends[order[:n]] - sizes[order[:n]] + t for t, n in enumerate(alive)]


def run(x: np.ndarray, plan: list[np.ndarray], wx: np.ndarray, wh: np.ndarray, bias: np.ndarray, keep: bool = False):
    """States of all rows; with `keep` also what the gradient needs."""
    hidden = wh.shape[0]
    projected = x @ wx + bias
    out = np.empty((len(x), hidden))
    h = c = np.zeros((len(plan[0]) if plan else 0, hidden))
    saved = []
    for at in plan:
        n = len(at)
        before, old = h[:n], c[:n]
        z = projected[at] + before @ wh
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = np.split(gates, 3, axis=1)
        g = np.tanh(z[:, 3 * hidden:])
        c = f * old + i * g
        tc = np.tanh(c)
        h = o * tc
        out[at] = h
        if keep:
            saved.append((before, old, i, f, o, g, tc))
    return out, saved


def gradients(x: np.ndarray, plan: list[np.ndarray], wx: np.ndarray, wh: np.ndarray, saved: list, d_out: np.ndarray):
    """Gradients of the inputs and of the three parameters for the gradient of the states."""
    hidden = wh.shape[0]
    dz_all = np.zeros((len(x), 4 * hidden))
    d_wh = np.zeros_like(wh)
    dh_next = dc_next = np.zeros((0, hidden))
    for at, (before, old, i, f, o, g, tc) in zip(reversed(plan), reversed(saved)):
        dh = d_out[at].copy()
        m = len(dh_next)
        dh[:m] += dh_next
        dc = dh * o * (1 - tc * tc)
        dc[:m] += dc_next
        dz = np.concatenate((dc * g * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
        dz_all[at] = dz
        d_wh += before.T @ dz
        dh_next, dc_next = dz @ wh.T, dc * f
    return dz_all @ wx.T, x.T @ dz_all, d_wh, dz_all.sum(axis=0)


class Adam:
    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.parameters, self.rate, self.count = parameters, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.square = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.count += 1
        for k, g in grads.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            scale = self.rate * np.sqrt(1 - 0.999**self.count) / (1 - 0.9**self.count)
            self.parameters[k] -= scale * self.mean[k] / (np.sqrt(self.square[k]) + 1e-8)
