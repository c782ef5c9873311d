"""Small bidirectional recurrent networks in numpy: forward pass, backpropagation through time, Adam.

Arrays run time first: (steps, rows, values). A mask (steps, rows) of 1 and 0 says which steps
exist; a missing step leaves the state as it is, so padding may stand at the end.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


class GatedCell:
    """Gated recurrent unit; gates in the order update, reset, candidate."""

    gates = 3

    @staticmethod
    def forward(pre, mask, u, keep):
        steps, rows, _ = pre.shape
        h = np.zeros((rows, u.shape[0]), pre.dtype)
        out = np.empty((steps, rows, u.shape[0]), pre.dtype)
        tape = []
        k = u.shape[0]
        for t in range(steps):
            q = h @ u
            zr = sigmoid(pre[t, :, : 2 * k] + q[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(pre[t, :, 2 * k :] + r * q[:, 2 * k :])
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[t][:, None] > 0, new, h)
            if keep:
                tape.append((h, z, r, n, q[:, 2 * k :]))
            h = out[t] = new
        return out, tape

    @staticmethod
    def backward(d_out, mask, u, tape):
        k = u.shape[0]
        d_u = np.zeros_like(u)
        d_pre = np.empty((*d_out.shape[:2], 3 * k), u.dtype)
        d_h = np.zeros_like(d_out[0])
        for t in range(len(tape) - 1, -1, -1):
            h, z, r, n, qn = tape[t]
            d = d_h + d_out[t]
            live = d if mask is None else d * mask[t][:, None]
            d_n = live * (1 - z) * (1 - n * n)
            d_z = live * (h - n) * z * (1 - z)
            d_r = d_n * qn * r * (1 - r)
            d_pre[t] = np.concatenate((d_z, d_r, d_n), axis=1)
            d_q = np.concatenate((d_z, d_r, d_n * r), axis=1)
            d_u += h.T @ d_q
            d_h = live * z + d_q @ u.T + (d - live)
        return d_pre, d_u


class LongShortCell:
    """Long short-term memory; gates in the order input, forget, output, candidate."""

    gates = 4

    @staticmethod
    def forward(pre, mask, u, keep):
        steps, rows, _ = pre.shape
        k = u.shape[0]
        h, c = np.zeros((rows, k), pre.dtype), np.zeros((rows, k), pre.dtype)
        out = np.empty((steps, rows, k), pre.dtype)
        tape = []
        for t in range(steps):
            a = pre[t] + h @ u
            gates = sigmoid(a[:, : 3 * k])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            g = np.tanh(a[:, 3 * k :])
            new_c = f * c + i * g
            s = np.tanh(new_c)
            new_h = o * s
            if mask is not None:
                m = mask[t][:, None] > 0
                new_c, new_h = np.where(m, new_c, c), np.where(m, new_h, h)
            if keep:
                tape.append((h, c, i, f, o, g, s))
            h, c = new_h, new_c
            out[t] = h
        return out, tape

    @staticmethod
    def backward(d_out, mask, u, tape):
        k = u.shape[0]
        d_u = np.zeros_like(u)
        d_pre = np.empty((*d_out.shape[:2], 4 * k), u.dtype)
        d_h, d_c = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for t in range(len(tape) - 1, -1, -1):
            h, c, i, f, o, g, s = tape[t]
            m = 1.0 if mask is None else mask[t][:, None]
            d = d_h + d_out[t]
            live = d * m
            cell = d_c * m + live * o * (1 - s * s)
            d_a = np.concatenate((cell * g * i * (1 - i), cell * c * f * (1 - f), live * s * o * (1 - o), cell * i * (1 - g * g)), axis=1)
            d_pre[t] = d_a
            d_u += h.T @ d_a
            d_h = d_a @ u.T + (d - live)
            d_c = cell * f + (d_c - d_c * m)
        return d_pre, d_u


class Bidirectional:
    """Two cells, one for each direction, and a softmax over classes at every step.

    Inputs are either symbols (integers below `inputs`, looked up in a table) or vectors.
    """

    def __init__(self, cell, inputs: int, hidden: int, classes: int, symbols: bool, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.cell, self.symbols, self.hidden = cell, symbols, hidden
        scale = 0.3 if symbols else 1 / np.sqrt(inputs)
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p["w" + side] = rng.normal(0, scale, (inputs, cell.gates * hidden))
            self.p["u" + side] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, cell.gates * hidden))
            self.p["c" + side] = np.zeros(cell.gates * hidden)
        self.p["v"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, classes))
        self.p["d"] = np.zeros(classes)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x, mask, keep):
        p = self.p
        sides = {}
        for side in "fb":
            own = x if side == "f" else x[::-1]
            m = mask if side == "f" or mask is None else mask[::-1]
            pre = (p["w" + side] + p["c" + side])[own] if self.symbols else own @ p["w" + side] + p["c" + side]
            sides[side] = (*self.cell.forward(pre, m, p["u" + side], keep), own, m)
        h = np.concatenate((sides["f"][0], sides["b"][0][::-1]), axis=2)
        return h, sides

    def probabilities(self, x, mask=None) -> np.ndarray:
        h, _ = self._run(x, mask, False)
        return softmax(h @ self.p["v"] + self.p["d"])

    def gradients(self, x, mask, labels):
        """Gradients of the mean cross-entropy over existing steps, and its value."""
        h, sides = self._run(x, mask, True)
        prob = softmax(h @ self.p["v"] + self.p["d"])
        weight = np.ones(labels.shape, np.float32) if mask is None else mask
        total = weight.sum()
        picked = np.take_along_axis(prob, labels[..., None], axis=2)[..., 0]
        loss = float(-(np.log(picked + 1e-9) * weight).sum() / total)
        d = prob.copy()
        np.put_along_axis(d, labels[..., None], picked[..., None] - 1, axis=2)
        d *= (weight / total)[..., None]
        k = self.hidden
        grads = {"v": np.tensordot(h, d, ((0, 1), (0, 1))), "d": d.sum(axis=(0, 1))}
        d_h = d @ self.p["v"].T
        for side, part in (("f", d_h[..., :k]), ("b", d_h[..., k:][::-1])):
            _, tape, own, m = sides[side]
            d_pre, grads["u" + side] = self.cell.backward(part, m, self.p["u" + side], tape)
            flat = d_pre.reshape(-1, d_pre.shape[-1])
            if self.symbols:
                keys = own.ravel()
                grads["w" + side] = np.stack([np.bincount(keys, flat[:, j], len(self.p["w" + side])) for j in range(flat.shape[1])], axis=1)
            else:
                grads["w" + side] = own.reshape(-1, own.shape[-1]).T @ flat
            grads["c" + side] = flat.sum(axis=0)
        return grads, loss


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.steps = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.s = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], factor: float = 1.0) -> None:
        self.steps += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = (g * clip).astype(np.float32)
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.01 * (g * g - self.s[k])
            m, s = self.m[k] / (1 - 0.9**self.steps), self.s[k] / (1 - 0.99**self.steps)
            self.params[k] -= self.rate * factor * m / (np.sqrt(s) + 1e-8)
