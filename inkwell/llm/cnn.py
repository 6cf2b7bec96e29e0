"""A small convolutional network over bytes, in numpy: embedding, filters of several widths,
maximum over positions, one dense layer and softmax. Trained with Adam on the driver from a
bounded set of windows; applied on executors to batches of windows of one fixed length.
"""

from __future__ import annotations

import numpy as np

PAD = 0


class ByteCNN:
    def __init__(self, classes: int, length: int, widths=(2, 3, 4), filters: int = 16, dim: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.length, self.dim, self.wide = length, dim, max(widths)
        self.emb = rng.normal(0, 0.5, (256, dim)).astype(np.float32)
        n = filters * len(widths)
        # All widths share one matrix product; narrower filters have zeros beyond their width.
        self.mask = np.zeros((self.wide * dim, n), np.float32)
        for i, w in enumerate(widths):
            self.mask[: w * dim, i * filters : (i + 1) * filters] = 1
        self.conv = rng.normal(0, 1, self.mask.shape).astype(np.float32) * self.mask / np.sqrt(self.mask.sum(0, keepdims=True))
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 1 / np.sqrt(n), (n, classes)).astype(np.float32)
        self.base = np.zeros(classes, np.float32)

    def _windows(self, x: np.ndarray) -> np.ndarray:
        """(n, length) bytes to (n, length, wide * dim): each position with what follows it."""
        n = len(x)
        e = np.zeros((n, self.length + self.wide - 1, self.dim), np.float32)
        e[:, : self.length] = np.take(self.emb, x, axis=0)
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (n, self.length, self.wide * self.dim), (s[0], s[1], e.itemsize))

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = self._windows(x)
        a = np.ascontiguousarray(v).reshape(-1, v.shape[2]) @ self.conv
        return v, a.reshape(len(x), self.length, -1), None

    def logits(self, x: np.ndarray, batch: int = 64) -> np.ndarray:
        """Class scores of (n, length) bytes."""
        out = np.empty((len(x), len(self.base)), np.float32)
        for i in range(0, len(x), batch):
            _, a, _ = self._pooled(x[i : i + batch])
            h = np.maximum(a.max(1) + self.bias, 0)
            out[i : i + batch] = h @ self.out + self.base
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 4e-3, weights: np.ndarray | None = None, seed: int = 3) -> ByteCNN:
        rng = np.random.default_rng(seed)
        names = ("emb", "conv", "bias", "out", "base")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        weights = np.ones(len(y), np.float32) if weights is None else weights.astype(np.float32)
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                pick = order[i : i + batch]
                g = self._gradients(x[pick], y[pick], weights[pick])
                t += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    step = rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - step).astype(np.float32))
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
        n = len(y)
        v, a, _ = self._pooled(x)
        at = a.argmax(1)
        raw = np.take_along_axis(a, at[:, None, :], 1)[:, 0] + self.bias
        h = np.maximum(raw, 0)
        p = softmax(h @ self.out + self.base)
        d = p
        d[np.arange(n), y] -= 1
        d *= w[:, None] / max(float(w.sum()), 1e-9)
        dh = (d @ self.out.T) * (raw > 0)
        seen = v[np.arange(n)[:, None], at]  # (n, filters, wide * dim)
        demb = np.zeros_like(self.emb)
        back = (dh[:, :, None] * self.conv.T[None]).reshape(n, -1, self.wide, self.dim)
        for j in range(self.wide):
            pos = at + j
            ok = pos < self.length
            code = np.where(ok, x[np.arange(n)[:, None], np.minimum(pos, self.length - 1)], PAD)
            np.add.at(demb, code[ok], back[:, :, j][ok])
        return {
            "emb": demb,
            "conv": np.einsum("nf,nfk->kf", dh, seen) * self.mask,
            "bias": dh.sum(0),
            "out": h.T @ d,
            "base": d.sum(0),
        }


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def cut(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into consecutive windows: (bytes, row of each, valid bytes of each)."""
    size = np.diff(offsets)
    n = -(-size // length)
    row = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][row] + nth * length
    valid = np.minimum(length, size[row] - nth * length)
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(padded, length)[start]
    short = np.flatnonzero(valid < length)
    x[short] *= np.arange(length)[None] < valid[short, None]
    return x, row, valid
