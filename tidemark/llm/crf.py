"""A linear-chain conditional random field over clauses, in numpy: sparse features, five labels, exact inference."""

from __future__ import annotations

import numpy as np


class Crf:
    """Weights of hashed features and of label pairs. Sequences are given flat: `feats` lists all clauses' feature numbers one after
    the other, `ends` where each clause ends in it, and `rows` to which sequence each clause belongs, in order."""

    def __init__(self, labels: int, width: int):
        self.w = np.zeros((width, labels))
        self.pair = np.zeros((labels, labels))
        self.first = np.zeros(labels)

    def _emit(self, feats: np.ndarray, ends: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], ends[:-1]])
        return np.add.reduceat(self.w[feats], starts, axis=0)

    @staticmethod
    def _padded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, longest) of clause numbers, -1 beyond a sequence's end; and the sequences' lengths."""
        n = int(rows[-1]) + 1
        size = np.bincount(rows, minlength=n)
        at = np.arange(len(rows)) - (np.cumsum(size) - size)[rows]
        out = np.full((n, int(size.max())), -1)
        out[rows, at] = np.arange(len(rows))
        return out, size

    def fit(self, feats: np.ndarray, ends: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 80, rate: float = 0.3, ridge: float = 1e-5) -> None:
        """Maximises the regularised conditional likelihood by Adam, each sequence with its weight. Sequences must be no longer than
        some dozens of clauses."""
        pad, size = self._padded(rows)
        n, longest = pad.shape
        k = len(self.first)
        weight = np.ones(n) if weight is None else weight / weight.mean()
        of_clause = weight[rows][:, None]
        # A weight without a feature here has no gradient and stays as it is: the steps go over the others alone.
        used, feats = np.unique(feats, return_inverse=True)
        every, self.w = self.w, self.w[used]
        # Longest first, so that at each place the sequences that reach it are the first ones.
        by = np.argsort(-size, kind="stable")
        pad, size, weight = pad[by], size[by], weight[by]
        live = [int((size > i).sum()) for i in range(longest)]
        yp = np.where(pad >= 0, y[pad], 0)
        starts = np.concatenate([[0], ends[:-1]])
        reps = ends - starts
        params = [self.w, self.pair, self.first]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        onehot = np.eye(k)[y]
        for t in range(1, steps + 1):
            e = self._emit(feats, ends)
            a, b = np.zeros((longest, n, k)), np.zeros((longest, n, k))
            a[0] = self.first + e[pad[:, 0]]
            for i in range(1, longest):
                x = a[i - 1, : live[i], :, None] + self.pair
                top = x.max(axis=1)
                a[i, : live[i]] = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1)) + e[pad[: live[i], i]]
            end = a[size - 1, np.arange(n)]
            top = end.max(axis=1)
            z = top + np.log(np.exp(end - top[:, None]).sum(axis=1))
            gp = np.zeros_like(self.pair)
            for i in range(longest - 2, -1, -1):
                on = live[i + 1]
                x = self.pair + (e[pad[:on, i + 1]] + b[i + 1, :on])[:, None, :]
                top = x.max(axis=2)
                b[i, :on] = top + np.log(np.exp(x - top[:, :, None]).sum(axis=2))
                gp += (np.exp(a[i, :on, :, None] + x - z[:on, None, None]) * weight[:on, None, None]).sum(axis=0)
                np.add.at(gp, (yp[:on, i], yp[:on, i + 1]), -weight[:on])
            marg = np.empty_like(e)
            for i in range(longest):
                marg[pad[: live[i], i]] = np.exp(a[i, : live[i]] + b[i, : live[i]] - z[: live[i], None])
            diff = (marg - onehot) * of_clause
            gw = np.stack([np.bincount(feats, weights=np.repeat(diff[:, j], reps), minlength=len(self.w)) for j in range(k)], axis=1)
            gf = diff[pad[:, 0]].sum(axis=0)
            for q, (par, g) in enumerate(zip(params, (gw, gp, gf))):
                g = g / n + ridge * par
                m[q] = 0.9 * m[q] + 0.1 * g
                v[q] = 0.99 * v[q] + 0.01 * g * g
                par -= rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.99**t)) + 1e-8)
        every[used] = self.w
        self.w = every

    def tag(self, feats: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The most likely labels of all clauses (Viterbi), of sequences of any length."""
        e = self._emit(feats, ends)
        out = np.empty(len(ends), np.int64)
        size = np.bincount(rows)
        first = np.cumsum(size) - size
        # Sequences of like length go together, so that a long one pads no short one.
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        k = len(self.first)
        lo = 0
        while lo < len(order):
            hi = np.searchsorted(size[order], max(4, 2 * size[order[lo]]), "right")
            part = order[lo:hi]
            n, longest = len(part), int(size[part].max())
            back = np.zeros((longest, n, k), np.int8)
            s = self.first + e[first[part]]
            for i in range(1, longest):
                x = s[:, :, None] + self.pair[None]
                on = i < size[part]
                back[i] = np.where(on[:, None], x.argmax(axis=1), np.arange(k)[None])
                nxt = x.max(axis=1) + e[np.minimum(first[part] + i, len(e) - 1)]
                s = np.where(on[:, None], nxt, s)
            lab = s.argmax(axis=1)
            for i in range(longest - 1, -1, -1):
                on = i < size[part]
                out[first[part][on] + i] = lab[on]
                lab = back[i][np.arange(n), lab]
            lo = hi
        return out
