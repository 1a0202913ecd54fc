"""A bidirectional gated recurrent network over bytes, in numpy: training by backpropagation through time, and use.

Two layers of gated units read the bytes from either end; at every byte their two states give the logits of its
language. One table holds each byte's contribution to the gates, so the input costs a lookup. Both directions are
computed side by side: arrays have the gate (update, reset, new) and the direction as their first axes.
"""

from __future__ import annotations

import numpy as np

H = 16
#: The byte that fills up a short piece. Its gates are closed and its state is 0, so it adds nothing and hands nothing on.
PAD = 256
_CLOSED = np.array([-200, -200, 0], np.float32)[:, None, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # of a closed gate
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


def _both(x: np.ndarray) -> np.ndarray:
    """[T, 2, B]: the bytes in the order in which either direction reads them."""
    return np.stack([x, x[::-1]], axis=1)


class Network:
    """Parameters: W [3, 2, 257, H] per byte, U [3, 2, H, H], c [2, 1, H], and for the logits V [2, H, classes], d."""

    def __init__(self, classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {
            "W": f(3, 2, 257, H, k=0.3), "U": f(3, 2, H, H, k=H**-0.5), "c": np.zeros((2, 1, H), np.float32),
            "V": f(2, H, classes, k=(2 * H) ** -0.5), "d": np.zeros(classes, np.float32),
        }
        self.p["W"][:, :, PAD] = _CLOSED

    def states(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States [T, 2, B, H] of both directions, each in its own order, for bytes [T, B]; and what the way back needs."""
        W, U, c = self.p["W"], self.p["U"], self.p["c"]
        steps, lanes = x.shape
        at = _both(x)[:, None] + (np.arange(6) * 257).reshape(1, 3, 2, 1)
        a = W.reshape(-1, H)[at]
        h = np.zeros((steps + 1, 2, lanes, H), W.dtype)
        zr, q, n = np.empty((steps, 2, 2, lanes, H), W.dtype), np.empty((steps, 2, lanes, H), W.dtype), np.empty((steps, 2, lanes, H), W.dtype)
        g = np.empty((3, 2, lanes, H), W.dtype)
        for t in range(steps):
            np.matmul(h[t], U, out=g)
            np.add(a[t, :2], g[:2], out=zr[t])
            _sigmoid(zr[t])
            np.add(g[2], c, out=q[t])
            np.multiply(zr[t, 1], q[t], out=n[t])
            n[t] += a[t, 2]
            np.tanh(n[t], out=n[t])
            new = h[t + 1]  # n + z * (h - n)
            np.subtract(h[t], n[t], out=new)
            new *= zr[t, 0]
            new += n[t]
        return h[1:], (h[:-1], zr, q, n)

    def backward(self, x: np.ndarray, tape: tuple, dh_at: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of W, U, c from those of the states [T, 2, B, H], by backpropagation through time."""
        h, zr, q, n = tape
        z, r = zr[:, 0], zr[:, 1]
        steps, _, lanes, _ = n.shape
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (h - n) * z * (1 - z), q * r * (1 - r)
        back = np.ascontiguousarray(self.p["U"].transpose(0, 1, 3, 2))
        gates, new = np.empty((steps, 3, 2, lanes, H), n.dtype), np.empty_like(n)
        dh, sent = np.zeros_like(dh_at[0]), np.empty((3, 2, lanes, H), n.dtype)
        for t in range(steps - 1, -1, -1):
            dh += dh_at[t]
            dn, d = new[t], gates[t]
            np.multiply(dh, by_n[t], out=dn)
            np.multiply(dh, by_z[t], out=d[0])
            np.multiply(dn, by_r[t], out=d[1])
            np.multiply(dn, r[t], out=d[2])
            np.matmul(d, back, out=sent)
            dh *= z[t]
            dh += sent[0]
            dh += sent[1]
            dh += sent[2]
        flat = gates.transpose(1, 2, 0, 3, 4).reshape(3, 2, -1, H)
        dU = np.ascontiguousarray(h.transpose(1, 3, 0, 2).reshape(2, H, -1)) @ flat
        dW = np.zeros_like(self.p["W"])
        for d, which in enumerate((x.reshape(-1), x[::-1].reshape(-1))):  # sums per byte, by sorting
            order = np.argsort(which, kind="stable")
            seen, first = np.unique(which[order], return_index=True)
            rows = np.concatenate([flat[0, d], flat[1, d], new[:, d].reshape(-1, H)], axis=1)
            dW[:, d, seen] = np.add.reduceat(rows[order], first, axis=0).reshape(-1, 3, H).transpose(1, 0, 2)
        return {"W": dW, "U": dU, "c": gates[:, 2].sum(axis=(0, 2))[:, None]}

    def logits_of(self, h: np.ndarray) -> np.ndarray:
        """[T, B, classes] from states [T, 2, B, H]."""
        return h[:, 0] @ self.p["V"][0] + h[::-1, 1] @ self.p["V"][1] + self.p["d"]

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 256, rate: float = 0.02, trim: float = 0.15, seed: int = 3) -> None:
        """Adam on the mean loss over all bytes of windows x [n, T], short ones filled up with PAD, with a label for
        every byte, y [n, T].

        After the first third, the windows of the highest loss (a share of trim) are left out of each step, since some
        labels are wrong.
        """
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = r.integers(0, len(x), batch)
            xt, yt = np.ascontiguousarray(x[pick].T), np.ascontiguousarray(y[pick].T)[..., None]
            h, tape = self.states(xt)
            prob = self.logits_of(h)
            prob -= prob.max(axis=2, keepdims=True)
            np.exp(prob, out=prob)
            prob /= prob.sum(axis=2, keepdims=True)
            live = (xt != PAD).astype(np.float32)
            own = np.take_along_axis(prob, yt, axis=2)
            loss = -(np.log(np.maximum(own[..., 0], 1e-9)) * live).sum(axis=0) / live.sum(axis=0)
            if step > steps // 3:
                live[:, np.argsort(loss)[int(batch * (1 - trim)) :]] = 0
            np.put_along_axis(prob, yt, own - 1, axis=2)
            prob *= (live / live.sum())[..., None]
            dh = np.empty_like(h)
            dh[:, 0] = prob @ self.p["V"][0].T
            dh[:, 1] = prob[::-1] @ self.p["V"][1].T
            grad = self.backward(xt, tape, dh)
            flat = prob.reshape(-1, prob.shape[2])
            grad["V"] = np.stack([h[:, 0].reshape(-1, H).T @ flat, h[::-1, 1].reshape(-1, H).T @ flat])
            grad["d"] = flat.sum(axis=0)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 1.0 / (size + 1e-9))
            lr = rate * (1 - step / (steps + 1)) + 0.001
            for k, g in grad.items():
                g = g * scale
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
            self.p["W"][:, :, PAD] = _CLOSED

    def read(self, x: np.ndarray, keep: bool) -> np.ndarray:
        """The states for bytes [T, B] as of states(), or, without keep, only their sum over T, [2, B, H].

        Faster than states(): no tape, buffers used again, and sigmoid(v) as (1 + tanh(v / 2)) / 2.
        """
        half = np.float32(0.5)
        W, U = self.p["W"].copy(), self.p["U"] * half
        W[:2] *= half
        W = W.reshape(-1, H)
        steps, lanes = x.shape
        c = np.repeat(self.p["c"] * half, lanes, axis=1)
        at = _both(x)[:, None] + (np.arange(6) * 257).reshape(1, 3, 2, 1)
        a, g = np.empty((3, 2, lanes, H), np.float32), np.empty((3, 2, lanes, H), np.float32)
        zr, z, r, n, q = g[:2], g[0], g[1], a[2], g[2]
        h, u, total = np.zeros((2, lanes, H), np.float32), np.empty((2, lanes, H), np.float32), np.zeros((2, lanes, H), np.float32)
        out = np.empty((steps, 2, lanes, H), np.float32) if keep else None
        for t in range(steps):
            np.take(W, at[t], axis=0, out=a, mode="clip")
            np.matmul(h, U, out=g)
            zr += a[:2]
            np.tanh(zr, out=zr)
            q += c
            n += q
            r *= q
            n += r
            np.tanh(n, out=n)
            np.subtract(h, n, out=u)
            u *= half
            np.multiply(z, u, out=h)
            h += u
            h += n
            if keep:
                out[t] = h
            else:
                total += h
        return out if keep else total

    def _parts(self, flat: np.ndarray, begin: np.ndarray, lens: np.ndarray, most: int, lanes: int):
        """Lanes of pieces' parts of like length: (numbers of their pieces, offsets within them, bytes [T, B])."""
        count = np.maximum(1, -(-lens // most))
        owner = np.repeat(np.arange(len(lens)), count)
        nth = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * most
        n = np.minimum(most, lens[owner] - nth)
        at = begin[owner] + nth
        order = np.argsort(n, kind="stable")
        for k in range(0, len(order), lanes):
            who = order[k : k + lanes]
            steps = np.arange(n[who].max())[:, None]
            if len(steps):
                yield owner[who], nth[who], np.where(steps < n[who], flat[np.minimum(at[who] + steps, len(flat) - 1)].astype(np.intp), PAD)

    def pooled(self, flat: np.ndarray, begin: np.ndarray, lens: np.ndarray, most: int = 256, lanes: int = 512) -> np.ndarray:
        """[pieces, classes]: the logits of all bytes of each piece, added up; a piece is flat[begin : begin + len].

        Logits are linear in the states, so these are summed and the logits computed once a piece. The sum differs from
        that of the log-probabilities by the same number for all classes. Pieces of more than `most` bytes are read in
        parts. Parts of like length run side by side; a piece's result doesn't depend on its neighbours.
        """
        out = np.zeros((len(lens), len(self.p["d"])), np.float32)
        for who, _, x in self._parts(flat, begin, lens, most, lanes):
            h = self.read(x, False)
            np.add.at(out, who, h[0] @ self.p["V"][0] + h[1] @ self.p["V"][1])
        return out + self.p["d"] * lens[:, None].astype(np.float32)

    def labelled(self, flat: np.ndarray, begin: np.ndarray, lens: np.ndarray, most: int = 256, lanes: int = 256) -> list[np.ndarray]:
        """Per piece the logits of every byte, [len, classes]."""
        out = [np.zeros((n, len(self.p["d"])), np.float32) for n in lens.tolist()]
        for who, nth, x in self._parts(flat, begin, lens, most, lanes):
            each = self.logits_of(self.read(x, True))
            for b, (k, at) in enumerate(zip(who.tolist(), nth.tolist())):
                n = min(most, len(out[k]) - at)
                out[k][at : at + n] = each[:n, b]
        return out
