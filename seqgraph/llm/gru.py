"""Gated recurrent language model in numpy with a class-factored softmax output.

Symbols are ordered by mass and cut into classes of equal size; the probability of the next symbol is that of its class
times that within the class. Training is backpropagation truncated to windows, with the state carried from window to
window; scoring carries it through the whole document.
"""

from __future__ import annotations

import numpy as np

WINDOW = 32
#: Symbols of a document that are learned in one go, at most; scoring carries the state through whole documents.
PIECE = 512


def _exp(a: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """exp in place, up to a factor for each row; bounds: how large outputs can be at all, as states lie between -1 and 1."""
    if float(bounds.max()) > 60:
        a -= a.max(1, keepdims=True)
    return np.exp(a, out=a)


def _row_sums(a: np.ndarray) -> np.ndarray:
    return a @ np.ones(a.shape[1], a.dtype)


class Gru:
    """Weights: inputs G (for each gate, a row for each symbol), U (for each gate); class outputs C, c; symbol outputs O, o. All float32."""

    NAMES = ("G", "U", "C", "c", "O", "o")

    def __init__(self, mass: np.ndarray, hidden: int = 16, per_class: int = 32, seed: int = 5):
        """mass: how often each symbol occurs, in descending order, a multiple of per_class of them; the output starts at it."""
        rng, n = np.random.default_rng(seed), len(mass)
        self.hidden, self.per_class = hidden, per_class
        p = (mass + 0.5) / (mass + 0.5).sum()
        by_class = p.reshape(-1, per_class)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.G, self.U = normal(3, n, hidden, scale=0.3), normal(3, hidden, hidden, scale=0.25)
        self.G[0] += 1.0  # keep the state at first
        self.C, self.c = normal(hidden, n // per_class, scale=0.02), np.log(by_class.sum(1)).astype(np.float32)
        self.O, self.o = normal(n, hidden, scale=0.02), np.log(p).astype(np.float32)

        self.spaces: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"spaces": {}}

    def _space(self, name: str, rows: int, width: int) -> np.ndarray:
        """Room for a large array, which is used again: fresh memory for each window costs more than the arithmetic."""
        held = self.spaces.get(name)
        if held is None or len(held) < rows or held.shape[1] != width or held.dtype != self.O.dtype:
            held = self.spaces[name] = np.empty((rows, width), self.O.dtype)
        return held[:rows]

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, k) for k in self.NAMES]

    def set_weights(self, w: list[np.ndarray]) -> None:
        for k, x in zip(self.NAMES, w, strict=True):
            setattr(self, k, x)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state for symbols x; also the gates, for training. The logistic function is half of tanh(half) and a half."""
        g, u = self.G.take(x, 1), h @ self.U
        zr = g[:2]
        zr += u[:2]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r, un = zr[0], zr[1], u[2]
        n = r * un
        n += g[2]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, un

    def _classes(self, h: np.ndarray) -> np.ndarray:
        a = np.matmul(h, self.C, out=self._space("classes", len(h), len(self.c)))
        a += self.c
        return _exp(a, np.abs(self.C).sum(0) + np.abs(self.c))

    def _within(self, h: np.ndarray, cuts: list[int]) -> np.ndarray:
        """Exponentials of the symbols' outputs in the class of each row; rows are sorted by class, cuts say where each begins."""
        out = self._space("within", len(h), self.per_class)
        for k in range(len(self.c)):
            if cuts[k] < cuts[k + 1]:
                rows, part = slice(k * self.per_class, (k + 1) * self.per_class), out[cuts[k] : cuts[k + 1]]
                np.matmul(h[cuts[k] : cuts[k + 1]], self.O[rows].T, out=part)
                part += self.o[rows]
        return _exp(out, np.abs(self.O).sum(1) + np.abs(self.o))

    def _by_class(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
        """Class of each symbol, the order by class, where each class begins in it, and places within classes in that order."""
        cls = (symbols // self.per_class).astype(np.uint16)
        order = np.argsort(cls, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(cls, minlength=len(self.c))))).tolist()
        return cls, order, cuts, (symbols % self.per_class)[order]

    def log_prob(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probability of symbols y after states h."""
        cls, order, cuts, place = self._by_class(y)
        rows = np.arange(len(y))
        a, b = self._classes(h), self._within(np.take(h, order, 0, out=self._space("sorted", len(h), self.hidden), mode="clip"), cuts)
        out = a[rows, cls] / _row_sums(a)
        out[order] *= b[rows, place] / _row_sums(b)
        return np.log(out)

    def score(self, symbols: np.ndarray, starts: np.ndarray, first: int) -> np.ndarray:
        """Natural log-probability of each whole document: symbols[starts[i]:starts[i + 1]], read after the symbol first.

        All documents advance together, longest first, so that those still running are always a prefix.
        """
        sizes = np.diff(starts)
        order = np.argsort(-sizes, kind="stable")
        at, left = starts[:-1][order], sizes[order]
        total, h = np.zeros(len(sizes)), np.zeros((len(sizes), self.hidden), np.float32)
        x, t, longest = np.full(len(sizes), first), 0, int(left[0]) if len(left) else 0
        live = np.searchsorted(-left, -np.arange(longest), side="left")  # documents longer than t
        while t < longest:
            states, targets, who = [], [], []
            for k in range(t, min(t + WINDOW, longest)):
                n = live[k]
                h = self.step(x[:n], h[:n])[0]
                x = symbols[at[:n] + k]
                states.append(h)
                targets.append(x)
                who.append(n)
            logs = self.log_prob(np.concatenate(states), np.concatenate(targets))
            for part, n in zip(np.split(logs, np.cumsum(who)[:-1]), who, strict=True):
                total[:n] += part
            t += WINDOW
        out = np.empty(len(sizes))
        out[order] = total
        return out

    def _gradients(self, xs: list[np.ndarray], ys: list[np.ndarray], h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, int]:
        """Gradients of the mean loss over one window (documents that end leave from the back), the last state."""
        cache, states = [], []
        for x in xs:
            h = h[: len(x)]
            new, z, r, n, un = self.step(x, h)
            cache.append((x, h, z, r, n, un))
            states.append(new)
            h = new
        y = np.concatenate(ys)
        H = np.concatenate(states, out=self._space("states", len(y), self.hidden))
        count, ones = len(y), np.ones(len(y), H.dtype)
        cls, order, cuts, place = self._by_class(y)
        rows = np.arange(count)
        a = self._classes(H)
        a *= (1 / (count * _row_sums(a)))[:, None]
        a[rows, cls] -= 1 / count
        dC, dc, dH = H.T @ a, ones @ a, np.matmul(a, self.C.T, out=self._space("slopes", count, self.hidden))
        dO, do = np.zeros_like(self.O), np.zeros_like(self.o)
        sorted_h = np.take(H, order, 0, out=self._space("sorted", count, self.hidden), mode="clip")
        b = self._within(sorted_h, cuts)
        b *= (1 / (count * _row_sums(b)))[:, None]
        b[rows, place] -= 1 / count
        back = self._space("back", count, self.hidden)
        for c in range(len(self.c)):
            lo, hi = cuts[c], cuts[c + 1]
            if lo < hi:
                some = slice(c * self.per_class, (c + 1) * self.per_class)
                dO[some], do[some] = b[lo:hi].T @ sorted_h[lo:hi], ones[lo:hi] @ b[lo:hi]
                np.matmul(b[lo:hi], self.O[some], out=back[lo:hi])
        place_of = np.empty(count, np.int64)
        place_of[order] = rows
        dH += np.take(back, place_of, 0, out=self._space("sorted", count, self.hidden), mode="clip")
        dU = np.zeros_like(self.U)
        gates = [self._space(f"gate {g}", count, self.hidden) for g in range(3)]
        stops = np.cumsum([len(s) for s in states]).tolist()
        after = np.zeros((0, self.hidden), H.dtype)
        for (x, prev, z, r, n, un), stop in zip(reversed(cache), reversed(stops), strict=True):
            d, inner = dH[stop - len(x) : stop], np.empty((3, len(x), self.hidden), H.dtype)
            d[: len(after)] += after
            dz, dr, dn = inner
            np.subtract(1, z, out=dz)
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= dz
            dn *= d
            prev_less = prev - n
            dz *= prev_less
            dz *= z
            dz *= d
            np.subtract(1, r, out=dr)
            dr *= r
            dr *= un
            dr *= dn
            for g in range(3):
                gates[g][stop - len(x) : stop] = inner[g]
            dn *= r
            dU += prev.T @ inner
            after = (inner @ self.U.transpose(0, 2, 1)).sum(0)
            d *= z
            after += d
        dG = np.zeros_like(self.G)
        _, order, cuts, place = self._by_class(np.concatenate(xs))
        one_hot = self._space("within", count, self.per_class)
        one_hot[:] = 0
        one_hot[rows, place] = 1
        for g in range(3):
            gate = np.take(gates[g], order, 0, out=self._space("sorted", count, self.hidden), mode="clip")
            for c in range(len(self.c)):
                lo, hi = cuts[c], cuts[c + 1]
                if lo < hi:
                    np.matmul(one_hot[lo:hi].T, gate[lo:hi], out=dG[g, c * self.per_class : (c + 1) * self.per_class])
        return [dG, dU, dC, dc, dO, do], h, count

    def train(self, docs: list[np.ndarray], first: int, rate: float = 0.01, batch: int = 32, epochs: int = 1, seed: int = 0, moments: list | None = None) -> int:
        """Adam over windows of WINDOW symbols; pieces of documents of like length run side by side. Returns the symbols seen.

        A piece has PIECE symbols, through which the state is carried; one within a document starts with the symbol before it.

        moments (an empty list at first) carries Adam's state from one call to the next.
        """
        moments = [] if moments is None else moments
        if not moments:
            moments += [0, [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights()]]
        rng, seen = np.random.default_rng(seed), 0
        pieces = [d[lo : lo + PIECE] for d in docs for lo in range(0, len(d), PIECE)]
        before = [d[lo - 1] if lo else first for d in docs for lo in range(0, len(d), PIECE)]
        by_size = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        groups = [by_size[i : i + batch] for i in range(0, len(by_size), batch)]
        for _ in range(epochs):
            for g in rng.permutation(len(groups)).tolist():
                group, h = [pieces[i] for i in groups[g]], np.zeros((len(groups[g]), self.hidden), np.float32)
                sizes = np.array([len(d) for d in group])
                flat, at = np.concatenate(group).astype(np.int64), np.cumsum(sizes) - sizes
                live = np.searchsorted(-sizes, -np.arange(len(group[0])), side="left").tolist()  # pieces longer than t
                x = np.array([before[i] for i in groups[g]], np.int64)
                for lo in range(0, len(group[0]), WINDOW):
                    xs, ys = [], []
                    for t in range(lo, min(lo + WINDOW, len(group[0]))):
                        xs.append(x[: live[t]])
                        x = flat[at[: live[t]] + t]
                        ys.append(x)
                    grads, h, count = self._gradients(xs, ys, h)
                    seen, moments[0] = seen + count, moments[0] + 1
                    size, turn = np.sqrt(sum(float(np.vdot(g_, g_)) for g_ in grads)), moments[0]
                    for w, g_, (m, v) in zip(self.weights(), grads, moments[1], strict=True):
                        g_ *= min(1.0, 1.0 / (size + 1e-9))
                        m += 0.1 * (g_ - m)
                        v += 0.01 * (g_ * g_ - v)
                        w -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
        return seen
