"""A gated recurrent language model in numpy, with a class-factored softmax.

Every word belongs to one class. The network predicts the class of the next
word from its state, and within the classes of frequent words (the shortlist)
the word; all other words share the tail classes, in which counts decide. Documents lie one after
another in lanes that advance together; a lane's state is set to zero where a
document begins and else carried on from window to window, so a document's
likelihood is that of its whole text.

Steps work on arrays of (gate, lane, unit), so that each gate is one run of memory, and reuse them; the
softmax goes over blocks of states that a core's cache holds. What does not depend on the state
after (the factors of the backward pass, the gradient of ``u``) is taken for a whole window at once.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

BLOCK = 256  # states
PARAMETERS = 8_192


def lay_out(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Lane and offset of each sequence, longest first to the emptiest lane; and the length of the longest lane."""
    heap = [(0, i) for i in range(lanes)]
    lane, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        end, k = heap[0]
        lane[i], offset[i] = k, end
        heapq.heapreplace(heap, (end + int(lengths[i]), k))
    return lane, offset, max(e for e, _ in heap)


class Lanes:
    """Sequences in a (steps x lanes) grid: inputs, targets and where they begin."""

    def __init__(self, inputs: np.ndarray, classes: np.ndarray, words: np.ndarray, lengths: np.ndarray, pad: int, most: int = 512):
        total, longest = int(lengths.sum()), int(lengths.max())
        lanes = int(np.clip(total // max(longest, 1), 1, most))
        lane, offset, steps = lay_out(lengths, lanes)
        begin = np.cumsum(lengths) - lengths
        self.cell = np.repeat((offset - begin) * lanes + lane, lengths)  # of each token, in the order given
        self.cell += np.arange(0, total * lanes, lanes)
        self.shape = (steps, lanes)
        self.inputs = self._grid(inputs, pad)
        self.classes, self.words = self._grid(classes, -1), self._grid(words, -1)
        fresh = np.zeros(steps * lanes, bool)
        fresh[self.cell[begin[lengths > 0]]] = True
        self.fresh = fresh.reshape(self.shape)

    def _grid(self, values: np.ndarray, pad: int) -> np.ndarray:
        out = np.full(self.shape[0] * self.shape[1], pad, np.int32)
        out[self.cell] = values
        return out.reshape(self.shape)


class Gru:
    """Parameters and passes. ``bounds`` are the first shortlist words of the shortlist's classes, and the end of the last.
    A row of ``wc`` (``wo``) has a class's (word's) weights, and its bias last."""

    NAMES = ("embed", "w", "b", "u", "wc", "wo")

    def __init__(self, inputs: int, bounds: list[int], tails: int, embed: int = 24, hidden: int = 32, seed: int = 11, dtype=np.float32):
        r = np.random.default_rng(seed)
        self.bounds, self.tails, self.hidden = bounds, tails, hidden
        classes = len(bounds) - 1 + tails
        self.p = {
            "embed": r.standard_normal((inputs, embed)) * 0.3,
            "w": r.standard_normal((embed, 3 * hidden)) / np.sqrt(embed),
            "b": np.concatenate([np.ones(hidden), np.zeros(2 * hidden)]),  # at first the state is kept for long
            "u": r.standard_normal((hidden, 3 * hidden)) * 0.5 / np.sqrt(hidden),
            "wc": np.concatenate([(r.standard_normal((hidden, classes)) * 0.01).T, np.zeros((classes, 1))], 1),
            "wo": np.zeros((bounds[-1], hidden + 1)),
        }
        self.p = {k: v.astype(dtype) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Parts of a flat vector by the parameters' names, not copied."""
        out, at = {}, 0
        for k in self.NAMES:
            out[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape)
            at += self.p[k].size
        return out

    def set(self, flat: np.ndarray) -> None:
        self.p = {k: v.astype(self.p[k].dtype) for k, v in self.views(flat).items()}

    def table(self, inputs: np.ndarray | None = None) -> np.ndarray:
        """(gate, input, unit): what inputs add to the gates; for the update and the reset gate with the sign turned."""
        embed = self.p["embed"] if inputs is None else self.p["embed"][inputs]
        out = (embed @ self.p["w"] + self.p["b"]).reshape(len(embed), 3, self.hidden).transpose(1, 0, 2).copy()
        out[:2] *= -1
        return out

    def forward(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, table: np.ndarray, trace: bool = False):
        """States after each step of a window (``inputs`` are rows of ``table``), the last, and with ``trace`` what the backward pass needs."""
        n, (steps, lanes) = self.hidden, inputs.shape
        u = self.p["u"].reshape(n, 3, n).transpose(1, 0, 2).copy()
        u[:2] *= -1
        states, held = np.empty((steps, lanes, n), h.dtype), steps if trace else 1
        before, gates, news = np.empty((held, lanes, n), h.dtype), np.empty((held, 3, lanes, n), h.dtype), np.empty((held, lanes, n), h.dtype)
        x, starts = np.empty((3, lanes, n), h.dtype), fresh.any(1)
        for t in range(steps):
            k = t if trace else 0
            old, gate, new, state = before[k], gates[k], news[k], states[t]
            old[:] = h
            if starts[t]:
                old[fresh[t]] = 0
            np.take(table, inputs[t], 1, out=x, mode="clip")
            np.matmul(old, u, out=gate)
            z_r = gate[:2]
            z_r += x[:2]
            np.exp(z_r, out=z_r)
            z_r += 1
            np.reciprocal(z_r, out=z_r)
            np.multiply(gate[1], gate[2], out=new)
            new += x[2]
            np.tanh(new, out=new)
            np.subtract(old, new, out=state)
            state *= gate[0]
            state += new
            h = state
        return states, h, (before, gates, news)

    def outputs(self, states: np.ndarray, classes: np.ndarray, words: np.ndarray, grads: dict | None = None):
        """Natural log-probability of class and, for shortlist words, word; with ``grads`` (zeros before) also the gradient of their sum by the states."""
        wc, wo, n, first = self.p["wc"], self.p["wo"], self.hidden, np.array(self.bounds)
        norm = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x))
        size = float(norm(states).max(initial=0))
        with_one = np.empty((len(states), n + 1), states.dtype)
        with_one[:, :n], with_one[:, n] = states, 1
        back = np.empty_like(states) if grads is not None else None
        minus = np.full(max(len(wc), len(wo)), -1, states.dtype)

        def tame(weights: np.ndarray, groups: np.ndarray) -> np.ndarray:
            """Whether no logit of a group, of any state, is too large for an exponential, and the greatest is not too small for one."""
            reach = norm(weights[:, :n]) * size
            return (np.maximum.reduceat(weights[:, n] + reach, groups) < 80) & (np.maximum.reduceat(weights[:, n] - reach, groups) > -80)

        def softmax(own: np.ndarray, weights: np.ndarray, across: np.ndarray, small: bool, at: np.ndarray, hit: np.ndarray, total: np.ndarray, by_state: np.ndarray | None) -> np.ndarray:
            """Puts the targets' logits (at the places ``at``) and the sums of all exponentials, below zero, into ``hit`` and ``total``; gives the gradient by the logits."""
            e = own @ across
            if not small:
                e -= e.max(1, keepdims=True)
            flat = e.reshape(-1)
            flat.take(at, out=hit, mode="clip")
            np.exp(e, out=e)
            np.matmul(e, minus[: len(weights)], out=total)
            if by_state is not None:
                e /= total[:, None]
                flat[at] += 1
                np.matmul(e, weights[:, :n], out=by_state)
            return e

        small, across = bool(tame(wc, np.zeros(1, np.int64))[0]), wc.T.copy()
        hit, total = np.empty((2, len(states)), states.dtype)
        places = np.arange(len(states)) % BLOCK * len(wc) + classes
        for at in range(0, len(states), BLOCK):
            part = slice(at, at + BLOCK)
            d = softmax(with_one[part], wc, across, small, places[part], hit[part], total[part], None if back is None else back[part])
            if grads is not None:
                grads["wc"] += d.T @ with_one[part]
        score = hit.astype(np.float64) - np.log(-total)

        listed = np.flatnonzero(words >= 0)
        if not len(listed):
            return score, back
        listed = listed[np.argsort(classes[listed].astype(np.uint16), kind="stable")]
        own, of = with_one[listed], classes[listed]
        edges, widths, small = np.searchsorted(of, np.arange(len(first))), np.diff(first), tame(wo, first[:-1])
        own_back = np.zeros((len(listed), n), states.dtype) if grads is not None else None
        hit, total = np.zeros(len(listed), states.dtype), np.full(len(listed), -1, states.dtype)  # the only word of a class is sure
        places = (np.arange(len(listed)) - edges[of]) * widths[of] + words[listed] - first[of]
        for c in np.flatnonzero((np.diff(edges) > 0) & (widths > 1)).tolist():
            part, rows = slice(edges[c], edges[c + 1]), slice(first[c], first[c + 1])
            d = softmax(own[part], wo[rows], wo[rows].T, small[c], places[part], hit[part], total[part], None if back is None else own_back[part])
            if grads is not None:
                np.matmul(d.T, own[part], out=grads["wo"][rows])
        score[listed] += hit - np.log(-total)
        if grads is not None:
            back[listed] += own_back
        return score, back

    def gradient(self, lanes: Lanes, begin: int, end: int, h: np.ndarray, flat: np.ndarray | None = None):
        """Log-likelihood of a window, its gradient (back-propagated within the window; put into ``flat`` if given) and the state to carry on."""
        n, p, fresh, inputs = self.hidden, self.p, lanes.fresh[begin:end], lanes.inputs[begin:end].ravel()
        # the inputs met, and their places with inputs of equal number of places side by side
        times = np.bincount(inputs)
        met = np.flatnonzero(times)
        met = met[np.argsort(times[met], kind="stable")]
        rank = np.empty_like(times)
        rank[met] = np.arange(len(met))
        row, times = rank[inputs], times[met]
        order = np.argsort(row.astype(np.uint16) if len(met) < 1 << 16 else row, kind="stable")

        states, last, (before, gates, news) = self.forward(row.reshape(fresh.shape), fresh, h, self.table(met), trace=True)
        grads = self.views(np.zeros(sum(v.size for v in p.values()), h.dtype) if flat is None else flat)
        for v in grads.values():
            v.fill(0)
        classes, words = lanes.classes[begin:end].ravel(), lanes.words[begin:end].ravel()
        real = classes >= 0
        tokens = int(real.sum())
        if tokens == len(real):
            score, by_state = self.outputs(states.reshape(-1, n), classes, words, grads)
        else:
            by_state = np.zeros((len(real), n), h.dtype)
            score, by_state[real] = self.outputs(states.reshape(-1, n)[real], classes[real], words[real], grads)
        by_state = by_state.reshape(states.shape)

        z, r, u_new = gates[:, 0], gates[:, 1], gates[:, 2]
        rest = 1 - z
        to_z = before - news
        to_z *= z
        to_z *= rest
        np.multiply(news, news, out=news)
        np.subtract(1, news, out=news)
        news *= rest  # now the factor to the new state
        u_new *= r
        u_new *= 1 - r  # and to the reset gate
        u_back = p["u"].reshape(n, 3, n).transpose(1, 2, 0).copy()
        by_gate = np.empty((4, *states.shape), h.dtype)  # new by the input, update, reset, new by the state
        d, through, starts = np.zeros_like(h), np.empty((3, *h.shape), h.dtype), fresh.any(1)
        for t in range(end - begin - 1, -1, -1):
            own = by_gate[:, t]
            d += by_state[t]
            np.multiply(d, news[t], out=own[0])
            np.multiply(d, to_z[t], out=own[1])
            np.multiply(own[0], u_new[t], out=own[2])
            np.multiply(own[0], r[t], out=own[3])
            d *= z[t]
            np.matmul(own[1:], u_back, out=through)
            d += through[0]
            d += through[1]
            d += through[2]
            if starts[t]:
                d[fresh[t]] = 0
        grads["u"][:] = np.matmul(before.transpose(0, 2, 1), by_gate[1:]).sum(1).transpose(1, 0, 2).reshape(n, 3 * n)
        ones = np.ones(len(order), h.dtype)
        ordered, by_table, at, first = by_gate[:3].reshape(3, -1, n).take(order, 1), np.empty((3, len(met), n), h.dtype), 0, 0
        for c, k in zip(*(x.tolist() for x in np.unique(times, return_counts=True))):
            own = ordered[:, at : at + c * k].reshape(3, k, c, n)
            if c > 32:
                np.matmul(ones[:c], own, out=by_table[:, first : first + k])
            else:
                np.add.reduce(own, 2, out=by_table[:, first : first + k])
            at, first = at + c * k, first + k
        by_table = np.concatenate([by_table[1], by_table[2], by_table[0]], 1)
        grads["embed"][met] = by_table @ p["w"].T
        grads["w"][:] = p["embed"][met].T @ by_table
        grads["b"][:] = by_table.sum(0)
        return float(score.sum()), tokens, grads, last

    def train(self, lanes: Lanes, window: int = 16, rate: float = 0.004) -> float:
        """One pass of truncated back-propagation with Adam; the mean log-likelihood met on the way."""
        flat = self.flat()
        self.p = self.views(flat)
        g, m, s, x = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        h = np.zeros((lanes.shape[1], self.hidden), flat.dtype)
        total, tokens, step = 0.0, 0, 0
        for begin in range(0, lanes.shape[0], window):
            score, n, _, h = self.gradient(lanes, begin, min(begin + window, lanes.shape[0]), h, g)
            total, tokens, step = total + score, tokens + n, step + 1
            # m and s are the running sums of g and its square, before their factors of 0.1 and 0.001
            rescale = math.sqrt(1000 * (1 - 0.999**step))
            for at in range(0, len(flat), PARAMETERS):
                own_g, own_m, own_s, own_x, own_p = (v[at : at + PARAMETERS] for v in (g, m, s, x, flat))
                own_g *= 1 / max(n, 1)
                own_m *= 0.9
                own_m += own_g
                own_g *= own_g
                own_s *= 0.999
                own_s += own_g
                np.sqrt(own_s, out=own_g)
                own_g += 1e-6 * rescale
                np.divide(own_m, own_g, out=own_x)
                own_x *= 0.1 * rate / (1 - 0.9**step) * rescale
                own_p += own_x
        return total / max(tokens, 1)

    def score(self, lanes: Lanes, window: int = 64) -> np.ndarray:
        """Natural log-probability (class, and word for the shortlist) of each token, in the order the tokens were given."""
        table = self.table()
        h = np.zeros((lanes.shape[1], self.hidden), table.dtype)
        out = np.zeros(lanes.shape[0] * lanes.shape[1])
        for begin in range(0, lanes.shape[0], window):
            end = min(begin + window, lanes.shape[0])
            states, h, _ = self.forward(lanes.inputs[begin:end], lanes.fresh[begin:end], h, table)
            classes, words = lanes.classes[begin:end].ravel(), lanes.words[begin:end].ravel()
            real = np.flatnonzero(classes >= 0)
            out[begin * len(h) + real] = self.outputs(states.reshape(-1, self.hidden)[real], classes[real], words[real])[0]
        return out[lanes.cell]
