"""A gated recurrent network over symbols with a class-factored output, in numpy.

Symbols are the frequent words and one symbol per class of other words. A symbol's probability is that
of its class times, for a frequent word, that of the word within its class; both are softmaxes of the
state. Trained by backpropagation through windows of some steps, the state going on from window to
window; scoring carries the state through a whole sequence. Networks trained apart from the same
parameters are joined by the mean of their parameters and moments.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import numpy as np

STATE, PER_CLASS = 24, 64
LANES, STEPS, RATE = 64, 16, 4e-3
#: Symbols of a sequence that go through one lane in training.
PIECE = 2_048
#: States, and parameters, that go through the same operations while a core's cache holds them.
ABREAST, PARAMETERS = 512, 1 << 14


def _lowered(x: np.ndarray, tame: bool) -> None:
    """Makes exponentials of the rows safe: those that are not tame are lowered by their largest value."""
    if not tame:
        x -= x.max(1, keepdims=True)


def _with_one(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rows in that order, each with a 1 behind it."""
    out = np.ones((len(order), x.shape[1] + 1), x.dtype)
    out[:, :-1] = x.take(order, 0)
    return out


class Network:
    """``words`` frequent words in classes of PER_CLASS by rank, then ``others`` one-symbol classes;
    ``start`` is the symbol before a sequence and at its end. ``counts`` of the symbols give the first
    output weights, so that an untrained network has their frequencies."""

    def __init__(self, words: int, others: int, start: int, counts: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.words, self.start = words, start
        self.n_word_classes = -(-words // PER_CLASS)
        self.class_of = np.concatenate(
            [np.arange(words) // PER_CLASS, self.n_word_classes + np.arange(others)]
        ).astype(np.int64)
        share = counts + 0.1
        by_class = np.bincount(self.class_of, share)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        padded = self.n_word_classes * PER_CLASS
        word_bias = np.full(padded, -30, np.float32)
        word_bias[:words] = np.log(share[:words] / by_class[self.class_of[:words]])
        self.p = {
            "g": small(words + others, 3 * STATE),
            "u": small(STATE, 3 * STATE),
            "wc": small(STATE, len(by_class)) * 0,
            "bc": np.log(by_class / by_class.sum()).astype(np.float32),
            "ww": small(padded, STATE) * 0,
            "bw": word_bias,
        }
        self.first = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.turn = 0

    def gates(self):
        """Weights of the symbols and of the state, an array for each gate; those of the two that are
        sigmoids are halved, as a sigmoid is taken from the tanh of one half."""
        both = []
        for k in ("g", "u"):
            parts = self.p[k].reshape(-1, 3, STATE).transpose(1, 0, 2).copy()
            parts[:2] *= 0.5
            both.append(parts)
        return both

    def step(self, symbol: np.ndarray, h: np.ndarray, gates=None):
        """The next states, and what the gradients need."""
        of_symbol, of_state = self.gates() if gates is None else gates
        x, hu = of_symbol.take(symbol, 1), h @ of_state
        zr = hu[:2]
        zr += x[:2]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr
        n = r * hu[2]
        n += x[2]
        np.tanh(n, out=n)
        out = h - n
        out *= z
        out += n
        return out, z, r, n, hu[2]

    def outputs(self):
        """Weights of the classes and, class by class, of the words, with the biases as weights of a 1 behind
        the state; for each of these softmaxes whether it is tame: no state exceeds 1, so the weights bound
        the logits, and exponentials of all rows neither overflow nor all vanish."""
        p = self.p
        classes = np.vstack([p["wc"], p["bc"]])
        words = np.hstack([p["ww"], p["bw"][:, None]]).reshape(-1, PER_CLASS, STATE + 1)
        tame = lambda bias, reach: ((bias + reach).max(-1) < 60) & ((bias - reach).max(-1) > -60)
        reach = (np.abs(p["ww"]) @ np.ones(STATE, p["ww"].dtype)).reshape(-1, PER_CLASS)
        tame_words = tame(p["bw"].reshape(-1, PER_CLASS), reach)
        return classes, words, tame(p["bc"], np.abs(p["wc"]).sum(0)), tame_words.tolist()

    def _by_class(self, of: np.ndarray):
        """The order of symbols by class, and the edges of the classes of words in it."""
        order = np.argsort(of.astype(np.int16), kind="stable")
        return order, np.searchsorted(of[order], np.arange(self.n_word_classes + 1)).tolist()

    def log_prob(self, h: np.ndarray, symbol: np.ndarray, outputs=None) -> np.ndarray:
        """Natural log probability of each symbol after each state."""
        classes, words, tame, tame_words = self.outputs() if outputs is None else outputs
        of = self.class_of[symbol]
        order, edge = self._by_class(of)
        s, symbol, of, every = _with_one(h, order), symbol[order], of[order], np.arange(len(order))
        value, sums, one = np.zeros(len(of)), np.ones(len(of)), np.ones(max(classes.shape[1], PER_CLASS), s.dtype)

        def settle(at, weights, own, safe):
            x = s[at] @ weights
            _lowered(x, safe)
            value[at] += x[every[: len(x)], own]
            np.exp(x, out=x)
            sums[at] *= x @ one[: x.shape[1]]

        for a in range(0, len(of), ABREAST):
            at = slice(a, a + ABREAST)
            settle(at, classes, of[at], tame)
        for c, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            if a < b:
                settle(slice(a, b), words[c].T, symbol[a:b] - c * PER_CLASS, tame_words[c])
        out = np.empty(len(of))
        out[order] = value - np.log(sums)
        return out

    def flat(self) -> np.ndarray:
        """Parameters and both moments in a row."""
        return np.concatenate([x.ravel() for part in (self.p, self.first, self.second) for x in part.values()])

    def set_flat(self, values: np.ndarray, turn: int) -> None:
        at = 0
        for part in (self.p, self.first, self.second):
            for k, x in part.items():
                part[k] = values[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
        self.turn = turn

    def forget(self) -> None:
        """Drops the moments, which only training needs."""
        self.first, self.second = {}, {}

    def train(self, blocks: Iterable[tuple[np.ndarray, np.ndarray]], lanes: int = LANES, rate: float = RATE) -> int:
        """Learns from all symbols of the blocks (symbols, first symbols of the sequences and the end), each
        sequence ended by the start symbol, and returns their number. The sequences go one after another
        through ``lanes`` lanes, the next one to the lane that has least left to do. Longer ones than PIECE
        are learned from in pieces: before a later piece stands the symbol s that precedes it as -2 - s,
        which is not learned from again, and the state begins anew."""
        left = [np.zeros(0, np.int16)] * lanes
        h, last, seen = np.zeros((lanes, STATE), np.float32), np.full(lanes, self.start, np.int64), 0
        for symbols, first in blocks:
            symbols = symbols.astype(np.int16)
            seen += len(symbols)
            parts = [[x] for x in left]
            load = [(len(x), i) for i, x in enumerate(left)]
            heapq.heapify(load)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                for c in range(a, b, PIECE):
                    size, i = load[0]
                    piece = symbols[c : min(c + PIECE, b)]
                    if c > a:
                        piece = np.insert(piece, 0, -2 - symbols[c - 1])
                    parts[i].append(piece)
                    heapq.heapreplace(load, (size + len(piece), i))
            left = [np.concatenate(x) for x in parts]
            done = load[0][0] // STEPS * STEPS
            if done:
                rows = np.stack([x[:done] for x in left], 1).astype(np.int64)
                left = [x[done:].copy() for x in left]
                h, last = self._follow(rows, h, last, STEPS, lanes, rate)
        # lanes that have come to their end are left out, the others take more steps at once
        while any(live := np.array([len(x) > 0 for x in left])):
            left, h, last = [x for x in left if len(x)], h[live], last[live]
            steps = min(max(STEPS, lanes * STEPS // len(left)), max(map(len, left)))
            rows = np.full((steps, len(left)), -1, np.int64)
            for i, x in enumerate(left):
                rows[: len(x), i] = x[:steps]
            h, last = self._follow(rows, h, last, steps, lanes, rate)
            left = [x[steps:] for x in left]
        return seen

    def _follow(self, rows: np.ndarray, h: np.ndarray, last: np.ndarray, steps: int, lanes: int, rate: float):
        """A step of Adam for each window of the rows (-1: nothing); the state and symbols behind them."""
        before = np.concatenate([last[None], rows[:-1]])
        for a in range(0, len(rows), steps):
            self.turn += 1
            window = rows[a : a + steps]
            grad, h = self._gradients(before[a : a + steps], window, h)
            norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
            # a window with few symbols counts for less
            share = min(1.0, np.count_nonzero(window >= 0) / (lanes * STEPS)) * min(1.0, 5.0 / (norm + 1e-9))
            now = rate * math.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn)
            for k, g in grad.items():
                flat = [x.reshape(-1) for x in (self.p[k], self.first[k], self.second[k], g)]
                for c in range(0, len(flat[0]), PARAMETERS):
                    value, first, second, g = (x[c : c + PARAMETERS] for x in flat)
                    square = g * g
                    square *= 0.001 * share * share
                    second *= 0.999
                    second += square
                    first *= 0.9
                    first += (0.1 * share) * g
                    np.sqrt(second, out=square)
                    square += 1e-8
                    np.divide(first, square, out=square)
                    square *= now
                    value -= square
        return h, rows[-1]

    def _gradients(self, before: np.ndarray, rows: np.ndarray, h: np.ndarray):
        """Mean gradients over a window, and the state behind it. Negative symbols are not learned: -1
        behind the end of a lane, -2 - s for the symbol s before a piece."""
        p, kept, states, gates = self.p, [], [], self.gates()
        anew = (before == self.start) | (before < -1)
        before = np.where(before < -1, -2 - before, before)
        some_anew = anew.any(1).tolist()
        for t, symbols in enumerate(before):
            fresh = np.where(anew[t][:, None], h.dtype.type(0), h) if some_anew[t] else h
            h, z, r, n, hn = self.step(symbols, fresh, gates)
            kept.append((fresh, z, r, n, hn))
            states.append(h)
        grad, ds = self._output_gradients(np.concatenate(states), rows.ravel())
        ds = ds.reshape(*before.shape, STATE)
        dh, back = np.zeros_like(h), p["u"].T
        du = np.empty((*before.shape, 3 * STATE), ds.dtype)  # by the products of the state and the gates
        dn = np.empty_like(ds)
        for t in range(len(before) - 1, -1, -1):
            fresh, z, r, n, hn = kept[t]
            dh += ds[t]
            rest = 1 - z
            slope = n * n
            np.subtract(1, slope, out=slope)
            slope *= rest
            slope *= dh
            dn[t] = slope
            slope *= r
            du[t, :, 2 * STATE :] = slope
            r = 1 - r
            r *= hn
            np.multiply(r, slope, out=du[t, :, STATE : 2 * STATE])
            rest *= fresh - n
            dh *= z
            np.multiply(rest, dh, out=du[t, :, :STATE])
            dh += du[t] @ back
            if some_anew[t]:
                dh[anew[t]] = 0
        given, du = before.ravel(), du.reshape(-1, 3 * STATE)
        order = np.argsort(given.astype(np.int16), kind="stable")
        edge = np.flatnonzero(np.diff(given[order], prepend=-2))
        grad["u"] = np.concatenate([k[0] for k in kept]).T @ du
        du[:, 2 * STATE :] = dn.reshape(-1, STATE)
        grad["g"] = np.zeros_like(p["g"])
        grad["g"][given[order[edge]]] = np.add.reduceat(du.take(order, 0), edge)
        return grad, h

    def _output_gradients(self, s: np.ndarray, target: np.ndarray):
        """Gradients of the softmaxes' weights, and those by the states ``s`` before the targets."""
        classes, words, tame, tame_words = self.outputs()
        live = target >= 0
        of = np.where(live, self.class_of[np.maximum(target, 0)], self.n_word_classes)
        order, edge = self._by_class(of)
        s, own, of = _with_one(s, order), target[order], of[order]
        weight = (live[order] / max(1, np.count_nonzero(live))).astype(s.dtype)
        every, one = np.arange(len(of)), np.ones(max(classes.shape[1], PER_CLASS), s.dtype)

        def errors(at, weights, own, safe):
            x = s[at] @ weights
            _lowered(x, safe)
            np.exp(x, out=x)
            x *= (weight[at] / (x @ one[: x.shape[1]]))[:, None]
            x[every[: len(x)], own] -= weight[at]
            return x

        by_class, ds, by_word = np.zeros_like(classes), np.empty((len(s), STATE), s.dtype), np.zeros_like(words)
        for a in range(0, len(s), ABREAST):
            at = slice(a, a + ABREAST)
            x = errors(at, classes, of[at], tame)
            by_class += s[at].T @ x
            np.matmul(x, classes[:-1].T, out=ds[at])
        for c, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            if a < b:
                x = errors(slice(a, b), words[c].T, own[a:b] - c * PER_CLASS, tame_words[c])
                by_word[c] = x.T @ s[a:b]
                ds[a:b] += x @ words[c, :, :-1]
        out = np.empty_like(ds)
        out[order] = ds
        by_word = by_word.reshape(-1, STATE + 1)
        return {"wc": by_class[:-1], "bc": by_class[-1], "ww": by_word[:, :-1], "bw": by_word[:, -1]}, out

    def score(self, symbols: np.ndarray, first: np.ndarray, window: int = 1 << 12) -> np.ndarray:
        """Natural log probability of each sequence symbols[first[i] : first[i + 1]]. Sequences of like
        length go on side by side, so many that a core's cache holds them; their states are carried from
        step to step."""
        order = np.argsort(-np.diff(first), kind="stable")
        out, gates, outputs = np.empty(len(order)), self.gates(), self.outputs()
        for at in range(0, len(order), ABREAST):
            some = order[at : at + ABREAST]
            out[some] = self._score(symbols, first[some], first[some + 1], window, gates, outputs)
        return out

    def _score(self, symbols, begin, end, window, gates, outputs) -> np.ndarray:
        """The same of sequences of falling length."""
        size, live = end - begin, len(begin)
        total = np.zeros(live)
        h, before = np.zeros((live, STATE), self.p["g"].dtype), np.full(live, self.start, np.int64)
        states, targets, owners, held = [], [], [], 0
        for t in range(int(size.max(initial=0))):
            while size[live - 1] <= t:
                live -= 1
            h = self.step(before[:live], h[:live], gates)[0]
            before = symbols[begin[:live] + t]
            states.append(h)
            targets.append(before)
            owners.append(live)
            held += live
            if held >= window:
                self._settle(total, states, targets, owners, outputs)
                states, targets, owners, held = [], [], [], 0
        if held:
            self._settle(total, states, targets, owners, outputs)
        return total

    def _settle(self, total, states, targets, owners, outputs) -> None:
        value = self.log_prob(np.concatenate(states), np.concatenate(targets), outputs)
        of = np.concatenate([np.arange(n) for n in owners])
        total[: owners[0]] += np.bincount(of, value, minlength=owners[0])
