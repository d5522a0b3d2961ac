"""A gated recurrent language model in numpy, with a class-factored output softmax.

P(word | history) = P(class | state) * P(word | class, state). The classes cut the word list by frequency. Words of the leading classes
have vectors of their own; inside the other classes, and in the last one (all words beyond the list), words share the state's class
probability by their counts. The biases start as the logarithms of the counts and the weights as zero, so an untrained model is the
smoothed unigram model; training can only move from there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    """Sizes. ``learned`` words have vectors, in about ``classes`` classes; the listed words after them are cut into ``bands`` classes."""

    hidden: int = 16
    embed: int = 12
    learned: int = 4096
    classes: int = 64
    bands: int = 16
    window: int = 16


def cut_by(weight: np.ndarray, parts: int) -> np.ndarray:
    """First places of runs with about equal sums of ``weight``."""
    if not len(weight):
        return np.zeros(0, np.int64)
    share = np.cumsum(weight) / weight.sum()
    return np.unique(np.r_[0, np.searchsorted(share, np.arange(1, parts) / parts) + 1].clip(0, len(weight) - 1))


class Vocabulary:
    """Words by falling count, as 64-bit hashes; ids follow that order, and the id after the last stands for every other word."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rest: float, shape: Shape):
        """``rest``: smoothed count of all words that aren't listed, the unknown word included."""
        self.shape, self.size = shape, len(hashes)
        order = np.argsort(hashes)
        self.sorted, self.place = hashes[order], order.astype(np.int32)
        self.counts = counts
        smooth = counts + 0.5
        n = min(shape.learned, self.size)
        starts = np.r_[cut_by(np.sqrt(smooth[:n]), shape.classes), n + cut_by(smooth[n:], shape.bands), self.size].astype(np.int64)
        self.starts, self.n_classes, self.n_learned = starts, len(starts), n
        self.learned_classes = int(np.searchsorted(starts, n)) if n else 0
        self.word_class = (np.searchsorted(starts, np.arange(self.size + 1), side="right") - 1).astype(np.int32)
        mass = np.add.reduceat(np.r_[smooth, rest], starts)
        self.class_bias = np.log(mass / mass.sum()).astype(np.float32)
        self.word_bias = np.log(np.r_[smooth, rest] / mass[self.word_class]).astype(np.float32)
        self.word_bias[self.size] = 0.0

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.size - 1)
        return np.where(self.sorted[at] == hashes, self.place[at], np.int32(self.size))

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        """Rows of the embedding table: learned words have their own, others one for each class."""
        return np.where(ids < self.n_learned, ids, self.n_learned + self.word_class[ids])

    @property
    def start(self) -> int:
        """Input at the start of a text."""
        return self.n_learned + self.n_classes


class Gru:
    def __init__(self, words: Vocabulary, flat: np.ndarray | None = None):
        s = words.shape
        self.words, h, e = words, s.hidden, s.embed
        self.shapes = {"embed": (words.start + 1, e), "wx": (e, 3 * h), "b": (3 * h,), "wh": (h, 3 * h), "wc": (h, words.n_classes), "bc": (words.n_classes,), "u": (words.n_learned, h)}
        sizes = [int(np.prod(x)) for x in self.shapes.values()]
        if flat is None:
            rng = np.random.default_rng(1)
            flat = np.zeros(sum(sizes), np.float32)
        self.flat, self.p, at = flat.astype(np.float32), {}, 0
        self.rooms: dict[str, np.ndarray] = {}
        self.seen = np.zeros_like(self.flat)  # squares of gradients, of all calls of train
        fresh = not flat.any()
        for (name, shape), size in zip(self.shapes.items(), sizes, strict=True):
            self.p[name] = self.flat[at : at + size].reshape(shape)
            if fresh and name in ("embed", "wx", "wh"):
                self.p[name][...] = rng.normal(0, 1 if name == "embed" else shape[0] ** -0.5, shape)
            at += size
        if fresh:
            self.p["bc"][...] = words.class_bias

    def _room(self, name: str, rows: int, columns: int) -> np.ndarray:
        """An array kept from call to call: new large arrays cost more than what is computed in them."""
        room = self.rooms.get(name)
        if room is None or len(room) < rows * columns:
            room = self.rooms[name] = np.empty(rows * columns, np.float32)
        return room[: rows * columns].reshape(rows, columns)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step from projected inputs: the new state, and what its gradient needs."""
        k = h.shape[1]
        hh = h @ self.p["wh"]
        gates = x[:, : 2 * k] + hh[:, : 2 * k]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :k], gates[:, k:]
        c = r * hh[:, 2 * k :]
        c += x[:, 2 * k :]
        np.tanh(c, out=c)
        new = c - h
        new *= z
        new += h
        return new, z, r, c, hh[:, 2 * k :]

    def output(self, states: np.ndarray, ids: np.ndarray, train: bool = False):
        """Natural log-probability of each id; with ``train`` also the gradients (of the negative sum) by parameter and by state."""
        w, p = self.words, self.p
        order = np.argsort(w.word_class[ids].astype(np.int16 if w.n_classes < 1 << 15 else np.int32), kind="stable")  # words of a class lie together, so that no class gathers on its own
        states, ids = states[order], ids[order]
        cls = w.word_class[ids]
        n, h = states.shape
        odds = np.matmul(states, p["wc"], out=self._room("odds", n, w.n_classes))
        odds += p["bc"]
        odds -= odds.max(1, keepdims=True)
        rows = np.arange(len(ids))
        logp = odds[rows, cls]
        np.exp(odds, out=odds)
        total = odds @ np.ones(w.n_classes, np.float32)
        logp += np.where(ids < w.n_learned, 0, w.word_bias[ids]) - np.log(total)
        if train:
            odds *= (1 / total)[:, None]
            odds[rows, cls] -= 1
            grads = {"wc": states.T @ odds, "bc": odds.sum(0), "u": np.zeros_like(p["u"])}
            by_state = np.matmul(odds, p["wc"].T, out=self._room("by_state", n, h))
        bounds = np.searchsorted(cls, np.arange(w.learned_classes + 1))
        for c in np.flatnonzero(np.diff(bounds)):
            at = slice(bounds[c], bounds[c + 1])
            lo, hi = w.starts[c], min(w.starts[c + 1], w.n_learned)
            if hi - lo < 2:
                continue
            u, own, k = p["u"][lo:hi], ids[at] - lo, rows[: bounds[c + 1] - bounds[c]]
            share = np.matmul(states[at], u.T, out=self._room("share", len(k), hi - lo))
            share += w.word_bias[lo:hi]
            share -= share.max(1, keepdims=True)
            logp[at] += share[k, own]
            np.exp(share, out=share)
            norm = share @ np.ones(hi - lo, np.float32)
            logp[at] -= np.log(norm)
            if train:
                share *= (1 / norm)[:, None]
                share[k, own] -= 1
                grads["u"][lo:hi] = share.T @ states[at]
                by_state[at] += np.matmul(share, u, out=self._room("more", len(k), h))
        back = np.empty_like(order)
        back[order] = rows
        return (logp[back], grads, by_state[back]) if train else logp[back]

    def train(self, texts: list[np.ndarray], rate: float = 0.05, streams_of: int = 2048, most: int = 512) -> int:
        """Truncated backpropagation through the texts, laid end to end in streams of about ``streams_of`` tokens (``most`` streams at most);
        the state is carried from window to window. A longer text is learned in pieces of so many tokens, which lie in any streams: each starts
        from the word before it and an empty state, so that the streams end together and no window is left to a few long texts."""
        w, s = self.words, self.words.shape
        pieces = [(t, a) for t in texts for a in range(0, len(t), streams_of)]
        total = sum(map(len, texts))
        n = max(4, min(most, total // streams_of))
        streams: list[list[tuple[np.ndarray, int]]] = [[] for _ in range(n)]
        lengths = np.zeros(n, np.int64)
        for t, a in sorted(pieces, key=lambda p: min(len(p[0]) - p[1], streams_of), reverse=True):
            k = int(lengths.argmin())
            streams[k].append((t, a))
            lengths[k] += min(len(t) - a, streams_of)
        longest = np.argsort(-lengths, kind="stable")  # streams that end first stand last, and leave
        streams, lengths = [streams[k] for k in longest], lengths[longest]
        width = int(lengths.max(initial=0)) + (-int(lengths.max(initial=0)) % s.window)
        ids = np.full((width, n), -1, np.int32)
        inputs, fresh = np.full((width, n), w.start, np.int64), np.ones((width, n), bool)
        for k, parts in enumerate(streams):
            at = 0
            for t, a in parts:
                stop = min(a + streams_of, len(t))
                head = int(a == 0)  # at the start of a text there is no word before
                ids[at : at + stop - a, k] = t[a:stop]
                inputs[at + head : at + stop - a, k] = w.inputs(t[a + head - 1 : stop - 1])
                fresh[at + 1 : at + stop - a, k] = False
                at += stop - a
        h = np.zeros((n, s.hidden), np.float32)
        grad, step = np.zeros_like(self.flat), np.empty_like(self.flat)
        views, at = {}, 0
        for name, shape in self.shapes.items():
            views[name] = grad[at : at + int(np.prod(shape))].reshape(shape)
            at += int(np.prod(shape))
        for t in range(0, width, s.window):
            active = int(np.searchsorted(-lengths, -t))
            h = self._window(ids[t : t + s.window, :active], inputs[t : t + s.window, :active], h[:active], views, fresh[t : t + s.window, :active])
            np.multiply(grad, grad, out=step)
            self.seen += step
            np.sqrt(self.seen, out=step)
            step += 1e-6
            np.divide(grad, step, out=step)
            step *= rate
            self.flat -= step
        return total

    def _window(self, ids: np.ndarray, inputs: np.ndarray, h: np.ndarray, views: dict, fresh: np.ndarray | None = None) -> np.ndarray:
        """``fresh``: where the state before is empty (where none is given, at the starts of texts)."""
        p, steps, k = self.p, len(ids), h.shape[1]
        first = (inputs == self.words.start if fresh is None else fresh).astype(np.float32)[:, :, None]
        vectors = p["embed"][inputs]
        x = np.matmul(vectors.reshape(steps * h.shape[0], -1), p["wx"], out=self._room("x", steps * h.shape[0], 3 * k)).reshape(steps, h.shape[0], 3 * k)
        x += p["b"]
        kept = []
        states = self._room("states", steps * h.shape[0], k).reshape(steps, *h.shape)
        for t in range(steps):
            before = h * (1 - first[t])
            h, z, r, c, hc = self.step(x[t], before)
            kept.append((before, z, r, c, hc))
            states[t] = h
        live = np.flatnonzero(ids.ravel() >= 0)
        _, grads, by_state = self.output(states.reshape(-1, k)[live], ids.ravel()[live], True)
        scale = np.float32(1 / max(1, len(live)))
        from_output = np.zeros((steps * h.shape[0], k), np.float32)
        from_output[live] = by_state * scale
        from_output = from_output.reshape(states.shape)
        dx, dhh = (self._room(c, steps * h.shape[0], 3 * k).reshape(steps, h.shape[0], 3 * k) for c in ("dx", "dhh"))
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            before, z, r, c, hc = kept[t]
            dh = dh + from_output[t]
            dc = dh * z * (1 - c * c)
            dx[t, :, :k] = dh * (c - before) * z * (1 - z)
            dx[t, :, k : 2 * k] = dc * hc * r * (1 - r)
            dx[t, :, 2 * k :] = dc
            dhh[t] = dx[t]
            dhh[t, :, 2 * k :] = dc * r
            dh = (dh * (1 - z) + dhh[t] @ p["wh"].T) * (1 - first[t])
        for name in ("wc", "bc", "u"):
            views[name][...] = grads[name] * scale
        flat_dx = dx.reshape(-1, 3 * k)
        views["wh"][...] = np.stack([q[0] for q in kept]).reshape(-1, k).T @ dhh.reshape(-1, 3 * k)
        views["wx"][...] = vectors.reshape(flat_dx.shape[0], -1).T @ flat_dx
        views["b"][...] = flat_dx.sum(0)
        views["embed"][...] = 0
        flat_inputs = inputs.ravel().astype(np.int16 if self.words.start < 1 << 15 else np.int32)
        order = np.argsort(flat_inputs, kind="stable")
        rows = flat_inputs[order].astype(np.int64)
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        views["embed"][rows[heads]] = np.add.reduceat((flat_dx @ p["wx"].T)[order], heads, axis=0)
        return h

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each whole text of ids; long texts run window by window with their state carried on."""
        w, s = self.words, self.words.shape
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros(len(texts))
        if not len(texts):
            return out
        flat = np.concatenate(texts)
        table = self.p["embed"] @ self.p["wx"] + self.p["b"]
        source = np.r_[0, w.inputs(flat[:-1])]
        offsets = np.cumsum(lengths) - lengths
        source[offsets[lengths > 0]] = w.start
        order = np.argsort(-lengths, kind="stable")
        start = offsets[order]
        active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max())), side="left")  # texts longer than t
        h = np.zeros((len(texts), s.hidden), np.float32)
        t = 0
        while t < len(active):
            window = max(1, min(4096, 60_000 // int(active[t])))
            stop = min(len(active), t + window)
            states, places = [], []
            for u in range(t, stop):
                n = active[u]
                at = start[:n] + u
                h = self.step(table[source[at]], h[:n])[0]
                states.append(h)
                places.append(at)
            at = np.concatenate(places)
            logp = self.output(np.concatenate(states), flat[at])
            who = np.concatenate([order[: active[u]] for u in range(t, stop)])
            out += np.bincount(who, logp, len(out))
            t = stop
        return out
