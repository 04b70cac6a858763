"""A small gated recurrent network with a class-factored softmax, in numpy.

A symbol is predicted in two steps: its class, then, in a word class, the word
within the class.  Other classes ("tail" classes) are single symbols here; the
caller splits their probability among the rare words they stand for.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

HIDDEN, CLASSES, PER_CLASS, TAIL = 16, 32, 64, 64
WORDS = CLASSES * PER_CLASS
SYMBOLS = WORDS + TAIL
END = 0  # the symbol that ends a text, and that stands before its first


def _small(weights: np.ndarray, offsets: np.ndarray, farthest: float) -> bool:
    """Whether no state with components up to ``farthest`` brings exponentials
    beyond a float, or a line of ``offsets`` without one well above zero.
    ``weights`` has a line for each offset."""
    reach = (np.abs(weights).sum(axis=1) * farthest).reshape(offsets.shape)
    return bool((offsets + reach).max() < 60 and (offsets - reach).max(axis=1).min() > -60)


def _exponentials(logits: np.ndarray) -> np.ndarray:
    """Puts the exponentials in place; the sums of the lines."""
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)


@dataclass
class Gru:
    """``enter``: what a symbol adds to the gates' and the candidate's input;
    ``gates``, ``turn``: state to the two gates and to the candidate;
    ``to_class``/``to_word`` with their offsets: state to class and word."""

    enter: np.ndarray
    gates: np.ndarray
    turn: np.ndarray
    to_class: np.ndarray
    class_offset: np.ndarray
    to_word: np.ndarray
    word_offset: np.ndarray

    @classmethod
    def start(cls, class_share: np.ndarray, word_share: np.ndarray, seed: int = 7) -> Gru:
        """Random weights; the offsets are the logarithms of the given shares
        of classes and of words within their class (0: no such word)."""
        r, f = np.random.default_rng(seed), np.float32
        draw = lambda *shape: (r.normal(size=shape) * 0.1).astype(f)
        log = lambda x: np.log(np.maximum(x, 1e-30)).astype(f)
        return cls(draw(SYMBOLS, 3 * HIDDEN), draw(HIDDEN, 2 * HIDDEN), draw(HIDDEN, HIDDEN), draw(HIDDEN, CLASSES + TAIL),
                   log(class_share), draw(WORDS, HIDDEN), log(word_share))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def with_flat(self, x: np.ndarray) -> Gru:
        out, at = [], 0
        for f in fields(self):
            a = getattr(self, f.name)
            out.append(x[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Gru(*out)

    # ---- forward

    def step(self, h: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(new state, update gate, reset gate, candidate)."""
        x = np.take(self.enter, symbols, axis=0)
        g = h @ self.gates
        g += x[:, : 2 * HIDDEN]
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        c = (r * h) @ self.turn
        c += x[:, 2 * HIDDEN :]
        np.tanh(c, out=c)
        out = c - h
        out *= z
        out += h
        return out, z, r, c

    def log_probabilities(self, h: np.ndarray, symbols: np.ndarray, gradient: Gru | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithm of each symbol's probability after its state;
        with ``gradient``, also the gradient of minus their sum by state,
        and those by the output weights, added into ``gradient``."""
        word = symbols < WORDS
        kind = np.where(word, symbols // PER_CLASS, symbols - WORDS + CLASSES)
        rows, farthest = np.arange(len(h)), float(np.abs(h).max(initial=0))
        # A last component of one brings the offsets into the products.
        states = np.ones((len(h), HIDDEN + 1), h.dtype)
        states[:, :HIDDEN] = h
        weights = np.vstack((self.to_class, self.class_offset))
        e = states @ weights
        if not _small(self.to_class.T, self.class_offset[None], farthest):
            e -= e.max(axis=1, keepdims=True)
        out = e[rows, kind]
        total = _exponentials(e)
        out -= np.log(total)
        back = None
        if gradient is not None:
            # The shares less one for what came, times the total; divided by it after the products.
            e[rows, kind] -= total
            part = 1 / total[:, None]
            back = (e @ self.to_class.T) * part
            by_class = (states * part).T @ e
            gradient.to_class += by_class[:HIDDEN]
            gradient.class_offset += by_class[HIDDEN]
        # Words in the order of their classes: a product for each class, all else at once.
        order = np.flatnonzero(word)
        order = order[np.argsort(kind[order].astype(np.int8), kind="stable")]
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
        spans = [(slice(edges[c], edges[c + 1]), slice(c * PER_CLASS, (c + 1) * PER_CLASS)) for c in range(CLASSES) if edges[c] < edges[c + 1]]
        own_states, rows, at = states[order], np.arange(len(order)), symbols[order] % PER_CLASS
        weights = np.column_stack((self.to_word, self.word_offset)).T
        e = np.empty((len(order), PER_CLASS), h.dtype)
        for own, span in spans:
            np.matmul(own_states[own], weights[:, span], out=e[own])
        if not _small(self.to_word, self.word_offset.reshape(CLASSES, PER_CLASS), farthest):
            e -= e.max(axis=1, keepdims=True, initial=-np.inf)
        picked = e[rows, at]
        total = _exponentials(e)
        out[order] += picked - np.log(total)
        if gradient is not None:
            e[rows, at] -= total
            part = 1 / total[:, None]
            scaled = own_states * part
            more = np.empty((len(order), HIDDEN), h.dtype)
            for own, span in spans:
                np.matmul(e[own], self.to_word[span], out=more[own])
                by_word = e[own].T @ scaled[own]
                gradient.to_word[span] += by_word[:, :HIDDEN]
                gradient.word_offset[span] += by_word[:, HIDDEN]
            back[order] += more * part
        return out, back

    def score(self, texts: list[np.ndarray], window_rows: int = 2048) -> np.ndarray:
        """Natural logarithm of each text's probability; a text is its symbols
        with ``END`` last.  All texts take a step together, the long ones go
        on; after ``window_rows`` states the outputs are added up and only
        the last state is carried on."""
        length = np.array([len(t) for t in texts], np.int64)
        by_length = np.argsort(-length, kind="stable")
        length = length[by_length]
        total = np.zeros(len(texts))
        if not len(texts) or not length[0]:
            return total
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # texts longer than t
        begin = np.concatenate(([0], np.cumsum(active)))
        flat = np.empty(begin[-1], np.int32)
        for rank, i in enumerate(by_length.tolist()):
            if length[rank]:
                flat[begin[: length[rank]] + rank] = texts[i]
        h = np.zeros((int(active[0]), HIDDEN), np.float32)
        kept, first = [], 0
        for t, n in enumerate(active.tolist()):
            before = np.full(n, END) if t == 0 else flat[begin[t - 1] : begin[t - 1] + n]
            h = self.step(h[:n], before)[0]
            kept.append(h)
            if begin[t + 1] - begin[first] >= window_rows or t + 1 == len(active):
                p, _ = self.log_probabilities(np.concatenate(kept), flat[begin[first] : begin[t + 1]])
                rank = np.concatenate([np.arange(k) for k in active[first : t + 1].tolist()])
                total += np.bincount(rank, weights=p, minlength=len(texts))
                kept, first = [], t + 1
        out = np.empty(len(texts))
        out[by_length] = total
        return out

    # ---- truncated backpropagation

    def train(self, stream: np.ndarray, streams: int = 256, window: int = 20, rate: float = 0.3,
              squares: dict[str, np.ndarray] | None = None) -> tuple[Gru, float]:
        """One pass over a stream of symbols (texts, each ended by ``END``),
        cut into ``streams`` parallel ones, fewer if they were shorter than
        fifty windows.  Gradients run back ``window`` steps, states run on; a
        new text starts from the zero state.  The symbols that don't fill all
        streams come last, as one window of one stream.  Steps are scaled per
        weight (Adagrad); a given ``squares`` keeps the scales from one call
        to the next.  Returns the network and its mean loss on the way."""
        net = self.with_flat(self.flat())
        streams = max(1, min(streams, len(stream) // (50 * window)))
        steps = len(stream) // streams
        before = np.concatenate(([END], stream[:-1])).astype(stream.dtype)
        inputs, targets = (a[: steps * streams].reshape(streams, steps).T for a in (before, stream))
        windows = [(inputs[at : at + window], targets[at : at + window]) for at in range(0, steps, window)]
        if steps * streams < len(stream):
            windows.append((before[steps * streams :, None], stream[steps * streams :, None]))
        squares = {} if squares is None else squares
        for f in fields(net):
            squares.setdefault(f.name, np.full_like(getattr(net, f.name), 1e-2))
        h, loss = np.zeros((streams, HIDDEN), np.float32), 0.0
        for x, y in windows:
            h, p, gradient = net._window(h[-x.shape[1] :], x, y)  # the last stream's state leads to what is left over
            loss -= p
            for name, g in gradient.items():
                # Symbols that were not entered have no gradient, so that nothing changes for them.
                rows = np.unique(x) if name == "enter" else slice(None)
                g = np.clip(g[rows] / streams, -1, 1)
                total = squares[name][rows] + g * g
                squares[name][rows] = total
                getattr(net, name)[rows] -= rate * g / np.sqrt(total)
        return net, loss / max(1, len(stream))

    def _window(self, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, dict[str, np.ndarray]]:
        """(last state, log-probability, gradients of minus it)."""
        zero = Gru(*[np.zeros(a.shape, a.dtype) for a in (getattr(self, f.name) for f in fields(self))])
        entering, fresh = np.take(self.enter, x, axis=0), (x != END).astype(h.dtype)[:, :, None]
        before, c, states = (np.empty((*x.shape, HIDDEN), h.dtype) for _ in range(3))
        both = np.empty((*x.shape, 2 * HIDDEN), h.dtype)
        z, r = both[:, :, :HIDDEN], both[:, :, HIDDEN:]
        away, against = -entering[:, :, : 2 * HIDDEN], -self.gates
        for t in range(len(x)):
            b, g, candidate = before[t], both[t], c[t]
            np.multiply(h, fresh[t], out=b)
            np.matmul(b, against, out=g)
            g += away[t]
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.matmul(r[t] * b, self.turn, out=candidate)
            candidate += entering[t, :, 2 * HIDDEN :]
            np.tanh(candidate, out=candidate)
            h = states[t]
            np.subtract(candidate, b, out=h)
            h *= z[t]
            h += b
        p, back = self.log_probabilities(states.reshape(-1, HIDDEN), y.ravel(), zero)
        back = back.reshape(states.shape)
        by_turn, by_update, by_reset = z * (1 - c * c), (c - before) * z * (1 - z), before * r * (1 - r)
        keep, reset = (1 - z) * fresh, r * fresh
        ahead = np.zeros_like(h)
        entered = np.empty((*x.shape, 3 * HIDDEN), h.dtype)
        gates_back, turn_back = self.gates.T.copy(), self.turn.T.copy()
        for t in range(len(x) - 1, -1, -1):
            d = back[t] + ahead
            dc = d * by_turn[t]
            dr = dc @ turn_back
            dg = entered[t, :, : 2 * HIDDEN]
            np.multiply(d, by_update[t], out=dg[:, :HIDDEN])
            np.multiply(dr, by_reset[t], out=dg[:, HIDDEN:])
            entered[t, :, 2 * HIDDEN :] = dc
            ahead = d * keep[t] + dr * reset[t] + (dg @ gates_back) * fresh[t]
        entered = entered.reshape(-1, 3 * HIDDEN)
        zero.gates += before.reshape(-1, HIDDEN).T @ entered[:, : 2 * HIDDEN]
        zero.turn += (r * before).reshape(-1, HIDDEN).T @ entered[:, 2 * HIDDEN :]
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) != 0)))
        zero.enter[flat[order][first]] = np.add.reduceat(np.ascontiguousarray(entered[order].T), first, axis=1).T
        return h, float(p.sum()), {f.name: getattr(zero, f.name) for f in fields(zero)}
