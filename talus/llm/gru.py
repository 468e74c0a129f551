"""A gated recurrent language model in numpy with a class-factored softmax.

Outputs: a token's class, then the token within its class. Head words (the most frequent)
have learned weights in classes of about equal root-frequency mass; all other words stand in
tail classes by their endings, where their share follows corpus counts. Inputs: the head
word, or the tail class.
"""

from __future__ import annotations

import numpy as np

EMBED, HIDDEN, HEAD, HEAD_CLASSES, TAILS = 12, 16, 1024, 24, 72
STREAMS, STEPS, RATE, CLIP, BLOCK = 512, 16, 0.02, 1.0, 16384
_F = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Overwrites x."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Shape:
    """Head words' hashes, class borders and unigram masses: what all workers share besides the weights."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tail_mass: np.ndarray):
        """hashes, counts: head words by falling count; tail_mass: tokens in each tail class."""
        self.hashes, n = hashes, len(hashes)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        mass = np.cumsum(np.sqrt(counts))
        k = np.minimum((mass - mass[:1] * 0.5) / max(1e-9, mass[-1] if n else 1) * HEAD_CLASSES, HEAD_CLASSES - 1).astype(int) if n else np.zeros(0, int)
        self.class_of = k
        self.first = np.searchsorted(k, np.arange(HEAD_CLASSES + 1))
        self.n = n
        self.mass = np.concatenate((np.bincount(k, counts, HEAD_CLASSES), tail_mass + 1))
        self.counts = counts

    def start(self, seed: int = 5) -> dict[str, np.ndarray]:
        r = np.random.default_rng(seed)
        small = lambda *s: (r.standard_normal(s) * 0.1).astype(_F)
        within = np.log(self.counts + 0.5) - np.log(self.mass[self.class_of] + 0.5)
        return {
            "embed": small(self.n + TAILS, EMBED),
            "wx": small(EMBED, 3 * HIDDEN) * 3,
            "wh": small(HIDDEN, 3 * HIDDEN) * 2,
            "b": np.concatenate((np.full(HIDDEN, 1), np.zeros(2 * HIDDEN))).astype(_F),
            "cls": small(HIDDEN, HEAD_CLASSES + TAILS) * 0.1,
            "cls_b": np.where(self.mass > 0, np.log(np.maximum(self.mass, 0.5) / max(self.mass.sum(), 1)), -1e4).astype(_F),  # no share for classes without words
            "out": small(self.n, HIDDEN) * 0.1,
            "out_b": within.astype(_F),
        }

    def ids(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Model numbers of words: head place, or n + tail class."""
        at = np.minimum(np.searchsorted(self.sorted, hashes), max(self.n - 1, 0))
        if not self.n:
            return tails.astype(np.int64)
        return np.where(self.sorted[at] == hashes, self.order[at], self.n + tails)

    def classes(self, ids: np.ndarray) -> np.ndarray:
        out = ids - self.n + HEAD_CLASSES
        head = ids < self.n
        out[head] = self.class_of[ids[head]]
        return out


def pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params.values()])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, p in like.items():
        out[k] = np.asarray(flat[at : at + p.size], _F).reshape(p.shape)
        at += p.size
    return out


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights as parts of ``flat``, which they share."""
    out, at = {}, 0
    for k, x in like.items():
        out[k] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    return out


def _heads(shape: Shape, ids: np.ndarray, classes: np.ndarray):
    """(rows, first word, end word) of tokens in each head class."""
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    ends = np.searchsorted(classes[order], np.arange(HEAD_CLASSES + 1))
    for k in range(HEAD_CLASSES):
        rows = order[ends[k] : ends[k + 1]]
        if len(rows) and shape.first[k + 1] - shape.first[k] > 1:
            yield rows, shape.first[k], shape.first[k + 1]


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x (overwritten) less a shift, its exponentials and their sums a row; there is no shift, or one for all rows, where that loses none of them."""
    ones = np.ones(x.shape[1], x.dtype)
    if (most := x.max(initial=-np.inf)) > 60:
        x -= most
    e = np.exp(x)
    total = e @ ones
    if total.min(initial=1) < 1e-20:
        x -= x.max(axis=1, keepdims=True)
        e = np.exp(x)
        total = e @ ones
    return x, e, total


def _logits(states: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    x = states @ weights
    x += bias
    return x


def _log_share(x: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Logs of the softmax of x (overwritten) at the right columns."""
    x, _, total = _exp(x)
    return x[np.arange(len(x)), right] - np.log(total)


def log_probabilities(shape: Shape, p: dict[str, np.ndarray], states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural logs: of the class, and for head words of the word within it."""
    classes = shape.classes(ids)
    out = _log_share(_logits(states, p["cls"], p["cls_b"]), classes).astype(np.float64)
    for rows, a, b in _heads(shape, ids, classes):
        out[rows] += _log_share(_logits(states[rows], p["out"][a:b].T, p["out_b"][a:b]), ids[rows] - a)
    return out


def score(shape: Shape, p: dict[str, np.ndarray], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of log_probabilities over texts laid end to end. The state starts at 0 and is carried through a whole text."""
    lengths = np.diff(ends, prepend=0)
    order = np.argsort(-lengths, kind="stable")
    first, length = (ends - lengths)[order], lengths[order]
    table = p["embed"] @ p["wx"] + p["b"]
    total, h = np.zeros(len(ends)), np.zeros((len(ends), HIDDEN), _F)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, live = 0, len(ends)

    def flush() -> None:
        nonlocal size
        if held:
            states, tokens, who = (np.concatenate(x) for x in zip(*held, strict=True))
            total[:] += np.bincount(who, log_probabilities(shape, p, states, tokens), len(total))
        held.clear()
        size = 0

    for t in range(int(length[0]) if len(length) else 0):
        while length[live - 1] <= t:
            live -= 1
        tokens = ids[first[:live] + t]
        state = h[:live]
        held.append((state.copy(), tokens, order[:live]))
        size += live
        if size >= BLOCK:
            flush()
        g, a = table[tokens], state @ p["wh"]
        gates = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        new = np.tanh(g[:, 2 * HIDDEN :] + gates[:, HIDDEN:] * a[:, 2 * HIDDEN :])
        h[:live] = new + gates[:, :HIDDEN] * (state - new)
    flush()
    return total


def gradients(shape: Shape, p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, keep: np.ndarray, h: np.ndarray):
    """One window (steps, streams): loss a token, gradients, the state after it.

    inputs: the tokens before (only where keep, else the text starts and the state is 0).
    """
    steps, streams = targets.shape
    embedded = p["embed"][inputs.ravel()]
    inward = (embedded @ p["wx"] + p["b"]).reshape(steps, streams, 3 * HIDDEN)
    states, befores, cache = [], [], []
    for t in range(steps):
        g, a = inward[t], h @ p["wh"]
        gates = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        befores.append(h)
        h = (new + z * (h - new)) * keep[t][:, None]
        cache.append((z, r, new, a[:, 2 * HIDDEN :]))
        states.append(h)
    s, ids = np.concatenate(states), targets.ravel()
    classes, n = shape.classes(ids), len(ids)
    loss, d = _loss(_logits(s, p["cls"], p["cls_b"]), classes, n)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["cls"], grads["cls_b"] = s.T @ d, np.ones(len(d), d.dtype) @ d
    ds = d @ p["cls"].T
    for rows, a, b in _heads(shape, ids, classes):
        own = s[rows]
        more, d = _loss(_logits(own, p["out"][a:b].T, p["out_b"][a:b]), ids[rows] - a, n)
        loss += more
        grads["out"][a:b], grads["out_b"][a:b] = d.T @ own, np.ones(len(d), d.dtype) @ d
        ds[rows] += d @ p["out"][a:b]
    ds = ds.reshape(steps, streams, HIDDEN)
    dh = np.zeros_like(h)
    dgs, das = np.empty_like(inward), np.empty_like(inward)
    for t in range(steps - 1, -1, -1):
        z, r, new, a = cache[t]
        dh = (dh + ds[t]) * keep[t][:, None]
        dn = dh * (1 - z) * (1 - new * new)
        dz = dh * (befores[t] - new) * z * (1 - z)
        dgs[t] = np.concatenate((dz, dn * a * r * (1 - r), dn), axis=1)
        das[t] = dgs[t]
        das[t, :, 2 * HIDDEN :] *= r
        dh = dh * z + das[t] @ p["wh"].T
    dg, da = dgs.reshape(-1, 3 * HIDDEN), das.reshape(-1, 3 * HIDDEN)
    grads["wx"], grads["b"], grads["wh"] = embedded.T @ dg, dg.sum(0), np.concatenate(befores).T @ da
    order = np.argsort(inputs.ravel(), kind="stable")
    words, first = np.unique(inputs.ravel()[order], return_index=True)
    grads["embed"][words] = np.add.reduceat((dg @ p["wx"].T)[order], first, axis=0)
    return loss / n, grads, h


def _loss(x: np.ndarray, right: np.ndarray, n: int):
    """Summed loss of logits (overwritten) against the right columns, and the gradient of its n-th part by the logits."""
    at = np.arange(len(x))
    x, d, total = _exp(x)
    loss = (np.log(total) - x[at, right]).sum()
    d *= (1 / (n * total))[:, None]
    d[at, right] -= 1 / n
    return loss, d


def steps_of(n: int, turn: int, rounds: int) -> tuple[int, int, int, int]:
    """(streams, length of a stream, first step, end): what round ``turn`` learns of n tokens. All rounds together take every token."""
    streams = max(1, min(STREAMS, n // (128 * STEPS)))
    length = -(-n // streams)
    every = -(-length // STEPS)
    first = turn * every // rounds
    return streams, length, first, max(first + 1, (turn + 1) * every // rounds)


def train(shape: Shape, p: dict[str, np.ndarray], ids: np.ndarray, ends: np.ndarray, turn: int = 0, rounds: int = 1) -> dict[str, np.ndarray]:
    """Weights after Adam steps over round ``turn``'s share of the texts' tokens (all of them in ``rounds`` rounds), by truncated backpropagation."""
    n = len(ids)
    if not n:
        return p
    streams, length, first, end = steps_of(n, turn, rounds)
    starts = np.zeros(n, bool)
    starts[0] = True
    starts[ends[:-1]] = True
    flat = pack(p)
    p = _views(flat, p)
    m, v, slope = (np.zeros_like(flat) for _ in range(3))
    grads = _views(slope, p)
    at = np.arange(streams) * length + first * STEPS
    h = np.zeros((streams, HIDDEN), _F)
    for step in range(1, end - first + 1):
        where = (at + np.arange(STEPS)[:, None]) % n
        _, made, h = gradients(shape, p, ids[(where - 1) % n], ids[where], (~starts[where]).astype(_F), h)
        for k, g in made.items():
            grads[k][...] = g
        slope *= min(1.0, CLIP / max(float(np.sqrt(slope @ slope)), 1e-9))
        rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        m += _F(0.1) * (slope - m)
        v += _F(0.001) * (slope * slope - v)
        flat -= _F(rate) * m / (np.sqrt(v) + _F(1e-8))
        at += STEPS
    return p
