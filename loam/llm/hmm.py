"""The hidden Markov model's arithmetic, in numpy.

Sequences are cut into chunks of ``STEP`` symbols. Each chunk's product of transition and emission
matrices is made in lockstep with all other chunks; multiplying the products along a sequence gives
the same value as the forward recursion from symbol to symbol, scaled as it goes. Sequences are taken
in groups of about ``GROUP`` symbols, which bounds the memory.
"""

from __future__ import annotations

import numpy as np

STEP = 32
LOT = 4096
GROUP = 1 << 20


class Model:
    """start: distribution of the state before the first symbol; step[i, j]; emit[k, symbol]."""

    def __init__(self, start, step, emit):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def first(cls, states: int, symbol_counts: np.ndarray, seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        emit = (symbol_counts + 0.5)[None, :] * rng.lognormal(0, 1, (states, len(symbol_counts)))
        step = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(step, 0.9 if states > 1 else 1)
        return cls(np.full(states, 1 / states), step, emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, start, step, emit, smooth: float = 0.05) -> Model:
        """Maximisation; ``smooth`` is added to each expected count."""
        ratio = lambda x: (x + smooth) / (x + smooth).sum(-1, keepdims=True)
        return cls(ratio(start), ratio(step), ratio(emit))


def _cut(lens: np.ndarray):
    """Index of each chunk's symbols, which of them exist, each sequence's first chunk and chunks."""
    n = -(-lens // STEP)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
    doc = np.repeat(np.arange(len(lens)), n)
    at = (begin[doc] + (np.arange(n.sum()) - first[doc]) * STEP)[:, None] + np.arange(STEP)[None, :]
    there = at < (begin + lens)[doc][:, None]
    return np.minimum(at, max(0, lens.sum() - 1)), there, first, n


def _lots(there: np.ndarray):
    """Chunks in lots, the longest first, and how many of a lot's chunks have a symbol at each step."""
    size = there.sum(1)
    order = np.argsort(-size, kind="stable")
    for a in range(0, len(order), LOT):
        lot = order[a : a + LOT]
        yield lot, np.searchsorted(-size[lot], -np.arange(STEP), side="left")


def _products(model: Model, x: np.ndarray, there: np.ndarray):
    k = len(model.start)
    out, logs = np.empty((len(x), k, k)), np.zeros(len(x))
    move = np.ascontiguousarray(model.step.T)
    for lot, act in _lots(there):
        xs = np.ascontiguousarray(x[lot].T)
        m = np.repeat(np.eye(k)[:, :, None], len(lot), 2)  # [i, j, chunk]
        for t in range(STEP):
            n = int(act[t])
            if not n:
                break
            nxt = move @ m[:, :, :n]
            nxt *= model.emit.take(xs[t, :n], 1)
            m[:, :, :n] = nxt
            if t % 8 == 7:
                s = m.max((0, 1))
                m /= s
                logs[lot] += np.log(s)
        out[lot] = m.transpose(2, 0, 1)
    return out, logs


def _forward(model: Model, m, logs, first, n):
    """log-likelihood of each sequence and the scaled forward vector before each chunk."""
    order = np.argsort(-n, kind="stable")
    sizes = n[order]
    alpha, ll = np.tile(model.start, (len(n), 1)), np.zeros(len(n))
    before = np.empty((len(m), len(model.start)))
    for j in range(int(sizes[0]) if len(n) else 0):
        act = int(np.searchsorted(-sizes, -j, side="left"))
        at = first[order[:act]] + j
        before[at] = alpha[:act]
        a = np.einsum("dk,dkl->dl", alpha[:act], m[at])
        s = a.sum(1)
        alpha[:act] = a / s[:, None]
        ll[:act] += np.log(s) + logs[at]
    out = np.empty(len(n))
    out[order] = ll
    return out, before


def _behind(model: Model, m, first, n):
    order = np.argsort(-n, kind="stable")
    sizes = n[order]
    beta = np.ones((len(n), len(model.start)))
    after = np.empty((len(m), len(model.start)))
    for j in range(int(sizes[0]) - 1 if len(n) else -1, -1, -1):
        act = int(np.searchsorted(-sizes, -j, side="left"))
        at = first[order[:act]] + j
        after[at] = beta[:act]
        b = np.einsum("dkl,dl->dk", m[at], beta[:act])
        beta[:act] = b / b.max(1, keepdims=True)
    return after


def _groups(symbols: np.ndarray, lens: np.ndarray):
    """Symbols and lengths of whole sequences, in turn; a group ends where it has ``GROUP`` symbols or more."""
    lens = np.asarray(lens, np.int64)
    ends = np.cumsum(lens)
    a, begin = 0, 0
    while a < len(lens):
        b = min(len(lens), int(np.searchsorted(ends, begin + GROUP)) + 1)
        yield symbols[begin : ends[b - 1]], lens[a:b]
        a, begin = b, int(ends[b - 1])


def likelihoods(model: Model, symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Natural-log likelihood of each sequence; every length is at least 1."""
    out = [np.zeros(0)]
    for x, sizes in _groups(symbols, lens):
        at, there, first, n = _cut(sizes)
        m, logs = _products(model, x[at], there)
        out.append(_forward(model, m, logs, first, n)[0])
    return np.concatenate(out)


def expected_counts(model: Model, symbols: np.ndarray, lens: np.ndarray):
    """Baum-Welch: expected counts of start states, transitions and emissions, and the log-likelihood."""
    k, c = model.emit.shape
    total = [np.zeros(k), np.zeros((k, k)), np.zeros((k, c)), 0.0]
    for x, sizes in _groups(symbols, lens):
        total = [a + b for a, b in zip(total, _group_counts(model, x, sizes))]
    return tuple(total)


def _group_counts(model: Model, symbols: np.ndarray, lens: np.ndarray):
    k, c = model.emit.shape
    start, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
    at, there, first, n = _cut(lens)
    x = symbols[at]
    m, logs = _products(model, x, there)
    ll, before = _forward(model, m, logs, first, n)
    after = _behind(model, m, first, n)
    heads = np.zeros(len(x), bool)
    heads[first] = True
    move = np.ascontiguousarray(model.step.T)
    for lot, act in _lots(there):
        xs = np.ascontiguousarray(x[lot].T)
        alphas, gammas = np.empty((STEP + 1, k, len(lot))), np.zeros((STEP, k, len(lot)))
        alphas[0] = before[lot].T
        moves = []  # emissions of each step over the forward vector's sum
        for t in range(STEP):
            j = int(act[t])
            e = model.emit.take(xs[t, :j], 1)
            v = move @ alphas[t, :, :j]
            v *= e
            s = v.sum(0)
            np.divide(v, s, out=alphas[t + 1, :, :j])
            alphas[t + 1, :, j:] = alphas[t, :, j:]
            e /= s
            moves.append(e)
        # Scaled so that forward times backward is the state's probability.
        beta = np.ascontiguousarray(after[lot].T)
        beta /= (alphas[STEP] * beta).sum(0)
        for t in range(STEP - 1, -1, -1):
            j = int(act[t])
            np.multiply(alphas[t + 1, :, :j], beta[:, :j], out=gammas[t, :, :j])
            w = moves[t]
            w *= beta[:, :j]
            step += alphas[t, :, :j] @ w.T
            beta[:, :j] = model.step @ w
        h = heads[lot]
        start += (alphas[0][:, h] * beta[:, h]).sum(1)
        flat = xs.ravel()
        for i in range(k):
            emit[i] += np.bincount(flat, weights=gammas[:, i].ravel(), minlength=c)
    return start, step * model.step, emit, float(ll.sum())
