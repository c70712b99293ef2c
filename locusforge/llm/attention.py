"""A small causal self-attention model in numpy over ranks of subword ids, with its gradient and Adam.

A rank is an id's place by falling frequency. The output layer is a tree of two levels: the model predicts the class of the
next rank, and then the rank within the class; both from the state that attention made. What is never seen in training shares
one input vector and, in the last class, one probability.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import cached_property, lru_cache

import numpy as np


@dataclass
class Tree:
    """Classes of neighbouring ranks: class ``c`` has the ranks ``first[c]`` to ``first[c + 1]``; ranks from ``seen`` on are
    the last class, and equal in it."""

    first: np.ndarray
    seen: int
    total: int

    @property
    def classes(self) -> int:
        return len(self.first) - 1

    @cached_property
    def runs(self) -> list[tuple[int, int, int]]:
        """Neighbouring classes of like size that go together: first, behind the last, and the greatest size. None of one rank."""
        sizes = np.diff(self.first)[: self.classes - (self.seen < self.total)]
        bracket = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        bounds = [0, *(np.flatnonzero(np.diff(bracket)) + 1).tolist(), len(sizes)]
        return [(a, b, int(sizes[a:b].max())) for a, b in zip(bounds, bounds[1:]) if a < b and bracket[a]]

    @cached_property
    def of(self) -> np.ndarray:
        """Class of each rank."""
        return np.repeat(np.arange(self.classes, dtype=np.uint16), np.diff(self.first))


def make_tree(counts: np.ndarray) -> Tree:
    """For counts in falling order. A class ends at its share of the mass or at its greatest size, so that both levels together
    have no more than a few times the root of the number of ranks seen."""
    seen = int((counts > 0).sum())
    root = max(1.0, np.sqrt(seen))
    share, most = 2 * counts.sum() / root, int(2 * root)
    first, mass = [0], 0.0
    for rank in range(seen):
        mass += counts[rank]
        if mass >= share or rank + 1 - first[-1] >= most:
            first.append(rank + 1)
            mass = 0.0
    if first[-1] < seen:
        first.append(seen)
    if seen < len(counts):
        first.append(len(counts))
    return Tree(np.array(first, np.int64), seen, len(counts))


@dataclass
class Attention:
    """``e`` and ``s``: vectors of the input and of the one before it; ``p`` of places; ``a`` and ``r``: what is asked by content
    and by distance; ``m``: mixing; ``w1 c1 w2``: the layer after it; ``u1 b1`` and ``u2 b2``: classes, and ranks within them."""

    e: np.ndarray
    s: np.ndarray
    p: np.ndarray
    a: np.ndarray
    r: np.ndarray
    m: np.ndarray
    w1: np.ndarray
    c1: np.ndarray
    w2: np.ndarray
    u1: np.ndarray
    b1: np.ndarray
    u2: np.ndarray
    b2: np.ndarray

    @property
    def window(self) -> int:
        return len(self.p)

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def like(self, flat: np.ndarray) -> Attention:
        out, at = [], 0
        for a in self.arrays():
            out.append(np.asarray(flat[at : at + a.size], a.dtype).reshape(a.shape))
            at += a.size
        return Attention(*out)


def new_attention(tree: Tree, counts: np.ndarray, *, width: int = 16, inner: int = 32, window: int = 32, seed: int = 0, dtype=np.float32) -> Attention:
    """Random small weights; the output biases begin at the log of ``counts`` (by rank). Inputs beside the ranks seen: an
    unseen one, the begin of a text, and none."""
    rng = np.random.default_rng(seed)
    small = lambda size, *shape: (rng.normal(0, size, shape)).astype(dtype)
    by_class = np.add.reduceat(counts + 0.5, tree.first[:-1]) if tree.classes else np.zeros(0)
    return Attention(
        small(0.1, tree.seen + 3, width), small(0.1, tree.seen + 3, width), small(0.05, window, width),
        small(0.1, width, width), np.zeros((window, window), dtype), small(0.1, width, width),
        small(0.15, width, inner), np.zeros(inner, dtype), small(0.1, inner, width),
        small(0.05, tree.classes, width), np.log(by_class / by_class.sum()).astype(dtype),
        small(0.05, tree.seen, width), np.log(counts[: tree.seen] + 0.5).astype(dtype) - np.log(by_class)[tree.of[: tree.seen]].astype(dtype),
    )


#: Attention scores and outputs count within these bounds, so that no row of exponentials needs its own maximum.
SCORE_BOUND = 60.0


@lru_cache(maxsize=8)
def _past(t: int, dtype) -> np.ndarray:
    return np.tril(np.ones((t, t), dtype))


@lru_cache(maxsize=8)
def _all_ones(n: int, dtype) -> np.ndarray:
    return np.ones(n, dtype)


def _ones(n: int, dtype) -> np.ndarray:
    return _all_ones(1 << int(n).bit_length(), dtype)[:n]


def _softmax(z: np.ndarray) -> np.ndarray:
    """Exponentials along the last axis, in place; returns their sums."""
    np.clip(z, -SCORE_BOUND, SCORE_BOUND, out=z)
    np.exp(z, out=z)
    return z @ _ones(z.shape[-1], z.dtype)


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.concatenate([weights, bias[:, None]], 1)


def _with_one(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows ``at`` of ``g``, each with a one behind it for the bias."""
    out = np.ones((len(at), g.shape[1] + 1), g.dtype)
    out[:, :-1] = g.take(at, 0)
    return out


def _inside(u2: np.ndarray, tree: Tree, g: np.ndarray, bounds: list, c: int, e: int, width: int):
    """Outputs within the classes ``c`` to ``e`` for states sorted by class, and the rows these are; of columns that a class
    lacks, next to nothing counts. States and ``u2`` have their ones and biases."""
    part = slice(bounds[c], bounds[e])
    z = np.empty((part.stop - part.start, width), g.dtype)
    for k in range(c, e):
        low, high, a, b = bounds[k], bounds[k + 1], tree.first[k], tree.first[k + 1]
        if low < high:
            own = z[low - part.start : high - part.start]
            np.matmul(g[low:high], u2[a:b].T, out=own[:, : b - a])
            own[:, b - a :] = -SCORE_BOUND
    return z, part


def _state(m: Attention, inputs: np.ndarray, before: np.ndarray):
    """What the gradient needs of each place: the input, what it asks, its weights on the past (exponentials, and one over
    their sums), what these mix, and the layers after it."""
    n, t = inputs.shape
    d = m.e.shape[1]
    x = m.e.take(inputs.ravel(), 0)
    x += m.s.take(before.ravel(), 0)
    x = x.reshape(n, t, d)
    x += m.p[:t]
    flat = x.reshape(n * t, d)
    xt = np.ascontiguousarray(x.transpose(0, 2, 1))  # products of many small matrices are slow over transposed views
    asked = (flat @ m.a).reshape(n, t, d)
    w = asked @ xt
    w += m.r[:t, :t]
    np.clip(w, -SCORE_BOUND, SCORE_BOUND, out=w)
    np.exp(w, out=w)
    w *= _past(t, w.dtype)
    part = np.divide(1, w @ _ones(t, w.dtype), dtype=w.dtype).reshape(n * t, 1)
    mixed = (w @ x).reshape(n * t, d)
    mixed *= part  # narrower than the weights
    h = mixed @ m.m
    h += flat
    f = h @ m.w1
    f += m.c1
    np.maximum(f, 0, out=f)
    g = f @ m.w2
    g += h
    return x, xt, asked, w, part, mixed, h, f, g


#: Rows whose classes are weighed at once; their outputs stay in the processor's cache from one step to the next.
CLASS_ROWS = 2048


def log_probabilities(m: Attention, tree: Tree, inputs: np.ndarray, before: np.ndarray, targets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Natural logs of the probabilities of ``targets`` at the places where ``wanted`` is true, in row order.

    The arrays have a row for each window; places behind a short window's end do no harm, since no earlier place looks at
    them.
    """
    at = np.flatnonzero(wanted)
    y = targets.ravel().take(at)
    own = tree.of.take(y)
    order = np.argsort(own, kind="stable")
    g = _with_one(_state(m, inputs, before)[-1], at.take(order))
    y, own = y.take(order), own.take(order)
    u2 = _with_bias(m.u2, m.b2)
    u1 = _with_bias(m.u1, m.b1).T
    logs = np.empty(len(y), g.dtype)
    for low in range(0, len(y), CLASS_ROWS):
        rows = slice(low, low + CLASS_ROWS)
        z = g[rows] @ u1
        logs[rows] = z[np.arange(len(z)), own[rows]]
        logs[rows] -= np.log(_softmax(z))
    bounds = np.searchsorted(own, np.arange(tree.classes + 1)).tolist()
    for c, e, width in tree.runs:
        z, part = _inside(u2, tree, g, bounds, c, e, width)
        if len(z):
            logs[part] += z[np.arange(len(z)), y[part] - tree.first[own[part]]]
            logs[part] -= np.log(_softmax(z))
    if tree.seen < tree.total:
        logs[bounds[-2] :] -= np.log(tree.total - tree.seen)
    out = np.empty_like(logs)
    out[order] = logs
    return out


#: Rows of one key that are added one after the other, for all keys at once; more are a product.
_SHORT_RUN = 12


def _sum_rows(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by key. (``reduceat`` would go column by column.)"""
    if n <= 1 << 16:
        keys = keys.astype(np.uint16)  # which numpy sorts by radix
    order = np.argsort(keys, kind="stable")
    own, rows = keys.take(order), rows[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    sizes = np.diff(starts, append=len(own))
    sums = rows[starts]
    for i in range(1, _SHORT_RUN):
        more = np.flatnonzero(sizes > i)
        sums[more] += rows[starts[more] + i]
    for k in np.flatnonzero(sizes > _SHORT_RUN).tolist():
        sums[k] = _ones(sizes[k], rows.dtype) @ rows[starts[k] : starts[k] + sizes[k]]
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[own[starts]] = sums
    return out


def _sum_inputs(slopes: np.ndarray, inputs: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``slopes`` by input and by the one before, which is the input of the place before it. A row of zeros stands
    before each window, for the input before its first, and at the end."""
    n, t = inputs.shape
    d = slopes.shape[1]
    both = np.lib.stride_tricks.as_strided(slopes, (n * (t + 1), 2 * d), slopes.strides, writeable=False)  # each row and the next
    sums = _sum_rows(both, np.concatenate([before[:, :1], inputs], 1).ravel(), size)
    return sums[:, :d], sums[:, d:]


def _gradient(m: Attention, tree: Tree, inputs: np.ndarray, before: np.ndarray, targets: np.ndarray, wanted: np.ndarray, over: int, into: Attention, slopes: np.ndarray) -> float:
    """Adds the gradient of the negative log probability over ``wanted``, divided by ``over``, to ``into``, but for the inputs'
    vectors: their ``slopes`` are set by place. Returns the loss."""
    n, t = inputs.shape
    x, xt, asked, w, share, mixed, h, f, g = _state(m, inputs, before)
    d = x.shape[2]
    flat = x.reshape(n * t, d)
    at = np.flatnonzero(wanted)
    y = targets.ravel().take(at)
    own = tree.of.take(y)
    order = np.argsort(own, kind="stable")
    at, y, own = at.take(order), y.take(order), own.take(order)
    gs = _with_one(g, at)
    scale = x.dtype.type(1 / max(1, over))
    rows = np.arange(len(y))
    u1, u2 = _with_bias(m.u1, m.b1).T, _with_bias(m.u2, m.b2)
    loss, dgs = 0.0, np.empty((len(y), d), x.dtype)
    z_room = np.empty((min(len(y), CLASS_ROWS), tree.classes), x.dtype)
    for low in range(0, len(y), CLASS_ROWS):
        some = slice(low, low + CLASS_ROWS)
        z = np.matmul(gs[some], u1, out=z_room[: len(y) - low])
        sums = _softmax(z)
        target = (rows[: len(z)], own[some])
        loss -= float(np.log(z[target] / sums).sum())
        z *= (scale / sums)[:, None]
        z[target] -= scale
        into.u1[...] += z.T @ gs[some, :-1]
        into.b1[...] += _ones(len(z), z.dtype) @ z
        np.matmul(z, m.u1, out=dgs[some])
    bounds = np.searchsorted(own, np.arange(tree.classes + 1)).tolist()
    for c, e, width in tree.runs:
        z, part = _inside(u2, tree, gs, bounds, c, e, width)
        if not len(z):
            continue
        sums = _softmax(z)
        target = (rows[: len(z)], y[part] - tree.first[own[part]])
        loss -= float(np.log(z[target] / sums).sum())
        z *= (scale / sums)[:, None]
        z[target] -= scale
        for k in range(c, e):
            low, high, a, b = bounds[k], bounds[k + 1], tree.first[k], tree.first[k + 1]
            if low < high:
                own_z = z[low - part.start : high - part.start, : b - a]
                du = own_z.T @ gs[low:high]
                into.u2[a:b] += du[:, :-1]
                into.b2[a:b] += du[:, -1]
                dgs[low:high] += own_z @ m.u2[a:b]
    dg = np.zeros_like(g)
    dg[at] = dgs
    df = dg @ m.w2.T
    df *= f > 0
    dh = df @ m.w1.T
    dh += dg
    dmixed = dh @ m.m.T
    dmixed *= share
    along = np.einsum("ij,ij->i", dmixed, mixed).reshape(n, t, 1)  # the slopes of a place's weights, weighed by these
    dmixed = dmixed.reshape(n, t, d)
    dw = dmixed @ xt
    dw -= along
    dw *= w
    dx = w.transpose(0, 2, 1) @ dmixed
    dasked = (dw @ x).reshape(n * t, d)
    dx += dw.transpose(0, 2, 1) @ asked
    dxf = dx.reshape(n * t, d)
    dxf += dh
    dxf += dasked @ m.a.T
    slopes[: n * (t + 1)].reshape(n, t + 1, d)[:, 1:] = dx
    into.r[:t, :t] += dw.sum(0)
    into.p[:t] += dx.sum(0)
    into.a[...] += flat.T @ dasked
    into.m[...] += mixed.T @ dh
    into.w1[...] += h.T @ df
    into.c1[...] += _ones(len(df), df.dtype) @ df
    into.w2[...] += f.T @ dg
    return loss * float(scale)


def loss_and_gradient(m: Attention, tree: Tree, *windows: np.ndarray) -> tuple[float, Attention]:
    """Mean negative log probability over the last of ``windows``, and its gradient: inputs, the inputs before them within a
    window, targets, and which targets count."""
    return _added_up(m, tree, windows, len(windows[0]))


#: Windows whose gradient is taken at once. The arrays of more leave the processor's caches and are mapped anew each time.
PIECE_WINDOWS = 256


def in_pieces(m: Attention, tree: Tree, *windows: np.ndarray) -> tuple[float, Attention]:
    """``loss_and_gradient``, added up over pieces of the windows."""
    return _added_up(m, tree, windows, PIECE_WINDOWS)


def _added_up(m: Attention, tree: Tree, windows: tuple, together: int) -> tuple[float, Attention]:
    inputs, before, *_, wanted = windows
    (n, t), d, over = inputs.shape, m.e.shape[1], int(wanted.sum())
    slope = Attention(m.e, m.s, *(np.zeros_like(a) for a in m.arrays()[2:]))
    slopes, loss = np.zeros((n * (t + 1) + 1, d), m.e.dtype), 0.0
    for at in range(0, n, max(1, together)):
        loss += _gradient(m, tree, *(x[at : at + together] for x in windows), over, slope, slopes[at * (t + 1) :])
    slope.e, slope.s = _sum_inputs(slopes, inputs, before, len(m.e))
    return loss, slope


#: Weights that Adam moves at once, so that what it holds of them stays in the cache between its steps.
ADAM_CELLS = 1 << 14


class Adam:
    """Adam over all weights of a model, which it changes in place."""

    def __init__(self, model: Attention, tree: Tree, rate: float = 3e-3):
        self.model, self.tree, self.rate, self.steps = model, tree, rate, 0
        self.first, self.second = ([np.zeros(a.size, a.dtype) for a in model.arrays()] for _ in range(2))

    def step(self, *windows: np.ndarray) -> float:
        loss, slope = in_pieces(self.model, self.tree, *windows)
        self.steps += 1
        fix1, fix2 = 1 - 0.9**self.steps, 1 - 0.99**self.steps
        least, rate = float(1e-8 * np.sqrt(fix2)), float(self.rate * np.sqrt(fix2) / fix1)
        room = np.empty(ADAM_CELLS, self.model.e.dtype)
        for weights, slopes, first, second in zip(self.model.arrays(), slope.arrays(), self.first, self.second):
            weights, slopes = weights.reshape(-1), slopes.reshape(-1)
            for at in range(0, len(weights), ADAM_CELLS):
                here = slice(at, at + ADAM_CELLS)
                g, a, b = slopes[here], first[here], second[here]
                move = np.subtract(g, a, out=room[: len(g)])
                move *= 0.1
                a += move
                np.multiply(g, g, out=move)
                move -= b
                move *= 0.01
                b += move
                np.sqrt(b, out=move)
                move += least
                np.divide(a, move, out=move)
                move *= rate
                weights[here] -= move
        return loss


def copy_of(model: Attention) -> Attention:
    return replace(model, **{f.name: getattr(model, f.name).copy() for f in fields(model)})
