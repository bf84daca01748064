"""Linear-chain conditional random fields over many sequences at a time, in numpy.

Every position of a sequence has a fixed number of active features, given as columns of indices. All
sequences of a batch advance together: they are sorted by length, and step t works on the prefix
of sequences that are longer than t. Decoding takes long sequences in blocks that advance together too,
each from every label that may stand before it, and then joins the blocks, so nothing is lost at their edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


#: Sequences longer than this many positions are decoded in blocks of so many.
BLOCK = 200


@dataclass
class ChainModel:
    """weights: (features, labels); moves: (from, to); first: (labels)."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = self.weights[features[:, 0]].copy()
        for column in range(1, features.shape[1]):
            out += self.weights[features[:, column]]
        return out


def _steps(offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The positions at step 0, 1, ... of all sequences that reach it, longest sequence first."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    for t, n in enumerate(active.tolist()):
        yield starts[:n] + t


def decode(model: ChainModel, features: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The likeliest labels of all positions (Viterbi), whatever the length of their sequence."""
    emit = model.scores(features)
    labels = np.zeros(len(emit), dtype=np.int8)
    long = np.diff(offsets) > block
    for own, blocks in ((~long, False), (long, True)):
        lengths = np.diff(offsets)[own]
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(offsets[:-1][own] - bounds[:-1], lengths) + np.arange(bounds[-1])
        if len(at):
            labels[at] = _decode_blocks(model, emit[at], bounds, block) if blocks else _decode_whole(model, emit[at], bounds)
    return labels


def _decode_whole(model: ChainModel, emit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    labels = np.zeros(len(emit), dtype=np.int8)
    best, steps = np.zeros(emit.shape, dtype=np.int8), list(_steps(offsets))
    held = None
    tops = []
    for t, at in enumerate(steps):
        if t == 0:
            held = model.first + emit[at]
        else:
            n, before = len(at), held
            reach = before[:n, :, None] + model.moves
            best[at] = reach.argmax(axis=1)
            tops.append(before[n:])
            held = np.take_along_axis(reach, best[at][:, None, :].astype(np.int64), axis=1)[:, 0] + emit[at]
    tops.append(held)
    state = np.zeros(0, dtype=np.int64)
    for t in range(len(steps) - 1, -1, -1):
        at = steps[t]
        # Sequences that end here start from their best last label; the others follow the pointers.
        state = np.concatenate((state, tops[t].argmax(axis=1)))
        labels[at] = state
        if t:
            state = best[at, state].astype(np.int64)
    return labels


def _decode_blocks(model: ChainModel, emit: np.ndarray, offsets: np.ndarray, block: int) -> np.ndarray:
    """As _decode_whole: the best way through every block from each label before it, then the best chain of blocks."""
    labels = np.zeros(len(emit), dtype=np.int8)
    n_labels = emit.shape[1]
    counts = -(-np.diff(offsets) // block)
    heads = np.concatenate(([0], np.cumsum(counts)))
    starts = np.repeat(offsets[:-1] - heads[:-1] * block, counts) + np.arange(heads[-1]) * block
    stops = np.append(starts[1:], offsets[-1])
    order = np.argsort(starts - stops, kind="stable")
    is_head = np.zeros(len(starts), dtype=bool)
    is_head[heads[:-1]] = True
    # best: (position, label before the block, label) -> label one position earlier.
    best, steps = np.zeros((len(emit), n_labels, n_labels), dtype=np.int8), list(_steps(np.append(starts, offsets[-1])))
    through = np.zeros((len(starts), n_labels, n_labels))
    held = np.where(is_head[order][:, None, None], model.first, model.moves) + emit[steps[0]][:, None, :]
    for at in steps[1:]:
        n = len(at)
        through[order[n : len(held)]] = held[n:]
        reach = held[:n, :, :, None] + model.moves
        top = reach.argmax(axis=2)
        best[at] = top
        held = np.take_along_axis(reach, top[:, :, None, :], axis=2)[:, :, 0] + emit[at][:, None, :]
    through[order[: len(held)]] = held
    # From block to block: the best label before each block for every label at its end, and back.
    came, last = np.zeros((len(starts), n_labels), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    for lo, hi in zip(heads[:-1].tolist(), heads[1:].tolist()):
        ends = through[lo, 0]
        for k in range(lo + 1, hi):
            reach = ends[:, None] + through[k]
            came[k] = reach.argmax(axis=0)
            ends = reach.max(axis=0)
        last[hi - 1] = ends.argmax()
        for k in range(hi - 1, lo, -1):
            last[k - 1] = came[k, last[k]]
    before = np.where(is_head, 0, np.append(0, last[:-1]))[order]
    state = np.zeros(0, dtype=np.int64)
    for t in range(len(steps) - 1, -1, -1):
        at = steps[t]
        state = np.concatenate((state, last[order[len(state) : len(at)]]))
        labels[at] = state
        if t:
            state = best[at, before[: len(at)], state].astype(np.int64)
    return labels


def marginals(model: ChainModel, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of every label at every position (forward-backward)."""
    return _forward_backward(model, features, offsets)[0]


def _forward_backward(model: ChainModel, features: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of positions, expected counts of moves, and the log of all partition sums together."""
    emit = model.scores(features)
    peak = emit.max(axis=1, keepdims=True) if len(emit) else emit[:, :1]
    local, moves, first = np.exp(emit - peak), np.exp(model.moves), np.exp(model.first)
    ahead, behind, scale = np.zeros_like(local), np.ones_like(local), np.ones(len(local))
    steps = list(_steps(offsets))
    for t, at in enumerate(steps):
        raw = (first if t == 0 else ahead[at - 1] @ moves) * local[at]
        scale[at] = raw.sum(axis=1)
        ahead[at] = raw / scale[at][:, None]
    expected = np.zeros_like(moves)
    for t in range(len(steps) - 1, 0, -1):
        at = steps[t]
        onward = local[at] * behind[at] / scale[at][:, None]
        behind[at - 1] = onward @ moves.T
        expected += (ahead[at - 1].T @ onward) * moves
    return ahead * behind, expected, float(np.log(scale).sum() + peak.sum())


def train(features: np.ndarray, offsets: np.ndarray, labels: np.ndarray, n_features: int, n_labels: int, ridge: float = 1.0, rounds: int = 80, rate: float = 0.1) -> ChainModel:
    """Maximise the ridge-penalised log likelihood by Adam over whole-batch gradients.

    Deterministic: the likelihood is concave, so no random start is needed.
    """
    if not len(labels):
        return ChainModel(np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    shapes = ((n_features, n_labels), (n_labels, n_labels), (n_labels,))
    params, m, v = ([np.zeros(s) for s in shapes] for _ in range(3))
    lengths = np.diff(offsets)
    firsts = offsets[:-1][lengths > 0]
    inner = np.ones(len(labels), dtype=bool)
    inner[firsts] = False
    inner = np.flatnonzero(inner)
    truth = np.eye(n_labels)[labels]
    moved = np.zeros(shapes[1])
    np.add.at(moved, (labels[inner - 1], labels[inner]), 1)
    for k in range(1, rounds + 1):
        model = ChainModel(*params)
        inside, expected, _ = _forward_backward(model, features, offsets)
        gap = truth - inside
        grads = [np.zeros(shapes[0]), moved - expected, gap[firsts].sum(axis=0)]
        # The gaps of a position sum to zero, so the last label's are those of the others with another sign.
        for label in range(n_labels - 1):
            for column in range(features.shape[1]):
                grads[0][:, label] += np.bincount(features[:, column], weights=gap[:, label], minlength=n_features)
        grads[0][:, -1] = -grads[0][:, :-1].sum(axis=1)
        for p, g, a, b in zip(params, grads, m, v):
            g = (g - ridge * p) / len(labels)
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p += rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return ChainModel(*params)
