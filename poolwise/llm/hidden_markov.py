"""Numeric core of the hidden Markov language model: expected counts and exact scaled likelihoods.

Sequences are runs in one flat array of symbol numbers. All of a slice's sequences advance together, one
symbol per step; the longest come first, so the active ones are always a prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Hmm:
    start: np.ndarray  # of a document, by state
    inner: np.ndarray  # of a window inside a document, by state
    move: np.ndarray  # from state, to state
    emit: np.ndarray  # symbol, state

    @classmethod
    def initial(cls, frequency: np.ndarray, states: int, seed: int) -> Hmm:
        """Every state emits by the corpus frequencies, each distorted in its own way; moves prefer to stay."""
        rng = np.random.default_rng(seed)
        emit = frequency[:, None] * rng.gamma(2.0, size=(len(frequency), states))
        move = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
        flat = np.full(states, 1 / states)
        return cls(flat, flat.copy(), move, emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, counts: np.ndarray, frequency: np.ndarray, states: int) -> Hmm:
        """The maximisation step; a little of the corpus frequencies keeps every symbol possible."""
        start, inner, move, emit = unpack(counts, states)
        emit = emit + 0.5 * frequency[:, None]
        norm = lambda x: (x + 1e-3) / (x + 1e-3).sum(axis=-1, keepdims=True)
        return cls(norm(start), norm(inner), norm(move), emit / emit.sum(axis=0))


def unpack(counts: np.ndarray, states: int) -> tuple[np.ndarray, ...]:
    a, b, c = states, 2 * states, 2 * states + states * states
    return counts[:a], counts[a:b], counts[b:c].reshape(states, states), counts[c:].reshape(-1, states)


def by_length(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of sequences, longest first; their starts; how many are active at each step."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    return order, starts[order], active


def log_likelihoods(model: Hmm, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each whole sequence, by the scaled forward recursion."""
    order, first, active = by_length(starts, lengths)
    total = np.zeros(len(lengths))
    state = None
    for t, n in enumerate(active.tolist()):
        seen = model.emit[flat[first[:n] + t]]
        state = seen * (model.start if state is None else state[:n] @ model.move)
        scale = state.sum(axis=1)
        state /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.zeros(len(lengths))
    out[order] = total
    return out


def expected_counts(model: Hmm, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, float]:
    """The expectation step over windows; ``whole`` says which windows begin a document. Counts, log likelihood."""
    states = len(model.start)
    start, inner = np.zeros(states), np.zeros(states)
    move, emit = np.zeros((states, states)), np.zeros_like(model.emit)
    order, first, active = by_length(starts, lengths)
    begins = whole[order]
    forward, scales, likelihood = [], [], 0.0
    transition, emission = model.move.astype(np.float32), model.emit.astype(np.float32)
    state = None
    for t, n in enumerate(active.tolist()):
        seen = emission[flat[first[:n] + t]]
        if state is None:
            state = seen * np.where(begins[:, None], model.start, model.inner).astype(np.float32)
        else:
            state = seen * (state[:n] @ transition)
        scale = state.sum(axis=1)
        state = state / scale[:, None]
        likelihood += float(np.log(scale).sum())
        forward.append(state)
        scales.append(scale)
    symbols, weights = [], []
    beta = np.zeros((0, states), np.float32)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        if len(beta) < n:
            beta = np.concatenate([beta, np.ones((n - len(beta), states), np.float32)])
        here = flat[first[:n] + t]
        gamma = forward[t] * beta
        symbols.append(here)
        weights.append(gamma)
        if t:
            ahead = emission[here] * beta / scales[t][:, None]
            move += forward[t - 1][:n].T @ ahead
            beta = ahead @ transition.T
        else:
            start += gamma[begins].sum(axis=0)
            inner += gamma[~begins].sum(axis=0)
    if symbols:
        seen, gamma = np.concatenate(symbols), np.concatenate(weights)
        for k in range(states):
            emit[:, k] = np.bincount(seen, weights=gamma[:, k], minlength=len(emit))
    return np.concatenate([start, inner, (move * model.move).ravel(), emit.ravel()]), likelihood
