"""Decoding of many label chains in step: the t-th items of all chains are worked together.

Chains are sorted by length, so at step t the first ``active[t]`` of them still run.  Scores
are one row per item, chain after chain; memory is bounded by the caller's slice.
"""

from __future__ import annotations

import numpy as np


def in_step(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chains longest first, their first items, number of chains still running at each step)."""
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    longest = int(counts.max(initial=0))
    active = np.searchsorted(-counts[order], -np.arange(longest), side="left")
    return order, starts, active


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every item when each change of label costs ``penalty``; ties stay."""
    _, starts, active = in_step(counts)
    labels = scores.shape[1]
    best = np.zeros((len(counts), labels))
    stays = np.ones(scores.shape, bool)
    from_ = np.zeros(len(scores), np.int16)
    for t, k in enumerate(active):
        at, d = starts[:k] + t, best[:k]
        if t:
            from_[at] = top = d.argmax(1)
            change = d[np.arange(k), top][:, None] - penalty
            stays[at] = stay = d >= change
            d = np.where(stay, d, change)
        best[:k] = d + scores[at]
    out = np.zeros(len(scores), np.int16)
    now = best.argmax(1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        at, k = starts[:active[t]] + t, active[t]
        out[at] = now[:k]
        now[:k] = np.where(stays[at, now[:k]], now[:k], from_[at])
    return out


def marginals(scores: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over log scores: (label marginals of every item, expected number of
    each move over all chains, summed log partition)."""
    _, starts, active = in_step(counts)
    ahead, behind = np.zeros(scores.shape), np.zeros(scores.shape)
    for t, k in enumerate(active):
        at = starts[:k] + t
        ahead[at] = scores[at] + (np.logaddexp.reduce(ahead[at - 1][:, :, None] + moves, axis=1) if t else 0.0)
    for t in range(len(active) - 2, -1, -1):
        at = starts[:active[t + 1]] + t
        behind[at] = np.logaddexp.reduce(moves + (scores[at + 1] + behind[at + 1])[:, None, :], axis=2)
    total = np.logaddexp.reduce(ahead + behind, axis=1)
    share = np.exp(ahead + behind - total[:, None])
    follows = np.ones(len(scores), bool)
    follows[starts[:active[0] if len(active) else 0]] = False
    at = np.flatnonzero(follows)
    pairs = ahead[at - 1][:, :, None] + moves + (scores[at] + behind[at])[:, None, :] - total[at][:, None, None]
    firsts = starts[:active[0]] if len(active) else starts[:0]
    return share, np.exp(pairs).sum(0), float(total[firsts].sum())
