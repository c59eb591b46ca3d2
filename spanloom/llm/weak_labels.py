"""Expectation-maximisation over vote patterns, shared by the weakly supervised operators.

Votes are 0 (abstain), 1 (against) and 2 (for). Labellers are taken as independent given the
class; each has a chance of every vote per class. The input is a count per vote pattern, so its
size is bounded by the number of labellers, whatever the corpus.
"""

from __future__ import annotations

import numpy as np


def estimate(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.5, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each pattern, chances[class, labeller, vote], class share).

    Starts from the majority vote. Smoothing by one pseudo-vote keeps every chance positive;
    without any pattern the result is empty.
    """
    if not len(patterns):
        return np.empty(0), np.full((2, 0, 3), 1 / 3), prior
    n_for, n_against = (patterns == 2).sum(axis=1), (patterns == 1).sum(axis=1)
    post = np.clip((n_for + prior) / (n_for + n_against + 1.0), 0.02, 0.98)
    chances, share = np.full((2, patterns.shape[1], 3), 1 / 3), prior
    for _ in range(rounds):
        before = post
        for c, weight in ((1, post * counts), (0, (1 - post) * counts)):
            total = weight.sum() + 3.0
            for v in range(3):
                chances[c, :, v] = ((patterns == v) * weight[:, None]).sum(axis=0) / total + 1.0 / total
        share = float(np.clip((post * counts).sum() / counts.sum(), 0.01, 0.99))
        at = np.arange(patterns.shape[1])[None, :]
        odds = np.log(share / (1 - share)) + (np.log(chances[1][at, patterns]) - np.log(chances[0][at, patterns])).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(post - before).max() < 1e-6:
            break
    # The class named "for" is the one whose members get more votes for than against.
    lean = ((n_for - n_against) * counts * (post - 0.5)).sum()
    return (post, chances, share) if lean >= 0 else (1 - post, chances[::-1], 1 - share)


def estimate_by_kind(patterns: np.ndarray, counts: np.ndarray, kinds: np.ndarray, prior: float, belief: float = 20.0, rounds: int = 200):
    """(posterior of each row, {kind: chances[class, labeller, vote]}, {kind: class share}).

    A labeller can be sure of one kind and worthless for another, so each kind has chances of its
    own. Without evidence a vote is taken as right four times of five and abstaining as saying
    nothing; that belief counts as so many votes of each labeller in each class. It also fixes
    which class is which, where votes all but always agree.
    """
    post, chances, shares = np.zeros(len(patterns)), {}, {}
    at = np.arange(patterns.shape[1])[None, :]
    for kind in np.unique(kinds):
        rows = np.flatnonzero(kinds == kind)
        p, n = patterns[rows], counts[rows]
        silent = np.clip((((p == 0) * n[:, None]).sum(axis=0) + 1) / (n.sum() + 2), 0.01, 0.99)
        start = np.stack([np.stack([silent, (1 - silent) * (0.8 - 0.6 * c), (1 - silent) * (0.2 + 0.6 * c)], axis=1) for c in (0, 1)])
        own, share = start.copy(), prior
        q = np.full(len(p), prior)
        for _ in range(rounds):
            before = q
            odds = np.log(share / (1 - share)) + (np.log(own[1][at, p]) - np.log(own[0][at, p])).sum(axis=1)
            q = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            for c, weight in ((1, q * n), (0, (1 - q) * n)):
                for v in range(3):
                    own[c, :, v] = (((p == v) * weight[:, None]).sum(axis=0) + belief * start[c, :, v]) / (weight.sum() + belief)
            share = float(((q * n).sum() + 2 * prior) / (n.sum() + 2.0))
            if np.abs(q - before).max() < 1e-6:
                break
        post[rows], chances[int(kind)], shares[int(kind)] = q, own, share
    return post, chances, shares


def reliability(chances: np.ndarray, share: float) -> list[float | None]:
    """Chance that a labeller's vote is right where it votes at all; None where it never does."""
    right = share * chances[1, :, 2] + (1 - share) * chances[0, :, 1]
    votes = share * (chances[1, :, 1] + chances[1, :, 2]) + (1 - share) * (chances[0, :, 1] + chances[0, :, 2])
    return [float(r / v) if v > 1e-9 else None for r, v in zip(right, votes)]


def code(votes) -> int:
    out = 0
    for v in votes:
        out = out * 3 + int(v)
    return out


def decode(codes: np.ndarray, labellers: int) -> np.ndarray:
    out = np.zeros((len(codes), labellers), dtype=int)
    rest = np.asarray(codes, dtype=np.int64).copy()
    for k in range(labellers - 1, -1, -1):
        out[:, k] = rest % 3
        rest //= 3
    return out
