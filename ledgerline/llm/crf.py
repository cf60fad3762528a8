"""A linear-chain conditional random field with two tags, vectorised over many sequences at once.

Tag 0 is ordinary, tag 1 offending.  A token's features add up to the weight of tag 1; transitions have three free weights.  With
two tags the forward and backward messages are single ratios, so one array step serves all sequences that are long enough.
"""
from __future__ import annotations

import numpy as np

_LIMIT = 30.0


class Layout:
    """Sequences of the given lengths, laid out step by step: at step t come the t-th tokens of all sequences longer than t."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        starts = np.cumsum(lengths) - lengths
        longest = int(lengths.max()) if len(lengths) else 0
        self.active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
        self.at = np.r_[0, np.cumsum(self.active)]
        total = int(lengths.sum())
        step = np.arange(total) - np.repeat(starts, lengths)
        place = np.empty(len(lengths), np.int64)
        place[order] = np.arange(len(lengths))
        self.slot = self.at[step] + np.repeat(place, lengths) if total else np.zeros(0, np.int64)


def messages(emit: np.ndarray, layout: Layout, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward ratios, backward ratios and exp(emission), step by step; ``move`` holds exp of (0 to 1, 1 to 0, 1 to 1, start)."""
    e = np.empty(len(emit))
    e[layout.slot] = np.exp(np.clip(emit, -_LIMIT, _LIMIT))
    up, down, stay, begin = move
    r, s = np.empty(len(e)), np.ones(len(e))
    at, active = layout.at, layout.active
    for t in range(len(active)):
        a, n = at[t], active[t]
        if t:
            before = r[at[t - 1] : at[t - 1] + n]
            r[a : a + n] = np.minimum(e[a : a + n] * (up + before * stay) / (1 + before * down), 1e100)
        else:
            r[a : a + n] = e[a : a + n] * begin
    for t in range(len(active) - 2, -1, -1):
        n, b = active[t + 1], at[t + 1]
        after = e[b : b + n] * s[b : b + n]
        s[at[t] : at[t] + n] = (down + stay * after) / (1 + up * after)
    return r, s, e


def marginals(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability of tag 1 for each token, in the order of ``emit``."""
    if not len(emit):
        return np.zeros(0)
    layout = Layout(lengths)
    r, s, _ = messages(emit, layout, np.exp(move))
    odds = r * s
    return (odds / (1 + odds))[layout.slot]


def train(features: np.ndarray, words: np.ndarray, tags: np.ndarray, lengths: np.ndarray, size: int, rounds: int = 60, rate: float = 0.3, ridge: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (``size``) and transitions by full-batch Adam on the conditional likelihood.

    ``features`` has a row of indices below ``size`` for each distinct word, ``words`` the word of each token; the sequences lie one
    after the other.
    """
    layout, n = Layout(lengths), max(len(tags), 1)
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(tags), bool)
    inner[starts] = False
    later = np.flatnonzero(inner)
    before, now = tags[later - 1].astype(bool), tags[later].astype(bool)
    seen = np.array([(~before & now).sum(), (before & ~now).sum(), (before & now).sum(), tags[starts].sum()], float)
    w, move = np.zeros(size), np.array([-3.0, 0.0, -2.0, -3.0])
    first = [np.zeros(size), np.zeros(4)]
    second = [np.zeros(size), np.zeros(4)]
    for k in range(1, rounds + 1):
        r, s, e = messages(w[features].sum(axis=1)[words], layout, np.exp(move))
        up, down, stay, _ = np.exp(move)
        left, right = r[layout.slot[later - 1]], (e * s)[layout.slot[later]]
        whole = 1 + up * right + left * (down + stay * right)
        joint = np.array([(up * right / whole).sum(), (left * down / whole).sum(), (left * right / whole).sum() * stay])
        del left, right, whole
        odds = (r * s)[layout.slot]
        p = odds / (1 + odds)
        by_word = np.bincount(words, p - tags, len(features))
        grads = [(np.bincount(features.ravel(), np.repeat(by_word, features.shape[1]), size) + ridge * w) / n,
                 (np.r_[joint, p[starts].sum()] - seen + ridge * move) / n]
        for x, g, m, v in zip((w, move), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        np.clip(move, -12, 6, out=move)
    return w, move
