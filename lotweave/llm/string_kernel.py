"""A gapped subsequence kernel on short strings, and a Nyström support vector machine over it.

The kernel of order three compares two words by the letter triples they share in order; a triple may
skip letters, inside five, and each skipped letter halves its weight. So an insult with letters put
in between still shares triples with the plain one. Words are compared with landmark words; the
Nyström map makes that a linear machine, trained by Newton steps on the squared hinge loss. As the
kernel has an explicit (sparse) feature space of 64^3 triples, the trained sum over landmarks folds
into one weight per triple, which gives the same scores without comparing words to landmarks again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SYMBOLS, REACH, DECAY, WIDTH = 64, 5, 0.5, 24
_TRIPLES = [(j, k) for k in range(2, REACH) for j in range(1, k)]
_WEIGHTS = np.array([DECAY ** (k - 2) for _, k in _TRIPLES], np.float32)
#: Look-alikes read as letters.
_LOOKALIKE = str.maketrans("013457@$!", "oieastasi")


def plain(word: str) -> str:
    """Lower-case letters only, with look-alikes read as letters."""
    word = word.lower()
    if not word.isalpha():
        word = "".join(c for c in word.translate(_LOOKALIKE) if c.isalpha())
    return word


def windows(word: str) -> list[str]:
    """The word, or overlapping windows of a long one; every triple of letters is in one of them."""
    if len(word) <= WIDTH:
        return [word]
    step = WIDTH - REACH + 1
    return [word[i:i + WIDTH] for i in range(0, len(word) - REACH + 1, step)]


def _codes(words: list[str]) -> np.ndarray:
    flat = np.zeros((len(words), WIDTH + REACH - 1), np.int32)
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letters = np.where((points >= 97) & (points < 123), points - 96, 27 + points % (SYMBOLS - 27))
    rows = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[rows, at] = letters
    return flat


def triples(words: list[str]) -> np.ndarray:
    """Index of every triple, one row per word and (start, gap form) columns; 0 where there is none."""
    c = _codes(words)
    longest = max((len(w) for w in words), default=0)
    out = np.empty((len(words), longest, len(_TRIPLES)), np.int32)
    first = c[:, :longest]
    for t, (j, k) in enumerate(_TRIPLES):
        b, d = c[:, j:j + longest], c[:, k:k + longest]
        out[:, :, t] = np.where((first > 0) & (b > 0) & (d > 0), (first * SYMBOLS + b) * SYMBOLS + d, 0)
    return out


def norms(index: np.ndarray) -> np.ndarray:
    """Length of each word's feature vector; equal triples add up before squaring."""
    n = len(index)
    weights = np.broadcast_to(np.arange(len(_TRIPLES), dtype=np.int64), index.shape).reshape(n, -1)
    key = np.sort(index.reshape(n, -1).astype(np.int64) * len(_TRIPLES) + weights, axis=1)
    flat, w = key.ravel() // len(_TRIPLES), _WEIGHTS[(key.ravel() % len(_TRIPLES))]
    head = np.ones(len(flat), bool)
    head[1:] = flat[1:] != flat[:-1]
    if key.shape[1]:
        head[::key.shape[1]] = True
    cuts = np.flatnonzero(head)
    sums = np.add.reduceat(w, cuts) if len(cuts) else np.zeros(0, np.float32)
    sums[flat[cuts] == 0] = 0
    return np.sqrt(np.bincount(cuts // max(1, key.shape[1]), weights=sums.astype(float) ** 2, minlength=n))


def _against(index: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.tensordot(table[index].sum(axis=1), _WEIGHTS, axes=([1], [0]))


def _vector(word: str) -> np.ndarray:
    index = triples([word])[0]
    table = np.bincount(index.ravel(), weights=np.tile(_WEIGHTS, len(index)), minlength=SYMBOLS ** 3).astype(np.float32)
    table[0] = 0
    return table


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values."""
    index = triples(words)
    size = np.maximum(norms(index), 1e-9)
    out = np.zeros((len(words), len(landmarks)))
    for j, landmark in enumerate(landmarks):
        table = _vector(landmark)
        out[:, j] = _against(index, table) / size / max(np.linalg.norm(table), 1e-9)
    return out


@dataclass
class Machine:
    """Weight per triple and bias: the trained Nyström machine in folded form."""

    table: np.ndarray
    bias: float

    def margins(self, words: list[str]) -> np.ndarray:
        """Signed distances of words of at most ``WIDTH`` letters."""
        out = np.full(len(words), self.bias)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, rows in by_length.items():
            if length < 3:
                continue
            for first in range(0, len(rows), 20_000):
                some = rows[first:first + 20_000]
                index = triples([words[i] for i in some])
                out[some] += _against(index, self.table) / np.maximum(norms(index), 1e-9)
        return out


def nystroem(words: list[str], landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of ``words``, and the map from kernel values to features."""
    own = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    return kernel(words, landmarks) @ root, root


def train(features: np.ndarray, label: np.ndarray, cost: float = 10.0, steps: int = 30) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps; the last weight is the bias."""
    x = np.hstack([features, np.ones((len(features), 1))])
    y = np.where(label > 0, 1.0, -1.0)
    weight = np.where(y > 0, cost / max(1, (y > 0).sum()), cost / max(1, (y < 0).sum())) * 100
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa = x[active] * weight[active, None]
        new = np.linalg.solve(ridge + xa.T @ x[active], xa.T @ y[active])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def fold(landmarks: list[str], root: np.ndarray, w: np.ndarray) -> Machine:
    """The sum over landmarks as one weight per triple."""
    table = np.zeros(SYMBOLS ** 3, np.float32)
    for share, landmark in zip(root @ w[:-1], landmarks, strict=True):
        one = _vector(landmark)
        table += np.float32(share / max(np.linalg.norm(one), 1e-9)) * one
    table[0] = 0
    return Machine(table, float(w[-1]))
