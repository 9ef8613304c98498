"""Hashed word and character n-grams of many texts at once, and small linear models on them, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
PRIME = 1_099_511_628_211  # odd, so it has an inverse modulo 2^64
INVERSE = pow(PRIME, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((PRIME, INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Texts:
    """Texts of one batch in one byte array, with the 64-bit hashes of their words (runs without white space)."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
        gap = np.concatenate([[True], SPACE[self.bytes], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.word_starts, self.word_ends = edge[::2], edge[1::2]
        self.first_word = np.searchsorted(self.word_starts, self.starts)
        self.last_word = np.searchsorted(self.word_starts, self.ends)

    def words(self, *prefixes: int) -> np.ndarray | list[np.ndarray]:
        """Hashes of the words; given lengths, those of the words' prefixes of so many bytes too (a list)."""
        up, down = powers(len(self.bytes) + 1)
        total = np.concatenate([np.zeros(1, U), np.cumsum((self.bytes.astype(U) + U(1)) * up[:-1], dtype=U)])
        upto = [self.word_ends, *[np.minimum(self.word_ends, self.word_starts + k) for k in prefixes]]
        out = [mixed((total[e] - total[self.word_starts]) * down[self.word_starts]) for e in upto]
        return out if prefixes else out[0]

    def per_text(self, flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[np.maximum(ends, starts)] - total[starts]

    def text_of(self, n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The text of each of n positions; -1 between texts."""
        out = np.full(n, -1)
        size = np.maximum(ends - starts, 0)
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        out[at] = np.repeat(np.arange(self.n), size)
        return out


def char_grams(t: Texts, size: int, bits: int) -> np.ndarray:
    """Bucket of the ``size`` bytes from each byte on."""
    x, n = t.bytes.astype(np.uint32), max(0, len(t.bytes) - size + 1)
    h = np.zeros(n, np.uint32)
    for k in range(size):
        h = h * np.uint32(16_777_619) + x[k:k + n] + np.uint32(1)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(2_654_435_769)) >> np.uint32(32 - bits)).astype(np.int64)


def word_grams(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of single words, and of each word with the next."""
    pair = mixed(h[:-1] * U(PRIME) + h[1:]) if len(h) > 1 else np.zeros(0, U)
    return tuple((x >> U(64 - bits)).astype(np.int64) for x in (h, pair))


def sampled(labels: DataFrame, docs: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, y, text) of at most ``max_rows`` labelled documents, the same ones each time.

    The ids are chosen from the labels alone by the order of a hash; this bounded list is what is broadcast.
    """
    ids = (labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(label).alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """A sparse matrix by rows: row starts, columns and values."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.n, self.width = len(parts), width
        size = np.array([len(c) for c, _ in parts], np.int64)
        self.row = np.repeat(np.arange(self.n), size)
        self.col = np.concatenate([c for c, _ in parts]) if parts else np.zeros(0, np.int64)
        self.val = np.concatenate([v for _, v in parts]) if parts else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.width)

    def common(self, least: int, most: float = 1.0) -> tuple[Rows, np.ndarray]:
        """The same rows with only the columns that ``least`` rows and no more than the share ``most`` have, and these columns."""
        df = np.bincount(self.col, minlength=self.width)
        use = (df >= least) & (df <= most * self.n)
        out, there = object.__new__(Rows), use[self.col]
        out.n, out.width = self.n, int(use.sum())
        out.row, out.col, out.val = self.row[there], (np.cumsum(use) - 1)[self.col[there]], self.val[there]
        return out, np.flatnonzero(use)

    def only(self, keep: np.ndarray) -> Rows:
        """The rows where ``keep`` holds."""
        out, there = object.__new__(Rows), keep[self.row]
        out.n, out.width = int(keep.sum()), self.width
        out.row, out.col, out.val = (np.cumsum(keep) - 1)[self.row[there]], self.col[there], self.val[there]
        return out


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b so that sigmoid(a z + b) fits y, by Newton's method with smoothed targets and a non-negative slope."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        w, g = np.maximum(p * (1 - p), 1e-9), p - t
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * z).sum(), g.sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-6), float(b)
