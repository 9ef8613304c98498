"""Toxicity by classifier chains: categories in order, earlier probabilities feed the later linear models.

Categories: ``insult`` and ``contempt`` (a document labelled toxic that uses one of the category's seed
words), then ``toxic`` (the label itself). Each link is a sparse (L1) logistic model on how often
(log of 1 + number) hashed lower-case words and word beginnings (for inflected and compound forms) occur, and on the earlier links' probabilities; while training, these probabilities
are out-of-fold, so that a later link sees them as wrong as they'll be on new documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, flat, slices, utf8
from .decontaminate import FOLD
from .features import Rows, Texts, U, mixed, sampled, sigmoid

#: Labelled rows that train the chain; buckets as bits; folds; buckets in fewer documents than LEAST are left out;
#: bytes of a word's beginnings.
MAX_ROWS, BITS, FOLDS, LEAST, ROUNDS, L1, BEGINNINGS = 2_000, 18, 2, 6, 70, 0.012, (4, 6, 7, 8)
TOXIC_FROM = 0.5

#: Seed words of the categories.
SEEDS = {
    "insult": ("idiot", "moron", "loser", "clown", "stupid", "fool", "dumb"),
    "contempt": ("pathetic", "worthless", "disgusting", "trash", "scum", "garbage"),
}
CATEGORIES = (*SEEDS, "toxic")
WIDTH = 1 << BITS


def buckets(texts: list[bytes]) -> tuple[Texts, np.ndarray]:
    """Buckets of each word (columns: the word, then its beginnings, each kind by a hash of its own)."""
    t = Texts([x.translate(FOLD) for x in texts])
    hashes = t.words(*BEGINNINGS)
    return t, np.column_stack([(mixed(h + U(k)) >> U(64 - BITS)).astype(np.int64) for k, h in enumerate(hashes)])


def bucket_of(word: str) -> int:
    return int(buckets([word.encode()])[1][0, 0])


def soft(w: np.ndarray, by: float) -> np.ndarray:
    return np.sign(w) * np.maximum(np.abs(w) - by, 0)


def fit(x: Rows, extra: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, l1: float = L1) -> np.ndarray:
    """Weights of the buckets, of the earlier probabilities and of the intercept, by accelerated proximal gradient.

    Only the buckets' weights are drawn to zero. Classes count equally.
    """
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    dense = np.column_stack([extra, np.ones(len(y))])
    v = np.ones(x.width + dense.shape[1])
    for _ in range(8):  # the largest curvature, by power iteration
        r = (x.dot(v[:x.width]) + dense @ v[x.width:]) * share
        v = np.concatenate([x.back(r), dense.T @ r])
        size = np.linalg.norm(v)
        v /= size
    step = 3.6 / size
    w = z = np.zeros(x.width + dense.shape[1])
    t = 1.0
    for _ in range(rounds):
        r = (sigmoid(x.dot(z[:x.width]) + dense @ z[x.width:]) - y) * share
        new = z - step * np.concatenate([x.back(r), dense.T @ r])
        new[:x.width] = soft(new[:x.width], step * l1)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return w


def predict(x: Rows, extra: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x.dot(w[:x.width]) + extra @ w[x.width:-1] + w[-1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[np.ndarray] | None:
    """Weights of each link; None if the labels don't have both classes, by which no document is toxic."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64, batch.column(2)):
                t, idx = buckets([b or b"" for b in utf8(part.column(2))])
                made = [np.unique(idx[a:b], return_counts=True) for a, b in zip(t.first_word, t.last_word, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1).cast(pa.int32()), *[pa.array([m[k].astype("<i4").tobytes() for m in made], pa.binary()) for k in (0, 1)]],
                    ["doc_id", "y", "cols", "counts"])

    found = sampled(labels, docs, "toxic", max_rows).select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, cols binary, counts binary")
    got = sorted(found.toLocalIterator(), key=lambda r: (r.doc_id, bytes(r.cols)))
    y = np.array([float(r.y > 0) for r in got])
    if len(got) < 2 * FOLDS or not 0 < y.sum() < len(y):
        return None
    cols = [np.frombuffer(r.cols, "<i4").astype(np.int64) for r in got]
    x, used = Rows([(c, np.log1p(np.frombuffer(r.counts, "<i4"))) for c, r in zip(cols, got, strict=True)], WIDTH).common(min(LEAST, int(y.sum())), 0.5)
    scale = np.sqrt(np.bincount(x.col, x.val**2, x.width) / x.n)  # each bucket gets the same mean square
    x.val = x.val / scale[x.col]
    fold = mixed(np.array([r.doc_id for r in got], np.int64).astype(U)) % U(FOLDS)
    targets = [y * np.array([bool(np.isin(c, [bucket_of(s) for s in SEEDS[name]]).any()) for c in cols]) if name in SEEDS else y for name in CATEGORIES]
    links, extra = [], np.zeros((len(y), 0))
    for target in targets:
        held = np.full(len(y), target.mean())
        for k in range(FOLDS):
            inside = fold != k
            if 0 < target[inside].sum() < inside.sum() and not inside.all():
                w = fit(x.only(inside), extra[inside], target[inside])
                held[~inside] = predict(x.only(~inside), extra[~inside], w)
        full = np.append(np.zeros(WIDTH + extra.shape[1]), -35.0)
        if 0 < target.sum() < len(target):
            w = fit(x, extra, target)
            full[used], full[WIDTH:] = w[:x.width] / scale, w[x.width:]
        links.append(full)
        extra = np.column_stack([extra, held])
    return links


def sparse(links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Buckets that any link weighs (by bucket: the number, or -1), their weights, and each link's dense rest."""
    used = np.flatnonzero(np.any([w[:WIDTH] != 0 for w in links], axis=0))
    number = np.full(WIDTH, -1, np.int32)
    number[used] = np.arange(len(used))
    return number, np.array([w[used] for w in links]).reshape(len(links), len(used)), [w[WIDTH:] for w in links]


def score(docs: DataFrame, links, keep: list[str], text: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """``row``, the probability of each category, and ``is_toxic``. A null or empty text has no words, so only the intercepts count."""
    shared = docs.sparkSession.sparkContext.broadcast(sparse(links) if links is not None else None)

    def make():
        m = shared.value

        def fn(texts):
            if m is None:
                return [*[np.zeros(len(texts))] * len(CATEGORIES), np.zeros(len(texts), bool)]
            number, weights, rest = m
            t, idx = buckets([b or b"" for b in texts])
            own = number[idx]
            at = np.nonzero(own >= 0)
            doc = np.searchsorted(t.last_word, at[0], side="right")
            pair, many = np.unique(doc * np.int64(max(1, weights.shape[1])) + own[at], return_counts=True)
            doc, own = pair // max(1, weights.shape[1]), pair % max(1, weights.shape[1])
            made: list[np.ndarray] = []
            for w, r in zip(weights, rest, strict=True):
                z = np.bincount(doc, w[own] * np.log1p(many), t.n) + r[-1]
                for p, c in zip(made, r[:-1], strict=True):
                    z = z + c * p
                made.append(sigmoid(z))
            return [*made, made[-1] >= toxic_from]

        return fn

    return annotate(docs, keep, text, make, ", ".join(f"p_{c} double" for c in CATEGORIES) + ", is_toxic boolean")


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, train(docs, labels), ["doc_id"])
    return flat(found, ["doc_id"], [*[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES], F.col("is_toxic").alias("toxic")])
