"""Quality rules: a calibrated logistic regression on hashed word and character n-grams, beside fixed rules.

Trained on at most ``MAX_ROWS`` labelled documents (a documented bound; the choice is by a hash of the
id); every document is scored whole, in Arrow batches, against the fixed thresholds below.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, flat, utf8, slices
from .features import SPACE, Rows, Texts, U, char_grams, mixed, platt, sampled, sigmoid, word_grams

#: Labelled rows that train the model; buckets as bits; bytes of a character n-gram; folds for calibration;
#: buckets in fewer documents than LEAST are left out.
MAX_ROWS, BITS, GRAM, FOLDS, ROUNDS, SCALE, LEAST = 2_000, 17, 4, 3, 40, 40.0, 3
#: Rules: fewer words, or a larger share of repeated words, fail. A document is kept from this probability of quality on.
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_FROM = 50, 50, 0.3

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def grams(t: Texts, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of features: buckets (offset by block), and the range of each text in them."""
    one, two = word_grams(h, BITS)
    chars = char_grams(t, GRAM, BITS)
    found = [(one, t.first_word, t.last_word), (two + (1 << BITS), t.first_word, t.last_word - 1),
             (chars + (2 << BITS), t.starts, t.ends - GRAM + 1)]
    return [(idx, np.minimum(a, len(idx)), np.minimum(b, len(idx))) for idx, a, b in found]


WIDTH = 3 << BITS


def rows_of(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and values of each text: the share of the block, times SCALE."""
    t = Texts(texts)
    blocks = grams(t, t.words())
    out = []
    for k in range(t.n):
        cols, vals = [], []
        for idx, a, b in blocks:
            if b[k] > a[k]:
                c, n = np.unique(idx[a[k]:b[k]], return_counts=True)
                cols.append(c)
                vals.append(n * (SCALE / (b[k] - a[k])))
        out.append((np.concatenate(cols), np.concatenate(vals)) if cols else (np.zeros(0, np.int64), np.zeros(0)))
    return out


def logits(t: Texts, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The same model applied to whole texts: the mean weight of each block's n-grams."""
    z = np.full(t.n, float(w[-1]))
    for idx, a, b in grams(t, h):
        n = np.maximum(b - a, 0)
        total = np.concatenate([[0.0], np.cumsum(w[idx])])
        z += np.where(n > 0, (total[np.maximum(a, b)] - total[a]) * SCALE / np.maximum(n, 1), 0)
    return z


def fit(x: Rows, y: np.ndarray, rounds: int = ROUNDS, l2: float = 1e-5, rate: float = 0.08) -> np.ndarray:
    """Weights, the last one the intercept: full-batch Adam on the log loss with equal weight for both classes."""
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(x.width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        r = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) * share
        g = np.append(x.back(r) + l2 * w[:-1], r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-10)
    return w.astype(np.float32).astype(float)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float, float] | None:
    """(weights, slope, shift); None if the labels don't have both classes, which keeps every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 64, batch.column(2)):
                made = rows_of([b or b"" for b in utf8(part.column(2))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1).cast(pa.int32()), pa.array([c.astype("<i4").tobytes() for c, _ in made], pa.binary()),
                     pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())], ["doc_id", "y", "cols", "vals"])

    found = sampled(labels, docs, "quality", max_rows).select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, cols binary, vals binary")
    got = sorted(found.toLocalIterator(), key=lambda r: (r.doc_id, bytes(r.cols), bytes(r.vals)))
    y = np.array([float(r.y > 0) for r in got])
    if len(got) < 2 * FOLDS or not 0 < y.sum() < len(y):
        return None
    x = Rows([(np.frombuffer(r.cols, "<i4").astype(np.int64), np.frombuffer(r.vals, "<f4").astype(float)) for r in got], WIDTH)
    x, used = x.common(LEAST)
    fold = mixed(np.array([r.doc_id for r in got], np.int64).astype(U)) % U(FOLDS)
    held = np.zeros(len(y))
    for k in range(FOLDS):
        inside = fold != k
        if inside.all() or not 0 < y[inside].sum() < inside.sum():
            continue
        w = fit(x.only(inside), y[inside])
        held[~inside] = x.only(~inside).dot(w[:-1]) + w[-1]
    small, w = fit(x, y), np.zeros(WIDTH + 1)
    w[used], w[-1] = small[:-1], small[-1]
    return w, *platt(held, y)


def base(t: Texts, h: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n_words = t.last_word - t.first_word
    chars = t.per_text(~SPACE[t.bytes] & ((t.bytes & 0xC0) != 0x80), t.starts, t.ends)
    symbols = t.per_text(SYMBOL[t.bytes], t.starts, t.ends)
    dup = np.zeros(t.n, np.int64)
    for k, text in enumerate(texts):
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x.strip()]
            dup[k] = len(lines) - len(set(lines))
    repeat = np.zeros(len(h), bool)
    own = t.text_of(len(h), t.first_word, t.last_word)
    if len(h) > 2:
        with_doc = own[:-2].astype(U)
        three = mixed(mixed(h[:-2] + with_doc * U(0x9E3779B97F4A7C15)) * U(3) + mixed(h[1:-1]) * U(5) + h[2:] * U(7))
        inside = np.flatnonzero(own[:-2] == own[2:])
        order = np.argsort(three[inside], kind="stable")
        s = three[inside][order]
        same = s[1:] == s[:-1]
        at = inside[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(s) else inside
        for k in range(3):
            repeat[at + k] = True
    return [n_words, chars, symbols, dup, t.per_text(repeat, t.first_word, t.last_word)]


def score(docs: DataFrame, model, keep: list[str], text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """``row``, the base counts, ``quality`` (calibrated probability, null without a model), ``base_failed`` and ``kept``.

    A null text has no words and fails the rules, as an empty one does; repeated rows each get their result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 x 2^17 weights, whatever the corpus holds

    def make():
        m = shared.value

        def fn(texts):
            texts = [b or b"" for b in texts]
            t = Texts(texts)
            h = t.words()
            counts = base(t, h, texts)
            p = sigmoid(m[1] * logits(t, h, m[0]) + m[2]) if m is not None else np.ones(t.n)
            failed = (counts[0] < MIN_WORDS) | (100 * counts[4] > MAX_REPEAT_PERCENT * counts[0])
            return [*counts, p, failed, ~failed & (p >= keep_from)]

        return fn

    return annotate(docs, keep, text, make, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                    "quality double, base_failed boolean, kept boolean", rows=128)


def op4_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, train(docs, labels), ["doc_id"])
    return flat(found, ["doc_id"], ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                    F.round("quality", 6).alias("quality")])
