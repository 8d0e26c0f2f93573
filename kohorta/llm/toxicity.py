"""Toxicity from subword-bag embeddings averaged into a linear softmax, trained jointly.

A word is the bag of its character n-grams, each hashed to an embedding; unseen and misspelt words
share n-grams with seen ones. A window of neighbouring words, or a whole shorter text, is the average of
their vectors, and a linear softmax on it gives the log odds of the labels. A text's log odds are those
of its windows averaged by their softmax: nearly the largest, since over a whole long text a few toxic
words would average away. A text that repeats itself keeps its score, so length alone moves none.

Training runs in numpy on a bounded sample of labelled texts. It alternates between scoring every
window of the sample and moving embeddings and softmax weights along the gradient of each text's
average. Since the softmax is linear, scoring needs one number per n-gram only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import held_out, label_sample

#: At most this many labelled rows are used to fit.
FIT_ROWS = 4_000
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIMS = 8
#: Words of a window; windows of all these lengths count.
WINDOWS = (1, 2)
#: Factor on a window's log odds.
SHARPNESS = 8.0
EPOCHS = 25
RATE = 0.3
SEED = 2
#: Distinct words whose scores a task remembers before it starts anew.
MEMO_WORDS = 300_000
#: Bytes of text that a task cuts into words at a time.
PART_BYTES = 1 << 20

#: ASCII letters in lower case; other ASCII characters part words, all others belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def gram_buckets(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of ``<word>`` for every word, and where each word's n-grams start."""
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    begin = np.cumsum(sizes) - sizes
    room = np.repeat(begin + sizes, sizes) - np.arange(len(raw))  # bytes left in the word
    owner, found = [], []
    h = np.zeros(len(raw), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            # h at i becomes the hash of the n bytes from i on.
            h[: len(raw) - n + 1] = h[: len(raw) - n + 1] * np.uint32(16777619) + raw[n - 1 :] + np.uint32(1)
            if n in GRAMS:
                at = np.flatnonzero(room >= n)
                mixed = h[at] * np.uint32(2654435761)
                found.append((mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS))
                owner.append(at)
    place, bucket = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(place, kind="stable")
    place, bucket = place[order], bucket[order]
    # Every word with its two marks has three bytes at least, so none is without n-grams.
    return bucket.astype(np.int64), np.searchsorted(place, begin)


def _pooled_logit(values: np.ndarray) -> float:
    """The log odds of all windows, averaged by their softmax."""
    c = np.concatenate([[0.0], np.cumsum(values)])
    spans = [min(w, len(values)) for w in WINDOWS]
    odds = SHARPNESS * np.concatenate([(c[n:] - c[:-n]) / n for n in spans])
    weight = np.exp(odds - odds.max())
    return float((odds * weight).sum() / weight.sum())


class ToxicityModel:
    """One score per n-gram bucket and a bias: the fitted embeddings times the softmax weights."""

    def __init__(self, gram_scores: np.ndarray, bias: float, prior: float):
        self.gram_scores, self.bias, self.prior = gram_scores, bias, prior

    def word_scores(self, words: Sequence[bytes]) -> np.ndarray:
        bucket, start = gram_buckets(words)
        counts = np.diff(np.append(start, len(bucket)))
        return np.add.reduceat(self.gram_scores[bucket].astype(np.float64), start) / counts

    def scores(self, texts: Sequence[bytes], memo: dict[bytes, float]) -> list[float]:
        """Probability of label 1; a text without words gets 0."""
        out: list[float] = []
        part: list[bytes] = []
        held = 0
        for t in texts:
            part.append(t)
            held += len(t)
            if held >= PART_BYTES:
                out += self._part_scores(part, memo)
                part, held = [], 0
        return out + self._part_scores(part, memo)

    def _part_scores(self, texts: list[bytes], memo: dict[bytes, float]) -> list[float]:
        split = [words_of(t) for t in texts]
        if len(memo) > MEMO_WORDS:
            memo.clear()
        fresh = list({w for ws in split for w in ws if w not in memo})
        if fresh:
            memo.update(zip(fresh, self.word_scores(fresh).tolist()))
        out = []
        for ws in split:
            if not ws:
                out.append(0.0)
                continue
            logit = _pooled_logit(np.fromiter((memo[w] for w in ws), np.float64, len(ws))) + self.bias
            out.append(float(1 / (1 + np.exp(-np.clip(logit, -30, 30)))))
        return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled texts outside the held-out fold."""
    return fit_sample(label_sample(docs, labels, label, rows, SEED))


def fit_sample(labelled: Sequence[tuple[bytes, int]]) -> ToxicityModel:
    """Fit on labelled texts; without words, or with one label only, all score the share of label 1."""
    sample = [(ws, y) for t, y in labelled if (ws := words_of(t))]
    y = np.array([q for _, q in sample], np.float64)
    prior = float(y.mean()) if len(y) else 0.0
    if not 0 < prior < 1:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log((prior + 1e-6) / (1 - prior + 1e-6))), prior)
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for ws, _ in sample for w in ws))}
    flat = np.fromiter((vocab[w] for ws, _ in sample for w in ws), np.int64)
    sizes = np.array([len(ws) for ws, _ in sample])
    begin = np.cumsum(sizes) - sizes
    bucket, start = gram_buckets(list(vocab))
    counts = np.diff(np.append(start, len(bucket)))
    owner = np.repeat(np.arange(len(vocab)), counts)

    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMS))
    softmax = rng.normal(0, 0.3, (DIMS, 2))
    # Windows of each length begin wherever they end within their text; a shorter text is one window.
    spans = np.minimum(sizes[None, :], np.array(WINDOWS)[:, None])
    places = (sizes[None, :] - spans + 1).ravel()
    text_of = np.repeat(np.tile(np.arange(len(sizes)), len(WINDOWS)), places)
    at = np.arange(places.sum()) + np.repeat(np.tile(begin, len(WINDOWS)) - (np.cumsum(places) - places), places)
    span = np.repeat(spans.ravel(), places)
    order = np.argsort(text_of, kind="stable")
    text_of, at, span = text_of[order], at[order], span[order]
    first = np.searchsorted(text_of, np.arange(len(sizes)))
    # Both labels weigh the same: the rarer one would otherwise drown.
    weight = np.where(y == 1, 0.5 / prior, 0.5 / (1 - prior)) / len(y)
    bias = 0.0
    seen_e, seen_s, seen_b = np.full(BUCKETS, 1e-10), np.full((DIMS, 2), 1e-10), 1e-10

    def pooled() -> tuple[np.ndarray, np.ndarray]:
        """Every text's log odds, and how much they rise with the odds of each window."""
        per_gram = embed @ (softmax[:, 1] - softmax[:, 0])
        words = np.add.reduceat(per_gram[bucket], start) / counts
        c = np.concatenate([[0.0], np.cumsum(words[flat])])
        odds = SHARPNESS * (c[at + span] - c[at]) / span
        e = np.exp(odds - np.maximum.reduceat(odds, first)[text_of])
        share = e / np.add.reduceat(e, first)[text_of]
        mean = np.add.reduceat(odds * share, first)
        return mean, share * (1 + odds - mean[text_of])

    for _ in range(EPOCHS):
        logit, slope = pooled()
        error = (1 / (1 + np.exp(-np.clip(logit + bias, -30, 30))) - y) * weight
        window_error = error[text_of] * slope * SHARPNESS / span
        # A word takes the errors of all windows that hold it.
        steps = np.bincount(at, window_error, len(flat) + 1) - np.bincount(at + span, window_error, len(flat) + 1)
        per_word = np.bincount(flat, weights=np.cumsum(steps[:-1]), minlength=len(vocab)) / counts
        gram_error = np.bincount(bucket, weights=per_word[owner], minlength=BUCKETS)
        pull = embed.T @ gram_error
        grad_s = np.stack([-pull, pull], axis=1)
        grad_e = gram_error[:, None] * (softmax[:, 1] - softmax[:, 0])
        seen_e += (grad_e**2).mean(axis=1)
        seen_s += grad_s**2
        seen_b += error.sum() ** 2
        embed -= RATE * (grad_e / np.sqrt(seen_e)[:, None])
        softmax -= RATE * 0.3 * grad_s / np.sqrt(seen_s)
        bias -= RATE * error.sum() / np.sqrt(seen_b)
    return ToxicityModel((embed @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), _best_shift(pooled()[0], y), prior)


def _best_shift(top: np.ndarray, y: np.ndarray) -> float:
    """The bias with the fewest errors on the sample; of a range of equals, its middle."""
    order = np.argsort(top)
    wrong_low = np.concatenate([[0], np.cumsum(y[order])])  # label 1 below the cut
    wrong_high = (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y[order])])
    errors = wrong_low + wrong_high
    best = np.flatnonzero(errors == errors.min())
    cut = best[len(best) // 2]
    edges = np.concatenate([[top.min() - 1], top[order], [top.max() + 1]])
    return -float((edges[cut] + edges[cut + 1]) / 2)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts, and texts without words, score 0. Repeated rows are scored each; other
    columns are neither read nor returned.
    """
    model = fit_toxicity(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.gram_scores, model.bias, model.prior))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted, memo = ToxicityModel(*shared.value), {}
        for texts in batches:
            yield pd.Series(fitted.scores([(t or "").encode() for t in texts], memo), dtype="float64")

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
