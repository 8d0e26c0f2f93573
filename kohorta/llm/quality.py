"""Quality by compression: how much shorter does a text get with the dictionary of good texts.

One zstandard dictionary is built from good and one from bad labelled texts. A text is compressed
with both; the difference of the sizes per byte, calibrated on labelled texts that the dictionaries
have not seen, is its score. The same difference says little in a short text and much in a long one,
so the calibration also sees the length, and how well the text compresses at all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import held_out, label_sample

#: At most this many labelled rows are used to fit; part of them calibrates.
FIT_ROWS = 6_000
DICT_BYTES = 112_640
LEVEL = 3
SEED = 6


class CompressionClassifier:
    """Two dictionaries and the weights of the calibration; plain data, so tasks can load it."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray, prior: float):
        self.good, self.bad, self.weights, self.prior = good, bad, weights, prior

    def _compressors(self):
        out = []
        for raw in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=LEVEL)
            out.append(
                zstandard.ZstdCompressor(
                    dict_data=known, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False
                ).compress
            )
        return out

    def features(self, texts: Sequence[bytes]) -> np.ndarray:
        """Per text: difference of sizes per byte, the same weighted by length, sizes per byte, log length."""
        with_good, with_bad = self._compressors()
        sizes = np.array([(len(with_good(t)), len(with_bad(t)), len(t)) for t in texts], np.float64).reshape(-1, 3)
        good, bad, raw = sizes.T
        raw = np.maximum(raw, 1)
        diff = (bad - good) / raw
        log = np.log(raw)
        return np.column_stack([np.ones_like(raw), diff, diff * log, np.abs(diff), good / raw, bad / raw, np.minimum(good, bad) / raw * log, log])

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        """Probability of good quality; an empty text gets the share of good labels."""
        if not texts:
            return np.empty(0)
        out = _sigmoid(self.features(texts) @ self.weights)
        out[[not t for t in texts]] = self.prior
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method on scaled columns."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(z @ w)
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; texts too few to train one serve as they are."""
    pieces = [t[i : i + 2048] for t in texts for i in range(0, len(t), 2048)]
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:] or b"\n"


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> CompressionClassifier:
    """Fit on at most ``rows`` labelled texts outside the held-out fold.

    Texts are dealt in turn to the dictionaries (two of three) and to the calibration (one of three).
    Without labelled texts, or with one label only, the score is the share of good labels, or one half.
    """
    sample = label_sample(docs, labels, label, rows, SEED)
    y = np.array([q for _, q in sample], np.float64)
    prior = float(y.mean()) if len(y) else 0.5
    seen = [x for i, x in enumerate(sample) if i % 3]
    rest = [x for i, x in enumerate(sample) if not i % 3]
    good, bad = ([t for t, q in seen if q == want and t] for want in (1, 0))
    flat = np.zeros(8)
    flat[0] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    model = CompressionClassifier(b"\n" * 8, b"\n" * 8, flat, prior)
    if good and bad and len({q for _, q in rest}) == 2:
        # The rarer kind bounds both samples, so neither dictionary has more to learn from.
        enough = max(sum(map(len, bad)), 1 << 20)
        kept, total = [], 0
        for t in good:
            if total < enough:
                kept.append(t)
                total += len(t)
        model.good, model.bad = _dictionary(kept, DICT_BYTES), _dictionary(bad, DICT_BYTES)
        model.weights = _logistic(model.features([t for t, _ in rest]), np.array([q for _, q in rest], np.float64))
    return model


def quality_score(model: CompressionClassifier, text: str | Column = "text") -> Column:
    """The score of a text column; null counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = (texts.iloc[at : at + 256] for at in range(0, len(texts), 256))
        found = [model.scores([(t or "").encode() for t in part]) for part in parts]
        return pd.Series(np.concatenate(found) if found else np.empty(0), dtype="float64")

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; other columns are neither read nor returned."""
    model = fit_quality(docs, labels)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns."""
    model = fit_quality(docs, labels)
    return docs.where(quality_score(model, F.col("text")) >= threshold)
