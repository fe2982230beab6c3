"""Quality by regularised quadratic discriminant analysis of document statistics.

Every document becomes ``len(NAMES)`` transformed statistics (logs of counts, shares
and repetition ratios). For each class the mean and a covariance shrunk towards the
pooled one and a multiple of the identity are computed from sums over all labelled
training rows, added up in the cluster; the Cholesky factors are computed once. The
score is the logistic of the difference of Mahalanobis log-densities plus log priors.

Defined cases: null text counts as empty, and an empty text gets the score of its
statistics like any other; null labels and null ids aren't used in training; a label
given twice counts each time; without labels of both classes every score is 0.5;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, small_batches, store

NAMES = (
    "log_words", "word_length", "upper_share", "digit_share", "stops_per_word", "commas_per_word", "symbol_share", "bars_per_word",
    "bangs_per_word", "distinct_words", "distinct_pairs", "distinct_lines", "words_per_line", "short_words", "long_words", "odd_words", "upper_words", "twin_words", "log_lines",
)
#: Words of usual text that every document's rates are mixed with, so that short texts aren't extreme.
PRIOR = 25.0
SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text (UTF-8)."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, n_bytes, n_lines = len(words), len(text), len(lines)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, high = count[65:91].sum(), count[97:123].sum(), count[128:].sum()
    lengths = np.fromiter(map(len, words), np.int64, n)
    letters, stops = int(upper + lower + high), int(count[46] + count[44])
    ends = [x[-1] for x in words]
    odd = sum(c < 48 and c != 46 and c != 44 or c == 124 for c in ends)

    def rate(part: float, whole: float, usual: float, weight: float = PRIOR) -> float:
        return float(np.log((part + usual * weight) / (whole + weight)))

    return [
        float(np.log(n + 1.0)),
        rate(n_bytes - n, n, 6.0),
        rate(upper, letters, 0.03, 6 * PRIOR),
        rate(count[48:58].sum(), n_bytes, 0.002, 6 * PRIOR),
        rate(count[46], n, 0.1),
        rate(stops - count[46], n, 0.05),
        rate(count[SYMBOLS].sum(), n_bytes, 0.002, 6 * PRIOR),
        rate(count[124], n, 0.01),
        rate(count[33] + count[63], n, 0.01),
        rate(len(set(words)), n, 0.7),
        rate(len(set(zip(words, words[1:], strict=False))), n, 0.95),
        rate(len(set(lines)), n_lines, 1.0, 2.0),
        rate(n, n_lines, 40.0, 2.0),
        rate((lengths <= 3).sum(), n, 0.35),
        rate((lengths >= 12).sum(), n, 0.05),
        rate(odd, n, 0.01),
        rate(sum(map(bytes.isupper, words)), n, 0.01),
        rate(sum(map(eq, words, words[1:])), n, 0.01),
        float(np.log(n_lines + 1.0)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array x of statistics, a row per document."""
    small_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [statistics(text) for text in as_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(measure, f"doc_id {id_type}, x array<double>")


def class_moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of x for each y; summed in the cluster, d*d numbers reach the driver."""
    d = len(NAMES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {y: np.zeros((d + 1, d + 1)) for y in (0, 1)}
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.asarray(batch.column(0).to_pylist(), float).reshape(-1, d)
            x = np.hstack([np.ones((len(x), 1)), x])
            for k in (0, 1):
                sums[k] += x[y == k].T @ x[y == k]
        for k, s in sums.items():
            yield pa.record_batch([pa.array([k] * s.size, pa.int32()), pa.array(range(s.size), pa.int32()), pa.array(s.ravel())], ["y", "cell", "value"])

    got = rows.select("x", "y").mapInArrow(partial, "y int, cell int, value double").groupBy("y", "cell").agg(F.sum("value").alias("value")).collect()
    out = {}
    for k in (0, 1):
        m = np.zeros((d + 1) ** 2)
        for r in got:
            if r["y"] == k:
                m[r["cell"]] = r["value"]
        m = m.reshape(d + 1, d + 1)
        out[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


@dataclass(frozen=True)
class Discriminant:
    """Standardisation, class means, inverse Cholesky factors and log constants; None: no model."""

    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple[np.ndarray, ...] = ()
    whiten: tuple[np.ndarray, ...] = ()
    constants: tuple[float, ...] = ()
    temper: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        if self.center is None:
            return np.full(len(x), 0.5)
        z = np.clip((x - self.center) / self.scale, -30, 30)
        logs = [c - 0.5 * (((z - m) @ w.T) ** 2).sum(1) for m, w, c in zip(self.means, self.whiten, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.temper * (logs[1] - logs[0]), -500, 500)))


def fit_discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled_share: float = 0.02, ridge: float = 0.02, temper: float = 1.0) -> Discriminant:
    """QDA whose class covariances are shrunk to the pooled one by ``pooled_share`` and to the identity by ``ridge``."""
    n = sum(m[0] for m in moments.values())
    if min(m[0] for m in moments.values()) < 2:
        return Discriminant()
    center = sum(m[1] for m in moments.values()) / n
    total = sum(m[2] for m in moments.values()) / n - np.outer(center, center)
    scale = np.sqrt(np.maximum(np.diag(total), 1e-8))
    pooled, covs, means = 0.0, [], []
    for k in (0, 1):
        c, s, q = moments[k]
        mean = s / c
        cov = (q / c - np.outer(mean, mean)) / np.outer(scale, scale)
        covs.append(cov)
        means.append((mean - center) / scale)
        pooled = pooled + cov * c / n
    whiten, constants = [], []
    for k in (0, 1):
        c = moments[k][0]
        share = min(1.0, pooled_share + len(center) / c)  # few rows lean more on the pooled covariance
        cov = (1 - share) * covs[k] + share * pooled
        cov = (1 - ridge) * cov + ridge * np.eye(len(center))
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        constants.append(float(np.log(c / n) - np.log(np.diag(factor)).sum()))
    return Discriminant(center, scale, tuple(means), tuple(whiten), tuple(constants), temper)


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fits the discriminant to all rows of ``stats`` that have a label."""
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    return fit_discriminant(class_moments(stats.join(y, "doc_id")))


def score_statistics(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of every row of ``document_statistics``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.record_batch([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    id_type = dict(stats.dtypes)["doc_id"]
    return stats.select("doc_id", "x").mapInArrow(score, f"doc_id {id_type}, score double")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Trains on ``labels`` and scores every document; texts are read once."""
    stats = store(document_statistics(docs, id_col, text_col), "statistics")
    return score_statistics(stats, train(stats, labels, id_col, label_col))


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The documents with a score of at least ``threshold``, with all their columns.

    Statistics, not texts, are joined to the labels; measuring texts twice costs less
    than moving them.
    """
    small_batches(docs.sparkSession)
    model = train(store(document_statistics(docs, id_col, text_col), "statistics"), labels, id_col, label_col)
    position = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.asarray([statistics(t) for t in as_bytes(batch.column(position))], float).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.score(x) >= threshold, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
