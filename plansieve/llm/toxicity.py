"""Toxicity by multiple-instance learning: sentence scores under a noisy-or.

A document is a bag of sentences and toxic if at least one sentence is. Each
sentence has probability sigmoid(b + sum of its features' weights); a document's
probability is 1 - prod(1 - p). Only document labels are used in training; the
sentence scores locate the offending sentences afterwards. Features are a word and
its prefixes of 3 to 6 letters, so inflected forms share evidence.

A sentence's features are a set, in training as in scoring. Training uses at most
``max_train`` labelled documents (those with the smallest hash of the id; copies of a text
count once). Features enter whose document frequency differs between the classes by
``min_z`` standard errors, or by half of the largest difference there is if that is less,
and which ``min_docs`` toxic documents hold (all, if there are fewer); a ridge shrinks
their weights.

Defined cases: null and empty texts have no sentence and score 0; null ids are held
in training never; a label given twice counts by its maximum; without labels of both
classes, or without a feature that is more frequent in toxic documents, every score is 0; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_texts, cut, slices, small_batches

SENTENCE = re.compile(r"[.!?\n]+")
PREFIXES = (3, 4, 5, 6)
EDGE = re.compile(r"^\W+|\W+$")


def features_of(token: str) -> tuple[str, ...]:
    """The features of a token as it stands in a text."""
    word = EDGE.sub("", token).lower()
    return (word, *[f"{word[:n]}~" for n in PREFIXES if len(word) > n]) if word else ()


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


@dataclass(frozen=True)
class NoisyOr:
    """A trained model; small whatever the corpus."""

    bias: float = -math.inf
    weights: dict[str, float] = field(default_factory=dict)

    def tokens(self, most: int = 200_000) -> dict[str, tuple[str, ...]]:
        """Token to those of its features that have a weight, filled as tokens are met and emptied at ``most`` entries."""
        weights = self.weights

        class Seen(dict):
            def __missing__(self, token: str) -> tuple[str, ...]:
                if len(self) >= most:
                    self.clear()
                value = self[token] = tuple(f for f in features_of(token) if f in weights)
                return value

        return Seen()

    def sentences(self, text: str, tokens: dict[str, tuple[str, ...]]) -> list[float]:
        """The logit of each sentence, in order."""
        get, bias, weight, out = tokens.__getitem__, self.bias, self.weights.__getitem__, []
        for s in SENTENCE.split(text):
            if s.strip():
                held = list(filter(None, map(get, s.split())))
                out.append(bias + math.fsum(map(weight, set(chain.from_iterable(held)))) if held else bias)
        return out

    @staticmethod
    def combine(logits: list[float]) -> float:
        """Noisy-or of sentence logits."""
        if not logits:
            return 0.0
        z = np.minimum(np.asarray(logits), 40)
        return float(-np.expm1(-np.logaddexp(0, z).sum()))


class Objective:
    """The mean log-likelihood of bags, less a ridge, with its gradient.

    bags: label, sentences without any feature, and the features of the others. Parameters
    are the weights, then the bias.
    """

    def __init__(self, bags: list[tuple[int, int, list[list[int]]]], n_features: int, ridge: float):
        self.n, self.ridge = n_features, ridge
        self.y, self.plain = np.array([b[0] for b in bags], float), np.array([b[1] for b in bags], float)
        self.bag_of = np.array([i for i, b in enumerate(bags) for _ in b[2]], np.int64)
        lists = [f for b in bags for f in b[2]]
        self.row = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
        self.col = np.fromiter((x for f in lists for x in f), np.int64)

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        n = len(self.y)
        z = np.clip(theta[-1] + np.bincount(self.row, theta[self.col], len(self.bag_of)), -30, 30)
        z0 = np.clip(theta[-1], -30, 30)
        none = self.plain * np.logaddexp(0, z0) + np.bincount(self.bag_of, np.logaddexp(0, z), n)  # -log of no toxic sentence
        p_doc = np.clip(-np.expm1(-none), 1e-9, 1)
        value = float(np.where(self.y == 1, np.log(p_doc), -none).mean() - self.ridge / 2 * (theta[:-1] ** 2).sum())
        pull = np.where(self.y == 1, (1 - p_doc) / p_doc, -1.0) / n
        by_sentence = pull[self.bag_of] / (1 + np.exp(-z))
        slope = np.empty_like(theta)
        slope[:-1] = np.bincount(self.col, by_sentence[self.row], self.n) - self.ridge * theta[:-1]
        slope[-1] = by_sentence.sum() + (pull * self.plain).sum() / (1 + np.exp(-z0))
        return value, slope


def fit_noisy_or(bags: list[tuple[int, int, list[list[int]]]], n_features: int, rounds: int = 400, rate: float = 0.15, ridge: float = 2e-5) -> tuple[float, np.ndarray]:
    """Bias and weights that make the objective large, by Adam."""
    objective = Objective(bags, n_features, ridge)
    theta = np.zeros(n_features + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        _, slope = objective(theta)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return float(theta[-1]), theta[:-1]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 20_000, min_docs: int = 3, min_z: float = 6.0) -> NoisyOr:
    """Fits the model to at most ``max_train`` labelled rows; every row of ``labels`` may be used."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("l_id"))
        .agg(F.max(F.col(label_col)).cast("int").alias("y"))
        .orderBy(F.xxhash64("l_id"), "l_id")
        .limit(max_train)
    )
    sample = docs.select(F.col(id_col).alias("l_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "l_id")  # at most max_train short rows
    sample = cut(sample.where(F.col("text").isNotNull()).groupBy(F.md5("text")).agg(F.max("y").alias("y"), F.first("text").alias("text")).select("y", "text").repartition(max(8, max_train // 1000)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]

        def partial() -> pa.RecordBatch:
            names = list(by[0].keys() | by[1].keys())
            rows = [pa.array([n[y], *[by[y][f] for f in names]], pa.int64()) for y in (0, 1)]
            for y in (0, 1):
                by[y].clear()
                n[y] = 0
            return pa.record_batch([pa.array([None, *names], pa.string()), *rows], ["feature", "n0", "n1"])

        for batch in slices(batches, 64):
            for y, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), strict=True):
                n[y] += 1
                by[y].update({f for token in set(text.split()) for f in features_of(token)})
            if len(by[0]) + len(by[1]) > 100_000:  # partial counts, so that memory doesn't follow the sample
                yield partial()
        yield partial()

    counts = cut(sample.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    whole = counts.where("feature is null").collect()
    n0, n1 = (whole[0]["n0"] or 0, whole[0]["n1"] or 0) if whole else (0, 0)
    if not n0 or not n1:
        return NoisyOr()
    rate0, rate1 = F.col("n0") / n0, F.col("n1") / n1
    z = (rate1 - rate0) / F.sqrt((F.col("n0") + F.col("n1")) / (float(n0) * n1))
    judged = counts.where(F.col("feature").isNotNull() & (F.col("n1") >= min(min_docs, n1)) & (z > 0)).select("feature", z.alias("z"))
    most = judged.agg(F.max("z")).first()[0] or 0.0
    kept = [r[0] for r in judged.where(F.col("z") >= min(min_z, most / 2)).orderBy("feature").select("feature").collect()]  # words of the sample
    if not kept:
        return NoisyOr()
    number = {f: i for i, f in enumerate(kept)}

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for y, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), strict=True):
                found = [sorted({number[f] for t in s.split() for f in features_of(t) if f in number}) for s in SENTENCE.split(text) if s.strip()]
                rows.append((y, sum(not x for x in found), [x for x in found if x]))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int32())))], ["y", "plain", "bags"])

    bags = [(r["y"], r["plain"], r["bags"]) for r in sample.mapInArrow(bag, "y int, plain long, bags array<array<int>>").collect()]
    bias, weights = fit_noisy_or(bags, len(kept))
    return NoisyOr(bias, {f: float(w) for f, w in zip(kept, weights, strict=True) if abs(w) > 1e-3})


def score_toxicity(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text", sentence_threshold: float = 0.5) -> DataFrame:
    """A row per document: its score, its number of sentences and the numbers of offending ones, from 0."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, least = model.tokens(), float(np.log(sentence_threshold / (1 - sentence_threshold)))
        for batch in slices(batches):
            logits = [model.sentences(text, tokens) for text in as_texts(batch.column(1))]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([model.combine(z) for z in logits], pa.float64()),
                    pa.array([len(z) for z in logits], pa.int64()),
                    pa.array([[i for i, x in enumerate(z) if x >= least] for z in logits], pa.list_(pa.int32())),
                ],
                ["doc_id", "score", "n_sentences", "offending"],
            )

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(score, f"doc_id {id_type}, score double, n_sentences long, offending array<int>")


def drop_toxic(docs: DataFrame, model: NoisyOr, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns, in one pass and without a join."""
    small_batches(docs.sparkSession)
    position = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = model.tokens()
        for batch in slices(batches):
            clean = [model.combine(model.sentences(text, tokens)) < threshold for text in as_texts(batch.column(position))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
