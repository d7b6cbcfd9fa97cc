"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words (value 1), and of word pairs and pairs with one or two
words between (value ``PAIR``: they are many, and a word should be blamed first), hashed
to ``1 << BITS`` coordinates; those that less than ``min_share`` of the sampled texts (or
fewer than three) have teach nothing. Each coordinate has a learning rate of its own; the L1 term leaves
most weights at zero, so the model is a short list that every task gets.

The model is fitted in one task on a sample of labelled rows whose size is a parameter
(``sample_rows`` of each label, those with the smallest hash of their id); the bias is
then set for the share that the label has among all labelled rows. Features are made
where the texts are read.

Defined cases: a null or empty text has no feature and gets the model's bias; a text
labelled twice counts as toxic if one label says so; rows with a null label or id teach
nothing; without any labelled row the score is 0; repeated rows get equal scores; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckflow.llm.common import WORD_HASHES, keep_rows, mixed, slices, text_rows

BITS = 24
#: Rows with label 0 and 1 that are fitted, at most.
SAMPLE_ROWS = (10_000, 6_000)
MIN_SHARE = 0.001
PAIR = 0.3
#: Coordinates of words, apart from those of pairs.
_WORDS = 1 << (BITS - 1)
THRESHOLD = 0.3
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def _grams(text: str | None) -> np.ndarray:
    """Coordinates of a whole text, with repeats."""
    words = WORD_HASHES.of(_WORD.findall((text or "").encode().lower()))
    pairs = np.concatenate([mixed(words[:-gap], words[gap:], gap) for gap in (1, 2, 3)])
    words, pairs = ((x >> np.uint64(65 - BITS)).astype(np.uint32) for x in (words, pairs))
    return np.concatenate([words | np.uint32(_WORDS), pairs])


def features(text: str | None) -> np.ndarray:
    return np.unique(_grams(text))


@dataclass
class Ftrl:
    """Follow the regularised leader, with a learning rate per coordinate."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.0

    def fit(
        self, rows: list[tuple[np.ndarray, int]], values: np.ndarray, epochs: int
    ) -> tuple[np.ndarray, float]:
        """Weights and bias for rows of (present coordinates, label); ``values`` are theirs if present."""
        size = self.size = len(values)
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        values = np.append(values, 1.0)
        rows = [(np.append(x, size), y) for x, y in rows]
        for _ in range(epochs):
            for at, label in rows:
                w, n, x = self.weights(at), self.n[at], values[at]
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
                grown = n + g * g
                self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
                self.n[at] = grown
        w = self.weights(np.arange(size + 1))
        return w[:-1] * values[:-1], float(w[-1])

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        slope = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        # The bias, the last coordinate, carries no penalty for being there.
        l1 = np.where(at == self.size, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / slope)


@dataclass
class Model:
    """The coordinates with a weight, their weights and the bias; None if nothing was learnt."""

    at: np.ndarray
    weight: np.ndarray
    bias: float | None
    #: Which coordinates have a weight, those in order, and their weights.
    _known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.bias is None:
            return [0.0] * len(texts)
        if self._known is None:
            order, there = np.argsort(self.at), np.zeros(1 << BITS, bool)
            there[self.at] = self.weight.astype(np.float32) != 0
            self._known = there, self.at[order], self.weight[order].astype(np.float32)
        there, at, weight = self._known
        sums = []
        for text in texts:
            grams = _grams(text)
            told = np.unique(grams[there[grams]])
            sums.append(float(weight[at.searchsorted(told)].sum()) + self.bias)
        return (1 / (1 + np.exp(-np.clip(sums, -35, 35)))).tolist()


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    sample_rows: tuple[int, int] = SAMPLE_ROWS,
    min_share: float = MIN_SHARE,
    epochs: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fit on rows of ``labels`` (ids and 0/1) and their texts, at most ``sample_rows`` of each label."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("rank", F.xxhash64("doc_id"))
    )
    shares = {r.label: r.n for r in known.groupBy(F.col("label") == 1).agg(F.max("label").alias("label"), F.count("*").alias("n")).collect()}
    sample = known.filter("label = 0").orderBy("rank").limit(sample_rows[0]).unionByName(
        known.filter("label = 1").orderBy("rank").limit(sample_rows[1])
    )

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                got = [features(t).tobytes() for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("rank"), some.column("label"), pa.array(got, pa.binary())],
                    ["rank", "label", "features"],
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, having = [], np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for x, y in zip(batch.column("features").to_pylist(), batch.column("label").to_pylist()):
                rows.append((np.frombuffer(x, np.uint32), y))
                having[rows[-1][0]] += 1
        if not rows:
            return
        kept = np.flatnonzero(having >= max(3, min_share * len(rows)))
        having[:] = -1
        having[kept] = np.arange(len(kept))
        for i, (x, y) in enumerate(rows):
            x = having[x]
            rows[i] = x[x >= 0], y
        weight, bias = Ftrl().fit(rows, np.where(kept >= _WORDS, 1.0, PAIR), epochs)
        ones = sum(y for _, y in rows)
        bias += np.log(((shares.get(1, 0) or 0.5) * max(len(rows) - ones, 0.5)) / ((shares.get(0, 0) or 0.5) * max(ones, 0.5)))
        at = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(kept[at], -1), pa.int64()), pa.array(np.append(weight[at], bias))], ["at", "weight"]
        )

    # The sample is bounded by ``sample_rows``, three numbers each, so it may be broadcast.
    fitted = (
        text_rows(docs, id_col, text_col)
        .join(F.broadcast(sample), "doc_id")
        .mapInArrow(seen, "rank long, label int, features binary")
        # Of rows that share an id one teaches, so that the fit takes no more rows than ids.
        .groupBy("rank", "label").agg(F.min("features").alias("features"))
        .repartition(1)
        .sortWithinPartitions("rank", "label", "features")
        .mapInArrow(fit, "at long, weight double")
        .toPandas()
    )
    if fitted.empty:
        return Model(np.zeros(0, np.int64), np.zeros(0), None)
    learnt = fitted[fitted["at"] >= 0]
    return Model(learnt["at"].to_numpy(), learnt["weight"].to_numpy(), float(fitted["weight"][fitted["at"] < 0].iloc[0]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                got = model.scores(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"]
                )

    return text_rows(docs, id_col, text_col).mapInArrow(rows, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    return keep_rows(docs, lambda texts: [s < threshold for s in model.scores(texts)], text_col)
