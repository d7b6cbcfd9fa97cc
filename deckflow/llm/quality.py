"""Quality rules: counts of a text, and a calibrated classifier of hashed n-grams.

The classifier is a logistic regression over the shares of hashed words, word pairs and
character n-grams (of four code points, so capitals, marks and repeated signs tell as well,
alike in every alphabet). It is fitted on a
sample of labelled rows bounded by ``sample_rows`` per label; a fifth of the sample, kept
out of the fit, calibrates the score into a probability (Platt). Texts are scored in Arrow
batches and kept from a fixed probability on.

Defined cases: a null text is an empty one: no words, failed by the length rule; rows
with a null label or id teach nothing; where a label is missing altogether, the classifier
keeps every text; a text with two labels counts as bad; ties and repeated rows get equal
results; very long texts are counted and scored whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckflow.llm.common import WORD_HASHES, mixed, slices, text_rows

BITS = 18
SAMPLE_ROWS = 4_000
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def counts(text: str, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int]:
    """Characters in words, symbols, repeated lines, and words in repeated windows of three."""
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeated = 0
    if len(words) > 3:
        windows = mixed(mixed(hashes[:-2], hashes[1:-1], 1), hashes[2:], 2)
        order = np.argsort(windows)
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            starts = np.zeros(len(words), bool)
            starts[order[1:][same]] = starts[order[:-1][same]] = True
            covered = starts.copy()
            covered[1:] |= starts[:-1]
            covered[2:] |= starts[:-2]
            repeated = int(covered.sum())
    return chars, symbols, len(lines) - len(set(lines)), repeated


def coordinates(text: str, hashes: np.ndarray) -> list[np.ndarray]:
    """Hashed words and pairs, and hashed character n-grams, with repeats."""
    words = np.concatenate([hashes, mixed(hashes[:-1], hashes[1:], 7)])
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    grams = c[:-3] if len(c) > 3 else c[:0]
    for k in range(1, 4):
        grams = grams * np.uint32(0x9E3779B1) + c[k : k + len(grams)]
    grams = grams * np.uint32(0x85EBCA77)
    return [
        (words >> np.uint64(64 - BITS)).astype(np.uint32),
        (grams >> np.uint32(32 - BITS)) + np.uint32(1 << BITS),
    ]


@dataclass
class Model:
    """Weights of word and character coordinates, and the calibration of their sum."""

    weight: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, text: str, hashes: np.ndarray) -> float:
        if self.weight is None:
            return 1.0
        raw = self.bias + sum(float(self.weight[at].mean()) for at in coordinates(text, hashes) if len(at))
        return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -35, 35))))


def _shares(text: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, share = [], []
    for of in coordinates(text, hashes):
        where, n = np.unique(of, return_counts=True)
        at.append(where)
        share.append(n / max(1, len(of)))
    return np.concatenate(at).astype(np.uint32), np.concatenate(share).astype(np.float32)


def _learn(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, rate: float) -> Model:
    """Stochastic steps with a rate per coordinate, then the calibration on every fifth row."""
    teach = [r for i, r in enumerate(rows) if i % 5]
    if len({y for *_, y in teach}) < 2:
        return Model()
    weight, seen, bias, bias_seen = np.zeros(2 << BITS), np.full(2 << BITS, 1e-8), 0.0, 1e-8
    for _ in range(epochs):
        for at, share, y in teach:
            g = 1 / (1 + np.exp(-np.clip(bias + weight[at] @ share, -35, 35))) - y
            step = g * share
            seen[at] += step * step
            weight[at] -= rate * step / np.sqrt(seen[at])
            bias_seen += g * g
            bias -= rate * g / np.sqrt(bias_seen)
    raw = np.array([bias + weight[at] @ share for at, share, _ in rows[::5]])
    label = np.array([y for *_, y in rows[::5]], float)
    # Platt's targets keep the calibration finite where the labels are parted cleanly.
    good, bad = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -35, 35)))
        d, v = p - target, np.maximum(p * (1 - p), 1e-6)
        hessian = np.array([[(v * raw * raw).sum(), (v * raw).sum()], [(v * raw).sum(), v.sum()]])
        move = np.linalg.solve(hessian + 1e-6 * np.eye(2), [(d * raw).sum(), d.sum()])
        slope, shift = slope - move[0], shift - move[1]
    return Model(weight.astype(np.float32), float(bias), float(slope), float(shift))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    epochs: int = 5,
    rate: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fit on ids and 0/1 labels (1: good), at most ``sample_rows`` of each label."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .withColumn("rank", F.xxhash64("doc_id"))
    )
    sample = None
    for label in (0, 1):
        some = known.filter(F.col("label") == label).orderBy("rank").limit(sample_rows)
        sample = some if sample is None else sample.unionByName(some)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                got = []
                for text in some.column("text").to_pylist():
                    text = text or ""
                    at, share = _shares(text, WORD_HASHES.of(text.encode().split()))
                    got.append((at.tobytes(), share.tobytes()))
                columns = [pa.array(c, pa.binary()) for c in zip(*got)]
                yield pa.RecordBatch.from_arrays(
                    [some.column("rank"), some.column("label"), *columns], ["rank", "label", "at", "share"]
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (np.frombuffer(r["at"], np.uint32), np.frombuffer(r["share"], np.float32), r["label"])
            for batch in batches
            for r in batch.to_pylist()
        ]
        if not rows:
            return
        model = _learn(rows, epochs, rate)
        parts = [b"" if model.weight is None else model.weight.tobytes()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.binary())] + [pa.array([x]) for x in (model.bias, model.slope, model.shift)],
            ["weight", "bias", "slope", "shift"],
        )

    # The sample is bounded by ``sample_rows`` a label, three numbers each.
    got = (
        text_rows(docs, id_col, text_col)
        .join(F.broadcast(sample), "doc_id")
        .mapInArrow(seen, "rank long, label int, at binary, share binary")
        # Of rows that share an id one teaches, so that the fit takes no more rows than ids.
        .groupBy("rank", "label").agg(F.min(F.struct("at", "share")).alias("least"))
        .select("rank", "label", "least.at", "least.share")
        .repartition(1)
        .sortWithinPartitions("rank", "at", "share")
        .mapInArrow(fit, "weight binary, bias double, slope double, shift double")
        .collect()
    )
    if not got or not got[0].weight:
        return Model()
    return Model(np.frombuffer(got[0].weight, np.float32), got[0].bias, got[0].slope, got[0].shift)


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, quality double"
)


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, the verdict of the fixed rules, the probability and the decision for every text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                got = []
                for text in some.column("text").to_pylist():
                    text = text or ""
                    words = text.encode().split()
                    hashes = WORD_HASHES.of(words)
                    n, base = len(words), counts(text, words, hashes)
                    failed = n < MIN_WORDS or 100 * base[3] > MAX_REPEAT_PERCENT * n
                    p = model.probability(text, hashes)
                    got.append((n, *base, failed, not failed and p >= threshold, p))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id")] + [pa.array(c, k) for c, k in zip(zip(*got), kinds)],
                    [f.split()[0] for f in RESULT.split(", ")],
                )

    return text_rows(docs, id_col, text_col).mapInArrow(rows, RESULT)
