"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of up to ``order`` bytes with the counts of
what followed. The code length of a byte comes from its longest context known there; where
the context is known but the byte is not, an escape is paid and the context shortened
(escape probability: distinct followers over followers plus distinct followers); beyond
the empty context all 256 bytes are alike. Statistics are frozen, so the code length of
each (context, byte) is a number, and all languages are looked up at once. The language
that codes the text in the fewest bits is predicted.

The trees are fitted on a sample of labelled texts bounded per language by
``sample_rows``; grams are counted in Spark, and contexts seen fewer than ``min_count``
times are cut off.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and a very long
one is coded whole, in pieces that know the bytes before them; rows with a null id, language
or text teach nothing; equal rows teach once, rows that share an id teach each its language; if no language was learnt, every text is ``und``;
ties go to the first language in order; repeated rows get equal results; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckflow.llm.common import slices, text_rows

ORDER = 3
SAMPLE_ROWS = 600
MIN_COUNT = 2
#: Bytes of a text that one numpy step works on.
PIECE_BYTES = 1 << 21
#: Parts of the range of hashes in which the rows of a language are counted.
HASH_PARTS = 1 << 12
_LETTER = re.compile(r"[^\W\d_]")


def grams(data: bytes, order: int, before: bytes = b"") -> list[np.ndarray]:
    """For n = 1 to ``order + 1``: the n bytes that end at each byte, as one number.

    ``before`` is what stands before ``data`` in its text. Line ends stand before a text, so
    that contexts never reach another one.
    """
    padded = np.frombuffer((b"\n" * order + before)[len(before) :] + data, np.uint8).astype(np.uint64)
    out, value = [], np.zeros(len(data), np.uint64)
    for n in range(order + 1):
        value = value | (padded[order - n : len(padded) - n] << np.uint64(8 * n))
        out.append(value)
    return out


@dataclass
class Table:
    """Numbers with a row of bits per language; looked up through a bucket index."""

    keys: np.ndarray
    bits: np.ndarray

    def __post_init__(self) -> None:
        size = max(1, len(self.keys))
        self.shift = np.uint64(64 - max(1, (2 * size - 1).bit_length()) - 1)
        hashed = self._hash(self.keys)
        order = np.argsort(hashed, kind="stable")
        self.keys, self.bits = self.keys[order], self.bits[order]
        buckets = 1 << (64 - int(self.shift))
        self.first = np.searchsorted(hashed[order], np.arange(buckets + 1, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max()) if len(self.keys) else 0

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        bucket = self._hash(keys)
        at, end = self.first[bucket], self.first[bucket + np.uint64(1)]
        ask = np.flatnonzero(at < end)
        for step in range(self.deepest):
            hit = self.keys[at[ask] + step] == keys[ask]
            out[ask[hit]] = at[ask[hit]] + step
            ask = ask[~hit]
            ask = ask[at[ask] + step + 1 < end[ask]]
            if not len(ask):
                break
        return out


@dataclass
class Model:
    """``codes[n]``: bits of n+1-grams; ``escapes[n]``: bits to leave a context of n bytes."""

    languages: list[str]
    codes: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]
    _tables: tuple | None = None

    def bits(self, data: bytes, before: bytes = b"") -> np.ndarray:
        """The exact code length of ``data`` in each language, after the last bytes ``before`` it."""
        if self._tables is None:
            self._tables = [Table(*c) for c in self.codes], [Table(*e) for e in self.escapes]
        codes, escapes = self._tables
        total = np.zeros(len(self.languages))
        all_grams = grams(data, len(codes) - 1, before)
        left = np.arange(len(data))
        for n in range(len(codes) - 1, -1, -1):
            found = codes[n].find(all_grams[n][left])
            hit = found >= 0
            total += codes[n].bits[found[hit]].sum(axis=0)
            left = left[~hit]
            if not len(left):
                return total
            context = all_grams[n][left] >> np.uint64(8)
            known = escapes[n].find(context) if n else np.zeros(len(left), np.int32)
            known = known[known >= 0]
            total += escapes[n].bits[known].sum(axis=0)
        return total + 8.0 * len(left)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the shortest code, and its share among all of them."""
        if not self.languages or not text or not _LETTER.search(text):
            return "und", 0.0
        data = text.encode()
        total, order = np.zeros(len(self.languages)), len(self.codes) - 1
        for at in range(0, len(data), PIECE_BYTES):
            total += self.bits(data[at : at + PIECE_BYTES], data[max(0, at - order) : at])
        best = int(total.argmin())
        # Bits of neighbouring bytes are far from independent: an eighth of them counts.
        return self.languages[best], float(1 / np.exp2(np.clip((total[best] - total) / 8, -1000, 0)).sum())


def fit(counts: list[tuple[str, int, int, int]], order: int) -> Model:
    """A model from rows of (language, n, n-gram, count), n from 1 to ``order + 1``."""
    languages = sorted({c[0] for c in counts})
    at = {x: i for i, x in enumerate(languages)}
    codes, escapes, lower = [], [], None
    for n in range(1, order + 2):
        rows = [(at[g], k, c) for g, m, k, c in counts if m == n]
        keys = np.unique(np.array([r[1] for r in rows], np.uint64))
        seen = np.zeros((len(keys), len(languages)))
        if rows:
            seen[np.searchsorted(keys, np.array([r[1] for r in rows], np.uint64)), [r[0] for r in rows]] = [r[2] for r in rows]
        contexts, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
        if n == 1:
            contexts, inverse = np.zeros(1, np.uint64), np.zeros(len(keys), np.int64)
        total, kinds = (np.zeros((len(contexts), len(languages))) for _ in range(2))
        np.add.at(total, inverse, seen)
        np.add.at(kinds, inverse, seen > 0)
        whole = np.maximum(total + kinds, 1)
        # A context unknown to a language costs nothing to leave.
        escape = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / whole), 0.0)
        short = np.full((len(keys), len(languages)), 8.0)
        if lower is not None:
            # n-grams start with the last byte in the lowest place: cut off the oldest byte.
            where = np.searchsorted(lower[0], keys & np.uint64((1 << 8 * (n - 1)) - 1))
            short = lower[1][where]
        bits = np.where(seen > 0, -np.log2(np.maximum(seen, 1) / whole[inverse]), escape[inverse] + short)
        codes.append((keys, bits))
        escapes.append((contexts, escape))
        lower = keys, bits
    return Model(languages, codes, escapes)


def smallest(rows: DataFrame, group: str, key: list[str], n: int) -> DataFrame:
    """The ``n`` rows of each group with the smallest hash of ``key``, which tells its rows apart.

    Rows are counted by part of the range of hashes first; only the parts that hold the
    first ``n`` are sorted, so a group may hold any share of all rows.
    """
    hashed = rows.withColumn("hash", F.xxhash64(*key))
    hashed = hashed.withColumn("part", F.shiftright("hash", 64 - (HASH_PARTS - 1).bit_length()))
    counts = hashed.groupBy(group, "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most ``HASH_PARTS`` rows of a group.
    wanted = counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).filter(F.col("before") < n)
    few = hashed.join(wanted.select(group, "part"), [group, "part"], "left_semi")
    place = F.row_number().over(Window.partitionBy(group).orderBy("hash", *key))
    return few.withColumn("place", place).filter(F.col("place") <= n).select(*rows.columns)


def train(
    docs: DataFrame,
    order: int = ORDER,
    sample_rows: int = SAMPLE_ROWS,
    min_count: int = MIN_COUNT,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Fit on the ``sample_rows`` labelled texts of each language with the smallest hash."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    ).filter("lang is not null and doc_id is not null and text is not null")
    key = ["lang", "doc_id", "text_hash"]
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    sample = smallest(rows.select(*key).distinct(), "lang", ["doc_id", "text_hash"], sample_rows)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[dict[int, int]]] = {}
        for batch in batches:
            for some in slices(batch):
                texts: dict[str, list[list[np.ndarray]]] = {}
                for lang, text in zip(some.column("lang").to_pylist(), some.column("text").to_pylist()):
                    texts.setdefault(lang, []).append(grams((text or "").encode(), order))
                for lang, of in texts.items():
                    mine = held.setdefault(lang, [{} for _ in range(order + 1)])
                    for n in range(order + 1):
                        keys, counts = np.unique(np.concatenate([g[n] for g in of]), return_counts=True)
                        for k, c in zip(keys.tolist(), counts.tolist()):
                            mine[n][k] = mine[n].get(k, 0) + c
        for lang, of in held.items():
            for n, mine in enumerate(of, 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(mine)), pa.array([n] * len(mine), pa.int32()), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())],
                    ["lang", "n", "gram", "count"],
                )

    # The sample is bounded: ``sample_rows`` texts of each language. Of equal rows one teaches.
    taught = rows.join(F.broadcast(sample), key).groupBy(*key).agg(F.first("text").alias("text"))
    kept = (
        taught.mapInArrow(counted, "lang string, n int, gram long, count long")
        .groupBy("lang", "n", "gram")
        .agg(F.sum("count").alias("count"))
        .filter((F.col("n") == 1) | (F.col("count") >= min_count))
        .toPandas()
    )
    return fit(list(kept.itertuples(index=False, name=None)), order)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                got = [model.predict(t) for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return text_rows(docs, id_col, text_col).mapInArrow(rows, "doc_id long, lang_pred string, score double")
