"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Fill a sequence greedily (the largest document that fits the gap, again and again); then
replace its smallest document with two unpacked ones that fill the expanded gap more
tightly. A sequence depends on lengths alone, so it is chosen on the histogram of the
lengths, which has at most ``capacity`` rows whatever the corpus: a chosen pattern
repeats until one of its lengths runs out. The pieces themselves stay in Spark; each gets
its rank within its length, and the rank its place.

Defined cases: a null text is an empty one, which still has its end id; equal lengths and
repeated rows are interchangeable and ordered by id, piece and content; very long texts are
cut into pieces one after another; an empty table gives no rows; other columns of documents
are not read, and further columns of pieces keep their values whatever their names, but for
``sequence_id`` and ``offset``, which are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckflow.llm.common import slices, text_rows
from deckflow.llm.tokens import encoder
from deckflow.session import materialize

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = 4096,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The token ids of each document with its end id, cut only where longer than ``capacity``.

    ``keep_ids`` adds ``ids``, the little-endian 32-bit ids of the piece.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for batch in batches:
            for some in slices(batch):
                rows = []
                encoded = tokens.encode(some.column("text").to_pylist())
                for doc, got in zip(some.column("doc_id").to_pylist(), encoded):
                    ids = np.append(np.frombuffer(got, tokens.dtype).astype("<u4"), np.array(end_id, "<u4"))
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        content = part.tobytes()
                        row = (doc, k, start, len(part), zlib.crc32(content))
                        rows.append((*row, content) if keep_ids else row)
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(columns)]
                )

    return text_rows(docs, id_col, text_col).mapInArrow(cut, PIECE + ", ids binary" * keep_ids)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns of lengths and how many sequences follow each, for a histogram of lengths.

    Each pattern uses up a length or comes near it, so there are about as many patterns as
    lengths, not as documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[int, list[int]]] = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return patterns
        free = left.copy()
        chosen: list[int] = []
        gap = capacity
        while gap:
            at = int(there.searchsorted(gap, "right")) - 1
            while at >= 0 and not free[there[at]]:
                at -= 1
            if at < 0:
                break
            chosen.append(int(there[at]))
            free[there[at]] -= 1
            gap -= chosen[-1]
        peak = np.bincount(chosen, minlength=capacity + 1)
        if gap:
            smallest = chosen[-1]
            pair = _tightest_pair(free, gap + smallest, smallest)
            if pair:
                chosen = [*chosen[:-1], *pair]
        net = np.bincount(chosen, minlength=capacity + 1)
        peak = np.maximum(peak, net)
        # Sequences follow this pattern while every length it met is still there.
        used = np.flatnonzero(net)
        times = int(((left[used] - peak[used]) // net[used]).min()) + 1
        left[used] -= times * net[used]
        patterns.append((times, chosen))


def _tightest_pair(free: np.ndarray, gap: int, beyond: int) -> list[int] | None:
    """Two free lengths with the largest sum of at most ``gap`` and over ``beyond``."""
    lengths = np.flatnonzero(free[: gap + 1])
    if not len(lengths):
        return None
    low, high, best, pair = 0, len(lengths) - 1, beyond, None
    while low <= high:
        a, b = int(lengths[low]), int(lengths[high])
        if a + b > gap or low == high and free[a] < 2:
            high -= 1
            continue
        if a + b > best:
            best, pair = a + b, [b, a]
            if best == gap:
                break
        low += 1
    return pair


def _places(patterns: list[tuple[int, list[int]]], capacity: int) -> dict[str, np.ndarray]:
    """For each length and run of ranks: the first sequence, offset and uses per sequence."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, chosen in patterns:
        offset = 0
        for length in sorted(set(chosen), reverse=True):
            uses, first = chosen.count(length), taken.get(length, 0)
            rows.append((length, first, sequence, offset, uses))
            taken[length] = first + uses * times
            offset += uses * length
        sequence += times
    rows.sort()
    names = ("length", "first", "sequence", "offset", "uses")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def _unused(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores behind as no column has."""
    taken = {c.lower() for c in columns}
    return [next(n + "_" * k for k in range(len(taken) + 1) if n + "_" * k not in taken) for n in names]


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (``doc_id, piece, length, ids_crc32`` and any more) with their places.

    Adds ``sequence_id`` and ``offset``. ``pieces`` should be stored, as it is read twice.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    bucket, rank, earlier = _unused(pieces.columns, "bucket", "rank", "before")
    # Ranks within a length are counted in buckets, so that a length that a third of all
    # pieces share is not sorted in one task.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = materialize(dealt.groupBy("length", bucket).agg(F.count("*").alias("n")), "length_counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(best_two_fit(histogram, capacity), capacity)
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(earlier))
    within = Window.partitionBy("length", bucket).orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn(rank, F.row_number().over(within) - 1)
        .join(bases, ["length", bucket])
        .withColumn(rank, F.col(rank) + F.col(earlier))
        .drop(bucket, earlier)
    )
    kept = [c for c in ranked.columns if c != rank]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (places["length"] << 44) + places["first"]
        for batch in batches:
            length, ranks = (batch.column(c).to_numpy() for c in ("length", rank))
            at = key.searchsorted((length << 44) + ranks, "right") - 1
            times, slot = np.divmod(ranks - places["first"][at], places["uses"][at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [pa.array(places["sequence"][at] + times), pa.array(places["offset"][at] + slot * length)],
                [*kept, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != rank)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
