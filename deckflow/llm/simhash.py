"""SimHash near-duplicates by meeting in the middle.

Two fingerprints at a distance of at most ``2 r`` share a variant at a distance of at
most ``r`` of both, and any two that share one are that close. So every distinct
fingerprint emits all variants within ``r`` flipped bits, equal variants meet, and their
owners are linked, after a check of the distance.

Variants go to the task of their first ``k`` bits. A fingerprint has thousands of
variants but they begin in a few ways, so it is sent once for each such beginning, and
the task writes out the variants that begin so. ``k`` grows with the logarithm of the
number of fingerprints; a beginning that still gathers too much (many near copies) is cut
again by its next bits, at last into single variants, which at most ``1 + 64 + 2016``
fingerprints own.

Owners of one variant are linked to the least of them, and a task returns a spanning
forest, so a group of copies makes no pairs. Copies share a fingerprint and cost one row.

Defined cases: a null text is an empty one; a text without words has the fingerprint
zero, which is linked like any other; a row without id takes part, but gives no name to
a component (a component of such rows only has the id null); repeated rows share their
component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckflow.llm.common import slices, text_rows
from deckflow.llm.components import components
from deckflow.session import materialize, materialize_measured

BITS = 64
#: Variants that a task writes out in one numpy step, on average and at most.
STEP = 2_000_000
#: Variants of one beginning that a task takes; more are cut by further bits.
GROUP = 64 * STEP


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all word shingles of a text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    ends = ends - 1
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 15):
        spans = zip(starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist())
        hashes = np.array([digest(joined[s:e], seed) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * total > len(starts)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", keys: bool = False
) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long; with ``keys`` also ``key``, a hash of the text."""
    texts = text_rows(docs, id_col, text_col)
    if keys:
        texts = texts.withColumn("key", F.xxhash64("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                got = [fingerprint(t, shingle) for t in some.column("text").to_pylist()]
                key = [some.column("key")] if keys else []
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(np.array(got, np.uint64).view(np.int64)), *key],
                    ["doc_id", "fp", "key"][: 2 + keys],
                )

    return texts.mapInArrow(rows, "doc_id long, fp long" + ", key long" * keys)


def _flips(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``radius`` set."""
    masks = [sum(1 << i for i in c) for n in range(min(radius, bits) + 1) for c in combinations(range(bits), n)]
    return np.array(masks, np.uint64)


def _ball(bits: int, radius: int) -> int:
    return sum(math.comb(bits, i) for i in range(min(radius, bits) + 1)) if radius >= 0 else 0


def _meet(fps: np.ndarray, left: np.ndarray, rest: int, distance: int) -> Iterator[np.ndarray]:
    """Pairs of the forest: ``fps`` share their beginning but for ``left`` more flips in ``rest`` bits."""
    size = sum(int((left == r).sum()) * _ball(rest, r) for r in range(int(left.max()) + 1))
    if size > 2 * STEP and rest:
        cut = min(4, rest)
        head = (fps >> np.uint64(rest - cut)) & np.uint64((1 << cut) - 1)
        for begin in range(1 << cut):
            less = left - np.bitwise_count(head ^ np.uint64(begin)).astype(left.dtype)
            there = less >= 0
            if there.sum() > 1:
                yield from _meet(fps[there], less[there], rest - cut, distance)
        return
    low = fps & np.uint64((1 << rest) - 1)
    variants, owners = [], []
    for r in range(int(left.max()) + 1):
        own = np.flatnonzero(left == r)
        if len(own):
            masks = _flips(rest, r)
            variants.append((low[own][:, None] ^ masks).ravel())
            owners.append(np.repeat(own, len(masks)))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    ranked = np.sort(variants)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return
    # A small table of remainders finds nearly all variants that nobody shares.
    table = np.zeros(1 << 20, bool)
    spread = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    table[spread(twice)] = True
    maybe = np.flatnonzero(table[spread(variants)])
    variants, owners = variants[maybe], owners[maybe]
    order = np.lexsort((fps[owners], variants))
    variants, owned = variants[order], fps[owners[order]]
    first = np.concatenate([[True], variants[1:] != variants[:-1]])
    least = owned[np.flatnonzero(first)[np.cumsum(first) - 1]]
    pairs = np.unique(np.stack([least, owned], 1)[~first], axis=0)
    if len(pairs):
        yield pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= distance]


def forest(pairs: np.ndarray) -> np.ndarray:
    """A star to the least node for each component of ``pairs``."""
    nodes, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(pairs.shape)
    parent = np.arange(len(nodes))
    while True:
        a, b = parent[at[:, 0]], parent[at[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != parent[parent]).any():
            parent = parent[parent]
    apart = np.flatnonzero(parent != np.arange(len(nodes)))
    return np.stack([nodes[parent[apart]], nodes[apart]], 1)


def _begin(rows: DataFrame, k: int, cut: int) -> DataFrame:
    """``fp, begin, left``: a row for each way in which variants begin, ``cut`` bits longer."""
    ways = F.array(*[F.struct(F.lit(int(m)).alias("mask"), F.lit(bin(int(m)).count("1")).alias("flips")) for m in _flips(cut, 2)])
    head = F.shiftrightunsigned("fp", BITS - k - cut).bitwiseAND((1 << cut) - 1)
    return (
        rows.withColumn("way", F.explode(ways))
        .filter("way.flips <= left")
        .select(
            "fp",
            (F.col("begin") * (1 << cut) + head.bitwiseXOR(F.col("way.mask"))).alias("begin"),
            (F.col("left") - F.col("way.flips")).alias("left"),
        )
    )


def links(fps: DataFrame, count: int, distance: int = 4) -> DataFrame:
    """Edges ``a, b`` that connect distinct fingerprints (column ``fp``) as their pairs within ``distance`` do."""
    radius = distance // 2
    if radius != 2 or distance % 2:
        raise ValueError("built for a distance of 4: variants within 2 flipped bits")

    def meet(k: int):
        def pairs(key: tuple, group: pa.Table) -> pa.Table:
            values = group.column("fp").to_numpy().view(np.uint64)
            found = list(_meet(values, group.column("left").to_numpy(), BITS - k, distance)) if len(values) > 1 else []
            both = forest(np.concatenate(found)) if found else np.zeros((0, 2), np.uint64)
            both = both.view(np.int64)
            return pa.table({"a": both[:, 0], "b": both[:, 1]})

        return pairs

    k = max(2, min(40, math.ceil(math.log2(max(count, 1) * _ball(BITS, radius) / STEP + 1))))
    rows = _begin(fps.select("fp", F.lit(0).cast("long").alias("begin"), F.lit(radius).alias("left")), 0, k)
    out = None
    while True:
        size = F.lit(0)
        for r in range(radius + 1):
            size = F.when(F.col("left") == r, F.lit(_ball(BITS - k, r))).otherwise(size)
        weights = rows.groupBy("begin").agg(F.sum(size).alias("size"))
        large, seen = materialize_measured(
            weights.filter(F.col("size") > GROUP).select("begin"), "beginnings", n=F.count("*")
        )
        small = rows.join(large, "begin", "left_anti") if seen["n"] else rows
        edges = small.groupBy("begin").applyInArrow(meet(k), "a long, b long")
        out = edges if out is None else out.unionByName(edges)
        if not seen["n"]:
            return out
        cut = min(8, BITS - k)
        rows = _begin(rows.join(large, "begin", "left_semi"), k, cut)
        k += cut


def near_duplicates(
    docs: DataFrame,
    shingle: int = 4,
    distance: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, fp, component_id``: the least id that links of ``distance`` reach."""
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    rooted = _rooted(rows, F.col("doc_id"), distance)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(named, "root").drop("root"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def _rooted(rows: DataFrame, order: Column, distance: int) -> DataFrame:
    """``fp, least, root``: each fingerprint with the least ``order`` of its rows and the root of its component."""
    distinct, seen = materialize_measured(
        rows.groupBy("fp").agg(F.min(order).alias("least")), "distinct", n=F.count("*")
    )
    nodes = components(links(distinct, seen["n"], distance))
    return distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )


def first_rows(
    docs: DataFrame,
    shingle: int = 4,
    distance: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``first_id, key``: one row of each component, by least id (rows without id last), fingerprint and text hash.

    ``key`` is ``xxhash64`` of the text, so that rows that share an id are told apart.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col, keys=True), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "key")
    first = _rooted(rows, order, distance).groupBy("root").agg(F.min("least").alias("first"))
    return first.select(F.col("first.doc_id").alias("first_id"), "first.key")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
