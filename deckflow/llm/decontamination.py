"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a benchmark item if some stretch of its text is within the
item's error budget of edits (insert, delete, replace a byte): ``error_rate`` of the
item's length. An item is split into budget-plus-one pieces, of which one must be there
unchanged, and where one is, Myers' bit-parallel algorithm gives the least distance around
it.

Pieces and documents meet in a shuffle, whatever the size of the benchmark. A piece is known
by the hash of its first bytes, at most ``ANCHOR``. One pass over the documents hashes the
bytes from every place on; two bit maps of bounded size, of all anchors and of their
beginnings, stop the places at which no piece can begin, and the others are joined with the
pieces. A document with hits then gets the items it may hold, with the stretches to look at.

Both sides are compared without case, punctuation and spacing: A-Z lower-cased, runs of
other ASCII characters than letters and digits one space.

Defined cases: null and empty texts are clean, and a very long text is searched whole, in
parts that overlap; null or empty items (after normalising) match nothing; an item too short
for an error must be there as it is (one of a few letters makes a row of the shuffle for each
place it stands at); repeated rows and repeated items give one result per pair of ids, the
least distance, then the first end; rows that share an id are told apart by their text when
contaminated ones are dropped; with an empty benchmark all documents are clean; other columns
are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckflow.llm.common import slices, text_rows
from deckflow.session import materialize

ERROR_RATE = 0.07
#: Bytes of a piece that are hashed.
ANCHOR = 16
#: Bits of a map: about this many for each piece, between the bounds (16 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 16, 27
#: Bytes of text that one numpy step works on.
STEP_BYTES = 1 << 20
#: Parts into which the documents that hit one piece or item are dealt.
SALTS = 16
_PLAIN = bytes(
    ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)
) + bytes(range(128, 256))
_BASE = 0x9E3779B97F4A7C15


def normalized(text: str | None) -> bytes:
    return b" ".join((text or "").encode().translate(_PLAIN).split())


def nearest(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a stretch of ``text``, and where the first such ends."""
    m = len(pattern)
    mask, last = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        places[c] |= 1 << i
    plus, minus, score = mask, 0, m
    best, end = m, 0
    get = places.get
    for j, c in enumerate(text, 1):
        equal = get(c, 0)
        across = (((equal & plus) + plus) ^ plus) | equal
        down = equal | minus
        up = minus | ~(across | plus)
        low = plus & across
        if up & last:
            score += 1
        elif low & last:
            score -= 1
            if score < best:
                best, end = score, j
        up <<= 1
        plus = ((low << 1) | ~(down | up)) & mask
        minus = up & down & mask
    return best, end


# --- pieces ---------------------------------------------------------------------

def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    n = STEP_BYTES + ANCHOR + 1
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return out[0], out[1]


class Places:
    """Hashes of the bytes from any place of a buffer on."""

    _tables: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, data: bytes):
        if Places._tables is None:  # once per worker process
            Places._tables = _powers()
        powers, self._inverse = Places._tables
        values = np.frombuffer(data, np.uint8).astype(np.uint64) * powers[: len(data)]
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        self.size = len(data)

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of ``length`` bytes from the places ``at`` on; equal bytes have equal hashes."""
        x = (self._sums[at + length] - self._sums[at]) * self._inverse[at]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def anchor_hash(piece: bytes) -> int:
    piece = piece[:ANCHOR]
    return int(Places(piece).hashes(np.zeros(1, np.int64), len(piece))[0])


@dataclass
class Filter:
    """Which places of a text may begin a piece: by hash of the beginning, then of the anchor."""

    lengths: list[int]  # of the anchors
    bits: int
    beginnings: np.ndarray
    anchors: np.ndarray

    def places(self, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of ``data`` and the hashes of the anchors that may begin there."""
        if not self.lengths:
            return
        shift, seven, one = np.uint64(64 - self.bits), np.uint64(7), np.uint8(1)

        def known(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
            bit = hashes >> shift
            return (bitmap[bit >> np.uint64(3)] >> (bit & seven).astype(np.uint8)) & one != 0

        # Very short anchors would make short beginnings of all: they are looked for apart.
        for group in ([n for n in self.lengths if n < 8], [n for n in self.lengths if n >= 8]):
            for least in group if group and group[-1] < 8 else group[:1]:
                lengths = [least] if least < 8 else group
                for start in range(0, len(data), STEP_BYTES):
                    step = Places(data[start : start + STEP_BYTES + ANCHOR])
                    begin = np.arange(max(0, min(STEP_BYTES, step.size - least + 1)))
                    begin = begin[known(self.beginnings, step.hashes(begin, least))]
                    for length in lengths:
                        at = begin[begin <= step.size - length]
                        hashes = step.hashes(at, length)
                        hit = known(self.anchors, hashes)
                        yield at[hit] + start, hashes[hit]


def split_items(items: DataFrame, error_rate: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The normalised items and their pieces, both stored."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalized(t) for t in batch.column("text").to_pylist()]
            made = pa.RecordBatch.from_pydict(
                {
                    "item_id": batch.column("item_id"),
                    "plain": pa.array(texts, pa.binary()),
                    "budget": pa.array([int(len(t) * error_rate) for t in texts], pa.int32()),
                }
            )
            yield made.filter(pa.array([bool(t) for t in texts], pa.bool_()))

    made = rows.distinct().mapInArrow(plain, "item_id long, plain binary, budget int").distinct()
    texts = materialize(made.select("item_id", F.xxhash64("plain").alias("item_key"), "plain", "budget"), "items")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.int32()] * 4
        names = ["anchor", "item_id", "item_key", "first", "length", "budget", "size"]
        for batch in batches:
            out = []
            for item in batch.to_pylist():
                text, parts = item["plain"], item["budget"] + 1
                for p in range(parts):
                    a, b = p * len(text) // parts, (p + 1) * len(text) // parts
                    anchor = np.uint64(anchor_hash(text[a:b])).astype(np.int64)
                    out.append((int(anchor), item["item_id"], item["item_key"], a, min(b - a, ANCHOR), item["budget"], len(text)))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    fields = "anchor long, item_id long, item_key long, first int, length int, budget int, size int"
    return texts, materialize(texts.mapInArrow(cut, fields), "pieces")


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A map of ``2 ** bits`` bits with those of the column ``h`` set, put together from pages of 4 KB."""
    bit = F.shiftrightunsigned("h", 64 - bits)
    pages = hashes.select(F.shiftright(bit, 15).alias("page"), bit.bitwiseAND(F.lit(32767)).cast("int").alias("bit"))

    def fill(group: pa.Table) -> pa.Table:
        page = np.zeros(32768, np.uint8)
        page[group.column("bit").to_numpy()] = 1
        data = np.packbits(page, bitorder="little").tobytes()
        return pa.table({"page": group.column("page").slice(0, 1), "data": pa.array([data], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in pages.distinct().groupBy("page").applyInArrow(fill, "page long, data binary").collect():  # 16 MB at most
        out[row.page * 4096 : row.page * 4096 + 4096] = np.frombuffer(row.data, np.uint8)
    return out


def build_filter(texts: DataFrame, pieces: DataFrame) -> Filter:
    """The driver gets two maps of bounded size and at most ``ANCHOR`` lengths."""
    seen = pieces.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("length")).alias("lengths")).first()
    if not seen.n:
        return Filter([], LEAST_BITS, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
    bits = min(MOST_BITS, max(LEAST_BITS, (seen.n * BITS_EACH - 1).bit_length()))
    least = min([n for n in seen.lengths if n >= 8], default=0)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                first, length = row["first"], row["length"]
                piece = row["plain"][first : first + (length if length < 8 else least)]
                out.append(int(np.uint64(anchor_hash(piece)).astype(np.int64)))
            yield pa.RecordBatch.from_pydict({"h": pa.array(out, pa.int64())})

    key = ["item_id", "item_key"]
    of = pieces.select(*[F.col(k).alias(f"p_{k}") for k in key], "first", "length")
    same = texts.item_id.eqNullSafe(of.p_item_id) & (texts.item_key == of.p_item_key)
    beginnings = of.join(texts, same).select("first", "length", "plain").mapInArrow(begin, "h long")
    return Filter(seen.lengths, bits, _bitmap(beginnings, bits), _bitmap(pieces.select(F.col("anchor").alias("h")), bits))


# --- documents --------------------------------------------------------------------


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))


def _found(docs: DataFrame, items: DataFrame, error_rate: float) -> DataFrame:
    """``doc_id, key, item_id, distance, end`` of ``doc_id, text``; ``key`` is the hash of the text."""
    texts, pieces = split_items(items, error_rate, "item_id", "text")
    places = build_filter(texts, pieces)
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                plain = [normalized(t) for t in some.column("text").to_pylist()]
                starts = np.cumsum([0] + [len(t) + 1 for t in plain])
                shown = np.zeros(len(plain), bool)
                # No piece has the byte between two texts.
                for at, hashes in places.places(b"\n".join(plain)):
                    text = np.searchsorted(starts, at, "right") - 1
                    # The text goes with the first hit in it.
                    first = np.zeros(len(text), bool)
                    first[np.unique(text, return_index=True)[1]] = True
                    first &= ~shown[text]
                    shown[text] = True
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column("doc_id").take(pa.array(text)),
                            some.column("key").take(pa.array(text)),
                            pa.array(at - starts[text], pa.int64()),
                            pa.array(hashes.view(np.int64)),
                            some.column("text").take(pa.array(text, mask=~first)),
                        ],
                        ["doc_id", "key", "at", "anchor", "text"],
                    )

    # Stored with the texts that have hits, so that no later step reads or shuffles the others.
    stored = materialize(rows.mapInArrow(search, "doc_id long, key long, at long, anchor long, text string"), "hits")
    salt = F.pmod("key", F.lit(SALTS)).cast("int").alias("salt")
    hits = stored.select("doc_id", "key", "at", "anchor", salt)
    # Where the whole item may lie if this piece of it is here.
    low = F.greatest(F.col("at") - F.col("first") - F.col("budget"), F.lit(0)).alias("low")
    high = (F.col("at") - F.col("first") + F.col("size") + F.col("budget")).alias("high")
    spots = hits.join(_salted(pieces), ["anchor", "salt"]).groupBy("doc_id", "key", "item_id", "item_key", "salt").agg(
        F.collect_set(F.struct(low, high)).alias("spots")
    )
    spots = materialize(spots, "spots")
    mine = _salted(texts).withColumnsRenamed({"item_id": "i", "item_key": "k", "salt": "s"})
    same = spots.item_id.eqNullSafe(mine.i) & (spots.item_key == mine.k) & (spots.salt == mine.s)
    wanted = spots.join(mine, same).groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("item_id", "plain", "budget", "spots")).alias("items")
    )
    wanted = wanted.withColumnsRenamed({"doc_id": "want_id", "key": "want_key"})
    # Of equal rows one is looked at.
    one = stored.where("text IS NOT NULL").groupBy("doc_id", "key").agg(F.first("text").alias("text"))
    asked = one.join(wanted, one.doc_id.eqNullSafe(wanted.want_id) & (one.key == wanted.want_key)).select("doc_id", "key", "text", "items")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "key", "item_id", "distance", "end"], [pa.int64()] * 3 + [pa.int32(), pa.int64()]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                plain = normalized(row["text"])
                for item in row["items"]:
                    best = least_distance(item["plain"], plain, item["budget"], [(s["low"], s["high"]) for s in item["spots"]])
                    if best:
                        out.append((row["doc_id"], row["key"], item["item_id"], *best))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return asked.mapInArrow(verify, "doc_id long, key long, item_id long, distance int, end long")


def least_distance(item: bytes, text: bytes, budget: int, spots: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The least distance within the budget and where the first such stretch ends, looking at ``spots`` alone."""
    windows: list[list[int]] = []
    for low, high in sorted(spots):
        if windows and low <= windows[-1][1]:
            windows[-1][1] = max(high, windows[-1][1])
        else:
            windows.append([low, high])
    best = None
    for low, high in windows:
        distance, end = nearest(item, text[low:high])
        if distance <= budget and (best is None or (distance, low + end) < best):
            best = distance, low + end
    return best


def matches(
    docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, item_id, distance, end``: the least distance of each item within its budget.

    ``end`` counts bytes of the normalised text.
    """
    found = _found(text_rows(docs, id_col, text_col), items, error_rate)
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end")).alias("m")).select("doc_id", "item_id", "m.*")


def clean(
    docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the contaminated rows."""
    found = _found(text_rows(docs, id_col, text_col), items, error_rate)
    bad = materialize(found.select(F.col("doc_id").alias("_bad_id"), F.col("key").alias("_bad_key")).distinct(), "contaminated")
    same = docs[id_col].cast("long").eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["_bad_key"])
    return docs.join(bad, same, "left_anti")
