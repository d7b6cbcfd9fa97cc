"""Removal of repeated word windows, by recompression.

Every text is parsed alike in rounds: first runs of one word, then, again and again, pairs
of neighbours become one symbol. Which neighbours pair is decided by a coin of each
symbol's name, and a name is a hash of what it stands for, so equal stretches get equal
symbols in all texts, but for a margin at their ends that depends on what stands beside
them. For a window of ``size`` words the parse knows which symbols depend on nothing
outside the window. Of those, the window is represented by one of the highest round: the
longest, then by name. Equal windows have equal representatives at equal places.

Spark brings equal representatives together. What all the windows of a representative
cover is its region. A region that occurs earlier settles all its windows in one row, and
representatives with a single region are unique. Only where one name has different
regions, at the ends of a repeat or by chance, the windows of their first occurrences are
verified one by one, by digests of their words.

A task drops regions (and windows) that it has itself seen earlier. Names that stand often in
a sample of documents (a phrase that a third of all texts hold amid different neighbours) do
not gather in one place: their rows pass through the first shuffle spread by their places, and
what is asked of them is aggregated before it is shuffled. The sample decides on the way
alone; both ways give the same rows.

Defined cases: a null or empty text has no words (digest of the empty string); texts
shorter than a window lose nothing, and very long ones are parsed whole; rows without id
lose nothing and are not searched; rows that share an id are told apart by their text, of
two windows with one start in them the one of the lesser hash of its text is the earlier,
and equal rows are one document; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckflow.llm.common import WORD_HASHES, mixed, slices, text_rows
from deckflow.session import materialize

SIZE = 20
#: One of runs, the others of pairs.
ROUNDS = 4
#: Documents looked at for frequent names, how often a name stands in them to count as frequent,
#: and how many names take the way of the frequent at most (those beyond go with the others).
SAMPLE_ROWS = 4_000
FREQUENT = 8
FREQUENT_NAMES = 10_000


@dataclass
class Batch:
    """The words of some texts in a row, in the order of their ids."""

    docs: np.ndarray  # id of each text
    keys: np.ndarray  # hash of each text
    first: np.ndarray  # where each text starts, and the end
    words: list[bytes]

    @classmethod
    def of(cls, ids: list[int], keys: list[int], texts: list[str | None]) -> Batch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i], keys[i]))
        split = [(texts[i] or "").encode().split() for i in order]
        first = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        docs, hashes = (np.array([of[i] for i in order], np.int64) for of in (ids, keys))
        return cls(docs, hashes, first, [w for ws in split for w in ws])

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with a space behind each, and where each starts (and the end)."""
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)
        return b" ".join(self.words), np.concatenate([[0], ends])


def representatives(batch: Batch, size: int = SIZE, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """``start, name, offset`` of every window: its first word, its symbol and where in the window that starts."""
    n = len(batch.words)
    lengths = np.diff(batch.first)
    text = np.repeat(np.arange(len(lengths)), lengths)
    ends = batch.first[1:][text] if n else np.zeros(0, np.int64)
    start = np.flatnonzero(np.arange(n) + size <= ends)
    names = WORD_HASHES.of(batch.words)
    at, long = np.arange(n), np.ones(n, np.int64)
    low, high = start.astype(np.int32), (start + size - 1).astype(np.int32)
    live = np.arange(len(start))
    best_name, best_at = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)

    def choose(which: np.ndarray, round_: int) -> None:
        # The longest symbol, then the one with the largest scrambled name, then the leftmost.
        if not which.any():
            return
        of, a, b = live[which], low[which], high[which]
        score = (long.astype(np.uint64) << np.uint64(44)) | (mixed(names, names, 99) >> np.uint64(20))
        pick, top = a.copy(), score[a]
        more = np.arange(len(a))
        for k in range(1, int((b - a).max()) + 1):
            more = more[a[more] + k <= b[more]]
            other = score[a[more] + k]
            better = other > top[more]
            where = more[better]
            pick[where] = a[where] + k
            top[where] = other[better]
        best_name[of] = mixed(names[pick], long[pick].astype(np.uint64), round_)
        best_at[of] = at[pick]

    for round_ in range(1, rounds + 1):
        if not len(live):
            break
        same = text[1:] == text[:-1]
        if round_ == 1:
            new = np.concatenate([[True], ~same | (names[1:] != names[:-1])])
            to = np.cumsum(new, dtype=np.int32) - 1
            # What touches an end of the window may go on outside.
            inner_low, inner_high = to[low] + 1, to[high] - 1
            keep = np.flatnonzero(new)
            runs = np.diff(np.append(keep, len(names)))
            renamed = np.where(runs > 1, mixed(names[keep], runs.astype(np.uint64), 0), names[keep])
        else:
            coin = mixed(names, names, 1000 + round_) >> np.uint64(63) == 1
            joins = np.append(~coin[:-1] & coin[1:] & same, False)
            new = np.concatenate([[True], ~joins[:-1]])
            to = np.cumsum(new, dtype=np.int32) - 1
            # A symbol with coin 1 may pair to its left, one with coin 0 to its right.
            inner_low, inner_high = to[low] + coin[low], to[high] - ~coin[high]
            keep = np.flatnonzero(new)
            renamed = np.where(joins, mixed(names, np.append(names[1:], names[:1]), round_), names)[keep]
        inside = inner_low <= inner_high
        choose(~inside, round_ - 1)
        low, high, live = inner_low[inside], inner_high[inside], live[inside]
        names, long = renamed, np.add.reduceat(long, keep)
        at, text = at[keep], text[keep]
    choose(np.ones(len(live), bool), rounds)
    return start, best_name, best_at - start


def regions(batch: Batch, size: int = SIZE) -> dict[str, np.ndarray]:
    """Neighbouring windows with one representative: its name, the place, and a digest of all their words."""
    start, name, offset = representatives(batch, size)
    if not len(start):
        none = np.zeros(0, np.int64)
        return {"name": none, "region": none, "doc_id": none, "key": none, "start": none, "n": none}
    text = np.searchsorted(batch.first, start, "right") - 1
    place = start + offset
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(start)))
    joined, byte = batch.joined()
    spans = zip(byte[start[at]].tolist(), (byte[start[at] + n + size - 1] - 1).tolist(), (offset[at] * size + n).tolist())
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    region = np.fromiter((digest(view[a:b], seed) for a, b, seed in spans), np.uint64, len(at))
    return {
        "name": name[at].view(np.int64),
        "region": region.view(np.int64),
        "doc_id": batch.docs[text[at]],
        "key": batch.keys[text[at]],
        "start": start[at] - batch.first[text[at]],
        "n": n,
    }


def _repeats(what: np.ndarray, doc: np.ndarray, start: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where the same stands earlier in another place; the rows are in order but within an id."""
    order = slice(None)
    if len(doc) and (key[1:] != key[:-1])[doc[1:] == doc[:-1]].any():  # texts that share an id
        order = np.lexsort((key, start, doc))
    _, first, inverse = np.unique(what[order], return_index=True, return_inverse=True)
    if isinstance(order, slice):
        earliest = first[inverse]
    else:
        earliest = np.empty(len(doc), np.int64)
        earliest[order] = order[first[inverse]]
    return (doc[earliest] != doc) | (start[earliest] != start) | (key[earliest] != key)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    for batch in batches:
        for some in slices(batch):
            yield some, Batch.of(*(some.column(c).to_pylist() for c in ("doc_id", "key", "text")))


def frequent_names(rows: DataFrame, size: int = SIZE, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Names that many documents hold, in ascending order; at most ``FREQUENT_NAMES``."""
    n = rows.count()
    share = min(1.0, sample_rows / n) if n else 1.0

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in _batches(batches):
            # Copies and repeats of a passage count once a slice, as they are settled there.
            got = regions(batch, size)
            pairs = np.unique(np.stack([got["name"].view(np.int64), got["region"].view(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0])], ["name"])

    counted = rows.sample(share, 7).mapInArrow(parse, "name long").groupBy("name").agg(F.count("*").alias("n"))
    often = counted.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "name").limit(FREQUENT_NAMES).collect()
    return np.array(sorted(r["name"] for r in often), np.int64)


def repeated_windows(
    docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", frequent: np.ndarray | None = None
) -> DataFrame:
    """``doc_id, key, start, n``: the ``n`` windows from word ``start`` on stand earlier as well.

    ``key`` is the hash of the text. ``frequent`` are names in ascending order, those of
    ``frequent_names`` unless given.
    """
    rows = text_rows(docs, id_col, text_col).filter("doc_id is not null").withColumn("key", F.xxhash64("text"))
    often = frequent_names(rows, size) if frequent is None else frequent

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in _batches(batches):
            got = regions(batch, size)
            name = got["name"].view(np.int64)
            both = mixed(got["name"].view(np.uint64), got["region"].view(np.uint64), 5)
            known = _repeats(both, got["doc_id"], got["start"], got["key"])
            hot = np.isin(name, often) & ~known
            # What is settled here, or elsewhere, only passes through the shuffle, spread by its place.
            spread = mixed(got["doc_id"].view(np.uint64), (got["start"] >> 6).view(np.uint64), 6).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(known | hot, spread, name)),
                    pa.array(np.where(known, 0, got["region"])),
                    pa.array(got["doc_id"]),
                    pa.array(got["key"]),
                    pa.array(got["start"].astype(np.int32)),
                    pa.array(got["n"].astype(np.int16)),
                    pa.array(known),
                    pa.array(name, mask=~hot),
                ],
                ["name", "region", "doc_id", "key", "start", "n", "known", "hot"],
            )

    fields = "name long, region long, doc_id long, key long, start int, n short, known boolean, hot long"
    found = rows.mapInArrow(parse, fields)
    by_name, by_region = Window.partitionBy("name"), Window.partitionBy("name", "region")
    place = F.struct("doc_id", "start", "key")
    told = (
        found.withColumn("one", F.min("region").over(by_name) == F.max("region").over(by_name))
        .withColumn("again", F.col("known") | (F.min(place).over(by_region) != place))
        .filter("again or not one or hot is not null")
    )
    region = F.when(F.col("hot").isNotNull(), F.col("region")).alias("region")
    told = materialize(told.select("doc_id", "key", "start", "n", "again", "hot", region), "regions")
    hot = told.filter("hot is not null").drop("again")
    firsts = hot.groupBy("hot", "region").agg(F.min(place).alias("first"))
    # One row for each of at most FREQUENT_NAMES names.
    several = firsts.groupBy("hot").agg((F.min("region") != F.max("region")).alias("several"))
    settled = (
        hot.join(firsts, ["hot", "region"])
        .join(F.broadcast(several), "hot")
        .withColumn("again", F.col("first") != place)
        .filter("again or several")
        .select("doc_id", "key", "start", "n", "again")
    )
    told = told.filter("hot is null").select(settled.columns).unionByName(materialize(settled, "frequent_regions"))
    ask = told.filter("not again").groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n")).alias("ask"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, batch in _batches(batches):
            asked = dict(zip(zip(some.column("doc_id").to_pylist(), some.column("key").to_pylist()), some.column("ask").to_pylist()))
            starts, of = [], []
            for i, doc in enumerate(zip(batch.docs.tolist(), batch.keys.tolist())):
                last = int(batch.first[i + 1] - batch.first[i]) - size
                own = sorted({s for r in asked[doc] for s in range(r["start"], r["start"] + r["n"]) if s <= last})
                starts += own
                of += [i] * len(own)
            start, of = np.array(starts, np.int64), np.array(of, np.int64)
            joined, byte = batch.joined()
            at = batch.first[of] + start if len(start) else start
            view, digest = memoryview(joined), xxhash.xxh3_128_digest
            keys = [digest(view[a:b]) for a, b in zip(byte[at].tolist(), (byte[at + size] - 1).tolist())]
            doc, key = (batch.docs[of], batch.keys[of]) if len(of) else (of, of)
            known = _repeats(np.array(keys, "S16"), doc, start, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(doc), pa.array(key), pa.array(start.astype(np.int32)), pa.array(known)],
                ["window", "doc_id", "key", "start", "known"],
            )

    checked = materialize(
        rows.join(ask, ["doc_id", "key"]).mapInArrow(verify, "window binary, doc_id long, key long, start int, known boolean"),
        "windows",
    )
    open_ = checked.filter("not known")
    first = open_.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    again = open_.join(first.select("window", "first"), "window").filter(place != F.col("first"))
    single = again.select("doc_id", "key", "start").unionByName(checked.filter("known").select("doc_id", "key", "start"))
    return told.filter("again").select("doc_id", "key", "start", "n").unionByName(
        single.select("doc_id", "key", "start", F.lit(1).cast("short").alias("n"))
    )


def kept_words(words: list[bytes], ranges: list[dict], size: int = SIZE) -> list[bytes]:
    """The words that no range of repeated windows covers."""
    edge = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        if r["start"] < len(words):
            edge[r["start"]] += 1
            edge[min(r["start"] + r["n"] - 1 + size, len(words))] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return words if len(kept) == len(words) else [words[i] for i in kept.tolist()]


def removed(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``, and with ``keep_text`` the ``kept`` words as a text."""
    ranges = (
        repeated_windows(docs, size, id_col, text_col)
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("start", "n")).alias("ranges"))
    )
    rows = text_rows(docs, id_col, text_col).withColumn("key", F.xxhash64("text")).join(ranges, ["doc_id", "key"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                total, gone, digests, texts = [], [], [], []
                for text, of in zip(some.column("text").to_pylist(), some.column("ranges").to_pylist()):
                    words = (text or "").encode().split()
                    kept = kept_words(words, of or [], size)
                    left = b" ".join(kept)
                    total.append(len(words))
                    gone.append(len(words) - len(kept))
                    digests.append(hashlib.sha256(left).hexdigest())
                    texts.append(left.decode() if keep_text else "")
                columns = [some.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return rows.mapInArrow(cut, fields + ", kept string" * keep_text)


def oracle_sql(size: int = SIZE) -> str:
    """The same in DuckDB's SQL: every window of every text."""
    return rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {size - 1}], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM texts)),
firsts AS (SELECT k, min((doc_id, i)) AS f FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {size})) AS i
  FROM windows JOIN firsts USING (k) WHERE (doc_id, i) <> f),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM texts) ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)"""
