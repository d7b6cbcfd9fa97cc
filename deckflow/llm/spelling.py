"""Spelling variants of a vocabulary by dynamic programming over sorted lists.

Words of the corpus are counted, and each word of the vocabulary finds all words at one
edit: one code point inserted, deleted or replaced.

Two such words, the shorter of ``m`` code points, agree up to their first difference and
from behind it on. So they meet in a *cell*: all words of ``m`` and ``m + 1`` code points
whose first difference may lie in one interval of places, with equal text before and after
that interval. The first cells have the two halves of the word as intervals; a cell with
more than ``CELL`` words is cut at the middle of its interval into two, until one place is
left, where a cell can hold no more words than twice the letters there are, and one. Every
word thus goes to four cells, or to a few more where words are crowded, and every pair is
found in one cell.

Within a cell the words are a sorted list. All its words walk that list at once: a row of
the edit matrix, of which the three values around the diagonal can matter, belongs to a
word and to a range of the list that shares a prefix. The longest common prefixes of
neighbours in the list say where a range falls apart at the next letter; a row computed
for a prefix is reused by all words that share it, and a range whose row has no value under
two is skipped with all words in it.

Defined cases: a null or empty text has no words; a null id counts as an empty one in the
hash; repeated rows count as often as they are there; a word of any length is handled
whole; ties for the most frequent near word go to the first in code-point order; an empty
table gives no rows; only ``doc_id`` and the text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckflow.llm.common import slices, text_rows
from deckflow.session import materialize, materialize_measured

MIN_LENGTH, MIN_COUNT, RATIO, MODULUS = 6, 5, 5, 199
#: Words of a cell beyond which it is cut.
CELL = 1000
#: Words, and characters of their matrix, that one numpy step works on.
STEP_WORDS, STEP_CHARS = 20_000, 4_000_000
#: Distinct words that a counting task holds before it hands them on.
HELD = 300_000

_CELL = ["m", "lo", "hi", "around"]


# --- words -----------------------------------------------------------------------


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of the words of enough length and count, stored. Tasks add up before the shuffle."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_length},}}")  # shorter runs have no word of enough length

    def flush(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())}
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        crc32 = zlib.crc32
        for batch in batches:
            for some in slices(batch):
                texts = some.column("text").cast(pa.binary()).to_pylist()
                for number, text in zip(some.column("doc_id").to_pylist(), texts):
                    if not text:
                        continue
                    prefix = crc32(f"{'' if number is None else number}:".encode())
                    # Lower-casing bytes changes A-Z only.
                    for run, n in Counter(runs.findall(text.lower().decode())).items():
                        h = crc32(run.encode(), prefix)
                        if h % MODULUS == 0:  # the contract's rare typing error
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < min_length:
                                continue
                        held[run] += n
                if len(held) > HELD:
                    yield flush(held)
                    held = Counter()
        if held:
            yield flush(held)

    counted = text_rows(docs, id_col, text_col).mapInArrow(count, "word string, n long")
    return materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), "vocabulary")


# --- cells -----------------------------------------------------------------------


def _in_cell(length: Column) -> dict[str, Column]:
    """What of a word stands around the interval ``lo`` to ``hi`` of its cell, and what within."""
    tail = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    return {
        "around": F.concat(
            F.substring("word", F.lit(1), F.col("lo")), F.lit("|"), F.substring("word", length - tail + 1, tail)
        ),
        "within": F.substring("word", F.col("lo") + 1, length - tail - F.col("lo")),
    }


def _halves(words: DataFrame, min_length: int) -> DataFrame:
    """Every word in the cells of pairs in which it is the shorter, or the longer."""
    length = F.length("word")
    shorter = F.explode(F.filter(F.array(length, length - 1), lambda m: m >= min_length)).alias("m")
    cells = words.select("word", "n", shorter).select(
        "*",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("lo"), F.expr("m div 2").cast("int").alias("hi")),
                F.struct(F.expr("m div 2").cast("int").alias("lo"), (F.col("m") + 1).alias("hi")),
            )
        ).alias("i"),
    )
    return cells.select("word", "n", "m", "i.lo", "i.hi").withColumns(_in_cell(length))


def _cut(cells: DataFrame) -> DataFrame:
    """The same words in cells of half the interval."""
    middle = F.expr("(lo + hi) div 2").cast("int")
    parts = F.array(
        F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi"))
    )
    again = cells.select("word", "n", "m", F.explode(parts).alias("i")).select("word", "n", "m", "i.lo", "i.hi")
    return again.withColumns(_in_cell(F.length("word")))


def cells(words: DataFrame, min_length: int = MIN_LENGTH, most: int = CELL) -> DataFrame:
    """``word, n, m, lo, hi, around, within``: cells of at most ``most`` words, or of one place."""
    done, rest, salts = None, materialize(_halves(words, min_length), "cells"), 16
    while True:
        sizes = rest.groupBy(*_CELL).agg(F.count("*").alias("size"))
        large = sizes.filter((F.col("size") > most) & (F.col("hi") - F.col("lo") > 1))
        large, seen = materialize_measured(large, "large_cells", n=F.count("*"))
        if not seen["n"]:
            return rest if done is None else done.unionByName(rest)
        # A large cell's rows are dealt over salts, as its key may hold a good part of all.
        salted = rest.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int"))
        marks = large.select(*_CELL, F.explode(F.array(*[F.lit(k) for k in range(salts)])).alias("salt"))
        keys = [*_CELL, "salt"]
        small = salted.join(marks, keys, "left_anti").select(rest.columns)
        done = small if done is None else done.unionByName(small)
        rest = materialize(_cut(salted.join(marks, keys, "left_semi")), "cells")


# --- sorted lists ------------------------------------------------------------------


def _ranges(cell: np.ndarray, letters: np.ndarray) -> list[np.ndarray]:
    """Where the sorted list falls apart: for each depth the first words of ranges that
    share a cell and so many letters, closed by the length of the list."""
    n, width = letters.shape
    differ = np.ones((n, width + 1), bool)
    differ[1:, 0] = cell[1:] != cell[:-1]
    differ[1:, 1:] = letters[1:] != letters[:-1]
    apart = np.logical_or.accumulate(differ, axis=1)  # the common prefix is shorter than the depth
    return [np.append(np.flatnonzero(apart[:, d]), n) for d in range(width + 1)]


def near_pairs(cell: np.ndarray, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of one cell at one edit. Rows are sorted by cell and letters.

    ``letters`` are code points, zero behind a word; ``lengths`` are ``m`` or ``m + 1``
    for the width ``m + 1``. Pairs of two words of ``m + 1`` belong to another cell.
    """
    n, width = letters.shape
    starts = _ranges(cell, letters)
    padded = np.zeros((n, width + 2), letters.dtype)
    padded[:, :width] = letters
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # Row 0 of every word at the range of its cell: the places before, on and behind the diagonal.
    query = np.arange(n)
    node = np.searchsorted(starts[0], query, "right") - 1
    far = np.int8(2)
    before, on, behind = np.full(n, far), np.zeros(n, np.int8), np.ones(n, np.int8)
    for depth in range(width):
        low, high = starts[depth], starts[depth + 1]
        # The ranges of the next letter within each range, and the row of the word for each.
        first = np.searchsorted(high, low[node], "left")
        many = np.searchsorted(high, low[node + 1], "left") - first
        source = np.repeat(np.arange(len(query)), many)
        child = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many) + first[source]
        q = query[source]
        ahead = high[child + 1] - 1 > q  # only words behind this one in the list
        source, child, q = source[ahead], child[ahead], q[ahead]
        letter = padded[high[child], depth]
        b, o, f = before[source], on[source], behind[source]
        miss = lambda k: (padded[q, depth + k] != letter).astype(np.int8)
        left = np.minimum(o + 1, b + miss(-1)) if depth else np.minimum(o + 1, far)
        same = np.minimum(np.minimum(f + 1, o + miss(0)), left + 1)
        right = np.minimum(f + miss(1), same + 1)
        # A word that ends here: the place of the whole other word in the row before.
        ends = letter == 0
        if ends.any():
            longer = lengths[q[ends]] - depth  # 0 or 1 more than the depth
            value = np.where(longer == 0, o[ends], np.where(longer == 1, f[ends], far))
            hit = value == 1
            found.append((q[ends][hit], high[child[ends][hit]]))
        going = ~ends & (np.minimum(np.minimum(left, same), right) < 2)
        query, node = q[going], child[going]
        before, on, behind = (np.minimum(x[going], far) for x in (left, same, right))
    # Words of the full width end here; the other one then is shorter.
    value = np.where(lengths[query] == width - 1, before, far)
    hit = value == 1
    found.append((query[hit], starts[width][node[hit]]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _code_points(texts: list[str], width: int) -> np.ndarray:
    data = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le"), "<u4")
    return data.reshape(len(texts), width).astype(np.uint16 if data.max(initial=0) < 1 << 16 else np.uint32)


def _near(rows: list[tuple]) -> pa.RecordBatch:
    """Whole cells of one ``m`` and interval width, sorted: each word's near words in them, added up."""
    keys, words, counts, within, first, last = zip(*rows)
    width = last[0] - first[0] + (1 if last[0] <= keys[0][0] else 0)
    lengths = np.fromiter(map(len, within), np.int64, len(within))
    cell = np.cumsum(np.fromiter((a != b for a, b in zip(keys, (None, *keys))), np.int64, len(keys)))
    letters = _code_points(within, width)
    i, j = near_pairs(cell, letters, lengths)
    # The first difference must lie in the interval: otherwise the pair is another cell's.
    shared = np.logical_and.accumulate(letters[i] == letters[j], axis=1).sum(axis=1)
    mine = shared < last[0] - first[0]
    i, j = np.concatenate([i[mine], j[mine]]), np.concatenate([j[mine], i[mine]])
    n = np.array(counts, np.int64)
    place = np.empty(len(words), np.int64)
    place[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    order = np.lexsort((place[j], -n[j], i))
    i, j = i[order], j[order]
    targets, at, near = np.unique(i, return_index=True, return_counts=True)
    best = j[at]
    return pa.RecordBatch.from_pydict(
        {
            "word": pa.array([words[t] for t in targets], pa.string()),
            "n_near": near.astype(np.int64),
            "form_n": n[best],
            "form": pa.array([words[b] for b in best], pa.string()),
        }
    )


def neighbours(crowds: DataFrame) -> DataFrame:
    """``word, n_near, form_n, form``: near words of every word that has any, and the most frequent."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kind = last = None
        for batch in batches:
            m, lo, hi, around, within, word, n = (c.to_pylist() for c in batch.columns)
            for key, w, t, k in zip(zip(m, lo, hi, around), word, within, n):
                if key != last and held:
                    # Cells of one shape go together, up to a bound of the matrix.
                    if key[:3] != kind or len(held) > STEP_WORDS or len(held) * (key[2] - key[1]) > STEP_CHARS:
                        yield _near(held)
                        held = []
                kind, last = key[:3], key
                held.append((key, w, k, t, key[1], key[2]))
        if held:
            yield _near(held)

    keyed = crowds.select(*_CELL, "within", "word", "n").repartition(*_CELL).sortWithinPartitions(*_CELL, "within")
    part = keyed.mapInArrow(rows, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form"
    )


def _followed(forms: DataFrame) -> DataFrame:
    """``word, root``: the last form of each word that has one, by doubling what each has followed.

    Forms grow in count, so chains end; rounds are the logarithm of the longest.
    """
    step = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = step.join(further, "root", "left")
        step, seen = materialize_measured(
            joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")),
            "roots",
            went=F.max("went"),
        )
        step = step.drop("went")
        if not seen["went"]:
            return step


def variants(words: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH, cell: int = CELL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of a vocabulary (``word, n``, distinct).

    ``form`` is the near word of the highest count, if that is at least ``ratio`` times the
    word's; ``root`` is where the forms lead.
    """
    near = neighbours(cells(words, min_length, cell))
    is_form = F.col("form_n") >= ratio * F.col("n")
    joined = materialize(
        words.join(near, "word", "left").select(
            "word",
            F.when(is_form, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _followed(joined.filter("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def oracle_sql(min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, modulus: int = MODULUS) -> str:
    """The same in DuckDB's SQL: pairs meet in the texts that one deletion leaves."""
    return rf"""
WITH RECURSIVE shifts AS (SELECT b AS start, b::BIGINT AS c, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT start, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM shifts WHERE k < 8),
crc AS (SELECT list(c ORDER BY start) AS t FROM shifts WHERE k = 8),
found AS (SELECT coalesce(doc_id::VARCHAR, '') AS d,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM documents),
runs AS (SELECT d, run, count(*) AS n FROM found WHERE length(run) >= {min_length} GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(0, octet_length(encode(d || ':' || run))), lambda k: ('0x' || substr(hex(encode(d || ':' || run)), 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {modulus} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {min_length} GROUP BY word HAVING sum(n) >= {min_count}),
cut AS (SELECT word, n, substr(word, 1, k - 1) || substr(word, k + 1) AS rest, k FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'form': other}}) AS b FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -b.less >= {ratio} * w.n THEN b.form END AS form, CASE WHEN -b.less >= {ratio} * w.n THEN -b.less END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM forms
  UNION ALL SELECT c.word, f.form, c.k + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word) r USING (word)"""
