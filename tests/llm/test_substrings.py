import hashlib
import random
import re

import numpy as np
import pytest
from samples import PROSE, fresh
from deckflow.llm import substrings


def brute(rows, size):
    """What is left of each document, as one pass in id order with all windows so far."""
    seen, out = set(), {}
    for doc, text in sorted({r for r in rows if r[0] is not None}):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def texts(seed, words, n, longest):
    """Shared passages, runs, periods and chance repeats over few words."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(words)]
    passages = [rng.choices(vocabulary, k=rng.randint(5, 60)) for _ in range(8)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                parts += rng.choice(passages)
            elif kind < 0.6:
                parts += [rng.choice(vocabulary)] * rng.randint(1, 50)
            elif kind < 0.7:
                parts += rng.choices(vocabulary, k=2) * rng.randint(1, 25)
            else:
                parts += rng.choices(vocabulary, k=rng.randint(1, longest))
        out.append((i * 3 % n, " ".join(parts)))
    return out


@pytest.mark.parametrize("seed, words, size", [(1, 2, 20), (2, 5, 20), (3, 500, 20), (4, 30, 7)])
def test_equals_brute_force(spark, seed, words, size):
    rows = texts(seed, words, 61, 40)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.removed(table, size).collect()}
    want = brute(rows, size)
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_frequent_names_take_another_way_to_the_same_rows(spark, monkeypatch):
    """A phrase amid different neighbours in every text, with all, some or no names frequent."""
    rng = random.Random(3)
    phrase = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join([f"a{i}", phrase[rng.randint(0, 40) :], f"b{i}", " ".join(f"c{rng.randint(0, 4)}" for _ in range(25))])) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parsed = substrings.text_rows(table).withColumn("key", substrings.F.xxhash64("text"))
    some = substrings.frequent_names(parsed)
    assert 0 < len(some) and (np.diff(some) > 0).all()
    monkeypatch.setattr(substrings, "FREQUENT", 1)
    every = substrings.frequent_names(parsed)
    assert len(every) > len(some)

    def windows(often):
        return {
            (r.doc_id, s)
            for r in substrings.repeated_windows(table, frequent=often).collect()
            for s in range(r.start, r.start + r.n)
        }

    none = windows(np.zeros(0, np.int64))
    assert none and windows(some) == none and windows(every) == none
    assert len(substrings.frequent_names(parsed.limit(0))) == 0


def test_equal_windows_have_equal_representatives():
    rng = random.Random(7)
    words = [w.encode() for w in rng.choices("abcdefgh", k=80)]
    for pad in range(1, 30):
        batch = substrings.Batch(np.array([1, 2]), np.array([5, 6]), np.array([0, 80, 80 + 2 * pad + 80]), words + [b"x"] * pad + words + [b"y"] * pad)
        start, name, offset = substrings.representatives(batch)
        here = {s: (n, o) for s, n, o in zip(start.tolist(), name.tolist(), offset.tolist())}
        for i in range(61):
            assert here[i] == here[80 + pad + i]


def test_rows_that_share_an_id(spark):
    """They are one document: the window that starts earlier stays, and a unique word always does."""
    common, size = [f"w{i}" for i in range(80)], 20
    a = " ".join([f"p{i}" for i in range(100)] + common)
    b = " ".join(common + [f"q{i}" for i in range(200)])
    c = " ".join(common + [f"r{i}" for i in range(60)])
    rows = [(7, a), (7, b), (9, c), (3, "x " * 30), (3, "y z " * 30), (3, "x " * 30)]
    rows += [(11, " ".join(common[k:] + [f"s{k}"] * 3)) for k in range(0, 40, 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_words, r.kept_sha256): r.n_removed for r in substrings.removed(table, size).collect()}
    key = {r.text: r.key for r in table.selectExpr("text", "xxhash64(text) AS key").collect()}
    places = {}
    for doc, text in set(rows):
        words = text.split()
        for i in range(len(words) - size + 1):
            places.setdefault(tuple(words[i : i + size]), []).append((doc, i, key[text]))
    want = {}
    for doc, text in set(rows):
        words = text.split()
        gone = set()
        for i in range(len(words) - size + 1):
            if min(places[tuple(words[i : i + size])]) != (doc, i, key[text]):
                gone |= set(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want[doc, len(words), hashlib.sha256(kept.encode()).hexdigest()] = len(gone)
    assert got == want
    assert want[7, 180, hashlib.sha256(" ".join(a.split()[:100]).encode()).hexdigest()] == 80


def test_edges(spark, edges):
    rows = {(r.doc_id, r.text) for r in edges.collect()}
    got = substrings.removed(edges, keep_text=True).collect()
    assert len(got) == edges.count()
    want = brute(rows, 20)
    for r in got:
        if r.doc_id is None:
            assert (r.n_words, r.n_removed, r.kept) == (len(PROSE.split()), 0, PROSE)
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    assert want[2][1] > 0 and want[8][1] == 0
    assert substrings.removed(edges.limit(0)).count() == 0


def test_one_passage_in_every_document(spark):
    rows = [(i, f"{fresh(i, 25)} {PROSE} {fresh(1000 + i, 25)}") for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.removed(table).collect()}
    assert got == brute(rows, 20)
