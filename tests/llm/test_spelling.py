import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from deckflow.llm import queries, spelling


def words(rows):
    """Counts of words of (doc_id, text)."""
    counts = Counter()
    for number, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and len(b) - len(a) < 2 and a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(counts, near):
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o))
        if counts[best] >= 5 * counts[word]:
            form[word] = best
    out = []
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        out.append((word, form.get(word), root, n, len(near.get(word, ())), counts.get(form.get(word))))
    return sorted(out)


def every_pair(counts):
    near = defaultdict(set)
    for a in counts:
        for b in counts:
            if one_edit(a, b):
                near[a].add(b)
    return near


def found(df):
    return sorted(map(tuple, df.collect()))


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("cell", [3, 1000])
def test_every_pair_of_crowded_words(spark, cell):
    """Few letters: cells are cut down to one place, pairs stand in runs of one letter."""
    some = random.Random(cell)
    counts = {"".join(some.choices("abé", k=some.randint(6, 9))): some.randint(5, 400) for _ in range(500)}
    counts |= {"a" * k: 5**k for k in range(6, 14)} | {"x" * 3000: 9, "x" * 3001: 90}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert key(found(spelling.variants(table, cell=cell))) == key(brute(counts, every_pair(counts)))


def test_chain_and_ties(spark):
    counts = {"horses": 1000, "hoarses": 100, "hoarsez": 20, "horsen": 1000, "horsey": 200, "lonely": 7}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = {r.word: r for r in spelling.variants(table).collect()}
    assert (rows["hoarsez"].form, rows["hoarsez"].root) == ("hoarses", "horses")
    assert rows["horsey"].form == "horsen"  # of two as frequent the first
    assert (rows["lonely"].form, rows["lonely"].root, rows["lonely"].n_near) == (None, "lonely", 0)


def test_edges(spark, edges):
    many = edges
    for _ in range(2):
        many = many.unionByName(many)
    counts = words((r.doc_id, r.text) for r in many.collect())
    assert counts
    got = found(spelling.variants(spelling.vocabulary(many)))
    assert key((g[0], g[3]) for g in got) == key(counts.items())
    assert spelling.variants(spelling.vocabulary(edges.limit(0))).count() == 0


def test_vocabulary(spark):
    rows = [(i % 3 or None, "Ünder the GREENISH leaves, été×÷ " * 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(map(tuple, spelling.vocabulary(docs).collect())) == words(rows)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = words((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in counts:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            if len(group) > 1:
                near[w] |= group - {w}
    assert key(found(queries.op11_spelling(spark, "/root/testdata/sf0.01"))) == key(brute(counts, near))
