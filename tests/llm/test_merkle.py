import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckflow.llm import merkle, queries
from deckflow.llm.common import remainder


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, k):
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([digest(*row[i : i + k]) for i in range(0, len(row), k)])
    return levels


def brute(rows, k=2):
    """Rows of (doc_id, source, lang, n_chars, text): what ``verify`` must return, by hashlib."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    groups = {g: sorted(groups[g], key=lambda r: r[:3]) for g in order}
    trees = {g: tree([r[2] for r in groups[g]], k) for g in order}
    top = tree([trees[g][-1][0] for g in order], k)
    out = []
    for place, g in enumerate(order):
        for at, (_, _, own, row) in enumerate(groups[g]):
            tampered = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node, siblings = leaf((*row[:3], row[3] + 1, row[4])) if tampered else own, []
            for levels, i in ((trees[g], at), (top, place)):
                for nodes in levels[:-1]:
                    run, slot = nodes[i - i % k : i - i % k + k], i % k
                    siblings += run[:slot] + run[slot + 1 :]
                    node, i = digest(*run[:slot], node, *run[slot + 1 :]), i // k
            root = top[-1][0]
            out.append((row[0], own, trees[g][-1][0], root, digest(*siblings), node, node == root))
    return out


def verified(docs, fanout=2, block=merkle.BLOCK):
    marked = merkle.leaves(docs, tampered=remainder("doc_id", 7) == 0)
    return sorted(map(tuple, merkle.verify(merkle.build(marked, fanout, block)).collect()), key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_states_are_those_of_sha256():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(7)]
    blocks = merkle.as_block(merkle.words(digests))
    state = np.repeat(merkle.START[:, None], 7, axis=1)
    for n in (1, 2, 3):
        state = merkle.absorb(state, blocks)
        want = b"".join(hashlib.sha256(d.hex().encode() * n).digest() for d in digests)
        assert merkle.as_bytes(merkle.finish(state, n)) == want


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_brute_force(spark, fanout):
    rows = [(i * 3 % 211, f"s{i}", [None, "en", "de", "é"][i % 7 % 4] if i else "lone", i or None, "é" * (i % 5)) for i in range(211)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert verified(docs, fanout, block=9) == sorted(brute(rows, fanout), key=str)


def test_edges(spark, edges):
    assert verified(edges) == sorted(brute(rows_of(edges)), key=str)
    assert verified(edges.limit(0)) == []
    one = edges.filter("doc_id = 7").withColumn("n_chars", F.lit(3).cast("long"))
    (only,) = verified(one)
    assert only[1:4] == (only[1],) * 3 and only[4] == digest("")


def test_a_third_of_the_rows_share_an_id(spark):
    rows = [(5 if i % 3 else i, "s", "en", 7, "same" if i % 2 else str(i)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert verified(docs) == sorted(brute(rows), key=str)


def test_query(spark):
    got = sorted(map(tuple, queries.op13_merkle(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == sorted(brute(rows_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))), key=str)
