import random

import pytest
from compare import difference
from samples import PROSE, fresh
from deckflow.llm import licenses


def oracle(docs, **kw):
    import duckdb

    con = duckdb.connect()
    table = docs.select("doc_id", "text").toPandas()
    table["doc_id"] = table.doc_id.astype("Int64")
    con.register("documents", table)
    return con.execute(licenses.oracle_sql(**kw)).df()


@pytest.mark.parametrize("threshold", [0.6, 0.85, 1.0])
def test_equals_every_block_against_every_template(spark, threshold):
    rng = random.Random(8)
    docs = []
    for i in range(150):
        lines = [PROSE] * rng.randint(0, 2)
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            kept = [w.upper() if rng.random() < 0.2 else w for w in words if rng.random() < 0.9]
            lines.append(rng.choice([" ", "  -- ", "\n", "\n# "]).join(kept + rng.choices(PROSE.split(), k=rng.randint(0, 3))))
        docs.append((i, "\n".join(lines)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = licenses.scan(table, threshold=threshold).toPandas()
    assert len(set(got.labels)) > 5 and difference(got, oracle(table, threshold=threshold)) is None


def test_phrases(spark):
    texts = ["CC-BY cc by", "xcc by", "all  RIGHTS\nreserved all rights reserved", "General Public Licenses", "éCC BY", "cc", "general public license cc by"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(table).collect()}
    assert rows == {
        0: (4, 2, 0, 2, "cc-by"), 1: (2, 0, None, None, ""), 2: (6, 2, 0, 3, "reserved"), 3: (3, 0, None, None, ""),
        4: (2, 0, None, None, ""), 5: (1, 0, None, None, ""), 6: (5, 2, 0, 3, "cc-by,gpl"),
    }


def test_edges(spark, edges):
    got = licenses.scan(edges).toPandas()
    assert len(got) == edges.count() and difference(got.astype({"doc_id": "Int64"}), oracle(edges)) is None
    assert licenses.scan(edges.limit(0)).count() == 0


def test_main_path_is_native(spark, edges):
    plan = licenses.scan(edges)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("template", licenses.TEMPLATES)
def test_wrapped_templates_are_found(spark, template):
    import textwrap

    label, text = template
    wraps = [textwrap.fill(f"{lead} {text}.", 70, initial_indent=mark, subsequent_indent=mark) for lead in ("See below.", "w " * 30) for mark in ("", " * ", "# ")]
    halves = text.split()
    far = " ".join(halves[: len(halves) // 2]) + "\n" + "pad " * 60 + "\n" + " ".join(halves[len(halves) // 2 :])
    narrow = textwrap.fill(text, 20)
    table = spark.createDataFrame(list(enumerate([*wraps, narrow, far])), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(table).collect()}
    for i in range(len(wraps) + 1):
        assert label in rows[i].labels.split(",") and rows[i].score == 1.0
    assert rows[len(wraps) + 1].score < 1.0
    assert difference(licenses.scan(table).toPandas(), oracle(table)) is None


def test_words_far_apart_are_no_notice(spark):
    """Neither in one long line nor over lines; and without its rarest words a notice may still be one."""
    far = "Released goods " + fresh(1, 500) + " under everything the " + fresh(2, 500) + " mit license"
    near = "Licensed under the Apache License, Version 2.0"
    long = fresh(3, 3000).replace(" ", "\n", 40) + " " + near + " " + fresh(4, 3000)
    spread = " w ".join(near.split())
    table = spark.createDataFrame(list(enumerate([far, near, long, spread])), "doc_id long, text string")
    rows = {r.doc_id: (r.labels, r.score) for r in licenses.scan(table).collect()}
    assert rows == {0: ("", 0.0), 1: ("apache-2.0", 1.0), 2: ("apache-2.0", 1.0), 3: ("", 0.0)}
