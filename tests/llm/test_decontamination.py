import random

from pyspark.sql import functions as F
from samples import PROSE, fresh
from deckflow.llm import decontamination as d


def brute(pattern, text):
    column, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for j, c in enumerate(text, 1):
        new = [0]
        for i in range(1, len(pattern) + 1):
            new.append(min(new[-1] + 1, column[i] + 1, column[i - 1] + (pattern[i - 1] != c)))
        column = new
        best = min(best, (column[-1], j))
    return best


def test_distance_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        pattern = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 90)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 130)))
        assert d.nearest(pattern, text) == brute(pattern, text)


def test_planted_items_are_found_as_by_brute_force(spark):
    rng = random.Random(6)
    items = [(i, fresh(50 + i, 20 + 5 * i)) for i in range(6)]
    docs = [(0, PROSE), (1, None), (2, "")]
    for n in range(40):
        _, item = items[n % 6]
        letters = list(item)
        for _ in range(rng.randint(0, len(item) // 12)):
            at = rng.randrange(len(letters))
            letters[at : at + 1] = rng.choice([[], ["q"], [letters[at], "q"]])
        docs.append((10 + n, f"{fresh(n, 15)} {''.join(letters).upper()}!? {fresh(90 + n, 15)}"))
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for doc, text in docs:
        for i, item in items:
            p = d.normalized(item)
            distance, end = brute(p, d.normalized(text))
            if distance <= int(len(p) * d.ERROR_RATE):
                want.add((doc, i, distance, end))
    assert 10 < len(want) < 40
    assert {tuple(r) for r in d.matches(table, bench).collect()} == want
    bad = {w[0] for w in want}
    assert {r.doc_id for r in d.clean(table, bench).collect()} == {x for x, _ in docs} - bad


def test_every_length_of_items(spark):
    """Items of one letter to many, over texts longer than one numpy step; all places count."""
    rng = random.Random(4)
    letters = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    items = [(n, letters[40 * n : 40 * n + n]) for n in range(1, 40)] + [(99, letters[500:1400])]
    step = d.STEP_BYTES
    long = fresh(1, step // 6)[: step - 20] + " " + letters[500:1390] + "zz" + fresh(2, 2000)
    docs = [(1, letters), (2, letters[::-1]), (3, long), (4, "b"), (5, letters[700:])]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in d.matches(table, bench).collect()}
    want = set()
    for doc, text in docs:
        plain = d.normalized(text)
        for i, item in items:
            p = d.normalized(item)
            distance, end = d.nearest(p, plain) if p else (1, 0)
            if distance <= int(len(p) * d.ERROR_RATE):
                want.add((doc, i, distance, end))
    assert got == want and (3, 99) in {g[:2] for g in got}


def test_a_large_benchmark(spark):
    """Some megabytes of items: no step of the driver or of a task grows with them but the maps of bits."""
    items = spark.range(20_000).select(
        F.col("id").alias("item_id"),
        F.concat_ws(" ", *[F.md5(F.concat("id", F.lit(f"-{k}"))) for k in range(6)]).alias("text"),
    )
    docs = items.filter("item_id % 50 = 0").select(
        (F.col("item_id") + 7).alias("doc_id"), F.concat(F.lit("before "), F.translate("text", "abc", "ABC"), F.lit("! after")).alias("text")
    )
    clean = spark.range(300).select((-F.col("id") - 1).alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    got = d.matches(docs.unionByName(clean), items).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == {(n + 7, n, 0) for n in range(0, 20_000, 50)}


def test_only_the_contaminated_row_of_an_id_goes(spark):
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    docs = spark.createDataFrame([(1, PROSE), (1, fresh(1, 30)), (None, PROSE), (None, fresh(2, 30))], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in d.clean(docs, bench).collect()} == {(1, fresh(1, 30)), (None, fresh(2, 30))}


def test_edges(spark, edges):
    items = spark.createDataFrame([(5, PROSE), (5, PROSE), (6, None)], "item_id long, text string")
    assert {r.doc_id for r in d.matches(edges, items).collect()} == {1, 2, 6, None}
    left = d.clean(edges, items)
    assert left.columns == edges.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "5", "7", "8", "8"]
    assert d.matches(edges.limit(0), items).count() == 0 and d.matches(edges, items.limit(0)).count() == 0
    assert d.clean(edges, items.limit(0)).count() == edges.count()


def test_texts_without_hits_go_no_further(spark, monkeypatch):
    """The documents are read once; what is stored and shuffled after are the texts with hits, once each."""
    made, store = {}, d.materialize
    monkeypatch.setattr(d, "materialize", lambda df, name: made.setdefault(name, store(df, name)))
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    docs = [(n, fresh(n, 40)) for n in range(30)] + [(90, PROSE), (91, fresh(1, 30) + " " + PROSE + " " + PROSE)]
    found = d.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {r.doc_id for r in found.collect()} == {90, 91}
    assert sorted(r.doc_id for r in made["hits"].where("text IS NOT NULL").collect()) == [90, 91]
