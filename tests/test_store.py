import csv
import hashlib
import os
import random

from pyspark.sql import functions as F

from deckflow.functions import ids
from deckflow.operators import exports, store

CARDS = "subject string, theme string, ordinal int, question string, answer string, note string"


def plain_guid(deck, question):
    digest = hashlib.sha1("\x1f".join([deck.split("::")[0], deck, question]).encode()).digest()
    number, out = int.from_bytes(digest[:8], "big"), ""
    while number:
        number, digit = divmod(number, 62)
        out = ids.BASE62_DIGITS[digit] + out
    return out or "0"


def test_guid_equals_big_integer_arithmetic(spark):
    rng = random.Random(2)
    rows = [(f"S{rng.randint(0, 9)}::T é{k}", "".join(rng.choices("abcé ∑", k=rng.randint(1, 20)))) for k in range(500)]
    df = spark.createDataFrame(rows, "deck string, question string")
    for r in df.withColumn("guid", ids.stable_guid(F.col("deck"), F.col("question"))).collect():
        assert r.guid == plain_guid(r.deck, r.question)


def test_base62_of_extreme_numbers(spark):
    rows = [("0" * 16,), ("f" * 16,), ("000000000000003e",), ("0000000100000000",)]
    got = spark.createDataFrame(rows, "h string").select("h", ids.base62_of_hex64(F.col("h")).alias("x")).collect()
    for h, x in got:
        number, out = int(h, 16), ""
        while number:
            number, digit = divmod(number, 62)
            out = ids.BASE62_DIGITS[digit] + out
        assert x == (out or "0")


def test_checksum_and_deck_id(spark):
    q = "Étant donné une suite"
    row = spark.range(1).select(ids.checksum(F.lit(q)).alias("c"), ids.deck_id(F.lit("A::B")).alias("d")).first()
    assert row.c == int(hashlib.sha1(q[:9].encode()).hexdigest()[:8], 16)
    assert row.d == int.from_bytes(hashlib.sha1(b"A::B").digest()[:6], "big") | (1 << 47)


def cards(spark):
    recall = spark.createDataFrame(
        [
            ("S", "A", 0, " q1\t", "a1", None),
            ("S", "A", 1, "q1", "again", "n"),
            ("S", "A", 2, "q2", " \n", ""),
            ("S", "B", 0, "q1", "other deck", " note "),
            ("S", "B", 1, None, "a", ""),
            ("S", "B", 2, "q3", "a3", ""),
        ],
        CARDS,
    )
    problem = spark.createDataFrame([("S", "A", 0, "q1", "method", "")], CARDS)
    return store.union_cards(recall, problem)


def test_upsert_inserts_each_guid_once(spark):
    none = spark.createDataFrame([], "subject string, guid string")
    first = store.new_cards(cards(spark), none, F.col("ordinal"))
    got = {(r.deck, r.question): (r.answer, r.note) for r in first.collect()}
    assert got == {
        ("S::A", "q1"): ("a1", ""),
        ("S::B", "q1"): ("other deck", "note"),
        ("S::B", "q3"): ("a3", ""),
        ("S::A::Problems", "q1"): ("method", ""),
    }
    assert store.new_cards(cards(spark), first, F.col("ordinal")).count() == 0


def test_ids_continue_after_the_store(spark):
    none = spark.createDataFrame([], "subject string, guid string")
    fresh = store.new_cards(cards(spark), none, F.col("ordinal"))
    maxima = spark.createDataFrame([("S", 5000, 200_000, 7)], "subject string, max_nid bigint, max_cid bigint, max_due bigint")
    rows = store.assign_ids(fresh, maxima, F.lit(1000)).orderBy("nid").collect()
    assert [(r.deck, r.question) for r in rows] == [
        ("S::A", "q1"), ("S::A::Problems", "q1"), ("S::B", "q1"), ("S::B", "q3")
    ]
    assert [r.nid for r in rows] == [5001, 5002, 5003, 5004]
    assert [r.cid for r in rows] == [200_001, 200_002, 200_003, 200_004]
    assert [r.due for r in rows] == [8, 9, 10, 11]


def test_numbers_run_on_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(store, "NUMBER_RANGE", 10)
    rng = random.Random(4)
    rows = [(f"s{rng.randint(0, 1)}", f"d{rng.randint(0, 2)}", n) for n in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "subject string, deck string, ordinal int")
    got = store.numbered(df, "subject", "deck", "ordinal").collect()
    for s in ("s0", "s1"):
        expected = [(d, n) for t, d, n in sorted(rows) if t == s]
        mine = sorted((r.k, r.deck, r.ordinal) for r in got if r.subject == s)
        assert [r[0] for r in mine] == list(range(len(expected)))
        assert [(d, n) for _, d, n in mine] == expected


def test_snapshot_names_unknown_decks(spark):
    fresh = store.with_ids(store.valid_cards(cards(spark))).withColumns(
        {"nid": F.monotonically_increasing_id(), "cid": F.lit(1), "due": F.lit(1)}
    )
    decks = store.deck_table(spark.createDataFrame([("S::A",)], "deck string"))
    assert {(r.name, r.parent, r.depth) for r in decks.collect()} == {("S", None, 1), ("S::A", "S", 2)}
    snapshot = store.card_snapshot(store.as_notes(fresh, F.current_timestamp()), store.as_cards(fresh), decks)
    assert {r.deck for r in snapshot.collect()} == {"S::A", "Unknown"}


def test_existing_questions_are_complete(spark):
    rows = [("S", d, n, f"q{n}") for d in ("S::A", "S::A::Problems") for n in range(50, 0, -1)]
    df = spark.createDataFrame(rows, "subject string, deck string, nid bigint, question string")
    assert sorted((r.deck, r.nid) for r in store.existing_questions(df).collect()) == sorted((d, n) for _, d, n, _ in rows)


SNAPSHOT = "subject string, deck string, nid bigint, question string, answer string, note string"
ROWS = [
    ("S", "S::B", 3, "q3", "a3", ""),
    ("S", "S::A", 2, 'say "hi", ok', "two\nlines", "n2"),
    ("S", "S::A", 1, "q1", " # a1", None),
    ("T", "T::A", 9, "t", "u", ""),
]


def folder_text(path, subject):
    folder = os.path.join(path, f"subject={subject}")
    names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    return [open(os.path.join(folder, n), encoding="utf-8", newline="").read() for n in names]


def test_markdown_files_are_the_document(spark, tmp_path):
    path = str(tmp_path / "md")
    exports.write_markdown(spark.createDataFrame(ROWS, SNAPSHOT), path)
    assert "".join(folder_text(path, "S")) == (
        "# S\n\n## S::A\n\n**Q:** q1\n\n**A:**  # a1\n\n---\n\n"
        '**Q:** say "hi", ok\n\n**A:** two\nlines\n\n> n2\n\n---\n\n'
        "## S::B\n\n**Q:** q3\n\n**A:** a3\n\n---\n"
    )
    # Only the subjects of a later export are replaced.
    exports.write_markdown(spark.createDataFrame([("S", "S::C", 4, "q", "a", "")], SNAPSHOT), path)
    assert "".join(folder_text(path, "S")) == "# S\n\n## S::C\n\n**Q:** q\n\n**A:** a\n\n---\n"
    assert "".join(folder_text(path, "T")).startswith("# T\n")


def test_csv_reads_back(spark, tmp_path):
    path = str(tmp_path / "csv")
    exports.write_csv(spark.createDataFrame(ROWS, SNAPSHOT), path)
    rows = []
    for part in folder_text(path, "S"):
        read = list(csv.reader(part.splitlines(keepends=True)))
        assert read[0] == list(exports.CSV_COLUMNS)
        rows += read[1:]
    assert rows == [
        ["S::A", "q1", " # a1", ""],
        ["S::A", 'say "hi", ok', "two\nlines", "n2"],
        ["S::B", "q3", "a3", ""],
    ]
