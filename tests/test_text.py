from pyspark.sql import functions as F

from deckflow.functions import text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_base_name_and_type(spark):
    expected = {
        "Cours Annoté": ("cours", "lecture_annotated"),
        "COURS ANNOTÉ": ("cours", "lecture_annotated"),
        "CI TD": ("ci td", "td"),
        "CI TD Corrigé": ("ci td", "td_corrected"),
        "Keynotes": ("key", "lecture"),
        "Notes": ("", "lecture_annotated"),
        "X Slides": ("x", "lecture"),
        "X": ("x", "lecture"),
        "TDX": ("tdx", "lecture"),
        "TP 3 Solution": ("tp 3", "td_corrected"),
        "X TD Corrected Notes": ("x td corrected", "td_corrected"),
        "Exercices 2": ("exercices 2", "td"),
    }
    df = spark.createDataFrame([(s,) for s in expected], "stem string")
    got = df.select("stem", text.base_name(F.col("stem")), text.doc_type(F.col("stem"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == expected


def test_strip_removes_unicode_space_and_separators(spark):
    assert one(spark, text.strip(F.lit("\x1f \xa0 a b \t\r\n\x1c　"))) == "a b"


def test_subject_of_folder(spark):
    rows = {
        "/in/My_Course/Part_1": "My Course::Part 1",
        "/in": "told",
        "/in/": "told",
        "/in/./A": "A",
        "/other/Loose_End": "Loose End",
        "/inside/B": "B",
    }
    df = spark.createDataFrame([(s,) for s in rows], "folder string")
    got = df.select("folder", text.subject_of_folder(F.col("folder"), "/in/", F.lit("told"))).collect()
    assert dict(map(tuple, got)) == rows


def test_artifact_name_keeps_letters_of_all_scripts(spark):
    assert one(spark, text.artifact_name(F.lit(" Théorie::des  jeux (1) "))) == "Théoriedes_jeux_1.apkg"


def test_deck_name(spark):
    s, t = F.lit("S"), F.lit("T")
    assert one(spark, text.deck_name(s, t, F.lit("recall"))) == "S::T"
    assert one(spark, text.deck_name(s, t, F.lit("problem"))) == "S::T::Problems"
