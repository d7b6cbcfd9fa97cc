from pyspark.sql import functions as F

from deckflow.operators import grouping, ledger
from deckflow.sources.files import with_path_parts


def test_pending_reasons(spark):
    files = spark.createDataFrame(
        [(p, "h") for p in ("same", "changed", "lost", "bare", "new", "empty")], "path string, sha256 string"
    )
    known = spark.createDataFrame(
        [("same", "h", "here"), ("changed", "old", "here"), ("lost", "h", "gone"), ("bare", "h", None), ("empty", "h", "")],
        "path string, sha256 string, artifact string",
    )
    present = spark.createDataFrame([("here",)], "artifact string")
    got = ledger.pending_files(files, known, present)
    assert {r.path: r.reason for r in got.collect()} == {
        "changed": "changed", "lost": "artifact_missing", "new": "new"
    }


def test_commit_gate(spark):
    members = spark.createDataFrame(
        [(s, f"/{s}", "h", ["t"]) for s in ("ok", "failed", "partly", "nothing", "skipped")],
        "subject string, path string, sha256 string, themes array<string>",
    )
    outcome = spark.createDataFrame(
        [("ok", 3, False), ("failed", 0, True), ("partly", 1, True), ("nothing", 0, False)],
        "subject string, total_added bigint, had_error boolean",
    )
    got = ledger.committable(members, outcome, F.concat("subject", F.lit(".apkg")))
    assert {r.path: r.artifact for r in got.collect()} == {
        "/ok": "ok.apkg", "/partly": "partly.apkg", "/nothing": None
    }


def test_newest_entry_wins(spark):
    log = spark.createDataFrame(
        [("a", "1", ["x"], None, 1), ("a", "2", ["y"], "f", 2), ("b", "3", [], None, 1)], ledger.LEDGER_SCHEMA
    )
    got = {r.path: (r.sha256, r.artifact) for r in ledger.latest_entries(log).collect()}
    assert got == {"a": ("2", "f"), "b": ("3", None)}


def test_last_file_of_a_type_wins(spark):
    paths = ["/c/X.pdf", "/c/X Slides.md", "/c/X Annotated.pdf", "/c/X TD.txt", "/d/X.pdf"]
    df = with_path_parts(spark.createDataFrame([(p,) for p in paths], "path string"))
    df = df.withColumn("ext_rank", F.when(F.col("ext") == ".pdf", 0).otherwise(3))
    groups = grouping.group_documents(grouping.with_group_key(df), F.struct("ext_rank", "path"))
    got = {(r.folder, r.base_name): (r.files, r.n_files) for r in groups.collect()}
    assert got == {
        ("/c", "x"): ({"lecture": "/c/X Slides.md", "lecture_annotated": "/c/X Annotated.pdf"}, 3),
        ("/c", "x td"): ({"td": "/c/X TD.txt"}, 1),
        ("/d", "x"): ({"lecture": "/d/X.pdf"}, 1),
    }
