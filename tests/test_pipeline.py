"""Whole runs over a folder, with an offline model."""

import json
import os
import re
import sys

import pytest
from pyspark import cloudpickle

from deckflow.plans import pipeline
from deckflow.sources import card_store

# The model below is defined here, and executors cannot import a test file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


LONG = "What is {t} about: {t}a {t}b {t}c"


class Model:
    """Answers every stage from the request text; counts nothing, remembers nothing."""

    def __init__(self, fail=()):
        self.fail = tuple(fail)

    def __call__(self, stage, prompt):
        if any(f in prompt and stage == s for s, f in self.fail):
            raise RuntimeError("out of order")
        answer = getattr(self, stage)(prompt)
        return {"raw": f"```json\n{json.dumps(answer)}\n```", "prompt_tokens": 10, "completion_tokens": 1, "total_tokens": 11}

    def analysis(self, prompt):
        names = sorted(set(re.findall(r"theme:(\w+)", prompt)))
        return {
            "subject": "Told",
            "themes": [
                {"name": n, "recall_concepts": [f"{n} concept"], "problem_types": [f"{n} task"] if n != "Limits" else []}
                for n in names
            ],
        }

    def resolution(self, prompt):
        proposed = json.loads(prompt.split("proposed by the new document:\n")[1].split("\n")[0])
        # 'Limitz' is forgotten, so the closest canonical takes it.
        return {"resolved": {"Limits": [], "Tests": ["Testing"]}, "new_themes": [p for p in proposed if p == "Bayes"]}

    def recall(self, prompt):
        theme = re.search(r"Theme: (.*)", prompt)[1]
        return {"flashcards": [
            {"question": LONG.format(t=theme), "answer": "An answer", "note": "n"},
            {"question": LONG.format(t=theme) + ", then", "answer": "An answer"},
            {"question": "", "answer": "no question"},
            {"question": f"State {theme}", "answer": f"{theme} stated"},
        ]}

    def problem(self, prompt):
        theme = re.search(r"Theme: (.*)", prompt)[1]
        return {"flashcards": [{"question": f"Solve {theme}", "answer": "By steps"}]}

    def confirm(self, prompt):
        return {"redundant": True}


@pytest.fixture
def course(tmp_path):
    root = tmp_path / "in"
    (root / "My_Course").mkdir(parents=True)
    (root / "My_Course" / "Week 1.md").write_text("theme:Limits theme:Testing")
    (root / "My_Course" / "Week 1 Annotated.txt").write_text("theme:Limitz")
    (root / "My_Course" / "Empty.md").write_text(" \n")
    (root / "My_Course" / "Scan.pdf").write_bytes(b"%PDF")
    (root / "My_Course" / "Scan.ocr.md").write_text("theme:Bayes")
    (root / "Loose.md").write_text("theme:Bayes")
    return root


def decode(path, content):
    if not content.startswith(b"%PDF"):
        raise ValueError("not a document")
    return [(1, 0, None)]


def params(course, model, **more):
    return pipeline.Params(str(course), str(course.parent / "work"), model, decode=decode, **more)


def test_runs_are_incremental_and_idempotent(spark, course):
    p = params(course, Model())
    first = pipeline.run(spark, p, now_ms=1_000_000)
    inserted = {(r.deck, r.question) for r in first["inserted"].collect()}
    assert inserted == {
        (f"My Course::{t}", q.format(t=t)) for t in ("Limits", "Tests", "Bayes") for q in (LONG, "State {t}")
    } | {("My Course::Tests::Problems", "Solve Tests"), ("My Course::Bayes::Problems", "Solve Bayes"),
         ("My Course::Limits::Problems", "Solve Limits"),
         ("Told::Bayes", LONG.format(t="Bayes")), ("Told::Bayes", "State Bayes"), ("Told::Bayes::Problems", "Solve Bayes")}
    outcome = {r.subject: (r.artifact, r.total_added, r.had_error) for r in first["outcome"].collect()}
    assert outcome == {"My Course": ("My_Course.apkg", 9, False), "Told": ("Told.apkg", 3, False)}
    nids = sorted(r.nid for r in first["inserted"].collect() if r.subject == "My Course")
    assert nids == list(range(1_000_000, 1_000_009))
    report = {r.measure: r.n for r in first["report"].collect()}
    assert report["files"] == 5 and report["added"] == 12
    usage = {r.subject: r.total_tokens for r in first["usage"].collect()}
    assert usage["Told"] == 11 * 4  # analysis, resolution, recall, problem

    # Nothing new: only the blank file, which is never recorded, comes up again.
    second = pipeline.run(spark, p, now_ms=2_000_000)
    assert [os.path.basename(r.path) for r in second["pending"].collect()] == ["Empty.md"]
    assert "inserted" not in second

    # A changed file is read again; known cards are not inserted again.
    (course / "Loose.md").write_text("theme:Bayes again")
    third = pipeline.run(spark, p, now_ms=3_000_000)
    assert third["inserted"].count() == 0
    pending = {os.path.basename(r.path): r.reason for r in third["pending"].collect()}
    assert pending == {"Loose.md": "changed", "Empty.md": "new"}

    text = ""
    folder = course.parent / "work" / "markdown" / "subject=Told"
    for name in sorted(n for n in os.listdir(folder) if n.startswith("part-")):
        text += (folder / name).read_text()
    assert text.startswith("# Told\n\n## Told::Bayes\n\n**Q:** ") and text.count("**Q:**") == 3


def test_a_second_run_opens_no_file(spark, course):
    """Bytes change under the same length and time: only a run that verifies everything sees it."""
    p = params(course, Model())
    pipeline.run(spark, p, now_ms=1_000)
    note = course / "My_Course" / "Week 1.md"
    state, text = os.stat(note), note.read_text()
    note.write_text(text.replace("Testing", "Tasting"))
    os.utime(note, ns=(state.st_atime_ns, state.st_mtime_ns))
    quiet = {os.path.basename(r.path) for r in pipeline.run(spark, p, now_ms=2_000)["pending"].collect()}
    p.verify_all = True
    loud = {os.path.basename(r.path) for r in pipeline.run(spark, p, now_ms=3_000)["pending"].collect()}
    assert "Week 1.md" not in quiet and loud == quiet | {"Week 1.md"}


def test_an_empty_folder_is_no_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = pipeline.run(spark, params(tmp_path / "in", Model()))
    assert set(got) == {"pending"} and got["pending"].isEmpty()


def test_failures_stay_where_they_happen(spark, course):
    model = Model(fail=[("recall", "Subject: Told"), ("problem", "Subject: Told"), ("analysis", "theme:Bayes again")])
    (course / "My_Course" / "Broken.pdf").write_bytes(b"junk")
    (course / "My_Course" / "Other.md").write_text("theme:Bayes again")
    got = pipeline.run(spark, params(course, model), now_ms=1_000)
    outcome = {r.subject: (r.artifact, r.total_added, r.had_error) for r in got["outcome"].collect()}
    assert outcome["Told"] == (None, 0, True) and outcome["My Course"][1] == 9
    assert [os.path.basename(r.path) for r in got["unreadable"].collect()] == ["Broken.pdf"]
    # What failed is not recorded, so the next run takes it up.
    healed = pipeline.run(spark, params(course, Model()), now_ms=2_000)
    names = {os.path.basename(r.path) for r in healed["pending"].collect()}
    assert names == {"Empty.md", "Broken.pdf", "Other.md", "Loose.md"}
    assert {r.subject: r.total_added for r in healed["outcome"].collect()}["Told"] == 3


def test_new_cards_may_be_compared_with_stored_ones(spark, course):
    pipeline.run(spark, params(course, Model()), now_ms=1_000)

    class Rephrased(Model):
        def recall(self, prompt):
            theme = re.search(r"Theme: (.*)", prompt)[1]
            return {"flashcards": [
                {"question": "And " + LONG.format(t=theme), "answer": "An answer"}]}

        def problem(self, prompt):
            return {"flashcards": []}

    (course / "Loose.md").write_text("theme:Bayes anew")
    # Stored questions are part of the requests, so these are new requests.
    p = params(course, Rephrased(), against_stored=True)
    assert pipeline.run(spark, p, now_ms=2_000)["inserted"].count() == 0


def test_a_large_registry_is_seen_as_a_whole(spark, course):
    class Finds(Model):
        def resolution(self, prompt):
            known, proposed = [
                json.loads(prompt.split(h + "\n")[1].split("\n")[0].replace(" (none yet)", ""))
                for h in ("in the registry:", "proposed by the new document:")
            ]
            hits = {k: [p for p in proposed if f"registered {p}" == k] for k in known}
            hits = {k: ps for k, ps in hits.items() if ps}
            return {"resolved": hits, "new_themes": [p for p in proposed if [p] not in hits.values()]}

    p = params(course, Finds())
    names = [f"registered {t}" for t in ("Limits", "Limitz", "Testing")] + [f"other {k}" for k in range(6_500)]
    rows = [("My Course", n, None, (1, 0, 0, k, -1), 1) for k, n in enumerate(names)]
    spark.createDataFrame(rows, pipeline.REGISTRY_SCHEMA).write.parquet(p.path("registry"))
    got = pipeline.run(spark, p, now_ms=1_000)
    themes = {r.deck.split("::")[1] for r in got["inserted"].collect() if r.subject == "My Course"}
    assert themes == {"registered Limits", "registered Limitz", "registered Testing", "Bayes"}
    held = {r.canonical for r in spark.read.parquet(p.path("registry")).collect() if r.subject == "My Course"}
    assert held == {*names, "Bayes"}


def test_one_theme_that_two_parts_call_new_has_one_name(spark, course):
    """Small requests: names of one theme are asked about apart, called new apart, and then meet."""
    import hashlib

    class Knows(Model):
        def resolution(self, prompt):
            known, proposed = [
                json.loads(prompt.split(h + "\n")[1].split("\n")[0].replace(" (none yet)", ""))
                for h in ("in the registry:", "proposed by the new document:")
            ]
            same = {k: [p for p in proposed if p[:4] == k[:4] and p != k] for k in known}
            hits = {k: ps for k, ps in same.items() if ps}
            return {"resolved": hits, "new_themes": [p for p in proposed if not any(p in ps for ps in hits.values())]}

    # Four names are proposed, one a part.
    parts = {int(hashlib.md5(n.encode()).hexdigest()[:8], 16) % 4 for n in ("Limits", "Limitz")}
    assert len(parts) == 2
    p = params(course, Knows(), request_items=1)
    pipeline.run(spark, p, now_ms=1_000)
    rows = [r for r in spark.read.parquet(p.path("registry")).collect() if r.subject == "My Course"]
    lim = {r.canonical for r in rows if r.canonical.startswith("Lim")}
    assert len(lim) == 1
    assert {r.alias for r in rows if r.canonical in lim and r.alias} == {"Limits", "Limitz"} - lim


def test_embedders_may_replace_terms(spark, course):
    def broken(texts):
        raise RuntimeError("no such model")

    def letters(texts):
        return [[float(t.lower().count(chr(97 + k))) for k in range(26)] for t in texts]

    p = params(course, Model(), embedders=(broken, letters), confirm=False, threshold=0.97)
    got = pipeline.run(spark, p, now_ms=1_000)
    asked = {r.question for r in got["inserted"].collect() if r.subject == "Told"}
    assert asked == {LONG.format(t="Bayes"), "State Bayes", "Solve Bayes"}


def test_a_run_that_dies_between_the_tables_leaves_nothing(spark, course, monkeypatch):
    p = params(course, Model())

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(card_store.store, "deck_table", broken)
        with pytest.raises(RuntimeError, match="lost"):
            pipeline.run(spark, p)
    assert spark.read.parquet(p.path("collection") + "/notes").count() > 0
    dead = card_store.read(spark, p.path("collection"))
    assert dead.snapshot().count() == dead.notes.count() == 0
    made = pipeline.run(spark, p)["inserted"].count()
    stored = card_store.read(spark, p.path("collection"))
    assert stored.snapshot().count() == stored.cards.count() == stored.notes.count() == made > 0
    decks = {r.name: r.parent for r in stored.decks.collect()}
    assert all(parent is None or parent in decks for parent in decks.values()) and any(decks.values())
    assert {r.deck for r in stored.snapshot().collect()} <= set(decks)
