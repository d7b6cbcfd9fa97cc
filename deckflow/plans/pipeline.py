"""One run of the whole pipeline: new files in, cards, snapshots and ledger out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.functions import answers, text
from deckflow.operators import (
    embedding,
    exports,
    grouping,
    inference,
    ledger,
    neardup,
    report,
    requests,
    store,
    themes,
)
from deckflow.session import materialize, materialize_measured
from deckflow.sources import card_store, files, parts
from deckflow.sources.tables import read_or_empty

REGISTRY_SCHEMA = (
    "subject string, canonical string, alias string,"
    " ordinal struct<gen:bigint,new:int,part:bigint,c:bigint,a:bigint>, run bigint"
)

# Reads one file: rows of (page or slide number from 1, shape number, text).
Decoder = Callable[[str, bytes], list[tuple[int, int, str]]]


@dataclass
class Params:
    """What a run needs to know. ``infer(stage, prompt)`` answers every request."""

    input_dir: str
    work_dir: str
    infer: inference.Infer
    decode: Decoder | None = None
    extensions: tuple[str, ...] = files.EXTENSIONS
    threshold: float = neardup.THRESHOLD
    parallelism: int | None = None
    register_new: bool = True
    confirm: bool = True
    against_stored: bool = False
    # Hash every file again, also those whose length and time of change are known.
    verify_all: bool = False
    # A request lists about this many names, concepts or questions.
    request_items: int = requests.REQUEST_ITEMS
    # Tried in order; without any, cards are compared by their terms.
    embedders: tuple[embedding.Embedder, ...] = ()

    def path(self, name: str) -> str:
        return f"{self.work_dir.rstrip('/')}/{name}"


def read_documents(pending: DataFrame, content: DataFrame, sidecars: DataFrame, decode: Decoder | None):
    """Texts of the files, and the files that could not be read with their error."""
    raw = files.with_format(pending).join(content.withColumnRenamed("error", "unread"), "path")
    raw = raw.withColumn("error", F.coalesce("error", "unread")).drop("unread")
    usable, bad = inference.quarantine(raw, F.col("error"))
    plain = usable.where("format = 'text'").select(
        "path", "folder", "stem", files.decode_text(F.col("content")).alias("text")
    )
    binary = usable.where("format <> 'text'").select("path", "folder", "stem", "format", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "part_no", "shape_no", "text", "error"]
        for batch in batches:
            rows = []
            for path, content in batch[["path", "content"]].itertuples(index=False):
                try:
                    if decode is None:
                        raise RuntimeError("no decoder for this format")
                    found = decode(path, content)
                    rows += [(path, p, s, t, None) for p, s, t in found] or [(path, 0, 0, None, None)]
                except Exception as e:  # one unreadable file must not fail the others
                    rows.append((path, 0, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=columns)

    shapes = materialize(
        binary.select("path", "content").mapInPandas(
            read, "path string, part_no int, shape_no int, text string, error string"
        ),
        "parts",
    )
    failed = shapes.where("error IS NOT NULL").select("path", "error")
    names = binary.select("path", "folder", "stem", "format")
    good = shapes.where("error IS NULL").join(names, "path")
    keys = ["path", "folder", "stem"]
    paged = parts.with_sidecar(
        parts.assemble_pages(good.where("format = 'pages'"), keys), sidecars, ["folder", "stem"]
    )
    slides = parts.assemble_slides(good.where("format = 'slides'"), keys)
    documents = plain.unionByName(paged.select(plain.columns)).unionByName(slides)
    return documents, bad.select("path", "error").unionByName(failed)


def read_analyses(asked: DataFrame, told: DataFrame, root: str) -> DataFrame:
    """One row per group whose requests all succeeded: its subject and themes."""
    parsed = asked.join(told, "request_hash").withColumn(
        "json", answers.parse_answer(F.col("raw"))["json"]
    )
    one = F.struct(
        "part",
        answers.subject_of(F.col("json")).alias("subject"),
        answers.themes_of(F.col("json")).alias("themes"),
    )
    grouped = (
        parsed.groupBy("folder", "base_name")
        .agg(
            F.array_sort(F.collect_list(one)).alias("parts"),
            F.bool_or(F.col("json").isNull()).alias("failed"),
        )
        .where("NOT failed")
    )
    told_subject = F.element_at("parts", 1)["subject"]
    return grouped.select(
        text.subject_of_folder(F.col("folder"), root, told_subject).alias("subject"),
        "folder",
        "base_name",
        F.flatten("parts.themes").alias("themes"),
    ).where("subject IS NOT NULL")


def read_cards(asked: DataFrame, told: DataFrame) -> DataFrame:
    """Cards of the answers, with the place of each in its answer."""
    parsed = asked.join(told, "request_hash").withColumn(
        "json", answers.parse_answer(F.col("raw"))["json"]
    )
    parsed = parsed.select(
        "subject",
        "part",
        F.col("canonical").alias("theme"),
        F.posexplode(answers.cards_of(F.col("json"))),
    )
    place = (F.col("part") * F.lit(1_000_000) + F.col("pos")).alias("ordinal")
    return parsed.select("subject", "theme", place, "col.question", "col.answer", "col.note")


def run(spark: SparkSession, p: Params, now_ms: int | None = None) -> dict[str, DataFrame]:
    """Process everything new, then stop. The ledger is written last."""
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    root = p.input_dir.rstrip("/")
    artifact = text.artifact_name(F.col("subject"))

    listing = files.list_files(spark, root)
    known = None if p.verify_all else read_or_empty(spark, p.path("hashes"), files.HASHES_SCHEMA)
    found = materialize(files.find_files(listing, root, p.extensions, known), "found")
    read_now = found.where("hashed AND sha256 IS NOT NULL").select("path", "length", "modified", "sha256")
    read_now.withColumn("run", F.lit(now_ms).cast("bigint")).write.mode("append").parquet(p.path("hashes"))
    found = found.drop("length", "modified", "hashed")
    held = card_store.read(spark, p.path("collection"))
    log = read_or_empty(spark, p.path("ledger"), ledger.LEDGER_SCHEMA)
    present = held.subjects().select(artifact.alias("artifact"))
    pending, seen = materialize_measured(
        ledger.pending_files(found, ledger.latest_entries(log), present),
        "pending",
        n=F.count(F.lit(1)),
    )
    if not seen["n"]:
        return {"pending": pending}

    # Groups of documents with text, and one analysis per group.
    groups = grouping.group_documents(
        grouping.with_group_key(pending), F.struct("ext_rank", "path")
    )
    members = grouping.group_files(groups)
    chosen = pending.join(members.select("path"), "path", "left_semi")
    documents, unreadable = read_documents(
        chosen,
        files.read_content(chosen, root),
        files.read_sidecars(listing, root, chosen),
        p.decode,
    )
    usable = materialize(
        grouping.usable_documents(members, documents).join(
            pending.select("path", "name", "sha256", "ext_rank"), "path"
        ),
        "documents",
    )

    def ask(prompts: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
        asked = materialize(requests.as_requests(prompts, stage), stage)
        told = inference.cached_inference(
            asked.select("request_hash", "stage", "prompt"), p.path("responses"), p.infer, p.parallelism, stage
        )
        return asked, materialize(told, f"{stage}-told")

    asked, told = ask(requests.analysis_requests(usable, "ext_rank", "path"), "analysis")
    analyses = materialize(read_analyses(asked, told, root), "analyses")
    told_subject = answers.subject_of(answers.parse_answer(F.col("raw"))["json"])
    analysis_usage = asked.join(told, "request_hash").select(
        F.coalesce(text.subject_of_folder(F.col("folder"), root, told_subject), F.lit("")).alias("subject"),
        "sent",
        *report.COUNTS,
    )
    if analyses.isEmpty():
        return {"pending": pending, "unreadable": unreadable, "analyses": analyses}

    # Canonical themes per subject; a subject whose answer failed is left for next time.
    registry = read_or_empty(spark, p.path("registry"), REGISTRY_SCHEMA)
    known = registry.groupBy("subject", "canonical", "alias").agg(
        F.min("ordinal").alias("ordinal")
    )
    proposed = themes.proposed_themes(analyses)
    asked, told = ask(requests.resolution_requests(proposed, known, p.request_items), "resolution")
    parsed = asked.join(told, "request_hash").select(
        "subject", "part", answers.parse_answer(F.col("raw")).alias("a"), "sent", *report.COUNTS
    )
    failed = parsed.where("a.json IS NULL").select("subject").distinct()
    resolutions = materialize(
        parsed.join(failed, "subject", "left_anti").select(
            "subject",
            "part",
            answers.resolved_of(F.col("a.text")).alias("resolved"),
            answers.new_themes_of(F.col("a.json")).alias("new_themes"),
        ),
        "resolutions",
    )
    entries = materialize(themes.merged_entries(themes.alias_entries(resolutions), known), "entries")
    # New names of different parts meet too: one theme may have got two.
    parts_of = requests.resolution_parts(proposed, known, p.request_items)
    invented, seen = materialize_measured(themes.new_names(entries, known, parts_of), "invented", part=F.max("part"))
    meeting = []
    if seen["part"]:
        asked, told = ask(requests.reconciliation_requests(invented), "resolution")
        meeting = [asked.join(told, "request_hash").select("subject", answers.parse_answer(F.col("raw")).alias("a"), "sent", *report.COUNTS)]
        found = meeting[0].select("subject", answers.resolved_of(F.col("a.text")).alias("resolved"))
        entries = materialize(themes.reconciled_entries(entries, themes.united_names(invented, found)), "reconciled")
    aliases = themes.alias_map(entries)
    built = analyses.join(resolutions.select("subject").distinct(), "subject", "left_semi")
    resolved = themes.resolve_themes(themes.proposed_themes(built), aliases)
    items = materialize(themes.theme_items(built, resolved), "items")
    canonicals = themes.subject_canonicals(items)

    # Cards per theme, without those that repeat an earlier one.
    existing = store.existing_questions(held.snapshot())
    recall_asked, recall_told = ask(
        requests.recall_requests(canonicals, themes.theme_content(items, "recall_concepts"), existing, p.request_items),
        "recall",
    )
    problem_asked, problem_told = ask(
        requests.problem_requests(canonicals, themes.theme_content(items, "problem_types"), existing, p.request_items),
        "problem",
    )
    made = store.union_cards(
        read_cards(recall_asked, recall_told), read_cards(problem_asked, problem_told)
    )
    # The order of a card within its subject: theme, recall before problem, ordinal.
    numbered = materialize(
        made.withColumn(
            "card_no",
            F.concat_ws(
                "\x1f",
                "subject",
                "theme",
                F.when(F.col("kind") == "recall", "0").otherwise("1"),
                F.lpad(F.col("ordinal").cast("string"), 18, "0"),
            ),
        ).withColumn("text", text.card_text(F.col("question"), F.col("answer"))),
        "cards",
    )
    compared, vector = numbered, None
    if p.embedders:
        vectors = embedding.embed_texts(numbered, "card_no", "subject", "text", p.embedders)
        compared = numbered.join(vectors.select(F.col("id").alias("card_no"), "vec"), "card_no")
        vector = "vec"
    kept = neardup.deduplicate_cards(
        compared, p.threshold, _confirmation(numbered, p) if p.confirm else None, vector
    ).drop("vec")
    kept = materialize(kept, "kept")
    if p.against_stored:
        kept = _unlike_stored(kept, held.notes, p)

    # Insert what the store lacks, as one batch of notes, cards and decks.
    fresh = store.new_cards(kept, held.notes, F.col("ordinal"))
    maxima = store.store_maxima(held.notes, held.cards)
    inserted = materialize(
        store.assign_ids(fresh, maxima, F.lit(now_ms))
        .withColumn("mod", F.timestamp_millis(F.lit(now_ms)))
        .select(
            "nid", "guid", "deck", "question", "answer", "note", "csum", "mod", "cid", "did", "due",
            "theme", "kind", "subject",
        ),
        "inserted",
    )
    card_store.commit(inserted, p.path("collection"), now_ms)
    grown = themes.registry_with(known, entries, p.register_new)
    added_names = (
        grown.where(F.col("ordinal.gen") == themes.FRESH)
        .withColumn("ordinal", F.col("ordinal").withField("gen", F.lit(now_ms).cast("bigint")))
        .withColumn("run", F.lit(now_ms).cast("bigint"))
    )
    added_names.write.mode("append").parquet(p.path("registry"))

    # Full snapshots of the subjects of this run.
    held = card_store.read(spark, p.path("collection"))
    touched = held.snapshot().join(canonicals.select("subject").distinct(), "subject", "left_semi")
    exports.write_markdown(touched, p.path("markdown"))
    exports.write_csv(touched, p.path("csv"))

    failures = [
        asked.join(told, "request_hash").select(
            "subject", answers.parse_answer(F.col("raw"))["json"].isNull().alias("errored")
        )
        for asked, told in ((recall_asked, recall_told), (problem_asked, problem_told))
    ]
    outcome = materialize(
        report.run_outcome(
            failures[0].unionByName(failures[1]), store.added_counts(inserted), artifact
        ),
        "outcome",
    )
    # Every answer of this run counts, also one that could not be read; stored ones do not.
    calls = (
        analysis_usage, parsed, *meeting, recall_asked.join(recall_told, "request_hash"),
        problem_asked.join(problem_told, "request_hash"),
    )
    usage = report.token_usage(*[c.where("sent") for c in calls])
    themed = themes.group_themes(items)
    entries = ledger.committable(
        usable.join(themed, ["folder", "base_name"]).select("subject", "path", "sha256", "themes"),
        outcome,
        artifact,
    )
    entries.withColumn("run", F.lit(now_ms)).write.mode("append").parquet(p.path("ledger"))
    return {
        "pending": pending,
        "unreadable": unreadable,
        "analyses": analyses,
        "inserted": inserted,
        "outcome": outcome,
        "usage": usage,
        "report": report.run_report(
            **{
                "files": pending,
                "groups": groups,
                "superseded files": pending.join(members, "path", "left_anti"),
                "unreadable files": unreadable,
                "themes": canonicals,
                "cards": numbered,
                "kept": kept,
                "added": inserted,
            }
        ),
    }


def _confirmation(cards: DataFrame, p: Params, id: str = "card_no") -> neardup.Confirm:
    return inference.confirm_pairs(
        cards.select(F.col(id).alias("id"), "question", "answer"), p.path("responses"), p.infer, p.parallelism
    )


def _unlike_stored(cards: DataFrame, notes: DataFrame, p: Params) -> DataFrame:
    """Cards that are no near-duplicate of a stored one either.

    Only new cards are compared with stored ones: a stored card drops a new one also
    where it is itself close to another stored card. Vectors of a model are those of
    this run, so cards of both kinds are embedded together.
    """
    subjects = cards.select("subject").distinct()
    old = notes.join(subjects, "subject", "left_semi").select(
        "subject", "question", "answer",
        F.concat(F.lit("0"), F.col("subject"), F.lit("\x1f"), F.col("guid")).alias("at"),
        text.card_text(F.col("question"), F.col("answer")).alias("text"),
    )
    new = cards.select("subject", "question", "answer", F.concat(F.lit("1"), F.col("card_no")).alias("at"), "text")
    both = materialize(old.unionByName(new), "old-and-new")
    compared, vector = both, None
    if p.embedders:
        vectors = embedding.embed_texts(both, "at", "subject", "text", p.embedders)
        compared, vector = both.join(vectors.select(F.col("id").alias("at"), "vec"), "at"), "vec"
    pairs = neardup.pairs_between(
        compared, "at", "subject", vector or "text", F.col("id").startswith("0"), p.threshold, vector=bool(vector)
    )
    if p.confirm:
        pairs = _confirmation(both, p, "at")(pairs)
    return cards.join(pairs.select(F.expr("substr(j, 2)").alias("card_no")).distinct(), "card_no", "left_anti")
