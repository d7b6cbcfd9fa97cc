"""The card store: validity, stable ids, insert-only upsert, snapshots.

The store is three tables: ``notes`` (content), ``cards`` (schedule, one per note)
and ``decks``. All functions take and return tables; ``plans.pipeline`` writes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckflow.functions.ids import checksum, deck_ancestors, deck_id, stable_guid
from deckflow.functions.text import deck_name, strip
from deckflow.session import materialize

# --- fixed values -----------------------------------------------------------
UNKNOWN_DECK = "Unknown"
CARD_ID_GAP = 100_000
# ----------------------------------------------------------------------------

# Numbering looks at this many consecutive ordinals of a deck at a time.
NUMBER_RANGE = 100_000

NOTES_SCHEMA = (
    "subject string, nid bigint, guid string, question string, answer string, note string,"
    " sfld string, csum bigint, mod timestamp"
)
CARDS_SCHEMA = "subject string, cid bigint, nid bigint, did bigint, due bigint"
DECKS_SCHEMA = "did bigint, name string, parent string, depth int"


def union_cards(recall: DataFrame, problem: DataFrame) -> DataFrame:
    """Recall and problem cards with their kind and their deck."""
    both = recall.withColumn("kind", F.lit("recall")).unionByName(
        problem.withColumn("kind", F.lit("problem"))
    )
    return both.withColumn(
        "deck", deck_name(F.col("subject"), F.col("theme"), F.col("kind"))
    )


def valid_cards(cards: DataFrame) -> DataFrame:
    """Stripped cards that have a question and an answer; a missing note is ''."""
    clean = {
        c: strip(F.coalesce(F.col(c), F.lit(""))) for c in ("question", "answer", "note")
    }
    return cards.withColumns(clean).where("question <> '' AND answer <> ''")


def with_ids(cards: DataFrame) -> DataFrame:
    return cards.withColumns(
        {
            "guid": stable_guid(F.col("deck"), F.col("question")),
            "csum": checksum(F.col("question")),
            "did": deck_id(F.col("deck")),
        }
    )


def first_per_guid(cards: DataFrame, order: Column, scope: Sequence[str] = ("subject",)) -> DataFrame:
    """One card per guid, the first in ``order``; combined before the shuffle."""
    rest = [c for c in cards.columns if c not in (*scope, "guid")]
    first = F.min_by(F.struct(*rest), order).alias("c")
    return cards.groupBy(*scope, "guid").agg(first).select(*scope, "guid", "c.*")


def new_cards(
    cards: DataFrame, existing: DataFrame, order: Column, scope: Sequence[str] = ("subject",)
) -> DataFrame:
    """What an upsert inserts: valid, first of its guid, not stored yet."""
    fresh = first_per_guid(with_ids(valid_cards(cards)), order, scope)
    return fresh.join(existing.select(*scope, "guid"), [*scope, "guid"], "left_anti")


def numbered(cards: DataFrame, subject: str, deck: str, ordinal: str) -> DataFrame:
    """Add ``k``: 0, 1, 2, … per subject over (deck, ordinal).

    A subject may hold any share of the rows, so it is not sorted as a whole. Rows
    are ranked inside ranges of NUMBER_RANGE ordinals, and the counts of the ranges
    give each range its offset.
    """
    ranged = materialize(
        cards.withColumn("_range", F.floor(F.col(ordinal) / F.lit(NUMBER_RANGE)).cast("bigint")),
        "ranged",
    )
    keys = [subject, deck, "_range"]
    before = Window.partitionBy(subject).orderBy(deck, "_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal)) - 1
    return (
        ranged.withColumn("_inside", inside)
        .join(offsets, keys)
        .withColumn("k", F.col("_offset") + F.col("_inside"))
        .drop("_range", "_inside", "_offset")
    )


def store_maxima(notes: DataFrame, cards: DataFrame) -> DataFrame:
    """``(subject, max_nid, max_cid, max_due)`` of the stored rows."""
    n = notes.groupBy("subject").agg(F.max("nid").alias("max_nid"))
    c = cards.groupBy("subject").agg(F.max("cid").alias("max_cid"), F.max("due").alias("max_due"))
    return n.join(c, "subject", "full")


def assign_ids(new: DataFrame, maxima: DataFrame, now_ms: Column, ordinal: str = "ordinal") -> DataFrame:
    """Note id, card id and due position, continuing after what is stored."""
    zero = F.lit(0).cast("bigint")
    base_nid = F.greatest(F.coalesce("max_nid", zero) + 1, now_ms)
    base_cid = F.greatest(F.coalesce("max_cid", zero) + 1, base_nid + CARD_ID_GAP)
    return (
        numbered(new, "subject", "deck", ordinal)
        .join(maxima, "subject", "left")
        .withColumns(
            {
                "nid": base_nid + F.col("k"),
                "cid": base_cid + F.col("k"),
                "due": F.coalesce("max_due", zero) + 1 + F.col("k"),
            }
        )
        .drop("k", "max_nid", "max_cid", "max_due")
    )


def as_notes(inserted: DataFrame, mod: Column) -> DataFrame:
    return inserted.select(
        "subject", "nid", "guid", "question", "answer", "note",
        F.col("question").alias("sfld"), "csum", mod.alias("mod"),
    )


def as_cards(inserted: DataFrame) -> DataFrame:
    return inserted.select("subject", "cid", "nid", "did", "due")


def deck_table(names: DataFrame, name: str = "deck") -> DataFrame:
    """All decks and their parents, each once."""
    return (
        names.select(name)
        .distinct()
        .select(F.explode(deck_ancestors(F.col(name))).alias("name"))
        .distinct()
        .select(
            deck_id(F.col("name")).alias("did"),
            "name",
            F.nullif(F.regexp_extract("name", r"(?s)^(.*)::", 1), F.lit("")).alias("parent"),
            F.size(F.split("name", "::")).alias("depth"),
        )
    )


def card_snapshot(notes: DataFrame, cards: DataFrame, decks: DataFrame) -> DataFrame:
    """Every stored card with its deck; a card of no known deck is 'Unknown'."""
    named = decks.select("did", F.col("name").alias("deck"))
    return (
        cards.select("subject", "nid", "did")
        .join(notes.select("subject", "nid", "question", "answer", "note"), ["subject", "nid"])
        .join(named, "did", "left")
        .select(
            "subject",
            F.coalesce("deck", F.lit(UNKNOWN_DECK)).alias("deck"),
            "nid",
            "question",
            "answer",
            "note",
        )
    )


def existing_questions(snapshot: DataFrame) -> DataFrame:
    """The stored questions of every deck; their order is that of the note ids."""
    return snapshot.select("subject", "deck", "nid", "question")


def added_counts(inserted: DataFrame) -> DataFrame:
    return inserted.groupBy("subject", "deck").agg(F.count("*").alias("added"))
