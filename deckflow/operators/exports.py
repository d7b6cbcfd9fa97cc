"""Full snapshots of the store as Markdown and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CSV_COLUMNS = ("deck", "question", "answer", "note")
SUBJECT_MARK = "# "
DECK_MARK = "## "
QUESTION_MARK = "**Q:** "
ANSWER_MARK = "**A:** "
NOTE_MARK = "> "
CARD_END = "---"
# ----------------------------------------------------------------------------


def markdown_blocks(snapshot: DataFrame) -> DataFrame:
    """``(subject, deck, part, nid, block)``: heading, deck headings and cards.

    The blocks of a subject in (deck, part, nid) order, each ended by a newline,
    are its Markdown file. The heading has deck '' and sorts first. No subject is
    ever put together in one row, so its size does not matter.
    """
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n\n" + NOTE_MARK), F.col("note")))
    card = F.concat(
        F.lit("\n" + QUESTION_MARK), F.col("question"),
        F.lit("\n\n" + ANSWER_MARK), F.col("answer"),
        F.coalesce(note, F.lit("")), F.lit("\n\n" + CARD_END),
    )
    decks = snapshot.select("subject", "deck").distinct()
    subjects = snapshot.select("subject").distinct()
    no_id = F.lit(0).cast("bigint").alias("nid")
    heading = subjects.select(
        "subject", F.lit("").alias("deck"), F.lit(0).alias("part"), no_id,
        F.concat(F.lit(SUBJECT_MARK), F.col("subject")).alias("block"),
    )
    deck_heading = decks.select(
        "subject", "deck", F.lit(1).alias("part"), no_id,
        F.concat(F.lit("\n" + DECK_MARK), F.col("deck")).alias("block"),
    )
    cards = snapshot.select("subject", "deck", F.lit(2).alias("part"), "nid", card.alias("block"))
    return heading.unionByName(deck_heading).unionByName(cards)


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Range partitions in file order; a large subject takes several of them."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def write_markdown(snapshot: DataFrame, path: str) -> None:
    """A folder per subject; its files in name order are one Markdown document.

    Only the subjects in ``snapshot`` are replaced.
    """
    ordered = _in_order(markdown_blocks(snapshot), "subject", "deck", "part", "nid")
    (
        ordered.select("subject", "block")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("subject")
        .text(path)
    )


def csv_lines(snapshot: DataFrame) -> DataFrame:
    """``(subject, deck, part, nid, line)``: the header of a subject, then its cards, quotes doubled.

    The lines of a subject in (part, deck, nid) order are its CSV file.
    """
    line = F.to_csv(F.struct(*CSV_COLUMNS), CSV_OPTIONS)
    header = snapshot.select("subject").distinct().select(
        "subject", F.lit("").alias("deck"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("nid"),
        F.lit(",".join(CSV_COLUMNS)).alias("line"),
    )
    return header.unionByName(snapshot.select("subject", "deck", F.lit(1).alias("part"), "nid", line.alias("line")))


CSV_OPTIONS = {
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(snapshot: DataFrame, path: str) -> None:
    """A folder per subject; its files in name order are one CSV document with one header."""
    ordered = _in_order(csv_lines(snapshot), "subject", "part", "deck", "nid")
    (
        ordered.select("subject", "line")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("subject")
        .text(path)
    )
