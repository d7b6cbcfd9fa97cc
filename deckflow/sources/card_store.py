"""The stored cards: notes, cards and decks behind one commit record.

A run writes its rows of the three tables under a batch id of its own, and one row to
``commits`` last. Rows whose batch is not there are not read: a run that dies between the
tables leaves nothing half written, and its repetition writes another batch.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.operators import store
from deckflow.sources.tables import read_or_empty

COMMIT_SCHEMA = "batch string, run bigint"


@dataclass
class Stored:
    """What is committed; a deck stands once, also if many runs used it."""

    notes: DataFrame
    cards: DataFrame
    decks: DataFrame

    def snapshot(self) -> DataFrame:
        return store.card_snapshot(self.notes, self.cards, self.decks)

    def subjects(self) -> DataFrame:
        return self.cards.select("subject").distinct()


def read(spark: SparkSession, path: str) -> Stored:
    done = read_or_empty(spark, f"{path}/commits", COMMIT_SCHEMA).select("batch").distinct()

    def committed(name: str, schema: str) -> DataFrame:
        # Tables are partitioned by batch, so what was never committed is not opened.
        rows = read_or_empty(spark, f"{path}/{name}", f"{schema}, batch string")
        return rows.join(done, "batch", "left_semi").drop("batch")

    return Stored(
        committed("notes", store.NOTES_SCHEMA),
        committed("cards", store.CARDS_SCHEMA),
        committed("decks", store.DECKS_SCHEMA).distinct(),
    )


def commit(inserted: DataFrame, path: str, run: int) -> None:
    """Add cards with their ids (``store.assign_ids``) and their ``mod``; the commit is written last."""
    spark = inserted.sparkSession
    batch = uuid.uuid4().hex
    for name, rows in (("notes", store.as_notes(inserted, F.col("mod"))), ("cards", store.as_cards(inserted))):
        (
            rows.withColumn("batch", F.lit(batch))
            .repartitionByRange("subject", "nid")
            .write.mode("append")
            .partitionBy("batch", "subject")
            .parquet(f"{path}/{name}")
        )
    decks = store.deck_table(inserted).withColumn("batch", F.lit(batch))
    decks.write.mode("append").partitionBy("batch").parquet(f"{path}/decks")
    spark.createDataFrame([(batch, run)], COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/commits")
