"""Arrivals into a card store: each run takes what is new and stops.

A stream with ``availableNow`` is the timer's run: it reads the files that came since
the last one. The ledger is checked inside the batch, because a file source does not
deliver a rewritten file again, and may deliver a batch twice after a failure. The
upsert only inserts unknown guids, so a repeated batch changes nothing.

Store and ledger are partitioned by a hash of their keys, and a batch reads the buckets of
its own subjects and paths only. The artifact of a source is what the store holds of its
subject. A source whose artifact is gone is taken again: if it arrives once more, and at the
start of a run from what arrived earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.functions.text import artifact_name
from deckflow.operators import ledger, store
from deckflow.session import materialize, scratch_path
from deckflow.sources.tables import read_or_empty

HELD_SCHEMA = "subject string, guid string, deck string, question string, answer string, note string"
ENTRY_SCHEMA = "path string, sha256 string, artifact string, run bigint"


# Folders of the store and of the ledger; fixed, as stored rows are found by it.
BUCKETS = 64


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def stored_beside(batch: DataFrame, key: str, path: str, schema: str) -> DataFrame:
    """The stored rows in the buckets of the batch's keys: at most BUCKETS numbers are collected."""
    wanted = [r[0] for r in batch.select(_bucket(key)).distinct().collect()]
    rows = read_or_empty(batch.sparkSession, path, f"{schema}, bucket int")
    return rows.where(F.col("bucket").isin(wanted)).drop("bucket")


def _append(rows: DataFrame, key: str, path: str) -> None:
    # Few files a bucket, while one that holds most rows is still written by several tasks.
    dealt = rows.withColumn("bucket", _bucket(key)).hint("rebalance", "bucket")
    dealt.write.mode("append").partitionBy("bucket").parquet(path)


def _artifacts(subjects: DataFrame) -> DataFrame:
    return subjects.select(artifact_name(F.col("subject")).alias("artifact")).distinct()


def absorb(batch: DataFrame, run: int, store_path: str, ledger_path: str) -> None:
    """Insert the cards of one batch that are neither recorded nor stored.

    ``batch`` has ``path, sha256, subject, deck, ordinal, question, answer, note``.
    The ledger is written last: a crash repeats work and loses none.
    """
    known = ledger.latest_entries(stored_beside(batch, "path", ledger_path, ENTRY_SCHEMA))
    held = stored_beside(batch, "subject", store_path, HELD_SCHEMA)
    pending = materialize(ledger.pending_files(batch, known, _artifacts(held)).drop("reason"), "pending")
    columns = ["subject", "guid", "deck", "question", "answer", "note"]
    fresh = materialize(store.new_cards(pending, held, F.col("ordinal")).select(*columns), "fresh")
    # Looked at before the store grows.
    present = materialize(_artifacts(held.select("subject").unionByName(fresh.select("subject"))), "artifacts")
    _append(fresh, "subject", store_path)
    named = pending.select("path", "sha256", artifact_name(F.col("subject")).alias("artifact"))
    recorded = named.join(present.withColumn("there", F.lit(True)), "artifact", "left").select(
        "path",
        "sha256",
        F.when(F.col("there"), F.col("artifact")).alias("artifact"),
        F.lit(run).cast("bigint").alias("run"),
    )
    _append(recorded, "path", ledger_path)


def redo_lost(spark: SparkSession, arrivals: str, schema, store_path: str, ledger_path: str) -> bool:
    """Take recorded sources again whose artifact is gone; whether there were any.

    Of a source that arrived in several versions the recorded one counts.
    """
    log = ledger.latest_entries(read_or_empty(spark, ledger_path, ENTRY_SCHEMA))
    present = _artifacts(read_or_empty(spark, store_path, HELD_SCHEMA))
    lost = log.where("artifact IS NOT NULL").join(present, "artifact", "left_anti").select("path", "sha256")
    sources = materialize(
        read_or_empty(spark, arrivals, schema).join(lost, ["path", "sha256"], "left_semi").distinct(), "lost"
    )
    if sources.isEmpty():
        return False
    # The entries are those of the ledger, so they rank behind every batch.
    absorb(sources, -1, store_path, ledger_path)
    return True


def run_available(
    spark: SparkSession, arrivals: str, schema, checkpoint: str, store_path: str, ledger_path: str
) -> None:
    """Take what was lost and every file in ``arrivals`` that no earlier run has seen, then stop."""
    redo_lost(spark, arrivals, schema, store_path, ledger_path)
    stream = (
        spark.readStream.schema(schema)
        .parquet(arrivals)
        .writeStream.foreachBatch(lambda df, run: absorb(df, run, store_path, ledger_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()


def event_cards(events: DataFrame) -> DataFrame:
    """Events read as cards, each event its own source."""
    return events.select(
        F.expr("'event/' || event_id").alias("path"),
        F.sha2("props", 256).alias("sha256"),
        F.expr("'Day ' || (user_id % 30)").alias("subject"),
        F.expr("'Day ' || (user_id % 30)").alias("deck"),
        F.col("event_id").alias("ordinal"),
        F.expr("event_type || ' by ' || user_id").alias("question"),
        F.col("props").alias("answer"),
        F.lit("").alias("note"),
    )


def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after the month's events arrived in three parts, one run each.

    Each part after the first brings some of the earlier rows once more.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    arrivals, checkpoint, store_path, ledger_path = (
        scratch_path(spark, n) for n in ("arrivals", "checkpoint", "store", "ledger")
    )
    day = F.dayofmonth("ts")
    for first, last in ((1, 10), (9, 20), (19, 31)):
        part = event_cards(events.where(day.between(first, last)))
        part.write.mode("append").parquet(arrivals)
        run_available(spark, arrivals, part.schema, checkpoint, store_path, ledger_path)
    return spark.read.schema(HELD_SCHEMA).parquet(store_path).select(
        "deck", "guid", "question", "answer"
    )
