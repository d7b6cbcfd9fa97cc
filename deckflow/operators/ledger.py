"""What was processed already, and what may be recorded as processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEDGER_SCHEMA = "path string, sha256 string, themes array<string>, artifact string, run bigint"


def latest_entries(log: DataFrame) -> DataFrame:
    """The newest entry per path of an append-only ledger."""
    rest = [c for c in log.columns if c != "path"]
    newest = F.max_by(F.struct(*rest), F.col("run")).alias("e")
    return log.groupBy("path").agg(newest).select("path", *[F.col(f"e.{c}").alias(c) for c in rest])


def pending_files(files: DataFrame, ledger: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Files to process, with the reason: new, changed, or their artifact is gone.

    ``ledger`` has one row per path, ``artifacts`` lists what exists now.
    """
    entry = ledger.select(
        "path", F.col("sha256").alias("_sha"), F.col("artifact").alias("_artifact")
    )
    present = artifacts.select(F.col("artifact").alias("_present")).distinct()
    recorded = F.nullif(F.col("_artifact"), F.lit(""))
    reason = (
        F.when(F.col("_sha").isNull(), "new")
        .when(F.col("_sha") != F.col("sha256"), "changed")
        .when(recorded.isNotNull() & F.col("_present").isNull(), "artifact_missing")
    )
    return (
        files.join(entry, "path", "left")
        .join(present, F.col("_artifact") == F.col("_present"), "left")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .drop("_sha", "_artifact", "_present")
    )


def committable(members: DataFrame, outcome: DataFrame, artifact: Column) -> DataFrame:
    """Ledger entries for the files of subjects that may be recorded.

    ``members`` carries ``subject, path, sha256, themes``; ``outcome`` one row per
    subject with ``total_added, had_error``. A subject that failed and added
    nothing is tried again next run; one that added nothing has no artifact.
    """
    done = outcome.where(~(F.col("had_error") & (F.col("total_added") == 0))).select(
        "subject", "total_added"
    )
    return members.join(done, "subject").select(
        "path",
        "sha256",
        "themes",
        F.when(F.col("total_added") > 0, artifact).alias("artifact"),
    )


def merge_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ledger after a run: new entries replace old ones of the same path."""
    tagged = old.withColumn("run", F.lit(0).cast("bigint")).unionByName(
        new.withColumn("run", F.lit(1).cast("bigint"))
    )
    return latest_entries(tagged).drop("run")
