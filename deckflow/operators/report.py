"""Token sums, outcomes per subject, and the run report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("prompt_tokens", "completion_tokens", "total_tokens")


def token_usage(*stages: DataFrame) -> DataFrame:
    """Token sums per subject over the stages; a missing count is 0."""
    rows = reduce(DataFrame.unionByName, [s.select("subject", *COUNTS) for s in stages])
    return rows.groupBy("subject").agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in COUNTS]
    )


def run_outcome(builds: DataFrame, added: DataFrame, artifact: Column) -> DataFrame:
    """``(subject, artifact, total_added, had_error)``: one row per built subject.

    ``builds`` has ``subject, errored`` per theme, ``added`` counts per deck.
    """
    failed = builds.groupBy("subject").agg(F.bool_or("errored").alias("had_error"))
    sums = added.groupBy("subject").agg(F.sum("added").alias("n"))
    total = F.coalesce("n", F.lit(0)).cast("bigint")
    return failed.join(sums, "subject", "left").select(
        "subject",
        F.when(total > 0, artifact).alias("artifact"),
        total.alias("total_added"),
        "had_error",
    )


def run_report(**counts: DataFrame) -> DataFrame:
    """``(measure, n)``: the row count of each named table."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("measure"), "n") for k, df in counts.items()]
    return reduce(DataFrame.unionByName, rows)
