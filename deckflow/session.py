"""Session set-up and the shared folder where lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("deckflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster
    without it is an error, because a machine-local folder would lose the data
    with the machine.
    """
    sc = spark.sparkContext
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or sc.getConf().get("spark.checkpoint.dir")
        or sc.getCheckpointDir()
    )
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir().rstrip("/")


# Folders of intermediate tables that this process made and did not discard.
_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/deckflow/{uuid.uuid4().hex}"
    _MADE.append(folder)
    return f"{folder}/{name}"


def file_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file as Spark names it, and the path there.

    A path without a scheme is a local one. Spark's names of S3 mean the same store, and a
    ``dbfs:`` path is reached through its mount.
    """
    if uri.startswith("dbfs:"):
        uri = "/dbfs/" + uri.removeprefix("dbfs:").lstrip("/")
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def discard_scratch() -> None:
    """Delete the intermediate tables made so far; frames that still read them end.

    For a caller that is through with the results of a run. Nothing else deletes them,
    because frames that a run returns are read from them.
    """
    while _MADE:
        fs, path = file_store(_MADE.pop())
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the stored columns.

    Unlike an RDD checkpoint the stored table is columnar, so later steps read
    only the columns they use. It survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """As ``materialize``, with aggregates taken while writing instead of by another job."""
    seen = Observation()
    stored = materialize(df.observe(seen, *[m.alias(k) for k, m in measures.items()]), name)
    return stored, seen.get


def spread(df: DataFrame) -> DataFrame:
    """Give work per row to all cores where the input has fewer splits than those.

    A large input has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
