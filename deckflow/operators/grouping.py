"""Variants of one document become one group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckflow.functions.text import DOC_TYPES, base_name, doc_type


def with_group_key(files: DataFrame, stem: str = "stem") -> DataFrame:
    return files.withColumn("base_name", base_name(F.col(stem))).withColumn(
        "doc_type", doc_type(F.col(stem))
    )


def group_documents(
    files: DataFrame,
    order: Column,
    path: str = "path",
    keys: Sequence[str] = ("folder", "base_name"),
) -> DataFrame:
    """One row per ``(folder, base_name)`` with ``files: doc_type -> path``.

    Of several files of one type the last in ``order`` wins. The types are a
    fixed list, so each is one conditional aggregate: a single shuffle with
    map-side combining, whatever the size of a group.
    """
    winners = [
        F.max_by(F.col(path), F.when(F.col("doc_type") == t, order)).alias(t) for t in DOC_TYPES
    ]
    found = F.filter(
        F.array(*[F.struct(F.lit(t).alias("key"), F.col(t).alias("value")) for t in DOC_TYPES]),
        lambda e: e["value"].isNotNull(),
    )
    return (
        files.groupBy(*keys)
        .agg(*winners, F.count("*").alias("n_files"))
        .select(*keys, F.map_from_entries(found).alias("files"), "n_files")
    )


def group_files(groups: DataFrame, keys: Sequence[str] = ("folder", "base_name")) -> DataFrame:
    """Long form of groups: one row per file that represents its type."""
    return groups.select(*keys, F.explode("files").alias("doc_type", "path"))


def usable_documents(
    members: DataFrame, documents: DataFrame, path: str = "path", text: str = "text"
) -> DataFrame:
    """Group members with text; a group none of whose files has any disappears."""
    from deckflow.sources.parts import drop_blank

    return members.join(drop_blank(documents.select(path, text), text), path)
