"""Embedding stage: texts -> vectors by the first embedder that can do a whole subject."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckflow.session import materialize_measured

# Vectors of a list of texts, in order. It may raise.
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def _embed(rows: DataFrame, id: str, block: str, text: str, embedder: Embedder, model: int) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # One call per block, so that a failure concerns that block alone.
            for _, part in batch.groupby("block", sort=False, dropna=False):
                try:
                    found = [[float(x) for x in v] for v in embedder(list(part["text"]))]
                    if len(found) != len(part):
                        raise ValueError("one vector per text is needed")
                    error = None
                except Exception as e:  # the whole block goes to the next embedder
                    found, error = [None] * len(part), f"{type(e).__name__}: {e}"
                yield part[["id", "block"]].assign(vec=found, model=model, error=error)

    asked = rows.select(
        F.col(id).alias("id"), F.col(block).alias("block"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    schema = f"id {kinds['id']}, block {kinds['block']}, vec array<double>, model int, error string"
    return asked.mapInPandas(work, schema)


def embed_texts(
    rows: DataFrame, id: str, block: str, text: str, embedders: Sequence[Embedder]
) -> DataFrame:
    """``(id, block, vec, model, error)``, the embedders tried in order.

    Vectors of different models cannot be compared, so a block in which any text
    failed is embedded again as a whole by the next one. A block that none of them
    can do has no vectors; its rows are kept as they are.
    """
    done, todo, failed = None, rows, None
    for model, embedder in enumerate(embedders):
        tried, seen = materialize_measured(
            _embed(todo, id, block, text, embedder, model),
            "vectors",
            failures=F.sum(F.col("error").isNotNull().cast("bigint")),
        )
        if not seen["failures"]:
            failed = None
            done = tried if done is None else done.unionByName(tried)
            break
        broken = tried.where("error IS NOT NULL").select("block").distinct()
        good = tried.join(broken, "block", "left_anti")
        done = good if done is None else done.unionByName(good)
        failed = tried.join(broken, "block", "left_semi")
        todo = rows.join(broken.withColumnRenamed("block", block), block, "left_semi")
    if failed is not None:
        none = failed.withColumn("vec", F.lit(None).cast("array<double>"))
        done = none if done is None else done.unionByName(none)
    return done.select("id", "block", "vec", "model", "error")
