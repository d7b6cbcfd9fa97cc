"""Putting a document's text together from its pages or slides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckflow.functions.text import is_blank, strip

# --- fixed values -----------------------------------------------------------
SLIDE_HEADING = ("[Slide ", "]")
# ----------------------------------------------------------------------------


def assemble_pages(
    parts: DataFrame, keys: Sequence[str], part_no: str = "part_no", text: str = "text"
) -> DataFrame:
    """One text per document: stripped pages in order, a blank line between.

    A page with no text at all is left out; a page of white space stays as an
    empty part. A document whose pages all lack text keeps its row, with ''.
    """
    page = F.when(F.col(text) != "", strip(F.col(text)))
    joined = F.expr(f"listagg(_page, '\n\n') WITHIN GROUP (ORDER BY {part_no})")
    return (
        parts.select(*keys, part_no, page.alias("_page"))
        .groupBy(*keys)
        .agg(F.coalesce(joined, F.lit("")).alias("text"))
    )


def assemble_slides(
    shapes: DataFrame,
    keys: Sequence[str],
    slide_no: str = "part_no",
    shape_no: str = "shape_no",
    text: str = "text",
) -> DataFrame:
    """One text per deck of slides; each slide is headed by its own number.

    ``slide_no`` counts from 1 over all slides, also those without text, which
    are left out without renumbering the others.
    """
    slides = (
        shapes.where(~is_blank(F.col(text)))
        .select(*keys, slide_no, shape_no, strip(F.col(text)).alias("_shape"))
        .groupBy(*keys, slide_no)
        .agg(F.expr(f"listagg(_shape, '\n') WITHIN GROUP (ORDER BY {shape_no})").alias("_body"))
    )
    headed = slides.withColumn(
        "_slide",
        F.concat(
            F.lit(SLIDE_HEADING[0]),
            F.col(slide_no).cast("string"),
            F.lit(SLIDE_HEADING[1] + "\n"),
            F.col("_body"),
        ),
    )
    return headed.groupBy(*keys).agg(
        F.expr(f"listagg(_slide, '\n\n') WITHIN GROUP (ORDER BY {slide_no})").alias("text")
    )


def with_sidecar(
    documents: DataFrame,
    sidecars: DataFrame,
    on: Sequence[str],
    text: str = "text",
    sidecar: str = "sidecar",
) -> DataFrame:
    """Give a document without text the stripped text of its sidecar, else ''."""
    side = sidecars.select(*on, F.col(sidecar).alias("_sidecar"))
    own = F.when(~is_blank(F.col(text)), F.col(text))
    return (
        documents.join(side, list(on), "left")
        .withColumn(text, F.coalesce(own, strip(F.col("_sidecar")), F.lit("")))
        .drop("_sidecar")
    )


def drop_blank(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.where(~is_blank(F.col(text)))
