"""Names, markers and text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Characters removed by a Unicode-aware strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Marker words that may end a file name without changing which document it is.
VARIANT_WORDS = "annotated|annoté|corrected|corrigé|solutions?|correction|notes?|slides?"
# Words that decide the kind of a document, strongest first.
CORRECTED_WORDS = "corrected|corrigé|solutions?|correction"
EXERCISE_WORDS = "td|tp|exercices?|worksheet"
ANNOTATED_WORDS = "annotated|annoté|notes?"
DOC_TYPES = ("lecture", "lecture_annotated", "td", "td_corrected")
ARTIFACT_SUFFIX = ".apkg"
DECK_SEPARATOR = "::"
PROBLEM_DECK = "Problems"
# Code fences around an answer.
FENCE_OPEN, FENCE_CLOSE = r"^```(?:json)?\s*", r"\s*```$"
# ----------------------------------------------------------------------------

_SPACE = r"[\s\x1c-\x1f]"
# A character of a term; all others separate terms.
TERM = r"[\p{L}\p{M}\p{N}_]"


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def base_name(stem: Column) -> Column:
    """The name shared by the variants of one document: at most one marker goes."""
    cut = F.regexp_replace(stem, rf"(?iuU){_SPACE}*({VARIANT_WORDS}){_SPACE}*$", "")
    return F.lower(strip(cut))


def doc_type(stem: Column) -> Column:
    def has(words: str) -> Column:
        return stem.rlike(rf"(?iuU)\b({words})\b")

    return (
        F.when(has(CORRECTED_WORDS), "td_corrected")
        .when(has(EXERCISE_WORDS), "td")
        .when(has(ANNOTATED_WORDS), "lecture_annotated")
        .otherwise("lecture")
    )


def subject_of_folder(folder: Column, root: str, fallback: Column) -> Column:
    """Folder below ``root`` as a ``::`` path; the root itself takes ``fallback``.

    A folder outside the root is known by its own last segment.
    """
    root = root.rstrip("/")
    inside = (folder == root) | folder.startswith(root + "/")
    below = F.substr(folder, F.lit(len(root) + 1))
    own_name = F.regexp_extract(folder, r"([^/]+)/*$", 1)
    segments = F.filter(
        F.split(F.when(inside, below).otherwise(own_name), "/"),
        lambda s: ~s.isin("", "."),
    )
    named = F.transform(segments, lambda s: strip(F.replace(s, F.lit("_"), F.lit(" "))))
    return F.when(F.size(segments) > 0, F.array_join(named, "::")).otherwise(fallback)


def artifact_name(subject: Column, suffix: str = ARTIFACT_SUFFIX) -> Column:
    """A file name for a subject: punctuation goes, white space becomes ``_``."""
    safe = F.regexp_replace(subject, r"(?U)[^\w\s\x1c-\x1f-]", "")
    return F.concat(F.regexp_replace(strip(safe), rf"(?U){_SPACE}+", "_"), F.lit(suffix))


def deck_name(subject: Column, theme: Column, kind: Column) -> Column:
    """``subject::theme``, with a ``Problems`` child for problem cards."""
    return F.concat_ws(
        DECK_SEPARATOR, subject, theme, F.when(kind == "problem", F.lit(PROBLEM_DECK))
    )


def card_text(question: Column, answer: Column) -> Column:
    empty = F.lit("")
    return strip(F.concat(F.coalesce(question, empty), F.lit(" "), F.coalesce(answer, empty)))


def strip_fences(raw: Column) -> Column:
    """Remove a Markdown code fence around an answer."""
    opened = F.regexp_replace(strip(raw), f"(?U){FENCE_OPEN}", "")
    return strip(F.regexp_replace(opened, f"(?U){FENCE_CLOSE}", ""))
