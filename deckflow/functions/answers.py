"""Reading model answers: fences, broken escapes, typed fields with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deckflow.functions.text import strip_fences

# --- fixed values -----------------------------------------------------------
# Backslashes before these are meant as JSON escapes; all others belong to the text.
GENUINE_ESCAPE = r'["\\/]|[bfnrt](?![A-Za-z])|u[0-9A-Fa-f]{4}'
# ----------------------------------------------------------------------------

CARDS_SCHEMA = "array<struct<question:string,answer:string,note:string>>"
THEMES_SCHEMA = (
    "array<struct<name:string,recall_concepts:array<string>,problem_types:array<string>>>"
)
RESOLVED_SCHEMA = "map<string,array<string>>"


def _closers(text: Column) -> Column:
    """What a cut-off JSON text lacks at its end: a quote, and brackets from the inside out.

    Outside of quoted strings, a fold over the brackets keeps those that are still to be
    closed, whatever their number.
    """
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    quote = F.when(bare.contains('"'), '"').otherwise("")
    left = F.regexp_replace(F.regexp_replace(bare, r'(?s)".*', ""), r"[^\[\]{}]", "")

    def step(still: Column, c: Column) -> Column:
        opened = F.when(c == "[", F.concat(F.lit("]"), still)).when(c == "{", F.concat(F.lit("}"), still))
        return F.coalesce(opened, F.substr(still, F.lit(2)))

    brackets = F.aggregate(F.filter(F.split(left, ""), lambda c: c != ""), F.lit(""), step)
    return F.struct(quote.alias("quote"), brackets.alias("brackets"))


def _closed(text: Column) -> list[Column]:
    """Cut-off texts with their ends put in: after a value, a key, or a comma."""
    end = _closers(text)
    whole = F.concat(text, end["quote"])
    bare = F.regexp_replace(whole, r"[,\s]+$", "")
    return [
        F.concat(bare, end["brackets"]),
        F.concat(F.regexp_replace(bare, r":\s*$", ""), F.lit(": null"), end["brackets"]),
    ]


def parse_answer(raw: Column) -> Column:
    """A struct ``(json, text, repair, suspect)`` for a raw answer.

    The strict parse comes first, since repairing a valid text would double its
    escapes. ``repair`` says which attempt succeeded (0 strict, 1 every lone
    backslash doubled, 2 the same but pairs left alone, 3 the same with a cut-off end
    closed) and is NULL when none did. ``text`` is the text that parsed; it keeps the
    order of keys, which ``json`` does not. ``suspect`` marks valid text whose escapes
    became control characters, the sign of a LaTeX command read as an escape.
    """
    text = strip_fences(raw)
    every = F.regexp_replace(text, rf"\\(?!{GENUINE_ESCAPE})", r"\\\\")
    paired = F.regexp_replace(
        text, rf"(?<!\\)((?:\\\\)*)\\(?!{GENUINE_ESCAPE})", r"$1\\\\"
    )
    starts = paired.rlike(r"^[\[{]")
    closed = [F.when(starts, t) for t in _closed(paired)]

    def first(*tries: tuple[Column, int]) -> Column:
        """The first text that parses, with its value."""
        listed = F.array(*[F.struct(t.alias("text"), F.lit(k).alias("repair")) for t, k in tries])
        tried = F.transform(
            listed,
            lambda a: F.struct(F.try_parse_json(a["text"]).alias("json"), a["text"].alias("text"), a["repair"].alias("repair")),
        )
        return F.get(F.filter(tried, lambda t: t["json"].isNotNull()), F.lit(0))

    # Repairs are worked out only where what stands before them failed.
    found = F.coalesce(first((text, 0)), first((every, 1), (paired, 2)), first((closed[0], 3), (closed[1], 3)))
    told = F.transform(
        F.array(found),
        lambda f: F.struct(
            f["json"].alias("json"),
            f["text"].alias("text"),
            f["repair"].alias("repair"),
            F.coalesce((f["repair"] == 0) & f["text"].rlike(r"\\[bfrt][A-Za-z]"), F.lit(False)).alias("suspect"),
        ),
    )
    return F.get(told, F.lit(0))


def _typed(json: Column, path: str, schema: str) -> Column:
    return F.try_variant_get(json, path, schema)


def cards_of(json: Column) -> Column:
    """The cards of an answer; a missing list is empty."""
    return F.coalesce(_typed(json, "$.flashcards", CARDS_SCHEMA), F.array().cast(CARDS_SCHEMA))


def subject_of(json: Column) -> Column:
    return _typed(json, "$.subject", "string")


def themes_of(json: Column) -> Column:
    return F.coalesce(_typed(json, "$.themes", THEMES_SCHEMA), F.array().cast(THEMES_SCHEMA))


def resolved_of(text: Column) -> Column:
    """Canonical theme -> aliases, in the order the answer lists them."""
    empty = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    )
    read = F.from_json(text, f"resolved {RESOLVED_SCHEMA}")["resolved"]
    return F.coalesce(read, empty)


def new_themes_of(json: Column) -> Column:
    return F.coalesce(
        _typed(json, "$.new_themes", "array<string>"), F.array().cast("array<string>")
    )


def redundant_of(json: Column) -> Column:
    """True only for an explicit yes; anything else keeps both cards."""
    return F.coalesce(_typed(json, "$.redundant", "boolean"), F.lit(False))
