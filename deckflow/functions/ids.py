"""Stable identifiers computed from content, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
FIELD_SEPARATOR = "\x1f"
BASE62_DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
DECK_ID_BIT = 1 << 47
# ----------------------------------------------------------------------------

_HALF = 1 << 32


def _hex_to_bigint(h: Column) -> Column:
    return F.conv(h, 16, 10).cast("bigint")


def base62_of_hex64(h: Column) -> Column:
    """Base-62 text of an unsigned 64-bit number given as 16 hex digits.

    The number does not fit a bigint, so it is divided as two 32-bit halves.
    """
    start = F.struct(
        _hex_to_bigint(F.substring(h, 1, 8)).alias("hi"),
        _hex_to_bigint(F.substring(h, 9, 8)).alias("lo"),
        F.lit("").alias("out"),
    )

    def one_digit(acc: Column, _: Column) -> Column:
        low = (acc["hi"] % 62) * F.lit(_HALF) + acc["lo"]
        digit = F.substr(F.lit(BASE62_DIGITS), (low % 62 + 1).cast("int"), F.lit(1))
        done = (acc["hi"] == 0) & (acc["lo"] == 0)
        return F.struct(
            F.floor(acc["hi"] / 62).cast("bigint").alias("hi"),
            F.floor(low / 62).cast("bigint").alias("lo"),
            F.when(done, acc["out"]).otherwise(F.concat(digit, acc["out"])).alias("out"),
        )

    # 62^11 > 2^64: eleven digits always suffice.
    text = F.aggregate(F.sequence(F.lit(1), F.lit(11)), start, one_digit, lambda acc: acc["out"])
    return F.when(text == "", F.lit("0")).otherwise(text)


def root_subject(deck: Column) -> Column:
    return F.substring_index(deck, "::", 1)


def stable_guid(deck: Column, question: Column) -> Column:
    """The id of a card: the same deck and question always give the same one."""
    key = F.concat_ws(FIELD_SEPARATOR, root_subject(deck), deck, question)
    return base62_of_hex64(F.substring(F.sha1(key), 1, 16))


def checksum(text: Column) -> Column:
    return _hex_to_bigint(F.substring(F.sha1(F.substring(text, 1, 9)), 1, 8))


def deck_id(name: Column) -> Column:
    return _hex_to_bigint(F.substring(F.sha1(name), 1, 12)).bitwiseOR(F.lit(DECK_ID_BIT))


def deck_ancestors(name: Column) -> Column:
    """All prefixes of a ``::`` path, the path itself included."""
    parts = F.split(name, "::")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "::"),
    )


def pack_fields(*fields: Column) -> Column:
    return F.concat_ws(FIELD_SEPARATOR, *[F.coalesce(f, F.lit("")) for f in fields])


def unpack_field(packed: Column, position: int) -> Column:
    """Field ``position`` (from 1) of a packed value; a missing one is ''."""
    return F.coalesce(F.try_element_at(F.split(packed, FIELD_SEPARATOR), F.lit(position)), F.lit(""))
