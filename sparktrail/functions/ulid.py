"""ULID times as pure expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktrail import values as V

VALID = "^[0-9A-HJKMNP-TV-Z]{26}$"


def is_ulid(name: Column) -> Column:
    return F.upper(name).rlike(VALID)


def decode_millis(name: Column) -> Column:
    """Milliseconds of the leading ten characters; NULL for anything not a ULID."""
    up = F.upper(name)
    alphabet = F.lit(V.ULID_ALPHABET)
    millis = F.aggregate(
        F.sequence(F.lit(1), F.lit(10)),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc * 32 + F.instr(alphabet, F.substr(up, i, F.lit(1))).cast("bigint") - 1,
    )
    return F.when(is_ulid(name), millis)


def encode_millis(ms: Column, tail: Column) -> Column:
    """Ten big-endian characters for ``ms`` followed by ``tail``."""
    parts = []
    for k in range(9, -1, -1):
        digit = F.shiftright(ms.cast("bigint"), 5 * k).bitwiseAND(F.lit(31)).cast("int")
        parts.append(F.substr(F.lit(V.ULID_ALPHABET), digit + 1, F.lit(1)))
    return F.concat(*parts, tail)


def day_floor(ms: Column) -> Column:
    """Start of the UTC day, in milliseconds."""
    return ms - F.pmod(ms, F.lit(86400000))
