"""Keyed fingerprints and masking, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktrail import values as V


def hmac_sha256(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex. The two padded keys are constants of the plan."""
    block = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def fingerprint(secret: Column, key: bytes) -> Column:
    return F.substr(hmac_sha256(secret, key), F.lit(1), F.lit(V.FINGERPRINT_HEX))


def mask_of(secret: Column, key: bytes) -> Column:
    return F.concat(
        F.substr(secret, F.lit(1), F.lit(V.CLEAR_PREFIX_CHARS)), F.lit("…[fp:"), fingerprint(secret, key), F.lit("]")
    )


def distinct_longest_first(secrets: Column) -> Column:
    kept = F.filter(F.array_distinct(secrets), lambda s: F.length(s) > 0)
    return F.array_sort(kept, lambda a, b: F.length(b) - F.length(a))


def mask_text(text: Column, secrets: Column, key: bytes) -> Column:
    """Replace every occurrence of every secret, longest first, literally."""
    masked = F.aggregate(
        distinct_longest_first(secrets), text, lambda acc, s: F.replace(acc, s, mask_of(s, key))
    )
    return F.when(F.size(secrets) > 0, masked).otherwise(text)


def fingerprints_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[fp:([0-9a-f]{16})\]"), 1)
