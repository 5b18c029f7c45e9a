"""Leaf truncation of oversize JSON payloads."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail import values as V

_RESULT = "struct<value:string,truncated:boolean,uncut:boolean>"


def _cut_json(limit: int):
    """Built on use and self-contained, so it travels to executors by value.

    Long leaves are replaced in the text itself; every other character stays as it is,
    so depth, number formats and escaped surrogates do not matter.
    """
    string = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\Z)', re.S)
    key = re.compile(r"[ \t\r\n]*+:")

    def is_json(payload):
        try:
            json.loads(payload, parse_int=str, parse_float=str)
        except RecursionError:
            return True  # too deep to be checked, which is no fault
        except ValueError:
            return False
        return True

    def leaf_size(token):
        if 4 * len(token) <= limit:
            return 0
        try:
            return len(json.loads(token).encode("utf-8", "surrogatepass"))
        except ValueError:
            return 0

    def one(payload):
        if payload is None:
            return None, False, False
        if not is_json(payload):
            return payload, False, True
        parts, done = [], 0
        for match in string.finditer(payload):
            size = leaf_size(match.group())
            if size > limit and not key.match(payload, match.end()):
                parts += [payload[done : match.start()], f'"[truncated {size} bytes]"']
                done = match.end()
        return "".join([*parts, payload[done:]]), bool(parts), False

    def batch(payloads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p) for p in payloads], columns=["value", "truncated", "uncut"])

    return F.pandas_udf(batch, _RESULT)


def truncate_leaves(df: DataFrame, payload: str, limit: int = V.MAX_LEAF_BYTES) -> DataFrame:
    """Truncate string leaves of a JSON column, any depth; adds ``truncated`` and ``uncut``.

    A document no longer than the limit cannot hold a longer leaf, so Python only
    receives the oversize ones (NULL is shipped for the rest). An oversize payload that
    is no JSON has no leaves: it passes unchanged and is marked ``uncut``.
    """
    cut = df.withColumn("_big", F.octet_length(payload) > limit).withColumn(
        "_cut", _cut_json(limit)(F.when(F.col("_big"), F.col(payload)))
    )
    rest = [c for c in df.columns if c != payload]
    return cut.select(
        *rest,
        F.when(F.col("_big"), F.col("_cut.value")).otherwise(F.col(payload)).alias(payload),
        F.coalesce(F.col("_big") & F.col("_cut.truncated"), F.lit(False)).alias("truncated"),
        F.coalesce(F.col("_big") & F.col("_cut.uncut"), F.lit(False)).alias("uncut"),
    )


def truncate_text(text: Column, limit: int = V.MAX_LEAF_BYTES) -> Column:
    """The same rule for a plain text column, natively."""
    size = F.octet_length(text)
    return F.when(size > limit, F.concat(F.lit("[truncated "), size.cast("string"), F.lit(" bytes]"))).otherwise(text)
