"""Order-dependent operators that survive hot keys.

A plain window puts all rows of one key into one task. Here a key's timeline is
cut into chunks (a monotone expression of the order, such as the minute): windows
run per (key, chunk), and only one summary row per chunk crosses chunk borders.
A key that owns a third of all rows is then spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 60


def time_chunk(ts: Column, seconds: int = CHUNK_SECONDS) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds)


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: Column,
    out: str,
) -> DataFrame:
    """Add ``out``: the latest non-null ``value`` strictly before the row in its key.

    With a value that is never null this is ``lag``; with a sparse one it is a
    backward as-of lookup.
    """
    cols = df.columns
    staged = df.select("*", chunk.alias("_chunk"), value.alias("_value"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    here = F.last("_value", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, -1))
    tails = staged.groupBy(*keys, "_chunk").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_tail")
    )
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "_chunk", F.last("_tail", ignorenulls=True).over(across).alias("_carried"))
    carried = carried.where(F.col("_carried").isNotNull())
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_chunk"]]
    joined = staged.withColumn("_here", here).alias("l").join(carried.alias("r"), on, "left")
    return joined.select(*[F.col(f"l.{c}") for c in cols], F.coalesce("l._here", "r._carried").alias(out))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where null meets null: rows without a chunk are a chunk too."""
    named = right.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]).drop(*[f"_r{k}" for k in keys])


def rank_in_order(df: DataFrame, chunks: Sequence[Column], order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: the 0-based position of each row in the total order.

    ``chunks`` are monotone prefixes of the order, coarse to fine. Rows before a
    chunk are counted from chunk sizes; only rows of one finest chunk are sorted
    together.
    """
    cols = df.columns
    names = [f"_c{i}" for i in range(len(chunks))]
    staged = df.select("*", *[c.alias(n) for c, n in zip(chunks, names)])
    sizes = staged.groupBy(*names).agg(F.count("*").alias("_n"))
    ranked = staged.withColumn("_pos", F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1)
    for depth in range(len(names), 0, -1):
        upto, outer = names[:depth], names[: depth - 1]
        level = sizes.groupBy(*upto).agg(F.sum("_n").alias("_n"))
        before = Window.partitionBy(*outer).orderBy(names[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        starts = level.select(*upto, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        ranked = _join_null_safe(ranked, starts, upto).withColumn("_pos", F.col("_pos") + F.col("_start")).drop("_start")
    return ranked.select(*cols, F.col("_pos").cast("bigint").alias(out))


def runs(df: DataFrame, key: str, order: Sequence[str], chunk: Column, out: str) -> DataFrame:
    """Number maximal runs of equal ``key`` in the total order (gaps and islands)."""
    cols = df.columns
    with_prev = last_before(df.withColumn("_all", F.lit(0)), ["_all"], order, chunk, F.struct(key), "_prev")
    changed = with_prev.withColumn(
        "_new", F.when(F.col("_prev").isNull() | ~F.col(f"_prev.{key}").eqNullSafe(F.col(key)), 1).otherwise(0)
    ).withColumn("_chunk", chunk)
    local = Window.partitionBy("_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per_chunk = changed.groupBy("_chunk").agg(F.sum("_new").alias("_n"))
    # One row per chunk of time: small by construction, so one task may order it.
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_chunk.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = _join_null_safe(changed.withColumn("_in", F.sum("_new").over(local)), starts, ["_chunk"])
    return numbered.select(*cols, (F.col("_in") + F.col("_start")).alias(out))
