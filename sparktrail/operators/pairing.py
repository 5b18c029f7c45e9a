"""Request/response pairing and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.operators.ordered import last_before, rank_in_order

SEQ_CHUNK = 65536


def pair_responses(frames: DataFrame) -> DataFrame:
    """Match responses to requests; add request_direction, request_method, latency_ms.

    A response takes the latest request of its (session, inverted direction, id)
    that no other response took; a repeated request replaces the pending one. So
    it matches exactly when the row before it in that key is a request.

    Keys are cut by sequence number, so at most ``SEQ_CHUNK`` frames of a key
    meet in one task. Frames that cannot pair bypass the shuffle.
    """
    inverted = F.when(F.col("direction") == V.CLIENT_TO_SERVER, V.SERVER_TO_CLIENT).otherwise(V.CLIENT_TO_SERVER)
    pairable = frames.where(F.col("kind").isin("request", "response")).withColumn(
        "request_direction", F.when(F.col("kind") == "request", F.col("direction")).otherwise(inverted)
    )
    chunk = F.floor(F.col("seq") / SEQ_CHUNK)
    prev = F.struct("kind", "method", "ts_ms")
    keyed = last_before(pairable, ["session", "request_direction", "rpc_id"], ["seq"], chunk, prev, "_prev")
    matched = (F.col("kind") == "response") & (F.col("_prev.kind") == "request")
    return keyed.select(
        *pairable.columns,
        F.when(matched, F.col("_prev.method")).alias("request_method"),
        F.when(matched, F.col("ts_ms") - F.col("_prev.ts_ms")).alias("latency_ms"),
    )


def session_stats(frames: DataFrame) -> DataFrame:
    """Frame counts per direction and run time of each session."""
    return frames.groupBy("session").agg(
        F.count_if(F.col("direction") == V.CLIENT_TO_SERVER).alias("frames_in"),
        F.count_if(F.col("direction") == V.SERVER_TO_CLIENT).alias("frames_out"),
        (F.max("ts_ms") - F.min("ts_ms")).alias("runtime_ms"),
    )


def _at_rank(value: str, upto: Column, n: Column, total: Column, q: float) -> Column:
    """The histogram value that holds rank ``floor(q * total)``, as an aggregate."""
    rank = F.least(F.floor(F.lit(q) * total), total - 1)
    return F.max(F.when((rank >= upto - n) & (rank < upto), F.col(value)))


def latency_stats(samples: DataFrame, value: str, width: int = 4096) -> DataFrame:
    """n, min, mean, p50, p95, p99, max with rank ``floor(q * n)``, exact.

    Works on the histogram of distinct integer values: counts are cumulated per
    band of ``width`` values, so no task sorts the samples.
    """
    bands = samples.groupBy(value).agg(F.count("*").alias("n")).withColumn("_band", F.floor(F.col(value) / width))
    per_band = bands.groupBy("_band").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_band.select("_band", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy("_band").orderBy(value)
    placed = bands.join(starts, "_band").withColumn("_upto", F.col("_start") + F.sum("n").over(local))
    total = per_band.agg(F.sum("_n")).scalar()
    return placed.withColumn("_total", total).agg(
        F.sum("n").alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 2).alias("mean"),
        *[
            _at_rank(value, F.col("_upto"), F.col("n"), F.col("_total"), q).alias(name)
            for name, q in (("p50", 0.50), ("p95", 0.95), ("p99", 0.99))
        ],
    )


def latency_quintiles(samples: DataFrame, value: str, size: str, order: list[str]) -> DataFrame:
    """Mean and p95 latency per fifth of the samples by payload size.

    Fifths hold ``floor(n / 5)`` samples each, the last takes the remainder; with
    fewer than five samples only the last one is filled.
    """
    chunks = [F.col(size), F.floor(F.col(order[0]) / (1000 * 3600))]
    ranked = rank_in_order(samples, chunks, [size, *order], "_rank")
    per = F.floor(F.col("_total") / 5)
    bucket = F.when(per > 0, F.least(F.floor(F.col("_rank") / per), F.lit(4))).otherwise(4)
    total = samples.agg(F.count("*")).scalar()
    bucketed = ranked.withColumn("_total", total).withColumn("quintile", (bucket + 1).cast("bigint"))
    histogram = bucketed.groupBy("quintile", value).agg(
        F.count("*").alias("n"), F.min(size).alias("_min_size"), F.max(size).alias("_max_size")
    )
    # Distinct latencies per fifth: integers in milliseconds, not samples.
    upto = F.sum("n").over(Window.partitionBy("quintile").orderBy(value))
    size_of = F.sum("n").over(Window.partitionBy("quintile"))
    placed = histogram.withColumns({"_upto": upto, "_size": size_of})
    return placed.groupBy("quintile").agg(
        F.sum("n").alias("n"),
        F.min("_min_size").alias("min_chars"),
        F.max("_max_size").alias("max_chars"),
        F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 2).alias("mean"),
        _at_rank(value, F.col("_upto"), F.col("n"), F.col("_size"), 0.95).alias("p95"),
    )
