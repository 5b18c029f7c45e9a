"""Successive snapshots of sets: distinct changes, vanished members, presence edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_digest(*parts: Column) -> list[Column]:
    """Aggregates whose equality means equal sets, in any order and any split.

    Each distinct element is hashed to 256 bits, and four 60-bit limbs are summed.
    Unlike a hash of a sorted list it needs no group in one place.
    """
    hashed = F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
    limbs = [F.conv(F.substr(hashed, F.lit(1 + 15 * k), F.lit(15)), 16, 10).cast("decimal(20,0)") for k in range(4)]
    return [F.count("*").alias("n"), *[F.sum(limb).cast("string").alias(f"h{k}") for k, limb in enumerate(limbs)]]


def digest_text() -> Column:
    return F.sha2(F.concat_ws("|", F.col("n").cast("string"), "h0", "h1", "h2", "h3"), 256)


def snapshot_hashes(members: DataFrame, keys: Sequence[str], tick: str, *parts: str) -> DataFrame:
    """One digest per (keys, tick) over distinct members."""
    distinct = members.select(*keys, tick, *parts).distinct()
    return distinct.groupBy(*keys, tick).agg(*set_digest(*[F.col(p) for p in parts])).select(
        *keys, tick, "n", digest_text().alias("hash")
    )


def snapshot_changes(hashes: DataFrame, keys: Sequence[str], tick: str) -> DataFrame:
    """Keep snapshots that differ from the one before; add the previous kept tick.

    Windows run over one row per snapshot, not over members.
    """
    timeline = Window.partitionBy(*keys).orderBy(tick)
    changed = hashes.withColumn("_prev", F.lag("hash").over(timeline)).where(~F.col("hash").eqNullSafe(F.col("_prev")))
    return changed.withColumn("prev_tick", F.lag(tick).over(timeline)).drop("_prev")


def vanished(
    members: DataFrame, changes: DataFrame, excluded: DataFrame, keys: Sequence[str], tick: str, name: str
) -> DataFrame:
    """Members of the previous distinct snapshot that are gone and were not removed on purpose."""
    present = members.select(*keys, tick, name).distinct()
    steps = changes.where(F.col("prev_tick").isNotNull()).select(*keys, F.col(tick).alias("_now"), F.col("prev_tick").alias(tick))
    before = present.join(steps, [*keys, tick]).select(*keys, F.col("_now").alias(tick), name)
    return before.join(present, [*keys, tick, name], "left_anti").join(
        excluded.select(*keys, name).distinct(), [*keys, name], "left_anti"
    )


def presence_edges(observed: DataFrame, keys: Sequence[str], tick: str, present: str) -> DataFrame:
    """seed / vanished / restored / none per observation, and whether a notice is pending."""
    timeline = Window.partitionBy(*keys).orderBy(tick)
    prev = F.lag(present).over(timeline)
    edge = (
        F.when(prev.isNull(), "seed")
        .when(prev & ~F.col(present), "vanished")
        .when(~prev & F.col(present), "restored")
        .otherwise("none")
    )
    edged = observed.withColumn("edge", edge)
    last = F.last(F.when(F.col("edge") != "none", F.col("edge")), ignorenulls=True)
    return edged.withColumn("notice_pending", last.over(timeline) == "vanished")


def inventory_coverage(entries: DataFrame) -> DataFrame:
    """Connector entries of many hosts by type and audit status."""
    wrapped = F.col("reason") == "already-wrapped"
    kind = (
        F.when(F.col("kind") == "wrappable", "local")
        .when(wrapped & (F.col("transport") == "http"), "remote")
        .when(wrapped & (F.col("transport") == "stdio"), "local")
        .otherwise("unknown")
    )
    status = (
        F.when(F.col("kind") == "wrappable", "not-audited").when(wrapped, "audited").otherwise("unsupported")
    )
    typed = entries.select("host", kind.alias("type"), status.alias("status"))
    per_host = typed.groupBy("type", "status", "host").agg(F.count("*").alias("n"))
    return per_host.groupBy("type", "status").agg(F.sum("n").alias("n"), F.count("*").alias("n_hosts"))
