"""Auth alerts and token events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.operators.ordered import last_before, time_chunk


def oauth_failure() -> Column:
    """A proxy error that is a failed authorization; other kinds of errors are no auth failures."""
    return F.coalesce((F.col("type") == "proxy.error") & (F.col("kind") == "oauth_failed"), F.lit(False))


def auth_signal(failure: Column, recovery_type: str = "app.connector_recovered") -> Column:
    """fail / live / recovery of a trail row; hook rows say nothing about a connector."""
    hook = F.coalesce(F.col("source") == V.HOOK_SOURCE, F.lit(False))
    return F.when(
        ~hook,
        F.when(failure, "fail")
        .when(F.startswith("type", F.lit("mcp.")), "live")
        .when(F.col("type") == recovery_type, "recovery"),
    )


def auth_alerts(signals: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Connectors whose last failure is recent and not followed by anything later.

    One conditional aggregate. A signal of the same instant does not clear a
    failure.
    """
    kind = F.col("signal")
    latest = signals.where(kind.isNotNull()).groupBy("mcp").agg(
        F.max(F.when(kind == "fail", F.col("ts_raw"))).alias("last_failure"),
        F.max_by("message", F.when(kind == "fail", F.struct("ts_raw", "id"))).alias("message"),
        F.max(F.when(kind != "fail", F.col("ts_raw"))).alias("_later"),
    )
    recent = F.to_timestamp("last_failure") >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(hours=F.lit(hours))
    cleared = F.coalesce(F.col("last_failure") < F.col("_later"), F.lit(False))
    return latest.where(recent & ~cleared).select("mcp", "last_failure", "message")


def alert_states(signals: DataFrame, seconds: int = 86400) -> DataFrame:
    """Whether each connector alerts at the end of each tick, for a series of ticks.

    Rows are first reduced to one per (connector, tick); the running maxima then
    run over ticks only.
    """
    kind = F.col("signal")
    tick = F.floor(F.unix_seconds("ts") / seconds)
    seen = signals.where(kind.isNotNull()).groupBy("mcp", tick.alias("tick")).agg(
        F.max(F.when(kind == "fail", F.col("ts_raw"))).alias("_fail"),
        F.max(F.when(kind != "fail", F.col("ts_raw"))).alias("_later"),
    )
    until = seen.agg(F.max("tick")).scalar()
    spans = seen.groupBy("mcp").agg(F.min("tick").alias("_since")).withColumn("_until", until)
    grid = spans.select("mcp", F.explode(F.sequence("_since", "_until")).alias("tick"))
    running = Window.partitionBy("mcp").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(seen, ["mcp", "tick"], "left").select(
        "mcp", "tick", F.max("_fail").over(running).alias("_fail"), F.max("_later").over(running).alias("_later")
    )
    end = F.timestamp_seconds((F.col("tick") + 1) * seconds)
    recent = F.to_timestamp("_fail") >= end - F.make_dt_interval(hours=F.lit(24))
    cleared = F.coalesce(F.col("_fail") < F.col("_later"), F.lit(False))
    return filled.select("mcp", "tick", F.coalesce(recent & ~cleared, F.lit(False)).alias("active"))


def alert_transitions(states: DataFrame) -> DataFrame:
    """Connectors to notify: alerting now and not at the tick before.

    The first tick only seeds. A connector that recovers and fails again
    notifies again.
    """
    first = states.agg(F.min("tick")).scalar()
    before = F.lag("active").over(Window.partitionBy("mcp").orderBy("tick"))
    edged = states.withColumn("_before", F.coalesce(before, F.lit(False))).withColumn("_first", first)
    return edged.where(F.col("active") & ~F.col("_before") & (F.col("tick") > F.col("_first"))).select("mcp", "tick")


def token_asof(rows: DataFrame, failure: Column, token: Column) -> DataFrame:
    """Failures with the latest token event of their session before them, and its age."""
    marked = rows.select(
        "id", "session", "ts", failure.alias("_failure"), F.when(token, F.struct("type", "ts")).alias("_token")
    )
    looked = last_before(marked, ["session"], ["ts", "id"], time_chunk(F.col("ts"), 86400), F.col("_token"), "_last")
    return looked.where("_failure").select(
        "id",
        F.col("_last.type").alias("last_token_event"),
        (F.unix_millis("ts") - F.unix_millis("_last.ts")).alias("ago_ms"),
    )
