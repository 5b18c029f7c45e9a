"""Retention, compaction and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.functions import ulid
from sparktrail.operators import assemble
from sparktrail.operators.trail import dedupe_first

TERMINAL_TYPES = ("proxy.shutdown", "proxy.child_exited")


def terminal_marker() -> Column:
    ended = (F.col("type") == "cc.event") & (F.col("hook_event") == "SessionEnd")
    return F.coalesce(F.col("type").isin(*TERMINAL_TYPES) | ended, F.lit(False))


def session_summary(rows: DataFrame, terminal: Column) -> DataFrame:
    """One row per session file: first and last time, whether it ended."""
    return rows.groupBy("session").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bool_or(terminal).alias("terminal")
    )


def _millis(text: str) -> Column:
    return F.unix_millis(F.to_timestamp(F.lit(text)))


# --- compaction --------------------------------------------------------------


def compact_candidates(files: DataFrame, now: str) -> DataFrame:
    """Ended sessions, or silent for more than seven days; day files are left alone.

    Adds the UTC day of the session start and the name of that day's file.
    """
    start = ulid.decode_millis(F.col("ulid"))
    day = ulid.day_floor(start)
    silent = _millis(now) - F.unix_millis("last_ts") > V.SILENCE_DAYS * 86400000
    own = start.isNotNull() & ~F.endswith("ulid", F.lit(V.DAY_FILE_TAIL))
    chosen = files.where(own & (F.col("terminal") | silent))
    return chosen.withColumn("day_ms", day).withColumn("day_file", ulid.encode_millis(day, F.lit(V.DAY_FILE_TAIL)))


def day_lines(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """Lines of the candidates with their day, laid out for writing.

    Range partitioning by (day, file, line) keeps the order of each day and cuts
    a day with very many lines into several files.
    """
    placed = lines.join(candidates.select("session", "ulid", "day_ms", "day_file"), "session")
    # Day files sort like days, and a write partitioned by them keeps this order.
    place = ["day_file", "ulid", "line_no"]
    return placed.repartitionByRange(*place).sortWithinPartitions(*place)


def new_lines(incoming: DataFrame, existing_ids: DataFrame, order: list[str]) -> DataFrame:
    """Incoming lines a day file does not have yet.

    Lines without an id (malformed ones) are always kept. Copies inside the batch
    are dropped too, first one wins.
    """
    with_id = dedupe_first(incoming.where("id IS NOT NULL"), order)
    fresh = with_id.join(existing_ids.select("id"), "id", "left_anti")
    return fresh.unionByName(incoming.where("id IS NULL"))


def compaction_counters(incoming: DataFrame, appended: DataFrame) -> DataFrame:
    """Files compacted, lines appended, duplicates skipped, days touched."""
    before = incoming.groupBy("day_ms", "session").agg(F.count("*").alias("lines_in"))
    after = appended.groupBy("day_ms", "session").agg(F.count("*").alias("lines_out"))
    per_file = before.join(after, ["day_ms", "session"], "left")
    per_day = per_file.groupBy("day_ms").agg(
        F.count("*").alias("files"), F.sum("lines_in").alias("lines_in"), F.sum("lines_out").alias("lines_out")
    )
    appended_total = F.coalesce(F.sum("lines_out"), F.lit(0))
    return per_day.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files_compacted"),
        appended_total.alias("lines_appended"),
        (F.coalesce(F.sum("lines_in"), F.lit(0)) - appended_total).alias("lines_skipped_duplicate"),
        F.count("*").alias("days_touched"),
    )


# --- retention ---------------------------------------------------------------


def _cutoff(mode: str, now: str) -> Column:
    return _millis(now) - V.PURGE_DAYS[mode] * 86400000


def purgeable(files: DataFrame, mode: str, now: str) -> DataFrame:
    """Files whose start and last write are both older than the mode allows.

    Names that are no ULIDs are kept for good; ``never`` purges nothing.
    """
    start = ulid.decode_millis(F.col("ulid"))
    if mode not in V.PURGE_DAYS:
        return files.where(F.lit(False))
    return files.where(F.greatest(start, F.unix_millis("last_ts")) < _cutoff(mode, now)).where(start.isNotNull())


def survivors(lines: DataFrame, purged: DataFrame) -> DataFrame:
    return lines.join(purged.select("session"), "session", "left_anti")


def purge_summary(purged: DataFrame, mode: str) -> DataFrame:
    """The fields of the one marker of a sweep; no row when nothing was purged."""
    start = ulid.decode_millis(F.col("ulid"))
    summed = purged.agg(F.count("*").alias("files_purged"), F.min(start).alias("from_ms"), F.max(start).alias("until_ms"))
    return summed.where("files_purged > 0").withColumn("purge_mode", F.lit(mode))


def purge_marker(summary: DataFrame, now: str) -> DataFrame:
    """The marker as a trail row."""
    return summary.select(
        F.sha2(F.concat_ws(":", F.lit("purge"), F.lit(now), "purge_mode"), 256).alias("id"),
        F.to_timestamp(F.lit(now)).alias("ts"),
        F.lit("desktop").alias("session"),
        F.lit("-").alias("mcp"),
        F.lit("app.retention_purged").alias("type"),
        "files_purged",
        "from_ms",
        "until_ms",
        "purge_mode",
    )


def purge_estimate(files: DataFrame, mode: str, now: str) -> DataFrame:
    """Files a mode would purge, by start time alone: looser than the sweep."""
    start = ulid.decode_millis(F.col("ulid"))
    old = start < _cutoff(mode, now) if mode in V.PURGE_DAYS else F.lit(False)
    return files.agg(F.count_if(old).alias("n")).select(F.lit(mode).alias("mode"), "n")


# --- export ------------------------------------------------------------------


def export_rows(rows: DataFrame, keep: Column, order: list[str]) -> DataFrame:
    """CSV rows of the detections that match, correlated over the whole trail.

    Keys and pairs are found before the filter: hiding one half of a pair must
    not unpair the other. Unlike assembled rows, every enrichment without a key
    inherits one.
    """
    keyed = assemble.rpc_key(rows)
    lent = assemble.call_attributes(keyed.where("type = 'mcp.request'"), order).select(
        *assemble.CALL, F.col("_use"), F.col("_shown.tool_name").alias("_tool")
    )
    enriched = F.col("type") == "mcp.detection_enrichment"
    filled = keyed.join(lent, assemble.CALL, "left").withColumns(
        {
            "tool_use_id": F.when(enriched, F.coalesce("tool_use_id", "_use")).otherwise(F.col("tool_use_id")),
            "tool_name": F.when(enriched, F.coalesce("tool_name", "_tool")).otherwise(F.col("tool_name")),
        }
    )
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return assemble.pair_sources(filled).where(keep).select(
        "id",
        F.col("ts_raw").alias("ts"),
        "mcp",
        "type",
        F.when(enriched, "").otherwise(text("method")).alias("method"),
        text("tool_name").alias("tool"),
        "category",
        "severity",
        F.col("n_findings").cast("string").alias("findings_count"),
        text("tool_use_id").alias("cc_tool_use_id"),
        text("paired_source").alias("paired_source"),
    )
