"""Queries over trail files: write and read back, compaction, retention, export, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.functions import ulid
from sparktrail.operators import daystore, lifecycle, trail
from sparktrail.operators.filters import DetectionFilter, matches
from sparktrail.plans import fixtures as X
from sparktrail.plans import trail as trail_plans
from sparktrail.session import scratch_path
from sparktrail.sources import files
from sparktrail.sources.tables import spread, table
from sparktrail.streaming import jobs

FILTER = DetectionFilter(sources=(V.HOOK_SOURCE,), severities=("high", "critical"))


def trail_write_roundtrip(spark, sf):
    """Rows to JSON lines in day folders and back through the tolerant reader."""
    rows = X.trail(spark, sf)
    path = scratch_path(spark, "trail")
    envelope = rows.select(
        "id", F.col("ts_raw").alias("ts"), "session", "mcp", "type", "direction",
        F.col("rpc_id").alias("rpcId"), "method", "error", "source", "cwd",
        F.col("cc_session").alias("ccSession"), F.col("ts").alias("_day"),
    )
    files.write_trail(envelope.drop("_day"), path, F.to_timestamp("ts"))
    back = trail.parse_trail(files.read_trail_lines(spark, path, "*.txt"))
    return back.select("id", "ts_raw", "session", "mcp", "type", "direction", "rpc_id", "method", "error", "source", "cwd", "cc_session")


def ulid_decode(spark, sf):
    sessions = X.session_files(spark, sf)
    start = ulid.decode_millis(F.col("ulid"))
    return sessions.select(
        "session", "ulid", start.alias("start_ms"), ulid.day_floor(start).alias("day_ms"),
        ulid.encode_millis(ulid.day_floor(start), F.lit(V.DAY_FILE_TAIL)).alias("day_file"),
    )


def compact_candidates(spark, sf):
    chosen = lifecycle.compact_candidates(X.session_files(spark, sf), X.LATER)
    return chosen.select("session", "ulid", "day_ms", "day_file")


def _lines(spark, sf):
    events = table(spark, sf, "events")
    return events.selectExpr(
        "'s' || user_id AS session", "event_id AS line_no", "CASE WHEN event_id % 19 = 0 THEN NULL ELSE lpad(CAST(event_id AS STRING), 12, '0') END AS id",
        "CASE WHEN event_id % 19 = 0 THEN '{broken ' || event_id ELSE '{\"id\":\"' || event_id || '\"}' END AS raw",
    )


def compact_days(spark, sf):
    """Candidate sessions rewritten into day folders, then read back and counted."""
    candidates = lifecycle.compact_candidates(X.session_files(spark, sf), X.LATER)
    path = scratch_path(spark, "days")
    lifecycle.day_lines(_lines(spark, sf), candidates).select("day_file", F.col("raw").alias("value")).write.partitionBy(
        "day_file"
    ).option("maxRecordsPerFile", 5_000_000).text(path)
    back = spark.read.text(path)
    return back.groupBy("day_file").agg(
        F.count("*").alias("n_lines"), F.count_if(F.startswith("value", F.lit("{broken"))).alias("n_broken")
    )


def compact_idempotent(spark, sf):
    """Counters when a third of the lines is in the day files already."""
    candidates = lifecycle.compact_candidates(X.session_files(spark, sf), X.LATER)
    incoming = lifecycle.day_lines(_lines(spark, sf), candidates).select("session", "day_ms", "line_no", "id", "raw")
    existing = incoming.where("line_no % 3 = 0 AND id IS NOT NULL")
    appended = lifecycle.new_lines(incoming, existing, ["session", "line_no"])
    return lifecycle.compaction_counters(incoming, appended)


def retention_sweep(spark, sf):
    purged = lifecycle.purgeable(X.session_files(spark, sf), "30d", X.RETENTION_NOW)
    marker = lifecycle.purge_marker(lifecycle.purge_summary(purged, "30d"), X.RETENTION_NOW)
    return marker.select("session", "mcp", "type", "files_purged", "from_ms", "until_ms", "purge_mode")


def retention_survivors(spark, sf):
    """Rows left per session after the sweep."""
    purged = lifecycle.purgeable(X.session_files(spark, sf), "30d", X.RETENTION_NOW)
    return lifecycle.survivors(_lines(spark, sf), purged).groupBy("session").agg(F.count("*").alias("n"))


def trail_size(spark, sf):
    """Bytes and files of a written trail, from its listing."""
    path = scratch_path(spark, "size")
    lines = table(spark, sf, "events").selectExpr(*X.raw_trail_columns("spark")).select(F.col("raw").alias("value"))
    lines.repartition(4).write.text(path)
    return files.folder_size(spark, path, "*.txt")


def retention_days(spark, sf):
    """Compact some sessions, then all, then all again; purge; clear; and list and count what is left."""
    sessions = X.session_files(spark, sf)
    candidates = lifecycle.compact_candidates(sessions, X.LATER).select("session", "ulid", "day_ms", "day_file")
    incoming = _lines(spark, sf).join(candidates, "session").select("session", "ulid", "line_no", "id", "raw", "day_ms", "day_file")
    days = daystore.DayStore(spark, scratch_path(spark, "daystore"))
    for part in (incoming.where(F.pmod(F.xxhash64("session"), F.lit(2)) == 0), incoming, incoming):
        days.compact(part)
    days.purge(lifecycle.purgeable(sessions, "30d", X.RETENTION_NOW))
    days.clear()
    listed = days.listing().groupBy("day_file").agg(F.sum("n_lines").alias("n_listed"), F.count("*").alias("n_sessions"))
    found = days.lines().groupBy("day_file").agg(
        F.count("*").alias("n_lines"), F.count_if(F.startswith("raw", F.lit("{broken"))).alias("n_broken")
    )
    return listed.join(found, "day_file", "full_outer")


def retention_estimate(spark, sf):
    sessions = X.session_files(spark, sf)
    modes = ["30d", "90d", "365d", "never", "bogus"]
    parts = [lifecycle.purge_estimate(sessions, m, X.RETENTION_NOW) for m in modes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_jsonl(spark, sf):
    """Matching lines verbatim, written oldest first and read back."""
    lines = spread(table(spark, sf, "events")).selectExpr(*X.raw_trail_columns("spark")).select("raw")
    rows = trail.detection_rows(trail.parse_trail(lines), X.SELFTEST_MCP)
    keep = matches(DetectionFilter(categories=("pii_structured",), sources=(V.HOOK_SOURCE,)), X.NOW)
    path = scratch_path(spark, "jsonl")
    files.write_jsonl_export(rows.withColumn("args_summary", F.lit(None).cast("string")).where(keep), path)
    return spark.read.text(path).select(F.col("value").alias("raw"))


def export_csv(spark, sf):
    rows = X.trail(spark, sf).where("type IN ('mcp.request', 'mcp.detection_enrichment')")
    rows = rows.withColumn("mcp", F.concat("mcp", F.lit(', "x"')))
    path = scratch_path(spark, "csv")
    files.write_csv_export(lifecycle.export_rows(rows, matches(FILTER, X.NOW), ["id"]), path)
    schema = ", ".join(f"{c} STRING" for c in V.CSV_COLUMNS)
    back = spark.read.schema(schema).options(header="true", quote='"', escape='"').csv(path)
    return back.fillna("")


QUERIES = {
    "trail_write_roundtrip": trail_write_roundtrip,
    "ulid_decode": ulid_decode,
    "compact_candidates": compact_candidates,
    "compact_days": compact_days,
    "compact_idempotent": compact_idempotent,
    "retention_sweep": retention_sweep,
    "retention_survivors": retention_survivors,
    "retention_days": retention_days,
    "retention_estimate": retention_estimate,
    "export_jsonl": export_jsonl,
    "export_csv": export_csv,
    "stream_trail_ingest": lambda s, sf: jobs.run_trail_ingest(s, sf),
    "stream_outcomes": lambda s, sf: jobs.run_outcomes(s, sf),
    "stream_counts": lambda s, sf: jobs.run_counts(s, sf),
    "stream_sessions": lambda s, sf: jobs.run_sessions(s, sf),
    "stream_session_ends": lambda s, sf: jobs.run_session_ends(s, sf),
    "stream_alerts": lambda s, sf: jobs.run_alerts(s, sf),
    "stream_scores": lambda s, sf: jobs.run_scores(s, sf),
    "trail_size": trail_size,
}

_T = f"WITH t AS MATERIALIZED (SELECT *, rpc_id_type || ':' || coalesce(rpc_id, '') AS rk FROM ({X.select_sql(X.trail_columns('duckdb'), 'events')}))"
_MS = lambda s: f"(epoch_us(TIMESTAMP '{s}') // 1000)"
_DAY = "(ms - ms % 86400000)"
_ENC_DAY = X._ENCODE["duckdb"].replace("(ms //", f"({_DAY} //") + " || '0000000000000000'"
_F = f"WITH f AS MATERIALIZED ({X.session_files_sql()}), u AS (SELECT * FROM f WHERE ulid NOT LIKE 'notes-%')"
_CAND = (
    _F
    + f", c AS (SELECT session, ulid, {_DAY} AS day_ms, {_ENC_DAY} AS day_file FROM u WHERE terminal OR {_MS(X.LATER)} - epoch_us(last_ts) // 1000 > 604800000)"
    + ", l AS (SELECT 's' || user_id AS session, event_id, event_id % 19 = 0 AS broken FROM events)"
)
_OLD = f"{_MS(X.RETENTION_NOW)} - CAST(30 AS BIGINT) * 86400000"

ORACLES = {
    "trail_write_roundtrip": _T + "SELECT id, ts_raw, session, mcp, type, direction, rpc_id, method, error, source, cwd, cc_session FROM t",
    "ulid_decode": _F
    + f" SELECT session, ulid, ms AS start_ms, {_DAY} AS day_ms, {_ENC_DAY} AS day_file FROM u UNION ALL SELECT session, ulid, NULL, NULL, NULL FROM f WHERE ulid LIKE 'notes-%'",
    "compact_candidates": _CAND + "SELECT * FROM c",
    "compact_days": _CAND + "SELECT day_file, count(*) AS n_lines, count(*) FILTER (broken) AS n_broken FROM l JOIN c USING (session) GROUP BY day_file",
    "compact_idempotent": _CAND
    + """, j AS (SELECT *, event_id % 3 = 0 AND NOT broken AS dup FROM l JOIN c USING (session))
      SELECT count(DISTINCT session) AS files_compacted, count(*) FILTER (NOT dup) AS lines_appended, count(*) FILTER (dup) AS lines_skipped_duplicate,
      count(DISTINCT day_ms) AS days_touched FROM j""",
    "retention_sweep": _F
    + f" SELECT 'desktop' AS session, '-' AS mcp, 'app.retention_purged' AS type, count(*) AS files_purged, min(ms) AS from_ms, max(ms) AS until_ms, '30d' AS purge_mode"
    f" FROM u WHERE greatest(ms, epoch_us(last_ts) // 1000) < {_OLD} HAVING count(*) > 0",
    "retention_survivors": _F
    + f", p AS (SELECT session FROM u WHERE greatest(ms, epoch_us(last_ts) // 1000) < {_OLD})"
    + " SELECT 's' || user_id AS session, count(*) AS n FROM events WHERE 's' || user_id NOT IN (SELECT session FROM p) GROUP BY ALL",
    "retention_days": _CAND
    + f""", p AS (SELECT session FROM u WHERE greatest(ms, epoch_us(last_ts) // 1000) < {_OLD})
      SELECT day_file, count(*) AS n_listed, count(DISTINCT session) AS n_sessions, count(*) AS n_lines, count(*) FILTER (broken) AS n_broken
      FROM l JOIN c USING (session) WHERE session NOT IN (SELECT session FROM p) GROUP BY day_file""",
    "retention_estimate": _F
    + " "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS mode, count(*) FILTER (ms < {_MS(X.RETENTION_NOW)} - CAST({d} AS BIGINT) * 86400000) AS n FROM u" if d else f"SELECT '{m}', 0"
        for m, d in (("30d", 30), ("90d", 90), ("365d", 365), ("never", 0), ("bogus", 0))
    ),
    "export_jsonl": f"""WITH l AS ({X.select_sql(X.raw_trail_columns('duckdb'), 'events')}) SELECT raw FROM l WHERE event_id % 23 <> 0 AND event_id % 41 <> 0
      AND event_id % 29 <> 0 AND event_id % 31 <> 0 AND event_id % 37 <> 0 AND event_id % 4 <> 3 AND event_type <> 'purchase' AND event_id % 3 = 0""",
    "export_csv": _T
    + """, d AS (SELECT * FROM t WHERE type IN ('mcp.request', 'mcp.detection_enrichment')),
      use AS (SELECT session, rk, arg_max(tool_use_id, id) AS u FROM d WHERE type = 'mcp.request' AND tool_use_id IS NOT NULL GROUP BY ALL),
      tl AS (SELECT session, rk, arg_max(tool_name, id) AS n FROM d WHERE type = 'mcp.request' GROUP BY ALL),
      k AS (SELECT d.* REPLACE (CASE WHEN type = 'mcp.request' THEN tool_use_id ELSE coalesce(tool_use_id, u) END AS tool_use_id,
         CASE WHEN type = 'mcp.request' THEN tool_name ELSE coalesce(tool_name, n) END AS tool_name) FROM d LEFT JOIN use USING (session, rk) LEFT JOIN tl USING (session, rk)),
      b AS (SELECT tool_use_id FROM k WHERE tool_use_id IS NOT NULL GROUP BY tool_use_id HAVING count(DISTINCT coalesce(source, '')) = 2)
      SELECT ts_raw AS ts, mcp || ', "x"' AS mcp, type, CASE WHEN type = 'mcp.request' THEN 'tools/call' ELSE '' END AS method, coalesce(tool_name, '') AS tool, category, severity,
        CAST(n_findings AS VARCHAR) AS findings_count, coalesce(tool_use_id, '') AS cc_tool_use_id,
        CASE WHEN tool_use_id IN (SELECT tool_use_id FROM b) THEN 'wrapper' ELSE '' END AS paired_source
      FROM k WHERE source = 'claude-code' AND severity IN ('high', 'critical')""",
    "stream_trail_ingest": _T + "SELECT id, session, type FROM t",
    "stream_outcomes": _T
    + """, oc AS (SELECT session, rk, arg_max(CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END, id) AS outcome FROM t WHERE type = 'mcp.response' GROUP BY ALL)
      SELECT mcp, outcome, count(*) AS n FROM t LEFT JOIN oc USING (session, rk) WHERE type = 'mcp.request' GROUP BY ALL""",
    "stream_counts": _T
    + """, w AS (SELECT unnest(range(epoch_us(ts) // 3600000000 + 1, epoch_us(ts) // 3600000000 + 25)) * 3600 AS until_s, category, severity FROM t WHERE type = 'mcp.request')
      SELECT until_s, count(*) FILTER (category <> 'tool_call_allowed') AS flagged, count(*) FILTER (severity = 'critical') AS critical FROM w GROUP BY until_s""",
    "stream_sessions": _T
    + f""", s AS (SELECT session, max(epoch_us(ts) // 1000) AS last_ms, count(*) AS n, bool_or(value > 60) AS terminal FROM t GROUP BY session)
      SELECT * FROM s WHERE terminal OR {_MS(X.LATER)} - last_ms > 604800000""",
    "stream_session_ends": _T
    + f""", m AS (SELECT id, session, epoch_us(ts) // 1000 AS ms, event_id % 23 = 0 OR event_id % 29 = 0 AS terminal FROM t),
      o AS (SELECT *, CASE WHEN lag(terminal) OVER w OR ms - lag(ms) OVER w > 172800000 THEN 1 ELSE 0 END AS opens FROM m
        WINDOW w AS (PARTITION BY session ORDER BY ms, terminal, id)),
      r AS (SELECT *, sum(opens) OVER (PARTITION BY session ORDER BY ms, terminal, id) AS run FROM o),
      s AS (SELECT session, run, max(ms) AS last_ms, count(*) AS n, bool_or(terminal) AS marked, run < max(run) OVER (PARTITION BY session) AS followed FROM r GROUP BY session, run)
      SELECT session, last_ms, n, CASE WHEN marked THEN 'marker' ELSE 'silence' END AS reason FROM s
      WHERE marked OR followed OR {_MS(X.LATER)} - last_ms > 172800000""",
    "stream_alerts": trail_plans.ORACLES["alert_transitions"],
    "stream_scores": """WITH d AS (SELECT 'd' || doc_id AS id, len(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{2,}'), lambda w: length(w) > 5)) AS n FROM documents)
      SELECT id, CASE WHEN n > 0 THEN 'pii_detected' END AS category, CASE WHEN n > 0 THEN 'low' END AS severity, n AS n_findings FROM d""",
    "trail_size": f"WITH l AS ({X.select_sql(X.raw_trail_columns('duckdb'), 'events')}) SELECT CAST(sum(strlen(raw) + 1) AS BIGINT) AS total_bytes, 4 AS file_count FROM l",
}
