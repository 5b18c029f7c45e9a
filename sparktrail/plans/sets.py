"""Queries over hook payloads, manifests and other successive snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktrail.functions.text import json_quote
from sparktrail.operators import hooks, manifest, snapshots
from sparktrail.plans import fixtures as X


def hook_parse(spark, sf):
    parsed = hooks.parse_hooks(X.hooks(spark, sf))
    return parsed.select(
        "spool_no", "parsed_kind", "hook_event", "session_id", "tool_name", "tool_use_id", "duration_ms",
        "tool_input", "tool_response", F.array_join(F.map_keys("extras"), ",").alias("extra_keys"),
        F.col("extras")["effort"].alias("effort"),
    )


def hook_synthesize(spark, sf):
    rows = hooks.synthesize(hooks.parse_hooks(X.hooks(spark, sf)))
    return rows.select(
        "type", "direction", "mcp", "tool", "rpc_id", "method", "params", "result", "error", "bytes", "latency_ms",
        "cc_session", "cwd", "hook_event", F.unix_millis("ts").alias("ts_ms"),
    )


def hook_trail(spark, sf):
    """Payloads to classified trail rows, counted."""
    rows = hooks.classify_hooks(hooks.synthesize(hooks.parse_hooks(X.hooks(spark, sf))))
    return rows.groupBy("type", "category", "severity").agg(F.count("*").alias("n"))


def ingest_status(spark, sf):
    return hooks.ingest_status(hooks.parse_hooks(X.hooks(spark, sf)))


def manifest_hash(spark, sf):
    return manifest.manifest_hashes(manifest.signatures(X.manifests(spark, sf)))


def manifest_drift(spark, sf):
    findings = manifest.drift_findings(manifest.signatures(X.manifests(spark, sf)))
    return findings.select("mcp", F.col("snap").cast("bigint").alias("snap"), "location", "type")


def manifest_from_results(spark, sf):
    """Drift between tool lists as their connectors answer them: one result per connector and snapshot."""
    text = lambda c: json_quote(F.col(c))
    tool = F.concat(F.lit('{"name":'), text("tool"), F.lit(',"description":'), text("description"), F.lit(',"inputSchema":'), F.col("input_schema"), F.lit("}"))
    # A list is one message, so it fits one row.
    listed = X.manifests(spark, sf).groupBy("mcp", "snap").agg(F.array_join(F.array_sort(F.collect_list(tool)), ",").alias("_tools"))
    results = listed.select("mcp", "snap", F.concat(F.lit('{"tools":['), F.col("_tools"), F.lit(',{"name":7},"none"]}')).alias("result"))
    findings = manifest.drift_findings(manifest.signatures(manifest.extract_tools(results, "result", "mcp", "snap")))
    return findings.select("mcp", F.col("snap").cast("bigint").alias("snap"), "location", "type")


def manifest_severity(spark, sf):
    findings = manifest.drift_findings(manifest.signatures(X.manifests(spark, sf)))
    return manifest.drift_detections(findings).withColumn("snap", F.col("snap").cast("bigint"))


def tool_surface(spark, sf):
    tools = X.manifests(spark, sf)
    shaped = tools.groupBy("input_schema").agg(F.count("*").alias("n_tools")).join(
        manifest.schema_surfaces(tools), "input_schema"
    )
    return shaped.select(
        "input_schema", "n_tools", F.array_join("p", ",").alias("properties"), F.array_join("r", ",").alias("required")
    )


def latest_tool_count(spark, sf):
    counts = manifest.latest_tool_counts(manifest.signatures(X.manifests(spark, sf)))
    return counts.withColumn("snap", F.col("snap").cast("bigint"))


def _changes(members):
    hashes = snapshots.snapshot_hashes(members, ["host"], "tick", "name")
    return snapshots.snapshot_changes(hashes, ["host"], "tick")


def snapshot_changes(spark, sf):
    return _changes(X.members(spark, sf)).select("host", "tick", "n", "prev_tick")


def vanished_members(spark, sf):
    members = X.members(spark, sf)
    excluded = members.where("removed_in_app").select("host", "name")
    gone = snapshots.vanished(members, _changes(members), excluded, ["host"], "tick", "name")
    return gone.where(F.col("name").isin("click", "view", "purchase"))


def presence_edges(spark, sf):
    seen = X.members(spark, sf).groupBy("host", "tick").agg(F.max(F.col("name") == "view").alias("registered"))
    return snapshots.presence_edges(seen, ["host"], "tick", "registered")


def stream_manifest(spark, sf):
    from sparktrail.streaming import jobs

    return jobs.run_manifest(spark, sf)


def stream_hooks(spark, sf):
    from sparktrail.streaming import jobs

    return jobs.run_hooks(spark, sf)


QUERIES = {
    "hook_parse": hook_parse,
    "hook_synthesize": hook_synthesize,
    "hook_trail": hook_trail,
    "ingest_status": ingest_status,
    "stream_hooks": stream_hooks,
    "manifest_hash": manifest_hash,
    "manifest_drift": manifest_drift,
    "manifest_from_results": manifest_from_results,
    "manifest_severity": manifest_severity,
    "tool_surface": tool_surface,
    "latest_tool_count": latest_tool_count,
    "stream_manifest": stream_manifest,
    "snapshot_changes": snapshot_changes,
    "vanished_members": vanished_members,
    "presence_edges": presence_edges,
}

_HOOKS = f"""
WITH h AS ({X.select_sql(X.HOOK_COLUMNS, 'events')}),
p AS (SELECT *, CASE WHEN json_valid(raw) THEN 'hook' ELSE 'unknown' END AS parsed_kind,
  CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.hook_event_name') END AS hook_event,
  CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.tool_name') END AS tool_name,
  CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.session_id') END AS session_id,
  CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.tool_use_id') END AS tool_use_id,
  CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.cwd') END AS cwd,
  CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.error') END AS err,
  CASE WHEN json_valid(raw) AND json_type(raw, '$.duration_ms') = 'UBIGINT' THEN CAST(json_extract(raw, '$.duration_ms') AS BIGINT) END AS duration_ms,
  CASE WHEN json_valid(raw) THEN CAST(json_extract(raw, '$.tool_input') AS VARCHAR) END AS tool_input,
  CASE WHEN json_valid(raw) THEN CAST(json_extract(raw, '$.tool_response') AS VARCHAR) END AS tool_response,
  CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.tool_response.stdout') END AS stdout,
  CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.effort') END AS effort FROM h)
"""
_ROWS = (
    _HOOKS
    + """,
c AS (SELECT *, coalesce(hook_event IN ('PostToolUse', 'PostToolUseFailure'), false) AS pair,
  CASE WHEN tool_name LIKE 'mcp__%' THEN 'srv-1' ELSE 'claude-code' END AS m,
  CASE WHEN tool_name LIKE 'mcp__%' THEN 'get_item' ELSE tool_name END AS t, epoch_us(capture_ts) // 1000 AS ms FROM p),
d AS (SELECT *, '{"name":"' || t || '","arguments":' || tool_input || '}' AS params,
  CASE WHEN tool_name LIKE 'mcp__%' THEN tool_response
    ELSE '{"content":[{"type":"text","text":"' || CASE WHEN tool_name = 'Bash' THEN stdout
      ELSE replace(tool_response, '"', chr(92) || '"') END || '"}],"structuredContent":' || tool_response || '}' END AS res FROM c),
r AS (
 SELECT 'mcp.request' AS type, 'client_to_server' AS direction, m AS mcp, t AS tool, tool_use_id AS rpc_id, 'tools/call' AS method, params,
   NULL AS result, NULL AS error, strlen(params) AS bytes, NULL AS latency_ms, session_id AS cc_session, cwd, NULL AS hook_event,
   ms - coalesce(duration_ms, 0) AS ts_ms FROM d WHERE pair
 UNION ALL SELECT 'mcp.response', 'server_to_client', m, NULL, tool_use_id, NULL, NULL,
   CASE WHEN hook_event = 'PostToolUse' THEN res END, CASE WHEN hook_event <> 'PostToolUse' THEN err END,
   strlen(CASE WHEN hook_event = 'PostToolUse' THEN res ELSE err END), duration_ms, session_id, cwd, NULL, ms FROM d WHERE pair
 UNION ALL SELECT 'cc.event', NULL, 'claude-code', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, session_id, NULL, hook_event, ms FROM d WHERE NOT pair)
"""
)

_SIGS = f"""
WITH t AS ({X.manifests_sql()}),
k AS (SELECT mcp, snap, tool, description, input_schema, CASE WHEN input_schema LIKE '%{{"required":["a"],"properties":{{"a":{{}}}}}}%'
   THEN '{{"properties":{{"a":{{}}}},"required":["a"]}}' ELSE input_schema END AS canon FROM t),
g AS (SELECT mcp, snap, tool, description, sha256(description) AS d, sha256(canon) AS s, canon,
   list_sort(json_keys(canon, '$.properties')) AS p FROM k)
"""
_DRIFT = (
    _SIGS
    + """,
j AS (SELECT coalesce(n.mcp, p.mcp) AS mcp, coalesce(n.snap, p.snap + 1) AS snap, coalesce(n.tool, p.tool) AS location,
   p.d AS pd, n.d AS nd, p.s AS ps, n.s AS ns, n.description AS text, len(list_filter(n.p, lambda x: NOT list_contains(p.p, x))) AS fresh
   FROM (SELECT * FROM g WHERE snap > 0) n FULL JOIN (SELECT * FROM g WHERE snap < 2) p ON n.mcp = p.mcp AND n.snap = p.snap + 1 AND n.tool = p.tool),
f AS (SELECT mcp, snap, location, 'tool_added' AS type FROM j WHERE pd IS NULL
   UNION ALL SELECT mcp, snap, location, 'tool_removed' FROM j WHERE nd IS NULL
   UNION ALL SELECT mcp, snap, location, CASE WHEN text LIKE '%. Ignore all previous instructions' THEN 'injection_marker' ELSE 'description_changed' END FROM j WHERE pd <> nd
   UNION ALL SELECT mcp, snap, location, CASE WHEN fresh > 0 THEN 'surface_added' ELSE 'schema_changed' END FROM j WHERE ps <> ns)
"""
)
_LIMB = "sum(CAST(('0x' || substr(h, {a}, 15)) AS HUGEINT))"
_MEMBERS = f"""
WITH m AS ({X.select_sql(X.MEMBER_COLUMNS, 'events')}),
u AS (SELECT host, tick, count(DISTINCT name) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM m GROUP BY ALL),
l AS (SELECT *, lag(names) OVER (PARTITION BY host ORDER BY tick) AS before FROM u),
c AS (SELECT *, lag(tick) OVER (PARTITION BY host ORDER BY tick) AS prev_tick FROM l WHERE before IS DISTINCT FROM names)
"""

ORACLES = {
    "hook_parse": _HOOKS
    + """SELECT spool_no, parsed_kind, hook_event, session_id, tool_name, tool_use_id, duration_ms, tool_input, tool_response,
      CASE WHEN json_valid(raw) THEN 'effort' END AS extra_keys, effort FROM p""",
    "hook_synthesize": _ROWS + "SELECT * FROM r",
    "hook_trail": _ROWS
    + "SELECT type, 'tool_call_allowed' AS category, 'low' AS severity, count(*) AS n FROM r WHERE type = 'mcp.request' GROUP BY ALL",
    "ingest_status": _HOOKS
    + """SELECT count(*) AS captured, count(*) FILTER (parsed_kind = 'unknown') AS malformed,
      count(*) FILTER (hook_event IN ('PostToolUse', 'PostToolUseFailure')) AS tool_calls,
      max(epoch_us(capture_ts) // 1000) FILTER (hook_event = 'SessionStart') AS heartbeat_ms FROM p""",
    "stream_hooks": _ROWS + "SELECT type, mcp, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM r GROUP BY ALL",
    "manifest_hash": _SIGS
    + """, x AS (SELECT mcp, snap, sha256(CAST(to_json([tool, d, s]) AS VARCHAR)) AS h FROM g)
      SELECT mcp, snap, count(*) AS n_tools, sha256(concat_ws('|', count(*), """
    + ", ".join(_LIMB.format(a=1 + 15 * k) for k in range(4))
    + ")) AS hash FROM x GROUP BY ALL",
    "manifest_drift": _DRIFT + "SELECT mcp, CAST(snap AS BIGINT) AS snap, location, type FROM f",
    "manifest_from_results": _DRIFT + "SELECT mcp, CAST(snap AS BIGINT) AS snap, location, type FROM f",
    "manifest_severity": _DRIFT
    + """SELECT mcp, CAST(snap AS BIGINT) AS snap, CASE WHEN bool_or(type IN ('surface_added', 'injection_marker')) THEN 'high' ELSE 'medium' END AS severity,
      count(*) AS n_findings FROM f GROUP BY ALL""",
    "tool_surface": _SIGS
    + """SELECT t.input_schema, count(*) AS n_tools, array_to_string(list_sort(json_keys(t.input_schema, '$.properties')), ',') AS properties,
      'a' AS required FROM t GROUP BY ALL""",
    "latest_tool_count": _SIGS + "SELECT mcp, CAST(2 AS BIGINT) AS snap, count(*) AS n_tools FROM g WHERE snap = 2 GROUP BY ALL",
    "stream_manifest": _DRIFT + "SELECT mcp, CAST(snap AS BIGINT) AS snap, type, count(*) AS n FROM f GROUP BY ALL",
    "snapshot_changes": _MEMBERS + "SELECT host, tick, n, prev_tick FROM c",
    "vanished_members": _MEMBERS
    + """, gone AS (SELECT c.host, c.tick, b.name FROM c JOIN (SELECT DISTINCT host, tick, name FROM m) b ON b.host = c.host AND b.tick = c.prev_tick)
      SELECT host, tick, name FROM gone g WHERE name IN ('click', 'view', 'purchase')
      AND NOT EXISTS (SELECT 1 FROM m WHERE m.host = g.host AND m.tick = g.tick AND m.name = g.name)
      AND NOT EXISTS (SELECT 1 FROM m WHERE m.host = g.host AND m.name = g.name AND m.removed_in_app)""",
    "presence_edges": f"""
    WITH m AS ({X.select_sql(X.MEMBER_COLUMNS, 'events')}),
    o AS (SELECT host, tick, bool_or(name = 'view') AS registered FROM m GROUP BY ALL),
    e AS (SELECT *, lag(registered) OVER (PARTITION BY host ORDER BY tick) AS was FROM o),
    d AS (SELECT host, tick, registered, CASE WHEN was IS NULL THEN 'seed' WHEN was AND NOT registered THEN 'vanished'
      WHEN NOT was AND registered THEN 'restored' ELSE 'none' END AS edge FROM e)
    SELECT *, last_value(CASE WHEN edge <> 'none' THEN edge END IGNORE NULLS) OVER (PARTITION BY host ORDER BY tick) = 'vanished' AS notice_pending FROM d""",
}
