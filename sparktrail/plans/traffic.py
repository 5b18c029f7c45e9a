"""Queries over frames: classification, scan text, pairing, latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktrail.functions.masking import fingerprints_in
from sparktrail.functions.text import json_quote, split_tool_name
from sparktrail.operators import capture, chain, frames, hooks, pairing, snapshots, truncation
from sparktrail.plans import fixtures as X
from sparktrail.plans import oracle_text as O
from sparktrail.sources.tables import spread, table


def frame_classify(spark, sf):
    lines = table(spark, sf, "conversations").selectExpr(*X.line_columns("spark"))
    framed = frames.classify_frames(lines.where("channel <> 'stderr'")).select(
        "session", "seq", "kind", "reason", "rpc_id", "rpc_id_type", "method", "bytes", "frame_snippet"
    )
    errors = frames.stderr_rows(lines.where("channel = 'stderr'")).select("session", "seq", "kind", "bytes")
    return framed.unionByName(errors, allowMissingColumns=True)


def scan_text(spark, sf):
    """Request and response scan texts by tool family, as lengths and digests."""
    hooked = table(spark, sf, "conversations").selectExpr(*X.scan_columns("spark"))
    scanned = hooks.response_scan_text(hooked, "hook_event", "tool_name", "tool_response", "error")
    return scanned.select(
        "session",
        "seq",
        F.length("scan").cast("bigint").alias("chars"),
        F.md5("scan").alias("digest"),
    )


def truncate_leaves(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    quoted = json_quote(F.col("text"))
    payload = F.concat(
        F.lit('{"name":"echo","arguments":{"message":'), quoted, F.lit(',"items":["small",'), quoted, F.lit("]}}")
    )
    cut = truncation.truncate_leaves(spread(docs).select("doc_id", payload.alias("params")), "params")
    return cut.select(
        "doc_id",
        "truncated",
        F.length(F.get_json_object("params", "$.arguments.message")).cast("bigint").alias("message_chars"),
        F.get_json_object("params", "$.arguments.items[0]").alias("first_item"),
        F.md5(F.get_json_object("params", "$.arguments.items[1]")).alias("second_item_md5"),
    )


def tool_name_split(spark, sf):
    events = table(spark, sf, "events").selectExpr("event_id", f"{X.TOOL_NAME} AS tool_name")
    mcp, tool = split_tool_name(F.col("tool_name"), "claude-code")
    return events.select(mcp.alias("mcp"), tool.alias("tool")).groupBy("mcp", "tool").agg(F.count("*").alias("n"))


def inventory_classify(spark, sf):
    entries = table(spark, sf, "events").selectExpr(*X.INVENTORY_COLUMNS)
    return snapshots.inventory_coverage(entries)


def rpc_latency(spark, sf):
    paired = pairing.pair_responses(X.frames(spark, sf))
    return paired.where("kind = 'response'").select("session", "seq", "latency_ms")


def response_method(spark, sf):
    paired = pairing.pair_responses(X.frames(spark, sf)).where("kind = 'response'")
    return paired.groupBy("request_method").agg(F.count("*").alias("n"))


def session_stats(spark, sf):
    return pairing.session_stats(X.frames(spark, sf))


def _samples(spark, sf):
    paired = pairing.pair_responses(X.frames(spark, sf))
    return paired.where("latency_ms IS NOT NULL").select(
        "session", "seq", "ts_ms", "latency_ms", F.length("text").cast("bigint").alias("chars")
    )


def latency_stats(spark, sf):
    return pairing.latency_stats(_samples(spark, sf), "latency_ms")


def latency_quintiles(spark, sf):
    return pairing.latency_quintiles(_samples(spark, sf), "latency_ms", "chars", ["ts_ms", "session", "seq"])


def wire_trail(spark, sf):
    """Frames to trail: requests and ``tools/call`` results classified, in one count."""
    paired = pairing.pair_responses(X.frames(spark, sf))
    requests = chain.detect(paired.where("kind = 'request'").select("text"), "text")
    results = paired.where("kind = 'response' AND request_method = 'tools/call'").select("text")
    answers = chain.detect(results, "text", policy="inbound")
    rows = requests.select(F.lit("mcp.request").alias("type"), "category", "severity").unionByName(
        answers.select(F.lit("mcp.detection_enrichment").alias("type"), "category", "severity")
    )
    return rows.groupBy("type", "category", "severity").agg(F.count("*").alias("n"))


def captured_trail(spark, sf):
    """Both sources through the whole write path; what is masked where, and that nothing leaks."""
    events = spread(table(spark, sf, "events").select("event_id", "user_id", "ts"))
    lines = events.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr(*X.WIRE_COLUMNS)
    rows = capture.capture(lines, events.selectExpr(*X.SECRET_HOOK_COLUMNS), X.HMAC_KEY)
    kept = F.concat_ws("\n", *capture.KEPT)
    marks = fingerprints_in(kept)
    return rows.select(
        "id", "type", "category", "severity", "method", "source",
        F.size(marks).cast("bigint").alias("n_masked"),
        F.get(marks, F.lit(0)).alias("fp"),
        kept.rlike("sk-ant-api03-[0-9a-f]").alias("leaked"),
    )


def stream_latency(spark, sf):
    from sparktrail.streaming import jobs

    return jobs.run_latency(spark, sf)


QUERIES = {
    "frame_classify": frame_classify,
    "scan_text": scan_text,
    "truncate_leaves": truncate_leaves,
    "tool_name_split": tool_name_split,
    "inventory_classify": inventory_classify,
    "rpc_latency": rpc_latency,
    "response_method": response_method,
    "session_stats": session_stats,
    "latency_stats": latency_stats,
    "latency_quintiles": latency_quintiles,
    "wire_trail": wire_trail,
    "captured_trail": captured_trail,
    "stream_latency": stream_latency,
}

_PAIRED = f"""
WITH f AS ({X.select_sql(X.FRAME_COLUMNS, 'conversations')}),
p AS (SELECT *, CASE WHEN kind = 'request' THEN direction WHEN direction = 'client_to_server' THEN 'server_to_client'
   ELSE 'client_to_server' END AS rd FROM f WHERE kind IN ('request', 'response')),
w AS (SELECT *, lag(kind) OVER k AS pk, lag(method) OVER k AS pm, lag(ts_ms) OVER k AS pt FROM p
   WINDOW k AS (PARTITION BY session, rd, rpc_id ORDER BY seq)),
r AS (SELECT session, seq, ts_ms, text, CASE WHEN pk = 'request' THEN pm END AS request_method,
   CASE WHEN pk = 'request' THEN ts_ms - pt END AS latency_ms FROM w WHERE kind = 'response'),
s AS (SELECT *, length(text) AS chars FROM r WHERE latency_ms IS NOT NULL)
"""


def _oracles():
    from sparktrail import values as V
    from sparktrail.operators.detectors import PII_TYPES
    from sparktrail.plans import oracle_text as O

    id_type = "json_type(j, '$.id')"
    has = lambda k: f"coalesce(list_contains(json_keys(j), '{k}'), false)"
    ok_json = "json_valid(line)"
    obj = "(json_type(j) = 'OBJECT')"
    method = "(json_type(j, '$.method') = 'VARCHAR')"
    answers = f"({has('result')} OR {has('error')})"
    reason = (
        f"CASE WHEN NOT {ok_json} THEN 'invalid_json' WHEN NOT {obj} THEN 'not_an_object'"
        f" WHEN json_type(j, '$.jsonrpc') IS DISTINCT FROM 'VARCHAR' OR json_extract_string(j, '$.jsonrpc') <> '2.0' THEN 'missing_jsonrpc_2_0'"
        f" WHEN {has('id')} AND {id_type} NOT IN ('NULL', 'VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN 'malformed_jsonrpc'"
        f" WHEN {has('id')} AND NOT coalesce({method}, false) AND NOT {answers} THEN 'malformed_jsonrpc'"
        f" WHEN NOT {has('id')} AND NOT coalesce({method}, false) AND NOT (transport = 'http' AND {answers}) THEN 'malformed_jsonrpc' END"
    )
    frame = f"""
    WITH l AS MATERIALIZED (SELECT *, CASE WHEN json_valid(line) THEN line ELSE 'null' END AS j
        FROM ({X.select_sql(X.line_columns('duckdb'), 'conversations')})),
    j AS (SELECT *, CASE WHEN channel = 'stderr' THEN NULL ELSE {reason} END AS reason FROM l),
    k AS (SELECT *, CASE WHEN channel = 'stderr' THEN 'mcp.stderr' WHEN reason IS NOT NULL THEN 'parse_error'
        WHEN {method} THEN CASE WHEN {has('id')} THEN 'request' ELSE 'notification' END ELSE 'response' END AS kind FROM j)
    SELECT session, seq, kind, reason,
      CASE WHEN kind IN ('request', 'response') THEN json_extract_string(j, '$.id') END AS rpc_id,
      CASE WHEN kind IN ('request', 'response') THEN CASE {id_type} WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'number'
         ELSE 'null' END END AS rpc_id_type,
      CASE WHEN kind IN ('request', 'notification') THEN json_extract_string(j, '$.method') END AS method,
      CAST(strlen(line) + CASE WHEN transport = 'http' AND channel <> 'stderr' THEN 0 ELSE 1 END AS BIGINT) AS bytes,
      CASE WHEN kind = 'parse_error' THEN left(line, 256) END AS frame_snippet FROM k"""
    texts = O.build_counts(V, PII_TYPES)
    requests = texts("SELECT row_number() OVER () AS unit_id, session AS source, text AS scan_text, CAST(NULL AS VARCHAR) AS tool FROM q", "request")
    results = texts("SELECT row_number() OVER () AS unit_id, session AS source, text AS scan_text, CAST(NULL AS VARCHAR) AS tool FROM a", "inbound")
    wire = (
        _PAIRED
        + ", q AS (SELECT session, seq, text FROM p WHERE kind = 'request'), a AS (SELECT session, seq, text FROM r WHERE request_method = 'tools/call')"
        + f" SELECT 'mcp.request' AS type, category, severity, count(*) AS n FROM ({requests}) GROUP BY ALL"
        + f" UNION ALL SELECT 'mcp.detection_enrichment', category, severity, count(*) FROM ({results}) GROUP BY ALL"
    )
    return {
        "frame_classify": frame,
        "scan_text": X.scan_oracle(),
        "truncate_leaves": """SELECT doc_id, strlen(text) > 65536 AS truncated,
            CAST(length(CASE WHEN strlen(text) > 65536 THEN '[truncated ' || strlen(text) || ' bytes]' ELSE text END) AS BIGINT) AS message_chars,
            'small' AS first_item,
            md5(CASE WHEN strlen(text) > 65536 THEN '[truncated ' || strlen(text) || ' bytes]' ELSE text END) AS second_item_md5 FROM documents""",
        "tool_name_split": f"""WITH t AS (SELECT {X.TOOL_NAME} AS tool_name FROM events)
            SELECT CASE WHEN regexp_matches(tool_name, '^mcp__(.+?)__(.+)$') THEN regexp_extract(tool_name, '^mcp__(.+?)__(.+)$', 1) ELSE 'claude-code' END AS mcp,
            CASE WHEN regexp_matches(tool_name, '^mcp__(.+?)__(.+)$') THEN regexp_extract(tool_name, '^mcp__(.+?)__(.+)$', 2) ELSE tool_name END AS tool,
            count(*) AS n FROM t GROUP BY ALL""",
        "inventory_classify": f"""WITH i AS ({X.select_sql(X.INVENTORY_COLUMNS, 'events')}),
            c AS (SELECT host, CASE WHEN kind = 'wrappable' THEN 'local' WHEN reason = 'already-wrapped' AND transport = 'http' THEN 'remote'
               WHEN reason = 'already-wrapped' AND transport = 'stdio' THEN 'local' ELSE 'unknown' END AS type,
               CASE WHEN kind = 'wrappable' THEN 'not-audited' WHEN reason = 'already-wrapped' THEN 'audited' ELSE 'unsupported' END AS status FROM i)
            SELECT type, status, count(*) AS n, count(DISTINCT host) AS n_hosts FROM c GROUP BY ALL""",
        "rpc_latency": _PAIRED + "SELECT session, seq, latency_ms FROM r",
        "response_method": _PAIRED + "SELECT request_method, count(*) AS n FROM r GROUP BY ALL",
        "session_stats": f"""SELECT session, count(*) FILTER (direction = 'client_to_server') AS frames_in,
            count(*) FILTER (direction = 'server_to_client') AS frames_out, max(ts_ms) - min(ts_ms) AS runtime_ms
            FROM ({X.select_sql(X.FRAME_COLUMNS, 'conversations')}) GROUP BY session""",
        "latency_stats": _PAIRED
        + ", o AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS rn, count(*) OVER () AS n FROM s)"
        + " SELECT CAST(max(n) AS BIGINT) AS n, min(latency_ms) AS min, max(latency_ms) AS max, round(sum(latency_ms) / count(*), 2) AS mean, "
        + ", ".join(
            f"max(latency_ms) FILTER (rn = least(n - 1, CAST(floor({q} * n) AS BIGINT))) AS p{p}"
            for p, q in ((50, 0.50), (95, 0.95), (99, 0.99))
        )
        + " FROM o",
        "latency_quintiles": _PAIRED
        + """, o AS (SELECT *, row_number() OVER (ORDER BY chars, ts_ms, session, seq) - 1 AS rn, count(*) OVER () // 5 AS per FROM s),
            b AS (SELECT *, CASE WHEN per > 0 THEN least(rn // per, 4) ELSE 4 END + 1 AS quintile FROM o),
            c AS (SELECT *, row_number() OVER (PARTITION BY quintile ORDER BY latency_ms) - 1 AS k, count(*) OVER (PARTITION BY quintile) AS m FROM b)
            SELECT quintile, count(*) AS n, min(chars) AS min_chars, max(chars) AS max_chars, round(sum(latency_ms) / count(*), 2) AS mean,
            max(latency_ms) FILTER (k = least(m - 1, CAST(floor(0.95 * m) AS BIGINT))) AS p95 FROM c GROUP BY quintile""",
        "wire_trail": wire,
        "stream_latency": _PAIRED + "SELECT session, seq, latency_ms FROM r WHERE latency_ms IS NOT NULL",
    }


ORACLES = _oracles()
ORACLES["captured_trail"] = f"""
WITH e AS (SELECT event_id AS e, 'w' || user_id AS session, event_id % 4 = 0 AS p, event_id % 17 = 0 AS broken,
    CASE WHEN event_id % 6 = 0 THEN 'resources/read' ELSE 'tools/call' END AS asked, {O._fp(X.PLANTED_SECRET)} AS secret_fp FROM events),
  w AS (SELECT *, sha256('wire:' || session || ':' || (2 * e)) AS q, sha256('wire:' || session || ':' || (2 * e + 1)) AS r,
    sha256('hook:' || e || ':0') AS hq, sha256('hook:' || e || ':1') AS hr FROM e),
  rows AS (
    SELECT q AS base, CASE WHEN broken THEN 'mcp.parse_error' ELSE 'mcp.request' END AS type, NOT broken AS asks,
      CASE WHEN NOT broken THEN asked END AS method, NULL AS source, 1 AS n, p, secret_fp FROM w
    UNION ALL SELECT r, 'mcp.response', false, CASE WHEN NOT broken THEN asked END, NULL, 1, p, secret_fp FROM w
    UNION ALL SELECT r, 'mcp.detection_enrichment', true, asked, NULL, 0, p, secret_fp FROM w WHERE p AND NOT broken AND asked = 'tools/call' AND e % 5 <> 0
    UNION ALL SELECT hq, 'cc.event', false, NULL, 'claude-code', CASE WHEN broken THEN 1 ELSE 3 END, p, secret_fp FROM w WHERE broken OR e % 9 = 0
    UNION ALL SELECT hq, 'mcp.request', true, 'tools/call', 'claude-code', 1, p, secret_fp FROM w WHERE NOT broken AND e % 9 <> 0
    UNION ALL SELECT hr, 'mcp.response', false, NULL, 'claude-code', CASE WHEN e % 9 = 1 THEN 1 ELSE 2 END, p, secret_fp FROM w WHERE NOT broken AND e % 9 <> 0
    UNION ALL SELECT hr, 'mcp.detection_enrichment', true, NULL, 'claude-code', 0, p, secret_fp FROM w WHERE p AND NOT broken AND e % 9 <> 0)
SELECT sha256(base || ':' || type || ':0') AS id, type, CASE WHEN asks THEN CASE WHEN p THEN 'credential_detected' ELSE 'tool_call_allowed' END END AS category,
  CASE WHEN asks THEN CASE WHEN p THEN 'critical' ELSE 'low' END END AS severity, method, source, CAST(CASE WHEN p THEN n ELSE 0 END AS BIGINT) AS n_masked,
  CASE WHEN p AND n > 0 THEN secret_fp END AS fp, false AS leaked FROM rows"""
