"""Queries over the trail: scan, assembly, pages, counts, facets, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.functions.text import byte_size, label_of, list_stamp, relative_time
from sparktrail.operators import alerts, assemble, entity, pages, stored, trail
from sparktrail.operators.filters import DetectionFilter, matches
from sparktrail.plans import fixtures as X
from sparktrail.session import scratch_path
from sparktrail.sources.tables import spread, table

ORDER = ["id"]
FILTER = DetectionFilter(
    categories=tuple(c for c in V.CATEGORIES if c != "tool_call_allowed"),
    severities=("high", "critical"),
    time_range="7d",
)
WIDE = DetectionFilter()


def _keyed(spark, sf):
    return assemble.rpc_key(X.trail(spark, sf))


def _parts(spark, sf):
    rows = _keyed(spark, sf)
    return rows, rows.where("type = 'mcp.request'"), rows.where("type = 'mcp.detection_enrichment'")


def _summarized(spark, sf):
    """The args summary is made for requests before assembly."""
    rows = X.trail(spark, sf).withColumn("args_json", F.when(F.col("type") == "mcp.request", F.col("args_json")))
    return trail.with_args_summary(rows)


def gold(spark, sf):
    """All rows assembled at once."""
    return assemble.assemble(_summarized(spark, sf), ORDER)


_STORED: dict[tuple, stored.StoredTrail] = {}


def stored_trail(spark, sf):
    """The trail of a folder as a stored table, taken in as two increments when it is first asked for.

    It is kept as long as the application runs and the folder's files stay as they are.
    """
    files = spark.read.parquet(f"{sf}/events.parquet").select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
    state = files.distinct().agg(F.bit_xor(F.xxhash64("*")), F.count("*")).first()
    key = (spark.sparkContext.applicationId, sf, *state)
    if key not in _STORED:
        trail_of = stored.StoredTrail(spark, scratch_path(spark, "trail"), ORDER)
        rows = _summarized(spark, sf)
        late = F.expr("event_id % 7 = 3") | (F.col("ts") >= F.to_timestamp(F.lit(X.NOW)) - F.expr("INTERVAL 2 DAYS"))
        for name, part in (("first", rows.where(~late)), ("second", rows.where(late))):
            trail_of.add(part, name)
        _STORED[key] = trail_of
    return _STORED[key]


def stored_rows(spark, sf):
    return stored_trail(spark, sf).rows().select(
        "id", "type", "category", "severity", "outcome", "tool_name", "cwd", "tool_use_id", "paired_source",
        F.col("enrichment.id").alias("enrichment_id"),
    )


def _scanned(lines):
    rows = trail.detection_rows(trail.parse_trail(lines), X.SELFTEST_MCP)
    return rows.select(
        "id", "type", "mcp", "rpc_id", "rpc_id_type", "category", "severity", "tool_name", "tool_use_id", "args_json",
        F.size("findings").cast("bigint").alias("n_findings"),
    )


def trail_scan(spark, sf):
    return _scanned(spread(table(spark, sf, "events")).selectExpr(*X.raw_trail_columns("spark")).select("event_id", "raw"))


def trail_tail(spark, sf):
    from sparktrail.streaming import jobs

    return _scanned(jobs.run_tail(spark, sf).select("file", "start", F.col("line").alias("raw")))


def dedupe_by_id(spark, sf):
    rows = X.trail(spark, sf).withColumn("id", F.expr("lpad(CAST(event_id div 3 AS STRING), 12, '0')"))
    return trail.dedupe_first(rows, ["event_id"]).select("id", "event_id", "type", "session")


def outcomes(spark, sf):
    rows, requests, _ = _parts(spark, sf)
    return requests.join(assemble.outcomes(rows, ORDER), assemble.CALL, "left").select("id", "outcome")


def enrichment_join(spark, sf):
    _, requests, enrichments = _parts(spark, sf)
    full = assemble.attach_enrichments(requests, enrichments, ORDER)
    return full.where("enrichment IS NOT NULL").select(
        "id", F.col("enrichment.id").alias("enrichment_id"), F.col("enrichment.category").alias("enrichment_category")
    )


def enrichment_orphans(spark, sf):
    _, requests, enrichments = _parts(spark, sf)
    return assemble.orphan_enrichments(requests, enrichments, ORDER).select("id", "category")


def inherit_keys(spark, sf):
    _, requests, enrichments = _parts(spark, sf)
    orphans = assemble.orphan_enrichments(requests, enrichments, ORDER)
    return assemble.inherit(orphans, requests, ORDER).select("id", "tool_use_id", "tool_name", "cwd")


def paired_source(spark, sf):
    rows = X.trail(spark, sf).where("type IN ('mcp.request', 'mcp.detection_enrichment')")
    return assemble.pair_sources(rows).where("paired_source IS NOT NULL").select("id", "paired_source")


def assemble_trail(spark, sf):
    return gold(spark, sf).select(
        "id", "type", "category", "severity", "outcome", "tool_name", "cwd", "tool_use_id", "paired_source",
        F.col("enrichment.id").alias("enrichment_id"),
    )


def _page_columns(df, *more):
    return df.select(*more, "id", "mcp", "type", "category", "severity", "source", "tool_name", "project", "outcome", "args_summary", "paired_source")


def page_rows(spark, sf):
    return _page_columns(stored_trail(spark, sf).page(FILTER, X.NOW, V.PAGE_SIZE))


def page_walk(spark, sf):
    """Every page to the last one."""
    rows = pages.numbered(stored_trail(spark, sf).within(FILTER, X.NOW), FILTER, X.NOW, limit=100)
    return _page_columns(rows, "page_no")


def page_counts(spark, sf):
    return pages.counts(stored_trail(spark, sf).rows(), FILTER, X.NOW)


def detail_by_id(spark, sf):
    """Full details of the rows on the head page; its ids are at most one page."""
    trail_of = stored_trail(spark, sf)
    return trail_of.details(trail_of.page(FILTER, X.NOW, V.PAGE_SIZE)).drop("ts_raw")


def _filtered(f):
    return lambda spark, sf: stored_trail(spark, sf).within(f, X.NOW).where(matches(f, X.NOW)).select("id", "type")


def facets(spark, sf):
    f = DetectionFilter(time_range="7d", sources=(V.HOOK_SOURCE,), tools=("tool_1", "retired_tool"))
    return pages.facets(stored_trail(spark, sf).within(f, X.NOW), f, X.NOW)


def facet_sessions(spark, sf):
    f = DetectionFilter(time_range="7d")
    return pages.session_facet(stored_trail(spark, sf).within(f, X.NOW), f, X.NOW)


def tray_counts_24h(spark, sf):
    return pages.tray_counts(X.trail(spark, sf), X.NOW)


def flagged_7d(spark, sf):
    return pages.calls_by_connector(X.trail(spark, sf).where("type = 'mcp.request'"), X.NOW)


def recent_flagged(spark, sf):
    rows = pages.recent_flagged(X.trail(spark, sf).where("type = 'mcp.request'"))
    return rows.select("mcp", F.col("rank").cast("bigint").alias("rank"), "id")


def session_blocks(spark, sf):
    rows = X.trail(spark, sf).where("type IN ('mcp.request', 'mcp.detection_enrichment')")
    return pages.session_blocks(rows.select("id", "ts", "ts_raw", "cc_session", "cwd", "mcp"))


def _signals(spark, sf):
    rows = X.trail(spark, sf)
    return rows.select("id", "mcp", "ts", "ts_raw", "message", alerts.auth_signal(alerts.oauth_failure()).alias("signal"))


def auth_alerts(spark, sf):
    return alerts.auth_alerts(_signals(spark, sf), X.NOW)


def alert_transitions(spark, sf):
    """Half-day ticks; recoveries and traffic clear, new failures notify."""
    rows = X.trail(spark, sf).where("type IN ('proxy.error', 'app.connector_recovered')")
    rows = rows.withColumn("mcp", F.col("session"))
    signal = alerts.auth_signal(alerts.oauth_failure()).alias("signal")
    states = alerts.alert_states(rows.select("id", "mcp", "ts", "ts_raw", signal), 43200)
    return alerts.alert_transitions(states)


def token_asof(spark, sf):
    """Failures after the last recovery of their session, standing in for token events."""
    rows = X.trail(spark, sf)
    return alerts.token_asof(rows, F.col("type") == "proxy.error", F.col("type") == "app.connector_recovered")


def drop_accounting(spark, sf):
    rows = X.trail(spark, sf).withColumn("reason", F.expr("CASE event_id % 3 WHEN 0 THEN 'queue_full' WHEN 1 THEN 'worker_dead' ELSE 'error' END"))
    return trail.drop_accounting(rows)


def last_purge_marker(spark, sf):
    return trail.last_marker(X.trail(spark, sf), "app.retention_purged", "id", "session", "mcp", "message")


def args_summary(spark, sf):
    rows = spread(table(spark, sf, "events")).selectExpr(*X.ARGS_COLUMNS)
    return trail.with_args_summary(rows, out="summary").select("event_id", "summary")


def report_labels(spark, sf):
    rows = X.trail(spark, sf).where("type IN ('mcp.request', 'mcp.detection_enrichment')")
    now = F.to_timestamp(F.lit(X.NOW))
    size = F.expr("CAST(pow(event_id % 50 + 1, 7) AS BIGINT)")
    enrichment = F.when(F.col("type") == "mcp.detection_enrichment", F.when(F.col("category") == "pii_detected", "[NER]").otherwise("[content]"))
    return rows.select(
        "id",
        label_of(F.col("category"), V.CATEGORY_LABELS).alias("category_label"),
        label_of(F.when(F.col("source") == V.HOOK_SOURCE, V.HOOK_SOURCE).otherwise(V.WIRE_SOURCE), V.SOURCE_LABELS).alias("source_label"),
        F.coalesce(enrichment, F.col("tool_name"), F.col("method")).alias("tool_label"),
        list_stamp(F.col("ts")).alias("stamp"),
        relative_time(F.col("ts"), now).alias("age"),
        byte_size(size).alias("size"),
    )


def ner_threshold(spark, sf):
    rows = X.trail(spark, sf).where("type = 'mcp.request'")
    groups = F.expr(
        "array(named_struct('entity_group', 'PER', 'score', (event_id % 101) / 100.0D, 'word', session),"
        " named_struct('entity_group', 'ORG', 'score', 0.5D, 'word', mcp),"
        " named_struct('entity_group', 'LOC', 'score', (event_id % 7) / 10.0D, 'word', mcp))"
    )
    found = entity.entity_enrichments(rows.select("id", "session", "rpc_id", groups.alias("groups")), "groups")
    return found.select("id", "category", "severity", F.array_join(F.col("findings.type"), ",").alias("types"))


QUERIES = {
    "trail_scan": trail_scan,
    "trail_tail": trail_tail,
    "dedupe_by_id": dedupe_by_id,
    "outcomes": outcomes,
    "enrichment_join": enrichment_join,
    "enrichment_orphans": enrichment_orphans,
    "inherit_keys": inherit_keys,
    "paired_source": paired_source,
    "assemble_trail": assemble_trail,
    "page_rows": page_rows,
    "stored_rows": stored_rows,
    "page_walk": page_walk,
    "page_counts": page_counts,
    "detail_by_id": detail_by_id,
    "filter_text": _filtered(DetectionFilter(text="RUN 1")),
    "filter_status": _filtered(DetectionFilter(status=("error",))),
    "filter_time": _filtered(DetectionFilter(time_range="24h", mcp="m3")),
    "filter_local_days": _filtered(
        DetectionFilter(time_range="custom", custom_range=("2024-01-10", "2024-01-12"), timezone="America/New_York")
    ),
    "filter_selections": _filtered(
        DetectionFilter(tools=("tool_1", "tool_2"), sessions=("cc1", "cc2", "cc3"), projects=("p1", "p2", "p3"))
    ),
    "facets": facets,
    "facet_sessions": facet_sessions,
    "tray_counts_24h": tray_counts_24h,
    "flagged_7d": flagged_7d,
    "recent_flagged": recent_flagged,
    "session_blocks": session_blocks,
    "auth_alerts": auth_alerts,
    "alert_transitions": alert_transitions,
    "token_asof": token_asof,
    "drop_accounting": drop_accounting,
    "last_purge_marker": last_purge_marker,
    "args_summary": args_summary,
    "report_labels": report_labels,
    "ner_threshold": ner_threshold,
}

_T = f"WITH t AS MATERIALIZED (SELECT *, rpc_id_type || ':' || coalesce(rpc_id, '') AS rk FROM ({X.select_sql(X.trail_columns('duckdb'), 'events')}))"
_PARTS = (
    _T
    + """,
req AS (SELECT * FROM t WHERE type = 'mcp.request'), enr AS (SELECT * FROM t WHERE type = 'mcp.detection_enrichment'),
oc AS (SELECT session, rk, arg_max(CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END, id) AS outcome FROM t WHERE type = 'mcp.response' GROUP BY ALL),
le AS (SELECT session, rk, direction, max(id) AS eid FROM enr GROUP BY ALL),
taken AS (SELECT le.eid FROM le SEMI JOIN req USING (session, rk, direction)),
orphan AS (SELECT * FROM enr WHERE id NOT IN (SELECT eid FROM taken)),
use AS (SELECT session, rk, arg_max(tool_use_id, id) AS u FROM req WHERE tool_use_id IS NOT NULL GROUP BY ALL),
shown AS (SELECT session, rk, arg_max(struct_pack(a := tool_name, b := cwd), id) AS s FROM req WHERE tool_name IS NOT NULL OR cwd IS NOT NULL GROUP BY ALL),
lent AS (SELECT o.* REPLACE (coalesce(o.tool_use_id, u.u) AS tool_use_id, coalesce(o.tool_name, s.s.a) AS tool_name, coalesce(o.cwd, s.s.b) AS cwd)
   FROM orphan o LEFT JOIN use u USING (session, rk) LEFT JOIN shown s USING (session, rk)),
alls AS (SELECT r.*, le.eid AS enrichment_id, oc.outcome FROM req r LEFT JOIN le USING (session, rk, direction) LEFT JOIN oc USING (session, rk)
   UNION ALL BY NAME SELECT *, NULL AS enrichment_id, NULL AS outcome FROM lent),
both_sides AS (SELECT tool_use_id FROM alls WHERE tool_use_id IS NOT NULL GROUP BY tool_use_id HAVING count(DISTINCT coalesce(source, '')) = 2),
gold AS (SELECT *, CASE WHEN tool_use_id IN (SELECT tool_use_id FROM both_sides) THEN CASE WHEN source = 'claude-code' THEN 'wrapper' ELSE 'cc-hook' END END AS paired_source,
  coalesce(source, 'gateway') AS src, regexp_extract(cwd, '([^/]+)$', 1) AS project,
  CASE WHEN type = 'mcp.request' THEN 'run ' || event_id END AS args_summary FROM alls)
"""
)
_NOW = f"TIMESTAMP '{X.NOW}'"
_WEEK = f"ts >= {_NOW} - INTERVAL 7 DAY"
_PAGE = f"category <> 'tool_call_allowed' AND severity IN ('high', 'critical') AND {_WEEK}"
_COLS = "id, mcp, type, category, severity, src AS source, tool_name, project, outcome, args_summary, paired_source"


def _labels():
    pick = lambda col, table: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
    minutes = f"((epoch_us({_NOW}) // 1000 - epoch_us(ts) // 1000) // 60000)"
    scale = lambda p, u: f"CASE WHEN n / {1024**p}.0 >= 10 THEN CAST(floor(n / {1024**p}.0 + 0.5) AS BIGINT)::VARCHAR ELSE printf('%.1f', n / {1024**p}.0) END || ' {u}'"
    return (
        _T
        + f""", r AS (SELECT *, CAST(pow(event_id % 50 + 1, 7) AS BIGINT) AS n FROM t WHERE type IN ('mcp.request', 'mcp.detection_enrichment'))
        SELECT id, {pick('category', V.CATEGORY_LABELS)} AS category_label, {pick("coalesce(source, 'gateway')", V.SOURCE_LABELS)} AS source_label,
        CASE WHEN type = 'mcp.detection_enrichment' THEN CASE WHEN category = 'pii_detected' THEN '[NER]' ELSE '[content]' END ELSE tool_name END AS tool_label,
        strftime(ts, '%d %b, %H:%M:%S') AS stamp,
        CASE WHEN {minutes} < 1 THEN 'just now' WHEN {minutes} < 60 THEN {minutes} || 'm ago' WHEN {minutes} < 1440 THEN ({minutes} // 60) || 'h ago'
          ELSE ({minutes} // 1440) || 'd ago' END AS age,
        CASE WHEN n < 1024 THEN n || ' B' WHEN n < {1024**2} THEN {scale(1, 'KB')} WHEN n < {1024**3} THEN {scale(2, 'MB')}
          WHEN n < {1024**4} THEN {scale(3, 'GB')} ELSE {scale(4, 'TB')} END AS size FROM r"""
    )


ORACLES = {
    "trail_scan": f"""WITH l AS ({X.select_sql(X.raw_trail_columns('duckdb'), 'events')}),
      g AS (SELECT *, (event_type <> 'signup') AS is_req, event_id % 3 = 0 AS hook FROM l WHERE event_id % 23 <> 0 AND event_id % 41 <> 0
        AND event_id % 29 <> 0 AND event_id % 31 <> 0 AND event_id % 37 <> 0 AND event_id % 4 <> 3 AND event_type <> 'purchase')
      SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, CASE WHEN is_req THEN 'mcp.request' ELSE 'mcp.detection_enrichment' END AS type,
        'm' || (event_id % 7) AS mcp, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 't' || event_id END AS rpc_id,
        CASE event_id % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'string' ELSE 'null' END AS rpc_id_type, 'pii_structured' AS category, 'medium' AS severity,
        CASE WHEN event_id % 5 <> 0 THEN 'tool_' || (event_id % 11) END AS tool_name,
        CASE WHEN hook AND event_id % 4 = 1 THEN 't' || event_id WHEN is_req AND event_id % 5 <> 0 THEN 'u' || event_id END AS tool_use_id,
        CASE WHEN event_id % 5 <> 0 THEN '{{"command":"run ' || event_id || '"}}' END AS args_json, 1 AS n_findings FROM g""",
    "dedupe_by_id": _T
    + "SELECT lpad(CAST(event_id // 3 AS VARCHAR), 12, '0') AS id, min(event_id) AS event_id, arg_min(type, event_id) AS type, arg_min(session, event_id) AS session FROM t GROUP BY 1",
    "outcomes": _PARTS + "SELECT r.id, oc.outcome FROM req r LEFT JOIN oc USING (session, rk)",
    "enrichment_join": _PARTS
    + "SELECT r.id, e.id AS enrichment_id, e.category AS enrichment_category FROM req r JOIN le USING (session, rk, direction) JOIN enr e ON e.id = le.eid",
    "enrichment_orphans": _PARTS + "SELECT id, category FROM orphan",
    "inherit_keys": _PARTS + "SELECT id, tool_use_id, tool_name, cwd FROM lent",
    "paired_source": _T
    + """, d AS (SELECT * FROM t WHERE type IN ('mcp.request', 'mcp.detection_enrichment') AND tool_use_id IS NOT NULL),
      w AS (SELECT *, count(DISTINCT coalesce(source, '')) OVER (PARTITION BY tool_use_id) AS k FROM d)
      SELECT id, CASE WHEN source = 'claude-code' THEN 'wrapper' ELSE 'cc-hook' END AS paired_source FROM w WHERE k = 2""",
    "assemble_trail": _PARTS + "SELECT id, type, category, severity, outcome, tool_name, cwd, tool_use_id, paired_source, enrichment_id FROM gold",
    "page_rows": _PARTS + f"SELECT {_COLS} FROM gold WHERE {_PAGE} ORDER BY ts_raw DESC, id DESC LIMIT 200",
    "page_walk": _PARTS + f"SELECT {_COLS}, (row_number() OVER (ORDER BY ts_raw DESC, id DESC) - 1) // 100 AS page_no FROM gold WHERE {_PAGE}",
    "page_counts": _PARTS
    + f"""SELECT count(*) AS total, count(*) FILTER (category <> 'tool_call_allowed' AND {_WEEK}) AS category_filtered_total, count(*) FILTER ({_PAGE}) AS total_matching, """
    + ", ".join(f"count(*) FILTER (category <> 'tool_call_allowed' AND {_WEEK} AND severity = '{s}') AS {s}" for s in V.SEVERITIES)
    + " FROM gold",
    "detail_by_id": _PARTS
    + f"""SELECT id, session, mcp, type, rpc_id, direction, category, severity, src AS source, method,
      CASE WHEN type = 'mcp.request' THEN tool_name END AS tool_name, CASE WHEN type = 'mcp.request' THEN args_json END AS arguments
      FROM gold WHERE {_PAGE} ORDER BY ts_raw DESC, id DESC LIMIT 200""",
    "filter_text": _PARTS + "SELECT id, type FROM gold WHERE contains(lower(tool_name), 'run 1') OR (type = 'mcp.request' AND contains(lower(args_summary), 'run 1'))",
    "filter_status": _PARTS + "SELECT id, type FROM gold WHERE type = 'mcp.request' AND outcome = 'error'",
    "filter_time": _PARTS + f"SELECT id, type FROM gold WHERE ts >= {_NOW} - INTERVAL 1 DAY AND mcp = 'm3'",
    "filter_local_days": _PARTS + "SELECT id, type FROM gold WHERE ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-13 05:00:00'",
    "filter_selections": _PARTS
    + "SELECT id, type FROM gold WHERE tool_name IN ('tool_1', 'tool_2') AND cc_session IN ('cc1', 'cc2', 'cc3') AND project IN ('p1', 'p2', 'p3')",
    "facets": _PARTS
    + f""", b AS (SELECT * FROM gold WHERE type = 'mcp.request' AND src = 'claude-code' AND {_WEEK})
      SELECT 'tool' AS facet, tool_name AS value FROM b UNION SELECT 'project', project FROM b WHERE cwd IS NOT NULL
      UNION SELECT 'tool', unnest(['tool_1', 'retired_tool'])""",
    "facet_sessions": _PARTS
    + f"""SELECT cc_session, min(ts_raw) AS started, coalesce(arg_max(project, (ts_raw, id)) FILTER (type = 'mcp.request' AND cwd IS NOT NULL),
      arg_max(mcp, (ts_raw, id))) AS place FROM gold WHERE {_WEEK} AND cc_session IS NOT NULL GROUP BY cc_session""",
    "tray_counts_24h": _T
    + f"""SELECT count(*) FILTER (category <> 'tool_call_allowed') AS flagged_24h, count(*) FILTER (severity = 'critical') AS critical_24h FROM t
      WHERE (type = 'mcp.request' OR (type = 'mcp.detection_enrichment' AND direction = 'server_to_client')) AND ts >= {_NOW} - INTERVAL 1 DAY""",
    "flagged_7d": _T + f"SELECT mcp, count(*) AS calls, count(*) FILTER (category <> 'tool_call_allowed') AS flagged FROM t WHERE type = 'mcp.request' AND {_WEEK} GROUP BY mcp",
    "recent_flagged": _T
    + """, r AS (SELECT mcp, id, row_number() OVER (PARTITION BY mcp ORDER BY ts_raw DESC, id DESC) AS rank FROM t WHERE type = 'mcp.request' AND category <> 'tool_call_allowed')
      SELECT mcp, rank, id FROM r WHERE rank <= 8""",
    "session_blocks": _T
    + """, d AS (SELECT *, lag(cc_session) OVER o AS prev, row_number() OVER o AS rn FROM t WHERE type IN ('mcp.request', 'mcp.detection_enrichment') WINDOW o AS (ORDER BY ts_raw, id)),
      b AS (SELECT *, sum(CASE WHEN rn = 1 OR prev IS DISTINCT FROM cc_session THEN 1 ELSE 0 END) OVER (ORDER BY ts_raw, id) AS blk FROM d)
      SELECT arg_max(id, rn) AS first_id, any_value(cc_session) AS cc_session, count(*) AS n,
        arg_max(coalesce(regexp_extract(cwd, '([^/]+)$', 1), mcp), rn) || ' · started ' || strftime(min(ts), '%d %b, %H:%M') AS label
      FROM b WHERE cc_session IS NOT NULL GROUP BY blk""",
    "auth_alerts": _T
    + f""", s AS (SELECT *, CASE WHEN type = 'proxy.error' AND kind = 'oauth_failed' THEN 'fail' WHEN type LIKE 'mcp.%' OR type = 'app.connector_recovered' THEN 'later' END AS k FROM t WHERE source IS NULL),
      a AS (SELECT mcp, max(ts_raw) FILTER (k = 'fail') AS last_failure, arg_max(message, id) FILTER (k = 'fail') AS message, max(ts_raw) FILTER (k = 'later') AS later FROM s GROUP BY mcp)
      SELECT mcp, last_failure, message FROM a WHERE CAST(last_failure AS TIMESTAMP) >= {_NOW} - INTERVAL 1 DAY AND NOT coalesce(last_failure < later, false)""",
    "alert_transitions": _T
    + """, s AS (SELECT session AS mcp, epoch_us(ts) // 43200000000 AS tick, ts_raw, type = 'proxy.error' AS bad FROM t
        WHERE source IS NULL AND (type = 'app.connector_recovered' OR (type = 'proxy.error' AND kind = 'oauth_failed'))),
      g AS (SELECT mcp, unnest(range(min(tick), (SELECT max(tick) FROM s) + 1)) AS tick FROM s GROUP BY mcp),
      st AS (SELECT g.mcp, g.tick, max(s.ts_raw) FILTER (bad) AS f, max(s.ts_raw) FILTER (NOT bad) AS l FROM g JOIN s ON s.mcp = g.mcp AND s.tick <= g.tick GROUP BY ALL),
      ac AS (SELECT mcp, tick, coalesce(CAST(f AS TIMESTAMP) >= make_timestamp((tick + 1) * 43200000000) - INTERVAL 1 DAY AND NOT coalesce(f < l, false), false) AS active FROM st),
      e AS (SELECT *, coalesce(lag(active) OVER (PARTITION BY mcp ORDER BY tick), false) AS was FROM ac)
      SELECT mcp, tick FROM e WHERE active AND NOT was AND tick > (SELECT min(tick) FROM s)""",
    "token_asof": _T
    + """, w AS (SELECT *, last_value(CASE WHEN type = 'app.connector_recovered' THEN struct_pack(k := type, at := ts) END IGNORE NULLS)
        OVER (PARTITION BY session ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tk FROM t)
      SELECT id, tk.k AS last_token_event, epoch_us(ts) // 1000 - epoch_us(tk.at) // 1000 AS ago_ms FROM w WHERE type = 'proxy.error'""",
    "drop_accounting": _T
    + "SELECT type, CASE event_id % 3 WHEN 0 THEN 'queue_full' WHEN 1 THEN 'worker_dead' ELSE 'error' END AS reason, count(*) AS n FROM t WHERE type = 'proxy.ner_dropped' GROUP BY ALL",
    "last_purge_marker": _T + "SELECT id, session, mcp, message FROM t WHERE type = 'app.retention_purged' ORDER BY ts_raw DESC, id DESC LIMIT 1",
    "args_summary": f"""WITH a AS ({X.select_sql(X.ARGS_COLUMNS, 'events')}), u AS (SELECT user_id, event_id FROM events)
      SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'run ' || event_id
        WHEN 1 THEN CASE WHEN tool_name = 'Read' THEN 'src/f' || user_id ELSE 'c' END
        WHEN 2 THEN left(trim(repeat('word ' || user_id || ' ', 40)), 99) || '…'
        WHEN 3 THEN 't' || event_id WHEN 4 THEN 'a b' WHEN 5 THEN NULL WHEN 6 THEN NULL
        ELSE 'o' || event_id END AS summary FROM a JOIN u USING (event_id)""",
    "report_labels": _labels(),
    "ner_threshold": _T
    + """, f AS (SELECT id, array_to_string(list_filter(['PER', 'LOC'], lambda k: CASE k WHEN 'PER' THEN (event_id % 101) / 100.0 > 0.5 ELSE (event_id % 7) / 10.0 > 0.5 END), ',') AS types
        FROM t WHERE type = 'mcp.request') SELECT id, 'pii_detected' AS category, 'low' AS severity, types FROM f WHERE types <> ''""",
}

ORACLES["trail_tail"] = ORACLES["trail_scan"]
ORACLES["stored_rows"] = ORACLES["assemble_trail"]
