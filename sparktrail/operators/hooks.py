"""Tool-hook payloads: tolerant parse, scan texts, synthesis into trail rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.functions import jsonx as J
from sparktrail.functions.plans import fence
from sparktrail.functions.text import dedupe_join, json_quote, split_tool_name
from sparktrail.operators import chain
from sparktrail.operators.chain import stamp_id
from sparktrail.operators.frames import result_text

_STRINGS = (
    "session_id", "tool_name", "error", "prompt_id", "agent_id", "agent_type", "cwd", "permission_mode",
    "tool_use_id", "source", "model",
)


def parse_hooks(spool: DataFrame, raw: str = "raw") -> DataFrame:
    """Typed columns for the known keys; a value of the wrong type counts as absent.

    Unknown keys go to ``extras``. Anything that is not an object with a string
    ``hook_event_name`` has ``parsed_kind = 'unknown'`` and keeps only ``raw``.
    """
    f = lambda name: F.col(f"_f.{name}")
    typed = ("hook_event_name", *_STRINGS, "is_interrupt", "duration_ms", "tool_response")
    staged = spool.withColumn("_f", J.fields(F.col(raw), typed, ("tool_input",)))
    hook_event = F.when(J.is_object(F.col(raw), "_f"), J.text(f("hook_event_name")))
    staged = staged.select("*", hook_event.alias("hook_event"), F.json_object_keys(raw).alias("_keys"))
    is_hook = F.col("hook_event").isNotNull()
    known = F.array(*[F.lit(k) for k in V.HOOK_KEYS])
    unknown = F.size(F.array_except("_keys", known)) > 0
    entries = F.from_json(F.col(raw), "map<string,string>")
    extras = F.map_filter(entries, lambda k, _: ~F.array_contains(known, k))
    response = J.raw_at(F.col(raw), "$.tool_response")
    quoted = F.when(J.kind(f("tool_response")) == "string", json_quote(response)).otherwise(response)
    parsed = staged.select(
        *spool.columns,
        F.when(is_hook, "hook").otherwise("unknown").alias("parsed_kind"),
        "hook_event",
        *[F.when(is_hook, J.text(f(k))).alias(k) for k in _STRINGS],
        F.when(is_hook, f("tool_input")).alias("tool_input"),
        F.when(is_hook, quoted).alias("tool_response"),
        F.when(is_hook, J.boolean(f("is_interrupt"))).alias("is_interrupt"),
        F.when(is_hook, J.number(f("duration_ms"))).alias("duration_ms"),
        F.when(is_hook & unknown, extras).alias("extras"),
    )
    return fence(parsed)


def response_scan_text(
    df: DataFrame, hook_event: str, tool_name: str, response: str, error: str, out: str = "scan"
) -> DataFrame:
    """The text of a tool response to scan, each fragment once.

    Failures give the error. Connector tools answer with a JSON string whose text
    parts count. Shell and file tools have known members; anything else is
    scanned whole.
    """
    mcp, tool = split_tool_name(F.coalesce(F.col(tool_name), F.lit("")), V.NATIVE_TOOL_BUCKET)
    r = F.col("_r")
    staged = df.select("*", J.parsed(F.col(response)).alias("_r"), mcp.alias("_mcp"), tool.alias("_tool_name"))
    staged = staged.withColumn("_kind", J.kind_of(r, "$")).withColumn(
        "_inner", F.when(F.col("_kind") == "string", F.try_variant_get(r, "$", "string"))
    )
    inner_parts = F.when(J.starts_object(F.col("_inner")), result_text(F.col("_inner")))
    remote = F.when(
        F.col("_inner").isNotNull(), F.coalesce(F.nullif(inner_parts, F.lit("")), F.col("_inner"))
    ).otherwise(F.col(response))
    shell = F.array(J.string_at(r, "$.stdout"), J.string_at(r, "$.stderr"))
    patch = J.raw_at(F.col(response), "$.structuredPatch")
    files = F.array(
        J.string_at(r, "$.content"),
        J.string_at(r, "$.patch"),
        F.when((J.kind_of(r, "$.structuredPatch") == "array") & (patch != "[]"), patch),
        J.string_at(r, "$.file.content"),
    )
    has_any = lambda parts: F.exists(parts, lambda p: p.isNotNull())
    native = (
        F.when((F.col("_kind") == "object") & (F.col("_tool_name") == "Bash") & has_any(shell), dedupe_join(shell))
        .when((F.col("_kind") == "object") & F.col("_tool_name").isin(*V.FILE_TOOLS) & has_any(files), dedupe_join(files))
        .otherwise(F.col(response))
    )
    text = (
        F.when(F.col(hook_event) == "PostToolUseFailure", F.coalesce(F.col(error), F.lit("")))
        .when(F.col(response).isNull(), "")
        .when(F.col("_mcp") != V.NATIVE_TOOL_BUCKET, remote)
        .otherwise(native)
    )
    return staged.withColumn(out, text).drop("_r", "_mcp", "_tool_name", "_kind", "_inner")


def trail_session(session_id: Column) -> Column:
    """A stable trail session for an external session id; unknown ones share one.

    32 hex digits: no ULID, from which retention would read a day that is none.
    """
    return F.substr(F.sha2(F.coalesce(session_id, F.lit("__unknown__")), 256), F.lit(1), F.lit(32))


def synthesize(hooks: DataFrame, spool_key: str = "spool_no", capture_ts: str = "capture_ts") -> DataFrame:
    """One finished tool call becomes a request row and a response row.

    The request is dated back by the call's duration. Failures answer with an
    error. Every other event becomes one ``cc.event`` row with its raw payload.
    """
    mcp, tool = split_tool_name(F.col("tool_name"), V.NATIVE_TOOL_BUCKET)
    base = response_scan_text(hooks, "hook_event", "tool_name", "tool_response", "error", "response_scan")
    base = fence(base.select("*", mcp.alias("_mcp"), tool.alias("_tool")))
    pair = F.col("hook_event").isin("PostToolUse", "PostToolUseFailure") & F.col("tool_name").isNotNull()
    failed = F.col("hook_event") == "PostToolUseFailure"
    arguments = F.when(F.col("tool_input").isNotNull(), F.concat(F.lit(',"arguments":'), F.col("tool_input")))
    params = F.concat(F.lit('{"name":'), json_quote(F.col("_tool")), F.coalesce(arguments, F.lit("")), F.lit("}"))
    result = _mcp_result(F.col("tool_response"), F.col("response_scan"), F.col("_mcp"))
    millis = F.unix_millis(F.col(capture_ts))
    base = base.withColumns(
        {
            "_params": params,
            "_result": F.when(~failed, result),
            "_error": F.when(failed, F.coalesce("error", F.lit(""))),
            "_ms": millis,
        }
    )

    shared = {"session": trail_session(F.col("session_id")), "source": F.lit(V.HOOK_SOURCE), "cc_session": F.col("session_id")}
    provenance = {c: F.col(c) for c in ("prompt_id", "cwd", "agent_id", "agent_type")}
    request = _trail_struct(
        id=stamp_id(F.lit("hook"), F.col(spool_key), F.lit(0)),
        ts=F.timestamp_millis(F.col("_ms") - F.coalesce("duration_ms", F.lit(0))),
        mcp=F.col("_mcp"),
        type=F.lit("mcp.request"),
        direction=F.lit(V.CLIENT_TO_SERVER),
        rpc_id=F.col("tool_use_id"),
        method=F.lit("tools/call"),
        tool=F.col("_tool"),
        params=F.col("_params"),
        scan=F.coalesce("tool_input", F.lit("")),
        bytes=F.octet_length("_params"),
        **shared,
        **provenance,
    )
    response = _trail_struct(
        id=stamp_id(F.lit("hook"), F.col(spool_key), F.lit(1)),
        ts=F.timestamp_millis("_ms"),
        mcp=F.col("_mcp"),
        type=F.lit("mcp.response"),
        direction=F.lit(V.SERVER_TO_CLIENT),
        rpc_id=F.col("tool_use_id"),
        scan=F.col("response_scan"),
        result=F.col("_result"),
        error=F.col("_error"),
        bytes=F.octet_length(F.coalesce("_error", "_result", F.lit("null"))),
        latency_ms=F.col("duration_ms"),
        is_interrupt=F.when(failed, F.col("is_interrupt")),
        **shared,
        **provenance,
    )
    event = _trail_struct(
        id=stamp_id(F.lit("hook"), F.col(spool_key), F.lit(0)),
        ts=F.timestamp_millis("_ms"),
        mcp=F.lit(V.NATIVE_TOOL_BUCKET),
        type=F.lit("cc.event"),
        hook_event=F.col("hook_event"),
        raw=F.col("raw"),
        **shared,
    )
    return base.select(F.inline_outer(F.when(pair, F.array(request, response)).otherwise(F.array(event))))


_TRAIL_FIELDS = {
    "id": "string", "ts": "timestamp", "session": "string", "mcp": "string", "type": "string", "direction": "string",
    "rpc_id": "string", "method": "string", "tool": "string", "params": "string", "scan": "string", "result": "string",
    "error": "string", "bytes": "bigint", "latency_ms": "bigint", "is_interrupt": "boolean", "source": "string",
    "cc_session": "string", "prompt_id": "string", "cwd": "string", "agent_id": "string", "agent_type": "string",
    "hook_event": "string", "raw": "string",
}


def _trail_struct(**given: Column) -> Column:
    """All trail fields in one order and type; the ones not given are NULL."""
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _TRAIL_FIELDS.items()])


def _mcp_result(response: Column, scan: Column, mcp: Column) -> Column:
    """Results in one shape: text content, with the original kept beside it."""
    quoted = response.startswith('"')
    inner = F.when(quoted, F.try_variant_get(J.parsed(response), "$", "string"))
    inner_json = F.when(inner.rlike(r"^[ \t\r\n]*[\[{]") & J.parsed(inner).isNotNull(), inner)
    as_text = lambda t: F.concat(F.lit('{"content":[{"type":"text","text":'), json_quote(t), F.lit("}]"))
    remote = F.when(quoted, F.coalesce(inner_json, F.concat(as_text(inner), F.lit("}")))).otherwise(response)
    original = F.coalesce(F.concat(F.lit(',"structuredContent":'), response), F.lit(""))
    return F.when(mcp != V.NATIVE_TOOL_BUCKET, remote).otherwise(F.concat(as_text(scan), original, F.lit("}")))


def classify_hooks(rows: DataFrame) -> DataFrame:
    """Detections of synthesized rows: requests with a baseline, results without.

    Yields the request rows fanned out per detection and one enrichment row per
    detection of a result. Both sides go through one chain whose labels depend
    on the row, so payloads are parsed and scanned once.
    """
    keep = ["id", "ts", "session", "mcp", "rpc_id", "type", "direction", "tool", "source", "cc_session", "scan"]
    texts = rows.where("type IN ('mcp.request', 'mcp.response')").select(*keep)
    found = chain.emit(chain.classify(texts, "scan", "tool", chain.HOOK_CHAIN, F.col("type") == "mcp.request"))
    enriched = F.when(F.col("type") == "mcp.request", F.col("type")).otherwise("mcp.detection_enrichment")
    return (
        found.withColumn("type", enriched)
        .withColumn("id", stamp_id(F.col("id"), F.col("type"), F.col("ordinal")))
        .drop("scan")
    )


def ingest_status(hooks: DataFrame, capture_ts: str = "capture_ts") -> DataFrame:
    """Counters of an ingest and its heartbeat, the newest session start."""
    return hooks.agg(
        F.count("*").alias("captured"),
        F.count_if(F.col("parsed_kind") == "unknown").alias("malformed"),
        F.count_if(F.col("hook_event").isin("PostToolUse", "PostToolUseFailure")).alias("tool_calls"),
        F.max(F.when(F.col("hook_event") == "SessionStart", F.unix_millis(capture_ts))).alias("heartbeat_ms"),
    )
