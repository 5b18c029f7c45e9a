"""The whole write path: captured frames and hook payloads to one masked trail.

Wire frames are parsed, their responses get the method of their request, requests and
results of tool calls are scanned; hook payloads become calls and are scanned alike. Then
both go the same way: long leaves are cut, secrets found anywhere in what is kept of a row
are masked everywhere in it, and rows fan out to one per detection under derived ids, so
that a replay writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.operators import chain, frames, hooks, pairing
from sparktrail.operators.chain import stamp_id
from sparktrail.operators.detectors import DETECTION
from sparktrail.operators.findings import mask_persisted
from sparktrail.operators.truncation import truncate_leaves, truncate_text
from sparktrail.session import materialize

#: What is kept of a payload, in clear until it is masked.
KEPT = ("params", "result", "error", "raw")
COLUMNS = (
    "id", "ts", "session", "mcp", "type", "direction", "rpc_id", "rpc_id_type", "method", "tool", *KEPT, "bytes", "latency_ms", "source",
    "cc_session", "cwd", "hook_event", "message", "truncated",
)


def wire_rows(lines: DataFrame) -> DataFrame:
    """Rows of wire frames, ``scan`` and its policy included.

    ``lines`` has session, seq, ts_ms, mcp, direction, transport and line; a frame is known by
    (session, seq). Pairing moves narrow columns, and of the full rows only responses.
    """
    parsed = frames.classify_frames(frames.non_empty(lines))
    parsed = materialize(lines.sparkSession, parsed, "frames")
    narrow = parsed.select("session", "seq", "ts_ms", "kind", "direction", "rpc_id", "method")
    paired = pairing.pair_responses(narrow).where("kind = 'response' AND request_method IS NOT NULL")
    answered = parsed.where("kind = 'response'").join(paired.select("session", "seq", "request_method", "latency_ms"), ["session", "seq"], "left")
    others = parsed.where("kind <> 'response'").withColumns({"request_method": F.lit(None).cast("string"), "latency_ms": F.lit(None).cast("bigint")})
    request, called = F.col("kind") == "request", F.col("request_method") == "tools/call"
    scan = F.when(request, F.coalesce("params", F.lit(""))).when(called & F.col("result").isNotNull(), frames.result_text(F.col("result")))
    return others.unionByName(answered).select(
        stamp_id(F.lit("wire"), F.col("session"), F.col("seq")).alias("id"),
        F.timestamp_millis("ts_ms").alias("ts"),
        "session",
        "mcp",
        F.concat(F.lit("mcp."), F.col("kind")).alias("type"),
        "direction",
        "rpc_id",
        "rpc_id_type",
        F.coalesce("method", "request_method").alias("method"),
        frames.tool_of_params(F.col("params"), F.col("method")).alias("tool"),
        "params",
        "result",
        "error",
        F.col("frame_snippet").alias("raw"),
        "bytes",
        "latency_ms",
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("cc_session"),
        F.lit(None).cast("string").alias("cwd"),
        F.lit(None).cast("string").alias("hook_event"),
        "message",
        scan.alias("scan"),
    )


def hook_rows(payloads: DataFrame) -> DataFrame:
    """The same of hook payloads (spool_no, capture_ts, raw); ids that are no calls' stay text."""
    rows = hooks.synthesize(hooks.parse_hooks(payloads))
    call = F.col("type").isin("mcp.request", "mcp.response")
    rows = rows.withColumns(
        {"rpc_id_type": F.when(F.col("rpc_id").isNotNull(), "string"), "message": F.lit(None).cast("string"), "scan": F.when(call, F.col("scan"))}
    )
    return rows.select(*[c for c in COLUMNS if c != "truncated"], "scan")


def persisted(rows: DataFrame, key: bytes, inbound: tuple = chain.INBOUND_CHAIN) -> DataFrame:
    """Scan, cut, mask and stamp: the trail rows of captured ``rows``.

    A request comes once per detection, or with the baseline. Other rows come as they are; what
    is found in a result follows as enrichments without payload.
    """
    # Written once: three branches read them, and each would parse and pair them again.
    rows = materialize(rows.sparkSession, rows, "captured")
    none = F.array().cast(f"array<{DETECTION}>")
    request, scanned = F.col("type") == "mcp.request", F.col("scan").isNotNull()
    asked = chain.classify(rows.where(request), "scan", "tool", chain.REQUEST_CHAIN, True)
    told = chain.classify(rows.where(~request & scanned), "scan", None, inbound, False)
    found = asked.unionByName(told).unionByName(rows.where(~request & ~scanned).withColumn("detections", none)).drop("scan")
    cut = found.withColumns({"error": truncate_text(F.col("error")), "raw": truncate_text(F.col("raw"))})
    names = ["params", "result"]
    for name in names:
        cut = truncate_leaves(cut, name).withColumnRenamed("truncated", f"_cut_{name}").drop("uncut")
    cut = cut.withColumn("truncated", F.col("_cut_params") | F.col("_cut_result")).drop("_cut_params", "_cut_result")
    masked = mask_persisted(cut, key, *KEPT)
    entry = lambda kind, i, d: F.struct(kind.alias("_type"), i.alias("ordinal"), d["category"].alias("category"), d["severity"].alias("severity"), d["findings"].alias("findings"))
    itself = F.array(entry(F.col("type"), F.lit(0), F.lit(None).cast(DETECTION)))
    after = F.transform("detections", lambda d, i: entry(F.lit("mcp.detection_enrichment"), i, d))
    entries = F.when(request, F.transform("detections", lambda d, i: entry(F.col("type"), i, d))).otherwise(F.concat(itself, after))
    fanned = masked.select(*COLUMNS, F.inline_outer(entries))
    enriched = F.col("_type") == "mcp.detection_enrichment"
    changed = {c: F.when(~enriched, F.col(c)) for c in KEPT}
    stamped = fanned.withColumns({**changed, "id": stamp_id(F.col("id"), F.col("_type"), F.col("ordinal")), "type": F.col("_type")})
    return stamped.drop("_type", "ordinal")


def capture(lines: DataFrame, payloads: DataFrame, key: bytes) -> DataFrame:
    """The trail of both sources."""
    wire = persisted(wire_rows(lines), key)
    return wire.unionByName(persisted(hook_rows(payloads), key, chain.HOOK_INBOUND_CHAIN))
