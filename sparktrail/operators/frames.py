"""JSON-RPC frames: classification, byte counts, scan texts, result texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.functions import jsonx as J
from sparktrail.functions.plans import fence
from sparktrail.functions.text import dedupe_join

PARSE_REASONS = ("invalid_json", "not_an_object", "missing_jsonrpc_2_0", "malformed_jsonrpc")


def classify_frames(frames: DataFrame, line: str = "line", transport: str | None = "transport") -> DataFrame:
    """Add kind, reason, rpc_id, rpc_id_type, method, params, result, error, bytes.

    Checks run in a fixed order, so each bad line has one reason. Over HTTP the
    message arrives parsed: an error response without an id keeps a null id, and
    no line terminator is counted.
    """
    cols = frames.columns
    raw = F.col(line)
    f = lambda name: F.col(f"_f.{name}")
    staged = frames.withColumn("_f", J.fields(raw, ("jsonrpc", "id", "method"), ("params", "result", "error")))
    staged = staged.select(
        *cols,
        "_f",
        J.is_object(raw, "_f").alias("_object"),
        F.coalesce(J.text(f("jsonrpc")) == "2.0", F.lit(False)).alias("_version"),
        J.kind(f("id")).alias("_id_kind"),
        J.text(f("method")).alias("_method"),
    )
    # A null result is still an answer; only then are the member names needed.
    keys = F.when(F.col("_object") & F.col("_method").isNull(), F.json_object_keys(raw))
    has = lambda k: F.coalesce(f(k).isNotNull() | F.array_contains("_keys", k), F.lit(False))
    staged = staged.withColumn("_keys", keys)
    http = F.col(transport) == "http" if transport else F.lit(False)
    has_id, has_method = F.col("_id_kind").isNotNull(), F.col("_method").isNotNull()
    answers = has("result") | has("error")
    other = ~F.col("_object")
    reason = (
        F.when(other & (J.starts_object(raw) | F.try_parse_json(raw).isNull()), "invalid_json")
        .when(other, "not_an_object")
        .when(~F.col("_version"), "missing_jsonrpc_2_0")
        .when(has_id & ~F.col("_id_kind").isin("null", "string", "number"), "malformed_jsonrpc")
        .when(has_id & ~has_method & ~answers, "malformed_jsonrpc")
        .when(~has_id & ~has_method & ~(http & answers), "malformed_jsonrpc")
    )
    staged = staged.withColumn("reason", reason)
    failed = F.col("reason").isNotNull()
    kind = (
        F.when(failed, "parse_error")
        .when(has_method, F.when(has_id, "request").otherwise("notification"))
        .otherwise("response")
    )
    staged = staged.withColumn("kind", kind)
    with_id, response = F.col("kind").isin("request", "response"), F.col("kind") == "response"
    return fence(
        staged.select(
            *cols,
            "kind",
            "reason",
            F.when(with_id, J.scalar(f("id"))).alias("rpc_id"),
            F.when(with_id, F.coalesce("_id_kind", F.lit("null"))).alias("rpc_id_type"),
            F.when(~failed, F.col("_method")).alias("method"),
            F.when(~failed & has_method, f("params")).alias("params"),
            F.when(response, f("result")).alias("result"),
            (response & has("result")).alias("has_result"),
            F.when(response & has("error"), F.coalesce(f("error"), F.lit("null"))).alias("error"),
            (F.octet_length(raw) + F.when(http, 0).otherwise(1)).cast("bigint").alias("bytes"),
            F.when(failed, F.left(raw, F.lit(V.SNIPPET_CHARS))).alias("frame_snippet"),
            F.when(failed, F.concat(F.lit("MCP frame parse error: "), F.col("reason"))).alias("message"),
        )
    )


def tool_of_params(params: Column, method: Column) -> Column:
    """The called tool's name: ``tools/call`` with a string name, else NULL."""
    return F.when(method == "tools/call", J.string_at(J.parsed(params), "$.name"))


def result_text(result: Column) -> Column:
    """Text parts of a result plus its structured content, duplicates dropped.

    ``content`` may also be one plain string, as hook payloads have it.
    """
    parts = F.from_json(J.raw_at(result, "$.content"), "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    plain = J.string_at(J.parsed(result), "$.content")
    content = F.when(plain.isNotNull(), F.array(plain)).otherwise(F.coalesce(texts, F.array().cast("array<string>")))
    return dedupe_join(F.concat(content, F.array(J.raw_at(result, "$.structuredContent"))))


def stderr_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Wrapped server stderr lines as rows; they are recorded, never scanned."""
    return lines.select(
        *[c for c in lines.columns if c != line],
        F.lit("mcp.stderr").alias("kind"),
        F.col(line).alias("text"),
        (F.octet_length(line) + 1).cast("bigint").alias("bytes"),
    )


def non_empty(lines: DataFrame, line: str = "line") -> DataFrame:
    """Line sources drop empty lines before anything is counted."""
    return lines.where(F.length(line) > 0)
