"""Trail lines to typed rows, argument summaries, drop accounting, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.functions import jsonx as J
from sparktrail.functions.plans import fence
from sparktrail.functions.text import java_regex

_TEXT = ("id", "session", "mcp", "type", "direction", "method", "kind", "message", "source", "cwd", "reason")
_TYPED = (
    *_TEXT, "ts", "rpcId", "ccSession", "hookEventName", "isInterrupt", "bytes", "overheadUs", "latencyMs", "error",
    "detection",
)
_FINDINGS = "array<struct<type:string,location:string>>"


def parse_trail(lines: DataFrame, line: str = "raw") -> DataFrame:
    """Typed columns of trail lines. A malformed line becomes no row, never a failure."""
    others = [c for c in lines.columns if c != line]
    f = lambda name: F.col(f"_f.{name}")
    staged = lines.withColumn("_f", J.fields(F.col(line), _TYPED, ("params",)))
    called = J.text(f("method")) == "tools/call"
    params = F.when(called, f("params"))
    failed = F.when(f("error").isNotNull(), F.coalesce(F.try_variant_get(f("error"), "$", "string"), F.lit("null")))
    block = f("detection")
    rows = staged.select(
        *others,
        F.col(line).alias("raw"),
        J.is_object(F.col(line), "_f").alias("_object"),
        *[J.text(f(k)).alias(k) for k in _TEXT],
        J.text(f("ts")).alias("ts_raw"),
        F.try_to_timestamp(J.text(f("ts"))).alias("ts"),
        J.scalar(f("rpcId")).alias("rpc_id"),
        J.kind(f("rpcId")).alias("rpc_id_type"),
        J.text(f("ccSession")).alias("cc_session"),
        J.text(f("hookEventName")).alias("hook_event"),
        J.fields(params, ("name", "_meta"), ("arguments",)).alias("_p"),
        failed.alias("error"),
        J.boolean(f("isInterrupt")).alias("is_interrupt"),
        *[J.number(f(k)).alias(c) for k, c in (("bytes", "bytes"), ("overheadUs", "overhead_us"), ("latencyMs", "latency_ms"))],
        J.string_at(block, "$.category").alias("category"),
        J.string_at(block, "$.severity").alias("severity"),
        F.try_variant_get(block, "$.findings", "array<variant>").isNotNull().alias("_listed"),
        F.try_variant_get(block, "$.findings", _FINDINGS).alias("findings"),
    )
    kept = [c for c in rows.columns if c not in ("_p", "_object")]
    named = rows.select(
        "_object",
        *kept,
        J.text(F.col("_p.name")).alias("tool_name"),
        F.col("_p.arguments").alias("args_json"),
        J.string_at(F.col("_p._meta"), f"$['{V.TOOL_USE_META_KEY}']").alias("_meta_id"),
    )
    return fence(named).where("_object").withColumn("tool_use_id", _tool_use_id()).drop("_object", "_meta_id")


def _tool_use_id() -> Column:
    """Hook rows carry it as their string id, wire requests in their metadata."""
    from_hook = (F.col("source") == V.HOOK_SOURCE) & (F.col("rpc_id_type") == "string")
    from_wire = (F.col("type") == "mcp.request") & (F.col("method") == "tools/call")
    return F.when(from_hook, F.col("rpc_id")).when(from_wire, F.col("_meta_id"))


def detection_rows(rows: DataFrame, selftest_mcp: str) -> DataFrame:
    """Requests and enrichments that pass the structural guards; traffic of the self-test connector is left out."""
    shaped = (
        F.col("type").isin("mcp.request", "mcp.detection_enrichment")
        & F.col("rpc_id_type").isin("string", "number", "null")
        & F.col("direction").isin(V.CLIENT_TO_SERVER, V.SERVER_TO_CLIENT)
        & F.col("category").isNotNull()
        & F.col("severity").isNotNull()
        & F.coalesce("_listed", F.lit(False))
    )
    return rows.where(shaped & ~F.col("mcp").eqNullSafe(F.lit(selftest_mcp))).drop("_listed")


def with_args_summary(
    rows: DataFrame, tool: str = "tool_name", args: str = "args_json", cwd: str = "cwd", out: str = "args_summary"
) -> DataFrame:
    """Add one short line per call: its leading argument, relative to the project.

    The tool's own key comes first, then a fixed list, then the first string
    value in the order of the JSON text. Arguments are parsed once per row.
    """
    v, folder = F.col("_args"), F.col("_base")
    space = java_regex(r"\s+")
    staged = rows.select(
        "*", J.parsed(F.col(args)).alias("_args"), F.concat(F.regexp_replace(cwd, "/$", ""), F.lit("/")).alias("_base")
    )

    def relative(value: Column) -> Column:
        inside = F.startswith(value, folder) & (F.length(value) > F.length(folder))
        return F.when(inside, F.substr(value, F.length(folder) + 1)).otherwise(value)

    def filled(value: Column) -> Column:
        return F.when(F.trim(F.regexp_replace(value, space, " ")) != "", value)

    found = {k: filled(J.string_at(v, f"$.{k}")).alias(f"_k_{k}") for k in V.ARGS_SUMMARY_KEYS}
    staged = staged.select("*", *found.values())
    at = {k: relative(F.col(f"_k_{k}")) if k.endswith("path") else F.col(f"_k_{k}") for k in found}
    own = F.when(F.col(tool) == "Bash", at["command"]).when(F.col(tool).isin(*V.FILE_TOOLS), at["file_path"])

    def keyed(k: Column) -> Column:
        path = F.concat(F.lit('$["'), k, F.lit('"]'))
        is_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
        text = F.when(is_text, filled(F.try_variant_get(v, path, "string")))
        return F.when((k == "path") | F.endswith(k, F.lit("_path")), relative(text)).otherwise(text)

    texts = F.filter(F.transform(F.json_object_keys(F.col(args)), keyed), lambda s: s.isNotNull())
    chosen = F.coalesce(own, *at.values(), F.try_element_at(texts, F.lit(1)))
    staged = staged.select(*rows.columns, F.when(J.starts_object(F.col(args)), chosen).alias("_chosen"))
    staged = staged.withColumn("_line", F.trim(F.regexp_replace("_chosen", space, " ")))
    clipped = F.concat(F.left("_line", F.lit(V.ARGS_SUMMARY_CHARS - 1)), F.lit("…"))
    summary = F.when(F.length("_line") <= V.ARGS_SUMMARY_CHARS, F.col("_line")).otherwise(clipped)
    return staged.select(*rows.columns, summary.alias(out))


def dedupe_first(rows: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """Keep the first row per id in a defined order.

    An aggregate and not a window: copies are combined before the shuffle, so an
    id with very many copies never meets in one task.
    """
    packed = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return packed.select("_row.*")


def drop_accounting(rows: DataFrame) -> DataFrame:
    """Drops of the off-path detector by reason."""
    dropped = rows.where(F.col("type").isin("proxy.ner_dropped", "proxy.ner_worker_died"))
    return dropped.groupBy("type", "reason").agg(F.count("*").alias("n"))


def last_marker(rows: DataFrame, marker: str, *columns: str) -> DataFrame:
    """The newest marker row of a type; a later line supersedes."""
    newest = rows.where(F.col("type") == marker).agg(F.max_by(F.struct(*columns), F.struct("ts_raw", "id")).alias("_m"))
    return newest.where(F.col("_m").isNotNull()).select("_m.*")
