"""Trail assembly: outcomes, enrichments, inherited keys, cross-source pairs.

Every lookup side is reduced to one row per key by a combinable aggregate first.
Joins then have a unique right side, and a hot key on the left is split by the
adaptive skew handling. Windows over event keys are avoided on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.operators.trail import dedupe_first
from sparktrail.session import materialize

CALL = ["session", "rpc_key"]
SIDE = ["session", "rpc_key", "direction"]


def rpc_key(df: DataFrame) -> DataFrame:
    """The call id as one non-null key: ``1`` and ``"1"`` differ, null matches null."""
    return df.withColumn(
        "rpc_key", F.concat_ws(":", F.coalesce("rpc_id_type", F.lit("null")), F.coalesce("rpc_id", F.lit("")))
    )


def outcomes(rows: DataFrame, order: list[str]) -> DataFrame:
    """ok / error per call from its last response."""
    failed = F.col("error").isNotNull()
    if "is_interrupt" in rows.columns:
        failed = failed | F.coalesce("is_interrupt", F.lit(False))
    # A response without an id answers no call; an id that is null answers the call with a null id.
    responses = rows.where("type = 'mcp.response' AND rpc_id_type IS NOT NULL")
    return responses.groupBy(*CALL).agg(
        F.max_by(F.when(failed, "error").otherwise("ok"), F.struct(*order)).alias("outcome")
    )


def last_enrichments(enrichments: DataFrame, order: list[str]) -> DataFrame:
    block = F.struct(F.col("id"), F.col("category"), F.col("severity"))
    return enrichments.groupBy(*SIDE).agg(F.max_by(block, F.struct(*order)).alias("enrichment"))


def attach_enrichments(requests: DataFrame, enrichments: DataFrame, order: list[str]) -> DataFrame:
    """The last enrichment of a call, given to every request row of that call and direction."""
    return requests.join(last_enrichments(enrichments, order), SIDE, "left")


def orphan_enrichments(requests: DataFrame, enrichments: DataFrame, order: list[str]) -> DataFrame:
    """Enrichments no request took, earlier ones that lost to a later one included."""
    keys = requests.select(*SIDE).distinct()
    taken = last_enrichments(enrichments, order).join(keys, SIDE, "left_semi").select(F.col("enrichment.id").alias("id"))
    return enrichments.join(taken, "id", "left_anti")


def call_attributes(requests: DataFrame, order: list[str]) -> DataFrame:
    """What a call lends to its enrichments, direction ignored.

    The tool-use id comes from the last request that has one. Tool and folder
    come together from the last request that has either.
    """
    at = F.struct(*order)
    shown = F.col("tool_name").isNotNull() | F.col("cwd").isNotNull()
    return requests.groupBy(*CALL).agg(
        F.max_by("tool_use_id", F.when(F.col("tool_use_id").isNotNull(), at)).alias("_use"),
        F.max_by(F.struct("tool_name", "cwd"), F.when(shown, at)).alias("_shown"),
    )


def inherit(enrichments: DataFrame, requests: DataFrame, order: list[str]) -> DataFrame:
    """Fill missing tool-use id, tool and folder of enrichments from their call."""
    lent = enrichments.join(call_attributes(requests, order), CALL, "left")
    return lent.withColumns(
        {
            "tool_use_id": F.coalesce("tool_use_id", "_use"),
            "tool_name": F.coalesce("tool_name", "_shown.tool_name"),
            "cwd": F.coalesce("cwd", "_shown.cwd"),
        }
    ).drop("_use", "_shown")


def is_hook() -> Column:
    return F.coalesce(F.col("source") == V.HOOK_SOURCE, F.lit(False))


def both_sides(rows: DataFrame) -> DataFrame:
    """Tool uses that both sources recorded, marked ``_both``."""
    seen = rows.where("tool_use_id IS NOT NULL").groupBy("tool_use_id").agg(
        F.bool_or(is_hook()).alias("_hook"), F.bool_or(~is_hook()).alias("_wire")
    )
    return seen.where("_hook AND _wire").select("tool_use_id", F.lit(True).alias("_both"))


def other_side() -> Column:
    return F.when(is_hook(), V.WIRE_SIDE).otherwise(V.HOOK_SIDE)


def pair_sources(rows: DataFrame) -> DataFrame:
    """Name the other source when both recorded the same tool use."""
    paired = F.when(F.col("_both"), other_side())
    return rows.join(both_sides(rows), "tool_use_id", "left").withColumn("paired_source", paired).drop("_both")


def call_lookup(rows: DataFrame, order: list[str]) -> DataFrame:
    """Everything assembly needs to know per call, in one combinable aggregate.

    Per direction: the last enrichment and whether a request is there to take it.
    """
    at, request = F.struct(*order), F.col("type") == "mcp.request"
    failed = F.col("error").isNotNull()
    if "is_interrupt" in rows.columns:
        failed = failed | F.coalesce("is_interrupt", F.lit(False))
    shown = request & (F.col("tool_name").isNotNull() | F.col("cwd").isNotNull())
    has_use = request & F.col("tool_use_id").isNotNull()
    block = F.struct("id", "category", "severity")
    per_side = []
    for side in (V.CLIENT_TO_SERVER, V.SERVER_TO_CLIENT):
        here = F.col("direction") == side
        enriched = here & (F.col("type") == "mcp.detection_enrichment")
        per_side.append(F.max_by(block, F.when(enriched, at)).alias(f"_last_{side}"))
        per_side.append(F.bool_or(here & request).alias(f"_asked_{side}"))
    return rows.groupBy(*CALL).agg(
        F.max_by(F.when(failed, "error").otherwise("ok"), F.when(F.col("type") == "mcp.response", at)).alias("_outcome"),
        F.max_by("tool_use_id", F.when(has_use, at)).alias("_use"),
        F.max_by(F.struct("tool_name", "cwd"), F.when(shown, at)).alias("_shown"),
        *per_side,
    )


def _first_copies(rows: DataFrame, order: list[str]) -> DataFrame:
    """Requests and enrichments once per id. Rows without an id, and all others, are not copies of each other.

    Ids that come more than once are found first, in a narrow count, and only their rows are
    compared: whole rows that are alone under their id are neither shuffled nor sorted.
    """
    shown = F.coalesce(F.col("type").isin("mcp.request", "mcp.detection_enrichment") & F.col("id").isNotNull(), F.lit(False))
    again = rows.where(shown).groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id")
    # Written, so that its size is known when the rows' joins are planned.
    again = materialize(rows.sparkSession, again, "copies").withColumn("_again", F.lit(True))
    marked = rows.join(again, "id", "left")
    copies = shown & F.col("_again").isNotNull()
    several = dedupe_first(marked.where(copies).select(*rows.columns), order)
    return several.unionByName(marked.where(~copies).select(*rows.columns))


def assemble(trail: DataFrame, order: list[str], dedupe: bool = True, pair: bool = True) -> DataFrame:
    """Silver rows to gold: requests and orphan enrichments with all they inherit.

    The same result as the single steps above, from one lookup and one join. The
    deduplicated rows are written once, since several branches read them.
    """
    rows = rpc_key(trail)
    if dedupe:
        rows = materialize(trail.sparkSession, _first_copies(rows, order), "silver")
    joined = rows.where(F.col("type").isin("mcp.request", "mcp.detection_enrichment")).join(
        call_lookup(rows, order).hint("shuffle_hash"), CALL, "left"
    )
    request = F.col("type") == "mcp.request"
    outbound = F.col("direction") == V.CLIENT_TO_SERVER
    last = F.when(outbound, F.col(f"_last_{V.CLIENT_TO_SERVER}")).otherwise(F.col(f"_last_{V.SERVER_TO_CLIENT}"))
    asked = F.when(outbound, F.col(f"_asked_{V.CLIENT_TO_SERVER}")).otherwise(F.col(f"_asked_{V.SERVER_TO_CLIENT}"))
    kept = joined.withColumns({"_last": last, "_asked": asked}).where(
        request | ~F.coalesce(F.col("_asked") & (F.col("id") == F.col("_last.id")), F.lit(False))
    )
    lend = lambda own, lent: F.when(request, F.col(own)).otherwise(F.coalesce(own, lent))
    full = kept.select(
        *[c for c in rows.columns if c not in ("tool_use_id", "tool_name", "cwd", "rpc_key")],
        lend("tool_use_id", "_use").alias("tool_use_id"),
        lend("tool_name", "_shown.tool_name").alias("tool_name"),
        lend("cwd", "_shown.cwd").alias("cwd"),
        F.when(request, F.col("_last")).alias("enrichment"),
        F.when(request, F.col("_outcome")).alias("outcome"),
    )
    return pair_sources(full) if pair else full
