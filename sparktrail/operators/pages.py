"""Pages, counts, facets and details over the gold rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.operators.filters import (
    DetectionFilter, base_filter, flagged, matches, pre_severity, project, source_kind,
)
from sparktrail.operators.ordered import rank_in_order, runs, time_chunk
from sparktrail.operators.trail import dedupe_first


def _newest():
    return [F.col("ts_raw").desc(), F.col("id").desc()]


def slim(gold: DataFrame) -> DataFrame:
    """The narrow list row; heavy fields stay in the table."""
    return gold.select(
        "id", "ts_raw", "ts", "mcp", "type", "category", "severity", source_kind().alias("source"),
        "cc_session", "paired_source", "tool_name", project().alias("project"), "method", "args_summary", "outcome",
    )


def detail(gold: DataFrame) -> DataFrame:
    request = F.col("type") == "mcp.request"
    return gold.select(
        "id", "ts_raw", "session", "mcp", "type", "rpc_id", "direction", "category", "severity",
        source_kind().alias("source"), F.when(request, F.col("method")).alias("method"),
        F.when(request, F.col("tool_name")).alias("tool_name"), F.when(request, F.col("args_json")).alias("arguments"),
    )


def page(
    gold: DataFrame, f: DetectionFilter, now, limit: int = V.PAGE_SIZE, cursor: tuple[str, str] | None = None
) -> DataFrame:
    """Rows strictly after the cursor in (ts, id) descending order: a bounded top-N."""
    rows = gold.where(matches(f, now))
    if cursor is not None:
        ts, id_ = cursor
        rows = rows.where((F.col("ts_raw") < ts) | ((F.col("ts_raw") == ts) & (F.col("id") < id_)))
    return slim(rows).orderBy(*_newest()).limit(limit)


def next_cursor(page_rows: DataFrame, gold: DataFrame, f: DetectionFilter, now, limit: int) -> tuple[str, str] | None:
    """The last row's key when more rows follow it, else None. Reads at most two rows."""
    last = page_rows.orderBy("ts_raw", "id").select("ts_raw", "id").first()
    if last is None:
        return None
    cursor = (last["ts_raw"], last["id"])
    more = page(gold, f, now, 1, cursor).select("id").first()
    return cursor if more is not None else None


def walk(gold: DataFrame, f: DetectionFilter, now, pages: int, limit: int = V.PAGE_SIZE) -> DataFrame:
    """Head page and the pages after it, overlaps removed by id."""
    merged, cursor = None, None
    for _ in range(pages):
        rows = page(gold, f, now, limit, cursor)
        merged = rows if merged is None else merged.unionByName(rows)
        cursor = next_cursor(rows, gold, f, now, limit)
        if cursor is None:
            break
    return dedupe_first(merged, ["ts_raw"])


def numbered(gold: DataFrame, f: DetectionFilter, now, limit: int = V.PAGE_SIZE) -> DataFrame:
    """Every page at once: all matching rows with ``page_no``, 0 for the newest ``limit`` rows."""
    rows = slim(gold.where(matches(f, now)))
    spans = [F.left("ts_raw", F.lit(n)) for n in (10, 13)]  # prefixes of the order: day, hour
    ranked = rank_in_order(rows, spans, ["ts_raw", "id"], "_rank")
    total = rows.agg(F.count("*").alias("n")).scalar()
    return ranked.withColumn("page_no", F.floor((total - 1 - F.col("_rank")) / limit)).drop("_rank")


def counts(gold: DataFrame, f: DetectionFilter, now) -> DataFrame:
    """Totals and the four severity buckets in one pass."""
    pre, severity = pre_severity(f, now), F.col("severity")
    return gold.agg(
        F.count("*").alias("total"),
        F.count_if(pre).alias("category_filtered_total"),
        F.count_if(pre & severity.isin(*f.severities)).alias("total_matching"),
        *[F.count_if(pre & (severity == s)).alias(s) for s in V.SEVERITIES],
    )


def facets(gold: DataFrame, f: DetectionFilter, now) -> DataFrame:
    """Menu entries (facet, value): what the base filter offers plus active selections.

    Rows, not lists: a menu of any size stays distributed.
    """
    offered = gold.where(base_filter(f, now) & (F.col("type") == "mcp.request"))
    pairs = F.array(
        F.struct(F.lit("tool").alias("facet"), F.col("tool_name").alias("value")),
        F.struct(F.lit("project").alias("facet"), project().alias("value")),
    )
    menu = offered.select(F.inline(pairs)).where("value IS NOT NULL").distinct()
    active = [("tool", v) for v in f.tools] + [("project", v) for v in f.projects]
    if active:
        chosen = gold.sparkSession.createDataFrame(active, "facet string, value string")
        menu = menu.unionByName(chosen).distinct()
    return menu


def session_facet(gold: DataFrame, f: DetectionFilter, now) -> DataFrame:
    """Sessions with their start and place: the newest project, else the newest connector."""
    rows = gold.where(base_filter(f, now) & F.col("cc_session").isNotNull())
    at = F.struct("ts_raw", "id")
    has_project = (F.col("type") == "mcp.request") & F.col("cwd").isNotNull()
    return rows.groupBy("cc_session").agg(
        F.min("ts_raw").alias("started"),
        F.coalesce(F.max_by(project(), F.when(has_project, at)), F.max_by("mcp", at)).alias("place"),
    )


def tray_counts(rows: DataFrame, now) -> DataFrame:
    """Flagged and critical in the last day, over requests and inbound enrichments."""
    countable = (F.col("type") == "mcp.request") | (
        (F.col("type") == "mcp.detection_enrichment") & (F.col("direction") == V.SERVER_TO_CLIENT)
    )
    recent = F.col("ts") >= F.to_timestamp(F.lit(now)) - F.expr("INTERVAL 24 HOURS")
    return rows.where(countable & recent).agg(
        F.count_if(flagged()).alias("flagged_24h"), F.count_if(F.col("severity") == "critical").alias("critical_24h")
    )


def calls_by_connector(rows: DataFrame, now, days: int = 7) -> DataFrame:
    """Calls and flagged calls per connector in the last days."""
    recent = F.col("ts") >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(days=F.lit(days))
    return rows.where(recent).groupBy("mcp").agg(F.count("*").alias("calls"), F.count_if(flagged()).alias("flagged"))


def recent_flagged(rows: DataFrame, top: int = 8) -> DataFrame:
    """The newest flagged rows per connector; Spark cuts each group before the shuffle."""
    newest = Window.partitionBy("mcp").orderBy(*_newest())
    ranked = rows.where(flagged()).withColumn("rank", F.row_number().over(newest))
    return ranked.where(F.col("rank") <= top)


def session_blocks(rows: DataFrame) -> DataFrame:
    """Separators of the session list: one per maximal run of rows of one session.

    Rows without a session break runs and get no separator. The label names the
    place of the newest row and the start of the oldest.
    """
    numbered = runs(rows, "cc_session", ["ts_raw", "id"], time_chunk(F.col("ts")), "block")
    at = F.struct("ts_raw", "id")
    blocks = numbered.where("cc_session IS NOT NULL").groupBy("block").agg(
        F.max_by(F.struct("id", "cc_session", F.coalesce(project(), F.col("mcp")).alias("place")), at).alias("head"),
        F.min("ts").alias("oldest"),
        F.count("*").alias("n"),
    )
    label = F.concat(F.col("head.place"), F.lit(" · started "), F.date_format("oldest", "dd MMM, HH:mm"))
    return blocks.select(F.col("head.id").alias("first_id"), "head.cc_session", "n", label.alias("label"))
