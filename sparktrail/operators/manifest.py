"""Tool manifests: signatures, schema surface, drift between snapshots."""

from __future__ import annotations

import json
import json.scanner
import sys

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.functions import jsonx as J
from sparktrail.functions.plans import fence
from sparktrail.operators.detectors import has_injection
from sparktrail.operators.snapshots import digest_text, set_digest

_SURFACE = "struct<p:array<string>,r:array<string>>"


def _surface_udf():
    """Built on use and self-contained, so it travels to executors by value."""

    def walk(node):
        names, required, stack = set(), set(), [node]
        while stack:
            item = stack.pop()
            if isinstance(item, dict):
                props, needs = item.get("properties"), item.get("required")
                if isinstance(props, dict):
                    names.update(props)
                if isinstance(needs, list):
                    required.update(x for x in needs if isinstance(x, str))
                stack.extend(item.values())
            elif isinstance(item, list):
                stack.extend(item)
        # A lone surrogate has no UTF-8 form; it stays escaped.
        plain = lambda found: sorted(x.encode("utf-8", "backslashreplace").decode() for x in found)
        return plain(names), plain(required)

    def parse_deep(text):
        """The decoder's Python form needs frames on the heap only, as many as the text nests."""
        decoder = json.JSONDecoder()
        decoder.scan_once = json.scanner.py_make_scanner(decoder)
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(before + 4 * (text.count("[") + text.count("{")))
        try:
            return decoder.decode(text)
        finally:
            sys.setrecursionlimit(before)

    def parse(text):
        if not text:
            return None
        try:
            try:
                return json.loads(text)
            except RecursionError:
                return parse_deep(text)
        except ValueError:
            return None

    def surface(schemas: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([walk(parse(text)) for text in schemas], columns=["p", "r"])

    return F.pandas_udf(surface, _SURFACE)


def schema_surfaces(tools: DataFrame, schema: str = "input_schema") -> DataFrame:
    """Property names and required entries at any depth, once per distinct schema."""
    distinct = tools.select(F.col(schema).alias("input_schema")).distinct()
    return distinct.withColumn("_s", _surface_udf()("input_schema")).select("input_schema", "_s.p", "_s.r")


def extract_tools(results: DataFrame, result: str, *keys: str) -> DataFrame:
    """Tools of ``tools/list`` results: objects with a string name, in list order."""
    listed = F.try_variant_get(J.fields(F.col(result), ("tools",))["tools"], "$", "array<variant>")
    rows = results.select(*keys, F.posexplode_outer(listed).alias("pos", "_t"))
    tools = rows.select(
        *keys,
        "pos",
        J.string_at(F.col("_t"), "$.name").alias("tool"),
        J.string_at(F.col("_t"), "$.description").alias("description"),
        F.to_json(J.at(F.col("_t"), "$.inputSchema")).alias("input_schema"),
    )
    return fence(tools).where("tool IS NOT NULL")


def signatures(tools: DataFrame) -> DataFrame:
    """One row per (mcp, snap, tool): hashes of description and canonical schema.

    A repeated name keeps its last definition. Object key order never matters:
    the VARIANT form of a schema has sorted keys.
    """
    order = F.col("pos") if "pos" in tools.columns else F.lit(0)
    last = tools.groupBy("mcp", "snap", "tool").agg(
        F.max_by(F.struct("description", "input_schema"), order).alias("_last")
    )
    canonical = F.to_json(F.try_parse_json(F.coalesce("_last.input_schema", F.lit("null"))))
    return last.select(
        "mcp",
        "snap",
        "tool",
        F.col("_last.description").alias("description"),
        F.col("_last.input_schema").alias("input_schema"),
        F.sha2(F.coalesce("_last.description", F.lit("")), 256).alias("d"),
        F.sha2(canonical, 256).alias("s"),
    )


#: Tools of the longest list of a connector that are compared as one part, on average.
PART_TOOLS = 1000


def in_parts(tools: DataFrame, each: int = PART_TOOLS) -> DataFrame:
    """Tool lists cut into parts by their names: ``part``, and ``size`` and ``pos`` within it.

    A connector has as many parts as its longest list needs, and a name is in the same part of
    every list. A part without tools in a list has one row of size 0 without position and tool.
    """
    order = "pos" if "pos" in tools.columns else "tool"
    tools = tools.where("mcp IS NOT NULL AND snap IS NOT NULL")
    lists = tools.groupBy("mcp", "snap").agg(F.count("*").alias("_n"))
    parts = lists.groupBy("mcp").agg(F.ceil(F.max("_n") / each).cast("int").alias("_parts"))
    parted = tools.join(parts, "mcp").withColumn("part", F.pmod(F.xxhash64("tool"), "_parts").cast("int")).drop("_parts")
    here = Window.partitionBy("mcp", "snap", "part")
    position = F.row_number().over(here.orderBy(order)).cast("int")
    placed = parted.withColumn("_pos", position).withColumn("size", F.count("*").over(here).cast("int"))
    placed = placed.drop("pos").withColumnRenamed("_pos", "pos")
    every = lists.join(parts, "mcp").select("mcp", "snap", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))
    empty = every.join(parted.select("mcp", "snap", "part").distinct(), ["mcp", "snap", "part"], "left_anti")
    return placed.unionByName(empty.withColumn("size", F.lit(0)), allowMissingColumns=True)


def signed_rows(tools: DataFrame) -> DataFrame:
    """Every row of a tool list with its hashes, surface and whether its description injects.

    Row by row, so that it also runs on a stream; a tool without a schema has an empty surface.
    """
    canonical = F.to_json(F.try_parse_json(F.coalesce("input_schema", F.lit("null"))))
    none = F.array().cast("array<string>")
    return tools.withColumn("_surface", _surface_udf()("input_schema")).select(
        *(c for c in ("mcp", "snap", "part", "size", "pos", "tool") if c in tools.columns),
        F.sha2(F.coalesce("description", F.lit("")), 256).alias("d"),
        F.sha2(canonical, 256).alias("s"),
        F.coalesce("_surface.p", none).alias("p"),
        F.coalesce("_surface.r", none).alias("r"),
        F.coalesce(has_injection("description"), F.lit(False)).alias("injected"),
    )


def manifest_hashes(sigs: DataFrame) -> DataFrame:
    """A digest per (mcp, snap) that does not depend on tool order."""
    summed = sigs.groupBy("mcp", "snap").agg(*set_digest(F.col("tool"), F.col("d"), F.col("s")))
    return summed.select("mcp", "snap", F.col("n").alias("n_tools"), digest_text().alias("hash"))


def drift_findings(sigs: DataFrame) -> DataFrame:
    """Changes between consecutive manifests of a connector, one row per finding.

    The first manifest seeds silently. Joins are on (mcp, snap, tool), so a
    connector with very many tools spreads over its tools.
    """
    timeline = Window.partitionBy("mcp").orderBy("snap")
    steps = sigs.select("mcp", "snap").distinct().withColumn("_next", F.lead("snap").over(timeline))
    steps = steps.withColumn("_first", F.lag("snap").over(timeline).isNull())
    surfaces = schema_surfaces(sigs)
    none = F.array().cast("array<string>")
    # A tool without a schema has an empty surface, so that gaining one is new surface.
    shaped = sigs.join(surfaces, "input_schema", "left").join(steps, ["mcp", "snap"])
    shaped = shaped.withColumn("p", F.coalesce("p", none)).withColumn("r", F.coalesce("r", none))
    prev = shaped.where(F.col("_next").isNotNull()).select(
        "mcp", F.col("_next").alias("snap"), "tool", F.struct("d", "s", "p", "r").alias("prev")
    )
    following = shaped.where(~F.col("_first")).select(
        "mcp", "snap", "tool", "description", F.struct("d", "s", "p", "r").alias("next")
    )
    both = following.join(prev, ["mcp", "snap", "tool"], "full_outer")
    described = F.col("prev.d") != F.col("next.d")
    schema = F.col("prev.s") != F.col("next.s")
    surface = (F.size(F.array_except("next.p", "prev.p")) > 0) | (F.size(F.array_except("next.r", "prev.r")) > 0)
    found = (
        F.when(F.col("prev").isNull(), F.array(F.lit("tool_added")))
        .when(F.col("next").isNull(), F.array(F.lit("tool_removed")))
        .otherwise(
            F.array_compact(
                F.array(
                    F.when(
                        described, F.when(has_injection("description"), "injection_marker").otherwise("description_changed")
                    ),
                    F.when(schema, F.when(surface, "surface_added").otherwise("schema_changed")),
                )
            )
        )
    )
    rows = both.select("mcp", "snap", F.col("tool").alias("location"), F.explode_outer(found).alias("type"))
    return rows.where(F.col("type").isNotNull())


def drift_detections(findings: DataFrame) -> DataFrame:
    """One detection per changed manifest: high on new surface or an injected description."""
    high = F.col("type").isin("surface_added", "injection_marker")
    return findings.groupBy("mcp", "snap").agg(
        F.when(F.max(high), "high").otherwise("medium").alias("severity"), F.count("*").alias("n_findings")
    )


def latest_tool_counts(sigs: DataFrame) -> DataFrame:
    """Size of the newest tool list per connector."""
    sizes = sigs.groupBy("mcp", "snap").agg(F.count("*").alias("n"))
    return sizes.groupBy("mcp").agg(F.max_by("n", "snap").alias("n_tools"), F.max("snap").alias("snap"))
