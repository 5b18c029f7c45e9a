"""The stored trail: increments against full assembly, what they rewrite, how it is read."""

from pyspark.sql import functions as F

from sparktrail.operators import assemble, pages
from sparktrail.operators.filters import DetectionFilter, matches
from sparktrail.operators.stored import NO_DAY, StoredTrail
from sparktrail.plans import fixtures as X
from sparktrail.session import scratch_path

COLUMNS = ["id", "ts_raw", "type", "outcome", "tool_use_id", "tool_name", "cwd", "paired_source"]


def _row(id_, ts_raw, session, type_, rpc_id, direction="client_to_server", error=None, source=None, use=None, tool=None):
    return (id_, ts_raw, session, type_, rpc_id, "string", direction, error, source, use, tool)


SCHEMA = (
    "id string, ts_raw string, session string, type string, rpc_id string, rpc_id_type string, direction string, error string, "
    "source string, tool_use_id string, tool_name string"
)


def frame(spark, rows):
    made = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.try_to_timestamp("ts_raw")).withColumn("cwd", F.lit(None).cast("string"))
    return made.withColumns({"category": F.lit("pii_detected"), "severity": F.lit("high")})


def shown(df):
    return sorted(map(str, df.select(*COLUMNS, F.col("enrichment.id").alias("enrichment_id")).collect()))


ROWS = [
    _row("a1", "2024-01-01T10:00:00.000Z", "s", "mcp.request", "1", use="u1", tool="t"),
    _row("a1", "2024-01-01T10:00:00.000Z", "s", "mcp.request", "1", use="u1", tool="t"),  # delivered twice
    _row("b1", "2024-01-02T10:00:00.000Z", "s", "mcp.detection_enrichment", "2"),  # an orphan until its request comes
    _row("c1", "2024-01-03T10:00:00.000Z", "r", "mcp.request", "1", source="claude-code", use="u1"),
    _row("d1", "2024-01-05T10:00:00.000Z", "q", "mcp.request", "9", use="u9"),
    _row(None, "2024-01-05T11:00:00.000Z", "q", "mcp.request", "9"),
    _row(None, "2024-01-05T11:00:00.000Z", "q", "mcp.request", "9"),
    _row(None, "not a time", "q", "mcp.request", "9"),
    _row(None, None, None, "mcp.request", None),
]
LATE = [
    _row("a2", "2024-01-08T10:00:00.000Z", "s", "mcp.response", "1", error="boom"),  # changes day 1 only
    _row("b2", "2024-01-09T10:00:00.000Z", "s", "mcp.request", "2"),  # takes up day 2's only row
]


def test_increments_rewrite_their_days_only(spark):
    kept = StoredTrail(spark, scratch_path(spark, "stored"), ["ts_raw", "id"])
    assert kept.days() == []
    first = kept.add(frame(spark, ROWS), "one")
    assert first == sorted(kept.days()) == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05", NO_DAY]
    assert shown(kept.rows()) == shown(assemble.assemble(frame(spark, ROWS), ["ts_raw", "id"]))
    files = set(kept.rows().inputFiles())
    assert kept.add(frame(spark, LATE), "two") == ["2024-01-01", "2024-01-02", "2024-01-09"]
    want = shown(assemble.assemble(frame(spark, ROWS + LATE), ["ts_raw", "id"]))
    assert shown(kept.rows()) == want and "2024-01-02" not in kept.days()
    untouched = {f for f in files if any(f"day={d}" in f for d in ("2024-01-03", "2024-01-05", NO_DAY))}
    assert len(untouched) == 3 and untouched <= set(kept.rows().inputFiles())
    # A pair that forms or dissolves rewrites the other row's day too.
    assert kept.add(frame(spark, [_row("e1", "2024-01-20T00:00:00.000Z", "z", "mcp.request", "1", source="claude-code", use="u9")]), "three") == [
        "2024-01-05",
        "2024-01-20",
    ]
    assert kept.add(frame(spark, LATE), "two") and kept.add(frame(spark, ROWS[:0]), "four") == []
    got = {r.id: r.paired_source for r in kept.rows().where("id IS NOT NULL").collect()}
    assert got["a1"] == "cc-hook" and got["c1"] == "wrapper" and got["d1"] == "cc-hook" and got["e1"] == "wrapper" and got["b2"] is None


def test_reading_prunes_days(spark, data):
    rows = X.trail(spark, data).withColumn("args_summary", F.lit("x"))
    kept = StoredTrail(spark, scratch_path(spark, "stored"), ["id"])
    for k in range(2):
        kept.add(rows.where(F.col("event_id") % 2 == k), f"part {k}")
    full = assemble.assemble(rows, ["id"])
    assert shown(kept.rows()) == shown(full)
    day = DetectionFilter(time_range="custom", custom_range=("2024-01-10", "2024-01-11"), timezone="America/New_York")
    for f in (day, DetectionFilter(time_range="24h"), DetectionFilter()):
        near = kept.within(f, X.NOW)
        assert shown(near.where(matches(f, X.NOW))) == shown(full.where(matches(f, X.NOW)))
        if f.time_range != "all":
            assert len(near.inputFiles()) <= len(kept.rows().inputFiles())
            assert "PartitionFilters: [(" in near._jdf.queryExecution().executedPlan().toString().replace("isnotnull(day", "(isnotnull(day")
    want = [r.id for r in pages.page(full, DetectionFilter(), X.NOW, 7).collect()]
    assert [r.id for r in kept.page(DetectionFilter(), X.NOW, 7, first=1).collect()] == want
    last = kept.page(DetectionFilter(), X.NOW, 7, first=1).collect()[-1]
    cursor = (last.ts_raw, last.id)
    want = [r.id for r in pages.page(full, DetectionFilter(), X.NOW, 9, cursor).collect()]
    assert [r.id for r in kept.page(DetectionFilter(), X.NOW, 9, cursor, first=1).collect()] == want
    details = kept.details(full.limit(5))
    assert details.count() == 5 and "PushedFilters: [In(id" in details._jdf.queryExecution().executedPlan().toString()
    walked = [(r.page_no, r.id) for r in pages.numbered(kept.rows(), DetectionFilter(), X.NOW, 10).orderBy("page_no", F.desc("ts_raw"), F.desc("id")).collect()]
    order = [r.id for r in full.where(matches(DetectionFilter(), X.NOW)).orderBy(F.desc("ts_raw"), F.desc("id")).collect()]
    assert walked == [(k // 10, i) for k, i in enumerate(order)]
