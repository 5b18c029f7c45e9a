import datetime as dt
import json
import random

from pyspark.sql import functions as F

from sparktrail.operators import alerts, assemble, lifecycle, manifest, pages, trail
from sparktrail.operators.filters import DetectionFilter, matches
from sparktrail.plans import fixtures as X
from sparktrail.session import materialize, scratch_path
from sparktrail.sources import files
from sparktrail.streaming import jobs, state, stateful


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_missing_folder_is_an_empty_trail(spark, tmp_path):
    assert files.read_trail_lines(spark, str(tmp_path / "none")).count() == 0
    assert files.folder_size(spark, str(tmp_path / "none")).first().asDict() == {"total_bytes": 0, "file_count": 0}


def test_tolerant_trail_reading(spark, tmp_path):
    event = {"v": 1, "id": "a", "ts": "2024-01-01T00:00:00.000Z", "session": "s", "mcp": "m", "type": "mcp.request",
             "direction": "client_to_server", "rpcId": 1, "method": "tools/call", "params": {"name": "t", "arguments": {"z": 1, "a": 2}},
             "detection": {"category": "c", "severity": "low", "findings": []}}
    lines = [json.dumps(event), "", "{broken", json.dumps({**event, "id": "b", "rpcId": {}}), json.dumps({**event, "id": "c", "mcp": "selftest"}),
             json.dumps({**event, "id": "d", "rpcId": None, "detection": 5}), '{"id":"e","id":"f"}', "[1]"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    (tmp_path / "ignored.txt").write_text(json.dumps(event))
    rows = trail.parse_trail(files.read_trail_lines(spark, str(tmp_path)))
    assert sorted(r.id for r in rows.select("id").collect()) == ["a", "b", "c", "d", "f"]
    kept = trail.detection_rows(rows, "selftest").collect()
    assert [(r.id, r.rpc_id, r.rpc_id_type, r.tool_name) for r in kept] == [("a", "1", "number", "t")]
    assert json.loads(kept[0].args_json) == {"z": 1, "a": 2}


def test_spool_names(spark, tmp_path):
    (tmp_path / "01HKZ0000000000000000000AB.json").write_text('{"hook_event_name":\n"SessionStart"}')
    (tmp_path / "note.json").write_text("{}")
    row = files.read_spool(spark, str(tmp_path)).collect()
    assert len(row) == 1 and row[0].spool_no == "01HKZ0000000000000000000AB" and row[0].capture_ts.year == 2024


def test_numbers_and_strings_are_different_calls(spark):
    rows = [
        ("1", "mcp.request", "1", "number", None), ("2", "mcp.request", "1", "string", None),
        ("3", "mcp.response", "1", "string", "bad"), ("4", "mcp.request", None, "null", None), ("5", "mcp.response", None, "null", None),
    ]
    df = spark.createDataFrame(rows, "id STRING, type STRING, rpc_id STRING, rpc_id_type STRING, error STRING")
    keyed = assemble.rpc_key(df.withColumn("session", F.lit("s")))
    known = assemble.outcomes(keyed, ["id"])
    got = {r.id: r.outcome for r in keyed.where("type = 'mcp.request'").join(known, assemble.CALL, "left").collect()}
    assert got == {"1": None, "2": "error", "4": "ok"}


def test_assembly_in_one_join_equals_the_single_steps(spark, data):
    rows = assemble.rpc_key(X.trail(spark, data))
    requests = rows.where("type = 'mcp.request'")
    enrichments = rows.where("type = 'mcp.detection_enrichment'")
    full = assemble.attach_enrichments(requests, enrichments, ["id"]).join(assemble.outcomes(rows, ["id"]), assemble.CALL, "left")
    orphans = assemble.inherit(assemble.orphan_enrichments(requests, enrichments, ["id"]), requests, ["id"])
    want = assemble.pair_sources(full.unionByName(orphans, allowMissingColumns=True))
    twice = X.trail(spark, data).unionByName(X.trail(spark, data))
    cols = ["id", "tool_use_id", "tool_name", "cwd", "enrichment", "outcome", "paired_source"]
    got = assemble.assemble(twice, ["id"]).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*cols).collect()))


def test_page_walk_equals_sorted_list(spark, data):
    gold = materialize(spark, X.trail(spark, data).withColumns({"args_summary": F.lit(""), "outcome": F.lit(""), "paired_source": F.lit("")}), "t")
    f = DetectionFilter(severities=("high",))
    want = [r.id for r in gold.where(matches(f, X.NOW)).orderBy(F.desc("ts_raw"), F.desc("id")).select("id").collect()]
    seen, cursor = [], None
    while True:
        page = pages.page(gold, f, X.NOW, 50, cursor)
        seen += [r.id for r in page.collect()]
        cursor = pages.next_cursor(page, gold, f, X.NOW, 50)
        if cursor is None:
            break
    assert seen == want
    assert "TakeOrderedAndProject" in _plan(pages.page(gold, f, X.NOW))


def test_equal_times_keep_the_alert(spark):
    rows = [("1", "a", "2024-01-31T00:00:00.000Z", "x", "fail"), ("2", "a", "2024-01-31T00:00:00.000Z", "", "live"),
            ("3", "b", "2024-01-31T00:00:00.000Z", "y", "fail"), ("4", "b", "2024-01-31T00:00:00.001Z", "", "recovery"),
            ("5", "c", "2024-01-29T00:00:00.000Z", "z", "fail")]
    df = spark.createDataFrame(rows, "id STRING, mcp STRING, ts_raw STRING, message STRING, signal STRING")
    got = alerts.auth_alerts(df, "2024-01-31 00:00:00").collect()
    assert [(r.mcp, r.message) for r in got] == [("a", "x")]


def test_local_days_follow_daylight_saving(spark):
    hours = [(dt.datetime(2024, 3, 10, 4) + dt.timedelta(hours=h),) for h in range(26)]
    df = spark.createDataFrame(hours, "ts TIMESTAMP")
    f = DetectionFilter(time_range="custom", custom_range=("2024-03-10", "2024-03-10"), timezone="America/New_York")
    from sparktrail.operators.filters import within_time

    assert df.where(within_time(f, X.NOW)).count() == 23
    bad = DetectionFilter(time_range="custom", custom_range=("soon", "2024-03-10"), timezone="America/New_York")
    assert df.where(within_time(bad, X.NOW)).count() == 24


def test_compaction_twice_adds_nothing(spark, data):
    incoming = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), (None, 3, "{b"), ("c", 4, "y")], "id STRING, line_no INT, raw STRING")
    existing = spark.createDataFrame([("c",)], "id STRING")
    first = lifecycle.new_lines(incoming, existing, ["line_no"])
    assert sorted((r.id or "", r.line_no) for r in first.collect()) == [("", 3), ("a", 1)]
    again = lifecycle.new_lines(incoming.where("id IS NOT NULL"), existing.unionByName(first.select("id")), ["line_no"])
    assert again.count() == 0


def test_csv_quotes_only_when_needed(spark):
    row = {"id": "1", "ts": "t", "mcp": 'a,"b"', "type": "x", "method": "", "tool": "two\nlines", "category": "c",
           "severity": "low", "findings_count": "0", "cc_tool_use_id": "", "paired_source": ""}
    path = scratch_path(spark, "csvtest")
    files.write_csv_export(spark.createDataFrame([row]), path)
    text = "".join(spark.sparkContext.wholeTextFiles(path).values().collect())
    assert text.splitlines()[1:] == ['t,"a,""b""",x,,"two', 'lines",c,low,0,,']


def test_surface_is_recursive(spark):
    schema = json.dumps({"anyOf": [{"properties": {"x": {"properties": {"y": {}}}}, "required": ["x", 3]}], "required": "no"})
    row = manifest.schema_surfaces(spark.createDataFrame([(schema,)], "input_schema STRING")).first()
    assert (row.p, row.r) == (["x", "y"], ["x"])


def test_tools_of_a_result(spark):
    result = json.dumps({"tools": [{"name": "a", "description": "one", "inputSchema": {"required": []}}, {"name": 5}, {"name": "a", "description": "two"}, 7]})
    df = spark.createDataFrame([("m", 0, result)], "mcp STRING, snap INT, result STRING")
    sigs = manifest.signatures(manifest.extract_tools(df, "result", "mcp", "snap")).collect()
    assert {r.tool: r.description for r in sigs}["a"] == "two"


def _split(spark, df, n, order):
    path = scratch_path(spark, "drops")
    for part in range(n):
        df.where(F.col(order) % n == part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_latency_over_many_batches_equals_batch(spark, data):
    from sparktrail.operators import pairing
    from tests.test_traffic import FRAME, random_frames

    rows = random_frames(200, 5)
    path = scratch_path(spark, "frames")
    for k in range(0, 200, 50):
        spark.createDataFrame(rows[k : k + 50], FRAME).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    root = scratch_path(spark, "latency")
    state.drain(jobs.append(stateful.pair_latency(stream), root))
    given = stateful.latest_revision(state.outputs(spark, root), ["session", "seq"], "latency_ms")
    got = {(r.seq, r.latency_ms) for r in given.collect()}
    batch = pairing.pair_responses(spark.createDataFrame(rows, FRAME)).where("kind = 'response' AND latency_ms IS NOT NULL")
    assert got == {(r.seq, r.latency_ms) for r in batch.collect()}


def test_stream_outcomes_over_many_batches_equals_batch(spark, data):
    rows = X.trail(spark, data)
    root = scratch_path(spark, "outcomes")
    state.drain(jobs.track_outcomes(_split(spark, rows, 4, "event_id"), root))
    got = {(r.session, r.rpc_key, r.outcome) for r in state.newest(state.outputs(spark, root), assemble.CALL).collect()}
    want = {(r.session, r.rpc_key, r.outcome) for r in assemble.outcomes(assemble.rpc_key(rows), ["id"]).collect()}
    assert got == want


def test_scratch_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
