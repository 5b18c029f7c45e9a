import json
import random

from pyspark.sql import functions as F

from sparktrail.operators import frames, hooks, ordered, pairing, truncation

FRAME = "session STRING, seq BIGINT, ts_ms BIGINT, kind STRING, direction STRING, rpc_id STRING, method STRING"


def _brute_force(rows):
    """In-flight map: overwrite on request, consume on response."""
    pending, out = {}, {}
    for session, seq, ts, kind, direction, rpc_id, _ in sorted(rows, key=lambda r: r[1]):
        if kind == "request":
            pending[(session, direction, rpc_id)] = ts
        elif kind == "response":
            inverted = "server_to_client" if direction == "client_to_server" else "client_to_server"
            start = pending.pop((session, inverted, rpc_id), None)
            out[seq] = None if start is None else ts - start
    return out


def random_frames(n, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        hot = rng.random() < 0.4  # one key owns a large part of all frames
        kind = rng.choice(["request", "response", "notification"])
        rpc_id = "hot" if hot else rng.choice(["1", "2", None])
        rows.append(
            ("s", seq, 1000 + seq * 3 - rng.randrange(5), kind, rng.choice(["client_to_server", "server_to_client"]), rpc_id, "m")
        )
    return rows


def test_pairing_equals_in_flight_map(spark, monkeypatch):
    monkeypatch.setattr(pairing, "SEQ_CHUNK", 7)
    rows = random_frames(400, 1)
    got = pairing.pair_responses(spark.createDataFrame(rows, FRAME)).where("kind = 'response'").collect()
    assert {r.seq: r.latency_ms for r in got} == _brute_force(rows)


def test_last_before_crosses_chunks(spark):
    rng = random.Random(2)
    rows = [("k" if rng.random() < 0.7 else "j", i, i if rng.random() < 0.1 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "key STRING, pos INT, val INT")
    got = ordered.last_before(df, ["key"], ["pos"], F.floor(F.col("pos") / 11), F.col("val"), "prev").collect()
    last, want = {}, {}
    for key, pos, val in rows:
        want[pos] = last.get(key)
        if val is not None:
            last[key] = val
    assert {r.pos: r.prev for r in got} == want


def test_global_rank_and_runs(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(4), rng.choice(["a", "b", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "pos INT, size INT, tag STRING")
    ranked = ordered.rank_in_order(df, [F.col("size"), F.floor(F.col("pos") / 9)], ["size", "pos"], "r").collect()
    want = {p: k for k, (p, _, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.pos: r.r for r in ranked} == want
    numbered = ordered.runs(df, "tag", ["pos"], F.floor(F.col("pos") / 13), "block").collect()
    block, previous, blocks = 0, object(), {}
    for pos, _, tag in rows:
        block += tag != previous
        previous = tag
        blocks[pos] = block
    assert {r.pos: r.block for r in numbered} == blocks


def test_latency_statistics_use_floor_ranks(spark):
    values = [5, 1, 9, 9, 3, 7, 10000, 2, 2, 8]
    df = spark.createDataFrame([(v,) for v in values], "v BIGINT")
    row = pairing.latency_stats(df, "v").first()
    s = sorted(values)
    assert (row.n, row.min, row.max) == (10, 1, 10000)
    assert [row.p50, row.p95, row.p99] == [s[min(9, int(q * 10))] for q in (0.5, 0.95, 0.99)]


def test_frame_truth_table(spark):
    cases = [
        ('{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{}}', "stdio", "request", None),
        ('{"jsonrpc":"2.0","id":null,"method":"x"}', "stdio", "request", None),
        ('{"jsonrpc":"2.0","id":"a","result":null}', "stdio", "response", None),
        ('{"jsonrpc":"2.0","id":"a","error":{}}', "stdio", "response", None),
        ('{"jsonrpc":"2.0","method":"x","params":[1]}', "stdio", "notification", None),
        ("{bad", "stdio", "parse_error", "invalid_json"),
        ("[]", "stdio", "parse_error", "not_an_object"),
        ("null", "stdio", "parse_error", "not_an_object"),
        ("5", "stdio", "parse_error", "not_an_object"),
        ('{"id":1,"method":"x"}', "stdio", "parse_error", "missing_jsonrpc_2_0"),
        ('{"jsonrpc":2.0,"id":1,"method":"x"}', "stdio", "parse_error", "missing_jsonrpc_2_0"),
        ('{"jsonrpc":"2.0","id":{},"method":"x"}', "stdio", "parse_error", "malformed_jsonrpc"),
        ('{"jsonrpc":"2.0","id":1}', "stdio", "parse_error", "malformed_jsonrpc"),
        ('{"jsonrpc":"2.0","error":{}}', "stdio", "parse_error", "malformed_jsonrpc"),
        ('{"jsonrpc":"2.0","error":{}}', "http", "response", None),
        ('{"jsonrpc":"2.0","method":5}', "stdio", "parse_error", "malformed_jsonrpc"),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i INT, line STRING, transport STRING")
    got = {r.i: r for r in frames.classify_frames(df).collect()}
    for i, (line, transport, kind, reason) in enumerate(cases):
        assert (got[i].kind, got[i].reason) == (kind, reason), line
        assert got[i].bytes == len(line) + (transport == "stdio")


def test_result_text_drops_duplicates(spark):
    result = json.dumps({"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "a"}], "structuredContent": {"z": 1, "b": 2}}, separators=(",", ":"))
    row = spark.createDataFrame([(result,)], "r STRING").select(frames.result_text(F.col("r")).alias("t")).first()
    assert row.t == 'a\n{"z":1,"b":2}'


def test_truncation_reaches_nested_leaves_only_when_long(spark):
    big = "é" * 10
    payload = json.dumps({"a": [{"b": big}, "ok"], "n": 1}, ensure_ascii=False)
    df = spark.createDataFrame([(1, payload), (2, '{"a":"ok"}')], "i INT, p STRING")
    got = {r.i: r for r in truncation.truncate_leaves(df, "p", limit=19).collect()}
    assert json.loads(got[1].p) == {"a": [{"b": "[truncated 20 bytes]"}, "ok"], "n": 1}
    assert got[1].truncated and not got[2].truncated and got[2].p == '{"a":"ok"}'


def test_hook_types_and_failure(spark):
    good = json.dumps({"hook_event_name": "PostToolUseFailure", "tool_name": "mcp__a-b__x__y", "tool_use_id": "t1", "error": "no", "duration_ms": 5, "cwd": 3, "is_interrupt": True, "zzz": {"k": 1}})
    rows = [(1, good), (2, '{"hook_event_name": 5}'), (3, "[1]"), (4, '{"hook_event_name":"SessionStart"}')]
    df = spark.createDataFrame(rows, "spool_no INT, raw STRING").withColumn("capture_ts", F.timestamp_millis(F.lit(1000)))
    parsed = hooks.parse_hooks(df)
    kinds = {r.spool_no: r for r in parsed.collect()}
    assert kinds[1].cwd is None and kinds[1].extras == {"zzz": '{"k":1}'}
    assert [kinds[i].parsed_kind for i in (1, 2, 3, 4)] == ["hook", "unknown", "unknown", "hook"]
    out = hooks.synthesize(parsed).collect()
    pair = {r.type: r for r in out if r.mcp == "a-b"}
    assert pair["mcp.request"].params == '{"name":"x__y"}'
    assert (pair["mcp.response"].error, pair["mcp.response"].is_interrupt, pair["mcp.response"].latency_ms) == ("no", True, 5)
    assert sum(r.type == "cc.event" for r in out) == 3
