"""Streams with engine state: any order of arrival, parts of lists, timers, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from sparktrail.operators import manifest
from sparktrail.session import scratch_path
from sparktrail.streaming import jobs, state, stateful


@pytest.fixture
def deliver(spark):
    """Run a job over batches of rows, one file and one start each."""

    def run(schema, batches, job):
        root = scratch_path(spark, "deliver")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
            state.drain(jobs.append(job(stream), root))
        return state.outputs(spark, root)

    return run


FRAME = "session string, seq bigint, ts_ms bigint, kind string, direction string, rpc_id string, at timestamp"


def test_settled_frames_are_forgotten_and_waiting_requests_are_not(deliver):
    def frame(seq, kind, rpc_id):
        direction = "client_to_server" if kind == "request" else "server_to_client"
        return ("s", seq, seq * 1000, kind, direction, rpc_id, seq)

    schema = FRAME.replace("at timestamp", "at_s bigint")
    batches = [
        [frame(1, "request", "a"), frame(2, "request", "b"), frame(4, "response", "b")],
        [frame(3, "request", "b")],  # late, but not too late: the answer is revised
        [frame(500, "request", "c")],
        [frame(900, "response", "a"), frame(901, "response", "c"), frame(1, "request", "a")],  # the last one comes again
        [frame(902, "response", "a")],  # nothing waits for it
    ]
    job = lambda s: stateful.pair_latency(s.withColumn("at", F.timestamp_seconds("at_s")), "100 seconds")
    given = deliver(schema, batches, job)
    got = {(r.seq, r.latency_ms) for r in stateful.latest_revision(given, ["session", "seq"], "latency_ms").collect()}
    assert got == {(4, 1000), (900, 899_000), (901, 401_000)}
    assert given.where("seq = 4").count() == 2


def test_withdrawn_answers_go(deliver):
    def frame(seq, kind, direction="server_to_client"):
        return ("s", seq, seq, kind, "client_to_server" if kind == "request" else direction, None, None)

    batches = [[frame(1, "request"), frame(5, "response")], [frame(3, "response")], [frame(4, "request"), frame(2, "notification")]]
    given = deliver(FRAME, batches[:2], stateful.pair_latency)
    assert [(r.seq, r.latency_ms) for r in stateful.latest_revision(given, ["session", "seq"], "latency_ms").collect()] == [(3, 2)]
    given = deliver(FRAME, batches, stateful.pair_latency)
    got = {(r.seq, r.latency_ms) for r in stateful.latest_revision(given, ["session", "seq"], "latency_ms").collect()}
    assert got == {(3, 2), (5, 1)}


TOOL = "mcp string, snap int, size int, pos int, tool string, description string, input_schema string"


def test_a_list_in_two_batches_is_one_list(deliver):
    schema = '{"properties":{"a":{}}}'
    rows = [("m", snap, 2, pos, f"t{pos}", "new" if (snap, pos) == (1, 2) else "old", schema) for snap in (0, 1) for pos in (1, 2)]
    more = [("m", 2, 3, 1, "t1", "old", schema), ("m", 2, 3, 2, "t3", "old", None), ("m", 2, 3, 3, "t1", "last", '{"properties":{"b":{}}}')]
    want = [(1, "t2", "description_changed"), (2, "t1", "description_changed"), (2, "t1", "surface_added"), (2, "t2", "tool_removed"), (2, "t3", "tool_added")]
    job = lambda s: stateful.manifest_drift(manifest.signed_rows(s))
    for batches in ([rows[:3], rows[3:], more], [more[1:], [*more[:1], *rows[2:]], rows[:2]]):
        got = deliver(TOOL, batches, job)
        assert sorted((r.snap, r.location, r.type) for r in got.collect()) == want


def test_parts_of_a_list_are_compared_apart(deliver, spark):
    rng = random.Random(5)
    schemas = ['{"properties":{"a":{}}}', '{"properties":{"a":{},"b":{}}}', '{"required":["a"]}', None]
    lists = [rng.sample(range(60), n) for n in (40, 45, 3, 38)]  # the third leaves parts empty
    rows = [(f"m{m}", snap, f"t{k}", f"text {rng.randrange(2)}", rng.choice(schemas)) for m in (0, 1) for snap, some in enumerate(lists) for k in some]
    tools = spark.createDataFrame(rows, "mcp string, snap int, tool string, description string, input_schema string")
    parted = manifest.in_parts(tools, 10)
    assert parted.where("mcp = 'm0'").select("part").distinct().count() == 5
    assert parted.where("size = 0").count() > 0
    came = parted.collect()
    rng.shuffle(came)
    got = deliver(parted.schema, [came[:100], came[90:200], came[200:]], lambda s: stateful.manifest_drift(manifest.signed_rows(s)))
    want = manifest.drift_findings(manifest.signatures(tools))
    pick = lambda df: sorted((r.mcp, r.snap, r.location, r.type) for r in df.collect())
    assert pick(got) == pick(want)


def test_alerts_begin_and_end_by_time(deliver):
    hour = 3600
    rows = {
        "a": [(10, "fail")],  # ends by itself
        "b": [(30, "fail"), (31, "recovery"), (60, "fail")],
        "c": [(200, "fail"), (230, "live"), (231, "fail")],
        "d": [(5, "live")],
    }
    flat = [(mcp, h * hour, signal) for mcp, signals in rows.items() for h, signal in signals] + [(None, 400 * hour, None)]
    job = lambda s: stateful.alert_transitions(s.withColumn("ts", F.timestamp_seconds("at_s")), 12 * hour, -1, "10 hours")
    want = [("a", 0, True), ("a", 2, False), ("b", 5, True), ("b", 7, False), ("c", 16, True), ("c", 18, False), ("c", 19, True), ("c", 21, False)]
    for cuts in ([flat], [flat[:4], flat[4:-1], flat[-1:]]):
        got = deliver("mcp string, at_s bigint, signal string", cuts, job)
        assert sorted((r.mcp, r.tick, r.alert) for r in got.collect()) == want


def test_sessions_end_once(deliver):
    rng = random.Random(2)
    rows = [("s", t, t in (50, 51)) for t in (1, 2, 30, 50, 51, 60, 61)] + [("r", t, False) for t in (5, 100, 104)] + [("q", 395, False)]
    job = lambda s: stateful.session_ends(s.withColumn("ts", F.timestamp_seconds("at_s")), 20, "1 day")
    want = [("r", 5000, 1, "silence"), ("r", 104_000, 2, "silence"), ("s", 2000, 2, "silence"), ("s", 50_000, 2, "marker"), ("s", 51_000, 1, "marker"), ("s", 61_000, 2, "silence")]
    rng.shuffle(rows)
    got = deliver("session string, at_s bigint, terminal boolean", [rows[:5], rows[5:], [(None, 86_400 + 400, None)]], job)
    assert sorted((r.session, r.last_ms, r.n, r.reason) for r in got.collect()) == want


def test_grouped_sessions_end_as_single_ones(deliver):
    day, silence = 86400, 20
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(6)}", rng.randrange(1, 400), rng.random() < 0.2) for _ in range(150)]
    # One that opens, ends while its timer waits, and opens again after that.
    rows += [("z", 40, False), ("z", 100, True), ("z", 250, False)]
    want = []
    for name in {r[0] for r in rows}:
        last, n = 0, 0
        for _, t, terminal in sorted(r for r in rows if r[0] == name):
            if n and t - last > silence:
                want.append((name, last * 1000, n, "silence"))
                n = 0
            last, n = t, n + 1
            if terminal:
                want.append((name, last * 1000, n, "marker"))
                n = 0
        if n:
            want.append((name, last * 1000, n, "silence"))
    cuts = (0, 50, 99, 110, 240, 260, 400)
    batches = [[*(r for r in rows if a < r[1] <= b), (None, day + b, None)] for a, b in zip(cuts, cuts[1:])] + [[(None, day + 500, None)]]
    for groups in (1, 3):
        job = lambda s: stateful.session_ends(s.withColumn("ts", F.timestamp_seconds("at_s")), silence, "1 day", groups)  # noqa: B023, E731
        got = deliver("session string, at_s bigint, terminal boolean", batches, job)
        assert sorted((r.session, r.last_ms, r.n, r.reason) for r in got.collect()) == sorted(want)


def test_files_of_a_step_grow_with_it(spark):
    rows = spark.range(60_000)
    assert [jobs.step_files(rows, F.col("id") % 4, each) for each in (100_000, 7_500, 1_500)] == [2, 2, 10]
    assert jobs.step_files(rows.where("id < 59990 AND id % 4 > 0 OR id < 4"), F.col("id") % 4, 1_500) == 2  # a step of one row fills one file


def test_outcomes_come_out_of_the_stream(deliver, spark):
    day = 86400
    rows = [
        ("q1", 10, "s", "m", "mcp.request", "1", "string", None),
        ("q2", 20, "s", "m", "mcp.request", "2", "string", None),
        ("q3", 30, "s", "m", "mcp.request", "3", "string", None),
        ("r1", 15, "s", "m", "mcp.response", "1", "string", None),
        ("r2", 25, "s", "m", "mcp.response", "1", "string", "boom"),
        ("r3", 30 + 5 * day, "s", "m", "mcp.response", "3", "string", "late"),  # beyond the horizon
    ]
    beats = [(None, 20 * day, "", None, t, None, "string", None) for t in ("mcp.request", "mcp.response")]
    schema = "id string, at_s bigint, session string, mcp string, type string, rpc_id string, rpc_id_type string, error string"
    timed = lambda s: s.withColumn("ts", F.timestamp_seconds("at_s"))
    got = deliver(schema, [rows[3:4] + rows[:2], rows[2:3], rows[4:], beats], lambda s: jobs.answered(timed(s), "1 day", 24))
    want = [("q1", "r1", "ok"), ("q1", "r2", "error"), ("q2", None, None), ("q3", None, None)]
    assert sorted(str((r.id, r.response_id, r.outcome)) for r in got.where("id IS NOT NULL").collect()) == sorted(map(str, want))
    final = jobs.reconciled(got, timed(spark.createDataFrame(rows, schema)))
    assert sorted(str((r.id, r.outcome)) for r in final.collect()) == sorted(map(str, [("q1", "error"), ("q2", None), ("q3", "error")]))
    late = jobs.reconciled(got.where("id <> 'q2'"), timed(spark.createDataFrame(rows, schema)))
    assert late.count() == 3
