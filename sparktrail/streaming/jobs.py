"""Streaming twins of the batch operators.

Each job takes a stream and a folder below the shared scratch folder, and works
with any trigger; the ``run_*`` functions drain the given tables once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.operators import assemble, entity, hooks, lifecycle, manifest
from sparktrail.operators.alerts import auth_signal, oauth_failure
from sparktrail.operators.filters import flagged
from sparktrail.operators.findings import mask_persisted
from sparktrail.plans import fixtures as X
from sparktrail.session import materialize, scratch_path
from sparktrail.sources import tail
from sparktrail.sources.tables import table
from sparktrail.streaming import state, stateful

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A given table as a file stream; works for one file and for a folder of files."""
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name}.parquet*")


def _prepare(spark: SparkSession, label: str) -> str:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return scratch_path(spark, label)


# --- ingestion ---------------------------------------------------------------


def ingest_trail(stream: DataFrame, root: str, trigger=None):
    """Append rows once per id, however late they come.

    There is no watermark: a host that was offline for days loses nothing. The state
    holds the ids seen, on the disk of the state store.
    """
    unique = stream.dropDuplicates(["id"])
    writer = unique.writeStream.format("parquet").option("path", f"{root}/out")
    return writer.option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def run_trail_ingest(spark, folder):
    root = _prepare(spark, "ingest")
    rows = stream_table(spark, folder, "events").selectExpr(*X.trail_columns("spark"))
    redelivered = rows.select("id", "ts", "session", "type", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    state.drain(ingest_trail(redelivered.drop("delivery"), root))
    return spark.read.parquet(f"{root}/out").select("id", "session", "type")


def ingest_hooks(stream: DataFrame, root: str, key: bytes, trigger=None):
    """Spool payloads to trail rows without secrets. Ids are derived, so a replay writes the same rows."""
    rows = hooks.synthesize(hooks.parse_hooks(stream))
    rows = mask_persisted(rows, key, "params", "scan", "result", "error", "raw")
    writer = rows.writeStream.format("parquet").option("path", f"{root}/out")
    return writer.option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def run_hooks(spark, folder):
    root = _prepare(spark, "hooks")
    state.drain(ingest_hooks(stream_table(spark, folder, "events").selectExpr(*X.HOOK_COLUMNS), root, X.HMAC_KEY))
    rows = spark.read.parquet(f"{root}/out")
    return rows.groupBy("type", "mcp").agg(
        F.count("*").alias("n"),
        F.min(F.unix_millis("ts")).alias("first_ms"),
        F.max(F.unix_millis("ts")).alias("last_ms"),
    )


#: Bytes of lines that a task sorts and writes into one file.
FILE_BYTES = 64 << 20


def file_count(lines: DataFrame, least: int, each: int = FILE_BYTES) -> int:
    """How many files take ``lines`` (raw) with about ``each`` bytes in one; at least ``least``."""
    total = lines.agg(F.sum(F.octet_length("raw") + 1)).first()[0] or 0
    return max(least, -(-total // each))


def grow_files(lines: DataFrame, folder: str, files: int, key: str, share: float) -> None:
    """Write the first ``share`` of the bytes of each file of ``lines`` (key, raw), cut anywhere.

    A file is written from its start each time, so a task that runs again does no harm; for a
    reader it has grown.
    """
    parted = lines.withColumn("_file", F.pmod(F.xxhash64(key), F.lit(files)))
    total = parted.groupBy("_file").agg(F.sum(F.octet_length("raw") + 1).alias("_bytes"))
    sized = parted.join(F.broadcast(total), "_file")  # one row a file
    sized = sized.repartition(files, "_file").sortWithinPartitions("_file", key)

    def run(batches):
        out, name, left = None, None, 0
        for batch in batches:
            for row in batch.select(["_file", "raw", "_bytes"]).to_pylist():
                if row["_file"] != name:
                    if out:
                        out.close()
                    name, left = row["_file"], int(row["_bytes"] * share)
                    out = tail.create(f"{folder}/part-{name:05d}.jsonl")
                data = (row["raw"] + "\n").encode()[:left]
                out.write(data)
                left -= len(data)
        if out:
            out.close()
        yield from ()

    sized.mapInArrow(run, "done int").write.format("noop").mode("overwrite").save()


def run_tail(spark, folder):
    """Trail lines out of files that grow by unequal pieces of bytes, read after each piece."""
    root = scratch_path(spark, "tail")
    lines = table(spark, folder, "events").selectExpr(*X.raw_trail_columns("spark")).select("event_id", "raw")
    lines = materialize(spark, lines, "lines")
    tail.register(spark)
    files = file_count(lines, 4)
    for share in (0.3, 0.77, 1.0):
        grow_files(lines, f"{root}/files", files, "event_id", share)
        stream = spark.readStream.format(tail.NAME).option("path", f"{root}/files").load()
        state.drain(append(stream, root))
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


# --- keyed state of the engine -----------------------------------------------


def append(rows: DataFrame, root: str, trigger=None):
    """Append what a stream gives to ``root``/out, each row once."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
    return writer.option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


#: Rows that one task writes into a file of a step.
FILE_ROWS = 100_000


def step_files(rows: DataFrame, step: Column, each: int = FILE_ROWS) -> int:
    """Files for every step: about ``each`` rows of the largest in one, at least 2, and no more than the smallest fills."""
    sizes = [r["count"] for r in rows.groupBy(step.alias("step")).count().where("step IS NOT NULL").collect()]  # a row a step
    return max(2, min(-(-max(sizes) // each), min(sizes) // 1000)) if sizes else 2


def feed(rows: DataFrame, step: Column, steps: int, root: str, job, last: DataFrame | None = None) -> DataFrame:
    """Deliver a table step by step to ``job(stream)``, which is stopped in the middle and started again.

    Every step is a micro-batch of its own; ``last`` comes after them. Returns what the job gave.
    """
    spark, files = rows.sparkSession, step_files(rows, step)
    for part in (range(steps // 2), range(steps // 2, steps)):
        for k in part:
            rows.where(step == k).repartition(files).write.mode("append").parquet(f"{root}/in")
        if last is not None and k == steps - 1:
            last.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
        given = job(stream)
        state.drain(append(given, root))
    return spark.read.schema(given.schema).parquet(f"{root}/out")


def run_latency(spark, folder):
    """Frames in any order: each step holds frames of all times."""
    root = _prepare(spark, "latency")
    frames = X.frames(spark, folder).drop("text")
    given = feed(frames, F.pmod(F.xxhash64("session", "seq"), F.lit(4)), 4, root, stateful.pair_latency)
    return stateful.latest_revision(given, ["session", "seq"], "latency_ms")


def run_manifest(spark, folder):
    """Tool lists whose rows are spread over all steps."""
    root = _prepare(spark, "manifest")
    listed = materialize(spark, manifest.in_parts(X.manifests(spark, folder)), "listed")
    step = F.pmod(F.xxhash64("mcp", "snap", "part", "pos"), F.lit(4))
    found = feed(listed, step, 4, root, lambda rows: stateful.manifest_drift(manifest.signed_rows(rows)))
    return found.groupBy("mcp", F.col("snap").cast("bigint").alias("snap"), "type").agg(F.count("*").alias("n"))


def score_texts(stream: DataFrame, text: str, load) -> DataFrame:
    """Enrichments of a stream's texts by a scorer, off the path that records the rows.

    A query of its own with its own checkpoint: how far it lags behind delays nobody, the
    source's files or bytes per trigger bound what it takes at once, and nothing is dropped.
    """
    return entity.enrich_requests(stream, text, load).drop(text)


def capital_scorer():
    """A deterministic scorer: capitalized words, the longer the surer."""
    import re

    word = re.compile("[A-Z][a-z]{2,}")

    def score(texts: list[str]) -> list[list[dict]]:
        return [[{"entity_group": "PER", "score": min(len(w), 10) / 10, "word": w} for w in word.findall(t)] for t in texts]

    return score


def run_scores(spark, folder):
    """Requests whose texts a scorer enriches on a stream of its own, stopped once and started again."""
    root = _prepare(spark, "scores")
    texts = table(spark, folder, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    given = feed(texts, F.pmod(F.xxhash64("id"), F.lit(4)), 4, root, lambda s: score_texts(s, "text", capital_scorer))
    enriched = given.select("id", "category", "severity", F.size("findings").cast("bigint").alias("n_findings"))
    # They meet their requests by id, as enrichments do by their call.
    return texts.select("id").join(enriched, "id", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0).cast("bigint")))


#: Rows of the last two queries arrive up to two days late, a step takes eight days.
_LATE, _STEP = "3 days", 8


def _arrival(ts: str, first_day: int) -> Column:
    late = F.pmod(F.xxhash64("id"), F.lit(2))
    return F.floor((F.floor(F.unix_seconds(ts) / 86400) + late - first_day) / _STEP)


def _span(rows: DataFrame) -> tuple[int, int]:
    """First and last second of a table: one row."""
    first, last = rows.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    return (0, 0) if first is None else (first, last)


def _heartbeat(rows: DataFrame, ts: Column) -> DataFrame:
    """A row of nothing but a time, by which the watermark reaches it."""
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else ts.cast("timestamp").alias("ts") for f in rows.schema]
    return rows.sparkSession.range(1).select(*nothing)


def run_alerts(spark, folder, tick_seconds: int = 43200):
    """Alert transitions out of a stream that delivers rows late and out of order."""
    root = _prepare(spark, "alerts")
    rows = X.trail(spark, folder).where("type IN ('proxy.error', 'app.connector_recovered')")
    signal = auth_signal(oauth_failure()).alias("signal")
    rows = rows.select("id", F.col("session").alias("mcp"), "ts", signal).where("signal IS NOT NULL")
    first, last = _span(rows)
    steps = (last // 86400 + 1 - first // 86400) // _STEP + 1
    end = (last // tick_seconds + 1) * tick_seconds + 3 * 86400
    job = lambda s: stateful.alert_transitions(s, tick_seconds, first // tick_seconds, _LATE)
    told = feed(rows, _arrival("ts", first // 86400), max(2, steps), root, job, _heartbeat(rows, F.timestamp_seconds(F.lit(end))))
    return told.where("alert").select("mcp", "tick")


def run_session_ends(spark, folder, silence_seconds: int = 2 * 86400):
    """Closings of sessions by terminal marker and by silence, until a given time."""
    root = _prepare(spark, "closings")
    rows = X.trail(spark, folder).selectExpr("* EXCEPT (type)", *X.MARKER_COLUMNS)
    rows = rows.select("id", "session", "ts", lifecycle.terminal_marker().alias("terminal"))
    first, last = _span(rows)
    steps = (last // 86400 + 1 - first // 86400) // _STEP + 1
    end = F.to_timestamp(F.lit(X.LATER)) + F.make_dt_interval(F.lit(3))
    job = lambda s: stateful.session_ends(s, silence_seconds, _LATE)
    return feed(rows, _arrival("ts", first // 86400), max(2, steps), root, job, _heartbeat(rows, end))


# --- keyed aggregates in update mode -----------------------------------------


def _updates(stream_agg: DataFrame, root: str, trigger=None):
    writer = stream_agg.writeStream.outputMode("update").foreachBatch(state.versioned(root))
    return writer.option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def track_outcomes(stream: DataFrame, root: str, trigger=None):
    """Last outcome per call as responses arrive, however late."""
    return _updates(assemble.outcomes(assemble.rpc_key(stream), ["id"]), root, trigger)


def answered(stream: DataFrame, lateness: str, horizon_hours: int) -> DataFrame:
    """``id, session, rpc_key, mcp, response_id, outcome`` of each request and its responses within the horizon.

    A stream-stream join: a request without a response comes out once, with nulls, when no
    response can come any more. Both sides hold what is newer than the watermark and horizon.
    """
    rows = assemble.rpc_key(stream)
    asked = rows.where("type = 'mcp.request'").select("id", "session", "rpc_key", "mcp", F.col("ts").alias("asked_at"))
    failed = F.when(F.col("error").isNotNull(), "error").otherwise("ok").alias("outcome")
    replies = rows.where("type = 'mcp.response' AND rpc_id_type IS NOT NULL").select(
        F.col("session").alias("_session"), F.col("rpc_key").alias("_key"), F.col("id").alias("response_id"), F.col("ts").alias("answered_at"), failed
    )
    near = F.expr(f"answered_at >= asked_at AND answered_at <= asked_at + INTERVAL {int(horizon_hours)} HOURS")
    same = (F.col("session") == F.col("_session")) & (F.col("rpc_key") == F.col("_key")) & near
    joined = asked.withWatermark("asked_at", lateness).join(replies.withWatermark("answered_at", lateness), same, "leftOuter")
    return joined.select("id", "session", "rpc_key", "mcp", "response_id", "outcome")


def reconciled(streamed: DataFrame, trail: DataFrame) -> DataFrame:
    """Requests with the outcome of the last response of their call, by what the stream gave and what it could not.

    The trail is read in narrow columns: for responses outside the horizon, and for requests
    that were later than the watermark. A call answered again later takes the later outcome.
    """
    known = streamed.where("id IS NOT NULL").groupBy("id", *assemble.CALL, "mcp").agg(F.max_by("outcome", "response_id").alias("outcome"))
    rows = assemble.rpc_key(trail)
    missed = rows.where("type = 'mcp.request'").join(known.select("id"), "id", "left_anti")
    every = known.unionByName(missed.select("id", *assemble.CALL, "mcp", F.lit(None).cast("string").alias("outcome")))
    last = assemble.outcomes(rows, ["id"]).withColumnRenamed("outcome", "_last")
    return every.join(last, assemble.CALL, "left").withColumn("outcome", F.coalesce("_last", "outcome")).drop("_last")


def run_outcomes(spark, folder):
    """Requests with their outcomes: out of the stream, then reconciled with the trail."""
    root = _prepare(spark, "outcomes")
    rows = X.trail(spark, folder).where("type IN ('mcp.request', 'mcp.response')")
    rows = rows.select("id", "ts", "session", "mcp", "type", "rpc_id", "rpc_id_type", "error")
    first, last = _span(rows)
    steps = (last // 86400 + 1 - first // 86400) // _STEP + 1
    beat = _heartbeat(rows, F.timestamp_seconds(F.lit(last + 10 * 86400)))
    # Of either type and with a key, or the join would drop them below the watermark.
    beat = beat.withColumns({"session": F.lit(""), "rpc_id_type": F.lit("string")})
    both = [beat.withColumn("type", F.lit(t)) for t in ("mcp.request", "mcp.response")]
    job = lambda s: answered(s, _LATE, 24)
    streamed = feed(rows, _arrival("ts", first // 86400), max(2, steps), root, job, both[0].unionByName(both[1]))
    return reconciled(streamed, rows).groupBy("mcp", "outcome").agg(F.count("*").alias("n"))


def hourly_counts(stream: DataFrame, root: str, trigger=None):
    """Flagged and critical rows of each hour: one row of state an hour. Late rows are counted too."""
    counted = stream.groupBy(F.window("ts", "1 hour")).agg(
        F.count_if(flagged()).alias("flagged"), F.count_if(F.col("severity") == "critical").alias("critical")
    )
    flat = counted.select(F.unix_seconds("window.end").alias("until_s"), "flagged", "critical")
    return _updates(flat, root, trigger)


def rolling_counts(hours: DataFrame, span: int = 24) -> DataFrame:
    """Counts of the last ``span`` hours at the end of every hour that has any, from hourly rows."""
    ends = F.explode(F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda k: F.col("until_s") + 3600 * k))
    spread = hours.select(ends.alias("until_s"), "flagged", "critical")
    return spread.groupBy("until_s").agg(F.sum("flagged").alias("flagged"), F.sum("critical").alias("critical"))


def run_counts(spark, folder):
    root = _prepare(spark, "counts")
    rows = stream_table(spark, folder, "events").selectExpr(*X.trail_columns("spark")).where("type = 'mcp.request'")
    state.drain(hourly_counts(rows, root))
    return rolling_counts(state.newest(state.outputs(spark, root), ["until_s"]))


def track_sessions(stream: DataFrame, root: str, trigger=None):
    """Last activity and terminal markers per session."""
    seen = stream.groupBy("session").agg(
        F.max(F.unix_millis("ts")).alias("last_ms"), F.count("*").alias("n"), F.bool_or("terminal").alias("terminal")
    )
    return _updates(seen, root, trigger)


def closed_sessions(sessions: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Sessions that ended, or have been silent for too long at ``now``."""
    silent = F.unix_millis(F.to_timestamp(F.lit(now))) - F.col("last_ms") > days * 86400000
    return sessions.where(F.col("terminal") | silent)


def run_sessions(spark, folder):
    root = _prepare(spark, "sessions")
    rows = stream_table(spark, folder, "events").selectExpr(*X.trail_columns("spark"))
    state.drain(track_sessions(rows.withColumn("terminal", F.col("value") > 60), root))
    return closed_sessions(state.newest(state.outputs(spark, root), ["session"]), X.LATER)
