"""Keyed state of streaming jobs, held by the engine's state store.

Each processor sees the rows of one key. Rows may come in any order and in any batch: an
answer that a later row changes is given again with the next revision, and readers take
the last one (``latest_revision``). Where a lateness is given, state settles behind the
watermark and stays small; without one it is exact for rows of any age.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sparktrail import values as V

LATENCY = "session string, seq bigint, latency_ms bigint, revision int"
FINDINGS = "mcp string, snap int, location string, type string"
ALERTS = "mcp string, tick bigint, alert boolean"
CLOSED = "session string, last_ms bigint, n bigint, reason string"


def latest_revision(updates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last answer per key; withdrawn ones go."""
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(value), "revision").alias("_last"))
    return last.select(*keys, F.col(f"_last.{value}").alias(value)).where(F.col(value).isNotNull())


def _timed(stream: DataFrame, at: str, lateness: str | None) -> tuple[DataFrame, str]:
    return (stream, "None") if lateness is None else (stream.withWatermark(at, lateness), "EventTime")


class InFlight(StatefulProcessor):
    """Frames of one call id in order of their numbers; a response takes the request right before it."""

    def __init__(self, settles: bool) -> None:
        self.settles = settles

    def init(self, handle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "seq bigint", "response boolean, ts_ms bigint, latency_ms bigint, revision int")

    def handleInputRows(self, key, rows, timerValues):
        held = {k[0]: tuple(v) for k, v in self.frames.iterator()}
        touched = set()
        for row in rows:
            # A frame delivered again changes nothing.
            if row.seq not in held:
                held[row.seq] = (row.kind == "response", row.ts_ms, None, 0)
                touched.add(row.seq)
        before = None
        for seq in sorted(held):
            response, ts_ms, known, revision = held[seq]
            latency = ts_ms - before[1] if response and before and not before[0] else None
            if latency != known:
                held[seq] = (response, ts_ms, latency, revision + 1)
                touched.add(seq)
                yield Row(session=key[0], seq=seq, latency_ms=latency, revision=revision + 1)
            before = held[seq]
        settled = self._settle(held, timerValues) if self.settles else set()
        for seq in touched - settled:
            self.frames.updateValue((seq,), held[seq])
        if self.settles and held:
            self.handle.registerTimer(max(frame[1] for frame in held.values()) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._settle({k[0]: tuple(v) for k, v in self.frames.iterator()}, timerValues)
        return iter(())

    def _settle(self, held: dict, timerValues) -> set:
        """Forget frames behind the watermark: only a request that still waits can matter."""
        watermark = timerValues.getCurrentWatermarkInMs()
        behind = sorted(seq for seq, frame in held.items() if frame[1] < watermark)
        if not behind:
            return set()
        if not held[behind[-1]][0]:
            behind.pop()
        for seq in behind:
            self.frames.removeKey((seq,))
        return set(behind)

    def close(self) -> None:
        pass


def pair_latency(stream: DataFrame, lateness: str | None = None) -> DataFrame:
    """Latencies of responses as revisions, from frames in any order.

    With a lateness (frames then need ``at``, a timestamp) rows later than it are dropped and
    the state holds what is newer than the watermark, and requests that wait for an answer.
    """
    inverted = F.when(F.col("direction") == V.CLIENT_TO_SERVER, V.SERVER_TO_CLIENT).otherwise(V.CLIENT_TO_SERVER)
    frames = stream.where(F.col("kind").isin("request", "response"))
    asked = F.when(F.col("kind") == "request", F.col("direction")).otherwise(inverted).alias("request_direction")
    timed = ["at"] if lateness else []
    frames, mode = _timed(frames.select("session", asked, "rpc_id", "seq", "kind", "ts_ms", *timed), "at", lateness)
    return frames.groupBy("session", "request_direction", "rpc_id").transformWithState(InFlight(lateness is not None), LATENCY, "Append", mode)


class Baseline(StatefulProcessor):
    """One part of the tool lists of one connector: the last complete one, and the pieces of those still open.

    A part of a list is complete when all of its rows are there; it is compared when its predecessor
    has been. That of the first list, number ``first``, seeds silently.
    """

    def __init__(self, first: int = 0) -> None:
        self.first = first

    def init(self, handle) -> None:
        # Of each list that waits: its size, the rows that came and the pieces they are held in.
        self.progress = handle.getValueState("progress", "compared int, snap array<int>, size array<int>, came array<int>, pieces array<int>")
        tools = "tool array<string>, d array<string>, s array<string>, surface array<string>"
        self.tools = handle.getValueState("tools", tools)
        self.open = handle.getMapState("open", "snap int, piece int", f"pos array<int>, {tools}, injected array<boolean>")

    def handleInputRows(self, key, rows, timerValues):
        compared, *lists = self.progress.get() or (self.first - 1, [], [], [], [])
        waiting = {snap: counts for snap, *counts in zip(*lists)}
        fresh: dict[int, list] = {}
        came = pd.concat(list(rows))
        for snap, some in came[came["snap"] > compared].groupby("snap"):
            counts = waiting.setdefault(int(snap), [0, 0, 0])
            counts[0] = int(some["size"].iloc[-1])
            some = some[some["pos"].notna()]  # a part without tools has a row without a position
            counts[1] += len(some)
            if len(some):
                fresh[int(snap)] = [some["pos"].astype(int).tolist(), *(_plain(some[c]) for c in ("tool", "d", "s", "surface", "injected"))]
        before, found = None, []
        while compared + 1 in waiting:
            snap = compared + 1
            size, n, pieces = waiting[snap]
            if n < size:
                break
            held = [self.open.getValue((snap, piece)) for piece in range(pieces)] + ([fresh[snap]] if snap in fresh else [])
            # A row that comes again takes the place of the first.
            rows_of = {pos: row for part in held for pos, *row in zip(*part)}
            if len(rows_of) < size:
                waiting[snap][1] = len(rows_of)
                break
            if before is None:
                before = {tool: rest for tool, *rest in zip(*(self.tools.get() or ()))}
            # Of a name listed twice the last definition holds.
            tools = {row[0]: row[1:] for _, row in sorted(rows_of.items(), key=lambda x: x[0])}
            if snap > self.first:
                found += ((snap, tool, kind) for tool, kind in self._compare(before, tools))
            before = {tool: rest[:3] for tool, rest in tools.items()}
            for piece in range(pieces):
                self.open.removeKey((snap, piece))
            del waiting[snap]
            fresh.pop(snap, None)
            compared = snap
        for snap, piece in fresh.items():
            self.open.updateValue((snap, waiting[snap][2]), tuple(piece))
            waiting[snap][2] += 1
        if before is not None:
            self.tools.update((list(before), *([rest[k] for rest in before.values()] for k in range(3))))
        self.progress.update((compared, list(waiting), *([counts[k] for counts in waiting.values()] for k in range(3))))
        if found:
            told = pd.DataFrame(found, columns=["snap", "location", "type"])
            told.insert(0, "mcp", key[0])
            yield told.astype({"snap": "int32"})

    def _compare(self, before: dict, tools: dict):
        for tool, (d, s, surface, injected) in tools.items():
            if tool not in before:
                yield tool, "tool_added"
                continue
            d0, s0, surface0 = before[tool]
            if d != d0:
                yield tool, "injection_marker" if injected else "description_changed"
            if s != s0:
                now, was = json.loads(surface), json.loads(surface0)
                yield tool, "surface_added" if any(set(now[k]) - set(was[k]) for k in "pr") else "schema_changed"
        yield from ((tool, "tool_removed") for tool in before.keys() - tools.keys())

    def close(self) -> None:
        pass


def _plain(column) -> list:
    return [None if x is None or x != x else x for x in column.tolist()]


def manifest_drift(signed: DataFrame, first: int = 0) -> DataFrame:
    """Findings between consecutive tool lists of a connector, numbered from ``first`` without gaps.

    ``signed`` has a row per tool: mcp, snap, size (rows of its list), pos, tool, d, s, p, r, injected.
    A list may be spread over any batches; a list of no tools has no rows and holds later ones back.
    With a column ``part`` (``manifest.in_parts``) size and pos are those of a part, every part is
    compared by itself, and one that lacks rows holds back its own successors only.
    """
    parted = signed if "part" in signed.columns else signed.withColumn("part", F.lit(0))
    rows = parted.select("mcp", "part", "snap", "size", "pos", "tool", "d", "s", F.to_json(F.struct("p", "r")).alias("surface"), "injected")
    return rows.groupBy("mcp", "part").transformWithStateInPandas(Baseline(first), FINDINGS, "Append", "None")


class AlertState(StatefulProcessor):
    """Last failure and last later signal of a connector, judged at the end of each tick.

    A timer waits at the end of every tick with a signal, and at the end of an alert, which
    so ends without a row.
    """

    def __init__(self, tick_ms: int, lasts_ms: int, first_tick: int) -> None:
        self.tick_ms, self.lasts_ms, self.first_tick = tick_ms, lasts_ms, first_tick

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", "fail_ms bigint, later_ms bigint, active boolean")
        # What came of ticks that have not ended: last failure and last other signal.
        self.ticks = handle.getMapState("ticks", "tick bigint", "fail_ms bigint, later_ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        came: dict[int, list] = {}
        for row in rows:
            if key[0] is None or row.signal is None:
                continue
            tick = row.ts_ms // self.tick_ms
            seen = came.setdefault(tick, list(self.ticks.getValue((tick,))) if self.ticks.containsKey((tick,)) else [None, None])
            which = 0 if row.signal == "fail" else 1
            seen[which] = max(seen[which] or row.ts_ms, row.ts_ms)
        for tick, seen in came.items():
            self.ticks.updateValue((tick,), tuple(seen))
            self.handle.registerTimer((tick + 1) * self.tick_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """All ticks that have ended, in order, whichever timer came first."""
        now = timerValues.getCurrentWatermarkInMs()
        fail, later, active = self.state.get() if self.state.exists() else (None, None, False)
        for tick in sorted(k[0] for k in self.ticks.keys()):
            end = (tick + 1) * self.tick_ms
            if end > now:
                break
            if active and self._last_tick(fail) < tick:
                yield Row(mcp=key[0], tick=self._last_tick(fail), alert=False)
                active = False
            seen = self.ticks.getValue((tick,))
            fail, later = (max((x for x in pair if x is not None), default=None) for pair in ((fail, seen[0]), (later, seen[1])))
            self.ticks.removeKey((tick,))
            alerting = fail is not None and fail >= end - self.lasts_ms and not (later is not None and fail < later)
            if alerting != active and (active or tick > self.first_tick):
                yield Row(mcp=key[0], tick=tick, alert=alerting)
            active = alerting
        if active:
            end = (self._last_tick(fail) + 1) * self.tick_ms
            if end <= now:
                yield Row(mcp=key[0], tick=self._last_tick(fail), alert=False)
                active = False
            else:
                self.handle.registerTimer(end)
        self.state.update((fail, later, active))

    def _last_tick(self, fail: int) -> int:
        """The tick at whose end a failure is too old for the first time."""
        return (fail + self.lasts_ms) // self.tick_ms

    def close(self) -> None:
        pass


def alert_transitions(signals: DataFrame, tick_seconds: int, first_tick: int, lateness: str, hours: int = 24) -> DataFrame:
    """Connectors that alert at the end of a tick and not at the end of the one before, and the other way round.

    ``signals`` has mcp, ts and signal (fail, live or recovery); other rows only move the watermark.
    Tick ``first_tick``, at which the job began, tells no alert.
    """
    # No filter here: it would be pushed below the watermark, which other rows move too.
    rows = signals.withWatermark("ts", lateness).select("mcp", "ts", F.unix_millis("ts").alias("ts_ms"), "signal")
    processor = AlertState(tick_seconds * 1000, hours * 3_600_000, first_tick)
    return rows.groupBy("mcp").transformWithState(processor, ALERTS, "Append", "EventTime")


class SessionEnds(StatefulProcessor):
    """Activity of a group of sessions, which close after a terminal marker or a silence, once each time.

    Moments come when the watermark has passed them, those of a batch after those of the batches
    before, so that only the open stretch of a session is held; what comes after a closing opens
    the session anew. One timer waits for the first silence that can end.
    """

    def __init__(self, silence_ms: int) -> None:
        self.silence_ms = silence_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "timer_ms bigint, session array<string>, last_ms array<bigint>, n array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        came = pd.concat([part[["session", "ts_ms", "terminal", "n"]] for part in rows])
        return self._closings(came[came["session"].notna()], None, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._closings(None, expiredTimerInfo.getExpiryTimeInMs(), timerValues)

    def _closings(self, came, expired, timerValues):
        now = timerValues.getCurrentWatermarkInMs()
        timer, *held = self.open.get() or (None, [], [], [])
        rows = pd.DataFrame({"session": held[0], "ts_ms": held[1], "terminal": False, "n": held[2]})
        if came is not None:
            # Of rows at one time the terminal ones come last, each by itself.
            came = came.reset_index(drop=True)
            again = came.index.repeat(np.where(came["terminal"], came["n"], 1))
            came = came.loc[again].assign(n=lambda x: np.where(x["terminal"], 1, x["n"]))
            rows = pd.concat([rows, came]) if len(rows) else came
        if not len(rows):
            if expired is not None:
                self.open.clear()
            return
        rows = rows.sort_values(["session", "ts_ms", "terminal"], kind="stable")
        session, ts_ms = rows["session"].to_numpy(object), rows["ts_ms"].to_numpy("int64")
        terminal, n = rows["terminal"].to_numpy(bool), rows["n"].to_numpy("int64")
        same = session[1:] == session[:-1]
        begins = np.flatnonzero(np.r_[True, ~same | terminal[:-1] | (np.diff(ts_ms) > self.silence_ms)])
        ends = np.r_[begins[1:], len(session)] - 1
        followed = np.r_[same, False][ends]
        closed = terminal[ends] | followed | (now - ts_ms[ends] > self.silence_ms)
        runs = pd.DataFrame({"session": session[ends], "last_ms": ts_ms[ends], "n": np.add.reduceat(n, begins)})
        still = runs[~closed]
        timer = None if timer == expired else timer
        if len(still) and timer is None:
            timer = int(still["last_ms"].min()) + self.silence_ms + 1
            self.handle.registerTimer(timer)
        if len(still) or timer is not None:
            self.open.update((timer, *(still[c].tolist() for c in still.columns)))
        else:
            self.open.clear()
        yield runs.assign(reason=np.where(terminal[ends], "marker", "silence"))[closed]

    def close(self) -> None:
        pass


def session_ends(rows: DataFrame, silence_seconds: int, lateness: str, groups: int = 1024) -> DataFrame:
    """``session, last_ms, n, reason`` of every closing; ``rows`` has session, ts and terminal.

    Rows wait for the watermark in an aggregate; what it lets go is judged for ``groups`` hashed
    groups of sessions, each as a whole. A group holds its open sessions, so ``groups`` should
    grow with their number; a checkpoint stays with its number.
    """
    # Rows without a session move the watermark, as for alerts.
    timed = rows.select("session", F.timestamp_millis(F.unix_millis("ts")).alias("ts"), F.coalesce("terminal", F.lit(False)).alias("terminal"))
    moments = timed.withWatermark("ts", lateness).groupBy("session", "ts", "terminal").agg(F.count("*").alias("n"))
    group = F.pmod(F.xxhash64("session"), F.lit(groups)).alias("group")
    moments = moments.select(group, "session", "ts", F.unix_millis("ts").alias("ts_ms"), "terminal", "n")
    return moments.groupBy("group").transformWithStateInPandas(SessionEnds(silence_seconds * 1000), CLOSED, "Append", "EventTime")
