"""The detection filter as a Column predicate."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.functions.text import basename

WINDOWS = {"1h": 3600, "24h": 86400, "7d": 7 * 86400}


@dataclass(frozen=True)
class DetectionFilter:
    """Empty selections do not restrict, except the three mandatory lists."""

    categories: tuple[str, ...] = V.CATEGORIES
    severities: tuple[str, ...] = V.SEVERITIES
    sources: tuple[str, ...] = (V.WIRE_SOURCE, V.HOOK_SOURCE)
    time_range: str = "all"  # all, 1h, 24h, 7d, custom
    custom_range: tuple[str, str] | None = None
    timezone: str = "UTC"
    mcp: str | None = None
    tools: tuple[str, ...] = ()
    sessions: tuple[str, ...] = ()
    projects: tuple[str, ...] = ()
    text: str | None = None
    status: tuple[str, ...] = ()


def source_kind() -> Column:
    """Exactly one literal is the hook; anything else, missing included, is the wire."""
    hook = F.coalesce(F.col("source") == V.HOOK_SOURCE, F.lit(False))
    return F.when(hook, V.HOOK_SOURCE).otherwise(V.WIRE_SOURCE)


def project() -> Column:
    return basename(F.col("cwd"))


def flagged() -> Column:
    return F.col("category") != V.BASELINE_CATEGORY


def local_midnight(day: str, timezone: str, days_later: int = 0) -> Column | None:
    """Midnight of a calendar day in ``timezone``; None when the text is no date.

    Out-of-range months and days roll over, as calendars do.
    """
    parts = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", day or "")
    if parts is None:
        return None
    year, month, dom = (int(p) for p in parts.groups())
    first = dt.date(year + (month - 1) // 12, (month - 1) % 12 + 1, 1)
    date = first + dt.timedelta(days=dom - 1 + days_later)
    return F.lit(f"{date.isoformat()} 00:00:00 {timezone}").cast("timestamp")


def instant(text: str) -> Column:
    """A literal point in time. Text without a zone is UTC, whatever the session's zone is."""
    zoned = re.search(r"(?:Z|[+-]\d{2}:?\d{2}|[A-Za-z]+)$", text.strip())
    return F.lit(text if zoned else f"{text} UTC").cast("timestamp")


def within_time(f: DetectionFilter, now: str | Column) -> Column:
    ts = F.col("ts")
    if f.time_range == "all":
        return F.lit(True)
    if f.time_range == "custom":
        if f.custom_range is None:
            return ts.isNotNull()
        start = local_midnight(f.custom_range[0], f.timezone)
        end = local_midnight(f.custom_range[1], f.timezone, 1)
        inside = ts.isNotNull()
        if start is not None:
            inside = inside & (ts >= start)
        return inside & (ts < end) if end is not None else inside
    now = instant(now) if isinstance(now, str) else now
    return ts >= now - F.make_dt_interval(secs=F.lit(WINDOWS[f.time_range]))


def bounds(f: DetectionFilter, now: str | Column) -> tuple[Column | None, Column | None]:
    """The earliest and the latest point in time that ``within_time`` lets through; None is open."""
    if f.time_range == "all" or (f.time_range == "custom" and f.custom_range is None):
        return None, None
    if f.time_range == "custom":
        return local_midnight(f.custom_range[0], f.timezone), local_midnight(f.custom_range[1], f.timezone, 1)
    now = instant(now) if isinstance(now, str) else now
    return now - F.make_dt_interval(secs=F.lit(WINDOWS[f.time_range])), None


def base_filter(f: DetectionFilter, now) -> Column:
    """Source and time only: what facet menus are drawn from."""
    return within_time(f, now) & source_kind().isin(*f.sources)


def pre_severity(f: DetectionFilter, now) -> Column:
    """All but severity. A missing field never matches an active selection."""
    is_request = F.col("type") == "mcp.request"
    keep = base_filter(f, now) & F.col("category").isin(*f.categories)
    if f.mcp is not None:
        keep = keep & (F.col("mcp") == f.mcp)
    if f.tools:
        keep = keep & F.col("tool_name").isin(*f.tools)
    if f.sessions:
        keep = keep & F.col("cc_session").isin(*f.sessions)
    if f.projects:
        keep = keep & project().isin(*f.projects)
    if f.text:
        needle = F.lit(f.text.lower())
        in_tool = F.contains(F.lower("tool_name"), needle)
        in_args = is_request & F.contains(F.lower("args_summary"), needle)
        keep = keep & (F.coalesce(in_tool, F.lit(False)) | F.coalesce(in_args, F.lit(False)))
    if f.status:
        keep = keep & is_request & F.col("outcome").isin(*f.status)
    return F.coalesce(keep, F.lit(False))


def matches(f: DetectionFilter, now) -> Column:
    return pre_severity(f, now) & F.col("severity").isin(*f.severities)
