"""Text helpers: regex rendering, JSON quoting, labels. All are Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the capture side understands it: ASCII plus the Unicode spaces.
_SPACES = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"
_NOT_BEFORE_WORD = r"(?![A-Za-z0-9_])"
_BEFORE_WORD = r"(?=[A-Za-z0-9_])"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """Render a neutral pattern for Spark.

    ``\\b`` is the ASCII word edge: Java's own also counts accented letters, so
    it is spelled out as a look-behind before a word character and a look-ahead
    after one. ``\\s`` and ``\\S`` cover the Unicode spaces.
    """
    out, i = [], 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b":
            opening = i + 2 < len(pattern) and pattern[i + 2] not in ")|"
            out.append(_NOT_AFTER_WORD if opening else _NOT_BEFORE_WORD)
            if opening and pattern[i + 2] == "[":
                out.append(_BEFORE_WORD)  # a class may also hold punctuation
            i += 2
        elif two == r"\s":
            out.append(f"[{_SPACES}]")
            i += 2
        elif two == r"\S":
            out.append(f"[^{_SPACES}]")
            i += 2
        elif two.startswith("\\"):
            out.append(two)
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def contains_any(text: Column, words) -> Column:
    """Literal containment of at least one word; a cheap gate before a regex."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def dedupe_join(parts: Column) -> Column:
    """Join non-empty distinct parts, first occurrence order, one per line."""
    kept = F.filter(parts, lambda p: p.isNotNull() & (F.length(p) > 0))
    return F.array_join(F.array_distinct(kept), "\n")


def json_quote(text: Column) -> Column:
    """``text`` as a JSON string literal."""
    boxed = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substr(boxed, F.lit(6), F.length(boxed) - 6))


def basename(path: Column) -> Column:
    trimmed = F.regexp_replace(path, "/+$", "")
    return F.element_at(F.split(trimmed, "/"), -1)


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def list_stamp(ts: Column) -> Column:
    """``31 Jan, 10:20:30``."""
    return F.date_format(ts, "dd MMM, HH:mm:ss")


def relative_time(ts: Column, now: Column) -> Column:
    ms = F.unix_millis(now) - F.unix_millis(ts)
    minutes = F.floor(ms / 60000)
    hours = F.floor(minutes / 60)
    return (
        F.when(ts.isNull(), F.lit("—"))
        .when(ms < 60000, F.lit("just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )


def byte_size(n: Column) -> Column:
    """1024-based size: one decimal below ten, none from ten on."""

    def scaled(power: int, unit: str) -> Column:
        value = n / float(1024**power)
        whole = F.floor(value + 0.5).cast("string")
        return F.concat(F.when(value >= 10, whole).otherwise(F.format_string("%.1f", value)), F.lit(f" {unit}"))

    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, scaled(1, "KB"))
        .when(n < 1024**3, scaled(2, "MB"))
        .when(n < 1024**4, scaled(3, "GB"))
        .otherwise(scaled(4, "TB"))
    )


def label_of(key: Column, table: dict[str, str]) -> Column:
    expr = F.lit(None).cast("string")
    for name, label in reversed(table.items()):
        expr = F.when(key == name, F.lit(label)).otherwise(expr)
    return expr


def split_tool_name(name: Column, native: str) -> tuple[Column, Column]:
    """``mcp__<server>__<tool>`` into (server, tool); anything else is native."""
    shape = r"(?s)^mcp__(.+?)__(.+)$"
    is_remote = name.rlike(shape)
    server = F.when(is_remote, F.regexp_extract(name, shape, 1)).otherwise(F.lit(native))
    tool = F.when(is_remote, F.regexp_extract(name, shape, 2)).otherwise(name)
    return server, tool


def tool_tokens(name: Column) -> Column:
    """Lower-case tokens of a snake, kebab or camel case tool name."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.transform(F.split(spaced, java_regex(r"(?:[_-]|\s)+")), F.lower), lambda t: F.length(t) > 0)
