"""The detector chain over a table of texts.

``classify`` adds the array of firing detections, ``emit`` turns it into one row
per detection. Both are narrow: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.operators import detectors as D
from sparktrail.operators.detectors import Detector, Scan

# Severity descending, the order rows come out in.
REQUEST_CHAIN: tuple[Detector, ...] = (D.credentials(), D.injection(), D.email_send(), D.data_export(), D.pii())

# Results: findings sit on 'result', no tool name, no baseline row.
INBOUND_CHAIN: tuple[Detector, ...] = (
    D.credentials("result"),
    D.injection("result"),
    D.email_send("result"),
    D.data_export_inbound("result"),
    D.pii("result"),
)

# Hook results keep the broad export rule, at the lowest severity.
HOOK_INBOUND_CHAIN: tuple[Detector, ...] = (
    *INBOUND_CHAIN[:3],
    D.data_export("result", "'low'"),
    INBOUND_CHAIN[4],
)

# Hook rows of both sides in one pass: labels follow the row's ``type``. Results
# have no tool name, so their tool branch is silent by itself.
_SIDE = "if(type = 'mcp.request', 'params', 'result')"
HOOK_CHAIN: tuple[Detector, ...] = (
    D.credentials(sql=_SIDE),
    D.injection(sql=_SIDE),
    D.email_send(sql=_SIDE),
    D.data_export(severity="if(type = 'mcp.request', 'medium', 'low')", sql=_SIDE),
    D.pii(sql=_SIDE),
)

POLICIES: dict[str, tuple[tuple[Detector, ...], bool]] = {
    "request": (REQUEST_CHAIN, True),
    "inbound": (INBOUND_CHAIN, False),
    "hook_inbound": (HOOK_INBOUND_CHAIN, False),
}


def baseline() -> Column:
    return F.struct(
        F.lit(V.BASELINE_CATEGORY).alias("category"),
        F.lit("low").alias("severity"),
        F.array().cast(D.FINDINGS).alias("findings"),
    )


def classify(
    df: DataFrame,
    text: str,
    tool: str | None = None,
    chain: Sequence[Detector] = REQUEST_CHAIN,
    with_baseline: bool | Column = True,
    out: str = "detections",
    secrets: str | None = None,
) -> DataFrame:
    """Add ``out``: the detections of the firing detectors, in chain order.

    The steps are separate projections on purpose: each gate, regex and checksum
    is evaluated once, and Catalyst does not merge projections that would repeat
    them. ``secrets`` names an extra column with the credential values to mask,
    taken from the same scan. ``with_baseline`` may be a condition per row.
    """
    kept = list(df.columns)
    named = df.select("*", F.col(text).alias("_text"), *([F.col(tool).alias("_tool")] if tool else []))
    lowered = named.withColumn("_lower", F.lower("_text"))
    scan = Scan(F.col("_text"), F.col("_lower"), F.col("_tool") if tool else None)
    gates = {name: col for d in chain for name, col in d.gates(scan).items()}
    measures = {name: col for d in chain for name, col in d.measures(scan).items()}
    staged = lowered.withColumns(gates) if gates else lowered
    staged = staged.withColumns(measures) if measures else staged
    extra = [D.credential_secrets("_m_hits").alias(secrets)] if secrets else []
    built = staged.select(*kept, *extra, *[d.build(scan).cast(D.DETECTION).alias(f"_d{i}") for i, d in enumerate(chain)])
    fired = F.array_compact(F.array(*[F.col(f"_d{i}") for i in range(len(chain))]))
    if with_baseline is not False:
        wanted = F.lit(True) if with_baseline is True else with_baseline
        fired = F.when((F.size(fired) == 0) & wanted, F.array(baseline())).otherwise(fired)
    return built.select(*kept, *([secrets] if secrets else []), fired.alias(out))


def emit(classified: DataFrame, detections: str = "detections") -> DataFrame:
    """One row per detection; ``ordinal`` keeps the chain order within a text.

    The outer explode is deliberate. For a plain one the optimizer infers the
    filter ``size(array) > 0`` and pushes it to the scan, which evaluates the
    whole chain twice.
    """
    kept = [c for c in classified.columns if c != detections]
    rows = classified.select(*kept, F.posexplode_outer(detections).alias("ordinal", "_d"))
    return rows.where(F.col("ordinal").isNotNull()).select(*kept, "ordinal", "_d.category", "_d.severity", "_d.findings")


def detect(df: DataFrame, text: str, tool: str | None = None, policy: str = "request") -> DataFrame:
    """Classify and emit under a named policy."""
    chain, with_baseline = POLICIES[policy]
    tool = tool if policy == "request" else None
    return emit(classify(df, text, tool, chain, with_baseline))


def stamp_id(*parts: Column) -> Column:
    """A replayable event id: the same inputs give the same id on every run."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
