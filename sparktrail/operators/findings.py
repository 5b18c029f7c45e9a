"""Views over detections: display groups, masking, shared secrets, self-check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrail.functions.masking import fingerprints_in, mask_text
from sparktrail.operators import detectors as D
from sparktrail.operators.chain import classify


def finding_groups(detections: DataFrame, key: str) -> DataFrame:
    """Findings of one event grouped by (type, location) with their multiplicity."""
    each = detections.select(key, F.explode_outer("findings").alias("f")).where(F.col("f").isNotNull())
    return each.groupBy(key, F.col("f.type").alias("type"), F.col("f.location").alias("location")).agg(
        F.count("*").alias("n")
    )


def with_secrets(df: DataFrame, text: str, out: str = "secrets") -> DataFrame:
    """The credential values of each text, found in one gated pass."""
    found = classify(df, text, chain=(D.credentials(),), with_baseline=False, out="_found", secrets=out)
    return found.drop("_found")


def mask_columns(df: DataFrame, secrets: str, key: bytes, *columns: str) -> DataFrame:
    """Mask the same secrets in every persisted column of the row.

    Secrets are computed once per source row, before it fans out into one row
    per detection, so every row derived from the event is masked alike.
    """
    return df.withColumns({c: mask_text(F.col(c), F.col(secrets), key) for c in columns})


def mask_persisted(rows: DataFrame, key: bytes, *columns: str) -> DataFrame:
    """Find the secrets in all of ``columns`` of a row and mask them in each of them."""
    whole = rows.withColumn("_whole", F.concat_ws("\n", *columns))
    return mask_columns(with_secrets(whole, "_whole", "_secrets"), "_secrets", key, *columns).select(*rows.columns)


def fingerprint_reuse(rows: DataFrame, text: str, unit: str, source: str) -> DataFrame:
    """Masked secrets and where they recur.

    Counted per (fingerprint, source) first, so neither a secret that is
    everywhere nor a long list of sources meets in one task.
    """
    each = rows.select(unit, source, F.explode(F.array_distinct(fingerprints_in(F.col(text)))).alias("fp"))
    by_source = each.groupBy("fp", source).agg(
        F.count("*").alias("n"), F.min(unit).alias("first_unit"), F.max(unit).alias("last_unit")
    )
    return by_source.groupBy("fp").agg(
        F.sum("n").alias("n_units"),
        F.count("*").alias("n_sources"),
        F.min("first_unit").alias("first_unit"),
        F.max("last_unit").alias("last_unit"),
    )


def first_detection(detections: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first detection seen per key."""
    block = F.struct("category", "severity")
    return detections.groupBy(*keys).agg(F.min_by(block, F.col(order)).alias("actual"))


def selftest_entries(golden: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """Expected label next to what was seen; ``passed`` needs both parts equal."""
    joined = golden.join(first, key, "left")
    passed = (F.col("actual.category") == F.col("expected_category")) & (
        F.col("actual.severity") == F.col("expected_severity")
    )
    return joined.withColumn("observed", F.col("actual").isNotNull()).withColumn(
        "passed", F.coalesce(passed, F.lit(False))
    )


def selftest_report(entries: DataFrame, run: str) -> DataFrame:
    """One outcome per run: mismatch, else complete, else nothing seen, else partial."""
    counted = entries.groupBy(run).agg(
        F.count("*").alias("n"),
        F.count_if("observed").alias("n_observed"),
        F.count_if(F.col("observed") & ~F.col("passed")).alias("n_mismatched"),
    )
    outcome = (
        F.when(F.col("n_mismatched") > 0, "detection_mismatch")
        .when(F.col("n_observed") == F.col("n"), "complete_pass")
        .when(F.col("n_observed") == 0, "timeout_no_data")
        .otherwise("timeout_partial")
    )
    return counted.withColumn("outcome", outcome)
