"""Queries over texts: the detector chain, its parts, masking, self-check."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.functions.masking import mask_text
from sparktrail.operators import chain, findings
from sparktrail.operators import detectors as D
from sparktrail.plans import fixtures as X
from sparktrail.plans import oracle_text as O
from sparktrail.sources.tables import spread, table


def detect_chain(spark, sf):
    docs = spread(table(spark, sf, "documents").select("text"))
    return chain.detect(docs, "text").groupBy("category", "severity").agg(F.count("*").alias("n"))


def _firing(spark, sf, detector, tool=None):
    df = chain.classify(X.planted(spark, sf), "scan_text", tool, (detector,), False)
    return chain.emit(df).select("unit_id", "severity", F.size("findings").cast("bigint").alias("n"))


def _policy(policy):
    def run(spark, sf):
        rows = chain.detect(X.planted(spark, sf), "scan_text", "tool", policy)
        return rows.select(
            "unit_id",
            F.col("ordinal").cast("bigint").alias("ordinal"),
            "category",
            "severity",
            F.size("findings").cast("bigint").alias("n"),
        )

    return run


def _pii_one(kind):
    def run(spark, sf):
        counts = D.pii_counts(X.planted(spark, sf), "scan_text", ["unit_id"], (kind,))
        return counts.where(F.col(kind) > 0).select("unit_id", F.col(kind).cast("bigint").alias("n"))

    return run


def _pii_long(spark, sf):
    """(unit, family, matches) for every family that fired."""
    counts = D.pii_counts(X.planted(spark, sf), "scan_text", ["unit_id"])
    long = counts.unpivot("unit_id", list(D.PII_TYPES), "type", "n")
    return long.where("n > 0").select("unit_id", "type", F.col("n").cast("bigint").alias("n"))


def pii_multilabel(spark, sf):
    """Texts whose identifiers pass the checks of more than one family."""
    counts = D.pii_counts(X.planted(spark, sf), "scan_text", ["unit_id"])
    fired = sum((F.when(F.col(k) > 0, 1).otherwise(0) for k in D.PII_TYPES), F.lit(0))
    total = sum((F.col(k) for k in D.PII_TYPES), F.lit(0))
    return counts.select(
        "unit_id", fired.cast("bigint").alias("n_types"), total.cast("bigint").alias("n_findings")
    ).where("n_types > 1")


def finding_groups(spark, sf):
    return findings.finding_groups(chain.detect(X.planted(spark, sf), "scan_text", "tool"), "unit_id")


def _masked(spark, sf):
    found = findings.with_secrets(X.planted(spark, sf), "scan_text")
    return found.select(
        "unit_id", "source", "secrets", mask_text(F.col("scan_text"), F.col("secrets"), X.HMAC_KEY).alias("masked")
    )


def mask_secrets(spark, sf):
    return _masked(spark, sf).select(
        "unit_id",
        F.size(F.array_distinct("secrets")).cast("bigint").alias("n_secrets"),
        F.length("masked").cast("bigint").alias("masked_chars"),
        F.md5("masked").alias("masked_md5"),
    )


def fingerprint_reuse(spark, sf):
    return findings.fingerprint_reuse(_masked(spark, sf), "masked", "unit_id", "source")


def selftest_report(spark, sf):
    golden = X.golden(spark, sf)
    rows = chain.detect(golden.select("unit_id", "scan_text"), "scan_text")
    first = findings.first_detection(rows, ["unit_id"], "ordinal")
    entries = findings.selftest_entries(golden.drop("scan_text"), first, "unit_id")
    return findings.selftest_report(entries, "run")


QUERIES = {
    "detect_chain": detect_chain,
    "detect_credentials": lambda s, sf: _firing(s, sf, D.credentials()),
    "detect_injection": lambda s, sf: _firing(s, sf, D.injection()),
    "detect_email_send": lambda s, sf: _firing(s, sf, D.email_send(), "tool"),
    "detect_export": lambda s, sf: _firing(s, sf, D.data_export()),
    "detect_export_inbound": lambda s, sf: _firing(s, sf, D.data_export_inbound()),
    "detect_request": _policy("request"),
    "detect_inbound": _policy("inbound"),
    "detect_inbound_hook": _policy("hook_inbound"),
    "pii_all": _pii_long,
    "pii_email": _pii_one("email"),
    "pii_iban": _pii_one("iban"),
    "pii_credit_card": _pii_one("credit_card"),
    "pii_us_ssn": _pii_one("us_ssn"),
    "pii_uk_nino": _pii_one("uk_nino"),
    "pii_uk_nhs": _pii_one("uk_nhs"),
    "pii_es_dni": _pii_one("es_dni"),
    "pii_es_nie": _pii_one("es_nie"),
    "pii_mrz_td3": _pii_one("mrz_td3"),
    "pii_fr_nir": _pii_one("fr_nir"),
    "pii_it_cf": _pii_one("it_codice_fiscale"),
    "pii_nl_bsn": _pii_one("nl_bsn"),
    "pii_de_steuer": _pii_one("de_steuer_id"),
    "pii_pt_nif": _pii_one("pt_nif"),
    "pii_phone": _pii_one("phone_e164"),
    "pii_multilabel": pii_multilabel,
    "finding_groups": finding_groups,
    "mask_secrets": mask_secrets,
    "fingerprint_reuse": fingerprint_reuse,
    "selftest_report": selftest_report,
}

ORACLES = O.build(V, D.PII_TYPES)
