"""Entity detection with a pluggable model, off the classification path."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.operators import detectors as D

GROUPS = "array<struct<entity_group:string,score:double,word:string>>"
Scorer = Callable[[list[str]], list[list[dict]]]


def scorer_udf(load: Callable[[], Scorer]):
    """A Pandas UDF text -> entity groups; ``load`` runs once per Python worker task."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load()
        for texts in batches:
            yield pd.Series(scorer([t or "" for t in texts]))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, GROUPS)


def entity_findings(groups: Column, threshold: float = V.ENTITY_THRESHOLD) -> Column:
    """Groups strictly above the threshold, by type; there is no location."""
    return F.transform(
        F.filter(groups, lambda g: g["score"] > threshold),
        lambda g: F.struct(g["entity_group"].alias("type"), F.lit(None).cast("string").alias("location")),
    )


def entity_enrichments(requests: DataFrame, groups: str, threshold: float = V.ENTITY_THRESHOLD) -> DataFrame:
    """Enrichment rows of requests with at least one entity; the rest give no row."""
    found = requests.withColumn("findings", entity_findings(F.col(groups), threshold).cast(D.FINDINGS)).drop(groups)
    return (
        found.where(F.size("findings") > 0)
        .withColumn("category", F.lit("pii_detected"))
        .withColumn("severity", F.lit("low"))
        .withColumn("type", F.lit("mcp.detection_enrichment"))
    )


def enrich_requests(requests: DataFrame, text: str, load: Callable[[], Scorer]) -> DataFrame:
    """Score the texts in Arrow batches, then map and filter natively."""
    return entity_enrichments(requests.withColumn("_groups", scorer_udf(load)(F.col(text))), "_groups")
