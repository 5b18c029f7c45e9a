"""Draining streams and reading what they left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

def drain(query) -> None:
    query.awaitTermination()


def versioned(root: str):
    """A ``foreachBatch`` function that keeps the updates of each batch as a table.

    For streaming aggregates in update mode: the newest update per key wins.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    return run


def outputs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/out")


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse versioned updates to the newest row per key."""
    from pyspark.sql import functions as F

    values = [c for c in updates.columns if c not in (*keys, "batch")]
    packed = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return packed.select(*keys, "_v.*")
