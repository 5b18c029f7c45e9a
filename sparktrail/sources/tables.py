"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that fits one scan partition.

    Such a table is one task however many cores wait. It is the only kind that is
    shuffled, so never more than ``spark.sql.files.maxPartitionBytes`` is moved; larger
    tables are split by their scan and left alone. Rows are the same either way.
    """
    session = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    one_task = session._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(session.sparkContext.defaultParallelism) if size <= one_task else df
