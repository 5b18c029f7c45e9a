"""File sources and sinks of the trail: JSON lines, spool documents, exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.functions.ulid import decode_millis
from sparktrail.values import CSV_COLUMNS

_TOLERANT = {"ignoreMissingFiles": "true", "ignoreCorruptFiles": "true", "recursiveFileLookup": "true"}
_POSITION = "file STRING, block BIGINT, line_no BIGINT"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_trail_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Lines of all trail files with their place; a missing folder is an empty trail.

    ``(file, block, line_no)`` orders lines within a file: blocks are the byte
    offsets of splits and ``line_no`` grows within one.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], f"raw STRING, {_POSITION}")
    lines = spark.read.options(**_TOLERANT, pathGlobFilter=pattern).text(path)
    return lines.select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
    )


def read_frame_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Frame lines as captured; empty lines are dropped."""
    return read_trail_lines(spark, path, pattern).withColumnRenamed("raw", "line").where(F.length("line") > 0)


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    """One hook payload per ``<ULID>.json``; other names are ignored."""
    docs = spark.read.options(**_TOLERANT, pathGlobFilter="*.json").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9A-HJKMNP-TV-Z]{26})\.json$", 1)
    named = docs.select(F.col("value").alias("raw"), name.alias("spool_no")).where("spool_no <> ''")
    return named.withColumn("capture_ts", F.timestamp_millis(decode_millis(F.col("spool_no"))))


def write_trail(rows: DataFrame, path: str, day: Column, mode: str = "append") -> None:
    """Append one JSON object per row, NULL members left out, in day folders."""
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), F.date_format(day, "yyyy-MM-dd").alias("day"))
    lines.write.mode(mode).partitionBy("day").text(path)


def write_jsonl_export(matched: DataFrame, path: str) -> None:
    """Matching source lines verbatim, oldest first: a range-partitioned sort."""
    matched.orderBy("ts_raw", "id").select("raw").write.mode("errorifexists").text(path)


def write_csv_export(rows: DataFrame, path: str) -> None:
    """The fixed columns with a header, quoted only where a field needs it."""
    ordered = rows.orderBy("ts", "id").select(*CSV_COLUMNS)
    ordered.write.mode("errorifexists").options(header="true", quote='"', escape='"', emptyValue="", nullValue="").csv(path)


def folder_size(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Bytes and files from file listings; contents are not read."""
    try:
        files = spark.read.format("binaryFile").options(**_TOLERANT, pathGlobFilter=pattern).load(path)
    except AnalysisException:
        files = spark.createDataFrame([], "length BIGINT")
    return files.select("length").agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"), F.count("*").alias("file_count")
    )
