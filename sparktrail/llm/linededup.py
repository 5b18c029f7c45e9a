"""Line dedup over range-partitioned hashes.

Long lines become narrow rows ``(hash, document, position)``. They are range
partitioned by hash and document block and sorted within partitions by hash,
document (largest first) and position. Streaming over that order gives the first
occurrence of every hash in every block, with the documents it stands for; those
few heads decide per hash. Text is never shuffled for the decision, and the answer
is one compressed keep bitmap per document: the kept lines as runs.

A hash held by a third of all rows spreads over ``blocks`` sort groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.llm.common import SPACES, ascii_lower, only, row_hash
from sparktrail.session import materialize

MIN_CHARS = 40
MIN_DOCUMENTS = 5
#: Sort groups that one hash can be spread over.
BLOCKS = 1024


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """ASCII blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.regexp_replace(line, rf"^{SPACES}+|{SPACES}+$", ""))


def line_rows(documents: DataFrame) -> DataFrame:
    """Long lines as ``h1, h2, doc_id, text_hash, pos``: two hashes, 128 bits together."""
    split = only(documents, "doc_id", "text").select(
        "doc_id", row_hash(F.col("text")).alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    )
    # Shorter lines cannot have a long key, which spares them the patterns.
    keyed = split.filter(F.length("line") >= MIN_CHARS).withColumn("key", line_key(F.col("line")))
    return keyed.filter(F.length("key") >= MIN_CHARS).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos"
    )


def _dropped(rows: DataFrame, min_documents: int) -> DataFrame:
    """The rows of ``line_rows`` to drop."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS)).cast("int"))
    ranged = rows.repartitionByRange("h1", "h2", "block").sortWithinPartitions(
        "h1", "h2", "block", F.desc("doc_id"), "pos"
    )
    group = Window.partitionBy("h1", "h2", "block").orderBy(F.desc("doc_id"), "pos")
    before = F.lag("doc_id").over(group)
    heads = (
        ranged.select("h1", "h2", "block", "doc_id", "pos")
        .withColumn("first", F.row_number().over(group) == 1)
        .withColumn("new", F.col("first") | ~before.eqNullSafe(F.col("doc_id")))
        .filter("new")
        .groupBy("h1", "h2", "block")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    )
    verdict = (
        heads.groupBy("h1", "h2")
        .agg(F.sum("n").alias("n_documents"), F.max("last").alias("last"))
        .filter(F.col("n_documents") >= min_documents)
        .select("h1", "h2", "last")
    )
    # Written, so that a hash with very many rows may be split in the join.
    verdict = materialize(rows.sparkSession, verdict, "verdicts")
    return rows.join(verdict, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))


def _keep_runs(dropped: Column, n_lines: Column) -> Column:
    """Kept lines as runs ``(start, length)``: the gaps between the dropped positions."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines.cast("int")))
    gaps = F.zip_with(
        F.slice(edges, F.lit(1), F.size(edges) - 1),
        F.slice(edges, F.lit(2), F.size(edges) - 1),
        lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")),
    )
    return F.filter(gaps, lambda run: run["length"] > 0)


def keep_bitmaps(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc_id, text_hash, dropped, n_dropped`` for the documents that lose lines.

    ``dropped`` holds the line numbers, ascending; ``apply_bitmaps`` turns them into
    runs. Rows with a null id count as one document that loses to every other.
    Rows repeated with one id count once. Null text is one empty line, and empty or
    blank lines are never dropped.
    """
    rows = materialize(documents.sparkSession, line_rows(documents), "lines")
    positions = F.array_sort(F.collect_set("pos")).alias("dropped")
    return (
        _dropped(rows, min_documents)
        .groupBy("doc_id", "text_hash")
        .agg(positions)
        .withColumn("n_dropped", F.size("dropped").cast("long"))
    )


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``documents`` (id and text) with ``keep_runs`` and the ``kept`` text.

    The only step that moves text, once, by document.
    """
    texts = only(documents, "doc_id", "text").withColumn("text_hash", row_hash(F.col("text")))
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "dropped", "n_dropped")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    joined = texts.join(marks.hint("shuffle_hash"), same, "left").drop("_id", "_hash")
    joined = joined.withColumn("lines", lines_of(F.col("text")))
    joined = joined.withColumn("n_lines", F.size("lines").cast("long"))
    none = F.array().cast("array<int>")
    joined = joined.withColumn("keep_runs", _keep_runs(F.coalesce("dropped", none), F.col("n_lines")))
    kept = F.flatten(F.transform("keep_runs", lambda r: F.slice("lines", r["start"] + 1, r["length"])))
    text = F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        "doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep_runs", text.alias("kept")
    )


def op3_line_dedup(spark, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    result = apply_bitmaps(documents, keep_bitmaps(documents))
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
