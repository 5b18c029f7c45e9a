"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over a prime-sized table of slots, given by
two hashes of its name: ``(offset + k * skip) mod size``. The shards take turns; on a
turn a shard claims the next slot of its order that is still free, until the table is
full. Shares differ by one slot at most, and adding or removing a shard moves few
slots. A key's slot is a hash modulo the size, so placing a row is one lookup in the
broadcast table, whose size is the parameter ``size`` and does not grow with the data.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.llm.common import unused

#: Shards of the registered query, and slots. The table should have 100 slots a shard at least.
N_SHARDS = 64
TABLE_SIZE = 8191
#: A larger table is refused: it is broadcast.
MAX_TABLE_SIZE = 1 << 22


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _word(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Shard number of every slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and distinct")
    if not _prime(size) or not len(shards) <= size <= MAX_TABLE_SIZE:
        raise ValueError(f"the table size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    offset = [_word(f"offset/{name}") % size for name in shards]
    skip = [_word(f"skip/{name}") % (size - 1) + 1 for name in shards]
    upcoming = list(offset)
    table = [-1] * size
    for turn in range(size):
        shard = turn % len(shards)
        while table[upcoming[shard]] >= 0:
            upcoming[shard] = (upcoming[shard] + skip[shard]) % size
        table[upcoming[shard]] = shard
    return table


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key's text; null keys share the slot of the empty text."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: Column, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (existing columns of these names are replaced).

    No shuffle. Copies of a key go to one shard; every row is placed, also with a null
    key; an empty table stays empty.
    """
    spark = df.sparkSession
    rows = list(enumerate(lookup_table(shards, size)))
    number = unused(df, "_slot")
    table = spark.createDataFrame(rows, f"{number} int, shard int")
    base = df.drop("slot", "shard").withColumn("slot", slot_of(key, size))
    return base.join(F.broadcast(table), F.col("slot") == F.col(number)).drop(number)


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder per shard. A shard's rows are spread over ``files_per_shard`` tasks."""
    salt = F.pmod(F.xxhash64(*placed.columns), F.lit(files_per_shard))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Whole rows of ``documents`` with their slot and shard."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return place(documents, F.col("doc_id"), shard_names(N_SHARDS))


OP2_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i AS shard,
    ('0x' || substr(md5('offset/shard-' || lpad(CAST(i AS VARCHAR), 5, '0')), 1, 8))::BIGINT % {TABLE_SIZE} AS off,
    ('0x' || substr(md5('skip/shard-' || lpad(CAST(i AS VARCHAR), 5, '0')), 1, 8))::BIGINT % {TABLE_SIZE - 1} + 1 AS skip
  FROM range({N_SHARDS}) t(i)),
fill AS (
  SELECT CAST(0 AS BIGINT) AS turn, list_transform(range({TABLE_SIZE}), lambda x: CAST(-1 AS BIGINT)) AS taken,
         CAST(-1 AS BIGINT) AS won
  UNION ALL
  SELECT turn + 1, list_concat(list_slice(taken, 1, slot), [shard], list_slice(taken, slot + 2, {TABLE_SIZE})), slot
  FROM (SELECT turn, taken, shard,
          list_filter(list_transform(range({TABLE_SIZE}), lambda k: (off + k * skip) % {TABLE_SIZE}),
                      lambda s: taken[s + 1] = -1)[1] AS slot
        FROM fill JOIN shards ON shard = turn % {N_SHARDS} WHERE turn < {TABLE_SIZE})),
slots AS (SELECT won AS slot, (turn - 1) % {N_SHARDS} AS shard FROM fill WHERE turn > 0)
SELECT d.* EXCLUDE (slot), CAST(slot AS INTEGER) AS slot, CAST(shard AS INTEGER) AS shard
FROM (SELECT *,
        ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {TABLE_SIZE} AS slot FROM documents) d
JOIN slots USING (slot)
"""
