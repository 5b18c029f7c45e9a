"""The assembled trail as a stored table that increments maintain.

Below ``root``: ``silver`` (delivered rows by increment and day), ``sessions`` and ``uses``
(on which days a session, or a tool use, has rows) and ``gold`` (assembled rows by day,
sorted by time and id within each file). An increment reads the days of its sessions
only, reassembles the calls it touches and overwrites just the day partitions whose rows
changed. An increment that is run again under its name replaces what it did before.

The day is the date at the beginning of the time's text, so that days order as pages do;
a time bound reaches one day further on either side, for texts in other zones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.operators import assemble, pages
from sparktrail.operators.filters import DetectionFilter, bounds
from sparktrail.session import materialize

#: Rows whose time has no date; pages look at them always.
NO_DAY = "none"


def day_of(ts_raw: Column) -> Column:
    dated = ts_raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    return F.when(dated, F.left(ts_raw, F.lit(10))).otherwise(NO_DAY)


def _call(rows: DataFrame) -> Column:
    """A call's key as a number; calls that share one are reassembled together."""
    return F.xxhash64("session", F.col("session").isNull(), "rpc_key")


class StoredTrail:
    """``order`` names the columns by which the first copy of a row and the last of its kind are told.

    Rows that share an id are copies of one row of one call.
    """

    def __init__(self, spark: SparkSession, root: str, order: list[str]) -> None:
        self.spark, self.root, self.order = spark, root, order

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _exists(self, name: str) -> bool:
        store, path = self._folder(name)
        return store.exists(path)

    def _read(self, name: str) -> DataFrame:
        # Days are text also where every one of them looks like a date.
        fields = self.spark.read.parquet(f"{self.root}/{name}").schema
        typed = ", ".join(f"`{f.name}` {'string' if f.name in ('day', 'increment') else f.dataType.simpleString()}" for f in fields)
        return self.spark.read.schema(typed).parquet(f"{self.root}/{name}")

    def _overwrite(self, rows: DataFrame, name: str, *parts: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.root}/{name}")

    def days(self) -> list[str]:
        """Days of the table, newest first, from the folder's listing."""
        if not self._exists("gold"):
            return []
        store, path = self._folder("gold")
        names = [s.getPath().getName() for s in store.listStatus(path) if s.isDirectory()]
        return sorted((n.removeprefix("day=") for n in names if n.startswith("day=")), reverse=True)

    def rows(self) -> DataFrame:
        return self._read("gold")

    def add(self, increment: DataFrame, name: str) -> list[str]:
        """Take an increment of trail rows in; returns the days whose partitions were overwritten."""
        spark = self.spark
        rows = assemble.rpc_key(increment).withColumn("day", day_of(F.coalesce("ts_raw", F.lit("")))).withColumn("increment", F.lit(name))
        if increment.isEmpty():
            return []
        # By day before they are written, or every task would sort all its rows by day.
        self._overwrite(rows.withColumn("call_key", _call(rows)).hint("rebalance", "day"), "silver", "increment", "day")
        own_rows = F.col("increment") == name
        rows = self._read("silver").where(own_rows)
        self._overwrite(rows.select("session", "day", "increment").distinct(), "sessions", "increment")
        # As many as the trail has days.
        near = self._read("sessions").join(rows.select(F.col("session").alias("_s")).distinct(), F.col("session").eqNullSafe(F.col("_s")), "left_semi")
        days = [r["day"] for r in near.select("day").distinct().collect()]
        # Lookups are written, so that their size is known when whole rows are joined to them.
        touched = materialize(spark, rows.select("call_key").distinct(), "touched")
        others = self._read("silver").where(~own_rows & F.col("day").isin(days)).join(touched, "call_key", "left_semi")
        silver = rows.unionByName(others)
        fresh = assemble.assemble(silver.drop("increment", "rpc_key"), self.order, pair=False)
        fresh = materialize(spark, fresh.withColumn("paired_source", F.lit(None).cast("string")), "fresh")
        before = self.rows() if self._exists("gold") else fresh.limit(0)
        old = before.where(F.col("day").isin(days)).join(touched, "call_key", "left_semi")
        old = materialize(spark, old.select("day", "tool_use_id"), "old")
        uses = fresh.select("tool_use_id").union(old.select("tool_use_id")).where("tool_use_id IS NOT NULL").distinct()
        uses = materialize(spark, uses, "uses")
        self._overwrite(fresh.where("tool_use_id IS NOT NULL").select("tool_use_id", "day").distinct().withColumn("increment", F.lit(name)), "uses", "increment")
        shared = self._read("uses").join(uses, "tool_use_id", "left_semi").select("day") if self._exists("uses") else uses.selectExpr("'' AS day").limit(0)
        own = {r["day"] for r in fresh.select("day").union(old.select("day")).distinct().collect()}
        affected = own | {r["day"] for r in shared.distinct().collect()}
        kept = before.where(F.col("day").isin(list(affected))).join(touched, "call_key", "left_anti")
        paired = materialize(spark, self._paired(kept.unionByName(fresh), uses), "paired")
        moved = paired.where("_moved").select("day").distinct()
        rewritten = own | {r["day"] for r in moved.collect()}
        out = paired.where(F.col("day").isin(list(rewritten))).drop("_moved")
        self._overwrite(out.repartitionByRange("day", "ts_raw", "id").sortWithinPartitions("day", "ts_raw", "id"), "gold", "day")
        for day in rewritten - {r["day"] for r in out.select("day").distinct().collect()}:
            store, path = self._folder(f"gold/day={day}")
            store.delete(path, True)  # all rows of that day were taken up by others
        return sorted(rewritten)

    def _paired(self, rows: DataFrame, uses: DataFrame) -> DataFrame:
        """``rows`` paired anew where their tool use is among ``uses``; ``_moved`` tells what changed."""
        seen = assemble.both_sides(rows.join(uses, "tool_use_id", "left_semi"))
        marks = materialize(self.spark, uses.join(seen, "tool_use_id", "left").withColumn("_anew", F.lit(True)), "marks")
        marked = rows.join(marks, "tool_use_id", "left").withColumn("_before", F.col("paired_source"))
        paired = F.when(F.col("_anew"), F.when(F.col("_both"), assemble.other_side())).otherwise(F.col("_before"))
        anew = marked.withColumn("paired_source", paired)
        anew = anew.withColumn("_moved", ~F.col("paired_source").eqNullSafe(F.col("_before")))
        return anew.select(*rows.columns, "_moved")

    # --- reading -------------------------------------------------------------

    def within(self, f: DetectionFilter, now) -> DataFrame:
        """The day partitions that a filter's time can reach."""
        rows = self.rows()
        for bound, days in zip(bounds(f, now), (-1, 1), strict=True):
            if bound is not None:
                edge = F.date_format(F.date_add(F.date_from_unix_date(F.floor(F.unix_seconds(bound) / 86400).cast("int")), days), "yyyy-MM-dd")
                inside = F.col("day") >= edge if days < 0 else F.col("day") <= edge
                rows = rows.where(inside | (F.col("day") == NO_DAY))
        return rows

    def page(self, f: DetectionFilter, now, limit: int, cursor: tuple[str, str] | None = None, first: int = 8) -> DataFrame:
        """A page from the newest days that fill it: at first ``first`` days, then twice as many and so on."""
        rows = self.within(f, now)
        days = [d for d in self.days() if d != NO_DAY and (cursor is None or d <= cursor[0][:10])]
        while True:
            found = pages.page(rows.where(F.col("day").isin([*days[:first], NO_DAY])), f, now, limit, cursor)
            if first >= len(days) or found.count() >= limit:
                return found
            first *= 2

    def details(self, ids: DataFrame) -> DataFrame:
        """Full rows of at most a page of ids; files whose ids lie elsewhere are skipped by their statistics."""
        wanted = [r["id"] for r in ids.select("id").collect()]
        return pages.detail(self.rows().where(F.col("id").isin(wanted)))
