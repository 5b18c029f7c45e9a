"""Lines of ended sessions in day folders, with a written list of the folders that count.

Below ``root``: ``data/version=n/day_file=...`` holds lines, ``listing/version=n`` one row
per day and session with the version of that day's folder. A change writes the folders of
its days under the next version and then the next listing; readers go by the newest
complete listing. Whatever ends a job in between leaves the state before it whole, and a
day that is not changed keeps its folder. ``clear`` removes folders that no longer count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.operators import lifecycle
from sparktrail.session import materialize

LINES = "session string, ulid string, line_no bigint, id string, raw string, day_ms bigint"
LISTING = "day_file string, session string, n_lines bigint, data_version int"


class DayStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _children(self, name: str) -> list[str]:
        store, path = self._folder(name)
        return [s.getPath().getName() for s in store.listStatus(path) if s.isDirectory()] if store.exists(path) else []

    def version(self) -> int:
        """The newest version with a complete listing; 0 before the first."""
        done = [0]
        for child in self._children("listing"):
            store, path = self._folder(f"listing/{child}/_SUCCESS")
            if store.exists(path):
                done.append(int(child.removeprefix("version=")))
        return max(done)

    def listing(self) -> DataFrame:
        version = self.version()
        if not version:
            return self.spark.createDataFrame([], LISTING)
        return self.spark.read.schema(LISTING).parquet(f"{self.root}/listing/version={version}")

    def _folders(self) -> dict[str, int]:
        """The version of each day's folder: as many entries as there are days."""
        return {r["day_file"]: r["data_version"] for r in self.listing().select("day_file", "data_version").distinct().collect()}

    def lines(self, days: list[str] | None = None) -> DataFrame:
        folders = self._folders()
        chosen = [d for d in (folders if days is None else days) if d in folders]
        if not chosen:
            return self.spark.createDataFrame([], f"{LINES}, day_file string")
        paths = [f"{self.root}/data/version={folders[d]}/day_file={d}" for d in sorted(chosen)]
        read = self.spark.read.schema(f"{LINES}, day_file string").option("basePath", f"{self.root}/data")
        return read.parquet(*paths).drop("version")

    def _put(self, lines: DataFrame, changed: list[str]) -> None:
        """Days ``changed`` hold ``lines`` from now on, and nothing if there are none."""
        # Folders of a job that was ended before its listing are overwritten.
        version = max([self.version(), *(int(c.removeprefix("version=")) for c in self._children("listing"))]) + 1
        place = ["day_file", "ulid", "line_no"]
        path = f"{self.root}/data/version={version}"
        lines.repartitionByRange(*place).sortWithinPartitions(*place).write.mode("overwrite").partitionBy("day_file").parquet(path)
        own = lines.groupBy("day_file", "session").agg(F.count("*").alias("n_lines")).withColumn("data_version", F.lit(version))
        others = self.listing().where(~F.col("day_file").isin(changed))
        others.unionByName(own).write.mode("overwrite").parquet(f"{self.root}/listing/version={version}")

    def compact(self, incoming: DataFrame) -> DataFrame:
        """Take lines of ended sessions in (``LINES`` and day_file); returns the counters.

        A line that is there already, by its place or by its id, is skipped, so a repeated run
        changes nothing. Lines without an id are told by their place.
        """
        incoming = materialize(self.spark, incoming, "incoming")
        days = [r["day_file"] for r in incoming.select("day_file").distinct().collect()]
        there = self.lines(days)
        unseen = incoming.join(there.select("session", "line_no"), ["session", "line_no"], "left_anti").select(*incoming.columns)
        appended = lifecycle.new_lines(unseen, there.where("id IS NOT NULL"), ["session", "line_no"])
        appended = materialize(self.spark, appended.select(*incoming.columns), "appended")
        changed = [r["day_file"] for r in appended.select("day_file").distinct().collect()]
        if changed:
            kept = self.lines(changed).select(*incoming.columns)
            self._put(materialize(self.spark, kept.unionByName(appended), "merged"), changed)
        return lifecycle.compaction_counters(incoming, appended)

    def purge(self, sessions: DataFrame) -> list[str]:
        """Remove all lines of ``sessions``; returns the days that changed.

        A day of which every session goes is left out of the listing without being read.
        """
        gone = sessions.select("session").distinct().withColumn("_gone", F.lit(True))
        marked = self.listing().join(gone, "session", "left")
        by_day = marked.groupBy("day_file").agg(F.count("_gone").alias("hit"), F.count("*").alias("n")).where("hit > 0").collect()
        partly = [r["day_file"] for r in by_day if r["hit"] < r["n"]]
        if by_day:
            left = self.lines(partly).join(gone, "session", "left_anti")
            self._put(materialize(self.spark, left, "left"), [r["day_file"] for r in by_day])
        return sorted(r["day_file"] for r in by_day)

    def clear(self) -> int:
        """Delete folders and listings that no longer count; returns how many. No job may be running."""
        current, folders, n = self.version(), self._folders(), 0
        old = [f"listing/{c}" for c in self._children("listing") if c != f"version={current}"]
        for child in self._children("data"):
            version = int(child.removeprefix("version="))
            inside = self._children(f"data/{child}")
            unused = [d for d in inside if folders.get(d.removeprefix("day_file=")) != version]
            old += [f"data/{child}"] if len(unused) == len(inside) else [f"data/{child}/{d}" for d in unused]
        for name in old:
            store, path = self._folder(name)
            n += store.delete(path, True)
        return n
