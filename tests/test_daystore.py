"""Day folders: repeated compaction, ended jobs, days that go and days that stay."""

from pyspark.sql import functions as F

from sparktrail.operators.daystore import LINES, DayStore
from sparktrail.session import scratch_path

SCHEMA = f"{LINES}, day_file string"


def _line(session, n, id_, day):
    return (session, f"ulid-{session}", n, id_, f"{session} {n}", day, f"day-{day}")


def _shown(days):
    return sorted((r.day_file, r.session, r.line_no) for r in days.lines().collect())


def test_compact_purge_clear(spark):
    days = DayStore(spark, scratch_path(spark, "daystore"))
    assert days.version() == 0 and days.lines().count() == 0 and days.purge(days.listing()) == [] and days.clear() == 0
    one = [_line("a", 1, "x1", 1), _line("a", 2, None, 1), _line("a", 3, None, 1), _line("b", 1, "x2", 1), _line("c", 1, "x3", 2)]
    frame = spark.createDataFrame(one, SCHEMA)
    first = days.compact(frame).first()
    assert (first.files_compacted, first.lines_appended, first.lines_skipped_duplicate, first.days_touched) == (3, 5, 0, 2)
    again = days.compact(frame).first()
    assert (again.lines_appended, again.lines_skipped_duplicate, days.version()) == (0, 5, 1)
    want = sorted((r[6], r[0], r[2]) for r in one)
    assert _shown(days) == want
    # A new day, and a copy of a line by its id.
    more = [_line("d", 1, "x9", 3), _line("e", 7, "x3", 2)]
    assert days.compact(spark.createDataFrame(more, SCHEMA)).first().lines_appended == 1
    before = set(days.lines().inputFiles())
    # A job that ends before its listing leaves folders that do not count.
    spark.createDataFrame([_line("z", 1, "z", 1)], SCHEMA).write.partitionBy("day_file").parquet(f"{days.root}/data/version=3")
    assert _shown(days) == sorted([*want, ("day-3", "d", 1)])
    # Day 2 goes as a whole, day 1 in part, day 3 is not touched.
    assert days.purge(spark.createDataFrame([("a",), ("c",), ("nobody",)], "session string")) == ["day-1", "day-2"]
    assert _shown(days) == [("day-1", "b", 1), ("day-3", "d", 1)]
    after = set(days.lines().inputFiles())
    assert {f for f in before if "day-3" in f} == {f for f in after if "day-3" in f}
    assert days.clear() > 0 and days.clear() == 0
    assert _shown(days) == [("day-1", "b", 1), ("day-3", "d", 1)]
    assert sorted(r.day_file for r in days.listing().select("day_file").distinct().collect()) == ["day-1", "day-3"]
    assert days.purge(days.listing().select("session")) == ["day-1", "day-3"] and days.lines().count() == 0
    assert days.lines().where(F.col("day_file") == "day-1").count() == 0
