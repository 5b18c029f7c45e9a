"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


_LOCAL_ROOTS: dict[str, str] = {}

#: Whether the engine removes a statement's shuffle files when the statement has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, name: str = "sparktrail", memory: str = "12g") -> SparkSession:
    """A session for tests and single-machine runs. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent, a local session uses one temporary folder per
    application; on a cluster that would be another disk for every executor, so
    there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="sparktrail-")
    return _LOCAL_ROOTS[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder; never reused between runs."""
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Statements started within run under these settings; afterwards the session has its own again."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialize(spark: SparkSession, df, label: str):
    """Write ``df`` once to the scratch folder and read it back.

    Cuts lineage with a reliable table, so a lost executor costs a re-read and
    not a recomputation of everything before it. What the write shuffled is removed when
    it has ended; else files stay until the driver's garbage collector finds them, and an
    operator of many statements holds most of what it ever shuffled.
    """
    path = scratch_path(spark, label)
    with settings(spark, {CLEANUP: "true"}):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
