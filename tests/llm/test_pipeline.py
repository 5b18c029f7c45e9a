"""The pipeline's stages on the smallest tables, each against its own rule."""

import time

import corpus_pipeline
from pyspark.sql import functions as F

from sparktrail import session
from sparktrail.llm import mixing, sharding

from .test_operators import brute_components


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    (_, rules), (_, near), (_, clean), (_, mixed), (_, shard) = corpus_pipeline.STAGES
    good = rules(spark, docs, data).cache()
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert good.columns == docs.columns
    assert good.join(labels, "doc_id").filter("quality = 0").count() <= 2
    one = near(spark, good, data).cache()
    want = brute_components([(r.doc_id, r.text) for r in good.select("doc_id", "text").collect()])
    assert {r.doc_id for r in one.collect()} == {i for i, (_, label) in want.items() if label == i}
    left = clean(spark, one, data).cache()
    assert 0 < left.count() <= one.count() and left.columns == docs.columns
    taken = mixed(spark, left, data).cache()
    total = left.agg(F.sum(mixing.n_tokens(F.col("text")))).first()[0]
    used = taken.agg(F.sum(mixing.n_tokens(F.col("text")))).first()[0]
    assert 0.85 * total < used and taken.select("doc_id").distinct().count() == taken.count()
    table = sharding.lookup_table(sharding.shard_names(sharding.N_SHARDS))
    placed = shard(spark, taken, data).collect()
    assert len(placed) == taken.count() and all(table[r.slot] == r.shard for r in placed)


def test_run_gives_the_same_rows(spark, data):
    rows = corpus_pipeline.run(spark, data)
    assert rows.count() > 0 and set(rows.columns) == {"doc_id", "text", "lang", "source", "n_chars", "slot", "shard"}


def test_a_written_intermediate_leaves_no_shuffle_files(spark):
    def files():
        on_disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getPath() for f in (on_disk.apply(k) for k in range(on_disk.size())) if f.getName().startswith("shuffle_")}

    spark.range(10).write.format("noop").mode("overwrite").save()
    before = files()
    written = session.materialize(spark, spark.range(10_000).selectExpr("id % 7 AS k").repartition("k").groupBy("k").count(), "sums")
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:  # they are removed in the background
        time.sleep(0.1)
    assert not left
    assert {(r["k"], r["count"]) for r in written.collect()} == {(k, 10_000 // 7 + (k < 10_000 % 7)) for k in range(7)}
    assert spark.conf.get(session.CLEANUP, "false") == "false"
