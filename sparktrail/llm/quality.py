"""Quality classifier: a document's quality from the marginals of its lines.

A linear-chain conditional random field labels every line good or bad;
forward-backward gives each line's probability of being good, and a document's score
is their mean weighted by the lines' lengths in words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail.llm import linecrf, textnum
from sparktrail.llm.common import only


def fold(doc_id: Column) -> Column:
    """0, 1 or 2 from the id's text; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0).cast("long"))


def _scores(model: linecrf.Model):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, end, data, offsets in textnum.chunks(batch.column("text")):
                told = linecrf.lines(data, offsets)
                p, *_ = linecrf.marginals(model.scores(told.features), told.first, model.moves)
                weight = np.maximum(told.words, 1e-9)
                begin = told.first[:-1]
                score = np.add.reduceat(p * weight, begin) / np.add.reduceat(weight, begin)
                score = np.clip(score, 0.0, 1.0)
                ids = batch.column("doc_id").slice(at, end - at)
                yield pa.RecordBatch.from_arrays([ids, pa.array(score)], names=["doc_id", "score"])

    return run


def quality_scores(documents: DataFrame, model: linecrf.Model) -> DataFrame:
    """``doc_id, score`` for every row of ``documents``, in one pass without a shuffle.

    Null and empty texts are one line without words and get that line's marginal.
    Repeated rows and null ids give a row each; an empty table an empty result.
    """
    return only(documents, "doc_id", "text").mapInArrow(_scores(model), "doc_id bigint, score double")


def op6_quality_classifier(spark, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = linecrf.fit_on_sample(documents, labels, allowed=fold(F.col("doc_id")) != 1)
    scored = quality_scores(documents, model)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
