"""Quality rules: line sequence labelling decides what is content and what is boilerplate.

The base rules count words, symbols, repeated lines and repeated word windows and fail
a document that is too short or too repetitive. For the others the best path of a
linear-chain conditional random field marks every line as content or boilerplate, and
the share of words in content lines decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrail.llm import linecrf, textnum
from sparktrail.llm.common import only, row_hash

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Least share of words in content lines.
MIN_CONTENT = 0.5

_SCHEMA = (
    "doc_id bigint, text_hash bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, content_share double, base_failed boolean, kept boolean"
)


def _measures(model: linecrf.Model):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, end, data, offsets in textnum.chunks(batch.column("text")):
                told = linecrf.lines(data, offsets)
                label = linecrf.viterbi(model.scores(told.features), told.first, model.moves)
                content = np.add.reduceat(told.words * label, told.first[:-1])
                share = content / np.maximum(told.n_words, 1)
                failed = (told.n_words < MIN_WORDS) | (100 * told.n_repeat_words > MAX_REPEAT_PERCENT * told.n_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, end - at),
                        batch.column("text_hash").slice(at, end - at),
                        *(pa.array(v) for v in told[3:8]),
                        pa.array(share),
                        pa.array(failed),
                        pa.array(~failed & (share >= MIN_CONTENT)),
                    ],
                    names=[f.split()[0] for f in _SCHEMA.split(", ")],
                )

    return run


def judge(documents: DataFrame, model: linecrf.Model) -> DataFrame:
    """One row per row of ``documents``, in one pass without a shuffle.

    ``doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    content_share, base_failed, kept``. Null and empty texts have no words and fail.
    Repeated rows and null ids give a row each; an empty table an empty result.
    """
    texts = only(documents, "doc_id", "text").select("doc_id", row_hash(F.col("text")).alias("text_hash"), "text")
    return texts.mapInArrow(_measures(model), _SCHEMA)


def _verdicts(model: linecrf.Model, column: str):
    measure = _measures(model)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            row = batch.column("row")
            text = pc.struct_field(row, "text")
            blank = pa.nulls(len(text), pa.int64())
            told = pa.RecordBatch.from_arrays([blank, blank, text], names=["doc_id", "text_hash", "text"])
            kept = [flag for part in measure([told]) for flag in part.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([row.filter(pa.array(kept, pa.bool_()))], names=["row"])

    return run


def keep_good(documents: DataFrame, model: linecrf.Model) -> DataFrame:
    """The rows of ``documents`` that pass, all columns unchanged; nothing is shuffled."""
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    kept = rows.mapInArrow(_verdicts(model, "kept"), rows.schema)
    return kept.select("row.*")


def op7_quality_rules(spark, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return judge(documents, linecrf.fit_on_sample(documents, labels)).drop("text_hash")
