"""Ranked lexical search by range maxima.

The index has a row per block of documents: the block's terms, and for each the ascending
documents that hold it with their counts. A block is searched for many items at once. The
impacts of its posting lists get sparse tables of range maxima, so the largest impact of a
term within any interval of documents is two look-ups; summed over an item's terms that
bounds every score in the interval. Per item, intervals wait best bound first. One is
taken, the document of its largest impact is scored exactly, and the two intervals beside
it are bounded anew; short ones are scored whole. Intervals whose bound does not reach the
item's k-th best are never opened. A task carries the best of its earlier blocks along.

Blocks are made where texts are read and searched where blocks are read; only the best of
each task move. Statistics of the whole corpus come from the index before the search.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.llm.common import only
from sparktrail.llm.textnum import LOWER, byte_column, edges
from sparktrail.session import materialize, settings

TOP = 10
#: Percent of a document's length that counts, as in the score's definition.
SLOPE = 75
#: Bytes of text in a block; one longer text is a block of its own.
BLOCK = 1 << 23
#: Documents of an interval that is scored whole, and pairs of interval and term handled at once.
SHORT = 16
PAIRS = 1 << 20
#: Bytes of text, and pairs of interval and term, whose arrays a task holds at once.
SLICE, PART = 1 << 20, 1 << 16
#: Texts come to a worker by about a block, blocks come one by one.
BY_TEXT = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BLOCK)}
BY_BLOCK = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "1"}
#: Items, and characters of items, that one pass over the index answers.
ITEMS, ITEM_CHARS = 2000, 4_000_000

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_INSIDE = np.ones(256, bool)
_INSIDE[[c for c in range(128) if not chr(c).isalnum()]] = False
#: Sorts after every id; stands for null.
NO_ID = np.iinfo(np.int64).max

INDEX = (
    "doc_ids array<bigint>, lengths array<bigint>, n_docs bigint, n_terms bigint, "
    "terms array<string>, sizes array<int>, docs array<int>, counts array<int>"
)
FOUND = "number bigint, doc_id bigint, score bigint, slot int"


def terms_of(text: str | None) -> list[str]:
    return [t.translate(_LOWER) for t in _TERM.findall(text or "")]


_LOWER = {c: c + 32 for c in range(65, 91)}


# --- index -------------------------------------------------------------------


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, object]:
    """Row and term of every occurrence in a chunk; the terms are dictionary-encoded."""
    import pyarrow as pa

    inside = _INSIDE[data]
    start, end = edges(inside, offsets)
    row = np.searchsorted(offsets[1:], start, side="right")
    lengths = np.concatenate([[0], np.cumsum(end - start)])
    text = LOWER[data[inside]]
    return row, pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(lengths), pa.py_buffer(text)).dictionary_encode()


def _postings(data: np.ndarray, offsets: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and by term then row: sizes of the lists, their rows and counts. The text is read in slices of rows."""
    import pyarrow as pa

    rows, at = len(offsets) - 1, 0
    found, coded = [], []
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1
        end = min(max(end, at + 1), rows)
        row, some = _terms(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        found.append((row + at).astype(np.int32))
        coded.append(some)
        at = end
    coded = pa.chunked_array(coded).unify_dictionaries()
    terms = coded.chunk(0).dictionary
    # In place, as there is a key for every word of the block.
    key, at = np.empty(len(coded), np.int64), 0
    for some, row in zip(coded.chunks, found, strict=True):
        np.multiply(some.indices.to_numpy(), rows, out=key[at : at + len(row)], dtype=np.int64)
        key[at : at + len(row)] += row
        at += len(row)
    del coded, found
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    counts, key = np.diff(first, append=len(key)), key[first]
    return terms, np.bincount(key // rows, minlength=len(terms)), key % rows, counts


def _long_postings(data: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The same for one long text, read in slices that end between terms."""
    import pyarrow as pa

    total: Counter[str] = Counter()
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and _INSIDE[data[end]]:
            end += 1
        _, coded = _terms(data[at:end], np.array([0, end - at]))
        sizes = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).tolist()
        total.update(dict(zip(coded.dictionary.to_pylist(), sizes, strict=True)))
        at = end
    n = len(total)
    return pa.array(list(total), pa.string()), np.ones(n, np.int64), np.zeros(n, np.int64), np.array(list(total.values()), np.int64)


def _texts_of_blocks(batches) -> Iterator:
    """Batches of about BLOCK bytes of text, or of one longer text, whatever the size of those that come."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        _, offsets = byte_column(batch.column(1))
        at = 0
        while at < batch.num_rows:
            end = max(int(np.searchsorted(offsets, offsets[at] + BLOCK - size, side="right")) - 1, at)
            end = min(max(end, at + 1) if not held else end, batch.num_rows)
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(offsets[end] - offsets[at])
            if end < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
            at = end
    if held:
        yield pa.concat_batches(held)


def build_index(documents: DataFrame) -> DataFrame:
    """Blocks of the index over ``doc_id, text``: every row of ``documents`` is a document of its own.

    Null text has no terms. Within a block documents ascend by id, null ids last.
    """

    def run(batches):
        import pyarrow as pa

        one = lambda values, kind: pa.array([values], pa.list_(kind))
        for batch in _texts_of_blocks(batches):
            n = batch.num_rows
            batch = batch.take(pa.array(np.argsort(batch.column(0).fill_null(NO_ID).to_numpy(), kind="stable")))
            data, offsets = byte_column(batch.column(1))
            text, within = data[offsets[0] : offsets[n]], offsets - offsets[0]
            terms, sizes, rows, counts = _long_postings(text) if n == 1 and len(text) > BLOCK else _postings(text, within)
            lengths = np.bincount(rows, weights=counts, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0)),
                    one(lengths, pa.int64()),
                    pa.array([int(np.count_nonzero(lengths))], pa.int64()),
                    pa.array([int(lengths.sum())], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms.cast(pa.string())),
                    one(sizes.astype(np.int32), pa.int32()),
                    one(rows.astype(np.int32), pa.int32()),
                    one(counts.astype(np.int32), pa.int32()),
                ],
                [c.split()[0] for c in INDEX.split(", ")],
            )

    return only(documents, "doc_id", "text").mapInArrow(run, INDEX)


# --- search of one block -----------------------------------------------------


class Lists:
    """Posting lists of a block with their impacts and a sparse table of range maxima.

    ``table[k][p]`` is the place of the first largest impact among the 2**k places from p on.
    Lists lie one after the other; a range never leaves its list.
    """

    def __init__(self, sizes: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int) -> None:
        self.n_docs, self.docs, self.impacts = n_docs, docs, impacts
        self.key = np.repeat(np.arange(len(sizes)), sizes) * n_docs + docs
        self.table = [np.arange(len(docs), dtype=np.int32)]
        for k in range(1, int(sizes.max(initial=0)).bit_length()):
            below, step = self.table[-1], 1 << (k - 1)
            left, right = below[: len(below) - step], below[step:]
            self.table.append(np.where(impacts[right] > impacts[left], right, left))

    def range(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of ``term`` with documents from ``low`` up to ``high``."""
        return np.searchsorted(self.key, term * self.n_docs + low), np.searchsorted(self.key, term * self.n_docs + high)

    def peak(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the largest impact of every range, none of which is empty."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), np.int64)
        for k in np.unique(level):
            here = level == k
            left, right = self.table[k][start[here]], self.table[k][end[here] - (1 << k)]
            out[here] = np.where(self.impacts[right] > self.impacts[left], right, left)
        return out


class Items:
    """Terms of the items as places in one vocabulary, with how often an item repeats each."""

    def __init__(self, texts: list[str | None]) -> None:
        counted = [Counter(terms_of(t)) for t in texts]
        place = {t: k for k, t in enumerate(sorted({t for c in counted for t in c}))}
        self.vocabulary = list(place)
        self.sizes = np.array([len(c) for c in counted], np.int64)
        self.terms = np.array([place[t] for c in counted for t in c], np.int64)
        self.repeats = np.array([n for c in counted for n in c.values()], np.int64)

    def pairs(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a run of items: which of the run, and which entry of ``terms``, for all their terms."""
        sizes = self.sizes[item]
        first = (np.cumsum(self.sizes) - self.sizes)[item]
        ends = np.cumsum(sizes)
        run = np.repeat(np.arange(len(item)), sizes)
        return run, np.arange(len(run)) + np.repeat(first - (ends - sizes), sizes)

    def of_block(self, present: np.ndarray) -> Items:
        """The same items with only the terms of a block, numbered as its lists."""
        out = object.__new__(Items)
        held = present[self.terms] >= 0
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        out.vocabulary, out.terms, out.repeats = self.vocabulary, present[self.terms[held]], self.repeats[held]
        out.sizes = np.bincount(owner[held], minlength=len(self.sizes))
        return out


class Best:
    """The best ``k`` documents of every item so far: highest score first, then lowest id."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.item, self.doc_id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least, self.least_id = np.zeros(n_items, np.int64), np.full(n_items, NO_ID)

    def add(self, item: np.ndarray, doc_id: np.ndarray, score: np.ndarray) -> None:
        good = (score > self.least[item]) | ((score == self.least[item]) & (score > 0) & (doc_id <= self.least_id[item]))
        if not good.any():
            return
        item = np.concatenate([self.item, item[good]])
        doc_id, score = np.concatenate([self.doc_id, doc_id[good]]), np.concatenate([self.score, score[good]])
        order = np.lexsort((doc_id, -score, item))
        item, doc_id, score = item[order], doc_id[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = rank < self.k
        self.item, self.doc_id, self.score = item[kept], doc_id[kept], score[kept]
        full = rank == self.k - 1
        self.least[item[full]], self.least_id[item[full]] = score[full], doc_id[full]

    def reaches(self, item: np.ndarray, bound: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """Whether documents from ``first_id`` on, with scores up to ``bound``, may still get in."""
        least = self.least[item]
        return (bound > least) | ((bound == least) & (bound > 0) & (first_id < self.least_id[item]))


def _parts(items: Items, item: np.ndarray) -> Iterator[slice]:
    """Slices of intervals with about PART pairs of interval and term; at least one slice, which may be empty."""
    ends = np.cumsum(items.sizes[item])
    at, before = 0, 0
    while True:
        end = min(max(int(np.searchsorted(ends, before + PART, side="right")), at + 1), len(item))
        yield slice(at, end)
        if end == len(item):
            return
        at, before = end, int(ends[end - 1])


def _bounded(lists: Lists, items: Items, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bound of every interval, and the document where it splits."""
    made = [_bounded_part(lists, items, item[s], low[s], high[s]) for s in _parts(items, item)]
    return tuple(np.concatenate(columns) for columns in zip(*made, strict=True))


def _bounded_part(lists: Lists, items: Items, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    run, entry = items.pairs(item)
    start, end = lists.range(items.terms[entry], low[run], high[run])
    some = end > start
    run, entry = run[some], entry[some]
    place = lists.peak(start[some], end[some])
    value = lists.impacts[place] * items.repeats[entry]
    bound, split = np.zeros(len(item), np.int64), low.copy()
    if len(run):
        first = np.flatnonzero(np.diff(run, prepend=-1))
        bound[run[first]] = np.add.reduceat(value, first)
        top = np.repeat(np.maximum.reduceat(value, first), np.diff(np.append(first, len(run))))
        at_top = np.flatnonzero(value == top)
        split[run[at_top]] = lists.docs[place[at_top]]
    return bound, split


def _scored(lists: Lists, items: Items, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval, document and exact score of every document with a term of the item."""
    made = []
    for s in _parts(items, item):
        interval, doc, total = _scored_part(lists, items, item[s], low[s], high[s])
        made.append((interval + s.start, doc, total))
    return tuple(np.concatenate(columns) for columns in zip(*made, strict=True))


def _scored_part(lists: Lists, items: Items, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    run, entry = items.pairs(item)
    start, end = lists.range(items.terms[entry], low[run], high[run])
    size = end - start
    pair = np.repeat(np.arange(len(run)), size)
    place = np.arange(len(pair)) + np.repeat(start - (np.cumsum(size) - size), size)
    value = lists.impacts[place] * items.repeats[entry[pair]]
    width = int((high - low).max(initial=1))
    cell = run[pair] * width + lists.docs[place] - low[run[pair]]
    order = np.argsort(cell, kind="stable")
    cell, value = cell[order], value[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    total = np.add.reduceat(value, first) if len(first) else value
    interval = cell[first] // width
    return interval, cell[first] % width + low[interval], total


def search_block(lists: Lists, doc_ids: np.ndarray, items: Items, best: Best) -> int:
    """Search all documents of a block for all items; returns how many documents were scored."""
    item = np.flatnonzero(items.sizes > 0)
    low, high = np.zeros(len(item), np.int64), np.full(len(item), lists.n_docs)
    bound, split = _bounded(lists, items, item, low, high)
    scored, batch = 0, 1
    width = max(1, int(items.sizes.max(initial=1)))
    while len(item):
        # The best intervals of every item, at most as many as fit the bound on pairs.
        order = np.lexsort((-bound, item))
        rank = np.arange(len(item)) - np.searchsorted(item[order], item[order])
        opened = order[rank < batch][: max(1, PAIRS // (2 * width))]
        rest = np.ones(len(item), bool)
        rest[opened] = False
        short = high[opened] - low[opened] <= SHORT
        whole, cut = opened[short], opened[~short]
        # Split documents are intervals of one document.
        ranges = [np.concatenate([x[whole], y]) for x, y in ((item, item[cut]), (low, split[cut]), (high, split[cut] + 1))]
        interval, doc, score = _scored(lists, items, *ranges)
        scored += len(doc)
        best.add(ranges[0][interval], doc_ids[doc], score)
        parts = [np.concatenate([item[cut], item[cut]]), np.concatenate([low[cut], split[cut] + 1]), np.concatenate([split[cut], high[cut]])]
        some = parts[2] > parts[1]
        parts = [p[some] for p in parts]
        made = _bounded(lists, items, *parts)
        item, low, high, bound, split = (
            np.concatenate([old[rest], new]) for old, new in zip((item, low, high, bound, split), (*parts, *made), strict=True)
        )
        open_still = best.reaches(item, bound, doc_ids[low]) if len(item) else np.zeros(0, bool)
        item, low, high, bound, split = (x[open_still] for x in (item, low, high, bound, split))
        batch = min(2 * batch, 1024)
    return scored


# --- search of the index -----------------------------------------------------


def _held(row: dict, vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the vocabulary as list numbers (-1: not in the block); sizes, documents and places of their lists."""
    import pyarrow.compute as pc

    found = pc.index_in(vocabulary, value_set=row["terms"]).fill_null(-1).to_numpy().astype(np.int64)
    held = np.flatnonzero(found >= 0)
    present = np.full(len(found), -1)
    present[held] = np.arange(len(held))
    all_sizes = row["sizes"].to_numpy().astype(np.int64)
    first = np.cumsum(all_sizes) - all_sizes
    sizes, first = all_sizes[found[held]], first[found[held]]
    place = np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    return present, held, sizes, place


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(c)[k].values for c, name in enumerate(batch.schema.names)}


def document_counts(index: DataFrame, vocabulary: list[str]) -> np.ndarray:
    """How many documents hold each term of a vocabulary."""

    def run(batches):
        import pyarrow as pa

        wanted = pa.array(vocabulary, pa.string())
        total = np.zeros(len(vocabulary), np.int64)
        for row in _rows(batches):
            _, held, sizes, _ = _held(row, wanted)
            total[held] += sizes
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    counted = index.select("terms", "sizes").mapInArrow(run, "term bigint, df bigint")
    out = np.zeros(len(vocabulary), np.int64)
    for row in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a term of the items
        out[row["term"]] = row["df"]
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence of a term in an item adds to a document's score."""
    m = 100 - SLOPE + SLOPE * lengths * n_docs // n_terms
    return weights * (1_000_000_000 * counts // (1000 * counts + 8 * m))


def search(index: DataFrame, numbers: list[int], texts: list[str | None], k: int, n_docs: int, n_terms: int) -> DataFrame:
    """``number, doc_id, score, slot``: of every task the best ``k`` documents of each item."""
    items = Items(texts)
    weights = np.array([weight(n_docs, df) for df in document_counts(index, items.vocabulary).tolist()], np.int64)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        wanted = pa.array(items.vocabulary, pa.string())
        best = Best(len(numbers), k)
        for row in _rows(batches):
            present, held, sizes, place = _held(row, wanted)
            docs, counts = (row[c].to_numpy().astype(np.int64)[place] for c in ("docs", "counts"))
            lengths, term = row["lengths"].to_numpy(), np.repeat(weights[held], sizes)
            doc_ids = row["doc_ids"].fill_null(NO_ID).to_numpy()
            lists = Lists(sizes, docs, impacts(term, counts, lengths[docs], n_docs, n_terms), len(lengths))
            search_block(lists, doc_ids, items.of_block(present), best)
        ids = pa.array(best.doc_id, mask=best.doc_id == NO_ID)
        slot = np.full(len(best.item), TaskContext.get().partitionId() % 64, np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(numbers, np.int64)[best.item]), ids, pa.array(best.score), pa.array(slot)],
            ["number", "doc_id", "score", "slot"],
        )

    columns = "doc_ids", "lengths", "terms", "sizes", "docs", "counts"
    return index.select(*columns).mapInArrow(run, FOUND)


def ranked_search(documents: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best ``k`` documents of every row of ``items`` (item_id, text).

    Scores of 0 do not rank; equal scores go by ascending doc_id, null ids last. Every row of
    ``documents`` is a document of its own, so repeated rows take a rank each, and every row of
    ``items`` is answered by itself, repeated ones too. Null texts have no terms: such items
    find nothing and such documents are never found. Extra columns are ignored; empty tables
    give an empty result.
    """
    spark = documents.sparkSession
    with settings(spark, BY_TEXT):
        index = materialize(spark, build_index(documents), "index")
    numbered = materialize(spark, only(items, "item_id", "text").withColumn("number", F.monotonically_increasing_id()), "items")
    size = numbered.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    corpus = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("terms")).first()
    passes = []
    if corpus["terms"]:
        groups = max(-(-size["n"] // ITEMS), -(-(size["chars"] or 0) // ITEM_CHARS))
        for group in range(groups):
            part = numbered.filter(F.pmod(F.xxhash64("number"), F.lit(groups)) == group).select("number", "text").collect()
            with settings(spark, BY_BLOCK):
                passed = search(index, [r["number"] for r in part], [r["text"] for r in part], k, corpus["n"], corpus["terms"])
                passes.append(materialize(spark, passed, "found"))
    found = reduce(DataFrame.union, passes) if passes else spark.createDataFrame([], FOUND)
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    for keys in (("number", "slot"), ("number",)):
        best = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("rank", best).filter(F.col("rank") <= k)
    return found.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, folder: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, t, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
corpus AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
impact AS (SELECT doc_id, t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS impact
  FROM tf JOIN df USING (t), corpus),
scored AS (SELECT item_id, doc_id, CAST(sum(repeats * impact) AS BIGINT) AS score FROM q JOIN impact USING (t) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
