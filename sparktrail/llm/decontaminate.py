"""Benchmark decontamination with a broadcast hash set of test n-grams.

The benchmark's 13-word windows (an item of fewer words is one window) are hashed
and broadcast, once their number is known to be within a limit; beyond it the same
join is left to the engine's shuffled plans. A training text is read once: its words
are hashed, every window gets a hash made of its first, middle and last word, and
windows whose hash is in the set are verified word by word. Only verified hits leave
the scan. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail.llm.common import ascii_lower, bounded, only, pieces, row_hash, unused
from sparktrail.session import materialize

NGRAM = 13
#: Most benchmark windows that are broadcast (about 300 bytes each).
BROADCAST_WINDOWS = 1_000_000
#: Between words: ASCII without digits and lower-case letters.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return pieces(ascii_lower(text), _GAP)


def _windows_hash(hashes: Column, size: int) -> Column:
    """One hash per window of ``size`` words, from its first, middle and last word."""
    count = F.greatest(F.size(hashes) - (size - 1), F.lit(0))
    first = F.slice(hashes, F.lit(1), count)
    if size == 1:
        return first
    middle = F.slice(hashes, F.lit(1 + size // 2), count)
    last = F.slice(hashes, F.lit(size), count)
    mixed = F.zip_with(first, middle, lambda a, b: F.xxhash64(a, b))
    return F.zip_with(mixed, last, lambda a, b: F.xxhash64(a, b))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows: ``size, window_hash, window`` and the ids of the items that hold it."""
    items = only(benchmark, "item_id", "text").withColumn("words", words_of(F.col("text")))
    items = items.filter(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(NGRAM)))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1))
    windows = items.withColumn("at", starts).select("item_id", "size", F.slice("words", F.col("at"), F.col("size")).alias("window"))
    return windows.groupBy("size", "window").agg(F.collect_set("item_id").alias("items"))


def _same_words(word_at) -> Column:
    """Whether the window's words are those that ``word_at`` gives for their numbers.

    Word by word: a plain equality would become a join key, built for every window of
    every text, and a slice would copy all words of the text for every candidate.
    """
    return F.forall(F.transform("window", lambda word, i: word == word_at(i)), lambda same: same)


def _hits(texts: DataFrame, windows: DataFrame, size: int, small: bool) -> DataFrame:
    """Verified occurrences of windows of one size."""
    here = windows.filter(F.col("size") == size).select("window", "items")
    hashed = here.withColumn("wanted", _windows_hash(F.transform("window", lambda w: F.xxhash64(w)), size)[0])
    # An outer explode: for a plain one the optimizer infers a filter on the array and computes it twice.
    scanned = texts.select(
        "doc_id", "text_hash", "n_words", "words", F.posexplode_outer(_windows_hash(F.col("hashes"), size)).alias("at", "found")
    )
    in_text = lambda i: F.get("words", F.col("at") + i)
    if small:
        joined = scanned.join(F.broadcast(hashed), F.col("found") == F.col("wanted")).filter(_same_words(in_text))
    else:
        # Only the window goes into the shuffle, never all words of its text.
        there = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), in_text)
        narrow = scanned.filter("found IS NOT NULL").withColumn("there", there).drop("words")
        joined = narrow.join(hashed, F.col("found") == F.col("wanted")).filter(_same_words(lambda i: F.get("there", i)))
    return joined.select("doc_id", "text_hash", "n_words", "at", F.lit(size).alias("size"), "items")


def _covered(spans: Column) -> Column:
    """Words inside any of the spans ``(at, size)``, by one pass over them in order."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))

    def step(acc, span):
        end = span["at"] + span["size"]
        fresh = F.greatest(end - F.greatest(acc["end"], span["at"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["words"] + fresh).alias("words"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["words"])


def _texts(documents: DataFrame) -> DataFrame:
    texts = only(documents, "doc_id", "text").select(
        "doc_id", row_hash(F.col("text")).alias("text_hash"), words_of(F.col("text")).alias("words")
    )
    return texts.withColumn("n_words", F.size("words").cast("long"))


def hit_texts(documents: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The texts with hits: ``doc_id, text_hash, n_words, n_hit, spans, items``, one row per id and text.

    One scan of the documents per window size; only verified hits are shuffled.
    """
    spark = documents.sparkSession
    windows = materialize(spark, benchmark_windows(benchmark), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # 13 values at most
    small = bounded(windows, broadcast_windows)
    texts = _texts(documents).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    found = None
    for size in sizes:
        hits = _hits(texts, windows, size, small)
        found = hits if found is None else found.union(hits)
    if found is None:
        columns = "doc_id bigint, text_hash bigint, n_words bigint, at int, size int, items array<bigint>"
        found = spark.createDataFrame([], columns)
    found = materialize(spark, found, "hits")
    found = found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.collect_set(F.struct("at", "size")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    return found.withColumn("n_hit", _covered(F.col("spans")))


def _is_contaminated(n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def contamination(documents: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document: ``doc_id, text_hash, n_words, n_hit, spans, items, contaminated``.

    ``spans`` are the hit windows ``(at, size)`` in words. Null text has no words.
    Rows with one id and text give one row each; null ids and null item ids are
    allowed (a null item id is not listed, its hits count). Items without words match nothing,
    equal items are all listed. Empty tables give empty results.
    """
    found = hit_texts(documents, benchmark, broadcast_windows).drop("n_words")
    found = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    counted = _texts(documents).drop("words")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(found, same, "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        "spans",
        "items",
        _is_contaminated(n_hit).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the contaminated ones, columns unchanged.

    Repeated rows go or stay together, rows that share an id are judged by their own
    text, also with a null id; null and empty texts stay. Any extra column is kept, empty
    tables give what is left: nothing, or all documents.
    """
    bad = hit_texts(documents, benchmark).filter(_is_contaminated(F.col("n_hit"))).select("doc_id", "text_hash")
    name = unused(documents, "_text_hash")
    named = documents.withColumn(name, row_hash(F.col("text")))
    same = named["doc_id"].eqNullSafe(bad["doc_id"]) & (named[name] == bad["text_hash"])
    return named.join(bad.hint("shuffle_hash"), same, "left_anti").drop(name)


def cut_spans(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, text``: the words left when hit spans are removed, normalised and joined by blanks.

    Texts without a hit stay as they are.
    """
    texts = only(documents, "doc_id", "text").withColumn("_hash", row_hash(F.col("text")))
    spans = found.filter("n_hit > 0").select(F.col("doc_id").alias("_id"), "text_hash", "spans")
    same = texts["doc_id"].eqNullSafe(spans["_id"]) & (texts["_hash"] == spans["text_hash"])
    joined = texts.join(spans, same, "left")
    inside = lambda i: F.exists("spans", lambda s: (s["at"] <= i) & (i < s["at"] + s["size"]))
    kept = F.filter(words_of(F.col("text")), lambda w, i: ~inside(i))
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(kept, " ")).alias("text"))


def op8_decontamination(spark, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = contamination(documents, benchmark)
    none = F.array().cast("array<bigint>")
    items = F.array_sort(F.transform(F.coalesce("items", none), lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP8_SQL = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS size,
    list_slice(words, pos, pos + least(len(words), 13) - 1) AS gram
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS pos FROM items WHERE len(words) > 0)),
texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
windows AS (
  SELECT doc_id, pos, size, list_slice(words, pos, pos + size - 1) AS gram
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos
        FROM texts, (SELECT DISTINCT size FROM grams) WHERE len(words) >= size)),
hits AS (SELECT DISTINCT doc_id, pos, w.size, item_id FROM windows w JOIN grams g ON w.gram = g.gram),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
