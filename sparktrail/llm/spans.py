"""Substring dedup by sliding sentence spans.

A text is cut into sentences, at sentence ends and line ends and, in long ones, at
words that their neighbourhood chooses, so that copies are cut alike. Every run of
consecutive sentences, two at least and long enough to mean something, is hashed from
its words; a text without such a run is one run as a whole. All runs are joined globally
by hash; of each hash the first run by document id and position stays, and sentences
covered by any other run of a repeated hash are removed. The runs travel as narrow
rows, and text is moved once, to the documents that lose something.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrail.llm import textnum
from sparktrail.llm.common import only, row_hash
from sparktrail.session import materialize

#: A run has two sentences and this many words at least.
MIN_SENTENCES = 2
MIN_WORDS = 20
#: So many characters of a script without blanks count as a word.
CHARACTERS = 2
#: A longer sentence is cut after the word of the smallest hash of each LONG_SENTENCE words in a row; a power of two.
LONG_SENTENCE = 16

_MOST_SENTENCES = (1 << 19) - 1  # of a run; it has at most MIN_WORDS * CHARACTERS

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?;"]] = True
#: Sentence ends of other scripts: ideographic and full-width, Arabic, Armenian, Hebrew, Indic, Tibetan, Burmese, Ethiopic, Khmer, Mongolian.
_WIDE_END = np.array(sorted(map(ord, "。．！？；｡։׃؛؟۔।॥།༎၊။።፧፨។៕᠃᠉…‼⁇⁈⁉")))
#: First and last characters of scripts without blanks: Thai, Lao, Tibetan, Burmese, Khmer, Chinese, Japanese.
_BLANKLESS = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x20000, 0x3FFFF))


class _Words(NamedTuple):
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    size: np.ndarray  # CHARACTERS for a word, 1 for a character of a script without blanks
    ends: np.ndarray  # whether its last character ends a sentence


def _characters(data: np.ndarray):
    """Starts, widths and code points of the characters of two bytes and more."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.int64)
    width = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead & np.array([0, 0, 0x1F, 0x0F, 0x07])[width]
    for k in range(1, 4):
        more = data[np.minimum(at + k, len(data) - 1)] & 0x3F
        code = np.where(k < width, code << 6 | more, code)
    return at, width, code


def _words(data: np.ndarray, offsets: np.ndarray) -> _Words:
    """Words between blanks; of scripts without blanks every character is one."""
    at, width, code = _characters(data)
    stops = np.zeros(len(data), bool)
    wide = np.isin(code, _WIDE_END)
    stops[at[wide] + width[wide] - 1] = True
    alone = np.zeros(len(code), bool)
    for low, high in _BLANKLESS:
        alone |= (code >= low) & (code <= high)
    if not alone.any():
        w = textnum.words(data, offsets)
        return _Words(*w, np.full(len(w.start), CHARACTERS), _END[data[w.end - 1]] | stops[w.end - 1])
    at, width = at[alone], width[alone]
    lower = textnum.LOWER[data]
    inside = ~textnum.SPACE[lower]
    for k in range(4):
        inside[at[k < width] + k] = False
    start, end = textnum.edges(inside, offsets)
    size = np.concatenate([np.full(len(start), CHARACTERS), np.ones(len(at), np.int64)])
    start, end = np.concatenate([start, at]), np.concatenate([end, at + width])
    order = np.argsort(start)
    start, end, size = start[order], end[order], size[order]
    row = np.searchsorted(offsets[1:], start, side="right")
    return _Words(row, start, end, textnum.span_hashes(lower, start, end), size, _END[data[end - 1]] | stops[end - 1])


def _long_cuts(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that end a piece of a sentence of more than LONG_SENTENCE words.

    From any LONG_SENTENCE words in a row the last one of the smallest hash. Every stretch
    of that many words has a cut, and inside a repeated stretch all cuts from the first
    such choice to the last depend on its words only.
    """
    if len(value) <= LONG_SENTENCE:
        return np.zeros(0, np.int64)
    sentence = np.cumsum(ends) - ends
    chosen, step = np.arange(len(value)), 1
    while step < LONG_SENTENCE:
        a, b = chosen[:-step], chosen[step:]
        chosen, step = np.where(value[b] <= value[a], b, a), step * 2
    within = sentence[: len(chosen)] == sentence[LONG_SENTENCE - 1 :]
    within &= np.bincount(sentence)[sentence[: len(chosen)]] > LONG_SENTENCE
    return np.unique(chosen[within])


def _sentences(data: np.ndarray, offsets: np.ndarray):
    """Words of a chunk and the first word of every sentence."""
    words = _words(data, offsets)
    n = len(words.start)
    ends = words.ends.copy()
    if n:
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        ends[:-1] |= (words.row[1:] != words.row[:-1]) | (breaks[words.start[1:]] > breaks[words.end[:-1]])
        ends[-1] = True
        ends[_long_cuts(words.hash, ends)] = True
    first = np.flatnonzero(np.concatenate([[True], ends[:-1]])) if n else np.zeros(0, np.int64)
    return words, first


def _runs(words, first: np.ndarray):
    """For every run: its first sentence, the sentence after it, and two hashes.

    Of every sentence the shortest run that begins with it and the shortest one that ends
    with it. In any longer run each sentence lies in a whole one of these: where the run
    that begins with it would reach past the end, the one that ends there holds it. A text
    that has none of them is a run itself.
    """
    n, s = len(words.start), len(first)
    if not s:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    bounds = np.concatenate([first, [n]])
    size = np.concatenate([[0], np.cumsum(words.size)])[bounds]
    least = MIN_WORDS * CHARACTERS
    number = np.arange(s)
    end = np.maximum(np.searchsorted(size, size[:-1] + least, side="left"), number + MIN_SENTENCES)
    begin = np.minimum(np.searchsorted(size, size[1:] - least, side="right") - 1, number + 1 - MIN_SENTENCES)
    begin, end = np.concatenate([number, begin]), np.concatenate([end, number + 1])
    ok = (begin >= 0) & (end <= s)
    begin, end = begin[ok], end[ok]
    same = words.row[first[begin]] == words.row[bounds[end] - 1]
    once = np.unique(begin[same] * (s + 1) + end[same])  # a run may be the shortest both ways
    begin, end = once // (s + 1), once % (s + 1)
    rows = words.row[first]
    whole = np.setdiff1d(rows, rows[begin])
    begin = np.concatenate([begin, np.searchsorted(rows, whole)])
    end = np.concatenate([end, np.searchsorted(rows, whole, side="right")])
    power, inverse = textnum.power_tables(n)
    hashes = []
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x632BE59BD9B4E019)):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(textnum.mix(words.hash ^ salt) * power, out=sums[1:], dtype=np.uint64)
        value = (sums[bounds[end]] - sums[first[begin]]) * inverse[first[begin]]
        hashes.append(textnum.mix(value + (bounds[end] - first[begin]).astype(np.uint64)))
    return begin, end, *hashes


def _emit_runs(batches):
    import pyarrow as pa

    for batch in batches:
        ids, tags = batch.column("doc_id"), batch.column("tag")
        for at, _, data, offsets in textnum.chunks(batch.column("text")):
            words, first = _sentences(data, offsets)
            begin, end, h, g = _runs(words, first)
            rows = words.row[first]
            base = np.searchsorted(rows, np.arange(len(offsets)))
            row = rows[begin]
            order = np.lexsort((begin, g, h, row))
            again = np.zeros(len(begin), np.int64)
            a, b = order[1:], order[:-1]
            again[a] = (row[a] == row[b]) & (h[a] == h[b]) & (g[a] == g[b])
            # First sentence in the document, sentences, and whether the document had this run before.
            place = ((begin - base[row]) << 20) | (np.minimum(end - begin, _MOST_SENTENCES) << 1) | again
            where = pa.array(row + at)
            whole = pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array((g >> np.uint64(33)).astype(np.int32)),
                    ids.take(where),
                    tags.take(where),
                    pa.array(place.astype(np.int64)),
                ],
                names=["h", "g", "doc_id", "tag", "place"],
            )
            for k in range(0, whole.num_rows, 50_000):
                yield whole.slice(k, 50_000)


def _removed(n: int, places) -> np.ndarray:
    gone = np.zeros(n + 1, np.int64)
    for place in places:
        a = place >> 20
        gone[a] += 1
        gone[a + (place >> 1 & _MOST_SENTENCES)] -= 1
    return np.cumsum(gone[:-1]) > 0


def _cut(batches):
    """Texts without the sentences that the runs at ``places`` cover."""
    import pyarrow as pa

    for batch in batches:
        places = batch.column("places").to_pylist()
        ids, texts = batch.column("doc_id"), batch.column("text")
        out = {"n_sentences": [], "n_removed": [], "text": []}
        for at, _, data, offsets in textnum.chunks(texts):
            words, first = _sentences(data, offsets)
            rows = words.row[first] if len(first) else first
            base = np.searchsorted(rows, np.arange(len(offsets)))
            for r in range(len(offsets) - 1):
                a, b = int(base[r]), int(base[r + 1])
                out["n_sentences"].append(b - a)
                if not places[at + r]:
                    out["n_removed"].append(0)
                    out["text"].append(texts[at + r].as_py())
                    continue
                gone = _removed(b - a, places[at + r])
                # A sentence reaches from its first word to the next sentence's.
                edge = [int(offsets[r]), *words.start[first[a + 1 : b]].tolist(), int(offsets[r + 1])]
                kept = [data[edge[k] : edge[k + 1]].tobytes() for k in range(b - a) if not gone[k]]
                out["n_removed"].append(int(gone.sum()))
                out["text"].append(b"".join(kept).decode("utf-8"))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(out["n_sentences"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["text"], pa.string())],
            names=["doc_id", "n_sentences", "n_removed", "text"],
        )


def repeated_runs(documents: DataFrame) -> DataFrame:
    """``doc_id, tag, places`` of the documents that hold runs which repeat earlier ones."""
    texts = _tagged(documents)
    runs = texts.mapInArrow(_emit_runs, "h bigint, g int, doc_id bigint, tag int, place bigint")
    firsts = runs.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    # Written, so that a run shared by very many documents may be split in the join.
    firsts = materialize(documents.sparkSession, firsts.filter("n > 1").select("h", "g", "first"), "firsts")
    again = F.col("place") % 2 == 1
    later = runs.join(firsts, ["h", "g"]).filter(again | ~F.col("doc_id").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places"))


def _tagged(documents: DataFrame) -> DataFrame:
    tag = (row_hash(F.col("text")) % (1 << 20)).cast("int")
    return only(documents, "doc_id", "text").select("doc_id", tag.alias("tag"), "text")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Every row of ``documents`` as ``doc_id, n_sentences, n_removed, text``.

    The document with the smallest id keeps a repeated run, and keeps its first
    occurrence; a copy of a short text loses all of it. Rows that repeat an id count as one document; all rows with a null id are
    one document that comes last. Null, empty and blank texts have no sentences and come
    back unchanged. An empty table gives an empty result.
    """
    texts = _tagged(documents)
    marks = repeated_runs(documents).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "places")
    same = texts["doc_id"].eqNullSafe(marks["_id"]) & (texts["tag"] == marks["_tag"])
    joined = texts.join(marks.hint("shuffle_hash"), same, "left").select("doc_id", "text", "places")
    return joined.mapInArrow(_cut, "doc_id bigint, n_sentences bigint, n_removed bigint, text string")


def op1_substring_dedup(spark, folder: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"))
