"""Fill-in-middle transformation.

A text is cut into units, words of ASCII letters and single other characters, and split at
two of them into prefix, middle and suffix, which are put out in the order suffix-prefix-
middle or prefix-suffix-middle between markers; some texts stay plain. The cuts and the
form follow from the hash of the document's id, so any run and any executor gives the same.

The work is a pipeline of Arrow kernels over chunks of a batch: units as list arrays over
the text's own bytes, flattened with their parents, numbered within them, filtered by
role, rebuilt as lists and joined. A text longer than a chunk goes through in slices, so
what is held besides it is bounded by the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail.llm.common import only
from sparktrail.llm.textnum import byte_column

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in percent: of texts that stay plain, and of the others that are put suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SEED = 1
CHUNK = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
FORMS = ["plain", "psm", "spm"]
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the hash of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substr(digest, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("bigint") for k in range(4)]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: at every character, but within a run of letters only at its first."""
    letter = _LETTER[data]
    start = (data & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(start)


def cut_pieces(data: np.ndarray, offsets: np.ndarray, ordinal: np.ndarray, first_cut, second_cut) -> list:
    """Prefix, middle and suffix of every row of a chunk, as string arrays.

    ``ordinal`` is the number of each row's first unit in its text; the cuts count units of the text.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    starts = unit_starts(data, offsets)
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data)))
    edges = np.searchsorted(starts, offsets)
    lists = pa.LargeListArray.from_arrays(pa.array(edges), flat)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    ordinals = pc.add(pa.array(np.arange(len(starts))), pc.take(pa.array(ordinal - edges[:-1]), parents))
    in_first = pc.less(ordinals, pc.take(pa.array(first_cut), parents))
    in_last = pc.greater_equal(ordinals, pc.take(pa.array(second_cut), parents))
    out = []
    for role in (in_first, pc.invert(pc.or_(in_first, in_last)), in_last):
        sizes = np.bincount(pc.filter(parents, role).to_numpy(), minlength=len(lists))
        rebuilt = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pc.filter(units, role))
        out.append(pc.binary_join(rebuilt, pa.scalar("", pa.large_string())))
    return out


def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in runs of whole units of about CHUNK bytes; a longer unit is a run."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data):
            here = unit_starts(data[end - 1 : end + CHUNK], np.array([0]))
            here = here[here > 0]
            if len(here):
                end += int(here[0]) - 1
                break
            end = min(end + CHUNK - 1, len(data))
        yield data[at:end]
        at = end


def _units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(unit_starts(data, offsets), offsets))


def _cuts(n: np.ndarray, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, other = one % (n + 1), other % (n + 1)
    return np.minimum(one, other), np.maximum(one, other)


def _long(data: np.ndarray, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, list]:
    """Units and pieces of one long text."""
    import pyarrow as pa

    counts = [int(_units(s, np.array([0, len(s)]))[0]) for s in _slices(data)]
    n = np.array([sum(counts)])
    first, second = _cuts(n, one, other)
    pieces: list[list[str]] = [[], [], []]
    at = 0
    for part, count in zip(_slices(data), counts, strict=True):
        for role, array in enumerate(cut_pieces(part, np.array([0, len(part)]), np.array([at]), first, second)):
            pieces[role].append(array[0].as_py())
        at += count
    return n, [pa.array(["".join(p)], pa.large_string()) for p in pieces]


def _transform(keys, text, n: np.ndarray, pieces: list, form_draw: np.ndarray, order_draw: np.ndarray, plain: int, suffix_first: int):
    import pyarrow as pa
    import pyarrow.compute as pc

    prefix, middle, suffix = pieces
    marked = pa.array(np.zeros(len(text), bool))
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = pc.or_(marked, pc.match_substring(text, marker))
    stays = pc.or_(pc.or_(marked, pa.array(n == 0)), pa.array(form_draw % 100 >= 100 - plain))
    form = pc.if_else(stays, 0, pa.array(np.where(order_draw % 100 < suffix_first, 2, 1)))
    join = lambda *parts: pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()))
    mark = {m: pa.scalar(m, pa.large_string()) for m in (PREFIX, SUFFIX, MIDDLE)}
    psm = join(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    spm = join(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    nothing = pa.scalar(None, pa.int64())
    length = lambda piece: pc.if_else(pc.equal(form, 0), nothing, pc.utf8_length(piece))
    return pa.RecordBatch.from_arrays(
        [
            keys,
            pa.array(n),
            pc.take(pa.array(FORMS), form),
            length(prefix),
            length(middle),
            pc.choose(form, text, psm, spm).cast(pa.string()),
        ],
        [c.split()[0] for c in SCHEMA.split(", ")],
    )


def fill_in_middle(documents: DataFrame, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row of ``documents``.

    Null text counts as empty; empty texts and texts that hold a marker stay plain, with null
    lengths. Rows with one id are cut by the same draws; a null id draws as an empty one. Extra
    columns are ignored, an empty table gives an empty result.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            data, offsets = byte_column(texts)
            drawn = [batch.column(2 + k).to_numpy() for k in range(4)]
            at = 0
            while at < batch.num_rows:
                end = int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1
                end = min(max(end, at + 1), batch.num_rows)
                here, edges = data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
                one, other, form, order = (d[at:end] for d in drawn)
                if len(here) > CHUNK:
                    n, pieces = _long(here, one, other)
                else:
                    n = _units(here, edges)
                    pieces = cut_pieces(here, edges, np.zeros(end - at, np.int64), *_cuts(n, one, other))
                yield _transform(batch.column(0).slice(at, end - at), texts.slice(at, end - at), n, pieces, form, order, plain, suffix_first)
                at = end

    named = only(documents, "doc_id", "text")
    drawn = [h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed))]
    return named.select("doc_id", "text", *drawn).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone: each marker of a changed text occurs once."""
    prefix, suffix, middle = (F.instr(output, m) for m in (PREFIX, SUFFIX, MIDDLE))
    end = F.length(output) + 1
    between = lambda start, stop: F.substr(output, start + 3, stop - start - 3)
    psm = F.concat(between(prefix, suffix), between(middle, end), between(suffix, middle))
    spm = F.concat(between(prefix, middle), between(middle, end), between(suffix, prefix))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_fill_in_middle(spark, folder: str) -> DataFrame:
    done = fill_in_middle(spark.read.parquet(f"{folder}/documents.parquet"))
    again = restored(F.col("output"), F.col("form"))
    return done.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(again, 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)[A-Za-z]+|[^A-Za-z]') AS u,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed),
cuts AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM units),
pieces AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""
