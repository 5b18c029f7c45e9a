"""Linear-chain conditional random field over the lines of a text, with two labels.

Features come from the line itself (words, symbols, case, digits, repeats) and from
its neighbours; transitions tie consecutive labels together. Feature extraction and
inference run on whole Arrow batches inside Spark tasks; only a bounded sample of
labelled rows is gathered for fitting.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrail.llm import textnum
from sparktrail.llm.common import only

#: Bounds of the training sample: documents, and lines a document may have to be in it.
SAMPLE_DOCUMENTS = 3000
SAMPLE_LINES = 200
_STEPS = 160
_RATE = 0.1
_PENALTY = 1e-4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?-'\"()/"]] = True
_WEIGHTS = [np.uint64(w) for w in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Lines(NamedTuple):
    first: np.ndarray  # first line of each row, and the number of lines at the end
    features: np.ndarray
    words: np.ndarray  # words of each line
    n_words: np.ndarray  # from here on one value per row
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def _equal_to_earlier(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(len(value)), value, row))
    out = np.zeros(len(value), bool)
    same = (row[order[1:]] == row[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
    out[order[1:]] = same
    return out


def _repeated_words(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Words inside a 3-word window that its row holds twice or more."""
    out = np.zeros(len(h), bool)
    if len(h) < 3:
        return out
    window = textnum.mix(h[:-2] * _WEIGHTS[0] + h[1:-1] * _WEIGHTS[1] + h[2:] * _WEIGHTS[2])
    at = np.flatnonzero(row[2:] == row[:-2])
    key = textnum.mix(window[at] + row[at].astype(np.uint64) * _WEIGHTS[2])
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    at = at[count[inverse] > 1]
    for k in range(3):
        out[at + k] = True
    return out


def lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    rows, n = len(offsets) - 1, len(data)
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(rows), np.searchsorted(offsets[1:], breaks, side="right")])
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    first = np.searchsorted(row, np.arange(rows + 1))
    end = offsets[row + 1].copy()
    inner = np.flatnonzero(row[1:] == row[:-1])
    end[inner] = start[inner + 1] - 1

    w_start, w_end = textnum.edges(~textnum.SPACE[data], offsets)
    w_row = np.searchsorted(offsets[1:], w_start, side="right")
    w_hash = textnum.span_hashes(data, w_start, w_end)
    w_line = np.searchsorted(start, w_start, side="right") - 1
    n_lines = len(start)

    def per_line(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return (sums[end] - sums[start]).astype(np.float64)

    def words_where(flags: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(w_line if flags is None else w_line[flags], minlength=n_lines).astype(np.float64)

    words = words_where()
    has_word = words > 0
    dup = _equal_to_earlier(row, textnum.span_hashes(data, start, end)) & has_word
    repeated = _repeated_words(w_row, w_hash)
    head = data[w_start] if len(w_start) else data[:0]
    inside = ~textnum.SPACE[data]
    symbols, chars = per_line(_SYMBOL[data]), np.maximum(per_line(inside), 1)
    code_points = inside & ((data & 0xC0) != 0x80)
    bangs = np.zeros(n, bool)
    bangs[1:] = (data[1:] == 33) & (data[:-1] == 33)
    last = data[np.maximum(end - 1, 0)] if n else np.zeros(n_lines, np.uint8)
    own_words = np.maximum(words, 1)
    own = np.stack(
        [
            np.log1p(words),
            symbols / chars,
            per_line(_PUNCT[data]) / chars,
            per_line(_DIGIT[data]) / chars,
            per_line(_UPPER[data]) / np.maximum(per_line(_LETTER[data]), 1),
            np.minimum(chars / own_words, 20) / 10,
            words_where((w_end - w_start == 1) & (head == 124)) / own_words,
            per_line(bangs) / own_words,
            words_where(repeated) / own_words,
            dup.astype(float),
            ((last == 46) | (last == 33) | (last == 63)).astype(float) * has_word,
            (words < 4).astype(float),
        ],
        axis=1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[inner + 1], after[inner] = own[inner], own[inner + 1]
    near = [1, 4, 6, 7, 8]
    bounds = np.zeros((n_lines, 2))
    bounds[first[:-1], 0] = 1
    bounds[first[1:] - 1, 1] = 1
    features = np.concatenate([np.ones((n_lines, 1)), own, before[:, near], after[:, near], bounds], axis=1)

    def per_row(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=values, minlength=rows).astype(np.int64)

    return Lines(
        first,
        features,
        words,
        per_row(words),
        per_row(per_line(code_points)),
        per_row(symbols),
        per_row(dup),
        np.bincount(w_row[repeated], minlength=rows).astype(np.int64),
    )


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the label good; the other label's score is 0
    moves: np.ndarray  # from label to label

    def scores(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights


N_FEATURES = 25
NEUTRAL = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), np.zeros((2, 2)))


def _steps(first: np.ndarray):
    """Line numbers at depth 0, 1, ... of all rows that are so long."""
    size = np.diff(first)
    begin = first[:-1][np.argsort(-size, kind="stable")]
    size = np.sort(size)[::-1]
    for t in range(int(size[0]) if len(size) else 0):
        yield t, begin[: np.searchsorted(-size, -t, side="left")] + t


def marginals(score: np.ndarray, first: np.ndarray, moves: np.ndarray):
    """Forward-backward: the probability of label 1 per line, the chain scores and log Z per line."""
    m = len(score)
    a, b = np.zeros((m, 2)), np.zeros((m, 2))
    steps = list(_steps(first))
    for t, at in steps:
        if t:
            past = a[at - 1]
            a[at] = np.logaddexp(past[:, :1] + moves[0], past[:, 1:] + moves[1])
        a[at, 1] += score[at]
    ends = np.zeros(m, bool)
    ends[first[1:] - 1] = True
    for _, at in reversed(steps):
        at = at[~ends[at]]
        nxt = b[at + 1].copy()
        nxt[:, 1] += score[at + 1]
        b[at] = np.logaddexp(nxt[:, :1] + moves[:, 0], nxt[:, 1:] + moves[:, 1])
    z = np.logaddexp(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])
    return np.exp(a[:, 1] + b[:, 1] - z), a, b, z


def viterbi(score: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Labels of the best path of each row; ties go to label 1."""
    m = len(score)
    best, back = np.zeros((m, 2)), np.zeros((m, 2), np.int8)
    steps = list(_steps(first))
    for t, at in steps:
        if t:
            options = best[at - 1][:, :, None] + moves[None]
            back[at] = options[:, 1] >= options[:, 0]
            best[at] = options.max(axis=1)
        best[at, 1] += score[at]
    label = np.zeros(m, np.int8)
    ends = first[1:] - 1
    label[ends] = best[ends, 1] >= best[ends, 0]
    last = np.zeros(m, bool)
    last[ends] = True
    for _, at in reversed(steps):
        at = at[~last[at]]
        label[at] = back[at + 1, label[at + 1]]
    return label


def fit(features: np.ndarray, first: np.ndarray, good: np.ndarray) -> Model:
    """Maximum likelihood by gradient steps. ``good`` is a row's label, given to all its lines."""
    if not len(good) or good.all() or not good.any():
        return NEUTRAL
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    mean[0], scale[0] = 0.0, 1.0
    x = (features - mean) / scale
    size = np.diff(first)
    row = np.repeat(np.arange(len(good)), size)
    weight = (1.0 / size / len(good))[row]
    label = good[row].astype(float)
    inner = np.flatnonzero(row[1:] == row[:-1]) + 1
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, _STEPS + 1):
        moves = theta[-4:].reshape(2, 2)
        score = x @ theta[:-4]
        p, a, b, z = marginals(score, first, moves)
        gradient = np.concatenate([x.T @ ((label - p) * weight), np.zeros(4)])
        state = np.stack([np.zeros(len(inner)), score[inner]], axis=1) + b[inner]
        pair = np.exp(a[inner - 1][:, :, None] + moves[None] + state[:, None, :] - z[inner][:, None, None])
        gold = np.zeros_like(pair)
        same = label[inner].astype(int)
        gold[np.arange(len(inner)), same, same] = 1.0
        gradient[-4:] = ((gold - pair) * weight[inner][:, None, None]).sum(axis=0).ravel()
        gradient -= _PENALTY * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + _RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def _sampled_features(max_lines: int):
    def run(batches):
        for batch in batches:
            yield from _batch_features(batch, max_lines)

    return run


def _batch_features(batch, max_lines: int):
    import pyarrow as pa

    good = batch.column("quality").to_numpy(zero_copy_only=False)
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for at, _, data, offsets in textnum.chunks(batch.column("text")):
        told = lines(data, offsets)
        for r in range(len(told.first) - 1):
            a, b = told.first[r], told.first[r + 1]
            if b - a <= max_lines:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(ids[at + r])]),
                        pa.array([int(good[at + r])]),
                        pa.array([told.features[a:b].astype(np.float32).tobytes()], pa.binary()),
                    ],
                    names=["doc_id", "quality", "features"],
                )


def fit_on_sample(
    documents: DataFrame,
    labels: DataFrame,
    allowed=None,
    max_documents: int = SAMPLE_DOCUMENTS,
    max_lines: int = SAMPLE_LINES,
) -> Model:
    """Fit on at most ``max_documents`` labelled texts of at most ``max_lines`` lines.

    The sample is the first by a hash of the id among the labels that ``allowed``
    admits; ids labelled 0 and 1 both, and null labels or ids, are not used. Of rows that
    share an id the least text is used, so the sample does not depend on the run.
    """
    known = only(labels, "doc_id", "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    if allowed is not None:
        known = known.filter(allowed)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    known = known.filter("quality = most").select("doc_id", "quality")
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_documents)
    sample = only(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    told = sample.mapInArrow(_sampled_features(max_lines), "doc_id bigint, quality bigint, features binary")
    rows = sorted(told.collect(), key=lambda r: r["doc_id"])
    if not rows:
        return NEUTRAL
    parts = [np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES).astype(float) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return fit(np.concatenate(parts), first, np.array([bool(r["quality"]) for r in rows]))
