"""Token ids of texts in word-aligned binary files.

A 64-bit word of a file holds four bits of selector and 60 bits of ids: the selector says
how many ids of which width. Ids that need more than 60 bits are escaped: their word names
an entry of the raw values at the end of its block. A block holds at most BLOCK ids of one
document and starts at a word of its own; the file's index gives every block's words, so
any run of blocks is decoded in a few vector operations, without walking through it.

Texts are dealt out by ranges of (doc_id, row); every task encodes its range in order and
writes one file. Tasks name their files freshly, and the written manifest says which of
them count, so a task that is run again leaves nothing behind that is read. Folders may
be on any store that ``pyarrow.fs`` opens by its URI.
"""

from __future__ import annotations

import os
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.llm.common import only
from sparktrail.llm.textnum import byte_column
from sparktrail.session import materialize, scratch_path

U64 = np.uint64
#: Ids a word and bits an id, by selector. Selector 0 is the escape.
LAYOUT = [(1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([count for count, _ in LAYOUT], np.int64)
BY_COUNT = {count: s for s, (count, _) in enumerate(LAYOUT)}
#: Least id that no longer fits, for selectors 1 to 14.
LIMITS = np.array([1 << bits for _, bits in LAYOUT[1:]], U64)
BLOCK = 4096
#: Bytes of text encoded and ids packed or read at once (whole blocks).
CHUNK = 1 << 22
GROUP = 1 << 20
#: Bytes of text of a file at least, ids of a file's segment (which one task reads), most files.
BYTES_PER_FILE = 1 << 24
SEGMENT = 1 << 22
MOST_FILES = 100_000
#: Pieces of words whose ids a worker remembers; then it starts afresh.
REMEMBERED = 500_000
#: Kinds of characters at which pieces of words begin.
_LETTER, _PUNCTUATION, _DIGIT, _BLANK = 1, 3, 5, 7
KINDS = {_LETTER: string.ascii_letters, _PUNCTUATION: '.,;:!?()"', _DIGIT: string.digits, _BLANK: " \t\n\r"}
#: Appended to every document by the registered query.
END_ID = 2

MAGIC = b"WORDIDS1"
#: Of a document in a file's index: id, whether it is null, first block and first id of the file.
DOC = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("block", "<i8"), ("id", "<i8")])
#: Of a block: its first word, ids, and raw words at its end.
BLOCKS = np.dtype([("word", "<i8"), ("ids", "<i4"), ("raw", "<i4")])
MANIFEST = "part int, segment int, file string, first_doc bigint, end_doc bigint, n_ids bigint"


# --- words -------------------------------------------------------------------


def pack(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of ``sizes`` ids as words; also the words of each block and the raw ones among them."""
    ids, n, ends = ids.astype(U64), len(ids), np.cumsum(sizes)
    left = np.minimum(np.repeat(ends, sizes) - np.arange(n), 61).astype(np.uint8)  # ids from here to the block's end
    rank = np.searchsorted(LIMITS, ids, side="right").astype(np.uint8)  # an id fits the selectors above its rank
    most = rank.copy()
    selector = np.where(rank < 14, 14, 0).astype(np.uint8)
    for count in range(2, min(60, n) + 1):
        reach = n - count + 1
        most = np.maximum(most[:reach], np.where(left[:reach] >= count, rank[count - 1 :], 255))
        if count in BY_COUNT:
            fits = most < BY_COUNT[count]
            if not fits.any():  # nor will more ids of fewer bits
                break
            selector[:reach][fits] = BY_COUNT[count]
    step = COUNTS[selector]
    # All blocks are walked side by side.
    at, end, walked = ends - sizes, ends, []
    while len(at):
        walked.append(at)
        at = at + step[at]
        on = at < end
        at, end = at[on], end[on]
    start = np.sort(np.concatenate([np.zeros(0, np.int64), *walked]))
    chosen = selector[start]
    words = chosen.astype(U64) << U64(60)
    block = np.searchsorted(ends, start, side="right")
    for s in np.unique(chosen):
        count, bits = LAYOUT[s]
        here = np.flatnonzero(chosen == s)
        if s == 0:
            nth = np.arange(len(here))
            words[here] |= (nth - np.searchsorted(block[here], block[here])).astype(U64)
            continue
        for k in range(count):
            words[here] |= ids[start[here] + k] << U64(k * bits)
    last = np.searchsorted(start, ends)
    escaped = np.flatnonzero(chosen == 0)
    raw = np.bincount(block[escaped], minlength=len(sizes))
    words = np.insert(words, last[block[escaped]], ids[start[escaped]])
    return words, np.diff(last, prepend=0) + raw, raw


def unpack(words: np.ndarray, sizes: np.ndarray, block_words: np.ndarray, block_raw: np.ndarray) -> np.ndarray:
    """The ids of a run of blocks."""
    block = np.repeat(np.arange(len(sizes)), block_words)
    place = np.arange(len(words)) - np.repeat(np.cumsum(block_words) - block_words, block_words)
    is_raw = place >= (block_words - block_raw)[block]
    raw, words, block = words[is_raw], words[~is_raw], block[~is_raw]
    selector = (words >> U64(60)).astype(np.int64)
    before = np.cumsum(COUNTS[selector]) - COUNTS[selector]
    within = before - before[np.searchsorted(block, block)] if len(block) else before
    first = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), U64)
    for s in np.unique(selector):
        count, bits = LAYOUT[s]
        here = np.flatnonzero(selector == s)
        if s == 0:
            payload = (words[here] & U64((1 << 60) - 1)).astype(np.int64)
            out[(first[block] + within)[here]] = raw[(np.cumsum(block_raw) - block_raw)[block[here]] + payload]
            continue
        there = (first[block] + within)[here]
        for k in range(count):
            out[there + k] = (words[here] >> U64(k * bits)) & U64((1 << bits) - 1)
    return out


# --- texts to ids ------------------------------------------------------------


class Encoder:
    """Ids of whole texts. With ``by_words`` every distinct piece of a word is encoded once.

    Pieces begin at either end of white space, between a letter and punctuation, and on both
    sides of a digit, if with a character below U+0300. That is for tokenizers that drop
    white space, split letters from punctuation and take digits one by one: there no token
    spans such a place, and normalization joins no such character to what is before it.
    Characters that special tokens hold are left out.
    """

    def __init__(self, path: str, by_words: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words
        special = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.kinds = np.zeros(256, np.uint8)
        for kind, characters in KINDS.items():
            self.kinds[[ord(c) for c in characters if kind == _LETTER or c not in special]] = kind
        # Whether an id ends a word, for models that mark it.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(0, bool)
        if suffix:
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[k for token, k in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode new pieces: runs of letters joined by blanks, where ids tell the ends of words; others one by one."""
        joined = [w for w in words if w.isalpha()] if len(self.last) else []
        ids, ends = self._joined(joined)
        if len(ends) != len(joined):  # normalization made two words of one
            joined, ids, ends = [], ids[:0], ends[:0]
        rest = list(set(words).difference(joined)) if joined else words
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        self.known.update(zip([*joined, *rest], range(len(self.known), len(self.known) + len(words)), strict=True))
        self.lengths = np.concatenate([self.lengths, np.diff(ends, prepend=0), np.array([len(x) for x in found], np.int64)])
        self.pool = np.concatenate([self.pool, ids, *found])

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in found)])
        return ids, np.flatnonzero(self.last[ids]) + 1 if len(ids) else np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a chunk, and how many each row has."""
        import pyarrow as pa

        if not self.by_words:
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cut = _piece_starts(data, self.kinds)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        cuts = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(
            len(cuts), pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(np.ascontiguousarray(data))
        ).dictionary_encode()
        words, code = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        if len(self.known) + len(words) > REMEMBERED:
            self._forget()
        if new := [w for w in words if w not in self.known]:
            self._learn(new)
        entry = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[code]
        size = self.lengths[entry]
        ends = np.cumsum(size)
        first = (np.cumsum(self.lengths) - self.lengths)[entry]
        ids = self.pool[np.repeat(first - (ends - size), size) + np.arange(ends[-1])]
        row = np.searchsorted(cuts, offsets)
        return ids, np.diff(np.concatenate([[0], ends])[row])


def _piece_starts(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where a piece of a word, or white space, begins."""
    kind = kinds[data]
    # Letters with accents: two bytes from 0xC3, but for the signs of multiplication and division.
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[accented] = kind[accented + 1] = _LETTER
    before, after = kind[:-1], kind[1:]
    cut = np.zeros(len(data), bool)
    cut[0] = True
    cut[1:] = (before * after == _LETTER * _PUNCTUATION) | (before == _DIGIT) | (after == _DIGIT)
    cut[1:] |= (before == _BLANK) != (after == _BLANK)
    cut[1:] &= (data[1:] < 0x80) | ((data[1:] >= 0xC2) & (data[1:] <= 0xCB))
    return cut


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = min(max(int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1, at + 1), rows)
        yield at, end
        at = end


def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in runs of words of about CHUNK bytes."""
    at = 0
    while len(data) - at > CHUNK:
        window = data[at + CHUNK // 2 : at + CHUNK + 1]
        cuts = np.flatnonzero((window[:-1] == 0x20) & (window[1:] > 0x20) & (window[1:] < 0x7F))  # as for pieces
        if not len(cuts):
            break
        end = at + CHUNK // 2 + int(cuts[-1]) + 1
        yield data[at:end]
        at = end
    yield data[at:]


def _block_sizes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each block, and blocks of each document."""
    blocks = -(-sizes // BLOCK)
    out = np.full(int(blocks.sum()), BLOCK, np.int64)
    last = np.cumsum(blocks) - 1
    out[last[blocks > 0]] = (sizes - (blocks - 1) * BLOCK)[blocks > 0]
    return out, blocks


def _pack_long(ids: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    parts = [ids[at : at + GROUP] for at in range(0, len(ids), GROUP)]
    words, counts, raws = zip(*(pack(p, _block_sizes(np.array([len(p)]))[0]) for p in parts), strict=True)
    return b"".join(w.astype("<u8").tobytes() for w in words), np.concatenate(counts), np.concatenate(raws)


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, by_words: bool) -> Encoder:
    """The encoder of this worker, which remembers words from task to task."""
    if (path, by_words) not in _encoders:
        _encoders[path, by_words] = Encoder(path, by_words)
    return _encoders[path, by_words]


def packed(batch, encoder: Encoder, end_id: int | None) -> Iterator[tuple[int | None, int, bytes, np.ndarray, np.ndarray]]:
    """``doc_id, n_ids, words, words of each block, raw words of each block`` of the rows of a batch."""
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    keys = batch.column(0).to_pylist()
    data, offsets = byte_column(batch.column(1))
    for at, end in _chunks(offsets):
        text = data[offsets[at] : offsets[end]]
        if encoder.by_words and len(text) > CHUNK:
            ids = np.concatenate([*(encoder(s, np.array([0, len(s)]))[0] for s in _slices(text)), tail])
            yield keys[at], len(ids), *_pack_long(ids)
            continue
        ids, sizes = encoder(text, offsets[at : end + 1] - offsets[at])
        if len(tail):
            ids, sizes = np.insert(ids, np.cumsum(sizes), tail[0]), sizes + 1
        block_sizes, blocks = _block_sizes(sizes)
        words, counts, raws = pack(ids, block_sizes)
        words = words.astype("<u8").tobytes()
        edges = np.concatenate([[0], np.cumsum(blocks)])
        bounds = (8 * np.concatenate([[0], np.cumsum(counts)])[edges]).tolist()
        edges = edges.tolist()
        for k in range(end - at):
            blocks_of = slice(edges[k], edges[k + 1])
            yield keys[at + k], int(sizes[k]), words[bounds[k] : bounds[k + 1]], counts[blocks_of], raws[blocks_of]


# --- files -------------------------------------------------------------------


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Writer:
    """One file: words, then the index of documents and blocks, then the sizes of both."""

    def __init__(self, folder: str, part: int) -> None:
        self.file = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        store, path = _store(self.file)
        store.create_dir(os.path.dirname(path), recursive=True)
        self.out = store.open_output_stream(path)
        self.out.write(MAGIC)
        self.part, self.words, self.ids, self.blocks = part, 0, 0, 0
        self.doc_index: list[bytes] = []
        self.block_index: list[bytes] = []
        self.docs, self.segments, self.opened = 0, [], (0, 0)

    def add(self, doc_id: int | None, n: int, words: bytes, counts: np.ndarray, raws: np.ndarray) -> None:
        if self.ids > self.opened[1] and self.ids + n - self.opened[1] > SEGMENT:
            self._close_segment()
        self.doc_index.append(np.array((doc_id or 0, doc_id is None, self.blocks, self.ids), DOC).tobytes())
        index = np.zeros(len(counts), BLOCKS)
        index["word"] = self.words + np.cumsum(counts) - counts
        index["ids"], index["raw"] = _block_sizes(np.array([n]))[0], raws
        self.block_index.append(index.tobytes())
        self.out.write(words)
        self.words += len(words) // 8
        self.blocks, self.docs, self.ids = self.blocks + len(counts), self.docs + 1, self.ids + n

    def _close_segment(self) -> None:
        self.segments.append((self.part, len(self.segments), self.file, self.opened[0], self.docs, self.ids - self.opened[1]))
        self.opened = (self.docs, self.ids)

    def close(self) -> list[tuple]:
        self._close_segment()
        # One entry more of each index, so that every document and block has an end.
        self.doc_index.append(np.array((0, 0, self.blocks, self.ids), DOC).tobytes())
        self.block_index.append(np.array((self.words, 0, 0), BLOCKS).tobytes())
        for piece in (*self.doc_index, *self.block_index):
            self.out.write(piece)
        self.out.write(np.array([self.words, self.docs, self.blocks], "<i8").tobytes() + MAGIC)
        self.out.close()
        return self.segments


def write_files(
    documents: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, by_words: bool, bytes_per_file: int = BYTES_PER_FILE
) -> DataFrame:
    """Write the ids of ``documents`` in ascending order of doc_id (nulls first) and return the files' manifest."""
    texts = only(documents, "doc_id", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = min(MOST_FILES, -(-total // bytes_per_file)) or 1
    # The row number lets a hot id spread over several files.
    dealt = texts.withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(files, "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        writer = None
        for batch in batches:
            for document in packed(batch, _encoder(tokenizer_path, by_words), end_id):
                writer = writer or _Writer(folder, TaskContext.get().partitionId())
                writer.add(*document)
        if writer:
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*writer.close(), strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return dealt.mapInArrow(run, MANIFEST)


def _documents(file: str, first: int, end: int) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
    """``doc_id, n_ids, ids in pieces`` of the documents from ``first`` up to ``end`` of a file."""
    store, path = _store(file)
    with store.open_input_file(path) as source:
        size = source.size()
        tail = source.read_at(32, size - 32)
        if tail[24:] != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError(f"no file of token ids: {file}")
        n_words, n_docs, _ = np.frombuffer(tail[:24], "<i8").tolist()
        doc_at = 8 + 8 * n_words
        block_at = doc_at + DOC.itemsize * (n_docs + 1)
        docs = np.frombuffer(source.read_at(DOC.itemsize * (end - first + 1), doc_at + DOC.itemsize * first), DOC)
        low, high = int(docs["block"][0]), int(docs["block"][-1])
        at, held, held_at = low, np.zeros(0, U64), int(docs["id"][0])
        blocks = np.frombuffer(source.read_at(BLOCKS.itemsize * (high - low + 1), block_at + BLOCKS.itemsize * low), BLOCKS)
        ends = np.cumsum(blocks["ids"][:-1].astype(np.int64)) + held_at

        def pieces(start: int, stop: int) -> Iterator[np.ndarray]:
            nonlocal at, held, held_at
            while start < stop:
                if start >= held_at + len(held):
                    held_at += len(held)
                    group = max(int(np.searchsorted(ends, held_at + GROUP, side="right")), at - low + 1)
                    run = blocks[at - low : group + 1]
                    edges = run["word"]
                    words = np.frombuffer(source.read_at(8 * int(edges[-1] - edges[0]), 8 + 8 * int(edges[0])), "<u8").astype(U64)
                    held = unpack(words, run["ids"][:-1].astype(np.int64), np.diff(edges), run["raw"][:-1].astype(np.int64))
                    at = low + group
                upto = min(stop, held_at + len(held))
                yield held[start - held_at : upto - held_at]
                start = upto

        for doc, following in zip(docs[:-1], docs[1:], strict=True):
            begin, stop = int(doc["id"]), int(following["id"])
            yield None if doc["null"] else int(doc["doc_id"]), stop - begin, pieces(begin, stop)


def read_files(manifest: DataFrame, digest, schema: str) -> DataFrame:
    """``digest(doc_id, start, n, pieces)`` of every document, read from the files of ``manifest``.

    ``pieces`` are arrays of its ids, in order; ``start`` counts the ids of all documents before it.
    """
    # One row a file, MOST_FILES at most, decides where each file starts.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    within = Window.partitionBy("part").orderBy("segment")
    placed = manifest.join(parts, "part").withColumn("start", F.col("before") + F.sum("n_ids").over(within) - F.col("n_ids"))
    tasks = min(manifest.count(), 4 * MOST_FILES) or 1
    placed = placed.select("file", "first_doc", "end_doc", "start").repartition(tasks)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                at, out = row["start"], []
                for doc_id, n, pieces in _documents(row["file"], row["first_doc"], row["end_doc"]):
                    out.append(digest(doc_id, at, n, pieces))
                    for _ in pieces:  # what the digest left
                        pass
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    names = [c.split()[0] for c in schema.split(", ")]
    return placed.mapInArrow(run, schema)


def crc_digest(doc_id, start, n, pieces):
    crc = 0
    for ids in pieces:
        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
    return doc_id, start, n, crc


def token_files(
    documents: DataFrame,
    tokenizer_path: str,
    end_id: int | None = END_ID,
    by_words: bool = False,
    bytes_per_file: int = BYTES_PER_FILE,
) -> DataFrame:
    """Encode ``documents`` into files below the shared folder and return their written manifest.

    ``tokenizer_path`` is a file that every executor can open; ``by_words`` is explained at
    ``Encoder``. Null text counts as empty. Repeated rows and rows with a null id are
    documents of their own (nulls come first, rows of one id in the order of the scan).
    Extra columns are ignored. An empty table makes no file and an empty manifest.
    """
    spark = documents.sparkSession
    files = write_files(documents, scratch_path(spark, "ids"), tokenizer_path, end_id, by_words, bytes_per_file)
    return materialize(spark, files, "manifest")


def op11_token_files(spark, folder: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{folder}/documents.parquet")
    manifest = token_files(documents, public_tokenizers.path("word_bpe_49k.json"), by_words=True)
    return read_files(manifest, crc_digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
