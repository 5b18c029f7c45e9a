"""Token files, fill-in-middle and ranked search: round trips, brute force, edge cases."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparktrail.llm import middle, ranked, tokenfile
from sparktrail.llm.textnum import byte_column

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
DIGEST = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

ROWS = [
    (5, "The cat, the DOG's 42 cats.", "x"),
    (2, "The cat, the DOG's 42 cats.", "x"),
    (2, "The cat, the DOG's 42 cats.", "x"),  # a repeated row
    (2, "another text of the same id", None),
    (None, "no id here, cat", ""),
    (None, "no id here, cat", ""),
    (1, None, None),
    (3, "", ""),
    (4, " \n\t", ""),
    (7, "Straße ÜBER <P> ␛ 中文 Éé<|endoftext|>", "y"),
    (6, "word cat " * 40_000, "long"),
]
COLUMNS = "doc_id bigint, text string, number string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).withColumn("row", F.lit(1)).withColumn("h0", F.lit("clash"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


# --- token files -------------------------------------------------------------


@given(
    st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3) | st.integers(0, 60_000), min_size=1, max_size=200), min_size=1, max_size=6)
)
@settings(max_examples=150, deadline=None)
def test_words_hold_any_ids(blocks):
    ids, sizes = np.array([i for b in blocks for i in b], np.uint64), np.array([len(b) for b in blocks])
    words, counts, raw = tokenfile.pack(ids, sizes)
    assert len(words) == counts.sum()
    assert tokenfile.unpack(words, sizes, counts, raw).tolist() == ids.tolist()
    # Any run of blocks is read by itself.
    edges = np.concatenate([[0], np.cumsum(counts)])
    one = tokenfile.unpack(words[edges[-2] :], sizes[-1:], counts[-1:], raw[-1:])
    assert one.tolist() == blocks[-1]


def test_small_ids_share_words():
    words, _, _ = tokenfile.pack(np.ones(600, np.uint64), np.array([600]))
    assert len(words) == 10


def test_pieces_of_words_give_the_ids_of_whole_texts():
    rng = random.Random(3)
    letters = [*"aZ .,;:!?()\"'sdt0129\n\t*-<|>_é́ñß½…— 中文ΣσİǅÅﬁ²³", "<|startoftext|>", "<|endoftext|>", "'s", "'re"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4000)]
    encoder = tokenfile.Encoder(PATH, by_words=True)
    ids, sizes = encoder(*byte_column(pa.array(texts)))
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == want
    whole, whole_sizes = tokenfile.Encoder(PATH, by_words=False)(*byte_column(pa.array(texts)))
    assert whole.tolist() == ids.tolist() and whole_sizes.tolist() == sizes.tolist()


def test_long_texts_are_read_in_slices(monkeypatch):
    monkeypatch.setattr(tokenfile, "CHUNK", 100)
    monkeypatch.setattr(tokenfile, "GROUP", 2 * tokenfile.BLOCK)
    text = np.frombuffer((" ".join(f"word{i}" for i in range(300)) + "x" * 500).encode(), np.uint8)
    parts = list(tokenfile._slices(text))
    assert len(parts) > 10 and np.concatenate(parts).tobytes() == text.tobytes()
    ids = np.arange(20_000, dtype=np.uint32)
    packed, counts, raw = tokenfile._pack_long(ids)
    sizes = tokenfile._block_sizes(np.array([len(ids)]))[0]
    assert tokenfile.unpack(np.frombuffer(packed, "<u8"), sizes, np.array(counts), np.array(raw)).tolist() == ids.tolist()


def brute_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out, start


@pytest.mark.parametrize(("by_words", "bytes_per_file"), [(True, 1 << 24), (False, 1 << 24), (True, 50)])
def test_token_files_against_brute_force(spark, docs, by_words, bytes_per_file):
    manifest = tokenfile.token_files(docs, PATH, by_words=by_words, bytes_per_file=bytes_per_file)
    rows = [tuple(r) for r in tokenfile.read_files(manifest, tokenfile.crc_digest, DIGEST).collect()]
    rows.sort(key=lambda r: r[1])
    want, total = brute_tokens(ROWS)
    assert sorted(map(str, ((i, n, c) for i, _, n, c in rows))) == sorted(map(str, want))
    assert [r[0] for r in rows] == [w[0] for w in want]  # ascending, nulls first
    starts = np.cumsum([0] + [r[2] for r in rows])
    assert [r[1] for r in rows] == starts[:-1].tolist() and starts[-1] == total


def test_documents_are_read_in_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "GROUP", 2 * tokenfile.BLOCK)
    writer = tokenfile._Writer(str(tmp_path), 0)
    texts = [np.arange(n, dtype=np.uint64) % 977 for n in (1, 0, 30_000, 7, 4096, 9000)]
    for k, ids in enumerate(texts):
        words, counts, raws = tokenfile._pack_long(ids) if len(ids) else (b"", [], [])
        writer.add(None if k == 3 else k, len(ids), words, np.array(counts, np.int64), np.array(raws, np.int64))
    (segment,) = writer.close()
    for first in range(len(texts)):
        found = [(i, n, np.concatenate([np.zeros(0, np.uint64), *p]).tolist()) for i, n, p in tokenfile._documents(segment[2], first, len(texts))]
        assert found == [(None if k == 3 else k, len(t), t.tolist()) for k, t in enumerate(texts)][first:]
    with pytest.raises(ValueError, match="no file"):
        (tmp_path / "bad").write_bytes(b"x" * 64)
        next(tokenfile._documents(str(tmp_path / "bad"), 0, 1))


def test_no_documents_no_files(empty):
    manifest = tokenfile.token_files(empty, PATH, by_words=True)
    assert manifest.count() == 0
    assert tokenfile.read_files(manifest, tokenfile.crc_digest, DIGEST).count() == 0


# --- fill in middle ----------------------------------------------------------


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, mid, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}")
    return (doc_id, n, "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}")


def test_middle_against_brute_force(spark, docs, empty):
    rng = random.Random(5)
    made = [(100 + k, "".join(rng.choices("ab é́中<>SPM\n.9", k=rng.randint(0, 60))), None) for k in range(300)]
    many = docs.select(*COLUMNS.replace(" bigint", "").replace(" string", "").split(", ")).union(spark.createDataFrame(made, COLUMNS))
    out = middle.fill_in_middle(many).withColumn("again", middle.restored(F.col("output"), F.col("form"))).collect()
    want = [brute_middle(i, t) for i, t, _ in [*ROWS, *made]]
    assert sorted(str(tuple(r)[:6]) for r in out) == sorted(map(str, want))
    assert sorted(r["again"] for r in out) == sorted(t or "" for _, t, _ in [*ROWS, *made])
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(empty).count() == 0
    assert middle.fill_in_middle(docs).count() == len(ROWS)


def test_long_texts_are_cut_in_slices(monkeypatch):
    monkeypatch.setattr(middle, "CHUNK", 64)
    rng = random.Random(6)
    for _ in range(30):
        text = "".join(rng.choice(["abc", "é", " ", "中", "x" * 150, "9"]) for _ in range(rng.randint(30, 200)))
        data = np.frombuffer(text.encode(), np.uint8)
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        one, other = rng.randint(0, 10**6), rng.randint(0, 10**6)
        n, pieces = middle._long(data, np.array([one]), np.array([other]))
        a, b = sorted((one % (len(units) + 1), other % (len(units) + 1)))
        assert n[0] == len(units)
        assert [p[0].as_py() for p in pieces] == ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]


# --- ranked search -----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, items, k=10):
    lowered = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(t or "")]
    docs = [(i, Counter(lowered(t))) for i, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, counts in docs:
            score = 0
            for t in lowered(text):
                if counts[t]:
                    m = 25 + 75 * sum(counts.values()) * n_docs // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item_id, r, d, -s) for r, (s, _, d) in enumerate(scored[:k], 1)]
    return out


def test_search_against_brute_force(spark, docs, empty, monkeypatch):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    rows = [(i, t) for i, t, _ in ROWS] + [(1000 - k, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for k in range(500)]
    rows += [(2000 + k, "w1 w2 W3") for k in range(40)]  # ties
    items = [(1, "w1 w2 w3 w1"), (2, None), (3, "???"), (None, "Cat cat word"), (4, "w5 w9 nothere w2"), (4, "w5 w9 nothere w2")]
    items += [(10 + k, " ".join(rng.choices(words, k=12))) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("number", F.lit("clash"))
    want = sorted(map(str, brute_search(rows, items)))
    assert sorted(str(tuple(r)) for r in ranked.ranked_search(frame, asked).collect()) == want
    monkeypatch.setattr(ranked, "ITEMS", 5)  # several passes
    assert sorted(str(tuple(r)) for r in ranked.ranked_search(frame, asked).collect()) == want
    assert ranked.ranked_search(docs, asked).count() > 0
    assert ranked.ranked_search(empty, asked).count() == 0
    assert ranked.ranked_search(frame, empty.selectExpr("doc_id AS item_id", "text")).count() == 0


def test_block_search_opens_few_intervals(monkeypatch):
    """In one block: results as from scoring all, for any batch and interval size, and most documents untouched."""
    rng = np.random.default_rng(4)
    n_docs, n_terms = 4000, 30
    lists = [np.flatnonzero(rng.random(n_docs) < 0.3 / (t + 1)) for t in range(n_terms)]
    sizes, docs = np.array([len(x) for x in lists]), np.concatenate(lists)
    impacts = (rng.pareto(1.0, len(docs)) * 100).astype(np.int64) + 1
    table = ranked.Lists(sizes, docs, impacts, n_docs)
    items = ranked.Items(["t0 t3 t5 t5", "t1 t2", "t20", "none"])
    place = {f"t{k}": k for k in range(n_terms)}
    present = np.array([place.get(t, -1) for t in items.vocabulary])
    ids = np.arange(n_docs) * 3
    want = []
    for number, text in enumerate(["t0 t3 t5 t5", "t1 t2", "t20"]):
        score = np.zeros(n_docs, np.int64)
        for t in text.split():
            here = np.repeat(np.arange(n_terms), sizes) == place[t]
            np.add.at(score, docs[here], impacts[here])
        top = np.lexsort((ids, -score))[:10]
        want += [(number, int(ids[d]), int(score[d])) for d in top if score[d] > 0]
    for short, pairs in ((16, 1 << 20), (1, 64), (300, 1)):
        monkeypatch.setattr(ranked, "SHORT", short)
        monkeypatch.setattr(ranked, "PAIRS", pairs)
        best = ranked.Best(4, 10)
        scored = ranked.search_block(table, ids, items.of_block(present), best)
        assert list(zip(best.item.tolist(), best.doc_id.tolist(), best.score.tolist(), strict=True)) == want
        assert short > 100 or scored < n_docs / 2


def test_blocks_do_not_depend_on_the_batches_of_texts(monkeypatch):
    """Texts of small batches meet in one block, those of a large batch are held in blocks only."""
    monkeypatch.setattr(ranked, "BLOCK", 100)
    rng = random.Random(12)
    rows = [(k, "x" * rng.choice([0, 1, 9, 30, 70, 100, 250])) for k in range(300)] + [(300, None)]
    whole = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    for size in (1, 7, 301):
        blocks = list(ranked._texts_of_blocks(whole.slice(k, size) for k in range(0, 301, size)))
        assert [tuple(r.values()) for b in blocks for r in b.to_pylist()] == rows
        lengths = [[len(t or "") for t in b.column(1).to_pylist()] for b in blocks]
        assert all(sum(x) <= 100 or len(x) == 1 for x in lengths)
        assert all(sum(x) + y[0] > 100 for x, y in zip(lengths, lengths[1:]))


def test_search_is_the_same_in_small_parts_and_holds_little(spark, docs, monkeypatch):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.6)) % 100_000}" for _ in range(20_000)]
    rows = [" ".join(rng.choices(words, k=500)) for _ in range(1200)]
    data, offsets = np.frombuffer("".join(rows).encode(), np.uint8), np.cumsum([0] + [len(r) for r in rows])
    tracemalloc.start()
    ranked._postings(data, offsets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 15 * len(data)
    asked = docs.selectExpr("doc_id AS item_id", "text")
    want = sorted(map(str, ranked.ranked_search(docs, asked).collect()))
    monkeypatch.setattr(ranked, "SLICE", 20)
    monkeypatch.setattr(ranked, "PART", 1)
    assert sorted(map(str, ranked.ranked_search(docs, asked).collect())) == want


def test_long_text_has_the_postings_of_its_slices(monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 50)
    text = " ".join(["Éa", "b9", "C", "x" * 120, "é"] * 30)
    terms, sizes, rows, counts = ranked._long_postings(np.frombuffer(text.encode(), np.uint8))
    assert dict(zip(terms.to_pylist(), counts.tolist(), strict=True)) == {"Éa": 30, "b9": 30, "c": 30, "x" * 120: 30, "é": 30}
    assert sizes.tolist() == [1] * 5 and not rows.any()
