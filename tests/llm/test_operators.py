"""Edge cases, brute force and SQL for the corpus operators."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparktrail.llm import chat, decontaminate, jaccard, linecrf, linededup, mixing, quality, queries, rules, sharding, spans, surrogates
from sparktrail.plans.check import compare

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i}" for i in range(60)) + "."
STORY = ". ".join(" ".join(f"s{k}x{i}" for i in range(9)) for k in range(8)) + "."

ROWS = [
    (1, LONG, "en", "a", 1, "x"),
    (2, LONG, "en", "a", 1, None),
    (2, LONG, "en", "a", 1, None),  # a repeated row
    (3, None, None, None, None, None),
    (4, "", "en", "b", 0, ""),
    (5, " \n\t", "de", "b", 3, ""),
    (None, LONG + " more", "en", None, 9, ""),
    (6, "word " * 30_000, "en", "b", 9, ""),
    (7, "Straße ÜBER ␛ </s>\nÉé", "de", "c", 9, ""),
]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, pos string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, LONG), (2, None), (3, "!!"), (None, "über straße"), (1, LONG), (4, "straße Über")]
    return spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, data, name):
    ok, note = compare(queries.QUERIES[name](spark, data), queries.ORACLES[name], data)
    assert ok, note


def test_every_row_is_answered(spark, docs, empty, bench):
    model = linecrf.NEUTRAL
    runs = {
        "spans": lambda d: spans.remove_repeats(d),
        "shards": lambda d: sharding.place(d, F.col("doc_id"), ["a", "b"], 11),
        "lines": lambda d: linededup.apply_bitmaps(d, linededup.keep_bitmaps(d)),
        "jaccard": lambda d: jaccard.jaccard_components(d),
        "surrogates": lambda d: surrogates.pseudonymize(d),
        "quality": lambda d: quality.quality_scores(d, model),
        "rules": lambda d: rules.judge(d, model),
        "benchmark": lambda d: decontaminate.contamination(d, bench),
    }
    for name, run in runs.items():
        assert run(docs).count() == len(ROWS), name
        assert run(empty).count() == 0, name


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_copies():
    """A family of edited copies, chains at the threshold, copies, and texts that share a passage."""
    base = [f"b{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for k in range(1, 25):
        words = list(base)
        for j in range(k % 5 + 1):
            words[(7 * k + 19 * j) % 100] = f"e{k}_{j}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(base[4 * k :] + [f"t{i}" for i in range(4 * k)])) for k in range(8)]
    rows += [(200 + k, f"only{k} " + LONG) for k in range(40)] + [(300, LONG), (301, LONG.upper()), (302, "a b"), (303, "A B"), (304, None)]
    return rows


def test_jaccard_against_brute_force(spark, monkeypatch):
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(rows)
    for short, sets, columns in ((32, 512, 400_000), (2, 8, 500)):  # also many small blocks
        monkeypatch.setattr(jaccard, "SHORT_LIST", short)
        monkeypatch.setattr(jaccard, "BLOCK_SETS", sets)
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", columns)
        monkeypatch.setattr(jaccard, "FAMILY_SETS", columns // 100)
        answers = jaccard.jaccard_components(frame).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in answers} == want
        assert {r.doc_id: r.n_links for r in answers} == brute_links(rows)


def brute_links(rows):
    sets = {i: shingles(t) for i, t in rows}
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    return {i: sum(bool(a) and i != j and alike(a, b) for j, b in sets.items()) for i, a in sets.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=25), min_size=1, max_size=25))
def test_derived_overlaps(drawn):
    arrays = [np.array(sorted(s), np.uint64) for s in drawn]
    assert jaccard.overlaps(arrays).tolist() == [[len(a & b) for b in drawn] for a in drawn]


def test_jaccard_moves_few_texts_that_no_family_asks_for(spark, monkeypatch):
    rows = near_copies() + [(1000 + k, f"alone{k} " + " ".join(f"x{k}_{i}" for i in range(30))) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    likely, moved = jaccard._likely, []

    def counted(*args):
        kept = likely(*args)
        moved.append(kept.count())
        return kept

    monkeypatch.setattr(jaccard, "_likely", counted)
    answers = jaccard.jaccard_components(frame).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in answers} == brute_components(rows)
    assert 25 <= moved[0] < 100 < len(rows)
    keys = spark.createDataFrame([(k, str(k)) for k in range(2000)] + [(None, "x")], "a bigint, b string")
    for words in (1, 1 << 18):
        monkeypatch.setattr(jaccard, "BITMAP_WORDS", words)
        wanted = keys.filter("a % 4 = 0 OR a IS NULL").selectExpr("a AS c", "b AS d")
        kept = likely(keys, F.xxhash64("a", "b"), wanted, F.xxhash64("c", "d"))
        assert kept.columns == keys.columns and kept.filter("a % 4 = 0 OR a IS NULL").count() == 501
        assert kept.count() < 510 or words == 1


def test_jaccard_keeps_one(spark, docs, empty):
    kept = [r.doc_id for r in jaccard.keep_one_per_component(docs).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 3, 4, 5, 6, 7]
    assert jaccard.keep_one_per_component(docs).columns == docs.columns
    assert jaccard.keep_one_per_component(empty).count() == 0


def test_jaccard_keeps_one_of_repeats(spark):
    other = STORY.replace(".", "")
    rows = [(1, LONG, 1), (1, LONG, 1), (1, LONG, 2), (1, LONG + " more", 3), (2, LONG, 4), (None, LONG, 5)]
    rows += [(None, other, 6), (None, other, 6), (None, other + " more", 7), (8, "", 8), (8, "", 8), (None, None, 9)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, `Rows` int, _text_hash string")
    kept = jaccard.keep_one_per_component(frame)
    assert kept.columns == frame.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 5 and sum(i == 1 for i, _ in got) == 1 and got.count((8, "")) == 2 and (None, None) in got
    assert sum(i is None and bool(t) for i, t in got) == 1


def test_clashing_names(spark, bench):
    clash = "text_hash string, _slot string, slot int, _TEXT_HASH string"
    frame = spark.createDataFrame([(1, LONG, "a", "b", 5, "c"), (None, None, "a", "b", 5, "c")], "doc_id bigint, text string, " + clash)
    clean = decontaminate.drop_contaminated(frame, bench)
    assert clean.columns == frame.columns and [r.doc_id for r in clean.collect()] == [None]
    placed = sharding.place(frame, F.col("doc_id"), ["a", "b"], 11)
    assert set(placed.columns) == {*frame.columns, "shard"} and placed.count() == 2


def test_the_fit_does_not_depend_on_repeated_rows(spark):
    good, bad = "A fine sentence stands here today.", "||| ### $$$ ||| ###"
    rows = [(i, good if i % 2 else bad) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    fits = [
        linecrf.fit_on_sample(spark.createDataFrame(taken, "doc_id bigint, text string"), labels, max_documents=12)
        for taken in (rows, rows * 3, [*rows, *((i, t + "~") for i, t in rows)])
    ]
    for one in fits[1:]:
        assert np.allclose(one.weights, fits[0].weights) and np.allclose(one.moves, fits[0].moves)
    long = spark.createDataFrame([(1, "a\nb\nc")], "doc_id bigint, text string")
    assert linecrf.fit_on_sample(long, labels, max_lines=2) is linecrf.NEUTRAL


def test_repeated_passages_go(spark):
    own = lambda k: ". ".join(" ".join(f"o{k}n{j}w{i}" for i in range(8)) for j in range(5)) + "."
    rows = [(3, f"{own(3)} {STORY} end"), (1, f"{STORY}\n{own(1)}"), (2, f"{own(2)}\n{STORY}\n{STORY}"), (4, own(4))]
    got = {r.doc_id: r for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].text == rows[1][1] and got[1].n_removed == 0 and got[4].n_removed == 0
    assert "s3x0" not in got[2].text and "s3x0" not in got[3].text
    assert all(f"o{k}n3w2" in got[k].text for k in (1, 2, 3, 4))


def brute_repeats(rows):
    """Numbers of the removed sentences of each text, from all runs of sentences that end with a full stop."""
    seen, gone = set(), {}
    for doc_id, text in sorted(rows):
        cut = [s.split() for s in text.split(".") if s.strip()]
        gone[doc_id] = set()
        for a in range(len(cut)):
            for b in range(a + 2, len(cut) + 1):
                run = tuple(map(tuple, cut[a:b]))
                if sum(map(len, run)) >= 20:
                    gone[doc_id] |= set(range(a, b)) if run in seen else set()
                    seen.add(run)
    return gone


def test_repeats_against_all_runs(spark):
    rng = random.Random(3)
    count = iter(range(10**6))
    story = lambda sizes: [" ".join(f"q{next(count)}" for _ in range(n)) for n in sizes]
    passages = [story(rng.choice([1, 2, 3, 5, 8, 12, 15]) for _ in range(rng.randint(2, 9))) for _ in range(30)]
    passages.append(story([15, 8, 5]))
    rows = [(k, ". ".join(passages[-1]) + ".") for k in (1, 2)]
    for k in range(3, 60):
        parts = [p for q in rng.choices(passages, k=3) for p in (q[rng.randint(0, 2) :], story([rng.randint(1, 14)]))]
        rows.append((k, ". ".join(s for p in parts for s in p) + "."))
    want = brute_repeats(rows)
    got = spans.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for doc_id, text in rows:
        cut = [s for s in text.split(".") if s.strip()]
        left = next(r.text for r in got if r.doc_id == doc_id)
        assert [s.strip() for s in left.split(".") if s.strip()] == [s.strip() for i, s in enumerate(cut) if i not in want[doc_id]]


def test_repeats_without_sentence_ends(spark):
    rng = random.Random(5)
    count = iter(range(10**6))
    stream = lambda n: " ".join(f"u{next(count)}" for _ in range(n))
    passages = [stream(51) for _ in range(200)]  # the middle word of each must go from the second copy
    rows = [(k, " ".join(f"{stream(rng.randint(0, 40))} {p} {stream(rng.randint(0, 40))}" for p in passages)) for k in (1, 2)]
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    chinese, ended, thai = han(300), "。".join(han(9) for _ in range(8)) + "。", "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(200))
    rows += [(3, chinese), (4, f"{han(50)}{chinese}{han(50)}"), (5, ended), (6, f"{han(5)}。{ended}{han(5)}"), (7, thai), (8, thai)]
    rows += [(9, "Kurz und gut"), (10, "kurz und  gut"), (11, "kurz und gut genug"), (12, "短"), (13, "短")]
    hindi = " ".join(" ".join(f"क{k}ख{i}" for i in range(7)) + "।" for k in range(6))
    rows += [(14, hindi), (15, f"एक।{' '}{hindi}")]
    got = {r.doc_id: r.text for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[k] == dict(rows)[k] for k in (1, 3, 5, 7, 9, 11, 12, 14))
    left = set(got[2].split())
    assert not [p for p in passages if p.split()[25] in left]
    assert chinese[20:-20] not in got[4] and len(got[4]) < 100 + 2 * 16 and got[4].startswith(rows[3][1][:30])
    assert len(got[6]) == 11 and got[8] == got[10] == got[13] == "" and got[15].strip() == "एक।"


def test_line_dedup_keeps_the_largest_id(spark):
    line = "x" * 45
    rows = [(i, f" {line.upper()}\nown{i}\n{line}") for i in range(5)] + [(9, "x" * 39), (10, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in linededup.apply_bitmaps(frame, linededup.keep_bitmaps(frame)).collect()}
    assert [got[i].kept for i in range(4)] == [f"own{i}" for i in range(4)]
    assert got[4].kept == rows[4][1] and [tuple(r) for r in got[0].keep_runs] == [(1, 1)]
    assert (got[10].n_lines, got[10].n_dropped, got[10].kept) == (1, 0, "")


def test_decontamination_of_edges(spark, docs, bench):
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect() if r.doc_id != 2}
    assert got[1].n_hit == got[1].n_words == 60 and got[1].items == [1] and got[1].contaminated
    assert got[3].n_words == 0 and not got[3].contaminated
    kept = [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()]
    assert 1 not in kept and 2 not in kept and {3, 4, 5, 6} <= set(kept)
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(docs, decontaminate.contamination(docs, bench)).collect()}
    assert cut[1] == "" and cut[4] == ""


def test_shards_take_turns():
    names = sharding.shard_names(7)
    table = sharding.lookup_table(names, 701)
    counts = collections.Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1 and -1 not in counts
    fewer = sharding.lookup_table(names[:-1], 701)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 701 * 0.2
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 700)


def test_budgets_pass_to_siblings_first(spark):
    leaves = [("d1", "en", "a", 10), ("d1", "en", "b", 1000), ("d1", "de", "c", 1000), ("d2", "en", "d", 1000)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    got = {r.source: r.allotted for r in mixing.allot(frame, 800, 1, weight=lambda name: F.lit(1).cast("long")).collect()}
    assert got == {"a": 10, "b": 190, "c": 200, "d": 400}


def test_mix_edges(spark, docs, empty):
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty, 50).columns == empty.columns
    everything = mixing.mix(docs, budget=10**9, max_epochs=1).collect()
    assert all(r.taken == r.n_tokens and r.epoch == 0 for r in everything)
    assert {r.doc_id for r in everything} == {1, 2, None, 6, 7}


def test_surrogates(spark):
    text = 'Herr Müller Mr Иванов a.b@x.org a.b@x.org +1 (499) 555-6503 4111111111111111 4111111111111112 10.1.2.3 token = "0123456789abcdef"'
    frame = spark.createDataFrame([(1, text), (2, "mail a.b@x.org, Frau Müller")], "doc_id bigint, text string")
    one, two = (r for r in surrogates.pseudonymize(frame).orderBy("doc_id").collect())
    for secret in ("Müller", "Иванов", "a.b@x.org", "499", "4111111111111111", "10.1.2.3", "0123456789abcdef"):
        assert secret not in one.text
    assert "4111111111111112" in one.text  # no valid card number
    mails = re.findall(r"\S+@\S+\.example", one.text + " " + two.text)
    assert len({m.rstrip(",") for m in mails}) == 1 and len(mails) == 3
    assert re.search(r"Mr [А-Я][а-я]+ ", one.text) and re.search(r"token = \"[0-9a-f]{16}\"", one.text)
    assert one.kinds == ["card", "email", "ip", "name", "phone", "secret"] and two.n_entities == 2


def test_surrogates_of_other_spellings(spark):
    rows = [
        (1, "Mr John Smith called. John Smith left. Smith's car, Smith-led. Smithson stays. Mr Smith and Dr. John Smith"),
        (2, "A.B@x.org a.b@X.org"),
        (3, "+1 (499) 555-6503 +14995556503 499-555-6503 (499) 555-6503."),
        (4, "415-555-2671 or (415) 555-2671; 030 12345678; 01 23 45 67 89; 020 7946 0958"),
        (5, "4111 1111 1111 1111 4111111111111111 4111-1111-1111-1111"),
        (6, "Herr Dr. Meier, Sra. Lopez, M. Dupont, Prof. Weber, Mme Dubois; Meier"),
        (7, "on 01-02-2024 at 12:30, 123-45-6789, 1234567890"),
    ]
    made = surrogates.pseudonymize(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = {r.doc_id: r.text for r in made}
    given, family = re.match(r"Mr (\w+) (\w+) called", got[1]).groups()
    assert got[1] == rows[0][1].replace("Smithson", "@").replace("John", given).replace("Smith", family).replace("@", "Smithson")
    assert {given, family}.isdisjoint({"John", "Smith"})
    assert len(set(got[2].split())) == 1 and "x.org" not in got[2].lower()
    ten = [re.sub(r"\D", "", m)[-10:] for m in re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1\d{10}|\d{3}-\d{3}-\d{4}|\(\d{3}\) \d{3}-\d{4}", got[3])]
    assert len(ten) == 4 and len(set(ten)) == 1 and ten[0] != "4995556503"
    for phone in ("415-555-2671", "(415) 555-2671", "030 12345678", "01 23 45 67 89", "020 7946 0958"):
        assert phone not in got[4]
    assert re.fullmatch(r"(\d{3})-(\d{3})-(\d{4}) or \(\1\) \2-\3; 0\d\d \d{8}; 0\d( \d\d){4}; 0\d\d \d{4} \d{4}", got[4])
    assert re.fullmatch(r"(\d{4}) (\d{4}) (\d{4}) (\d{4}) \1\2\3\4 \1-\2-\3-\4", got[5]) and "4111" not in got[5]
    assert not re.search("Meier|Lopez|Dupont|Weber|Dubois", got[6]) and got[6].startswith("Herr Dr. ")
    assert got[7].startswith("on 01-02-2024 at 12:30, ") and got[7].endswith(", 1234567890") and "123-45-6789" not in got[7]


def test_colliding_surrogates_draw_again(spark, monkeypatch):
    # All first and second draws are equal: only the third tells the values apart.
    real = surrogates.surrogate
    monkeypatch.setattr(
        surrogates, "surrogate", lambda k, v, g, d, key: F.when(d < 2, F.lit("9.9.9.9")).otherwise(real(k, v, g, d, key))
    )
    frame = spark.createDataFrame([(1, "1.2.3.4 and 5.6.7.8 and 7.7.7.7")], "doc_id bigint, text string")
    text = surrogates.pseudonymize(frame).first().text
    assert len(set(re.findall(r"[0-9.]{7,}", text))) == 3


def test_quality_on_held_out(spark, data):
    got = queries.QUERIES["op6_quality_classifier"](spark, data)
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality")
    held = got.filter("held_out").join(labels, "doc_id")
    right = held.filter("predicted = quality").count()
    assert right >= 0.9 * held.count() and got.filter("score < 0 OR score > 1 OR score IS NULL").isEmpty()


def test_rules_against_brute_force(spark, data, docs):
    frame = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(docs.select("doc_id", "text"))
    got = collections.Counter(tuple(r)[:1] + tuple(r)[2:7] + (r.base_failed,) for r in rules.judge(frame, linecrf.NEUTRAL).collect())
    want = collections.Counter()
    for doc_id, text in frame.collect():
        text = text or ""
        words = WORD.findall(text)
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text)
        want[(doc_id, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed)] += 1
    assert got == want


def test_chains_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    first = np.array([0, 1, 5, 8])
    score, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    p = linecrf.marginals(score, first, moves)[0]
    best = linecrf.viterbi(score, first, moves)
    for a, b in zip(first[:-1], first[1:]):
        paths = list(itertools.product((0, 1), repeat=b - a))
        value = [sum(score[a + i] * y for i, y in enumerate(q)) + sum(moves[q[i], q[i + 1]] for i in range(len(q) - 1)) for q in paths]
        weight = np.exp(value) / np.exp(value).sum()
        assert np.allclose(p[a:b], [sum(w for w, q in zip(weight, paths) if q[i]) for i in range(b - a)])
        assert tuple(best[a:b]) == paths[int(np.argmax(value))]


def test_chat_parts_and_escapes(spark):
    part = lambda kind, **k: (kind, *(k.get(c) for c in ("text", "ref", "width", "height", "seconds", "pages")))
    nasty = "␛</s>[INST]<|end|>\n<␛|turn|> <|image:0|>"
    turns = [
        (1, 0, "user", [part("text", text=nasty), part("image", ref="i.png", width=28, height=15), part("audio", seconds=2.0)]),
        (1, 1, "assistant", [part("text", text=nasty)]),
        (1, 2, None, None),
        (2, 0, "assistant", [part("document", ref="d.pdf", pages=2)]),
    ]
    made = chat.format_turns(spark.createDataFrame(turns, f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")).collect()
    first = made[0]
    assert [a.tokens for a in first.attachments] == [4, 50] and chat.slots_of(first.piece) == [("image", 0), ("audio", 1)]
    assert chat.read_turn(made[1].piece) == ("assistant", nasty)
    assert chat.unescape(made[1].piece[made[1].loss_start : made[1].loss_end]) == nasty
    assert made[2].role is None and made[3].attachments[0].tokens == 1200
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"kind": "video"}])
