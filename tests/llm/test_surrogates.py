"""Surrogates over a table: distinctness, coreference and format, with few and with many exceptions."""

import re

import pytest
from pyspark.sql import functions as F

from sparktrail.llm import surrogates

KINDS = {
    "email": [f"user{k}@site{k % 7}.org" for k in range(60)],
    "ip": [f"10.{k // 9}.{k % 9}.{k}" for k in range(60)],
    "phone": [f"+1 (499) 555-{6500 + k}" for k in range(60)],
    "name": [f"Mr {chr(65 + k % 26)}nna{'abcdef'[k // 26]} {chr(65 + k // 3)}ergs" for k in range(60)],
}


def texts():
    """Every value in two documents, spelled in two ways, among words that must stay."""
    for k, values in enumerate(zip(*KINDS.values(), strict=True)):
        email, ip, phone, name = values
        yield 2 * k, f"see {email} at {ip} or {phone} for {name} now"
        yield 2 * k + 1, f"see {email.upper()} at {ip} or {phone.replace(' ', '')} for {name} now"
    yield 1000, "nothing here"
    yield None, None


FORM = re.compile(r"see (\S+@\S+\.example) at (\d+\.\d+\.\d+\.\d+) or (\+1 ?\(\d{3}\) ?\d{3}-\d{4}) for Mr (\w+) (\w+) now", re.IGNORECASE)


@pytest.mark.parametrize("taken", [False, True])
def test_distinct_and_the_same_everywhere(spark, monkeypatch, taken):
    real = surrogates.surrogate
    if taken:  # a small room: nearly every first draw is taken

        def crowded(kind, value, gender, draw, key):
            few = real(kind, F.substr(value, F.length(value)), gender, F.lit(0), key)
            room = F.when(kind == "ip", F.concat_ws(".", *(F.pmod(F.xxhash64(value), F.lit(5)).cast("string") for _ in range(4))))
            return F.when((draw == 0) & kind.isin("ip", "given"), F.coalesce(room, few)).otherwise(real(kind, value, gender, draw, key))

        monkeypatch.setattr(surrogates, "surrogate", crowded)
    frame = spark.createDataFrame(list(texts()), "doc_id bigint, text string").withColumn("special", F.lit("clash"))
    few = surrogates.pseudonymize(frame)
    rows = few.collect()
    if taken:
        many = surrogates.pseudonymize(frame, broadcast_exceptions=0)
        assert sorted(map(str, rows)) == sorted(map(str, many.collect()))
    got = {r.doc_id: r.text for r in rows}
    assert got[None] is None and got[1000] == "nothing here"
    maps = [{}, {}, {}, {}, {}]
    for k, values in enumerate(zip(*KINDS.values(), strict=True)):
        given, family = values[3].removeprefix("Mr ").split()
        for doc in (2 * k, 2 * k + 1):
            made = FORM.fullmatch(got[doc])
            assert made, got[doc]
            parts = [made[1].lower(), made[2], re.sub(r"\D", "", made[3]), made[4], made[5]]
            for seen, old, new in zip(maps, (values[0], values[1], values[2], given, family), parts, strict=True):
                assert seen.setdefault(old, new) == new and new != old
    for seen in maps:
        assert len(set(seen.values())) == len(seen)


def test_names_grow_with_every_draw(spark):
    made = spark.range(30).select(
        F.length(surrogates.surrogate(F.lit("given"), F.lit("Anna"), F.lit(1), F.col("id").cast("int"), b"k")).alias("n")
    )
    lengths = [r.n for r in made.collect()]
    assert len(set(lengths[:6])) == 1 and lengths[6:] == list(range(lengths[0] + 2, lengths[0] + 2 + 2 * 24, 2))


def test_no_rows(spark):
    assert surrogates.pseudonymize(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
