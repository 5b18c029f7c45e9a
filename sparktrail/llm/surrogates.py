"""Surrogates for personal data.

Detected entities are replaced by keyed surrogates of the same type and format: digits
become digits, letters letters of the same case and script, card numbers keep a valid
check digit, addresses stay addresses, and a titled name becomes a name of the title's
gender in the script of the original. A surrogate depends on the key, the type and the
normalised value only, so one person is one surrogate in all documents (coreference):
numbers count by their digits, e-mails in lower case, and given and family names apart.
Where a document names a person by title, bare mentions of the name go as well.

Distinctness is checked over the whole corpus: distinct values are gathered by type, and
where two would share a surrogate, or a surrogate is itself a real value, all but one
draw again. Those exceptions are a constant of the plan, an array of buckets, in which the
values are looked up where the text is read; every other replacement is computed there, and no text moves.
Beyond a limit of exceptions, texts with entities alone are joined to theirs. All of it is
built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail.functions.masking import hmac_sha256
from sparktrail.llm.common import bounded, only, row_hash
from sparktrail.session import materialize

#: Key of the registered query; a deployment passes its own.
KEY = b"surrogate-key"
#: Draws before the job gives up, and from which draw on a value gets longer.
MAX_DRAWS = 40
LONGER_AFTER = 6
#: Most exceptions that go along with the plan, and into how many buckets.
BROADCAST_EXCEPTIONS = 200_000
BUCKETS = 4096

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_MALE = r"Mr|Sir|Lord|Herr|Hr\.|Señor|Sr|Don|Monsieur|M\.|Signor|Sig|господин|г-н|κύριος|κος|κ\."
_FEMALE = r"Mrs|Ms|Miss|Madam|Lady|Frau|Fr\.|Señora|Señorita|Sra|Srta|Doña|Madame|Mademoiselle|Mme|Mlle|Signora|госпожа|г-жа|κυρία|κα"
_TITLE = rf"(?:{_FEMALE}|{_MALE}|Mx|Dr|Doctor|Prof|Professor|доктор|профессор)(?!\p{{L}})\.?"
#: A word of a name; a possessive s is none of it.
_NAME_WORD = r"\p{Lu}(?:\p{L}|['’-](?!s(?!\p{L}))(?=\p{L}))*+"
#: Phone numbers without a country: North American ones, and those that begin with 0.
_NATIONAL = (
    r"(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}"
    r"|0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})"
    r"|\(0[1-9][0-9]{1,4}\) ?[0-9]{3,4}[ -]?[0-9]{3,5}|0[1-9][0-9]{1,4}[ /-][0-9]{6,8}|0[1-9][0-9]{1,3}[ -][0-9]{3,4}[ -][0-9]{3,4}"
)
#: One pattern per type, tried in this order where several begin at one place.
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9_])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?+[\x20\t]*+[=:][\x20\t]*+[\"']?+[A-Za-z0-9_./+=-]{8,}+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone": r"(?<![\w+])\+(?:1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{11,15})(?![0-9])"
    r"|(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
    rf"|(?<![\w+.,/:(-])(?:{_NATIONAL})(?![\w-]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}"
    r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLE} )++(?!{_TITLE}){_NAME_WORD}(?: (?!{_TITLE}){_NAME_WORD})?+",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_GATE = rf"[0-9@]|{_TITLE} |(?:secret|password|passwd|token|key)"

#: What a phone number's digits begin with and keep.
_COUNTRY = "0|[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

#: Name syllables by script; a surrogate is made of two or three.
_SYLLABLES = {
    "latin": "ba be bo da de do ga ka la le lo ma me mo na ne no ra re ro sa se so ta te to va".split(),
    "cyrillic": "ба бе бо да де до ка ла ле ло ма ме мо на не но ра ре ро са се со та те то ва".split(),
    "greek": "βα βε βο δα δε δο κα λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το".split(),
}
_ENDINGS = {"latin": ("n", "lia"), "cyrillic": ("н", "лия"), "greek": ("ν", "λια")}


def kind_of(match: Column) -> Column:
    """Type of a match of PATTERN; null for what only looks like an entity."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    out = F.when(match.rlike(f"^(?:{PATTERNS['secret']})$"), "secret").when(F.contains(match, F.lit("@")), "email")
    out = out.when(F.startswith(match, F.lit("+")), "phone").when(match.rlike(f"^(?:{_NATIONAL})$"), "phone")
    out = out.when(match.rlike("^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$"), "iban")
    out = out.when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(match.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip")
    out = out.when(match.rlike(r"^[0-9][0-9 -]+$") & F.call_function("luhn_check", digits), "card")
    return out.when(match.rlike(f"^{_TITLE} "), "name")


def value_of(match: Column, kind: Column) -> Column:
    """The identifying part: a secret without its label, a name without its title, else the match."""
    secret = F.regexp_extract(match, r"[=:][\x20\t]*+[\"']?+([A-Za-z0-9_./+=-]+)$", 1)
    name = F.regexp_replace(match, f"^(?:{_TITLE} )+", "")
    return F.when(kind == "secret", secret).when(kind == "name", name).otherwise(match)


def gender_of(match: Column) -> Column:
    return F.when(match.rlike(rf"^(?:{_TITLE} )*?(?:{_FEMALE})(?!\p{{L}})"), 1).otherwise(0)


def normal_of(value: Column, kind: Column) -> Column:
    """What all spellings of a value share. A North American phone number gets its country."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    abroad = F.startswith(value, F.lit("+")) | F.startswith(digits, F.lit("0"))
    out = F.when(kind == "email", F.lower(value)).when(kind == "card", digits)
    out = out.when(kind == "phone", F.when(abroad, digits).otherwise(F.concat(F.lit("1"), digits)))
    return out.when(kind == "iban", F.regexp_replace(value, " ", "")).otherwise(value)


def parts_of(match: Column) -> Column:
    """``kind, value, gender`` of what a match is made of: given and family name, or one normalised value."""
    kind = kind_of(match)
    value = value_of(match, kind)
    part = lambda k, v, g: F.struct(k.alias("kind"), v.alias("value"), g.alias("gender"))
    given = part(F.lit("given"), F.regexp_extract(value, "^[^ ]+", 0), gender_of(match))
    family = part(F.lit("family"), F.regexp_extract(value, "[^ ]+$", 0), F.lit(0))
    names = F.when(F.contains(value, F.lit(" ")), F.array(given, family)).otherwise(F.array(family))
    return F.when(kind == "name", names).when(kind.isNotNull(), F.array(part(kind, normal_of(value, kind), F.lit(0))))


def _digest(kind: Column, value: Column, draw: Column, block: Column, key: bytes) -> Column:
    return hmac_sha256(F.concat_ws("\x1f", kind, value, draw.cast("string"), block.cast("string")), key)


def _stream(kind: Column, value: Column, draw: Column, key: bytes) -> Column:
    """Keyed hex digits, two for every character of the value and some more."""
    blocks = F.sequence(F.lit(0), F.ceil(F.length(value) / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: _digest(kind, value, draw, b, key)), "")


def _number(stream: Column, at: Column) -> Column:
    """The byte for position ``at``."""
    return F.conv(F.substr(stream, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _same_shape(value: Column, stream: Column) -> Column:
    """Every ASCII digit and letter replaced by one of its class; the rest stays."""

    def one(c, i):
        n = _number(stream, i)
        letter = lambda first: F.char(F.lit(first) + n % 26)
        out = F.when(c.between("0", "9"), (n % 10).cast("string"))
        return out.when(c.between("A", "Z"), letter(65)).when(c.between("a", "z"), letter(97)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(value: Column) -> Column:
    """``value`` with its last digit set so that the check passes."""
    head = F.substr(value, F.lit(1), F.length(value) - 1)
    digits = F.reverse(F.regexp_replace(head, "[^0-9]", ""))

    def weigh(d, i):
        twice = d.cast("int") * 2
        return F.when(i % 2 == 1, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(F.split(digits, ""), weigh), F.lit(0), lambda a, x: a + x)
    return F.concat(head, ((10 - total % 10) % 10).cast("string"))


def _address(stream: Column) -> Column:
    first = 1 + _number(stream, F.lit(0)) % 223
    return F.concat_ws(".", first.cast("string"), *(_number(stream, F.lit(k)).cast("string") for k in (1, 2, 3)))


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name(kind: Column, value: Column, gender: Column, stream: Column, draw: Column) -> Column:
    def made(script: str) -> Column:
        table = F.array(*(F.lit(s) for s in _SYLLABLES[script]))
        endings = F.array(*(F.lit(e) for e in _ENDINGS[script]))
        pick = lambda k: F.element_at(table, 1 + _number(stream, F.lit(k)) % len(_SYLLABLES[script]))
        # Every further draw adds a syllable, so names never run out.
        extra = F.sequence(F.lit(7), F.greatest(draw - LONGER_AFTER, F.lit(0)) + 7)
        more = F.when(draw >= LONGER_AFTER, F.array_join(F.transform(extra, lambda k: F.element_at(table, 1 + _number(stream, k) % len(_SYLLABLES[script]))), ""))
        more = F.coalesce(more, F.lit(""))
        given = F.initcap(F.concat(pick(0), pick(1), pick(2), more, F.element_at(endings, gender + 1)))
        family = F.initcap(F.concat(pick(3), pick(4), pick(5), pick(6), more))
        return F.when(kind == "given", given).otherwise(family)

    script = _script(value)
    return F.when(script == "cyrillic", made("cyrillic")).when(script == "greek", made("greek")).otherwise(made("latin"))


def surrogate(kind: Column, value: Column, gender: Column, draw: Column, key: bytes) -> Column:
    stream = _stream(kind, value, draw, key)
    shaped = _same_shape(value, stream)
    longer = F.when(draw >= LONGER_AFTER, F.substr(stream, F.lit(1), F.lit(12))).otherwise("")
    at = F.instr(shaped, "@")
    email = F.concat(F.substr(shaped, F.lit(1), at - 1), longer, F.lit("@"), F.regexp_extract(shaped, r"@([^.]*)", 1), F.lit(".example"))
    country = F.regexp_extract(value, f"^(?:{_COUNTRY})", 0)
    return (
        F.when(kind == "email", email)
        .when(kind == "card", _luhn(shaped))
        .when(kind == "ip", _address(stream))
        .when(kind.isin("given", "family"), _name(kind, value, gender, stream, draw))
        .when(kind == "phone", F.concat(country, F.substr(shaped, F.length(country) + 1)))
        .when((kind == "secret") & value.rlike("^[0-9a-f]+$"), F.substr(stream, F.lit(1), F.length(value)))
        .when(kind == "secret", F.concat(shaped, longer))
        .otherwise(shaped)
    )


def _matches(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(_GATE), found).otherwise(F.array().cast("array<string>"))


def entities(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, kind, value, gender`` of every part of a detected entity."""
    found = only(documents, "doc_id", "text").select(
        "doc_id", row_hash(F.col("text")).alias("text_hash"), F.explode(_matches(F.col("text"))).alias("match")
    )
    return found.select("doc_id", "text_hash", F.explode(parts_of(F.col("match"))).alias("part")).select("doc_id", "text_hash", "part.*")


def exceptions(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, value, gender, surrogate`` where the first draw was taken; checked until none is."""
    spark = found.sparkSession
    distinct = found.select("kind", "value", "gender").distinct().withColumn("draw", F.lit(0))
    distinct = materialize(spark, distinct, "values")
    # The surrogate a value keeps may be no real value and no other value's surrogate.
    real = distinct.select("kind", F.col("value").alias("real")).distinct()
    current = distinct
    for _ in range(MAX_DRAWS):
        drawn = current.withColumn(
            "surrogate", surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.col("draw"), key)
        )
        drawn = materialize(spark, drawn, "drawn")
        # Values that have been drawn longest keep theirs.
        holder = F.struct(-F.col("draw"), F.col("value"), F.col("gender"))
        shared = (
            drawn.groupBy("kind", "surrogate")
            .agg(F.count("*").alias("n"), F.min(holder).alias("keeps"))
            .filter("n > 1")
            .select(F.col("kind").alias("_kind"), F.col("surrogate").alias("_surrogate"), "keeps")
        )
        same = (F.col("kind") == F.col("_kind")) & (F.col("surrogate") == F.col("_surrogate"))
        losers = drawn.join(shared, same).filter(holder != F.col("keeps")).select("kind", "value", "gender")
        real_too = drawn.join(
            real.withColumnRenamed("kind", "_kind"), (F.col("kind") == F.col("_kind")) & (F.col("surrogate") == F.col("real"))
        ).select("kind", "value", "gender")
        again = materialize(spark, losers.union(real_too).distinct(), "again")
        if again.isEmpty():
            return drawn.filter("draw > 0").select("kind", "value", "gender", "surrogate")
        moved = again.withColumn("more", F.lit(1))
        current = drawn.drop("surrogate").join(moved, ["kind", "value", "gender"], "left")
        current = current.withColumn("draw", F.col("draw") + F.coalesce("more", F.lit(0))).drop("more")
    raise RuntimeError(f"surrogates still collide after {MAX_DRAWS} draws")


def _new(part: Column, buckets: Column, key: bytes) -> Column:
    """The surrogate of a part. ``buckets`` has one array of exceptions a bucket, or one for all."""
    held = F.get(buckets, F.when(F.size(buckets) > 1, _bucket(part["value"])).otherwise(0))
    own = F.filter(held, lambda s: (s["kind"] == part["kind"]) & (s["value"] == part["value"]) & (s["gender"] == part["gender"]))
    return F.coalesce(F.get(own, F.lit(0))["surrogate"], surrogate(part["kind"], part["value"], part["gender"], F.lit(0), key))


def _spelled(value: Column, new: Column) -> Column:
    """``new``, which is normalised, with the gaps of ``value``; both are lined up at their ends."""

    def one(c, i):
        left = F.length(F.regexp_replace(F.substr(value, i + 1), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substr(new, F.length(new) - left + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _replaced(match: Column, buckets: Column, key: bytes) -> Column:
    kind = kind_of(match)
    value = value_of(match, kind)
    made = F.transform(parts_of(match), lambda p: _new(p, buckets, key))
    new = F.when(kind == "name", F.array_join(made, " "))
    new = new.when(kind.isin("phone", "card", "iban"), _spelled(value, F.get(made, F.lit(0)))).otherwise(F.get(made, F.lit(0)))
    head = F.substr(match, F.lit(1), F.length(match) - F.length(value))
    return F.when(kind.isNull(), match).otherwise(F.concat(head, new))


def _people(matches: Column, buckets: Column, key: bytes) -> Column:
    """``kind, value, surrogate`` of the names in a document, family names first."""
    parts = F.array_distinct(F.flatten(F.transform(F.filter(matches, lambda m: kind_of(m) == "name"), parts_of)))
    told = F.transform(parts, lambda p: F.struct(p["kind"].alias("kind"), p["value"].alias("value"), _new(p, buckets, key).alias("surrogate")))
    return F.array_sort(told)


def _without_names(text: Column, people: Column) -> Column:
    """``text`` with its bare mentions of ``people`` replaced, also as parts of hyphened words."""
    known = lambda word: F.get(F.filter(people, lambda p: p["value"] == word), F.lit(0))["surrogate"]
    pieces = lambda word: F.array_join(F.transform(F.split(word, "-"), lambda w: F.coalesce(known(w), w)), "-")
    word = rf"(?<!\p{{L}}){_NAME_WORD}"
    new = F.transform(F.regexp_extract_all(text, F.lit(word), F.lit(0)), lambda w: F.coalesce(known(w), pieces(w)))
    return F.array_join(_weave(F.split(text, word, -1), new), "")


def _bucket(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


_SPECIAL = "array<struct<kind:string,value:string,gender:int,surrogate:string>>"


def _all_buckets(special: DataFrame) -> Column:
    """The exceptions, few as they are, as a constant of the plan: an array with one array of them a bucket."""
    kept = F.struct("kind", "value", "gender", "surrogate")
    filled = special.groupBy(_bucket(F.col("value")).alias("bucket")).agg(F.collect_list(kept).alias("held"))
    held: list[str] = ["[]"] * BUCKETS
    for row in filled.select("bucket", F.to_json("held").alias("held")).collect():
        held[row["bucket"]] = row["held"]
    return F.from_json(F.lit(f"[{','.join(held)}]"), f"array<{_SPECIAL}>")


def _held_by_document(found: DataFrame, special: DataFrame) -> DataFrame:
    """Per document with exceptions among its values: those, in one bucket."""
    named = special.select(*(F.col(c).alias(f"_{c}") for c in special.columns))
    same = [F.col(c) == F.col(f"_{c}") for c in ("kind", "value", "gender")]
    hit = found.join(named, same).select(
        "doc_id", "text_hash", F.struct("kind", "value", "gender", F.col("_surrogate").alias("surrogate")).alias("special")
    )
    return hit.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.array(F.collect_set("special")).alias("buckets")
    )


def pseudonymize(documents: DataFrame, key: bytes = KEY, broadcast_exceptions: int = BROADCAST_EXCEPTIONS) -> DataFrame:
    """Every row of ``documents`` as ``doc_id, text, n_entities, kinds`` with entities replaced.

    Bare mentions of a name are replaced where its document has it after a title, and are not
    counted. Null text stays null, texts without entities stay as they are. Repeated rows and null
    ids give a row each; extra columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    found = materialize(spark, entities(documents), "entities")
    special = materialize(spark, exceptions(found, key), "exceptions")
    texts = only(documents, "doc_id", "text")
    if special.isEmpty():
        return _rewritten(texts, F.lit(None).cast(f"array<{_SPECIAL}>"), key)
    if bounded(special, broadcast_exceptions):
        return _rewritten(texts, _all_buckets(special), key)
    # Only texts with entities meet their exceptions; the others stay where they are.
    marks = _held_by_document(found, special)
    has_some = F.coalesce(F.size(_matches(F.col("text"))) > 0, F.lit(False))
    named = texts.filter(has_some).withColumn("_text_hash", row_hash(F.col("text")))
    same = named["doc_id"].eqNullSafe(marks["_id"]) & (named["_text_hash"] == marks["_hash"])
    joined = named.join(marks, same, "left").select("doc_id", "text", "buckets")
    rest = _rewritten(texts.filter(~has_some), F.lit(None).cast(f"array<{_SPECIAL}>"), key)
    return _rewritten(joined, F.col("buckets"), key).union(rest)


def _rewritten(texts: DataFrame, buckets: Column, key: bytes) -> DataFrame:
    texts = texts.withColumn("matches", _matches(F.col("text")))
    new = F.transform("matches", lambda m: _replaced(m, buckets, key))
    texts = texts.withColumn("people", _people(F.col("matches"), buckets, key))
    gaps = F.split("text", PATTERN, -1)
    people = F.col("people")
    gaps = F.when(F.size(people) > 0, F.transform(gaps, lambda g: _without_names(g, people))).otherwise(gaps)
    woven = F.array_join(_weave(gaps, new), "")
    kinds = F.filter(F.transform("matches", kind_of), lambda k: k.isNotNull())
    return texts.select(
        "doc_id",
        F.when(F.size("matches") > 0, woven).otherwise(F.col("text")).alias("text"),
        F.size(kinds).cast("long").alias("n_entities"),
        F.array_sort(F.array_distinct(kinds)).alias("kinds"),
    )


def _weave(gaps: Column, new: Column) -> Column:
    """Gap, replacement, gap, ... , gap."""
    return F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(new, i), F.lit(""))))


def op5_pii_surrogates(spark, folder: str) -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{folder}/documents.parquet"))
