"""Checksums of national and financial identifiers as SQL predicates.

Each takes the SQL text of a string expression (a matched candidate) and returns
the SQL text of a boolean. They are meant for ``filter(candidates, x -> ...)``
over the few candidates a regex proposed, never for whole texts. SQL text keeps
the plan cheap to build: one parse in the JVM per family.
"""

from __future__ import annotations

from sparktrail import values as V


def _digit(s: str, i: int | str) -> str:
    return f"cast(substr({s}, {i}, 1) AS INT)"


def _fold(n: int | str, start: str, step: str) -> str:
    """Fold over positions 1..n with ``acc`` and ``i``."""
    return f"aggregate(sequence(1, {n}), {start}, (acc, i) -> {step})"


def _descending_sum(s: str, n: int, first_weight: int) -> str:
    return _fold(n, "0", f"acc + {_digit(s, 'i')} * ({first_weight + 1} - i)")


def _plain(s: str) -> str:
    return f"translate({s}, ' -', '')"


def _letter_or_digit(c: str) -> str:
    """Face value of a digit, A=10 .. Z=35."""
    return f"if({c} BETWEEN '0' AND '9', cast({c} AS INT), ascii({c}) - 55)"


def iban(raw: str) -> str:
    s = f"upper({_plain(raw)})"
    turned = f"concat(substr({s}, 5), substr({s}, 1, 4))"
    c = f"substr({turned}, i, 1)"
    step = f"(acc * if({c} BETWEEN '0' AND '9', 10, 100) + {_letter_or_digit(c)}) % 97"
    shaped = f"length({s}) BETWEEN 15 AND 34 AND {s} RLIKE '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$'"
    return f"if({shaped}, {_fold(f'length({s})', '0', step)} = 1, false)"


def credit_card(raw: str) -> str:
    grouped = rf"{raw} RLIKE r'^\d{{4}}([ -])(?:\d{{4}}\1)*\d{{1,4}}$'"
    digits = _plain(raw)
    shaped = rf"({grouped} OR {raw} RLIKE r'^\d+$') AND length({digits}) BETWEEN 13 AND 19"
    return f"if({shaped}, luhn_check({digits}), false)"


def us_ssn(raw: str) -> str:
    return f"NOT ({raw} RLIKE '^(?:000|666|9)') AND substr({raw}, 5, 2) <> '00' AND substr({raw}, 8, 4) <> '0000'"


def uk_nino(raw: str) -> str:
    s = f"upper(replace({raw}, ' ', ''))"
    pairs = ", ".join(f"'{p}'" for p in V.NINO_BAD_PAIRS)
    return f"{s} RLIKE '^{V.NINO_FIRST}{V.NINO_SECOND}[0-9]{{6}}[A-D]$' AND substr({s}, 1, 2) NOT IN ({pairs})"


def uk_nhs(raw: str) -> str:
    s = _plain(raw)
    # 11 - sum mod 11 must be the last digit; 11 counts as 0 and 10 never matches.
    return f"11 - {_descending_sum(s, 9, 10)} % 11 = if({_digit(s, 10)} = 0, 11, {_digit(s, 10)})"


def _control_letter(number: str, letter: str) -> str:
    return f"substr('{V.DNI_LETTERS}', cast(cast({number} AS BIGINT) % 23 AS INT) + 1, 1) = upper({letter})"


def es_dni(raw: str) -> str:
    return _control_letter(f"substr({raw}, 1, 8)", f"substr({raw}, 9, 1)")


def es_nie(raw: str) -> str:
    return _control_letter(f"translate(substr({raw}, 1, 8), 'XYZ', '012')", f"substr({raw}, 9, 1)")


def _mrz_check(field: str, length: int, check: str) -> str:
    c = f"substr({field}, i, 1)"
    value = f"if({c} = '<', 0, {_letter_or_digit(c)})"
    total = _fold(length, "0", f"acc + {value} * element_at(array(1, 7, 3), i % 3 + 1)")
    expected = f"CASE WHEN {check} = '<' THEN 0 WHEN {check} BETWEEN '0' AND '9' THEN cast({check} AS INT) ELSE -1 END"
    return f"{total} % 10 = {expected}"


def mrz_td3(raw: str) -> str:
    """Second line of a passport: five check digits, weights 7-3-1."""

    def part(start: int, length: int) -> str:
        return f"substr({raw}, {start}, {length})"

    composite = f"concat({part(1, 10)}, {part(14, 7)}, {part(22, 7)}, {part(29, 15)})"
    checks = [
        _mrz_check(part(1, 9), 9, part(10, 1)),
        _mrz_check(part(14, 6), 6, part(20, 1)),
        _mrz_check(part(22, 6), 6, part(28, 1)),
        _mrz_check(part(29, 14), 14, part(43, 1)),
        _mrz_check(composite, 39, part(44, 1)),
    ]
    return f"if(length({raw}) = 44, {' AND '.join(checks)}, false)"


def fr_nir(raw: str) -> str:
    dept = f"substr({raw}, 6, 2)"
    numeric = f"CASE {dept} WHEN '2A' THEN '19' WHEN '2B' THEN '18' ELSE {dept} END"
    body = f"concat(substr({raw}, 1, 5), {numeric}, substr({raw}, 8, 6))"
    return f"97 - cast({body} AS BIGINT) % 97 = cast(substr({raw}, 14, 2) AS BIGINT)"


def it_codice_fiscale(raw: str) -> str:
    s = f"upper({raw})"
    c = f"substr({s}, i, 1)"
    rank = f"if({c} BETWEEN '0' AND '9', cast({c} AS INT), ascii({c}) - 65)"
    odd = ", ".join(map(str, V.CODICE_FISCALE_ODD))
    total = _fold(15, "0", f"acc + if(i % 2 = 1, element_at(array({odd}), {rank} + 1), {rank})")
    return f"ascii(substr({s}, 16, 1)) - 65 = {total} % 26"


def nl_bsn(raw: str) -> str:
    total = f"{_descending_sum(raw, 8, 9)} - {_digit(raw, 9)}"
    return f"{raw} <> '000000000' AND ({total}) <> 0 AND ({total}) % 11 = 0"


def de_steuer_id(raw: str) -> str:
    head = f"substr({raw}, 1, 10)"
    counts = f"transform(sequence(0, 9), d -> 10 - length(replace({head}, cast(d AS STRING), '')))"
    repeats = f"aggregate({counts}, 0, (acc, n) -> acc + CASE WHEN n > 3 THEN 100 WHEN n > 1 THEN 1 ELSE 0 END)"
    total = f"({_digit(head, 'i')} + acc) % 10"
    product = _fold(10, "10", f"if({total} = 0, 20, {total} * 2) % 11")
    return f"substr({raw}, 1, 1) <> '0' AND {repeats} = 1 AND (11 - {product}) % 10 = {_digit(raw, 11)}"


def pt_nif(raw: str) -> str:
    rest = f"{_descending_sum(raw, 8, 9)} % 11"
    return f"substr({raw}, 1, 1) RLIKE '[{V.NIF_FIRST}]' AND if({rest} < 2, 0, 11 - {rest}) = {_digit(raw, 9)}"
