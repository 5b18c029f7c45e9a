"""Content detectors: one ``Detector`` is a name and a Column expression.

A detector sees the text to scan, its lower-case form and the tool name, and
yields ``STRUCT<category, severity, findings ARRAY<STRUCT<type, location>>>`` or
NULL. Anything with that output type can join the chain, a Pandas UDF included.

Every regex sits behind a gate of literal ``contains`` tests that can only
over-approximate it, so ordinary texts cost a few memory scans.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail import values as V
from sparktrail.functions import checksums as C
from sparktrail.functions.text import java_regex, tool_tokens

FINDINGS = "array<struct<type:string,location:string>>"
DETECTION = f"struct<category:string,severity:string,findings:{FINDINGS}>"


@dataclass(frozen=True)
class Scan:
    """The columns a detector may look at; ``classify`` provides them under fixed names."""

    text: Column
    lower: Column
    tool: Column | None = None


def _nothing(*_args) -> dict[str, Column]:
    return {}


@dataclass(frozen=True)
class Detector:
    """Three steps, each evaluated once per text in its own projection.

    ``gates`` are cheap booleans, ``measures`` the counts or arrays taken behind
    them, ``build`` the detection made from the measures. A custom detector may
    leave the first two out and build straight from the scan.

    The built-in ones are written as SQL text over ``_text``, ``_lower``,
    ``_tool``, the gates and the measures: one JVM call per expression instead
    of one per operator.
    """

    name: str
    build: Callable[[Scan], Column]
    gates: Callable[[Scan], dict[str, Column]] = _nothing
    measures: Callable[[Scan], dict[str, Column]] = _nothing


def sql_text(value: str) -> str:
    """``value`` as a SQL string literal, nothing unescaped."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_of(words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(_lower, {sql_text(w)})" for w in words) + ")"


def _all_of(*groups: Sequence[str]) -> Column:
    return F.expr(" AND ".join(_any_of(words) for words in groups))


def _count(gate: str, pattern: str) -> Column:
    return F.expr(f"if({gate}, regexp_count(_text, {sql_text(java_regex(pattern, True))}), 0)")


def _repeat(kind: str, n: str, location: str) -> str:
    return f"array_repeat(named_struct('type', '{kind}', 'location', {location}), {n})"


def _place(location: str, sql: str | None) -> str:
    """SQL of the finding location: a constant, or an expression over the row."""
    return sql or f"'{location}'"


def _block(category: str, severity: str, findings: str, fired: str) -> Column:
    return F.expr(
        f"if({fired}, named_struct('category', '{category}', 'severity', {severity}, 'findings', {findings}), null)"
    )


# --- credentials -------------------------------------------------------------

_CREDENTIAL_ANY = java_regex(r"\b(?:" + "|".join(shape for _, shape in V.CREDENTIAL_PATTERNS) + ")")
_CREDENTIAL_GATE = (
    "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "akia", "asia", "aiza",
    "xox", "sk_", "rk_", "token", "secret", "api_key",
)


def credential_gates(_scan: Scan) -> dict[str, Column]:
    return {"_g_credential": _all_of(_CREDENTIAL_GATE)}


def credential_hits(_scan: Scan) -> dict[str, Column]:
    """Every credential-shaped substring, found in one pass of one alternation."""
    shape = sql_text(_CREDENTIAL_ANY)
    return {"_m_hits": F.expr(f"if(_g_credential, regexp_extract_all(_text, {shape}, 0), cast(array() AS array<string>))")}


def credential_type(hit: str) -> str:
    whens = " ".join(
        f"WHEN {hit} RLIKE {sql_text('^' + java_regex(shape))} THEN '{name}'" for name, shape in V.CREDENTIAL_PATTERNS
    )
    return f"CASE {whens} END"


def credential_secrets(hits: str) -> Column:
    """The values to mask: for ``name = "value"`` shapes only the value.

    In JSON text the quotes are escaped, so a backslash may stand before either.
    """
    value = "substring_index(rtrim('\"\\\\', h), '\"', -1)"
    return F.expr(f"transform({hits}, h -> if(endswith(h, '\"'), {value}, h))")


def credentials(location: str = "params", sql: str | None = None) -> Detector:
    place = _place(location, sql)

    def build(_scan):
        one = f"named_struct('type', {credential_type('h')}, 'location', {place})"
        return _block("credential_detected", "'critical'", f"transform(_m_hits, h -> {one})", "size(_m_hits) > 0")

    return Detector("credential_detected", build, credential_gates, credential_hits)


# --- prompt injection --------------------------------------------------------

_INJECTION_GATES = {
    "ignore_instructions": (("ignore", "disregard", "forget"), ("instruction", "prompt", "rule", "directive")),
    "role_override": (("you", "act", "pretend", "roleplay"), ("dan", "jailbroken", "unrestricted", "uncensored", "developer")),
    "system_prompt_leak": (("system",), ("prompt",)),
    "jailbreak_marker": (("mode", "jailbroken", "anything"), ("dan", "aim", "developer", "jailbroken", "now")),
}


def injection_gates(_scan: Scan) -> dict[str, Column]:
    return {f"_g_{kind}": _all_of(*words) for kind, words in _INJECTION_GATES.items()}


def injection_counts(_scan: Scan) -> dict[str, Column]:
    return {f"_m_{kind}": _count(f"_g_{kind}", p) for kind, p in V.INJECTION_PATTERNS.items()}


def injection(location: str = "params", sql: str | None = None) -> Detector:
    kinds, place = list(V.INJECTION_PATTERNS), _place(location, sql)

    def build(_scan):
        found = "concat(" + ", ".join(_repeat(k, f"_m_{k}", place) for k in kinds) + ")"
        return _block("prompt_injection", "'critical'", found, " + ".join(f"_m_{k}" for k in kinds) + " > 0")

    return Detector("prompt_injection", build, injection_gates, injection_counts)


def has_injection(text: str) -> Column:
    """Presence only, for short texts such as tool descriptions."""
    tests = " OR ".join(f"{text} RLIKE {sql_text(java_regex(p, True))}" for p in V.INJECTION_PATTERNS.values())
    return F.expr(f"coalesce({tests}, false)")


# --- e-mail sending ----------------------------------------------------------

_EMAIL_GATES = (
    (("send", "compose", "draft", "write"), ("mail", "message")),
    (("env", "manda", "redacta", "escribe"), ("correo", "mail", "mensaje")),
)


def tool_send_tier(tool: Column) -> Column:
    """2 for send-like tool names, 1 for draft-like ones, else 0."""
    tokens = F.coalesce(tool_tokens(tool), F.array().cast("array<string>"))
    sends = F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in V.SEND_TOKENS]))
    drafts = F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in V.COMPOSE_TOKENS]))
    return F.when(sends, 2).when(drafts, 1).otherwise(0)


def email_send(location: str = "params", sql: str | None = None) -> Detector:
    """Text commands are high; send-like tool names high, draft-like ones medium."""

    def gates(_scan):
        return {f"_g_email_{i}": _all_of(*words) for i, words in enumerate(_EMAIL_GATES)}

    def measures(scan):
        out = {f"_m_email_{i}": _count(f"_g_email_{i}", p) for i, p in enumerate(V.EMAIL_SEND_PATTERNS)}
        out["_m_tier"] = F.lit(0) if scan.tool is None else tool_send_tier(scan.tool)
        return out

    def build(_scan):
        parts = [
            _repeat("email_send_command", "_m_email_0 + _m_email_1", _place(location, sql)),
            _repeat("email_send_tool", "if(_m_tier = 2, 1, 0)", "'tool'"),
            _repeat("email_compose_tool", "if(_m_tier = 1, 1, 0)", "'tool'"),
        ]
        severity = "if(_m_email_0 + _m_email_1 > 0 OR _m_tier = 2, 'high', 'medium')"
        return _block(
            "email_send_warning", severity, f"concat({', '.join(parts)})", "_m_email_0 + _m_email_1 + _m_tier > 0"
        )

    return Detector("email_send_warning", build, gates, measures)


# --- data export -------------------------------------------------------------

_EXPORT_OBJECTS_EN = ("data", "file", "record", "user", "content", "backup", "table")
_EXPORT_OBJECTS_ES = ("datos", "archivo", "fichero", "registro", "usuario", "contenido", "backup", "tabla")
_EXPORT_GATES = (
    (("download", "export", "dump", "extract", "save", "copy"), _EXPORT_OBJECTS_EN),
    (("descarga", "exporta", "vuelca", "extrae", "guarda", "copia"), _EXPORT_OBJECTS_ES),
)
_INBOUND_GATES = (
    (
        ("download", "export", "dump", "extract", "save", "copy", "upload", "send", "post", "transfer", "forward"),
        _EXPORT_OBJECTS_EN,
        (".", "/"),
    ),
    (
        ("descarga", "exporta", "vuelca", "extrae", "guarda", "copia", "sube", "env", "manda", "publica", "transfiere"),
        _EXPORT_OBJECTS_ES,
        (".", "/"),
    ),
)


def _export(patterns, words, kind: str, severity: str, place: str) -> Detector:
    def gates(_scan):
        return {f"_g_{kind}_{i}": _all_of(*w) for i, w in enumerate(words)}

    def measures(_scan):
        return {f"_m_{kind}_{i}": _count(f"_g_{kind}_{i}", p) for i, p in enumerate(patterns)}

    def build(_scan):
        total = f"_m_{kind}_0 + _m_{kind}_1"
        return _block("data_export_warning", severity, _repeat(kind, total, place), f"{total} > 0")

    return Detector("data_export_warning", build, gates, measures)


def data_export(location: str = "params", severity: str = "'medium'", sql: str | None = None) -> Detector:
    """``severity`` is SQL, so that it may depend on the row."""
    return _export(V.EXPORT_PATTERNS, _EXPORT_GATES, "data_export_command", severity, _place(location, sql))


# Same matches as the host shape, with possessive repeats only: a plain repeat of a group
# takes a stack frame of the JVM for each label, and hosts have any number of them. After
# the first label those that cannot end a host are passed over; then come the letters of
# one that can, and the same again as long as another such label follows.
_HOST_END = r"(?:(?![a-z]{2})[a-z0-9-]++\.)*+[a-z]{2,}+"
_HOST_JAVA = rf"[a-z0-9-]++\.{_HOST_END}(?:[a-z0-9-]*+\.{_HOST_END})*+"
_INBOUND_JAVA = tuple(p.replace(V.HOST, _HOST_JAVA) for p in V.INBOUND_EXPORT_PATTERNS)


def data_export_inbound(location: str = "params") -> Detector:
    """Strict form for results: an explicit destination must be named."""
    return _export(_INBOUND_JAVA, _INBOUND_GATES, "data_export_destination", "'medium'", _place(location, None))


# --- structured personal identifiers -----------------------------------------

_CHECKS: dict[str, Callable[[str], str] | None] = {
    "email": None,
    "iban": C.iban,
    "credit_card": C.credit_card,
    "us_ssn": C.us_ssn,
    "uk_nino": C.uk_nino,
    "uk_nhs": C.uk_nhs,
    "es_dni": C.es_dni,
    "es_nie": C.es_nie,
    "mrz_td3": C.mrz_td3,
    "fr_nir": C.fr_nir,
    "it_codice_fiscale": C.it_codice_fiscale,
    "nl_bsn": C.nl_bsn,
    "de_steuer_id": C.de_steuer_id,
    "pt_nif": C.pt_nif,
    "phone_e164": None,
}
PII_TYPES = tuple(_CHECKS)

# Necessary conditions, each one pass over the text shared by the families it guards.
_PII_GATES = {
    "digits": r"_text RLIKE r'\d(?:[ -]?\d){5}'",
    "at": "contains(_text, '@')",
    "plus": "contains(_text, '+')",
    "iban": r"_text RLIKE r'[A-Z]{2}\d{2}'",
    "cf": r"_text RLIKE r'\d{2}[A-Za-z]\d{2}'",
    "mrz": "_text RLIKE '[A-Z0-9<]{44}'",
}
_GATE_OF = {
    "email": ("at",),
    "iban": ("iban",),
    "credit_card": ("digits",),
    "us_ssn": ("digits",),
    "uk_nino": ("digits",),
    "uk_nhs": ("digits",),
    "es_dni": ("digits",),
    "es_nie": ("digits",),
    "mrz_td3": ("mrz",),
    "fr_nir": ("digits",),
    "it_codice_fiscale": ("cf",),
    "nl_bsn": ("digits",),
    "de_steuer_id": ("digits",),
    "pt_nif": ("digits",),
    "phone_e164": ("digits", "plus"),
}


# Same matches as the e-mail shape, found in linear time: within one run of address
# characters only the first word character can start a match (or the place where
# the match before ended), so a long run without an address is tried once.
_EMAIL_JAVA = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[.%+-]*+(?=[A-Za-z0-9_])[A-Za-z0-9._%+-]++"
    r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_])"
)


def pii_gates(kinds: Sequence[str] = PII_TYPES) -> dict[str, Column]:
    needed = sorted({g for kind in kinds for g in _GATE_OF[kind]})
    return {f"_g_{g}": F.expr(_PII_GATES[g]) for g in needed}


def pii_count(kind: str) -> Column:
    """Confirmed matches of one family: a regex proposes, the checksum decides."""
    gate = " AND ".join(f"_g_{g}" for g in _GATE_OF[kind])
    shape = _EMAIL_JAVA if kind == "email" else java_regex(V.PII_PATTERNS[kind])
    found = f"regexp_extract_all(_text, {sql_text(shape)}, 0)"
    check = _CHECKS[kind]
    confirmed = found if check is None else f"filter({found}, x -> {check('x')})"
    return F.expr(f"if({gate}, size({confirmed}), 0)")


def pii(location: str = "params", sql: str | None = None) -> Detector:
    def build(_scan):
        found = "concat(" + ", ".join(_repeat(k, f"_m_{k}", _place(location, sql)) for k in PII_TYPES) + ")"
        return _block("pii_structured", "'medium'", found, " + ".join(f"_m_{k}" for k in PII_TYPES) + " > 0")

    return Detector(
        "pii_structured", build, lambda _s: pii_gates(), lambda _s: {f"_m_{k}": pii_count(k) for k in PII_TYPES}
    )


def pii_counts(df: DataFrame, text: str, keep: Sequence[str], kinds: Sequence[str] = PII_TYPES) -> DataFrame:
    """One narrow column of match counts per family next to the ``keep`` columns."""
    gated = df.select(*keep, F.col(text).alias("_text")).withColumns(pii_gates(kinds))
    return gated.select(*keep, *[pii_count(k).alias(k) for k in kinds])
