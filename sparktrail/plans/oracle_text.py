"""The check engine's SQL for the text queries, with checksums written anew."""

from __future__ import annotations

from sparktrail.plans import fixtures as X


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _n(pattern: str, text: str = "scan_text") -> str:
    return f"len(regexp_extract_all({text}, {_q('(?i)' + pattern)}))"


def _sum(n: int, term: str) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: {term}))"


_D = "CAST(substr({s}, i, 1) AS INT)"
_PLAIN = "replace(replace(x, ' ', ''), '-', '')"
_VAL = "CASE WHEN {c} = '<' THEN 0 WHEN {c} BETWEEN '0' AND '9' THEN CAST({c} AS INT) ELSE ascii({c}) - 55 END"


def _mrz(field: str, n: int, check: str) -> str:
    c = f"substr({field}, i, 1)"
    want = f"CASE WHEN {check} = '<' THEN 0 WHEN {check} BETWEEN '0' AND '9' THEN CAST({check} AS INT) ELSE -1 END"
    weight = "CASE i % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END"
    return f"{_sum(n, f'({_VAL.format(c=c)}) * ({weight})')} % 10 = {want}"


def _check(V) -> dict[str, str]:
    iban = f"upper({_PLAIN})"
    turned = f"(substr({iban}, 5) || substr({iban}, 1, 4))"
    digits = (
        f"array_to_string(list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c"
        " ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '')"
    )
    mod97 = (
        f"list_reduce(list_transform(string_split({digits}, ''), lambda c: CAST(c AS INT)), lambda a, b: (a * 10 + b) % 97)"
    )
    luhn = (
        f"list_sum(list_transform(range(1, length({_PLAIN}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN"
        f" CAST(substr(reverse({_PLAIN}), i, 1) AS INT) WHEN CAST(substr(reverse({_PLAIN}), i, 1) AS INT) > 4 THEN"
        f" CAST(substr(reverse({_PLAIN}), i, 1) AS INT) * 2 - 9 ELSE CAST(substr(reverse({_PLAIN}), i, 1) AS INT) * 2 END)) % 10 = 0"
    )
    grouped = (
        "(regexp_matches(x, '^[0-9]{4}( [0-9]{4})* [0-9]{1,4}$') OR regexp_matches(x, '^[0-9]{4}(-[0-9]{4})*-[0-9]{1,4}$')"
        " OR regexp_matches(x, '^[0-9]+$'))"
    )
    nino = "upper(replace(x, ' ', ''))"
    nhs = _sum(9, f"{_D.format(s=_PLAIN)} * (11 - i)")
    letters = V.DNI_LETTERS
    head = "substr(x, 1, 10)"
    steuer_counts = f"list_transform(range(0, 10), lambda d: 10 - length(replace({head}, CAST(d AS VARCHAR), '')))"
    steuer = (
        "list_reduce(list_transform(string_split(substr(x, 1, 10), ''), lambda c: CAST(c AS INT)),"
        " lambda p, d: (CASE WHEN (d + p) % 10 = 0 THEN 20 ELSE ((d + p) % 10) * 2 END) % 11, 10)"
    )
    cf = "upper(x)"
    rank = f"CASE WHEN substr({cf}, i, 1) BETWEEN '0' AND '9' THEN CAST(substr({cf}, i, 1) AS INT) ELSE ascii(substr({cf}, i, 1)) - 65 END"
    odd = "[" + ", ".join(map(str, V.CODICE_FISCALE_ODD)) + "]"
    cf_total = _sum(15, f"CASE WHEN i % 2 = 1 THEN ({odd})[({rank}) + 1] ELSE {rank} END")
    nir_body = (
        "(substr(x, 1, 5) || CASE substr(x, 6, 2) WHEN '2A' THEN '19' WHEN '2B' THEN '18' ELSE substr(x, 6, 2) END || substr(x, 8, 6))"
    )
    eight = _sum(8, f"{_D.format(s='x')} * (10 - i)")
    ninth = "CAST(substr(x, 9, 1) AS INT)"
    composite = "(substr(x, 1, 10) || substr(x, 14, 7) || substr(x, 22, 7) || substr(x, 29, 15))"
    mrz = " AND ".join(
        [
            _mrz("substr(x, 1, 9)", 9, "substr(x, 10, 1)"),
            _mrz("substr(x, 14, 6)", 6, "substr(x, 20, 1)"),
            _mrz("substr(x, 22, 6)", 6, "substr(x, 28, 1)"),
            _mrz("substr(x, 29, 14)", 14, "substr(x, 43, 1)"),
            _mrz(composite, 39, "substr(x, 44, 1)"),
        ]
    )
    pairs = ", ".join(f"'{p}'" for p in V.NINO_BAD_PAIRS)
    return {
        "iban": f"length({iban}) BETWEEN 15 AND 34 AND {mod97} = 1",
        "credit_card": f"{grouped} AND length({_PLAIN}) BETWEEN 13 AND 19 AND {luhn}",
        "us_ssn": "substr(x, 1, 3) NOT IN ('000', '666') AND substr(x, 1, 1) <> '9' AND substr(x, 5, 2) <> '00' AND substr(x, 8, 4) <> '0000'",
        "uk_nino": f"instr('DFIQUV', substr({nino}, 1, 1)) = 0 AND instr('DFIQUVO', substr({nino}, 2, 1)) = 0"
        f" AND instr('ABCD', substr({nino}, 9, 1)) > 0 AND substr({nino}, 1, 2) NOT IN ({pairs})",
        "uk_nhs": f"CASE 11 - {nhs} % 11 WHEN 11 THEN 0 ELSE 11 - {nhs} % 11 END = CAST(substr({_PLAIN}, 10, 1) AS INT)",
        "es_dni": f"substr('{letters}', CAST(substr(x, 1, 8) AS INT) % 23 + 1, 1) = upper(substr(x, 9, 1))",
        "es_nie": f"substr('{letters}', CAST(translate(substr(x, 1, 1), 'XYZ', '012') || substr(x, 2, 7) AS INT) % 23 + 1, 1) = upper(substr(x, 9, 1))",
        "mrz_td3": f"length(x) = 44 AND CASE WHEN length(x) = 44 THEN {mrz} ELSE false END",
        "fr_nir": f"97 - CAST({nir_body} AS BIGINT) % 97 = CAST(substr(x, 14, 2) AS INT)",
        "it_codice_fiscale": f"chr(CAST(65 + {cf_total} % 26 AS INT)) = substr({cf}, 16, 1)",
        "nl_bsn": f"({eight} - {ninth}) <> 0 AND ({eight} - {ninth}) % 11 = 0",
        "de_steuer_id": f"substr(x, 1, 1) <> '0' AND len(list_filter({steuer_counts}, lambda c: c BETWEEN 2 AND 3)) = 1"
        f" AND len(list_filter({steuer_counts}, lambda c: c > 3)) = 0 AND (11 - {steuer}) % 10 = CAST(substr(x, 11, 1) AS INT)",
        "pt_nif": f"instr('{V.NIF_FIRST}', substr(x, 1, 1)) > 0 AND CASE WHEN {eight} % 11 < 2 THEN 0 ELSE 11 - {eight} % 11 END = {ninth}",
    }


def _tokens() -> str:
    spaced = "regexp_replace(tool, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"list_transform(string_split_regex({spaced}, '[-_ ]+'), lambda t: lower(t))"


def _ipad(key: bytes, pad: int) -> str:
    return "unhex('" + bytes(b ^ pad for b in key.ljust(64, b"\0")).hex() + "')"


def _fp(s: str) -> str:
    inner = f"sha256({_ipad(X.HMAC_KEY, 0x36)} || encode({s}))"
    return f"substr(sha256({_ipad(X.HMAC_KEY, 0x5C)} || unhex({inner})), 1, 16)"


def build_counts(V, pii_types):
    """The SQL of the emitted detections for any base of (unit_id, source, scan_text, tool)."""
    return build(V, pii_types, emitter=True)


def build(V, pii_types, emitter=False):
    planted = X.select_sql(X.planted_columns("duckdb"), "documents")
    natural = "SELECT doc_id AS unit_id, source, text AS scan_text, CAST(NULL AS VARCHAR) AS tool FROM documents"
    check = _check(V)

    def pii_n(kind: str) -> str:
        found = f"regexp_extract_all(scan_text, {_q(V.PII_PATTERNS[kind])})"
        if kind in check:
            found = f"list_filter({found}, lambda x: {check[kind]})"
        return f"len({found}) AS {kind}"

    cred = r"\b(?:" + "|".join(s for _, s in V.CREDENTIAL_PATTERNS) + ")"
    hits = f"regexp_extract_all(scan_text, {_q(cred)})"
    inj = " + ".join(_n(p) for p in V.INJECTION_PATTERNS.values())
    tool = (
        f"CASE WHEN list_has_any({_tokens()}, ['send', 'reply', 'forward']) THEN 2"
        f" WHEN list_has_any({_tokens()}, ['draft', 'compose']) THEN 1 ELSE 0 END"
    )

    def counts(base: str, kinds=tuple(pii_types)) -> str:
        cols = [
            "unit_id, source, scan_text",
            f"{hits} AS hits",
            f"{inj} AS inj",
            f"{' + '.join(_n(p) for p in V.EMAIL_SEND_PATTERNS)} AS mail",
            f"coalesce({tool}, 0) AS tier",
            f"{' + '.join(_n(p) for p in V.EXPORT_PATTERNS)} AS exp",
            f"{' + '.join(_n(p) for p in V.INBOUND_EXPORT_PATTERNS)} AS exp_in",
            *[pii_n(k) for k in kinds],
        ]
        return f"SELECT {', '.join(cols)} FROM ({base})"

    pii_total = "(" + " + ".join(pii_types) + ")"

    def emitted(base: str, policy: str) -> str:
        if policy == "request":
            mail_n, mail_sev = "mail + (tier > 0)::INT", "CASE WHEN mail > 0 OR tier = 2 THEN 'high' ELSE 'medium' END"
            exp, exp_sev = "exp", "medium"
        else:
            mail_n, mail_sev = "mail", "'high'"
            exp, exp_sev = ("exp_in", "medium") if policy == "inbound" else ("exp", "low")
        rows = [
            ("credential_detected", "'critical'", "len(hits)"),
            ("prompt_injection", "'critical'", "inj"),
            ("email_send_warning", mail_sev, mail_n),
            ("data_export_warning", f"'{exp_sev}'", exp),
            ("pii_structured", "'medium'", pii_total),
        ]
        parts = [
            f"SELECT unit_id, {i} AS pos, '{c}' AS category, {s} AS severity, CAST({n} AS BIGINT) AS n FROM c WHERE {n} > 0"
            for i, (c, s, n) in enumerate(rows)
        ]
        if policy == "request":
            none = " AND ".join(f"{n} = 0" for _, _, n in rows)
            parts.append(
                f"SELECT unit_id, 9 AS pos, 'tool_call_allowed' AS category, 'low' AS severity, 0 AS n FROM c WHERE {none}"
            )
        return (
            f"WITH c AS MATERIALIZED ({counts(base)}), e AS ({' UNION ALL '.join(parts)})"
            " SELECT unit_id, row_number() OVER (PARTITION BY unit_id ORDER BY pos) - 1 AS ordinal, category, severity, n FROM e"
        )

    if emitter:
        return emitted

    def one(n: str, severity: str) -> str:
        return f"SELECT unit_id, {severity} AS severity, CAST({n} AS BIGINT) AS n FROM ({counts(planted, ())}) WHERE {n} > 0"

    def cred_type(h: str) -> str:
        whens = " ".join(
            f"WHEN regexp_matches({h}, {_q('^' + s)}) THEN '{t}'" for t, s in V.CREDENTIAL_PATTERNS
        )
        return f"CASE {whens} END"

    out = {
        "detect_chain": f"SELECT category, severity, count(*) AS n FROM ({emitted(natural, 'request')}) GROUP BY ALL",
        "detect_credentials": one("len(hits)", "'critical'"),
        "detect_injection": one("inj", "'critical'"),
        "detect_email_send": one(
            "mail + (tier > 0)::INT", "CASE WHEN mail > 0 OR tier = 2 THEN 'high' ELSE 'medium' END"
        ),
        "detect_export": one("exp", "'medium'"),
        "detect_export_inbound": one("exp_in", "'medium'"),
        "detect_request": emitted(planted, "request"),
        "detect_inbound": emitted(planted, "inbound"),
        "detect_inbound_hook": emitted(planted, "hook_inbound"),
    }
    keys = {
        "it_codice_fiscale": "pii_it_cf", "de_steuer_id": "pii_de_steuer", "phone_e164": "pii_phone",
    }
    for kind in pii_types:
        name = keys.get(kind, f"pii_{kind}")
        out[name] = f"SELECT unit_id, CAST({kind} AS BIGINT) AS n FROM (SELECT unit_id, {pii_n(kind)} FROM ({planted})) WHERE {kind} > 0"
    pii_only = f"SELECT unit_id, {', '.join(pii_n(k) for k in pii_types)} FROM ({planted})"
    long = " UNION ALL ".join(f"SELECT unit_id, '{k}' AS type, CAST({k} AS BIGINT) AS n FROM p WHERE {k} > 0" for k in pii_types)
    out["pii_all"] = f"WITH p AS MATERIALIZED ({pii_only}) {long}"
    fired = " + ".join(f"({k} > 0)::INT" for k in pii_types)
    out["pii_multilabel"] = (
        f"SELECT unit_id, CAST({fired} AS BIGINT) AS n_types, CAST({pii_total} AS BIGINT) AS n_findings FROM ({pii_only}) WHERE {fired} > 1"
    )

    injection_parts = [
        f"SELECT unit_id, '{k}' AS type, 'params' AS location, {_n(p)} AS n FROM c" for k, p in V.INJECTION_PATTERNS.items()
    ]
    groups = [
        f"SELECT unit_id, {cred_type('h')} AS type, 'params' AS location, count(*) AS n FROM (SELECT unit_id, unnest(hits) AS h FROM c) GROUP BY ALL",
        *injection_parts,
        "SELECT unit_id, 'email_send_command', 'params', mail FROM c",
        "SELECT unit_id, 'email_send_tool', 'tool', (tier = 2)::INT FROM c",
        "SELECT unit_id, 'email_compose_tool', 'tool', (tier = 1)::INT FROM c",
        "SELECT unit_id, 'data_export_command', 'params', exp FROM c",
        *[f"SELECT unit_id, '{k}', 'params', {k} FROM c" for k in pii_types],
    ]
    out["finding_groups"] = (
        f"WITH c AS MATERIALIZED ({counts(planted)}), g AS ({' UNION ALL '.join(groups)})"
        " SELECT unit_id, type, location, CAST(n AS BIGINT) AS n FROM g WHERE n > 0"
    )

    secret = "list_transform(hits, lambda h: CASE WHEN h LIKE '%\"' THEN regexp_extract(h, '\"([0-9a-f]{40})\"', 1) ELSE h END)"
    ordered = f"list_sort(list_transform(list_distinct({secret}), lambda s: (100000 - length(s), s)))"
    masked = (
        f"SELECT unit_id, source, len(list_distinct({secret})) AS n_secrets, CASE WHEN len(hits) = 0 THEN scan_text ELSE"
        f" list_reduce(list_prepend(scan_text, list_transform({ordered}, lambda t: t[2])),"
        f" lambda acc, s: replace(acc, s, substr(s, 1, 10) || '…[fp:' || {_fp('s')} || ']')) END AS masked"
        f" FROM (SELECT unit_id, source, scan_text, {hits} AS hits FROM ({planted}))"
    )
    out["mask_secrets"] = (
        "SELECT unit_id, CAST(n_secrets AS BIGINT) AS n_secrets, CAST(length(masked) AS BIGINT) AS masked_chars,"
        f" md5(masked) AS masked_md5 FROM ({masked})"
    )
    out["fingerprint_reuse"] = (
        f"WITH m AS ({masked}), f AS (SELECT DISTINCT unit_id, source, unnest(regexp_extract_all(masked, '\\[fp:([0-9a-f]{{16}})\\]', 1)) AS fp FROM m)"
        " SELECT fp, count(*) AS n_units, count(DISTINCT source) AS n_sources, min(unit_id) AS first_unit, max(unit_id) AS last_unit FROM f GROUP BY fp"
    )
    golden = X.select_sql(X.golden_columns("duckdb"), "documents")
    golden_units = f"SELECT unit_id, run AS source, scan_text, CAST(NULL AS VARCHAR) AS tool FROM ({golden})"
    out["selftest_report"] = (
        f"WITH g AS ({golden}), d AS ({emitted(golden_units, 'request')}),"
        " e AS (SELECT run, d.category IS NOT NULL AS observed, coalesce(d.category = expected_category AND d.severity = expected_severity, false) AS passed"
        " FROM g LEFT JOIN d ON g.unit_id = d.unit_id AND d.ordinal = 0)"
        " SELECT run, count(*) AS n, count(*) FILTER (observed) AS n_observed, count(*) FILTER (observed AND NOT passed) AS n_mismatched,"
        " CASE WHEN count(*) FILTER (observed AND NOT passed) > 0 THEN 'detection_mismatch' WHEN count(*) FILTER (observed) = count(*) THEN 'complete_pass'"
        " WHEN count(*) FILTER (observed) = 0 THEN 'timeout_no_data' ELSE 'timeout_partial' END AS outcome FROM e GROUP BY run"
    )
    return out
