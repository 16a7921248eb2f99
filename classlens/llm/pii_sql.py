"""The spans of personal data as DuckDB SQL, from the same table of kinds."""

from __future__ import annotations

from classlens.llm.pii import AFTER, BEFORE, CONFIRMED, CONTEXT, IBAN_LENGTHS, KEEP, KINDS, OTHER

#: Plain forms of the patterns: this engine needs no guard against slow texts.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
}

LUHN = """list_sum(list_transform(range(1, len(d) + 1), lambda i:
    CASE WHEN (len(d) - i) % 2 = 0 THEN CAST(d[i] AS INT)
    WHEN CAST(d[i] AS INT) > 4 THEN 2 * CAST(d[i] AS INT) - 9 ELSE 2 * CAST(d[i] AS INT) END)) % 10 = 0"""

MOD_97 = """list_reduce(list_concat([0], list_transform(range(1, length(a) + 1), lambda i: ascii((a[5:] || a[1:4])[i]))),
    lambda x, c: CASE WHEN c < 58 THEN (x * 10 + c - 48) % 97 ELSE (x * 100 + c - 55) % 97 END) = 1"""

#: Per kind: what admits a match for good, and what lets the score decide.
RULES = {
    "email": ("true", "false"),
    "ip": ("len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3"
           " OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0", "false"),
    "card": (f"len(d) BETWEEN 16 AND 19 AND {LUHN}", f"len(d) BETWEEN 13 AND 15 AND {LUHN}"),
    "phone": ("m[1] = '+' AND len(d) BETWEEN 8 AND 15", "m[1] <> '+'"),
    "iban": ("false", MOD_97),
    "ssn": ("false", "NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000')"),
}


def _named(words: str) -> str:
    return rf"(?i)(?:^|[^A-Za-z0-9])(?:{words})(?:[^A-Za-z0-9]|\z)"


def _kind(number: int, kind) -> str:
    pattern = PLAIN.get(kind.name, kind.pattern)
    base, weak = RULES[kind.name]
    lengths = ", ".join(f"'{c}': {n}" for c, n in IBAN_LENGTHS.items())
    whole = kind.name != "iban"
    cut = "length(g)" if whole else (
        f"list_filter(range(1, length(g) + 1), lambda i: length(replace(g[1:i], ' ', '')) = map {{{lengths}}}[g[1:2]])[1]"
    )
    prior = kind.prior + (CONFIRMED if kind.confirmed else 0)
    return rf"""
found{number} AS (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS f, string_split_regex(t, '{pattern}') AS p FROM docs),
rows{number} AS (
    SELECT doc_id, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS g, unnest(p[1:len(f)]) AS before, unnest(p[2:]) AS rest
    FROM found{number} WHERE len(f) > 0),
placed{number} AS (
    SELECT *, sum(length(before) + length(g)) OVER (PARTITION BY doc_id ORDER BY i) - length(g) AS s, {cut} AS n
    FROM rows{number}),
parts{number} AS (
    SELECT doc_id, s, n, g[1:n] AS m, before, g[n + 1:] || rest AS after, replace(g[1:n], ' ', '') AS a,
        string_split(regexp_replace(g[1:n], '[^0-9]', '', 'g'), '') AS d
    FROM placed{number} WHERE n IS NOT NULL),
scored{number} AS (
    SELECT *, right(before, {BEFORE}) || chr(10) || left(after, {AFTER}) AS near FROM parts{number}),
judged{number} AS (
    SELECT doc_id, {number} AS k, '{kind.name}' AS kind, s, s + n AS e, {base} AS base,
        {weak} AND NOT regexp_matches(before, '[A-Za-z0-9]\z') AND NOT regexp_matches(after, '^[A-Za-z0-9]')
        AND (before <> '' OR s = 0)
        AND {prior} + CASE WHEN regexp_matches(near, '{_named(kind.words)}') THEN {CONTEXT} ELSE 0 END
            - CASE WHEN regexp_matches(near, '{_named(OTHER)}') THEN {CONTEXT} ELSE 0 END >= {KEEP} AS weak
    FROM scored{number})"""


def personal_data() -> str:
    kinds = ",".join(_kind(i, kind) for i, kind in enumerate(KINDS))
    union = " UNION ALL ".join(f"SELECT doc_id, k, kind, s, e, base FROM judged{i} WHERE base OR weak" for i in range(len(KINDS)))
    counts = ", ".join(f"count(*) FILTER (base AND kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {kinds},
spans AS (SELECT *, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM ({union})),
grouped AS (
    SELECT doc_id, {counts}, string_agg(x, ',' ORDER BY k, s) FILTER (base) AS b, string_agg(x, ',' ORDER BY k, s) AS spans
    FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
    coalesce(n_phone, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN grouped USING (doc_id)
"""
