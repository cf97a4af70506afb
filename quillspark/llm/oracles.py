"""SQL for DuckDB that says what the registered queries of this subpackage return."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _matches(at: int, pattern: str, test: str, group: int = 0) -> str:
    """Spans of one kind: a match starts after all text between matches and all matches before it."""
    p = _quoted(pattern)
    before = "list_sum(list_transform(s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, CAST({before} AS BIGINT) AS a, {at} AS kind, CAST({before} + length(m[k]) AS BIGINT) AS z
        FROM (SELECT doc_id, s, m, g, unnest(generate_series(1, len(m))) AS k
            FROM (SELECT doc_id, string_split_regex(t, {p}) AS s, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS g FROM d WHERE regexp_matches(t, {p})))
        WHERE {test}"""


def _spans(kinds: list[tuple[str, str, str, int]], n_base: int, with_all: bool) -> str:
    """Counts of the base kinds, the digest of their spans and, if asked, all spans."""
    names = "[" + ", ".join(_quoted(k) for k, *_ in kinds) + "]"
    found = "\n        UNION ALL ".join(_matches(at, p, t, g) for at, (_, p, t, g) in enumerate(kinds))
    text = f"{names}[kind + 1] || ':' || a || ':' || z"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{kinds[k][0]}" for k in range(n_base))
    shown = ", ".join(f"coalesce(n_{kinds[k][0]}, 0) AS n_{kinds[k][0]}" for k in range(n_base))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({found}),
        c AS (SELECT doc_id, {counts}, string_agg({text}, ',' ORDER BY a, kind, z) FILTER (WHERE kind < {n_base}) AS base, string_agg({text}, ',' ORDER BY a, kind, z) AS spans FROM f GROUP BY doc_id)
        SELECT doc_id, {shown}, sha256(coalesce(base, '')) AS base_sha256{", coalesce(spans, '') AS spans" if with_all else ""} FROM d LEFT JOIN c USING (doc_id)"""


#: kind, pattern, what a match m[k] with group g[k] must fulfil, the group
SECRETS = _spans(
    [
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(g[k]) >= 12", 2),
        ("access", r"AKIA[A-Z0-9]+", "length(m[k]) >= 18", 0),
        ("hex", r"[0-9a-f]{16,}", "true", 0),
        ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "true", 0),
        ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "true", 0),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true", 0),
        ("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", "true", 0),
    ],
    3,
    True,
)

_DIGITS = "regexp_replace(m[k], '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(generate_series(1, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INT) WHEN CAST(reverse({_DIGITS})[i] AS INT) > 4 THEN 2 * CAST(reverse({_DIGITS})[i] AS INT) - 9 ELSE 2 * CAST(reverse({_DIGITS})[i] AS INT) END)) % 10 = 0"
PII_BASE = _spans(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m[k], '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(left(ltrim(x, '0'), 3) AS INT), 0) > 255)) = 0", 0),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}", 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", 0),
    ],
    4,
    False,
)

NEAR = rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    k AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(least, doc_id), doc_id) AS component_id, coalesce(least(least, doc_id), doc_id) = doc_id AS kept
    FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""
