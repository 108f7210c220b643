"""DuckDB SQL for what SQL can say of operators 1, 3 and 7: base statistics, and the base spans with their digest."""

from __future__ import annotations

BLANK = r"[\x20\x09-\x0D]+"

#: Statistics of whole texts and the base rule of operator 1.
QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{BLANK}'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
grams AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN repeated USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""


def spans(kinds: list[tuple[str, str, str]]) -> str:
    """(doc_id, a count for each kind, base_sha256): kinds of (name, pattern, condition on the match m), in their order."""
    one = """SELECT doc_id, '{kind}' AS kind, {place} AS place, CAST(b AS BIGINT) AS s, CAST(b + length(m) AS BIGINT) AS e FROM (
SELECT doc_id, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS b FROM (
SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS ps FROM t))) WHERE {keep}"""
    found = " UNION ALL ".join(one.format(kind=k, place=i, pattern=p.replace("'", "''"), keep=keep) for i, (k, p, keep) in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, _, _ in kinds)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({found})
SELECT t.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (WHERE kind IS NOT NULL), '')) AS base_sha256 FROM t LEFT JOIN found ON found.doc_id = t.doc_id GROUP BY t.doc_id"""


_EITHER = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_BEFORE = rf"""(?:{_EITHER})["']?\x20*[:=]\x20*["']?"""
SECRETS = spans([
    ("assign", rf"{_BEFORE}[A-Za-z0-9+/_.=-]+", "length(regexp_replace(m, '^{0}', '')) >= 6".format(_BEFORE.replace("'", "''"))),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
])

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INTEGER) ELSE (2 * CAST(reverse({_DIGITS})[i] AS INTEGER)) // 10 + (2 * CAST(reverse({_DIGITS})[i] AS INTEGER)) % 10 END)) % 10 = 0"
_PART = "length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) <= 255"
PERSONAL = spans([
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", f"len(list_filter(string_split(m, '.'), lambda x: NOT ({_PART}))) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
])
