"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def _spans(kind: str, pattern: str, keep: str, text: str = "t") -> str:
    """A list of (s, e, m) for one kind; ``keep`` is a condition on the lambda's x."""
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len({kind}_m) + 1), lambda i: {{
        's': (coalesce(list_sum(list_transform({kind}_g[1:i], lambda z: length(z))), 0) + coalesce(list_sum(list_transform({kind}_m[1:i - 1], lambda z: length(z))), 0))::BIGINT,
        'm': {kind}_m[i]}}), lambda x: {keep})""".replace("{p}", p)


def _found(kinds: list[tuple[str, str, str]], by_start: bool, counts: list[str], base: int, extra: str = "", sort_extra: str = "") -> str:
    pieces = []
    for kind, pattern, _ in kinds:
        p = pattern.replace("'", "''")
        pieces.append(f"regexp_extract_all(t, '{p}') AS {kind}_m, string_split_regex(t, '{p}') AS {kind}_g")
    lists = ", ".join(f"{_spans(k, p, keep)} AS {k}" for k, p, keep in kinds)

    def tags(which: list[tuple[int, tuple[str, str, str]]]) -> str:
        each = [f"list_transform({k}, lambda x: {{'a': {'x.s' if by_start else r}, 'b': {r if by_start else 'x.s'}, 'k': '{k}', 's': x.s, 'e': x.s + length(x.m)}})" for r, (k, _, _) in which]
        return f"coalesce(array_to_string(list_transform(list_sort(flatten([{', '.join(each)}])), lambda y: y.k || ':' || y.s || ':' || y.e), ','), '')"

    numbered = list(enumerate(kinds))
    return f"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matched AS (SELECT doc_id, t, {', '.join(pieces)} FROM raw),
placed AS (SELECT doc_id, t, {lists} FROM matched)
SELECT doc_id, {', '.join(f'len({k})::BIGINT AS n_{k}' for k in counts)},
  sha256({tags(numbered[:base])}) AS base_sha256,
  {tags(numbered)} AS spans{extra}
FROM placed"""


OP3 = _found(
    [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"""length(regexp_extract(x.m, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 12"""),
        ("access", "AKIA[A-Z0-9]+", "length(x.m) >= 18"),
        ("hex", "[0-9a-f]{16,}", "true"),
        ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
        ("github", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
        ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
        ("google", "AIza[A-Za-z0-9_-]{35}", "true"),
    ],
    True, ["assign", "access", "hex"], 3,
)

_DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN (length({_DIGITS}) - j) % 2 = 0 THEN substr({_DIGITS}, j, 1)::INT
  WHEN substr({_DIGITS}, j, 1)::INT > 4 THEN 2 * substr({_DIGITS}, j, 1)::INT - 9 ELSE 2 * substr({_DIGITS}, j, 1)::INT END)) % 10 = 0"""
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_FLAT = "replace(x.m, ' ', '')"
_TURNED = f"(substr({_FLAT}, 5) || substr({_FLAT}, 1, 4))"
_MOD97 = f"""list_reduce(list_prepend(0, list_transform(range(1, length({_TURNED}) + 1), lambda j: ascii(substr({_TURNED}, j, 1))::BIGINT)),
  lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1"""
_CONTEXT = {
    "email": (0, "e-?mail|contact|write|correo|courriel|kontakt"),
    "ip": (0, "ip:|ip address|host|server|login"),
    "card": (0, "card|visa|credit|payment|karte|tarjeta|carte"),
    "phone": (0, "phone|call|tel|mobile|fax|telefon"),
    "iban": (0, "iban|account|bank|konto|cuenta|compte"),
}
_NEAR = " + ".join(
    f"len(list_filter({k}, lambda x: regexp_matches(substr(t, greatest(x.s - 48, 0) + 1, least(x.s, 48)) || ' ' || substr(t, x.s + length(x.m) + 1, 24), '(?i){p}')))" for k, (_, p) in _CONTEXT.items()
)

OP5 = _found(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_matches(x.m, '^{_OCTET}(\.{_OCTET}){{3}}$')"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
        ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", f"""length({_FLAT}) BETWEEN 15 AND 34 AND {_MOD97}
          AND NOT regexp_matches(CASE WHEN x.s > 0 THEN substr(t, x.s, 1) ELSE '' END || substr(t, x.s + length(x.m) + 1, 1), '[A-Za-z0-9]')"""),
    ],
    False, ["email", "ip", "card", "phone"], 4, f",\n  ({_NEAR})::BIGINT AS n_with_context",
)

OP4 = """
WITH RECURSIVE sizes AS (SELECT source, count(*)::DOUBLE AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
totals AS (SELECT sum(w) AS w, sum(n) AS n FROM sizes),
rates AS (SELECT s.source, s.w / t.w * t.n / s.n AS rate FROM sizes s, totals t),
terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c, 0.0::DOUBLE AS below FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1), c FROM terms WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
drawn AS (SELECT *, (('0x' || substr(md5('42:n:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5)::DOUBLE / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, t.k AS n FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND t.c >= d.u AND (t.below < d.u OR t.k = 0))
SELECT doc_id, text, lang, source, n_chars, r.copy::INTEGER AS copy, md5('42:s:' || coalesce(doc_id::VARCHAR, 'null') || ':' || r.copy) AS shuffle_key
FROM counted, unnest(range(n)) AS r(copy)"""

#: Base 32 of a SHA-1 from its hex digits: 5 of them are 4 characters.
OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(flatten(list_transform(range(0, 8), lambda i: list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT, 1)))), '') AS payload_digest FROM d),
f AS (SELECT payload_digest, max(page_id) AS first FROM b GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b JOIN f USING (payload_digest)"""

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP10 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE len({_WORDS}) > 0),
q AS (SELECT DISTINCT item, least(10, len(w)) AS n, w[k:k + least(10, len(w)) - 1] AS g FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(k)),
s AS (SELECT DISTINCT n FROM q),
g AS (SELECT doc_id, k, n, w[k:k + n - 1] AS g FROM d, s, unnest(range(1, len(w) - n + 2)) AS r(k)),
m AS (SELECT g.doc_id, g.k, g.n, q.item FROM g JOIN q ON g.n = q.n AND g.g = q.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(k, k + n)) AS r(p) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""

ORACLES: dict[str, str] = {"op1_warc": OP1, "op3_secret_scans": OP3, "op4_mixing": OP4, "op5_personal_data": OP5, "op10_decontamination": OP10}
