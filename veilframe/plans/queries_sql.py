"""The same results in DuckDB SQL, by other means where there are any: from how the carriers are built."""

# ruff: noqa: E501

from __future__ import annotations

from .queries import SECRET, TENANT

_KEY = SECRET.encode().ljust(64, b"\0")
_IN = "".join(f"{b ^ 0x36:02X}" for b in _KEY)
_OUT = "".join(f"{b ^ 0x5C:02X}" for b in _KEY)


def _token(prefix: str, value: str, session: str | None = None) -> str:
    """SQL of the keyed token of a normalised value."""
    middle = "" if session is None else f"'session' || chr(31) || '{session}' || chr(31) || "
    message = f"('{TENANT}' || chr(31) || {middle}'{prefix}' || chr(31) || {value})"
    inner = f"sha256(unhex('{_IN}') || encode({message}))"
    return f"'{prefix}_' || upper(substr(sha256(unhex('{_OUT}') || unhex({inner})), 1, 16))"


_EMAIL = r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
_MAIL, _PHONE, _INTL = "'C' || id || '@Mail.example.ae'", "'05' || lpad((id % 100000000)::VARCHAR, 8, '0')", "'+966 5' || lpad((id * 7919 % 100000000)::VARCHAR, 8, '0')"
_T_MAIL, _T_PHONE, _T_INTL = _token("EMAIL", "'c' || id || '@mail.example.ae'"), _token("PHONE", _PHONE), _token("PHONE", "'9665' || lpad((id * 7919 % 100000000)::VARCHAR, 8, '0')")
_DONE = f"replace(replace(replace(text, {_INTL}, {_T_INTL}), {_PHONE} || ' email', ({_T_PHONE}) || ' email'), {_MAIL}, {_T_MAIL})"
_SPAN_INT = f"(strpos(text, v) - 1)::INT AS start, (strpos(text, v) - 1 + length(v))::INT AS \"end\""
_LEAK = [
    r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b", r"\b(?:SA|AE|QA|KW|BH|OM)\d{2}[A-Z0-9 \-]{15,30}\b", r"(?:\+|00)?(?:966|971|974|965|973|968)[\s\-\.]?\d(?:[\s\-\.]?\d){6,10}",
    r"\b0?5\d(?:[\s\-]?\d){7}\b", r"\b784[\- ]?\d{4}[\- ]?\d{7}[\- ]?\d\b", r"\b(?:\d[ \-]?){13,19}\b", r"(?i)\b(?:sk-[A-Za-z0-9_\-]{20,}|AKIA[0-9A-Z]{16}|(?:api[_\- ]?key|secret|token)\s*[:=]\s*[A-Za-z0-9_\-]{12,})\b",
]


#: Tags, comments, sections, scripts and styles of a page whose markup is closed.
_TAG = r"""(?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
_MARKUP = rf"(?is)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<script{_TAG}.*?</script[^>]*>|<style{_TAG}.*?</style[^>]*>|<{_TAG}"


def _spans(carrier: str, rows: list[tuple[str, str, str, str]]) -> str:
    """Spans of values that the carrier holds: (value, kind, source, condition)."""
    return "\nUNION ALL ".join(f"SELECT id, {_SPAN_INT}, '{kind}' AS kind, v AS text, '{source}' AS source FROM (SELECT id, text, {value} AS v FROM {carrier} WHERE {cond})" for value, kind, source, cond in rows)


_PAD = "lpad(id::VARCHAR, {n}, '0')"
SQL = {
    "email_spans": f"SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS text FROM documents",
    "email_domains": f"SELECT lower(split_part(e, '@', 2)) AS domain, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS e FROM documents) GROUP BY 1",
    "digit_functions": f"SELECT id, 'جوال ' || {_PHONE} || ' ثم' AS folded, {_PHONE} AS digits, {_PHONE} AS alnum FROM folded",
    "scrub_invisible": f"SELECT id, 'call ' || {_PHONE} || ' or c' || id || '@example.ae now' AS clean FROM hidden",
    "luhn_numbers": "SELECT doc_id, d AS digits, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(d, length(d) - i + 1, 1)::INT WHEN substr(d, length(d) - i + 1, 1)::INT > 4 THEN substr(d, length(d) - i + 1, 1)::INT * 2 - 9 ELSE substr(d, length(d) - i + 1, 1)::INT * 2 END)) % 10 = 0 AND d <> repeat('0', length(d)) AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{2,}')) AS d FROM documents)",
    "html_text": rf"SELECT page_id, (i - 1)::INT AS node, p[i] AS text FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, list_filter(string_split_regex(html, '{_MARKUP}'), lambda x: x <> '') AS p FROM pages))",
    "iban_remainders": "SELECT id, ((id::HUGEINT * 1000000 + 281000 + 98 - (id * 1000000 + 281000) % 97 + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) % 97)::INT AS remainder, id % 5 <> 0 AS valid FROM account",
    "kuwait_ids": "SELECT s_suppkey AS id, 11 - t % 11 <= 9 AND 11 - t % 11 = s_suppkey % 10 AS valid FROM (SELECT s_suppkey, list_sum(list_transform(range(1, 12), lambda i: substr(d, i, 1)::INT * [2,1,6,3,7,9,10,5,8,4,2][i])) AS t FROM (SELECT s_suppkey, '2' || lpad((s_suppkey * 8191 % 10000000000)::VARCHAR, 10, '0') AS d FROM supplier))",
    "path_hashes": "SELECT page_id, sha256(url) AS path_hash, replace(replace(url, '~', '~0'), '/', '~1') AS pointer, regexp_replace(url, '[^A-Za-z0-9]', '-', 'g') AS folder FROM pages",
    "title_variants": "SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS titled, true AS augment, (length(n_name) + 2 - length(regexp_extract(n_name, '[A-Z0-9_]*$')))::INT AS safe FROM nation",
    "arabic_normal_forms": "SELECT n_nationkey, 'الاداره ' || n_nationkey || ' موسسه' AS normal, 'a جاب ' || n_name AS turned, 'كتاب' AS stem FROM nation",
    "format_kinds": "SELECT page_id, CASE WHEN lower(html[1:64]) LIKE '%<!doctype html%' OR lower(html[1:64]) LIKE '%<html%' THEN 'HTML' WHEN regexp_matches(html, '^[ \\t\\n\\f\\r]*[{\\[]') THEN 'JSON' ELSE 'TXT' END AS kind FROM pages",
    # where a page's texts hold no phone number, as in these pages
    "html_redacted": rf"SELECT page_id, sha256(array_to_string(list_transform(range(1, len(p) + 1), lambda i: list_reduce(list_prepend(p[i], list_distinct(regexp_extract_all(p[i], '{_EMAIL}'))), lambda t, e: replace(t, e, " + _token("EMAIL", "lower(e)") + rf")) || coalesce(m[i], '')), '')) AS sha256, list_sum(list_transform(p, lambda x: len(regexp_extract_all(x, '{_EMAIL}'))))::INT AS n, NULL::VARCHAR AS error FROM (SELECT page_id, string_split_regex(html, '{_MARKUP}') AS p, regexp_extract_all(html, '{_MARKUP}') AS m FROM pages)",
    "iban_spans": _spans("account", [(f"'SA' || lpad((98 - (id * 1000000 + 281000) % 97)::VARCHAR, 2, '0') || {_PAD.format(n=20)}", "IBAN", "regex.gcc.iban.mod97", "id % 5 <> 0")]),
    "phone_spans": _spans("contact", [(_PHONE, "PHONE", "regex.gcc.phone", "true"), (_INTL, "PHONE", "regex.gcc.phone", "true")]),
    "folded_phone_spans": _spans("folded", [(f"translate({_PHONE}, '0123456789', '٠١٢٣٤٥٦٧٨٩')", "PHONE", "regex.gcc.phone", "true")]),
    "identity_spans": _spans("identity", [(f"'784-1990-' || {_PAD.format(n=7)} || '-' || (id % 10)", "NATIONAL_ID", "regex.gcc.uae_id", "true"), (f"'2' || {_PAD.format(n=11)}", "NATIONAL_ID", "regex.gcc.saudi_id_context", "true"), (f"'9' || {_PAD.format(n=9)}", "NATIONAL_ID", "regex.shareholder_id", "true")]),
    "tax_spans": _spans("invoice", [(f"'1' || {_PAD.format(n=14)}", "TAX_NUMBER", "regex.tax_context_bare_15", "id % 2 = 0")]),
    "address_spans": _spans("place", [("(id % 9000 + 1000)::VARCHAR", "ADDRESS", "regex.address_po_box", "true"), ("CASE WHEN id % 2 = 0 THEN 'Riyadh 1' ELSE 'Jeddah 2' END || lpad((id % 10000)::VARCHAR, 4, '0')", "ADDRESS", "regex.address_city_postal", "true")]),
    "geo_gated": _spans("place", [("CASE WHEN id % 2 = 0 THEN 'Riyadh' ELSE 'Jeddah' END", "ADDRESS", "geo.gazetteer_address_gated", "true")]),
    "resolve_overlaps": _spans("company", [(f"'10' || {_PAD.format(n=8)}", "COMMERCIAL_REGISTRATION", "regex.gcc.commercial_registration_context", "true"), (f"'3' || {_PAD.format(n=13)} || '3'", "TAX_NUMBER", "regex.gcc.tax_number_context", "true")]),
    "context_boost": f"SELECT id, (strpos(text, v) - 1)::INT AS start, kind, c::DOUBLE AS confidence, terms FROM (SELECT id, text, {_MAIL} AS v, 'EMAIL' AS kind, 1.0 AS c, 'email' AS terms FROM contact UNION ALL SELECT id, text, {_PHONE}, 'PHONE', 1.0, 'phone' FROM contact UNION ALL SELECT id, text, {_INTL}, 'PHONE', 0.93, NULL FROM contact)",
    "suppressed": f"SELECT id, {_MAIL} AS text FROM contact WHERE id NOT IN (1, 2)",
    "tokenized": "SELECT c_custkey AS id, " + _token("EMAIL", "'c' || c_custkey || '@mail.example.ae'") + " AS email_token, " + _token("PHONE", "'05' || lpad(c_custkey::VARCHAR, 8, '0')", "s1") + " AS phone_token FROM customer",
    "anonymize_text": f"SELECT id, {_DONE} AS text, 3::INT AS n FROM contact",
    "vault_records": f"SELECT kind, token, min_by(value, id) AS value, min_by(normalized, id) AS normalized FROM (SELECT id, 'EMAIL' AS kind, {_T_MAIL} AS token, {_MAIL} AS value, lower({_MAIL}) AS normalized FROM contact UNION ALL SELECT id, 'PHONE', {_T_PHONE}, {_PHONE}, {_PHONE} FROM contact UNION ALL SELECT id, 'PHONE', {_T_INTL}, {_INTL}, regexp_replace({_INTL}, '[^0-9]', '', 'g') FROM contact) GROUP BY kind, token",
    "anonymize_hidden": "SELECT id, 'call ' || " + _T_PHONE + " || ' or ' || " + _token("EMAIL", "'c' || id || '@example.ae'") + " || ' now' AS text FROM hidden",
    "anonymize_folded": f"SELECT id, 'جوال ' || {_T_PHONE} || ' ثم' AS text FROM folded",
    "policy_balanced": f"SELECT id, CASE WHEN id IN (1, 2) THEN replace({_DONE}, {_T_MAIL}, {_MAIL}) ELSE {_DONE} END AS text FROM contact",
    "policy_kinds": f"SELECT id, replace({_DONE}, {_T_MAIL}, {_MAIL}) AS text, 3::INT AS n FROM contact",
    "policy_audit": "SELECT id, text, 0::INT AS records FROM contact",
    "restore_exact": "SELECT id, text, 3::INT AS restored FROM contact",
    "restore_fuzzy": "SELECT id, text, 0::INT AS unrestored FROM contact",
    "leak_gate": "SELECT doc_id, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in _LEAK) + " AS leaks FROM documents",
    "residual_guard": "SELECT id, 0::INT AS residual FROM contact",
    "structured_keys": "SELECT * FROM (VALUES ('customer_name', 'PERSON'), ('max_tokens', NULL), ('phone', 'PHONE'), ('tax_amount', NULL), ('billing-email', 'EMAIL'), ('supplier.id', 'ORGANIZATION'), ('رقم الجوال', 'PHONE'), ('note', NULL), ('tin', 'TAX_NUMBER')) t(key, kind)",
    "structured_redact": "SELECT id, " + _token("PHONE", "'05' || lpad(id::VARCHAR, 8, '0')") + " AS phone, " + _token("PHONE", "'0501234567'") + " AS amount_note, 'mail ' || " + _token("EMAIL", "'c' || id || '@x.ae'") + " AS note FROM contact",
    "tabular_redact": "SELECT c_custkey AS id, " + _token("PHONE", "'05' || lpad(c_custkey::VARCHAR, 8, '0')") + " AS mobile, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE " + _token("EMAIL", "'a@b.co'") + " END AS email FROM customer",
    "kind_counts": "SELECT id, 'EMAIL' AS kind, 1::BIGINT AS n FROM contact UNION ALL SELECT id, 'PHONE', 2 FROM contact",
    "corpus_summary": f"SELECT CASE WHEN g = 0 THEN 'EMAIL' END AS kind, count(*) AS detections, count(DISTINCT doc_id) AS files_with, (SELECT count(*) FROM documents) AS files FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS e FROM documents), range(2) r(g) GROUP BY g",
    "top_files": f"SELECT doc_id, count(*) AS total FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS e FROM documents) GROUP BY 1 ORDER BY total DESC, doc_id LIMIT 10",
    "eval_scores": "SELECT 'EMAIL' AS kind, (count(*) FILTER (id % 3 <> 0))::BIGINT AS tp, (count(*) FILTER (id % 3 = 0))::BIGINT AS fp, 0::BIGINT AS fn, (count(*) FILTER (id % 3 <> 0)) / count(*) AS precision, 1.0::DOUBLE AS recall FROM contact UNION ALL SELECT 'PHONE', 0, 2 * count(*), 0, 0.0, 0.0 FROM contact",
    "hook_decisions": "SELECT id, CASE id % 4 WHEN 0 THEN CASE WHEN id % 3 <> 0 THEN 'block' END WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN id % 3 <> 0 THEN 'deny' END ELSE CASE WHEN id % 3 <> 0 THEN 'replace' END END AS decision, CASE WHEN id % 3 <> 0 THEN 'EMAIL:1, PHONE:2' END AS summary FROM contact",
    "stream_restore": "SELECT id, text FROM contact",
    "conversation_redact": "SELECT conv_id, turn, role, 'mail ' || " + _token("EMAIL", "'u' || conv_id || '@x.ae'") + " || ' ' || text AS text FROM conversations",
    "word_pieces": "SELECT id, word::INT AS word, min(i)::INT AS start, (max(i) + 1)::INT AS \"end\", CASE WHEN max(CASE WHEN i % 2 = 1 THEN 1 ELSE 0 END) = 1 THEN 'B-PER' ELSE 'O' END AS label FROM (SELECT n_nationkey AS id, i, i // 3 + 1 AS word FROM (SELECT n_nationkey, unnest(range(0, length(n_name))) AS i FROM nation)) GROUP BY id, word",
}
