"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: control strings of the chat template, as one alternation
_CONTROLS = r"<s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<<ANS>>|</s>|<<ROLE>>|<<TEXT>>|<</ROLE>>"

CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, '{_CONTROLS}')) AS n_escaped,
    length(role) + length(role) - length(replace(role, chr(92), '')) + len(regexp_extract_all(role, '{_CONTROLS}')) AS role_escaped FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n_escaped + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 13 WHEN 'system' THEN 17 ELSE 29 + role_escaped END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_STRENGTH = """
{level}_m AS (SELECT sum(s) AS s, sum(n) AS n, sum(n * n) AS nn, sum(s * s / n) AS ssn, count(*) AS m FROM {level}),
{level}_k AS (SELECT CASE WHEN n IS NULL OR n = 0 THEN 0.5 ELSE s / n END AS p,
  CASE WHEN n IS NULL OR n = 0 OR m < 2 OR s = 0 OR s = n THEN 10.0
    ELSE 1.0 / least(greatest(CASE WHEN n - nn / n > m - 1 THEN ((ssn - n * (s / n) * (s / n)) / ((s / n) * (1 - s / n)) - (m - 1)) / (n - nn / n - (m - 1)) ELSE 0.0 END, 0.001), 0.999) - 1.0 END AS k FROM {level}_m)"""

URLS = rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), good AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), seen AS (
  SELECT p.host, g.good FROM (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})[^/]*/?$', 1), '') AS BIGINT) AS doc_id FROM p) p JOIN good g USING (doc_id)
), by_host AS (SELECT host, sum(good) AS s, count(*)::DOUBLE AS n FROM seen GROUP BY host),
parts AS (SELECT host, s, n, CASE WHEN len(string_split(host, '.')) > 1 THEN string_split(host, '.')[-2] || '.' ELSE '' END || string_split(host, '.')[-1] AS domain, string_split(host, '.')[-1] AS suffix FROM by_host),
by_domain AS (SELECT domain, suffix, sum(s) AS s, sum(n) AS n FROM parts GROUP BY domain, suffix),
by_suffix AS (SELECT suffix, sum(s) AS s, sum(n) AS n FROM parts GROUP BY suffix),
{",".join(_STRENGTH.format(level=x) for x in ("by_host", "by_domain", "by_suffix"))},
suffixes AS (SELECT suffix, (s + k * p) / (n + k) AS ms FROM by_suffix, by_suffix_k),
domains AS (SELECT domain, (d.s + k * ms) / (d.n + k) AS md FROM by_domain d JOIN suffixes USING (suffix), by_domain_k),
hosts AS (SELECT DISTINCT host, CASE WHEN len(string_split(host, '.')) > 1 THEN string_split(host, '.')[-2] || '.' ELSE '' END || string_split(host, '.')[-1] AS domain, string_split(host, '.')[-1] AS suffix FROM p),
prior AS (
  SELECT host, coalesce(b.s, 0) AS s, coalesce(b.n, 0) AS n, coalesce(md, ms, (SELECT p FROM by_suffix_k)) AS q
  FROM hosts LEFT JOIN by_host b USING (host) LEFT JOIN domains USING (domain) LEFT JOIN suffixes USING (suffix)
), post AS (SELECT host, (s + k * q) / (n + k) AS m, n + k AS t FROM prior, by_host_k),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN m + 1.645 * sqrt(m * (1 - m) / (t + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN post USING (host)
"""

ORACLE = {"op2_chat_format": CHAT, "op6_url_filter": URLS}
