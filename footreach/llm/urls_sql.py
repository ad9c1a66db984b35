"""The path-template tree once more, as SQL for the `pages` table: the rules and bounds are written out again."""

from __future__ import annotations

_LEVELS = """
t(k, host, raw, n, l, b, template) AS (SELECT 0, host, raw, count(*), count(said), count(CASE WHEN said = 'block' THEN 1 END), CAST([] AS VARCHAR[]) FROM base GROUP BY host, raw
  UNION ALL SELECT k + 1, host, raw, n, l, b, CASE WHEN len(raw) <= k THEN template
    ELSE list_append(template, CASE WHEN children >= 8 AND visits <= 4 * children AND NOT starts_with(raw[k + 1], '*') THEN '*' ELSE raw[k + 1] END) END
  FROM (SELECT *, count(DISTINCT raw[k + 1]) OVER (PARTITION BY host, template) AS children, sum(CASE WHEN len(raw) > k THEN n END) OVER (PARTITION BY host, template) AS visits FROM t)
  WHERE k < (SELECT max(len(raw)) FROM base)),
t6 AS (SELECT * FROM t WHERE k = (SELECT max(len(raw)) FROM base)),"""


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


OP6_SQL = rf"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM r),
p AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h),
ruled AS (SELECT *, CASE WHEN {_fits('www.example.com', '/en/')} THEN 'www.example.com/en/' WHEN {_fits('example.com', '/en/')} THEN 'example.com/en/'
  WHEN {_fits('net', '/es/')} THEN 'net/es/' WHEN {_fits('net', '/fr/')} THEN 'net/fr/' WHEN {_fits('com', '/')} THEN 'com/' END AS rule,
  list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM p),
base AS (SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said,
  forms AS raw FROM (SELECT *, list_transform(parts, lambda s:
    CASE WHEN regexp_matches(substr(s, 1, length(s) - length(regexp_extract(s, '(\.[A-Za-z]{{1,5}})$', 1))), '^[0-9]+$|[0-9]{{4}}|^[0-9a-fA-F-]{{8,}}$')
      OR length(s) - length(regexp_extract(s, '(\.[A-Za-z]{{1,5}})$', 1)) > 40 THEN '*' || regexp_extract(s, '(\.[A-Za-z]{{1,5}})$', 1) ELSE s END) AS forms FROM ruled)),
{_LEVELS}
leaf AS (SELECT host, template, CASE WHEN len(template) > 0 THEN template[1:len(template) - 1] ELSE template END AS node, sum(l) AS l, sum(b) AS b FROM t6 GROUP BY 1, 2),
pooled AS (SELECT host, node, sum(l) AS pl, sum(b) AS pb FROM leaf GROUP BY 1, 2),
hosts AS (SELECT host, sum(l) AS hl, sum(b) AS hb FROM leaf GROUP BY 1),
prior AS (SELECT coalesce(CAST(sum(b) AS double) / nullif(sum(l), 0), 0e0) AS p FROM leaf),
z AS (SELECT leaf.*, CAST(pb AS double) / nullif(pl, 0) AS share FROM leaf JOIN pooled USING (host, node)),
marked AS (SELECT host, template, l, b, CASE WHEN l > 0 AND abs((b - l * share) / nullif(sqrt(l * share * (1 - share)), 0)) > 1.96
  THEN coalesce(array_to_string(template, '/'), '') ELSE coalesce(array_to_string(node, '/'), '') || '/+' END AS branch FROM z),
merged AS (SELECT host, branch, sum(l) AS l, sum(b) AS b FROM marked GROUP BY 1, 2),
judged AS (SELECT host, branch, l, (b + 4 * ((hb + 4 * (SELECT p FROM prior)) / (hl + 4))) / (l + 4) AS purity FROM merged JOIN hosts USING (host)),
v AS (SELECT t6.host, t6.raw, t6.template, judged.branch, purity, judged.l >= 5 AND purity >= 0.8 AS rejected
  FROM t6 JOIN marked ON t6.host = marked.host AND t6.template = marked.template JOIN judged ON judged.host = marked.host AND judged.branch = marked.branch)
SELECT page_id, base.host AS host, path, rule, coalesce(said, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || coalesce(array_to_string(template, '/'), '') AS template, branch, round(purity, 9) AS purity
FROM base JOIN v ON base.host = v.host AND base.raw = v.raw
"""
