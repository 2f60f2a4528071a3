"""DuckDB SQL for those of the opN queries that SQL can express."""

from tallyweir.llm.queries import QUALIFIERS, SUBJECTS

_S, _Q = "|".join(SUBJECTS), "|".join(QUALIFIERS)
#: The patterns of url_rule_set as one expression; a separator is anything but letters, digits, ``_``, ``%`` and ``-``, or an end.
_PATTERNS = f"(^|[^A-Za-z0-9_%-])(({_S})-|(({_S})[-=]({_Q})|({_Q})-({_S}))([^A-Za-z0-9_%-]|$)|({_S})[.]({_Q})[.])|/({_S})/({_Q})/|^({_S})({_Q})[.]"

op3_url_filters = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM rest
), parts AS (
  SELECT page_id,
         translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM cut
), ruled AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
         END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host || path, '{patterns}') THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
""".replace("{patterns}", _PATTERNS)
