"""Named queries, each with the SQL a second engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import AuditConfig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The policy the queries run under: hosts that the derived captures mention.
CONFIG = AuditConfig(
    forbiddenHosts=("staging.example.com", "dev.example.com", "*.internal.example.com"))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# --- SQL fragments of the checking engine ---------------------------------------------------

TRACKING = "^(utm_.*|gclid|fbclid|msclkid|mc_(cid|eid)|_ga|ref|referrer)$"


def host(url: str) -> str:
    return f"regexp_extract({url}, '^https?://([^/?#:]+)', 1)"


def site(url: str) -> str:
    return f"regexp_replace({host(url)}, '^www\\.', '')"


def path(url: str) -> str:
    return f"regexp_extract({url}, '^https?://[^/?#]+([^?#]*)', 1)"


def _params(url: str) -> str:
    return (f"list_sort(list_filter(string_split(regexp_extract({url}, '\\?([^#]*)', 1), '&'), "
            f"lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '{TRACKING}', 'i')))")


def _search(url: str) -> str:
    return (f"CASE WHEN len({_params(url)}) > 0 THEN '?' || array_to_string({_params(url)}, '&') "
            f"ELSE '' END")


def norm(url: str) -> str:
    return f"(regexp_extract({url}, '^[^?#]*', 0) || {_search(url)})"


def key(url: str) -> str:
    return f"(regexp_replace(regexp_extract({url}, '^[^?#]*', 0), '([^/])/+$', '\\1') || {_search(url)})"


CAPTURES = f"""
cap AS (SELECT page_id, url, {site('url')} AS site,
  CASE page_id % 50 WHEN 3 THEN 0 WHEN 7 THEN 404 WHEN 11 THEN 500 WHEN 13 THEN 429
       WHEN 17 THEN 403 WHEN 19 THEN 503 ELSE 200 END AS status,
  page_id % 50 NOT IN (3, 23) AS has_dom,
  page_id % 50 = 13 OR page_id % 100 IN (17, 19) AS blocked,
  CASE WHEN page_id % 100 IN (17, 19) THEN 'Just a moment...' ELSE CASE page_id % 8
       WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Short' WHEN 3 THEN repeat('Long title ', 8)
       WHEN 4 THEN 'A shared title for pages' ELSE concat('Own title number ', page_id) END END AS title,
  CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Too short.' WHEN 2 THEN repeat('long text ', 17)
       ELSE 'A description of fair length, shared by a number of pages.' END AS description,
  CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 9 = 1 THEN 'https://staging.example.com/c'
       WHEN page_id % 9 = 2 THEN 'http://[bad' ELSE url END AS canonical,
  CASE WHEN page_id % 4 = 0 THEN chr(10) || 'found on: sitemap' ELSE '' END AS found_on
 FROM pages)"""

HOPS = """
hops AS (SELECT p.page_id, h.hop_no,
  CASE WHEN p.page_id % 40 = 7 AND h.hop_no = 0 THEN concat('https://staging.example.com/h/', p.page_id)
       ELSE concat(p.url, '?hop=', h.hop_no) END AS hop_url
 FROM pages p JOIN (SELECT 0 AS hop_no UNION ALL SELECT 1 UNION ALL SELECT 2) h
  ON h.hop_no < CASE WHEN p.page_id % 10 = 7 THEN 3 WHEN p.page_id % 10 = 1 THEN 1 ELSE 0 END),
chains AS (SELECT page_id, count(*) AS n, string_agg(hop_url, ' -> ' ORDER BY hop_no) AS route
 FROM hops GROUP BY page_id)"""

# Links of the real HTML, resolved and escaped.
LINKS = f"""
raw_links AS (SELECT page_id, url, i, 
  unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS label,
  unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">', 1)))) AS pos
 FROM (SELECT *, 0 AS i FROM pages)),
links AS (SELECT page_id, url, pos, label,
  regexp_extract(url, '^https?://[^/]+', 0) || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS link_url
 FROM raw_links)"""
LINK_STATUS = """
link_status AS (SELECT DISTINCT link_url,
  CASE length(link_url) % 12 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 999 WHEN 3 THEN 403
       WHEN 4 THEN 0 ELSE 200 END AS status,
  CASE WHEN length(link_url) % 12 = 5 THEN 1 ELSE 0 END AS redirects,
  CASE WHEN length(link_url) % 12 IN (6, 0) THEN 20000 ELSE 80 END AS duration_ms
 FROM links)"""
