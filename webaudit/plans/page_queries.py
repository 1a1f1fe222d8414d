"""Queries over URLs and the real HTML of the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions import urls as U
from ..functions.lets import explode_rows
from ..operators.checks import check_links
from ..operators.classify import classify_issues
from ..operators.crosspage import duplicate_members, duplicate_parts
from ..operators.frontier import found_on, link_edges, probe_worklist
from ..operators.report import counts_by_rule
from ..sources import textfiles as X
from ..sources.captures import with_site
from ..session import cut_lineage
from . import derived as D
from .audit import run_page_checks
from .registry import CONFIG, LINKS, LINK_STATUS, host, key, norm, path, query, site

CHECKED = CONFIG.with_(checks=("seo",))


@query("issues_by_rule", f"""
WITH t AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw FROM pages),
u AS (SELECT *, trim(replace(replace(replace(raw, '&quot;', '"'), '&amp;', '&'), '&amp', '&')) AS title FROM t),
found AS (
 SELECT 'missing-title' AS rule FROM u WHERE title = ''
 UNION ALL SELECT 'title-too-short' FROM u WHERE title <> '' AND length(title) < 10
 UNION ALL SELECT 'title-too-long' FROM u WHERE length(title) > 70
 UNION ALL SELECT 'missing-h1' FROM pages WHERE NOT regexp_matches(html, '<h1>')
 UNION ALL SELECT 'missing-html-lang' FROM pages WHERE NOT regexp_matches(html, '<html lang="[^"]')
 UNION ALL SELECT unnest(['missing-meta-description', 'missing-canonical', 'missing-og-title',
   'missing-og-image', 'missing-og-description']) FROM pages)
SELECT rule, CASE WHEN rule IN ('missing-title', 'missing-h1', 'missing-canonical',
   'missing-meta-description') THEN 'P2' ELSE 'P3' END AS priority,
 CASE WHEN rule LIKE '%og%' THEN 'content' ELSE 'seo' END AS category, count(*) AS n
FROM found GROUP BY rule""")
def issues_by_rule(spark, sf_dir) -> DataFrame:
    """Flagship: SEO findings of the real pages, by rule, most urgent first."""
    captures = D.html_captures(spark, sf_dir, "title", "metaDescription", "metaRobots", "canonical",
                               "htmlLang", "h1s", "og", "hreflang")
    return counts_by_rule(classify_issues(run_page_checks(captures, CHECKED)))


@query("dom_titles", """
SELECT page_id, nullif(trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
  '&quot;', '"'), '&amp;', '&'), '&amp', '&')), '') AS title FROM pages""")
def dom_titles(spark, sf_dir):
    return D.dom_pages(spark, sf_dir, "title").select("page_id", F.col("dom.title").alias("title"))


@query("dom_h1", """
SELECT page_id, len(h) AS n_h1, trim(replace(replace(replace(h[1], '&quot;', '"'), '&amp;', '&'), '&amp', '&')) AS h1
FROM (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS h FROM pages)""")
def dom_h1(spark, sf_dir):
    return D.dom_pages(spark, sf_dir, "h1s").select(
        "page_id", F.size("dom.h1s").cast("bigint").alias("n_h1"),
        F.get("dom.h1s", F.lit(0)).alias("h1"))


@query("dom_lang", """
SELECT lang, count(*) AS n FROM (SELECT regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages)
GROUP BY lang""")
def dom_lang(spark, sf_dir):
    return D.dom_pages(spark, sf_dir, "htmlLang").groupBy(
        F.col("dom.htmlLang").alias("lang")).agg(F.count("*").alias("n"))


@query("dom_links", f"WITH {LINKS} SELECT page_id, pos, link_url AS href, label AS text FROM links")
def dom_links(spark, sf_dir):
    links = explode_rows(D.dom_pages(spark, sf_dir, "links"), "dom.links", "l", "page_id", pos="pos")
    return links.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "l.href", "l.text")


@query("inline_scripts", """
SELECT page_id, trim(regexp_extract(html, '<script>(.*?)</script>', 1)) AS script,
 CAST(len(regexp_extract_all(regexp_extract(html, '<script>(.*?)</script>', 1), 'https?://')) AS BIGINT) AS n_urls
FROM pages""")
def inline_scripts(spark, sf_dir):
    pages = D.dom_pages(spark, sf_dir, "inlineScripts")
    return explode_rows(pages, "dom.inlineScripts", "script", "page_id").withColumn(
        "n_urls", F.size(T.extract_urls(F.col("script"))).cast("bigint"))


_DOTTED = "concat_ws('.', v // 16777216, v // 65536 % 256, v // 256 % 256, v % 256)"


@query("normalize_urls", f"""
WITH p AS (SELECT page_id, url, CASE page_id % 8 WHEN 5 THEN 2130706432 WHEN 6 THEN 167772160 WHEN 7 THEN 3232235520
  ELSE 0 END + page_id AS v FROM pages)
SELECT page_id, 'own' AS host, {norm('url')} AS normalized FROM p
UNION ALL SELECT page_id, 'odd', CASE page_id % 8
 WHEN 0 THEN 'https://xn--bcher-kva.s' || page_id || '.example/p' WHEN 1 THEN 'https://xn--r8jz45g.xn--zckzah/' || page_id
 WHEN 2 THEN 'https://strasse.d' || page_id || '.example/' WHEN 3 THEN 'http://example' || page_id || '.com/a'
 WHEN 4 THEN 'https://xn--80ak6aa92e.com/' || page_id ELSE 'http://' || {_DOTTED} || '/' END FROM p""")
def normalize_urls(spark, sf_dir):
    """The pages' own URLs, and some whose hosts have letters beyond ASCII or are odd numbers."""
    n = F.col("page_id")
    odd = F.concat(F.when(n % 8 == 0, F.concat(F.lit("https://BÜCHER.s"), n, F.lit(".example/p")))
                   .when(n % 8 == 1, F.concat(F.lit("https://例え。テスト/"), n))
                   .when(n % 8 == 2, F.concat(F.lit("https://stra%C3%9Fe.d"), n, F.lit(".example")))
                   .when(n % 8 == 3, F.concat(F.lit("http://ｅｘａｍ\u00adple"), n, F.lit("．com/a")))
                   .when(n % 8 == 4, F.concat(F.lit("https://аррӏе.com/"), n))
                   .when(n % 8 == 5, F.concat(F.lit("http://0x"), F.hex(n + 2130706432)))
                   .when(n % 8 == 6, F.concat(F.lit("http://012."), n))
                   .otherwise(F.concat(F.lit("http://"), n + 3232235520)))
    both = F.array(F.struct(F.lit("own").alias("host"), F.col("url")), F.struct(F.lit("odd").alias("host"), odd.alias("url")))
    return D.pages(spark, sf_dir).select("page_id", F.explode(both).alias("u")).select(
        "page_id", "u.host", U.normalize_url("u.url").alias("normalized"))


@query("dedupe_keys", f"""
SELECT {key('url')} AS key, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1""")
def dedupe_keys(spark, sf_dir):
    # Spark takes no URL function inside a grouping or an aggregate, so the key is a column first.
    return D.pages(spark, sf_dir).withColumn("key", U.dedupe_key("url")).groupBy("key").agg(
        F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("resolve_references", f"""
WITH r AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+', 0) AS origin,
  split_part({path('url')}, '/', 2) AS loc FROM pages)
SELECT page_id, origin || '/about' AS rooted, origin || '/' || loc || '/next%20page' AS sibling,
 origin || '/up' AS parent, regexp_extract(origin, '^https?:', 0) || '//cdn.example.com/x' AS scheme_relative,
 CAST(NULL AS VARCHAR) AS not_web FROM r""")
def resolve_references(spark, sf_dir):
    base = F.regexp_replace("url", "^(https?://[^/]+/[^/]+/[^/?#]+).*$", "$1")
    return D.pages(spark, sf_dir).withColumn("b", base).select(
        "page_id", U.normalize_url(F.lit("/about#x"), "b").alias("rooted"),
        U.normalize_url(F.lit("next page"), "b").alias("sibling"),
        U.normalize_url(F.lit("../up?utm_source=x"), "b").alias("parent"),
        U.normalize_url(F.lit("//cdn.example.com/x"), "b").alias("scheme_relative"),
        U.normalize_url(F.lit("mailto:a@b.c"), "b").alias("not_web"))


@query("hosts_by_site", f"""
SELECT {site('url')} AS site, count(DISTINCT {host('url')}) AS hosts, count(*) AS pages,
 CAST(count_if({site('url')} = 'therea.example.net') AS BIGINT) AS same_site
FROM pages GROUP BY 1""")
def hosts_by_site(spark, sf_dir):
    same = U.is_same_site(F.col("url"), F.lit("https://www.therea.example.net/"))
    return with_site(D.pages(spark, sf_dir)).withColumn("host", U.host_of("url")).withColumn(
        "same", same).groupBy("site").agg(
        F.countDistinct("host").alias("hosts"), F.count("*").alias("pages"),
        F.count_if("same").alias("same_site"))


@query("locale_counts", f"""
SELECT CASE WHEN split_part({path('url')}, '/', 2) IN ('en', 'es', 'de', 'en-us')
  THEN split_part({path('url')}, '/', 2) END AS locale, count(*) AS n,
 CAST(count_if(split_part({path('url')}, '/', 2) NOT IN ('es', 'de', 'en-us')) AS BIGINT) AS in_scope
FROM pages GROUP BY 1""")
def locale_counts(spark, sf_dir):
    """Locale segments, and what a run limited to English keeps."""
    locale = U.locale_of("url", CONFIG.knownLocales)
    return D.pages(spark, sf_dir).withColumn("locale", locale).groupBy("locale").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("locale").isNull() | F.col("locale").isin("en")).alias("in_scope"))


@query("path_scope", f"""
WITH p AS (SELECT page_id, lower(CASE WHEN split_part({path('url')}, '/', 2) IN ('en', 'es', 'de', 'en-us')
  THEN regexp_replace({path('url')}, '^/[^/]+', '') ELSE {path('url')} END) AS rest FROM pages)
SELECT page_id, rest = '/fr' OR rest LIKE '/fr/%' AS in_fr,
 NOT (rest = '/fr' OR rest LIKE '/fr/%') AS kept,
 regexp_matches(rest, '^/1$|^/1/') AS in_one FROM p""")
def path_scope(spark, sf_dir):
    """Prefixes match whole segments after the locale: /fr is not a known locale here."""
    locales = CONFIG.knownLocales
    inside = U.path_matches("url", ["/fr/"], locales)
    return D.pages(spark, sf_dir).select(
        "page_id", inside.alias("in_fr"), (~inside).alias("kept"),
        U.path_matches("url", ["1"], locales).alias("in_one"))


@query("ignore_scope", f"""
SELECT page_id, {path('url')} LIKE '%.html' AS html_suffix, lower(url) LIKE '%/de/%' AS substring,
 {path('url')} LIKE '%.html' OR lower(url) LIKE '%/de/%' AS ignored FROM pages""")
def ignore_scope(spark, sf_dir):
    u = F.col("url")
    return D.pages(spark, sf_dir).select(
        "page_id", U.matches_ignore_pattern(u, [".HTML"]).alias("html_suffix"),
        U.matches_ignore_pattern(u, ["/de/"]).alias("substring"),
        U.matches_ignore_pattern(u, [".html", "/DE/"]).alias("ignored"))


GLOBS = ("blog.*", "*.casino-win.example.com", "*.example.net", "*spam*")


@query("host_globs", f"""
WITH h AS (SELECT DISTINCT {host('url')} AS host FROM pages)
SELECT host, CASE WHEN regexp_matches(host, '^blog\\..*$') OR host = 'blog' THEN 'blog.*'
 WHEN regexp_matches(host, '^.*\\.casino-win\\.example\\.com$') OR host = 'casino-win.example.com' THEN '*.casino-win.example.com'
 WHEN regexp_matches(host, '^.*\\.example\\.net$') OR host = 'example.net' THEN '*.example.net'
 WHEN regexp_matches(host, '^.*spam.*$') THEN '*spam*' END AS pattern
FROM h""")
def host_globs(spark, sf_dir):
    """First matching pattern per distinct host; no join, patterns compile once per task."""
    hosts = D.pages(spark, sf_dir).select(U.host_of("url").alias("host")).distinct()
    return hosts.select("host", U.match_host(F.col("host"), GLOBS).alias("pattern"))


@query("url_belongs_to", f"""
SELECT page_id, regexp_matches({host('url')}, '(^|\\.)example\\.net$') AS in_net,
 lower(url) LIKE '%example.com/en%' AS in_com_en FROM pages""")
def url_belongs_to(spark, sf_dir):
    u = F.col("url")
    return D.pages(spark, sf_dir).select(
        "page_id", U.url_belongs_to(u, ["example.net"]).alias("in_net"),
        U.url_belongs_to(u, ["EXAMPLE.com/en"]).alias("in_com_en"))


def _link_captures(spark, sf_dir):
    return D.html_captures(spark, sf_dir, "links")


@query("link_issues", f"""
WITH {LINKS}, {LINK_STATUS},
first_links AS (SELECT page_id, url, link_url, min_by(label, pos) AS label FROM links GROUP BY 1, 2, 3),
j AS (SELECT f.*, s.status, s.redirects, s.duration_ms,
 'Link ' || CASE WHEN label = '' THEN '(no text)' WHEN length(label) > 60 THEN '"' || left(label, 60) || '…"'
   ELSE '"' || label || '"' END AS lead FROM first_links f JOIN link_status s USING (link_url))
SELECT page_id, 'error' AS severity, 'link-unreachable' AS rule, lead || ' is unreachable: timeout after 10000ms' AS message,
  url AS "pageUrl", link_url AS target, 'a[href]' AS "where", CAST(NULL AS VARCHAR) AS detail FROM j WHERE status = 0
UNION ALL SELECT page_id, 'warning', 'link-refused', lead || ' returned ' || status || ' to an automated request', url, link_url,
  'a[href]', 'may be anti-bot protection rather than a broken link; verify by hand' FROM j WHERE status IN (403, 999)
UNION ALL SELECT page_id, 'error', 'link-server-error', lead || ' returned 500', url, link_url, 'a[href]', NULL FROM j WHERE status = 500
UNION ALL SELECT page_id, 'error', 'link-dead', lead || ' returned 404', url, link_url, 'a[href]', NULL FROM j WHERE status = 404
UNION ALL SELECT page_id, 'warning', 'link-redirects', lead || ' redirects', url, link_url, 'a[href]',
  '-> ' || link_url || '/moved' FROM j WHERE status = 200 AND redirects > 0
UNION ALL SELECT page_id, 'warning', 'link-slow', lead || ' took ' || duration_ms || 'ms to respond', url, link_url,
  'a[href]', NULL FROM j WHERE status <> 0 AND duration_ms > 15000""")
def link_issues(spark, sf_dir):
    captures = _link_captures(spark, sf_dir)
    status = D.link_status(probe_worklist(captures, CONFIG))
    return check_links(captures, status, CONFIG).select(
        F.col("seq").alias("page_id"), "severity", "rule", "message", "pageUrl", "target", "where",
        "detail")


@query("probe_worklist", f"WITH {LINKS} SELECT DISTINCT link_url AS url FROM links")
def worklist(spark, sf_dir):
    return probe_worklist(_link_captures(spark, sf_dir), CONFIG)


@query("found_on", f"""
WITH {LINKS} SELECT {site('url')} AS site, link_url AS key, arg_min(url, (page_id, pos)) AS found_on
FROM links GROUP BY 1, 2""")
def first_found_on(spark, sf_dir):
    return found_on(link_edges(_link_captures(spark, sf_dir)))


_TITLES = f"""t AS (SELECT page_id, url, {site('url')} AS site,
 nullif(trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'),
 '&amp;', '&'), '&amp', '&')), '') AS title FROM pages)"""


def _titled(spark, sf_dir):
    """Titles of all pages, taken from the HTML once and stored."""
    return cut_lineage(D.html_captures(spark, sf_dir, "title").select(
        "site", "seq", "url", "status", F.struct("dom.title").alias("dom")), "titles")


@query("duplicate_titles", f"""
WITH {_TITLES}
SELECT site, title AS value, n, first_url, CAST(CASE WHEN n > 1000 THEN page_id // 1000 ELSE 0 END AS BIGINT) AS part,
 string_agg(url, chr(10) ORDER BY page_id) AS urls
FROM (SELECT *, count(*) OVER g AS n, first_value(url) OVER (g ORDER BY page_id) AS first_url
 FROM t WHERE title IS NOT NULL WINDOW g AS (PARTITION BY site, title)) WHERE n >= 2 GROUP BY 1, 2, 3, 4, 5""")
def duplicate_titles(spark, sf_dir):
    """Every page of every group of equal titles, in lists of bounded length."""
    return duplicate_parts(_titled(spark, sf_dir), "title").select(
        "site", "value", "n", "first_url", "part", F.array_join("urls", "\n").alias("urls"))


@query("duplicate_members", f"""
WITH {_TITLES}
SELECT site, title AS value, page_id, url, row_number() OVER (PARTITION BY site, title ORDER BY page_id) - 1 AS rank,
 (row_number() OVER (PARTITION BY site, title ORDER BY page_id) - 1) // 7 AS chunk FROM t
QUALIFY title IS NOT NULL AND count(*) OVER (PARTITION BY site, title) >= 2""")
def title_members(spark, sf_dir):
    return duplicate_members(_titled(spark, sf_dir), "title", chunk=7).select(
        "site", "value", F.col("seq").alias("page_id"), "url", "rank", "chunk")


@query("srcset_urls", """
SELECT page_id, unnest(['/' || page_id || '.png', 'b' || (page_id % 7) || '.png', 'c.png']) AS src,
 unnest([0, 1, 2]) AS pos FROM pages""")
def srcset(spark, sf_dir):
    text = F.concat(F.lit(" /"), "page_id", F.lit(".png 1x,\n b"), F.col("page_id") % 7,
                    F.lit(".png 2x, , c.png "))
    return D.pages(spark, sf_dir).select(
        "page_id", F.posexplode(T.srcset_urls(text)).alias("pos", "src"))


@query("finding_text", """
WITH d AS (SELECT doc_id, text, n_chars FROM documents)
SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS short,
 replace(replace(replace(replace(replace('&lt;' || lang || '&amp;lt;', '&amp;', '&'), '&lt;', '<'), '&gt;', '>'),
   '&quot;', '"'), '&apos;', '''') AS entities,
 coalesce(nullif(lower(regexp_replace(regexp_replace(source || ' / ' || lang, '[^a-zA-Z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'run') AS slug,
 lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || source ELSE '' END AS lines
FROM documents""")
def finding_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        "doc_id", T.truncate(F.col("text"), 80).alias("short"),
        T.decode_xml_entities(F.concat(F.lit("&lt;"), "lang", F.lit("&amp;lt;"))).alias("entities"),
        T.slug(F.concat("source", F.lit(" / "), "lang")).alias("slug"),
        T.join_lines(F.col("lang"), F.lit(""), F.when(F.col("doc_id") % 2 == 0, F.col("source")))
        .alias("lines"))


# --- site files -----------------------------------------------------------------------------

_ROBOTS_RULES = f"""
sites AS (SELECT DISTINCT {site('url')} AS site FROM pages),
rules AS (SELECT site, unnest(['disallow', 'disallow', 'allow', 'disallow', 'crawl-delay', 'sitemap']) AS kind,
 unnest(['/de/', '/*/1' || (length(site) % 10), '/de/2', '/es/*.html$',
  CAST((length(site) % 3) * 1000 AS VARCHAR), 'https://' || site || '/sitemap.xml']) AS pattern FROM sites)"""


@query("robots_parse", f"WITH {_ROBOTS_RULES} SELECT site, kind, pattern FROM rules")
def robots_parse(spark, sf_dir):
    return X.parse_robots(D.robots_files(D.pages(spark, sf_dir))).select("site", "kind", "pattern")


@query("robots_allowed", f"""
WITH {_ROBOTS_RULES},
u AS (SELECT page_id, {site('url')} AS site, {path('url')} AS path,
  regexp_replace({norm('url')}, '^https?://[^/]+', '') AS target FROM pages),
m AS (SELECT u.page_id, max(CASE WHEN kind = 'disallow' THEN length(pattern) END) AS d,
  max(CASE WHEN kind = 'allow' THEN length(pattern) END) AS a
 FROM u LEFT JOIN rules r ON r.site = u.site AND kind IN ('disallow', 'allow') AND regexp_matches(target,
  '^' || replace(replace(pattern, '.', '\\.'), '*', '.*')) GROUP BY 1)
SELECT page_id, d IS NULL OR coalesce(a, -1) >= d AS robots_allowed FROM m""")
def robots_verdict(spark, sf_dir):
    source = D.pages(spark, sf_dir)
    rules = X.parse_robots(D.robots_files(source))
    return X.robots_allowed(source.select("site", "url", "page_id"), rules).select(
        "page_id", "robots_allowed")


def _sitemap_files(spark, sf_dir) -> DataFrame:
    """One small sitemap per page: site, file, XML of its entries."""
    source = D.pages(spark, sf_dir)
    entry = F.concat(F.lit("<url>\n<LOC> "), F.replace("url", F.lit("?"), F.lit("?a=1&amp;")),
                     F.lit(" </LOC></url>"))
    return source.select(
        "site", F.lit("sitemap").alias("kind"),
        F.concat(F.lit("https://"), "site", F.lit("/sitemaps/"), "page_id", F.lit(".xml")).alias("url"),
        F.concat(F.lit("<urlset>"), entry, F.lit("<url><loc>mailto:x@y.z</loc></url></urlset>")).alias("text"),
        F.lit(None).cast("string").alias("error"), "page_id")


_SITEMAP_URL = "CASE WHEN position('?' IN url) > 0 THEN replace(url, '?', '?a=1&') ELSE url END"


@query("sitemap_parse", f"""
SELECT {site('url')} AS site, page_id, {norm(f'({_SITEMAP_URL})')} AS url FROM pages""")
def sitemap_parse(spark, sf_dir):
    return X.parse_sitemap(_sitemap_files(spark, sf_dir), "page_id").select("site", "page_id", "url")


@query("sitemap_walk", f"""
WITH e AS (SELECT page_id, {site('url')} AS site, {norm(f'({_SITEMAP_URL})')} AS url FROM pages)
SELECT DISTINCT site, 'url' AS kind, url FROM e WHERE page_id % 3 <> 0
UNION ALL SELECT DISTINCT site, 'error', 'https://' || site || '/sitemaps/' || page_id || '.xml' FROM e WHERE page_id % 3 = 0
UNION ALL SELECT DISTINCT {site('url')}, 'error', 'https://' || {host('url')} || '/sitemap.xml' FROM pages
 WHERE {host('url')} <> {site('url')}""")
def sitemap_walk(spark, sf_dir):
    """An index per site that names itself and a file per page; every third file is missing.

    The walk also begins at each host's own index, which hosts with a leading www do not have.

    Here the index text is one row per child, so that no site is folded into one row.
    """
    leaves = _sitemap_files(spark, sf_dir)
    child = F.concat(F.lit("<sitemapindex ><sitemap><loc>"), "url",
                     F.lit("</loc></sitemap><sitemap><loc>https://"), "site",
                     F.lit("/sitemap.xml</loc></sitemap></sitemapindex>"))
    index = leaves.select("site", F.concat(F.lit("https://"), "site", F.lit("/sitemap.xml")).alias("url"),
                          child.alias("text"), "error")
    files = leaves.where("page_id % 3 <> 0").select("site", "url", "text", "error").unionByName(index)
    hosts = D.pages(spark, sf_dir).select("site", F.concat(F.lit("https://"), U.host_of("url")).alias("baseUrl"))
    entries = X.sitemap_entries(hosts.select("site").distinct()).unionByName(X.sitemap_entries(hosts.distinct()))
    urls, errors = X.expand_sitemaps(entries, files)
    return urls.select("site", F.lit("url").alias("kind"), "url").unionByName(
        errors.select("site", F.lit("error").alias("kind"), "url"))


@query("llms_parse", f"""
WITH p AS (SELECT page_id, {site('url')} AS site, {norm('url')} AS url FROM pages)
SELECT page_id, '' AS section, '' AS title, 'https://example.org/early' AS url, 3 AS line FROM p
UNION ALL SELECT page_id, 'Docs', 'Page ' || page_id, url, 5 FROM p
UNION ALL SELECT page_id, 'Docs', 'Rel', 'https://' || site || '/rel', 5 FROM p
UNION ALL SELECT page_id, 'Blog', '', url, 8 FROM p""")
def llms_parse(spark, sf_dir):
    """A markdown file per page: sections, markdown links, a bare URL, repeats."""
    text = F.concat(
        F.lit("# Title\r\n\r\nsee https://example.org/early\n## Docs\n- [Page "), "page_id",
        F.lit("]("), "url", F.lit(' "tip") and [Rel](/rel) and [again]('), "url",
        F.lit(")\n###\n### Blog\nbare "), "url", F.lit(" [x](mailto:a@b.c)"))
    files = D.pages(spark, sf_dir).select(
        "site", F.concat(F.lit("https://"), "site", F.lit("/"), "page_id", F.lit("/llms.txt")).alias("url"),
        text.alias("text"))
    return X.parse_llms_txt(files).select(
        F.regexp_extract("file", "/([0-9]+)/llms.txt$", 1).cast("bigint").alias("page_id"),
        "section", "title", "url", "line")


@query("retry_after", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 100) * 1000 WHEN 1 THEN 60000
 WHEN 2 THEN 0 END AS wait_ms FROM events""")
def retry_after(spark, sf_dir):
    """Retry-After as seconds, as a date a minute ahead, as a past date, and unusable."""
    now = F.date_trunc("second", F.col("ts").cast("timestamp"))

    def http_date(seconds: int):
        moment = F.timestamp_seconds(F.unix_timestamp(now) + seconds)
        return F.concat(F.date_format(moment, "E"), F.lit(", "),
                        F.date_format(moment, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))

    header = (F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" "), (F.col("event_id") % 100).cast("string")))
              .when(F.col("event_id") % 4 == 1, http_date(60))
              .when(F.col("event_id") % 4 == 2, http_date(-60)).otherwise("soon"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", T.retry_after_ms(header, now).alias("wait_ms"))
