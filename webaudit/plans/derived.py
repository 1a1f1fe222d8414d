"""Captures and logs derived by formula from the driver's tables.

The tables hold raw pages but no statuses, logs or probe results. Each formula below depends
on a row of ``pages`` or ``events`` only, so every derived table grows with its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import site_of
from ..operators.skew import salted_join
from ..schemas import AXE, CAPTURE_FIELDS, DOM
from ..sources.html import extract_dom


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("site", site_of("url"))


def dom_pages(spark: SparkSession, sf_dir: str, *surfaces: str) -> DataFrame:
    """Pages with the named surfaces of their real HTML."""
    return extract_dom(pages(spark, sf_dir), surfaces=surfaces)


def html_captures(spark: SparkSession, sf_dir: str, *surfaces: str) -> DataFrame:
    """Captures of the real HTML: every page answered 200."""
    return dom_pages(spark, sf_dir, *surfaces).select(
        "site", F.col("page_id").alias("seq"), "url", F.col("url").alias("finalUrl"),
        F.lit(200).alias("status"), "dom",
        *[F.lit({"depth": 0, "loadMs": 100, "attempts": 1, "source": "seed"}.get(n)).cast(t).alias(n)
          for n, t in CAPTURE_FIELDS.items()
          if n not in ("site", "seq", "url", "finalUrl", "status", "dom")])


_SCALARS = {
    "seq": "page_id",
    "finalUrl": "url",
    "status": "CASE page_id % 50 WHEN 3 THEN 0 WHEN 7 THEN 404 WHEN 11 THEN 500 WHEN 13 THEN 429 "
              "WHEN 17 THEN 403 WHEN 19 THEN 503 ELSE 200 END",
    "navigationError": "CASE WHEN page_id % 50 = 3 THEN 'net::ERR_NAME_NOT_RESOLVED' END",
    "domError": "CASE WHEN page_id % 50 = 23 THEN 'snapshot failed' END",
    "source": "CASE WHEN page_id % 4 = 0 THEN 'sitemap' ELSE 'seed' END",
    "loadMs": "100 + page_id % 900",
    "depth": "0",
    "attempts": "1",
    "redirectChain":
        "transform(filter(array(0, 1, 2), h -> h < CASE WHEN page_id % 10 = 7 THEN 3 "
        "WHEN page_id % 10 = 1 THEN 1 ELSE 0 END), h -> CASE WHEN page_id % 40 = 7 AND h = 0 "
        "THEN concat('https://staging.example.com/h/', page_id) "
        "ELSE concat(url, '?hop=', h) END)",
    "requestUrls":
        "array(CASE WHEN page_id % 15 = 8 THEN concat('https://dev.example.com/api/', page_id % 3) "
        "ELSE 'https://api.example.com/v1' END)",
    "console":
        "CASE WHEN page_id % 5 < 3 THEN array_repeat(named_struct('type', CASE page_id % 4 "
        "WHEN 0 THEN 'warning' WHEN 1 THEN 'error' ELSE 'pageerror' END, 'text', "
        "CASE WHEN page_id % 3 = 0 THEN 'boom from googletagmanager.com' "
        "ELSE concat('TypeError ', page_id % 17) END, 'location', CAST(NULL AS STRING)), 2) END",
    "failedRequests":
        "CASE WHEN page_id % 4 = 2 OR page_id % 9 = 1 THEN array(named_struct('url', "
        "CASE WHEN page_id % 6 = 0 THEN 'https://www.google-analytics.com/c' "
        "ELSE concat('https://cdn.example.com/f', page_id % 19) END, "
        "'status', CASE WHEN page_id % 2 = 0 THEN 404 ELSE 0 END, 'method', 'GET', "
        "'resourceType', 'script', "
        "'failure', CASE WHEN page_id % 2 = 1 THEN 'net::ERR_FAILED' END)) END",
    "axeError": "CASE WHEN page_id % 93 = 0 THEN 'axe is not defined' END",
}

_AXE = (
    "CASE WHEN page_id % 3 = 0 THEN array(named_struct('id', 'color-contrast', 'impact', "
    "CASE page_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' WHEN 2 THEN 'moderate' "
    "ELSE 'minor' END, 'help', 'Contrast', 'helpUrl', CAST(NULL AS STRING), "
    "'tags', array('cat.color', 'wcag2aa', 'wcag143'), "
    "'nodes', transform(sequence(1, least(1 + page_id % 12, 8)), n -> concat('.n', n)), "
    "'nodeCount', CAST(1 + page_id % 12 AS INT), 'failureSummary', CAST(NULL AS STRING))) END"
)

# The challenge title of blocked pages comes before the heading-style title.
TITLE = (
    "CASE WHEN page_id % 100 IN (17, 19) THEN 'Just a moment...' ELSE CASE page_id % 8 "
    "WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Short' WHEN 3 THEN repeat('Long title ', 8) "
    "WHEN 4 THEN 'A shared title for pages' ELSE concat('Own title number ', page_id) END END"
)
DESCRIPTION = (
    "CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Too short.' WHEN 2 THEN repeat('long text ', 17) "
    "ELSE 'A description of fair length, shared by a number of pages.' END"
)

_DOM = {
    "title": TITLE,
    "metaDescription": DESCRIPTION,
    "metaRobots": "CASE WHEN page_id % 25 = 4 THEN 'NoIndex, follow' END",
    "canonical": "CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 9 = 1 "
                 "THEN 'https://staging.example.com/c' WHEN page_id % 9 = 2 THEN 'http://[bad' "
                 "ELSE url END",
    "htmlLang": "CASE WHEN page_id % 10 = 9 THEN NULL ELSE 'en' END",
    "h1s": "array_repeat('Heading', CASE page_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END)",
    "og": "map_from_entries(filter(array("
          "named_struct('k', 'og:title', 'v', CASE WHEN page_id % 3 = 0 THEN 'OG title' END), "
          "named_struct('k', 'og:image', 'v', CASE WHEN page_id % 8 = 5 "
          "THEN 'https://dev.example.com/og.png' WHEN page_id % 8 < 5 "
          "THEN 'https://cdn.example.com/og.png' END)), e -> e.v IS NOT NULL))",
    "hreflang": None,
    "links": "array_repeat(named_struct('href', CASE page_id % 6 "
             "WHEN 0 THEN 'https://staging.example.com/en/cart' "
             "WHEN 1 THEN 'http://localhost:11434/api' "
             "WHEN 2 THEN concat('https://a.internal.example.com/', page_id) "
             "WHEN 3 THEN 'https://not-staging.example.com/x' ELSE 'https://example.com/ok' END, "
             "'text', 'Buy', 'rel', CAST(NULL AS STRING)), 2)",
    "images": "array(named_struct('src', CASE WHEN page_id % 11 = 0 THEN 'https://bat.bing.net/p.gif' "
              "ELSE concat('https://cdn.example.com/i', page_id % 13, '.png') END, 'alt', "
              "CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN '' ELSE 'alt' END, "
              "'naturalWidth', CASE page_id % 7 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE 640 END))",
    "resources": "array(named_struct('url', CASE WHEN page_id % 12 = 5 "
                 "THEN 'http://cdn.example.com/app.js' WHEN page_id % 20 = 6 "
                 "THEN 'http://localhost:3000/app.js' ELSE 'https://cdn.example.com/app.js' END, "
                 "'where', 'script[src]'))",
    "inlineScripts": "array(CASE WHEN page_id % 14 = 3 THEN 'cfg={api:\"https://dev.example.com/v1\"}' "
                     "WHEN page_id % 14 = 4 THEN 'go(\"http://127.0.0.1:5000/p\")' ELSE 'track(1);' END)",
    "consentBannerVisible": "page_id % 30 = 2",
}


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Small rows dealt over all cores, for steps that cost far more than the rows' bytes suggest.

    Spark merges the partitions of a shuffle by their bytes, down to one or two here.
    """
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *columns)


def captures(spark: SparkSession, sf_dir: str, hreflang: bool = False) -> DataFrame:
    """Page captures; ``hreflang`` adds alternates: a site's first page, and its last to that."""
    return captures_of(pages(spark, sf_dir), hreflang)


def captures_of(source: DataFrame, hreflang: bool = False) -> DataFrame:
    alternates = F.lit(None)
    if hreflang:
        ends = source.groupBy("site").agg(
            F.min("page_id").alias("_first"), F.min_by("url", "page_id").alias("_first_url"),
            F.max_by("url", "page_id").alias("_last_url"))
        source = salted_join(source, ends, ["site"], ["page_id"], "left").withColumn(
            "_other", F.when(F.col("page_id") == F.col("_first"), F.col("_last_url"))
            .otherwise(F.col("_first_url")))
        source = spread(source, "page_id")
        alternates = F.expr(
            "CASE WHEN page_id % 6 IN (0, 1, 2) AND _other IS NOT NULL "
            "THEN array(named_struct('hreflang', 'de', 'href', _other)) ELSE array() END")
    parts = [(alternates if n == "hreflang" else F.expr(e)).alias(n) for n, e in _DOM.items()]
    order = [f.split(":")[0].strip() for f in
             "title metaDescription metaRobots canonical htmlLang h1s og hreflang links images "
             "resources inlineScripts consentBannerVisible".split()]
    by_name = dict(zip(_DOM, parts))
    unread = F.expr("page_id % 50 IN (3, 23)")
    dom = F.when(~unread, F.struct(*[by_name[n] for n in order]).cast(DOM))
    columns = {"site": F.col("site"), "url": F.col("url"), "dom": dom,
               "axe": F.expr(_AXE).cast(AXE)}
    columns.update({n: F.expr(e) for n, e in _SCALARS.items()})
    return source.select(*[columns[n].cast(t).alias(n) for n, t in CAPTURE_FIELDS.items()])


def link_status(urls: DataFrame) -> DataFrame:
    """Probe results by formula for a table of distinct URLs."""
    return urls.select(
        "url",
        F.expr("CASE length(url) % 12 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 999 "
               "WHEN 3 THEN 403 WHEN 4 THEN 0 ELSE 200 END").alias("status"),
        F.expr("CASE WHEN length(url) % 12 = 5 THEN concat(url, '/moved') END").alias("finalUrl"),
        F.expr("CASE WHEN length(url) % 12 = 5 THEN 1 ELSE 0 END").alias("redirects"),
        F.expr("CASE WHEN length(url) % 12 = 4 THEN 'timeout after 10000ms' END").alias("error"),
        F.expr("CAST(CASE WHEN length(url) % 12 IN (6, 0) THEN 20000 ELSE 80 END AS BIGINT)")
        .alias("durationMs"))


def sitemap(source: DataFrame) -> DataFrame:
    return source.where("page_id % 5 <> 0").select("site", "url", F.col("page_id").alias("pos"))


def llms(source: DataFrame, every: int = 7) -> DataFrame:
    """Entries of llms.txt for every so manyth page."""
    return source.where(f"page_id % {every} = 0").select(
        "site", F.concat(F.lit("https://"), "site", F.lit("/llms.txt")).alias("file"),
        F.expr("CASE WHEN page_id % 2 = 0 THEN 'Docs' ELSE '' END").alias("section"),
        F.concat(F.lit("Page "), F.col("page_id")).alias("title"), "url",
        (F.col("page_id") + 1).alias("line"))


def landing(source: DataFrame, seq: str | None = None) -> DataFrame:
    """First visits of all pages, numbered by the column ``seq`` if it is given."""
    return source.select(
        "site", "url", *([F.col(seq).alias("seq")] if seq else []), F.expr("page_id % 2 = 0").alias("banner_visible"),
        F.expr("CASE WHEN page_id % 9 = 4 THEN 'Timeout 30000ms exceeded' END").alias("error"))


def probe_attempts(source: DataFrame) -> DataFrame:
    second = "length(url) % 3 = 0 OR length(url) % 12 = 4"
    return source.select("page_id", "url", F.explode(F.expr(
        f"CASE WHEN {second} THEN array(1, 2) ELSE array(1) END")).alias("attempt_no")).select(
        "page_id", "url", "attempt_no",
        F.expr("CASE WHEN length(url) % 12 = 4 THEN attempt_no ELSE 1 END").alias("round"),
        F.expr("CASE WHEN attempt_no = 1 THEN 'HEAD' ELSE 'GET' END").alias("method"),
        F.expr("CASE WHEN attempt_no = 1 AND length(url) % 3 = 0 THEN 405 "
               "WHEN length(url) % 12 = 4 THEN 0 ELSE 200 END").alias("status"),
        F.expr("CASE WHEN length(url) % 5 = 1 THEN concat(url, '/x') ELSE url END").alias("final_url"),
        F.expr("length(url) % 5 = 1").alias("redirected"),
        F.expr("CASE WHEN length(url) % 12 = 4 THEN 'reset' END").alias("error"),
        F.expr("CAST(40 * attempt_no AS BIGINT)").alias("duration_ms"))


def page_attempts(source: DataFrame) -> DataFrame:
    """Fetches of each page: some are rate limited once, some until the retries are spent."""
    return source.select("site", "url", "page_id", F.explode(F.expr(
        "CASE page_id % 10 WHEN 3 THEN array(1, 2) WHEN 6 THEN array(1, 2, 3) WHEN 9 THEN array(1) "
        "ELSE array(1) END")).alias("attempt_no")).select(
        "site", "url", "page_id", "attempt_no",
        F.expr("CASE WHEN page_id % 10 = 3 AND attempt_no = 1 THEN 429 "
               "WHEN page_id % 10 IN (6, 9) THEN 429 ELSE 200 END").alias("status"))


def page_events(source: DataFrame) -> DataFrame:
    """A browser event log: two console lines, a request, and perhaps a failure per page."""
    def event(name: str, **fields: str) -> str:
        columns = ("type", "text", "location", "url", "method", "resource_type", "failure")
        parts = [f"'event', '{name}'"]
        parts += [f"'{c}', CAST({fields.get(c, 'NULL')} AS STRING)" for c in columns]
        parts += [f"'status', CAST({fields.get('status', 'NULL')} AS INT)",
                  f"'is_main_document', {fields.get('main', 'false')}"]
        return f"named_struct({', '.join(parts)})"

    kind = "CASE page_id % 4 WHEN 0 THEN 'warning' WHEN 1 THEN 'error' ELSE 'log' END"
    events = ", ".join([
        event("console", type=kind, text="CASE WHEN page_id % 7 = 0 THEN 'Failed to load resource: x' "
                                         "ELSE concat('TypeError ', page_id % 17) END"),
        event("pageerror", text="concat('TypeError ', page_id % 5)"),
        event("request", url="concat(url, '/r')"),
        event("requestfailed", url="concat(url, '/f')", method="'GET'", resource_type="'script'",
              failure="CASE page_id % 3 WHEN 0 THEN 'net::ERR_ABORTED' ELSE 'net::ERR_FAILED' END"),
        event("response", url="concat(url, '/s')", method="'GET'", resource_type="'image'",
              status="CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END",
              main="page_id % 10 = 0"),
    ])
    return source.select("page_id", "url", F.posexplode(F.expr(f"array({events})")).alias("i", "e")) \
        .select("page_id", F.col("i").cast("bigint").alias("seq"), "e.*")


def rate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log by host: an error event is a 429."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("h"), F.col("user_id"), F.lit(".example.com")).alias("host"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.expr("CASE WHEN event_type = 'error' THEN 429 ELSE 200 END").alias("status"),
        F.expr("CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 15000 END")
        .alias("retry_after_ms"))


def edges(source: DataFrame) -> DataFrame:
    """A link graph on one site: page n links to pages 2n+1 and 2n+2."""
    one_site = source.select("page_id", one_host("url").alias("url"))
    targets = one_site.select(F.col("page_id").alias("dst_id"), F.col("url").alias("dst_url"))
    sources = one_site.select(F.col("url").alias("src_url"), "page_id",
                              F.explode(F.array(F.lit(1), F.lit(2))).alias("i")).withColumn(
        "dst_id", F.expr("page_id * 2 + i"))
    return sources.join(targets, "dst_id").select(
        F.lit("example.com").alias("site"), "src_url", "dst_url",
        (F.col("page_id") * 10 + F.col("i")).alias("seq"))


def one_host(url: str):
    return F.regexp_replace(url, "^https?://[^/]+", "https://example.com")


def robots_files(source: DataFrame) -> DataFrame:
    """A robots.txt per site; its rules depend on the length of the site's name."""
    text = F.concat(
        F.lit("# rules\nUser-agent: Foo\nUser-agent: *\nDisallow: /de/\nDisallow: /*/1"),
        (F.length("site") % 10).cast("string"),
        F.lit("\nAllow: /de/2 # carved out\nDisallow:\nDisallow: /es/*.html$\nCrawl-delay: "),
        (F.length("site") % 3).cast("string"),
        F.lit("\n\nUser-agent: BadBot\nDisallow: /\nSitemap: https://"), F.col("site"),
        F.lit("/sitemap.xml\n"))
    return source.select("site").distinct().select(
        "site", F.lit("robots").alias("kind"),
        F.concat(F.lit("https://"), "site", F.lit("/robots.txt")).alias("url"),
        text.alias("text"), F.lit(None).cast("string").alias("error"))


def site_files(source: DataFrame) -> DataFrame:
    """robots.txt, sitemaps and llms.txt of all sites.

    A site's index lists a sitemap for each page, of which those of every fifth page are missing. An
    index or an llms.txt has a row for each page it is about, so that no site is one row.
    """
    first = source.groupBy("site").agg(F.regexp_extract(
        F.min_by("url", "page_id"), "^https?://[^/]+", 0).alias("base"))
    based = salted_join(source.select("site", "page_id", "url"), first, ["site"], ["page_id"])
    none = F.lit(None).cast("string").alias("error")
    index = F.concat(F.col("base"), F.lit("/sitemap.xml"))
    leaf = F.concat(F.col("base"), F.lit("/sitemaps/"), F.col("page_id"), F.lit(".xml"))
    loc = lambda url: F.concat(F.lit("<loc>"), url, F.lit("</loc>"))
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    indexes = based.select("site", F.lit("sitemap").alias("kind"), index.alias("url"), F.concat(
        F.lit("<sitemapindex>"), loc(leaf), F.lit("</sitemapindex>")).alias("text"), none)
    leaves = based.where("page_id % 5 <> 0").select(
        "site", F.lit("sitemap").alias("kind"), leaf.alias("url"),
        F.concat(F.lit("<urlset>"), loc(escaped), F.lit("</urlset>")).alias("text"), none)
    leak = F.when(F.col("page_id") % 14 == 0, F.concat(F.lit("https://dev.example.com/"), F.col("page_id")))
    llms = source.where("page_id % 7 = 0").select(
        "site", F.lit("llms").alias("kind"),
        F.concat(F.lit("https://"), "site", F.lit("/llms.txt")).alias("url"),
        F.concat_ws("\n", F.lit("## Docs"), F.concat(
            F.lit("- [Page "), F.col("page_id"), F.lit("]("), F.col("url"), F.lit(")")), leak).alias("text"), none)
    return robots_files(source).unionByName(indexes).unionByName(leaves).unionByName(llms)
