"""robots.txt, sitemap XML and llms.txt, parsed as tables of lines.

Input is a ``site_files`` table with one fetched file per row: ``site, kind, url, text,
error``. Windows run within one file, so a group is never larger than the row it came from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lets import first_per_key
from ..functions.texts import decode_xml_entities, trim_space
from ..functions.urls import normalize_url, path_matches, url_parts
from ..operators.skew import salted_join
from ..session import cut_lineage

# The line and link patterns of the three formats.
LOC = r"(?i)<loc>\s*([^<]+?)\s*</loc>"
MARKDOWN_LINK = r"""\[([^\]]*)\]\(\s*([^)\s]+)(?:\s+"[^"]*")?\s*\)"""
BARE_URL = r"""(?<![(\[<])\bhttps?://[^\s<>()\[\]"']+"""
HEADING = r"^#{1,6}\s+(.*)$"


def lines_of(files: DataFrame) -> DataFrame:
    """``site, url, line_no`` (from 1) and ``line``."""
    return files.where(F.col("text").isNotNull()).select(
        "site", "url", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line")).select(
        "site", "url", (F.col("i") + 1).alias("line_no"), "line")


# --- robots.txt ---------------------------------------------------------------------------


def parse_robots(files: DataFrame) -> DataFrame:
    """``site, url, line_no, kind, pattern`` with kind disallow, allow, sitemap, crawl-delay.

    Only the ``*`` group counts; consecutive User-agent lines share one group; sitemaps
    belong to no group. A crawl delay is given in milliseconds.
    """
    bare = trim_space(F.regexp_replace("line", "#.*$", ""))
    directives = (
        lines_of(files).withColumn("line", bare).where(F.col("line").contains(":"))
        .select("site", "url", "line_no",
                F.lower(trim_space(F.substring_index("line", ":", 1))).alias("field"),
                trim_space(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value")))
    by_file = W.partitionBy("site", "url").orderBy("line_no")
    agent = F.col("field") == "user-agent"
    follows_agent = F.coalesce(F.lag(agent).over(by_file), F.lit(False))
    grouped = directives.withColumn("start", (agent & ~follows_agent).cast("int")).withColumn(
        "grp", F.sum("start").over(by_file)).withColumn(
        "wild", F.max(agent & (F.col("value") == "*")).over(W.partitionBy("site", "url", "grp")))
    seconds = F.col("value").try_cast("double")
    rules = grouped.where(
        ((F.col("field") == "sitemap") | F.col("wild"))
        & F.col("field").isin("disallow", "allow", "sitemap", "crawl-delay")
        & (F.col("value") != "")
        & ((F.col("field") != "crawl-delay") | seconds.isNotNull()))
    return rules.select(
        "site", "url", "line_no", F.col("field").alias("kind"),
        F.when(F.col("field") == "crawl-delay", (seconds * 1000).cast("bigint").cast("string"))
        .otherwise(F.col("value")).alias("pattern"))


def robots_by_site(rules: DataFrame) -> DataFrame:
    """One row per site with its patterns, cut up (a robots file bounds the row's size)."""
    entry = pattern_parts(F.col("pattern"))

    def of(kind: str) -> Column:
        return F.collect_set(F.when(F.col("kind") == kind, entry))

    return rules.where(F.col("kind").isin("disallow", "allow")).groupBy("site").agg(
        of("disallow").alias("disallow"), of("allow").alias("allow"))


def pattern_parts(pattern: Column) -> Column:
    """A robots pattern cut at its stars: a head, what follows it in order, and a tail that must
    end the path if the pattern ends in ``$`` (``exact`` if it has no star either)."""
    anchored = F.endswith(pattern, F.lit("$"))
    parts = F.split(F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern),
                    r"\*", -1)
    n = F.size(parts)
    return F.struct(
        F.length(pattern).alias("size"), F.get(parts, F.lit(0)).alias("head"),
        F.slice(parts, F.lit(2), F.greatest(n - F.when(anchored, 2).otherwise(1), F.lit(0)))
        .alias("inner"),
        F.when(anchored & (n > 1), F.get(parts, n - 1)).alias("tail"),
        (anchored & (n == 1)).alias("exact"))


def pattern_matches(path: Column, p: Column) -> Column:
    """Whether a path matches ``pattern_parts``.

    Each part is taken at its earliest place, which leaves the most room to those behind it. A
    regular expression from a column would be compiled for every path and pattern.
    """
    def step(at: Column, part: Column) -> Column:
        found = F.position(part, path, at + 1)
        return F.when((at < 0) | (part == ""), at).when(
            found > 0, found - 1 + F.length(part)).otherwise(-1)

    begun = F.when(F.startswith(path, p["head"]), F.length(p["head"])).otherwise(-1)
    return F.aggregate(
        p["inner"], begun, step,
        lambda at: (at >= 0) & (~p["exact"] | (at == F.length(path))) & (
            p["tail"].isNull() | (F.endswith(path, p["tail"])
                                  & (F.length(path) - F.length(p["tail"]) >= at))))


def longest_match(patterns: Column, path: Column) -> Column:
    """The size of the longest pattern that matches; -1 without one."""
    hits = F.filter(patterns, lambda p: pattern_matches(path, p))
    return F.coalesce(F.array_max(F.transform(hits, lambda p: p["size"])), F.lit(-1))


def allowed_by(disallow: Column, allow: Column, path: Column) -> Column:
    """The longest matching pattern decides, and Allow wins ties."""
    return longest_match(allow, path) >= longest_match(disallow, path)


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add ``robots_allowed`` to a table with ``site`` and a URL column."""
    parts = urls.withColumn("_u", url_parts(url))
    joined = salted_join(parts, robots_by_site(rules), ["site"], urls.columns, how="left")
    target = F.concat(F.col("_u.path"), F.when(F.col("_u.query") == "", F.lit("")).otherwise(
        F.concat(F.lit("?"), F.col("_u.query"))))
    verdict = F.coalesce(allowed_by(F.col("disallow"), F.col("allow"), target), F.lit(False))
    return joined.withColumn(
        "robots_allowed", F.col("_u").isNotNull() & verdict).drop("_u", "disallow", "allow")


# --- sitemaps -----------------------------------------------------------------------------


def origin_of(url: Column) -> Column:
    """Scheme, host and port of an http(s) URL, else NULL."""
    found = F.regexp_extract(url, "(?i)^https?://[^/?#]+", 0)
    return F.when(found != "", found)


def is_sitemap_index(text: Column) -> Column:
    return text.rlike(r"(?i)<sitemapindex[\s>]")


def parse_sitemap(files: DataFrame, *keep: str) -> DataFrame:
    """``site, sitemap, pos, url``: the usable locations of each file, in order."""
    locs = F.regexp_extract_all(F.col("text"), F.lit(LOC), F.lit(1))
    return (files.select("site", F.col("url").alias("sitemap"), *keep,
                         F.posexplode(locs).alias("pos", "loc"))
            .withColumn("url", normalize_url(decode_xml_entities(F.col("loc"))))
            .where(F.col("url").isNotNull()).drop("loc"))


def sitemap_entries(sites: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (),
                    extra: Sequence[str] = (), locales: Sequence[str] = ()) -> DataFrame:
    """Where a walk starts: ``/sitemap.xml`` of each site, and extra files in scope.

    ``sites`` has ``site`` and may have ``baseUrl``; without one, https is assumed.
    """
    base = F.concat(F.lit("https://"), F.col("site"))
    if "baseUrl" in sites.columns:
        base = F.coalesce(origin_of(F.col("baseUrl")), base)
    own = sites.select("site", F.concat(base, F.lit("/sitemap.xml")).alias("url"))
    if not extra:
        return own
    more = sites.select("site", F.explode(F.array(*map(F.lit, extra))).alias("url"))
    inside = (path_matches("url", include, locales) if include
              else ~path_matches("url", exclude, locales))
    return own.unionByName(more.where(inside))


def expand_sitemaps(entries: DataFrame, files: DataFrame, max_depth: int = 3
                    ) -> tuple[DataFrame, DataFrame]:
    """Walk sitemap indexes level by level: ``(urls, errors)``, urls as ``site, url, pos``.

    Each file is visited once per site however many indexes name it; a missing or failed
    file yields an error row.
    """
    texts = files.select("site", normalize_url("url").alias("url"), "text", "error")
    level = entries.select("site", normalize_url("url").alias("url")).where(
        "url IS NOT NULL").distinct()
    visited, found, errors = None, [], []
    for depth in range(max_depth + 1):
        if visited is not None:
            level = level.join(visited, ["site", "url"], "left_anti")
        level = cut_lineage(level)
        visited = level if visited is None else visited.unionByName(level)
        read = level.join(texts, ["site", "url"], "left")
        errors.append(read.where(F.col("text").isNull()).select(
            "site", "url", F.coalesce("error", F.lit("not fetched")).alias("error")))
        good = read.where(F.col("text").isNotNull())
        index = is_sitemap_index(F.col("text"))
        found.append(parse_sitemap(good.where(~index)).select(
            "site", "url", (F.col("pos") + (depth << 40)).alias("pos")))
        if depth == max_depth or level.isEmpty():
            break
        level = parse_sitemap(good.where(index)).select("site", "url").distinct()
    urls, failed = found[0], errors[0]
    for more, worse in zip(found[1:], errors[1:]):
        urls, failed = urls.unionByName(more), failed.unionByName(worse)
    return urls.groupBy("site", "url").agg(F.min("pos").alias("pos")), failed


# --- llms.txt -----------------------------------------------------------------------------


def parse_llms_txt(files: DataFrame) -> DataFrame:
    """``site, file, section, title, url, line``: markdown links and bare URLs.

    ``##`` and deeper headings open a section. A URL counts once per line. Relative links
    start at the host the file came from.
    """
    lines = lines_of(files)
    heading = trim_space(F.regexp_extract("line", HEADING, 1))
    is_heading = F.col("line").rlike(HEADING)
    opened = F.when(is_heading & F.col("line").startswith("##") & (heading != ""), heading)
    fill = W.partitionBy("site", "url").orderBy("line_no")
    base = F.coalesce(origin_of(F.col("url")), F.concat(F.lit("https://"), F.col("site")))

    def pieces(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(F.col("line"), F.lit(pattern), F.lit(group))

    markdown = F.transform(
        F.arrays_zip(pieces(MARKDOWN_LINK, 1).alias("t"), pieces(MARKDOWN_LINK, 2).alias("u")),
        lambda z, i: F.struct(normalize_url(z["u"], F.col("_base")).alias("key"), i.alias("pos"),
                              trim_space(z["t"]).alias("title")))
    bare = F.transform(
        pieces(BARE_URL, 0),
        lambda u, i: F.struct(normalize_url(u).alias("key"), (i + F.lit(1_000_000)).alias("pos"),
                              F.lit("").alias("title")))
    sectioned = lines.withColumn(
        "section", F.coalesce(F.last(opened, ignorenulls=True).over(fill), F.lit("")))
    links = sectioned.where(~is_heading & (F.col("line").contains("http")
                                           | F.col("line").contains("]("))).withColumn(
        "_base", base).select(
        "site", F.col("url").alias("file"), "section", F.col("line_no").alias("line"),
        F.explode(first_per_key(
            F.filter(F.concat(markdown, bare), lambda x: x["key"].isNotNull()), "key")).alias("l"))
    return links.select("site", "file", "section", F.col("l.title").alias("title"),
                        F.col("l.key").alias("url"), "line")
