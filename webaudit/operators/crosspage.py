"""Findings that need more than one page: duplicates, hreflang, sitemap and llms.txt drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.lets import explode_rows
from ..functions.texts import is_blank, truncate
from ..functions.urls import dedupe_key, normalize_url
from .checks.common import issue
from .skew import first_k_list, salted_join

LISTED = 50  # fixed value: URLs named in a drift finding
INLINE = 1000  # URLs that a duplicate finding names; all of them are members


def ok_pages(captures: DataFrame) -> DataFrame:
    return captures.where(F.col("status").between(200, 299))


def _as_issues(df: DataFrame, item: Column) -> DataFrame:
    return df.select("site", F.lit(None).cast("bigint").alias("seq"), item.alias("i")).select(
        "site", "seq", "i.*")


def _valued(captures: DataFrame, field: str) -> DataFrame:
    return ok_pages(captures).select(
        "site", F.col(f"dom.{field}").alias("value"), "seq", "url").where(~is_blank(F.col("value")))


def _grouped(captures: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """Groups of two pages or more, and the pages in them. Counts combine before the shuffle."""
    pages = _valued(captures, field)
    groups = pages.groupBy("site", "value").agg(
        F.count("*").alias("n"), F.min(F.struct("seq", "url"))["url"].alias("first_url")).where(
        "n >= 2")
    return groups, salted_join(pages, groups, ["site", "value"], ["seq", "url"])


def duplicate_members(captures: DataFrame, field: str = "title", chunk: int = INLINE) -> DataFrame:
    """Every page of every group sharing a title or description: ``site, value, seq, url, rank, chunk``.

    ``rank`` numbers a group's pages from 0 in crawl order, without gaps; ``chunk`` holds ``chunk``
    of them. Pages are numbered within stretches of crawl positions, each in its own task, and
    the stretches' counts are summed up; so a group is never in one task, only a row for each of
    its stretches.
    """
    _, members = _grouped(captures, field)
    placed = members.withColumn("_stretch", F.floor(F.coalesce("seq", F.lit(-1)) / chunk))
    group = ["site", "value"]
    before = W.partitionBy(*group).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "_stretch").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = W.partitionBy(*group, "_stretch").orderBy("seq", "url")
    ranked = placed.withColumn("_at", F.row_number().over(inside) - 1).join(
        sums.drop("_n"), [*group, "_stretch"])
    rank = F.col("_before") + F.col("_at")
    return ranked.select(*group, "seq", "url", rank.alias("rank"),
                         F.floor(rank / chunk).alias("chunk"))


def duplicate_groups(captures: DataFrame, field: str = "title", inline: int = INLINE) -> DataFrame:
    """``site, value, n, first_url, urls``: a row per group, with its first ``inline`` pages in crawl order.

    The list is the only thing that is bounded; ``duplicate_members`` has every page.
    """
    groups, members = _grouped(captures, field)
    lists = first_k_list(members, ["site", "value"], [F.col("seq"), F.col("url")], "url", inline,
                         "urls", ["seq", "url"])
    return groups.join(lists, ["site", "value"]).select("site", "value", "n", "first_url", "urls")


def duplicate_parts(captures: DataFrame, field: str = "title", inline: int = INLINE) -> DataFrame:
    """``site, value, n, first_url, part, urls``: every page of every group, in bounded lists.

    A group of up to ``inline`` pages is one row, with ``part`` 0. A larger one has a row for
    each stretch of ``inline`` crawl positions that it touches, numbered by the stretch, so
    no list outgrows a row and no task has a whole group. Pages keep their crawl order.
    """
    _, members = _grouped(captures, field)
    stretch = F.when(F.col("n") > inline, F.floor(F.col("seq") / inline)).otherwise(0)
    listed = members.groupBy("site", "value", "n", "first_url", stretch.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("m"))
    return listed.select("site", "value", "n", "first_url", "part", F.col("m.url").alias("urls"))


def duplicate_issues(captures: DataFrame, inline: int = INLINE) -> DataFrame:
    """A finding per group of duplicates, naming its pages.

    A group above ``inline`` pages names the first ones and how many more there are.
    """
    count = F.col("n").cast("string")
    more = F.when(F.col("n") > inline, F.concat(
        F.lit("\n… and "), (F.col("n") - inline).cast("string"), F.lit(" more"))).otherwise("")
    urls = F.concat(F.array_join("urls", "\n"), more)
    titles = _as_issues(duplicate_groups(captures, "title", inline), issue(
        "cross-page", "warning", "duplicate-title",
        F.concat(count, F.lit(' pages share the title "'), truncate(F.col("value"), 80), F.lit('"')),
        page_url=F.col("first_url"), detail=urls))
    descriptions = _as_issues(duplicate_groups(captures, "metaDescription", inline), issue(
        "cross-page", "warning", "duplicate-meta-description",
        F.concat(count, F.lit(" pages share the same meta description")),
        page_url=F.col("first_url"),
        detail=F.concat(F.lit('"'), truncate(F.col("value"), 100), F.lit('"\n'), urls)))
    return titles.unionByName(descriptions)


def hreflang_edges(captures: DataFrame) -> DataFrame:
    """``site, seq, url, self_key, hreflang, alt_key`` of pages that answered 2xx."""
    pages = explode_rows(ok_pages(captures), "dom.hreflang", "a", "site", "seq", "url",
                         dedupe_key("finalUrl").alias("self_key")).where("self_key IS NOT NULL")
    return pages.select("site", "seq", "url", "self_key", F.col("a.hreflang").alias("hreflang"),
                        dedupe_key("a.href").alias("alt_key")).where("alt_key IS NOT NULL")


def hreflang_issues(captures: DataFrame) -> DataFrame:
    """Alternates that were crawled for the same site and do not point back.

    Each crawled URL of a site is reduced to the alternates of its last capture, so one join answers
    both "was it crawled" and "does it point back".
    """
    alternates = F.transform(F.coalesce(
        F.col("dom.hreflang"), F.array().cast("array<struct<hreflang:string,href:string>>")),
        lambda a: dedupe_key(a["href"]))
    crawled = (ok_pages(captures)
               .select("site", dedupe_key("finalUrl").alias("alt_key"), "seq",
                       alternates.alias("back"))
               .where("alt_key IS NOT NULL").groupBy("site", "alt_key")
               .agg(F.max_by("back", "seq").alias("back")))
    edges = hreflang_edges(captures).where("alt_key <> self_key")
    one_way = salted_join(edges, crawled, ["site", "alt_key"], ["seq", "self_key"]).where(
        ~F.coalesce(F.array_contains("back", F.col("self_key")), F.lit(False)))
    tag = F.concat(F.lit("link[hreflang="), F.col("hreflang"), F.lit("]"))
    found = issue("cross-page", "warning", "hreflang-not-reciprocal",
                  F.concat(F.lit('Declares hreflang="'), F.col("hreflang"),
                           F.lit('" alternate that does not point back')),
                  target=F.col("alt_key"), where=tag)
    return one_way.select("site", "seq", found.alias("i")).select("site", "seq", "i.*")


def _keys(df: DataFrame, url: str, order: str) -> DataFrame:
    """Distinct URL identities per site, with their first position."""
    return df.select("site", dedupe_key(url).alias("key"), F.col(order).alias("pos")).where(
        "key IS NOT NULL").groupBy("site", "key").agg(F.min("pos").alias("pos"))


def missing_keys(have: DataFrame, want: DataFrame) -> DataFrame:
    """Keys of ``have`` that ``want`` lacks, counted and listed per site: ``site, n, urls``.

    Both sides hold each key once, so the anti join has no hot key.
    """
    absent = have.join(want, ["site", "key"], "left_anti")
    listed = first_k_list(absent, ["site"], [F.col("pos"), F.col("key")], "key", LISTED, "urls",
                          ["key"])
    return absent.groupBy("site").agg(F.count("*").alias("n")).join(listed, "site")


def sitemap_issues(captures: DataFrame, sitemap: DataFrame, cfg: AuditConfig,
                   bases: DataFrame | None = None) -> DataFrame:
    """One finding per site that has a sitemap lacking crawled pages.

    ``sitemap`` has ``site, url, pos``; ``bases`` (``site, baseUrl``) names the page it is about.
    """
    crawled = _keys(ok_pages(captures), "finalUrl", "seq")
    listed = _keys(sitemap, "url", "pos")
    has_sitemap = sitemap.select("site").distinct()
    drift = missing_keys(crawled, listed).join(has_sitemap, "site", "left_semi")
    page = F.lit(cfg.baseUrl) if cfg.baseUrl else F.concat(F.lit("https://"), F.col("site"))
    if bases is not None:
        drift, page = drift.join(bases, "site", "left"), F.coalesce("baseUrl", page)
    return _as_issues(drift, issue(
        "cross-page", "warning", "page-missing-from-sitemap",
        F.concat(F.col("n").cast("string"), F.lit(" crawled pages are not listed in the sitemap")),
        page_url=page, detail=F.array_join("urls", "\n")))


def llms_link_issues(links: DataFrame, link_status: DataFrame) -> DataFrame:
    """Dead, unreachable and moved URLs in llms.txt (no exemption for refusals)."""
    bad = link_status.where("status = 0 OR status >= 400 OR redirects > 0").select(
        F.col("url").alias("link_key"), "status", "redirects", "finalUrl", "error")
    joined = salted_join(links.withColumn("link_key", normalize_url("url")), bad, ["link_key"],
                         ["file", "line"])
    code = F.col("status")
    label = F.when(is_blank(F.col("title")), F.col("url")).otherwise(
        F.concat(F.lit('"'), truncate(F.col("title"), 60), F.lit('"')))
    line = F.col("line").cast("string")
    where = F.when(is_blank(F.col("section")), F.concat(F.lit("llms.txt line "), line)).otherwise(
        F.concat(F.lit('llms.txt section "'), F.col("section"), F.lit('", line '), line))

    def found(severity: str, rule: str, *message: Column, detail: Column | None = None) -> Column:
        return issue("llms-txt", severity, rule, F.concat(F.lit("llms.txt link "), label, *message),
                     target=F.col("url"), where=where, detail=detail, page_url=F.col("file"))

    item = (
        F.when(code == 0, found("error", "llms-txt-link-unreachable", F.lit(" is unreachable: "),
                                F.coalesce("error", F.lit("request failed"))))
        .when(code >= 400, found("error", "llms-txt-link-dead", F.lit(" returned "),
                                 code.cast("string")))
        .when(F.col("redirects") > 0, found(
            "warning", "llms-txt-link-redirects",
            F.lit(" redirects — update it to the final URL"),
            detail=F.concat(F.lit("-> "), F.coalesce("finalUrl", F.lit("(unknown)"))))))
    return _as_issues(joined, item)


def llms_coverage_issues(docs: DataFrame, links: DataFrame, sitemap: DataFrame) -> DataFrame:
    """One finding per site whose llms.txt leaves out sitemap URLs.

    ``docs`` has one row per llms.txt (``site, file``); ``links`` what they list.
    """
    listed = _keys(links.withColumn("pos", F.lit(0)), "url", "pos")
    totals = listed.groupBy("site").agg(F.count("*").alias("listed"))
    drift = missing_keys(_keys(sitemap, "url", "pos"), listed)
    rows = drift.join(docs, "site").join(totals, "site", "left")
    return _as_issues(rows, issue(
        "llms-txt", "info", "llms-txt-coverage",
        F.concat(F.lit("llms.txt lists "), F.coalesce("listed", F.lit(0)).cast("string"),
                 F.lit(" URLs; "), F.col("n").cast("string"),
                 F.lit(" sitemap URLs are not in it")),
        page_url=F.col("file"), detail=F.array_join("urls", "\n")))


def consent_issues(landing: DataFrame) -> DataFrame:
    """Findings of a first-visit probe: ``site, url, banner_visible, error``.

    With a column ``seq``, which numbers the visits, each finding has that of its visit.
    """
    failed = ~is_blank(F.col("error"))
    item = F.when(failed, issue(
        "consent-banner", "warning", "consent-banner-check-failed",
        F.concat(F.lit("Could not verify the consent banner: "), F.col("error")))).when(
        ~F.coalesce(F.col("banner_visible"), F.lit(False)), issue(
            "consent-banner", "error", "consent-banner-missing",
            "No cookie-consent banner appeared for a first-time visitor in a fresh, unseeded "
            "browser context"))
    seq = F.col("seq") if "seq" in landing.columns else F.lit(None)
    return landing.select("site", seq.cast("bigint").alias("seq"), item.alias("i")).where(
        "i IS NOT NULL").select("site", "seq", "i.*")
