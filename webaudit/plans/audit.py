"""The whole audit: one pass over the captures, and everything else from what it stores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import AuditConfig, CustomCheck
from ..functions.lets import explode_rows
from ..operators.checks import ROW_CHECKS, check_links, scan_text_files
from ..operators.checks.common import explode_issues
from ..operators.checks.http_status import (
    block_verdict, blocked_issue, is_blocked, unread_issue,
)
from ..operators.checks.links import explode_targets, judge_targets, link_targets_column
from ..operators.classify import classify_issues
from ..operators.crosspage import (
    consent_issues, duplicate_issues, duplicate_members, hreflang_issues, llms_coverage_issues,
    llms_link_issues, sitemap_issues,
)
from ..operators.frontier import judge_offers, skip_counts
from ..operators.host_patterns import LISTS, site_file_leaks, site_leaks
from ..operators.report import (
    SEVERITIES, counts_by_priority, counts_by_rule, counts_by_severity, filter_issues, run_name,
    top_findings,
)
from ..rules import rule_meta_df
from ..schemas import ISSUE_FIELDS
from ..session import cut_lineage, scratch_path
from ..sources.textfiles import (
    expand_sitemaps, origin_of, parse_llms_txt, parse_robots, sitemap_entries,
)


def custom_rules(cfg: AuditConfig) -> dict:
    return {rule: meta for c in cfg.customChecks for rule, meta in c.rules.items()}


def _survives_block(check: Column, rule: Column) -> Column:
    return (check == "forbidden-hosts") | (rule == "page-blocked")


def page_issues_column(cfg: AuditConfig) -> Column:
    """All findings that need the capture row alone, after the blocked-page cull."""
    enabled = cfg.enabled_checks()
    row_customs = {c.id: c.fn for c in cfg.customChecks if isinstance(c.fn, Column)}
    parts = []
    for name in enabled:
        if name in ROW_CHECKS:
            parts.append(ROW_CHECKS[name](cfg))
        elif name in row_customs:
            parts.append(row_customs[name])
    blocked = is_blocked()
    if "http-status" not in enabled:
        # A page nobody could read is reported whatever the run was limited to.
        parts.insert(0, F.when(blocked, F.array(blocked_issue(block_verdict()))).when(
            F.coalesce(F.col("domError"), F.lit("")) != "", F.array(unread_issue(False)))
            .otherwise(F.filter(F.array(unread_issue(False)), lambda _: F.lit(False))))
    found = F.concat(*parts)
    return F.filter(found, lambda i: ~blocked | _survives_block(i["check"], i["rule"]))


def run_page_checks(captures: DataFrame, cfg: AuditConfig, link_status: DataFrame | None = None
                    ) -> DataFrame:
    """Page findings: one scan for every row check, one join for link statuses.

    A check that is not enabled adds nothing to the plan.
    """
    enabled = cfg.enabled_checks()
    out = explode_issues(captures, page_issues_column(cfg))
    if "links" in enabled and link_status is not None:
        out = out.unionByName(check_links(captures.where(~is_blocked()), link_status, cfg))
    for custom in cfg.customChecks:
        if custom.id in enabled and not isinstance(custom.fn, Column):
            out = out.unionByName(_custom_issues(captures, link_status, custom))
    return filter_issues(out, cfg)


def _custom_issues(captures: DataFrame, link_status: DataFrame | None, custom: CustomCheck
                   ) -> DataFrame:
    """Rows of a DataFrame check; findings on blocked pages fall to the cull as well.

    A row is about the page that its ``site`` and ``seq`` name, as pages may share a URL. Without
    them it is about every page of its ``pageUrl``, and falls if one of those is blocked.
    """
    rows = custom.fn(captures, link_status)
    lacking = {c: F.lit(None).cast(t) for c, t in (("site", "string"), ("seq", "bigint"))
               if c not in rows.columns}
    no_seq, no_url = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    # A blocked page goes by its number and by its URL; a finding has one of the two.
    blocked = captures.where(is_blocked()).select(F.col("site").alias("_site"), F.inline(F.array(
        F.struct(F.col("seq").alias("_seq"), no_url.alias("_url")),
        F.struct(no_seq.alias("_seq"), F.col("url").alias("_url"))))).where(
        "_seq IS NOT NULL OR _url IS NOT NULL").distinct()
    seq = no_seq if lacking else F.col("seq")
    on = seq.eqNullSafe(F.col("_seq")) & F.when(seq.isNull(), F.col("pageUrl")).eqNullSafe(F.col("_url"))
    if "site" not in lacking:
        on &= F.col("site").eqNullSafe(F.col("_site"))
    return rows.join(blocked, on, "left_anti").withColumns(lacking).select("site", "seq", *ISSUE_FIELDS)


def run_cross_page_checks(captures: DataFrame, cfg: AuditConfig, sitemap: DataFrame,
                          llms_docs: DataFrame | None = None, llms: DataFrame | None = None,
                          link_status: DataFrame | None = None,
                          bases: DataFrame | None = None) -> DataFrame | None:
    enabled, parts = cfg.enabled_checks(), []
    if "cross-page" in enabled:
        parts += [duplicate_issues(captures), hreflang_issues(captures),
                  sitemap_issues(captures, sitemap, cfg, bases)]
    if "llms-txt" in enabled and llms is not None:
        if link_status is not None:
            parts.append(llms_link_issues(llms, link_status))
        parts.append(llms_coverage_issues(llms_docs, llms, sitemap))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class AuditResult:
    issues: DataFrame  # classified, stored
    counts: DataFrame  # per site and severity
    rules: DataFrame  # per site and rule, ranked
    members: DataFrame  # field, site, value, seq, url of every page with a duplicate text
    sitemap_errors: DataFrame | None = None  # site, url, error of files the walk could not read
    runs: DataFrame | None = None  # the summary row of each site's run
    skipped: DataFrame | None = None  # site, reason, n of offered URLs that the crawl left out
    totals: dict[str, int] | None = None  # of the page pass: pages, blocked, unread, retried, findings


def base_urls(captures: DataFrame, cfg: AuditConfig) -> DataFrame:
    """``site, baseUrl``: as configured, else the origin of the page a site's crawl began with."""
    given = (F.max(cfg.setting("baseUrl")) if cfg.perSite or cfg.baseUrl
             else F.lit(None).cast("string"))
    first = F.min_by(origin_of(F.col("url")), "seq")
    return captures.groupBy("site").agg(F.coalesce(given, first).alias("baseUrl"))


# What steps after the page pass read of a page.
SLIM_DOM = ("title", "metaDescription", "hreflang", "links")


def page_pass(captures: DataFrame, cfg: AuditConfig) -> tuple[DataFrame, dict[str, int]]:
    """One scan of the captures: findings of all row checks, and what later steps need, stored.

    The stored table has a row per page: its slim columns, its link targets and the array of its
    findings. Everything across pages runs from it, so the captures' large columns are read
    once, whatever the number of checks. Totals are observed while it is written.
    """
    spark = captures.sparkSession
    dom = F.when(F.col("dom").isNotNull(), F.struct(*[F.col(f"dom.{n}") for n in SLIM_DOM]))
    targets = F.when(~is_blocked(), link_targets_column(cfg))
    own = ["siteConfig"] if cfg.perSite else []
    judged = captures.withColumns({
        "blocked": is_blocked(), "targets": targets, "found": page_issues_column(cfg)})
    rows = judged.select("site", "seq", "url", "finalUrl", "status", "depth", "attempts", *own,
                         dom.alias("dom"), "blocked", "targets", "found")
    seen = Observation()
    observed = rows.observe(
        seen, F.count("*").alias("pages"), F.count_if("blocked").alias("blocked"),
        F.count_if(F.col("dom").isNull()).alias("unread"),
        F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).alias("retried"),
        F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("findings"))
    path = scratch_path(spark, "audit-pages")
    observed.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), seen.get


def crawl_skips(pages: DataFrame, cfg: AuditConfig, robots: DataFrame | None = None) -> DataFrame:
    """``site, reason, n``: why links found on the pages were no pages to crawl.

    Every link is an offer, in crawl order, judged as the crawl judges it: by scope, robots.txt
    rules, depth, page cap, and whether an earlier offer settled its URL.
    """
    own = ["siteConfig"] if cfg.perSite else []
    offers = explode_rows(pages, "dom.links", "l", "site", "seq", "finalUrl", "depth", *own,
                          pos="pos").select(
        "site", F.struct("seq", "pos").alias("seq"), F.col("l.href").alias("raw"),
        (F.col("depth") + 1).alias("depth"), F.col("finalUrl").alias("base"),
        F.col("finalUrl").alias("source"), *own)
    return skip_counts(judge_offers(offers, cfg, robots))


def run_rows(pages: DataFrame, counts: DataFrame, bases: DataFrame, cfg: AuditConfig,
             link_status: DataFrame | None = None, retries: DataFrame | None = None,
             skipped: DataFrame | None = None, started_at: str = "", finished_at: str = ""
             ) -> DataFrame:
    """The summary row of each site's run.

    ``linksChecked``: distinct targets of its pages that have a status. ``rateLimited``: fetches that
    were put back because the site asked for patience, from ``retries`` (``site, rateLimited``) or
    the pages' own attempts. ``skipped``: offers left out, by reason.
    """
    per_site = pages.groupBy("site").agg(
        F.count("*").alias("pagesCrawled"), F.count_if("blocked").alias("pagesBlocked"),
        F.sum(F.greatest(F.coalesce("attempts", F.lit(1)) - 1, F.lit(0))).alias("_again"))
    out = per_site.join(bases, "site", "left").join(counts, "site", "left")
    if link_status is None:
        out = out.withColumn("linksChecked", F.lit(0).cast("bigint"))
    else:
        # Distinct pairs combine before the shuffle; statuses have one row per URL.
        targets = explode_targets(pages, F.col("targets")).select("site", "linkUrl").distinct()
        checked = targets.join(link_status.select(F.col("url").alias("linkUrl")), "linkUrl", "left_semi")
        out = out.join(checked.groupBy("site").agg(F.count("*").alias("linksChecked")), "site", "left")
    if retries is not None:
        out = out.join(retries, "site", "left")
    else:
        out = out.withColumn("rateLimited", F.col("_again"))
    reasons = F.lit(None).cast("map<string,bigint>")
    if skipped is not None:
        # At most a row per reason, of which there are eight.
        out = out.join(skipped.groupBy("site").agg(F.map_from_entries(F.sort_array(
            F.collect_list(F.struct("reason", "n")))).alias("skipped")), "site", "left")
        reasons = F.coalesce("skipped", F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast("array<bigint>")))
    name = run_name(F.lit(cfg.runName), F.array(*map(F.lit, cfg.includePaths)).cast("array<string>"))
    started, finished = F.lit(started_at or None).cast("string"), F.lit(finished_at or None).cast("string")
    took = (F.to_timestamp(finished).cast("double") - F.to_timestamp(started).cast("double")) * 1000
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "site", name.alias("run"), "baseUrl", started.alias("startedAt"), finished.alias("finishedAt"),
        F.round(took).cast("bigint").alias("durationMs"), "pagesCrawled", "pagesBlocked",
        zero("linksChecked"), *map(zero, SEVERITIES), zero("rateLimited"), reasons.alias("skipped"))


def audit(captures: DataFrame, cfg: AuditConfig, files: DataFrame | None = None,
          link_status: DataFrame | None = None, landing: DataFrame | None = None,
          sitemap: DataFrame | None = None, filter_global: bool = False,
          sites: DataFrame | None = None, retries: DataFrame | None = None,
          started_at: str = "", finished_at: str = "") -> AuditResult:
    """Everything: page findings, cross-page findings, text files, consent, and the run's summary.

    The captures are read by the page pass alone, which stores a slim table; all else runs from it.
    Two things read them again: checks written as DataFrames, and per-site host patterns. Findings
    are stored too, so that counting them does not compute them again.

    ``files`` is a ``site_files`` table. Its sitemaps are walked from ``/sitemap.xml`` of each
    site's base URL and from ``extraSitemaps``, through indexes; the walk stores its levels. Its
    robots.txt files decide which links a crawl skips. ``sites`` may hold each site's own host
    patterns (``forbiddenHosts``, ``localhostHosts``). ``retries``: ``site, rateLimited`` of the fetch
    log. The report filters apply to page findings only, unless ``filter_global`` is set.
    """
    enabled, spark = cfg.enabled_checks(), captures.sparkSession
    listed = sites is not None and any(name in sites.columns for name in LISTS)
    in_pass = cfg.with_(checks=[c for c in enabled if c != "forbidden-hosts"],
                        disabledChecks=()) if listed and "forbidden-hosts" in enabled else cfg
    pages, totals = page_pass(captures, in_pass)
    out = pages.select("site", F.col("seq"), F.explode("found").alias("i")).select("site", "seq", "i.*")
    if "links" in enabled and link_status is not None:
        own = ("siteConfig",) if cfg.perSite else ()
        out = out.unionByName(judge_targets(
            explode_targets(pages, F.col("targets"), *own), link_status, cfg))
    if listed and "forbidden-hosts" in enabled:
        out = out.unionByName(site_leaks(captures, sites, cfg))
    for check in cfg.customChecks:
        if check.id in enabled and not isinstance(check.fn, Column):
            out = out.unionByName(_custom_issues(captures, link_status, check))
    out = filter_issues(out, cfg)
    docs = llms = failed = robots = None
    bases = base_urls(pages, cfg)
    extra: list[DataFrame] = []
    if files is not None:
        texts = files.where((F.col("kind") == "llms") & F.col("text").isNotNull())
        docs = texts.select("site", F.col("url").alias("file")).distinct()
        llms = cut_lineage(parse_llms_txt(texts), "audit-llms")
        robots = parse_robots(files.where("kind = 'robots'"))
        if "forbidden-hosts" in enabled:
            extra.append(site_file_leaks(texts, sites, cfg) if listed else scan_text_files(texts, cfg))
        if sitemap is None:
            sitemap, failed = expand_sitemaps(
                sitemap_entries(bases, cfg.includePaths, cfg.excludePaths, cfg.extraSitemaps,
                                cfg.knownLocales), files.where("kind = 'sitemap'"))
            sitemap = cut_lineage(sitemap, "audit-sitemap")
    walked = failed is not None
    if sitemap is None:
        sitemap = spark.createDataFrame([], "site string, url string, pos bigint")
    cross = run_cross_page_checks(pages, cfg, sitemap, docs, llms, link_status,
                                  bases if walked else None)
    if cross is not None:
        extra.append(cross)
    if landing is not None and "consent-banner" in enabled:
        extra.append(consent_issues(landing))
    for part in extra:
        out = out.unionByName(filter_issues(part, cfg) if filter_global else part)
    rules = custom_rules(cfg)
    meta = rule_meta_df(spark, rules) if rules else None
    classified = cut_lineage(classify_issues(out, meta), "audit-issues")
    members = [duplicate_members(pages, name).select(F.lit(name).alias("field"), "*")
               for name in ("title", "metaDescription")]
    counts = counts_by_severity(classified, "site")
    skipped = crawl_skips(pages, cfg, robots)
    runs = run_rows(pages, counts, bases, cfg, link_status, retries, skipped, started_at, finished_at)
    return AuditResult(classified, counts, counts_by_rule(classified, "site"),
                       members[0].unionByName(members[1]), failed, runs, skipped, totals)


def summary(classified: DataFrame) -> dict[str, DataFrame]:
    """What a reader wants first."""
    order = [F.col("pageUrl"), F.col("rule"), F.col("where"), F.col("target"), F.col("message")]
    return {
        "counts": counts_by_severity(classified),
        "priorities": counts_by_priority(classified),
        "rules": counts_by_rule(classified),
        "findings": top_findings(classified, [], order),
    }
