"""Which offered URLs a crawl takes, and a replay of the crawl over a link table.

An offer is judged by its place in the order of offers: the first one a URL may be judged on
decides, later ones are duplicates. Per-URL facts come from aggregates, and the page cap from
a two-round top-k, so neither a link shown on every page nor one giant site is handled by a
single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.lets import explode_rows
from ..functions.urls import (
    dedupe_key, locale_of_path, matches_ignore_pattern, path_in_prefixes, strip_www, url_parts,
)
from ..session import cut_lineage
from ..sources.textfiles import allowed_by, robots_by_site
from .sites import attach_site_config
from .skew import salted_join, top_k

VERDICT = "reason"  # NULL = accepted


def seed_offers(sitemap: DataFrame, llms: DataFrame, sites: DataFrame) -> DataFrame:
    """Seeds in the order a crawl offers them: sitemap, llms.txt, then the base URL."""
    def offers(df: DataFrame, source: str, rank: int, order: str) -> DataFrame:
        return df.select("site", F.struct(F.lit(rank).alias("rank"),
                                          F.col(order).cast("bigint").alias("pos")).alias("seq"),
                         F.col("url").alias("raw"), F.lit(0).alias("depth"),
                         F.lit(None).cast("string").alias("base"), F.lit(source).alias("source"))

    start = F.concat(F.lit("https://"), F.col("site"))
    if "baseUrl" in sites.columns:
        start = F.coalesce("baseUrl", start)
    base = sites.select("site", start.alias("url"), F.lit(0).alias("pos"))
    return offers(sitemap, "sitemap", 0, "pos").unionByName(
        offers(llms, "llms.txt", 1, "line")).unionByName(offers(base, "seed", 2, "pos"))


def scope_reason(cfg: AuditConfig, robots_ok: Column) -> Column:
    """Why a usable URL is out of scope for its site, or NULL. Needs ``_u`` and ``site``."""
    path = F.col("_u.path")
    locale = locale_of_path(path, cfg.knownLocales)
    wrong_locale = (locale.isNotNull() & ~locale.isin(*cfg.locales)) if cfg.locales else F.lit(False)
    if cfg.includePaths:
        outside = ~path_in_prefixes(path, cfg.includePaths, cfg.knownLocales)
    elif cfg.excludePaths:
        outside = path_in_prefixes(path, cfg.excludePaths, cfg.knownLocales)
    else:
        outside = F.lit(False)
    return (
        F.when(~strip_www(F.col("_u.host")).eqNullSafe(strip_www(cfg.own_host())), "off-site")
        .when(matches_ignore_pattern(F.col("_u.url"), cfg.ignorePatterns), "ignored")
        .when(~robots_ok, "robots")
        .when(wrong_locale, "wrong-locale")
        .when(outside, "out-of-scope-path")
    )


def parse_offers(offers: DataFrame, cfg: AuditConfig, robots: DataFrame | None = None
                 ) -> DataFrame:
    """Add ``url, key, scope`` to rows with ``site, raw, base``: what needs no other offer.

    ``robots`` has one row per site (``robots_by_site``). With ``perSite``, offers carry
    ``siteConfig``.
    """
    parsed = offers.withColumn("_u", url_parts("raw", F.coalesce("base", F.lit(""))))
    robots_ok = F.lit(True)
    if robots is not None and cfg.respectRobots:
        parsed = salted_join(parsed, robots, ["site"], ["seq"], "left")
        target = F.concat(F.col("_u.path"), F.when(F.col("_u.query") == "", F.lit("")).otherwise(
            F.concat(F.lit("?"), F.col("_u.query"))))
        robots_ok = allowed_by(F.col("disallow"), F.col("allow"), target)
    return parsed.select(*offers.columns, F.col("_u.url").alias("url"),
                         F.col("_u.key").alias("key"),
                         scope_reason(cfg, robots_ok).alias("scope"))


def settle_offers(offers: DataFrame, cfg: AuditConfig, seen: DataFrame | None = None,
                  taken: DataFrame | None = None) -> DataFrame:
    """Add ``reason`` (NULL = accepted) to parsed offers, by their place in the order.

    ``seen`` (``site, key``) holds identities already settled and ``taken`` (``site, taken``)
    the pages already accepted, when the offers continue an earlier batch.
    """
    judged = offers.withColumn("_eligible", F.col("depth") <= cfg.setting("maxDepth"))
    counted = judged.where("key IS NOT NULL AND _eligible").select(
        "site", "key", "seq", "scope", F.lit(False).alias("_settled"),
        cfg.setting("maxPages").alias("_limit"))
    if seen is not None:
        blank = [F.lit(None).cast(offers.schema[c].dataType).alias(c) for c in ("seq", "scope")]
        counted = counted.unionByName(seen.select(
            "site", "key", *blank, F.lit(True).alias("_settled"),
            F.lit(None).cast("int").alias("_limit")))
    per_key = counted.groupBy("site", "key").agg(
        F.min(F.when(F.col("scope").isNull(), F.col("seq"))).alias("_in"),
        F.min(F.when(F.col("scope").isNotNull(), F.col("seq"))).alias("_out"),
        F.max("_settled").alias("_seen"), F.max("_limit").alias("_limit"))
    candidates = per_key.where(
        "NOT _seen AND _in IS NOT NULL AND (_out IS NULL OR _in < _out)")
    accepted = _within_cap(candidates, cfg, taken).select("site", "key", F.lit(True).alias("_accepted"))
    marks = per_key.join(accepted, ["site", "key"], "left").select(
        "site", "key", "_seen",
        F.when(F.col("_accepted"), F.col("_in")).otherwise(F.col("_out")).alias("_mark"))
    joined = salted_join(judged, marks, ["site", "key"], ["seq"], "left")
    reason = (
        F.when(F.col("key").isNull(), "invalid")
        .when(F.col("_seen") | (F.col("seq") > F.col("_mark")), "duplicate")
        .when(~F.col("_eligible"), "too-deep")
        .when(F.col("seq") == F.col("_mark"), F.col("scope"))
        .otherwise("max-pages"))
    return joined.select(*[c for c in offers.columns if c not in ("scope", "siteConfig")], reason.alias(VERDICT))


def _within_cap(candidates: DataFrame, cfg: AuditConfig, taken: DataFrame | None) -> DataFrame:
    """The first candidates of each site, up to its page cap. Those without a cap are not ranked."""
    if cfg.maxPages is None and not cfg.perSite:
        return candidates
    limit = F.col("_limit") if cfg.perSite else F.lit(cfg.maxPages)
    capped = candidates.where("_limit IS NOT NULL")
    ranked = top_k(capped, ["site"], [F.col("_in")], limit, ["key"], rank="_rank")
    if taken is not None:
        ranked = ranked.join(taken, "site", "left").where(
            F.col("_rank") + F.coalesce("taken", F.lit(0)) <= limit)
    kept = ranked.select(*candidates.columns)
    return kept.unionByName(candidates.where("_limit IS NULL")) if cfg.maxPages is None else kept


def judge_offers(offers: DataFrame, cfg: AuditConfig, robots: DataFrame | None = None,
                 sites: DataFrame | None = None) -> DataFrame:
    """``url, key, reason`` for offers ``site, seq, raw, depth, base, source``.

    ``robots`` is a rule table from ``parse_robots``; ``sites`` holds each site's own
    settings and is needed with ``perSite``.
    """
    if sites is not None:
        offers = attach_site_config(offers, sites, ["seq", "raw"])
    compiled = robots_by_site(robots) if robots is not None and cfg.respectRobots else None
    return settle_offers(parse_offers(offers, cfg, compiled), cfg)


def skip_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col(VERDICT).isNotNull()).groupBy("site", VERDICT).agg(
        F.count("*").alias("n"))


def link_edges(captures: DataFrame) -> DataFrame:
    """The link graph: ``site, src_url, dst_url, seq`` (page order, then place on the page)."""
    links = explode_rows(captures, "dom.links", "l", "site", F.col("finalUrl").alias("src_url"),
                         "seq", pos="pos")
    return links.select("site", "src_url", F.col("l.href").alias("dst_url"),
                        F.struct("seq", "pos").alias("seq"))


def found_on(edges: DataFrame) -> DataFrame:
    """Per link target, the first page that ships the link."""
    return edges.withColumn("key", dedupe_key("dst_url")).where("key IS NOT NULL").groupBy(
        "site", "key").agg(F.min_by("src_url", "seq").alias("found_on"))


def crawl_frontier(seeds: DataFrame, edges: DataFrame, cfg: AuditConfig,
                   robots: DataFrame | None = None, sites: DataFrame | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    """Replay a crawl breadth-first: ``(pages, skipped)``.

    ``seeds`` are offers at depth 0; ``edges`` has ``site, src_url, dst_url, seq``. Pages come
    out with their least depth and the page that led to them. ``sites`` as in ``judge_offers``. Each level is written to
    reliable storage, so lineage stays short and a lost executor costs one level at most.
    """
    compiled = None
    if robots is not None and cfg.respectRobots:
        compiled = cut_lineage(robots_by_site(robots), "robots")
    links = edges.select(
        "site", dedupe_key("src_url").alias("src_key"), F.col("src_url").alias("base"),
        F.col("dst_url").alias("raw"), "seq")
    deepest, own = cfg.maxDepth, []
    if sites is not None:
        links = attach_site_config(links, sites, ["seq"])
        seeds = attach_site_config(seeds, sites, ["seq", "raw"])
        own = ["siteConfig"]
        if "maxDepth" in sites.columns:
            deepest = max(deepest, sites.agg(F.max("maxDepth")).first()[0] or 0)
    # Each link is parsed and scoped once, before the loop that only orders and counts.
    graph = cut_lineage(parse_offers(links, cfg, compiled), "graph")
    offers, seen, taken = parse_offers(seeds, cfg, compiled), None, None
    pages, skipped = [], []
    for _ in range(deepest + 2):
        level = cut_lineage(settle_offers(offers, cfg, seen, taken), "level")
        accepted = level.where(F.col(VERDICT).isNull())
        pages.append(accepted.select("site", "url", "key", "depth", "source"))
        skipped.append(skip_counts(level))
        settled = level.where(
            "key IS NOT NULL AND (reason IS NULL OR reason NOT IN "
            "('duplicate', 'too-deep', 'max-pages'))").select("site", "key").distinct()
        seen = settled if seen is None else seen.unionByName(settled)
        if accepted.isEmpty():
            break
        taken = _union(pages).groupBy("site").agg(F.count("*").alias("taken"))
        # A page settles once, so each side of this join names a source page once or the
        # links of one page; the links spread over the salts.
        offers = salted_join(
            graph, accepted.select("site", F.col("key").alias("src_key"), "depth"),
            ["site", "src_key"], ["seq"],
        ).select("site", "seq", "raw", (F.col("depth") + 1).alias("depth"), "base",
                 F.col("base").alias("source"), "url", "key", "scope", *own)
    skips = _union(skipped).groupBy("site", VERDICT).agg(F.sum("n").alias("n"))
    return _union(pages), skips


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def probe_worklist(captures: DataFrame, cfg: AuditConfig, llms: DataFrame | None = None
                   ) -> DataFrame:
    """Each URL whose status is wanted, once: page links and llms.txt entries in scope."""
    from .checks.links import link_targets

    urls = link_targets(captures, cfg).select(F.col("linkUrl").alias("url"))
    if llms is not None:
        urls = urls.unionByName(llms.select("url").where(
            ~matches_ignore_pattern(F.col("url"), cfg.ignorePatterns)))
    return urls.distinct()
