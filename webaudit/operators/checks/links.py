"""Statuses of link targets, joined back to the pages that link to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...config import AuditConfig
from ...functions.lets import first_per_key
from ...functions.texts import is_blank, truncate
from ...functions.urls import matches_ignore_pattern, normalize_url, url_belongs_to
from ..skew import salted_join
from .common import explode_issues, issue, issues_when

CHECK = "links"

# Statuses that mean "refused us", not "broken".
REFUSAL_STATUSES = (400, 401, 403, 405, 429, 999)


def link_targets_column(cfg: AuditConfig) -> Column:
    """A page's distinct link targets as an array of ``key, pos, text``, with the first link's text."""
    found = F.transform(
        F.col("dom.links"),
        lambda x, i: F.struct(normalize_url(x["href"]).alias("key"), i.alias("pos"),
                              x["text"].alias("text")))
    wanted = F.filter(found, lambda x: x["key"].isNotNull()
                      & ~matches_ignore_pattern(x["key"], cfg.ignorePatterns))
    return first_per_key(wanted, "key")


def explode_targets(pages: DataFrame, targets: Column, *keep: str) -> DataFrame:
    return (pages.select("site", "seq", "url", *keep, F.explode(targets).alias("l"))
            .select("site", "seq", "url", *keep, F.col("l.key").alias("linkUrl"),
                    F.col("l.text").alias("text")))


def link_targets(captures: DataFrame, cfg: AuditConfig, *keep: str) -> DataFrame:
    """One row per page and distinct link target: ``linkUrl`` and the first link's text."""
    return explode_targets(captures, link_targets_column(cfg), *keep)


def noteworthy(slow_ms: Column) -> Column:
    """Probe results that can yield a finding; healthy ones need no join at all."""
    return ((F.col("status") == 0) | (F.col("status") >= 400) | (F.col("redirects") > 0)
            | (F.col("durationMs") > slow_ms))


def link_issues(cfg: AuditConfig) -> Column:
    """Issues of one (page, link, status) row. Refusals are tested before server errors."""
    code, url = F.col("linkStatus"), F.col("linkUrl")
    label = F.when(is_blank(F.col("text")), F.lit("(no text)")).otherwise(
        F.concat(F.lit('"'), truncate(F.col("text"), 60), F.lit('"')))
    shown = code.cast("string")
    known = url_belongs_to(url, cfg.botHostileHosts)

    def found(severity: Column | str, rule: str, *message: Column, detail: Column | None = None):
        return issue(CHECK, severity, rule, F.concat(F.lit("Link "), label, *message),
                     target=url, where="a[href]", detail=detail)

    returned = (F.lit(" returned "), shown)
    main = (
        F.when(code == 0, found("error", "link-unreachable", F.lit(" is unreachable: "),
                                F.coalesce(F.col("error"), F.lit("request failed"))))
        .when(code.isin(*REFUSAL_STATUSES), found(
            F.when(known, "info").otherwise("warning"), "link-refused", *returned,
            F.lit(" to an automated request"),
            detail=F.when(known, "host is known to block bots — a human visitor is likely fine")
            .otherwise("may be anti-bot protection rather than a broken link; verify by hand")))
        .when(code >= 500, found("error", "link-server-error", *returned))
        .when(code >= 400, found("error", "link-dead", *returned))
        .when(F.col("redirects") > 0, found(
            "warning", "link-redirects", F.lit(" redirects"),
            detail=F.concat(F.lit("-> "), F.coalesce(F.col("linkFinalUrl"), F.lit("(unknown)")))))
    )
    slow = found("warning", "link-slow", F.lit(" took "), F.col("durationMs").cast("string"),
                 F.lit("ms to respond"))
    return issues_when(
        (F.lit(True), main),
        ((code != 0) & (F.col("durationMs") > cfg.setting("slowLinkMs")), slow))


def check_links(captures: DataFrame, link_status: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Findings about the targets of the captures' links."""
    keep = ("siteConfig",) if cfg.perSite else ()
    return judge_targets(link_targets(captures, cfg, *keep), link_status, cfg)


def judge_targets(targets: DataFrame, link_status: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Findings about rows of ``link_targets``.

    Only noteworthy statuses are joined, so the shared healthy links of every page's
    header and footer fall away before the shuffle; what stays hot is salted.
    """
    limit = F.lit(-1) if cfg.perSite else cfg.setting("slowLinkMs")
    status = link_status.where(noteworthy(limit)).select(
        F.col("url").alias("linkUrl"), F.col("status").alias("linkStatus"),
        F.col("finalUrl").alias("linkFinalUrl"), "redirects", "error", "durationMs")
    joined = salted_join(targets, status, ["linkUrl"], spread=["site", "url"])
    return explode_issues(joined, link_issues(cfg))
