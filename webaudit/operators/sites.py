"""Configuration of many sites at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ALL_CHECKS, SITE_SETTINGS, AuditConfig
from ..functions.urls import host_of, normalize_url
from .skew import salted_join


def with_defaults(sites: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Fill each setting a site leaves open; thresholds are merged one by one."""
    columns = {}
    for name, kind in SITE_SETTINGS.items():
        default = F.lit(getattr(cfg, name)).cast(kind)
        own = F.col(name).cast(kind) if name in sites.columns else F.lit(None).cast(kind)
        columns[name] = F.coalesce(own, default)
    return sites.withColumns(columns)


def attach_site_config(captures: DataFrame, sites: DataFrame,
                       spread: Sequence[str] = ("url", "seq")) -> DataFrame:
    """Add ``siteConfig`` to captures; use with ``cfg.with_(perSite=True)``.

    ``spread`` names columns that tell the rows of a site apart.
    """
    fields = [(F.col(n) if n in sites.columns else F.lit(None)).cast(k).alias(n)
              for n, k in SITE_SETTINGS.items()]
    settings = sites.select("site", F.struct(*fields).alias("siteConfig"))
    return salted_join(captures, settings, ["site"], spread, "left")


def validate_sites(sites: DataFrame) -> DataFrame:
    """One ``site, error`` row per site configuration that cannot give a meaningful run.

    Optional array columns: ``forbiddenHosts, localhostHosts, checks, disabledChecks,
    customIds``. The first problem found is the one reported.
    """
    def array(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast("array<string>")) if name in sites.columns \
            else F.array().cast("array<string>")

    builtin = F.array(*map(F.lit, ALL_CHECKS))
    custom = array("customIds")
    known = F.concat(builtin, custom)
    base = F.col("baseUrl")
    chosen = F.when(F.size(array("checks")) > 0, array("checks")).otherwise(known)
    patterns = F.concat(array("forbiddenHosts"), array("localhostHosts"))
    too_wide = F.get(F.filter(patterns, lambda p: F.regexp_replace(p, "[*.]", "") == ""), F.lit(0))
    clash = F.get(F.filter(custom, lambda c: F.array_contains(builtin, c)), F.lit(0))
    unknown = F.array_join(F.filter(chosen, lambda c: ~F.array_contains(known, c)), ", ")
    unknown_off = F.array_join(
        F.filter(array("disabledChecks"), lambda c: ~F.array_contains(known, c)), ", ")
    left = F.filter(chosen, lambda c: ~F.array_contains(array("disabledChecks"), c))
    error = (
        F.when(F.coalesce(base, F.lit("")) == "", F.lit("baseUrl is required"))
        .when(host_of(base).isNull(), F.concat(F.lit("baseUrl is not a valid absolute URL: "), base))
        .when(normalize_url(base).isNull(), F.concat(F.lit("baseUrl must be http(s), got: "), base))
        .when(too_wide.isNotNull(),
              F.concat(F.lit("Host pattern '"), too_wide, F.lit("' matches every host")))
        .when(clash.isNotNull(), F.concat(F.lit("Custom check id '"), clash,
                                          F.lit("' collides with a builtin check")))
        .when(unknown != "", F.concat(F.lit("Unknown check(s): "), unknown))
        .when(unknown_off != "", F.concat(F.lit("Unknown disabled check(s): "), unknown_off))
        .when((F.size(array("disabledChecks")) > 0) & (F.size(left) == 0),
              F.lit("Every check is disabled")))
    return sites.select("site", error.alias("error")).where("error IS NOT NULL")


def landing_pages(sites: DataFrame, locales: Sequence[str]) -> DataFrame:
    """``site, url`` of every landing page to probe for a consent banner."""
    from ..functions.texts import landing_routes
    base = F.concat(F.lit("https://"), F.col("site"))
    if "baseUrl" in sites.columns:
        base = F.coalesce(F.regexp_replace("baseUrl", "/+$", ""), base)
    return sites.select("site", F.explode(landing_routes(base, locales)).alias("url"))
