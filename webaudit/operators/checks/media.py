"""Insecure subresources and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...config import AuditConfig
from ...functions.lets import first_per_key
from ...functions.texts import is_blank
from ...functions.urls import url_belongs_to
from .common import explode_issues, issue, no_issues


def mixed_content_issues(cfg: AuditConfig) -> Column:
    """``http://`` resources on an ``https://`` page; the first sighting of a URL counts."""
    def seen(where: Column, url: Column, pos: Column) -> Column:
        return F.struct(url.alias("key"), pos.alias("pos"), where.alias("where"))

    kind = "array<struct<key:string,pos:int,where:string>>"
    resources = F.coalesce(F.transform(
        F.col("dom.resources"), lambda r, i: seen(r["where"], r["url"], i)), F.array().cast(kind))
    requests = F.coalesce(F.transform(
        F.col("requestUrls"), lambda u, i: seen(F.lit("network"), u, i + F.lit(1_000_000_000))),
        F.array().cast(kind))
    insecure = F.filter(F.concat(resources, requests), lambda x: x["key"].startswith("http://"))
    return F.when(
        F.col("dom").isNotNull() & F.col("finalUrl").startswith("https://"),
        F.transform(first_per_key(insecure, "key"), lambda x: issue(
            "mixed-content", "error", "insecure-subresource",
            "Insecure http:// resource loaded on an https:// page",
            target=x["key"], where=x["where"])),
    ).otherwise(no_issues())


def image_issues(cfg: AuditConfig) -> Column:
    """Images that did not decode, and images without an ``alt`` attribute; once per source."""
    usable = F.filter(
        F.coalesce(F.col("dom.images"),
                   F.array().cast("array<struct<src:string,alt:string,naturalWidth:int>>")),
        lambda m: ~is_blank(m["src"]) & ~url_belongs_to(m["src"], cfg.trackingHosts))
    broken = F.array_distinct(F.transform(
        F.filter(usable, lambda m: m["naturalWidth"] == 0), lambda m: m["src"]))
    unlabelled = F.array_distinct(F.transform(
        F.filter(usable, lambda m: m["alt"].isNull()), lambda m: m["src"]))
    return F.concat(
        F.transform(broken, lambda s: issue(
            "images", "error", "broken-image", "Image failed to load", target=s, where="img[src]")),
        F.transform(unlabelled, lambda s: issue(
            "images", "warning", "missing-alt", "Image has no alt attribute", target=s,
            where="img[src]")))


def check_mixed_content(captures: DataFrame, cfg: AuditConfig) -> DataFrame:
    return explode_issues(captures, mixed_content_issues(cfg))


def check_images(captures: DataFrame, cfg: AuditConfig) -> DataFrame:
    return explode_issues(captures, image_issues(cfg))
