"""JavaScript errors, failed subresources, and an overlay left standing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...config import AuditConfig
from ...functions.lets import first_per_key
from ...functions.texts import noise_text, truncate
from ...functions.urls import url_belongs_to
from .common import explode_issues, issue, issues_when

CHECK = "console-errors"


def console_issue(entry: Column, cfg: AuditConfig) -> Column:
    text, kind = entry["text"], entry["type"]
    noise = noise_text(text, cfg.trackingHosts)
    warning = kind == "warning"
    short = truncate(text, 200)
    return issue(
        CHECK,
        F.when(warning | noise, "info").otherwise("error"),
        F.when(warning, "console-warning").when(kind == "pageerror", "uncaught-exception")
        .otherwise("console-error"),
        F.concat(F.when(warning, "console.warn: ").when(kind == "pageerror", "Uncaught exception: ")
                 .otherwise("console.error: "), short),
        where=entry["location"],
        detail=F.when(~warning & noise, "third-party script — downgraded to info"))


def request_issue(req: Column, cfg: AuditConfig) -> Column:
    answered = req["status"] > 0
    noise = (url_belongs_to(req["url"], cfg.trackingHosts)
             | noise_text(req["url"], cfg.trackingHosts)
             | noise_text(req["failure"], cfg.trackingHosts))
    what = F.when(answered, F.concat(F.lit("returned "), req["status"].cast("string"))).otherwise(
        F.concat(F.lit("failed ("), F.coalesce(req["failure"], F.lit("unknown")), F.lit(")")))
    return issue(
        CHECK, F.when(noise, "info").otherwise("error"),
        F.when(answered, "subresource-error-status").otherwise("subresource-request-failed"),
        F.concat(req["resourceType"], F.lit(" "), what),
        target=req["url"], where="network",
        detail=F.when(noise, "third-party resource — downgraded to info").otherwise(req["method"]))


def console_issues(cfg: AuditConfig) -> Column:
    """The same text, or the same failed request, counts once per page."""
    entries = F.transform(
        F.coalesce(F.col("console"), F.array().cast("array<struct<type:string,text:string,location:string>>")),
        lambda e, i: F.struct(e["text"].alias("key"), i.alias("pos"),
                              console_issue(e, cfg).alias("issue")))
    requests = F.transform(
        F.coalesce(F.col("failedRequests"), F.array().cast(
            "array<struct<url:string,status:int,method:string,resourceType:string,failure:string>>")),
        lambda r, i: F.struct(
            F.concat(r["status"].cast("string"), F.lit(":"), r["url"]).alias("key"),
            (i + F.lit(1_000_000_000)).alias("pos"),  # requests come after console entries
            request_issue(r, cfg).alias("issue")))
    overlay = issues_when((
        F.coalesce(F.col("dom.consentBannerVisible"), F.lit(False)),
        issue(CHECK, "warning", "consent-banner-not-dismissed",
              "Cookie-consent overlay still visible after load — results for this page may be "
              "unreliable")))
    once = first_per_key(F.concat(entries, requests), "key")
    return F.concat(F.transform(once, lambda x: x["issue"]), overlay)


def check_console_errors(captures: DataFrame, cfg: AuditConfig) -> DataFrame:
    return explode_issues(captures, console_issues(cfg))
