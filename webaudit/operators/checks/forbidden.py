"""References to hosts that production must never mention.

A link is only one way such a host gets out: an asset, a canonical tag, a request made by a
script or a redirect hop leaks it just as well, so all surfaces are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...config import AuditConfig
from ...functions.lets import first_per_key, let
from ...functions.texts import extract_urls, truncate
from ...functions.urls import host_of, match_host
from .common import explode_issues, issue

CHECK = "forbidden-hosts"
_MENTION = "array<struct<rule:string,where:string,target:string,detail:string>>"


def mention(rule: str, where: Column | str, target: Column, detail: Column | None = None) -> Column:
    return F.struct(
        F.lit(f"forbidden-host-in-{rule}").alias("rule"),
        (F.lit(where) if isinstance(where, str) else where).alias("where"),
        target.alias("target"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def mentions() -> Column:
    """Every URL a page mentions, with the surface it was seen on, in document order."""
    def over(array: Column | str, build) -> Column:
        column = F.col(array) if isinstance(array, str) else array
        return F.coalesce(F.transform(column, build), F.array().cast(_MENTION))

    dom = F.col("dom")
    canonical = F.filter(F.array(dom["canonical"]), lambda c: F.coalesce(c, F.lit("")) != "")
    og = F.filter(F.map_entries(dom["og"]), lambda e: e["value"].startswith("http"))
    scripts = F.flatten(F.transform(dom["inlineScripts"], lambda s: F.transform(
        extract_urls(s),
        lambda u: mention("inline-script", "inline-script", u, truncate(s, 200)))))
    route = F.concat_ws(" -> ", F.col("redirectChain"))
    return F.concat(
        over("dom.links", lambda x: mention("link", "a[href]", x["href"])),
        over("dom.resources", lambda x: mention("resource", x["where"], x["url"])),
        over(canonical, lambda x: mention("canonical", "link[rel=canonical]", x)),
        over("dom.hreflang", lambda x: mention(
            "hreflang", F.concat(F.lit("link[hreflang="), x["hreflang"], F.lit("]")), x["href"])),
        over(og, lambda x: mention(
            "og", F.concat(F.lit("meta["), x["key"], F.lit("]")), x["value"])),
        F.coalesce(scripts, F.array().cast(_MENTION)),
        over("requestUrls", lambda x: mention("request", "network", x)),
        over("redirectChain", lambda x: mention("redirect", "redirect-chain", x, route)),
        F.array(mention("redirect", "final-url", F.col("finalUrl"))),
    )


def leak_pattern(host: Column, where: Column, own_host: Column, cfg: AuditConfig) -> Column:
    """The pattern a mentioned host violates on this surface, or NULL.

    A localhost link may be the point of a tutorial; a localhost asset or call is a defect.
    The audited site itself is never a leak.
    """
    local = F.when((where != "a[href]") & ~host.eqNullSafe(own_host),
                   match_host(host, cfg.localhostHosts))
    return F.coalesce(match_host(host, cfg.forbiddenHosts), local)


def forbidden_issues(cfg: AuditConfig) -> Column:
    def judged(own: Column) -> Column:
        def judge(m: Column, i: Column) -> Column:
            return let(host_of(m["target"]), lambda h: F.struct(
                F.struct(m["rule"].alias("rule"), m["where"].alias("where"),
                         m["target"].alias("target")).alias("key"),
                i.alias("pos"), m["detail"].alias("detail"), h.alias("host"),
                leak_pattern(h, m["where"], own, cfg).alias("pattern")))

        return F.filter(F.transform(mentions(), judge), lambda x: x["pattern"].isNotNull())

    return F.transform(
        first_per_key(let(cfg.own_host(), judged), "key"),
        lambda x: issue(
            CHECK, "error", x["key"]["rule"],
            F.concat(F.lit('Forbidden host "'), x["host"], F.lit('" (matches "'), x["pattern"],
                     F.lit('") referenced in '), x["key"]["where"]),
            target=x["key"]["target"], where=x["key"]["where"], detail=x["detail"]))


def check_forbidden_hosts(captures: DataFrame, cfg: AuditConfig) -> DataFrame:
    return explode_issues(captures, forbidden_issues(cfg))


def has_forbidden_host(cfg: AuditConfig) -> Column:
    """Does the page leak at all? Reads requests, redirects, links and resources only."""
    empty = F.array().cast("array<string>")
    urls = F.concat(
        F.coalesce(F.col("requestUrls"), empty), F.coalesce(F.col("redirectChain"), empty),
        F.coalesce(F.col("dom.links.href"), empty), F.coalesce(F.col("dom.resources.url"), empty))
    return F.exists(urls, lambda u: let(
        host_of(u), lambda h: match_host(h, cfg.forbiddenHosts)).isNotNull())


def scan_text_files(files: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Forbidden hosts in text files such as llms.txt: first URL per host and file."""
    found = F.transform(
        extract_urls(F.col("text")),
        lambda u, i: let(host_of(u), lambda h: F.struct(
            h.alias("key"), i.alias("pos"), u.alias("target"),
            match_host(h, cfg.forbiddenHosts).alias("pattern"))))
    hits = first_per_key(F.filter(found, lambda x: x["pattern"].isNotNull()), "key")
    issues = F.transform(hits, lambda x: issue(
        CHECK, "error", "forbidden-host-in-text-file",
        F.concat(F.lit('Forbidden host "'), x["key"], F.lit('" (matches "'), x["pattern"],
                 F.lit('") referenced in '), F.col("url")),
        target=x["target"], where=F.col("url")))
    return explode_issues(files.withColumn("seq", F.lit(None).cast("bigint")), issues)
