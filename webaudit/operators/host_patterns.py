"""Host patterns of many sites as an index: joins by equality wherever a pattern allows one.

A site may list thousands of patterns, and a job holds many sites, so patterns are a table. An
exact host and a glob with one star at its edge are found by joining the host, the endings of
its labels and the beginnings of its labels; only globs with a star elsewhere are tried
against each distinct host of their site. The first pattern in a site's list wins, as it does with
the list of ``AuditConfig``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.lets import explode_rows
from ..functions.texts import extract_urls
from ..functions.urls import host_of
from ..session import cut_lineage
from ..sources.textfiles import pattern_matches, pattern_parts
from .checks.common import issue
from .checks.forbidden import CHECK, mentions

LISTS = ("forbiddenHosts", "localhostHosts")  # a link may lead to hosts of the second list
EXACT, ENDING, BEGINNING, GLOB = "exact", "ending", "beginning", "glob"


def site_patterns(sites: DataFrame, cfg: AuditConfig) -> DataFrame:
    """``site, list, pos, pattern``: each site's own lists, or those of ``cfg`` where it has none.

    ``sites`` has ``site`` and may have ``forbiddenHosts`` and ``localhostHosts`` (arrays). An empty
    array is a list of its own: nothing is forbidden there.
    """
    entries = []
    for name in LISTS:
        default = F.array(*map(F.lit, getattr(cfg, name))).cast("array<string>")
        own = F.coalesce(F.col(name), default) if name in sites.columns else default
        entries.append(_entries(own, name))
    return explode_rows(sites, F.concat(*entries), "e", "site").select("site", "e.*")


def _entries(patterns: Column, name: str) -> Column:
    return F.transform(patterns, lambda p, i: F.struct(
        F.lit(name).alias("list"), i.alias("pos"), p.alias("pattern")))


def index_patterns(patterns: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``part``, the labels that a host must be, end with or begin with."""
    p = F.lower("pattern")
    stars = F.length(p) - F.length(F.replace(p, F.lit("*"), F.lit("")))
    kind = (F.when(stars == 0, EXACT).when((stars == 1) & F.startswith(p, F.lit("*.")), ENDING)
            .when((stars == 1) & F.endswith(p, F.lit(".*")), BEGINNING).otherwise(GLOB))
    part = (F.when(F.col("kind") == ENDING, F.substr(p, F.lit(3)))
            .when(F.col("kind") == BEGINNING, F.substr(p, F.lit(1), F.length(p) - 2)).otherwise(p))
    return patterns.withColumn("kind", kind).withColumn("part", part)


def label_keys(host: Column) -> Column:
    """``kind, part`` of everything an indexed pattern may ask of a host.

    As many entries as three times its labels, whatever the number of patterns.
    """
    labels = F.split(host, "[.]")
    n = F.size(labels)

    def runs(kind: str, slices) -> Column:
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
            F.lit(kind).alias("kind"), F.array_join(slices(i), ".").alias("part")))

    return F.concat(
        F.array(F.struct(F.lit(EXACT).alias("kind"), host.alias("part"))),
        runs(ENDING, lambda i: F.slice(labels, i, n)), runs(BEGINNING, lambda i: F.slice(labels, 1, i)))


def _glob_hit(host: Column, pattern: Column) -> Column:
    """A glob with stars anywhere; at an edge it also covers the bare host."""
    p = F.lower(pattern)
    whole = pattern_matches(host, pattern_parts(F.concat(p, F.lit("$"))))
    return (whole | (F.startswith(p, F.lit("*.")) & (host == F.substr(p, F.lit(3))))
            | (F.endswith(p, F.lit(".*")) & (host == F.substr(p, F.lit(1), F.length(p) - 2))))


def match_hosts(hosts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``site, host, list, pattern``: the first pattern of each list that a site's host matches.

    ``hosts``: distinct ``site, host``; ``patterns``: ``site, list, pos, pattern``. Hosts that no
    pattern matches, and empty or NULL ones, have no row.
    """
    indexed = index_patterns(patterns)
    hosts = hosts.where("host <> ''")
    keys = explode_rows(hosts, label_keys(F.lower("host")), "k", "site", "host").select(
        "site", "host", "k.*")
    first = F.min(F.struct("pos", "pattern")).alias("first")
    # Equal patterns of a site become one entry first, so a key has one partner for each list.
    once = indexed.where(F.col("kind") != GLOB).groupBy("site", "kind", "part", "list").agg(first)
    equal = keys.join(once, ["site", "kind", "part"]).select("site", "host", "list", "first")
    globs = indexed.where(F.col("kind") == GLOB).groupBy("site", "list", "pattern").agg(
        F.min("pos").alias("pos"))
    tried = hosts.join(globs, "site").where(_glob_hit(F.lower("host"), F.col("pattern"))).select(
        "site", "host", "list", F.struct("pos", "pattern").alias("first"))
    return equal.unionByName(tried).groupBy("site", "host", "list").agg(
        F.min("first").alias("first")).select("site", "host", "list", "first.pattern")


def own_hosts(sites: DataFrame, cfg: AuditConfig) -> DataFrame:
    """``site, own``: the host of each site's base URL, which is never a leak by ``localhostHosts``."""
    base = F.concat(F.lit("https://"), F.col("site")) if cfg.baseUrl is None else F.lit(cfg.baseUrl)
    if "baseUrl" in sites.columns:
        base = F.coalesce("baseUrl", base)
    return sites.select("site", host_of(base).alias("own"))


def site_leaks(captures: DataFrame, sites: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Findings of the forbidden-hosts check, with the pattern lists of each site.

    Captures are read twice: for their distinct hosts, which meet the patterns, and for the mentions
    of those that match. The matches are stored between, so that their size is known before the
    second pass and a short list costs no shuffle of the mentions. Sites without a row in
    ``sites`` have no patterns.
    """
    found = F.transform(mentions(), lambda m, i: F.struct(
        i.alias("pos"), m["rule"].alias("rule"), m["where"].alias("where"),
        m["target"].alias("target"), m["detail"].alias("detail"), host_of(m["target"]).alias("host")))
    seen = explode_rows(captures, found, "m", "site", "seq", "url").select(
        "site", "seq", "url", "m.*").where("host <> ''")
    hit = _hits(seen, sites, cfg)
    # The first mention of a rule, place and target on a page; they combine before the shuffle.
    once = hit.groupBy("site", "seq", "url", "rule", "where", "target").agg(
        F.min(F.struct("pos", "host", "pattern", "detail")).alias("m"))
    return once.select("site", "seq", issue(
        CHECK, "error", F.col("rule"), _message(F.col("m.host"), F.col("m.pattern"), F.col("where")),
        target=F.col("target"), where=F.col("where"), detail=F.col("m.detail")).alias("i")).select(
        "site", "seq", "i.*")


def site_file_leaks(files: DataFrame, sites: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Findings in text files, with each site's list of forbidden hosts: first URL per host and file."""
    found = F.transform(extract_urls(F.col("text")), lambda u, i: F.struct(
        i.alias("pos"), u.alias("target"), host_of(u).alias("host")))
    seen = explode_rows(files, found, "m", "site", "url").select("site", "url", "m.*").where(
        "host <> ''")
    matched = cut_lineage(match_hosts(
        seen.select("site", "host").distinct(),
        site_patterns(sites, cfg).where("list = 'forbiddenHosts'")), "forbidden-hosts")
    once = seen.join(matched, ["site", "host"]).groupBy("site", "url", "host", "pattern").agg(
        F.min(F.struct("pos", "target")).alias("m"))
    return once.select("site", F.lit(None).cast("bigint").alias("seq"), issue(
        CHECK, "error", "forbidden-host-in-text-file",
        _message(F.col("host"), F.col("pattern"), F.col("url")), target=F.col("m.target"),
        where=F.col("url")).alias("i")).select("site", "seq", "i.*")


def _hits(seen: DataFrame, sites: DataFrame, cfg: AuditConfig) -> DataFrame:
    matched = match_hosts(seen.select("site", "host").distinct(), site_patterns(sites, cfg))
    by_list = matched.groupBy("site", "host").agg(*[
        F.max(F.when(F.col("list") == name, F.col("pattern"))).alias(name) for name in LISTS])
    known = cut_lineage(by_list.join(own_hosts(sites, cfg), "site", "left"), "forbidden-hosts")
    local = F.when((F.col("where") != "a[href]") & ~F.col("host").eqNullSafe(F.col("own")),
                   F.col("localhostHosts"))
    return seen.join(known, ["site", "host"]).withColumn(
        "pattern", F.coalesce("forbiddenHosts", local)).where("pattern IS NOT NULL")


def _message(host: Column, pattern: Column, where: Column) -> Column:
    return F.concat(F.lit('Forbidden host "'), host, F.lit('" (matches "'), pattern,
                    F.lit('") referenced in '), where)
