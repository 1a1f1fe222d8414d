"""Small text functions used by parsers, messages and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import absolutize

# Patterns of absolute URLs in script text, and of expected console noise.
URL_IN_TEXT = r"""https?://[^\s"'`<>()\\]+"""
NOISE = r"(?i)ERR_BLOCKED_BY_CLIENT|Content Security Policy.*(analytics|tag|pixel)"

ELLIPSIS = "…"


def is_blank(value: Column) -> Column:
    """NULL or empty."""
    return F.coalesce(value, F.lit("")) == ""


def trim_space(value: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(value, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def truncate(value: Column, limit: int) -> Column:
    return F.when(F.length(value) > limit,
                  F.concat(F.substring(value, 1, limit), F.lit(ELLIPSIS))).otherwise(value)


def join_lines(*parts: Column, sep: str = "\n") -> Column:
    """Join the parts that are neither NULL nor empty; NULL when none is left."""
    return F.nullif(F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def extract_urls(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(URL_IN_TEXT), F.lit(0))


def decode_xml_entities(value: Column) -> Column:
    """The five XML entities, ``&amp;`` first."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&apos;", "'")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def srcset_urls(value: Column) -> Column:
    """URLs of a ``srcset`` candidate list."""
    urls = F.transform(F.split(value, ","),
                       lambda c: F.regexp_extract(c, r"^\s*(\S*)", 1))
    return F.filter(urls, lambda u: u != "")


def slug(value: Column) -> Column:
    cleaned = F.regexp_replace(value, "(?i)[^a-z0-9-]+", "-")
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(cleaned, "^-+|-+$", "")), F.lit("")),
                      F.lit("run"))


def wcag_of(tags: Column) -> Column:
    """Human-readable WCAG criteria among the tags of a violation."""
    return F.transform(F.filter(tags, lambda t: t.rlike(r"^wcag\d")), F.upper)


def retry_after_ms(header: Column, now: Column) -> Column:
    """Delay-seconds or HTTP date as milliseconds from ``now``; NULL when unusable."""
    trimmed = trim_space(header)
    seconds = F.when(trimmed.rlike(r"^\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
                     trimmed.try_cast("double"))
    moment = F.try_to_timestamp(F.regexp_extract(trimmed, r"^[A-Za-z]{3}, (.*)$", 1),
                                F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.when(seconds.isNotNull(), (seconds * 1000).cast("bigint")).when(
        moment.isNotNull(),
        F.greatest(F.lit(0).cast("bigint"), F.unix_millis(moment) - F.unix_millis(now)))


def landing_routes(base_url: Column, locales: Sequence[str]) -> Column:
    """URLs a first-time visitor may land on: the base, or one per locale."""
    if not locales:
        return F.array(base_url)
    return F.array(*[absolutize(F.lit(f"/{loc}/"), base_url) for loc in locales])


def noise_text(value: Column, tracking_hosts: Sequence[str]) -> Column:
    """Console prose nobody can act on: a blocked tracker or a tracking script."""
    hosts = "|".join("\\Q" + h + "\\E" for h in tracking_hosts)
    hit = value.rlike(NOISE)
    if hosts:
        hit = hit | value.rlike("(?i)" + hosts)
    return F.coalesce(hit, F.lit(False))
