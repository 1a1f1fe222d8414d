"""What search engines and share previews see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...config import AuditConfig
from ...functions.lets import let
from ...functions.texts import is_blank
from ...functions.urls import dedupe_key, strip_www, url_parts
from .common import explode_issues, issue, issues_when, no_issues

CHECK = "seo"


def _length_rules(value: Column, label: str, rule: str, low: Column, high: Column,
                  tail: str) -> list[tuple[Column, Column]]:
    size = F.length(value)
    shown = size.cast("string")

    def message(word: str, bound: Column, end: str) -> Column:
        return F.concat(F.lit(f"{label} is "), shown, F.lit(f" chars ({word} "),
                        bound.cast("string"), F.lit(f"){end}"))

    return [
        (~is_blank(value) & (size < low),
         issue(CHECK, "warning", f"{rule}-too-short", message("min", low, ""), detail=value)),
        (~is_blank(value) & (size >= low) & (size > high),
         issue(CHECK, "warning", f"{rule}-too-long", message("max", high, tail), detail=value)),
    ]


def _canonical_issues(cfg: AuditConfig) -> Column:
    canonical = F.col("dom.canonical")
    missing = issue(CHECK, "warning", "missing-canonical", "Page has no canonical link")
    invalid = issue(CHECK, "error", "invalid-canonical", "Canonical is not a valid URL",
                    detail=canonical)
    site = strip_www(cfg.own_host())
    judged = let(url_parts("dom.canonical"), lambda u: issues_when(
        (u["url"].isNull(), invalid),
        (strip_www(u["host"]) != site,
         issue(CHECK, "error", "canonical-off-site", "Canonical points to a different site",
               target=u["url"], where="link[rel=canonical]"))))
    return F.when(is_blank(canonical), F.array(missing)).otherwise(judged)


def _hreflang_issues() -> Column:
    cluster = F.col("dom.hreflang")
    names_self = let(dedupe_key("finalUrl"), lambda me: F.exists(
        cluster, lambda a: dedupe_key(a["href"]).eqNullSafe(me)))
    return issues_when((
        (F.coalesce(F.array_size(cluster), F.lit(0)) > 0) & ~names_self,
        issue(CHECK, "warning", "hreflang-missing-self",
              "hreflang cluster does not include a self-reference",
              detail=F.array_join(F.transform(cluster, lambda a: a["hreflang"]), ", "))))


def seo_issues(cfg: AuditConfig) -> Column:
    """Skipped for pages without a DOM and for error pages, which are thin by nature."""
    title, description = F.col("dom.title"), F.col("dom.metaDescription")
    h1s, robots = F.col("dom.h1s"), F.col("dom.metaRobots")
    h1_count = F.coalesce(F.array_size(h1s), F.lit(0))
    head = issues_when(
        (is_blank(title), issue(CHECK, "error", "missing-title", "Page has no <title>")),
        *_length_rules(title, "Title", "title", cfg.setting("titleMin"), cfg.setting("titleMax"),
                       " — will be truncated in search results"),
        (is_blank(description),
         issue(CHECK, "warning", "missing-meta-description", "Page has no meta description")),
        *_length_rules(description, "Meta description", "description",
                       cfg.setting("descriptionMin"), cfg.setting("descriptionMax"),
                       " — will be truncated"),
        (h1_count == 0, issue(CHECK, "error", "missing-h1", "Page has no <h1>")),
        (h1_count > 1, issue(
            CHECK, "error", "multiple-h1",
            F.concat(F.lit("Page has "), h1_count.cast("string"), F.lit(" <h1> elements")),
            detail=F.array_join(
                F.transform(h1s, lambda h: F.concat(F.lit('"'), h, F.lit('"'))), ", "))),
        (F.lower(robots).contains("noindex"),
         issue(CHECK, "error", "noindex-on-live-page", "Page is marked noindex", detail=robots)),
    )
    og = F.col("dom.og")
    tail = issues_when(
        *[(is_blank(F.try_element_at(og, F.lit(f"og:{name}"))),
           issue(CHECK, "warning", f"missing-og-{name}", f"Missing og:{name}"))
          for name in ("title", "image", "description")],
        (is_blank(F.col("dom.htmlLang")),
         issue(CHECK, "warning", "missing-html-lang", "Missing <html lang> attribute")),
    )
    return F.when(
        F.col("dom").isNotNull() & (F.col("status") < 400),
        F.concat(head, _canonical_issues(cfg), tail, _hreflang_issues()),
    ).otherwise(no_issues())


def check_seo(captures: DataFrame, cfg: AuditConfig) -> DataFrame:
    return explode_issues(captures, seo_issues(cfg))
