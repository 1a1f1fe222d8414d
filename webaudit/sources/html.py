"""HTML to DOM snapshot, inside the JVM.

Captured pages are scanned with a handful of regular expressions that follow the HTML
tokenizer where it matters: comments and raw-text elements hide what is inside them, quoted
attribute values may hold ``>``, character references are decoded. No Python process sees
the page, so the scan keeps the speed of the executors' own code.

What only a browser knows (decoded image width, a visible overlay) stays NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lets import first_per_key, let_sql, text
from ..functions.markup import (
    ANCHOR, ATTRIBUTES, HEADING, RAW_TEXT, TAG, attribute_sql, has_attribute_sql,
    text_content_sql, trim_sql, unescape_sql,
)
from ..functions.urls import absolutize_sql, origin_sql
from ..schemas import DOM

# Element, attribute and label of each resource surface, in report order.
RESOURCES = (
    ("script", "src", "script[src]"), ("iframe", "src", "iframe[src]"),
    ("img", "srcset", "img[srcset]"), ("source", "srcset", "source[srcset]"),
    ("source", "src", "source[src]"), ("video", "src", "video[src]"),
    ("link", "href", "link[href]"), ("form", "action", "form[action]"),
    ("img", "src", "img[src]"),
)
LINK_TEXT_CAP = 120  # fixed value

SURFACES = ("title", "metaDescription", "metaRobots", "canonical", "htmlLang", "h1s", "og",
            "hreflang", "links", "images", "resources", "inlineScripts")


def _of(names: str, condition: str = "true") -> str:
    wanted = ", ".join(f"'{n}'" for n in names.split("|"))
    return f"filter(_tags, e -> e.n IN ({wanted}) AND {condition})"


def _meta(name: str) -> str:
    hit = _of("meta", f"lower({attribute_sql('e.t', 'name', False)}) = '{name}'")
    return let_sql("m", f"get({hit}, 0)",
                   f"CASE WHEN m IS NOT NULL THEN "
                   f"{trim_sql('coalesce(' + attribute_sql('m.t', 'content') + ', ' + chr(39) * 2 + ')')} END")


def _resource(element: str, attribute: str, where: str) -> str:
    values = (f"filter(transform({_of(element)}, e -> {attribute_sql('e.t', attribute)}), "
              f"r -> r <> '')")
    if attribute == "srcset":
        values = (f"flatten(transform({values}, r -> filter(transform(split(r, ','), "
                  f"c -> regexp_extract(c, {text(r'^\s*(\S*)')}, 1)), c -> c <> '')))")
    return (f"transform({values}, r -> named_struct('url', {absolutize_sql('r', '_base', '_origin')}, "
            f"'where', '{where}'))")


def _relation(rel: str) -> str:
    return f"lower({attribute_sql('e.t', 'rel', False)}) = '{rel}'"


def _surface_sql(name: str) -> str:
    if name == "title":
        start = text(r"(?is)^<title" + ATTRIBUTES + r">|</title\s*>$")
        hit = f"get(filter(_raw, r -> r rlike {text(r'(?is)^<title')}), 0)"
        inner = f"regexp_replace({hit}, {start}, '')"
        decoded = let_sql("tt", inner, unescape_sql("tt"))
        return f"nullif(trim(regexp_replace({decoded}, {text(r'[ \t\n\f\r]+')}, ' ')), '')"
    if name == "metaDescription":
        return _meta("description")
    if name == "metaRobots":
        return _meta("robots")
    if name == "canonical":
        hit = f"get({_of('link', _relation('canonical'))}, 0).t"
        return let_sql("c", hit, f"CASE WHEN c IS NOT NULL THEN "
                                 f"{absolutize_sql(attribute_sql('c', 'href'), '_base', '_origin')} END")
    if name == "htmlLang":
        return attribute_sql(f"get({_of('html')}, 0).t", "lang", False)
    if name == "h1s":
        return (f"transform(regexp_extract_all(_clean, {text(HEADING)}, 1), "
                f"h -> {text_content_sql('h')})")
    if name == "hreflang":
        hits = _of("link", f"{_relation('alternate')} AND {has_attribute_sql('e.t', 'hreflang')}")
        return (f"transform({hits}, e -> named_struct("
                f"'hreflang', {attribute_sql('e.t', 'hreflang', False)}, "
                f"'href', {absolutize_sql(attribute_sql('e.t', 'href'), '_base', '_origin')}))")
    if name == "links":
        anchors = (f"filter(transform(regexp_extract_all(_clean, {text(ANCHOR)}, 0), a -> "
                   f"named_struct('a', a, 'h', {attribute_sql('a', 'href')})), x -> x.h IS NOT NULL)")
        inner = f"regexp_replace(x.a, {text('(?is)^<a' + ATTRIBUTES + '>')}, '')"
        return (f"transform({anchors}, x -> named_struct("
                f"'href', {absolutize_sql('x.h', '_base', '_origin')}, "
                f"'text', left({text_content_sql(inner)}, {LINK_TEXT_CAP}), "
                f"'rel', {attribute_sql('x.a', 'rel', False)}))")
    if name == "images":
        return (f"transform({_of('img')}, e -> named_struct("
                f"'src', {absolutize_sql(attribute_sql('e.t', 'src'), '_base', '_origin')}, "
                f"'alt', {attribute_sql('e.t', 'alt')}, 'naturalWidth', CAST(NULL AS INT)))")
    if name == "resources":
        return "concat(" + ", ".join(_resource(*r) for r in RESOURCES) + ")"
    if name == "inlineScripts":
        bodies = (f"filter(_raw, r -> r rlike {text(r'(?is)^<script[\s/>]')} "
                  f"AND NOT {has_attribute_sql('r', 'src')})")
        ends = text(r"(?is)^<script" + ATTRIBUTES + r">|</script\s*>$")
        return (f"filter(transform({bodies}, "
                f"r -> {trim_sql(f'regexp_replace(r, {ends}, {chr(39) * 2})')}), r -> r <> '')")
    raise ValueError(f"unknown DOM surface: {name}")


def _og() -> Column:
    """Open Graph properties by lower-cased key; the last of equal keys counts."""
    hits = _of("meta", f"lower({attribute_sql('e.t', 'property', False)}) LIKE 'og:%'")
    entries = F.expr(
        f"filter(transform({hits}, (e, i) -> named_struct("
        f"'key', lower({attribute_sql('e.t', 'property', False)}), 'pos', -i, "
        f"'raw', {attribute_sql('e.t', 'content')})), x -> x.raw <> '')")
    last = first_per_key(entries, "key")
    return F.map_from_entries(F.transform(last, lambda x: F.struct(
        x["key"].alias("key"), F.trim(x["raw"]).alias("value"))))


def extract_dom(
    pages: DataFrame, html: str = "html", url: str = "url", surfaces: tuple[str, ...] = SURFACES,
) -> DataFrame:
    """Add a ``dom`` struct with the asked-for surfaces (the others are NULL).

    Name only what a query reads: each surface costs its own pass over the tags.
    """
    tags = (f"transform(regexp_extract_all(_clean, {text(TAG)}, 0), t -> named_struct("
            f"'n', lower(regexp_extract(t, '^<([A-Za-z0-9]+)', 1)), 't', t))")
    base_tag = f"get({_of('base', has_attribute_sql('e.t', 'href'))}, 0).t"
    base = let_sql("bt", base_tag, f"CASE WHEN bt IS NULL THEN `{url}` ELSE "
                                   f"{absolutize_sql(attribute_sql('bt', 'href'), f'`{url}`')} END")
    scanned = (
        pages
        .withColumn("_raw", F.regexp_extract_all(F.col(html), F.lit(RAW_TEXT), F.lit(0)))
        .withColumn("_clean", F.regexp_replace(F.col(html), RAW_TEXT, "$1"))
        .withColumn("_tags", F.expr(tags))
        .withColumn("_base", F.expr(base))
        .withColumn("_origin", F.expr(origin_sql("_base")))
    )
    built = []
    for name in SURFACES:
        if name not in surfaces:
            value = F.lit(None)
        else:
            value = _og() if name == "og" else F.expr(_surface_sql(name))
        built.append(value.alias(name))
    built.append(F.lit(None).cast("boolean").alias("consentBannerVisible"))
    return scanned.withColumn("dom", F.struct(*built).cast(DOM)).drop(
        "_raw", "_clean", "_tags", "_base", "_origin")


