"""Site files, logs and reports."""

import json
import random
import re

from pyspark.sql import functions as F

from webaudit.functions import texts as T
from webaudit.functions.urls import robots_to_regex, robots_to_regex_col
from webaudit.schemas import PAGE_EVENTS
from webaudit.sources import logs as L
from webaudit.sources import textfiles as X
from webaudit.sources.captures import read_captures, read_report

from captures import capture, frame

# Two groups that are for everyone around one that is not, agents in a row, an empty rule, a rule
# with an anchor, one with two stars, both kinds of line ends, a delay and no sitemap before the end.
ROBOTS = (
    "Sitemap: https://shop.test/a.xml\r\n"
    "user-agent: Slow\nuser-agent:*\nDisallow:\nDISALLOW: /cart$\nAllow: /cart/help\nCrawl-delay: 2\n"
    "# a comment between groups\n\n"
    "User-agent: Picky\nUser-agent: Fussy\nDisallow: /all-of-it\nAllow: /\n"
    "\nUser-agent: *   # again\nDisallow: /*/tmp*.log\nDisallow: /cart/\n"
)
FILES = "site string, url string, text string"


def robots(spark, *texts):
    return X.parse_robots(spark.createDataFrame(
        [(f"s{i}", f"https://s{i}/robots.txt", t) for i, t in enumerate(texts)], FILES))


def test_parse_robots(spark):
    rules = robots(spark, ROBOTS, "# c\nUser-agent: *\nDisallow: /x # trailing\nDisallow:\n",
                   "User-agent: Foo\r\nUser-agent: *\r\nDISALLOW : /shared\r\nCrawl-delay: 1.5",
                   "Disallow: /orphan\nUser-agent: a\nDisallow: /a\nUser-agent: *\nAllow: /b").collect()
    got = {}
    for r in sorted(rules, key=lambda r: (r.site, r.line_no)):
        got.setdefault(r.site, []).append((r.kind, r.pattern))
    assert sorted(got["s0"]) == [
        ("allow", "/cart/help"), ("crawl-delay", "2000"), ("disallow", "/*/tmp*.log"), ("disallow", "/cart$"),
        ("disallow", "/cart/"), ("sitemap", "https://shop.test/a.xml")]
    assert got["s1"] == [("disallow", "/x")]
    assert got["s2"] == [("disallow", "/shared"), ("crawl-delay", "1500")]
    assert got["s3"] == [("allow", "/b")]


def test_robots_allowed(spark):
    rules = robots(spark, ROBOTS, "User-agent: *\nDisallow: /team/\nAllow: /team/jobs",
                   "User-agent: *\nDisallow: /*.html$\nDisallow: /a?b=\nAllow: /a?b=")
    cases = [
        ("s0", "https://s0/cart", False), ("s0", "https://s0/cart?x=1", True), ("s0", "https://s0/cart/1", False),
        ("s0", "https://s0/cart/help/me", True), ("s0", "https://s0/a/tmp1.log.gz", False),
        ("s0", "https://s0/tmp1.log", True), ("s0", "https://s0/all-of-it", True), ("s0", "https://s0/", True),
        ("s1", "https://s1/team/wiki", False), ("s1", "https://s1/team/jobs", True),
        ("s2", "https://s2/x.html", False), ("s2", "https://s2/x.html?y=1", True),
        ("s2", "https://s2/a?b=1", True), ("s2", "not a url", False), ("none", "https://none/", True)]
    df = spark.createDataFrame(cases, "site string, url string, e boolean")
    assert X.robots_allowed(df, rules).where("robots_allowed <> e").collect() == []


def test_robots_patterns_match_as_their_regular_expressions(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices("ab/**$.", k=rng.randint(1, 8))),
             "/" + "".join(rng.choices("ab/.$", k=rng.randint(0, 9)))) for _ in range(4000)]
    rows += [("/a*", "/a"), ("/a$", "/a"), ("/*a$", "/aa"), ("*", "/"), ("/ab*b$", "/ab"), ("$", "/")]
    got = spark.createDataFrame(rows, "pattern string, path string").select(
        "pattern", "path", X.pattern_parts(F.col("pattern")).alias("parts")).select(
        "pattern", "path", X.pattern_matches(F.col("path"), F.col("parts")).alias("hit"),
        F.rlike("path", robots_to_regex_col(F.col("pattern"))).alias("want")).collect()
    assert [r for r in got if r.hit != r.want] == [] and 400 < sum(r.hit for r in got) < 3600
    assert all(r.hit == bool(re.search(robots_to_regex(r.pattern), r.path)) for r in got)


def test_sitemaps(spark):
    files = spark.createDataFrame([
        ("a", "https://a/sitemap.xml", "<sitemapindex>\n<sitemap><loc>https://a/1.xml</loc></sitemap>"
         "<loc>https://a/sitemap.xml</loc><LOC> https://a/gone.xml </LOC></sitemapindex>", None),
        ("a", "https://a/1.xml", "<urlset><loc>https://a/p?x=1&amp;y=2</loc><loc>mailto:x</loc>"
         "<loc>https://a/q</loc></urlset>", None),
        ("b", "https://b/sitemap.xml", None, "HTTP 500"),
        *[("c", f"https://c/{i}.xml", f"<sitemapindex><loc>https://c/{i + 1}.xml</loc></sitemapindex>", None)
          for i in range(6)],
    ], "site string, url string, text string, error string")
    entries = spark.createDataFrame([
        ("a", "https://a/sitemap.xml"), ("a", "https://a/sitemap.xml#x"), ("b", "https://b/sitemap.xml"),
        ("c", "https://c/0.xml")], "site string, url string")
    urls, errors = X.expand_sitemaps(entries, files)
    assert sorted(r.url for r in urls.collect()) == ["https://a/p?x=1&y=2", "https://a/q"]
    assert sorted((r.url, r.error) for r in errors.collect()) == [
        ("https://a/gone.xml", "not fetched"), ("https://b/sitemap.xml", "HTTP 500")]


def test_sitemap_entries_scope(spark):
    sites = spark.createDataFrame([("a",)], "site string")
    extra = ("https://a/blog/sitemap.xml", "https://a/shop/sitemap.xml")
    assert {r.url for r in X.sitemap_entries(sites, exclude=["/blog"], extra=extra).collect()} == {
        "https://a/sitemap.xml", "https://a/shop/sitemap.xml"}
    assert {r.url for r in X.sitemap_entries(sites, include=["/blog"], extra=extra).collect()} == {
        "https://a/sitemap.xml", "https://a/blog/sitemap.xml"}


# No title, a link before any section, a section without links, one under a deeper heading, a link
# with a tooltip, the same URL twice on a line and again below, a bare URL, and links that are no pages.
LLMS = (
    "[Start](/begin) of the list\n"
    "## Empty\n\n"
    "### Tools and ropes\n"
    "* [Knots](https://tools.test/knots \"how to tie\") [Knots again](https://tools.test/knots)\n"
    "1. see https://tools.test/ropes?b=2&a=1 or [write](mailto:a@b.c) or [call](tel:1)\n"
    "##### Last\n"
    "[Knots](https://tools.test/knots) [broken]( http://[x )"
)
LLMS_ENTRIES = [
    (1, "", "Start", "https://tools.test/begin"), (5, "Tools and ropes", "Knots", "https://tools.test/knots"),
    (6, "Tools and ropes", "", "https://tools.test/ropes?a=1&b=2"), (8, "Last", "Knots", "https://tools.test/knots")]


def test_llms_txt(spark):
    df = X.parse_llms_txt(spark.createDataFrame([("tools.test", "f", LLMS)], FILES))
    got = sorted((r.line, r.section, r.title, r.url) for r in df.collect())
    assert got == LLMS_ENTRIES


def test_page_events(spark):
    def event(seq, event, **f):
        base = dict(page_id=1, seq=seq, event=event, type=None, text=None, location=None, url=None,
                    status=None, method="GET", resource_type="script", failure=None,
                    is_main_document=False)
        return {**base, **f}

    df = spark.createDataFrame([
        event(0, "console", type="log", text="hi"), event(1, "console", type="error", text="bad"),
        event(2, "console", type="error", text="Failed to load resource: 404"),
        event(3, "pageerror", text="boom"), event(4, "request", url="u1"),
        event(5, "requestfailed", url="u2", failure="net::ERR_ABORTED"),
        event(6, "requestfailed", url="u3"), event(7, "response", url="u4", status=404),
        event(8, "response", url="main", status=404, is_main_document=True),
        event(9, "response", url="u5", status=200)], PAGE_EVENTS)
    assert [(r.type, r.text) for r in L.console_entries(df).orderBy("seq").collect()] == [
        ("error", "bad"), ("pageerror", "boom")]
    assert [(r.url, r.status, r.failure) for r in L.failed_requests(df).orderBy("seq").collect()] == [
        ("u3", 0, "unknown"), ("u4", 404, None)]
    assert [r.url for r in L.request_urls(df).collect()] == ["u1"]


def test_reports_survive_broken_files(spark, tmp_path):
    good = {"baseUrl": "https://a", "startedAt": "2024-01-01", "issues": [{"rule": "x", "severity": "error"}]}
    for name, body in (("main", json.dumps(good, indent=1)), ("half", '{"startedAt": "20'), ("other", "{}")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "report.json").write_text(body)
    rows = read_report(spark, str(tmp_path)).collect()
    assert [(r.run, r.baseUrl, r.issues[0].rule) for r in rows] == [("main", "https://a", "x")]


def test_read_captures(spark, tmp_path):
    frame(spark, capture()).write.json(str(tmp_path / "c"))
    row = read_captures(spark, str(tmp_path / "c"), "json").first()
    assert (row.url, row.dom.title, row.axe) == ("https://example.com/en/vps", "Example page title", None)


def test_retry_after(spark):
    cases = [("120", 120_000), (" 0 ", 0), ("1.5", 1500), ("", None), (None, None), ("soon", None),
             ("-5", None), ("Mon, 01 Jan 2024 00:01:00 GMT", 60_000), ("Sun, 31 Dec 2023 00:00:00 GMT", 0)]
    df = spark.createDataFrame(cases, "h string, e long").withColumn(
        "g", T.retry_after_ms(F.col("h"), F.lit("2024-01-01 00:00:00").cast("timestamp")))
    assert df.where("not (g <=> e)").collect() == []
