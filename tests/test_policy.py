"""Rules, configuration, reports and the whole plan."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from webaudit.config import AuditConfig, CustomCheck
from webaudit.operators import report as R
from webaudit.operators.checks.common import issue, issues_when
from webaudit.operators.classify import classify_issues
from webaudit.operators.crosspage import hreflang_issues
from webaudit.operators.frontier import crawl_frontier
from webaudit.plans.audit import audit, run_page_checks
from webaudit.rules import RULES, merged_rules, register_rules, rule_meta_df

from captures import capture, dom, frame, link, rules

ROOT = Path(__file__).resolve().parents[1]


def test_every_emitted_rule_is_ranked():
    code = "\n".join(p.read_text() for p in (ROOT / "webaudit/operators").rglob("*.py"))
    literal = set(re.findall(r'"(?:error|warning|info)",\s*"([a-z0-9]+-[a-z0-9-]+)"', code))
    assert len(literal) > 25
    assert literal <= set(RULES)
    by_priority = {p: sum(m[0] == p for m in RULES.values()) for p in ("P0", "P1", "P2", "P3")}
    assert by_priority == {"P0": 13, "P1": 19, "P2": 16, "P3": 15}


def test_classification_and_registration(spark):
    df = spark.createDataFrame([("server-error",), ("mine",), ("other",)], "rule string")
    meta = register_rules(rule_meta_df(spark), spark.createDataFrame(
        [("mine", "P1", "content", "r"), ("server-error", "P3", "seo", "demoted")],
        "rule string, priority string, category string, rationale string"))
    got = {r.rule: (r.priority, r.category) for r in classify_issues(df, meta).collect()}
    assert got == {"server-error": ("P0", "availability"), "mine": ("P1", "content"),
                   "other": ("P2", "content")}
    assert merged_rules({"server-error": ("P3", "seo", "x")})["server-error"][0] == "P0"


@pytest.mark.parametrize("changes, message", [
    (dict(checks=("forbiden-hosts",)), "Unknown check"),
    (dict(disabledChecks=("acessibility",)), "Unknown disabled check"),
    (dict(checks=("seo",), disabledChecks=("seo",)), "Every check is disabled"),
    (dict(forbiddenHosts=("*.*",)), "matches every host"),
    (dict(localhostHosts=("**",)), "matches every host"),
    (dict(customChecks=(CustomCheck("seo", lambda c, s: c),)), "collides with a builtin"),
])
def test_bad_policies(changes, message):
    with pytest.raises(ValueError, match=message):
        AuditConfig(**changes).enabled_checks()


def test_enabled_checks():
    custom = (CustomCheck("pricing", lambda c, s: c),)
    assert "pricing" in AuditConfig(customChecks=custom).enabled_checks()
    assert AuditConfig(customChecks=custom, checks=("seo",)).enabled_checks() == ["seo"]
    assert AuditConfig(checks=("seo", "links"), disabledChecks=("links",)).enabled_checks() == ["seo"]


def test_gate_and_run_names(spark):
    counts = spark.createDataFrame([(1, 0, 0), (0, 1, 0), (0, 0, 1)], "error long, warning long, info long")
    for level, want in (("error", [1, 0, 0]), ("warning", [1, 1, 0]), ("info", [0, 0, 0]), ("never", [0, 0, 0])):
        assert [r.exit_code for r in R.quality_gate(counts, level).collect()] == want
    df = spark.createDataFrame([(" My Run!", None), ("", ["/blog", "/docs"]), (None, None), ("!!", [])],
                               "n string, p array<string>")
    assert [r[0] for r in df.select(R.run_name(F.col("n"), F.col("p"))).collect()] == [
        "my-run", "blog--docs", "main", "run"]


def test_blocked_pages_are_culled(spark):
    page = capture(status=403, dom=dom(title="Just a moment...", links=[link("https://staging.example.com/a")]))
    cfg = AuditConfig(forbiddenHosts=("staging.example.com",))
    assert rules(run_page_checks(frame(spark, page), cfg)) == ["forbidden-host-in-link", "page-blocked"]
    assert rules(run_page_checks(frame(spark, page), cfg.with_(checks=("images",)))) == ["page-blocked"]
    unread = capture(dom=None, domError="boom")
    assert rules(run_page_checks(frame(spark, unread), cfg.with_(checks=("images",)))) == [
        "dom-extraction-failed"]


def test_filters_spare_global_findings_by_default(spark):
    pages = [capture(seq=i, url=f"https://example.com/{i}", dom=dom(title=None, metaDescription="same " * 12))
             for i in range(2)]
    cfg = AuditConfig(rules=("missing-title",))
    sitemap = spark.createDataFrame([("example.com", "https://example.com/z", 0)],
                                    "site string, url string, pos long")
    got = audit(frame(spark, *pages), cfg, sitemap=sitemap).issues
    assert rules(got) == ["duplicate-meta-description", "missing-title", "missing-title",
                          "page-missing-from-sitemap"]
    strict = audit(frame(spark, *pages), cfg, sitemap=sitemap, filter_global=True).issues
    assert set(rules(strict)) == {"missing-title"}


def test_custom_checks(spark):
    column = issues_when((F.col("url").contains("/pricing"), issue(
        "pricing", "error", "missing-price", "No price")))
    cfg = AuditConfig(checks=("pricing",), customChecks=(
        CustomCheck("pricing", column, {"missing-price": ("P1", "content", "r")}),))
    pages = frame(spark, capture(url="https://example.com/pricing"), capture())
    assert rules(audit(pages, cfg).issues, "priority") == [("missing-price", "P1")]


def test_custom_rows_fall_with_their_own_page(spark):
    a, b, c = (f"https://example.com/{n}" for n in "abc")
    refused = dict(status=403, dom=dom(title="Just a moment..."))
    pages = frame(spark, capture(seq=0, url=a, **refused), capture(seq=1, url=a),
                  capture(seq=2, url=b, **refused), capture(seq=3, url=c), capture(seq=4, url=b, site=None, **refused))
    every = lambda captures, _: captures.select("site", "seq", issue(
        "mine", "info", "found", "x").alias("i")).select("site", "seq", "i.*")

    def kept(change):
        cfg = AuditConfig(checks=("mine",), customChecks=(
            CustomCheck("mine", lambda captures, status: change(every(captures, status))),))
        got = run_page_checks(pages, cfg).where("rule = 'found'").collect()
        return sorted((r.seq if r.seq is not None else -1, r.pageUrl) for r in got)

    assert kept(lambda rows: rows) == [(1, a), (3, c)]
    # Rows that name no page go by its URL.
    assert kept(lambda rows: rows.drop("site", "seq")) == [(-1, c)]
    assert kept(lambda rows: rows.drop("seq")) == [(-1, c)]
    assert kept(lambda rows: rows.withColumn("seq", F.when(F.col("seq") != 0, F.col("seq")))) == [(1, a), (3, c)]
    assert kept(lambda rows: rows.withColumn("pageUrl", F.lit(b))) == [(1, b), (3, b)]


def test_hreflang_uses_the_last_capture_of_a_url(spark):
    a, b = "https://example.com/a", "https://example.com/b"
    alt = lambda href: [dict(hreflang="de", href=href)]
    pages = [
        capture(seq=0, url=a, finalUrl=a, dom=dom(hreflang=alt(b))),
        capture(seq=1, url=b, finalUrl=b, dom=dom(hreflang=alt(a))),
        capture(seq=2, url=b + "?old", finalUrl=b + "/", dom=dom(hreflang=alt("https://example.com/c"))),
    ]
    got = hreflang_issues(frame(spark, *pages)).collect()
    assert [(r.pageUrl, r.target) for r in got] == [(a, b)]


def test_crawl_replay(spark):
    offer = "site string, seq long, raw string, depth int, base string, source string"
    seeds = spark.createDataFrame([("h", 0, "https://h/", 0, None, "seed")], offer)
    edges = spark.createDataFrame([
        ("h", "https://h/", "/a", 1), ("h", "https://h/", "/b", 2), ("h", "https://h/a", "/b/", 3),
        ("h", "https://h/a", "https://other/x", 4), ("h", "https://h/b", "/c", 5),
        ("h", "https://h/c", "/d", 6), ("h", "https://h/c", "/", 7)],
        "site string, src_url string, dst_url string, seq long")
    pages, skipped = crawl_frontier(seeds, edges, AuditConfig(maxDepth=2))
    assert sorted((r.key, r.depth, r.source) for r in pages.collect()) == [
        ("https://h/", 0, "seed"), ("https://h/a", 1, "https://h/"), ("https://h/b", 1, "https://h/"),
        ("https://h/c", 2, "https://h/b")]
    assert {r.reason: r.n for r in skipped.collect()} == {"duplicate": 2, "off-site": 1, "too-deep": 1}
    capped, counts = crawl_frontier(seeds, edges, AuditConfig(maxPages=2))
    assert sorted(r.key for r in capped.collect()) == ["https://h/", "https://h/a"]
    assert {r.reason: r.n for r in counts.collect()} == {"max-pages": 2, "off-site": 1}
