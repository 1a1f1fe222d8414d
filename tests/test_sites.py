"""Several sites in one job: base URLs, sitemap walks, alternates, limits; stored reports."""

import random

from pyspark.sql import functions as F

from webaudit.config import AuditConfig, CustomCheck
from webaudit.functions.urls import match_host
from webaudit.operators.crosspage import duplicate_issues, duplicate_members, hreflang_issues
from webaudit.operators.frontier import crawl_frontier, judge_offers
from webaudit.operators.host_patterns import match_hosts
from webaudit.operators.report import write_report
from webaudit.plans.audit import audit, base_urls
from webaudit.schemas import ISSUE, RUN, SITE_FILES
from webaudit.sources.captures import broken_reports, read_report
from webaudit.sources.logs import reduce_probe_attempts
from webaudit.sources.textfiles import parse_llms_txt

from captures import capture, dom, frame, link

CROSS = AuditConfig(checks=("cross-page",))


def page(site, path, seq=0, **changes):
    url = f"https://{site}{path}"
    return capture(site=site.removeprefix("www."), seq=seq, url=url, finalUrl=url, **changes)


def loc(*urls):
    return "".join(f"<loc>{u}</loc>" for u in urls)


def test_audit_walks_an_index_from_the_real_base(spark):
    captures = frame(spark, page("www.a.com", "/", 0), page("www.a.com", "/x", 1, dom=dom(title="Other page title")))
    files = spark.createDataFrame([
        ("a.com", "sitemap", "https://www.a.com/sitemap.xml",
         "<sitemapindex >" + loc("https://www.a.com/s1.xml", "https://www.a.com/gone.xml"), None),
        ("a.com", "sitemap", "https://www.a.com/s1.xml", "<urlset>" + loc("https://www.a.com/"), None)], SITE_FILES)
    assert base_urls(captures, CROSS).first().baseUrl == "https://www.a.com"
    result = audit(captures, CROSS, files=files)
    found = result.issues.where("rule = 'page-missing-from-sitemap'").collect()
    assert [(r.pageUrl, r.detail) for r in found] == [("https://www.a.com", "https://www.a.com/x")]
    assert [r.url for r in result.sitemap_errors.collect()] == ["https://www.a.com/gone.xml"]


def test_llms_links_start_at_the_file(spark):
    files = spark.createDataFrame(
        [("a.com", "llms", "http://www.a.com/llms.txt", "[x](/x) and https://b.com/y", None)], SITE_FILES)
    assert sorted(r.url for r in parse_llms_txt(files).collect()) == ["http://www.a.com/x", "https://b.com/y"]


def test_alternates_of_another_audit_are_not_judged(spark):
    to_b = dom(hreflang=[dict(hreflang="de", href="https://b.com/")])
    rows = [page("a.com", "/", dom=to_b), page("b.com", "/", seq=5)]
    assert hreflang_issues(frame(spark, *rows)).count() == 0
    own = [page("a.com", "/", dom=to_b), {**page("b.com", "/", seq=5), "site": "a.com"}]
    assert hreflang_issues(frame(spark, *own)).count() == 1


def test_a_blocked_page_of_another_site_hides_nothing(spark):
    rows = [page("a.com", "/"), {**page("a.com", "/"), "site": "b.com", "status": 429}]
    custom = CustomCheck("mine", lambda c, s: c.select(
        "site", "seq", F.lit("mine").alias("check"), F.lit("info").alias("severity"), F.lit("r").alias("rule"),
        F.lit("m").alias("message"), F.col("url").alias("pageUrl"),
        *[F.lit(None).cast("string").alias(n) for n in ("target", "where", "detail")]))
    cfg = AuditConfig(checks=("mine",), customChecks=(custom,))
    found = audit(frame(spark, *rows), cfg).issues.where("rule = 'r'").collect()
    assert [r.site for r in found] == ["a.com"]


def test_large_groups_of_duplicates_are_one_finding_and_lose_no_page(spark):
    df = frame(spark, *[page("a.com", f"/{i}", i) for i in range(0, 50, 2)],
               *[page("b.com", f"/{i}", i) for i in (3, 90)])
    found = {r.site: r for r in duplicate_issues(df, inline=10).where("rule = 'duplicate-title'").collect()}
    assert found["a.com"].message.startswith("25 pages share") and found["b.com"].message.startswith("2 pages")
    assert found["a.com"].detail.split("\n") == [f"https://a.com/{i}" for i in range(0, 20, 2)] + ["… and 15 more"]
    assert found["b.com"].detail.split("\n") == ["https://b.com/3", "https://b.com/90"]
    members = duplicate_members(df, "title", chunk=4).where("site = 'a.com'").orderBy("rank").collect()
    assert [(r.rank, r.chunk, r.url) for r in members] == [
        (i, i // 4, f"https://a.com/{2 * i}") for i in range(25)]
    assert audit(df, CROSS).members.where("field = 'title'").count() == 27
    # The same pages at other crawl positions give the same finding.
    moved = frame(spark, *[page("a.com", f"/{i}", i * 1000) for i in range(0, 50, 2)])
    again = duplicate_issues(moved, inline=10).where("rule = 'duplicate-title'").collect()
    assert [(r.message, r.detail) for r in again] == [(found["a.com"].message, found["a.com"].detail)]


def test_run_rows_say_what_the_run_did(spark):
    links = [link("https://a.com/x"), link("/y"), link("https://b.com/"), link("https://b.com/#t"), link("mailto:a@b.c")]
    rows = [page("a.com", "/", 0, dom=dom(links=links)),
            page("a.com", "/x", 1, attempts=3, dom=dom(links=links, title="Just a moment..."), status=403),
            page("b.com", "/", 0, status=404)]
    status = spark.createDataFrame([("https://a.com/x", 200, None, 0, None, 5), ("https://b.com/", 404, None, 0, None, 5)],
                                   "url string, status int, finalUrl string, redirects int, error string, durationMs bigint")
    files = spark.createDataFrame([("a.com", "robots", "https://a.com/robots.txt", "User-agent: *\nDisallow: /y", None)],
                                  SITE_FILES)
    result = audit(frame(spark, *rows), AuditConfig(runName="Night run", includePaths=()), files=files,
                   link_status=status, started_at="2026-01-01T00:00:00Z", finished_at="2026-01-01T00:00:02Z")
    runs = {r.site: r for r in result.runs.collect()}
    a, b = runs["a.com"], runs["b.com"]
    assert (a.run, a.baseUrl, a.durationMs, a.pagesCrawled, a.pagesBlocked, a.linksChecked, a.rateLimited) == (
        "night-run", "https://a.com", 2000, 2, 1, 2, 2)
    # Ten offers: /x is new once, /y is shut off by robots.txt, b.com is another site, mailto is no page.
    assert a.skipped == {"robots": 1, "off-site": 1, "invalid": 2, "duplicate": 5}
    assert (b.pagesCrawled, b.linksChecked, b.skipped) == (1, 0, {})
    counted = result.issues.where("site = 'a.com'").groupBy("severity").count().collect()
    assert {r["severity"]: r["count"] for r in counted} == {
        k: v for k, v in (("error", a.error), ("warning", a.warning), ("info", a.info)) if v}
    assert result.totals["pages"] == 3 and result.totals["blocked"] == 1 and result.totals["retried"] == 2


def test_site_patterns_equal_lists_tried_in_order(spark):
    rng = random.Random(5)
    labels = ["a", "b", "staging", "example", "com", "local", "x1"]
    hosts = sorted({".".join(rng.choices(labels, k=rng.randrange(1, 5))) for _ in range(150)} | {"A.Example", ""})
    made = lambda: ".".join(rng.choices([*labels, "*", "*", "st*", "*x1"], k=rng.randrange(1, 4)))
    lists = {site: [made() for _ in range(60)] + ["a.b", "A.*", "*.LOCAL"] for site in ("one.com", "two.com")}
    lists["none.com"] = []
    patterns = spark.createDataFrame(
        [(s, "forbiddenHosts", i, p) for s, ps in lists.items() for i, p in enumerate(ps)],
        "site string, list string, pos int, pattern string")
    df = spark.createDataFrame([(s, h) for s in lists for h in hosts], "site string, host string")
    got = {(r.site, r.host): r.pattern for r in match_hosts(df, patterns).collect()}
    for site, listed in lists.items():
        want = df.where(F.col("site") == site).select("host", match_host(F.col("host"), listed).alias("p")).collect()
        assert {r.host: got.get((site, r.host)) for r in want} == {r.host: r.p for r in want}
    assert len(got) > 100


def test_site_lists_in_an_audit(spark):
    leaky = dom(links=[link("https://dev.a.com/"), link("https://x.ngrok.io/")])
    rows = [page(s, "/", 0, dom=leaky, requestUrls=["http://localhost:1/", "http://127.0.0.1/"])
            for s in ("a.com", "b.com", "c.com")]
    sites = spark.createDataFrame(
        [("a.com", ["dev.*"], ["localhost"]), ("b.com", [], None), ("c.com", None, [])],
        "site string, forbiddenHosts array<string>, localhostHosts array<string>")
    files = spark.createDataFrame([(s, "llms", f"https://{s}/llms.txt", "see https://dev.a.com/z", None)
                                   for s in ("a.com", "b.com")], SITE_FILES)
    cfg = AuditConfig(checks=("forbidden-hosts",))
    result = audit(frame(spark, *rows), cfg, files=files, sites=sites)
    assert sorted((r.site, r.rule, r.target) for r in result.issues.collect()) == [
        ("a.com", "forbidden-host-in-link", "https://dev.a.com/"),
        ("a.com", "forbidden-host-in-request", "http://localhost:1/"),
        ("a.com", "forbidden-host-in-text-file", "https://dev.a.com/z"),
        ("b.com", "forbidden-host-in-request", "http://127.0.0.1/"),
        ("b.com", "forbidden-host-in-request", "http://localhost:1/"),
        ("c.com", "forbidden-host-in-link", "https://x.ngrok.io/")]
    plain = audit(frame(spark, rows[0]), cfg.with_(forbiddenHosts=("dev.*",), localhostHosts=("localhost",)), files=files)
    key = lambda r: (r.rule, r.message, r.target, r.where, r.detail)
    assert sorted(map(key, plain.issues.where("site = 'a.com'").collect()), key=str) == sorted(
        map(key, result.issues.where("site = 'a.com'").collect()), key=str)



def test_limits_of_each_site(spark):
    offers = spark.createDataFrame(
        [(s, i, f"https://{s}/{i}", d, None, "x") for s in ("a.com", "b.com") for i, d in enumerate((0, 0, 0, 2))],
        "site string, seq long, raw string, depth int, base string, source string")
    sites = spark.createDataFrame([("a.com", 2, 1)], "site string, maxPages int, maxDepth int")
    rows = judge_offers(offers, AuditConfig(perSite=True), sites=sites).collect()
    assert {(r.site, r.seq): r.reason for r in rows} == {
        ("a.com", 0): None, ("a.com", 1): None, ("a.com", 2): "max-pages", ("a.com", 3): "too-deep",
        **{("b.com", i): None for i in range(4)}}


def test_crawl_goes_as_deep_as_its_site_allows(spark):
    seeds = spark.createDataFrame([(s, 0, f"https://{s}/0", 0, None, "seed") for s in ("a.com", "b.com")],
                                  "site string, seq long, raw string, depth int, base string, source string")
    edges = spark.createDataFrame([(s, f"https://{s}/{i}", f"https://{s}/{i + 1}", 10 + i)
                                   for s in ("a.com", "b.com") for i in range(4)],
                                  "site string, src_url string, dst_url string, seq long")
    sites = spark.createDataFrame([("a.com", 3)], "site string, maxDepth int")
    pages, _ = crawl_frontier(seeds, edges, AuditConfig(perSite=True, maxDepth=1), sites=sites)
    assert {r.site: r.n for r in pages.groupBy("site").agg(F.count("*").alias("n")).collect()} == {
        "a.com": 4, "b.com": 2}


def test_probe_time_is_that_of_the_last_round(spark):
    rows = [("u", 1, 1, "HEAD", 405, 10_000), ("u", 2, 1, "GET", 200, 8_000),
            ("v", 1, 1, "HEAD", 0, 9_000), ("v", 2, 2, "HEAD", 405, 5), ("v", 3, 2, "GET", 200, 6)]
    attempts = spark.createDataFrame(
        [(u, n, r, m, s, u, False, None, d) for u, n, r, m, s, d in rows],
        "url string, attempt_no int, round int, method string, status int, final_url string, "
        "redirected boolean, error string, duration_ms long")
    assert {r.url: (r.status, r.durationMs) for r in reduce_probe_attempts(attempts).collect()} == {
        "u": (200, 18_000), "v": (200, 11)}


def test_reports_come_back_as_written(spark, tmp_path):
    issues = spark.createDataFrame(
        [("a.com", "seo", "error", "r", f"m{i}", f"https://a.com/{i % 3}", None, None, None) for i in range(9)],
        "site string, " + ISSUE)
    runs = spark.createDataFrame([(None, "https://a.com", "2024-01-01", None, None, None, None)], RUN)
    write_report(issues, runs, str(tmp_path), "nightly")
    back = read_report(spark, str(tmp_path), multi_line=False)
    assert {r.run for r in back.collect()} == {"nightly"}
    got = back.select("site", F.explode("issues").alias("i")).select("site", "i.*")
    assert sorted(map(str, got.collect())) == sorted(map(str, issues.collect()))


def test_a_run_with_a_broken_line_goes_as_a_whole(spark, tmp_path):
    started = '{"startedAt": "2024", "issues": [{"rule": "x"}]}\n'
    for name, body in (("half", started + '{"startedAt": "20'), ("good", started), ("none", "{}\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.json").write_text(body)
    assert [r.run for r in read_report(spark, str(tmp_path), multi_line=False).collect()] == ["good"]
    broken = broken_reports(spark, str(tmp_path), multi_line=False).collect()
    assert sorted((r.run, r.corrupt, r.started) for r in broken) == [("half", 1, 1), ("none", 0, 0)]


def test_issues_by_page_and_global_ones_are_read(spark, tmp_path):
    (tmp_path / "main").mkdir()
    (tmp_path / "main" / "report.json").write_text(
        '{"startedAt": "2024", "pages": [{"issues": [{"rule": "a"}]}, {}], "globalIssues": [{"rule": "b"}]}')
    assert [i.rule for i in read_report(spark, str(tmp_path)).first().issues] == ["a", "b"]
