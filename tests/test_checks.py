"""Every per-page rule: must fire, and must stay silent."""

from pyspark.sql import functions as F

from captures import capture, dom, frame, link, rules
from webaudit.config import AuditConfig
from webaudit.operators import checks as C
from webaudit.schemas import LINK_STATUS

CFG = AuditConfig(baseUrl="https://example.com",
                  forbiddenHosts=("staging.example.com", "dev.example.com"))
STAGING = "https://staging.example.com/en/cart"


def leaks(spark, *captures, cfg=CFG):
    return C.check_forbidden_hosts(frame(spark, *captures), cfg)


def test_every_surface_leaks(spark):
    page = capture(
        dom=dom(
            links=[link(STAGING)] * 50,
            resources=[dict(url="https://dev.example.com/logo.png", where="img[src]")],
            canonical="https://staging.example.com/en/vps",
            hreflang=[dict(hreflang="de", href="https://dev.example.com/de")],
            og={"og:image": "https://dev.example.com/o.png", "og:title": "dev.example.com"},
            inlineScripts=['window.CONFIG={apiBase:"https://staging.example.com/api"};']),
        requestUrls=["https://dev.example.com/api/price"],
        redirectChain=["https://example.com/old", "https://staging.example.com/en/vps"],
        finalUrl="https://dev.example.com/x")
    got = rules(leaks(spark, page), "where")
    assert got == sorted([
        ("forbidden-host-in-link", "a[href]"),
        ("forbidden-host-in-resource", "img[src]"),
        ("forbidden-host-in-canonical", "link[rel=canonical]"),
        ("forbidden-host-in-hreflang", "link[hreflang=de]"),
        ("forbidden-host-in-og", "meta[og:image]"),
        ("forbidden-host-in-inline-script", "inline-script"),
        ("forbidden-host-in-request", "network"),
        ("forbidden-host-in-redirect", "redirect-chain"),
        ("forbidden-host-in-redirect", "final-url"),
    ])


def test_distinct_urls_stay_distinct(spark):
    urls = [f"https://staging.example.com/de/{i}/" for i in range(5)]
    page = capture(dom=dom(links=[link(u) for u in urls + urls]))
    assert sorted(r.target for r in leaks(spark, page).collect()) == urls


def test_localhost_depends_on_surface(spark):
    prose = capture(dom=dom(links=[link("http://localhost:11434/api")]))
    asset = capture(dom=dom(resources=[dict(url="http://localhost:3000/a.css", where="link[href]")]))
    call = capture(requestUrls=["http://127.0.0.1:5000/api"])
    assert rules(leaks(spark, prose)) == []
    assert rules(leaks(spark, asset)) == ["forbidden-host-in-resource"]
    assert rules(leaks(spark, call)) == ["forbidden-host-in-request"]


def test_the_audited_site_is_no_leak(spark):
    cfg = AuditConfig(baseUrl="http://127.0.0.1:3000", forbiddenHosts=("staging.example.com",))
    page = capture(url="http://127.0.0.1:3000/", finalUrl="http://127.0.0.1:3000/",
                   dom=dom(resources=[dict(url="http://127.0.0.1:3000/app.js", where="script[src]")]),
                   requestUrls=["http://127.0.0.1:3000/api"])
    assert rules(leaks(spark, page, cfg=cfg)) == []


def test_clean_pages_stay_clean(spark):
    page = capture(
        dom=dom(links=[link("https://dev.to/a"), link("https://dev.mysql.com/doc"),
                       link("https://staging.othervendor.test/a"), link("not a url")],
                canonical="https://example.com/en/vps"),
        requestUrls=["https://www.google-analytics.com/g"])
    assert rules(leaks(spark, page)) == []
    assert frame(spark, page).where(C.has_forbidden_host(CFG)).count() == 0
    assert frame(spark, capture(requestUrls=[STAGING])).where(
        C.has_forbidden_host(CFG)).count() == 1


def test_text_files(spark):
    text = ("see https://staging.example.com/a and https://staging.example.com/b, "
            "http://localhost/x, https://dev.example.com/c")
    files = spark.createDataFrame(
        [("example.com", "llms", "https://example.com/llms.txt", text)],
        "site string, kind string, url string, text string")
    got = sorted(r.target for r in C.scan_text_files(files, CFG).collect())
    assert got == ["https://dev.example.com/c", "https://staging.example.com/a"]


HTTP_CASES = [
    (dict(), []),
    (dict(navigationError="net::ERR", dom=None, status=0, domError="x"), ["navigation-failed"]),
    (dict(domError="boom", dom=None), ["dom-extraction-failed"]),
    (dict(status=404), ["client-error"]),
    (dict(status=503), ["server-error"]),
    (dict(status=503, dom=dom(title="Access denied | x")), ["page-blocked"]),
    (dict(status=403, dom=dom(title="Members only")), ["client-error"]),
    (dict(status=403, redirectChain=["https://example.com/pl"], dom=dom(title="Just a moment...")),
     ["page-blocked"]),
    (dict(status=429, dom=dom(title="Please try again shortly")), ["page-blocked"]),
    (dict(status=200, dom=dom(title="Just a moment...")), []),
    (dict(redirectChain=["a", "b"]), []),
    (dict(redirectChain=["a", "b", "c"]), ["long-redirect-chain"]),
    (dict(redirectChain=["a"], status=404), ["client-error", "redirect-to-error"]),
]


def by_case(issues, n):
    """Rules found per case; cases are numbered by ``seq``."""
    found = [[] for _ in range(n)]
    for row in issues.select("seq", "rule").collect():
        found[row.seq].append(row.rule)
    return [sorted(f) for f in found]


def test_http_status(spark):
    pages = [capture(seq=i, **changes) for i, (changes, _) in enumerate(HTTP_CASES)]
    got = by_case(C.check_http_status(frame(spark, *pages), CFG), len(pages))
    assert got == [expected for _, expected in HTTP_CASES]


def test_http_details(spark):
    rows = C.check_http_status(frame(
        spark,
        capture(status=429, attempts=3, source="sitemap", dom=dom(title=" Wait ")),
        capture(status=500, source="https://example.com/list"),
    ), CFG).collect()
    details = {r.rule: r.detail for r in rows}
    assert details["page-blocked"].split("\n")[:2] == [
        'HTTP 429, page titled "Wait"', "still blocked after 3 attempts"]
    assert details["page-blocked"].endswith("found on: sitemap")
    assert details["server-error"] == (
        "final URL: https://example.com/en/vps\nfound on: https://example.com/list")


def test_console(spark):
    page = capture(
        console=[dict(type="error", text="boom", location="a.js:1:2"),
                 dict(type="pageerror", text="boom", location=None),
                 dict(type="pageerror", text="x" * 250, location=None),
                 dict(type="error", text="at GoogleTagManager.com/gtm.js", location=None),
                 dict(type="warning", text="careful", location=None),
                 dict(type="error", text="404:https://example.com/a.js", location=None)],
        failedRequests=[
            dict(url="https://example.com/a.js", status=404, method="GET", resourceType="script",
                 failure=None),
            dict(url="https://example.com/b.js", status=0, method="GET", resourceType="script",
                 failure="net::ERR_FAILED"),
            dict(url="https://example.com/b.js", status=0, method="GET", resourceType="script",
                 failure="net::ERR_FAILED"),
            dict(url="https://x.hotjar.com/b.js", status=500, method="GET", resourceType="script",
                 failure=None)],
        dom=dom(consentBannerVisible=True))
    got = rules(C.check_console_errors(frame(spark, page), CFG), "severity")
    assert got == sorted([
        ("console-error", "error"), ("uncaught-exception", "error"), ("console-error", "info"),
        ("console-warning", "info"), ("console-error", "error"),
        ("subresource-request-failed", "error"), ("subresource-error-status", "info"),
        ("consent-banner-not-dismissed", "warning")])
    long = C.check_console_errors(frame(spark, page), CFG).where("rule = 'uncaught-exception'")
    assert long.first().message == "Uncaught exception: " + "x" * 200 + "…"


GOOD = dict(title="A title of fair length", metaDescription="d" * 60,
            canonical="https://www.example.com/en/vps", htmlLang="en", h1s=["One"],
            og={"og:title": "t", "og:image": "i", "og:description": "d"})


SEO_CASES = [
    ({}, []),
    (dict(title=None), ["missing-title"]),
    (dict(title=""), ["missing-title"]),
    (dict(title="Short"), ["title-too-short"]),
    (dict(title="x" * 71), ["title-too-long"]),
    (dict(title="x" * 70), []),
    (dict(metaDescription=""), ["missing-meta-description"]),
    (dict(metaDescription="short"), ["description-too-short"]),
    (dict(metaDescription="x" * 161), ["description-too-long"]),
    (dict(h1s=[]), ["missing-h1"]),
    (dict(h1s=["a", "b"]), ["multiple-h1"]),
    (dict(metaRobots="NoIndex, follow"), ["noindex-on-live-page"]),
    (dict(canonical=""), ["missing-canonical"]),
    (dict(canonical="http://[bad"), ["invalid-canonical"]),
    (dict(canonical="https://staging.example.com/c"), ["canonical-off-site"]),
    (dict(og={}), ["missing-og-description", "missing-og-image", "missing-og-title"]),
    (dict(htmlLang=""), ["missing-html-lang"]),
    (dict(hreflang=[dict(hreflang="de", href="https://example.com/de")]), ["hreflang-missing-self"]),
    (dict(hreflang=[dict(hreflang="en", href="https://example.com/en/vps/")]), []),
]


def test_seo(spark):
    pages = [capture(seq=i, dom=dom(**{**GOOD, **c})) for i, (c, _) in enumerate(SEO_CASES)]
    got = by_case(C.check_seo(frame(spark, *pages), CFG), len(pages))
    assert got == [expected for _, expected in SEO_CASES]


def test_seo_skips_error_pages(spark):
    pages = [capture(status=404, dom=dom(title=None)), capture(dom=None)]
    assert rules(C.check_seo(frame(spark, *pages), CFG)) == []


LINKS = [
    # status, redirects, ms, rule, severity
    ("https://www.facebook.com/x", 400, 0, 50, [("link-refused", "info")]),
    ("https://docs.example.com/a", 403, 0, 50, [("link-refused", "warning")]),
    ("https://example.com/gone", 404, 0, 50, [("link-dead", "error")]),
    ("https://example.com/broken", 503, 0, 50, [("link-server-error", "error")]),
    ("https://www.linkedin.com/x", 999, 0, 50, [("link-refused", "info")]),
    ("https://example.com/down", 0, 0, 90_000, [("link-unreachable", "error")]),
    ("https://example.com/moved", 200, 1, 50, [("link-redirects", "warning")]),
    ("https://example.com/slow", 200, 0, 15_001, [("link-slow", "warning")]),
    ("https://example.com/slowgone", 404, 0, 20_000, [("link-dead", "error"), ("link-slow", "warning")]),
    ("https://example.com/fine", 200, 0, 15_000, []),
]


def test_links(spark):
    status = spark.createDataFrame(
        [(u, s, None, r, None, ms) for u, s, r, ms, _ in LINKS], LINK_STATUS)
    page = capture(dom=dom(links=[
        *[link(u, "A" * 70) for u, *_ in LINKS], *[link(u + "#again", "second") for u, *_ in LINKS],
        link("mailto:a@b.c"), link("https://example.com/gone.pdf"), link("https://unprobed.example/")]))
    got = C.check_links(frame(spark, page), status, CFG)
    want = sorted((rule, sev, u) for u, *_, found in LINKS for rule, sev in found)
    assert rules(got, "severity", "target") == want
    dead = got.where("rule = 'link-dead' and target like '%gone'").first()
    assert dead.message == 'Link "' + "A" * 60 + '…" returned 404'


def test_mixed_content(spark):
    insecure = "http://cdn.example.com/a.js"
    page = capture(dom=dom(resources=[dict(url=insecure, where="script[src]")] * 2),
                   requestUrls=[insecure, "http://cdn.example.com/b.js", "https://x.example/"])
    plain = capture(finalUrl="http://example.com/", requestUrls=[insecure])
    unread = capture(dom=None, requestUrls=[insecure])
    got = rules(C.check_mixed_content(frame(spark, page, plain, unread), CFG), "target", "where")
    assert got == [("insecure-subresource", insecure, "script[src]"),
                   ("insecure-subresource", "http://cdn.example.com/b.js", "network")]


def test_images(spark):
    def img(src, alt="", width=640):
        return dict(src=src, alt=alt, naturalWidth=width)

    page = capture(dom=dom(images=[
        img("https://example.com/hero.png", None, 0), img("https://example.com/hero.png", None, 0),
        img("https://bat.bing.net/action/0?ti=9", None, 0), img("", None, 0),
        img("https://example.com/busy.png", "", -1)]))
    assert rules(C.check_images(frame(spark, page), CFG)) == ["broken-image", "missing-alt"]


def violation(**changes):
    base = dict(id="color-contrast", impact="serious", help="Contrast", helpUrl="https://h",
                tags=["wcag2aa", "cat.color"], nodes=[".a"], nodeCount=1, failureSummary="Fix it")
    return {**base, **changes}


def test_accessibility(spark):
    page = capture(axe=[violation(impact=i) for i in ("critical", "serious", "moderate", "minor")]
                   + [violation(id="image-alt", nodes=[".a", ".b"], nodeCount=42, tags=["cat.x"])])
    failed = capture(axeError="axe is not defined", axe=[violation()])
    got = C.check_accessibility(frame(spark, page, failed, capture(axe=[])), CFG)
    assert rules(got, "severity") == sorted([
        ("a11y-critical", "error"), ("a11y-serious", "error"), ("a11y-serious", "error"),
        ("a11y-moderate", "warning"), ("a11y-minor", "warning"), ("a11y-audit-failed", "error")])
    row = got.where("message like 'image-alt%'").first()
    assert row.message == "image-alt: Contrast — 42 elements"
    assert row.detail == ".a\n.b (+40 more)\n\nFix it\n\nWCAG: n/a"
    assert got.where(F.col("detail").contains("WCAG: WCAG2AA")).count() == 4
