"""Input and output contracts as Spark schemas."""

ISSUE_FIELDS = ("check", "severity", "rule", "message", "pageUrl", "target", "where", "detail")

ISSUE = "`check` string, severity string, rule string, message string, pageUrl string, " \
        "target string, `where` string, detail string"

DOM = (
    "struct<title:string, metaDescription:string, metaRobots:string, canonical:string, "
    "htmlLang:string, h1s:array<string>, og:map<string,string>, "
    "hreflang:array<struct<hreflang:string,href:string>>, "
    "links:array<struct<href:string,text:string,rel:string>>, "
    "images:array<struct<src:string,alt:string,naturalWidth:int>>, "
    "resources:array<struct<url:string,where:string>>, "
    "inlineScripts:array<string>, consentBannerVisible:boolean>"
)
CONSOLE = "array<struct<type:string,text:string,location:string>>"
FAILED_REQUESTS = (
    "array<struct<url:string,status:int,method:string,resourceType:string,failure:string>>"
)
AXE = (
    "array<struct<id:string,impact:string,help:string,helpUrl:string,tags:array<string>,"
    "nodes:array<string>,nodeCount:int,failureSummary:string>>"
)

# One row per crawled page. ``site`` and ``seq`` (crawl order) are ours: one job audits many
# sites, and order-dependent rules never rely on the order rows arrive in.
CAPTURE_FIELDS = {
    "site": "string", "seq": "bigint", "url": "string", "finalUrl": "string", "status": "int",
    "redirectChain": "array<string>", "depth": "int", "source": "string", "loadMs": "bigint",
    "attempts": "int", "dom": DOM, "console": CONSOLE, "failedRequests": FAILED_REQUESTS,
    "requestUrls": "array<string>", "axe": AXE, "axeError": "string",
    "navigationError": "string", "domError": "string",
}
CAPTURE = ", ".join(f"{name} {kind}" for name, kind in CAPTURE_FIELDS.items())

LINK_STATUS = (
    "url string, status int, finalUrl string, redirects int, error string, durationMs bigint"
)
SITE_FILES = "site string, kind string, url string, text string, error string"
PAGE_EVENTS = (
    "page_id bigint, seq bigint, event string, type string, text string, location string, "
    "url string, status int, method string, resource_type string, failure string, "
    "is_main_document boolean"
)
RUN = (
    "run string, baseUrl string, startedAt string, finishedAt string, durationMs bigint, "
    "pagesCrawled bigint, linksChecked bigint"
)
