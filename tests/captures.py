"""Hand-built captures for must-fire and must-stay-silent tests."""

from webaudit.schemas import CAPTURE


def dom(**changes):
    base = dict(
        title="Example page title", metaDescription=None, metaRobots=None, canonical=None,
        htmlLang="en", h1s=["Example"], og={}, hreflang=[], links=[], images=[], resources=[],
        inlineScripts=[], consentBannerVisible=False)
    return {**base, **changes}


def link(href, text="Buy", rel=None):
    return dict(href=href, text=text, rel=rel)


def capture(**changes):
    base = dict(
        site="example.com", seq=0, url="https://example.com/en/vps",
        finalUrl="https://example.com/en/vps", status=200, redirectChain=[], depth=0,
        source="seed", loadMs=100, attempts=1, dom=dom(), console=[], failedRequests=[],
        requestUrls=[], axe=None, axeError=None, navigationError=None, domError=None)
    return {**base, **changes}


def frame(spark, *captures):
    return spark.createDataFrame(list(captures), CAPTURE)


def rules(df, *extra):
    rows = df.select("rule", *extra).collect()
    return sorted(r.rule for r in rows) if not extra else sorted(tuple(r) for r in rows)
