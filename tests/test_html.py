"""HTML extraction: corner cases, and a brute-force comparison on real pages."""

import html as stdlib_html
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from webaudit.sources.html import extract_dom

PAGE = """<!DOCTYPE html><HTML lang='en'><head><base href="/base/">
<title>
  Fish &amp; Chips &#8212; caf&eacute; &copy </title><title>second</title>
<meta NAME="Description" content=" About &quot;us&quot; "><meta name=robots content=noindex>
<meta property="OG:Title" content="first"><meta property="og:title" content=" last ">
<meta property="og:image" content="">
<link rel="Canonical" href="page?a=1&amp;b=2"><link rel="alternate" hreflang="de" href="/de/x">
<link rel="canonical nofollow" href="/no"><link rel=stylesheet href=style.css>
<!-- <a href="/hidden">x</a> <script>no()</script> -->
<script>if (a < b) { document.write("<a href='/written'>w</a>"); } // <!-- not a comment
</script><script src="app.js" async></script><script>  </script>
<style>a > b { color: red }</style><noscript><img src="/ns.gif"></noscript></head>
<body><h1> Main <b>title</b> &amp; more</h1><h1></h1>
<a title="a > b href=fake" href="/one?x=1&copy=2#t">One <img src=i.png alt> </a>
<a name="x">no href</a><a href="two" rel="nofollow">T<b>w</b>o<a href=''>Empty</a>
<a href="mailto:a@b.c">mail</a><a href="/für">für</a>
<img srcset="s1.png 1x, s2.png 2x" src="/full.png" alt=''><img src="noalt.png">
<iframe src="https://v.example/f"></iframe><video src="v.mp4"><source src="s.webm"></video>
<form action="/submit"></form></body></HTML>"""


def test_corner_cases(spark):
    df = spark.createDataFrame([("https://h.example/en/p", PAGE)], "url string, html string")
    d = extract_dom(df).first().dom
    b = "https://h.example/base/"
    assert d.title == "Fish & Chips — café ©"
    assert d.metaDescription == 'About "us"'
    assert d.metaRobots == "noindex"
    assert d.canonical == b + "page?a=1&b=2"
    assert d.htmlLang == "en"
    assert d.h1s == ["Main title & more", ""]
    assert d.og == {"og:title": "last"}
    assert [(x.hreflang, x.href) for x in d.hreflang] == [("de", "https://h.example/de/x")]
    assert [(x.href, x.text, x.rel) for x in d.links] == [
        ("https://h.example/one?x=1&copy=2#t", "One", None),
        (b + "two", "Two", "nofollow"), ("", "Empty", None), ("mailto:a@b.c", "mail", None),
        ("https://h.example/f%C3%BCr", "für", None)]
    assert [(x.src, x.alt) for x in d.images] == [
        (b + "i.png", ""), ("https://h.example/full.png", ""), (b + "noalt.png", None)]
    assert [(x.where, x.url) for x in d.resources] == [
        ("script[src]", b + "app.js"), ("iframe[src]", "https://v.example/f"),
        ("img[srcset]", b + "s1.png"), ("img[srcset]", b + "s2.png"),
        ("source[src]", b + "s.webm"), ("video[src]", b + "v.mp4"),
        ("link[href]", b + "page?a=1&b=2"), ("link[href]", "https://h.example/de/x"),
        ("link[href]", "https://h.example/no"), ("link[href]", b + "style.css"),
        ("form[action]", "https://h.example/submit"), ("img[src]", b + "i.png"),
        ("img[src]", "https://h.example/full.png"), ("img[src]", b + "noalt.png")]
    assert len(d.inlineScripts) == 1 and d.inlineScripts[0].startswith("if (a < b)")


class Brute(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.h1s, self.hrefs, self.stack, self.lang = "", [], [], [], None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        self.stack.append(tag)
        if tag == "html":
            self.lang = attrs.get("lang")
        if tag == "a" and "href" in attrs:
            self.hrefs.append(attrs["href"])
        if tag == "h1":
            self.h1s.append("")

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if "title" in self.stack:
            self.title += data
        if "h1" in self.stack:
            self.h1s[-1] += data


def test_against_a_parser_on_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = extract_dom(pages, surfaces=("title", "h1s", "htmlLang", "links")).select(
        "url", "html", "dom").collect()
    assert rows
    for r in rows:
        p = Brute()
        p.feed(r.html)
        assert r.dom.title == " ".join(p.title.split())
        assert r.dom.htmlLang == p.lang
        assert r.dom.h1s == [h.strip() for h in p.h1s]
        got = [stdlib_html.unescape(x.href) for x in r.dom.links]
        assert len(got) == len(p.hrefs)
        for mine, theirs in zip(r.dom.links, p.hrefs):
            joined = urljoin(r.url, theirs)
            assert mine.href.split("/")[2] == joined.split("/")[2]


def test_unescape(spark):
    from webaudit.functions.markup import unescape_sql
    samples = ["a &lt;b&gt; &amp;amp; &nbsp;x", "&#x1F600; &#65;&#0;", "&copyx &unknown; &", "R&D",
               "&notin; &not x", "plain"]
    df = spark.createDataFrame([(s,) for s in samples], "s string").select(
        "s", F.expr(unescape_sql("s")).alias("u"))
    for r in df.collect():
        assert r.u == stdlib_html.unescape(r.s), r.s
