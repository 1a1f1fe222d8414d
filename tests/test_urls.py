"""Scalar URL semantics, one row per case."""

import random

import pytest
from pyspark.sql import functions as F

from webaudit.functions import urls as U

NORMALIZE = [
    # (input, base, expected)
    ("https://example.com/en/vps?utm_source=x&gclid=y#pricing", None, "https://example.com/en/vps"),
    ("https://example.com/s?b=2&a=1", None, "https://example.com/s?a=1&b=2"),
    ("https://example.com/en/vps/", None, "https://example.com/en/vps/"),
    ("https://example.com/en/vps", None, "https://example.com/en/vps"),
    ("/de/vps", "https://example.com/en/", "https://example.com/de/vps"),
    ("../about", "https://example.com/en/vps", "https://example.com/about"),
    ("mailto:a@b.com", None, None),
    ("javascript:void(0)", None, None),
    ("not a url", None, None),
    ("https://EXAMPLE.com/EN/VPS", None, "https://example.com/EN/VPS"),
    ("https://example.com", None, "https://example.com/"),
    ("https://example.com:443/a", None, "https://example.com/a"),
    ("http://example.com:80/a", None, "http://example.com/a"),
    ("http://example.com:8080/a", None, "http://example.com:8080/a"),
    ("http://example.com:99999/a", None, None),
    ("//cdn.example.com/x", "https://example.com/", "https://cdn.example.com/x"),
    ("?page=2", "https://example.com/list?page=1", "https://example.com/list?page=2"),
    ("#top", "https://example.com/list?page=1#x", "https://example.com/list?page=1"),
    ("b/c", "https://example.com", "https://example.com/b/c"),
    ("b", "https://example.com/a/", "https://example.com/a/b"),
    ("/für", "https://example.com/", "https://example.com/f%C3%BCr"),
    ("/a b", "https://example.com/", "https://example.com/a%20b"),
    ("/a%2fb+c", "https://example.com/", "https://example.com/a%2fb+c"),
    ("https://example.com/?flag", None, "https://example.com/?flag="),
    ("https://example.com/?q=a%20b", None, "https://example.com/?q=a+b"),
    ("https://example.com/?q=100%", None, "https://example.com/?q=100%25"),
    ("https://example.com/?", None, "https://example.com/"),
    ("https://example.com/?a=1&&b=", None, "https://example.com/?a=1&b="),
    ("https://example.com/?b=2&a=2&b=1", None, "https://example.com/?a=2&b=2&b=1"),
    ("https://example.com/?page=2&ref=x", None, "https://example.com/?page=2"),
    ("https://example.com/?REF=x&mc_cid=1&_ga=2&refer=3", None, "https://example.com/?refer=3"),
    ("https://example.com/a/./b/../c", None, "https://example.com/a/c"),
    ("https://example.com/a/..", None, "https://example.com/"),
    ("https://example.com/a/%2E%2e/b", None, "https://example.com/b"),
    ("https://example.com\\a\\b", None, "https://example.com/a/b"),
    ("  https://example.com/a\n", None, "https://example.com/a"),
    ("http://[bad", None, None),
    ("http://[::1]:3000/a", None, "http://[::1]:3000/a"),
    ("http://a_b.com/x", None, "http://a_b.com/x"),
    ("http://exa mple.com/", None, None),
    ("https://", None, None),
    ("https:page", "https://example.com/en/x", "https://example.com/en/page"),
    ("http://user:pw@example.com/a", None, "http://user:pw@example.com/a"),
    ("http://127.0.0.1:5000/p", None, "http://127.0.0.1:5000/p"),
    ("http://999.0.0.1/p", None, None),
    ("http://bücher.example/a", None, "http://xn--bcher-kva.example/a"),
    ("HTTPS://BÜCHER.Straße.example:8443/Ä", None,
     "https://xn--bcher-kva.strasse.example:8443/%C3%84"),
    ("http://b%C3%BCcher.example/", None, "http://xn--bcher-kva.example/"),
    ("http://b%FFcher.example/", None, None),
    ("http://例え。テスト/x", None, "http://xn--r8jz45g.xn--zckzah/x"),
    ("http://ｅｘａｍｐｌｅ．com/", None, "http://example.com/"),
    ("http://ex\u00adample.com/", None, "http://example.com/"),
    ("http://a\u3000b.com/", None, None),
    ("//ü.example/y", "https://example.com/", "https://xn--tda.example/y"),
    ("http://0x7f.1/", None, "http://127.0.0.1/"),
    ("http://0X7F000001/", None, "http://127.0.0.1/"),
    ("http://2130706433/", None, "http://127.0.0.1/"),
    ("http://0177.0.0.01:5000/p", None, "http://127.0.0.1:5000/p"),
    ("http://127.1/", None, "http://127.0.0.1/"),
    ("http://127.0.0.1./", None, "http://127.0.0.1/"),
    ("http://0x/", None, "http://0.0.0.0/"),
    ("http://4294967295/", None, "http://255.255.255.255/"),
    ("http://4294967296/", None, None),
    ("http://1.2.3.256/", None, None),
    ("http://256.1/", None, None),
    ("http://1.16777215/", None, "http://1.255.255.255/"),
    ("http://1.2.3.4.5/", None, None),
    ("http://1.2.08.4/", None, None),
    ("http://a.0x1g/", None, "http://a.0x1g/"),
    ("http://a.5/", None, None),
    ("http://１２７.0.0.1/", None, "http://127.0.0.1/"),
    ("https://example.com/a|b", None, "https://example.com/a|b"),
    ("https://example.com//a//", None, "https://example.com//a//"),
    ("", None, None),
    (None, None, None),
]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_normalize(spark):
    rows = [(i, v, b) for i, (v, b, _) in enumerate(NORMALIZE)]
    df = frame(spark, rows, "i int, v string, b string")
    plain = df.where("b is null").select("i", U.normalize_url("v").alias("n"))
    based = df.where("b is not null").select("i", U.normalize_url("v", "b").alias("n"))
    got = {r.i: r.n for r in plain.union(based).collect()}
    wrong = [(NORMALIZE[i][:2], got[i], e) for i, (_, _, e) in enumerate(NORMALIZE) if got[i] != e]
    assert not wrong


def test_dedupe_key(spark):
    cases = {
        "https://example.com/en/vps/": "https://example.com/en/vps",
        "https://example.com/en/vps": "https://example.com/en/vps",
        "https://example.com/": "https://example.com/",
        "https://example.com//": "https://example.com/",
        "https://example.com/a//?b=1": "https://example.com/a?b=1",
        "https://example.com/de/vps/#x": "https://example.com/de/vps",
        "mailto:a@b.c": None,
    }
    df = frame(spark, list(cases.items()), "v string, e string")
    assert df.where(~U.dedupe_key("v").eqNullSafe(F.col("e"))).collect() == []


def test_hosts(spark):
    cases = {
        "https://WWW.Example.com:8080/x": "www.example.com",
        "ftp://Files.example.com/x": "files.example.com",
        "mailto:a@b.c": "",
        "foo://Bar:9/x": "bar",
        "/relative": None,
        "http://[bad": None,
        "http://u@h.example/": "h.example",
    }
    df = frame(spark, list(cases.items()), "v string, e string")
    bad = df.withColumn("got", U.host_of("v")).where("not (got <=> e)").collect()
    assert bad == []


def test_same_site(spark):
    rows = [
        ("https://www.example.com/en", "https://example.com", True),
        ("https://staging.example.com/en", "https://example.com", False),
        ("https://other-site.test", "https://example.com", False),
        ("http://example.com:8080", "https://example.com", True),
        ("nonsense", "https://example.com", False),
    ]
    df = frame(spark, rows, "a string, b string, e boolean")
    assert df.where(U.is_same_site(F.col("a"), F.col("b")) != F.col("e")).collect() == []


HOST_MATCHES = [
    ("dev.example.com", "dev.example.com", True),
    ("example.com", "dev.example.com", False),
    ("api.local", "*.local", True),
    ("local", "*.local", True),
    ("notlocal", "*.local", False),
    ("staging.example.com", "staging.*", True),
    ("staging", "staging.*", True),
    ("not-staging.example.com", "staging.*", False),
    ("staging-01", "staging-*", True),
    ("prod-01", "staging-*", False),
    ("eu-staging.example.com", "*-staging.example.com", True),
    ("staging.example.com", "*-staging.example.com", False),
    ("api.eu.example.com", "api.*.example.com", True),
    ("api.example.com", "api.*.example.com", False),
    ("dev.example.co.uk", "*.example.*", True),
    ("dev.notexample.com", "*.example.*", False),
    ("cdn.example.com.evil.test", "*.example.com", False),
    ("example.com.evil.test", "example.com", False),
    ("my-staging-tips.example.com", "*staging*", True),
    ("devxexample.com", "dev.example.com", False),
    ("a+b.example.com", "a+b.example.com", True),
    ("xa+b.example.com", "*a+b.example.com", True),
    ("STAGING.Example.COM", "*.example.com", True),
    ("staging.example.com", "*.EXAMPLE.com", True),
]


@pytest.mark.parametrize("as_column", [False, True])
def test_host_globs(spark, as_column):
    df = frame(spark, HOST_MATCHES, "h string, p string, e boolean")
    if as_column:
        got = df.select("h", "p", "e", U.host_matches_col(F.col("h"), F.col("p")).alias("g"))
        assert got.where("g <> e").collect() == []
    else:
        patterns = sorted({p for _, p, _ in HOST_MATCHES})
        got = df.select("h", "p", "e", *[
            U.host_matches(F.col("h"), p).alias(f"g{i}") for i, p in enumerate(patterns)])
        for r in got.collect():
            assert r[f"g{patterns.index(r.p)}"] == r.e, (r.h, r.p)


def test_first_forbidden_pattern_wins(spark):
    patterns = ["staging.example.com", "*.example.com", "localhost", "*.local"]
    cases = {
        "https://staging.example.com/en": "staging.example.com",
        "https://dev.example.com/a.js": "*.example.com",
        "http://localhost:3000/api": "localhost",
        "https://example.org/": None,
        "mailto:x@localhost": None,
    }
    df = frame(spark, list(cases.items()), "v string, e string")
    assert df.where(~U.match_forbidden_host("v", patterns).eqNullSafe(F.col("e"))).collect() == []


def test_locale_scope_and_paths(spark):
    locales = ["en", "es", "de", "en-us"]
    rows = [
        ("https://example.com/de/vps", "de", False),
        ("https://example.com/en-us/vps", "en-us", False),
        ("https://example.com/", None, False),
        ("https://example.com/blog/post", None, True),
        ("https://example.com/en/blog/post", "en", True),
        ("https://example.com/blog", None, True),
        ("https://example.com/BLOG/x", None, True),
        ("https://example.com/blogger/x", None, False),
        ("https://example.com/blog/de/x", None, True),
    ]
    df = frame(spark, rows, "v string, l string, b boolean").withColumn(
        "gl", U.locale_of("v", locales)).withColumn("gb", U.path_matches("v", ["/blog"], locales))
    assert df.where("not (gl <=> l) or gb <> b").collect() == []


def test_ignore_and_belongs(spark):
    rows = [
        ("https://example.com/a.PDF", True, False),
        ("https://example.com/a.pdf?x=1", True, False),
        ("https://example.com/pdf", False, False),
        ("https://example.com/cdn-cgi/x", True, False),
        ("https://www.facebook.com/tr?id=1", False, True),
        ("https://www.facebook.com/x", False, False),
        ("https://bat.bing.net/p", False, True),
        ("https://notbing.net/p", False, False),
    ]
    df = frame(spark, rows, "v string, i boolean, t boolean")
    bad = df.where(
        (U.matches_ignore_pattern(F.col("v"), [".pdf", "/cdn-cgi/"]) != F.col("i"))
        | (U.url_belongs_to(F.col("v"), ["bat.bing.net", "facebook.com/tr"]) != F.col("t")))
    assert bad.collect() == []


def test_absolutize(spark):
    cases = [
        ("/für?x=ü&b=1#t", "https://h.example/a", "https://h.example/f%C3%BCr?x=%C3%BC&b=1#t"),
        ("mailto:x@y.z", "https://h.example/a", "mailto:x@y.z"),
        ("javascript:void(0)", "https://h.example/a", "javascript:void(0)"),
        ("http://[bad", "https://h.example/a", "http://[bad"),
        ("", "https://h.example/a", ""),
        (None, "https://h.example/a", ""),
        ("x?utm_source=1", "https://h.example/a/b", "https://h.example/a/x?utm_source=1"),
    ]
    df = frame(spark, cases, "v string, b string, e string")
    bad = df.withColumn("g", U.absolutize(F.col("v"), F.col("b"))).where("not (g <=> e)").collect()
    assert bad == []


def test_international_hosts_equal_a_plain_encoder(spark):
    rng = random.Random(6)
    alphabets = ["abcz0", "éüßñ", "абвгд", "日本語テスト", "ａＢｃ"]

    def encoded(label):
        try:
            return label.encode("idna").decode()
        except UnicodeError:  # too long
            return None

    labels = {"".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 24)))
              for _ in range(400)}
    labels = sorted(w for w in labels if not w.isascii() and encoded(w))
    assert len(labels) > 200
    df = spark.createDataFrame([(w,) for w in labels], "w string").select(
        "w", U.host_of(F.concat(F.lit("https://"), "w", F.lit(".example/p"))).alias("h"))
    got = {r["w"]: r["h"] for r in df.collect()}
    assert got == {w: f"{encoded(w)}.example" for w in labels}


def test_number_hosts_equal_a_plain_parser(spark):
    rng = random.Random(3)

    def number(part):
        if part.startswith("0x"):
            return int(part[2:] or "0", 16)
        return int(part, 8) if part.startswith("0") else int(part)

    def plain(host):
        parts = host.split(".")
        try:
            n = [number(p) for p in parts]
        except ValueError:
            return None
        if len(n) > 4 or any(x > 255 for x in n[:-1]) or n[-1] >= 256 ** (5 - len(n)):
            return None
        value = n[-1] + sum(x << 8 * (3 - i) for i, x in enumerate(n[:-1]))
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))

    hosts = set()
    for _ in range(500):
        n = rng.randrange(1, 6)
        top = [256] * (n - 1) + [256 ** max(1, 5 - n) + 9]
        hosts.add(".".join(rng.choice(["{}", "0x{:x}", "0{:o}"]).format(rng.randrange(t)) for t in top))
    df = spark.createDataFrame([(h,) for h in sorted(hosts)], "w string").select(
        "w", U.host_of(F.concat(F.lit("http://"), "w", F.lit("/"))).alias("h"))
    assert {r["w"]: r["h"] for r in df.collect()} == {h: plain(h) for h in hosts}
