"""Streams fed file by file give what their batch twins give."""

import random

from pyspark.sql import functions as F

from webaudit import streaming as S
from webaudit.config import AuditConfig
from webaudit.plans.audit import run_page_checks
from webaudit.schemas import CAPTURE
from webaudit.session import scratch_path

from captures import capture, dom, frame, link
from test_scale import read_strikes, sequential_strikes, strike_log

T0 = 1_700_000_000


def land(tmp_path, *batches):
    """Each batch becomes one file; modification order is batch order."""
    folder = tmp_path / "in"
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(str(folder / f"b{i:03d}"))
    return str(folder / "*")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").option(
        "pathGlobFilter", "*.parquet").parquet(path)


def test_page_findings(spark, tmp_path):
    pages = [capture(seq=i, url=f"https://example.com/{i}", status=[200, 404, 429][i % 3],
                     dom=dom(links=[link("https://x.ngrok.io/a")] * (i % 2))) for i in range(9)]
    path = land(tmp_path, frame(spark, *pages[:4]), frame(spark, *pages[4:]))
    got = S.run_available(S.page_findings(stream(spark, path, CAPTURE), AuditConfig()), "t")
    want = run_page_checks(frame(spark, *pages), AuditConfig())
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() > 20


def test_urls_are_probed_once(spark, tmp_path):
    def links(*urls):
        return spark.createDataFrame([(T0 + i, u) for i, u in enumerate(urls)], "t long, url string") \
            .select(F.timestamp_seconds("t").alias("ts"), "url")

    path = land(tmp_path, links("https://a/1", "https://a/1#x", "https://a/2", "mailto:x"),
                links("https://a/2?utm_source=y", "https://a/3", "https://a/f.pdf"))
    out = S.run_available(S.new_probe_urls(
        stream(spark, path, "ts timestamp, url string"), AuditConfig(), "1 hour"), "t")
    assert sorted(r.url for r in out.collect()) == ["https://a/1", "https://a/2", "https://a/3"]


def test_heartbeat_drops_what_is_too_late(spark, tmp_path):
    def pages(*seconds):
        return spark.createDataFrame([(T0 - T0 % 60 + s, 1, 0) for s in seconds],
                                     "t long, errors int, warnings int").select(
            F.timestamp_seconds("t").alias("ts"), "errors", "warnings")

    # A watermark rejects late rows from the second batch after the one that moved it.
    path = land(tmp_path, pages(0, 10, 59, 60), pages(1000), pages(1001), pages(5, 1005), pages(2000))
    beat = S.heartbeat(stream(spark, path, "ts timestamp, errors int, warnings int"),
                       "1 minute", delay="2 minutes")
    got = {int(r.start.timestamp()) % 10_000: (r.pages, r.errors) for r in S.run_available(beat, "t").collect()}
    assert sorted(got.values()) == [(1, 1), (3, 3), (3, 3)]


def test_sessions(spark, tmp_path):
    rows = [("a", T0), ("a", T0 + 100), ("a", T0 + 1000), ("b", T0 + 50), ("z", T0 + 50_000)]
    df = spark.createDataFrame(rows, "host string, t long").select(
        "host", F.timestamp_seconds("t").alias("ts"))
    path = land(tmp_path, df)
    out = S.run_available(S.crawl_sessions(
        stream(spark, path, "host string, ts timestamp"), "5 minutes", "1 minute"), "t")
    assert sorted((r.host, r.requests) for r in out.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_strikes_carry_over_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted((("hot" if rng.random() < 0.6 else f"h{rng.randrange(3)}",
                    T0 * 1_000_000 + rng.randrange(6_000) * 1_000_000, i, rng.choice([None, 150]))
                   for i in range(120)), key=lambda r: (r[1], r[2]))
    log = [strike_log(spark, rows[a:a + 40]).withColumn("ts", F.col("ts")) for a in (0, 40, 80)]
    path = land(tmp_path, *log)
    cfg = AuditConfig(rateLimitBackoffMs=40, maxRateLimitBackoffMs=200, forgetMs=600_000)
    out, state, mark = (scratch_path(spark, n) for n in ("o", "s", "m"))
    schema = "host string, ts timestamp, event_id long, status int, retry_after_ms long"
    S.strike_batches(stream(spark, path, schema), cfg, out, state, mark).awaitTermination()
    assert read_strikes(spark.read.parquet(out)) == sequential_strikes(rows, 40, 200, 600_000_000)


def test_retries_across_batches(spark, tmp_path):
    def fetches(*rows):
        return spark.createDataFrame(list(rows), "url string, attempt_no int, status int")

    path = land(tmp_path, fetches(("a", 1, 429), ("b", 1, 200), ("c", 1, 429), ("d", 1, 429)),
                fetches(("a", 2, 200), ("c", 2, 429)), fetches(("c", 3, 429)))
    out = S.run_available(S.final_captures(
        stream(spark, path, "url string, attempt_no int, status int"), AuditConfig()), "t")
    assert sorted(map(tuple, out.select("url", "status", "attempts", "retried").collect())) == [
        ("a", 200, 2, 1), ("b", 200, 1, 0), ("c", 429, 3, 2)]  # d never returns, and nothing holds it


def test_urls_are_probed_once_ever(spark, tmp_path):
    def links(*urls):
        return spark.createDataFrame([(u,) for u in urls], "url string")

    path = land(tmp_path, links("https://a/1", "https://a/1#x", "https://a/2"), links("https://a/3"),
                links("https://a/1?utm_source=y", "https://a/k", "mailto:x"), links("https://a/4", "https://a/3"))
    known = links("https://a/k")
    out, mark = scratch_path(spark, "once"), scratch_path(spark, "once-mark")
    for _ in range(2):  # a restart offers nothing again
        S.probe_batches(stream(spark, path, "url string"), AuditConfig(), out, mark, known).awaitTermination()
        got = [(r.batch, r.url) for r in spark.read.schema("url string, batch int").parquet(out).collect()]
        assert sorted(got) == [(0, "https://a/1"), (0, "https://a/2"), (1, "https://a/3"), (3, "https://a/4")]


def test_windows_in_update_mode_take_late_rows_and_keep_no_closed_state(spark, tmp_path):
    def pages(*seconds):
        return spark.createDataFrame([(T0 - T0 % 60 + s, 1, 0) for s in seconds],
                                     "t long, errors int, warnings int").select(
            F.timestamp_seconds("t").alias("ts"), "errors", "warnings")

    path = land(tmp_path, pages(0, 10, 61), pages(20, 62), pages(1000), pages(1001), pages(30, 1002), pages(2000))
    beat = S.heartbeat(stream(spark, path, "ts timestamp, errors int, warnings int"), "1 minute", delay="2 minutes")
    out = scratch_path(spark, "beat")
    run = S.upsert_batches(beat, out, scratch_path(spark, "beat-mark"))
    run.awaitTermination()
    got = S.latest(spark, out, beat.schema, ["start", "end"]).orderBy("start").collect()
    assert [r.pages for r in got] == [3, 2, 3, 1]  # the row at 30 s came after its window had closed
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
