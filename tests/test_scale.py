"""Operators whose groups may be hot, against brute force on skewed random data."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from webaudit.config import AuditConfig
from webaudit.operators.backoff import peak_in_flight, strike_backoff, strike_state
from webaudit.operators.crosspage import duplicate_groups, duplicate_members
from webaudit.operators.frontier import judge_offers
from webaudit.operators.skew import first_k_list, salted_join, top_k

from captures import capture, dom, frame


def skewed(rng, n):
    return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", i, rng.randrange(1000))
            for i in range(n)]


def test_top_k_and_lists(spark):
    rows = skewed(random.Random(1), 600)
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = top_k(df, ["k"], [F.col("v"), F.col("i")], 7, ["i"]).collect()
    want = defaultdict(list)
    for k, i, v in rows:
        want[k].append((v, i))
    assert {(r.k, r.rank, r.i) for r in got} == {
        (k, n + 1, i) for k, vs in want.items() for n, (v, i) in enumerate(sorted(vs)[:7])}
    lists = first_k_list(df, ["k"], [F.col("v"), F.col("i")], "i", 5, "ids", ["i"]).collect()
    assert {r.k: r.ids for r in lists} == {
        k: [i for _, i in sorted(vs)[:5]] for k, vs in want.items()}


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame(skewed(random.Random(2), 400), "k string, i long, v long")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("zz", 4)], "k string, w long")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = salted_join(left, right, ["k"], ["i"], how)
        b = left.join(right, ["k"], how)
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_duplicate_groups_stay_bounded_and_whole(spark):
    pages = [capture(seq=i, url=f"https://example.com/{i}", dom=dom(title="Same" if i % 3 else f"T{i}"))
             for i in range(30)] + [capture(seq=99, url="x", status=404, dom=dom(title="Same"))]
    df = frame(spark, *pages)
    group = duplicate_groups(df, "title", inline=4).first()
    assert (group.n, group.first_url, group.urls) == (
        20, "https://example.com/1", [f"https://example.com/{i}" for i in (1, 2, 4, 5)])
    assert sorted(r.seq for r in duplicate_members(df, "title").collect()) == [
        i for i in range(30) if i % 3]


def sequential_strikes(log, base, cap, forget_us):
    state, out = {}, []
    for host, us, event, retry in sorted(log, key=lambda r: (r[1], r[2])):
        strike, last, until = state.get(host, (0, None, 0))
        strike = strike + 1 if last is not None and us - last < forget_us else 1
        wait = min(max(base * 2 ** (strike - 1), retry or 0), cap)
        until = max(until, us // 1000 + wait)
        state[host] = (strike, us, until)
        out.append((host, event, strike, wait, until))
    return sorted(out)


CFG = AuditConfig(rateLimitBackoffMs=40, maxRateLimitBackoffMs=200, forgetMs=600_000)


def strike_log(spark, rows):
    return spark.createDataFrame(rows, "host string, us long, event_id long, retry_after_ms long") \
        .select("host", F.timestamp_micros("us").alias("ts"), "event_id",
                F.lit(429).alias("status"), "retry_after_ms")


def read_strikes(df):
    return sorted((r.host, r.event_id, r.strike, r.wait_ms, r.cooldown_until_ms) for r in df.collect())


def test_strikes_double_up_to_the_cap(spark):
    rows = [("a", i * 1000, i, None) for i in range(5)] + [
        ("b", 0, 10, 150), ("c", 0, 11, 3_600_000)]
    got = {r[1]: r[3] for r in read_strikes(strike_backoff(strike_log(spark, rows), CFG))}
    assert [got[i] for i in range(5)] == [40, 80, 160, 200, 200]
    assert (got[10], got[11]) == (150, 200)


def test_sliced_scan_equals_one_pass(spark):
    rng = random.Random(3)
    t0 = 1_700_000_000_000_000
    rows = [("hot" if rng.random() < 0.6 else f"h{rng.randrange(4)}",
             t0 + rng.randrange(40_000) * 1_000_000, i, rng.choice([None, None, 150]))
            for i in range(500)]
    want = sequential_strikes(rows, 40, 200, 600_000_000)
    for unit in ("minute", "hour", "day"):
        assert read_strikes(strike_backoff(strike_log(spark, rows), CFG, unit)) == want
    rows.sort(key=lambda r: (r[1], r[2]))
    first, second = rows[:200], rows[200:]
    one = strike_backoff(strike_log(spark, first), CFG)
    state = strike_state(one, None, CFG)
    two = strike_backoff(strike_log(spark, second), CFG, state=state)
    assert sorted(read_strikes(one) + read_strikes(two)) == want


def test_peak_in_flight(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        start = 1_700_000_000 + rng.randrange(20_000)
        rows.append(("hot" if i % 2 else f"h{i % 5}", start, start + 1 + rng.randrange(9000)))
    log = spark.createDataFrame(rows, "host string, s long, e long").select(
        "host", F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("end_ts"))
    want = {}
    for host in {r[0] for r in rows}:
        edges = sorted([(s, 1) for h, s, _ in rows if h == host] + [(e, -1) for h, _, e in rows if h == host])
        n = best = 0
        for _, d in edges:
            n += d
            best = max(best, n)
        want[host] = best
    for unit in ("minute", "hour"):
        assert {r.host: r.peak for r in peak_in_flight(log, unit).collect()} == want


def one_by_one(offers, max_pages, max_depth):
    seen, accepted, out = set(), 0, {}
    for seq, raw, depth in sorted(offers):
        key = raw.rstrip("/")
        if raw == "mailto:x":
            out[seq] = "invalid"
        elif key in seen:
            out[seq] = "duplicate"
        elif depth > max_depth:
            out[seq] = "too-deep"
        elif raw.endswith(".pdf"):
            out[seq] = "ignored"
            seen.add(key)
        elif accepted >= max_pages:
            out[seq] = "max-pages"
        else:
            out[seq] = None
            seen.add(key)
            accepted += 1
    return out


def test_admission_equals_one_by_one(spark):
    """Slash forms share an identity, but only one of them may be ignored: order decides."""
    rng = random.Random(5)
    offers = []
    for seq in range(400):
        page = "hot.pdf" if rng.random() < 0.3 else f"p{rng.randrange(25)}" + rng.choice(["", ".pdf"])
        raw = "mailto:x" if rng.random() < 0.05 else f"https://example.com/{page}" + rng.choice(["", "/"])
        offers.append((seq, raw, rng.choice([0, 1, 2, 3])))
    df = spark.createDataFrame(offers, "seq long, raw string, depth int").select(
        F.lit("example.com").alias("site"), "seq", "raw", "depth",
        F.lit(None).cast("string").alias("base"), F.lit("seed").alias("source"))
    for cap in (5, 10, 1000):
        got = judge_offers(df, AuditConfig(maxPages=cap, maxDepth=2)).collect()
        assert {r.seq: r.reason for r in got} == one_by_one(offers, cap, 2)
