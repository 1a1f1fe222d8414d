"""Conversation repair against plain enumeration."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from webaudit.llm import conversation as conv

SCHEMA = "conv_id long, turn long, role string, text string, gaps int, part string"
WANTED = re.compile("(s?(ua)+)?")


def enumerated(rows):
    """Cheapest (cost, audit, repaired lines) of ``role, text, fault`` rows, path by path."""
    heap, seen = [(0, "", 0, ())], {}
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(rows) and WANTED.fullmatch("".join(r[:1] for r, _ in out)):
            return cost, audit, [f"{r}:{t}" for r, t in out]
        state = "".join(r[:1] for r, _ in out)[-2:], len(out) % 4, i
        if seen.get((state, out), (9e9,)) < (cost, audit):
            continue
        seen[state, out] = (cost, audit)
        ways = []
        if i < len(rows):
            role, text, fault = rows[i]
            ways.append((3, "D", i + 1, out))
            if fault in ("none", "truncated"):
                more = fault == "truncated"
                if role:  # an empty role has no initial to keep
                    ways.append((more, "K", i + 1, (*out, (role, text))))
                ways += [(2 + more, "R", i + 1, (*out, (r, text))) for r in ("user", "assistant")]
        if len(out) < len(rows) + 3:
            ways += [(2, "I", i, (*out, (r, ""))) for r in ("user", "assistant")]
        for c, letter, j, o in ways:
            initials = "".join(r[:1] for r, _ in o)
            if re.fullmatch("s?(ua)*u?", initials):
                heapq.heappush(heap, (cost + c, audit + letter, j, o))
    raise AssertionError


def plain(rows):
    """The contract's columns for rows ``turn, role, text`` of one conversation, after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    out, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0, "none": 0}
    for _, role, text in rows:
        stripped = text.strip("\t\n\x0b\x0c\r ")
        fault = ("blank" if not stripped else "duplicate" if (role, text) in seen
                 else "truncated" if stripped[-1] not in ".!?" else "none")
        seen.add((role, text))
        counts[fault] += 1
        out.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit, lines = enumerated(out)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        found = convs.setdefault(c, [])
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        found += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return {c: plain(found) for c, found in convs.items()}


def some_rows():
    rng = random.Random(7)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Hi.", "What?", "no end", "", " \t", None, "Same.", "line\nbreak!", "é日\U0001F600."]
    rows = []
    for c in range(150):
        for turn in range(rng.randrange(1, 6)):
            rows.append((c, turn, rng.choice(roles), rng.choice(texts)))
    rows += [(500, None, "user", "Nothing known."), (500, None, "assistant", "Nor here."),
             (501, 3, "user", "A."), (501, 3, "user", "A."), (501, 9, "user", "A."),
             (None, 1, "user", "No id."), (None, None, "assistant", "No id."),
             (9007199254740993, 4, "system", "x" * 3_000_000 + ".")]
    return rows


def result(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("chunk", [1024, 2])
def test_repair_equals_enumeration(spark, monkeypatch, chunk):
    monkeypatch.setattr(conv, "CHUNK_ROWS", chunk)
    rows = some_rows()
    want = by_hand(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    got = conv.repair(conv.damaged(df))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                           "audit", "repaired_sha256"]
    found = result(got)
    assert got.count() == len(found) and found == want


def test_repair_of_nothing_and_of_dropped_turns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conv.repair(conv.damaged(none)).count() == 0
    gone = next(t for t in range(999) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, gone, "user", "Gone.", 1, "x")], SCHEMA)
    assert result(conv.repair(conv.damaged(df))) == {
        1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_conversation_lies_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(conv, "CHUNK_ROWS", 16)
    rng = random.Random(1)
    rows = [(t, rng.choice(["user", "assistant", "system"]), f"turn {t}" + "." * rng.randrange(2))
            for t in range(3000)]
    df = spark.createDataFrame([(1, *r, 1) for r in rows] + [(2, 1, "user", "Hi.", 1)],
                               "conv_id long, turn long, role string, text string, copies long")
    got = result(conv.repair(df))[1]
    symbols = [r[0].upper() if t[-1] != "." else r[0] for _, r, t in rows]
    whole = conv.Grammar([]).walk("".join(symbols), conv.START, None)
    assert got[5:7] == (whole[0], whole[1] + whole[2])
    lines = conv.repaired_lines(got[6], conv.START, [r[1] for r in rows], [r[2] for r in rows])
    assert got[7] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_grammar_changes_no_result():
    rng = random.Random(2)
    for _ in range(300):
        seq = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randrange(30)))
        rules, known = [], "suaxSUAXd"
        for i in range(12):
            rules.append(rng.choice(known) + rng.choice(known))
            known += chr(conv.FIRST_RULE + i)
        assert conv.Grammar(rules).walk(seq, 0, None) == conv.Grammar([]).walk(seq, 0, None)
