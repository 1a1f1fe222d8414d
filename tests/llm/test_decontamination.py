"""Decontamination against plain search of every window."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from webaudit.llm import decontamination as dec

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def by_hand(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def tables(short):
    rng = random.Random(8)
    vocab = ["Éa", "über", "naïve", "x1", "Ö", "日本", "the", "of", "ﬁ", "A", "b", "\U00010400z"]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, line(rng.choice([12, 15, 30]))) for i in range(12)]
    items += [(20, items[0][1]), (None, items[1][1] + " tail"), (3, line(11)), (21, None), (22, "..!"),
              (23, items[2][1] + ", " + items[3][1]), (24, "a " * 14)]
    if short:
        items += [(30, "just four words here"), (31, "Seven words are in this one now"), (32, "unique1")]
    docs = [(i, line(60)) for i in range(40)]
    for i in range(40, 80):
        own = words(rng.choice(items)[1])
        at = rng.randrange(max(1, len(own) - 8))
        docs.append((i, f"{line(rng.randrange(9))} -- {' / '.join(own[at:at + rng.randrange(8, 16)])}! "
                     f"{line(4)} {items[i % 12][1].upper()} {line(3)}"))
    docs += [(90, None), (91, ""), (92, " ,.\n"), (93, "a A-a " * 9), (94, "one just FOUR words here unique1"),
             (95, (items[4][1] + " ") * 400 + "filler " * 60_000), (7, items[5][1]), (None, items[6][1]),
             (None, items[6][1])]
    return docs, items


@pytest.mark.parametrize("short", [False, True])
def test_equals_search_of_all_windows(spark, short):
    docs, items = tables(short)
    d = spark.createDataFrame([(i, t, "w", 1) for i, t in docs],
                              "doc_id long, text string, words string, print long")
    b = spark.createDataFrame([(i, t, "h") for i, t in items], "item_id long, text string, span string")
    df = dec.decontaminate(d, b)
    assert df.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got, want = [tuple(r) for r in df.collect()], by_hand(docs, items)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert 30 < sum(r[5] for r in want) < len(want)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInPandas" not in plan


def test_empty_tables_and_a_full_bitmap(spark, monkeypatch):
    docs, items = tables(True)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert dec.decontaminate(d.where("false"), b).count() == 0
    clean = dec.decontaminate(d, b.where("false")).collect()
    assert len(clean) == len(docs) and not any(r["n_hit"] or r["contaminated"] for r in clean)
    monkeypatch.setattr(dec, "MOST_BITS", 64)  # every window passes it
    got = [tuple(r) for r in dec.decontaminate(d, b).collect()]
    assert sorted(map(str, got)) == sorted(map(str, by_hand(docs, items)))
