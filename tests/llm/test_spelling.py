"""Spelling variants against plain enumeration."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webaudit.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(rows):
    total = Counter()
    for doc_id, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= 5 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words.get(form[w]), root)
    return out


def some_texts():
    rng = random.Random(4)
    stems = ["answer", "answers", "internationalisation", "éclairs", "banana", "ananas", "zzzzzz",
             "zzzzzzz", "aaaaaaaa", "straße", "question", "Ünderwear", "pro×duct"]
    words = list(stems)
    for _ in range(400):
        w = list(rng.choice(words))
        at = rng.randrange(len(w))
        kind = rng.randrange(3)
        w[at:at + (kind > 0)] = [rng.choice("abnéz")] if kind < 2 else []
        words.append("".join(w))
    weights = [5 ** rng.randrange(5) for _ in words]
    texts = [" ".join(rng.choices(words, weights, k=120)) for _ in range(120)]
    texts += [None, "", "123 !", "word " * 30_000, "Answer-answer_ANSWER\n" * 9, texts[0]]
    return [*((i, t) for i, t in enumerate(texts)), (3, texts[3]), (None, texts[1])]


@pytest.mark.parametrize("dictionary", [4, 1 << 15])
def test_variants_equal_enumeration(spark, monkeypatch, dictionary):
    monkeypatch.setattr(spelling, "DICTIONARY", dictionary)
    rows = some_texts()
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows],
                                 "doc_id long, text string, word string, n int")
    df = spelling.spelling_variants(docs)
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    got = df.collect()
    want = by_hand(rows)
    assert len(want) > 100 and any(v[4] not in (w, v[2]) for w, v in want.items())
    assert len(got) == len(want)
    assert {r["word"]: tuple(r)[1:] for r in got} == want
    assert spelling.spelling_variants(docs.where("false")).count() == 0


LETTERS = st.sampled_from("abé")
WORDS = st.text(LETTERS, min_size=6, max_size=26)


@settings(max_examples=1500, deadline=None)
@given(WORDS, st.data())
def test_near_words_share_a_key(word, data):
    at = data.draw(st.integers(0, len(word)))
    kind = data.draw(st.sampled_from(["insert", "delete", "replace"]))
    letter = data.draw(LETTERS)
    other = word[:at] + ("" if kind == "delete" else letter) + word[at + (kind != "insert"):]
    both = spelling.FIRST + word + spelling.LAST, spelling.FIRST + other + spelling.LAST
    parts = sorted({w[i:j] for w in both for i in range(len(w)) for j in range(i + 2, len(w) + 1)
                    if j - i < spelling.LONGEST})
    known: dict[str, int] = {}
    for gram in sorted(parts, key=len):  # any tree of grams may be frequent
        if (len(gram) == 2 or gram[:-1] in known) and data.draw(st.booleans()):
            known[gram] = 30 + len(known)
    for w in (word, other):
        if len(w) < 6:
            return
        found = spelling.decompose(w, spelling.longest_gram(len(w)), known)
        assert len(found.kept) > found.affected  # the bound always leaves a gram
    q = spelling.longest_gram(min(len(word), len(other)))
    assert set(spelling.entries(word, q, known)) & set(spelling.entries(other, q, known))
