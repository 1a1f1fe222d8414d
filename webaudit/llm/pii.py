"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_columns

# Kinds and patterns of the base (fixed values). Runs are matched possessively, which changes no
# match: what follows a run can never be part of it.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Tokens that might be personal data though no pattern takes them. Numbers are of one group, or of
# groups with a space between, as in "(017) 555-5036".
GROUP = re.compile(r"(?<![A-Za-z0-9.@/-])\+?\(?[0-9](?:[0-9().-]*[0-9])?\)?(?![A-Za-z0-9@/-])")
LEAST_DIGITS = 6   # of a number in several groups, and of one that is the end of another
AT = re.compile(r"@|\x20{0,2}(?:\(at\)|\[at\]|\{at\})\x20{0,2}", re.IGNORECASE)
DOT = re.compile(r"\x20{0,2}(?:\(dot\)|\[dot\]|\{dot\})\x20{0,2}", re.IGNORECASE)
HOST = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{DOT.pattern})[A-Za-z0-9-]++)*+", re.IGNORECASE)

LABELS = ("none", *KINDS)
NOISE = 0.2        # share of the "none" labels of the weakly labelled tokens that may be wrong
STRONGEST = 5.0    # bound of a learned potential
ROUNDS, DAMPING = 12, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern. Only at an @ can one be, with the whole run of
    local characters before it, so the time does not grow with runs that have none."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, sorted."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for kind, pattern, least, most in ((2, CARD, 12, 19), (3, PHONE, 9, 15)):
            if kind == 3 and "+" not in text:
                continue
            for m in pattern.finditer(text):
                digits = "".join(DIGIT.findall(m[0]))
                if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                    spans.append((m.start(), kind, m.end()))
    return sorted(spans)


def _key(token: str) -> str:
    """Repeated or similar tokens have equal keys: the last nine digits of a number, its whole if
    it has three dots; an address without its disguise."""
    low = AT.sub("@", token.lower())
    if "@" in low:
        return "a" + DOT.sub(".", low)
    if low.count(".") == 3 and "+" not in low:
        return "d" + low
    return "n" + "".join(DIGIT.findall(low))[-9:]


def _code(token: str) -> int:
    """Features of a token, packed: digits (four classes), +, @, three dots, a separator, and
    whether a number of a card's length has a right check digit."""
    digits = "".join(DIGIT.findall(token))
    n = len(digits)
    return (0 if n < 9 else 1 if n < 12 else 2 if n < 20 else 3) | ("+" in token) << 2 | (
        bool(AT.search(token))) << 3 | (token.count(".") == 3) << 4 | bool(
        re.search("[ ()-]", token)) << 5 | (12 <= n <= 19 and luhn(digits)) << 6


CODES = 128


def _digits(token: str) -> str:
    return "".join(DIGIT.findall(token))


def _numbers(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Numbers outside the base spans. Of groups in a row, those that make up the end of a base
    number are one, a long group is one, and what lies between is one if it may be a number."""
    known = {d[i:] for a, k, b in base if k >= 2 for d in [_digits(text[a:b])]
             for i in range(len(d) - LEAST_DIGITS + 1)}
    spans = sorted((a, b) for a, _, b in base)
    runs: list[list[tuple[int, int, str]]] = []
    at = end = 0
    for m in GROUP.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            end = max(end, spans[at][1])
            at += 1
        if a < end:
            continue
        group = (a, b, _digits(m[0]))
        if runs and text[runs[-1][-1][1]:a] == " " and m[0][0] != "+":
            runs[-1].append(group)
        else:
            runs.append([group])

    def trimmed(groups: list[tuple[int, int, str]]) -> tuple[int, int]:
        a, b = groups[0][0], groups[-1][1]
        b -= text[b - 1] == ")"
        return a + (text[a] == "(" and ")" not in text[a:b]), b

    def rest(groups: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
        if len(groups) > 1 and LEAST_DIGITS <= sum(len(d) for _, _, d in groups) < 20:
            yield trimmed(groups)
        else:
            for g in groups:
                a, b = trimmed([g])
                if b - a >= 6:
                    yield a, b

    for run in runs:
        i = start = 0
        while i < len(run):
            digits, found = "", 0
            for j in range(i, len(run)):
                digits += run[j][2]
                if len(digits) > 21:
                    break
                if digits in known or digits.lstrip("0") in known:
                    found = j + 1
            if not found and len(run[i][2]) >= 9:
                found = i + 1
            if found:
                yield from rest(run[start:i])
                yield trimmed(run[i:found])
                i = start = found
            else:
                i += 1
        yield from rest(run[start:])


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """``(start, end, label, key)`` of base spans (label: kind + 1) and other tokens (0), in order.

    A number of fewer than nine digits has the key of a longer one that ends with it, if there is one.
    """
    nodes = [(a, b, k + 1) for a, k, b in base]
    taken = [(a, b) for a, _, b in base]
    other: list[tuple[int, int]] = []
    if DIGIT.search(text):
        other += _numbers(text, base)
    for m in AT.finditer(text):
        start = m.start()
        while start > 0 and LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start() and (host := HOST.match(text, m.end())):
            other.append((start, host.end()))
    at, last = 0, 0
    for a, b in sorted(other):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= last and not (at < len(taken) and taken[at][0] < b):
            nodes.append((a, b, 0))
            last = b
    keyed = [(a, b, k, _key(text[a:b])) for a, b, k in sorted(nodes)]
    ends = {key[-n:]: key for _, _, _, key in keyed if key[0] == "n" and len(key) > 9
            for n in range(LEAST_DIGITS, 9)}
    return [(a, b, k, ends.get(key[1:], key) if key[0] == "n" else key) for a, b, k, key in keyed]


def links(nodes: list[tuple[int, int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours and skip edges from each token to the next of its key."""
    last: dict[str, int] = {}
    skip = []
    for i, (_, _, _, key) in enumerate(nodes):
        if key in last and last[key] != i - 1:
            skip.append((last[key], i))
        elif key in last:
            skip.append((i - 1, i))
        last[key] = i
    near = set(skip)
    return [(i, i + 1) for i in range(len(nodes) - 1) if (i, i + 1) not in near], skip


@dataclass(frozen=True)
class Field:
    unary: np.ndarray  # CODES x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray   # labels x labels


def learn(docs: DataFrame) -> Field:
    """Potentials from counts over all documents; base spans label their tokens.

    Unary: log-probabilities of the labels by features, smoothed, with a share of the "none"
    labels taken as unknown. Chain and skip: log-ratio of joint to independent frequency,
    where for skip edges only pairs that the base labels both count (it cannot see the others).
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                if not text or not (nodes := tokens(text, base_spans(text))):
                    continue
                seen.update((0, _code(text[a:b]), k) for a, b, k, _ in nodes)
                chain, skip = links(nodes)
                seen.update((1, nodes[i][2], nodes[j][2]) for i, j in chain)
                seen.update((2, nodes[i][2], nodes[j][2]) for i, j in skip
                            if nodes[i][2] and nodes[j][2])
        rows = [(*k, n) for k, n in seen.items()]
        yield pd.DataFrame(rows, columns=["part", "a", "b", "n"]).astype(
            {"part": "int32", "a": "int32", "b": "int32", "n": "int64"})

    sums = docs.select("text").mapInPandas(count, "part int, a int, b int, n long").groupBy(
        "part", "a", "b").agg(F.sum("n").alias("n")).collect()  # a few hundred rows at most
    size = len(LABELS)
    unary, pair = np.zeros((CODES, size)), [np.zeros((size, size)) for _ in range(2)]
    for r in sums:
        if r["part"] == 0:
            unary[r["a"], r["b"]] += r["n"]
        else:
            pair[r["part"] - 1][r["a"], r["b"]] += r["n"]
            pair[r["part"] - 1][r["b"], r["a"]] += r["n"]
    unary += 0.5
    spread = NOISE * unary[:, :1] * np.ones(size) / size
    unary[:, 0] *= 1 - NOISE
    unary = np.log((unary + spread) / (unary + spread).sum(1, keepdims=True))

    def ratio(n: np.ndarray, prior: np.ndarray) -> np.ndarray:
        joint = (n + prior) / (n + prior).sum()
        return np.clip(np.log(joint / np.outer(joint.sum(1), joint.sum(0))), -STRONGEST, STRONGEST)

    return Field(np.maximum(unary, -STRONGEST), ratio(pair[0], np.full((size, size), 1.0)),
                 ratio(pair[1], np.eye(size) * 5 + 0.1))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def marginals(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Loopy sum-product, all messages at once with damping. Time and memory grow with the edges."""
    if len(edges):
        source, target = np.concatenate([edges, edges[:, ::-1]]).T
        potential = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
        n = len(edges)
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        message = np.zeros((2 * n, unary.shape[1]))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, message)
            out = _logsum((belief[source] - message[back])[:, :, None] + potential, 1)
            out -= _logsum(out, 1)[:, None]
            message = DAMPING * message + (1 - DAMPING) * out
        unary = unary.copy()
        np.add.at(unary, target, message)
    return np.exp(unary - _logsum(unary, 1)[:, None])


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Tokens that the field gives a kind with a marginal above one half."""
    nodes = tokens(text, base)
    if all(k for _, _, k, _ in nodes):
        return []
    unary = np.stack([field.unary[_code(text[a:b])] if not k
                      else np.where(np.arange(len(LABELS)) == k, 0.0, -50.0)
                      for a, b, k, _ in nodes])
    chain, skip = links(nodes)
    edges = np.array([*chain, *skip], np.int64).reshape(-1, 2)
    potentials = np.concatenate([np.broadcast_to(p, (n, *p.shape)) for p, n in (
        (field.chain, len(chain)), (field.skip, len(skip)))])
    p = marginals(unary, edges, potentials)
    return [(a, int(p[i].argmax()) - 1, b) for i, (a, b, k, _) in enumerate(nodes)
            if not k and p[i].argmax() and p[i].max() > 0.5]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts by kind, ``base_sha256`` and ``spans`` (base and added), per row.

    Offsets are code points, the end is exclusive. NULL and empty texts have no span. Very long
    texts are read whole; work grows with their tokens. doc_id may be NULL or repeat; other
    columns take no part.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    field = docs.sparkSession.sparkContext.broadcast(learn(docs))
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                text = text or ""
                base = base_spans(text)
                by_kind = Counter(k for _, k, _ in base)
                rows.append((doc_id, *(by_kind[k] for k in range(len(KINDS))),
                             hashlib.sha256(_joined(base).encode()).hexdigest(),
                             _joined(base + added_spans(text, base, field.value))))
            yield pd.DataFrame(rows, columns=names)

    return docs.mapInPandas(find, "doc_id string, " + ", ".join(f"n_{k} long" for k in KINDS)
                            + ", base_sha256 string, spans string").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal_data(text_columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
