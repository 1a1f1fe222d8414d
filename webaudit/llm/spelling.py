"""Spelling variants: words one edit apart, by a variable-length gram index."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table, text_columns

LETTERS = "a-zÀ-ÿ"            # letters of a word after A-Z are lowered (fixed values)
LEAST_LENGTH, LEAST_COUNT = 6, 5
DAMAGE = 199                  # one in so many words of a document loses a letter
FORM_RATIO = 5                # a word's form is so many times as frequent
HELD_WORDS = 300_000          # distinct words a task counts before it hands them on
SHORTEST, LONGEST = 2, 8      # lengths of grams
DICTIONARY = 1 << 15          # at most so many frequent grams of each length
LEAST_LIST = 24               # a gram of no more positions than this is not extended
FIRST, LAST = "\x02", "\x03"  # the ends of a word, as letters of its grams


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over all documents, after the damage; words that are too short or too rare go.

    A run of letters whose crc32, with its document's id, ``DAMAGE`` divides loses one letter in
    that document. Counts are summed in each task before they are shuffled.
    """
    runs = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")  # shorter runs make no word

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array):
                if not isinstance(text, str):
                    continue
                text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                prefix = zlib.crc32(f"{doc_id if isinstance(doc_id, str) else ''}:".encode())
                for word, n in Counter(runs.findall(text)).items():
                    h = zlib.crc32(word.encode(), prefix)
                    if h % DAMAGE == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= LEAST_LENGTH:
                        total[word] += n
            if len(total) >= HELD_WORDS:
                yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                total = Counter()
        if total:
            yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, "word string, n long")
    return cut_lineage(counted.groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= LEAST_COUNT), "words")


def longest_gram(length: int) -> int:
    """Longest gram of words of a length, such that one edit never affects all grams of a word.

    A gram reads at most ``q`` letters, so an edit at letter ``i`` reaches grams that begin in
    ``i - q + 1 .. i + q - 2``. The first gram lies outside if ``i >= q``, the last if
    ``i <= length - 2 q + 3`` (with both ends as letters). Every ``i`` is one or the other if
    ``3 q <= length + 4``.
    """
    return min(LONGEST, (length + 4) // 3)


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """The dictionary's inner nodes: grams with so many positions in all words that they are
    extended by a letter, with their counts.

    A gram counts as frequent above ``positions / DICTIONARY``, so at most ``DICTIONARY`` grams of
    each length are, whatever the table. Grams are counted with their prefixes: those of
    length ``k + 1`` only behind frequent ones of length ``k``, which prunes the tree.
    """
    spelled = words.select(F.concat(F.lit(FIRST), "word", F.lit(LAST)).alias("w")).withColumn(
        "size", F.char_length("w"))
    positions = spelled.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cut = max(LEAST_LIST, positions // DICTIONARY)
    found: dict[str, int] = {}
    for length in range(SHORTEST, LONGEST):
        before = frozenset(g for g in found if len(g) == length - 1)
        shared = words.sparkSession.sparkContext.broadcast(before)

        def run(batches: Iterator[pd.DataFrame], length: int = length, shared=shared
                ) -> Iterator[pd.DataFrame]:
            counts, known = Counter(), shared.value
            for pdf in batches:
                for w in pdf["w"]:
                    q = longest_gram(len(w) - 2)
                    if length < q:
                        counts.update(w[p:p + length] for p in range(len(w) - length + 1)
                                      if not known or w[p:p + length - 1] in known)
                if len(counts) >= HELD_WORDS:
                    yield pd.DataFrame({"gram": list(counts), "n": list(counts.values())})
                    counts = Counter()
            if counts:
                yield pd.DataFrame({"gram": list(counts), "n": list(counts.values())})

        if length > SHORTEST and not before:
            break
        rows = spelled.select("w").mapInPandas(run, "gram string, n long").groupBy("gram").agg(
            F.sum("n").alias("n")).where(F.col("n") > cut).collect()
        found |= {r["gram"]: r["n"] for r in rows}
    return found


class Grams(NamedTuple):
    """``start, gram`` of a word's variable-length grams, and how many of them one edit affects."""

    kept: list[tuple[int, str]]
    affected: int


def decompose(word: str, q: int, frequent: dict[str, int]) -> Grams:
    """Grams of a word with its ends, none longer than ``q``, none inside another.

    At each start the gram is the shortest one that is not frequent, or as long as may be; its
    own letters decide that. So an edit affects a gram if it lies in the gram, or in an
    earlier one that may come to cover it, or if an inserted letter may begin a gram that does.
    """
    w = FIRST + word + LAST
    size = len(w)
    ends, reach, kept = [], 0, []
    for p in range(size - SHORTEST + 1):
        end = p + SHORTEST
        while end < size and end - p < q and w[p:end] in frequent:
            end += 1
        ends.append(end)
        if end > reach:
            kept.append(p)
            reach = end
    changed, inserted = [0] * size, [0] * size  # letter changed or removed; one put before it
    for p in kept:
        spare = q - (ends[p] - p)
        near = range(max(0, p - spare), p + 1)  # starts of grams that may cover it
        reach = max(ends[s] for s in near)
        for i in range(near[0], reach):
            changed[i] += any(s <= i < ends[s] for s in near)
            inserted[i] += (any(s < i < ends[s] for s in near) or p + 1 - spare <= i <= p)
    # The ends of the word are not letters that an edit can touch.
    return Grams([(p, w[p:ends[p]]) for p in kept], max(*changed[1:-1], *inserted[1:]))


def entries(word: str, q: int, frequent: dict[str, int]) -> list[tuple]:
    """Index keys of a word, of which any word one edit away has one in common.

    Of a word's grams all but ``affected`` remain, so the ``affected + 1`` first ones, by any
    order that both words share, have one in common: rare grams first, then by their count. A
    gram before the edit keeps its distance from the front, one behind it that from the back;
    both are keys.
    """
    kept, affected = decompose(word, q, frequent)
    order = sorted(kept, key=lambda x: (frequent.get(x[1], 0), x[1]))
    if len(order) <= affected:
        raise ValueError(f"no bound for {word!r}")  # longest_gram() rules it out
    last = order[affected][1]
    chosen = order[:affected + 1] + [x for x in order[affected + 1:] if x[1] == last]
    return [key for p, gram in chosen
            for key in ((q, 0, p, gram), (q, 1, len(word) - p - len(gram), gram))]


def _key(key: tuple) -> int:
    return xxhash.xxh3_64_intdigest(repr(key).encode()) - (1 << 63)


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: all pairs of words that differ by exactly one letter, once each.

    Words meet where they share an index key; there their distance decides. Lists are kept short
    by the dictionary: a gram with more positions than its threshold is extended by a letter, up
    to what the word's length allows.
    """
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = frequent.value
        for pdf in batches:
            keys, grams, at = [], [], []
            for i, word in enumerate(pdf["word"]):
                # Pairs use the gram length of the shorter word, which may be one letter shorter.
                for q in {longest_gram(len(word)), longest_gram(max(len(word) - 1, LEAST_LENGTH))}:
                    found = [_key(k) for k in entries(word, q, known)]
                    keys += found
                    grams += [q] * len(found)
                    at += [i] * len(found)
            rows = pdf.iloc[at]
            yield pd.DataFrame({"sig": keys, "q": grams, "word": rows["word"].array,
                                "n": rows["n"].array})

    index = cut_lineage(
        words.mapInPandas(run, "sig long, q int, word string, n long").withColumn(
            "size", F.char_length("word").cast("int")), "word-grams")
    x, y = index.alias("x"), index.alias("y")
    shorter = F.least(F.col("x.size"), F.col("y.size"))
    meant = F.least(F.lit(LONGEST), F.floor((shorter + 4) / 3)).cast("int")
    met = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.word") < F.col("y.word"))
                 & (F.abs(F.col("x.size") - F.col("y.size")) <= 1) & (meant == F.col("x.q"))
                 & (F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1))
    return met.select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"),
                      F.col("y.word").alias("b"), F.col("y.n").alias("b_n")).distinct()


def roots(forms: DataFrame, most: int) -> DataFrame:
    """``word, root`` for ``word, form``, by doubling the steps.

    Each step multiplies the count by ``FORM_RATIO`` at least, so ``most``, the largest count,
    bounds the length of a chain.
    """
    steps = max(1, math.ceil(math.log(max(most, LEAST_COUNT) / LEAST_COUNT, FORM_RATIO)) + 1)
    now = cut_lineage(forms.select("word", F.col("form").alias("root")), "word-roots")
    for _ in range(math.ceil(math.log2(steps))):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut_lineage(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")), "word-roots")
    return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``doc_id, text``.

    Words: maximal runs of Latin letters of whole texts, A-Z lowered, after the damage that
    ``count_words`` states, of at least 6 code points and 5 occurrences. Rows are counted as
    they are: repeated rows count each time, and documents of equal text are damaged by
    their own ids; a NULL doc_id is written as nothing. NULL, empty and letterless texts have no
    words. Among near words of the same count the smallest in code-point order is the form.
    Columns other than doc_id and text take no part. An empty table gives no rows.
    """
    words = count_words(docs)
    pairs = cut_lineage(near_pairs(words), "word-pairs")
    both = pairs.unionByName(pairs.select(
        F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"),
        F.col("a_n").alias("b_n")))
    # Near words are few (one edit away), and counts and minima combine before the shuffle.
    near = both.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min("a_n").alias("own"),
        F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("top"))
    formed = F.col("own") * FORM_RATIO <= -F.col("top.less")
    near = cut_lineage(near.select(
        "word", "n_near", F.when(formed, F.col("top.b")).alias("form"),
        F.when(formed, -F.col("top.less")).alias("form_n")), "word-near")
    most = words.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    root = roots(near.where("form IS NOT NULL"), most)
    return (words.join(near, "word", "left").join(root, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n",
        F.coalesce("root", "word").alias("root")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of ``documents``."""
    return spelling_variants(text_columns(table(spark, sf_dir, "documents"), "doc_id", "text"))


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of an expression of code points up to U+00FF."""
    entries_of = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        entries_of.append(str(byte))
    table_of = f"[{', '.join(entries_of)}]::BIGINT[]"
    points = f"list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT)"
    as_bytes = (f"flatten(list_transform({points}, lambda x: CASE WHEN x < 128 THEN [x] "
                "ELSE [192 + (x >> 6), 128 + (x & 63)] END))")
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {as_bytes}), "
            f"lambda c, b: xor(c >> 8, ({table_of})[(xor(c, b) & 255) + 1])))")


# Near words by what remains when each letter is left out, and by inner letters replaced.
SQL = f"""
WITH runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text,
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents WHERE text IS NOT NULL),
counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h
  FROM counted),
words AS (
  SELECT CASE WHEN h % 199 = 0
              THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
              ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1),
kept AS (SELECT * FROM words WHERE length(word) >= 6 AND n >= 5),
less AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM kept, unnest(range(1, length(word) + 1)) AS t(i)),
pairs AS (
  SELECT x.word AS a, y.word AS b, y.n AS b_n FROM less x JOIN less y
    ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM less x JOIN kept y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM less x JOIN kept y ON x.rest = y.word),
ranked AS (
  SELECT a, b, b_n, count(*) OVER (PARTITION BY a) AS n_near,
         row_number() OVER (PARTITION BY a ORDER BY b_n DESC, b) AS r FROM pairs),
near AS (
  SELECT k.word, k.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.b_n >= 5 * k.n THEN r.b END AS form,
         CASE WHEN r.b_n >= 5 * k.n THEN r.b_n END AS form_n
  FROM kept k LEFT JOIN ranked r ON r.a = k.word AND r.r = 1),
chain AS (
  WITH RECURSIVE c(word, here) AS (
    SELECT word, word FROM near
    UNION ALL SELECT c.word, n.form FROM c JOIN near n ON n.word = c.here WHERE n.form IS NOT NULL)
  SELECT c.word, c.here AS root FROM c JOIN near n ON n.word = c.here WHERE n.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM near JOIN chain USING (word)
"""
