"""Benchmark decontamination by winnowing, in DataFrame functions throughout."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lets import explode_rows
from .common import cut_lineage, table, text_columns

WINDOW = 10              # words of a window; an item of fewer words is one window
GRAM = 5                 # words of the grams whose hashes are winnowed
BITS_PER_PRINT = 64      # of the bitmap of test fingerprints
MOST_BITS = 1 << 23      # size of the bitmap, whatever the benchmark's: 1 MB
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what words are cut at, once A-Z are lowered
# Texts without these are lowered alike by lower() and by lowering A-Z alone.
OTHER_CASES = r"[^\x00-¿ß-ÿ]"


def words_of(text: Column) -> Column:
    """The words of a text in order; NULL has none."""
    lowered = F.when(text.rlike(OTHER_CASES), F.translate(
        text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATORS), ""),
                      F.array().cast("array<string>"))


def _starts(items: str, width: int) -> Column:
    """Where ``width`` neighbours of an array begin: none in a shorter array."""
    n = F.size(items)
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(
        F.array().cast("array<int>"))


def with_prints(rows: DataFrame, span: int) -> DataFrame:
    """``rows`` with ``m<span>``: the fingerprint of each window of ``span`` of its ``words``.

    A window's fingerprint is the least hash of its grams. Equal windows have equal
    fingerprints wherever they stand, so no shared window is missed; and neighbours mostly
    have the same one.
    """
    gram = min(GRAM, span)
    hashed = rows if "h" in rows.columns else rows.withColumn(
        "h", F.transform("words", lambda w: F.xxhash64(w)))
    grams = hashed.withColumn("g", F.transform(_starts("h", gram), lambda i: F.xxhash64(
        F.lit(gram), *[F.get("h", i + k) for k in range(gram)])))
    width = span - gram + 1
    least = F.col("g") if width == 1 else F.transform(_starts("g", width), lambda i: F.least(
        *[F.get("g", i + k) for k in range(width)]))
    return grams.withColumn(f"m{span}", least).drop("g")


def windows(span: int, at: Column) -> Column:
    """The words of a window; words hold no spaces."""
    return F.array_join(F.slice("words", at + 1, span), " ")


def test_windows(items: DataFrame) -> DataFrame:
    """``span, print, window, item`` of every window of every item, each once."""
    made = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                        words_of(F.col("text")).alias("words"))
    made = made.withColumn("span", F.least(F.lit(WINDOW), F.size("words"))).where("span > 0")
    made = cut_lineage(made, "test-items")
    out = None
    for span in spans_of(made):
        part = with_prints(made.where(F.col("span") == span), span).select(
            "item", F.transform(f"m{span}", lambda m, i: F.struct(
                m.alias("print"), windows(span, i).alias("window"))).alias("found"))
        rows = explode_rows(part, "found", "f", "item").select(
            F.lit(span).alias("span"), "f.print", "f.window", "item")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return made.select("span", F.lit(0).cast("long").alias("print"),
                           F.lit("").alias("window"), "item")
    return cut_lineage(out.distinct(), "test-windows")


def spans_of(rows: DataFrame) -> list[int]:
    """The window lengths that occur: at most ``WINDOW`` numbers."""
    return sorted(r["span"] for r in rows.select("span").distinct().collect())


def _words_of_map(bits: int) -> int:
    return max(1, bits // 64)


def bitmap(prints: DataFrame) -> tuple[Column, int]:
    """A bitmap of fingerprints as a constant array of longs, and its number of bits.

    It has ``BITS_PER_PRINT`` bits for each fingerprint up to ``MOST_BITS``: a larger benchmark makes
    it let more windows pass, which the join behind it drops. It never holds one back.
    """
    one = prints.select("print").distinct()
    n = one.count()
    bits = 64
    while bits < min(n * BITS_PER_PRINT, MOST_BITS):
        bits *= 2
    # Two positions a fingerprint, of different bits of it.
    slots = one.select(F.explode(F.array(*_slots(F.col("print"), bits))).alias("slot"))
    rows = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))).alias("b")
    ).collect()
    found = {r["at"]: r["b"] for r in rows}
    text = ",".join(str(found.get(i, 0)) for i in range(_words_of_map(bits)))
    return F.split(F.lit(text), ",").cast("array<bigint>"), bits


def _slots(value: Column, bits: int) -> tuple[Column, Column]:
    mask = F.lit(bits - 1).cast("long")
    return value.bitwiseAND(mask), F.shiftrightunsigned(value, 32).bitwiseAND(mask)


def _inside(bit_map: Column, bits: int, value: Column) -> Column:
    def has(slot: Column) -> Column:
        word = F.get(bit_map, F.shiftright(slot, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, slot.bitwiseAND(63).cast("int")
                               ).bitwiseAND(F.lit(1).cast("long")) == 1
    first, second = _slots(value, bits)
    return has(first) & has(second)


def shared_windows(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """``doc_id, key, n_words, found``: each document's windows whose fingerprint may be a test's.

    One scan. ``key`` is the text's digest: rows of equal text share what follows. ``found`` holds
    ``at, span, print, window`` of the windows that the bitmap of test fingerprints lets pass.
    """
    rows = docs.select("doc_id", F.md5("text").alias("key"), words_of(F.col("text")).alias("words"))
    none = F.array().cast("array<struct<at:int,span:int,print:bigint,window:string>>")
    parts = [none]
    for span in spans_of(tests):
        rows = with_prints(rows, span)
        parts.append(_passed(span, *bitmap(tests.where(F.col("span") == span))))
    return cut_lineage(rows.select(
        "doc_id", "key", F.size("words").cast("long").alias("n_words"),
        F.concat(*parts).alias("found")), "shared-windows")


def _passed(span: int, bit_map: Column, bits: int) -> Column:
    prints = f"m{span}"
    starts = F.filter(_starts(prints, 1), lambda i: _inside(bit_map, bits, F.get(prints, i)))
    return F.transform(starts, lambda i: F.struct(
        i.alias("at"), F.lit(span).alias("span"), F.get(prints, i).alias("print"),
        windows(span, i).alias("window")))


def covered(spans: Column) -> Column:
    """Words in any of the ``at, span`` structs of a sorted array."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(state: Column, s: Column) -> Column:
        end = s["at"] + s["span"]
        return F.struct(
            (state["n"] + F.greatest(F.lit(0), end - F.greatest(state["end"], s["at"]))).alias("n"),
            F.greatest(state["end"], end).alias("end"))

    return F.aggregate(spans, start, add, lambda s: s["n"])


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document.

    ``docs``: ``doc_id, text``; ``items``: ``item_id, text``. Windows of ten words of an item (all its
    words, if fewer) are hit wherever a document has them. Windows are found by their winnowed
    fingerprints and joined by fingerprint and words, so a hit is exact and extends over every
    window that holds it. Windows that occur in the same items are one class, so a passage that
    many items share meets them once.

    NULL and wordless texts have no words; such items have no windows. Repeated rows each have their
    row. Items of the same item_id are one item; a NULL item_id is an item whose id is
    written as nothing. Columns other than the named ones take no part. Without documents
    there are no rows, without items nothing is hit.
    """
    tests = test_windows(items)
    found = shared_windows(docs, tests)
    per_window = tests.groupBy("span", "print", "window").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("y"))
    same = cut_lineage(per_window, "window-classes")
    named = same.groupBy("n", "x", "y").agg(
        F.min(F.struct("span", "print", "window")).alias("w"))
    of_class = named.select("n", "x", "y", "w.*").join(tests, ["span", "print", "window"]).select(
        "n", "x", "y", "item")
    rows = explode_rows(found, "found", "f", "key").select(
        "key", "f.at", "f.span", "f.print", "f.window").dropDuplicates(["key", "at", "span"])
    hits = cut_lineage(rows.join(same, ["span", "print", "window"]).select(
        "key", "at", "span", "n", "x", "y"), "window-hits")
    # Both lists are of one text: its windows, and the items that it holds.
    words_hit = hits.groupBy("key").agg(
        covered(F.sort_array(F.collect_list(F.struct("at", "span")))).alias("n_hit"))
    texts = hits.select("key", "n", "x", "y").distinct().join(of_class, ["n", "x", "y"]).select(
        "key", "item").distinct().groupBy("key").agg(
        F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(
            F.collect_list("item")), ","), 256).alias("items_sha256"))
    per_text = words_hit.join(texts, "key")
    return found.select("doc_id", "key", "n_words").join(per_text, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows that it shares with ``benchmark``."""
    return decontaminate(text_columns(table(spark, sf_dir, "documents"), "doc_id", "text"),
                         text_columns(table(spark, sf_dir, "benchmark"), "item_id", "text"))


def _words_sql(text: str) -> str:
    lowered = f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"coalesce(regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql("text")} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words_sql("text")} AS w
      FROM benchmark),
t AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS span,
             array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS v
      FROM b, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
s AS (SELECT DISTINCT span FROM t),
windows AS (SELECT r, i, span, array_to_string(w[i:i + span - 1], ' ') AS v
            FROM d, s, unnest(range(1, len(w) - span + 2)) AS u(i)),
hits AS (SELECT r, i, t.span, item FROM windows JOIN t USING (span, v)),
n_hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, span)) AS u(k)
          GROUP BY r),
n_items AS (SELECT r, count(DISTINCT item) AS n_items,
                   sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256
            FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN n_items USING (r)
"""
