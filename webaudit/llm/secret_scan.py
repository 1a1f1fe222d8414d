"""Secret scans: wide candidate patterns, and a random forest that removes false positives."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table, text_columns

# Where a value of a secret's name begins: token=, api_key: , "password": , secretKey = .
ASSIGNED = (r"""(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth(?!or))"""
            r"""(?:[A-Z0-9_-][A-Za-z0-9_-]{0,32})?["']?[\x20\t]{0,2}[=:][\x20\t]{0,2}""")
# A candidate: the password of user:password@ in a URL; a value assigned to a secret's name; a
# quoted value assigned to any name; a long token, with its parts joined by dots. Every loop
# without bound is of one character class, which the JVM matches without recursion.
CANDIDATE = (r"""(?<=:)(?<=://[^\s/:@]{0,255}:)[^\s/]+(?=@)"""
             rf"""|(?<=[=:][\x20\t]{{0,2}})(?<={ASSIGNED})[^\s"'&]+(?:&(?![\w-]{{1,64}}=)[^\s"'&]*){{0,64}}"""
             r"""(?<=[^,;.)}\]>])(?<=\S{4})"""
             rf"""|(?<=")(?<={ASSIGNED}")[^"\r\n]{{4,}}(?=")"""
             rf"""|(?<=')(?<={ASSIGNED}')[^'\r\n]{{4,}}(?=')"""
             r"""|(?<=[=:][\x20]{0,2}["'])[^"'\s]{8,}(?=["'])"""
             r"""|(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-][A-Za-z0-9_+/.-]{14,}[A-Za-z0-9_+/-]"""
             r"""(?:={1,2}(?![A-Za-z0-9_+/"'=-]))?""")
OPEN, CLOSE = "\x01", "\x02"  # marks; in the text they become spaces first

# Names secrets are assigned to, and shapes that never are secrets (fixed values).
SECRET_NAME = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)"
KNOWN_NUMBER = r"^[0-9][0-9_./=-]*$"

CONTEXT = 48              # characters read on either side for neighbouring words and paths
SAMPLE_FINDINGS = 5000    # labelled findings the forest is fitted on
DICTIONARY_WORDS = 2000
TREES, DEPTH, SEED = 20, 6, 7
FEATURES = ["length", "switches", "switch_rate", "digit_share", "letter_kinds", "distinct_share",
            "covered", "in_path", "assigned", "quoted", "named", "known_before",
            "mixed_run", "login", "is_name"]
CONTEXT_FEATURES = ["in_path", "assigned", "quoted", "named", "known_before", "login"]
MIXED_RUN, MIXED_RATE = 16, 0.5  # a run of letters and digits, or of changing case, that may be random


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, nth, start, value, before, after``: every candidate of the whole texts.

    ``start`` counts code points from 0. One regular expression marks all candidates; the marked
    text is cut at the marks.
    """
    clean = F.translate(F.coalesce(F.col("text"), F.lit("")), OPEN + CLOSE, "  ")
    marked = F.regexp_replace(clean, f"({CANDIDATE})", f"{OPEN}$1{CLOSE}")
    # Rows without a mark end here, before anything is exploded.
    found = docs.select("doc_id", marked.alias("marked")).where(F.instr("marked", OPEN) > 0)
    cut = found.select("doc_id", "marked", F.posexplode(F.split("marked", OPEN)).alias("nth", "piece"))
    head = F.call_function("substring_index", F.col("marked"), F.lit(OPEN), F.col("nth"))
    return cut.where("nth > 0").select(
        "doc_id", F.col("nth").cast("int"),
        (F.char_length(head) - 2 * (F.col("nth") - 1)).cast("long").alias("start"),
        F.substring_index("piece", CLOSE, 1).alias("value"),
        F.translate(F.right(head, F.lit(CONTEXT)), OPEN + CLOSE, "").alias("before"),
        F.left(F.substring_index("piece", CLOSE, -1), F.lit(CONTEXT)).alias("after"))


def dictionary(docs: DataFrame) -> list[str]:
    """The ``DICTIONARY_WORDS`` letter runs (four letters or more) most frequent in all documents.

    Counts combine before the shuffle, so a frequent word costs a row per task; ties go by word.
    How many words have each number of binary digits in their count tells which can be
    among the first, so that tasks do not each send their own first words.
    """
    words = docs.select(F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(r"(\p{L}{4,24})"), F.lit(1))).alias("word"))
    counts = cut_lineage(words.groupBy("word").count(), "secret-words")
    floor, found = 1, 0
    for row in (counts.groupBy(F.length(F.bin("count")).alias("digits"))
                .agg(F.count("*").alias("n")).orderBy(F.desc("digits")).collect()):  # 63 rows at most
        floor, found = 1 << (row["digits"] - 1), found + row["n"]
        if found >= DICTIONARY_WORDS:
            break
    rows = counts.where(F.col("count") >= floor).orderBy(F.desc("count"), "word").limit(
        DICTIONARY_WORDS)
    return [r["word"] for r in rows.collect()]


def _share(pattern: str, value: Column) -> Column:
    return 1 - F.char_length(F.regexp_replace(value, pattern, "")) / F.greatest(
        F.char_length(value), F.lit(1))


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """The forest's inputs: length, character transitions, dictionary coverage, path, neighbours."""
    value = F.col("value")
    kinds = reduce(lambda v, r: F.regexp_replace(v, *r), (
        ("[^A-Za-z0-9]", "-"), ("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0")), value)
    runs = F.char_length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    length = F.greatest(F.char_length(value), F.lit(1))
    letters = F.regexp_extract_all(F.lower(value), F.lit("([a-z]{4,})"), F.lit(1))
    known = F.filter(letters, lambda w: F.array_contains(F.lit(words), w)) if words else F.array()
    covered = F.char_length(F.array_join(known, "")) / length
    before = F.lower(F.col("before"))
    runs_mixed = F.filter(F.regexp_extract_all(value, F.lit("([A-Za-z0-9_+-]{2,})"), F.lit(1)),
                          lambda r: r.rlike("[0-9]") & r.rlike("[A-Za-z]"))
    neighbour = F.regexp_extract(before, r"(\p{L}{2,})\P{L}*$", 1)
    n = {
        "length": F.char_length(value), "switches": runs - 1, "switch_rate": (runs - 1) / length,
        "digit_share": _share("[0-9]", value),
        "letter_kinds": reduce(lambda a, b: a + b, (
            value.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))),
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / length,
        "covered": covered,
        "in_path": (F.col("before").rlike(r"[/?&.@][^\s]*$")
                    | F.col("after").rlike(r"^[/@.][A-Za-z]")).cast("int"),
        "assigned": F.col("before").rlike(r"""[=:]\s{0,2}["']?$""").cast("int"),
        "quoted": F.col("after").rlike(r"""^["']""").cast("int"),
        "named": F.regexp_extract(F.col("before"), r"""([\w-]+)["']?\s{0,2}[=:]\s{0,2}["']?$""", 1)
        .rlike(SECRET_NAME).cast("int"),
        "known_before": (F.array_contains(F.lit(words), neighbour) if words
                         else F.lit(False)).cast("int"),
        "mixed_run": F.coalesce(F.array_max(F.transform(runs_mixed, F.char_length)), F.lit(0)),
        "login": (F.col("before").rlike(r"//[^\s/:@]*:$") & F.col("after").rlike("^@")).cast("int"),
        "is_name": F.col("after").rlike(r"""^["']?\s{0,2}[=:]""").cast("int"),
    }
    return found.select("*", *[n[c].cast("double").alias(c) for c in FEATURES])


def weak_labels(found: DataFrame) -> DataFrame:
    """Findings labelled by rule, where no labelled ones are given: 1 for the password of a URL and
    for a long mixed value that is assigned to a secret's name, 0 for plain numbers, names that
    are assigned to, and paths and values without a name whose own characters look like words.

    Other values without a name may be secrets and stay unlabelled. Each value labelled 1 for its
    name is also given bare, so that the forest learns its shape besides its neighbours.
    """
    secret = ((F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("length") >= 16)
              & (F.col("letter_kinds") >= 2) & (F.col("is_name") == 0))
    random = (F.col("mixed_run") >= MIXED_RUN) | (
        (F.col("switch_rate") >= MIXED_RATE) & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]"))
    other = (F.col("value").rlike(KNOWN_NUMBER) | (F.col("is_name") == 1)
             | ((F.col("in_path") == 1) | (F.col("assigned") == 0)) & ~random)
    label = F.when((F.col("login") == 1) | secret, 1.0).when(other & (F.col("named") == 0), 0.0)
    labelled = found.withColumn("label", label).where(F.col("label").isNotNull())
    bare = labelled.where(secret & random).withColumns({c: F.lit(0.0) for c in CONTEXT_FEATURES})
    return labelled.unionByName(bare)


def train(labelled: DataFrame, rows: int = SAMPLE_FINDINGS) -> RandomForestClassificationModel | None:
    """Fit on at most ``rows`` labelled findings, those of smallest hash for each label.

    Equal findings count once. None if a label is missing.
    """
    order = F.xxhash64("value", "before")
    halves = [labelled.where(F.col("label") == k).select(*FEATURES, "label", order.alias("h"))
              .distinct().orderBy("h", *FEATURES).limit(rows // 2) for k in (0.0, 1.0)]
    sample = cut_lineage(halves[0].unionByName(halves[1]).coalesce(1).sortWithinPartitions(
        "h", *FEATURES).drop("h"), "secret-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt",
        cacheNodeIds=False)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
                      .select("features", "label"))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, nth, start, end, value, score, is_secret`` of every candidate in every text.

    ``labelled``: findings with ``value, before, after, label``; without them, ``weak_labels`` of
    the candidates. The forest's score decides at one half. If it cannot be fitted (one label
    only), candidates assigned to a secret's name are the secrets.

    NULL and empty texts have no candidates; very long ones are scanned whole. Repeated rows
    yield their findings each; doc_id may be NULL. Other columns take no part.
    """
    docs = text_columns(docs, "doc_id", "text")
    words = dictionary(docs)
    found = cut_lineage(features(candidates(docs), words), "secret-candidates")
    given = weak_labels(found) if labelled is None else features(labelled, words)
    model = train(given)
    if model is None:
        judged = found.withColumn("score", F.col("named").cast("double"))
    else:
        judged = model.transform(VectorAssembler(
            inputCols=FEATURES, outputCol="features").transform(found)).withColumn(
            "score", vector_to_array("probability")[1])
    return judged.select(
        "doc_id", "nth", "start", (F.col("start") + F.char_length("value")).alias("end"), "value",
        F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("is_secret"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of all documents with the forest's verdict; values as digests only."""
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "nth", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score",
        "is_secret")
