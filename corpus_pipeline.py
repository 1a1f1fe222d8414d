"""A corpus pipeline over ``documents``: language, near duplicates, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the
next one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webaudit.llm import langid, ngram_join, packing, secret_scan
from webaudit.llm.common import cut_lineage, prepared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT_BELOW = 0.3  # a calibrated probability that tells no language apart
REDACTED = "[SECRET]"
BEFORE_TOKEN, AFTER_TOKEN = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
QUOTED_END = r"\E\\E\Q"  # a quoted pattern's way to hold its own end mark

# Models, loops to a fixpoint and packing: not SQL. tests/llm holds each against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; NULL, empty and letterless texts go."""
    prepared(spark)
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang"))
    # Integers travel as text, as nullable ones would pass through floating point.
    kinds = dict(docs.dtypes)
    carried = docs.select(*[F.col(c).cast("string").alias(c) for c in COLUMNS])
    judged = langid.predict(carried, model, COLUMNS)
    kept = judged.where((F.col("lang_pred") != langid.UNDETERMINED)
                        & (F.col("score") >= REJECT_BELOW))
    return kept.select(*[F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS])


def keyed(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a doc_id, and the rows ``lost`` without one, with a ``key``: the doc_id,
    or a number above all of them, which is written once and so stays the same."""
    lost = cut_lineage(lost.withColumn(
        "key", F.lit(ngram_join.NO_ID) + F.monotonically_increasing_id()), "without-id")
    return docs.where("doc_id IS NOT NULL").withColumn(
        "key", F.col("doc_id").cast("long")).unionByName(lost)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingle sets of similarity 0.8 or more.

    The one of smallest doc_id stays; of repeated rows of that doc_id, one. Documents
    without a word stay, a row for each doc_id. Of groups without any doc_id one stays.
    """
    prepared(spark)
    docs = docs.select(*COLUMNS)
    whole = keyed(docs, docs.where("doc_id IS NULL").dropDuplicates(["text"]))
    groups = ngram_join.jaccard_groups(
        whole.select(F.col("key").alias("doc_id"), "text"), words=5, percent=80)
    keep = cut_lineage(groups.where(
        F.col("doc_id") == F.coalesce("comp", "doc_id")).select(
        F.col("doc_id").alias("key")).distinct(), "keep")
    kept = whole.join(keep, "key", "left_semi")
    repeated = kept.groupBy("key").count().where("count > 1").select("key")
    once = kept.join(repeated, "key", "left_anti").unionByName(
        kept.join(repeated, "key", "left_semi").dropDuplicates(["key"]))
    return once.select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by ``[SECRET]``.

    A secret goes where it was found, and wherever else its document has it as a token of its own,
    that is between characters that are no letters, digits or underscores. Longer ones go first.
    Rows of the same doc_id are searched for each other's secrets too.
    """
    docs = docs.select(*COLUMNS)
    whole = keyed(docs, docs.where("doc_id IS NULL"))
    found = cut_lineage(secret_scan.scan(whole.select(F.col("key").alias("doc_id"), "text")).where(
        "is_secret").select(F.col("doc_id").alias("key"), "start", "value").distinct(), "secrets")
    per_doc = found.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "value")), False).alias("spans"),
        F.sort_array(F.collect_set(F.struct(F.char_length("value").alias("n"), "value")), False)
        .alias("values"))
    # From the last span to the first, so that the others keep their places.
    cut = F.aggregate("spans", F.col("text"), lambda t, s: F.when(
        F.substr(t, s["start"] + 1, F.char_length(s["value"])) == s["value"],
        F.overlay(t, F.lit(REDACTED), s["start"] + 1, F.char_length(s["value"]))).otherwise(t))
    clean = F.aggregate("values", cut, lambda t, s: F.regexp_replace(
        t, F.concat(F.lit(BEFORE_TOKEN + r"\Q"), F.replace(s["value"], F.lit(r"\E"), F.lit(QUOTED_END)),
                    F.lit(r"\E" + AFTER_TOKEN)), F.lit(REDACTED)))
    joined = whole.join(per_doc, "key", "left").withColumn(
        "clean", F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean))
    return joined.select(
        "doc_id", F.col("clean").alias("text"), "lang", "source",
        F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(
            F.char_length("clean")).cast(dict(docs.dtypes)["n_chars"]).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of at most 4,096 tokens."""
    prepared(spark)
    return packing.pack_documents(docs)


STAGES = [("language ID", language), ("near duplicates", near_duplicates),
          ("secret scan", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
