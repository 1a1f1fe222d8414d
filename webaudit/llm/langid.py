"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, table, text_columns

DIM = 1 << 15          # hashed n-gram features
ORDERS = 3             # n-grams of 1 to 3 characters
SAMPLE_ROWS = 4096     # labelled rows the classifier is fitted on, shared evenly by the languages
LEAST_PER_LANG = 64
CALIBRATION = 4        # every fourth sampled row sets the temperature and is not fitted on
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray      # DIM
    weights: np.ndarray  # DIM x languages; mostly zeros
    temperature: float


class Features:
    """Counts of hashed character n-grams of a text; letters are lower-cased, runs of all other
    characters count as one space. The whole text counts."""

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)

    def counts(self, text: str | None) -> np.ndarray | None:
        """``DIM`` counts, or None if there is no letter."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = self.letter[np.minimum(codes, 0xFFFF)]
        if (far := codes > 0xFFFF).any():
            known = {c: chr(c).isalpha() for c in np.unique(codes[far]).tolist()}
            letter[far] = [known[c] for c in codes[far].tolist()]
        if not letter.any():
            return None
        codes = np.where(letter, codes, 32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint32)
        gram, found = codes, []
        for order in range(1, ORDERS + 1):
            if order > 1:
                gram = gram[:-1] * np.uint32(0x01000193) + codes[order - 1:]
            mixed = (gram + np.uint32(order)) * np.uint32(0x9E3779B1)
            found.append((mixed ^ (mixed >> np.uint32(15))) & np.uint32(DIM - 1))
        return np.bincount(np.concatenate(found), minlength=DIM)


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features present and their TF-IDF weights, of unit length."""
    at = np.nonzero(counts)[0]
    x = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm > 0 else x


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """Follow-the-regularised-leader with elastic-net penalties; rows are (class, features, x)."""
    z, n = np.zeros((DIM, classes)), np.zeros((DIM, classes))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > L1, w, 0.0)

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            label, at, x = rows[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    return weights(np.arange(DIM))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, from a fine logarithmic grid."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-300)).mean()
            for t in grid]
    return float(grid[int(np.argmin(loss))])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all given documents each feature occurs, and how many have letters."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, df, n = Features(), np.zeros(DIM, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                if (c := features.counts(text)) is not None:
                    df += c > 0
                    n += 1
        at = np.append(np.nonzero(df)[0], DIM)
        yield pd.DataFrame({"feature": at, "df": np.append(df, n)[at]})

    sums = docs.select("text").mapInPandas(count, "feature int, df long").groupBy("feature").agg(
        F.sum("df").alias("df")).collect()  # DIM + 1 rows at most
    df = np.zeros(DIM + 1, np.int64)
    for r in sums:
        df[r["feature"]] = r["df"]
    return df[:DIM], int(df[DIM])


def hash_limit(wanted: int, rows: int) -> int:
    """The 64-bit hash up to which about ``wanted`` of ``rows`` different rows lie."""
    if rows <= wanted:
        return (1 << 63) - 1
    return (1 << 64) * wanted // rows - (1 << 63)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``doc_id, text, lang`` rows.

    Document frequencies come from all rows. The classifier itself is fitted on a bounded
    sample: at most ``sample_rows`` rows in all (``LEAST_PER_LANG`` for each language at
    least), those of smallest hash in each language; repeated rows teach once. Rows without a
    language or a letter teach nothing. No labelled row: a model that knows no language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                          & (F.col("lang") != UNDETERMINED))
    langs = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    if not langs:
        return Model([], idf, np.zeros((DIM, 0)), 1.0)
    each = max(LEAST_PER_LANG, sample_rows // len(langs))
    keyed = labelled.select("lang", "doc_id", "text",
                            F.xxhash64("doc_id", "text", F.lit("sample")).alias("hash"))
    # Of each language only about twice the rows asked for, those of smallest hash, move at
    # all: the cut follows from its number of distinct rows, which is off by a few percent.
    distinct = keyed.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()
    limits = F.create_map(*[F.lit(v) for r in distinct
                            for v in (r["lang"], hash_limit(2 * each + LEAST_PER_LANG, r["n"]))])
    order = W.partitionBy("lang").orderBy("hash", "doc_id", "text")
    chosen = (keyed.where(F.col("hash") <= limits[F.col("lang")])
              .dropDuplicates(["lang", "hash"])
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for pdf in batches:
            rows = []
            for lang, rank, text in zip(pdf["lang"], pdf["rank"], pdf["text"]):
                if (c := features.counts(text)) is not None:
                    at, x = vector(c, idf)
                    rows.append((lang, rank, at.astype(np.uint16).tobytes(),
                                 x.astype(np.float32).tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "rank", "at", "x"])

    sample = chosen.select("lang", "rank", "text").mapInPandas(
        vectors, "lang string, rank int, at binary, x binary").collect()
    number = {lang: i for i, lang in enumerate(langs)}
    rows, held = [], []
    for r in sorted(sample, key=lambda r: (r["rank"], r["lang"])):
        row = (number[r["lang"]], np.frombuffer(r["at"], np.uint16).astype(np.int64),
               np.frombuffer(r["x"], np.float32).astype(np.float64))
        (held if r["rank"] % CALIBRATION == 0 else rows).append(row)
    weights = fit_ftrl(rows, len(langs))
    logits = np.array([x @ weights[at] for _, at, x in held]).reshape(len(held), len(langs))
    return Model(langs, idf, weights.astype(np.float32),
                 fit_temperature(logits, np.array([c for c, _, _ in held], int)))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``, the calibrated probability.

    ``und`` with score 0 where the text is NULL or has no letter, or no language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, m = Features(), shared.value
        for pdf in batches:
            langs, scores = [], []
            for text in pdf["__text"]:
                c = features.counts(text) if m.langs else None
                if c is None:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    at, x = vector(c, m.idf)
                    p = _softmax(x @ m.weights[at] / m.temperature)
                    langs.append(m.langs[int(p.argmax())])
                    scores.append(float(p.max()))
            yield pdf[keep].assign(lang_pred=langs, score=scores)

    return docs.select(*keep, F.col("text").alias("__text")).mapInPandas(
        run, f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, learn_from: Column) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, learned from the rows where ``learn_from`` holds.

    Only text and lang are learned from; a prediction sees the text alone. NULL or repeated
    doc_ids are rows like any other; columns besides doc_id, text and lang take no part.
    """
    model = train(docs.where(learn_from).select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", "lang"))
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return predict(keyed, model, ["doc_id"]).withColumn("doc_id", F.col("doc_id").cast("long"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the three quarters not held out."""
    docs = text_columns(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return identify(docs, ~held_out(F.col("doc_id"))).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
