"""Nearest neighbours by randomly rotated one-bit codes, with error bounds that choose what to rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, parts_for, table

BLOCK = 4096             # vectors of an index row
QUERY_BLOCK = 1024       # queries of a query row
BROADCAST_BLOCKS = 32    # query rows broadcast at once: 16 MB at 64 dimensions
CONFIDENCE = 3.0         # error bounds hold for all but about one estimate in a thousand
SEED = 11

INDEX = "vec_ids binary, vectors binary, bits binary, scalars binary"
FOUND = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated residuals, and per vector: residual norm, and the inner
    product of the unit residual with its code (the correction of the estimate)."""
    rest = vectors - centre
    norm = np.linalg.norm(rest, axis=1)
    turned = rest @ turn.T / np.where(norm > 0, norm, 1)[:, None]
    own = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), np.stack([norm, np.where(norm > 0, own, 1)], 1)


def bounds(bits: np.ndarray, scalars: np.ndarray, queries: np.ndarray, centre: np.ndarray,
           turn: np.ndarray, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, a row per query."""
    dim = queries.shape[1]
    rest = queries - centre
    qnorm = np.linalg.norm(rest, axis=1)
    turned = rest @ turn.T / np.where(qnorm > 0, qnorm, 1)[:, None]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    norm, own = scalars[:, 0], scalars[:, 1]
    inner = (turned.astype(np.float32) @ signs.T) / np.sqrt(dim) / own
    error = np.sqrt(np.maximum(1 - own ** 2, 0)) / own * confidence / np.sqrt(max(dim - 1, 1))
    base = norm ** 2 + (qnorm ** 2)[:, None]
    scale = 2 * norm * qnorm[:, None]
    slack = 1e-5 * base  # single-precision rounding
    return base - scale * (inner + error) - slack, base - scale * (inner - error) + slack


def _rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["embedding"].to_numpy()).astype(np.float64)


def _blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= size:
            whole = pd.concat(held)
            for at in range(0, len(whole) - size + 1, size):
                yield _rows(whole[at:at + size])
            held = [whole[len(whole) // size * size:]]
    if held and len(rest := pd.concat(held)):
        yield _rows(rest)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """Distinct ``vec_id, embedding`` that can take part: no NULL, zero or non-finite ones.

    Vectors whose length is not the most common one take no part either (ties: the shorter).
    """
    v = F.col("embedding")
    sound = vectors.select("vec_id", v).where(
        F.col("vec_id").isNotNull() & v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0))
    sizes = sound.groupBy(F.size(v).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes["dim"] if sizes else 0
    return sound.where(F.size(v) == dim).dropDuplicates(["vec_id", "embedding"])


def build_index(vectors: DataFrame, centre: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Rows of up to ``block`` vectors: ids, originals (for the rerank), codes and corrections."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(len(centre))
        for ids, vecs in _blocks(batches, block):
            bits, scalars = encode(vecs, centre, turn)
            yield pd.DataFrame({
                "vec_ids": [ids.tobytes()], "vectors": [vecs.astype(np.float32).tobytes()],
                "bits": [bits.tobytes()], "scalars": [scalars.tobytes()]})

    return vectors.mapInPandas(pack, INDEX)


def _centre(vectors: DataFrame) -> np.ndarray:
    """The mean of all vectors, from partial sums."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for pdf in batches:
            if len(pdf):
                part = _rows(pdf)[1].sum(0)
                total, n = part if total is None else total + part, n + len(pdf)
        if total is not None:
            yield pd.DataFrame({"d": np.arange(len(total)), "s": total, "n": n})

    sums = vectors.mapInPandas(add, "d int, s double, n long").groupBy("d").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("d").collect()
    return np.array([r["s"] / r["n"] for r in sums])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10,
            confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of all ``vectors`` to each query.

    ``vectors`` as from ``valid_vectors``; ``queries`` is a subset of them. Every index block
    meets every block of queries: estimates from the bits bound all distances of the block,
    vectors whose lower bound exceeds the k-th smallest upper bound are put aside, the others
    are measured in double precision, and each block's k best compete for the result. Queries
    are broadcast ``BROADCAST_BLOCKS`` rows at a time. Ties go to smaller ids; a
    query never finds its own id. Fewer candidates than ``k``: all of them. No vectors: no rows.
    """
    spark = vectors.sparkSession
    centre = _centre(vectors)
    dim = len(centre)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = cut_lineage(build_index(vectors, centre), "ann-index")

    def pack_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, vecs in _blocks(batches, QUERY_BLOCK):
            yield pd.DataFrame({"query_ids": [ids.tobytes()], "query_vectors": [vecs.tobytes()]})

    n_queries = queries.count()
    packed = cut_lineage(
        queries.repartition(parts_for(n_queries, QUERY_BLOCK)).mapInPandas(
            pack_queries, "query_ids binary, query_vectors binary")
        .withColumn("qblock", F.row_number().over(W.orderBy(F.xxhash64("query_ids"))) - 1),
        "ann-queries")
    blocks = packed.count()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(dim)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = np.frombuffer(row.vec_ids, np.int64)
                vecs = np.frombuffer(row.vectors, np.float32).reshape(-1, dim)
                bits = np.frombuffer(row.bits, np.uint8).reshape(len(ids), -1)
                scalars = np.frombuffer(row.scalars, np.float64).reshape(-1, 2)
                qids = np.frombuffer(row.query_ids, np.int64)
                qvecs = np.frombuffer(row.query_vectors, np.float64).reshape(-1, dim)
                low, high = bounds(bits, scalars, qvecs, centre, turn, confidence)
                own = qids[:, None] == ids
                low[own] = high[own] = np.inf
                kth = np.partition(high, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                out = []
                for i in range(len(qids)):
                    chosen = np.nonzero((low[i] <= kth[i]) & ~own[i])[0]
                    squares = (vecs[chosen].astype(np.float64) - qvecs[i]) ** 2
                    exact = np.sqrt(np.add.accumulate(squares, axis=1)[:, -1])  # in order, as SQL
                    best = np.lexsort((ids[chosen], exact))[:k]
                    out.append(pd.DataFrame({"query_id": qids[i], "vec_id": ids[chosen[best]],
                                             "score": exact[best]}))
                yield pd.concat(out)

    found = None
    for at in range(0, blocks, BROADCAST_BLOCKS):
        last = min(at + BROADCAST_BLOCKS, blocks) - 1
        some = F.broadcast(packed.where(F.col("qblock").between(at, last)))
        pairs = index.withColumn("qblock", F.explode(F.sequence(F.lit(at), F.lit(last))))
        part = pairs.join(some, "qblock").drop("qblock").mapInPandas(search, FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings to each one whose id is divisible by 100."""
    vectors = cut_lineage(valid_vectors(table(spark, sf_dir, "embeddings")), "ann-vectors")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e),
    lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""
