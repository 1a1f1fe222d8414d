"""Best-fit packing with certified bounds: uncertified partitions exchange documents and repack."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, parts_for, table, text_columns
from .words import WordEncoder

CAPACITY = 4096
END = b"\x01\x00\x00\x00"  # id 1 after each document, little-endian
BINS_PER_PART = 512        # sequences a partition packs in the first round
MERGED = 16                # partitions whose released documents meet in the next round
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Inside, ids travel as text: a nullable long would pass through floating point.
TEXT_PIECES = PIECES.replace("doc_id long", "doc_id string")
PACKED = TEXT_PIECES + ", part int, bin int, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids, cut only beyond capacity."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(path)
        names = [c.split()[0] for c in PIECES.split(", ")]
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array):
                ids = (encoder.encode(text) if text else b"") + END
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=names)

    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return keyed.mapInPandas(cut, TEXT_PIECES).withColumn("doc_id", F.col("doc_id").cast("long"))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of the dual-feasible functions tried.

    Identity; the rounding functions u_k; and, for every threshold e, the function that counts
    items above capacity - e as whole bins and ignores those below e. All in integers.
    """
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, 21):
        scaled, whole = (k + 1) * x // capacity, (k + 1) * x % capacity == 0
        best = max(best, -(-int((counts * np.where(whole, k * x, scaled * capacity)).sum())
                           // (k * capacity)))
    tokens, items = np.cumsum(counts * x), np.cumsum(counts)
    for e in range(1, capacity // 2 + 1):
        large = int(items[-1] - items[capacity - e])
        middle = int(tokens[capacity - e] - tokens[e - 1])
        best = max(best, large - (-middle // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """The bin of each item; ``lengths`` must be decreasing."""
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    bins, opened = [], 0
    for length in lengths.tolist():
        at = bisect.bisect_left(room, (length, -1))
        if at == len(room):
            free, target = capacity, opened
            opened += 1
        else:
            free, target = room.pop(at)
        if free > length:
            bisect.insort(room, (free - length, target))
        bins.append(target)
    return bins


def _pack(last: bool, capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"],
                              ascending=[False, True, True, True], kind="stable")
        lengths = pdf["length"].to_numpy(np.int64)
        bins = np.asarray(best_fit_decreasing(lengths, capacity))
        loads = np.bincount(bins, weights=lengths).astype(np.int64)
        gap = len(loads) - lower_bound(lengths, capacity)
        if gap and not last:
            # The poorest bins: those whose room adds up to the gap, and as many fuller ones.
            poorest = np.argsort(loads, kind="stable")
            room = np.cumsum(capacity - loads[poorest])
            released = min(len(loads), 2 * (int(np.searchsorted(room, gap * capacity)) + 1))
            bins = np.where(np.isin(bins, poorest[:released]), -1, bins)
        out = pdf.assign(bin=bins.astype(np.int32))
        before = out.groupby("bin")["length"].cumsum() - out["length"]
        return out.assign(offset=before.where(out["bin"] >= 0, 0).astype(np.int64))

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, bins_per_part: int = BINS_PER_PART,
         merged: int = MERGED) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, in as few sequences as the rounds find.

    Round 1 packs each hash partition (about ``bins_per_part`` sequences) by best-fit
    decreasing. A partition whose bin count equals its lower bound is certified optimal.
    Any other keeps its well-filled bins and releases the documents of its poorest; those of
    ``merged`` partitions meet in the next round, until one partition is left. Rounds: the
    logarithm of the partition count. Every piece is packed exactly once.

    NULL doc_ids are pieces like any others, and leave the others as they are. No pieces: no rows.
    """
    total, rows = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    parts = parts_for(total, capacity * bins_per_part)
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    kind = dict(pieces.dtypes)["doc_id"]
    todo = pieces.withColumn("part", part).withColumn("doc_id", F.col("doc_id").cast("string"))
    done, level = [], 0
    while True:
        tried = cut_lineage(todo.groupBy("part").applyInPandas(
            _pack(parts == 1, capacity), PACKED), f"packed-{level}")
        kept = tried.where("bin >= 0")
        number = (F.lit(level << 52) + F.shiftleft(F.col("part").cast("long"), 20)
                  + F.col("bin").cast("long"))
        done.append(kept.select(F.col("doc_id").cast(kind).alias("doc_id"), "piece", "start", "length", "ids_crc32",
                                number.alias("sequence_id"), "offset"))
        if parts == 1:
            break
        parts, level = -(-parts // merged), level + 1
        todo = tried.where("bin < 0").drop("bin", "offset").withColumn(
            "part", F.expr(f"part % {parts}").cast("int"))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack: a row per piece with its ``sequence_id`` and ``offset``.

    A NULL or empty text is the end id alone. Very long texts become pieces of ``capacity``
    ids, the last one shorter. Repeated rows are packed each. Other columns take no part.
    """
    pieces = cut_lineage(pieces_of(
        text_columns(docs, "doc_id", "text"), path or tokenizer_path(), capacity), "pieces")
    return pack(pieces, capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
