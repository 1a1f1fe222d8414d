"""Jaccard join of word n-gram sets by token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, stored, table, text_columns
from .components import components

SKETCH_BITS = 21       # buckets of the token-frequency counts: 2 MB a task
SLICE = 1 << 15        # buckets of a slice of them
WHOLE_UP_TO = 256      # sets up to this size are indexed whole, larger ones in hash ranges of half to all of it
PARITY = 16            # 64-bit words of a set's parity bitmap
FOLDED = 4             # words of the bitmap of a set or hash range that joins with the index
STAR_ROUNDS = 2        # rounds that join each bucket's sets to one of them
CROWD = 16             # a bucket of more sets than these is crowded, and has a round of its own
CROWD_SHARE = 16       # one crowded bucket in so many names heads: the sets of a crowd share very many
HEADS = 8              # heads of such a bucket, and of a set in that round
SENT_BYTES = 16 << 20  # tokens that a task hands on at once
NEEDED_BITS = 26       # bits of the map of sets whose tokens are fetched for verification
BLOCK_BYTES = 1 << 20  # text hashed at once
SEEN_SETS = 500_000    # sets a task remembers, to index copies once
NO_ID = 1 << 62        # nodes of sets without any doc_id lie above

MIX1, MIX2, MIX3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9  # odd constants


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of a text's words: polynomials of random byte values, mixed."""

    def __init__(self):
        rng = np.random.default_rng(5)
        self.value = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(0, 1 << 62)) * 8 + 5  # odd, so it has an inverse
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.space = np.isin(np.arange(256), [32, *range(9, 14)])

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            size = len(self.powers)
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate(
                    [old, old * np.uint64(pow(base, size, 1 << 64))]))

    def hashes(self, data: bytes) -> np.ndarray:
        """Of the words of ``data``, a block at a time, cut at white space."""
        out, at = [], 0
        while at < len(data):
            end = min(at + BLOCK_BYTES, len(data))
            while end < len(data) and not self.space[data[end]]:
                end += 1
            out.append(self._block(np.frombuffer(data, np.uint8, end - at, at)))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def _block(self, b: np.ndarray) -> np.ndarray:
        self._grow(len(b))
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = ~self.space[b]
        change = np.nonzero(inside[1:] != inside[:-1])[0]
        starts, ends = change[::2], change[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.value[b] * self.powers[:len(b)], out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * self.inverses[starts]
                    + (ends - starts).astype(np.uint64))


def tokens_of(text: str | None, words: int, hasher: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text.

    Words: runs without ASCII white space, A-Z lowered. Fewer than ``words``: the whole
    sequence is the only n-gram. No text or word: none.
    """
    hashes = hasher.hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    grams = np.full(len(hashes) - size + 1, size, np.uint64)
    for k in range(size):
        grams = grams * np.uint64(MIX3) + hashes[k:len(hashes) - size + 1 + k]
    return np.unique(_mix(grams))


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(tokens.tobytes())
    return tuple(np.frombuffer(h, np.int64).tolist())


def overlap_needed(n: int, percent: int) -> int:
    """Tokens a set of ``n`` shares with any set it links to."""
    return -(-percent * n // 100)


def size_classes(n: int, percent: int) -> list[int]:
    """The classes a set of ``n`` is indexed in: class ``c`` cuts it into ``2^c`` ranges of its hashes.

    Its own class, and the one below if it may link with a set of that one. Linked sets have
    a class in common, as their sizes differ by less than a factor of two.
    """
    own = max(0, (-(-n // WHOLE_UP_TO) - 1).bit_length())
    least = (WHOLE_UP_TO << own >> 1) + 1
    return [own - 1, own] if own and n * percent < least * 100 else [own]


def ranges_of(tokens: np.ndarray, of: int) -> np.ndarray:
    """The hash range of each token in a class."""
    return (tokens >> np.uint64(64 - of)).astype(np.int64) if of else np.zeros(len(tokens), np.int64)


def range_rows(tokens: np.ndarray, percent: int) -> np.ndarray | None:
    """``range, n`` and parity words of the hash ranges of a set that is cut into some."""
    out = []
    for of in size_classes(len(tokens), percent):
        if not of:
            continue
        at = ranges_of(tokens, of)
        bits = np.bincount(at * (FOLDED * 64) + (tokens & np.uint64(FOLDED * 64 - 1)).astype(np.int64),
                           minlength=FOLDED * 64 << of) & 1
        n = np.bincount(at, minlength=1 << of)
        words = np.packbits(bits.astype(np.uint8)).view(np.int64).reshape(-1, FOLDED)
        out.append(np.column_stack([np.arange(1 << of) + (of << 40), n, words])[n > 0])
    return np.concatenate(out).ravel() if out else None


@lru_cache(256)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def entries_of(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> list[np.ndarray]:
    """Index entries of a set: ``sig, range, skip, before, between``.

    A small set is indexed whole. A larger one is cut into hash ranges, each indexed like a set: if
    two sets are as similar as asked, then so are their tokens in one range at least, as
    the differences of all ranges add up. What follows holds in a range.

    Order: rare tokens first, then frequent ones, by hash in each. Linked sets share at least
    two tokens of their prefixes of ``n - needed + 2``: a rare one, which is indexed by itself, or
    two frequent ones, which are indexed as a pair. (Of one token, that one.) The first common
    token, or first two, have no other common one before or between them, so a pair of sets need
    not be taken elsewhere: ``skip`` counts the tokens before the entry's last (without its own),
    which are then in one set only; ``before`` is the one just before its first and ``between`` that
    just before its second, 0 if there is none.
    """
    n = len(tokens)
    if n < 2:
        return [np.empty(0, t) for t in (np.uint64, np.int64, np.int32, np.uint64, np.uint64)]
    common = frequent[tokens >> np.uint64(64 - SKETCH_BITS)]
    out = []
    for of in size_classes(n, percent):
        place = np.uint64(of * MIX1 & (1 << 64) - 1)
        at = ranges_of(tokens, of)
        order = np.argsort(at * 2 + common, kind="stable")
        ordered, at = tokens[order], at[order]
        sizes = np.bincount(at, minlength=1 << of)
        starts = np.cumsum(sizes) - sizes
        rare = sizes - np.bincount(at, weights=common[order], minlength=1 << of).astype(np.int64)
        prefix = np.minimum(sizes, sizes - -(-percent * sizes // 100) + 2)
        within = np.arange(n) - starts[at]
        one = np.nonzero((within < np.minimum(prefix, rare)[at]) | (sizes[at] == 1))[0]
        last = np.concatenate([np.zeros(1, np.uint64), ordered[:-1]])
        sig = _mix(ordered[one] + place) if of else ordered[one]
        out.append((sig, at[one] + (of << 40), within[one],
                    np.where(within[one] > 0, last[one], np.uint64(0)), np.zeros(len(one), np.uint64)))
        for k in np.nonzero(prefix - rare > 1)[0].tolist():
            i, j = _pairs(int(prefix[k] - rare[k]))
            first = int(starts[k] + rare[k])
            rest, ahead = ordered[first:], last[first:first + int(prefix[k] - rare[k])].copy()
            if not rare[k]:
                ahead[0] = 0
            out.append((_mix(rest[i] * np.uint64(MIX3) + rest[j] + place),
                        np.full(len(i), k + (of << 40)), j + (int(rare[k]) - 1), ahead[i],
                        np.where(j == i + 1, np.uint64(0), ahead[j])))
    found = [np.concatenate(x) for x in zip(*out)]
    found[2] = found[2].astype(np.int32)
    return found


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of a set: any two linked, different sets have one in common."""
    return np.unique(entries_of(tokens, frequent, percent)[0])


def parity(tokens: np.ndarray) -> np.ndarray:
    """One bit per bucket: whether an odd number of tokens falls into it."""
    bits = np.bincount((tokens & np.uint64(PARITY * 64 - 1)).astype(np.int64),
                       minlength=PARITY * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


PARITY_COLUMNS = [f"p{i}" for i in range(PARITY)]
ENTRY_COLUMNS = ["range", "skip", "before", "between"]


def wide_parity(tokens: np.ndarray) -> bytes | None:
    """The parity bitmap of a set too large for ``parity``, of two to four bits a token."""
    if len(tokens) <= PARITY * 32:
        return None
    size = 1 << (2 * len(tokens) - 1).bit_length()
    bits = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Tokens that two sets differ in at least: a bitmap is folded to the length of the shorter."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def document_sets(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, np.ndarray]:
    """One scan: ``doc_id`` (as text), ``n``, key ``h1, h2``, parity bitmap and hash ranges of each
    document's set; and which hash buckets hold a frequent token, as packed bits.

    Token counts cover all documents. They are summed and judged by slices of the buckets; what
    reaches the driver is ``2^SKETCH_BITS`` bits, whatever the corpus. A bucket is frequent if
    its count stands out from the mean by far more than chance allows. A wrong flag costs time, never
    a link.
    """
    buckets = 1 << SKETCH_BITS
    columns = ["doc_id", "n", "h1", "h2", *PARITY_COLUMNS, "wide", "ranges", "slice", "counts"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, counts = Words(), np.zeros(buckets, np.uint32)
        for pdf in batches:
            rows, found = [], []
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array):
                tokens = tokens_of(text, words, cache)
                found.append(tokens)
                rows.append((doc_id, len(tokens), *set_key(tokens), *parity(tokens).tolist(),
                             wide_parity(tokens), range_rows(tokens, percent), -1, b""))
            at = (np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            np.add.at(counts, at, np.uint32(1))  # in place: no second array of all buckets
            yield pd.DataFrame(rows, columns=columns)
        if counts.any():
            for i in range(0, buckets, SLICE):
                yield pd.DataFrame([("", *[0] * (PARITY + 3), None, None, i // SLICE,
                                     counts[i:i + SLICE].tobytes())], columns=columns)

    schema = ("doc_id string, n long, h1 long, h2 long, "
              + ", ".join(f"{p} long" for p in PARITY_COLUMNS)
              + ", wide binary, ranges array<long>, slice int, counts binary")
    both = cut_lineage(docs.mapInPandas(run, schema), "ngram-sets")

    sizes = both.where("slice < 0").drop("slice", "counts")
    mean = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / buckets
    frequent_above = mean + 6 * np.sqrt(mean) + 16

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.uint32)
        return pd.DataFrame({"slice": pdf["slice"][:1],
                             "flags": [np.packbits(total > frequent_above).tobytes()]})

    flags = np.zeros(buckets // 8, np.uint8)
    for row in (both.where("slice >= 0").select("slice", "counts").groupBy("slice")
                .applyInPandas(add, "slice int, flags binary").collect()):
        flags[row["slice"] * SLICE // 8:(row["slice"] + 1) * SLICE // 8] = np.frombuffer(row["flags"], np.uint8)
    return sizes.withColumn("doc_id", F.col("doc_id").cast("long")), flags


def index_entries(docs: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``sig, h1, h2`` and what ``entries_of`` tells: the index, with each set once a task.

    ``frequent``: a packed bit for each bucket.
    """
    flags = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, seen = Words(), set()
        common = np.unpackbits(flags.value).astype(bool)
        for pdf in batches:
            found, keys = [], []
            for text in pdf["text"].array:
                tokens = tokens_of(text, words, cache)
                if len(tokens) < 2 or (key := set_key(tokens)) in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(key)
                found.append(entries_of(tokens, common, percent))
                keys.append(key)
            if found:
                sizes = [len(x[0]) for x in found]
                h = np.array(keys, np.int64)
                columns = [np.concatenate(x) for x in zip(*found)]
                yield pd.DataFrame({"sig": columns[0].view(np.int64), "h1": np.repeat(h[:, 0], sizes),
                                    "h2": np.repeat(h[:, 1], sizes), "range": columns[1],
                                    "skip": columns[2], "before": columns[3].view(np.int64),
                                    "between": columns[4].view(np.int64)})

    return docs.select("text").mapInPandas(
        run, "sig long, h1 long, h2 long, range long, skip int, before long, between long")


def fetch_tokens(docs: DataFrame, words: int, needed: DataFrame) -> DataFrame:
    """``needed`` (rows ``h1, h2, id`` of sets, and more) with the ``tokens`` of each row's set.

    ``id`` names the one document whose text is read for a set. A bitmap of the needed ids, of
    ``2^NEEDED_BITS`` bits at most, spares the other documents' texts the work; only the parts of
    it that hold an id exist. The join behind it is exact. Rows without doc_id are all read.
    """
    slot = F.pmod(F.col("id"), F.lit(1 << NEEDED_BITS))
    maps = needed.where("id IS NOT NULL").select(slot.alias("slot")).groupBy(
        F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    # Bucket numbers begin at 0 for slot 0 alone, then at 1 for every 32,768 slots.
    shared = docs.sparkSession.sparkContext.broadcast(
        {row["bucket"]: bytes(row["bits"]) for row in maps})

    def wanted(doc_id: str | None) -> bool:
        if doc_id is None:
            return True
        at = int(doc_id) % (1 << NEEDED_BITS)
        bucket, bit = (0, 0) if at == 0 else (1 + (at - 1) // 32768, (at - 1) % 32768)
        bits = shared.value.get(bucket)
        return bits is not None and bool(bits[bit // 8] >> (bit % 8) & 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Words()
        for pdf in batches:
            rows, size = [], 0
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array):
                if wanted(doc_id) and len(tokens := tokens_of(text, words, cache)) > 1:
                    rows.append((doc_id, *set_key(tokens), tokens.tobytes()))
                    size += len(rows[-1][-1])
                if size > SENT_BYTES:
                    yield pd.DataFrame(rows, columns=["own", "k1", "k2", "tokens"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["own", "k1", "k2", "tokens"])

    rows = docs.mapInPandas(run, "own string, k1 long, k2 long, tokens binary").withColumn(
        "own", F.col("own").cast("long"))
    return needed.join(rows, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
                       & F.col("id").eqNullSafe(F.col("own"))).drop("own", "k1", "k2", "h1", "h2")


def _possible(percent: int, columns: list[str] = PARITY_COLUMNS) -> Column:
    """Whether the parity bitmaps of two sets leave room for enough overlap."""
    differ = reduce(lambda a, b: a + b,
                    (F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in columns))
    n, m = F.col("x.n"), F.col("y.n")
    # overlap <= (n + m - differ) / 2, and (100 + percent) * overlap >= percent * (n + m)
    return ((100 + percent) * (n + m - differ) >= 2 * percent * (n + m)) & (
        100 * F.least(n, m) >= percent * F.greatest(n, m))


def verify(docs: DataFrame, pairs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of set nodes whose token sets are as similar as asked, by exact count.

    The tokens of ``a`` go with each of its pairs to where those of ``b`` are: pairs with a common
    ``b`` move each set once.
    """
    ends = sets.select("node", "h1", "h2", "id", "many")
    left = pairs.join(ends, F.col("a") == F.col("node")).drop("node")
    right = pairs.select("b").distinct().join(ends, F.col("b") == F.col("node")).select(
        F.lit(None).cast("long").alias("a"), "b", "h1", "h2", "id", "many")
    needed, drop = stored(left.unionByName(right), "ngram-needed")
    tokens, drop_tokens = stored(fetch_tokens(docs, words, needed), "ngram-tokens")
    # A set whose text may be read more than once counts once.
    tokens = tokens.where("NOT many").unionByName(
        tokens.where("many").dropDuplicates(["a", "b"])).drop("id", "many")

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"]):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pdf.loc[keep, ["a", "b"]]

    x = tokens.where("a IS NOT NULL").withColumnRenamed("tokens", "x")
    y = tokens.where("a IS NULL").select("b", F.col("tokens").alias("y"))
    links = cut_lineage(x.join(y, "b").select("a", "b", "x", "y").mapInPandas(
        similar, "a long, b long"), "ngram-links")
    drop()
    drop_tokens()
    return links


def not_ruled_out(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b, n, m`` (sizes) of large sets whose wide bitmaps leave room for enough overlap."""
    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [(100 + percent) * (n + m - least_difference(x, y)) >= 2 * percent * (n + m)
                    for n, m, x, y in zip(pdf["n"], pdf["m"], pdf["x"], pdf["y"])]
            yield pdf.loc[keep, ["a", "b"]]

    wide = sets.where("wide IS NOT NULL")
    x = wide.select(F.col("node").alias("a"), F.col("n"), F.col("wide").alias("x"))
    y = wide.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("wide").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInPandas(possible, "a long, b long")


def candidates(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of nodes in different groups whose entries may be their first common ones.

    ``mixed``: entries with ``node, comp``, size ``n`` of the set, and size ``part`` and parity
    words of the set or range that the entry is of.
    """
    x, y = mixed.alias("x"), mixed.alias("y")

    def unlike(c: str) -> Column:
        return (F.col(f"x.{c}") != F.col(f"y.{c}")) | (F.col(f"x.{c}") == 0)

    left, right = F.col("x.part") - F.col("x.skip"), F.col("y.part") - F.col("y.skip")
    differ = F.greatest(
        F.col("x.skip") + F.col("y.skip") + F.abs(left - right),
        reduce(lambda a, b: a + b, (F.bit_count(F.col(f"x.f{i}").bitwiseXOR(F.col(f"y.f{i}")))
                                    for i in range(FOLDED))))
    both = F.col("x.part") + F.col("y.part")
    # The bounds are part of the join: pairs that they rule out are never rows.
    return x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") < F.col("y.node"))
                  & (F.col("x.comp") != F.col("y.comp")) & unlike("before") & unlike("between")
                  & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
                  & ((100 + percent) * (both - differ) >= 2 * percent * both)).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def one_head(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs ``a, b``: each set with one head of another group, that of most of its buckets.

    ``placed``: the index's ``sig, node, crowded`` with each node's group ``comp``.
    """
    order = F.xxhash64("node", F.lit(turn))
    first = placed.groupBy("sig").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        F.min_by(F.struct("node", "comp"), order).alias("first")).where("lo < hi").select(
        "sig", F.col("first.node").alias("head"), F.col("first.comp").alias("own"))
    return placed.join(first, "sig").where("comp <> own").groupBy("node", "head").agg(
        F.count("*").alias("n")).groupBy("node").agg(
        F.max(F.struct("n", "head")).alias("top")).select(
        F.col("node").alias("a"), F.col("top.head").alias("b"))


def crowd_heads(placed: DataFrame) -> DataFrame:
    """Pairs ``a, b``: each set of crowded buckets with at most ``HEADS`` heads of other groups.

    In a large family of near copies a set links with only some of the others, so one head seldom
    tells. Sets that a few more heads bring into the family's group are no pairs with each of its
    members. Only a share of the buckets names heads, which bounds the rows; whatever links
    only elsewhere is left to the join of all buckets.
    """
    placed = placed.where(F.col("crowded") & (F.pmod("sig", F.lit(CROWD_SHARE)) == 0)).select(
        "sig", "node", "comp")
    orders = [F.xxhash64("node", F.lit(-1 - i)) for i in range(HEADS)]
    first = placed.groupBy("sig").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.array_distinct(F.array(
            *[F.min_by(F.struct("node", "comp"), order) for order in orders])).alias("heads")).where(
        "lo < hi").select("sig", F.explode("heads").alias("head")).select(
        "sig", F.col("head.node").alias("head"), F.col("head.comp").alias("own"))
    most = W.partitionBy("node").orderBy(F.desc("n"), "head")
    return placed.join(first, "sig").where("comp <> own").groupBy("node", "head").agg(
        F.count("*").alias("n")).withColumn("rank", F.row_number().over(most)).where(
        F.col("rank") <= HEADS).select(F.col("node").alias("a"), F.col("head").alias("b"))


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n, node, comp`` of every row: its set's size, set and group of linked sets.

    Two documents link when their n-gram sets are as similar as ``percent`` says; ``comp`` is the
    smallest doc_id reachable by links. Equal sets are one set from the start, so copies cost
    nothing more. Star rounds verify each indexed set against one head, and those of crowded
    buckets against a few, which joins large groups without their pairs; the last round verifies the pairs of sets that are still in different groups
    and share a bucket of their first common tokens, if parity bitmaps leave room for enough
    overlap. No link is lost: every pair of different sets that links shares such a bucket. ``percent`` is above 50 (sets
    of one token have no entry, and link with no other set then).

    NULL, empty and blank texts have n = 0 and link with nothing. Rows of the same doc_id are the
    same document. Rows without doc_id take part, and get a ``comp`` above ``NO_ID`` if no
    row of their group has one. Columns other than doc_id and text take no part. An empty
    table gives no rows.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found, frequent = document_sets(docs, words, percent)
    members = found.select("doc_id", "n", "h1", "h2")
    without = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("h1", "h2"), 2)
    sets = cut_lineage(found.where("n > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("id"), ((F.count("*") > 1) | F.min("doc_id").isNull()).alias("many"),
        F.first("wide").alias("wide"), F.first("ranges").alias("ranges"), *[F.min(c).alias(c) for c in ("n", *PARITY_COLUMNS)])
        .withColumn("node", F.coalesce("id", without)), "ngram-nodes")
    entries = index_entries(docs, words, percent, frequent)
    bucket = W.partitionBy("sig")
    shared, drop_shared = stored(
        entries.repartition("sig").dropDuplicates(["sig", "h1", "h2"])
        .withColumn("size", F.count("*").over(bucket)).where("size > 1")
        .withColumn("crowded", F.col("size") > CROWD).drop("size"), "ngram-shared")
    sketches = sets.select("node", "n", *PARITY_COLUMNS)
    named, drop_named = stored(shared.join(sets, ["h1", "h2"]).select(
        "sig", "node", "crowded", *ENTRY_COLUMNS), "ngram-named")
    drop_shared()

    def judged(pairs: DataFrame) -> DataFrame:
        x, y = sketches.alias("x"), sketches.alias("y")
        large = (F.col("x.n") > PARITY * 32) & (F.col("y.n") > PARITY * 32)
        met, drop_met = stored(
            pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
            .where(_possible(percent)).select("a", "b", large.alias("large")), "ngram-met")
        kept, drop = stored(met.where("NOT large").select("a", "b").unionByName(not_ruled_out(
            met.where("large").select("a", "b"), sets, percent)), "ngram-pairs")
        drop_met()
        found = verify(docs, kept, sets, words, percent)
        drop()
        return found

    links, placed = None, named.withColumn("comp", F.col("node"))
    for turn in range(STAR_ROUNDS + 1):
        new = judged(one_head(placed, turn) if turn < STAR_ROUNDS else crowd_heads(placed))
        links = new if links is None else links.unionByName(new)
        group = components(links)
        placed = named.join(group, "node", "left").select(
            "sig", "node", "crowded", F.coalesce("comp", "node").alias("comp"), *ENTRY_COLUMNS)
    words_of = [f"f{i}" for i in range(FOLDED)]
    whole = sets.select("node", "n", F.lit(0).cast("long").alias("range"), F.col("n").alias("part"), *[
        reduce(lambda x, y: x.bitwiseXOR(y), map(F.col, PARITY_COLUMNS[i::FOLDED])).alias(f)
        for i, f in enumerate(words_of)])
    cut = sets.where("ranges IS NOT NULL").select("node", "n", "ranges", F.explode(F.sequence(
        F.lit(0), F.size("ranges") - 1, F.lit(FOLDED + 2))).alias("at")).select("node", "n", *[
            F.col("ranges")[F.col("at") + i].alias(c) for i, c in enumerate(["range", "part", *words_of])])
    mixed, drop_mixed = stored(placed.join(
        placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .where("lo < hi").select("sig"), "sig").join(whole.unionByName(cut), ["node", "range"]),
        "ngram-mixed")
    drop_named()
    rest = candidates(mixed, percent).distinct()
    more = judged(rest)
    drop_mixed()
    comp = components(links.unionByName(more))
    return (members.join(sets.select("h1", "h2", "node"), ["h1", "h2"], "left").join(comp, "node", "left")
            .select("doc_id", "n", "node", F.coalesce("comp", "node", "doc_id").alias("comp")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with three-word shingle sets of a Jaccard similarity of 0.9 or more."""
    docs = text_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    return jaccard_groups(docs, words=3, percent=90).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("comp") < NO_ID, F.col("comp")).alias("component_id"))
