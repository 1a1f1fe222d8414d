"""SentencePiece encoding by the best total score, in parallel within giant documents."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers.models import Unigram

from .common import cut_lineage, table, text_columns

CHUNK = 1 << 15       # code points of a chunk; longer texts are giants
BLOCK = 64            # chunks whose matrices one task multiplies
CACHED_WORDS = 200_000  # bounds a Python worker's memory; a full cache starts again
SPACE = "▁"      # how pieces spell a space
NONE = -np.inf
ENCODED = "doc_id string, chunk int, start long, length long, n_tokens long, ids binary"


class Pieces:
    """The vocabulary of a model file with additive scores, and the best-path search.

    A text becomes a space mark, then the text with its spaces as marks. Of all ways to
    cut it into pieces the one with the largest sum of scores is its encoding; among equals, at each
    end the longest last piece. A character without a piece costs ten less than the worst piece and
    becomes its UTF-8 bytes. Scores are whole numbers in double precision: sums are exact.
    """

    def __init__(self, path: str):
        sp = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.vocab_size()) if not (
            sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.piece = {sp.id_to_piece(i): (i, float(sp.get_score(i))) for i in ids}
        self.unknown = min(s for _, s in self.piece.values()) - 10
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.spelled = {i: p.encode() for p, (i, _) in self.piece.items()}
        self.spelled |= {i: bytes([b]) for b, i in enumerate(self.byte)}
        self.longest = max(map(len, self.piece))
        # Score of each piece, and minus infinity for beginnings of pieces that are none themselves:
        # a search ends where no piece goes on.
        self.begins = {p[:k]: NONE for p in self.piece for k in range(1, len(p))}
        self.begins |= {p: score for p, (_, score) in self.piece.items()}
        # The score that each id adds: of an unknown character's bytes, the first has it.
        self.worth = np.zeros(sp.vocab_size())
        self.worth[ids] = [self.piece[sp.id_to_piece(i)][1] for i in ids]
        self.worth[[i for b, i in enumerate(self.byte) if not 0x80 <= b < 0xC0]] = self.unknown
        # The library's search of ``path`` for a stretch by itself: same scores, same choice among
        # equals. It would take the name of a byte or control piece in a text for that piece.
        names, least = [sp.id_to_piece(i) for i in range(sp.vocab_size())], self.unknown + 10
        self.search = Unigram([(p, self.piece[p][1] if p in self.piece else least) for p in names],
                              sp.unk_id(), True)
        self.names = sorted(set(names) - set(self.piece))
        self.marks = {name[0] for name in self.names}
        self.cache: dict[str, bytes] = {}
        # No piece crosses from another character into a space mark, or touches a line end: the
        # best path passes through these cuts. Checked, as it depends on the vocabulary.
        self.cuts = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1)
                            for p in self.piece)
        self.words = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if self.cuts else "(?s).+")

    def ids_of(self, piece: str) -> list[int]:
        known = self.piece.get(piece)
        return [known[0]] if known else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]

    def path(self, s: str, begin: list[float], stop: int) -> tuple[list[float], list[int]]:
        """Best scores at the positions of ``s``, and where the last piece begins (-1: it is an
        entry). ``begin``: scores of the entry positions 0, 1, …; pieces begin before ``stop``."""
        best, back = [NONE] * (len(s) + 1), [-1] * (len(s) + 1)
        best[:len(begin)] = begin
        begins, n, unknown = self.begins, len(s), self.unknown
        for p in range(stop):
            here = best[p]
            if here == NONE:
                continue
            single, end = False, p + 1
            while end <= n and (score := begins.get(s[p:end])) is not None:
                if score > NONE:
                    single |= end == p + 1
                    if here + score > best[end]:
                        best[end], back[end] = here + score, p
                end += 1
            if not single and here + unknown > best[p + 1]:
                best[p + 1], back[p + 1] = here + unknown, p
        return best, back

    def trace(self, s: str, back: list[int], end: int) -> tuple[int, bytes]:
        """The entry position of the best path to ``end``, and the path's ids."""
        cuts = [end]
        while back[cuts[-1]] >= 0:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        return cuts[0], _bytes([i for a, b in zip(cuts, cuts[1:]) for i in self.ids_of(s[a:b])])

    def word(self, w: str) -> bytes:
        """Ids of a stretch between cuts."""
        if (known := self.cache.get(w)) is None:
            known = self._search(w)
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            if len(w) <= 64:
                self.cache[w] = known
        return known

    def _search(self, w: str) -> bytes:
        if self.marks.isdisjoint(w) or not any(name in w for name in self.names):
            try:
                return _bytes([t.id for t in self.search.tokenize(w)])
            except UnicodeEncodeError:  # half of a surrogate pair
                pass
        return self.trace(w, self.path(w, [0.0], len(w))[1], len(w))[1]

    def encode(self, normal: str) -> bytes:
        return b"".join(map(self.word, self.words.findall(normal)))

    def score(self, ids: bytes) -> float:
        return float(self.worth[np.frombuffer(ids, "<u4")].sum())

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text, with spaces again; the leading mark of a document is a space here."""
        found = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.spelled.__getitem__, found)).replace(SPACE.encode(), b" ")

    def borders(self, s: str, size: int) -> tuple[int, int] | None:
        """First and last cut of a chunk that all its paths pass, behind all its entry states."""
        if not self.cuts:
            return None
        cut = re.compile(f"(?<=[^{SPACE}]){SPACE}|\n|(?<=\n)[^{SPACE}\n]")
        first = cut.search(s, min(self.longest - 1, size))
        if first is None or first.start() > size:
            return None
        last = first.start()
        for at in range(size, max(last, size - 512), -1):
            if cut.match(s, at):
                return first.start(), at
        return first.start(), last

    def transfer(self, s: str, size: int) -> np.ndarray:
        """Best score from entry state i (offset of the first piece in the chunk) to exit state j.

        ``s``: the chunk of ``size`` characters and what follows, up to the longest piece.
        """
        wide = self.longest
        out = np.full((wide, wide), NONE)
        marks = self.borders(s, size)
        if marks:
            first, last = marks
            middle = self.score(self.encode(s[first:last]))
            tail = self.path(s[last:], [0.0], size - last)[0]
            ends = np.array((tail[size - last:] + [NONE] * wide)[:wide])
        for i in range(min(wide, len(s) + 1)):
            begin = [NONE] * i + [0.0]
            if marks:
                head = self.path(s[:first], begin, first)[0][first]
                out[i] = head + middle + ends
            else:
                best = self.path(s, begin, size)[0]
                row = (best[size:] + [NONE] * wide)[:wide]
                out[i] = row
        return out

    def backtrace(self, s: str, size: int, entry: list[float]) -> list[tuple[int, bytes] | None]:
        """For each exit state the entry state and the ids of the best path, given the best scores
        of the entry states over all that precedes."""
        wide = self.longest
        marks = self.borders(s, size)
        head, shift = b"", 0
        start: int | None = None
        if marks:
            first, last = marks
            _, back = self.path(s[:first], entry[:first + 1], first)
            start, head = self.trace(s, back, first)
            head += self.encode(s[first:last])
            s, size, shift, entry = s[last:], size - last, last, [0.0]
        best, back = self.path(s, entry[:len(s) + 1], size)
        found: list[tuple[int, bytes] | None] = []
        for j in range(wide):
            if size + j > len(s) or best[size + j] == NONE:
                found.append(None)
                continue
            own, ids = self.trace(s, back, size + j)
            found.append((own if start is None else start, head + ids))
        return found


@lru_cache(1)
def pieces_at(path: str) -> Pieces:
    """One for all tasks of a Python worker, with the words that it has seen."""
    return Pieces(path)


def _bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus matrix product; associative."""
    return (left[:, :, None] + right[None]).max(1)


def encode_ordinary(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_at(path)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                text = text or ""
                normal = SPACE + text.replace(" ", SPACE) if text else ""
                ids = pieces.encode(normal)
                rows.append((doc_id, 0, 0, len(normal), len(ids) // 4, ids))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENCODED.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(run, ENCODED)


def encode_giants(docs: DataFrame, path: str, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Encode long texts chunk by chunk; equal texts once.

    1. Each chunk's transfer matrix between its boundary states (how far a piece reaches over
       the boundary). 2. Matrices of a block of chunks are multiplied, and the products of a
       document's blocks scanned, which yields the best scores of the states at every boundary; a
       document has at most 2^31 characters, so ``2^31 / (chunk * block)`` products. 3. Each chunk
       maps exit states to entry states; the maps are composed from the end in the same two
       levels. 4. Each chunk's path is then fixed, independently of the others.
    """
    wide = pieces_at(path).longest
    texts = docs.select(F.sha2("text", 256).alias("text_key"), "text").dropDuplicates(["text_key"])
    normal = F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE)))
    chunks = cut_lineage(texts.select("text_key", normal.alias("s")).select(
        "text_key", "s", F.char_length("s").alias("n"),
        F.explode(F.sequence(F.lit(0), F.floor((F.char_length("s") - 1) / chunk))).alias("chunk")
    ).select("text_key", F.col("chunk").cast("int").alias("chunk"),
             F.least(F.lit(chunk), F.col("n") - F.col("chunk") * chunk).cast("int").alias("size"),
             F.expr(f"substring(s, CAST(chunk * {chunk} + 1 AS INT), {chunk + wide - 1})").alias("s"))
        .repartition("text_key", "chunk"), "pieces-chunks")

    def matrices(batches):
        pieces = pieces_at(path)
        for pdf in batches:
            yield pd.DataFrame({"text_key": pdf["text_key"], "chunk": pdf["chunk"], "m": [
                pieces.transfer(s, n).tobytes() for s, n in zip(pdf["s"], pdf["size"])]})

    def matrix(b):
        return np.frombuffer(b, np.float64).reshape(wide, wide)

    steps = cut_lineage(chunks.mapInPandas(matrices, "text_key string, chunk int, m binary")
                        .withColumn("block", F.expr(f"chunk DIV {block}").cast("int")), "pieces-steps")

    def multiply(key, pdf):
        out = None
        for m in pdf.sort_values("chunk")["m"]:
            out = matrix(m) if out is None else product(out, matrix(m))
        return pd.DataFrame({"text_key": [key[0]], "block": [key[1]], "m": [out.tobytes()]})

    def scan(key, pdf):
        pdf, state, rows = pdf.sort_values("block"), np.full(wide, NONE), []
        state[0] = 0.0
        for b, m in zip(pdf["block"], pdf["m"]):
            rows.append((key[0], b, state.tobytes()))
            state = (state[:, None] + matrix(m)).max(0)
        return pd.DataFrame(rows, columns=["text_key", "block", "state"])

    begins = steps.groupBy("text_key", "block").applyInPandas(
        multiply, "text_key string, block int, m binary").groupBy("text_key").applyInPandas(
        scan, "text_key string, block int, state binary")

    def within(key, steps_pdf, state_pdf):
        state, rows = np.frombuffer(state_pdf["state"].iloc[0], np.float64), []
        for c, m in steps_pdf.sort_values("chunk")[["chunk", "m"]].itertuples(index=False):
            rows.append((key[0], c, state.tobytes()))
            state = (state[:, None] + matrix(m)).max(0)
        return pd.DataFrame(rows, columns=["text_key", "chunk", "state"])

    states = steps.groupBy("text_key", "block").cogroup(
        begins.groupBy("text_key", "block")).applyInPandas(
        within, "text_key string, chunk int, state binary")

    def paths(batches):
        pieces = pieces_at(path)
        for pdf in batches:
            rows = []
            for key, c, n, s, state in pdf[["text_key", "chunk", "size", "s", "state"]].itertuples(
                    index=False):
                found = pieces.backtrace(s, n, np.frombuffer(state, np.float64).tolist())
                rows.append((key, c, n, [-1 if x is None else x[0] for x in found],
                             [b"" if x is None else x[1] for x in found]))
            yield pd.DataFrame(rows, columns=["text_key", "chunk", "size", "entry", "ids"])

    # Exits that no path takes keep an empty list; the others share most of their ids, and
    # compress.
    traced = cut_lineage(chunks.join(states, ["text_key", "chunk"]).mapInPandas(
        paths, "text_key string, chunk int, size int, entry array<int>, ids array<binary>")
        .withColumn("block", F.expr(f"chunk DIV {block}").cast("int")), "pieces-paths")
    maps = traced.select("text_key", "block", "chunk", "entry")

    def compose(key, pdf):
        out = np.arange(wide)
        for e in pdf.sort_values("chunk", ascending=False)["entry"]:
            out = np.where(out >= 0, np.asarray(e)[out], -1)
        return pd.DataFrame({"text_key": [key[0]], "block": [key[1]], "entry": [out.tolist()]})

    def back(key, pdf):
        pdf, state, rows = pdf.sort_values("block", ascending=False), 0, []
        for b, e in zip(pdf["block"], pdf["entry"]):
            rows.append((key[0], b, state))
            state = int(e[state])
        return pd.DataFrame(rows, columns=["text_key", "block", "state"])

    ends = maps.groupBy("text_key", "block").applyInPandas(
        compose, "text_key string, block int, entry array<int>").groupBy("text_key").applyInPandas(
        back, "text_key string, block int, state int")

    def exits(key, maps_pdf, state_pdf):
        state, rows = int(state_pdf["state"].iloc[0]), []
        for c, e in maps_pdf.sort_values("chunk", ascending=False)[["chunk", "entry"]].itertuples(
                index=False):
            rows.append((key[0], c, state))
            state = int(e[state])
        return pd.DataFrame(rows, columns=["text_key", "chunk", "exit"])

    chosen = maps.groupBy("text_key", "block").cogroup(ends.groupBy("text_key", "block")).applyInPandas(
        exits, "text_key string, chunk int, exit int")
    done = traced.join(chosen, ["text_key", "chunk"]).select(
        "text_key", "chunk", "size", F.col("entry")[F.col("exit")].alias("entry"), "exit",
        F.col("ids")[F.col("exit")].alias("ids"))
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("text_key"))
    return keyed.join(done, "text_key").select(
        "doc_id", "chunk", (F.col("chunk").cast("long") * chunk + F.col("entry")).alias("start"),
        (F.col("size") + F.col("exit") - F.col("entry")).cast("long").alias("length"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """``doc_id`` (as text), ``chunk``, ``start``, ``length``, ``n_tokens``, ``ids``.

    A row per document, with chunk 0; per chunk for those of more than ``chunk`` code points.
    ``ids`` are little-endian unsigned 32-bit integers, ``start`` and ``length`` count code points
    of the text with its leading mark. NULL and empty texts have no ids. Rows with NULL or
    repeated doc_ids are encoded each; other columns take no part; no rows give none.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    giant = F.coalesce(F.char_length("text") >= chunk, F.lit(False))
    return encode_ordinary(docs.where(~giant), path).unionByName(
        encode_giants(docs.where(giant), path, chunk))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the ``text`` that its ids spell (a document's first mark is a space)."""
    schema = ", ".join(f"{n} {t}" for n, t in encoded.dtypes) + ", text binary"

    def run(batches):
        pieces = pieces_at(path)
        for pdf in batches:
            yield pdf.assign(text=[pieces.decode(bytes(i)) for i in pdf["ids"]])

    return encoded.mapInPandas(run, schema)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: digests of ids and of the decoded text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = text_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    return decode(encode(docs, path), path).select(
        F.col("doc_id").cast("long").alias("doc_id"), "chunk", "start", "length", "n_tokens",
        F.crc32("ids").alias("ids_crc32"), F.crc32("text").alias("text_crc32"))
