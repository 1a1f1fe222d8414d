"""Conversation structure repair by min-plus transfer matrices over a Re-Pair grammar."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, cut_lineage, prepared, table

CHUNK_ROWS = 1024          # rows of a chunk, the unit that a long conversation is cut into
CHUNK_BYTES = 4 << 20      # text of a chunk after which it ends
ROUNDS = 8                 # Re-Pair rounds; what they leave is folded symbol by symbol
RULES_PER_ROUND = 48       # rules that a round adds
FIRST_RULE = 0x100         # code point of the first rule; symbols of turns are ASCII letters
SEEN_SEQUENCES = 100_000   # repaired sequences that a task remembers

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
FAR = 1 << 60              # cost of what cannot be

# The wanted order as an automaton: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ACCEPTED = (START, ASSISTANT)
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
        "a": {USER: ASSISTANT}}
NEXT_ROLE = {START: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}  # of an inserted or changed turn
ROLE_NAMES = {"u": "user", "a": "assistant"}
MUST_GO = "d"              # symbol of blank and repeated turns; others: s u a x, truncated S U A X
LEGAL = ("su", "ua", "au")
SPACE = "\t\n\x0b\x0c\r "  # what ends of texts are tested without
ENDS = ".!?"

CHUNK_FIELDS = ("seq string, roles array<string>, texts array<string>, blank long, duplicate long, "
                "truncated long, illegal long, head string, tail string, turns long, low long, "
                "high long")


class Matrix(NamedTuple):
    """Cheapest edits between states, row by row: entry ``4 * p + q``.

    ``rank`` orders a row's reachable entries by their audit strings. Strings of a row are
    never prefixes of each other (each ends with the edit of the last turn, and insertions
    come before turns), so what follows them never changes their order. ``rope`` says how
    an audit is spelled: by itself, or as the state in the middle of a rule's two halves.
    """

    cost: tuple[int, ...]
    rank: tuple[int, ...]
    rope: tuple


def _ranked(words: list) -> tuple[int, ...]:
    order = sorted(w for w in words if w is not None)
    return tuple(len(words) if w is None else order.index(w) for w in words)


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions, then the edit of one turn."""
    truncated, role = symbol.isupper(), symbol.lower()
    cost, rank, rope = [], [], []
    for p in STATES:
        best: dict[int, tuple[int, str]] = {}
        state, spent, audit = p, 0, ""
        for _ in range(3):  # two insertions reach every state
            ways = [(state, DELETE_COST, DELETE)]
            if symbol != MUST_GO:
                extra = TRUNCATED_COST * truncated
                if state in STEP.get(role, ()):
                    ways.append((STEP[role][state], KEEP_COST + extra, KEEP))
                ways.append((STEP[NEXT_ROLE[state]][state], REROLE_COST + extra, REROLE))
            for q, more, letter in ways:
                best[q] = min(best.get(q, (FAR, "")), (spent + more, audit + letter))
            state, spent, audit = STEP[NEXT_ROLE[state]][state], spent + INSERT_COST, audit + INSERT
        row = [best.get(q) for q in STATES]
        cost += [w[0] if w else FAR for w in row]
        rank += _ranked([w and w[1] for w in row])
        rope += [w[1] if w else None for w in row]
    return Matrix(tuple(cost), tuple(rank), tuple(rope))


def _row(cost: list[int], rank: list[int], then: Matrix) -> tuple[list[int], list[int], list]:
    """One row times a matrix: costs, ranks and the middle state of each entry."""
    out, via = [], []
    for q in STATES:
        least = min((cost[k] + then.cost[4 * k + q], rank[k], k) for k in STATES)
        out.append(min(least[0], FAR))
        via.append(least[2] if least[0] < FAR else None)
    keys = [None if k is None else (rank[k], then.rank[4 * k + q]) for q, k in enumerate(via)]
    return out, list(_ranked(keys)), via


def product(first: Matrix, then: Matrix) -> Matrix:
    cost, rank, rope = [], [], []
    for p in range(0, 16, 4):
        c, r, via = _row(list(first.cost[p:p + 4]), list(first.rank[p:p + 4]), then)
        cost += c
        rank += r
        rope += via
    return Matrix(tuple(cost), tuple(rank), tuple(rope))


class Grammar:
    """Rules ``pair of symbols -> symbol``, with the matrix and the ropes of each, bottom-up."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.matrices = {c: symbol_matrix(c) for c in "suaxSUAX" + MUST_GO}
        self.parts: dict[str, str] = {}
        for i, pair in enumerate(rules):
            self.parts[chr(FIRST_RULE + i)] = pair
            self.matrices[chr(FIRST_RULE + i)] = product(*(self.matrices[c] for c in pair))

    def compress(self, seq: str) -> str:
        for symbol, pair in self.parts.items():
            seq = seq.replace(pair, symbol)
        return seq

    def spell(self, path: Iterable[tuple[str, int, int]]) -> str:
        """The audit of ``symbol, entry, exit`` steps, along the ropes."""
        out, stack = [], list(path)[::-1]
        while stack:
            symbol, p, q = stack.pop()
            rope = self.matrices[symbol].rope[4 * p + q]
            if symbol in self.parts:
                left, right = self.parts[symbol]
                stack += [(right, rope, q), (left, p, rope)]
            else:
                out.append(rope)
        return "".join(out)

    def matrix(self, seq: str) -> Matrix | None:
        """Of a whole sequence; None for an empty one."""
        total = None
        for symbol in self.compress(seq):
            m = self.matrices[symbol]
            total = m if total is None else product(total, m)
        return total

    def walk(self, seq: str, entry: int, leave: int | None) -> tuple[int, str, str]:
        """Cost, audit and closing insertions of a sequence from ``entry`` to ``leave``.

        Without ``leave`` the sequence ends a conversation, and the best accepted end is taken.
        """
        cost = [0 if k == entry else FAR for k in STATES]
        rank = [0] * 4
        symbols, back = self.compress(seq), []
        for symbol in symbols:
            cost, rank, via = _row(cost, rank, self.matrices[symbol])
            back.append(via)
        total, closing = 0, ""
        if leave is None:
            total, leave, closing = finish(cost, rank)
        path, state = [], leave
        for symbol, via in zip(reversed(symbols), reversed(back)):
            path.append((symbol, via[state], state))
            state = via[state]
        return total, self.spell(reversed(path)), closing


def finish(cost: list[int], rank: list[int]) -> tuple[int, int, str]:
    """Cheapest way to an accepted end: cost, last state, insertions."""
    best = None
    for state in STATES:
        at, spent, closing = state, cost[state], ""
        for _ in range(2):
            if at in ACCEPTED:
                break
            at, spent, closing = STEP[NEXT_ROLE[at]][at], spent + INSERT_COST, closing + INSERT
        if at in ACCEPTED and cost[state] < FAR:
            best = min(best or (FAR,), (spent, rank[state], state, closing))
    return best[0], best[2], best[3]


def repaired_lines(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the turns that the edits leave, from a state on."""
    out, i = [], 0
    for letter in audit:
        if letter == DELETE:
            i += 1
            continue
        initial = roles[i][:1] if letter == KEEP else NEXT_ROLE[state]
        role = roles[i] if letter == KEEP else ROLE_NAMES[initial]
        out.append(f"{role}:{'' if letter == INSERT else texts[i]}")
        state = STEP[initial][state]
        i += letter != INSERT
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after the damage that crc32 of ``conv_id:turn`` asks
    for; dropped rows have no copies. NULLs, also in the hashed string, are one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), kind.alias("kind"),
        role.alias("role"), text.alias("text")).select(
        "conv_id", "turn",
        F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
        .alias("role"),
        F.when(F.col("kind") <= 1, "")
        .when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long")
        .alias("copies"))


def faulty(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, copies`` with ``fault`` and ``key``, equal rows as one.

    ``fault`` is that of the first copy: blank, duplicate (the same role and text at an earlier
    turn), truncated or none; further copies are duplicates unless blank. Only texts that a
    conversation has at two turns or more take part in the join behind it.
    """
    key = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"),
                         F.col("text")))
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    one = one.withColumn("key", key).withColumn("end", end)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = rows.where("copies > 0").withColumn("key", key).groupBy("conv_id", "key").agg(
        F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    later = again.select(F.col("conv_id").alias("of"), F.col("key").alias("same"), "first")
    joined = one.join(later, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("same")),
                      "left")
    fault = (F.when(F.col("end") == "", "blank")
             .when(F.col("first") < place, "duplicate")
             .when(F.locate(".", F.translate("end", ENDS, "...")) == 0, "truncated")
             .otherwise("none"))
    return joined.select("conv_id", "turn", "role", "text", "copies", "key", fault.alias("fault"))


class _Chunk:
    """Turns of one conversation that follow each other in one partition."""

    def __init__(self):
        self.symbols, self.roles, self.texts, self.size = [], [], [], 0
        self.counts = Counter()
        self.head = self.tail = self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str,
            new_turn: bool) -> None:
        initial = role[:1]
        for i in range(copies):
            kind = "duplicate" if i and fault != "blank" else fault
            self.counts[kind] += 1
            symbol = initial if initial in ("s", "u", "a") else "x"
            self.symbols.append(MUST_GO if kind in ("blank", "duplicate") else
                                symbol.upper() if kind == "truncated" else symbol)
            self.roles.append(role)
            self.texts.append("" if self.symbols[-1] == MUST_GO else text)
            if self.tail is not None and self.tail + initial not in LEGAL:
                self.counts["illegal"] += 1
            self.head, self.tail = initial if self.head is None else self.head, initial
        if copies and turn is not None:
            self.turns += new_turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.size += len(text)

    def full(self) -> bool:
        return len(self.symbols) >= CHUNK_ROWS or self.size >= CHUNK_BYTES

    def row(self) -> tuple:
        n = self.counts
        return ("".join(self.symbols), self.roles, self.texts, n["blank"], n["duplicate"],
                n["truncated"], n["illegal"], self.head, self.tail, self.turns, self.low, self.high)


def chunks(rows: DataFrame) -> DataFrame:
    """The turns in order, cut into chunks: ``conv_id, part, at, whole`` and ``CHUNK_FIELDS``.

    Rows are dealt by ranges of conversation and turn, so a long conversation lies in many
    partitions. ``whole``: the chunk certainly is its whole conversation.
    """
    kind = dict(rows.dtypes)["conv_id"]
    ordered = (rows.repartitionByRange("conv_id", "turn", "role", "key")
               .sortWithinPartitions("conv_id", "turn", "role", "key")
               .withColumn("part", F.spark_partition_id()))
    schema = f"conv_id {kind}, part int, at int, whole boolean, {CHUNK_FIELDS}"
    fields = _arrow_schema(rows.sparkSession, schema)
    names = ("conv_id", "turn", "role", "text", "copies", "fault", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chunk, part, at, cut, last_turn, out = None, None, 0, 0, False, None, []

        def done(inner: bool) -> None:
            nonlocal at
            out.append((conv, part, at, inner and not cut and conv_no > 0, *chunk.row()))
            at += 1

        conv_no = -1
        for batch in batches:
            for c, turn, role, text, copies, fault, part in zip(
                    *(batch.column(n).to_pylist() for n in names)):
                if chunk is None or c != conv:
                    if chunk is not None:
                        done(True)
                    conv, chunk, cut, last_turn = c, _Chunk(), False, None
                    conv_no += 1
                elif chunk.full():
                    cut = True
                    done(False)
                    chunk, last_turn = _Chunk(), None
                chunk.add(turn, role, text, copies, fault, turn != last_turn)
                last_turn = turn if copies else last_turn
            if out:
                yield _batch(out, fields)
                out = []
        if chunk is not None:
            done(False)
            yield _batch(out, fields)

    return cut_lineage(ordered.mapInArrow(run, schema), "turn-chunks")


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def learn_rules(cut: DataFrame) -> list[str]:
    """Re-Pair rules of all sequences: each round counts the adjacent pairs of all chunks, as the
    rules so far leave them, and makes rules of the most frequent ones.

    Equal sequences are counted once with their weight. A round brings at most
    ``RULES_PER_ROUND`` pairs to the driver; a pair that occurs once makes no rule.
    """
    weighted = cut_lineage(cut.where("seq <> ''").groupBy("seq").agg(F.count("*").alias("n")),
                           "turn-sequences")
    rules: list[str] = []
    for _ in range(ROUNDS):
        known = list(rules)

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grammar, counts = Grammar(known), Counter()
            for batch in batches:
                for seq, n in zip(batch.column("seq").to_pylist(), batch.column("n").to_pylist()):
                    short = grammar.compress(seq)
                    for i in range(len(short) - 1):
                        counts[short[i:i + 2]] += n
            if counts:
                yield pa.RecordBatch.from_pydict(
                    {"pair": list(counts), "n": list(counts.values())})

        top = weighted.mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(
            F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(
            RULES_PER_ROUND).collect()
        if not top:
            break
        rules += [r["pair"] for r in top]
    return rules


class _Solver:
    """Repairs whole conversations; equal sequences are solved once."""

    def __init__(self, rules: list[str]):
        self.grammar = Grammar(rules)
        self.known: dict[str, tuple[int, str]] = {}

    def solve(self, seq: str) -> tuple[int, str]:
        found = self.known.get(seq)
        if found is None:
            total, audit, closing = self.grammar.walk(seq, START, None)
            if len(self.known) >= SEEN_SEQUENCES:
                self.known.clear()
            found = self.known[seq] = total, audit + closing
        return found


def _result_schema(kind: str) -> str:
    return (f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, "
            "cost long, audit string, repaired_sha256 string")


def _solve_whole(whole: DataFrame, rules: list[str], kind: str) -> DataFrame:
    """Conversations of one chunk."""
    schema = _result_schema(kind)
    fields = _arrow_schema(whole.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = _Solver(rules)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cost, audit = solver.solve(r["seq"])
                text = "\n".join(repaired_lines(audit, START, r["roles"], r["texts"]))
                gaps = 0 if r["low"] is None else r["high"] - r["low"] + 1 - r["turns"]
                out.append((r["conv_id"], gaps, r["blank"], r["duplicate"], r["truncated"],
                            r["illegal"], cost, audit, _sha(text)))
            yield _batch(out, fields)

    return whole.mapInArrow(run, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows of sorted batches, with whether a row begins a new conversation."""
    last, begun = None, False
    for batch in batches:
        for r in batch.to_pylist():
            yield not begun or r["conv_id"] != last, r
            last, begun = r["conv_id"], True


def _solve_cut(edge: DataFrame, rules: list[str], kind: str) -> DataFrame:
    """Conversations that may consist of several chunks.

    One matrix per chunk; the matrices of a conversation stream through one task in order,
    32 numbers each, which leaves the states between chunks; each chunk is then
    spelled by itself, and its lines stream through the hash, which is sequential.
    """
    spark = edge.sparkSession
    schema = f"conv_id {kind}, part int, at int, cost array<long>, rank array<long>"
    fields = _arrow_schema(spark, schema)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                m = grammar.matrix(r["seq"])
                out.append((r["conv_id"], r["part"], r["at"], m and list(m.cost), m and list(m.rank)))
            yield _batch(out, fields)

    by_matrix = edge.select("conv_id", "part", "at", "seq").mapInArrow(matrices, schema)
    placed_schema = "part int, at int, enter int, leave int, closing string, cost long"
    placed_fields = _arrow_schema(spark, placed_schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple] = []  # part, at and the middle states of each chunk
        cost, rank = [0, FAR, FAR, FAR], [0] * 4

        def settle() -> pa.RecordBatch:
            total, state, closing = finish(cost, rank)
            out = []
            for i, (part, at, via) in enumerate(reversed(seen)):
                enter = state if via is None else via[state]
                out.append((part, at, enter, state, closing if i == 0 else "",
                            total if i == 0 else 0))
                state = enter
            return _batch(out, placed_fields)

        for new, r in _grouped(batches):
            if new and seen:
                yield settle()
                seen, cost, rank = [], [0, FAR, FAR, FAR], [0] * 4
            via = None
            if r["cost"] is not None:
                cost, rank, via = _row(cost, rank, Matrix(tuple(r["cost"]), tuple(r["rank"]), ()))
            seen.append((r["part"], r["at"], via))
        if seen:
            yield settle()

    placed = cut_lineage(
        by_matrix.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
        .mapInArrow(fold, placed_schema), "turn-states")
    kept = ["blank", "duplicate", "truncated", "illegal", "turns", "low", "high"]
    lines_schema = (f"conv_id {kind}, part int, at int, audit string, lines binary, n_lines long, "
                    "cost long, head string, tail string, "
                    + ", ".join(f"{c} long" for c in kept))
    lines_fields = _arrow_schema(spark, lines_schema)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                audit = grammar.walk(r["seq"], r["enter"], r["leave"])[1] + r["closing"]
                lines = repaired_lines(audit, r["enter"], r["roles"], r["texts"])
                out.append((r["conv_id"], r["part"], r["at"], audit,
                            "\n".join(lines).encode("utf-8", "surrogatepass"), len(lines),
                            r["cost"], r["head"], r["tail"], *(r[c] for c in kept)))
            yield _batch(out, lines_fields)

    spelled = edge.join(placed, ["part", "at"]).mapInArrow(spell, lines_schema)
    schema = _result_schema(kind)
    fields = _arrow_schema(spark, schema)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, begun = None, False

        def row() -> pa.RecordBatch:
            t = total
            gaps = 0 if t["low"] is None else t["high"] - t["low"] + 1 - t["turns"]
            return _batch([(t["conv_id"], gaps, t["blank"], t["duplicate"], t["truncated"],
                            t["illegal"], t["cost"], "".join(t["audit"]), t["sha"].hexdigest())],
                          fields)

        for new, r in _grouped(batches):
            if new:
                if total is not None:
                    yield row()
                total, begun = r | {"audit": [], "sha": hashlib.sha256()}, False
            else:
                if r["low"] is not None:
                    total["turns"] += r["turns"] - (r["low"] == total["high"])
                    total["low"] = r["low"] if total["low"] is None else total["low"]
                    total["high"] = r["high"]
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    total[c] += r[c]
                if r["head"] is not None and total["tail"] is not None:
                    total["illegal"] += total["tail"] + r["head"] not in LEGAL
                total["tail"] = total["tail"] if r["tail"] is None else r["tail"]
            total["audit"].append(r["audit"])
            if r["n_lines"]:
                total["sha"].update((b"\n" if begun else b"") + r["lines"])
                begun = True
        if total is not None:
            yield row()

    return spelled.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").mapInArrow(
        close, schema)


def repair(rows: DataFrame) -> DataFrame:
    """Structure faults and the cheapest repair of each conversation of ``conv_id, turn, role, text``.

    ``rows`` may carry ``copies`` (a row stands for so many; 0: the row is gone, but its
    conversation is known). Result: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256``. Turns are ordered by turn (NULL first), then role and text. Repeated
    rows are copies: all but the first are duplicates. NULL roles and texts count as one space;
    a NULL conv_id is a conversation of its own. A role is known by its first letter: s, u or a;
    others, empty ones included, can only be changed or deleted. Edits turn the roles into an
    optional system turn and pairs of user and assistant; of equally cheap audits the ASCII-least
    is taken. Conversations without rows get zeros, an empty audit and the hash of nothing. Extra
    columns take no part; an empty table gives no rows.
    """
    kind = dict(rows.dtypes)["conv_id"]
    cut = chunks(faulty(rows))
    rules = learn_rules(cut)
    return _solve_whole(cut.where("whole"), rules, kind).unionByName(
        _solve_cut(cut.where("NOT whole"), rules, kind))


def op13_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation after the stated damage."""
    prepared(spark)
    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows.select(*columns_of(["conv_id", "turn", "role", "text"]))))
