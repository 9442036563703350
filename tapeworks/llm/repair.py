"""Conversation structure repair by a dynamic program over a grammar.

A conversation is a sequence of symbols, a role and a fault each. Re-Pair turns frequent pairs of
symbols, of all conversations together, into new symbols. What a symbol does to the state of the
role grammar is a 4 x 4 matrix of least costs: those of the few terminals are written down, that
of a rule is the min-plus product of its two halves, made once and used by every conversation.

Among edits of equal cost the least audit string counts. An entry's string is a rope: the state
in which its two halves meet. Every string of a symbol ends with the letter of its last row and
has one such letter for each row, so of two strings of a symbol neither begins the other, and
joined strings compare as their halves do. So an entry needs its string's rank among the
symbol's, and no string is written out until the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._order import running_before
from tapeworks.llm._rows import partitions
from tapeworks.session import materialize

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
ROUNDS, RULES_PER_ROUND = 10, 64
#: Rows of a conversation that are one sequence; longer conversations are several.
RUN_BITS = 10
_BLANK = r"[^\x20\x09-\x0D]"
_SPACES = " \t\n\x0b\x0c\r"
_NEVER = 1 << 40

# states of (s?(ua)+)?: nothing yet, after s, after u, after a
START, S, U, A = range(4)
CLASSES, STATES = "suao", 4
#: Insertions that lead from a state to another, by the initials of the inserted roles.
INSERTS = {(START, U): "u", (START, A): "ua", (S, U): "u", (S, A): "ua", (U, A): "a", (A, U): "u"} | {(q, q): "" for q in range(STATES)}
TAILS = {START: "", S: "ua", U: "a", A: ""}
ROLES = {"u": "user", "a": "assistant"}


# --- terminals ----------------------------------------------------------------------------------

def symbol(role: str, mark: str) -> int:
    """0 for a row that has to go, else one for each role class and whether it is truncated."""
    return 0 if mark in "bd" else 1 + 2 * CLASSES.index(role) + (mark == "t")


TERMINALS = 1 + 2 * len(CLASSES)


def row_edits(sym: int) -> dict[tuple[int, int], tuple[int, str]]:
    """What may be done to a row: {(state before, state after): (cost, letter)}."""
    out = {(q, q): (DELETE, "D") for q in range(STATES)}
    if not sym:
        return out
    kind, extra = CLASSES[(sym - 1) // 2], TRUNCATED * ((sym - 1) % 2)
    for q in range(STATES):
        for to, role in ((U, "u"), (A, "a")):
            if (to == A) == (q == U):
                out[q, to] = (extra, "K") if kind == role else (REROLE + extra, "R")
    if kind == "s":
        out[START, S] = (extra, "K")
    return out


def _terminal(sym: int) -> dict[tuple[int, int], tuple[int, str, str]]:
    """{(before, after): (cost, audit, inserted roles)}, insertions before the row included."""
    best: dict[tuple[int, int], tuple[int, str, str]] = {}
    for (p, q), put in INSERTS.items():
        for (q2, r), (cost, letter) in row_edits(sym).items():
            if q2 == q:
                way = (cost + INSERT * len(put), "I" * len(put) + letter, put)
                best[p, r] = min(best.get((p, r), way), way)
    return best


TERMINAL = [_terminal(s) for s in range(TERMINALS)]


def _ranks(keys: list) -> list[int]:
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    return [place[k] for k in keys]


# --- grammar ------------------------------------------------------------------------------------

@dataclass
class Grammar:
    """Rules in the order they were made, and each symbol's matrices: cost, rank of the audit, and
    for rules the state between the halves. At most ROUNDS * RULES_PER_ROUND rules."""

    rules: list[tuple[int, int]] = field(default_factory=list)
    cost: list[np.ndarray] = field(default_factory=list)
    rank: list[np.ndarray] = field(default_factory=list)
    mid: list[np.ndarray | None] = field(default_factory=list)

    def __post_init__(self):
        for t in TERMINAL:
            cost, rank = np.full((STATES, STATES), _NEVER), np.zeros((STATES, STATES), np.int64)
            ranks = _ranks([a for _, a, _ in t.values()])
            for (pr, (c, _, _)), k in zip(t.items(), ranks):
                cost[pr], rank[pr] = c, k
            self.cost.append(cost)
            self.rank.append(rank)
            self.mid.append(None)

    def add(self, left: int, right: int) -> int:
        """The symbol of a new rule, its matrix the product of its halves'."""
        cost, rank, mid = product(self.cost[left], self.rank[left], self.cost[right], self.rank[right])
        self.rules.append((left, right))
        self.cost.append(cost)
        self.rank.append(rank)
        self.mid.append(mid)
        return TERMINALS + len(self.rules) - 1

    def parse(self, symbols: np.ndarray, first: int = 0) -> np.ndarray:
        """Rewrite a sequence (several, parted by -1) by the rules from number `first` on."""
        for k, (a, b) in enumerate(self.rules[first:], first):
            hit = np.flatnonzero((symbols[:-1] == a) & (symbols[1:] == b))
            if not len(hit):
                continue
            if a == b:  # in a run of equal symbols every second place
                new = np.concatenate([[True], np.diff(hit) > 1])
                at = np.arange(len(hit))
                hit = hit[(at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0]
            symbols[hit] = TERMINALS + k
            symbols = np.delete(symbols, hit + 1)
        return symbols

    def matrix(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Cost and rank of a parsed sequence, and the states between its symbols."""
        cost, rank, mids = self.cost[symbols[0]], self.rank[symbols[0]], []
        for s in symbols[1:]:
            cost, rank, mid = product(cost, rank, self.cost[s], self.rank[s])
            mids.append(mid)
        return cost, rank, mids

    def edits(self, symbols: np.ndarray, mids: list, begin: int, end: int) -> list[tuple[str, str, int]]:
        """Per row the inserted roles before it, its letter and the state after it, by descent into the ropes."""
        parts = []
        for s, mid in zip(symbols[:0:-1], mids[::-1]):
            between = int(mid[begin, end])
            parts.append((int(s), between, end))
            end = between
        out, stack = [], [*parts, (int(symbols[0]), begin, end)]
        while stack:
            s, p, r = stack.pop()
            if s < TERMINALS:
                _, audit, put = TERMINAL[s][p, r]
                out.append((put, audit[-1], r))
            else:
                left, right = self.rules[s - TERMINALS]
                q = int(self.mid[s][p, r])
                stack += [(right, q, r), (left, p, q)]
        return out


def product(cost_a, rank_a, cost_b, rank_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Min-plus product of two matrices; equal costs go to the lesser pair of ranks."""
    wide = int(rank_b.max()) + 1
    cost = cost_a[:, :, None] + cost_b[None]
    rank = rank_a[:, :, None] * wide + rank_b[None]
    least = cost.min(1)
    rank = np.where(cost == least[:, None], rank, np.iinfo(np.int64).max)
    mid, best = rank.argmin(1), rank.min(1)
    open_ = least < _NEVER
    dense = np.zeros((STATES, STATES), np.int64)
    dense[open_] = np.unique(best[open_], return_inverse=True)[1]
    return np.where(open_, least, _NEVER), dense, mid


def learn(sequences: DataFrame, rounds: int = ROUNDS, per_round: int = RULES_PER_ROUND) -> Grammar:
    """Re-Pair in batches over (symbols array<int>): each round makes rules of the most frequent
    pairs, the most frequent first, and rewrites the sequences with them.

    Counts are combined before the shuffle; at most per_round pairs come to the driver. Rules
    only shorten the work: a sequence that keeps many symbols is multiplied out one by one.
    """
    grammar = Grammar()
    for _ in range(rounds):
        n = F.size("symbols")
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(
            F.element_at("symbols", i).alias("a"), F.element_at("symbols", i + 1).alias("b"))))
        counted = sequences.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").count().where("count > 1")
        top = counted.orderBy(F.desc("count"), "a", "b").limit(per_round).collect()
        if not top:
            break
        first = len(grammar.rules)
        for r in top:
            grammar.add(r["a"], r["b"])
        sequences = materialize(sequences.mapInArrow(_rewriter(grammar, first), "symbols array<int>"), "repair-sequences")
    return grammar


def _rewriter(grammar: Grammar, first: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([_parsed(grammar, batch.column("symbols"), first)], ["symbols"])

    return run


def _parsed(grammar: Grammar, lists: pa.Array, first: int = 0) -> pa.ListArray:
    """All sequences of a batch rewritten at once, a border before each."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    flat = grammar.parse(np.insert(flat, at[:-1], -1), first)
    border = np.flatnonzero(flat == -1)
    ends = np.concatenate([border, [len(flat)]]) - np.arange(len(border) + 1)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[flat >= 0], pa.int32()))


# --- rows ---------------------------------------------------------------------------------------

def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(convs: DataFrame) -> DataFrame:
    """The test damage: by crc32 of `conv_id:turn` modulo 20 a row is dropped, emptied, robbed of its
    end marks, repeated, or given to the user. Nulls count as one space in that key and in role and text."""
    kind = F.pmod(F.crc32(F.concat(_text(convs["conv_id"]), F.lit(":"), _text(convs["turn"])).cast("binary")), F.lit(20))
    d = convs.select("conv_id", "turn", _text(convs["role"]).alias("role"), _text(convs["text"]).alias("text"), kind.alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _keyed(convs: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, h): h stands for the text."""
    c = convs.select(convs[conv_col].alias("conv"), convs[turn_col].cast("long").alias("turn"), _text(convs[role_col]).alias("role"), _text(convs[text_col]).alias("text"))
    return c.withColumn("h", F.unhex(F.sha2("text", 256)))


_ORDER = ["conv", "turn", "role", "h"]


def _sequences(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows in order without texts, (seq, conv, turn, role, h, cls, mark); and the runs of
    conversations as strings, (conv, run, first, roles, marks)."""
    last = F.right(F.rtrim(F.col("text"), F.lit(_SPACES)), F.lit(1))
    initial = F.substring("role", 1, 1)
    cls = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    mark = F.when(~F.col("text").rlike(_BLANK), "b").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    dup = F.unhex(F.sha2(F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.length("role"), F.lit(":"), "role", F.hex("h")), 256))
    slim = keyed.select(*_ORDER, cls.alias("cls"), mark.alias("mark"), dup.alias("dup"))
    ranged = slim.repartitionByRange(partitions(keyed.sparkSession), *_ORDER).sortWithinPartitions(*_ORDER)
    rows = materialize(ranged.withColumn("seq", F.monotonically_increasing_id()), "repair-rows")
    seen = running_before(rows.select("conv", "seq", "cls", "mark", "dup"), ["seq"], {"earlier": F.lit(1)}, "dup")
    full = F.when((F.col("earlier") > 0) & (F.col("mark") != "b"), "d").otherwise(F.col("mark"))
    of_run = F.sort_array(F.collect_list(F.struct("seq", "cls", "m")))
    runs = seen.withColumn("m", full).groupBy("conv", F.shiftright("seq", RUN_BITS).alias("run")).agg(of_run.alias("rows"))
    joined = lambda c: F.array_join(F.transform("rows", lambda x: x[c]), "")
    return rows, materialize(runs.select("conv", "run", F.col("rows")[0]["seq"].alias("first"), joined("cls").alias("roles"), joined("m").alias("marks")), "repair-runs")


def _symbols() -> Column:
    """The symbols of a run, from its roles and marks."""
    at = F.sequence(F.lit(1), F.length("roles"))
    kind = lambda i: F.instr(F.lit(CLASSES), F.substring(F.col("roles"), i, F.lit(1)))
    mark = lambda i: F.substring(F.col("marks"), i, F.lit(1))
    return F.transform(at, lambda i: F.when(mark(i).isin("b", "d"), 0).otherwise(2 * kind(i) - 1 + F.when(mark(i) == "t", 1).otherwise(0)).cast("int"))


_PLANNED = ("conv {conv}, first long, is_last boolean, n int, blank long, duplicate long, truncated long, illegal long, cost long, "
            "audit string, ops array<string>, roles_after array<string>, puts array<string>, tail string")
_LEGAL = {"su", "ua", "au"}


def _planner(grammar: Grammar):
    """Over runs sorted by conversation: compose the matrices of a conversation's runs, choose the
    way through, and write out each run's edits."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, ready = [], None, []
        for batch in source:
            parsed = _parsed(grammar, batch.column("symbols")).to_pylist()
            rows = zip(batch.column("conv").to_pylist(), batch.column("first").to_pylist(), batch.column("roles").to_pylist(), batch.column("marks").to_pylist(), parsed)
            kind = batch.schema.field("conv").type
            for conv, first, roles, marks, symbols in rows:
                if held and key != (conv,):
                    ready.append((key[0], held))
                    held = []
                    if len(ready) >= 5000:
                        yield from packed(ready, kind)
                        ready = []
                key = (conv,)
                held.append((first, roles, marks, symbols))
        if held:
            yield from packed([*ready, (key[0], held)], kind)

    def packed(ready: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for conv, held in ready:
            for row in _planned(grammar, conv, held, known):
                out.append(row)
                n += row[3]
                if n >= 50_000:
                    yield pack(out, kind)
                    out, n = [], 0
        if out:
            yield pack(out, kind)

    known: dict[bytes, tuple] = {}

    def pack(rows: list, conv: pa.DataType) -> pa.RecordBatch:
        names = [c.split()[0] for c in _PLANNED.split(", ")]
        words = pa.list_(pa.string())
        kinds = [conv, pa.int64(), pa.bool_(), pa.int32(), *[pa.int64()] * 5, pa.string(), words, words, words, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _planned(grammar: Grammar, conv, runs: list, known: dict) -> Iterator[tuple]:
    """The planned runs of one conversation. Of each run only its matrix takes part in the choice."""
    maps = []
    for _, _, _, symbols in runs:
        code = np.array(symbols, np.int32).tobytes()
        if code not in known:
            if len(known) > 20_000:
                known.clear()
            known[code] = grammar.matrix(np.array(symbols))
        maps.append(known[code])
    # the way from the start: cost, rank of the audit so far, and where each state came from
    cost, rank, came = maps[0][0][START], maps[0][1][START], []
    for c, r, _ in maps[1:]:
        to_cost, to_rank, mid = product(np.broadcast_to(cost, (STATES, STATES)), np.broadcast_to(rank, (STATES, STATES)), c, r)
        cost, rank = to_cost[0], to_rank[0]
        came.append(mid[0])
    total = [(int(cost[q]) + INSERT * len(TAILS[q]), int(rank[q]), TAILS[q], q) for q in range(STATES) if cost[q] < _NEVER]
    least, _, tail, end = min(total)
    ends = [end]
    for mid in reversed(came):
        ends.append(int(mid[ends[-1]]))
    ends.reverse()
    before, border = START, ""
    for k, ((first, roles, marks, symbols), (_, _, mids), after) in enumerate(zip(runs, maps, ends)):
        last = k == len(runs) - 1
        edits = grammar.edits(np.array(symbols), mids, before, after)
        put_tail = tail if last else ""
        audit = "".join("I" * len(p) + x for p, x, _ in edits) + "I" * len(put_tail)
        pairs = border + roles
        illegal = sum(pairs[i:i + 2] not in _LEGAL for i in range(len(pairs) - 1))
        yield (conv, first, last, len(roles), marks.count("b"), marks.count("d"), marks.count("t"), illegal, least if last else 0, audit,
                    [x for _, x, _ in edits], ["-sua"[q] for _, _, q in edits], [p for p, _, _ in edits], put_tail)
        before, border = after, roles[-1]


@dataclass(frozen=True)
class Plan:
    """The keyed rows, the ordered rows without texts, and the planned runs."""

    keyed: DataFrame
    rows: DataFrame
    runs: DataFrame


def plan(convs: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
         rounds: int = ROUNDS, per_round: int = RULES_PER_ROUND) -> Plan:
    """The cheapest edits that give every conversation's role initials the form (s?(ua)+)?.

    Rows follow the turn (null first), then role and a hash of the text. A row's first fault
    counts: blank, duplicate (role and text seen earlier), truncated. Keeping is free; a new
    role, user or assistant, costs 1, a deletion 2, an inserted empty turn 5, a truncated row
    that stays 5; blank and duplicate rows have to go. Null roles and texts count as one space,
    a null conversation id is a conversation; a role is known by its first letter, and an empty
    one by none. Other columns are ignored; an empty table gives no rows.

    Ranges of (conversation, turn) become tasks, and a run of at most 2^RUN_BITS rows one
    sequence, so a conversation of any length is spread; of its runs a short matrix and the
    symbols, a byte a row, meet.
    """
    keyed = _keyed(convs, conv_col, turn_col, role_col, text_col)
    rows, runs = _sequences(keyed)
    runs = runs.withColumn("symbols", _symbols())
    grammar = learn(runs.select("symbols").distinct(), rounds, per_round)
    kind = rows.schema["conv"].dataType.simpleString()
    dealt = runs.repartition(partitions(convs.sparkSession), "conv").sortWithinPartitions("conv", "run")
    planned = dealt.select("conv", "first", "roles", "marks", "symbols").mapInArrow(_planner(grammar), _PLANNED.format(conv=kind))
    return Plan(keyed, rows, materialize(planned, "repair-plan"))


def summary(made: Plan) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    t = F.col("turn")
    turns = made.rows.groupBy("conv").agg(F.coalesce(F.max(t) - F.min(t) + 1 - F.countDistinct(t), F.lit(0)).alias("gaps"))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "audit"))), lambda x: x["audit"]), "").alias("audit")
    per = made.runs.groupBy("conv").agg(*sums, audit).withColumnRenamed("conv", "c")
    return turns.join(per, F.col("conv").eqNullSafe(F.col("c"))).drop("c")


def _live(made: Plan) -> DataFrame:
    """The edits of rows that stay or have insertions before them, and of conversations' ends:
    (conv, at_end, turn, role, h, seq, puts, stays, new_role)."""
    e = made.runs.select("first", F.posexplode(F.arrays_zip("ops", "roles_after", "puts")).alias("i", "e"))
    e = e.select((F.col("first") + F.col("i")).alias("seq"), F.col("e.ops").alias("op"), F.col("e.roles_after").alias("after"), F.col("e.puts").alias("puts"))
    new = F.when(F.col("op") == "R", F.when(F.col("after") == "u", "user").otherwise("assistant"))
    e = e.where("op <> 'D' or puts <> ''").select("seq", "puts", (F.col("op") != "D").alias("stays"), new.alias("new_role"))
    edits = made.rows.select("seq", *_ORDER).join(e, "seq").select("conv", F.lit(False).alias("at_end"), "turn", "role", "h", "seq", "puts", "stays", "new_role")
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    ends = made.runs.where("is_last and tail <> ''").select(
        "conv", F.lit(True).alias("at_end"), null("turn", "long"), null("role", "string"), null("h", "binary"), (F.col("first") + F.col("n")).alias("seq"),
        F.col("tail").alias("puts"), F.lit(False).alias("stays"), null("new_role", "string"))
    return edits.unionByName(ends)


def repaired(made: Plan, by: list[str] | None = None) -> DataFrame:
    """(conv, place, turn, role, text): the rows of the repaired conversations; place is their
    order. Inserted rows have no turn and an empty text.

    Edits and texts meet in one sorted shuffle, an edit just before the text it is about; of
    equal rows only the first can stay, so the first text after an edit is its own. Tasks stream.
    `by` names the columns that deal the rows out (default: rows of one turn together).
    """
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    texts = made.keyed.select("conv", F.lit(False).alias("at_end"), "turn", "role", "h", null("seq", "long"), null("puts", "string"), null("stays", "boolean"), null("new_role", "string"), "text")
    both = _live(made).withColumn("text", F.lit(None).cast("string")).unionByName(texts)
    both = both.withColumn("is_text", F.col("seq").isNull())
    order = ["conv", "at_end", "turn", "role", "h", "is_text", "seq"]
    dealt = both.repartition(partitions(made.rows.sparkSession), *(by or ["conv", "at_end", "turn"])).sortWithinPartitions(*order)
    conv = made.rows.schema["conv"].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits = None
        for batch in source:
            col = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            out = []
            for k, is_text in enumerate(col["is_text"]):
                own = (col["conv"][k], col["turn"][k], col["role"][k], col["h"][k])
                if is_text:
                    if waits and waits[0] == own:
                        out.append((own[0], waits[1] << 2 | 3, own[1], waits[2] or own[2], col["text"][k]))
                        waits = None
                    continue
                seq = col["seq"][k]
                out += [(own[0], seq << 2 | i, None, ROLES[x], "") for i, x in enumerate(col["puts"][k])]
                if col["stays"][k]:
                    waits = (own, seq, col["new_role"][k])
            kinds = [batch.schema.field("conv").type, pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["conv", "place", "turn", "role", "text"])

    return dealt.mapInArrow(run, f"conv {conv}, place long, turn long, role string, text string")


def hashes(made: Plan) -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of a conversation's repaired `role:text`, newline-joined.

    A hash is taken in order, so a conversation goes through one task, which streams its rows.
    """
    conv = made.rows.schema["conv"].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        key, state, kind = None, None, pa.int64()
        for batch in source:
            kind, done = batch.schema.field("conv").type, []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text"))):
                if key != (c,):
                    if key:
                        done.append((key[0], state.hexdigest()))
                    key, state = (c,), sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], ["conv", "repaired_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], kind), pa.array([state.hexdigest()])], ["conv", "repaired_sha256"])

    return repaired(made, ["conv"]).mapInArrow(run, f"conv {conv}, repaired_sha256 string")


_NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of the empty string


def digest(convs: DataFrame, ids: DataFrame, **columns) -> DataFrame:
    """Per conversation of ids: its faults, the cost and audit of its repair, and the hash of what comes out."""
    id_col = ids.columns[0]
    made = plan(convs, **columns)
    per = summary(made)
    out = ids.select(F.col(id_col).alias("id")).distinct().join(per, F.col("id").eqNullSafe(F.col("conv")), "left").drop("conv")
    out = out.join(hashes(made), F.col("id").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias(id_col), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_NOTHING)).alias("repaired_sha256"))
