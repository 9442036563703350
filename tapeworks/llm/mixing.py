"""Mixing sources to target weights: Pfair scheduling of blocks.

DataFrame functions only on the rows. Only the weights, a number for each source, and the
number of blocks of each source come to the driver; it lays out one period of the schedule,
which the rows then look up.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._order import running_before
from tapeworks.llm._rows import KEY, partitions, row_key
from tapeworks.session import materialize

BLOCK_BYTES = 1 << 16
RESOLUTION = 1024
MAX_SOURCES = 10_000
TEMPER = 0.5


def whole_weights(shares: dict[str, float], resolution: int) -> dict[str, int]:
    """Integers of at least 1 that add up to the resolution (largest remainders)."""
    total = sum(shares.values())
    room = resolution - len(shares)
    if room < 0:
        raise ValueError(f"{len(shares)} sources need a resolution of at least as many")
    exact = {s: room * w / total for s, w in shares.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in by_rest[:resolution - sum(out.values())]:
        out[s] += 1
    return out


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period of sum(weights) slots.

    Block k of a source of weight w in a period of W has the release floor(kW/w) and the
    deadline ceil((k+1)W/w); of the released blocks the one with the earliest deadline goes
    first. Every deadline is met, so no source is ever a whole block off its share.
    """
    whole = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s) for s in sorted(weights)]
    ready: list[tuple[int, str]] = []
    for slot in range(whole):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * whole // weights[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(slot)
        if len(slots[s]) < weights[s]:
            heapq.heappush(waiting, (len(slots[s]) * whole // weights[s], s))
    return slots


@dataclass
class Phase:
    """From slot `at`, until a source has no blocks left: weights, first blocks, one period."""

    at: int
    weights: dict[str, int]
    first: dict[str, int]
    slots: dict[str, list[int]]


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[Phase]:
    """When a source has run dry, the others go on with their weights from there."""
    done = {s: 0 for s in blocks if blocks[s]}
    at, out = 0, []
    while done:
        w = {s: weights[s] for s in done}
        whole, slots = sum(w.values()), period(w)
        out.append(Phase(at, w, dict(done), slots))
        place = lambda s, k: k // w[s] * whole + slots[s][k % w[s]]
        length = min(place(s, blocks[s] - done[s] - 1) for s in done) + 1
        turns, rest = divmod(length, whole)
        for s in list(done):
            done[s] += turns * w[s] + sum(x < rest for x in slots[s])
            if done[s] >= blocks[s]:
                del done[s]
        at += length
    return out


def _source_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit(""))


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, *, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", block_bytes: int = BLOCK_BYTES, resolution: int = RESOLUTION, temper: float = TEMPER) -> DataFrame:
    """One row per distinct row of docs: row key, id, src, n_bytes, copies, before, block, slot,
    release, deadline, weight, of_weights, phase_at.

    Within a source, documents follow their id; the block of a document is where its first byte
    falls when the source's texts (UTF-8 bytes + 1 each) stand one after another, block_bytes
    to a block. Blocks get slots by Pfair scheduling with the target weights (null: shares of
    bytes to the power `temper`, so that small sources come up), rounded to `resolution` parts.
    No document is dropped or repeated: when a source has run dry the rest go on among
    themselves; slots that a long document runs through stay empty. At most MAX_SOURCES
    sources: the periods of all phases, up to one for each source that runs dry, are a table
    that is made on the driver and broadcast (1,000 sources that run dry one by one: a million
    numbers).

    Null and repeated ids, null and empty texts are documents like others; a null source is a
    source of its own; rows that repeat wholly share one row here, with `copies`; a source
    without a weight in `weights` gets the smallest; other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(
        *row_key(docs[id_col], docs[source_col], docs[text_col]), docs[id_col].alias("id"), _source_key(docs[source_col]).alias("src"),
        (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + 1).cast("long").alias("n_bytes"),
    )
    slim = slim.groupBy(*KEY, "id", "src", "n_bytes").agg(F.count("*").alias("copies"))
    placed = running_before(slim, ["id", KEY[1], KEY[0]], {"before": F.col("n_bytes") * F.col("copies")}, key="src")
    placed = placed.withColumn("block", F.expr(f"before div {block_bytes}"))
    placed = materialize(placed, "blocks")
    sizes = placed.groupBy("src").agg(F.sum(F.col("n_bytes") * F.col("copies")).alias("bytes")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    totals = {r["src"]: r["bytes"] for r in sizes}
    if weights is None:
        shares = {s: b**temper for s, b in totals.items()}
    else:
        named = {"" if s is None else f"s{s}": w for s, w in weights.items()}
        shares = {s: max(named.get(s, 0.0), 0.0) for s in totals}
    if not any(shares.values()):
        shares = dict.fromkeys(totals, 1.0)
    table = []
    if totals:
        whole = whole_weights(shares, max(resolution, 2 * len(totals)))
        for p in phases({s: -(-b // block_bytes) for s, b in totals.items()}, whole):
            table += [(s, p.first[s], p.at, p.weights[s], sum(p.weights.values()), p.slots[s]) for s in p.weights]
    kinds = "src string, first long, at long, w long, of long, slots array<int>"
    by_source = spark.createDataFrame(table, kinds).groupBy("src").agg(
        F.sort_array(F.collect_list(F.struct("first", "at", "w", "of", "slots"))).alias("phases"))
    # a row for each source, up to its weight in slots for each phase it is in
    out = placed.join(F.broadcast(by_source), "src").withColumn(
        "p", F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("block")), -1)).drop("phases")
    k = F.col("block") - F.col("p.first")
    turn, place = F.expr("(block - p.first) div p.w"), F.pmod(k, F.col("p.w")).cast("int")
    return out.select(
        *KEY, "id", "src", "n_bytes", "copies", "before", "block",
        (F.col("p.at") + turn * F.col("p.of") + F.get("p.slots", place)).alias("slot"),
        (F.col("p.at") + F.expr("((block - p.first) * p.of) div p.w")).alias("release"),
        (F.col("p.at") + F.expr("((block - p.first + 1) * p.of + p.w - 1) div p.w")).alias("deadline"),
        F.col("p.w").alias("weight"), F.col("p.of").alias("of_weights"), F.col("p.at").alias("phase_at"),
    )


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, *, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", **options) -> DataFrame:
    """All rows of docs with its columns, in the order of the mix: partitions are runs of slots,
    sorted inside, so files written from them follow the mix one after another."""
    slots = schedule(docs, weights, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    slots = materialize(slots.select(*KEY, "slot", "before"), "slots")
    # the columns of docs travel in one struct, so that no name of theirs meets one of these
    rows = docs.select(*row_key(docs[id_col], docs[source_col], docs[text_col]), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    ordered = rows.join(slots, list(KEY)).repartitionByRange(partitions(docs.sparkSession), "slot", "before").sortWithinPartitions("slot", "before")
    return ordered.select("row.*")
