"""Sharding along a Hilbert curve over several metadata dimensions.

DataFrame functions only. Each dimension is cut into cells at approximate quantiles, the cells
are put on a Hilbert curve, rows are ordered by the curve, and equal runs of rows become
shards, so a shard covers a small box of every dimension and its statistics prune files.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm._order import running_before
from tapeworks.llm._rows import KEY, partitions, row_key
from tapeworks.session import materialize

BITS = 6
SHARDS = 16


@lru_cache(maxsize=8)
def curve_table(dims: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Per (state, digit): the digit along the curve, and the next state.

    A state is an entry corner and a direction, state = corner * dims + direction; the digit
    has one bit of every dimension. Sub-cubes are visited in Gray-code order, each entered at
    the corner next to where the last one was left.
    """
    full = (1 << dims) - 1
    rot_l = lambda x, r: ((x << r % dims) | (x >> (dims - r % dims))) & full if r % dims else x
    rot_r = lambda x, r: rot_l(x, dims - r % dims)
    gray = [w ^ (w >> 1) for w in range(1 << dims)]
    rank = {g: w for w, g in enumerate(gray)}
    ones = lambda x: (x ^ (x + 1)).bit_length() - 1  # noqa: E731  trailing ones
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(1 << dims)]
    turn = [0 if w == 0 else (ones(w) if w & 1 else ones(w - 1)) % dims for w in range(1 << dims)]
    step, follow = [], []
    for state in range(dims << dims):
        corner, way = divmod(state, dims)
        for digit in range(1 << dims):
            w = rank[rot_r(digit ^ corner, way + 1)]
            step.append(w)
            follow.append((corner ^ rot_l(entry[w], way + 1)) * dims + (way + turn[w] + 1) % dims)
    return tuple(step), tuple(follow)


def curve_index(cells: list[Column], bits: int) -> Column:
    """The index along the curve of a point with `bits` bits in each dimension."""
    dims = len(cells)
    step, follow = curve_table(dims)
    array = lambda xs: F.array(*[F.lit(x) for x in xs])

    def down(acc: Column, level: Column) -> Column:
        bit = [F.call_function("shiftright", c, level).bitwiseAND(F.lit(1)) for c in cells]
        digit = sum((b * (1 << i) for i, b in enumerate(bit)), F.lit(0))
        at = (acc["state"] * (1 << dims) + digit).cast("int")
        return F.struct(
            (acc["index"] * (1 << dims) + F.get(array(step), at)).cast("long").alias("index"),
            F.get(array(follow), at).cast("int").alias("state"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("int").alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, down, lambda acc: acc["index"])


def _axis(df: DataFrame, name: str) -> Column:
    """An order-keeping number; text as it is, for `_ranked`."""
    kind, c = df.schema[name].dataType, df[name]
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return c
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return c.cast("double") if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) else c.cast("long")


def _ranked(rows: DataFrame, axis: str) -> DataFrame:
    """The text axis as a number: how many rows have a smaller value, whole values compared.

    Values are counted before they are shuffled, and ranges of them ranked: a common value is
    one row of that table, long common beginnings do no harm.
    """
    values = rows.where(F.col(axis).isNotNull()).groupBy(axis).agg(F.count("*").alias("n"))
    ranks = materialize(running_before(values, [axis], {"below": F.col("n")}).select(axis, "below"), "values")
    return rows.join(ranks, axis, "left").drop(axis).withColumnRenamed("below", axis)


def _cell(axis: Column, cuts: list | None) -> Column:
    """How many cuts are at or below the value; a null is below them all."""
    values = F.array(*[F.lit(x) for x in sorted(set(cuts or []))]) if cuts else F.array().cast("array<long>")
    return F.coalesce(F.size(F.filter(values, lambda x: x <= axis)), F.lit(0))


def assign(docs: DataFrame, *, dims: tuple[str, ...] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text",
           shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """One row per row of docs: row key, id, size (UTF-8 bytes + 1), text_crc32, curve, shard, slot.

    Law `rows`: shard s holds the ranks from ceil(s*n/shards) on, so counts differ by one at
    most, and slot is the place in the shard. Rows of one curve cell follow the checksum of
    their text, then their id: equal texts with equal metadata stand together. Wholly equal
    rows take neighbouring places. A null stands in the first cell of its dimension; a null
    text has size 1 and checksum 0; ids may be null or repeat; other columns are ignored; an
    empty table gives no rows. Text dimensions are cut by the ranks of their whole values.
    """
    slim = docs.select(
        *row_key(docs[id_col], docs[text_col], *[docs[d] for d in dims]), docs[id_col].alias("id"),
        (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(docs[text_col]), F.lit(0)).cast("long").alias("text_crc32"),
        *[_axis(docs, d).alias(f"__d{i}") for i, d in enumerate(dims)],
    )
    slim = materialize(slim, "curve")
    for i in range(len(dims)):
        if isinstance(slim.schema[f"__d{i}"].dataType, (T.StringType, T.BinaryType)):
            slim = _ranked(slim, f"__d{i}")
    probs = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = slim.agg(*[F.percentile_approx(f"__d{i}", probs, 10_000).alias(f"q{i}") for i in range(len(dims))], F.count("*").alias("n")).first()
    slim = slim.withColumns({f"__c{i}": _cell(F.col(f"__d{i}"), found[f"q{i}"]) for i in range(len(dims))})
    slim = slim.withColumn("curve", curve_index([F.col(f"__c{i}") for i in range(len(dims))], bits))
    slim = slim.drop(*[f"__{x}{i}" for i in range(len(dims)) for x in "dc"])
    ranked = running_before(slim, ["curve", "text_crc32", "id", KEY[1]], {"rank": F.lit(1)})
    ranked = ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div {found['n'] or 1} as int)"))
    first = F.expr(f"(cast(shard as long) * {found['n']} + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", F.col("rank") - first).drop("rank")


def write_shards(docs: DataFrame, path: str, *, rows_per_file: int = 1_000_000, **options) -> None:
    """Write docs as Parquet, a folder per shard, each file a run of the curve in order.

    Shards are written in ranges of (shard, slot), so a shard above rows_per_file rows is many
    files and no task holds more than a range. The folders are named `shard`, with as many
    underscores after it as docs makes necessary.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    dims = options.get("dims", ("lang", "source", "n_chars"))
    slots = assign(docs, **options).groupBy(*KEY).agg(F.min(F.struct("shard", "slot")).alias("at"))
    # the columns of docs travel in one struct, so that no name of theirs meets one of these
    rows = docs.select(*row_key(docs[id_col], docs[text_col], *[docs[d] for d in dims]), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.join(slots, list(KEY)).select("row", "at.shard", "at.slot")
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot")
    folder = "shard"
    while folder in docs.columns:
        folder += "_"
    ordered.select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).option("maxRecordsPerFile", rows_per_file).parquet(path)
