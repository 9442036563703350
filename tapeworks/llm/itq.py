"""Embedding near-duplicates by iterative quantisation.

Rotations learned on a bounded sample turn vectors into balanced binary codes. Multi-index
Hamming tables over the codes retrieve candidates, and the original vectors decide by cosine.
Equal vectors are one class throughout, so copies are never paired with one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._graph import components
from tapeworks.llm._rows import partitions, whole_groups
from tapeworks.session import materialize

SAMPLE_ROWS = 10_000
ITERATIONS = 50
ROTATIONS = 2
CODE_BITS = 64
BLOCKS = 8
AGREE = 2
HAMMING_SHARE = 0.25
THRESHOLD = 0.9
CELL_ROWS = 2048
_SEED = 11


@dataclass(frozen=True)
class Model:
    """Mean and, for each rotation, the map from a vector to CODE_BITS signs."""

    mean: np.ndarray
    maps: tuple[np.ndarray, ...]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, rotations) unsigned 64-bit codes of unit vectors."""
        centred = x - self.mean
        bits = [np.packbits(centred @ m > 0, axis=1).view(">u8")[:, 0].astype(np.uint64) for m in self.maps]
        return np.stack(bits, 1)


def fit(x: np.ndarray, rotations: int = ROTATIONS, iterations: int = ITERATIONS, seed: int = _SEED) -> Model:
    """Alternate between the signs of the rotated sample and the best rotation to them."""
    d = x.shape[1] if x.ndim == 2 else 0
    mean = x.mean(0) if len(x) else np.zeros(d)
    centred = x - mean
    if len(x):
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :CODE_BITS]
    else:
        axes = np.eye(d)[:, :CODE_BITS]
    c = axes.shape[1]
    flat = centred @ axes
    rng, maps = np.random.default_rng(seed), []
    for _ in range(rotations):
        rotation, _ = np.linalg.qr(rng.standard_normal((c, c)))
        for _ in range(iterations if len(x) else 0):
            signs = np.where(flat @ rotation > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(signs.T @ flat)
            rotation = (u @ vt).T
        full = axes @ rotation
        if c < CODE_BITS:  # short vectors: random directions fill the code up
            full = np.hstack([full, rng.standard_normal((d, CODE_BITS - c))])
        maps.append(full)
    return Model(mean, tuple(maps))


def _unit(col: pa.Array, dim: int) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_FIRST = np.full(256, 255, np.uint8)
_PAIRS = list(combinations(range(BLOCKS), AGREE))
for _t, _c in reversed(list(enumerate(_PAIRS))):
    for _m in range(256):
        if all(_m >> b & 1 for b in _c):
            _FIRST[_m] = _t


def _first_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first table in which two codes meet (255: none); codes are (n, rotations)."""
    out = np.full(len(a), 255, np.uint8)
    for r in range(a.shape[1] - 1, -1, -1):
        same = (a[:, r] ^ b[:, r]).view(np.uint8).reshape(-1, BLOCKS) == 0
        own = _FIRST[np.packbits(same, axis=1, bitorder="little")[:, 0]]
        out = np.where(own < 255, own + np.uint8(r * len(_PAIRS)), out)
    return out


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1) <= most


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        low = np.minimum(label[a], label[b])
        top = np.maximum(label[a], label[b])
        if (low == top).all():
            return
        np.minimum.at(label, top, low)
        while not ((step := label[label]) == label).all():
            label[:] = step


def _cells(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Borders of the runs of equal keys."""
    k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
    return np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [k.shape[1]]])


def _pairs(borders: np.ndarray, own: np.ndarray, between: np.ndarray, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All row pairs to compare inside the cells, in blocks: within one part, or between two."""
    sizes = np.diff(borders)
    start = np.repeat(borders[:-1], sizes)
    before = np.arange(len(start)) - start
    total = np.concatenate([[0], np.cumsum(before)])
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + at_once, "right")) - 1)
        n = before[lo:hi]
        a = np.repeat(np.arange(lo, hi), n)
        b = start[a] + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        stay = ~between[a] | (own[a] != own[b])
        if stay.any():
            yield a[stay], b[stay]
        lo = hi


_KEYS = ["table", "bits", "i", "j"]


def _candidates(source: Iterator[pa.RecordBatch], most: int, rotations: int) -> Iterator[pa.RecordBatch]:
    """Of each cell, the classes that a pair within `most` bits first meets in, by group."""
    names = [f"code{r}" for r in range(rotations)]
    for batch in whole_groups(source, _KEYS):
        borders = _cells(batch, _KEYS)
        codes = np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in names], 1)
        table, i, j = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("table", "i", "j"))
        own = batch.column("own").to_numpy(zero_copy_only=False).astype(bool)
        label = np.arange(len(codes))
        for a, b in _pairs(borders, own, i != j):
            near = _near(codes[a], codes[b], most)
            a, b = a[near], b[near]
            meet = _first_table(codes[a], codes[b]) == table[a]
            _merge(label, a[meet], b[meet])
        size = np.bincount(label, minlength=len(label))
        stay = pa.array(np.flatnonzero(size[label] > 1))
        rows = batch.take(stay)
        cls = batch.column("cls")
        group = cls.take(pa.array(label[stay.to_numpy()]))
        yield pa.RecordBatch.from_arrays(
            [*[rows.column(c) for c in (*_KEYS, "own")], group, *[rows.column(c) for c in ("cls", *names)]], [*_KEYS, "own", "grp", "cls", *names])


def _reranked(source: Iterator[pa.RecordBatch], most: int, rotations: int, dim: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Per class and cell: the vectors linked in it, and a class that the links reach."""
    names = [f"code{r}" for r in range(rotations)]
    keys = [*_KEYS, "grp"]
    for batch in whole_groups(source, keys):
        borders = _cells(batch, keys)
        codes = np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in names], 1)
        table, i, j, times, cls = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("table", "i", "j", "times", "cls"))
        own = batch.column("own").to_numpy(zero_copy_only=False).astype(bool)
        x = _unit(batch.column("vector"), dim)
        label, links = np.arange(len(x)), np.zeros(len(x), np.int64)
        for a, b in _pairs(borders, own, i != j):
            near = _near(codes[a], codes[b], most)
            a, b = a[near], b[near]
            meet = _first_table(codes[a], codes[b]) == table[a]
            a, b = a[meet], b[meet]
            linked = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[linked], b[linked]
            np.add.at(links, a, times[b])
            np.add.at(links, b, times[a])
            _merge(label, a, b)
        hit = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array(cls[label[hit]]), pa.array(links[hit])], ["cls", "other", "links"])


def groups(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
           sample_rows: int = SAMPLE_ROWS, rotations: int = ROTATIONS, hamming_share: float = HAMMING_SHARE,
           cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Rotations are fitted on at most sample_rows vectors, those with the smallest hashes; every
    vector is indexed. Codes are cut into 8 blocks per rotation; a table for each pair of blocks
    brings together codes that agree on both. A pair is judged where it first meets: codes
    within hamming_share of their bits, then the cosine of the vectors in double precision, at
    least `threshold`. Cells above cell_rows classes are dealt into parts, and each pair of parts
    compared as a cell of its own. n_links counts every other vector with a link, copies with
    their number. Recall is measured in tests/llm.

    A vector that is null, zero or has null or non-finite components, or another length than
    the most common one, links with nothing. Ids may repeat (n_links counts rows) or be null
    (component_id is null where no id is reached, kept false); an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("vector"))
    big = F.aggregate("vector", F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.withColumn("sound", F.coalesce(sound & (F.size("vector") > 0) & (big > 0), F.lit(False)))
    common = v.where("sound").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 0
    v = v.withColumn("vector", F.when(F.col("sound") & (F.size("vector") == dim), F.col("vector"))).drop("sound")
    alone = v.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")).where(F.lit(dim == 0))
    if dim == 0:
        return _named(alone, id_col)
    classes = v.where("vector is not null").groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("times"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    drawn = classes.select("vector", F.xxhash64("vector").alias("h")).orderBy("h", "vector").limit(sample_rows).select("vector").toArrow()
    model = fit(_unit(drawn.column("vector").combine_chunks(), dim), rotations)
    names = [f"code{r}" for r in range(rotations)]
    most = int(hamming_share * CODE_BITS * rotations)

    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                codes = model.codes(_unit(batch.column("vector"), dim)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("cls"), *[pa.array(codes[:, r]) for r in range(rotations)]], ["cls", *names])

    coded = materialize(classes.select("cls", "vector").mapInArrow(encode, "cls long, " + ", ".join(f"{n} long" for n in names)), "codes")
    tables = []
    for r in range(rotations):
        for t, pair in enumerate(_PAIRS):
            mask = sum(0xFF << 8 * b for b in pair)
            mask -= (1 << 64) if mask >> 63 else 0
            tables.append(F.struct(F.lit(r * len(_PAIRS) + t).alias("table"), F.col(f"code{r}").bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    rows = coded.select("cls", *names, F.explode(F.array(*tables)).alias("t")).select("t.table", "t.bits", "cls", *names)
    sizes = rows.groupBy("table", "bits").agg(F.count("*").alias("n")).where("n > 1")
    parts = sizes.select("table", "bits", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    rows = rows.join(parts, ["table", "bits"]).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(
        F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j"), (F.col("mine") <= k).alias("own")))
    rows = rows.select("table", "bits", "cls", *names, F.explode(cells).alias("c")).select("table", "bits", "c.i", "c.j", "c.own", "cls", *names)
    n = partitions(spark)
    dealt = rows.repartition(n, *_KEYS).sortWithinPartitions(*_KEYS, "cls")
    kinds = "table int, bits long, i int, j int, own boolean, grp long, cls long, " + ", ".join(f"{c} long" for c in names)
    found = materialize(dealt.mapInArrow(lambda it: _candidates(it, most, rotations), kinds), "candidates")
    full = found.join(classes.select("cls", "vector", "times"), "cls")
    full = full.repartition(n, *_KEYS, "grp").sortWithinPartitions(*_KEYS, "grp", "cls")
    linked = full.mapInArrow(lambda it: _reranked(it, most, rotations, dim, threshold), "cls long, other long, links long")
    linked = materialize(linked, "links")
    roots = components(linked.select("cls", "other"), "cls", "other")
    per_class = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    table = classes.select("cls", "vector", "least", "times").join(per_class, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    least = roots.withColumnRenamed("node", "cls").join(classes.select("cls", "least"), "cls").groupBy("root").agg(F.min("least").alias("of_root"))
    table = table.join(least, "root", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("of_root")).alias("component_id"))
    good = v.where("vector is not null").join(table, "vector").select("id", "n_links", "component_id")
    bad = v.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return _named(good.unionByName(bad), id_col)


def _named(out: DataFrame, id_col: str) -> DataFrame:
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).withColumnRenamed("id", id_col)
