"""SimHash near-duplicates: BK-trees over sharded fingerprints.

Two fingerprints of 64 bits that differ in at most `radius` bits agree on all bits of some
choice of the blocks that the bits are dealt into. Fingerprints that agree on a choice form a
shard; each shard is one BK-tree. A shard goes to one task as sorted rows of a shuffle, since
all trees together grow with the corpus and can't be broadcast; a very large shard is cut into
cells, each a tree and the part of the shard that asks it. Only distinct fingerprints are
shuffled; links inside a tree leave it as one row per fingerprint, not as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._graph import components
from tapeworks.llm._rows import KEY, partitions, row_key, whole_groups, with_key
from tapeworks.session import materialize

SEED = 42
WORDS = 3
RADIUS = 3
BLOCKS = 5
CELL_ROWS = 8192
HASH_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit b is set if it is set in over half of the hashes of the word shingles; 0 if none."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    ends = [e + i for i, e in enumerate(accumulate(map(len, parts)))]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    n = max(1, len(parts) - words + 1)
    ends = ends[words - 1:] if len(parts) >= words else ends[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, HASH_CHUNK):
        h = np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts[at:min(n, at + HASH_CHUNK)], ends[at:at + HASH_CHUNK])], ">u8")
        bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(row key, id, fp) of every row; fp holds the 64 bits as a signed long."""
    slim = docs.select(*row_key(docs[id_col], docs[text_col]), docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (*KEY, "id")], pa.array(fp.view(np.int64))], [*KEY, "id", "fp"])

    return slim.mapInArrow(run, f"{KEY[0]} long, {KEY[1]} long, id {id_type}, fp long")


class Forest:
    """BK-trees of many groups at once: a child hangs on the edge of its distance to its parent.

    Built level by level: of the points that wait at one node with one distance, the first
    becomes the child and the others wait at it. group holds a number per point.
    """

    def __init__(self, points: np.ndarray, group: np.ndarray):
        n = len(points)
        self.points = points
        self.edge = np.zeros(n, np.int64)
        up = np.full(n, -1, np.int64)
        order = np.arange(n)
        where, label = group.astype(np.int64), np.zeros(n, np.int64)
        root_level = True
        while len(order):
            sort = np.lexsort((order, label, where))
            order, where, label = order[sort], where[sort], label[sort]
            first = np.ones(len(order), bool)
            first[1:] = (where[1:] != where[:-1]) | (label[1:] != label[:-1])
            head = order[first][np.cumsum(first) - 1]
            if root_level:
                self.root_of = np.zeros(n, np.int64)
                self.root_of[order] = head
            else:
                up[order[first]] = where[first]
                self.edge[order[first]] = label[first]
            rest = ~first
            order, where = order[rest], head[rest]
            label = np.bitwise_count(points[order] ^ points[where]).astype(np.int64)
            root_level = False
        has = np.flatnonzero(up >= 0)
        self.kids = has[np.lexsort((self.edge[has], up[has]))]
        self.key = up[self.kids] * 65 + self.edge[self.kids]  # ascending: children by edge

    def within(self, asks: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (ask number, point) at most radius apart, following only edges within it."""
        ask, node = np.arange(len(asks)), roots
        while len(ask):
            d = np.bitwise_count(asks[ask] ^ self.points[node]).astype(np.int64)
            near = d <= radius
            yield ask[near], node[near]
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
            count = hi - lo
            ask = np.repeat(ask, count)
            node = self.kids[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(len(ask))]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower the labels until linked points agree."""
    while len(a):
        low = np.minimum(label[a], label[b])
        top = np.maximum(label[a], label[b])
        differ = low != top
        if not differ.any():
            break
        a, b, low, top = a[differ], b[differ], low[differ], top[differ]
        np.minimum.at(label, top, low)
        while True:
            step = label[label]
            if (step == label).all():
                break
            label = step
    return label


def _tree_links(source: Iterator[pa.RecordBatch], radius: int, asks_at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows (table, block bits, i, j, own, fp): own rows form the cell's tree, all others ask it.

    Gives (fp, root) for each fingerprint that is not the smallest of those it is linked with.
    """
    for batch in whole_groups(source, ["table", "bits", "i", "j"]):
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("table", "bits", "i", "j")])
        cell = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))])
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        own = batch.column("own").to_numpy(zero_copy_only=False).astype(bool)
        inner = keys[2] == keys[3]
        tree = np.flatnonzero(own)
        forest = Forest(fp[tree], cell[tree])
        root_of_cell = np.full(cell[-1] + 1 if len(cell) else 0, -1, np.int64)
        root_of_cell[cell[tree]] = forest.root_of
        asks = np.flatnonzero(np.where(inner, own, ~own) & (root_of_cell[cell] >= 0))
        label = np.arange(len(fp))
        for at in range(0, len(asks), asks_at_once):
            some = asks[at:at + asks_at_once]
            for k, node in forest.within(fp[some], root_of_cell[cell[some]], radius):
                label = _merge(label, some[k], tree[node])
        linked = np.flatnonzero(label != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[label[linked]].view(np.int64))], ["fp", "root"])


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(fp, root): edges that connect exactly the fingerprints within the radius of one another.

    fps has distinct longs in fp. Each is in one shard for every choice of blocks - radius
    blocks. Shards above cell_rows fingerprints are dealt into s parts by hash, and each pair
    of parts (i <= j) is a cell of its own: whole results from cells of bounded size.
    """
    cuts = [round(64 * b / blocks) for b in range(blocks + 1)]
    masks = []
    for choice in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in choice)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    shards = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for t, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(shards).alias("s")).select("s.table", "s.bits", "fp")
    sizes = rows.groupBy("table", "bits").agg(F.count("*").alias("n")).where("n > 1")
    parts = sizes.select("table", "bits", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    rows = rows.join(parts, ["table", "bits"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(
        F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j"), (F.col("mine") <= k).alias("own")))
    rows = rows.select("table", "bits", "fp", F.explode(cells).alias("c")).select("table", "bits", "c.i", "c.j", "c.own", "fp")
    n = partitions(fps.sparkSession)
    dealt = rows.repartition(n, "table", "bits", "i", "j").sortWithinPartitions("table", "bits", "i", "j", "fp")
    return dealt.mapInArrow(lambda it: _tree_links(it, radius), "fp long, root long")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: row key, id, fp, component_id (smallest id that links reach).

    A text without words (null, empty, white space) has fingerprint zero and links like any
    other. Ids may be null or repeat: component_id is null only where no document of the
    component has an id. Other columns are ignored; an empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    own = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(links(own.select("fp"), radius), "fp", "root")
    joined = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    least = roots.withColumnRenamed("node", "fp").join(own, "fp").groupBy("root").agg(F.min("least").alias("of_root"))
    table = joined.join(least, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("of_root")).alias("component_id"), "root")
    return marked.join(table, "fp")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of docs of each group of near-duplicates: that with the smallest id (rows without
    an id come last, then the smallest text hash decides); one of them, if it repeats."""
    found = groups(docs, id_col=id_col, text_col=text_col, words=words, radius=radius)
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(KEY[1]).alias("row"), F.col(KEY[0]).alias("key"))
    best = found.groupBy(F.col("root").isNull().alias("single"), F.coalesce("root", "fp").alias("group")).agg(F.min(rank).alias("b"))
    stay = best.select(F.col("b.key").alias(KEY[0]), F.col("b.row").alias(KEY[1])).distinct()
    rows = docs.select(*row_key(docs[id_col], docs[text_col]), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.join(stay, list(KEY), "left_semi").dropDuplicates(list(KEY)).select("row.*")


# --- near copies by similarity: fingerprints retrieve, word shingles decide -----------------------

SHINGLE = 5
SIMILARITY = 0.8
#: Texts that share 0.8 of their five-word shingles differ in about one word of 45: in 5 bits of a
#: fingerprint of two-word shingles on average, where one of five-word shingles differs in 10.
FP_WORDS, REACH = 2, 9
ROWS_PER_SHARD = 512


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (fewer words: of all of them; none: of nothing)."""
    from xxhash import xxh64_intdigest

    w = _words(text)
    return np.unique(np.array([xxh64_intdigest(b" ".join(w[i:i + words]), SEED) for i in range(max(1, len(w) - words + 1))], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sorted sets of hashes."""
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def shard_masks(radius: int, agree: int) -> list[int]:
    """The bits of each choice of `agree` among radius + agree blocks: two fingerprints within the
    radius agree on all bits of one choice at least."""
    blocks = radius + agree
    cuts = [round(64 * b / blocks) for b in range(blocks + 1)]
    return [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in choice) for choice in combinations(range(blocks), agree)]


def _first_shard(x: np.ndarray, masks: list[int]) -> np.ndarray:
    """The first shard in which fingerprints with these differing bits meet (-1: none)."""
    out = np.full(len(x), -1, np.int64)
    for t in range(len(masks) - 1, -1, -1):
        out[(x & np.uint64(masks[t])) == 0] = t
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row key, id, cls, fp) of every row; texts of equal words are one class."""
    slim = docs.select(*row_key(docs[id_col], docs[text_col]), docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in source:
            cls = np.empty(batch.num_rows, np.uint64)
            fp = np.empty(batch.num_rows, np.uint64)
            for i, t in enumerate(batch.column("text")):
                cls[i] = xxh64_intdigest(b" ".join(_words(t.as_py())), SEED)
                fp[i] = fingerprint(t.as_py(), FP_WORDS)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*KEY, "id")], pa.array(cls.view(np.int64)), pa.array(fp.view(np.int64))], [*KEY, "id", "cls", "fp"])

    return slim.mapInArrow(run, f"{KEY[0]} long, {KEY[1]} long, id {id_type}, cls long, fp long")


_CELL = ["table", "bits", "i", "j"]


def _near_groups(source: Iterator[pa.RecordBatch], radius: int, masks: list[int], asks_at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    """Of each cell, the classes whose fingerprints a pair within the radius first meets in, by group."""
    for batch in whole_groups(source, _CELL):
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in _CELL])
        cell = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))])
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        own = batch.column("own").to_numpy(zero_copy_only=False).astype(bool)
        # one point for each fingerprint of a cell and side; the classes that share it follow it
        side = np.where(keys[2] == keys[3], 0, own)
        _, point, of = np.unique(np.stack([cell, side, fp.view(np.int64)]), axis=1, return_index=True, return_inverse=True)
        of = of.ravel()
        inner = (keys[2] == keys[3])[point]
        tree = np.flatnonzero(own[point])
        forest = Forest(fp[point][tree], cell[point][tree])
        root_of_cell = np.full(cell[-1] + 1 if len(cell) else 0, -1, np.int64)
        root_of_cell[cell[point][tree]] = forest.root_of
        asks = np.flatnonzero(np.where(inner, own[point], ~own[point]) & (root_of_cell[cell[point]] >= 0))
        label = np.arange(len(point))
        table = keys[0][point]
        for at in range(0, len(asks), asks_at_once):
            some = asks[at:at + asks_at_once]
            for k, node in forest.within(fp[point][some], root_of_cell[cell[point][some]], radius):
                a, b = some[k], tree[node]
                meet = _first_shard(fp[point][a] ^ fp[point][b], masks) == table[a]
                label = _merge(label, a[meet], b[meet])
        group = label[of]
        size = np.bincount(group, minlength=len(point))
        # classes of one fingerprint meet in the first shard
        stay = np.flatnonzero((size[group] > 1) & ((keys[0] == 0) | (np.bincount(label, minlength=len(point))[group] > 1)))
        rows = batch.take(pa.array(stay))
        head = fp[point][group[stay]].view(np.int64)
        yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in (*_CELL, "own")], pa.array(head), rows.column("cls"), rows.column("fp")], [*_CELL, "own", "grp", "cls", "fp"])


def _confirmed(source: Iterator[pa.RecordBatch], radius: int, masks: list[int], words: int, least: float) -> Iterator[pa.RecordBatch]:
    """(cls, other): edges between classes of a group whose shingles are similar enough.

    Pairs are taken by falling likeness of their fingerprints, and those that are connected
    already are passed over.
    """
    keys = [*_CELL, "grp"]
    for batch in whole_groups(source, keys):
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
        borders = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [k.shape[1]]])
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        cls = batch.column("cls").to_numpy(zero_copy_only=False)
        own = batch.column("own").to_numpy(zero_copy_only=False).astype(bool)
        a_out, b_out = [], []
        for lo, hi in zip(borders[:-1], borders[1:]):
            sets = [shingles(t.as_py(), words) for t in batch.column("text").slice(lo, hi - lo)]
            up = list(range(hi - lo))

            def find(x: int, up=up) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            inner = k[2, lo] == k[3, lo]
            found = [[], [], []]
            for a in range(1, hi - lo):  # one row of pairs at a time
                x = fp[lo:lo + a] ^ fp[lo + a]
                far = np.bitwise_count(x)
                ok = far <= radius
                if not inner:
                    ok &= own[lo:lo + a] != own[lo + a]
                b = np.flatnonzero(ok)
                b = b[_first_shard(x[b], masks) == k[0, lo]]
                for f, y in zip(found, (far[b], np.full(len(b), a), b)):
                    f.append(y)
            far, a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
            for i in np.argsort(far, kind="stable").tolist():
                p, q = int(a[i]), int(b[i])
                x, y = find(p), find(q)
                if x != y and similarity(sets[p], sets[q]) >= least:
                    up[max(x, y)] = min(x, y)
            for x in range(hi - lo):
                if find(x) != x:
                    a_out.append(cls[lo + x])
                    b_out.append(cls[lo + find(x)])
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["cls", "other"])


def similar_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, least: float = SIMILARITY,
                    radius: int = REACH, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per class of texts with equal words: cls, root (a token that linked classes share,
    null for a class alone), b (its first row: whether it lacks an id, id, row key).

    Links are pairs of texts that share at least `least` of their word shingles, found among
    pairs whose fingerprints differ in at most `radius` bits: BK-trees over shards as in
    `links`, with as many agreeing blocks as keep shards at about ROWS_PER_SHARD of random
    fingerprints. A pair is judged where it first meets, by the shingles of its whole texts.
    Texts travel only for classes that have a pair to judge.
    """
    marked = _classes(docs, id_col, text_col)
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(KEY[1]).alias("row"), F.col(KEY[0]).alias("key"))
    classes = materialize(marked.groupBy("cls", "fp").agg(F.min(rank).alias("b")), "classes")
    n, agree = classes.count(), 2
    while n / 2 ** (64 * agree / (radius + agree)) > ROWS_PER_SHARD and agree < 5:
        agree += 1
    masks = shard_masks(radius, agree)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for t, m in enumerate(signed)])
    rows = classes.select("cls", "fp", F.explode(shards).alias("s")).select("s.table", "s.bits", "cls", "fp")
    sizes = rows.groupBy("table", "bits").agg(F.count("*").alias("n")).where("n > 1")
    parts = sizes.select("table", "bits", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    rows = rows.join(parts, ["table", "bits"]).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(
        F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j"), (F.col("mine") <= k).alias("own")))
    rows = rows.select("table", "bits", "cls", "fp", F.explode(cells).alias("c")).select("table", "bits", "c.i", "c.j", "c.own", "cls", "fp")
    p = partitions(docs.sparkSession)
    dealt = rows.repartition(p, *_CELL).sortWithinPartitions(*_CELL, "fp", "cls")
    near = materialize(dealt.mapInArrow(lambda it: _near_groups(it, radius, masks), "table int, bits long, i int, j int, own boolean, grp long, cls long, fp long"), "near")
    first = near.select("cls").distinct().join(classes, "cls").select("cls", F.col("b.key").alias(KEY[0]), F.col("b.row").alias(KEY[1]))
    texts = with_key(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")), "id", "text").select(*KEY, "text")
    texts = texts.join(first, list(KEY)).dropDuplicates(["cls"]).select("cls", "text")
    full = near.join(texts, "cls").repartition(p, *_CELL, "grp").sortWithinPartitions(*_CELL, "grp", "cls")
    edges = full.mapInArrow(lambda it: _confirmed(it, radius, masks, words, least), "cls long, other long")
    roots = components(materialize(edges, "similar"), "cls", "other")
    return classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "root", "b")


def keep_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs of each group of texts linked by `similar_classes`: that with the smallest id
    (rows without an id come last, then the smallest text hash decides); one of them, if it repeats.

    Texts without words are copies of one another. Ids may be null; other columns stay as they
    are; an empty table gives no rows.
    """
    found = similar_classes(docs, id_col=id_col, text_col=text_col, **options)
    best = found.groupBy(F.col("root").isNull().alias("single"), F.coalesce("root", "cls").alias("group")).agg(F.min("b").alias("b"))
    stay = best.select(F.col("b.key").alias(KEY[0]), F.col("b.row").alias(KEY[1])).distinct()
    rows = docs.select(*row_key(docs[id_col], docs[text_col]), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.join(stay, list(KEY), "left_semi").dropDuplicates(list(KEY)).select("row.*")
