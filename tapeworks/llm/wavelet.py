"""Token ids as wavelet matrices: one compressed block of bit planes per run of documents.

File format: Parquet, written in document order. A row is one block: `shard` and `block` (the
order), `docs` and `lengths` (one entry per document), `first` (the ids of all blocks of the
shard before it), `n_tokens`, and `planes`, a self-contained binary:

    "WVM1", then little-endian unsigned 32-bit numbers: n ids, L levels, s symbols;
    s numbers: the ids that occur, ascending; an id's code is its place among them
    L numbers: how many zeros each level has
    L numbers: the bytes of each level's compressed plane, then the planes (zstandard)

A plane holds bit L-1-l of the codes at level l, most significant first, eight to a byte;
codes with a zero go on to the next level before those with a one, else in order. Ranks of
ones are counted from the bits on opening a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm._rows import KEY, partitions, row_key
from tapeworks.llm.encode import BATCH_BYTES, encoder, parts_by_bytes

BLOCK_TOKENS = 1 << 18
MAGIC = b"WVM1"


def build(ids: np.ndarray) -> bytes:
    """The block of a sequence of unsigned 32-bit ids."""
    from zstandard import ZstdCompressor

    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()) + 1 if len(ids) else 0
    if top <= 1 << 22:
        seen = np.zeros(top, bool)
        seen[ids] = True
        symbols = np.flatnonzero(seen).astype("<u4")
        place = np.zeros(top, np.uint32)
        place[symbols] = np.arange(len(symbols), dtype=np.uint32)
        codes = place[ids]
    else:
        symbols, codes = np.unique(ids, return_inverse=True)
    levels = max(0, len(symbols) - 1).bit_length()
    codes = codes.astype(np.uint16 if levels <= 16 else np.uint32)
    zeros, planes = [], []
    pack = ZstdCompressor(level=1).compress
    for k in range(levels - 1, -1, -1):
        if k == 7:
            codes = codes.astype(np.uint8)  # the higher bits have had their levels
        one = (codes & codes.dtype.type(1 << k)) != 0
        planes.append(pack(np.packbits(one).tobytes()))
        low, high = np.flatnonzero(~one), np.flatnonzero(one)
        zeros.append(len(low))
        codes = np.concatenate([codes.take(low), codes.take(high)])
    head = np.array([len(ids), levels, len(symbols), *symbols, *zeros, *map(len, planes)], "<u4")
    return b"".join([MAGIC, head.tobytes(), *planes])


class Block:
    """Access, count and lookup on one block."""

    def __init__(self, data: bytes):
        from zstandard import ZstdDecompressor

        if data[:4] != MAGIC:
            raise ValueError("not a wavelet block")
        self.n, self.levels, s = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
        head = np.frombuffer(data, "<u4", s + 2 * self.levels, 16)
        self.symbols, self.zeros = head[:s], head[s:s + self.levels].astype(int)
        at, self.planes = 16 + 4 * len(head), []
        unpack = ZstdDecompressor().decompress
        for size in head[s + self.levels:]:
            raw = unpack(data[at:at + int(size)])
            self.planes.append(np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool))
            at += int(size)
        self._ranks: list[np.ndarray] | None = None

    @property
    def ranks(self) -> list[np.ndarray]:
        """Per level, the ones before each place."""
        if self._ranks is None:
            self._ranks = [np.concatenate([[0], np.cumsum(p, dtype=np.int32)]) for p in self.planes]
        return self._ranks

    def all(self) -> np.ndarray:
        """Every id in order, from the last level up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        codes = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            one, zeros = self.planes[level], self.zeros[level]
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~one)] = codes[:zeros]
            up[np.flatnonzero(one)] = codes[zeros:] | kind(1 << (self.levels - 1 - level))
            codes = up
        return self.symbols[codes] if self.n else np.zeros(0, "<u4")

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        at, code = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        for level in range(self.levels):
            one, rank = self.planes[level][at], self.ranks[level][at]
            at = np.where(one, self.zeros[level] + rank, at - rank)
            code = 2 * code + one
        return self.symbols[code]

    def _range(self, token: int, end: int) -> tuple[int, int, int] | None:
        code = int(np.searchsorted(self.symbols, token))
        if code == len(self.symbols) or self.symbols[code] != token:
            return None
        a, b = 0, end
        for level in range(self.levels):
            ra, rb = int(self.ranks[level][a]), int(self.ranks[level][b])
            if code >> (self.levels - 1 - level) & 1:
                a, b = self.zeros[level] + ra, self.zeros[level] + rb
            else:
                a, b = a - ra, b - rb
        return code, int(a), int(b)

    def count(self, token: int, end: int | None = None) -> int:
        """How often an id stands before place `end`."""
        found = self._range(token, self.n if end is None else end)
        return found[2] - found[1] if found else 0

    def places(self, token: int) -> np.ndarray:
        """Every place of an id, ascending."""
        found = self._range(token, self.n)
        if not found:
            return np.zeros(0, np.int64)
        code, a, b = found
        at = np.arange(a, b)
        for level in range(self.levels - 1, -1, -1):
            one = bool(code >> (self.levels - 1 - level) & 1)
            # the k-th one (zero) of the level: found among the ranks by binary search
            if one:
                at = np.searchsorted(self.ranks[level], at - self.zeros[level] + 1, "left") - 1
            else:
                gaps = np.arange(self.n + 1) - self.ranks[level]
                at = np.searchsorted(gaps, at + 1, "left") - 1
        return at


FIELDS = "shard int, block int, first long, n_tokens long, docs array<long>, lengths array<long>, planes binary"


def write(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
          block_tokens: int = BLOCK_TOKENS, shards: int | None = None) -> None:
    """Encode every whole text, end_id after each, in ascending id order, and write the shards.

    Ranges of ids become shards, one file each; a block closes after the document that takes it
    to block_tokens, so a task holds one block. A null or empty text is the end id alone. Rows
    of one id follow a hash of their text; a null id comes first. Other columns are ignored; an
    empty table writes an empty table.
    """
    n = shards or partitions(docs.sparkSession)
    slim = docs.select(docs[id_col].cast("long").alias("id"), row_key(docs[id_col], docs[text_col])[1], docs[text_col].cast("string").alias("text"))
    ranged = slim.repartitionByRange(n, "id", KEY[1]).sortWithinPartitions("id", KEY[1])
    end = np.array([end_id], "<u4").tobytes()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        held, ids, sizes, tokens, first, block = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, ids, sizes, tokens, first, block
            blob = build(np.frombuffer(b"".join(held), "<u4"))
            row = [[shard], [block], [first], [tokens], [ids], [sizes], [blob]]
            held, ids, sizes, first, block, tokens = [], [], [], first + tokens, block + 1, 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = [f.split()[0] for f in FIELDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names)

        for batch in source:
            texts, keys = batch.column("text"), batch.column("id").to_pylist()
            for a, b in parts_by_bytes(texts, BATCH_BYTES):
                for key, data in zip(keys[a:b], enc.encode(texts.slice(a, b - a))):
                    held += [data, end]
                    ids.append(key)
                    sizes.append(len(data) // 4 + 1)
                    tokens += sizes[-1]
                    if tokens >= block_tokens:
                        yield close()
        if ids:
            yield close()

    # planes are compressed already; one block to a page keeps reads of single blocks small
    ranged.mapInArrow(run, FIELDS).write.option("compression", "none").parquet(path)


def blocks(files: DataFrame) -> DataFrame:
    """The blocks with `start`: the ids of all blocks of all shards before.

    Only the token totals of the shards, a row for each file, meet in one window.
    """
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def documents(files: DataFrame) -> DataFrame:
    """Read every document back: id, start, n_tokens, ids (binary), in any row order."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in ("docs", "lengths", "planes", "start")}
                ids = Block(one["planes"]).all().astype("<u4").tobytes()
                sizes = np.array(one["lengths"], np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                for a in range(0, len(sizes), 4096):
                    part = slice(a, a + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one["docs"][part], pa.int64()), pa.array(begins[part] + one["start"]), pa.array(sizes[part]),
                         pa.array([ids[4 * x:4 * y] for x, y in zip(begins[part], ends[part])], pa.binary())],
                        ["id", "start", "n_tokens", "ids"])

    slim = blocks(files).select("docs", "lengths", "start", "planes")
    return slim.mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def occurrences(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, id, place): every place of the tokens in their documents, by rank and select."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in range(batch.num_rows):
                block = Block(batch.column("planes")[row].as_py())
                ids = batch.column("docs")[row].values
                ends = np.cumsum(np.array(batch.column("lengths")[row].as_py(), np.int64))
                for token in tokens:
                    at = block.places(token)
                    doc = np.searchsorted(ends, at, "right")
                    begin = np.where(doc > 0, ends[doc - 1], 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), token, np.int64)), ids.take(pa.array(doc)), pa.array(at - begin)], ["token", "id", "place"])

    return files.select("docs", "lengths", "planes").mapInArrow(run, "token long, id long, place long")


def counts(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each token stands in all shards, by rank alone."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for blob in batch.column("planes"):
                block = Block(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([block.count(t) for t in tokens], pa.int64())], ["token", "n"])

    return files.select("planes").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def digest(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents with a checksum in place of the ids."""
    return read.select(F.col("id").alias(id_col), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["Block", "blocks", "build", "counts", "digest", "documents", "occurrences", "write"]
