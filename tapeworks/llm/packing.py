"""Best-fit packing: bounded-space online best-fit over a bitset keyed by free space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.encode import BATCH_BYTES, encoder, parts_by_bytes

OPEN_BINS = 512


class OpenBins:
    """At most `most` open bins of `size`; bit f of the set says that a bin has f free.

    A length goes to the bin with the least free space that holds it, found as the lowest set
    bit at or above the length. When one bin too many is open, the fullest closes.
    """

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits, self.open, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            own = self._take(free)
        else:
            free, own = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            self.at[left].append(own)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return own, self.size - free

    def _take(self, free: int) -> int:
        own = self.at[free].pop()
        self.open -= 1
        if not self.at[free]:
            self.bits &= ~(1 << free)
        return own


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4096,
         end_id: int = 1, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pack the token ids of every text, and end_id after each, into sequences of at most `size`.

    One row per piece: id, piece, start, ids (binary, little-endian unsigned 32-bit),
    sequence_id, offset. Only a document longer than `size` is cut, into pieces of `size` and a
    rest. Each task packs the rows it reads as they come, so nothing is shuffled and memory is
    the open bins; a lost task repeats its own split and numbers only. All but one of the bins
    of a task are more than half full. A null or empty text is the end id alone; ids may be
    null or repeat (each row is a document); other columns are ignored; no rows give none.
    """
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(size, open_bins)
        base = TaskContext.get().partitionId() << 33
        enc = encoder(tokenizer)
        for batch in source:
            texts = batch.column("text")
            for a, b in parts_by_bytes(texts, BATCH_BYTES):
                row, piece, start, ids, seq, off = [], [], [], [], [], []
                for i, data in enumerate(enc.encode(texts.slice(a, b - a)), a):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * size)):
                        part = data[at:at + 4 * size] if len(data) > 4 * size else data
                        own, place = bins.place(len(part) // 4)
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        ids.append(part)
                        seq.append(base + own)
                        off.append(place)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                    ["id", "piece", "start", "ids", "sequence_id", "offset"])

    out = slim.mapInArrow(run, f"id {id_type}, piece int, start long, ids binary, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def digest(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed pieces with a checksum in place of the ids."""
    return packed.select(
        id_col, "piece", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset",
    )
