"""Token counts: batch encoding in Arrow functions that give back lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.encode import BATCH_BYTES, encoder, parts_by_bytes, pieces

def _lengths(texts: pa.Array, path: str, most: int) -> np.ndarray:
    if not path.endswith(".json"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return np.array([len(x) for x in model.encode([t or "" for t in texts.to_pylist()], num_threads=1)], np.int64)
    enc = encoder(path)
    if not enc.by_word or len(texts) > 1 or len(texts[0].as_py() or "") <= most:
        return enc.lengths(texts)
    # a run of one text above the batch size: its pieces are batches of their own. Only of the
    # known rules it is sure that no token spans a cut; other tokenizers take texts whole
    return np.array([sum(int(enc.lengths(pa.array([p]))[0]) for p in pieces(texts[0].as_py(), most))])


def counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
           batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens) for each row, no begin, end or added special tokens.

    tokenizer: the path of a .json (tokenizers) or .model (sentencepiece) file. The rows of an
    Arrow batch are encoded in runs of about batch_bytes, long texts in pieces cut before white
    space where the tokenizer's rules make that safe, and whole with any other. One pass, no shuffle. A null or empty text has 0 bytes and 0 tokens; ids may be null
    or repeat (each row is counted); other columns are ignored; an empty table gives no rows.
    """
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column("text")
            n = np.zeros(len(texts), np.int64)
            for a, b in parts_by_bytes(texts, batch_bytes):
                n[a:b] = _lengths(texts.slice(a, b - a), tokenizer, batch_bytes)
            size = texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())
            n_bytes = pc.fill_null(pc.binary_length(size), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), n_bytes, pa.array(n)], ["id", "n_bytes", "n_tokens"])

    out = slim.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")

