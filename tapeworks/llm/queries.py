"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import chat, hilbert, html_text, itq, licences, mixing, packing, quality, repair, simhash, token_counts, wavelet, whitening
from tapeworks.llm.queries_sql import ORACLES
from tapeworks.session import durable_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

__all__ = ["ORACLES", "QUERIES"]


def word_bpe() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_wavelet_shards")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{durable_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    wavelet.write(table(spark, sf, "documents"), path, word_bpe())
    return wavelet.digest(wavelet.documents(spark.read.schema(wavelet.FIELDS).parquet(path)))


@query("op2_itq_groups")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return itq.groups(table(spark, sf, "embeddings"))


@query("op3_hilbert_shards")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return hilbert.assign(table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


@query("op4_token_counts")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    n = token_counts.counts(table(spark, sf, "documents"), word_bpe())
    return n.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf, "documents"), word_bpe()))


@query("op6_licence_rules")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan(table(spark, sf, "documents"), notices=True).select(
        "doc_id", "n_sentences", *[F.array_join(c, ",").alias(c) for c in ("found", "licences", "kinds")])


@query("op7_line_frequency")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.verdicts(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


@query("op8_bk_tree_simhash")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    out = simhash.groups(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op9_text_density")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.main_text(table(spark, sf, "pages"))


@query("op10_pfair_mix")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    out = mixing.schedule(table(spark, sf, "documents"))
    source = F.when(F.col("src") != "", F.substring("src", 2, 1 << 30))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        F.col("id").alias("doc_id"), source.alias("source"), "n_bytes", "block", "slot", "release", "deadline", "weight", "of_weights", "phase_at")


@query("op11_repair_conversations")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    convs = table(spark, sf, "conversations")
    return repair.digest(repair.damaged(convs), convs.select("conv_id"))


#: A conversation whose texts hold control strings of common templates.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


@query("op12_prefix_targets")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{durable_dir(spark)}/chat-{uuid.uuid4().hex}"
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    chat.write(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra), path)
    return chat.digest(*chat.read(spark, path))


@query("op13_gkl_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.digest(table(spark, sf, "embeddings"))
