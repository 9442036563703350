"""Reading and writing the event streams: batch files, file streams or a message broker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.functions.numeric import blank_to_null, finite
from tapeworks.operators.quality import parse_ts
from tapeworks.sources import schemas


def read_records(
    spark: SparkSession, source: str, *, fmt: str = "text", stream: bool = False, **options: str
) -> DataFrame:
    """Raw records as one `value` string column plus what the format adds.

    fmt "text" reads JSON lines, "kafka" a topic (replay with startingOffsets=earliest and a
    fresh checkpoint; tail with startingOffsets=latest and a durable one).
    """
    reader = (spark.readStream if stream else spark.read).format(fmt)
    for name, option in options.items():
        reader = reader.option(name, option)
    if fmt == "kafka":
        reader = reader.option("subscribe", source)
        return reader.load().select(F.col("value").cast("string"), "timestamp", "offset", "partition")
    return reader.load(source)


def decode(records: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Parse `value`; undecodable or non-object records keep it and have a NULL `record`."""
    text = F.trim(F.col(value))
    parsed = F.from_json(F.col(value), schema, {"mode": "PERMISSIVE"})
    # permissive mode turns broken text into an all-NULL object; the JSON check tells them apart
    valid = text.startswith("{") & F.get_json_object(F.col(value), "$").isNotNull()
    # a generator keeps the optimizer from repeating the parse for every extracted field
    return records.select("*", F.explode(F.array(F.when(valid, parsed))).alias("record"))


def good_records(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("record").isNotNull()).select("record.*")


def dead_letters(decoded: DataFrame, topic: str, value: str = "value") -> DataFrame:
    """Records for `<topic>.dlq`, with the raw text untouched."""
    return decoded.where(F.col("record").isNull()).select(
        F.lit(f"{topic}.dlq").alias("topic"), F.col(value).alias("raw")
    )


def read_features(records: DataFrame) -> DataFrame:
    """Feature events with UTC times and the open `values` map kept as text values."""
    r = good_records(decode(records, schemas.RAW_FEATURE))
    return r.select(
        blank_to_null(F.col("eventId")).alias("event_id"),
        blank_to_null(F.col("instrument")).alias("instrument"),
        parse_ts(F.coalesce("eventTime", "event_time", "timestamp")).alias("event_time"),
        parse_ts(F.col("ingestTime")).alias("ingest_time"),
        F.col("featureName").alias("feature_name"),
        F.col("inputEventIds").alias("input_event_ids"),
        parse_ts(F.col("windowStart")).alias("window_start"),
        parse_ts(F.col("windowEnd")).alias("window_end"),
        F.col("values"),
    )


def read_fills(records: DataFrame) -> DataFrame:
    """Fills as text columns, ready for validation."""
    return good_records(decode(records, schemas.RAW_FILL))


def tick_price(*candidates: Column) -> Column:
    """First present price among the aliases; non-positive and non-finite prices are NULL."""
    price = finite(F.coalesce(*candidates))
    return F.when(price > 0, price)


def read_ticks(records: DataFrame) -> DataFrame:
    r = good_records(decode(records, schemas.RAW_TICK))
    return r.select(
        "instrument",
        tick_price(F.col("price"), F.col("mid"), F.col("midPrice"), F.col("values")["midPrice"]).alias("price"),
        finite(F.col("quantity")).alias("quantity"),
        parse_ts(F.col("timestamp")).alias("ts"),
        "is_buyer_maker",
    ).where(F.col("instrument").isNotNull() & F.col("price").isNotNull() & F.col("ts").isNotNull())


def read_trades(records: DataFrame) -> DataFrame:
    """Nested trade events, flattened."""
    r = good_records(decode(records, schemas.TRADE))
    return r.select(
        F.col("eventId").alias("event_id"),
        parse_ts(F.col("eventTime")).alias("event_time"),
        parse_ts(F.col("ingestTime")).alias("ingest_time"),
        "source",
        F.concat_ws("-", "instrument.baseAsset", "instrument.quoteAsset").alias("instrument"),
        F.col("instrument.symbol").alias("symbol"),
        F.col("instrument.exchange.id").alias("exchange"),
        F.col("sequenceNumber").alias("sequence_number"),
        "price", "size", "side",
        F.col("exchangeTradeId").alias("exchange_trade_id"),
    )


def read_feature_capture(spark: SparkSession, path: str) -> DataFrame:
    """A captured topic: one JSON event per line."""
    return read_features(read_records(spark, path))


def write_feature_capture(records: DataFrame, path: str) -> None:
    """One event per line, as received."""
    records.select("value").write.mode("errorifexists").text(path)
