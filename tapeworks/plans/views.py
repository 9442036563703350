"""Event-stream views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators.quality import normalize_liquidity, validate_fills

AS_OF = "2024-01-31 00:00:00"
AS_OF_MID = "2024-01-10 12:00:00"
NEWS_AS_OF = "2024-01-01 02:50:00"
COINS = ["BTC-USDT", "ETH-USDT", "SOL-USDT", "XRP-USDT", "DOGE-USDT"]
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _instrument(n):
    return F.element_at(F.array(*[F.lit(c) for c in COINS]), (n % 5 + 1).cast("int"))


def events(spark, sf) -> DataFrame:
    # a generator extracts k once per row; as a plain column every later use would parse again
    once = F.explode(F.array(F.get_json_object("props", "$.k").cast("int"))).alias("k")
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", once)
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        "k", _instrument(F.col("user_id")).alias("instrument"), (100 + F.col("value") / 10).alias("px"),
    )


def raw_fills(spark, sf) -> DataFrame:
    qty = (1 + F.col("event_id") % 7).cast("double")
    k = F.col("k")
    return events(spark, sf).select(
        "event_id", F.concat(F.lit("x"), "event_id").alias("execution_id"),
        F.concat(F.lit("o"), F.floor(F.col("event_id") / 2)).alias("order_id"), "instrument",
        F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), qty.alias("quantity"),
        F.col("px").alias("fill_price"), (0.0005 * F.col("px") * qty).alias("transaction_cost"),
        F.when(k % 3 == 0, 0).otherwise(k % 7).cast("double").alias("slippage_bps"),
        F.when(k % 4 == 0, "maker").when(k % 4 == 1, "T").when(k % 4 == 2, "weird").alias("liquidity"), "ts", "k",
    )


def fills(spark, sf) -> DataFrame:
    return raw_fills(spark, sf).withColumn("liquidity", normalize_liquidity(F.col("liquidity"))).drop("k")


def quick_fills(spark, sf) -> DataFrame:
    """Fills in pairs of events: bought with the even one, sold with the next, so lots close soon."""
    pair = F.floor(F.col("event_id") / 2)
    qty = (1 + pair % 7).cast("double")
    return fills(spark, sf).withColumns({
        "instrument": _instrument(pair), "side": F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL"), "quantity": qty,
        "transaction_cost": 0.0005 * F.col("fill_price") * qty})


def dirty_fills(spark, sf) -> DataFrame:
    """Fills as text, with broken fields, blank ids and repeated rows."""
    k = F.col("k")
    f = raw_fills(spark, sf).select(
        "event_id", F.when(k < 10, " ").otherwise(F.col("execution_id")).alias("execution_id"), "order_id",
        F.when(k == 93, None).otherwise(F.col("instrument")).alias("instrument"),
        F.when(k == 98, "HOLD").otherwise(F.col("side")).alias("side"),
        F.when(k == 97, "-1").when(k == 96, "NaN").otherwise(F.col("quantity").cast("string")).alias("quantity"),
        F.when(k == 94, "abc").otherwise(F.col("fill_price").cast("string")).alias("fill_price"),
        F.when(k == 95, "inf").otherwise(F.col("transaction_cost").cast("string")).alias("transaction_cost"),
        F.col("slippage_bps").cast("string").alias("slippage_bps"), "liquidity", "ts",
        F.date_format("ts", ISO).alias("timestamp"), "k",
    )
    copies = F.when(k % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return f.withColumn("copy", F.explode(copies)).withColumn(
        "arrival_no", F.col("event_id") * 2 + F.col("copy")).drop("copy", "k")


def validated_fills(spark, sf) -> DataFrame:
    return validate_fills(dirty_fills(spark, sf))


def ticks(spark, sf) -> DataFrame:
    """A quote up to 100 seconds before every trade, a little away from its price."""
    k = F.col("k")
    return events(spark, sf).select(
        F.concat(F.lit("t"), "event_id").alias("tick_id"), "event_id", "instrument",
        (F.col("px") * (1 + (k - 50) / 10000)).alias("price"), (1 + k % 10).cast("double").alias("quantity"),
        F.timestamp_micros(F.unix_micros("ts") - (1 + k) * F.lit(1_000_000).cast("long")).alias("ts"),
    )


def trade_ticks(spark, sf) -> DataFrame:
    """The trades themselves as a price series."""
    return events(spark, sf).select(
        F.concat(F.lit("t"), "event_id").alias("tick_id"), "event_id", "instrument", F.col("px").alias("price"),
        (1 + F.col("k") % 10).cast("double").alias("quantity"), "ts",
    )


def features(spark, sf) -> DataFrame:
    i, k = F.col("event_id"), F.col("k")
    return events(spark, sf).select(
        F.concat(F.lit("e"), i).alias("event_id"), "instrument", F.col("ts").alias("event_time"),
        F.timestamp_micros(F.unix_micros("ts") + k * F.lit(60_000_000).cast("long")).alias("ingest_time"),
        ((k - 50) / 50).alias("obi"), F.col("px").alias("midPrice"), (0.01 * (1 + k % 5)).alias("spread"),
        ((i % 21 - 10) / 2500).alias("momentum"), (i % 37 / 1500).alias("volatility"),
        (i * 7 % 101).cast("double").alias("fearGreed"), (0.5 + i % 40 / 10).alias("volumeRatio"),
        i.alias("seq"), "k", "event_type",
    )


def revisions(spark, sf) -> DataFrame:
    """Features plus later corrections of every eleventh event."""
    f = features(spark, sf)
    fix = f.where(F.col("seq") % 11 == 0).withColumns({
        "event_id": F.concat(F.lit("r"), "seq"), "obi": -F.col("obi"),
        "ingest_time": F.timestamp_micros(F.unix_micros("ingest_time") + F.lit(86_400_000_000)),
    })
    return f.unionByName(fix)


def spine(spark, sf) -> DataFrame:
    """A decision half an hour after every event."""
    return events(spark, sf).select(
        F.col("event_id").alias("spine_id"), "instrument",
        F.timestamp_micros(F.unix_micros("ts") + F.lit(1_800_000_000)).alias("decision_time"),
    )


def raw_feature_json(spark, sf) -> DataFrame:
    """Feature events as JSON text; broken text, missing fields and odd values by k."""
    f = features(spark, sf)
    k = F.col("k")
    text = lambda c: F.col(c).cast("string")
    values = F.map_from_entries(F.array(
        F.struct(F.lit("obi").alias("k"), F.when(k == 90, "abc").when(k == 91, "NaN").otherwise(text("obi")).alias("v")),
        *[F.struct(F.lit(c).alias("k"), text(c).alias("v"))
          for c in ("midPrice", "spread", "momentum", "volatility", "fearGreed", "volumeRatio")],
    ))
    values = F.map_filter(values, lambda key, v: ~((k == 92) & (key == "obi")) & ~((k % 20 == 7) & (key == "spread")))
    body = F.to_json(F.struct(
        F.when(k % 25 == 1, "").otherwise(F.col("event_id")).alias("eventId"),
        F.when(k == 88, None).otherwise(F.date_format("event_time", ISO)).alias("eventTime"),
        F.date_format("ingest_time", ISO).alias("ingestTime"),
        F.lit("obi").alias("featureName"), F.when(k == 89, None).otherwise(F.col("instrument")).alias("instrument"),
        F.when(k != 87, values).alias("values"),
    ))
    return f.select("seq", F.when(k == 99, "{bad").when(k == 98, "[1,2]").otherwise(body).alias("value"))


def books(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    level = lambda price, off: F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.struct(
        price(i).alias("price"), F.abs(F.element_at("embedding", i + off)).cast("double").alias("qty")))
    return e.select(
        F.col("vec_id").alias("book_id"), _instrument(F.col("vec_id")).alias("instrument"),
        F.lit("book").alias("symbol"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 1200).alias("ts"),
        level(lambda i: 100 - 0.01 * i, 0).alias("bids"), level(lambda i: 100.01 + 0.01 * i, 20).alias("asks"),
    )


def market_layers(spark, sf) -> DataFrame:
    """Fear-and-greed index, funding rate and a model's score, next to the feature events."""
    return features(spark, sf).select(
        "instrument", F.col("event_time").alias("ts"), "event_id", F.col("fearGreed").alias("fear_greed"),
        ((F.col("seq") % 13 - 6) / 10000).alias("funding_rate"), F.abs("obi").alias("ml_score"), F.lit(1.0).alias("ml_ready"))


def open_interest(spark, sf) -> DataFrame:
    return events(spark, sf).select(
        "instrument", "ts", "event_id", (1000 + F.col("event_id") * 37 % 500).cast("double").alias("open_interest"))


def headlines(spark, sf) -> DataFrame:
    """Documents as headlines with a classifier's text answer."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    label = F.when(F.col("quality") == 1, "bullish").when(F.col("toxic") == 1, "bearish").otherwise("neutral")
    conf = (F.col("doc_id") % 11 / 10).cast("string")
    body = F.concat(
        F.lit('{"btc": "'), label, F.lit('", "btc_confidence": '), conf,
        F.lit(', "eth": "'), F.when(F.col("doc_id") % 3 == 0, "BULLISH").otherwise("other"),
        F.lit('", "eth_confidence": '), F.when(F.col("doc_id") % 4 == 0, "7").otherwise("-1"),
        F.lit(', "sol": "'), F.when(F.col("doc_id") % 5 == 2, "bearish").otherwise("neutral"), F.lit('", "sol_confidence": 0.'),
        (F.col("doc_id") % 7).cast("string"),
        F.lit(', "xrp": "'), F.when(F.col("doc_id") % 7 == 3, " Bullish ").otherwise("bearish"), F.lit('", "xrp_confidence": "high"}'))
    answer = (
        F.when(F.col("doc_id") % 13 == 0, "no idea")
        .when(F.col("doc_id") % 13 == 1, "{broken")
        .when(F.col("doc_id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Sure: "), body, F.lit(" done")))
    )
    return d.select(
        F.col("doc_id").alias("headline_id"), F.col("text").alias("title"), "source",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("processed_at"), answer.alias("response"))


def latency(spark, sf) -> DataFrame:
    return events(spark, sf).select(
        "event_id", "ts", F.col("event_type").alias("job"), "instrument",
        (F.col("value") * 2).alias("latency_ms"), (F.col("k") > 2).alias("up"),
        F.when(F.col("k") % 2 == 0, "BUY").otherwise("SELL").alias("side"))


def order_book_orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), _instrument(F.col("o_custkey")).alias("instrument"),
        F.col("o_totalprice").alias("notional"), (1 + F.col("o_orderkey") % 10).cast("int").alias("slices"))
