"""Explicit schemas of the event streams; nothing is inferred."""

from pyspark.sql import types as T

_S, _D, _L, _B, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# Numbers arrive as text or numbers, so a fill is read as text and validated afterwards.
RAW_FILL = _struct(
    execution_id=_S, order_id=_S, instrument=_S, side=_S, quantity=_S, fill_price=_S,
    transaction_cost=_S, slippage_bps=_S, liquidity=_S, timestamp=_S,
)
FILL = _struct(
    execution_id=_S, order_id=_S, instrument=_S, side=_S, quantity=_D, fill_price=_D,
    transaction_cost=_D, slippage_bps=_D, liquidity=_S, ts=_TS,
)
RAW_FEATURE = T.StructType([
    *_struct(
        eventId=_S, eventTime=_S, event_time=_S, timestamp=_S, ingestTime=_S, codeVersion=_S,
        inputEventIds=T.ArrayType(_S), featureName=_S, featureVersion=_S, instrument=_S,
        windowStart=_S, windowEnd=_S, signalTimeMs=_L,
    ).fields,
    T.StructField("values", T.MapType(_S, _S)),
])
TICK = _struct(
    type=_S, instrument=_S, price=_D, Price=_D, mid=_D, midPrice=_D, quantity=_D, timestamp=_S,
    trade_time=_L, is_buyer_maker=_B, values=T.MapType(_S, _D),
)
RAW_TICK = _struct(
    type=_S, instrument=_S, price=_S, mid=_S, midPrice=_S, quantity=_S, timestamp=_S,
    trade_time=_L, is_buyer_maker=_B, values=T.MapType(_S, _S),
)
TRADE = _struct(
    eventId=_S, eventTime=_S, ingestTime=_S, source=_S,
    instrument=_struct(
        symbol=_S, baseAsset=_S, quoteAsset=_S,
        exchange=_struct(id=_S, displayName=_S, timezone=_S),
    ),
    sequenceNumber=_L, schemaVersion=_S, price=_D, size=_D, side=_S, exchangeTradeId=_S,
)
BOOK_LEVEL = _struct(price=_D, qty=_D)
BOOK = _struct(
    lastUpdateId=_L, bids=T.ArrayType(BOOK_LEVEL), asks=T.ArrayType(BOOK_LEVEL),
)

# The keys a published feature event must carry.
REQUIRED_TOP_LEVEL = [
    "eventId", "eventTime", "ingestTime", "codeVersion", "inputEventIds", "featureName",
    "featureVersion", "instrument", "windowStart", "windowEnd", "signalTimeMs", "values",
]
REQUIRED_VALUES = [
    "obi", "bidVolume", "askVolume", "spread", "midPrice", "levels", "momentum", "momentum1m",
    "momentum15m", "emaFast", "emaSlow", "volatility", "atr", "volumeRatio", "fearGreed",
    "fundingRate", "oiChange", "mlScore", "mlReady", "newsSentiment", "regimeVolAnn",
    "regimeHurst", "regimeAutocorr", "regimeConfidence",
]
