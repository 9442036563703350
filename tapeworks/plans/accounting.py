"""Registered queries: intake, validation, fill accounting, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import ledger, quality, risk
from tapeworks.plans import views
from tapeworks.plans.registry import pick, query, shared, time_cuts
from tapeworks.sources import readers, schemas

CASH = 100_000.0


def clean_fills(spark, sf):
    valid = quality.typed_fills(views.validated_fills(spark, sf))
    return quality.dedup_fills(valid, order=["arrival_no"])


def cuts(spark, sf):
    return time_cuts(spark, sf, lambda: views.fills(spark, sf), ["ts", "execution_id"])


def positions(spark, sf):
    return shared(spark, sf, "positions", lambda: ledger.signed_positions(views.fills(spark, sf), cuts=cuts(spark, sf)))


def equity(spark, sf):
    return shared(spark, sf, "equity", lambda: ledger.equity_curve(positions(spark, sf), initial_cash=CASH, cuts=cuts(spark, sf)))


def matches(spark, sf):
    return shared(spark, sf, "matches", lambda: ledger.fifo_match(views.fills(spark, sf), cuts=cuts(spark, sf)))


def trips(spark, sf):
    return ledger.round_trips(positions(spark, sf))


def drawdowns(spark, sf):
    return shared(spark, sf, "drawdowns", lambda: ledger.drawdown_points(equity(spark, sf), initial_cash=CASH, cuts=cuts(spark, sf)))


@query("net_pnl_by_instrument", """
SELECT instrument, count(*) AS trades, count(*) FILTER (WHERE opposes) AS round_trips,
  snap(avg(CASE WHEN realized - transaction_cost > 0 THEN 1 ELSE 0 END) FILTER (WHERE opposes), 6) AS win_rate,
  snap(sum(realized - transaction_cost) FILTER (WHERE opposes), 4) AS net_pnl,
  arg_max(qn, rn) AS position, snap(arg_max(an, rn), 6) AS avg_cost
FROM x_cl_pos GROUP BY instrument""")
def net_pnl_by_instrument(spark, sf):
    # the scans read the cleaned fills several times
    clean = shared(spark, sf, "clean_fills", lambda: clean_fills(spark, sf))
    pos = ledger.signed_positions(clean, uid="event_id", cuts=cuts(spark, sf))
    return risk.by_instrument(pos, uid="event_id").transform(pick, "instrument", "trades", "round_trips", "snap(win_rate, 6) win_rate", "snap(net_pnl, 4) net_pnl",
        "position", "snap(avg_cost, 6) avg_cost")


@query("io1_read_features", """
SELECT CASE WHEN k % 25 = 1 THEN NULL ELSE event_id END AS event_id,
  CASE WHEN k <> 89 THEN instrument END AS instrument, CASE WHEN k <> 88 THEN epoch_us(event_time) END AS event_us,
  epoch_us(ingest_time) AS ingest_us,
  CASE WHEN k NOT IN (87, 90, 91, 92) THEN snap(obi, 6) END AS obi FROM x_feat WHERE k NOT IN (98, 99)""")
def io1(spark, sf):
    return readers.read_features(views.raw_feature_json(spark, sf)).transform(pick, "event_id", "instrument", "unix_micros(event_time) event_us", "unix_micros(ingest_time) ingest_us",
        "snap(if(isnan(try_cast(values['obi'] as double)), null, try_cast(values['obi'] as double)), 6) obi")


def _fill_json(spark, sf):
    raw = views.dirty_fills(spark, sf)
    return raw.select("arrival_no", F.to_json(F.struct(*[c for c in schemas.RAW_FILL.fieldNames()])).alias("value"))


@query("io2_read_fills", """
SELECT execution_id, order_id, instrument, side, count(*) AS n, snap(sum(TRY_CAST(quantity AS DOUBLE))
  FILTER (WHERE isfinite(TRY_CAST(quantity AS DOUBLE))), 6) AS quantity
FROM x_dirty GROUP BY execution_id, order_id, instrument, side""")
def io2(spark, sf):
    q = F.col("quantity").try_cast("double")
    return readers.read_fills(_fill_json(spark, sf)).groupBy("execution_id", "order_id", "instrument", "side").agg(
        F.count("*").alias("n"), F.round(F.sum(F.when(~F.isnan(q), q)), 6).alias("quantity"))


@query("io3_read_ticks", """
SELECT instrument, snap(CASE k % 3 WHEN 0 THEN px WHEN 1 THEN px ELSE px END, 6) AS price,
  epoch_us(ts) AS ts_us FROM x_ev WHERE k NOT IN (1, 2, 3)""")
def io3(spark, sf):
    e = views.events(spark, sf)
    k, px = F.col("k"), F.col("px").cast("string")
    price = F.when(k == 1, "-5").when(k == 2, "NaN").when(k == 3, "inf").otherwise(px)
    body = F.to_json(F.struct(
        F.lit("tick").alias("type"), "instrument", F.when((k % 3 == 0) | (k < 4), price).alias("price"),
        F.when((k % 3 == 1) & (k >= 4), price).alias("mid"),
        F.when((k % 3 == 2) & (k >= 4), F.create_map(F.lit("midPrice"), price)).alias("values"),
        F.date_format("ts", views.ISO).alias("timestamp")))
    return readers.read_ticks(e.select(body.alias("value"))).transform(pick, "instrument", "snap(price, 6) price", "unix_micros(ts) ts_us")


@query("io4_read_trades", """
SELECT 'tr' || event_id AS event_id, instrument, epoch_us(ts) AS event_us, snap(px, 6) AS price,
  CAST(1 + k AS DOUBLE) AS size, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 'x1' AS exchange FROM x_ev""")
def io4(spark, sf):
    e = views.events(spark, sf)
    base = F.split_part("instrument", F.lit("-"), F.lit(1))
    body = F.to_json(F.struct(
        F.concat(F.lit("tr"), "event_id").alias("eventId"), F.date_format("ts", views.ISO).alias("eventTime"),
        F.struct(F.concat(base, F.lit("USDT")).alias("symbol"), base.alias("baseAsset"), F.lit("USDT").alias("quoteAsset"),
                 F.struct(F.lit("x1").alias("id"), F.lit("X").alias("displayName"), F.lit("UTC").alias("timezone")).alias("exchange")
                 ).alias("instrument"),
        F.col("event_id").alias("sequenceNumber"), F.col("px").alias("price"), (1 + F.col("k")).cast("double").alias("size"),
        F.when(F.col("k") % 2 == 0, "BUY").otherwise("SELL").alias("side")))
    return readers.read_trades(e.select(body.alias("value"))).transform(pick, "event_id", "instrument", "unix_micros(event_time) event_us", "snap(price, 6) price", "size", "side", "exchange")


@query("io5_feature_capture", """
SELECT event_id, instrument, epoch_us(event_time) AS event_us FROM x_feat""")
def io5(spark, sf):
    """Write a capture, read it back."""
    import uuid

    from tapeworks.session import durable_dir
    f = views.features(spark, sf)
    lines = f.select(F.to_json(F.struct(
        F.col("event_id").alias("eventId"), "instrument", F.date_format("event_time", views.ISO).alias("eventTime"))).alias("value"))
    path = f"{durable_dir(spark)}/capture-{uuid.uuid4().hex}"
    readers.write_feature_capture(lines, path)
    return readers.read_feature_capture(spark, path).transform(pick, "event_id", "instrument", "unix_micros(event_time) event_us")


@query("io6_replay_twice", """
SELECT reason, count(*) AS n FROM (SELECT coalesce(reason, 'processed') AS reason,
  row_number() OVER (PARTITION BY coalesce(reason, coalesce(nullif(trim(execution_id), ''),
  concat_ws('|', order_id, ts, side, quantity, fill_price))) ORDER BY arrival_no) AS n FROM x_checked WHERE reason IS NULL)
WHERE n = 1 GROUP BY reason""")
def io6(spark, sf):
    """Reading a topic twice from the start gives the same fills as reading it once."""
    import uuid

    from tapeworks.session import durable_dir
    topic = f"{durable_dir(spark)}/fills-{uuid.uuid4().hex}"
    lines = views.dirty_fills(spark, sf).drop("ts")
    lines.select(F.to_json(F.struct(*lines.columns)).alias("value")).write.text(topic)
    read = lambda: readers.good_records(readers.decode(readers.read_records(spark, topic), lines.schema))
    twice = quality.validate_fills(read().unionByName(read()))
    return quality.dedup_fills(quality.typed_fills(twice), order=["arrival_no"]).groupBy(
        F.lit("processed").alias("reason")).agg(F.count("*").alias("n"))


@query("io8_dead_letters", """
SELECT 'features.dlq' AS topic, CASE WHEN k = 99 THEN '{bad' ELSE '[1,2]' END AS raw, count(*) AS n
FROM x_feat WHERE k IN (98, 99) GROUP BY 1, 2""")
def io8(spark, sf):
    decoded = readers.decode(views.raw_feature_json(spark, sf), schemas.RAW_FEATURE)
    return readers.dead_letters(decoded, "features").groupBy("topic", "raw").agg(F.count("*").alias("n"))


@query("v1_validate_fills", """
SELECT arrival_no, reason IS NULL AS ok, reason FROM x_checked""")
def v1(spark, sf):
    return views.validated_fills(spark, sf).select("arrival_no", "ok", "reason")


@query("v2_reject_counts", "SELECT coalesce(reason, 'processed') AS reason, count(*) AS n FROM x_checked GROUP BY 1")
def v2(spark, sf):
    return quality.reject_counts(views.validated_fills(spark, sf))


@query("v3_v4_normalize", """
SELECT side, liq, count(*) AS n FROM (SELECT CASE k % 5 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN 'BUY' WHEN 3 THEN 'SELL' END AS side,
  CASE k % 7 WHEN 0 THEN 'maker' WHEN 1 THEN 'taker' WHEN 2 THEN 'maker' WHEN 3 THEN 'taker' WHEN 4 THEN 'maker' END AS liq FROM x_ev)
GROUP BY side, liq""")
def v34(spark, sf):
    e = views.events(spark, sf)
    spell = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("k") % len(xs) + 1).cast("int"))
    return e.select(
        quality.normalize_side(spell([" buy ", "1", "b", "Sell", "hold"])).alias("side"),
        quality.normalize_liquidity(spell(["Passive", "REMOVED", "true", " 0", "1", "maybe", ""])).alias("liq"),
    ).groupBy("side", "liq").agg(F.count("*").alias("n"))


@query("v5_normalize_ts", """
SELECT event_id, CASE k % 4 WHEN 3 THEN NULL WHEN 1 THEN epoch_us(ts) - 7200000000 ELSE epoch_us(ts) END AS ts_us FROM x_ev""")
def v5(spark, sf):
    e = views.events(spark, sf)
    k = F.col("k") % 4
    bare = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(k == 0, F.concat(bare, F.lit("Z"))).when(k == 1, F.concat(bare, F.lit("+02:00"))).when(k == 2, bare).otherwise("soon")
    return e.select("event_id", F.unix_micros(quality.parse_ts(text)).alias("ts_us"))


@query("v6_field_aliases", """
SELECT event_id, CASE WHEN k % 3 = 2 THEN NULL ELSE instrument END AS instrument FROM x_ev""")
def v6(spark, sf):
    k = F.col("k") % 3
    e = views.events(spark, sf).select(
        "event_id", F.when(k == 0, F.col("instrument")).alias("instrument_id"), F.when(k == 1, F.col("instrument")).alias("InstrumentId"))
    # column names are case-insensitive in Spark, so Pascal-case text keys arrive under their own name
    return e.select("event_id", quality.first_of(e, "instrument_id", "InstrumentId").alias("instrument"))


@query("v7_extract_record", """
SELECT CASE WHEN k % 25 = 1 THEN NULL ELSE event_id END AS event_id, CASE WHEN k <> 89 THEN instrument END AS instrument,
  CASE WHEN k <> 88 THEN epoch_us(event_time) END AS event_us, k IN (88, 89) AS quarantined FROM x_feat WHERE k NOT IN (98, 99)""")
def v7(spark, sf):
    f = readers.read_features(views.raw_feature_json(spark, sf))
    return quality.extract_record(f).transform(pick, "event_id", "instrument", "unix_micros(event_time) event_us", "quarantined")


@query("v8_validate_features", """
SELECT CASE WHEN k % 25 = 1 THEN NULL ELSE event_id END AS event_id, epoch_us(ingest_time) AS ingest_us, CASE k WHEN 89 THEN 'missing_instrument' WHEN 87 THEN 'missing_values'
  WHEN 92 THEN 'missing_obi' WHEN 90 THEN 'non_numeric_obi' WHEN 91 THEN 'nan_inf_obi' END AS reason
  FROM x_feat WHERE k NOT IN (98, 99)""")
def v8(spark, sf):
    f = readers.read_features(views.raw_feature_json(spark, sf))
    return quality.validate_features(f).transform(pick, "event_id", "unix_micros(ingest_time) ingest_us", "reason")


@query("v9_coerce_values", """
SELECT event_id, snap(CASE WHEN k IN (87, 90, 91, 92) THEN 0 ELSE obi END, 6) AS obi,
  snap(CASE WHEN k = 87 OR k % 20 = 7 THEN 0 ELSE spread END, 6) AS spread,
  snap(CASE WHEN k = 87 THEN 1 ELSE midPrice END, 6) AS midPrice, k IN (87, 90, 91, 92) AS obi_defaulted
FROM (SELECT * REPLACE (CASE WHEN k % 25 = 1 THEN NULL ELSE event_id END AS event_id) FROM x_feat WHERE k NOT IN (98, 99))""")
def v9(spark, sf):
    f = readers.read_features(views.raw_feature_json(spark, sf))
    return quality.coerce_values(f).transform(pick, "event_id", "snap(obi, 6) obi", "snap(spread, 6) spread", "snap(midPrice, 6) midPrice", "obi_defaulted")


@query("v9_default_counts", """
SELECT feature, count(*) FILTER (WHERE (feature = 'obi' AND k IN (87, 90, 91, 92)) OR (feature = 'spread' AND (k = 87 OR k % 20 = 7))
  OR (feature NOT IN ('obi', 'spread') AND k = 87)) AS defaulted
FROM x_feat, (SELECT unnest(['obi', 'midPrice', 'spread', 'momentum', 'volatility', 'fearGreed', 'volumeRatio']) AS feature)
WHERE k NOT IN (98, 99) GROUP BY feature""")
def v9_counts(spark, sf):
    f = readers.read_features(views.raw_feature_json(spark, sf))
    return quality.default_counts(quality.coerce_values(f))


# what the raw events of the fixture hold; all other required keys are missing in every one
_HELD = ("eventId", "eventTime", "ingestTime", "featureName", "instrument", "values")
_HELD_VALUES = ("obi", "midPrice", "spread", "momentum", "volatility", "fearGreed", "volumeRatio")
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)


@query("v10_contract_check", f"""
SELECT problem, field, count(*) AS n FROM (
  SELECT 'missing_top_level' AS problem, f AS field FROM x_feat, (SELECT unnest([{_quoted(k for k in schemas.REQUIRED_TOP_LEVEL if k not in _HELD)}]) AS f) WHERE k NOT IN (98, 99)
  UNION ALL SELECT 'missing_top_level', 'eventTime' FROM x_feat WHERE k = 88
  UNION ALL SELECT 'missing_top_level', 'instrument' FROM x_feat WHERE k = 89
  UNION ALL SELECT 'missing_top_level', 'values' FROM x_feat WHERE k = 87
  UNION ALL SELECT 'missing_value', f FROM x_feat, (SELECT unnest([{_quoted(k for k in schemas.REQUIRED_VALUES if k not in _HELD_VALUES)}]) AS f) WHERE k NOT IN (98, 99)
  UNION ALL SELECT 'missing_value', f FROM x_feat, (SELECT unnest([{_quoted(_HELD_VALUES)}]) AS f) WHERE k = 87
  UNION ALL SELECT 'missing_value', 'obi' FROM x_feat WHERE k = 92
  UNION ALL SELECT 'missing_value', 'spread' FROM x_feat WHERE k % 20 = 7 AND k <> 87
  UNION ALL SELECT 'non_numeric_value', 'obi' FROM x_feat WHERE k IN (90, 91)) GROUP BY problem, field""")
def v10(spark, sf):
    raw = readers.decode(views.raw_feature_json(spark, sf), schemas.RAW_FEATURE).where(F.col("record").isNotNull())
    keyed = raw.select("seq", F.json_object_keys("value").alias("keys"), F.col("record.values").alias("values"))
    return quality.contract_violations(
        keyed, "keys", "values", schemas.REQUIRED_TOP_LEVEL, schemas.REQUIRED_VALUES
    ).groupBy("problem", "field").agg(F.count("*").alias("n"))


@query("v11_symbol_to_instrument", """
SELECT event_id, CASE k % 4 WHEN 0 THEN b || '-USDT' WHEN 1 THEN b || '-BTC' WHEN 2 THEN b || '-USD' ELSE b || 'EUR' END AS instrument
FROM (SELECT *, split_part(instrument, '-', 1) AS b FROM x_ev)""")
def v11(spark, sf):
    base = F.lower(F.split_part("instrument", F.lit("-"), F.lit(1)))
    tail = F.element_at(F.array(*[F.lit(x) for x in ("usdt", "btc", "usd", "eur")]), (F.col("k") % 4 + 1).cast("int"))
    return views.events(spark, sf).select(
        "event_id", quality.symbol_to_instrument(F.concat(base, tail)).alias("instrument"))


@query("v12_kline_window", """
SELECT instrument, d, CASE WHEN d % 7 = 0 THEN epoch_us(last_ts) ELSE lo * 1000 END AS start_us,
  CASE WHEN d % 7 = 0 THEN epoch_us(last_ts) ELSE (hi + 299999) * 1000 END AS end_us FROM (
  SELECT instrument, dayofmonth(ts) AS d, min(epoch_us(ts) // 1000) AS lo, max(epoch_us(ts) // 1000) AS hi, max(ts) AS last_ts
  FROM x_ev GROUP BY 1, 2)""")
def v12(spark, sf):
    e = views.events(spark, sf).withColumn("d", F.dayofmonth("ts"))
    ms = F.when(F.col("d") % 7 != 0, F.unix_millis("ts"))
    k = e.select("instrument", "d", ms.alias("open_ms"), (ms + 299999).alias("close_ms"), "ts")
    return quality.kline_window(k, key=["instrument", "d"], open_ms="open_ms", close_ms="close_ms", fallback="ts").transform(pick, "instrument", "d", "unix_micros(window_start) start_us", "unix_micros(window_end) end_us")


@query("v13_values_long", """
SELECT event_id, feature, snap(value, 6) AS value FROM (SELECT event_id, obi, midPrice, momentum FROM x_feat)
UNPIVOT (value FOR feature IN (obi, midPrice, momentum))""")
def v13(spark, sf):
    f = views.features(spark, sf)
    m = F.create_map(*[x for c in ("obi", "midPrice", "momentum") for x in (F.lit(c), F.col(c))])
    return quality.values_long(f.select("event_id", m.alias("values")), keep=["event_id"]).transform(pick, "event_id", "feature", "snap(value, 6) value")


@query("d1_dedup_fills", "SELECT arrival_no, instrument, side FROM x_clean")
def d1(spark, sf):
    return clean_fills(spark, sf).select("arrival_no", "instrument", "side")


@query("d2_dedup_events", """
SELECT id AS event_id, count(*) AS n FROM (SELECT CASE WHEN k < 5 THEN NULL ELSE 'd' || (event_id // 3) END AS id,
  row_number() OVER (PARTITION BY event_id // 3, k < 5 ORDER BY event_id) AS rn, k FROM x_ev) WHERE rn = 1 OR k < 5 GROUP BY id""")
def d2(spark, sf):
    e = views.events(spark, sf).select(
        F.when(F.col("k") >= 5, F.concat(F.lit("d"), F.floor(F.col("event_id") / 3))).alias("event_id"), F.col("event_id").alias("arrival"))
    return quality.dedup_events(e, order=["arrival"]).groupBy("event_id").agg(F.count("*").alias("n"))


@query("d3_dedup_by_order_id", """
SELECT arrival_no FROM (SELECT arrival_no, row_number() OVER (PARTITION BY coalesce(nullif(trim(execution_id), ''), order_id)
  ORDER BY arrival_no) AS n FROM x_checked WHERE reason IS NULL) WHERE n = 1""")
def d3(spark, sf):
    valid = quality.typed_fills(views.validated_fills(spark, sf))
    return quality.dedup_fills(valid, order=["arrival_no"], fallback="order_id").select("arrival_no")


@query("d4_headline_dedup", """
SELECT headline_id, sha256(title) AS title_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY title ORDER BY processed_at, headline_id) AS n FROM x_head) WHERE n = 1""")
def d4(spark, sf):
    return quality.dedup_headlines(views.headlines(spark, sf), order=["processed_at", "headline_id"]).select("headline_id", "title_hash")


@query("d4_headline_expiry", """
SELECT headline_id FROM (
  SELECT title, rank FROM x_titles WHERE rank = 1 UNION ALL SELECT title, rank FROM x_title_orbit) JOIN x_titles USING (title, rank)""")
def d4x(spark, sf):
    """A title counts again two hours after it was last kept."""
    return quality.dedup_headlines_within(views.headlines(spark, sf)).select("headline_id")


@query("d5_latest_per_order", "SELECT order_id, arg_max(execution_id, (ts, execution_id)) AS execution_id FROM x_fills GROUP BY order_id")
def d5(spark, sf):
    return quality.latest_per_order(views.fills(spark, sf)).select("order_id", "execution_id")


@query("a1_signed_positions", """
SELECT execution_id, instrument, qn AS qty, snap(an, 6) AS avg_cost FROM x_pos""")
def a1(spark, sf):
    return positions(spark, sf).transform(pick, "execution_id", "instrument", "qty", "snap(avg_cost, 6) avg_cost")


@query("a2_round_trips", """
SELECT execution_id, instrument, snap(pnl, 6) AS pnl, snap(fee, 8) AS fee, snap(net_pnl, 5) AS net_pnl FROM x_trips""")
def a2(spark, sf):
    return trips(spark, sf).transform(pick, "execution_id", "instrument", "snap(pnl, 6) pnl", "snap(fee, 8) fee", "snap(net_pnl, 5) net_pnl")


@query("a3_slippage_attribution", """
SELECT execution_id, snap(sn, 6) AS open_slippage, snap(released, 6) AS released FROM x_pos""")
def a3(spark, sf):
    return positions(spark, sf).transform(pick, "execution_id", "snap(open_slippage, 6) open_slippage", "snap(released_slippage, 6) released")


@query("a4_cash_ledger", "SELECT execution_id, snap(cash, 4) AS cash FROM x_equity")
def a4(spark, sf):
    return ledger.cash_ledger(positions(spark, sf), initial_cash=CASH, cuts=cuts(spark, sf)).transform(pick, "execution_id", "snap(cash, 4) cash")


@query("a5_equity_curve", """
SELECT execution_id, snap(value, 3) AS value, snap(pnl, 3) AS pnl, snap(fees, 3) AS fees, fills FROM x_equity""")
def a5(spark, sf):
    return equity(spark, sf).transform(pick, "execution_id", "snap(value, 3) value", "snap(pnl, 3) pnl", "snap(fees, 3) fees", "fills")


@query("a5_equity_mark_to_market", "SELECT execution_id, snap(value_mtm, 4) AS value FROM x_equity")
def a5m(spark, sf):
    return ledger.equity_curve(positions(spark, sf), initial_cash=CASH, mark_to_market=True, cuts=cuts(spark, sf)).transform(pick, "execution_id", "snap(value, 4) value")


@query("a6_drawdown_points", "SELECT execution_id, snap(peak, 4) AS peak, snap(dd, 4) AS drawdown, snap(dd_pct, 8) AS drawdown_pct FROM x_dd")
def a6(spark, sf):
    return drawdowns(spark, sf).transform(pick, "execution_id", "snap(peak, 4) peak", "snap(drawdown, 4) drawdown", "snap(drawdown_pct, 8) drawdown_pct")


_DRAWDOWN = """
SELECT (SELECT snap(arg_max(dd, (dd_pct, dd)), 4) FROM x_dd WHERE ts <= TIMESTAMP '{t}') AS max_drawdown,
  (SELECT snap(max(dd_pct), 8) FROM x_dd WHERE ts <= TIMESTAMP '{t}') AS max_drawdown_pct,
  coalesce(snap(max(epoch_us(nxt) - epoch_us(dd_start)) / 1e6, 4), 0) AS max_secs,
  coalesce(snap(max(CASE WHEN nxt IS NULL THEN epoch_us(TIMESTAMP '{t}') - epoch_us(dd_start) END) / 1e6, 4), 0) AS open_secs
FROM (SELECT dd_start, lead(t) OVER (ORDER BY t) AS nxt FROM (
  SELECT min(ts) AS t, min(ts) FILTER (WHERE dd_pct > 1e-4) AS dd_start FROM x_dd WHERE ts <= TIMESTAMP '{t}' GROUP BY peak))"""


@query("a6_drawdown_summary", _DRAWDOWN.format(t=views.AS_OF))
def a6s(spark, sf, as_of=views.AS_OF):
    return ledger.drawdown_summary(drawdowns(spark, sf), as_of=as_of).transform(pick, "snap(max_drawdown, 4) max_drawdown", "snap(max_drawdown_pct, 8) max_drawdown_pct",
        "snap(max_dd_duration_secs, 4) max_secs", "snap(current_dd_duration_secs, 4) open_secs")


@query("a6_drawdown_summary_mid", _DRAWDOWN.format(t=views.AS_OF_MID))
def a6s_mid(spark, sf):
    return a6s(spark, sf, views.AS_OF_MID)


@query("a7_unrealized", """
SELECT execution_id, snap(qn * fill_price, 5) AS market_value, snap(qn * (fill_price - an), 5) AS unrealized FROM x_pos""")
def a7(spark, sf):
    return ledger.unrealized(positions(spark, sf)).transform(pick, "execution_id", "snap(market_value, 5) market_value", "snap(unrealized, 5) unrealized")


@query("a8_last_price", "SELECT instrument, snap(arg_max(fill_price, (ts, execution_id)), 6) AS last_price FROM x_fills GROUP BY instrument")
def a8(spark, sf):
    return ledger.last_prices(views.fills(spark, sf)).transform(pick, "instrument", "snap(last_price, 6) last_price")


@query("a9_fifo_match", """
SELECT entry_id, exit_id, instrument, CASE WHEN way > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, qty, snap(pnl, 5) AS pnl FROM x_match""")
def a9(spark, sf):
    return matches(spark, sf).transform(pick, "entry_id", "exit_id", "instrument", "direction", "qty", "snap(pnl, 5) pnl")


@query("a10_fifo_labels", "SELECT entry_id, instrument, qty, label, epoch_us(label_time) AS label_us, snap(pnl, 5) AS pnl FROM x_labels")
def a10(spark, sf):
    return ledger.fifo_labels(matches(spark, sf)).transform(pick, "entry_id", "instrument", "qty", "label", "unix_micros(label_time) label_us", "snap(pnl, 5) pnl")


@query("a11_recent_trades", """
SELECT execution_id, snap(net_pnl, 5) AS net_pnl FROM x_trips ORDER BY time DESC, execution_id DESC LIMIT 50""")
def a11(spark, sf):
    return ledger.recent(trips(spark, sf), 50).transform(pick, "execution_id", "snap(net_pnl, 5) net_pnl")


@query("r1_change_series", "SELECT execution_id, snap(change, 5) AS change FROM x_equity WHERE fills > 1")
def r1(spark, sf):
    return risk.change_series(equity(spark, sf)).transform(pick, "execution_id", "snap(change, 5) change")


_RATIO_SQL = """
SELECT h AS hours, n, CASE WHEN n < 2 THEN 0 ELSE snap(mean / (CASE WHEN sd > 0 THEN sd ELSE 0.001 END) * sqrt(n / greatest(h, 1) * 8760), 4) END AS sharpe,
  CASE WHEN n < 2 THEN 0 WHEN down > 0 THEN snap(mean / sqrt(down / n) * sqrt(n / greatest(h, 1) * 8760), 4)
    WHEN mean > 0 THEN 99 ELSE 0 END AS sortino
FROM (SELECT h, count(change) AS n, avg(change) AS mean, stddev_pop(change) AS sd, sum(change * change) FILTER (WHERE change < 0) AS down
  FROM (VALUES (1), (6), (24)) t(h) LEFT JOIN x_equity e ON e.fills > 1
    AND (epoch_us(TIMESTAMP '{t}') - epoch_us(ts)) / 3.6e9 BETWEEN 0 AND h GROUP BY h)"""


@query("r2_r3_rolling_ratios_mid", _RATIO_SQL.format(t=views.AS_OF_MID))
def r2_mid(spark, sf):
    return r2(spark, sf, views.AS_OF_MID)


@query("r2_r3_rolling_ratios", _RATIO_SQL.format(t=views.AS_OF))
def r2(spark, sf, as_of=views.AS_OF):
    return risk.rolling_ratios(equity(spark, sf), as_of=as_of).transform(pick, "hours", "n", "snap(sharpe, 4) sharpe", "snap(sortino, 4) sortino")


@query("r4_cvar", """
SELECT count(*) AS n, snap(avg(net_pnl) FILTER (WHERE rn <= greatest(1, CAST(floor(m * 5 / 100) AS BIGINT))), 4) AS cvar FROM (
  SELECT net_pnl, row_number() OVER (ORDER BY net_pnl, execution_id) AS rn, count(*) OVER () AS m FROM x_trips)""")
def r4(spark, sf):
    return risk.cvar(trips(spark, sf)).transform(pick, "n", "snap(cvar, 4) cvar")


@query("r5_r6_r7_trade_stats", """
SELECT n AS round_trips, w AS wins, l AS losses, snap(w / (w + l), 6) AS win_rate, snap(gp / gl, 6) AS profit_factor,
  snap(gp / w, 5) AS avg_win, snap(gl / l, 5) AS avg_loss,
  snap(least(greatest((gp / w / (gl / l) * (w / (w + l)) - (1 - w / (w + l))) / (gp / w / (gl / l)) / 2, 0), 0.25), 6) AS half_kelly
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE net_pnl > 0) AS w, count(*) FILTER (WHERE net_pnl < 0) AS l,
  sum(net_pnl) FILTER (WHERE net_pnl > 0) AS gp, -sum(net_pnl) FILTER (WHERE net_pnl < 0) AS gl FROM x_trips)""")
def r567(spark, sf):
    return risk.trade_stats(trips(spark, sf)).transform(pick, "round_trips", "wins", "losses", "snap(win_rate, 6) win_rate", "snap(profit_factor, 6) profit_factor",
        "snap(avg_win, 5) avg_win", "snap(avg_loss, 5) avg_loss", "snap(half_kelly, 6) half_kelly")


_CALMAR = """
SELECT snap(v, 4) AS last_value, snap((v / 100000 - 1) / greatest((epoch_us(TIMESTAMP '{t}') - epoch_us(t0)) / 1e6 / (365.25 * 86400), 0.001) / m, 5) AS calmar
FROM (SELECT arg_max(value, (ts, execution_id)) AS v, min(ts) AS t0 FROM x_equity WHERE ts <= TIMESTAMP '{t}'),
  (SELECT max(dd_pct) AS m FROM x_dd WHERE ts <= TIMESTAMP '{t}')"""


@query("r8_calmar_mid", _CALMAR.format(t=views.AS_OF_MID))
def r8_mid(spark, sf):
    return r8(spark, sf, views.AS_OF_MID)


@query("r8_calmar", _CALMAR.format(t=views.AS_OF))
def r8(spark, sf, as_of=views.AS_OF):
    dd = ledger.drawdown_summary(drawdowns(spark, sf), as_of=as_of)
    return risk.calmar(equity(spark, sf), dd, as_of=as_of, initial_cash=CASH).transform(pick, "snap(last_value, 4) last_value", "snap(calmar, 5) calmar")


@query("r9_performance_summary", """
SELECT count(*) AS total_fills, count(*) FILTER (WHERE opposes) AS round_trips, snap(sum(realized), 4) AS realized_pnl,
  snap(sum(transaction_cost), 4) AS total_fees, snap(sum(sc), 4) AS total_slippage,
  snap(sum(realized) - sum(transaction_cost), 4) AS net_trading_pnl,
  snap(sum(transaction_cost) / greatest(abs(sum(realized)), 0.01) * 100, 4) AS fee_drag_pct FROM x_pos""")
def r9(spark, sf):
    return risk.performance_summary(positions(spark, sf)).transform(pick, "total_fills", "round_trips", "snap(realized_pnl, 4) realized_pnl", "snap(total_fees, 4) total_fees",
        "snap(total_slippage, 4) total_slippage", "snap(net_trading_pnl, 4) net_trading_pnl", "snap(fee_drag_pct, 4) fee_drag_pct")


@query("r10_by_instrument", """
SELECT instrument, count(*) AS trades, count(*) FILTER (WHERE opposes) AS round_trips,
  snap(avg(CASE WHEN realized - transaction_cost > 0 THEN 1 ELSE 0 END) FILTER (WHERE opposes), 6) AS win_rate,
  snap(sum(realized - transaction_cost) FILTER (WHERE opposes), 4) AS net_pnl,
  arg_max(qn, rn) AS position, snap(arg_max(an, rn), 6) AS avg_cost FROM x_pos GROUP BY instrument""")
def r10(spark, sf):
    return risk.by_instrument(positions(spark, sf)).transform(pick, "instrument", "trades", "round_trips", "snap(win_rate, 6) win_rate", "snap(net_pnl, 4) net_pnl",
        "position", "snap(avg_cost, 6) avg_cost")


@query("r11_correlation_matrix", """
SELECT a.instrument AS a, b.instrument AS b, count(*) AS n, snap(corr(a.ret, b.ret), 6) AS corr
FROM x_tail a JOIN x_tail b ON a.pos = b.pos AND a.instrument < b.instrument GROUP BY 1, 2 HAVING count(*) >= 5""")
def r11(spark, sf):
    return risk.pair_correlations(risk.ranked_returns(trips(spark, sf), cuts=cuts(spark, sf))).transform(pick, "a", "b", "n", "snap(corr, 6) corr")


@query("r12_portfolio_var", """
SELECT count(*) AS instruments, snap(sqrt(any_value(v)) * 1.645 * 100, 4) AS var_95, snap(sqrt(any_value(v)) * 2.326 * 100, 4) AS var_99,
  snap((1 - sqrt(any_value(v)) / (sum(s) / count(*))) * 100, 5) AS diversification_benefit
FROM (SELECT instrument, stddev_pop(ret) AS s FROM x_tail GROUP BY instrument), (
  SELECT sum(x.s * y.s * CASE WHEN x.instrument = y.instrument THEN 1 ELSE c END) / (count(DISTINCT x.instrument) ** 2) AS v
  FROM (SELECT instrument, stddev_pop(ret) AS s FROM x_tail GROUP BY instrument) x
  JOIN (SELECT instrument, stddev_pop(ret) AS s FROM x_tail GROUP BY instrument) y ON true
  LEFT JOIN (SELECT a.instrument AS i, b.instrument AS j, corr(a.ret, b.ret) AS c FROM x_tail a JOIN x_tail b ON a.pos = b.pos GROUP BY 1, 2)
    ON i = x.instrument AND j = y.instrument)""")
def r12(spark, sf):
    return risk.portfolio_var(risk.ranked_returns(trips(spark, sf), cuts=cuts(spark, sf))).transform(pick, "instruments", "snap(var_95, 4) var_95", "snap(var_99, 4) var_99", "snap(diversification_benefit, 5) diversification_benefit")


@query("r13_portfolio_construction", """
SELECT instrument, snap(w, 6) AS weight, snap(abs(w) * vol / sum(abs(w) * vol) OVER (), 6) AS risk_contribution,
  snap(avg(c) OVER (), 6) AS market, snap(avg(mean) OVER (), 5) AS momentum, snap(avg(vol) OVER (), 5) AS volatility, n
FROM (SELECT *, g / sum(abs(g)) OVER () AS w FROM (SELECT *, 1 / vol - avg(1 / vol) OVER () AS g FROM (
  SELECT instrument, avg(ret) AS mean, stddev_pop(ret) AS vol, corr(ret, basket) AS c, count(*) AS n FROM (
    SELECT *, avg(ret) OVER (PARTITION BY pos) AS basket FROM (
      SELECT t.* FROM x_tail t, (SELECT min(m) AS m FROM (SELECT count(*) AS m FROM x_tail GROUP BY instrument)) WHERE pos <= m))
  GROUP BY instrument)))""")
def r13(spark, sf):
    return risk.portfolio_construction(risk.ranked_returns(trips(spark, sf), cuts=cuts(spark, sf))).transform(pick, "instrument", "snap(weight, 6) weight", "snap(risk_contribution, 6) risk_contribution", "snap(market, 6) market",
        "snap(momentum, 5) momentum", "snap(volatility, 5) volatility", "n")


@query("r13_portfolio_unavailable", f"""
SELECT NULL::VARCHAR AS instrument, NULL::DOUBLE AS weight, false AS available, 'need at least 2 instruments with {risk.MIN_RETURNS} returns, have '
  || count(*) AS reason FROM (SELECT instrument FROM x_trips WHERE instrument = 'BTC-USDT' GROUP BY instrument HAVING count(*) >= {risk.MIN_RETURNS})""")
def r13u(spark, sf):
    """One instrument alone is no portfolio, and the row says so."""
    one = trips(spark, sf).where("instrument = 'BTC-USDT'")
    return risk.portfolio_construction(risk.ranked_returns(one, cuts=cuts(spark, sf))).select("instrument", "weight", "available", "reason")


_STEPS = " + ".join(f"CASE WHEN u >= {s} THEN 1 ELSE 0 END" for s in risk.POISSON_STEPS)


@query("r14_bootstrap_sharpe", f"""
SELECT n AS n_trades, 5000 AS n_sims, snap(m / s, 6) AS sharpe, snap(lo, 6) AS ci_low, snap(hi, 6) AS ci_high,
  snap(p, 6) AS p_value, lo > 0 AS significant FROM (
  SELECT quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi, avg(CASE WHEN s <= 0 THEN 1.0 ELSE 0 END) AS p FROM (
    SELECT CASE WHEN wrr / w - (wr / w) * (wr / w) > 0 THEN wr / w / sqrt(wrr / w - (wr / w) * (wr / w)) ELSE 0 END AS s FROM (
      SELECT sim, sum(w) AS w, sum(w * r) AS wr, sum(w * r * r) AS wrr FROM (
        SELECT sim, r, {_STEPS} AS w FROM (SELECT sim, r, x * x % {risk.PRIME} AS u FROM (
          SELECT sim, r, (x * 48271 + sim) % {risk.PRIME} AS x FROM (SELECT sim, r, x * x % {risk.PRIME} AS x FROM (
            SELECT sim, net_pnl AS r, (CAST(substr(execution_id, 2) AS BIGINT) % {risk.PRIME} * 48271 + sim * 69621 + 12345) % {risk.PRIME} AS x
            FROM x_trips, (SELECT unnest(range(5000)) AS sim))))))
      GROUP BY sim))),
  (SELECT count(*) AS n, avg(net_pnl) AS m, stddev_pop(net_pnl) AS s FROM x_trips)""")
def r14(spark, sf):
    h = F.substring("execution_id", 2, 20).cast("long")
    return risk.bootstrap_sharpe(trips(spark, sf), id_hash=h).transform(pick, "n_trades", "cast(n_sims as int) n_sims", "snap(sharpe, 6) sharpe", "snap(ci_low, 6) ci_low", "snap(ci_high, 6) ci_high",
        "snap(p_value, 6) p_value", "significant")


@query("r15_cost_attribution", """
SELECT n AS round_trips, snap(g, 4) AS gross_pnl, snap(net, 4) AS net_pnl, snap(f, 4) AS fee_drag, snap(s, 4) AS slippage_drag,
  snap(al / (aw + al), 6) AS break_even_winrate, snap((f + s) / n / scale * 1e4, 4) AS break_even_edge_bps,
  snap(g / n / scale * 1e4, 4) AS edge_bps, snap(won / (lost + f + s), 6) AS fee_adjusted_profit_factor,
  snap(g / (f + s), 6) AS cost_efficiency, g > 0 AND net < 0 AS gross_positive_net_negative
FROM (SELECT count(*) AS n, sum(pnl) AS g, sum(net_pnl) AS net, sum(fee) AS f, sum(slippage) AS s, avg(abs(pnl)) AS scale,
  avg(net_pnl) FILTER (WHERE net_pnl > 0) AS aw, -avg(net_pnl) FILTER (WHERE net_pnl < 0) AS al,
  sum(pnl) FILTER (WHERE pnl > 0) AS won, -sum(pnl) FILTER (WHERE pnl < 0) AS lost FROM x_trips)""")
def r15(spark, sf):
    return risk.cost_attribution(trips(spark, sf)).transform(pick, "round_trips", "snap(gross_pnl, 4) gross_pnl", "snap(net_pnl, 4) net_pnl", "snap(fee_drag, 4) fee_drag",
        "snap(slippage_drag, 4) slippage_drag", "snap(break_even_winrate, 6) break_even_winrate",
        "snap(break_even_edge_bps, 4) break_even_edge_bps", "snap(edge_bps, 4) edge_bps",
        "snap(fee_adjusted_profit_factor, 6) fee_adjusted_profit_factor", "snap(cost_efficiency, 6) cost_efficiency",
        "gross_positive_net_negative")


@query("r16_reconciliation", """
SELECT n AS fills, snap(p, 4) AS realized_pnl, snap(p - f, 4) AS net_pnl, snap(v * 4 / 1e4, 4) AS modelled_fees,
  snap(f - v * 4 / 1e4, 4) AS fee_model_gap, n - 235 AS fills_delta,
  abs((p + 59.0439) / 59.0439) > 0.25 AS pnl_diverged, abs((n - 235) / 235) > 0.25 AS fills_diverged,
  p - f < -59.0439 AND f > v * 4 / 1e4 AS fee_model_diverged
FROM (SELECT count(*) AS n, sum(realized) AS p, sum(transaction_cost) AS f, sum(quantity * fill_price) AS v FROM x_pos)""")
def r16(spark, sf):
    return risk.reconciliation(positions(spark, sf), expected={**risk.EXPECTED, "fee_bps": 4.0}).transform(pick, "fills", "snap(realized_pnl, 4) realized_pnl", "snap(net_pnl, 4) net_pnl", "snap(modelled_fees, 4) modelled_fees",
        "snap(fee_model_gap, 4) fee_model_gap", "fills_delta", "pnl_diverged", "fills_diverged", "fee_model_diverged")


@query("r17_backtest_row", """
SELECT p.n AS fills, snap(turnover, 6) AS turnover, snap(hit, 6) AS hit_rate, snap(hold, 3) AS avg_hold_secs,
  snap(ret, 8) AS total_return, snap(bh, 8) AS buy_and_hold, snap(ret - bh, 8) AS excess_return
FROM (SELECT count(*) AS n, sum(quantity * fill_price) / 100000 AS turnover FROM x_pos) p,
  (SELECT avg(CASE WHEN net_pnl > 0 THEN 1 ELSE 0 END) AS hit FROM x_trips),
  (SELECT avg(epoch_us(exit_time) - epoch_us(entry_time)) / 1e6 AS hold FROM x_match),
  (SELECT arg_max(value, (ts, execution_id)) / 100000 - 1 AS ret FROM x_equity),
  (SELECT avg(r) AS bh FROM (SELECT arg_max(fill_price, (ts, execution_id)) / arg_min(fill_price, (ts, execution_id)) - 1 AS r FROM x_pos GROUP BY instrument))""")
def r17(spark, sf):
    return risk.backtest_row(positions(spark, sf), trips(spark, sf), matches(spark, sf), equity(spark, sf), initial_cash=CASH).transform(pick, "fills", "snap(turnover, 6) turnover", "snap(hit_rate, 6) hit_rate", "snap(avg_hold_secs, 3) avg_hold_secs",
        "snap(total_return, 8) total_return", "snap(buy_and_hold, 8) buy_and_hold", "snap(excess_return, 8) excess_return")
