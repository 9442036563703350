"""The same views as SQL text, and reference statements other statements build on."""

_COINS = "['BTC-USDT','ETH-USDT','SOL-USDT','XRP-USDT','DOGE-USDT']"

VIEWS: dict[str, str] = {}

VIEWS["x_ev"] = f"""
SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  {_COINS}[CAST(user_id % 5 + 1 AS INTEGER)] AS instrument, 100 + value / 10 AS px FROM events"""

VIEWS["x_raw"] = """
SELECT event_id, 'x' || event_id AS execution_id, 'o' || (event_id // 2) AS order_id, instrument,
  CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(1 + event_id % 7 AS DOUBLE) AS quantity,
  px AS fill_price, 0.0005::DOUBLE * px * CAST(1 + event_id % 7 AS DOUBLE) AS transaction_cost,
  CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE k % 7 END AS DOUBLE) AS slippage_bps,
  CASE k % 4 WHEN 0 THEN 'maker' WHEN 1 THEN 'T' WHEN 2 THEN 'weird' END AS liquidity, ts, k FROM x_ev"""

VIEWS["x_fills"] = """
SELECT * REPLACE (CASE liquidity WHEN 'maker' THEN 'maker' WHEN 'T' THEN 'taker' END AS liquidity) FROM x_raw"""

VIEWS["x_quick"] = f"""
SELECT * REPLACE ({_COINS}[CAST((event_id // 2) % 5 + 1 AS INTEGER)] AS instrument, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
  CAST(1 + (event_id // 2) % 7 AS DOUBLE) AS quantity, 0.0005::DOUBLE * px * CAST(1 + (event_id // 2) % 7 AS DOUBLE) AS transaction_cost)
FROM (SELECT f.*, fill_price AS px FROM x_fills f)"""

VIEWS["x_dirty"] = """
SELECT event_id, CASE WHEN k < 10 THEN ' ' ELSE execution_id END AS execution_id, order_id,
  CASE WHEN k = 93 THEN NULL ELSE instrument END AS instrument,
  CASE WHEN k = 98 THEN 'HOLD' ELSE side END AS side,
  CASE WHEN k = 97 THEN '-1' WHEN k = 96 THEN 'NaN' ELSE CAST(quantity AS VARCHAR) END AS quantity,
  CASE WHEN k = 94 THEN 'abc' ELSE CAST(fill_price AS VARCHAR) END AS fill_price,
  CASE WHEN k = 95 THEN 'inf' ELSE CAST(transaction_cost AS VARCHAR) END AS transaction_cost,
  slippage_bps, liquidity, ts, event_id * 2 + c AS arrival_no
FROM x_raw, (VALUES (0), (1)) t(c) WHERE c = 0 OR k % 10 = 3"""

VIEWS["x_checked"] = """
SELECT *, CASE
  WHEN instrument IS NULL THEN 'missing_instrument'
  WHEN upper(trim(side)) NOT IN ('BUY', 'SELL', 'B', 'S', '0', '1') THEN 'bad_side'
  WHEN TRY_CAST(quantity AS DOUBLE) IS NULL OR TRY_CAST(fill_price AS DOUBLE) IS NULL
    OR TRY_CAST(transaction_cost AS DOUBLE) IS NULL THEN 'non_numeric'
  WHEN NOT isfinite(TRY_CAST(quantity AS DOUBLE)) THEN 'nan_inf_quantity'
  WHEN NOT isfinite(TRY_CAST(fill_price AS DOUBLE)) THEN 'nan_inf_fill_price'
  WHEN NOT isfinite(TRY_CAST(transaction_cost AS DOUBLE)) THEN 'nan_inf_fee'
  WHEN TRY_CAST(quantity AS DOUBLE) <= 0 OR TRY_CAST(fill_price AS DOUBLE) <= 0 THEN 'non_positive' END AS reason
FROM x_dirty"""

VIEWS["x_clean"] = """
SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(trim(execution_id), ''),
    concat_ws('|', order_id, ts, side, quantity, fill_price)) ORDER BY arrival_no) AS n
  FROM x_checked WHERE reason IS NULL) WHERE n = 1"""

VIEWS["x_ticks"] = """
SELECT 't' || event_id AS tick_id, instrument, px * (1 + (k - 50) / 10000) AS price,
  CAST(1 + k % 10 AS DOUBLE) AS quantity, ts - to_seconds(1 + k) AS ts FROM x_ev"""

VIEWS["x_trades"] = """
SELECT 't' || event_id AS tick_id, event_id, instrument, px AS price, CAST(1 + k % 10 AS DOUBLE) AS quantity, ts FROM x_ev"""

VIEWS["x_turns"] = """
SELECT instrument, ts, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 4 + CASE WHEN event_id % 17 = 0 THEN 3 ELSE 0 END AS turn FROM x_trades"""
# the latest time of all earlier turns
VIEWS["x_marks"] = """
SELECT turn, max(top) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM (SELECT turn, max(ts) AS top FROM x_turns GROUP BY turn)"""

VIEWS["x_feat"] = """
SELECT 'e' || event_id AS event_id, instrument, ts AS event_time, ts + to_minutes(k) AS ingest_time,
  (k - 50) / 50 AS obi, px AS midPrice, 0.01::DOUBLE * (1 + k % 5) AS spread,
  (event_id % 21 - 10) / 2500 AS momentum, (event_id % 37) / 1500 AS volatility,
  CAST((event_id * 7) % 101 AS DOUBLE) AS fearGreed, 0.5::DOUBLE + (event_id % 40) / 10 AS volumeRatio,
  event_id AS seq, k, event_type FROM x_ev"""

VIEWS["x_rev"] = """
SELECT * FROM x_feat UNION ALL
SELECT * REPLACE ('r' || seq AS event_id, -obi AS obi, ingest_time + INTERVAL 1 DAY AS ingest_time)
FROM x_feat WHERE seq % 11 = 0"""

VIEWS["x_spine"] = "SELECT event_id AS spine_id, instrument, ts + INTERVAL 30 MINUTE AS decision_time FROM x_ev"

VIEWS["x_books"] = f"""
SELECT vec_id AS book_id, {_COINS}[CAST(vec_id % 5 + 1 AS INTEGER)] AS instrument,
  TIMESTAMP '2024-01-01' + to_seconds(vec_id * 1200) AS ts, embedding AS e FROM embeddings"""

VIEWS["x_book_levels"] = """
SELECT book_id, i, 100 - 0.01::DOUBLE * i AS bid, CAST(abs(e[i]) AS DOUBLE) AS bq,
  100.01::DOUBLE + 0.01::DOUBLE * i AS ask, CAST(abs(e[i + 20]) AS DOUBLE) AS aq
FROM x_books, (SELECT unnest(range(1, 21)) AS i) t"""

VIEWS["x_obi"] = """
SELECT b.book_id, any_value(b.instrument) AS instrument, any_value(b.ts) AS ts,
  sum(bq) AS bv, sum(aq) AS av, max(bid) AS best_bid, min(ask) AS best_ask,
  arg_min(bq, i) AS bq1, arg_min(aq, i) AS aq1
FROM x_books b JOIN x_book_levels l ON b.book_id = l.book_id AND l.i <= 10 GROUP BY b.book_id"""

VIEWS["x_oi"] = "SELECT instrument, ts, event_id, CAST(1000 + (event_id * 37) % 500 AS DOUBLE) AS open_interest FROM x_ev"

VIEWS["x_head"] = """
SELECT d.doc_id AS headline_id, text AS title, source, TIMESTAMP '2024-01-01' + to_seconds(d.doc_id * 60) AS processed_at,
  CASE WHEN quality = 1 THEN 'bullish' WHEN toxic = 1 THEN 'bearish' ELSE 'neutral' END AS btc_sentiment,
  round((d.doc_id % 11) / 10, 3) AS btc_confidence,
  CASE WHEN d.doc_id % 3 = 0 THEN 'bullish' ELSE 'neutral' END AS eth_sentiment,
  CASE WHEN d.doc_id % 4 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS eth_confidence,
  CASE WHEN d.doc_id % 5 = 2 THEN 'bearish' ELSE 'neutral' END AS sol_sentiment, round((d.doc_id % 7) / 10, 3) AS sol_confidence,
  CASE WHEN d.doc_id % 7 = 3 THEN 'bullish' ELSE 'bearish' END AS xrp_sentiment, 0.5::DOUBLE AS xrp_confidence,
  'neutral' AS doge_sentiment, 0.5::DOUBLE AS doge_confidence,
  d.doc_id % 13 NOT IN (0, 1) AS classified
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

VIEWS["x_titles"] = "SELECT title, processed_at, headline_id, row_number() OVER (PARTITION BY title ORDER BY processed_at, headline_id) AS rank FROM x_head"
VIEWS["x_title_next"] = """
SELECT a.title, a.rank, min(b.rank) AS next FROM x_titles a JOIN x_titles b ON a.title = b.title AND b.processed_at >= a.processed_at + INTERVAL 2 HOUR
GROUP BY a.title, a.rank"""
VIEWS["x_title_orbit"] = """
SELECT title, next AS rank FROM x_title_next WHERE rank = 1
UNION ALL SELECT n.title, n.next FROM x_title_orbit o JOIN x_title_next n ON n.title = o.title AND n.rank = o.rank"""

VIEWS["x_news"] = "SELECT headline_id, title, source, processed_at, classified, " + ", ".join(
    f"CASE WHEN classified THEN {c}_sentiment ELSE 'neutral' END AS {c}_sentiment, CASE WHEN classified THEN {c}_confidence ELSE 0.5 END AS {c}_confidence"
    for c in ("btc", "eth", "sol", "xrp", "doge")) + " FROM x_head"

VIEWS["x_coins"] = " UNION ALL ".join(
    f"SELECT '{c}' AS coin, classified, processed_at, {c}_sentiment AS s, {c}_confidence AS c FROM x_news" for c in ("btc", "eth", "sol", "xrp", "doge"))

VIEWS["x_mood"] = """
SELECT upper(coin) || '-USDT' AS instrument, mood_ts, sum(w * c * d) / sum(CASE WHEN c > 0 THEN w * c ELSE w END) AS score FROM (
  SELECT coin, c, mood_ts, CASE s WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END AS d,
    exp(-(epoch_us(mood_ts) - epoch_us(processed_at)) / 1e6 * ln(2) / 1800) AS w FROM (
    SELECT *, time_bucket(INTERVAL 10 MINUTE, processed_at) + to_minutes(10 * i) AS mood_ts FROM x_coins, (SELECT unnest(range(13)) AS i) WHERE classified)
  WHERE mood_ts >= processed_at AND processed_at > mood_ts - INTERVAL 2 HOUR) GROUP BY coin, mood_ts"""

VIEWS["x_lat"] = """
SELECT event_id, ts, event_type AS job, instrument, value * 2 AS latency_ms, k > 2 AS up,
  CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM x_ev"""

VIEWS["x_orders"] = f"""
SELECT o_orderkey AS order_id, {_COINS}[CAST(o_custkey % 5 + 1 AS INTEGER)] AS instrument,
  o_totalprice AS notional, CAST(1 + o_orderkey % 10 AS INTEGER) AS slices FROM orders"""


def fold_positions(source: str, key: str) -> tuple[str, str]:
    """A row-by-row fold of positions over `source`, partitioned by the columns in `key`."""
    same = "(p.qn = 0 OR sign(p.qn) = sign(f.s))"
    gone = "(abs(p.qn + f.s) < 1e-9 OR sign(p.qn + f.s) <> sign(p.qn))"
    on = " AND ".join(f"f.{c} = p.{c}" for c in key.split(", "))
    seq = f"""
SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, execution_id) AS rn,
  CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS s,
  abs(coalesce(slippage_bps, 0)) / 1e4 * (fill_price * quantity) AS sc FROM {source}"""
    fkey = ", ".join(f"f.{c}" for c in key.split(", "))
    pos = f"""
SELECT {key}, rn, execution_id, ts, s, fill_price, quantity, transaction_cost, sc,
  0.0::DOUBLE AS qp, 0.0::DOUBLE AS ap, 0.0::DOUBLE AS sp, s AS qn, fill_price AS an, sc AS sn, NULL::DOUBLE AS lp
FROM %SEQ% WHERE rn = 1
UNION ALL
SELECT {fkey}, f.rn, f.execution_id, f.ts, f.s, f.fill_price, f.quantity, f.transaction_cost, f.sc, p.qn, p.an, p.sn,
  CASE WHEN abs(p.qn + f.s) < 1e-9 THEN 0 ELSE p.qn + f.s END,
  CASE WHEN {same} THEN (p.an * abs(p.qn) + f.fill_price * f.quantity) / abs(p.qn + f.s)
    WHEN abs(p.qn + f.s) < 1e-9 THEN 0 WHEN {gone} THEN f.fill_price ELSE p.an END,
  CASE WHEN {same} THEN p.sn + f.sc WHEN {gone} THEN 0
    ELSE p.sn - p.sn * (least(abs(p.qn), f.quantity) / abs(p.qn)) END, p.fill_price
FROM %POS% p JOIN %SEQ% f ON {on} AND f.rn = p.rn + 1"""
    return seq, pos


def _add_fold(name: str, source: str, key: str) -> None:
    seq, pos = fold_positions(source, key)
    VIEWS[f"{name}_seq"] = seq
    VIEWS[f"{name}_fold"] = pos.replace("%SEQ%", f"{name}_seq").replace("%POS%", f"{name}_fold")
    VIEWS[f"{name}_pos"] = f"""
SELECT *, qp <> 0 AND sign(qp) <> sign(s) AS opposes,
  CASE WHEN qp <> 0 AND sign(qp) <> sign(s) THEN sign(qp) * (fill_price - ap) * least(abs(qp), quantity) ELSE 0 END AS realized,
  CASE WHEN qp <> 0 AND sign(qp) <> sign(s) THEN sp * least(abs(qp), quantity) / abs(qp) + sc END AS released
FROM {name}_fold"""


_add_fold("x", "x_fills", "instrument")
VIEWS["x_typed"] = """
SELECT event_id AS execution_id, instrument, side, CAST(quantity AS DOUBLE) AS quantity, CAST(fill_price AS DOUBLE) AS fill_price,
  CAST(transaction_cost AS DOUBLE) AS transaction_cost, slippage_bps, ts FROM x_clean"""
_add_fold("x_cl", "x_typed", "instrument")
VIEWS["x_trips"] = """
SELECT instrument, execution_id, realized AS pnl, transaction_cost AS fee, released AS slippage,
  realized - transaction_cost AS net_pnl, ts AS time FROM x_pos WHERE opposes"""

VIEWS["x_equity"] = """
SELECT instrument, execution_id, ts, realized - transaction_cost AS change,
  100000 + sum(-s * fill_price - transaction_cost) OVER w AS cash,
  100000 + sum(-s * fill_price - transaction_cost + qn * an - qp * ap) OVER w AS value,
  100000 + sum(-s * fill_price - transaction_cost + qn * fill_price - qp * coalesce(lp, 0)) OVER w AS value_mtm,
  sum(realized) OVER w AS pnl, sum(transaction_cost) OVER w AS fees, count(*) OVER w AS fills
FROM x_pos WINDOW w AS (ORDER BY ts, execution_id ROWS UNBOUNDED PRECEDING)"""

VIEWS["x_dd"] = """
SELECT *, (peak - value) / peak AS dd_pct, peak - value AS dd FROM (
  SELECT *, greatest(100000, max(value) OVER (ORDER BY ts, execution_id ROWS UNBOUNDED PRECEDING)) AS peak FROM x_equity)"""

VIEWS["x_lots"] = """
SELECT instrument, execution_id, ts, side, fill_price, transaction_cost, quantity,
  sum(quantity) OVER w - quantity AS a, sum(quantity) OVER w AS b FROM x_fills
WINDOW w AS (PARTITION BY instrument, side ORDER BY ts, execution_id ROWS UNBOUNDED PRECEDING)"""


def match_sql(lots: str) -> str:
    """Pairs of bought and sold quantity intervals that overlap."""
    return f"""
SELECT *, way * (exit_price - entry_price) * qty - entry_fee - exit_fee AS pnl FROM (
  SELECT instrument, way, qty, CASE WHEN way > 0 THEN bid ELSE sid END AS entry_id,
    CASE WHEN way > 0 THEN sid ELSE bid END AS exit_id,
    CASE WHEN way > 0 THEN bp ELSE sp END AS entry_price, CASE WHEN way > 0 THEN sp ELSE bp END AS exit_price,
    CASE WHEN way > 0 THEN bq ELSE sq END AS entry_qty,
    CASE WHEN way > 0 THEN bt ELSE st END AS entry_time, CASE WHEN way > 0 THEN st ELSE bt END AS exit_time,
    CASE WHEN way > 0 THEN bf / bq ELSE sf / sq END * qty AS entry_fee,
    CASE WHEN way > 0 THEN sf / sq ELSE bf / bq END * qty AS exit_fee
  FROM (SELECT x.instrument, least(x.b, y.b) - greatest(x.a, y.a) AS qty,
      CASE WHEN (x.ts, x.execution_id) < (y.ts, y.execution_id) THEN 1 ELSE -1 END AS way,
      x.execution_id AS bid, y.execution_id AS sid, x.fill_price AS bp, y.fill_price AS sp, x.ts AS bt, y.ts AS st,
      x.transaction_cost AS bf, y.transaction_cost AS sf, x.quantity AS bq, y.quantity AS sq
    FROM {lots} x JOIN {lots} y ON x.instrument = y.instrument AND x.side = 'BUY' AND y.side = 'SELL'
      AND x.a < y.b AND y.a < x.b))"""


VIEWS["x_match"] = match_sql("x_lots")


def label_sql(match: str) -> str:
    return f"""
SELECT l.*, CASE WHEN pnl > 0 THEN 1 ELSE 0 END AS label FROM (
  SELECT instrument, entry_id, sum(qty) AS qty, sum(pnl) AS pnl, max(exit_time) AS label_time,
    any_value(entry_qty) AS entry_qty, any_value(way) AS way FROM {match} GROUP BY ALL) l
LEFT JOIN (SELECT exit_id, sum(qty) AS used FROM {match} GROUP BY exit_id) u ON u.exit_id = l.entry_id
WHERE abs(l.entry_qty - coalesce(used, 0) - l.qty) < 1e-9""".replace("GROUP BY ALL", "GROUP BY instrument, entry_id")


VIEWS["x_labels"] = label_sql("x_match")

VIEWS["x_arrival"] = """
SELECT f.*, CASE WHEN t.ts >= f.ts - INTERVAL 60 SECOND THEN t.price END AS arrival
FROM x_fills f ASOF LEFT JOIN x_ticks t ON f.instrument = t.instrument AND f.ts >= t.ts"""

VIEWS["x_tca"] = """
SELECT *, slip / 1e4 * notional AS slip_cost_raw, coalesce(slip / 1e4 * notional, 0) AS slip_cost,
  coalesce(slip / 1e4 * notional, 0) + transaction_cost AS shortfall,
  CASE WHEN slippage_bps <> 0 THEN 'reported' WHEN slip IS NOT NULL THEN 'arrival' END AS source FROM (
  SELECT *, fill_price * quantity AS notional, transaction_cost / (fill_price * quantity) * 1e4 AS fee_bps,
    CASE WHEN slippage_bps <> 0 THEN slippage_bps
      ELSE (CASE WHEN side = 'BUY' THEN 1 ELSE -1 END) * (fill_price - arrival) / arrival * 1e4 END AS slip
  FROM x_arrival)"""

VIEWS["x_steps"] = """
SELECT instrument, ts, fill_price * quantity AS notional, ln(fill_price / lag(fill_price) OVER w) AS ret,
  epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM x_fills
WINDOW w AS (PARTITION BY instrument ORDER BY ts, execution_id)"""

VIEWS["x_est"] = """
SELECT s.instrument, n AS fills, least(greatest(sd * sqrt(86400 / (gap / 1e6)), 1e-4), 2) AS sigma,
  greatest(total / greatest(span / 86400, 1 / 24), 1) AS adv, total / n AS trade_notional FROM (
  SELECT instrument, count(*) AS n, stddev_samp(ret) AS sd, sum(notional) AS total,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM x_steps GROUP BY instrument) s
JOIN (SELECT instrument, gap FROM (
  SELECT instrument, gap, row_number() OVER (PARTITION BY instrument ORDER BY gap) AS rn,
    count(*) OVER (PARTITION BY instrument) AS m FROM x_steps WHERE gap > 0) WHERE rn = m // 2 + 1) g
  ON g.instrument = s.instrument"""

VIEWS["x_dec"] = """
SELECT *, CASE WHEN side IS NULL THEN 'no_signal' WHEN blocked_by IS NOT NULL THEN 'blocked' ELSE 'trade' END AS type FROM (
  SELECT *, CASE
    WHEN side IS NULL THEN NULL WHEN volumeRatio > 3 THEN 'volume_spike'
    WHEN side = 'SELL' AND momentum > 0.002 OR side = 'BUY' AND momentum < -0.002 THEN 'momentum'
    WHEN side = 'SELL' AND fearGreed > 0 AND fearGreed < 20 OR side = 'BUY' AND fearGreed > 80 THEN 'sentiment'
    END AS blocked_by FROM (
    SELECT *, CASE WHEN obi > eff THEN 'SELL' WHEN obi < -eff THEN 'BUY' END AS side, abs(obi) <> eff AS counted FROM (
      SELECT *, 0.9::DOUBLE + CASE WHEN volatility > 0.015 THEN 0.05::DOUBLE ELSE 0 END AS eff FROM x_feat)))"""


def bars_sql(minutes: int, source: str = "x_trades") -> str:
    return f"""
SELECT instrument, time_bucket(INTERVAL {minutes} MINUTE, ts) AS open_time,
  time_bucket(INTERVAL {minutes} MINUTE, ts) + INTERVAL {minutes} MINUTE AS close_time,
  arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close,
  sum(quantity) AS volume, sum(price * quantity) / sum(quantity) AS vwap, count(*) AS ticks
FROM {source} GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3")


VIEWS["x_bars1"], VIEWS["x_bars5"], VIEWS["x_bars15"] = bars_sql(1), bars_sql(5), bars_sql(15)


def bar_signal_sql(bars: str) -> str:
    def ema(p):
        return (f"CASE WHEN len(c) < {p} THEN c[-1] ELSE list_reduce(list_prepend(list_avg(c[1:{p}]), c[{p + 1}:]), "
                f"lambda a, x: (x - a) * (2.0::DOUBLE / {p + 1}) + a) END")
    return f"""
SELECT *, CASE WHEN es > 0 THEN (ef - es) / es ELSE 0 END AS momentum, CASE WHEN close > 0 THEN atr / close ELSE 0 END AS volatility FROM (
  SELECT *, CASE WHEN len(c) >= 26 THEN {ema(12)} ELSE 0 END AS ef, CASE WHEN len(c) >= 26 THEN {ema(26)} ELSE 0 END AS es,
    CASE WHEN n14 >= 5 THEN (coalesce(tr13, 0) + CASE WHEN n14 = 14 THEN hl14 ELSE 0 END) / n14 ELSE 0 END AS atr,
    CASE WHEN older > 0 THEN recent / older ELSE 1 END AS volume_ratio FROM (
    SELECT *, list(close) OVER (w ROWS 29 PRECEDING) AS c, sum(tr) OVER (w ROWS 12 PRECEDING) AS tr13,
      first_value(high - low) OVER (w ROWS 13 PRECEDING) AS hl14, count(*) OVER (w ROWS 13 PRECEDING) AS n14,
      avg(volume) OVER (w ROWS 4 PRECEDING) AS recent, avg(volume) OVER (w ROWS BETWEEN 29 PRECEDING AND 5 PRECEDING) AS older
    FROM (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr
      FROM (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY open_time) AS pc FROM {bars}))
    WINDOW w AS (PARTITION BY instrument ORDER BY open_time)))"""


VIEWS["x_sig1"], VIEWS["x_sig5"], VIEWS["x_sig15"] = (bar_signal_sql(f"x_bars{n}") for n in (1, 5, 15))

VIEWS["x_rets"] = """
SELECT *, ln(close / lag(close) OVER w) AS ret, row_number() OVER w AS rn FROM x_bars5
WINDOW w AS (PARTITION BY instrument ORDER BY open_time)"""

VIEWS["x_span"] = """
SELECT a.instrument, a.open_time, a.rn, b.rn AS j, b.ret,
  avg(b.ret) OVER g AS m, stddev_pop(b.ret) OVER g AS sd, count(*) OVER g AS n
FROM x_rets a JOIN x_rets b ON a.instrument = b.instrument AND b.rn BETWEEN a.rn - 59 AND a.rn AND b.ret IS NOT NULL
WINDOW g AS (PARTITION BY a.instrument, a.rn)"""

VIEWS["x_walk"] = """
SELECT *, sum(ret - m) OVER (PARTITION BY instrument, rn ORDER BY j ROWS UNBOUNDED PRECEDING) AS c,
  lag(ret) OVER (PARTITION BY instrument, rn ORDER BY j) AS r0 FROM x_span"""

VIEWS["x_stats"] = """
SELECT r.instrument, r.open_time, least(r.rn, 61) AS prices, coalesce(s.n, 0) AS n, s.mean,
  CASE WHEN s.sd > 0 THEN s.sd ELSE 1e-10 END AS std, s.rng, s.ac FROM x_rets r LEFT JOIN (
  SELECT instrument, open_time, any_value(n) AS n, any_value(m) AS mean, any_value(sd) AS sd, max(c) - min(c) AS rng,
    CASE WHEN any_value(n) > 2 THEN covar_pop(ret, r0) / (CASE WHEN var_pop(ret) FILTER (WHERE r0 IS NOT NULL) > 0 AND var_pop(r0) > 0
      THEN sqrt(var_pop(ret) FILTER (WHERE r0 IS NOT NULL) * var_pop(r0)) ELSE 1 END) ELSE 0 END AS ac
  FROM x_walk GROUP BY instrument, open_time) s ON s.instrument = r.instrument AND s.open_time = r.open_time"""

VIEWS["x_regime"] = """
SELECT *, CASE WHEN prices < 20 OR n < 10 THEN 'unknown' WHEN vol > 0.8 AND drift < 0.5 THEN 'volatile'
    WHEN drift > 1 AND hurst > 0.55 THEN 'trending' WHEN ac < -0.15 AND vol < 0.6 THEN 'mean_reverting'
    WHEN vol < 0.3 THEN 'quiet' ELSE 'mean_reverting' END AS regime,
  CASE WHEN prices < 20 OR n < 10 THEN 0 WHEN vol > 0.8 AND drift < 0.5 THEN least(vol / 1.2, 1)
    WHEN drift > 1 AND hurst > 0.55 THEN least(drift / 2, 1) WHEN ac < -0.15 AND vol < 0.6 THEN least(abs(ac) / 0.3, 1)
    WHEN vol < 0.3 THEN 1 - vol / 0.3 ELSE 0.4 END AS confidence FROM (
  SELECT *, std * sqrt(252 * 24 * 12) AS vol, abs(mean / std) AS drift,
    CASE WHEN n > 1 THEN ln(rng / std + 1e-10) / ln(n) END AS hurst FROM x_stats)"""

VIEWS["x_fwd"] = """
SELECT *, lead(midPrice) OVER (PARTITION BY instrument ORDER BY event_time, event_id) / midPrice - 1 AS fwd_ret FROM x_feat"""

VIEWS["x_grid"] = """
SELECT 't' || t || '_s' || s AS combo, t::DOUBLE AS threshold, s::DOUBLE AS size
FROM (VALUES ('0.5'), ('0.6'), ('0.7'), ('0.8')) a(t), (VALUES ('0.01'), ('0.02')) b(s)"""


def sweep_sql(source: str, extra: str = "") -> str:
    return f"""
SELECT {extra} combo, event_id AS execution_id, instrument, CASE WHEN obi > 0 THEN 'SELL' ELSE 'BUY' END AS side,
  size AS quantity, midPrice * (1 + CASE WHEN obi > 0 THEN -1 ELSE 1 END * 2.0::DOUBLE / 1e4) AS fill_price,
  size * (midPrice * (1 + CASE WHEN obi > 0 THEN -1 ELSE 1 END * 2.0::DOUBLE / 1e4)) * 5.0::DOUBLE / 1e4 AS transaction_cost,
  2.0::DOUBLE AS slippage_bps, event_time AS ts
FROM {source}, x_grid WHERE abs(obi) > threshold"""


VIEWS["x_swfills"] = sweep_sql("x_feat")
_add_fold("x_sw", "x_swfills", "combo, instrument")
VIEWS["x_swlots"] = """
SELECT combo || '/' || instrument AS instrument, combo, execution_id, ts, side, fill_price, transaction_cost, quantity,
  sum(CAST(quantity AS DECIMAL(18, 4))) OVER w - CAST(quantity AS DECIMAL(18, 4)) AS a, sum(CAST(quantity AS DECIMAL(18, 4))) OVER w AS b FROM x_swfills
WINDOW w AS (PARTITION BY combo, instrument, side ORDER BY ts, execution_id ROWS UNBOUNDED PRECEDING)"""
VIEWS["x_swmatch"] = "SELECT *, split_part(instrument, '/', 1) AS combo FROM (" + match_sql("x_swlots") + ")"

VIEWS["x_chunks"] = """
SELECT *, least((row_number() OVER (ORDER BY event_time, event_id) - 1) // greatest(count(*) OVER () // 5, 1), 4) AS chunk FROM x_feat"""
VIEWS["x_roles"] = """
SELECT c.*, f AS fold, CASE WHEN chunk < f THEN 'train' ELSE 'test' END AS part
FROM x_chunks c, (VALUES (1), (2), (3), (4)) t(f) WHERE chunk <= f"""
VIEWS["x_wffills"] = sweep_sql("x_roles", "fold, part,")
_add_fold("x_wf", "x_wffills", "fold, part, combo, instrument")
VIEWS["x_wfres"] = """
SELECT fold, part, combo, count(*) AS fills, sum(realized - transaction_cost) AS net_pnl FROM x_wf_pos GROUP BY 1, 2, 3"""
VIEWS["x_wfbest"] = """
SELECT b.fold, b.combo, b.train_pnl, t.net_pnl AS test_pnl, t.fills AS test_fills FROM (
  SELECT fold, arg_max(combo, (net_pnl, combo)) AS combo, max(net_pnl) AS train_pnl
  FROM x_wfres WHERE part = 'train' GROUP BY fold) b
LEFT JOIN x_wfres t ON t.part = 'test' AND t.fold = b.fold AND t.combo = b.combo"""

VIEWS["x_known"] = """
SELECT f.*, e.event_time AS feature_event_time, e.obi, e.midPrice, e.spread, e.momentum, e.volatility, e.fearGreed, e.volumeRatio
FROM x_quick f ASOF JOIN x_feat e ON f.instrument = e.instrument AND f.ts > e.event_time"""
VIEWS["x_klots"] = """
SELECT instrument, execution_id, ts, side, fill_price, transaction_cost, quantity,
  sum(quantity) OVER w - quantity AS a, sum(quantity) OVER w AS b FROM x_known
WINDOW w AS (PARTITION BY instrument, side ORDER BY ts, execution_id ROWS UNBOUNDED PRECEDING)"""
VIEWS["x_kmatch"] = match_sql("x_klots")
VIEWS["x_klabels"] = label_sql("x_kmatch")
VIEWS["x_eng"] = """
SELECT *, abs(obi) AS abs_obi, CASE WHEN obi >= 0 THEN 1.0 ELSE -1.0 END AS obi_sign, fearGreed / 100 AS fear_greed_norm,
  volumeRatio AS volume_ratio, CASE WHEN midPrice > 0 THEN spread / midPrice ELSE 0 END AS spread_rel,
  sin((hour(tt) + minute(tt) / 60) / 24 * 2 * pi()) AS hour_sin, cos((hour(tt) + minute(tt) / 60) / 24 * 2 * pi()) AS hour_cos,
  sin((isodow(tt) - 1) / 7 * 2 * pi()) AS dow_sin, cos((isodow(tt) - 1) / 7 * 2 * pi()) AS dow_cos FROM %SRC%"""
VIEWS["x_samples"] = """
SELECT l.*, e.feature_event_time, e.abs_obi, e.obi_sign, e.momentum, e.volatility, e.fear_greed_norm, e.volume_ratio,
  e.spread_rel, e.hour_sin, e.hour_cos, e.dow_sin, e.dow_cos
FROM x_klabels l JOIN (""" + VIEWS["x_eng"].replace(
    "%SRC%", "(SELECT *, feature_event_time AS tt FROM x_known)") + """) e
  ON e.instrument = l.instrument AND e.execution_id = l.entry_id"""
VIEWS["x_feat_eng"] = VIEWS.pop("x_eng").replace("%SRC%", "(SELECT *, event_time AS tt FROM x_feat)")

VIEWS["x_ranked"] = """
SELECT instrument, execution_id, time, net_pnl AS ret, row_number() OVER (PARTITION BY instrument ORDER BY time DESC, execution_id DESC) AS pos FROM x_trips"""
VIEWS["x_tail"] = "SELECT * FROM x_ranked"

VIEWS["x_permin"] = """
SELECT job, epoch_us(ts) // 60000000 AS minute, count(*) FILTER (WHERE latency_ms > 256) AS bad,
  count(*) FILTER (WHERE up) AS ups, count(*) AS total FROM x_lat GROUP BY 1, 2"""

VIEWS["x_psi"] = """
SELECT feature, half, least(CAST(floor((value - lo) / (hi - lo) * 10) AS BIGINT), 9) AS bin FROM (
  SELECT feature, half, value, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi FROM (
    SELECT CASE WHEN event_time >= TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END AS half, abs(obi) AS abs_obi, momentum, volatility, volumeRatio AS volume_ratio
    FROM x_feat) UNPIVOT (value FOR feature IN (abs_obi, momentum, volatility, volume_ratio)))"""

VIEWS["x_signed"] = """
SELECT instrument, e - quantity AS s, e, coalesce(last_value(m IGNORE NULLS) OVER (
    PARTITION BY instrument ORDER BY ts, tick_id ROWS UNBOUNDED PRECEDING), 1) AS way FROM (
  SELECT *, sum(quantity) OVER w AS e, nullif(sign(price - lag(price) OVER w), 0) AS m FROM x_trades
  WINDOW w AS (PARTITION BY instrument ORDER BY ts, tick_id))"""

VIEWS["x_vpin"] = """
SELECT instrument, bucket, sum(way * part) AS flow FROM (
  SELECT instrument, bucket, way, least(e, (bucket + 1) * 200) - greatest(s, bucket * 200) AS part FROM (
    SELECT *, unnest(range(CAST(floor(s / 200) AS BIGINT), CAST(ceil(e / 200) AS BIGINT))) AS bucket FROM x_signed))
GROUP BY 1, 2 HAVING sum(part) >= 199.9999"""


# --- hidden-Markov regimes: states by scaled volatility, their sums, a model from the sums ------

def states_sql(source: str) -> str:
    return f"""
SELECT *, lag(state) OVER (PARTITION BY instrument ORDER BY event_time, event_id) AS s0 FROM (
  SELECT *, CASE WHEN z > 0.5 THEN 2 WHEN z > -0.5 THEN 1 ELSE 0 END AS state FROM (
    SELECT *, (x1 - avg(x1) OVER w) / (CASE WHEN stddev_pop(x1) OVER w < 1e-9 THEN 1 ELSE stddev_pop(x1) OVER w END) AS z FROM (
      SELECT instrument, event_time, event_id, momentum AS x0, volatility AS x1, abs(obi) AS x2,
        datediff('day', DATE '1970-01-01', CAST(event_time AS DATE)) AS epoch FROM {source}) WINDOW w AS (PARTITION BY instrument)))"""


_SUMS = [f"n{k}" for k in range(3)] + [f"s{k}_{i}" for k in range(3) for i in range(3)] + [
    f"q{k}_{i}{j}" for k in range(3) for i in range(3) for j in range(i, 3)] + [f"t{j}{k}" for j in range(3) for k in range(3)]


def _state_sum(name: str) -> str:
    kind, k = name[0], name[1]
    if kind == "n":
        return f"count(*) FILTER (WHERE state = {k}) AS {name}"
    if kind == "t":
        return f"count(*) FILTER (WHERE s0 = {k} AND state = {name[2]}) AS {name}"
    x = f"x{name[3]}" if kind == "s" else f"x{name[3]} * x{name[4]}"
    return f"coalesce(sum({x}) FILTER (WHERE state = {k}), 0) AS {name}"


def model_sql(sums: str, key: str = "instrument") -> str:
    """pi, transitions, means and covariances in columns pi0.., t0..t8, m0..m8, v<state><place>."""
    total = lambda f: " + ".join(f.format(k=k) for k in range(3))
    cov = {(i, j): f"{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}
    center = ", ".join(f"({total(f's{{k}}_{i}')}) / n_obs AS c{i}" for i in range(3))
    width = ", ".join(f"CASE WHEN sqrt(greatest(({total(f'q{{k}}_{i}{i}')}) / n_obs - c{i} * c{i}, 0)) < 1e-9 THEN 1 "
                      f"ELSE sqrt(greatest(({total(f'q{{k}}_{i}{i}')}) / n_obs - c{i} * c{i}, 0)) END AS w{i}" for i in range(3))
    pi = ", ".join(f"(n{k} + 1) / (n_obs + 3) AS pi{k}" for k in range(3))
    trans = ", ".join(f"(t{j}{k} + 1) / (t{j}0 + t{j}1 + t{j}2 + 3) AS a{3 * j + k}" for j in range(3) for k in range(3))
    means = ", ".join(f"CASE WHEN n{k} >= 2 THEN (s{k}_{i} / n{k} - c{i}) / w{i} ELSE 0 END AS m{3 * k + i}" for k in range(3) for i in range(3))
    covs = ", ".join(
        f"CASE WHEN n{k} >= 2 THEN (q{k}_{cov[i, j]} / n{k} - s{k}_{i} / n{k} * s{k}_{j} / n{k}) / w{i} / w{j} ELSE {float(i == j)} END + {0.001 if i == j else 0.0} AS v{k}{3 * i + j}"
        for k in range(3) for i in range(3) for j in range(3))
    return f"""
SELECT {key}, n_obs, {', '.join(f'c{i}, w{i}' for i in range(3))}, {pi}, {trans}, {means}, {covs} FROM (
  SELECT *, {width} FROM (SELECT *, {center} FROM (SELECT *, n0 + n1 + n2 AS n_obs FROM {sums}) WHERE n_obs >= 200))"""


def emission_sql(rows: str, model: str, key: str = "instrument", within: str | None = None) -> str:
    """rn within the key (or `within`), and b0..b2, densities scaled to a largest of 1, from rows next to their model."""
    det = lambda k: (f"(v{k}0 * (v{k}4 * v{k}8 - v{k}5 * v{k}5) - v{k}1 * (v{k}1 * v{k}8 - v{k}5 * v{k}2) + v{k}2 * (v{k}1 * v{k}5 - v{k}4 * v{k}2))")
    def log_density(k):
        a, b, c, e, f, i = (f"v{k}{x}" for x in (0, 1, 2, 4, 5, 8))
        d0, d1, d2 = (f"(z{x} - m{3 * k + x})" for x in range(3))
        quad = (f"(({e} * {i} - {f} * {f}) * {d0} * {d0} + ({a} * {i} - {c} * {c}) * {d1} * {d1} + ({a} * {e} - {b} * {b}) * {d2} * {d2} "
                f"+ 2 * ({c} * {f} - {b} * {i}) * {d0} * {d1} + 2 * ({b} * {f} - {c} * {e}) * {d0} * {d2} + 2 * ({b} * {c} - {a} * {f}) * {d1} * {d2})")
        return f"-0.5 * ({quad} / {det(k)} + ln({det(k)}))"
    on = " AND ".join(f"o.{c} = m.{c}" for c in key.split(", "))
    part = ", ".join(f"o.{c}" for c in (within or key).split(", "))
    z = ", ".join(f"(x{i} - c{i}) / w{i} AS z{i}" for i in range(3))
    return f"""
SELECT *, l0 - greatest(l0, l1, l2) AS g0, l1 - greatest(l0, l1, l2) AS g1, l2 - greatest(l0, l1, l2) AS g2 FROM (
  SELECT *, {', '.join(f'{log_density(k)} AS l{k}' for k in range(3))} FROM (
    SELECT o.event_id, o.event_time, row_number() OVER (PARTITION BY {part} ORDER BY o.event_time, o.event_id) AS rn, {z}, m.*
    FROM {rows} o JOIN {model} m ON {on}))"""


def forward_sql(name: str, emissions: str, key: str = "instrument") -> str:
    on = " AND ".join(f"e.{c} = p.{c}" for c in key.split(", "))
    keys = ", ".join(f"e.{c}" for c in key.split(", "))
    norm = lambda f: ", ".join(f"{f(k)} / ({' + '.join(f(x) for x in range(3))}) AS p{k}" for k in range(3))
    first = norm(lambda k: f"(pi{k} * exp(g{k}))")
    nxt = norm(lambda k: f"((p.p0 * a{k} + p.p1 * a{3 + k} + p.p2 * a{6 + k}) * exp(e.g{k}))")
    return f"""
SELECT {keys}, e.event_id, e.rn, {first} FROM {emissions} e WHERE rn = 1
UNION ALL SELECT {keys}, e.event_id, e.rn, {nxt} FROM {name} p JOIN {emissions} e ON {on} AND e.rn = p.rn + 1"""


VIEWS["x_hstates"] = states_sql("x_feat")
VIEWS["x_hsums"] = f"SELECT instrument, {', '.join(map(_state_sum, _SUMS))} FROM x_hstates GROUP BY instrument"
VIEWS["x_hmodel"] = model_sql("x_hsums")
# the columns that are compared, under the names of the query
_NAMED = ", ".join(["instrument", "n_obs", "pi0", "pi2", "a0 AS t0", "a4 AS t4", "a8 AS t8", *[f"m{i}" for i in range(9)],
                    *[f"v{k}{i}" for k in range(3) for i in (0, 1, 4, 8)]])
VIEWS["x_hmm"] = f"SELECT {_NAMED} FROM x_hmodel"
VIEWS["x_hemit"] = emission_sql("x_hstates", "x_hmodel")
VIEWS["x_hfwd"] = forward_sql("x_hfwd", "x_hemit")
# rows of instruments without a model stay, without a state
VIEWS["x_hall"] = """
SELECT o.instrument, o.event_id, f.rn, p0, p1, p2 FROM x_hstates o LEFT JOIN x_hfwd f ON f.instrument = o.instrument AND f.event_id = o.event_id"""
_back = lambda k: f"(a{3 * k} * exp(e.g0) * p.b0 + a{3 * k + 1} * exp(e.g1) * p.b1 + a{3 * k + 2} * exp(e.g2) * p.b2)"
VIEWS["x_hbwd"] = f"""
SELECT instrument, rn, 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2 FROM (SELECT instrument, max(rn) AS rn FROM x_hemit GROUP BY instrument)
UNION ALL SELECT e.instrument, e.rn - 1, {', '.join(f"{_back(k)} / ({' + '.join(_back(x) for x in range(3))}) AS b{k}" for k in range(3))}
FROM x_hbwd p JOIN x_hemit e ON e.instrument = p.instrument AND e.rn = p.rn WHERE p.rn > 1"""
_step = lambda j, k: f"p.d{j} + ln(a{3 * j + k})"
VIEWS["x_hbest"] = f"""
SELECT instrument, event_id, rn, {', '.join(f'ln(pi{k}) + g{k} AS d{k}' for k in range(3))}, 0 AS f0, 0 AS f1, 0 AS f2 FROM x_hemit WHERE rn = 1
UNION ALL SELECT e.instrument, e.event_id, e.rn, {', '.join(f"greatest({', '.join(_step(j, k) for j in range(3))}) + e.g{k} AS d{k}" for k in range(3))},
  {', '.join(f"CASE WHEN {_step(0, k)} >= greatest({_step(1, k)}, {_step(2, k)}) THEN 0 WHEN {_step(1, k)} >= {_step(2, k)} THEN 1 ELSE 2 END AS f{k}" for k in range(3))}
FROM x_hbest p JOIN x_hemit e ON e.instrument = p.instrument AND e.rn = p.rn + 1"""
VIEWS["x_hpath"] = """
SELECT instrument, event_id, rn, CASE WHEN d0 >= greatest(d1, d2) THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS path, f0, f1, f2
FROM x_hbest WHERE (instrument, rn) IN (SELECT (instrument, max(rn)) FROM x_hbest GROUP BY instrument)
UNION ALL SELECT b.instrument, b.event_id, b.rn, CASE p.path WHEN 0 THEN p.f0 WHEN 1 THEN p.f1 ELSE p.f2 END, b.f0, b.f1, b.f2
FROM x_hpath p JOIN x_hbest b ON b.instrument = p.instrument AND b.rn = p.rn - 1"""
# models after 200 rows and again after every 50, from earlier rows alone
VIEWS["x_h8n"] = """
SELECT *, CASE WHEN n <= 200 THEN 0 ELSE (n - 201) // 50 + 1 END AS epoch FROM (
  SELECT instrument, event_time, event_id, momentum AS x0, volatility AS x1, abs(obi) AS x2,
    row_number() OVER (PARTITION BY instrument ORDER BY event_time, event_id) AS n FROM x_feat)"""
VIEWS["x_h8own"] = "SELECT instrument, epoch, count(*) AS c, avg(x1) AS m, stddev_pop(x1) AS w, sum(x1) AS s, sum(x1 * x1) AS q FROM x_h8n GROUP BY 1, 2"
VIEWS["x_h8band"] = """
SELECT instrument, epoch, m, CASE WHEN w < 1e-9 THEN 1 ELSE w END AS w FROM (
  SELECT instrument, epoch, CASE WHEN epoch = 0 THEN m ELSE sum(s) OVER p / sum(c) OVER p END AS m,
    CASE WHEN epoch = 0 THEN w ELSE sqrt(greatest(sum(q) OVER p / sum(c) OVER p - (sum(s) OVER p / sum(c) OVER p) * (sum(s) OVER p / sum(c) OVER p), 0)) END AS w
  FROM x_h8own WINDOW p AS (PARTITION BY instrument ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
VIEWS["x_h8states"] = """
SELECT *, lag(state) OVER (PARTITION BY instrument ORDER BY n) AS s0 FROM (
  SELECT o.*, CASE WHEN (x1 - m) / w > 0.5 THEN 2 WHEN (x1 - m) / w > -0.5 THEN 1 ELSE 0 END AS state FROM x_h8n o JOIN x_h8band b USING (instrument, epoch))"""
VIEWS["x_h8sums"] = f"SELECT instrument, epoch, {', '.join(map(_state_sum, _SUMS))} FROM x_h8states GROUP BY instrument, epoch"
VIEWS["x_h8past"] = f"""
SELECT instrument, epoch, {', '.join(f'coalesce(sum({c}) OVER w, 0) AS {c}' for c in _SUMS)} FROM x_h8sums
WINDOW w AS (PARTITION BY instrument ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
VIEWS["x_h8model"] = model_sql("x_h8past", "instrument, epoch")
VIEWS["x_h8emit"] = emission_sql("x_h8states", "x_h8model", "instrument, epoch", "instrument")
VIEWS["x_h8fwd"] = forward_sql("x_h8fwd", "x_h8emit")
VIEWS["x_hhist"] = "SELECT o.instrument, o.event_id, o.epoch, p0, p1, p2 FROM x_h8n o LEFT JOIN x_h8fwd f ON f.instrument = o.instrument AND f.event_id = o.event_id"


# --- Baum-Welch, two starts and two rounds, row by row --------------------------------------------

_EM_KEY = "instrument, start"
_MOMENTS = [f"(avg(x{i} * x{j}) - avg(x{i}) * avg(x{j}))" for i in range(3) for j in range(3)]
VIEWS["x_emobs"] = "SELECT instrument, event_time, event_id, seq, momentum AS x0, volatility AS x1, abs(obi) AS x2 FROM x_feat"
VIEWS["x_emstat"] = f"""
SELECT instrument, count(*) AS n_obs, {', '.join(f'avg(x{i}) AS c{i}, stddev_pop(x{i}) AS w{i}' for i in range(3))},
  {', '.join(f'covar_pop(x{i}, x{j}) AS k{3 * i + j}' for i in range(3) for j in range(3))} FROM x_emobs GROUP BY instrument HAVING count(*) >= 200"""
VIEWS["x_emz"] = f"SELECT o.instrument, start, seq, {', '.join(f'(x{i} - c{i}) / w{i} AS z{i}' for i in range(3))} FROM x_emobs o JOIN x_emstat USING (instrument), (SELECT unnest([0, 1]) AS start)"


def noise_sql(draw: int) -> str:
    """Uniform noise in (0, 1) from the number in a row's id; `hmm_noise` in models.py is its twin."""
    return f"(((seq % 1000003) * 7919 + start * 104729 + {draw} * 1299709 + 12345) * 48271 % 2147483647 + 0.5) / 2147483647"


_DIST = lambda k: " + ".join(f"(z{i} - q{k}{i}) * (z{i} - q{k}{i})" for i in range(3))
_RACE = ["ln({u})", "ln({u}) / ({0})", "ln({u}) / least({0}, {1})"]
for _k in range(3):
    _race = _RACE[_k].format(*map(_DIST, range(_k)), u=noise_sql(_k)) if _k else f"ln({noise_sql(0)})"
    _apart = " AND ".join(f"({_DIST(j)}) > 0" for j in range(_k)) or "true"
    _old = "".join(f", q{j}{i}" for j in range(_k) for i in range(3))
    VIEWS[f"x_emq{_k}"] = f"""
SELECT instrument, start{_old}, {', '.join(f'arg_max(z{i}, ({_race})) AS q{_k}{i}' for i in range(3))}
FROM x_emz {f'JOIN x_emq{_k - 1} USING (instrument, start)' if _k else ''} WHERE {_apart} GROUP BY ALL"""
VIEWS["x_em0"] = f"""
SELECT instrument, start, n_obs, {', '.join(f'c{i}, w{i}, 1.0::DOUBLE / 3 AS pi{i}' for i in range(3))},
  {', '.join(f'{0.8 if j == k else 0.1}::DOUBLE AS a{3 * j + k}' for j in range(3) for k in range(3))},
  {', '.join(f'q{k}{i} AS m{3 * k + i}' for k in range(3) for i in range(3))},
  {', '.join(f'k{3 * i + j} / w{i} / w{j} + {0.001 if i == j else 0.0} AS v{k}{3 * i + j}' for k in range(3) for i in range(3) for j in range(3))}
FROM x_emstat JOIN x_emq2 USING (instrument)"""


def em_round_sql(r: int) -> None:
    """Views of round r: emissions, forward with the log scale, backward, expected counts, the next model."""
    sum3 = lambda f: " + ".join(f(k) for k in range(3))
    VIEWS[f"x_emrow{r}"] = "SELECT o.*, start FROM x_emobs o, (SELECT unnest([0, 1]) AS start)"
    VIEWS[f"x_ememit{r}"] = emission_sql(f"x_emrow{r}", f"x_em{r}", _EM_KEY)
    on = "e.instrument = p.instrument AND e.start = p.start"
    first, nxt = (lambda k: f"(e.pi{k} * exp(e.g{k}))"), (lambda k: f"((p.p0 * a{k} + p.p1 * a{3 + k} + p.p2 * a{6 + k}) * exp(e.g{k}))")
    top = "greatest(e.l0, e.l1, e.l2) - 1.5 * ln(2 * pi())"
    state = lambda f: ", ".join(f"{f(k)} / ({sum3(f)}) AS p{k}" for k in range(3)) + f", ln({sum3(f)}) + {top} AS ll"
    VIEWS[f"x_emfwd{r}"] = f"""
SELECT e.instrument, e.start, e.rn, {state(first)} FROM x_ememit{r} e WHERE rn = 1
UNION ALL SELECT e.instrument, e.start, e.rn, {state(nxt)} FROM x_emfwd{r} p JOIN x_ememit{r} e ON {on} AND e.rn = p.rn + 1"""
    VIEWS[f"x_emll{r}"] = f"SELECT instrument, start, sum(ll) AS ll FROM x_emfwd{r} GROUP BY 1, 2"
    back = lambda k: f"(a{3 * k} * exp(e.g0) * p.b0 + a{3 * k + 1} * exp(e.g1) * p.b1 + a{3 * k + 2} * exp(e.g2) * p.b2)"
    VIEWS[f"x_embwd{r}"] = f"""
SELECT instrument, start, max(rn) AS rn, 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2 FROM x_ememit{r} GROUP BY 1, 2
UNION ALL SELECT e.instrument, e.start, e.rn - 1, {', '.join(f'{back(k)} / ({sum3(back)}) AS b{k}' for k in range(3))}
FROM x_embwd{r} p JOIN x_ememit{r} e ON {on} AND e.rn = p.rn WHERE p.rn > 1"""
    post = lambda k: f"p{k} * b{k} / ({sum3(lambda x: f'p{x} * b{x}')})"
    pair = lambda j, k: f"o{j} * a{3 * j + k} * exp(g{k}) * b{k}"
    every = " + ".join(pair(j, k) for j in range(3) for k in range(3))
    VIEWS[f"x_empost{r}"] = f"""
SELECT instrument, start, rn, z0, z1, z2, {', '.join(f'{post(k)} AS y{k}' for k in range(3))},
  {', '.join(f'{pair(j, k)} / ({every}) AS h{3 * j + k}' for j in range(3) for k in range(3))} FROM (
  SELECT e.*, p0, p1, p2, b0, b1, b2, {', '.join(f'lag(p{j}) OVER (PARTITION BY e.instrument, e.start ORDER BY e.rn) AS o{j}' for j in range(3))}
  FROM x_ememit{r} e JOIN x_emfwd{r} USING (instrument, start, rn) JOIN x_embwd{r} USING (instrument, start, rn))"""
    h = lambda j: sum3(lambda k: f"sum(h{3 * j + k})")
    VIEWS[f"x_em{r + 1}"] = f"""
SELECT instrument, start, {', '.join(f'c{i}, w{i}' for i in range(3))}, n_obs, e.* EXCLUDE (instrument, start) FROM x_emstat JOIN (
  SELECT instrument, start, {', '.join(f'max(y{k}) FILTER (rn = 1) AS pi{k}' for k in range(3))},
    {', '.join(f'sum(h{3 * j + k}) / ({h(j)}) AS a{3 * j + k}' for j in range(3) for k in range(3))},
    {', '.join(f'sum(y{k} * z{i}) / sum(y{k}) AS m{3 * k + i}' for k in range(3) for i in range(3))},
    {', '.join(f'sum(y{k} * z{i} * z{j}) / sum(y{k}) - sum(y{k} * z{i}) / sum(y{k}) * (sum(y{k} * z{j}) / sum(y{k})) AS v{k}{3 * i + j}' for k in range(3) for i in range(3) for j in range(3))}
  FROM x_empost{r} GROUP BY 1, 2) e USING (instrument)"""


EM_ROUNDS = 2
for _r in range(EM_ROUNDS):
    em_round_sql(_r)
VIEWS["x_emfit"] = f"SELECT f.*, f0.ll AS ll0, f1.ll AS ll1 FROM x_em{EM_ROUNDS} f JOIN x_emll0 f0 USING (instrument, start) JOIN x_emll1 f1 USING (instrument, start)"
# the log-likelihood of the labelled models' rows
VIEWS["x_hscore"] = """
SELECT instrument, rn, ln(s) + top AS ll FROM (
  SELECT e.instrument, e.rn, greatest(l0, l1, l2) - 1.5 * ln(2 * pi()) AS top,
    CASE WHEN e.rn = 1 THEN pi0 * exp(g0) + pi1 * exp(g1) + pi2 * exp(g2) ELSE
      (p.p0 * a0 + p.p1 * a3 + p.p2 * a6) * exp(g0) + (p.p0 * a1 + p.p1 * a4 + p.p2 * a7) * exp(g1) + (p.p0 * a2 + p.p1 * a5 + p.p2 * a8) * exp(g2) END AS s
  FROM x_hemit e LEFT JOIN x_hfwd p ON p.instrument = e.instrument AND p.rn = e.rn - 1)"""
VIEWS["x_hknown"] = "SELECT * FROM x_rev WHERE event_time <= TIMESTAMP '2024-01-10 12:00:00' AND ingest_time <= TIMESTAMP '2024-01-10 12:00:00'"
VIEWS["x_hwstates"] = states_sql("x_hknown")
VIEWS["x_hwsums"] = f"SELECT instrument, {', '.join(map(_state_sum, _SUMS))} FROM x_hwstates GROUP BY instrument"
VIEWS["x_hwmodel"] = model_sql("x_hwsums")
VIEWS["x_hwarm"] = f"SELECT {_NAMED} FROM x_hwmodel"
