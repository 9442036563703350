"""Validation, normalization and deduplication of the event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.numeric import blank_to_null, finite
from tapeworks.functions.scan import running
from tapeworks.session import materialize

# The accepted spellings of sides and liquidity flags.
BUY_TOKENS = ["BUY", "B", "0"]
SELL_TOKENS = ["SELL", "S", "1"]
MAKER_TOKENS = ["maker", "m", "added", "add", "post", "passive", "true", "1"]
TAKER_TOKENS = ["taker", "t", "removed", "remove", "aggressive", "active", "false", "0"]
# Quote suffixes of an exchange symbol, longest first.
QUOTE_SUFFIXES = ["USDT", "USD", "BTC", "ETH"]
# What a missing or non-finite feature counts as.
FEATURE_DEFAULTS = {
    "obi": 0.0, "midPrice": 1.0, "spread": 0.0, "momentum": 0.0, "volatility": 0.0,
    "fearGreed": 50.0, "volumeRatio": 1.0,
}


def parse_ts(col: Column) -> Column:
    """ISO text to a UTC timestamp; text without a zone means UTC (the session zone)."""
    return F.try_to_timestamp(F.trim(col.cast("string")))


def normalize_side(col: Column) -> Column:
    s = F.upper(F.trim(col.cast("string")))
    return F.when(s.isin(BUY_TOKENS), "BUY").when(s.isin(SELL_TOKENS), "SELL")


def normalize_liquidity(col: Column) -> Column:
    """maker, taker or NULL; an unknown flag is never counted as taker."""
    s = F.lower(F.trim(col.cast("string")))
    return F.when(s.isin(MAKER_TOKENS), "maker").when(s.isin(TAKER_TOKENS), "taker")


def first_of(df: DataFrame, *names: str) -> Column:
    """First non-null among those alias columns the frame has."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def symbol_to_instrument(col: Column) -> Column:
    s = F.upper(col)
    out = s
    for q in reversed(QUOTE_SUFFIXES):
        base = F.substring(s, F.lit(1), F.length(s) - len(q))
        out = F.when(s.endswith(q), F.concat(base, F.lit(f"-{q}"))).otherwise(out)
    return out


def fill_reason(df: DataFrame) -> Column:
    """The first broken rule of a raw fill, NULL when it is valid."""
    def missing(name):
        return F.col(name).isNull()

    def number(name):
        return F.col(name).cast("string").try_cast("double")

    fee_text = F.coalesce(blank_to_null(F.col("transaction_cost")), F.lit("0"))
    qty, price, fee = number("quantity"), number("fill_price"), fee_text.try_cast("double")

    def unreal(x):
        return F.isnan(x) | (F.abs(x) == float("inf"))

    side = normalize_side(F.col("side"))
    return (
        F.when(blank_to_null(F.col("instrument")).isNull(), "missing_instrument")
        .when(side.isNull(), "bad_side")
        .when(missing("quantity"), "missing_quantity")
        .when(missing("fill_price"), "missing_fill_price")
        .when(qty.isNull() | price.isNull() | fee.isNull(), "non_numeric")
        .when(unreal(qty), "nan_inf_quantity")
        .when(unreal(price), "nan_inf_fill_price")
        .when(unreal(fee), "nan_inf_fee")
        .when((qty <= 0) | (price <= 0), "non_positive")
    )


def validate_fills(df: DataFrame) -> DataFrame:
    return df.withColumn("reason", fill_reason(df)).withColumn("ok", F.col("reason").isNull())


def reject_counts(validated: DataFrame) -> DataFrame:
    """Rows per outcome; valid rows are counted under `processed`."""
    return validated.groupBy(F.coalesce("reason", F.lit("processed")).alias("reason")).agg(
        F.count("*").alias("n")
    )


def typed_fills(validated: DataFrame) -> DataFrame:
    """Valid raw fills with typed, normalized columns."""
    v = validated.where("ok")
    ts = F.col("ts") if "ts" in v.columns else parse_ts(F.col("timestamp"))
    return v.select(
        blank_to_null(F.col("execution_id")).alias("execution_id"),
        "order_id", "instrument",
        normalize_side(F.col("side")).alias("side"),
        F.col("quantity").cast("double").alias("quantity"),
        F.col("fill_price").cast("double").alias("fill_price"),
        F.coalesce(finite(F.col("transaction_cost")), F.lit(0.0)).alias("transaction_cost"),
        finite(F.col("slippage_bps")).alias("slippage_bps"),
        normalize_liquidity(F.col("liquidity")).alias("liquidity"),
        ts.alias("ts"),
        *[c for c in v.columns if c in ("arrival_no", "event_id")],
    )


def fill_key(df: DataFrame, *, fallback: str = "composite") -> Column:
    """`execution_id`, or a composite of the order's fields, or only the order id."""
    own = blank_to_null(F.col("execution_id"))
    if fallback == "order_id":
        return F.coalesce(F.concat(F.lit("fill:"), own), F.concat(F.lit("fill:"), F.col("order_id")))
    when = F.col("ts") if "ts" in df.columns else F.col("timestamp")
    parts = [F.col("order_id"), when, F.col("side"), F.col("quantity"), F.col("fill_price")]
    return F.coalesce(own, F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One row per key, the earliest by `order`.

    A partial aggregate folds copies before the shuffle, so a key with very many copies
    does not land whole in one task.
    """
    row = F.struct(*df.columns)
    return (
        df.select(key.alias("__key"), F.struct(*order).alias("__at"), row.alias("__row"))
        .groupBy("__key")
        .agg(F.min_by("__row", "__at").alias("__row"))
        .select("__row.*")
    )


def dedup_fills(df: DataFrame, *, order: list[str], fallback: str = "composite") -> DataFrame:
    """First arrival per fill key; runs after validation so a bad copy never hides a good one."""
    return keep_first(df, fill_key(df, fallback=fallback), order)


def dedup_events(df: DataFrame, *, order: list[str], event_id: str = "event_id") -> DataFrame:
    """First arrival per event id; events without an id are all kept."""
    key = blank_to_null(F.col(event_id))
    tagged = df.withColumn("__id", key)
    named = keep_first(tagged.where(F.col("__id").isNotNull()), F.col("__id"), order)
    return named.unionByName(tagged.where(F.col("__id").isNull())).drop("__id")


HEADLINE_SECONDS = 2 * 3600


def title_hash(title: Column) -> Column:
    return F.sha2(title, 256)


def dedup_headlines(df: DataFrame, *, order: list[str]) -> DataFrame:
    return keep_first(df.withColumn("title_hash", title_hash(F.col("title"))), F.col("title_hash"), order)


def dedup_headlines_within(df: DataFrame, *, seconds: int = HEADLINE_SECONDS, time: str = "processed_at", uid: str = "headline_id") -> DataFrame:
    """Headlines whose title was not kept in the `seconds` before: a title is remembered from the
    row that was kept, not from each repeat, so the next kept row is the first at or after that time.

    Each row of a repeated title points to the row that would be kept after it, and kept rows are
    found by doubling these pointers: log2(kept rows of a title) joins on (title, rank), which no
    title can skew. `uid` is unique. Rows without a title are one title.
    """
    tagged = df.withColumn("title_hash", title_hash(F.col("title")))
    slim = materialize(tagged.select(F.coalesce("title_hash", F.lit("")).alias("__key"), F.col(time).alias("__at"), F.col(uid).alias("__uid")), "titles")
    after = F.expr(f"interval {seconds} seconds")
    again = slim.groupBy("__key").agg(F.min("__at").alias("a"), F.max("__at").alias("b")).where(F.col("b") >= F.col("a") + after).select("__key")
    ranked = running(slim.join(again, "__key", "left_semi"), {"__rank": ("count", F.lit(1))}, key=["__key"], order=["__at", "__uid"])
    ranked = materialize(ranked, "title-ranks")
    rows = ranked.withColumn("__kind", F.lit(1))
    asked = ranked.withColumns({"__at": F.col("__at") + after, "__kind": F.lit(0)})
    # seen from the end, the last row before a question is the first at or after its time
    found = running(rows.unionByName(asked), {"__next": ("last", F.when(F.col("__kind") == 1, F.col("__rank")))},
                    key=["__key"], order=["__at", "__kind", "__uid"], descending=True)
    jump = materialize(found.where("__kind = 0 and __next is not null").select("__key", "__rank", "__next"), "title-jumps")
    kept = ranked.where("__rank = 1").select("__key", "__rank")
    later = []
    while True:
        hit = materialize(kept.join(jump, ["__key", "__rank"]).select("__key", F.col("__next").alias("__rank")), "title-kept")
        if hit.isEmpty():
            break
        later.append(hit)
        kept = kept.unionByName(hit)
        beyond = jump.select("__key", F.col("__rank").alias("__next"), F.col("__next").alias("__far"))
        jump = materialize(jump.join(beyond, ["__key", "__next"]).select("__key", "__rank", F.col("__far").alias("__next")), "title-jumps")
    first = keep_first(tagged, F.coalesce("title_hash", F.lit("")), [time, uid])
    if not later:
        return first
    ranks = later[0]
    for hit in later[1:]:
        ranks = ranks.unionByName(hit)
    ids = ranked.join(ranks, ["__key", "__rank"]).select(F.col("__uid").alias(uid))
    return first.unionByName(tagged.join(ids, uid, "left_semi"))


def latest_per_order(fills: DataFrame, *, time: str = "ts", uid: str = "execution_id") -> DataFrame:
    """The last fill of each order."""
    return (
        fills.groupBy("order_id")
        .agg(F.max_by(F.struct(*[c for c in fills.columns if c != "order_id"]), F.struct(time, uid)).alias("r"))
        .select("order_id", "r.*")
    )


def feature_reason(df: DataFrame) -> Column:
    """The first broken rule of a feature event whose `values` map holds text."""
    raw = F.col("values")["obi"]
    x = raw.cast("string").try_cast("double")
    return (
        F.when(blank_to_null(F.col("instrument")).isNull(), "missing_instrument")
        .when(F.col("values").isNull() | (F.size("values") <= 0), "missing_values")
        .when(raw.isNull(), "missing_obi")
        .when(x.isNull(), "non_numeric_obi")
        .when(F.isnan(x) | (F.abs(x) == float("inf")), "nan_inf_obi")
    )


def validate_features(df: DataFrame) -> DataFrame:
    return df.withColumn("reason", feature_reason(df)).withColumn("ok", F.col("reason").isNull())


def extract_record(df: DataFrame) -> DataFrame:
    """Split usable store rows from quarantined ones by a `quarantined` flag."""
    bad = blank_to_null(F.col("instrument")).isNull() | F.col("event_time").isNull()
    return df.withColumn("quarantined", bad)


def coerce_values(df: DataFrame, values: str = "values") -> DataFrame:
    """Promote the map's known keys to double columns, with defaults, plus `<key>_defaulted`."""
    found = {k: finite(F.col(values)[k]) for k in FEATURE_DEFAULTS}
    return df.withColumns({
        **{k: F.coalesce(x, F.lit(FEATURE_DEFAULTS[k])) for k, x in found.items()},
        **{f"{k}_defaulted": x.isNull() for k, x in found.items()},
    })


def default_counts(coerced: DataFrame) -> DataFrame:
    """How often each key fell back to its default, one row per key."""
    sums = coerced.agg(*[F.count_if(f"{k}_defaulted").alias(k) for k in FEATURE_DEFAULTS])
    return sums.unpivot([], list(FEATURE_DEFAULTS), "feature", "defaulted")


def contract_violations(
    df: DataFrame, top_keys: str, values: str, required_top: list[str], required_values: list[str]
) -> DataFrame:
    """One row per missing key or non-numeric value of a feature event."""
    have = F.coalesce(F.col(top_keys), F.array().cast("array<string>"))
    vals = F.coalesce(F.col(values), F.create_map().cast("map<string,string>"))
    tag = lambda kind, names: F.transform(names, lambda k: F.struct(F.lit(kind).alias("problem"), k.alias("field")))
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    odd = F.map_keys(F.map_filter(vals, lambda k, v: finite(v).isNull()))
    problems = F.concat(
        tag("missing_top_level", F.array_except(lit(required_top), have)),
        tag("missing_value", F.array_except(lit(required_values), F.map_keys(vals))),
        tag("non_numeric_value", odd),
    )
    return df.withColumn("__p", F.explode(problems)).select(
        *[c for c in df.columns if c not in (top_keys, values)], "__p.problem", "__p.field"
    )


def kline_window(df: DataFrame, *, key: list[str], open_ms: str, close_ms: str, fallback: str) -> DataFrame:
    """First open and last close of a set of bars; the fallback time where they are absent."""
    return df.groupBy(*key).agg(
        F.coalesce(F.timestamp_millis(F.min(open_ms)), F.max(fallback)).alias("window_start"),
        F.coalesce(F.timestamp_millis(F.max(close_ms)), F.max(fallback)).alias("window_end"),
    )


def values_long(df: DataFrame, *, keep: list[str], values: str = "values") -> DataFrame:
    """One row per (event, key) of the values map."""
    return df.select(*keep, F.explode(values).alias("feature", "value"))


def rejection_windows(validated: DataFrame, *, time: str = "ts", width: str = "5 minutes",
                      threshold: float = 0.2, key: Column | None = None) -> DataFrame:
    """Rejected share and duplicate count per window, with the burst flag."""
    if key is None:
        key = fill_key(validated)
    # copies of one key fold together before the window totals are taken
    per_key = validated.groupBy(F.window(time, width)["start"].alias("window_start"), key.alias("k"), "ok").agg(
        F.count("*").alias("n")
    )
    totals = per_key.groupBy("window_start").agg(
        F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("valid"),
        F.sum(F.when(~F.col("ok"), F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("ok"), F.col("n") - 1).otherwise(0)).alias("duplicates"),
    )
    processed = F.col("valid") - F.col("duplicates")
    share = F.col("rejected") / F.greatest(processed, F.lit(1))
    return totals.select(
        "window_start", processed.alias("processed"), "rejected", "duplicates",
        share.alias("reject_ratio"), (share > threshold).alias("burst"),
    )

