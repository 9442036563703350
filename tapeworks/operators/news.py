"""News sentiment: cleaning, parsing of classifier answers, decayed aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.numeric import clamp, finite
from tapeworks.operators.ledger import recent

HALF_LIFE_SECS = 1800.0
WINDOW = "2 hours"
# The scored coins, characters a headline may keep, and the accepted labels.
COINS = ("btc", "eth", "sol", "xrp", "doge")
UNSAFE = r"[^a-zA-Z0-9\s.,;:!?'&$%#@\-+()/]"
LABELS = ["bullish", "bearish", "neutral"]


def sanitize(title: Column, chars: int | None = None) -> Column:
    """Drop unsafe characters; a prompt that can take only so many characters says so."""
    clean = F.regexp_replace(title, UNSAFE, "")
    return F.substring(clean, 1, chars) if chars else clean


def parse_response(df: DataFrame, *, response: str = "response", coins=COINS) -> DataFrame:
    """Label and confidence per coin from a classifier's text answer, and whether it parsed."""
    text = F.trim(F.col(response))
    fence = r"(?m)^\s*```.*$"
    bare = F.when(text.startswith("```"), F.regexp_replace(text, fence, "")).otherwise(text)
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    parsed = F.when(body != "", F.from_json(body, "map<string,string>"))
    # a generator keeps the optimizer from repeating the parse for every field
    d = df.select("*", F.explode(F.array(parsed)).alias("__j")).withColumn("classified", F.col("__j").isNotNull())
    out = {}
    for c in coins:
        label = F.lower(F.trim(F.col("__j")[c]))
        conf = finite(F.col("__j")[f"{c}_confidence"])
        out[f"{c}_sentiment"] = F.when(label.isin(LABELS), label).otherwise("neutral")
        out[f"{c}_confidence"] = F.round(clamp(F.coalesce(conf, F.lit(0.5)), 0.0, 1.0), 3)
    return d.withColumns(out).drop("__j")


def by_coin(parsed: DataFrame, *, coins=COINS) -> DataFrame:
    """One row per headline and coin."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("coin"), F.col(f"{c}_sentiment").alias("sentiment"), F.col(f"{c}_confidence").alias("confidence"))
        for c in coins
    ])
    keep = ["title", "processed_at", "headline_id", "classified"]
    return parsed.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def score_label(score: Column) -> Column:
    return (
        F.when(score < -0.5, "very_bearish").when(score < -0.2, "bearish").when(score < -0.05, "slightly_bearish")
        .when(score <= 0.05, "neutral").when(score <= 0.2, "slightly_bullish").when(score <= 0.5, "bullish")
        .otherwise("very_bullish")
    )


def retained(df: DataFrame, as_of, *, window: str = WINDOW) -> DataFrame:
    """The headlines of the window that ends at as_of; later ones are not known yet."""
    t = F.lit(as_of).cast("timestamp")
    return df.where((F.col("processed_at") > t - F.expr(f"interval {window}")) & (F.col("processed_at") <= t))


def sentiment(parsed: DataFrame, as_of, *, coins=COINS, half_life: float = HALF_LIFE_SECS, window: str = WINDOW) -> DataFrame:
    """Recency- and confidence-weighted score per coin over the window up to as_of;
    unclassified headlines are only counted."""
    parsed = retained(parsed, as_of, window=window)
    t = F.unix_micros(F.lit(as_of).cast("timestamp"))
    age = (t - F.unix_micros("processed_at")) / 1e6
    w = F.exp(-age * F.ln(F.lit(2.0)) / half_life)
    way = F.when(F.col("sentiment") == "bullish", 1.0).when(F.col("sentiment") == "bearish", -1.0).otherwise(0.0)
    c, ok = F.col("confidence"), F.col("classified")
    up = F.sum(F.when(ok, w * c * way))
    down = F.sum(F.when(ok, F.when(c > 0, w * c).otherwise(w)))
    return by_coin(parsed, coins=coins).groupBy("coin").agg(
        F.coalesce(F.when(down > 0, up / F.nullif(down, F.lit(0.0))), F.lit(0.0)).alias("score"),
        F.count_if(ok).alias("headlines"), F.count_if(~ok).alias("unclassified"),
        F.max_by("title", F.struct("processed_at", "headline_id")).alias("latest_headline"),
    ).withColumn("label", score_label(F.round("score", 4)))


def sentiment_series(parsed: DataFrame, *, step_minutes: int = 10, coins=COINS, half_life: float = HALF_LIFE_SECS,
                     window_minutes: int = 120) -> DataFrame:
    """`sentiment` at every multiple of the step that has a headline in its window: (coin, at, score).

    A headline goes to the snapshots it is seen by, window / step of them, and partial sums do
    the rest.
    """
    step = step_minutes * 60_000_000
    born = F.unix_micros("processed_at")
    first = F.ceil(born / step)
    seen = F.sequence(first, F.floor((born + F.lit(window_minutes * 60_000_000) - 1) / step))
    rows = by_coin(parsed, coins=coins).where("classified").withColumn("__k", F.explode(seen))
    w = F.exp(-(F.col("__k") * step - born) / 1e6 * F.ln(F.lit(2.0)) / half_life)
    way = F.when(F.col("sentiment") == "bullish", 1.0).when(F.col("sentiment") == "bearish", -1.0).otherwise(0.0)
    c = F.col("confidence")
    sums = rows.groupBy("coin", F.timestamp_micros(F.col("__k") * step).alias("at")).agg(
        F.sum(w * c * way).alias("up"), F.sum(F.when(c > 0, w * c).otherwise(w)).alias("down"))
    return sums.select("coin", "at", F.coalesce(F.col("up") / F.nullif(F.col("down"), F.lit(0.0)), F.lit(0.0)).alias("score"))


def recent_headlines(parsed: DataFrame, *, limit: int = 50) -> DataFrame:
    return recent(parsed, limit, time="processed_at", uid="headline_id")


def status(parsed: DataFrame) -> DataFrame:
    return parsed.agg(
        F.count("*").alias("headlines"), F.count_if(~F.col("classified")).alias("unclassified"),
        F.count_if("classified").alias("parsed"), F.countDistinct("source").alias("active_feeds"),
        F.max(F.when(F.col("classified"), F.col("processed_at"))).alias("last_parsed"),
    )
