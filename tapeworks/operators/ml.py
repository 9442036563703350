"""Signal-quality samples, model training, metrics and drift."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.asof import asof_join
from tapeworks.functions.numeric import ratio
from tapeworks.functions.quantiles import exact_quantiles
from tapeworks.functions.scan import order_cuts, running, with_block
from tapeworks.operators.ledger import fifo_labels, fifo_match
from tapeworks.session import exists, materialize

MIN_SAMPLES, RETRAIN_INTERVAL, TEST_SHARE = 30, 50, 0.2
MAX_DEPTH, ROUNDS, LEARNING_RATE = 4, 100, 0.1
MIN_TEST_POSITIVES = 5
PSI_BINS = 10
# The model's feature names in their order.
FEATURES = [
    "abs_obi", "obi_sign", "momentum", "volatility", "fear_greed_norm", "volume_ratio", "spread_rel",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos",
]
RAW = ["obi", "midPrice", "spread", "momentum", "volatility", "fearGreed", "volumeRatio"]


def engineer_features(df: DataFrame, *, time: str = "event_time") -> DataFrame:
    hour = (F.hour(time) + F.minute(time) / 60) / 24 * 2 * F.pi()
    day = F.weekday(time) / 7 * 2 * F.pi()
    return df.withColumns({
        "abs_obi": F.abs("obi"), "obi_sign": F.when(F.col("obi") >= 0, 1.0).otherwise(-1.0),
        "momentum": F.col("momentum"), "volatility": F.col("volatility"),
        "fear_greed_norm": F.col("fearGreed") / 100, "volume_ratio": F.col("volumeRatio"),
        "spread_rel": F.when(F.col("midPrice") > 0, ratio(F.col("spread"), F.col("midPrice"))).otherwise(0.0),
        "hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "dow_sin": F.sin(day), "dow_cos": F.cos(day),
    })


def attach_preceding_features(fills: DataFrame, features: DataFrame) -> DataFrame:
    """The latest feature row strictly before each fill; fills without one are dropped."""
    j = asof_join(
        fills, features, left_time="ts", right_time="event_time", left_uid="execution_id",
        right_uid="event_id", take={**{c: c for c in RAW}, "feature_event_time": "event_time"}, strict=True,
    )
    return j.where(F.col("feature_event_time").isNotNull())


def build_training_set(fills: DataFrame, features: DataFrame) -> DataFrame:
    """Labelled samples: features of the entry fill, outcome of its closed lot."""
    # matching scans these rows several times, and the samples join them again
    known = materialize(attach_preceding_features(fills, features), "known")
    # the labels read the matches by their entries and by their exits
    labels = fifo_labels(materialize(fifo_match(known), "matches"))
    entry = engineer_features(known, time="feature_event_time").select(
        "instrument", F.col("execution_id").alias("entry_id"), "feature_event_time", *FEATURES)
    return labels.join(entry, ["instrument", "entry_id"])


def temporal_split(samples: DataFrame, *, test_share: float = TEST_SHARE, uid: str = "entry_id") -> DataFrame:
    """Mark training rows so that no training label resolves after a test row's features.

    The boundary is the largest valid rank at or below the wanted one, never below 1.
    """
    order = ["label_time", uid]
    cuts = order_cuts(samples, order)
    ranked = running(samples, {"rank": ("count", F.lit(1))}, order=order, cuts=cuts)
    ranked = running(
        ranked, {"__later": ("min", F.col("feature_event_time"), "before")}, order=order, cuts=cuts, descending=True, source=with_block(samples, order, cuts))
    # read for the boundary and for the rows
    ranked = materialize(ranked, "ranked")
    n = samples.count()
    wanted = max(1, int(n * (1 - test_share)))
    wanted = max(1, n - 1) if wanted >= n else wanted
    valid = (F.col("rank") <= wanted) & (F.col("label_time") <= F.col("__later"))
    cut = ranked.agg(F.max(F.when(valid, F.col("rank"))).alias("k")).first()["k"] or 1
    return ranked.withColumn("is_train", F.col("rank") <= cut).drop("__later")


def train_classifier(train: DataFrame, *, features: list[str] = FEATURES, rounds: int = ROUNDS,
                     depth: int = MAX_DEPTH, rate: float = LEARNING_RATE, min_samples: int = MIN_SAMPLES,
                     seed: int = 42) -> PipelineModel | None:
    """Boosted trees weighted by class balance; None with too few rows or a single class."""
    c = train.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    n, pos = c["n"], c["p"] or 0
    if n < min_samples or pos in (0, n):
        return None
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, (n - pos) / pos).otherwise(1.0))
    gbt = GBTClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", maxDepth=depth, maxIter=rounds,
        stepSize=rate, seed=seed,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), gbt]).fit(weighted)


def score(model: PipelineModel | None, rows: DataFrame) -> DataFrame:
    """Confidence that a trade pays; 0.5 while there is no model."""
    if model is None:
        return rows.withColumns({"confidence": F.lit(0.5), "prediction": F.lit(0.0), "model_ready": F.lit(False)})
    s = model.transform(rows).withColumn("confidence", vector_to_array("probability")[1])
    return s.withColumn("model_ready", F.lit(True)).drop("features", "rawPrediction", "probability")


def score_latest(model: PipelineModel | None, features: DataFrame) -> DataFrame:
    """The newest feature row of every instrument, scored."""
    rest = [c for c in features.columns if c != "instrument"]
    latest = features.groupBy("instrument").agg(
        F.max_by(F.struct(*rest), F.struct("event_time", "event_id")).alias("r")).select("instrument", "r.*")
    return score(model, engineer_features(latest))


def classifier_metrics(scored: DataFrame, *, label="label", prediction="prediction") -> DataFrame:
    """Accuracy, precision, recall and F1, 0 where a denominator is 0."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = scored.agg(
        F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    safe = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    c = c.withColumns({
        "accuracy": safe(F.col("tp") + F.col("tn"), F.col("n")),
        "precision": safe(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": safe(F.col("tp"), F.col("tp") + F.col("fn")),
    })
    return c.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def promotion_gate(scored: DataFrame, *, challenger="prediction", incumbent: str | None = None,
                   min_positives: int = MIN_TEST_POSITIVES) -> DataFrame:
    """Promote only on a two-class test set with enough positives and a strictly better accuracy."""
    right = lambda c: F.avg((F.col(c) == F.col("label")).cast("double"))
    a = scored.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("positives"),
        right(challenger).alias("challenger_accuracy"),
        (right(incumbent) if incumbent else F.lit(None).cast("double")).alias("incumbent_accuracy"),
    )
    n, pos = F.col("n"), F.col("positives")
    reason = (
        F.when(n == 0, "empty_test_set").when((pos == 0) | (pos == n), "single_class")
        .when(pos < min_positives, "too_few_positives")
        .when(F.col("incumbent_accuracy").isNull(), "first_model")
        .when(F.col("challenger_accuracy") > F.col("incumbent_accuracy"), "better")
        .otherwise("no_improvement")
    )
    return a.withColumn("reason", reason).withColumn("promote", F.col("reason").isin("first_model", "better"))


def gate_against_stored(spark: SparkSession, candidate: PipelineModel | None, path: str, test: DataFrame, *, trained_at: str, samples: int,
                        features: list[str] = FEATURES) -> DataFrame:
    """The gate's decision on a newly trained model against the stored one, both on the same test
    rows. A promoted candidate is stored in its place; no candidate is never promoted."""
    if candidate is None:
        none = promotion_gate(test.limit(0).withColumn("prediction", F.lit(0.0)))
        return none.withColumn("reason", F.lit("not_trained"))
    stored = load_model(spark, path, features=features) if exists(spark, f"{path}/metadata") else None
    scored = score(candidate, test).withColumnRenamed("prediction", "challenger").drop("confidence", "model_ready")
    if stored is not None:
        scored = score(stored, scored).withColumnRenamed("prediction", "incumbent")
    decision = materialize(promotion_gate(scored, challenger="challenger", incumbent=None if stored is None else "incumbent"), "gate")
    if decision.first()["promote"]:
        save_model(spark, candidate, path, trained_at=trained_at, samples=samples, features=features)
    return decision


def schema_hash(features: list[str] = FEATURES) -> str:
    return hashlib.sha256(json.dumps(features).encode()).hexdigest()[:16]


def feature_importance(model: PipelineModel, features: list[str] = FEATURES) -> dict[str, float]:
    return dict(zip(features, (float(x) for x in model.stages[-1].featureImportances.toArray())))


def save_model(spark: SparkSession, model: PipelineModel, path: str, *, trained_at: str, samples: int,
               features: list[str] = FEATURES) -> str:
    """Save the pipeline with its metadata row; returns the version id."""
    importance = feature_importance(model, features)
    stamp = json.dumps([trained_at, samples, schema_hash(features), importance], sort_keys=True)
    version = hashlib.sha256(stamp.encode()).hexdigest()[:12]
    model.write().overwrite().save(f"{path}/model")
    row = [(version, schema_hash(features), trained_at, samples, importance)]
    spark.createDataFrame(
        row, "version string, schema_hash string, trained_at string, samples long, importance map<string,double>"
    ).write.mode("overwrite").json(f"{path}/metadata")
    return version


def load_model(spark: SparkSession, path: str, *, features: list[str] = FEATURES) -> PipelineModel | None:
    """The saved model, or None when it was trained on another feature schema."""
    meta = spark.read.schema("version string, schema_hash string").json(f"{path}/metadata").first()
    if meta is None or meta["schema_hash"] != schema_hash(features):
        return None
    return PipelineModel.load(f"{path}/model")


def psi(expected: DataFrame, actual: DataFrame, *, features: list[str], bins: int = PSI_BINS) -> DataFrame:
    """Population stability index per feature on equal-width bins of the joint range."""
    long = lambda df, side: df.select(F.lit(side).alias("side"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        ["side"], features, "feature", "value").where(F.col("value").isNotNull())
    both = long(expected, "e").unionByName(long(actual, "a"))
    span = both.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.count_if(F.col("side") == "e").alias("ne"), F.count_if(F.col("side") == "a").alias("na"))
    # one row per feature: always small, Spark checks its size before broadcasting it
    place = F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    hist = both.join(span, "feature").where(F.col("hi") > F.col("lo")).groupBy("feature", place.alias("bin")).agg(
        F.count_if(F.col("side") == "e").alias("e"), F.count_if(F.col("side") == "a").alias("a"))
    grid = span.where((F.col("hi") > F.col("lo")) & (F.col("ne") > 0) & (F.col("na") > 0)).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(hist, ["feature", "bin"], "left")
    share = lambda c, n: F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.col(n), F.lit(1e-6))
    e, a = share("e", "ne"), share("a", "na")
    scored = full.groupBy("feature").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))
    return span.select("feature").join(scored, "feature", "left").select(
        "feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def confidence_distribution(scored: DataFrame, *, value="confidence", time="ts", uid="execution_id",
                            last_n: int | None = None) -> DataFrame:
    """Mean, median, 90th percentile and range of the confidences, or of the newest last_n."""
    if last_n:
        scored = running(scored.select(value, time, uid), {"__k": ("count", F.lit(1))}, order=[time, uid],
                         descending=True).where(F.col("__k") <= last_n)
    q = exact_quantiles(scored, key=[], value=value, probs={"p50": 0.5, "p90": 0.9}).withColumn("one", F.lit(1))
    a = scored.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"),
                   F.max(value).alias("max"), F.lit(1).alias("one"))
    return a.join(q, "one").drop("one")


def sample_status(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """How many samples exist, are labelled, pending, and positive."""
    e = entries.agg(F.count("*").alias("total"), F.lit(1).alias("one"))
    l = labels.agg(F.count("*").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("positive"), F.lit(1).alias("one"))
    return e.join(l, "one").select(
        "total", "labelled", (F.col("total") - F.col("labelled")).alias("pending"),
        F.coalesce(ratio(F.col("positive"), F.col("labelled")), F.lit(0.0)).alias("positive_rate"))
