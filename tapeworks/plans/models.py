"""Registered queries: samples and models, regimes, news, research, pipeline quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import baum_welch, ml, news, quality, regime, research, slo
from tapeworks.plans import market, views
from tapeworks.plans.accounting import trips
from tapeworks.plans.registry import pick, query, shared
from tapeworks.plans.views_sql import EM_ROUNDS


def samples(spark, sf):
    return shared(spark, sf, "samples", lambda: ml.build_training_set(views.quick_fills(spark, sf), views.features(spark, sf)))


_ENG = ml.FEATURES
_ENG_SQL = ", ".join(f"snap({c}, 7) AS {c}" for c in _ENG)
_ENG_EXPR = [f"snap({c}, 7) {c}" for c in _ENG]


@query("m1_engineer_features", f"SELECT event_id, {_ENG_SQL} FROM x_feat_eng")
def m1(spark, sf):
    return ml.engineer_features(views.features(spark, sf)).transform(pick, "event_id", *_ENG_EXPR)


@query("m2_preceding_features", "SELECT execution_id, epoch_us(feature_event_time) AS feature_us, snap(obi, 6) AS obi FROM x_known")
def m2(spark, sf):
    return ml.attach_preceding_features(views.quick_fills(spark, sf), views.features(spark, sf)).transform(
        pick, "execution_id", "unix_micros(feature_event_time) feature_us", "snap(obi, 6) obi")


@query("m3_training_set", f"SELECT entry_id, label, epoch_us(label_time) AS label_us, {_ENG_SQL} FROM x_samples")
def m3(spark, sf):
    return samples(spark, sf).transform(pick, "entry_id", "label", "unix_micros(label_time) label_us", *_ENG_EXPR)


@query("m4_temporal_split", """
SELECT entry_id, rn <= coalesce(max(rn) FILTER (WHERE rn <= greatest(1, CAST(floor(n * 0.8) AS BIGINT)) AND label_time <= later) OVER (), 1) AS is_train FROM (
  SELECT entry_id, label_time, row_number() OVER w AS rn, count(*) OVER () AS n,
    min(feature_event_time) OVER (ORDER BY label_time DESC, entry_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later
  FROM x_samples WINDOW w AS (ORDER BY label_time, entry_id))""")
def m4(spark, sf):
    return ml.temporal_split(samples(spark, sf)).select("entry_id", "is_train")


def split(spark, sf):
    return shared(spark, sf, "split", lambda: ml.temporal_split(samples(spark, sf)))


_MODELS: dict = {}


def classifier(spark, sf):
    """The model of the training part, fitted once per application and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = ml.train_classifier(split(spark, sf).where("is_train"))
    return _MODELS[key]


@query("m5_train_and_score")
def m5(spark, sf):
    """Trained on M4's training part only, scored on the test part."""
    return ml.score(classifier(spark, sf), split(spark, sf).where("NOT is_train")).transform(
        pick, "entry_id", "label", "prediction", "snap(confidence, 6) confidence", "model_ready")


@query("m5_scored_rows", """
SELECT entry_id, label, true AS model_ready FROM x_samples WHERE entry_id NOT IN (
  SELECT entry_id FROM (SELECT entry_id, rn, max(rn) FILTER (WHERE rn <= greatest(1, CAST(floor(n * 0.8) AS BIGINT)) AND label_time <= later) OVER () AS cut FROM (
    SELECT entry_id, label_time, row_number() OVER w AS rn, count(*) OVER () AS n,
      min(feature_event_time) OVER (ORDER BY label_time DESC, entry_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later
    FROM x_samples WINDOW w AS (ORDER BY label_time, entry_id))) WHERE rn <= coalesce(cut, 1))""")
def m5_rows(spark, sf):
    """The rows that M5 scores, and that a model was there."""
    return m5(spark, sf).select("entry_id", "label", "model_ready")


@query("m8_model_bookkeeping", f"""
SELECT '{ml.schema_hash()}' AS schema_hash, {len(ml.FEATURES)} AS features, 12 AS version_chars, true AS loaded, true AS refused, true AS same_version,
  1.0::DOUBLE AS importance, count(*) FILTER (WHERE is_train) AS samples FROM (
  SELECT rn <= coalesce(max(rn) FILTER (WHERE rn <= greatest(1, CAST(floor(n * 0.8) AS BIGINT)) AND label_time <= later) OVER (), 1) AS is_train FROM (
    SELECT label_time, row_number() OVER w AS rn, count(*) OVER () AS n,
      min(feature_event_time) OVER (ORDER BY label_time DESC, entry_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later
    FROM x_samples WINDOW w AS (ORDER BY label_time, entry_id)))""")
def m8(spark, sf):
    """Save the model with its metadata, load it, and be refused with another schema."""
    import uuid

    from tapeworks.session import durable_dir
    model = classifier(spark, sf)
    path = f"{durable_dir(spark)}/model-{uuid.uuid4().hex}"
    n = split(spark, sf).where("is_train").count()
    first, again = (ml.save_model(spark, model, path, trained_at="2024-01-31T00:00:00Z", samples=n) for _ in range(2))
    meta = spark.read.schema("version string, schema_hash string, samples long, importance map<string,double>").json(f"{path}/metadata")
    importance = F.aggregate(F.map_values("importance"), F.lit(0.0), lambda acc, x: acc + x)
    return meta.select(
        "schema_hash", F.size("importance").alias("features"), F.length("version").alias("version_chars"),
        F.lit(ml.load_model(spark, path) is not None).alias("loaded"), F.lit(ml.load_model(spark, path, features=ml.FEATURES[1:]) is None).alias("refused"),
        F.lit(first == again).alias("same_version"), F.round(importance, 6).alias("importance"), "samples")


_FIXED = "CASE WHEN abs_obi > 0.5 THEN 1 ELSE 0 END"


@query("m6_classifier_metrics", f"""
SELECT n, tp, fp, fn, tn, snap((tp + tn) / n, 6) AS accuracy, snap(tp / (tp + fp), 6) AS precision, snap(tp / (tp + fn), 6) AS recall,
  snap(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE label = 1 AND p = 1) AS tp, count(*) FILTER (WHERE label = 0 AND p = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND p = 0) AS fn, count(*) FILTER (WHERE label = 0 AND p = 0) AS tn FROM (SELECT label, {_FIXED} AS p FROM x_samples))""")
def m6(spark, sf):
    scored = samples(spark, sf).withColumn("prediction", F.expr(_FIXED))
    return ml.classifier_metrics(scored).transform(
        pick, "n", "tp", "fp", "fn", "tn", "snap(accuracy, 6) accuracy", "snap(precision, 6) precision", "snap(recall, 6) recall", "snap(f1, 6) f1")


@query("m7_promotion_gate", f"""
SELECT n, positives, snap(c, 6) AS challenger_accuracy, snap(i, 6) AS incumbent_accuracy, c > i AS promote FROM (
  SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, avg(CASE WHEN label = {_FIXED} THEN 1 ELSE 0 END) AS c, avg(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS i FROM x_samples)""")
def m7(spark, sf):
    scored = samples(spark, sf).withColumn("prediction", F.expr(_FIXED)).withColumn("always", F.lit(1))
    return ml.promotion_gate(scored, incumbent="always").transform(
        pick, "n", "positives", "snap(challenger_accuracy, 6) challenger_accuracy", "snap(incumbent_accuracy, 6) incumbent_accuracy", "promote")


@query("m6_trained_metrics")
def m6t(spark, sf):
    """M6 on what the trained model says of the test part; tested against counts of its predictions."""
    scored = ml.score(classifier(spark, sf), split(spark, sf).where("NOT is_train"))
    return ml.classifier_metrics(scored).transform(
        pick, "n", "tp", "fp", "fn", "tn", "snap(accuracy, 6) accuracy", "snap(precision, 6) precision", "snap(recall, 6) recall", "snap(f1, 6) f1")


@query("m7_trained_gate")
def m7t(spark, sf):
    """A model of the older half of the training part is the first; that of the whole part is gated against it."""
    import uuid

    from tapeworks.session import durable_dir
    path = f"{durable_dir(spark)}/gate-{uuid.uuid4().hex}"
    train, test = split(spark, sf).where("is_train"), split(spark, sf).where("NOT is_train")
    mid = train.agg(F.percentile_approx(F.unix_micros("label_time"), 0.5).alias("t")).first()["t"]
    older = train.where(F.unix_micros("label_time") <= mid)
    first = ml.gate_against_stored(spark, ml.train_classifier(older), path, test, trained_at="2024-01-15T00:00:00Z", samples=older.count())
    second = ml.gate_against_stored(spark, classifier(spark, sf), path, test, trained_at="2024-01-31T00:00:00Z", samples=train.count())
    return first.withColumn("turn", F.lit(1)).unionByName(second.withColumn("turn", F.lit(2))).select(
        "turn", "n", "positives", "challenger_accuracy", "incumbent_accuracy", "reason", "promote")


@query("m9_score_latest")
def m9(spark, sf):
    return ml.score_latest(classifier(spark, sf), views.features(spark, sf)).transform(pick, "instrument", "event_id", "snap(confidence, 6) confidence", "model_ready")


@query("m10_psi", """
SELECT feature, snap(sum((a - e) * ln(a / e)), 6) AS psi FROM (
  SELECT g.feature, g.bin, greatest(coalesce(sum(CASE WHEN h.half = 0 THEN c END), 0) / any_value(ne), 1e-6) AS e,
    greatest(coalesce(sum(CASE WHEN h.half = 1 THEN c END), 0) / any_value(na), 1e-6) AS a
  FROM (SELECT feature, unnest(range(10)) AS bin, count(*) FILTER (WHERE half = 0) AS ne, count(*) FILTER (WHERE half = 1) AS na
    FROM (SELECT feature, half FROM x_psi) GROUP BY feature) g
  LEFT JOIN (SELECT feature, half, bin, count(*) AS c FROM x_psi GROUP BY 1, 2, 3) h ON h.feature = g.feature AND h.bin = g.bin
  GROUP BY g.feature, g.bin) GROUP BY feature""")
def m10(spark, sf):
    f = ml.engineer_features(views.features(spark, sf))
    half = F.col("event_time") >= F.lit("2024-01-15").cast("timestamp")
    return ml.psi(f.where(~half), f.where(half), features=["abs_obi", "momentum", "volatility", "volume_ratio"]).transform(pick, "feature", "snap(psi, 6) psi")


@query("m11_confidence_distribution", """
SELECT count(*) AS n, snap(avg(c), 6) AS mean, snap(quantile_cont(c, 0.5), 6) AS p50, snap(quantile_cont(c, 0.9), 6) AS p90,
  snap(min(c), 6) AS min, snap(max(c), 6) AS max FROM (SELECT abs(obi) AS c FROM x_feat)""")
def m11(spark, sf):
    c = views.features(spark, sf).withColumn("confidence", F.abs("obi"))
    return ml.confidence_distribution(c, time="event_time", uid="event_id").transform(
        pick, "n", "snap(mean, 6) mean", "snap(p50, 6) p50", "snap(p90, 6) p90", "snap(min, 6) min", "snap(max, 6) max")


@query("m12_sample_status", """
SELECT total, labelled, total - labelled AS pending, snap(positive / labelled, 6) AS positive_rate FROM
  (SELECT count(*) AS total FROM x_known), (SELECT count(*) AS labelled, sum(label) AS positive FROM x_klabels)""")
def m12(spark, sf):
    known = ml.attach_preceding_features(views.quick_fills(spark, sf), views.features(spark, sf))
    return ml.sample_status(known, samples(spark, sf)).transform(pick, "total", "labelled", "pending", "snap(positive_rate, 6) positive_rate")


# --- regimes ----------------------------------------------------------------------------------

def obs(spark, sf):
    return regime.observations(views.features(spark, sf))


def models(spark, sf):
    return shared(spark, sf, "models", lambda: regime.fit_states(obs(spark, sf)))


@query("h1_observations", "SELECT event_id, snap(momentum, 7) AS x0, snap(volatility, 7) AS x1, snap(abs(obi), 6) AS x2 FROM x_feat")
def h1(spark, sf):
    return obs(spark, sf).transform(pick, "event_id", "snap(x0, 7) x0", "snap(x1, 7) x1", "snap(x2, 6) x2")


@query("h2_window_zscore", """
SELECT event_id, snap((x0 - avg(x0) OVER w) / stddev_pop(x0) OVER w, 5) AS x0, snap((x1 - avg(x1) OVER w) / stddev_pop(x1) OVER w, 5) AS x1,
  snap((x2 - avg(x2) OVER w) / stddev_pop(x2) OVER w, 5) AS x2 FROM (
  SELECT event_id, instrument, momentum AS x0, volatility AS x1, abs(obi) AS x2 FROM x_feat)
WINDOW w AS (PARTITION BY instrument)""")
def h2(spark, sf):
    return regime.window_zscore(obs(spark, sf)).transform(pick, "event_id", "snap(x0, 5) x0", "snap(x1, 5) x1", "snap(x2, 5) x2")


_FLATTEN = ["pi[0] pi0", "pi[2] pi2", *[f"trans[{i}] t{i}" for i in (0, 4, 8)], *[f"means[{i}] m{i}" for i in range(9)], *[f"covars[{9 * k + i}] v{k}{i}" for k in range(3) for i in (0, 1, 4, 8)]]
_SNAPPED = [f"snap({x.split()[0]}, 5) {x.split()[1]}" for x in _FLATTEN]
_SNAPPED_SQL = ", ".join(f"snap({x.split()[1]}, 5) AS {x.split()[1]}" for x in _FLATTEN)


@query("h3_fit_states", f"SELECT instrument, n_obs, {_SNAPPED_SQL} FROM x_hmm")
def h3(spark, sf):
    return models(spark, sf).transform(pick, "instrument", "n_obs", *_SNAPPED)


_PROBS = "snap(probs[0], 5) p0", "snap(probs[1], 5) p1", "snap(probs[2], 5) p2"
_PROBS_SQL = "snap(p0, 5) AS p0, snap(p1, 5) AS p1, snap(p2, 5) AS p2"


@query("h4_causal_filter", f"SELECT instrument, event_id, {_PROBS_SQL} FROM x_hall")
def h4(spark, sf):
    return regime.causal_filter(obs(spark, sf), models(spark, sf)).transform(pick, "instrument", "event_id", *_PROBS)


@query("h5_decode", "SELECT o.instrument, o.event_id, path FROM x_hstates o LEFT JOIN x_hpath h ON h.instrument = o.instrument AND h.event_id = o.event_id")
def h5(spark, sf):
    return regime.decode(obs(spark, sf), models(spark, sf)).select("instrument", "event_id", "path")


@query("h5_smooth", """
SELECT instrument, event_id, snap(p0 * b0 / (p0 * b0 + p1 * b1 + p2 * b2), 5) AS p0, snap(p2 * b2 / (p0 * b0 + p1 * b1 + p2 * b2), 5) AS p2
FROM x_hall LEFT JOIN x_hbwd USING (instrument, rn)""")
def h5s(spark, sf):
    return regime.smooth(obs(spark, sf), models(spark, sf)).transform(pick, "instrument", "event_id", "snap(smoothed[0], 5) p0", "snap(smoothed[2], 5) p2")


@query("h6_stationary_distribution", """
SELECT instrument, snap(b / (a + b), 6) AS down, snap(a / (a + b), 6) AS up FROM (
  SELECT instrument, avg(CASE WHEN s0 = 0 THEN s END) AS a, avg(CASE WHEN s0 = 1 THEN 1 - s END) AS b FROM (
    SELECT instrument, s, lag(s) OVER (PARTITION BY instrument ORDER BY event_time, event_id) AS s0 FROM (
      SELECT *, CASE WHEN obi > 0 THEN 1 ELSE 0 END AS s FROM x_feat)) GROUP BY instrument)""")
def h6(spark, sf):
    """Long-run shares of the imbalance sign, from its observed switching rates."""
    from tapeworks.functions.scan import running
    f = views.features(spark, sf).withColumn("s", F.when(F.col("obi") > 0, 1).otherwise(0))
    t = running(f, {"s0": ("lag", F.col("s"))}, key=["instrument"], order=["event_time", "event_id"])
    a, b = F.avg(F.when(F.col("s0") == 0, F.col("s"))), F.avg(F.when(F.col("s0") == 1, 1 - F.col("s")))
    m = t.groupBy("instrument").agg(F.array(1 - a, a, b, 1 - b).alias("trans"))
    return m.withColumn("pi", regime.stationary_distribution(F.col("trans"))).transform(
        pick, "instrument", "snap(pi[0], 6) down", "snap(pi[1], 6) up")


@query("h7_state_labels", """
SELECT instrument, event_type, CASE WHEN r = 1 THEN 'calm' WHEN r = k THEN 'turbulent' WHEN lead = 1 THEN 'trending' ELSE 'choppy' END AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY CASE WHEN r > 1 AND r < k THEN 0 ELSE 1 END, abs(trend) DESC, state) AS lead FROM (
    SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY vol + disp, state) AS r, count(*) OVER (PARTITION BY instrument) AS k FROM (
      SELECT instrument, event_type, length(event_type) * 100 + ascii(event_type) AS state, avg(momentum) AS trend, avg(volatility) AS vol,
        (var_pop(momentum) + var_pop(volatility) + var_pop(abs(obi))) / 3 AS disp FROM x_feat GROUP BY instrument, event_type)))""")
def h7(spark, sf):
    """Event types stand in for states, with their empirical means and variances as parameters."""
    s = views.features(spark, sf).groupBy("instrument", "event_type").agg(
        F.avg("momentum").alias("trend_mean"), F.avg("volatility").alias("vol_mean"),
        ((F.var_pop("momentum") + F.var_pop("volatility") + F.var_pop(F.abs("obi"))) / 3).alias("dispersion"),
    ).withColumn("state", F.length("event_type") * 100 + F.ascii("event_type"))
    return regime.derive_labels(s).select("instrument", "event_type", "label")


@query("h7_fitted_labels", """
SELECT instrument, CAST(state AS INTEGER) AS state, CASE WHEN r = 1 THEN 'calm' WHEN r = 3 THEN 'turbulent' ELSE 'trending' END AS label, snap(t, 4) AS turbulence FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t, state) AS r FROM (
    SELECT instrument, 0 AS state, m1 + (v00 + v04 + v08) / 3 AS t FROM x_hmm UNION ALL SELECT instrument, 1, m4 + (v10 + v14 + v18) / 3 FROM x_hmm
    UNION ALL SELECT instrument, 2, m7 + (v20 + v24 + v28) / 3 FROM x_hmm))""")
def h7m(spark, sf):
    return regime.derive_labels(regime.state_parameters(models(spark, sf))).transform(pick, "instrument", "state", "label", "snap(turbulence, 4) turbulence")


def hmm_noise(start: int, draw: int):
    """Noise from the number in the row's id, alike in both engines (twin of `noise_sql`)."""
    seq = F.regexp_extract("event_id", r"(\d+)$", 1).cast("long")
    return (((seq % 1000003) * 7919 + F.lit(start * 104729 + draw * 1299709 + 12345)) * 48271 % 2147483647 + 0.5) / 2147483647.0


def em_models(spark, sf):
    """Two rounds of Baum-Welch from two starts: as far as row-by-row SQL follows."""
    def build():
        o = obs(spark, sf)
        first = baum_welch.starts(o, 2, noise=hmm_noise)
        return baum_welch.refine(baum_welch.packed(o), first, rounds=EM_ROUNDS, tolerance=float("-inf"))
    return shared(spark, sf, "em", build)


_EM = [x for x in _SNAPPED if "pi" not in x] + ["snap(history[0], 4) ll0", "snap(history[1], 4) ll1"]
_EM_SQL = ", ".join([f"snap(a{i}, 5) AS t{i}" for i in (0, 4, 8)] + [f"snap(m{i}, 5) AS m{i}" for i in range(9)]
                    + [f"snap(v{k}{i}, 5) AS v{k}{i}" for k in range(3) for i in (0, 1, 4, 8)] + ["snap(ll0, 4) AS ll0", "snap(ll1, 4) AS ll1"])


@query("h3_baum_welch", f"SELECT instrument, start, n_obs, {_EM_SQL} FROM x_emfit")
def h3em(spark, sf):
    return em_models(spark, sf).transform(pick, "instrument", "cast(start as int) start", "n_obs", *_EM)


@query("h3_fit_hmm")
def h3fit(spark, sf):
    """The likeliest of five starts after at most 10 rounds; its likelihoods are tested to rise."""
    m = baum_welch.fit_hmm(obs(spark, sf), rounds=10)
    return m.select("instrument", "start", "n_obs", "loglik", F.size("history").alias("rounds"), "pi", "trans", "means", "covars")


@query("h5_score", "SELECT instrument, snap(sum(ll), 4) AS loglik FROM x_hscore GROUP BY instrument")
def h5score(spark, sf):
    return baum_welch.score(obs(spark, sf), models(spark, sf)).transform(pick, "instrument", "snap(loglik, 4) loglik")


@query("h8_regime_history", f"SELECT instrument, event_id, epoch, {_PROBS_SQL} FROM x_hhist")
def h8(spark, sf):
    return regime.regime_history(obs(spark, sf)).transform(pick, "instrument", "event_id", "epoch", *_PROBS)


@query("h9_warm_start", f"SELECT instrument, n_obs, {_SNAPPED_SQL} FROM x_hwarm")
def h9(spark, sf):
    return regime.warm_start(views.revisions(spark, sf), views.AS_OF_MID).transform(pick, "instrument", "n_obs", *_SNAPPED)


# --- news -------------------------------------------------------------------------------------

def parsed(spark, sf):
    return news.parse_response(views.headlines(spark, sf))


@query("n1_sanitize", r"""
SELECT headline_id, regexp_replace(title, '[^a-zA-Z0-9\s.,;:!?''&$%#@\-+()/]', '', 'g') AS clean FROM x_head""")
def n1(spark, sf):
    return views.headlines(spark, sf).select("headline_id", news.sanitize(F.col("title")).alias("clean"))


_ANSWERS = [f"{c}_{x}" for c in news.COINS for x in ("sentiment", "confidence")]


@query("n2_parse_response", f"SELECT headline_id, classified, {', '.join(_ANSWERS)} FROM x_news")
def n2(spark, sf):
    return parsed(spark, sf).select("headline_id", "classified", *_ANSWERS)


_SCORE = f"""
SELECT coin, coalesce(sum(w * c * d) FILTER (WHERE classified) / sum(CASE WHEN c > 0 THEN w * c ELSE w END) FILTER (WHERE classified), 0) AS score,
  count(*) FILTER (WHERE classified) AS headlines, count(*) FILTER (WHERE NOT classified) AS unclassified FROM (
  SELECT coin, classified, c, CASE s WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END AS d,
    exp(-(epoch_us(TIMESTAMP '{views.NEWS_AS_OF}') - epoch_us(processed_at)) / 1e6 * ln(2) / 1800) AS w FROM x_coins
  WHERE processed_at > TIMESTAMP '{views.NEWS_AS_OF}' - INTERVAL 2 HOUR AND processed_at <= TIMESTAMP '{views.NEWS_AS_OF}') GROUP BY coin"""


@query("n3_n4_sentiment", f"""
SELECT coin, snap(score, 6) AS score, headlines, unclassified, CASE WHEN score < -0.5 THEN 'very_bearish' WHEN score < -0.2 THEN 'bearish'
  WHEN score < -0.05 THEN 'slightly_bearish' WHEN score <= 0.05 THEN 'neutral' WHEN score <= 0.2 THEN 'slightly_bullish'
  WHEN score <= 0.5 THEN 'bullish' ELSE 'very_bullish' END AS label FROM ({_SCORE})""")
def n3(spark, sf):
    return news.sentiment(parsed(spark, sf), views.NEWS_AS_OF).transform(pick, "coin", "snap(score, 6) score", "headlines", "unclassified", "label")


@query("n5_retention", """
SELECT headline_id FROM x_head WHERE processed_at > TIMESTAMP '2024-01-01 02:30:00' - INTERVAL 2 HOUR AND processed_at <= TIMESTAMP '2024-01-01 02:30:00'""")
def n5(spark, sf):
    return news.retained(views.headlines(spark, sf), "2024-01-01 02:30:00").select("headline_id")


@query("n6_recent_headlines", "SELECT headline_id, source FROM x_head ORDER BY processed_at DESC, headline_id DESC LIMIT 50")
def n6(spark, sf):
    return news.recent_headlines(views.headlines(spark, sf)).select("headline_id", "source")


@query("n6_status", """
SELECT count(*) AS headlines, count(*) FILTER (WHERE NOT classified) AS unclassified, count(*) FILTER (WHERE classified) AS parsed,
  count(DISTINCT source) AS active_feeds FROM x_head""")
def n6s(spark, sf):
    return news.status(parsed(spark, sf)).select("headlines", "unclassified", "parsed", "active_feeds")


# --- research ---------------------------------------------------------------------------------

def forward(spark, sf):
    return research.forward_returns(views.features(spark, sf))


@query("w1_forward_returns", "SELECT event_id, snap(fwd_ret, 8) AS fwd_ret FROM x_fwd")
def w1(spark, sf):
    return forward(spark, sf).transform(pick, "event_id", "snap(fwd_ret, 8) fwd_ret")


@query("w2_information_coefficient", """
SELECT instrument, count(*) AS n, snap(corr(rs, rr), 6) AS ic FROM (
  SELECT instrument, rank() OVER (PARTITION BY instrument ORDER BY obi) + (count(*) OVER (PARTITION BY instrument, obi) - 1) / 2 AS rs,
    rank() OVER (PARTITION BY instrument ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY instrument, fwd_ret) - 1) / 2 AS rr
  FROM x_fwd WHERE fwd_ret IS NOT NULL) GROUP BY instrument""")
def w2(spark, sf):
    return research.information_coefficient(forward(spark, sf)).transform(pick, "instrument", "n", "snap(ic, 6) ic")


@query("w3_rolling_corr", """
SELECT event_id, n, CASE WHEN isfinite(c) THEN snap(c, 5) END AS corr FROM (
  SELECT event_id, count(*) OVER w AS n, corr(obi, fwd_ret) OVER w AS c FROM x_fwd
  WINDOW w AS (PARTITION BY instrument ORDER BY event_time, event_id ROWS 59 PRECEDING))""")
def w3(spark, sf):
    return research.rolling_corr(forward(spark, sf), window=60).transform(pick, "event_id", "n", "if(isnan(corr), null, snap(corr, 5)) corr")


@query("w3_hit_rate", """
SELECT instrument, count(*) AS n, snap(avg(CASE WHEN sign(obi) = sign(fwd_ret) THEN 1 ELSE 0 END), 6) AS hit_rate
FROM x_fwd WHERE obi <> 0 AND fwd_ret <> 0 GROUP BY instrument""")
def w3h(spark, sf):
    return research.hit_rate(forward(spark, sf)).transform(pick, "instrument", "n", "snap(hit_rate, 6) hit_rate")


@query("w5_threshold_fills", """
SELECT execution_id, side, snap(fill_price, 6) AS fill_price, snap(transaction_cost, 9) AS transaction_cost FROM x_swfills WHERE combo = 't0.7_s0.01'""")
def w5(spark, sf):
    return research.strategy_fills(views.features(spark, sf), research.STRATEGIES["threshold"](0.7), size=0.01).transform(
        pick, "execution_id", "side", "snap(fill_price, 6) fill_price", "snap(transaction_cost, 9) transaction_cost")


@query("w4_w6_strategy_signals", """
SELECT 'vwap_deviation' AS strategy, count(*) FILTER (WHERE g < -0.001) AS buys, count(*) FILTER (WHERE g > 0.001) AS sells
  FROM (SELECT (close - vwap) / vwap AS g FROM x_bars15)
UNION ALL SELECT 'ema_crossover', count(*) FILTER (WHERE ef > es AND es > 0), count(*) FILTER (WHERE ef < es) FROM x_sig5
UNION ALL SELECT 'ou_zscore', count(*) FILTER (WHERE z BETWEEN -3 AND -1.5), count(*) FILTER (WHERE z BETWEEN 1.5 AND 3) FROM (
  SELECT (close - (mx - md / slope)) / nullif(sd, 0) AS z FROM (
    SELECT close, CASE WHEN count(dx) OVER w >= 60 THEN covar_pop(dx, x) OVER w / nullif(var_pop(x) OVER w, 0) END AS slope,
      avg(x) OVER w AS mx, avg(dx) OVER w AS md, stddev_pop(close) OVER w AS sd FROM (
      SELECT *, close - x AS dx FROM (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY open_time) AS x FROM x_bars5))
    WINDOW w AS (PARTITION BY instrument ORDER BY open_time ROWS 59 PRECEDING)) WHERE slope < 0)""")
def w6(spark, sf):
    s = research.STRATEGIES
    ticks = views.trade_ticks(spark, sf)
    from tapeworks.operators.bars import bars
    parts = {
        "vwap_deviation": (bars(ticks, "15 minutes"), s["vwap_deviation"]()),
        "ema_crossover": (market.signals_of(spark, sf, "5 minutes"), s["ema_crossover"]()),
        "ou_zscore": (research.ou_scores(market.bars5(spark, sf)), s["ou_zscore"]()),
    }
    out = None
    for name, (df, way) in parts.items():
        c = df.withColumn("way", way).agg(F.count_if(F.col("way") > 0).alias("buys"), F.count_if(F.col("way") < 0).alias("sells"))
        c = c.select(F.lit(name).alias("strategy"), "buys", "sells")
        out = c if out is None else out.unionByName(c)
    return out


@query("w6_vpin_breakout", """
SELECT instrument, CAST(CASE WHEN vpin > 0.1501 THEN sign(flow) ELSE 0 END AS INTEGER) AS way, count(*) AS n FROM (
  SELECT instrument, flow, avg(abs(flow) / 200) OVER (PARTITION BY instrument ORDER BY bucket ROWS 49 PRECEDING) AS vpin FROM x_vpin)
GROUP BY 1, 2""")
def w6v(spark, sf):
    from tapeworks.operators.signals import vpin
    v = vpin(views.trade_ticks(spark, sf), bucket_volume=200.0)
    return v.withColumn("way", research.STRATEGIES["vpin_breakout"](0.1501)).groupBy("instrument", "way").agg(F.count("*").alias("n"))


@query("w7_composite", """
SELECT event_id, snap(s, 6) AS score, 3 AS alphas, CASE WHEN s > 0.05 + 1e-9 THEN 'BUY' WHEN s < -0.05 - 1e-9 THEN 'SELL' END AS entry
FROM (SELECT event_id, -0.5 * obi + 100 * momentum * 0.3 + 0.2 * (fearGreed - 50) / 50 AS s FROM x_feat)""")
def w7(spark, sf):
    f = views.features(spark, sf)
    alphas = f.select("instrument", "event_time", "event_id", F.explode(F.create_map(
        F.lit("imbalance"), -F.col("obi"), F.lit("momentum"), 100 * F.col("momentum"), F.lit("mood"), (F.col("fearGreed") - 50) / 50,
    )).alias("alpha", "signal"))
    weights = spark.createDataFrame([("imbalance", 0.5), ("momentum", 0.3), ("mood", 0.2)], "alpha string, weight double")
    return research.composite(alphas, weights).transform(pick, "event_id", "snap(score, 6) score", "cast(alphas as int) alphas", "entry")


@query("w8_parameter_sweep", """
SELECT combo, count(*) AS fills, snap(sum(realized), 5) AS realized_pnl, snap(sum(realized - transaction_cost), 5) AS net_pnl,
  snap(avg(CASE WHEN realized - transaction_cost > 0 THEN 1 ELSE 0 END) FILTER (WHERE opposes), 6) AS hit_rate,
  snap(sum(quantity * fill_price) / 100000, 6) AS turnover,
  any_value(hold) AS avg_hold_secs FROM x_sw_pos LEFT JOIN (
    SELECT combo, snap(avg(epoch_us(exit_time) - epoch_us(entry_time)) / 1e6, 2) AS hold FROM x_swmatch GROUP BY combo) USING (combo) GROUP BY combo""")
def w8(spark, sf):
    return research.parameter_sweep(views.features(spark, sf)).transform(
        pick, "combo", "fills", "snap(realized_pnl, 5) realized_pnl", "snap(net_pnl, 5) net_pnl", "snap(hit_rate, 6) hit_rate", "snap(turnover, 6) turnover",
        "snap(avg_hold_secs, 2) avg_hold_secs")


def folds(spark, sf):
    return shared(spark, sf, "folds", lambda: research.fold_results(views.features(spark, sf)))


@query("w9_walk_forward", """
SELECT CAST(fold AS INTEGER) AS fold, combo, snap(train_pnl, 5) AS train_pnl, snap(test_pnl, 5) AS test_pnl, test_fills,
  coalesce(test_pnl > 0, false) AS profitable FROM x_wfbest""")
def w9(spark, sf):
    return research.walk_forward(folds(spark, sf)).transform(
        pick, "fold", "combo", "snap(train_pnl, 5) train_pnl", "snap(test_pnl, 5) test_pnl", "test_fills", "profitable")


@query("w10_overfitting_probability", """
SELECT count(*) AS folds, snap(avg(CASE WHEN w > n / 2 THEN 1.0 ELSE 0 END), 6) AS pbo FROM (
  SELECT r.fold, count(*) AS n, count(*) FILTER (WHERE r.net_pnl >= b.test_pnl) AS w
  FROM x_wfres r JOIN x_wfbest b ON b.fold = r.fold WHERE r.part = 'test' GROUP BY r.fold)""")
def w10(spark, sf):
    return research.overfitting_probability(folds(spark, sf)).transform(pick, "folds", "snap(pbo, 6) pbo")


@query("w11_deflated_sharpe", """
SELECT * FROM (WITH t AS (SELECT combo, avg(realized - transaction_cost) / stddev_pop(realized - transaction_cost) AS sharpe FROM x_sw_pos WHERE opposes GROUP BY combo),
  n AS (SELECT count(*) AS n_trials, var_samp(sharpe) AS v FROM t), best AS (SELECT combo FROM t ORDER BY sharpe DESC, combo LIMIT 1),
  r AS (SELECT realized - transaction_cost AS net FROM x_sw_pos JOIN best USING (combo) WHERE opposes),
  m AS (SELECT count(*) AS n, avg(net) AS mean, stddev_pop(net) AS sd FROM r),
  h AS (SELECT any_value(n) AS n, any_value(mean) / any_value(sd) AS s, avg(power((net - mean) / sd, 3)) AS skew, avg(power((net - mean) / sd, 4)) AS kurt FROM r, m),
  z AS (SELECT *, (s - sqrt(v) * %s) * sqrt(greatest(n - 1, 0)) / sqrt(greatest(1 - skew * s + (kurt - 1) / 4 * s * s, 1e-12)) AS z FROM h, n)
SELECT n, n_trials, snap(s, 6) AS sharpe, snap(skew, 4) AS skew, snap(kurt, 4) AS kurt, snap(%s, 5) AS dsr FROM z)""" % (
    research.expected_maximum(len(research.THRESHOLDS) * len(research.SIZES)), research.normal_cdf_sql("z")))
def w11(spark, sf):
    """The best of the parameter combinations against the luck of having tried them all."""
    trips = shared(spark, sf, "sweep_trips", lambda: research.sweep_trips(views.features(spark, sf)))
    trials = research.trial_sharpes(trips)
    return research.deflated_sharpe(research.best_trial(trips, trials), trials).transform(
        pick, "n", "n_trials", "snap(sharpe, 6) sharpe", "snap(skew, 4) skew", "snap(kurt, 4) kurt", "snap(dsr, 5) dsr")


# --- pipeline quality -------------------------------------------------------------------------

_RATIOS = """
SELECT job, minute, %s FROM x_permin WINDOW
  w5 AS (PARTITION BY job ORDER BY minute RANGE 4 PRECEDING), w30 AS (PARTITION BY job ORDER BY minute RANGE 29 PRECEDING),
  w1 AS (PARTITION BY job ORDER BY minute RANGE 59 PRECEDING), w6 AS (PARTITION BY job ORDER BY minute RANGE 359 PRECEDING)"""
_WIN = {"5m": "w5", "30m": "w30", "1h": "w1", "6h": "w6"}
_BAD = _RATIOS % ", ".join(f"sum(bad) OVER {w} / greatest(sum(total) OVER {w}, 1) AS bad_{n}" for n, w in _WIN.items())
_DOWN = _RATIOS % ", ".join(f"1 - sum(ups) OVER {w} / sum(total) OVER {w} AS down_{n}" for n, w in _WIN.items())


def ratios(spark, sf):
    return slo.latency_bad_ratio(views.latency(spark, sf))


@query("q1_latency_bad_ratio", f"SELECT job, minute, {', '.join(f'snap(bad_{n}, 6) AS bad_{n}' for n in _WIN)} FROM ({_BAD})")
def q1(spark, sf):
    return ratios(spark, sf).transform(pick, "job", "minute", *[f"snap(bad_{n}, 6) bad_{n}" for n in _WIN])


@query("q2_burn_alerts", f"""
SELECT job, minute, bad_1h > 0.144 AND bad_5m > 0.144 AS fast_burn, bad_6h > 0.06 AND bad_30m > 0.06 AS slow_burn FROM ({_BAD})""")
def q2(spark, sf):
    return slo.burn_alerts(ratios(spark, sf)).select("job", "minute", "fast_burn", "slow_burn")


@query("q3_freshness_gaps", """
SELECT job, m AS limit_min, count(*) AS gaps, snap(max(gap), 4) AS longest_secs FROM (
  SELECT job, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY job ORDER BY ts, event_id))) / 1e6 AS gap FROM x_lat),
  (VALUES (2), (5), (10), (20), (30)) t(m) WHERE gap > m * 60 GROUP BY job, m""")
def q3(spark, sf):
    return slo.freshness_gaps(views.latency(spark, sf)).transform(pick, "job", "limit_min", "gaps", "snap(longest_secs, 4) longest_secs")


@query("q4_rejection_bursts", """
SELECT epoch_us(w) AS window_us, valid - dup AS processed, rejected, dup AS duplicates, rejected / greatest(valid - dup, 1) > 0.2 AS burst FROM (
  SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, count(*) FILTER (WHERE reason IS NULL) AS valid, count(*) FILTER (WHERE reason IS NOT NULL) AS rejected,
    count(*) FILTER (WHERE reason IS NULL) - count(DISTINCT CASE WHEN reason IS NULL THEN coalesce(nullif(trim(execution_id), ''),
      concat_ws('|', order_id, ts, side, quantity, fill_price)) END) AS dup FROM x_checked GROUP BY 1)""")
def q4(spark, sf):
    return quality.rejection_windows(views.validated_fills(spark, sf)).select(
        F.unix_micros("window_start").alias("window_us"), "processed", "rejected", "duplicates", "burst")


@query("q5_availability", f"""
SELECT minute, {', '.join(f'snap(max(down_{n}), 6) AS down_{n}' for n in _WIN)}, max(down_1h) > 0.072 AND max(down_5m) > 0.072 AS fast_burn,
  max(down_6h) > 0.03 AND max(down_30m) > 0.03 AS slow_burn FROM ({_DOWN}) GROUP BY minute""")
def q5(spark, sf):
    return slo.worst_unavailability(slo.unavailability(views.latency(spark, sf))).transform(
        pick, "minute", *[f"snap(down_{n}, 6) down_{n}" for n in _WIN], "fast_burn", "slow_burn")


@query("q6_latency_quantiles", """
SELECT job, snap(quantile_cont(latency_ms, 0.5), 5) AS p50, snap(quantile_cont(latency_ms, 0.95), 5) AS p95, snap(quantile_cont(latency_ms, 0.99), 5) AS p99
FROM x_lat GROUP BY job""")
def q6(spark, sf):
    return slo.latency_quantiles(views.latency(spark, sf)).transform(pick, "job", "snap(p50, 5) p50", "snap(p95, 5) p95", "snap(p99, 5) p99")


@query("q6_rates", "SELECT epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) AS window_us, side, instrument, count(*) AS n FROM x_lat GROUP BY 1, 2, 3")
def q6r(spark, sf):
    return slo.rates(views.latency(spark, sf), key=["side", "instrument"]).select(
        F.unix_micros("window_start").alias("window_us"), "side", "instrument", "n")
