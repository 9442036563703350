"""Hidden-Markov models from unlabelled series: Baum-Welch over pieces of a series.

A piece of a series acts on the state vector as one K x K matrix, so the forward vector before it
and the backward vector after it come from the matrices of the other pieces. With both, a task
has all it needs for the expected counts of its own rows, and these add up over pieces. A round
is two passes over the packed observations; only matrices and sums move. Several starts are
fitted side by side and the likeliest is taken.

Starts are k-means++ centres (Arthur and Vassilvitskii, 2007): each next centre is drawn with a
weight of its squared distance to the nearest one, here as the row with the largest ln(u) / w,
u being uniform noise (Efraimidis and Spirakis, 2006), so a draw is one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scan import BLOCK, Cuts, order_cuts, with_block
from tapeworks.operators.regime import COVAR_FLOOR, DIMS, FLAT, MIN_OBS, MODEL, STATES, Chain, emission
from tapeworks.session import materialize

STARTS, ROUNDS, TOLERANCE = 5, 100, 1e-4
STAY = 0.8
ROWS_PER_PIECE = 4096
_PIECE = "__piece"


# --- pieces -------------------------------------------------------------------------------------

def packed(obs: DataFrame, *, key=("instrument",), time="event_time", uid="event_id", cuts: Cuts | None = None) -> DataFrame:
    """(key..., block, piece, is_first, xs): the rows of a piece in order, as one flat array.

    Written once, so that no round sorts or shuffles rows again.
    """
    key, order = list(key), [time, uid]
    blocked = with_block(obs.select(*key, *order, *DIMS), order, cuts if cuts is not None else order_cuts(obs, order))
    place = F.row_number().over(Window.partitionBy(*key, BLOCK).orderBy(*order)) - 1
    rows = blocked.withColumn(_PIECE, F.floor(place / ROWS_PER_PIECE)).groupBy(*key, BLOCK, _PIECE).agg(
        F.sort_array(F.collect_list(F.struct(*order, *DIMS))).alias("rows"))
    xs = F.flatten(F.transform("rows", lambda r: F.array(*[r[d] for d in DIMS]))).alias("xs")
    pieces = materialize(rows.select(*key, BLOCK, _PIECE, xs), "pieces")
    heads = pieces.groupBy(*key).agg(F.min(F.struct(BLOCK, _PIECE)).alias("__head"))
    first = (F.col(BLOCK) == F.col("__head")[BLOCK]) & (F.col(_PIECE) == F.col("__head")[_PIECE])
    return pieces.join(heads, key).withColumn("is_first", first).drop("__head")


def walk(steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The row vector after each step matrix, scaled to sum 1: rows of about sqrt(n) matrices are
    multiplied side by side, so there are few and wide operations."""
    n, k, _ = steps.shape
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    full = np.concatenate([steps, np.broadcast_to(np.eye(k), (rows * width - n, k, k))]).reshape(rows, width, k, k)
    product = full[:, 0]
    for i in range(1, width):
        product = product @ full[:, i]
        product = product / product.max(axis=(1, 2), keepdims=True)
    before = np.empty((rows, k))
    v = start / start.sum()
    for r in range(rows):
        before[r] = v
        v = v @ product[r]
        v = v / v.sum()
    out = np.empty((rows, width, k))
    for i in range(width):
        before = (before[:, None, :] @ full[:, i])[:, 0]
        before = before / before.sum(axis=1, keepdims=True)
        out[:, i] = before
    return out.reshape(-1, k)[:n]


def product(steps: np.ndarray) -> tuple[np.ndarray, float]:
    """The product of all step matrices, scaled, and the log of the scale."""
    scale = 0.0
    while len(steps) > 1:
        odd = steps[-1:] if len(steps) % 2 else steps[:0]
        steps = steps[0:len(steps) - len(odd):2] @ steps[1::2]
        top = steps.max(axis=(1, 2), keepdims=True)
        scale += float(np.log(top).sum())
        steps = np.concatenate([steps / top, odd])
    return steps[0], scale


def stepped(chain: Chain, x: np.ndarray, first: bool) -> tuple[np.ndarray, float]:
    """The step matrices of the rows, densities scaled to a largest of 1, and the log of that scale."""
    log_b = emission((x - chain.center) / chain.scale, chain.mu, chain.cov)
    top = log_b.max(axis=1, keepdims=True)
    b = np.exp(log_b - top)
    m = chain.trans[None] * b[:, None, :]
    if first:
        m[0] = chain.pi * b[0]
    return m, float(top.sum())


# --- passes -------------------------------------------------------------------------------------

def _kinds(df: DataFrame, cols: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{c} {types[c]}" for c in cols)


def _rows(batch: pa.RecordBatch, cols: list[str]) -> Iterator[tuple[dict, np.ndarray]]:
    """Each row's small columns as a dict, and its piece straight from Arrow's buffer."""
    xs = batch.column("xs")
    for i, row in enumerate(batch.select(cols).to_pylist()):
        yield row, xs[i].values.to_numpy(zero_copy_only=False).reshape(-1, len(DIMS))


def _maps(pieces: DataFrame, models: DataFrame, key: list[str], ids: list[str]) -> DataFrame:
    """Per piece and model: the product of its step matrices and the log of what was scaled away."""
    joined = pieces.join(models, key)
    by = [*ids, BLOCK, _PIECE]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found, scales = [], []
            for row, x in _rows(batch, [*MODEL, "is_first"]):
                steps, emitted = stepped(Chain(row), x, row["is_first"])
                m, scale = product(steps)
                found.append(m.ravel().tolist())
                scales.append(scale + emitted)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], pa.array(found, pa.list_(pa.float64())), pa.array(scales, pa.float64())], [*by, "m", "s"])

    return joined.select(*by, *MODEL, "xs", "is_first").mapInArrow(run, _kinds(joined, by) + ", m array<double>, s double")


def _borders(maps: DataFrame, ids: list[str]) -> DataFrame:
    """The vectors before and after every piece, and the series' log-likelihood, from one small
    matrix per piece."""
    by = [*ids, BLOCK, _PIECE]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([BLOCK, _PIECE])
        k = int(round(len(pdf["m"].iloc[0]) ** 0.5))
        m = np.stack(pdf["m"].to_list()).reshape(-1, k, k)
        v, total, starts = np.full(k, 1 / k), float(pdf["s"].sum()), []
        for one in m:
            starts.append(v.tolist())
            v = v @ one
            total += np.log(v.sum())
            v = v / v.sum()
        w, ends = np.ones(k) / k, []
        for one in m[::-1]:
            ends.append(w.tolist())
            w = one @ w
            w = w / w.sum()
        return pdf[by].assign(start_v=starts, end_v=ends[::-1], loglik=total)

    return maps.groupBy(*ids).applyInPandas(chain, _kinds(maps, by) + ", start_v array<double>, end_v array<double>, loglik double")


def expected(chain: Chain, x: np.ndarray, first: bool, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Flat expected counts of a piece: rows, sums and products of each state, transitions, first state."""
    steps, _ = stepped(chain, x, first)
    fore = walk(steps, before)
    back = np.concatenate([walk(steps[:0:-1].transpose(0, 2, 1), after)[::-1], (after / after.sum())[None]]) if len(x) > 1 else (after / after.sum())[None]
    g = fore * back
    g /= g.sum(axis=1, keepdims=True)
    pairs = np.concatenate([before[None] / before.sum(), fore[:-1]])[:, :, None] * steps
    pairs *= back[:, None, :]
    pairs = pairs.reshape(len(x), -1)
    pairs /= pairs.sum(axis=1, keepdims=True)
    z = (x - chain.center) / chain.scale
    squares = (z[:, :, None] * z[:, None, :]).reshape(len(x), -1)
    return np.concatenate([
        g.sum(0), (g.T @ z).ravel(), (g.T @ squares).ravel(),
        pairs[1 if first else 0:].sum(0), g[0] if first else np.zeros(g.shape[1])])


def _counted(pieces: DataFrame, models: DataFrame, borders: DataFrame, key: list[str], ids: list[str], states: int) -> DataFrame:
    """Per model: the expected counts of its series, added up in Spark, and the log-likelihood."""
    ready = pieces.join(models.select(*ids, *MODEL), key).join(borders, [*ids, BLOCK, _PIECE])
    size = states * (2 + len(DIMS) + len(DIMS) ** 2 + states)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sums = []
            for row, x in _rows(batch, [*MODEL, "is_first", "start_v", "end_v"]):
                sums.append(expected(Chain(row), x, row["is_first"], np.array(row["start_v"]), np.array(row["end_v"])).tolist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ids], batch.column("loglik"), pa.array(sums, pa.list_(pa.float64()))], [*ids, "ll", "e"])

    per_piece = ready.select(*ids, "loglik", *MODEL, "xs", "is_first", "start_v", "end_v").mapInArrow(run, _kinds(ready, ids) + ", ll double, e array<double>")
    return per_piece.groupBy(*ids).agg(F.max("ll").alias("ll"), F.array(*[F.sum(F.col("e")[i]) for i in range(size)]).alias("e"))


def _improved(row: dict, counts: np.ndarray) -> dict:
    """The model of largest expected likelihood, covariances with no eigenvalue below the floor."""
    k, d = len(row["pi"]), len(DIMS)
    n, s, q, t, g0 = np.split(counts, np.cumsum([k, k * d, k * d * d, k * k]))
    s, q, t = s.reshape(k, d), q.reshape(k, d, d), t.reshape(k, k)
    means, covs = np.array(row["means"]).reshape(k, d), np.array(row["covars"]).reshape(k, d, d)
    for i in range(k):
        if n[i] > 1e-8:  # a state that no row is in keeps its Gaussian
            means[i] = s[i] / n[i]
            size, way = np.linalg.eigh(q[i] / n[i] - np.outer(means[i], means[i]))
            covs[i] = (way * np.maximum(size, COVAR_FLOOR)) @ way.T
    out = t.sum(axis=1, keepdims=True)
    trans = np.where(out > 1e-12, t / np.where(out > 1e-12, out, 1.0), np.array(row["trans"]).reshape(k, k))
    return {"pi": (g0 / g0.sum()).tolist(), "trans": trans.ravel().tolist(), "means": means.ravel().tolist(), "covars": covs.ravel().tolist()}


def one_round(pieces: DataFrame, models: DataFrame, key: list[str], states: int, tolerance: float = 0.0) -> DataFrame:
    """The models after one more round; `history` gains the log-likelihood the models had before
    it. A model whose last gain was below tolerance is done."""
    ids = [*key, "start"]
    active = models.where(~F.col("done"))
    borders = _borders(_maps(pieces, active, key, ids), ids)
    counted = active.join(_counted(pieces, active, borders, key, ids, states), ids)
    names, kinds = models.columns, _kinds(models, models.columns)

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            rows = []
            for row in pdf.to_dict("records"):
                history = [*row["history"], row.pop("ll")]
                done = len(history) > 1 and history[-1] - history[-2] < tolerance
                counts = np.array(row.pop("e"))
                rows.append({**row, **({} if done else _improved(row, counts)), "history": history, "done": done})
            yield pd.DataFrame(rows, columns=names)

    return counted.mapInPandas(run, kinds).unionByName(models.where("done"))


# --- starts -------------------------------------------------------------------------------------

def hashed_noise(uid: str = "event_id") -> Callable[[int, int], Column]:
    """Uniform noise in (0, 1) for a start and a draw, from the row's id alone."""
    return lambda start, draw: (F.shiftrightunsigned(F.xxhash64(F.col(uid), F.lit(start), F.lit(draw)), 11) + 0.5) / float(1 << 53)


def starts(obs: DataFrame, n: int = STARTS, *, states: int = STATES, key=("instrument",), uid: str = "event_id", min_obs: int = MIN_OBS,
           noise: Callable[[int, int], Column] | None = None) -> DataFrame:
    """n models per key to begin with: k-means++ centres on the scaled rows, the covariance of all
    rows in every state, equal first states, and transitions that stay with 0.8.

    Keys with fewer than min_obs rows have none. A draw is one pass with an aggregate per start.
    """
    key, noise, ks = list(key), noise or hashed_noise(uid), range(states)
    flat = lambda c: F.when(c < FLAT, 1.0).otherwise(c)
    stats = obs.groupBy(*key).agg(
        F.count("*").alias("n_obs"), F.array(*[F.avg(d) for d in DIMS]).alias("center"), F.array(*[flat(F.stddev_pop(d)) for d in DIMS]).alias("scale"),
        F.array(*[F.covar_pop(a, b) for a in DIMS for b in DIMS]).alias("cov")).where(F.col("n_obs") >= min_obs)
    stats = materialize(stats, "em-stats")  # a row per key, of a size Spark knows
    scaled = obs.select(*key, uid, *DIMS).join(stats.select(*key, "center", "scale"), key)
    z = F.array(*[(F.col(d) - F.col("center")[i]) / F.col("scale")[i] for i, d in enumerate(DIMS)])
    scaled = scaled.select(*key, uid, z.alias("z"))
    chosen = stats.select(*key, *[F.array().cast("array<array<double>>").alias(f"c{s}") for s in range(n)])
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    for draw in ks:
        rows = scaled.join(chosen, key)
        picks = []
        for s in range(n):
            # without equal points left to avoid, weights are all zero: then the noise alone decides
            w = F.array_min(F.transform(F.col(f"c{s}"), lambda c: far(F.col("z"), c))) if draw else F.lit(1.0)
            u = noise(s, draw)
            picks.append(F.max_by("z", F.struct((w > 0).alias("apart"), F.when(w > 0, F.ln(u) / w).otherwise(u).alias("race"), F.col(uid).alias("uid"))).alias(f"p{s}"))
        found = rows.groupBy(*key).agg(*picks)
        grown = [F.concat(f"c{s}", F.array(f"p{s}")).alias(f"c{s}") for s in range(n)]
        chosen = materialize(chosen.join(found, key).select(*key, *grown), "em-centres")
    one = stats.join(chosen, key).select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("start"), F.flatten(f"c{s}").alias("means")) for s in range(n)])).alias("p"))
    cov = F.array(*[F.col("cov")[len(DIMS) * i + j] / F.col("scale")[i] / F.col("scale")[j] + (COVAR_FLOOR if i == j else 0.0)
                    for _ in ks for i in range(len(DIMS)) for j in range(len(DIMS))])
    trans = F.array(*[F.lit(STAY if i == j else (1 - STAY) / (states - 1)) if states > 1 else F.lit(1.0) for i in ks for j in ks])
    return one.select(
        *key, F.col("p.start").alias("start"), F.col("n_obs").cast("long").alias("n_obs"), F.array(*[F.lit(1.0 / states) for _ in ks]).alias("pi"), trans.alias("trans"),
        F.col("p.means").alias("means"), cov.alias("covars"), "center", "scale",
        F.array().cast("array<double>").alias("history"), F.lit(False).alias("done"))


# --- fitting and scoring ------------------------------------------------------------------------

def refine(pieces: DataFrame, models: DataFrame, *, key=("instrument",), rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Baum-Welch from the given models until each gains less than tolerance, or for `rounds`."""
    first = models.select(F.size("pi").alias("k")).first()
    if first is None:
        return models
    for _ in range(rounds):
        models = materialize(one_round(pieces, models, list(key), first["k"], tolerance), "em-models")
        if models.where("not done").isEmpty():
            break
    return models


def scores(pieces: DataFrame, models: DataFrame, *, key=("instrument",)) -> DataFrame:
    """(model ids..., loglik): the log-likelihood of each series under its models."""
    key = list(key)
    ids = [*key, *[c for c in ("start",) if c in models.columns]]
    ends = _borders(_maps(pieces, models.select(*ids, *MODEL), key, ids), ids)
    return ends.groupBy(*ids).agg(F.max("loglik").alias("loglik"))


def score(obs: DataFrame, models: DataFrame, *, key=("instrument",), time="event_time", uid="event_id", cuts: Cuts | None = None) -> DataFrame:
    """(key..., loglik): the exact log-likelihood of every series that has a model."""
    return scores(packed(obs, key=key, time=time, uid=uid, cuts=cuts), models, key=key)


def fit_hmm(obs: DataFrame, *, n_starts: int = STARTS, rounds: int = ROUNDS, tolerance: float = TOLERANCE, states: int = STATES,
            key=("instrument",), time="event_time", uid="event_id", min_obs: int = MIN_OBS, noise=None, cuts: Cuts | None = None) -> DataFrame:
    """The likeliest of n_starts models per key: key, start, n_obs, the model, history, loglik.

    Any grouping will do as key; a constant column pools all rows. Keys with fewer than min_obs
    rows have no model. Its columns are those `regime` filters, smooths and decodes with.
    """
    key = list(key)
    first = materialize(starts(obs, n_starts, states=states, key=key, uid=uid, min_obs=min_obs, noise=noise), "em-models")
    pieces = materialize(packed(obs, key=key, time=time, uid=uid, cuts=cuts), "em-pieces")
    fitted = refine(pieces, first, key=key, rounds=rounds, tolerance=tolerance)
    ranked = fitted.join(scores(pieces, fitted, key=key), [*key, "start"])
    best = Window.partitionBy(*key).orderBy(F.desc("loglik"), "start")
    return ranked.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "done")
