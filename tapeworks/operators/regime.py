"""Hidden-Markov market regimes: models from labelled states, filtering, decoding, labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.functions.numeric import finite
from tapeworks.functions.scan import BLOCK, Cuts, order_cuts, running, spread, with_block
from tapeworks.operators.store import training_window
from tapeworks.session import materialize

STATES, MIN_OBS, COVAR_FLOOR = 3, 200, 1e-3
REFIT = 50
DIMS = ["x0", "x1", "x2"]
ROWS_PER_CHAIN = 100_000
FLAT = 1e-9
# borders of the volatility states, in deviations from the mean
STATE_BORDERS = (-0.5, 0.5)


def observations(features: DataFrame, *, time="event_time", uid="event_id") -> DataFrame:
    """Finite [momentum, volatility, |imbalance|] vectors; anything else is rejected."""
    cols = [finite(F.col("momentum")), finite(F.col("volatility")), F.abs(finite(F.col("obi")))]
    o = features.select("instrument", time, uid, *[c.alias(d) for c, d in zip(cols, DIMS)])
    return o.where(F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("x2").isNotNull())


def newest(obs: DataFrame, n: int | None = None, *, key=("instrument",), time="event_time", uid="event_id") -> DataFrame:
    """The newest n observations per key; all of them unless the caller names a window."""
    if n is None:
        return obs
    r = running(obs, {"age": ("count", F.lit(1))}, key=list(key), order=[time, uid], descending=True)
    return r.where(F.col("age") <= n)


def window_zscore(obs: DataFrame, *, n: int | None = None, time="event_time", uid="event_id") -> DataFrame:
    """Observations scaled by the window's own mean and deviation (1 when it is flat)."""
    w = newest(obs, n, time=time, uid=uid)
    stats = w.groupBy("instrument").agg(
        *[F.avg(d).alias(f"m_{d}") for d in DIMS], *[F.stddev_pop(d).alias(f"s_{d}") for d in DIMS])
    scale = lambda d: F.when(F.col(f"s_{d}") < FLAT, 1.0).otherwise(F.col(f"s_{d}"))
    return w.join(stats, "instrument").select(
        "instrument", time, uid, *[((F.col(d) - F.col(f"m_{d}")) / scale(d)).alias(d) for d in DIMS])


# --- models -----------------------------------------------------------------------------------

def volatility_states(obs: DataFrame, *, dim: str = "x1", borders=STATE_BORDERS) -> DataFrame:
    """Add `state`: how many borders, in deviations from the instrument's mean, the row exceeds."""
    s = obs.groupBy("instrument").agg(F.avg(dim).alias("__m"), F.stddev_pop(dim).alias("__s"))
    z = (F.col(dim) - F.col("__m")) / F.when(F.col("__s") < FLAT, 1.0).otherwise(F.col("__s"))
    state = sum((F.when(z > b, 1).otherwise(0) for b in borders), F.lit(0))
    return obs.join(s, "instrument").withColumn("state", state).drop("__m", "__s")


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(DIMS)) for j in range(i, len(DIMS))]


def state_sums(labelled: DataFrame, *, key=("instrument",), states: int = STATES, time="event_time", uid="event_id") -> DataFrame:
    """Per key: rows, sums and products of each state, and transitions between states.

    One aggregate after a scan for the previous state. The sums add up over keys, so models of
    longer or shorter spans need no second pass over the rows.
    """
    key = list(key)
    before = running(labelled, {"__s0": ("lag", F.col("state"))}, key=["instrument"], order=[time, uid])
    here = lambda k, x: F.sum(F.when(F.col("state") == k, x).otherwise(0.0))
    aggs = []
    for k in range(states):
        aggs.append(F.count_if(F.col("state") == k).alias(f"n{k}"))
        aggs += [here(k, F.col(d)).alias(f"s{k}_{i}") for i, d in enumerate(DIMS)]
        aggs += [here(k, F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q{k}_{i}{j}") for i, j in _pairs()]
        aggs += [F.count_if((F.col("__s0") == j) & (F.col("state") == k)).alias(f"t{j}{k}") for j in range(states)]
    return before.groupBy(*key).agg(*aggs)


def models_from(sums: DataFrame, *, key=("instrument",), states: int = STATES, min_obs: int = MIN_OBS) -> DataFrame:
    """Maximum-likelihood chain of the labelled states, on scaled observations.

    Transitions and state shares get one pseudo-count each; covariances a floor on the
    diagonal; a state with fewer than two rows is a unit Gaussian in the middle. The scaler
    (`center`, `scale`) is part of the model. Keys with fewer than min_obs rows have none.
    """
    c, ks, d = F.col, range(states), len(DIMS)
    total = lambda name: sum((c(f"{name.format(k=k)}") for k in ks), F.lit(0.0))
    m = sums.withColumn("n_obs", sum((c(f"n{k}") for k in ks), F.lit(0))).where(c("n_obs") >= min_obs)
    m = m.withColumns({f"c{i}": total(f"s{{k}}_{i}") / c("n_obs") for i in range(d)})
    var = lambda i: F.greatest(total(f"q{{k}}_{i}{i}") / c("n_obs") - c(f"c{i}") * c(f"c{i}"), F.lit(0.0))
    m = m.withColumns({f"w{i}": F.when(F.sqrt(var(i)) < FLAT, 1.0).otherwise(F.sqrt(var(i))) for i in range(d)})

    def mean(k, i):
        return F.when(c(f"n{k}") >= 2, (c(f"s{k}_{i}") / c(f"n{k}") - c(f"c{i}")) / c(f"w{i}")).otherwise(0.0)

    def cov(k, i, j):
        i, j = min(i, j), max(i, j)
        raw = c(f"q{k}_{i}{j}") / c(f"n{k}") - c(f"s{k}_{i}") / c(f"n{k}") * c(f"s{k}_{j}") / c(f"n{k}")
        return F.when(c(f"n{k}") >= 2, raw / c(f"w{i}") / c(f"w{j}")).otherwise(float(i == j)) + (COVAR_FLOOR if i == j else 0.0)

    out = [sum((c(f"t{j}{k}") for k in ks), F.lit(0)) for j in ks]
    return m.select(
        *key, c("n_obs").cast("long").alias("n_obs"),
        F.array(*[(c(f"n{k}") + 1) / (c("n_obs") + states) for k in ks]).alias("pi"),
        F.array(*[(c(f"t{j}{k}") + 1) / (out[j] + states) for j in ks for k in ks]).alias("trans"),
        F.array(*[mean(k, i) for k in ks for i in range(d)]).alias("means"),
        F.array(*[cov(k, i, j) for k in ks for i in range(d) for j in range(d)]).alias("covars"),
        F.array(*[c(f"c{i}") for i in range(d)]).alias("center"), F.array(*[c(f"w{i}") for i in range(d)]).alias("scale"),
    )


def fit_states(obs: DataFrame, **params) -> DataFrame:
    """A model per instrument from its volatility states."""
    return models_from(state_sums(volatility_states(obs)), **params)


def warm_start(store: DataFrame, as_of, **params) -> DataFrame:
    """Models from what the store knew at `as_of`, before a stream starts."""
    return fit_states(observations(training_window(store, as_of)), **params)


def epochs(obs: DataFrame, *, first: int = MIN_OBS, every: int = REFIT, key=("instrument",), time="event_time", uid="event_id", cuts: Cuts | None = None) -> DataFrame:
    """Add `n`, the row's number in its key, and `epoch`: 0 for the first `first` rows, then one
    more with every `every` rows, as models are renewed."""
    numbered = running(obs, {"n": ("count", F.lit(1))}, key=list(key), order=[time, uid], cuts=cuts)
    later = (F.floor((F.col("n") - first - 1) / every) + 1).cast("long")
    return numbered.withColumn("epoch", F.when(F.col("n") <= first, 0).otherwise(later))


def _before(sums: DataFrame, names: list[str]) -> DataFrame:
    """Per epoch the sums of all earlier epochs of the instrument (0 where there are none)."""
    past = running(sums, {f"__b_{c}": ("sum", F.col(c), "before") for c in names}, key=["instrument"], order=["epoch"])
    return past.select("instrument", "epoch", *[F.coalesce(f"__b_{c}", F.lit(0)).alias(c) for c in names])


def states_so_far(numbered: DataFrame, *, dim: str = "x1", borders=STATE_BORDERS) -> DataFrame:
    """Add `state` as `volatility_states` does, by mean and deviation of earlier epochs alone; the
    first epoch, which no model scores, by its own."""
    x = F.col(dim)
    own = numbered.groupBy("instrument", "epoch").agg(F.count("*").alias("c"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    own = materialize(own, "epoch-sums")
    bands = _before(own, ["c", "s", "q"]).where("epoch > 0").unionByName(own.where("epoch = 0"))
    mean = F.col("s") / F.col("c")
    width = F.sqrt(F.greatest(F.col("q") / F.col("c") - mean * mean, F.lit(0.0)))
    bands = bands.select("instrument", "epoch", mean.alias("__m"), F.when(width < FLAT, 1.0).otherwise(width).alias("__w"))
    z = (x - F.col("__m")) / F.col("__w")
    state = sum((F.when(z > b, 1).otherwise(0) for b in borders), F.lit(0))
    return numbered.join(bands, ["instrument", "epoch"]).withColumn("state", state).drop("__m", "__w")


def refits(numbered: DataFrame, *, time="event_time", uid="event_id", **params) -> DataFrame:
    """A model per instrument and epoch, from the rows of all earlier epochs.

    Labels of a row use earlier rows only, so they never change, and the sums of epochs add up:
    every refit is a prefix of one scan, and no row is read again for a later model.
    """
    key = ["instrument", "epoch"]
    sums = materialize(state_sums(states_so_far(numbered), key=key, time=time, uid=uid), "epoch-state-sums")
    return models_from(_before(sums, [c for c in sums.columns if c not in key]), key=key, **params)


def regime_history(obs: DataFrame, *, min_obs: int = MIN_OBS, refit: int = REFIT, time="event_time", uid="event_id", cuts: Cuts | None = None) -> DataFrame:
    """Every row filtered by the model that was current when it came: fitted after min_obs rows of
    its instrument, and again after every `refit` more, on all rows before.

    Nothing about a row depends on later ones. The chain goes on through a refit (states are
    bands of volatility, so they keep their meaning). The first min_obs rows have no state.
    """
    order = [time, uid]
    cuts = cuts if cuts is not None else order_cuts(obs, order, rows_per_block=ROWS_PER_CHAIN)
    numbered = materialize(with_block(epochs(obs, first=min_obs, every=refit, time=time, uid=uid, cuts=cuts), order, cuts), "epochs")
    models = materialize(refits(numbered.drop(BLOCK), time=time, uid=uid, min_obs=min_obs), "refits")
    by = ["instrument", BLOCK]
    # the models of a block's epochs, next to its rows
    here = numbered.select(*by, "epoch").distinct().join(models.select("instrument", "epoch", *MODEL), ["instrument", "epoch"])
    here = materialize(here.select(*by, "epoch", *MODEL), "block-refits")
    types = dict(numbered.dtypes)
    kinds = ", ".join(f"{c} {types[c]}" for c in by)

    def modelled(rows: pd.DataFrame, par: pd.DataFrame):
        rows = rows.sort_values(order).reset_index(drop=True)
        own = rows[rows["epoch"] > 0]
        if own.empty or par.empty:
            return rows, own, None
        chain = Refitted(par)
        return rows, own, chain.steps(own[DIMS].to_numpy(float), own["epoch"].to_numpy(), int(own["n"].iloc[0]) == min_obs + 1)

    def summarize(rows: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in [*by, "m"]})
        _, _, steps = modelled(rows, par)
        m = np.eye(STATES) if steps is None else prefixes(steps)[-1]
        return pd.DataFrame([{**{c: rows[c].iloc[0] for c in by}, "m": m.ravel().tolist()}])

    def replay(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        # the second frame holds the block's models and, in each row, the vector before the block
        rows, own, steps = modelled(rows, start)
        out = rows[["instrument", time, uid, "epoch"]].assign(probs=None, state=None)
        if steps is not None:
            p = np.einsum("i,tij->tj", np.asarray(start["start"].iloc[0], float), prefixes(steps))
            p = p / p.sum(axis=1, keepdims=True)
            out.loc[own.index, "probs"] = pd.Series(p.tolist(), index=own.index)
            out.loc[own.index, "state"] = p.argmax(axis=1)
        return out.assign(state=out["state"].astype("Int32"))

    sides = lambda right: spread(numbered, *by).groupBy(*by).cogroup(spread(right, *by).groupBy(*by))
    ends = _ends(sides(here).applyInPandas(summarize, f"{kinds}, m array<double>"), ["instrument"], False)
    ready = here.join(ends.select(*[F.col(c).alias(c) for c in (*by, "start")]), by)
    columns = ", ".join(f"{c} {types[c]}" for c in ("instrument", time, uid, "epoch"))
    return sides(ready).applyInPandas(replay, f"{columns}, probs array<double>, state int")


# --- chains -----------------------------------------------------------------------------------

def emission(x: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log density of every row under every state's Gaussian."""
    inv, (_, logdet) = np.linalg.inv(cov), np.linalg.slogdet(cov)
    d = x[None] - mu[:, None]
    return -0.5 * (((d @ inv) * d).sum(axis=2).T + logdet + x.shape[1] * np.log(2 * np.pi))


def _sum_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = a @ b
    return m / m.max(axis=(1, 2), keepdims=True)


def _best_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = (a[:, :, :, None] + b[:, None, :, :]).max(axis=2)
    return m - m.max(axis=(1, 2), keepdims=True)


@dataclass(frozen=True)
class Algebra:
    """How stacks of step matrices are multiplied (and scaled), and the unit's entries.

    SUM adds the weights of all paths; in BEST a path's weight is a sum of logs and the best
    path counts.
    """

    times: Callable[[np.ndarray, np.ndarray], np.ndarray]
    one: float
    zero: float


SUM = Algebra(_sum_times, 1.0, 0.0)
BEST = Algebra(_best_times, 0.0, -np.inf)


def prefixes(steps: np.ndarray, algebra: Algebra = SUM, flipped: bool = False) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, by doubling: log2(n) vectorized rounds."""
    times = (lambda a, b: algebra.times(b, a)) if flipped else algebra.times
    out, gap = steps, 1
    while gap < len(out):
        out = np.concatenate([out[:gap], times(out[:-gap], out[gap:])])
        gap *= 2
    return out


def suffixes(steps: np.ndarray, algebra: Algebra = SUM) -> np.ndarray:
    """Products of the matrices after each place (the unit at the last)."""
    unit = np.where(np.eye(steps.shape[1]) > 0, algebra.one, algebra.zero)[None]
    return np.concatenate([prefixes(steps[:0:-1], algebra, True)[::-1], unit]) if len(steps) > 1 else unit


class Chain:
    """A model row in arrays; step matrices of a stretch of observations."""

    def __init__(self, row):
        self.pi = np.asarray(row["pi"], float)
        k, d = len(self.pi), len(DIMS)
        self.trans = np.asarray(row["trans"], float).reshape(k, k)
        self.mu = np.asarray(row["means"], float).reshape(k, d)
        self.cov = np.asarray(row["covars"], float).reshape(k, d, d)
        self.center, self.scale = np.asarray(row["center"], float), np.asarray(row["scale"], float)

    def steps(self, x: np.ndarray, first: bool, best: bool = False) -> np.ndarray:
        """Row t as a matrix from the state before it to its own; the first row of all starts from pi."""
        log_b = emission((x - self.center) / self.scale, self.mu, self.cov)
        log_b -= log_b.max(axis=1, keepdims=True)
        if best:
            with np.errstate(divide="ignore"):
                m = np.log(self.trans)[None] + log_b[:, None, :]
                if first:
                    m[0] = np.log(self.pi) + log_b[0]
            return m
        b = np.exp(log_b)
        m = self.trans[None] * b[:, None, :]
        if first:
            m[0] = self.pi * b[0]
        return m

    def forward(self, x: np.ndarray, start: np.ndarray | None) -> np.ndarray:
        """Normalized forward probabilities; start is the vector before the first row, or None."""
        k = len(self.pi)
        v = np.full(k, 1 / k) if start is None else np.asarray(start, float)
        p = np.einsum("i,tij->tj", v, prefixes(self.steps(x, start is None)))
        return p / p.sum(axis=1, keepdims=True)


class Refitted:
    """The models of several epochs side by side; each row is stepped by that of its epoch."""

    def __init__(self, par: pd.DataFrame):
        par = par.sort_values("epoch")
        k, d = len(par["pi"].iloc[0]), len(DIMS)
        stack = lambda c, *shape: np.stack(par[c].to_list()).astype(float).reshape(-1, *shape)
        self.epochs = par["epoch"].to_numpy()
        self.pi, self.trans, self.mu, cov = stack("pi", k), stack("trans", k, k), stack("means", k, d), stack("covars", k, d, d)
        self.center, self.scale = stack("center", d), stack("scale", d)
        self.inv, self.logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def steps(self, x: np.ndarray, epoch: np.ndarray, first: bool) -> np.ndarray:
        e = np.searchsorted(self.epochs, epoch)
        off = ((x - self.center[e]) / self.scale[e])[:, None, :] - self.mu[e]
        log_b = -0.5 * (np.einsum("tki,tkij,tkj->tk", off, self.inv[e], off) + self.logdet[e])
        b = np.exp(log_b - log_b.max(axis=1, keepdims=True))
        m = self.trans[e] * b[:, None, :]
        if first:
            m[0] = self.pi[e[0]] * b[0]
        return m


MODEL = ["pi", "trans", "means", "covars", "center", "scale"]


def _blocks(obs, models, key, order, cuts):
    """Blocks of each key's sequence, and one row per block with its key's model."""
    blocked = with_block(obs, order, cuts)
    heads = blocked.groupBy(*key, BLOCK).agg(F.count("*").alias("rows")).withColumn(
        "is_first", F.col(BLOCK) == F.min(BLOCK).over(Window.partitionBy(*key)))
    params = heads.join(models.select(*key, *MODEL), key)
    # fresh column identities: both sides of the later cogroup descend from `obs`
    return blocked, params.select(*[F.col(c).alias(c) for c in params.columns])


def _block_maps(blocked, params, key, order, best: bool) -> DataFrame:
    """The product of the step matrices of every block."""
    by = [*key, BLOCK]

    def summarize(rows: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or par.empty:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in [*by, "m"]})
        p = par.iloc[0]
        x = rows.sort_values(order)[DIMS].to_numpy(float)
        m = prefixes(Chain(p).steps(x, p["is_first"], best), BEST if best else SUM)[-1]
        return pd.DataFrame([{**{c: p[c] for c in by}, "m": m.ravel().tolist()}])

    types = dict(blocked.dtypes)
    kinds = ", ".join(f"{c} {types[c]}" for c in by)
    return spread(blocked, *by).groupBy(*by).cogroup(spread(params, *by).groupBy(*by)).applyInPandas(summarize, f"{kinds}, m array<double>")


def _ends(maps: DataFrame, key, best: bool) -> DataFrame:
    """The vectors before and after every block: one small matrix per block is multiplied along."""
    algebra = BEST if best else SUM

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        k = int(round(len(pdf["m"].iloc[0]) ** 0.5))
        m = np.stack([np.asarray(x, float).reshape(k, k) for x in pdf["m"]])
        fore, aft = prefixes(m, algebra), suffixes(m, algebra)
        unit = np.zeros(k) if best else np.full(k, 1 / k)
        if best:
            starts = [unit, *[f.max(axis=0) for f in fore[:-1]]]
            ends = [a.max(axis=1) for a in aft]
        else:
            starts = [unit, *[(f / f.sum()).sum(axis=0) for f in fore[:-1]]]
            ends = [a.sum(axis=1) for a in aft]
        out = pdf[[*key, BLOCK]].copy()
        out["start"], out["end"] = [s.tolist() for s in starts], [e.tolist() for e in ends]
        return out

    types = dict(maps.dtypes)
    kinds = ", ".join(f"{c} {types[c]}" for c in [*key, BLOCK])
    return maps.groupBy(*key).applyInPandas(chain, f"{kinds}, start array<double>, end array<double>")


def _along_chains(obs, models, key, time, uid, cuts, best, fold, columns, names):
    """fold(chain, observations, start, end, is_first) over every block, next to all other rows."""
    key, order = list(key), [time, uid]
    cuts = cuts if cuts is not None else order_cuts(obs, order, rows_per_block=ROWS_PER_CHAIN)
    blocked, params = _blocks(obs, models, key, order, cuts)
    by = [*key, BLOCK]
    ready = params.join(_ends(_block_maps(blocked, params, key, order, best), key, best), by)
    ready = ready.select(*[F.col(c).alias(c) for c in ready.columns])
    types = dict(obs.dtypes)
    keep = [*key, time, uid]

    def replay(rows: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        out = rows[keep].reset_index(drop=True)
        if rows.empty or par.empty:  # no model: the rows stay, without a state
            return out.assign(**{c: pd.Series([None] * len(out), dtype="object") for c in names})
        p = par.iloc[0]
        return out.assign(**fold(Chain(p), rows[DIMS].to_numpy(float), np.asarray(p["start"], float), np.asarray(p["end"], float), p["is_first"]))

    kinds = ", ".join(f"{c} {types[c]}" for c in keep)
    return spread(blocked, *by).groupBy(*by).cogroup(spread(ready, *by).groupBy(*by)).applyInPandas(replay, f"{kinds}, {columns}")


def causal_filter(obs: DataFrame, models: DataFrame, *, key=("instrument",), time="event_time", uid="event_id",
                  cuts: Cuts | None = None) -> DataFrame:
    """State probabilities of every row from its past only, over sequences of any length.

    A stretch of the chain acts on the state vector as one K x K matrix. Each block's matrix
    is computed in its own task, the few matrices of a key are multiplied in order, and each
    block is then replayed from its true starting vector. Keys without a model keep their rows.
    """
    def fold(chain, x, start, end, first):
        probs = chain.forward(x, None if first else start)
        return {"probs": probs.tolist(), "state": probs.argmax(axis=1).astype("int32")}

    return _along_chains(obs, models, key, time, uid, cuts, False, fold, "probs array<double>, state int", ["probs", "state"])


def decode(obs: DataFrame, models: DataFrame, *, key=("instrument",), time="event_time", uid="event_id", cuts: Cuts | None = None) -> DataFrame:
    """The most likely path over the whole sequence: the state at each row through which the
    best path of all runs, from the best scores up to it and onward from it."""
    def fold(chain, x, start, end, first):
        steps = chain.steps(x, first, True)
        up = (start[None, :, None] + prefixes(steps, BEST)).max(axis=1)
        on = (suffixes(steps, BEST) + end[None, None, :]).max(axis=2)
        return {"path": (up + on).argmax(axis=1).astype("int32")}

    return _along_chains(obs, models, key, time, uid, cuts, True, fold, "path int", ["path"])


def smooth(obs: DataFrame, models: DataFrame, *, key=("instrument",), time="event_time", uid="event_id", cuts: Cuts | None = None) -> DataFrame:
    """State probabilities of every row from the whole sequence."""
    def fold(chain, x, start, end, first):
        steps = chain.steps(x, first)
        g = np.einsum("i,tij->tj", start, prefixes(steps)) * np.einsum("tij,j->ti", suffixes(steps), end)
        return {"smoothed": (g / g.sum(axis=1, keepdims=True)).tolist()}

    return _along_chains(obs, models, key, time, uid, cuts, False, fold, "smoothed array<double>", ["smoothed"])


# --- parameters -------------------------------------------------------------------------------

@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _stationary(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for flat in batches:
        if not len(flat):
            yield pd.Series([], dtype="object")
            continue
        k = int(round(len(flat.iloc[0]) ** 0.5))
        a = np.stack(flat.to_list()).astype(float).reshape(-1, k, k)
        lhs = np.concatenate([a.transpose(0, 2, 1) - np.eye(k), np.ones((len(a), 1, k))], axis=1)
        v = np.abs(np.linalg.pinv(lhs) @ np.append(np.zeros(k), 1.0))
        v = v / v.sum(axis=1, keepdims=True)
        yield pd.Series(np.where(np.isfinite(v), v, 1 / k).tolist())


def stationary_distribution(trans: Column) -> Column:
    """Long-run state shares of a row-major transition matrix."""
    return _stationary(trans)


def state_parameters(models: DataFrame, *, dims: int = len(DIMS)) -> DataFrame:
    """One row per model state: trend and volatility means, mean emission variance."""
    k = F.size("pi")
    s = models.select("instrument", "means", "covars", F.explode(F.sequence(F.lit(0), k - 1)).alias("state"))
    mean = lambda i: F.element_at("means", (F.col("state") * dims + i + 1).cast("int"))
    var = lambda i: F.element_at("covars", (F.col("state") * dims * dims + i * dims + i + 1).cast("int"))
    spread = sum((var(i) for i in range(1, dims)), var(0)) / dims
    return s.select("instrument", "state", mean(0).alias("trend_mean"), mean(1).alias("vol_mean"), spread.alias("dispersion"))


def derive_labels(states: DataFrame, *, key=("instrument",)) -> DataFrame:
    """Label states from fitted parameters alone: calm, turbulent, trending, choppy."""
    key = list(key)
    s = states.withColumns({
        "turbulence": F.col("vol_mean") + F.col("dispersion"), "trend_strength": F.abs("trend_mean")})
    w = Window.partitionBy(*key)
    up = w.orderBy("turbulence", "state")
    s = s.withColumns({"__r": F.row_number().over(up), "__k": F.count("*").over(w)})
    middle = (F.col("__r") > 1) & (F.col("__r") < F.col("__k"))
    # only states between the calmest and the most turbulent compete for the trend
    s = s.withColumn("__lead", F.row_number().over(w.orderBy(
        F.when(middle, 0).otherwise(1), F.desc("trend_strength"), "state")))
    label = (F.when(F.col("__r") == 1, "calm").when(F.col("__r") == F.col("__k"), "turbulent")
             .when(F.col("__lead") == 1, "trending").otherwise("choppy"))
    return s.withColumn("label", label).drop("__r", "__k", "__lead")
