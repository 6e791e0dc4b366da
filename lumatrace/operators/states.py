"""State assignment of whole corpora: kernels run over batches of traces on the executors, joint fits loop over aggregates."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatrace.functions import seq
from lumatrace.operators.kernels import Model, forward_backward_all, segmental_kmeans_all, viterbi_all
from lumatrace.schema import KEYS
from lumatrace.session import settle


def wide(points: DataFrame, channel: str = "fret") -> DataFrame:
    """One row for each trace: keys, x (its frames' values in order)."""
    rows = F.array_sort(F.collect_list(F.struct("frame", F.coalesce(F.col(channel), F.lit(0.0)).alias("v"))))
    return points.groupBy(*KEYS).agg(F.transform(rows, lambda r: r["v"]).alias("x"))


def _blocks(points: DataFrame, channel: str, clip: tuple[float, float] = (-np.inf, np.inf), cells: int = 1_000_000) -> RDD:
    """Traces as lists of arrays of some `cells` frames, packed once, for fits that pass over them many times."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            xs = [np.clip(np.asarray(x, float), *clip) for x in f["x"]]
            part = np.cumsum([len(x) for x in xs]) // cells
            for p in np.unique(part):
                own = [xs[i] for i in np.flatnonzero(part == p)]
                yield pd.DataFrame({"x": [np.concatenate(own).tobytes()], "n": [np.array([len(x) for x in own], np.int64).tobytes()]})

    def views(row) -> list[np.ndarray]:
        return np.split(np.frombuffer(row.x), np.cumsum(np.frombuffer(row.n, np.int64))[:-1])

    return wide(points, channel).mapInPandas(pack, "x binary, n binary").rdd.map(views).persist(StorageLevel.MEMORY_AND_DISK)


def _long(paths: DataFrame) -> DataFrame:
    return paths.select(*KEYS, F.posexplode("states").alias("at", "state")).select(*KEYS, (F.col("at") + 1).alias("frame"), F.col("state").cast("int"))


def _each(fit: Callable[[list[np.ndarray]], list[list]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = fit([np.asarray(x, float) for x in f["x"]])
            yield pd.DataFrame({**{k: f[k] for k in KEYS}, **{n: [o[i] for o in out] for i, n in enumerate(("states", "ll", "mu", "sigma"))}})

    return run


_FIT = "dataset string, trace_id long, states array<int>, ll double, mu array<double>, sigma array<double>"


def assign(points: DataFrame, model: Model, channel: str = "fret") -> DataFrame:
    """Viterbi states of every trace for one model: (keys, frame, state)."""

    def fit(xs: list[np.ndarray]) -> list[list]:
        return [[s.tolist(), ll, model.mu.tolist(), model.sigma.tolist()] for s, ll in viterbi_all(xs, model)]

    return _long(wide(points, channel).mapInPandas(_each(fit), _FIT))


def fit_each(points: DataFrame, model: Model, channel: str = "fret", clip: tuple[float, float] = (-1.0, 10.0)) -> DataFrame:
    """Segmental k-means of every trace by itself: keys, states, ll, mu, sigma."""

    def fit(xs: list[np.ndarray]) -> list[list]:
        return [[s.tolist(), ll, m.mu.tolist(), m.sigma.tolist()] for s, m, ll in segmental_kmeans_all([np.clip(x, *clip) for x in xs], model)]

    return wide(points, channel).mapInPandas(_each(fit), _FIT)


def states_of(fits: DataFrame) -> DataFrame:
    return _long(fits)


def ensemble_model(fits: DataFrame) -> DataFrame:
    """Mean over traces of each class's mean and spread, to four significant figures: (dataset, state, mu, sigma)."""
    one = fits.filter("not isnan(ll)").select("dataset", F.posexplode(F.arrays_zip("mu", "sigma")).alias("at", "m"))
    mean = one.groupBy("dataset", (F.col("at") + 1).alias("state")).agg(F.avg("m.mu").alias("mu"), F.avg("m.sigma").alias("sigma"))
    four = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.format_string("%.3e", F.col(c)).cast("double"))
    return mean.select("dataset", "state", four("mu").alias("mu"), four("sigma").alias("sigma"))


def fit_jointly(points: DataFrame, model: Model, channel: str = "fret", rounds: int = 20, tolerance: float = 1e-4) -> tuple[Model, DataFrame]:
    """Segmental k-means with one model for all traces: each round is one Viterbi pass and one aggregation."""
    base, size = _blocks(points, channel), 2 + len(model.mu) * (len(model.mu) + 4)
    last, k = -np.inf, len(model.mu)
    try:
        for _ in range(rounds):
            m = model

            def stats(blocks: Iterator[list[np.ndarray]], m=m) -> Iterator[np.ndarray]:
                total = np.zeros(size)
                for xs in blocks:
                    for x, (s, ll) in zip(xs, viterbi_all(xs, m), strict=True):
                        n = int((s > 0).sum())
                        if n < 2:
                            continue
                        s, x = s[:n] - 1, x[:n]
                        a = np.zeros((k, k))
                        np.add.at(a, (s[:-1], s[1:]), 1)
                        d = x - m.mu[s]
                        total += np.concatenate([[ll * n, n], np.eye(k)[s[0]], a.ravel(), np.bincount(s, minlength=k), np.bincount(s, d, k), np.bincount(s, d * d, k)])
                yield total

            v = base.mapPartitions(stats).fold(np.zeros(size), np.add)  # a few numbers from each task
            if not v[1]:
                break
            ll = v[0] / v[1]
            p0, a = v[2 : 2 + k] + 0.01, v[2 + k : 2 + k + k * k].reshape(k, k) + 0.01 * np.eye(k)
            n, d1, d2 = v[2 + k + k * k :].reshape(3, k)
            mean = np.divide(d1, n, out=np.zeros(k), where=n > 0)
            var = np.divide(d2 - n * mean**2, n - 1, out=m.sigma**2, where=n > 1)
            model = Model(p0 / p0.sum(), m.mu if m.fix_mu else m.mu + mean, m.sigma if m.fix_sigma else np.maximum(0.01, np.sqrt(np.maximum(var, 0))), a / a.sum(axis=1, keepdims=True), m.fix_mu, m.fix_sigma)
            if abs(ll - last) < tolerance:
                break
            last = ll
        else:
            warnings.warn(f"segmental k-means stopped after {rounds} rounds without converging", stacklevel=2)
        return model, assign(points, model, channel)
    finally:
        base.unpersist()


def baum_welch(points: DataFrame, model: Model, channel: str = "fret", rounds: int = 200, tolerance: float = 1e-5) -> tuple[Model, list[float]]:
    """Maximum likelihood model of all traces; log likelihood (by trace) of each round. Executors send sums, not traces."""
    base, k, history = _blocks(points, channel, (-0.5, 1.5)), len(model.mu), []
    size = 2 + k + k * k + 3 * k
    try:
        for _ in range(rounds):
            m = model

            def stats(blocks: Iterator[list[np.ndarray]], m=m) -> Iterator[np.ndarray]:
                total = np.zeros(size)
                for xs in blocks:
                    total[1] += len(xs)
                    r = forward_backward_all(xs, m)
                    if r is not None:
                        total += np.concatenate([[r["ll"], 0], r["g1"], r["xi"].ravel(), r["g"], r["gx"] - m.mu * r["g"], r["gxx"] - 2 * m.mu * r["gx"] + m.mu**2 * r["g"]])
                yield total

            v = base.mapPartitions(stats).fold(np.zeros(size), np.add)  # a few numbers from each task
            if not v[1]:
                break
            history.append(v[0] / v[1])
            g1, xi = v[2 : 2 + k], v[2 + k : 2 + k + k * k].reshape(k, k)
            g, d1, d2 = v[2 + k + k * k :].reshape(3, k)
            safe = np.maximum(g, 1e-12)
            mean = d1 / safe
            sigma = np.maximum(0.01, np.sqrt(np.maximum(d2 / safe - mean**2, 0)))
            model = Model(g1 / max(g1.sum(), 1e-12), m.mu if m.fix_mu else m.mu + mean, m.sigma if m.fix_sigma else sigma, xi / np.maximum(xi.sum(axis=1, keepdims=True), 1e-12), m.fix_mu, m.fix_sigma)
            if len(history) > 1 and abs(history[-1] - history[-2]) <= tolerance:
                break
        else:
            warnings.warn(f"Baum-Welch stopped after {rounds} rounds without converging", stacklevel=2)
        return model, history
    finally:
        base.unpersist()


def by_threshold(points: DataFrame, level: float) -> DataFrame:
    """State 3 where the running mean of fret is above a level, else 2, up to before its last frame above 0.2; then 1."""
    df = points.withColumn("__m", F.round(seq.running_mean3("fret"), 9))
    cut = F.max(F.when(F.col("__m") > 0.2, F.col("frame"))).over(seq.whole()) - 1
    return df.withColumn("state", F.when(F.col("frame") > F.coalesce(cut, F.lit(0)), 1).when(F.col("__m") > level, 3).otherwise(2)).drop("__m")


def donor_alive(points: DataFrame, model: Model | None = None) -> DataFrame:
    """Donor alive by segmental k-means of the total, normalised by its mean where alive, twice; eroded: points with alive."""
    model = model or Model.of([0.0, 0.5, 1.0], 0.15)
    df = seq.with_donor_alive(points.withColumn("total", F.col("donor") + F.col("acceptor")))
    for _ in range(2):
        df = settle(df)  # both the fit and the join below read it
        level = F.avg(F.when(F.col("alive"), F.col("total"))).over(seq.whole())
        scaled = df.withColumn("__x", F.coalesce(F.try_divide(F.col("total"), level), F.lit(0.0)))
        idl = states_of(fit_each(scaled, model, "__x"))
        df = df.drop("alive").join(idl.select(*KEYS, "frame", (F.col("state") == len(model.mu)).alias("alive")), [*KEYS, "frame"])
    return df.withColumn("alive", seq.erode3("alive"))


def idealize(points: DataFrame, model: Model, method: str = "skm", channel: str = "fret", excluded: DataFrame | None = None) -> DataFrame:
    """States by method (viterbi, skm, skm-joint, bw, threshold); excluded traces get state 0."""
    part = points if excluded is None else points.join(excluded.select(*KEYS), KEYS, "left_anti")
    if method == "skm":
        idl = states_of(fit_each(part, model, channel))
    elif method == "skm-joint":
        idl = fit_jointly(part, model, channel)[1]
    elif method == "bw":
        idl = assign(part, baum_welch(part, model, channel)[0], channel)
    elif method == "threshold":
        idl = by_threshold(part, float(np.mean(model.mu[-2:])))
    else:
        idl = assign(part, model, channel)
    return points.select(*KEYS, "frame").join(idl.select(*KEYS, "frame", "state"), [*KEYS, "frame"], "left").withColumn("state", F.coalesce("state", F.lit(0)))


def state_means(idl: DataFrame) -> DataFrame:
    return idl.filter("state > 0").groupBy("dataset", "state").agg(F.avg("fret").alias("mean"), F.stddev_samp("fret").alias("sd"))
