"""Least-squares exponentials through curves that Spark has already aggregated to a bounded number of points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _best(loss, low: float, high: float, steps: int = 200) -> float:
    """The k in [low, high] of least loss: a logarithmic grid, then golden sections around its best point."""
    grid = np.geomspace(low, high, steps)
    i = int(np.argmin([loss(k) for k in grid]))
    a, b = np.log(grid[max(0, i - 1)]), np.log(grid[min(steps - 1, i + 1)])
    ratio = (np.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = loss(np.exp(c)), loss(np.exp(d))
    while b - a > 1e-13:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = loss(np.exp(c))
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = loss(np.exp(d))
    return float(np.exp((a + b) / 2))


def exponential(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """a, tau and adjusted R2 of the least-squares a exp(-x / tau). For each tau the best a is known, so only tau is searched."""
    span = x.max() - x.min() if len(x) else 0.0
    if len(x) < 3 or span <= 0:
        return np.nan, np.nan, np.nan

    def amplitude(k: float) -> float:
        e = np.exp(-k * x)
        return float(e @ y / (e @ e))

    k = _best(lambda k: float(((y - amplitude(k) * np.exp(-k * x)) ** 2).sum()), 1e-4 / span, 1e4 / span)
    a = amplitude(k)
    left, total = float(((y - a * np.exp(-k * x)) ** 2).sum()), float(((y - y.mean()) ** 2).sum())
    return a, 1 / k, 1 - left / total * (len(x) - 1) / (len(x) - 2) if total > 0 else np.nan


def decay_to_offset(x: np.ndarray, y: np.ndarray, low=(-0.1, 0.0, 1e-6), high=(0.01, 1.0, 1000.0)) -> tuple[float, float, float]:
    """y0, a and k of the least-squares y0 + a exp(-k x) with y0, a and k inside their bounds."""
    if len(x) < 3:
        return np.nan, np.nan, np.nan

    def linear(k: float) -> tuple[float, float, float]:
        e, best = np.exp(-k * x), None
        a, y0 = np.linalg.lstsq(np.stack([e, np.ones_like(e)], axis=1), y, rcond=None)[0]
        tries = [(y0, a)] if low[0] <= y0 <= high[0] and low[1] <= a <= high[1] else []
        for edge in (low[0], high[0]):  # the optimum of a convex problem lies on the box's border if not inside
            tries.append((edge, float(np.clip(e @ (y - edge) / max(e @ e, 1e-300), low[1], high[1]))))
        for edge in (low[1], high[1]):
            tries.append((float(np.clip((y - edge * e).mean(), low[0], high[0])), edge))
        for y0, a in tries:
            loss = float(((y - y0 - a * e) ** 2).sum())
            if best is None or loss < best[0]:
                best = (loss, y0, a)
        return best

    k = _best(lambda k: linear(k)[0], low[2], high[2])
    return *linear(k)[1:], k


def exponential_fits(curve: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """a, tau, r2 of each group's curve (by, x, y). A group is one curve: as many rows as it has points, never raw data."""
    fields = [f for f in curve.schema.fields if f.name in by]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", a double, tau double, r2 double"
    names = [f.name for f in fields]

    def fit(table: pa.Table) -> pa.Table:
        xs, ys = table.column("__x").to_numpy(), table.column("__y").to_numpy()
        order = np.argsort(xs)
        values = [None if np.isnan(v) else float(v) for v in exponential(xs[order], ys[order])]
        return pa.table([table.column(n).slice(0, 1) for n in names] + [pa.array([v], pa.float64()) for v in values], names=[*names, "a", "tau", "r2"])

    points = curve.select(*names, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).filter("__x is not null and __y is not null")
    return points.groupBy(*names).applyInArrow(fit, schema)


def gaussian(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float, float]:
    """a, b and c > 0 of the least-squares a exp(-((x - b) / c) ** 2), by damped Gauss-Newton steps from the curve's moments.

    Steps that do not lower the loss are damped more; fewer than three values above zero fix no curve (nan).
    """
    total = y.sum()
    if (y > 0).sum() < 3 or total <= 0:
        return np.nan, np.nan, np.nan
    b = float(x @ y / total)
    at = np.array([y.max(), b, max(np.sqrt(2 * ((x - b) ** 2 @ y) / total), np.abs(np.diff(x)).min() / 2)])
    value = lambda p: p[0] * np.exp(-(((x - p[1]) / p[2]) ** 2))
    loss, damp = float(((y - value(at)) ** 2).sum()), 1e-3
    for _ in range(rounds):
        e = np.exp(-(((x - at[1]) / at[2]) ** 2))
        jac = np.stack([e, at[0] * e * 2 * (x - at[1]) / at[2] ** 2, at[0] * e * 2 * (x - at[1]) ** 2 / at[2] ** 3], axis=1)
        normal, right = jac.T @ jac, jac.T @ (y - at[0] * e)
        while damp < 1e12:
            step = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-300), right, rcond=None)[0]
            new = at + step
            new_loss = float(((y - value(new)) ** 2).sum()) if new[2] > 0 else np.inf
            if new_loss <= loss:
                break
            damp *= 10
        else:
            break
        done = np.abs(step).max() <= 1e-12 * np.abs(at).max()
        at, loss, damp = new, new_loss, max(damp / 10, 1e-12)
        if done:
            break
    return float(at[0]), float(at[1]), float(at[2])


def gaussian_fits(histogram: DataFrame, by: list[str], bin: str, y: str, low: float, step: float, bins: int) -> DataFrame:
    """Height, center and width of the Gaussian through each group's histogram (by, bin from 1, y): all groups at once.

    Bins without a row count as zero. A group is one histogram: `bins` rows at most, never raw data. Groups whose histogram
    has fewer than three filled bins get nulls.
    """
    fields = [f for f in histogram.schema.fields if f.name in by]
    names = [f.name for f in fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", height double, center double, width double"
    x = low + step * np.arange(bins)

    def fit(table: pa.Table) -> pa.Table:
        full = np.zeros(bins)
        full[table.column("__bin").to_numpy() - 1] = table.column("__y").to_numpy()
        values = [None if np.isnan(v) else v for v in gaussian(x, full)]
        return pa.table([table.column(n).slice(0, 1) for n in names] + [pa.array([v], pa.float64()) for v in values], names=[*names, "height", "center", "width"])

    points = histogram.select(*names, F.col(bin).cast("int").alias("__bin"), F.col(y).cast("double").alias("__y")).filter(F.col("__bin").between(1, bins) & F.col("__y").isNotNull())
    return points.groupBy(*names).applyInArrow(fit, schema)
