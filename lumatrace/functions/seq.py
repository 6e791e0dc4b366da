"""Sequence primitives over the frames of a trace: windows, run lengths, lifetimes, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lumatrace.schema import CONSTANTS, KEYS


def by_frame() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy("frame")


def whole() -> WindowSpec:
    return Window.partitionBy(*KEYS)


def rows(a: int, b: int) -> WindowSpec:
    return by_frame().rowsBetween(a, b)


def gradient(c: str, over: WindowSpec | None = None) -> Column:
    """Half the difference of the neighbours; one-sided at the ends; 0 for a single frame."""
    w, x = over or by_frame(), F.col(c)
    after, before = F.lead(c).over(w), F.lag(c).over(w)
    return F.coalesce((after - before) / 2, after - x, x - before, F.lit(0.0))


def moving_median(c: str, width: int = CONSTANTS.tau) -> Column:
    half = width // 2
    return F.percentile(c, 0.5).over(rows(-half, half))


def std1(c: Column) -> Column:
    """Sample standard deviation; 0 for one value, null for none."""
    return F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))


def std1_over(c: Column, w: WindowSpec) -> Column:
    return F.when(F.count(c).over(w) == 1, 0.0).otherwise(F.stddev_samp(c).over(w))


def running_mean3(c: str) -> Column:
    """Mean of a frame and the two before; frames before the first count as the first."""
    first = F.first(c).over(rows(Window.unboundedPreceding, 0))
    w = rows(-2, 0)
    return (F.sum(c).over(w) + (3 - F.count("*").over(w)) * first) / 3


def erode3(flag: str) -> Column:
    """True where a frame and both neighbours are; neighbours beyond the ends count as true."""
    w = by_frame()
    return F.col(flag) & F.coalesce(F.lag(flag).over(w), F.lit(True)) & F.coalesce(F.lead(flag).over(w), F.lit(True))


def run_id(df: DataFrame, value: str, name: str = "run") -> DataFrame:
    """Numbers the runs of equal values of each trace from 1."""
    changed = F.when(F.lag(value).over(by_frame()).eqNullSafe(F.col(value)) & (F.row_number().over(by_frame()) > 1), 0).otherwise(1)
    return df.withColumn("__changed", changed).withColumn(name, F.sum("__changed").over(rows(Window.unboundedPreceding, 0))).drop("__changed")


def run_lengths(df: DataFrame, value: str) -> DataFrame:
    """One row for each run: run, value, start_frame, n_frames."""
    return run_id(df.select(*KEYS, "frame", value), value).groupBy(*KEYS, "run", value).agg(F.min("frame").alias("start_frame"), F.count("*").cast("int").alias("n_frames"))


def long_runs(df: DataFrame, flag: str, name: str, tau: int = CONSTANTS.rle_min) -> DataFrame:
    """name: flag holds in a run of more than tau frames."""
    marked = run_id(df, flag, "__run")
    n = F.count("*").over(Window.partitionBy(*KEYS, "__run"))
    return marked.withColumn(name, F.coalesce(F.col(flag), F.lit(False)) & (n > tau)).drop("__run")


def with_gradient(df: DataFrame, c: str, tau: int = CONSTANTS.tau) -> DataFrame:
    """__med: moving median of c; __grad: its gradient."""
    return df.withColumn("__med", moving_median(c, tau)).withColumn("__grad", gradient("__med"))


def with_lifetime(df: DataFrame, c: str = "total", name: str = "lifetime", tau: int = CONSTANTS.tau, n_std: float = CONSTANTS.n_std) -> DataFrame:
    """The last large drop of the smoothed signal, the last frame aside; at least 2; the trace's length if there is none."""
    t = whole()
    df = with_gradient(df, c, tau)
    limit = F.avg("__grad").over(t) + 6 * std1_over(F.col("__grad"), t)
    df = df.withColumn("__clean", F.when(F.abs("__grad") <= limit, F.col("__grad")))
    df = df.withColumn("__limit", F.avg("__clean").over(t) - n_std * std1_over(F.col("__clean"), t)).withColumn("__len", F.max("frame").over(t))
    last = F.max(F.when((F.col("__grad") <= F.col("__limit")) & (F.col("frame") < F.col("__len")), F.col("frame"))).over(t)
    return df.withColumn("__last", last).withColumn(name, F.when(F.col("__last").isNull(), F.col("__len")).otherwise(F.greatest(F.lit(2), "__last"))).drop("__med", "__grad", "__clean", "__limit", "__len", "__last")


def with_donor_alive(df: DataFrame, c: str = "total", name: str = "alive", blink_std: float = CONSTANTS.blink_std) -> DataFrame:
    """False from the lifetime on, and where c is within `blink_std` standard deviations of the background after it."""
    t = whole()
    df = with_lifetime(df, c, "__lt")
    tail = F.when(F.col("frame").between(F.col("__lt") + 5, F.col("__lt") + 5 + CONSTANTS.background_frames), F.col(c))
    df = df.withColumn("__n", F.count(tail).over(t)).withColumn("__sd", std1_over(tail, t))
    dark = (F.col("__n") >= 10) & (F.col(c) <= blink_std * F.col("__sd"))
    return df.withColumn(name, (F.col("frame") < F.col("__lt")) & ~F.coalesce(dark, F.lit(False))).drop("__lt", "__n", "__sd")


def sampling(df: DataFrame) -> DataFrame:
    """dataset, sampling_ms: the step between the first two frames."""
    at = lambda n: F.max(F.when(F.col("frame") == n, F.col("time_ms")))
    return df.groupBy("dataset").agg((at(2) - at(1)).alias("sampling_ms"))


def _lagged_sums(df: DataFrame, order: str, lags: int, **sums: Column) -> DataFrame:
    """keys, n, the named sums and products: array over lags 0 .. lags of the sum of __b at i times __a at i + lag.

    All lags are neighbours in one ordering of each trace: one exchange, no row is multiplied.
    """
    w = Window.partitionBy(*KEYS).orderBy(order)
    wide = df.select("*", *(F.lead("__a", lag).over(w).alias(f"__a{lag}") for lag in range(1, lags + 1))).withColumn("__a0", F.col("__a"))
    products = F.array(*(F.sum(F.col("__b") * F.col(f"__a{lag}")) for lag in range(lags + 1)))
    return wide.groupBy(*KEYS).agg(F.count("*").alias("__n"), *(v.alias(k) for k, v in sums.items()), products.alias("products"))


def _by_lag(sums: DataFrame, lags: int, norm: Column) -> DataFrame:
    """(keys, lag, value): lags as far as each trace is long."""
    reach = F.least(F.col("__n"), F.lit(lags + 1)).cast("int")
    each = sums.select(*KEYS, norm.alias("__norm"), F.posexplode(F.slice("products", F.lit(1), reach)).alias("lag", "__s"))
    return each.select(*KEYS, "lag", F.try_divide(F.col("__s"), F.col("__norm")).alias("value"))


def autocovariance(df: DataFrame, order: str, c: str, lags: int) -> DataFrame:
    """Biased autocovariance of each trace's sequence (`order` counts it off), divided by that at lag 0: (keys, lag, value)."""
    x = (F.col(c) - F.avg(c).over(whole())).alias("__a")
    sums = _lagged_sums(df.select(*KEYS, order, x).withColumn("__b", F.col("__a")), order, lags)
    return _by_lag(sums, lags, F.col("products")[0])


def cross_correlation(df: DataFrame, a: str, b: str, lags: int) -> DataFrame:
    """Correlation of a at i + lag with b at i over each trace's frames in order, for lags from 0: (keys, lag, value)."""
    t = whole()
    centred = df.select(*KEYS, "frame", (F.col(a) - F.avg(a).over(t)).alias("__a"), (F.col(b) - F.avg(b).over(t)).alias("__b"))
    sums = _lagged_sums(centred, "frame", lags, aa=F.sum(F.col("__a") ** 2), bb=F.sum(F.col("__b") ** 2))
    return _by_lag(sums, lags, F.sqrt(F.col("aa") * F.col("bb")))


def nonlinear_filter(df: DataFrame, widths: tuple[int, ...] = (4, 8, 16, 32, 64), m: int = 10, p: int = 5) -> DataFrame:
    """Donor and acceptor smoothed by forward and backward means of several widths, weighted by how well each predicts.

    A predictor's weight is the power -p of its summed squared residuals of both channels over the last (next) m frames;
    predictors without frames take no part. fret is computed anew; frames with fret 0 keep it.
    """
    sums: dict[str, Column] = {}
    for n in widths:
        for side, span, look in (("b", (-n, -1), (-(m - 1), 0)), ("f", (1, n), (0, m - 1))):
            k = f"__{side}{n}"
            df = df.withColumn(f"{k}d", F.avg("donor").over(rows(*span))).withColumn(f"{k}a", F.avg("acceptor").over(rows(*span)))
            df = df.withColumn(f"{k}r", (F.col("donor") - F.col(f"{k}d")) ** 2 + (F.col("acceptor") - F.col(f"{k}a")) ** 2)
            df = df.withColumn(f"{k}w", F.coalesce(F.try_divide(F.lit(1.0), F.pow(F.sum(f"{k}r").over(rows(*look)), p)), F.lit(0.0)))
            df = df.withColumn(f"{k}w", F.when(F.col(f"{k}d").isNull(), 0.0).otherwise(F.col(f"{k}w")))
            for c in "dawx":
                term = F.col(f"{k}w") if c == "w" else F.col(f"{k}w") * F.coalesce(F.col(f"{k}{c}"), F.lit(0.0)) if c != "x" else None
                if term is not None:
                    sums[c] = sums[c] + term if c in sums else term
    df = df.withColumn("__w", sums["w"]).withColumn("__d", sums["d"]).withColumn("__a", sums["a"])
    df = df.withColumn("donor", F.coalesce(F.try_divide(F.col("__d"), F.col("__w")), F.col("donor"))).withColumn("acceptor", F.coalesce(F.try_divide(F.col("__a"), F.col("__w")), F.col("acceptor")))
    df = df.withColumn("fret", F.when(F.col("fret") == 0, 0.0).otherwise(F.coalesce(F.try_divide(F.col("acceptor"), F.col("donor") + F.col("acceptor")), F.lit(0.0))))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def bin_of(c: Column, low: float, step: float, bins: int) -> Column:
    """Bin 1..bins of a value by centres low, low + step, ...; edges are midway, right-closed; outliers fall in the end bins."""
    return F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(F.round((c - low) / step + 0.5, 6)))).cast("int")
