"""Dwell times and kinetics from state assignments."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions import seq
from lumatrace.operators import fits
from lumatrace.schema import KEYS


# Gas constant in kJ/(mol K), Planck's and Boltzmann's in SI units.
_PHYSICS = (8.314472e-3, 6.62606896e-34, 1.3806504e-23)


def to_dwells(idl: DataFrame, *means: str) -> DataFrame:
    """Runs of equal states, those of state 0 left out, numbered; with the mean of each column in `means`."""
    runs = seq.run_id(idl.select(*KEYS, "frame", "state", *means), "state")
    out = runs.groupBy(*KEYS, "run", "state").agg(F.min("frame").alias("start_frame"), F.count("*").cast("int").alias("n_frames"), *[F.avg(m).alias(f"mean_{m}") for m in means])
    return out.filter("state > 0").withColumn("dwell_no", F.row_number().over(Window.partitionBy(*KEYS).orderBy("run"))).drop("run")


def to_states(dwells: DataFrame, frames: DataFrame) -> DataFrame:
    """Back to a state for each of `frames` (keys, frame); gaps get 0."""
    return on_frames(dwells, frames.select(*KEYS, "frame"))


def on_frames(dwells: DataFrame, points: DataFrame) -> DataFrame:
    """points with `state`: that of the dwell a frame lies in, 0 in gaps. Dwells of a trace do not overlap.

    Starts of dwells are sorted in among the frames and carried on. Dwells spread out to their frames would be joined by the size
    they have before: a table small enough to broadcast, with millions of frames in it.
    """
    starts = dwells.dropna(subset=[*KEYS, "start_frame", "n_frames"]).select(*KEYS, F.col("start_frame").cast(points.schema["frame"].dataType).alias("frame"), F.struct("start_frame", "n_frames", "state").alias("__dwell"))
    both = points.unionByName(starts, allowMissingColumns=True)
    so_far = Window.partitionBy(*KEYS).orderBy("frame", F.col("__dwell").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    df = both.withColumn("__last", F.last("__dwell", ignorenulls=True).over(so_far)).filter("__dwell is null")
    own = F.when(F.col("frame") < F.col("__last.start_frame") + F.col("__last.n_frames"), F.col("__last.state"))
    return df.withColumn("state", F.coalesce(own, F.lit(0))).drop("__dwell", "__last")


def with_empty(dwells: DataFrame, traces: DataFrame) -> DataFrame:
    """Traces without dwells come back as one row of nulls."""
    return traces.select(*KEYS).join(dwells, KEYS, "left")


def dwell_seconds(dwells: DataFrame, sampling_ms: float) -> DataFrame:
    return dwells.select(*KEYS, "dwell_no", "state", (F.col("n_frames") * sampling_ms / 1000).alias("seconds"))


def remove_blinks(dwells: DataFrame) -> DataFrame:
    """Dark dwells (state 1) removed: a leading one moves the start, an inner one's frames go to both neighbours (the
    odd one to the next), a trailing one is dropped; equal neighbours then merge. Dark dwells never touch."""
    w = Window.partitionBy(*KEYS).orderBy("dwell_no")
    s, n = F.col("state"), F.col("n_frames")
    before, after = F.lag("state").over(w), F.lead("state").over(w)
    inner_next = (after == 1) & F.lead("state", 2).over(w).isNotNull()
    inner_last = (before == 1) & F.lag("state", 2).over(w).isNotNull()
    given = n + F.when(inner_next, F.floor(F.lead("n_frames").over(w) / 2)).otherwise(0) + F.when(inner_last, F.ceil(F.lag("n_frames").over(w) / 2)).otherwise(0)
    start = F.col("start_frame") - F.when(inner_last, F.ceil(F.lag("n_frames").over(w) / 2)).otherwise(0)
    kept = dwells.select(*KEYS, "dwell_no", "state", given.alias("n_frames"), start.alias("start_frame")).filter(s != 1)
    new = F.when(F.lag("state").over(w) == s, 0).otherwise(1)
    runs = kept.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    merged = runs.groupBy(*KEYS, "run", "state").agg(F.sum("n_frames").cast("int").alias("n_frames"), F.min("start_frame").cast("int").alias("start_frame"))
    return merged.select(*KEYS, F.col("run").cast("int").alias("dwell_no"), "state", "start_frame", "n_frames")


def survival(dwells: DataFrame) -> DataFrame:
    """Share of each state's dwells that last longer than n frames, relative to the first point: (dataset, state, n_frames, survival)."""
    n = dwells.groupBy("dataset", "state", "n_frames").agg(F.count("*").alias("k"))
    top = n.groupBy("dataset").agg(F.max("n_frames").alias("top"))
    grid = n.select("dataset", "state").distinct().join(top, "dataset").select("dataset", "state", F.explode(F.sequence(F.lit(0), "top")).alias("n_frames"))
    full = grid.join(n, ["dataset", "state", "n_frames"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    w = Window.partitionBy("dataset", "state")
    left = full.withColumn("left", F.sum("k").over(w) - F.sum("k").over(w.orderBy("n_frames")))
    return left.select("dataset", "state", "n_frames", F.try_divide(F.col("left"), F.max(F.when(F.col("n_frames") == 0, F.col("left"))).over(w)).alias("survival"))


def log_histogram(dwells: DataFrame, sampling_ms: float, step: float = 0.4, normalize: str = "state", blinks: bool = False) -> DataFrame:
    """Dwells in bins of log time whose edges are whole numbers of frames: (dataset, state, low_frames, value).

    Dark dwells are removed first unless `blinks`. value: counts by bin width, scaled to 100 for each state (off: to its
    number of dwells; file: to its percentage of the file's dwells; time: to its dwells for each second of the file).
    """
    dwells = dwells if blinks else remove_blinks(dwells)
    dt = sampling_ms / 1000
    top = dwells.agg(F.max("n_frames").alias("top"))
    at = F.explode(F.sequence(F.lit(0), F.floor(F.log(F.col("top") * 3.0) / step).cast("int")))
    raw = top.select("top", at.alias("k")).select(F.exp(F.col("k") * step).alias("e"))
    down, up = F.floor("e"), F.floor("e") + 1
    nearest = F.when(F.log("e") - F.log(down) <= F.log(up) - F.log("e"), down).otherwise(up)
    edges = raw.select(nearest.cast("long").alias("low_frames")).distinct()
    w = Window.orderBy("low_frames")  # a few dozen edges
    edges = edges.select("low_frames", F.lead("low_frames").over(w).alias("high_frames"))
    width = F.log(F.col("high_frames") / F.col("low_frames"))
    edges = edges.withColumn("width", F.coalesce(width, F.lag(width).over(w)))
    counts = dwells.groupBy("dataset", "state", "n_frames").agg(F.count("*").alias("k"))
    inside = (F.col("n_frames") >= F.col("low_frames")) & F.col("high_frames").isNotNull() & (F.col("n_frames") < F.col("high_frames"))
    bins = counts.join(F.broadcast(edges), inside).groupBy("dataset", "state", "low_frames").agg((F.sum("k") / F.first("width")).alias("v"))
    s = Window.partitionBy("dataset", "state")
    totals = dwells.groupBy("dataset", "state").agg(F.count("*").alias("n"), F.sum("n_frames").alias("frames"))
    d = Window.partitionBy("dataset")
    totals = totals.withColumn("all", F.sum("n").over(d)).withColumn("seconds", F.sum("frames").over(d) * dt)
    scale: dict[str, Column] = {"off": F.col("n"), "state": F.lit(100.0), "file": 100 * F.col("n") / F.col("all"), "time": F.col("n") / F.col("seconds")}
    return bins.join(totals, ["dataset", "state"]).select("dataset", "state", "low_frames", (F.col("v") / F.sum("v").over(s) * scale[normalize]).alias("value"))


def _counted(idl: DataFrame, hide_dark: bool) -> DataFrame:
    """Assigned frames; without the dark class (state 1) unless it is wanted."""
    return idl.filter("state > 1" if hide_dark else "state > 0")


def occupancy_by_frame(idl: DataFrame, frames: int = 300, hide_dark: bool = True) -> DataFrame:
    """Percent of traces in each state by frame, the dark class (state 1) left out of the rows and of the total unless wanted."""
    n = _counted(idl, hide_dark).filter(F.col("frame") <= frames).groupBy("dataset", "frame", "state").agg(F.count("*").alias("n"))
    return n.select("dataset", "frame", "state", (100 * F.col("n") / F.sum("n").over(Window.partitionBy("dataset", "frame"))).alias("percent"))


def state_frames(idl: DataFrame) -> DataFrame:
    return idl.groupBy(*KEYS, "state").agg(F.count("*").alias("n_frames"))


def percent_time(idl: DataFrame, by: list[str] | None = None, truncate: int | None = None, hide_dark: bool = True) -> DataFrame:
    """Percent of the time in each state, by dataset (or other columns); the dark class (state 1) does not count unless wanted."""
    by = by or ["dataset"]
    part = idl if truncate is None else idl.filter(F.col("frame") <= truncate)
    n = _counted(part, hide_dark).groupBy(*by, "state").agg(F.count("*").alias("n"))
    return n.select(*by, "state", (100 * F.col("n") / F.sum("n").over(Window.partitionBy(*by))).alias("percent"))


def percent_time_by_day(idl: DataFrame, places: DataFrame, hide_dark: bool = True) -> DataFrame:
    """Standard deviation over acquisition days (places: keys, day) of percent_time(): (state, sd)."""
    daily = percent_time(idl.join(places.select(*KEYS, "day"), KEYS), ["day"], hide_dark=hide_dark)
    return daily.groupBy("state").agg(F.stddev_samp("percent").alias("sd"))


def transition_events(idl: DataFrame, truncate: int | None = None) -> DataFrame:
    """By trace, dark frames (state 1 and 0) removed, the rest closed up, then cut: events (runs less one) and frames."""
    w = seq.by_frame()
    part = idl.filter("state > 1")
    part = part if truncate is None else part.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= truncate)
    changed = F.coalesce((F.lag("state").over(w) != F.col("state")).cast("int"), F.lit(0))
    return part.withColumn("changed", changed).groupBy(*KEYS).agg(F.sum("changed").alias("events"), F.count("*").alias("n_frames"))


def transitions_per_second(idl: DataFrame, sampling_ms: float, truncate: int | None = None) -> DataFrame:
    return transition_events(idl, truncate).groupBy("dataset").agg((F.sum("events") / (F.sum("n_frames") * sampling_ms / 1000)).alias("per_second"))


def equilibrium_constants(dwells: DataFrame) -> DataFrame:
    """For every two states, the ratio of their total times: (dataset, src, dst, k)."""
    t = dwells.groupBy("dataset", "state").agg(F.sum("n_frames").alias("n"))
    a, b = t.toDF("dataset", "src", "n_src"), t.toDF("dataset", "dst", "n_dst")
    return a.join(b, "dataset").filter("src != dst").select("dataset", "src", "dst", (F.col("n_dst") / F.col("n_src")).alias("k"))


def dwell_matrix(dwells: DataFrame, states: list[int], sampling_ms: float) -> DataFrame:
    """Milliseconds of each trace in each state, a column for each."""
    return dwells.groupBy(*KEYS).agg(*[F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n_frames"))) * sampling_ms, F.lit(0.0)).alias(f"state_{s}_ms") for s in states])


def autocovariance(dwells: DataFrame, state: int, lags: int = 49, least: int = 20) -> DataFrame:
    """Mean and standard error, over traces with more than `least` dwells in a state, of the autocovariance of those dwells.

    Only the state's own dwells count, one after another. A trace is 0 at the lag of its number of dwells and has no value
    beyond; lags with fewer than 3 traces are left out: (dataset, lag, mean, sem, n).
    """
    own = F.row_number().over(Window.partitionBy(*KEYS).orderBy("dwell_no"))
    dwells = dwells.filter(F.col("state") == state).withColumn("dwell_no", own)
    long = dwells.withColumn("__n", F.count("*").over(Window.partitionBy(*KEYS))).filter(F.col("__n") > least).withColumn("n_frames", F.col("n_frames").cast("double"))
    each = seq.autocovariance(long, "dwell_no", "n_frames", lags)
    ends = long.groupBy(*KEYS).agg(F.max("__n").cast("int").alias("lag")).filter(F.col("lag") <= lags)
    each = each.unionByName(ends.select(*KEYS, "lag", F.lit(0.0).alias("value")))
    out = each.groupBy("dataset", "lag").agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"), F.count("value").alias("n"))
    return out.filter("n >= 3")


def autocovariance_fit(curve: DataFrame, lags: int = 49) -> dict[str, tuple[float, float, float]]:
    """dataset -> y0, a, k of y0 + a exp(-k lag) through autocovariance()'s means at lags 1 .. lags; at most `lags` rows a dataset.

    Lags from the first that too few traces reach count as 0.
    """
    rows, out = curve.filter(F.col("lag").between(0, lags)).select("dataset", "lag", "mean").toPandas(), {}
    for d, g in rows.groupby("dataset"):
        known = dict(zip(g["lag"], g["mean"], strict=True))
        y, open_ = np.zeros(lags), True
        for lag in range(lags + 1):
            open_ = open_ and lag in known
            if open_ and lag:
                y[lag - 1] = known[lag]
        out[d] = fits.decay_to_offset(np.arange(1.0, lags + 1), y)
    return out


def transition_counts(idl: DataFrame, by: list[str]) -> DataFrame:
    """Frame-to-frame steps from state to state, both assigned: (by, src, dst, n)."""
    nxt = F.lead("state").over(seq.by_frame())
    return idl.withColumn("dst", nxt).filter("state > 0 and dst > 0").groupBy(*by, F.col("state").alias("src"), "dst").agg(F.count("*").alias("n"))


def transition_matrix(idl: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or ["dataset"]
    return transition_counts(idl, by).select(*by, "src", "dst", (F.col("n") / F.sum("n").over(Window.partitionBy(*by, "src"))).alias("p"))


def rates(dwells: DataFrame, sampling_ms: float, by: list[str] | None = None) -> DataFrame:
    """Most likely rates of a model with a state for each class and all rates free: (by, src, dst, k) in 1/s.

    A state's total rate is its exits (the last dwell of a trace exits anywhere) over its time; it is shared out by the
    counts of where the exits went.
    """
    by = by or ["dataset"]
    w = Window.partitionBy(*KEYS).orderBy("dwell_no")
    d = dwells.withColumn("dst", F.lead("state").over(w))
    total = d.groupBy(*by, "state").agg((F.count("*") / (F.sum("n_frames") * sampling_ms / 1000)).alias("q"))
    pair = d.filter("dst is not null").groupBy(*by, "state", "dst").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by, "state"))
    return pair.withColumn("share", share).join(total, [*by, "state"]).select(*by, F.col("state").alias("src"), "dst", (F.col("q") * F.col("share")).alias("k"))


def rate_histogram(rates: DataFrame, low: float = -3.0, step: float = 0.2, bins: int = 40) -> DataFrame:
    """Rates by the tenth logarithm; extremes fall in the end bins: (src, dst, bin, n)."""
    at = F.least(F.lit(bins), F.greatest(F.lit(1), F.floor(F.round((F.log10("k") - low) / step, 6)) + 1)).cast("int")
    return rates.filter("k > 0").groupBy("src", "dst", at.alias("bin")).agg(F.count("*").alias("n"))


def rate_ensemble(dwells: DataFrame, sampling_ms: float, least: int = 4) -> DataFrame:
    """Geometric mean of per-trace rates, of traces with at least `least` transitions of the kind: (dataset, src, dst, k, n)."""
    w = Window.partitionBy(*KEYS).orderBy("dwell_no")
    n = dwells.withColumn("dst", F.lead("state").over(w)).filter("dst is not null").groupBy(*KEYS, F.col("state").alias("src"), "dst").agg(F.count("*").alias("m"))
    own = rates(dwells, sampling_ms, KEYS).join(n, [*KEYS, "src", "dst"]).filter(F.col("m") >= least)
    return own.groupBy("dataset", "src", "dst").agg(F.exp(F.avg(F.log("k"))).alias("k"), F.count("*").alias("n"))


def survival_before(dwells: DataFrame) -> DataFrame:
    """Survival of the dwells before each kind of transition: (dataset, src, dst, n_frames, survival)."""
    w = Window.partitionBy(*KEYS).orderBy("dwell_no")
    d = dwells.withColumn("dst", F.lead("state").over(w)).filter("dst is not null")
    n = d.groupBy("dataset", F.col("state").alias("src"), "dst", "n_frames").agg(F.count("*").alias("k"))
    p = Window.partitionBy("dataset", "src", "dst")
    return n.select("dataset", "src", "dst", "n_frames", (1 - F.sum("k").over(p.orderBy("n_frames")) / F.sum("k").over(p)).alias("survival"))


def exponential_lifetime(dwells: DataFrame, sampling_ms: float, floor: float = 0.01, blinks: bool = False) -> DataFrame:
    """Time constant in seconds of each state: (dataset, state, a, tau, r2), r2 adjusted.

    a exp(-t / tau) by least squares through the survival curve up to its last value above `floor`; dark dwells are
    removed first unless `blinks`. Each curve has a point for each frame, however many dwells it stands for.
    """
    s = survival(dwells if blinks else remove_blinks(dwells))
    last = F.max(F.when(F.col("survival") > floor, F.col("n_frames"))).over(Window.partitionBy("dataset", "state"))
    s = s.withColumn("__last", last).filter(F.col("n_frames") <= F.col("__last")).withColumn("t", F.col("n_frames") * sampling_ms / 1000)
    return fits.exponential_fits(s, ["dataset", "state"], "t", "survival")


def total_lifetime_curves(dwells: DataFrame, on_state: int) -> DataFrame:
    """Survival of the on times, the off times and each trace's total on time: (dataset, kind, n_frames, survival)."""
    on = F.col("state") == on_state
    single = dwells.select("dataset", F.when(on, "on").otherwise("off").alias("state"), "n_frames")
    total = dwells.filter(on).groupBy(*KEYS).agg(F.sum("n_frames").cast("int").alias("n_frames")).select("dataset", F.lit("total on").alias("state"), "n_frames")
    return survival(single.unionByName(total)).withColumnRenamed("state", "kind")


def total_lifetime_report(dwells: DataFrame, on_state: int, sampling_ms: float) -> dict[str, DataFrame]:
    """summary: blinking(), in seconds; curves: total_lifetime_curves() with their time in seconds (t)."""
    curves = total_lifetime_curves(dwells, on_state)
    return {"summary": blinking(dwells, on_state, sampling_ms), "curves": curves.withColumn("t", F.col("n_frames") * sampling_ms / 1000)}


def transition_density(idl: DataFrame, sampling_ms: float, low: float = -0.1, step: float = 0.03, bins: int = 44, normalize: str = "total time", hide_blinks: bool = False, truncate: int | None = None) -> DataFrame:
    """Mean fret of neighbouring dwells: (dataset, bin_before, bin_after, density), per second or in percent of transitions."""
    part = idl if truncate is None else idl.filter(F.col("frame") <= truncate)
    d = to_dwells(part.filter("state > 1") if hide_blinks else part, "fret")
    w = Window.partitionBy(*KEYS).orderBy("dwell_no")
    d = d.withColumn("bin_after", seq.bin_of(F.round("mean_fret", 6), low, step, bins)).withColumn("bin_before", F.lag("bin_after").over(w))
    n = d.filter("bin_before is not null").groupBy("dataset", "bin_before", "bin_after").agg(F.count("*").alias("n"))
    if normalize == "total time":
        total = d.groupBy("dataset").agg((F.sum("n_frames") * sampling_ms / 1000).alias("s"))
        return n.join(total, "dataset").select("dataset", "bin_before", "bin_after", (F.col("n") / F.col("s")).alias("density"))
    return n.select("dataset", "bin_before", "bin_after", (100 * F.col("n") / F.sum("n").over(Window.partitionBy("dataset"))).alias("density"))


def state_histograms(idl: DataFrame, low: float = -0.1, step: float = 0.03, bins: int = 44, frames: int = 50, ignore_zero: bool = False) -> DataFrame:
    """fret histogram of each state over the first frames, as a share of all frames counted: (dataset, state, bin, share)."""
    part = idl.filter(F.col("frame") <= frames)
    part = part.filter("state > 0") if ignore_zero else part
    n = part.groupBy("dataset", "state", seq.bin_of(F.round("fret", 6), low, step, bins).alias("bin")).agg(F.count("*").alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dataset")))
    return share.filter("state > 0").select("dataset", "state", "bin", "share")


def blinking(dwells: DataFrame, on_state: int, sampling_ms: float) -> DataFrame:
    """Mean on and off time, mean total on and off time of traces that have any, percent of time on: by dataset, in seconds."""
    s = F.col("n_frames") * sampling_ms / 1000
    on = F.col("state") == on_state
    d = dwells.select(*KEYS, F.when(on, s).alias("on"), F.when(~on, s).alias("off"))
    each = d.groupBy(*KEYS).agg(F.sum("on").alias("t_on"), F.sum("off").alias("t_off"), F.count("on").alias("n_on"), F.count("off").alias("n_off"))
    out = each.groupBy("dataset").agg((F.sum("t_on") / F.sum("n_on")).alias("mean_on"), F.try_divide(F.sum("t_off"), F.sum("n_off")).alias("mean_off"), F.avg("t_on").alias("total_on"), F.avg("t_off").alias("total_off"), (100 * F.sum("t_on") / (F.sum("t_on") + F.coalesce(F.sum("t_off"), F.lit(0.0)))).alias("percent_on"))
    return out


def time_to_state(dwells: DataFrame, n_traces: DataFrame, state: int = 3, seconds: float = 1.0, sampling_ms: float = 40.0) -> DataFrame:
    """Share of all traces that have begun a dwell of `state` of at least `seconds` by each such start: (dataset, start_frame, reached)."""
    first = dwells.filter((F.col("state") == state) & (F.col("n_frames") * sampling_ms / 1000 >= seconds)).groupBy(*KEYS).agg(F.min("start_frame").alias("start_frame"))
    n = first.groupBy("dataset", "start_frame").agg(F.count("*").alias("k")).join(n_traces, "dataset")
    return n.select("dataset", "start_frame", (F.sum("k").over(Window.partitionBy("dataset").orderBy("start_frame")) / F.col("n_traces")).alias("reached"))


def time_to_state_curve(dwells: DataFrame, n_traces: DataFrame, state: int = 3, seconds: float = 1.0, sampling_ms: float = 40.0, until: float = 120.0) -> DataFrame:
    """time_to_state() on a grid: (dataset, frame, seconds, reached) for every frame from 0 to `until` seconds.

    frame 0 is the recording's first. Starts beyond the grid count at its last place, as a histogram's end bin has it; datasets
    in which no trace reaches the state have zeros.
    """
    last = int(round(until * 1000 / sampling_ms))
    first = dwells.filter((F.col("state") == state) & (F.col("n_frames") * sampling_ms / 1000 >= seconds)).groupBy(*KEYS).agg(F.min("start_frame").alias("start_frame"))
    n = first.groupBy("dataset", F.least(F.lit(last), F.col("start_frame") - 1).cast("int").alias("frame")).agg(F.count("*").alias("k"))
    grid = n_traces.select("dataset", "n_traces", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("frame"))
    so_far = F.sum(F.coalesce("k", F.lit(0))).over(Window.partitionBy("dataset").orderBy("frame"))
    return grid.join(n, ["dataset", "frame"], "left").select("dataset", "frame", (F.col("frame") * sampling_ms / 1000).alias("seconds"), (so_far / F.col("n_traces")).alias("reached"))


def log_rate_histogram(dwells: DataFrame, sampling_ms: float, least: int = 4, low: float = -3.0, step: float = 0.3, bins: int = 27) -> DataFrame:
    """Natural logarithms of per-trace rates of each transition, as shares: (dataset, src, dst, bin, center, share, n_traces).

    Bins are centred on low, low + step, ...; the end bins take what lies beyond. Traces with fewer than `least` transitions of
    the kind are left out.
    """
    w = Window.partitionBy(*KEYS).orderBy("dwell_no")
    n = dwells.withColumn("dst", F.lead("state").over(w)).filter("dst is not null").groupBy(*KEYS, F.col("state").alias("src"), "dst").agg(F.count("*").alias("m"))
    own = rates(dwells, sampling_ms, KEYS).join(n, [*KEYS, "src", "dst"]).filter((F.col("m") >= least) & (F.col("k") > 0))
    counted = own.groupBy("dataset", "src", "dst", seq.bin_of(F.round(F.log("k"), 9), low, step, bins).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("dataset", "src", "dst"))
    return counted.select("dataset", "src", "dst", "bin", F.round(low + step * (F.col("bin") - 1), 9).alias("center"), (F.col("n") / total).alias("share"), total.alias("n_traces"))


def rate_peaks(histogram: DataFrame, low: float = -3.0, step: float = 0.3, bins: int = 27) -> DataFrame:
    """Peak of each log-rate histogram by a Gaussian fitted to it: (dataset, src, dst, k, spread, n_traces).

    k = exp(centre), spread = exp(width); empty bins count as zeros. All histograms are fitted by the tasks that hold them.
    """
    by = ["dataset", "src", "dst"]
    peaks = fits.gaussian_fits(histogram, by, "bin", "share", low, step, bins)
    n = histogram.groupBy(*by).agg(F.max("n_traces").alias("n_traces"))
    return peaks.join(n, by).select(*by, F.exp("center").alias("k"), F.exp("width").alias("spread"), "n_traces")


def waiting_curve(dwells: DataFrame, frames: int = 100) -> DataFrame:
    """Of each kind of transition, how many of the dwells before it last longer than 0, 1, ... frames: (dataset, src, dst, frame, left)."""
    by = ["dataset", "src", "dst"]
    w = Window.partitionBy(*KEYS).orderBy("dwell_no")
    d = dwells.withColumn("dst", F.lead("state").over(w)).filter("dst is not null").withColumnRenamed("state", "src")
    n = d.groupBy(*by, F.least(F.col("n_frames"), F.lit(frames)).alias("frame")).agg(F.count("*").alias("k"))
    grid = n.groupBy(*by).agg(F.sum("k").alias("total")).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    ended = F.sum(F.coalesce("k", F.lit(0))).over(Window.partitionBy(*by).orderBy("frame"))
    return grid.join(n, [*by, "frame"], "left").select(*by, "frame", (F.col("total") - ended).alias("left"))


def waiting_fits(curve: DataFrame, sampling_ms: float) -> DataFrame:
    """waiting_curve() as a exp(-k t), t in seconds: (dataset, src, dst, a, k, r2)."""
    fitted = fits.exponential_fits(curve.withColumn("__t", F.col("frame") * sampling_ms / 1000), ["dataset", "src", "dst"], "__t", "left")
    return fitted.select("dataset", "src", "dst", "a", F.try_divide(F.lit(1.0), F.col("tau")).alias("k"), "r2")


def energy_landscape(rates: DataFrame, kelvin: float = 298.0) -> DataFrame:
    """Barrier of each transition in kJ/mol from its rate in 1/s: (dataset, src, dst, barrier)."""
    gas, planck, boltzmann = _PHYSICS
    return rates.filter("k > 0").select("dataset", "src", "dst", (-gas * kelvin * F.log(F.col("k") * planck / (boltzmann * kelvin))).alias("barrier"))


def well_energies(percent: DataFrame, reference: int, kelvin: float = 298.0) -> DataFrame:
    """Free energy of each state against a reference state, in kJ/mol, from percent_time(): (dataset, state, energy)."""
    ref = percent.filter(F.col("state") == reference).select("dataset", F.col("percent").alias("__ref"))
    return percent.join(ref, "dataset").select("dataset", "state", (-_PHYSICS[0] * kelvin * F.log(F.col("percent") / F.col("__ref"))).alias("energy"))


def energy_path(rates: DataFrame, percent: DataFrame, order: list[int], kelvin: float = 298.0) -> DataFrame:
    """The landscape along a cycle of states, the first being the reference: (dataset, step, src, dst, well, peak).

    peak: the transition state between src and dst, the average of what is reached from either side, each side's barrier
    less its well. Steps without both rates have no peak.
    """
    wells, barriers = well_energies(percent, order[0], kelvin), energy_landscape(rates, kelvin)
    steps = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(a).alias("src"), F.lit(b).alias("dst")) for i, (a, b) in enumerate(zip(order, order[1:] + order[:1], strict=True))])
    path = percent.select("dataset").distinct().select("dataset", F.explode(steps).alias("s")).select("dataset", "s.*")
    well = lambda at, name: wells.select("dataset", F.col("state").alias(at), F.col("energy").alias(name))
    path = path.join(well("src", "well"), ["dataset", "src"], "left").join(well("dst", "__w2"), ["dataset", "dst"], "left")
    path = path.join(barriers.withColumnRenamed("barrier", "__b1"), ["dataset", "src", "dst"], "left").join(barriers.select("dataset", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("barrier").alias("__b2")), ["dataset", "src", "dst"], "left")
    return path.select("dataset", "step", "src", "dst", "well", ((F.col("__b1") - F.col("well") + F.col("__b2") - F.col("__w2")) / 2).alias("peak"))


def _weighted(rows: DataFrame, resamples: int) -> DataFrame:
    """rows of traces with b and w: how often resample b draws the row's trace, by Poisson(1) from a hash of both; 0 too."""
    limits = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    # A digest's first 32 bits, which SQL twins can draw as well. Digits compare as the number does, so a draw costs one digest.
    draws = rows.withColumn("__k", F.concat_ws("#", *KEYS, F.lit(""))).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("__u", F.md5(F.concat("__k", F.col("b").cast("string"))))
    w = F.lit(len(limits))
    for n, x in reversed(list(enumerate(limits))):
        w = F.when(F.col("__u") < f"{math.ceil(x * 2**32):08x}", n).otherwise(w)
    return draws.withColumn("w", w).drop("__k", "__u")


def bootstrap_draws(rows: DataFrame, resamples: int) -> DataFrame:
    """rows of traces with b and w: how often resample b draws the row's trace, by Poisson(1) from a hash of both; draws of 0 and rows without keys are left out."""
    return _weighted(rows.dropna(subset=KEYS), resamples).filter("w > 0")


def bootstrap_sums(rows: DataFrame, by: list[str], columns: list[str], resamples: int) -> DataFrame:
    """(dataset, by, b, columns): sums of each resample over traces, rows weighted as bootstrap_draws() draws their traces.

    A trace is drawn beside its rows, so nothing is joined, and tasks add their traces up before they send anything. Rows of
    traces are dealt anew, as the few that traces come in would leave most cores idle. What no drawn trace holds is left out.
    """
    rows = rows.select(*KEYS, *by, *columns).dropna(subset=KEYS)
    if by:
        rows = rows.groupBy(*KEYS).agg(F.collect_list(F.struct(*by, *columns)).alias("__rows"))
    drawn = _weighted(rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *KEYS), resamples)
    if by:
        drawn = drawn.filter("w > 0").select("dataset", "b", "w", F.inline("__rows"))
    sums = [F.sum(F.when(F.col("w") > 0, F.col("w") * F.col(c))).alias(c) for c in columns]
    return drawn.groupBy("dataset", *by, "b").agg(*sums, F.max("w").alias("__w")).filter("__w > 0").drop("__w")


def bootstrap_se(each: DataFrame, statistic: Column, resamples: int = 1000) -> DataFrame:
    """Standard error over traces of any statistic that is an expression of sums: (dataset, se).

    each: keys and columns to sum; statistic: an expression of those columns' (weighted) sums, such as F.col("events") / F.col("seconds").
    """
    sums = bootstrap_sums(each, [], [c for c in each.columns if c not in KEYS], resamples)
    return sums.select("dataset", statistic.alias("__s")).groupBy("dataset").agg(F.stddev_samp("__s").alias("se"))


def bootstrap_percent(idl: DataFrame, resamples: int = 1000, hide_dark: bool = True) -> DataFrame:
    """Standard error of percent_time() over traces, by bootstrap_draws()."""
    w = bootstrap_sums(state_frames(_counted(idl, hide_dark)), ["state"], ["n_frames"], resamples)
    p = w.select("dataset", "state", "b", (100 * F.col("n_frames") / F.sum("n_frames").over(Window.partitionBy("dataset", "b"))).alias("percent"))
    return p.groupBy("dataset", "state").agg(F.stddev_samp("percent").alias("se"))
