"""Ensemble summaries: contours, histograms, averages, post-synchronised traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions import ranks, seq
from lumatrace.operators import dwell, fits
from lumatrace.operators.dwell import to_dwells
from lumatrace.schema import KEYS
from lumatrace.session import settle


def contour_counts(points: DataFrame, low: float = -0.1, step: float = 0.03, bins: int = 44, offset: int = 0) -> DataFrame:
    """Traces in each fret bin by frame, no fret counting as 0: (dataset, frame, bin, n)."""
    fret = F.round(F.coalesce("fret", F.lit(0.0)), 6)
    return points.filter(F.col("frame") > offset).groupBy("dataset", (F.col("frame") - offset).alias("frame"), seq.bin_of(fret, low, step, bins).alias("bin")).agg(F.count("*").alias("n"))


def contour(points: DataFrame, low: float = -0.1, step: float = 0.03, bins: int = 44, offset: int = 0, remove_bleached: bool = False) -> DataFrame:
    """Share of traces in each fret bin by frame: (dataset, frame, bin, share); bins without traces have no row.

    remove_bleached: bins up to fret 0.15 are left out and each frame sums to 1.
    """
    n = contour_counts(points, low, step, bins, offset)
    if remove_bleached:
        n = n.filter(F.round(low + (F.col("bin") - 1) * step, 9) > 0.15)
        return n.select("dataset", "frame", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("dataset", "frame"))).alias("share"))
    traces = points.groupBy("dataset").agg(F.countDistinct("trace_id").alias("traces"))
    return n.join(traces, "dataset").select("dataset", "frame", "bin", (F.col("n") / F.col("traces")).alias("share"))


def display_contour(c: DataFrame, length: int) -> DataFrame:
    """Means over groups of ceil(length / 50) frames; an incomplete last group is dropped."""
    f = -(-length // 50)
    whole = F.col("frame") <= length - length % f
    return c.filter(whole).groupBy("dataset", (F.floor((F.col("frame") - 1) / f) + 1).cast("int").alias("group"), "bin").agg((F.sum("share") / f).alias("share"))


def histogram_counts(points: DataFrame, by: list[str] | None = None, frames: int = 50, low: float = -0.2, step: float = 0.03, bins: int = 47) -> DataFrame:
    """First frames with fret in each fret bin: (by, bin, n)."""
    part = points.filter((F.col("frame") <= frames) & (F.col("fret") != 0))
    return part.groupBy(*(by or ["dataset"]), seq.bin_of(F.round("fret", 6), low, step, bins).alias("bin")).agg(F.count("*").alias("n"))


def fret_histogram(points: DataFrame, by: list[str] | None = None, frames: int = 50, low: float = -0.2, step: float = 0.03, bins: int = 47) -> DataFrame:
    """fret of frames with fret, first frames only, in percent: (by, bin, percent)."""
    by = by or ["dataset"]
    n = histogram_counts(points, by, frames, low, step, bins)
    return n.select(*by, "bin", (100 * F.col("n") / F.sum("n").over(Window.partitionBy(*by))).alias("percent"))


def live_frames(points: DataFrame, idl: DataFrame, dark: int = 1) -> DataFrame:
    """points with fret 0 where a state assignment has the dark state or none, as histograms leave such frames out."""
    lit = points.join(idl.filter((F.col("state") > 0) & (F.col("state") != dark)).select(*KEYS, "frame", F.lit(True).alias("__lit")), [*KEYS, "frame"], "left")
    return lit.withColumn("fret", F.when(F.col("__lit"), F.col("fret")).otherwise(0.0)).drop("__lit")


def fret_histogram_with_errors(points: DataFrame, resamples: int = 100, frames: int = 50, low: float = -0.2, step: float = 0.03, bins: int = 47) -> DataFrame:
    """fret_histogram() of each dataset with the standard deviation of each bin over resampled traces: (dataset, bin, percent, se).

    Traces are drawn with replacement by dwell.bootstrap_sums(): each trace's own histogram is counted once and weighted, so
    frames are not multiplied. Bins that a resample leaves empty count as 0 there.
    """
    own = histogram_counts(points, KEYS, frames, low, step, bins)
    weighted = dwell.bootstrap_sums(own, ["bin"], ["n"], resamples)
    shares = weighted.select("dataset", "bin", "b", (100 * F.col("n") / F.sum("n").over(Window.partitionBy("dataset", "b"))).alias("p"))
    # Resamples without the bin are zeros: the spread follows from sums and the number of resamples.
    spread = shares.groupBy("dataset", "bin").agg(F.sum("p").alias("s1"), F.sum(F.col("p") ** 2).alias("s2"))
    se = F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") ** 2 / resamples) / (resamples - 1)))
    return fret_histogram(points, ["dataset"], frames, low, step, bins).join(spread.select("dataset", "bin", se.alias("se")), ["dataset", "bin"], "left").withColumn("se", F.coalesce("se", F.lit(0.0)))


def mean_fret_by_frame(points: DataFrame, low: float = 0.175, high: float = 1.2, frames: int = 300) -> DataFrame:
    """Mean fret of the frames within [low, high), from an exact sum (in units of 2^-55), so that no order of the rows shows in it."""
    exact = F.sum((F.col("fret") * 2.0**55).cast("long").cast("decimal(19,0)")).cast("double") / 2.0**55
    return points.filter((F.col("fret") >= low) & (F.col("fret") < high) & (F.col("frame") <= frames)).groupBy("dataset", "frame").agg((exact / F.count("*")).alias("mean_fret"))


def median_fret(points: DataFrame, low: float = 0.2, frames: int = 100) -> DataFrame:
    return ranks.percentile(points.filter((F.col("fret") > low) & (F.col("frame") <= frames)), ["dataset"], "fret", 0.5, "median_fret")


def fret_stoichiometry(points: DataFrame, low: float = -0.1, step: float = 0.03, bins: int = 43) -> DataFrame:
    """Two-dimensional histogram of frames with fret, left-closed bins, summing to 1: (dataset, fret_bin, s_bin, share)."""
    at = lambda c: (F.floor(F.round((F.col(c) - low) / step, 6)) + 1).cast("int")
    n = points.filter("fret != 0").select("dataset", at("fret").alias("fret_bin"), at("stoichiometry").alias("s_bin")).filter(F.col("fret_bin").between(1, bins) & F.col("s_bin").between(1, bins)).groupBy("dataset", "fret_bin", "s_bin").agg(F.count("*").alias("n"))
    return n.select("dataset", "fret_bin", "s_bin", (F.col("n") / F.sum("n").over(Window.partitionBy("dataset"))).alias("share"))


def fluorescence_correlation(points: DataFrame, least_fret: float = 0.18, frames: int = 100, alive: int = 100, lags: int = 50) -> DataFrame:
    """Mean over traces of the donor-acceptor correlation over alive frames: (dataset, lag, value, n)."""
    df = points.filter(F.col("frame") <= frames).withColumn("__on", F.col("fret") > least_fret).withColumn("__alive", seq.erode3("__on"))
    part = df.filter("__alive").withColumn("__n", F.count("*").over(seq.whole())).filter(F.col("__n") >= alive)
    each = seq.cross_correlation(part, "donor", "acceptor", lags)
    return each.groupBy("dataset", "lag").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def post_sync(points: DataFrame, idl: DataFrame, least: int = 3, before: int = 5, total: int = 50, on_state: int = 2) -> DataFrame:
    """Every dwell of at least on_state and of `least` frames, but a trace's first, as a trace of its own, `before` frames ahead of it.

    (dataset, trace_id, event, frame, fret); frames beyond the dwell, or the trace, are 0, to `total` frames.
    """
    on = idl.withColumn("state", F.when(F.col("state") >= on_state, 2).otherwise(1))
    w = Window.partitionBy(*KEYS).orderBy("dwell_no")
    d = to_dwells(on).withColumn("ahead", F.lag("n_frames").over(w)).filter((F.col("state") == 2) & (F.col("n_frames") >= least) & F.col("ahead").isNotNull())
    d = d.withColumn("pre", F.least(F.lit(before), F.col("ahead"))).withColumn("event", F.row_number().over(w))
    grid = d.select(*KEYS, "event", "pre", "start_frame", "n_frames", F.explode(F.sequence(F.lit(1), F.lit(total))).alias("new"))
    at = F.col("new") - 1 - before + F.col("start_frame")
    grid = grid.withColumn("frame", at).withColumn("inside", (at >= F.col("start_frame") - F.col("pre")) & (at < F.col("start_frame") + F.col("n_frames")))
    out = grid.join(points.select(*KEYS, "frame", "fret"), [*KEYS, "frame"], "left")
    return out.select(*KEYS, "event", F.col("new").alias("frame"), F.when(F.col("inside"), F.coalesce("fret", F.lit(0.0))).otherwise(0.0).alias("fret"))


def simple_post_sync(points: DataFrame, threshold: float, before: int = 5, total: int = 50) -> DataFrame:
    """Traces shifted so that their first frame at or above the threshold is frame before + 1; missing frames are 0."""
    first = points.groupBy(*KEYS).agg(F.min(F.when(F.col("fret") >= threshold, F.col("frame"))).alias("first")).filter("first is not null")
    grid = first.select(*KEYS, "first", F.explode(F.sequence(F.lit(1), F.lit(total))).alias("new")).withColumn("frame", F.col("new") - 1 - before + F.col("first"))
    return grid.join(points.select(*KEYS, "frame", "fret"), [*KEYS, "frame"], "left").select(*KEYS, F.col("new").alias("frame"), F.coalesce("fret", F.lit(0.0)).alias("fret"))


def percent_with_fret(stats: DataFrame, least: float = 0.2) -> DataFrame:
    """Percent of each dataset's traces whose mean fret is above `least`."""
    return stats.groupBy("dataset").agg((100 * F.count_if(F.col("avg_fret") > least) / F.count("*")).alias("percent"))


def over_datasets(values: DataFrame, column: str) -> DataFrame:
    """Mean and standard deviation of a column over datasets, and how many there are."""
    return values.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.count(column).alias("n"))


def photobleaching(stats: DataFrame, bins: int = 40) -> dict[str, DataFrame]:
    """curves: lifetime_curves() of donor and acceptor (kind); summary: mean intensity t, and each curve's time constant in bins."""
    stats = settle(stats)
    curves = lifetime_curves(stats, "donorlife", bins).withColumn("kind", F.lit("donor")).unionByName(lifetime_curves(stats, "acclife", bins).withColumn("kind", F.lit("acceptor")))
    taus = fits.exponential_fits(curves, ["dataset", "kind"], "bin", "left").groupBy("dataset").agg(*[F.max(F.when(F.col("kind") == k, F.col("tau"))).alias(f"{k}_tau") for k in ("donor", "acceptor")])
    return {"curves": curves, "summary": stats.groupBy("dataset").agg(F.avg("t").alias("mean_t")).join(taus, "dataset")}


def lifetime_curves(stats: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """One less the cumulative share of traces by a statistic, on `bins` bins up to its greatest value: (dataset, bin, left)."""
    stats = settle(stats.select("dataset", column))
    top = stats.agg(F.max(column).alias("top"))
    at = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(F.round(F.coalesce(F.try_divide(F.col(column) * bins, F.col("top")), F.lit(0.0)), 6)))).cast("int")
    n = stats.crossJoin(F.broadcast(top)).groupBy("dataset", at.alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("dataset")
    return n.select("dataset", "bin", (1 - F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)).alias("left"))
