"""Diagnostics of dyes: which traces are single dyes, and how bright and how long they shine, with spreads over files.

Every table has a `condition`; a dataset (file) belongs to one. Limits come from all files of a condition together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions import ranks, seq
from lumatrace.operators import dwell, fits
from lumatrace.schema import KEYS
from lumatrace.session import settle


def background_histogram(stats: DataFrame, top: int = 300) -> DataFrame:
    """Traces by background level, those strictly between 0 and `top`, in bins of 1 centred on whole numbers: (condition, bin, n)."""
    part = stats.filter((F.col("bg") > 0) & (F.col("bg") < top))
    return part.groupBy("condition", seq.bin_of(F.round("bg", 9), 0.0, 1.0, top + 1).alias("bin")).agg(F.count("*").alias("n"))


def background_limits(stats: DataFrame, widths: float = 4.0, top: int = 300) -> DataFrame:
    """(condition, center, width, limit): limit is so many widths above the peak of the Gaussian through background_histogram()."""
    peaks = fits.gaussian_fits(background_histogram(stats, top), ["condition"], "bin", "n", 0.0, 1.0, top + 1)
    return peaks.select("condition", "center", "width", (F.col("center") + widths * F.col("width")).alias("limit"))


def extreme_limits(stats: DataFrame) -> DataFrame:
    """(condition, t_max, snr_max): the sorted t and snr_s at place floor(0.99 n) - 1, counted from 1; null where there is none."""
    stats = settle(stats.select("condition", "t", "snr_s"))
    place = lambda n: F.when(F.floor(n * 0.99) >= 2, F.floor(n * 0.99) - 2)
    filled = stats.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("t", "snr_s")})
    a, b = (ranks.percentile(filled, ["condition"], c, 0.99, name, rank=place) for c, name in (("t", "t_max"), ("snr_s", "snr_max")))
    return a.join(b, "condition")


def single_dyes(stats: DataFrame, least_snr: float = 10.0, remove_high_background: bool = True) -> DataFrame:
    """Rows of stats that look like one dye: snr above the least, no overlap, t and snr_s above 0 and below extreme_limits(),
    background below background_limits() (no limit where no Gaussian fits). Comparisons are strict; null statistics reject."""
    stats = settle(stats)
    df = stats.join(extreme_limits(stats), "condition").filter((F.col("snr") > least_snr) & (F.col("overlap") == 0))
    df = df.filter((F.col("t") > 0) & (F.col("snr_s") > 0) & F.coalesce(F.col("t") < F.col("t_max"), F.lit(True)) & F.coalesce(F.col("snr_s") < F.col("snr_max"), F.lit(True)))
    if remove_high_background:
        df = df.join(background_limits(stats).select("condition", "limit"), "condition", "left").filter(F.coalesce(F.col("bg") < F.col("limit"), F.lit(True))).drop("limit")
    return df.drop("t_max", "snr_max")


def steady(transitions: DataFrame) -> DataFrame:
    """Traces (condition, keys, transitions) that switch at least once, and less often than the condition's mean plus two standard deviations."""
    m = transitions.groupBy("condition").agg(F.avg("transitions").alias("__m"), F.coalesce(F.stddev_samp("transitions"), F.lit(0.0)).alias("__s"))
    return transitions.join(m, "condition").filter((F.col("transitions") > 0) & ((F.col("__s") == 0) | (F.col("transitions") < F.col("__m") + 2 * F.col("__s")))).drop("__m", "__s")


def transitions_of(dwells: DataFrame) -> DataFrame:
    """(keys, transitions): dwells of each trace less one."""
    return dwells.groupBy(*KEYS).agg((F.count("*") - 1).alias("transitions"))


def less_final_dark(dwells: DataFrame, dark: int = 1) -> DataFrame:
    """dwells without a trace's last one if it is dark: the bleached state."""
    last = F.max("dwell_no").over(Window.partitionBy(*KEYS))
    return dwells.withColumn("__last", last).filter((F.col("dwell_no") < F.col("__last")) | (F.col("state") != dark)).drop("__last")


def over_files(values: DataFrame, statistic: str = "mean", resamples: int = 100) -> DataFrame:
    """(condition, value, sd, files): mean over files of each file's statistic, and its standard deviation over files.

    values: condition, keys, x; statistic: mean or median (exact). A condition with one file has the bootstrap's standard
    deviation instead: its traces drawn with replacement.
    """
    if statistic == "mean":
        each = values.groupBy("condition", "dataset").agg(F.avg("x").alias("v"))
    else:
        each = ranks.percentile(values, ["condition", "dataset"], "x", 0.5, "v")
    files = each.groupBy("condition").agg(F.avg("v").alias("value"), F.stddev_samp("v").alias("sd"), F.count("*").alias("files"))
    alone = values.join(files.filter("files = 1").select("condition"), "condition", "left_semi").filter("x is not null")
    draws = dwell.bootstrap_draws(alone, resamples)
    own = F.sum(F.col("w") * F.col("x")) / F.sum("w") if statistic == "mean" else F.percentile("x", F.lit(0.5), F.col("w"))
    spread = draws.groupBy("condition", "b").agg(own.alias("v")).groupBy("condition").agg(F.stddev_samp("v").alias("__sd"))
    return files.join(spread, "condition", "left").select("condition", "value", F.coalesce("sd", "__sd").alias("sd"), "files")


def shining(points: DataFrame, dwells: DataFrame, sampling_ms: float, on: int = 2) -> tuple[DataFrame, DataFrame]:
    """By trace (condition, keys, total_on in seconds, photons), and the mean light by frame (condition, frame, photons).

    points: condition, keys, frame, total; dwells: of the same traces. Traces without an on dwell count as 0.
    """
    seen = dwell.on_frames(dwells.filter(F.col("state") == on), points).withColumn("__v", F.when(F.col("state") > 0, F.col("total")).otherwise(0.0))
    each = seen.groupBy("condition", *KEYS).agg((F.count_if(F.col("state") > 0) * sampling_ms / 1000).alias("total_on"), F.sum("__v").alias("photons"))
    return each, seen.groupBy("condition", "frame").agg(F.avg("__v").alias("photons"))
