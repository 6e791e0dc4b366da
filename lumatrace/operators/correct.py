"""Corrections: baseline, crosstalk, scale, gamma, direct excitation, flat field."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatrace.functions import ranks, seq
from lumatrace.operators.select import gaussian_center
from lumatrace.schema import CONSTANTS, KEYS


def subtract_background(points: DataFrame, channels: tuple[str, ...] = ("donor", "acceptor")) -> DataFrame:
    """Each channel less its mean over the frames from 5 after the lifetime on, if there are 10 or more. fret stays as it is."""
    t = seq.whole()
    df = seq.with_lifetime(points.withColumn("__total", F.col("donor") + F.col("acceptor")), "__total", "__lt")
    tail = F.col("frame").between(F.col("__lt") + 5, F.col("__lt") + 5 + CONSTANTS.background_frames)
    df = df.withColumn("__n", F.count(F.when(tail, 1)).over(t))
    for c in channels:
        df = df.withColumn(f"__{c}", F.avg(F.when(tail, F.col(c))).over(t))
    for c in channels:
        df = df.withColumn(c, F.col(c) - F.when(F.col("__n") >= 10, F.col(f"__{c}")).otherwise(0.0))
    return df.drop("__total", "__lt", "__n", *[f"__{c}" for c in channels])


def rescale(points: DataFrame, crosstalk: dict[tuple[str, str], float], scale: dict[str, float], undo: tuple[dict, dict] | None = None) -> DataFrame:
    """Take back earlier corrections, then crosstalk from bluer to redder channels, then scale factors."""
    df = points
    if undo:
        old_talk, old_scale = undo
        for c, k in old_scale.items():
            df = df.withColumn(c, F.col(c) / k)
        for (src, dst), k in reversed(list(old_talk.items())):
            df = df.withColumn(dst, F.col(dst) + k * F.col(src))
    for (src, dst), k in crosstalk.items():
        df = df.withColumn(dst, F.col(dst) - k * F.col(src))
    for c, k in scale.items():
        df = df.withColumn(c, F.col(c) * k)
    return df


def recompute_fret(points: DataFrame) -> DataFrame:
    """fret anew; frames where it was 0 keep 0."""
    value = F.coalesce(F.try_divide(F.col("acceptor"), F.col("donor") + F.col("acceptor")), F.lit(0.0))
    return points.withColumn("fret", F.when(F.col("fret") == 0, 0.0).otherwise(value))


def crosstalk_by_trace(points: DataFrame, low: float = -0.1, high: float = 0.25) -> DataFrame:
    """Acceptor over donor, means of 15 frames that end two before the last with fret: (keys, crosstalk), those in (low, high)."""
    t = seq.whole()
    df = points.withColumn("__d", F.max(F.when(F.col("fret") != 0, F.col("frame"))).over(t))
    part = df.filter((F.col("__d") >= 20) & F.col("frame").between(F.col("__d") - 16, F.col("__d") - 2))
    each = part.groupBy(*KEYS).agg(F.avg("acceptor").alias("a"), F.avg("donor").alias("d"), F.count_if(F.col("fret") == 0).alias("dark"))
    return each.filter("dark = 0").select(*KEYS, F.try_divide(F.col("a"), F.col("d")).alias("crosstalk")).filter((F.col("crosstalk") > low) & (F.col("crosstalk") < high))


def gamma_by_trace(points: DataFrame, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """Change of donor over change of acceptor when the acceptor bleaches: (keys, gamma), those in (low, high)."""
    t = seq.whole()
    df = seq.long_runs(points.withColumn("__on", F.col("fret") >= 0.2), "__on", "__lit")
    df = df.withColumn("a", F.max(F.when(F.col("__lit"), F.col("frame"))).over(t)).withColumn("d", F.max(F.when(F.col("fret") != 0, F.col("frame"))).over(t))
    df = df.filter((F.col("a") > 21) & (F.col("d") - F.col("a") > 21) & F.col("frame").between(F.col("a") - 21, F.col("d") - 1))
    pre, post = F.col("frame") < F.col("a"), F.col("frame") > F.col("a")
    mean = lambda when, c: F.avg(F.when(when, F.col(c)))
    each = df.groupBy(*KEYS).agg((mean(post, "donor") - mean(pre, "donor")).alias("dd"), (mean(pre, "acceptor") - mean(post, "acceptor")).alias("da"), F.count_if((F.col("fret") == 0) | (post & (F.col("fret") > 0.2))).alias("bad"))
    return each.filter("bad = 0").select(*KEYS, F.try_divide(F.col("dd"), F.col("da")).alias("gamma")).filter((F.col("gamma") > low) & (F.col("gamma") < high))


def ensemble_value(values: DataFrame, column: str, low: float, step: float, bins: int, use_median: bool = False) -> float | None:
    """One value of the ensemble: the centre of a Gaussian fitted to the histogram, or the median."""
    found = ranks.percentile(values, [], column, 0.5, "median").first()
    median = found and found[0]
    if use_median or median is None:
        return median
    counts = np.zeros(bins)
    for r in values.groupBy(seq.bin_of(F.col(column), low, step, bins).alias("b")).count().collect():  # at most `bins`
        counts[r.b - 1] = r["count"]
    centers = low + step * np.arange(bins)
    center, width = gaussian_center(centers, counts)
    return center if centers[0] <= center <= centers[-1] and np.isfinite(width) else median


def correct_crosstalk(points: DataFrame, value: float | None = None, use_median: bool = False) -> DataFrame:
    """Crosstalk taken off the acceptor, fret anew; without a value it is estimated from the traces (one job)."""
    k = ensemble_value(crosstalk_by_trace(points), "crosstalk", -0.1, 0.01, 36, use_median) if value is None else value
    return recompute_fret(rescale(points, {("donor", "acceptor"): k or 0.0}, {}))


def correct_by_parameters(points: DataFrame, traces: DataFrame) -> DataFrame:
    """Each trace's own crosstalk and scale (traces: keys, crosstalk, scale; null counts as 0 and 1) applied, fret anew."""
    own = traces.select(*KEYS, F.coalesce("crosstalk", F.lit(0.0)).alias("__c"), F.coalesce("scale", F.lit(1.0)).alias("__s"))
    df = points.join(own, KEYS, "left")
    value = (F.col("acceptor") - F.coalesce("__c", F.lit(0.0)) * F.col("donor")) * F.coalesce("__s", F.lit(1.0))
    return recompute_fret(df.withColumn("acceptor", value)).drop("__c", "__s")


def apply_reviewed(points: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Reviewed adjustments (keys, adjusted, background_donor, background_acceptor, crosstalk, gamma) of flagged traces; others stay.

    The baselines are taken off first, then crosstalk, then the acceptor is scaled; nulls change nothing.
    """
    names = ("background_donor", "background_acceptor", "crosstalk", "gamma")
    flags = adjustments.filter("adjusted").select(*KEYS, F.lit(True).alias("__flag"), *[F.col(c).alias(f"__{c}") for c in names])
    df, on = points.join(flags, KEYS, "left"), F.coalesce("__flag", F.lit(False))
    own = lambda c, default: F.coalesce(f"__{c}", F.lit(default))
    donor = F.col("donor") - own("background_donor", 0.0)
    acceptor = (F.col("acceptor") - own("background_acceptor", 0.0) - own("crosstalk", 0.0) * donor) * own("gamma", 1.0)
    df = df.withColumn("__d", F.when(on, donor).otherwise(F.col("donor"))).withColumn("acceptor", F.when(on, acceptor).otherwise(F.col("acceptor"))).withColumn("donor", F.col("__d"))
    return recompute_fret(df).drop("__flag", "__d", *[f"__{c}" for c in names])


def correct_gamma(points: DataFrame, value: float | None = None, use_median: bool = False) -> DataFrame:
    """The acceptor scaled by gamma, fret anew; without a value it is estimated from the traces (one job)."""
    k = ensemble_value(gamma_by_trace(points), "gamma", 0.0, 0.1, 101, use_median) if value is None else value
    return recompute_fret(rescale(points, {}, {"acceptor": k or 1.0}))


def correct_direct_excitation(points: DataFrame, fraction: float) -> DataFrame:
    """Where the mean of the last 6 non-zero fret (of more than 5) is under 0.075: acceptor less a fraction of the total."""
    back = F.row_number().over(seq.by_frame().orderBy(F.desc("frame")))
    last = points.filter("fret != 0").withColumn("__k", back).filter("__k <= 6").groupBy(*KEYS).agg(F.avg("fret").alias("__m"), F.count("*").alias("__n"))
    df = points.join(last.filter("__n > 5"), KEYS, "left")
    off = F.coalesce(F.col("__m") < 0.075, F.lit(False))
    return recompute_fret(df.withColumn("acceptor", F.col("acceptor") - F.when(off, fraction * (F.col("donor") + F.col("acceptor"))).otherwise(0.0))).drop("__m", "__n")


def flat_field(points: DataFrame, places: DataFrame) -> list[float]:
    """Six coefficients (1, x, y, x^2, xy, y^2) of acceptor over donor across the field, relative to its mean.

    Spark sums the normal equations over traces whose first 25 frames all have fret in (0.3, 0.7); the 6 x 6 solve is local.
    """
    first = points.filter("frame <= 25").groupBy(*KEYS).agg(F.avg("acceptor").alias("a"), F.avg("donor").alias("d"), F.bool_and((F.col("fret") > 0.3) & (F.col("fret") < 0.7)).alias("ok")).filter("ok")
    z = first.join(places, KEYS).select("dataset", (F.col("donor_x") / 1000).alias("x"), (F.col("donor_y") / 1000).alias("y"), F.try_divide(F.col("a"), F.col("d")).alias("r"))
    z = z.join(z.groupBy("dataset").agg(F.avg("r").alias("m")), "dataset").withColumn("z", F.col("r") / F.col("m"))
    x, y = F.col("x"), F.col("y")
    terms = [F.lit(1.0), x, y, x * x, x * y, y * y]
    sums = z.agg(*[F.sum(a * b) for i, a in enumerate(terms) for b in terms[i:]], *[F.sum(a * F.col("z")) for a in terms]).first()
    xtx, k = np.zeros((6, 6)), 0
    for i in range(6):
        for j in range(i, 6):
            xtx[i, j] = xtx[j, i] = sums[k] or 0.0
            k += 1
    return np.linalg.lstsq(xtx, np.array([v or 0.0 for v in sums[21:]]), rcond=None)[0].tolist()


def apply_flat_field(points: DataFrame, places: DataFrame, c: list[float], dy: float = 0.0) -> DataFrame:
    x, y = F.col("donor_x") / 1000, (F.col("donor_y") + dy) / 1000
    r = c[0] + c[1] * x + c[2] * y + c[3] * x * x + c[4] * x * y + c[5] * y * y
    return recompute_fret(points.join(places.select(*KEYS, r.alias("__r")), KEYS).withColumn("acceptor", F.try_divide(F.col("acceptor"), F.col("__r")))).drop("__r")


def manual_baseline(points: DataFrame, ranges: DataFrame, channel: str) -> DataFrame:
    """ranges (keys, low, high): the channel less its mean over those frames; other traces unchanged."""
    mean = points.join(ranges, KEYS).filter(F.col("frame").between(F.col("low"), F.col("high"))).groupBy(*KEYS).agg(F.avg(channel).alias("__b"))
    return points.join(mean, KEYS, "left").withColumn(channel, F.col(channel) - F.coalesce("__b", F.lit(0.0))).drop("__b")


def illumination_profile(points: DataFrame, places: DataFrame, size: float, bins: int = 24) -> DataFrame:
    """Mean intensity of the first 10 frames along x and along y: (axis, bin, mean, n)."""
    total = points.filter("frame <= 10").groupBy(*KEYS).agg(F.avg(F.col("donor") + F.col("acceptor")).alias("v")).join(places, KEYS)
    at = lambda c: F.least(F.lit(bins), F.floor(F.col(c) * bins / size) + 1).cast("int")
    long = total.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), at(c).alias("bin")) for a, c in (("x", "donor_x"), ("y", "donor_y"))])).alias("p"), "v")
    return long.groupBy("p.axis", "p.bin").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
