"""Selection of traces: criteria, samples, places, reviewed labels."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumatrace.functions import ranks, seq
from lumatrace.schema import KEYS
from lumatrace.session import settle


def criteria_predicate(criteria: dict[str, float | None]) -> Column:
    """min_ and max_ are strict, eq_ is equality; null values and unknown prefixes are passed over; a null statistic rejects."""
    out = F.lit(True)
    for name, value in criteria.items():
        kind, _, stat = name.partition("_")
        if value is not None and kind in ("min", "max", "eq"):
            c = F.col(stat)
            out = out & F.coalesce(c > value if kind == "min" else c < value if kind == "max" else c == value, F.lit(False))
    return out


def criteria_from(spark: SparkSession, path: str) -> dict[str, float | None]:
    """Criteria from a JSON file: {"min_snr": 8, "max_bg": null, ...}."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def pick(stats: DataFrame, criteria: dict[str, float | None]) -> DataFrame:
    return stats.filter(criteria_predicate(criteria))


def gaussian_center(centers: np.ndarray, counts: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Centre and width (the c of exp(-((x - b) / c)^2)) of a histogram's peak: Gauss-Newton from its moments."""
    total = counts.sum()
    b = float((centers * counts).sum() / total)
    c = float(np.sqrt(2 * ((centers - b) ** 2 * counts).sum() / total)) or 1.0
    a = float(counts.max())
    for _ in range(steps):
        e = np.exp(-(((centers - b) / c) ** 2))
        jac = np.stack([e, a * e * 2 * (centers - b) / c**2, a * e * 2 * (centers - b) ** 2 / c**3], axis=1)
        step = np.linalg.lstsq(jac, counts - a * e, rcond=None)[0]
        a, b, c = a + step[0], b + step[1], abs(c + step[2]) or 1e-9
        if np.abs(step).max() < 1e-10:
            break
    return b, c


def within_sigma(stats: DataFrame, k: float, column: str = "t", bins: int = 51) -> DataFrame:
    """Traces whose intensity lies within k widths of the peak of a Gaussian fitted to its histogram.

    The histogram holds values above 0 in bins centred on 0 to the greatest value; any trace may then be picked.
    """
    stats = settle(stats)
    top = stats.agg(F.max(column)).first()[0]
    if top is None or top <= 0:
        return stats.limit(0)
    step = top / (bins - 1)
    rows = stats.filter(F.col(column) > 0).groupBy(seq.bin_of(F.col(column), 0.0, step, bins).alias("b")).count().collect()  # at most `bins`
    counts = np.zeros(bins)
    for r in rows:
        counts[r.b - 1] = r["count"]
    b, c = gaussian_center(step * np.arange(bins), counts / counts.sum())
    return stats.filter(F.abs(F.col(column) - b) < k * c)


def keep_percent(traces: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    """The floor of p percent of the traces, drawn by a hash of their keys; the same for any partitioning.

    Hashes are cut into 4096 ranges and counted; whole ranges below the limit pass, and only the limit's own is ordered.
    """
    h = F.md5(F.concat_ws("#", *KEYS, F.lit(seed)))
    df = traces.withColumn("__h", h).withColumn("__r", F.substring("__h", 1, 3))
    counts = df.groupBy("__r").agg(F.count("*").alias("n"))  # at most 4096 rows
    total = F.sum("n").over(Window.partitionBy())
    limit = F.floor(total * percent / 100)
    before = F.sum("n").over(Window.orderBy("__r")) - F.col("n")
    plan = counts.select("__r", before.alias("__before"), limit.alias("__limit"))
    df = df.join(F.broadcast(plan), "__r").filter(F.col("__before") < F.col("__limit"))
    rank = F.row_number().over(Window.partitionBy("__r").orderBy("__h", *KEYS))
    return df.withColumn("__k", rank).filter(F.col("__before") + F.col("__k") <= F.col("__limit")).drop("__h", "__r", "__before", "__limit", "__k")


def center_quadrant(places: DataFrame) -> DataFrame:
    """Strictly within one and three quarters of the greatest x and y of the dataset."""
    top = places.groupBy("dataset").agg(F.max("donor_x").alias("mx"), F.max("donor_y").alias("my"))
    x, y = F.col("donor_x"), F.col("donor_y")
    return places.join(top, "dataset").filter((x > F.col("mx") / 4) & (x < 3 * F.col("mx") / 4) & (y > F.col("my") / 4) & (y < 3 * F.col("my") / 4)).drop("mx", "my")


def rectangle(places: DataFrame, nx: float, ny: float, margin: float = 0.25) -> DataFrame:
    x, y = F.col("donor_x"), F.col("donor_y")
    return places.filter((x > nx * margin) & (x < nx * (1 - margin)) & (y > ny * margin) & (y < ny * (1 - margin)))


def by_rates(traces: DataFrame, rates: DataFrame, low: float, high: float) -> DataFrame:
    """Traces with no rate outside (low, high)."""
    bad = rates.filter((F.col("k") <= low) | (F.col("k") >= high) | F.col("k").isNull()).select(*KEYS).distinct()
    return traces.join(bad, KEYS, "left_anti")


def by_dwell_count(dwells: DataFrame, low: int, high: int, double_count: bool = False) -> DataFrame:
    """Keys of traces with low to high dwells, both included; double_count counts each twice, as older analyses did."""
    n = F.count("*") * (2 if double_count else 1)
    return dwells.groupBy(*KEYS).agg(n.alias("n_dwells")).filter(F.col("n_dwells").between(low, high))


def by_class_frames(idl: DataFrame, least: dict[int, int]) -> DataFrame:
    """Keys of traces with at least so many frames in each class."""
    n = idl.groupBy(*KEYS).agg(*[F.count_if(F.col("state") == s).alias(f"n{s}") for s in least])
    for s, k in least.items():
        n = n.filter(F.col(f"n{s}") >= k)
    return n.select(*KEYS)


def by_state_means(idl: DataFrame, separation: float = 0.12, frames: int = 1000) -> DataFrame:
    """Keys of traces whose states' mean fret all lie within `separation` of the states' medians over traces."""
    m = idl.filter((F.col("frame") <= frames) & (F.col("state") > 0)).groupBy(*KEYS, "state").agg(F.avg("fret").alias("m"))
    mid = ranks.percentile(m, ["dataset", "state"], "m", 0.5, "mid")
    return m.join(mid, ["dataset", "state"]).groupBy(*KEYS).agg(F.bool_and(F.abs(F.col("m") - F.col("mid")) <= separation).alias("ok")).filter("ok").select(*KEYS)


def productive(dwells: DataFrame, state: int, least: int) -> DataFrame:
    """Keys and whether any dwell in a state lasts at least so many frames."""
    return dwells.groupBy(*KEYS).agg(F.coalesce(F.bool_or((F.col("state") == state) & (F.col("n_frames") >= least)), F.lit(False)).alias("productive"))


def representative(stats: DataFrame) -> DataFrame:
    """Traces like the average: t within 0.2 standard deviations, donorlife within a tenth, background under twice the median, no overlap."""
    stats = settle(stats)
    d = stats.groupBy("dataset").agg(F.avg("t").alias("__mt"), F.stddev_samp("t").alias("__st"), F.avg("donorlife").alias("__ml")).join(ranks.percentile(stats, ["dataset"], "bg", 0.5, "__mb"), "dataset")
    ok = (F.abs(F.col("t") - F.col("__mt")) < 0.2 * F.col("__st")) & (F.abs(F.col("donorlife") - F.col("__ml")) < 0.1 * F.col("__ml")) & (F.col("bg") < 2 * F.col("__mb")) & (F.col("overlap") == 0)
    return stats.join(d, "dataset").filter(ok).drop("__mt", "__st", "__ml", "__mb")


def by_day(places: DataFrame) -> DataFrame:
    """day: the recording's path up to its last slash."""
    return places.withColumn("day", F.regexp_extract("ids", r"^(.*[/\\])", 1))


def printed_spots(places: DataFrame, nx: float, ny: float, k: float = 1.9) -> DataFrame:
    """Quadrant A to D by half the field, then those within k standard deviations of the quadrant's centre, as an ellipse."""
    left, low = F.col("donor_x") <= nx / 2, F.col("donor_y") <= ny / 2
    df = places.withColumn("quadrant", F.when(left & low, "A").when(~left & low, "B").when(left, "C").otherwise("D"))
    m = df.groupBy("dataset", "quadrant").agg(*[f(c).alias(n) for c, a, b in (("donor_x", "mx", "sx"), ("donor_y", "my", "sy")) for f, n in ((F.avg, a), (F.stddev_samp, b))])
    far = ((F.col("donor_x") - F.col("mx")) / F.col("sx")) ** 2 + ((F.col("donor_y") - F.col("my")) / F.col("sy")) ** 2
    return df.join(m, ["dataset", "quadrant"]).filter(far < k**2).drop("mx", "my", "sx", "sy")


def in_circles(places: DataFrame, circles: DataFrame, cell: float = 256.0) -> DataFrame:
    """Places within a circle (quadrant, cx, cy, r), or only those of its dataset if circles name it.

    They meet through grid cells: a circle is sent to those that it may reach, a place to its own.
    """
    by = ["dataset"] if "dataset" in circles.columns else []
    at = lambda x: F.floor(x / cell).cast("long")
    reach = lambda c: F.explode(F.sequence(at(F.col(c) - F.col("r")), at(F.col(c) + F.col("r"))))
    spread = circles.withColumn("__gx", reach("cx")).withColumn("__gy", reach("cy"))
    hit = F.hypot(F.col("donor_x") - F.col("cx"), F.col("donor_y") - F.col("cy")) <= F.col("r")
    own = places.withColumn("__gx", at(F.col("donor_x"))).withColumn("__gy", at(F.col("donor_y")))
    return own.join(spread, [*by, "__gx", "__gy"]).filter(hit).drop("cx", "cy", "r", "__gx", "__gy")


def without(traces: DataFrame, picked: DataFrame) -> DataFrame:
    """The inverted selection: traces that were not picked."""
    return traces.join(picked.select(*KEYS), KEYS, "left_anti")


def flagged(traces: DataFrame, excluded: DataFrame | None = None, everything: bool = False) -> DataFrame:
    """traces with `included`: false for those in `excluded`; for all (everything) or none where no table is given."""
    if excluded is None:
        return traces.withColumn("included", F.lit(not everything))
    marks = excluded.select(*KEYS).distinct().withColumn("__out", F.lit(True))
    return traces.join(marks, KEYS, "left").withColumn("included", F.col("__out").isNull()).drop("__out")


def review_bins(points: DataFrame, labels: DataFrame) -> DataFrame:
    """All frames of each labelled trace (labels: keys, bin), once for each bin it is in."""
    return points.join(labels.select(*KEYS, "bin").distinct(), KEYS)


def save_review_bins(points: DataFrame, labels: DataFrame, path: str, mode: str = "overwrite") -> None:
    """review_bins() as Parquet, a folder for each bin, traces in order."""
    review_bins(points, labels).repartition("bin", *KEYS).sortWithinPartitions("bin", *KEYS, "frame").write.mode(mode).partitionBy("bin").parquet(path)


def labelled(traces: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    return traces.join(labels.filter(F.col("bin") == name).select(*KEYS), KEYS, "left_semi")


def not_done(inputs: DataFrame, done: DataFrame, key: str = "dataset") -> DataFrame:
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def below_order_statistic(stats: DataFrame, column: str, share: float = 0.99) -> DataFrame:
    """Rows whose statistic is below the dataset's sorted value at `share` of its length."""
    stats = settle(stats)
    ranked = ranks.percentile(stats, ["dataset"], column, share, "__lim", discrete=True)
    return stats.join(ranked, "dataset").filter(F.col(column) < F.col("__lim")).drop("__lim")


def dye_filter(stats: DataFrame, events: DataFrame, most_background: float, least_snr: float = 10.0) -> DataFrame:
    """Single dyes: low background, intensity and noise ratio below their 99th percentiles, no overlap, and a number of
    transitions (events: keys, events) above 0 and below mean plus two standard deviations."""
    calm = below_order_statistic(below_order_statistic(stats.filter((F.col("bg") < most_background) & (F.col("overlap") == 0)), "t"), "snr_s").filter(F.col("snr") > least_snr)
    df = settle(calm.join(events.select(*KEYS, "events"), KEYS))
    m = df.groupBy("dataset").agg((F.avg("events") + 2 * F.stddev_samp("events")).alias("__lim"))
    return df.join(m, "dataset").filter((F.col("events") > 0) & (F.col("events") < F.col("__lim"))).drop("__lim")


def fit_circles(edges: DataFrame, by: list[str], samples: int = 200, within: float = 12.0, least: int = 10, radius: tuple[float, float] = (205.0, 280.0)) -> DataFrame:
    """The circle through three edge points (by, id, x, y) with the most points near it: (by, cx, cy, r, inliers).

    Triples are drawn by hash: every sample number picks, of each group's points, the three with the least hashes. The
    edge points of one field are few; samples are a fixed number.
    """
    draws = edges.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("h", F.xxhash64("id", "s"))
    three = draws.groupBy(*by, "s").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "x", "y"))), 1, 3).alias("p")).filter(F.size("p") == 3)
    x1, y1, x2, y2, x3, y3 = (F.col("p")[i][c] for i in range(3) for c in ("x", "y"))
    d = 2 * (x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2))
    s1, s2, s3 = x1 * x1 + y1 * y1, x2 * x2 + y2 * y2, x3 * x3 + y3 * y3
    circles = three.select(*by, "s", F.try_divide(s1 * (y2 - y3) + s2 * (y3 - y1) + s3 * (y1 - y2), d).alias("cx"), F.try_divide(s1 * (x3 - x2) + s2 * (x1 - x3) + s3 * (x2 - x1), d).alias("cy"), x1.alias("x1"), y1.alias("y1"))
    circles = circles.withColumn("r", F.hypot(F.col("x1") - F.col("cx"), F.col("y1") - F.col("cy"))).filter(F.col("r").between(*radius)).drop("x1", "y1")
    near = F.abs(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r")) <= within
    scored = edges.join(circles, by).groupBy(*by, "s", "cx", "cy", "r").agg(F.count_if(near).alias("inliers")).filter(F.col("inliers") >= least)
    return scored.groupBy(*by).agg(F.max_by(F.struct("cx", "cy", "r", "inliers"), F.struct("inliers", -F.col("s"))).alias("c")).select(*by, "c.*")


def spot_edges(places: DataFrame, cell: float = 16.0, least: int = 1) -> DataFrame:
    """Grid cells that hold molecules beside one that holds none, as edge points: (dataset, id, x, y)."""
    cx, cy = F.floor(F.col("donor_x") / cell), F.floor(F.col("donor_y") / cell)
    full = places.groupBy("dataset", cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    sides = full.select("dataset", "cx", "cy", F.explode(steps).alias("s")).select("dataset", F.col("cx").alias("ox"), F.col("cy").alias("oy"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    open_ = sides.join(full.select("dataset", "cx", "cy"), ["dataset", "cx", "cy"], "left_anti").select("dataset", F.col("ox").alias("cx"), F.col("oy").alias("cy")).distinct()
    return open_.select("dataset", (F.col("cx") * 100_000 + F.col("cy")).cast("long").alias("id"), ((F.col("cx") + 0.5) * cell).alias("x"), ((F.col("cy") + 0.5) * cell).alias("y"))
