"""Movie operators on pixel tables (movie, frame, channel, y, x, intensity)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_channels(pixels: DataFrame, tile_w: int, tile_h: int, tiles_x: int) -> DataFrame:
    """Side-by-side tiles as channels 1, 2, ... in row order, coordinates within the tile."""
    channel = (F.floor(F.col("y") / tile_h) * tiles_x + F.floor(F.col("x") / tile_w) + 1).cast("int")
    return pixels.withColumn("channel", channel).withColumn("x", F.col("x") % tile_w).withColumn("y", F.col("y") % tile_h)


def stack_average(pixels: DataFrame, first: int = 10) -> DataFrame:
    return pixels.filter(F.col("frame") <= first).groupBy("movie", "channel", "y", "x").agg(F.avg("intensity").alias("intensity"))


def block_background(image: DataFrame, size: int = 6) -> DataFrame:
    """The pixel at a sixth of each block's sorted values, for the whole block: (movie, channel, by, bx, background)."""
    w = Window.partitionBy("movie", "channel", "by", "bx")
    rank = F.row_number().over(w.orderBy("intensity", "y", "x"))
    df = image.withColumn("by", F.floor(F.col("y") / size).cast("int")).withColumn("bx", F.floor(F.col("x") / size).cast("int"))
    df = df.withColumn("k", rank).withColumn("want", F.greatest(F.lit(1), F.floor(0.167 * F.count("*").over(w))))
    return df.filter("k = want").select("movie", "channel", "by", "bx", F.col("intensity").alias("background"))


def background_noise(pixels: DataFrame, share: float = 0.75) -> DataFrame:
    """Standard deviation of the lowest three quarters of pixels of the last frames but one, channels summed."""
    last = pixels.groupBy("movie").agg(F.max("frame").alias("__last"))
    part = pixels.join(last, "movie").filter(F.col("frame").between(F.col("__last") - 11, F.col("__last") - 1))
    image = part.groupBy("movie", "y", "x").agg((F.sum("intensity") / F.countDistinct("frame")).alias("v"))
    limit = image.groupBy("movie").agg(F.percentile("v", share).alias("lim"))
    return image.join(limit, "movie").filter("v <= lim").groupBy("movie").agg(F.stddev_samp("v").alias("noise"))


def pick_peaks(image: DataFrame, threshold: float, edge: int = 3) -> DataFrame:
    """Pixels above the threshold, and above all four neighbours (equal ones: only the first in row order), off the edges."""
    row, col = Window.partitionBy("movie", "channel", "y").orderBy("x"), Window.partitionBy("movie", "channel", "x").orderBy("y")
    v = F.col("intensity")
    before = [F.lag("intensity").over(row), F.lag("intensity").over(col)]
    after = [F.lead("intensity").over(row), F.lead("intensity").over(col)]
    df = image
    for i, c in enumerate(before + after):
        df = df.withColumn(f"__{i}", c)
    top = (v > threshold) & F.coalesce(v > F.col("__0"), F.lit(True)) & F.coalesce(v > F.col("__1"), F.lit(True)) & F.coalesce(v >= F.col("__2"), F.lit(True)) & F.coalesce(v >= F.col("__3"), F.lit(True))
    size = image.groupBy("movie", "channel").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    inside = (F.col("x") >= edge) & (F.col("y") >= edge) & (F.col("x") <= F.col("mx") - edge) & (F.col("y") <= F.col("my") - edge)
    return df.filter(top).join(size, ["movie", "channel"]).filter(inside).select("movie", "channel", "x", "y", "intensity")


def neighbourhood(image: DataFrame, peaks: DataFrame, half: int) -> DataFrame:
    """The pixels around each peak (movie, channel, mol_id, x, y): with dx, dy and intensity."""
    d = F.sequence(F.lit(-half), F.lit(half))
    cells = peaks.select("movie", "channel", "mol_id", "x", "y", F.explode(d).alias("dx")).select("*", F.explode(d).alias("dy"))
    cells = cells.select("movie", "channel", "mol_id", "dx", "dy", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    return cells.join(image.select("movie", "channel", "x", "y", "intensity"), ["movie", "channel", "x", "y"])


def centroids(image: DataFrame, peaks: DataFrame, half: int = 1) -> DataFrame:
    """Intensity-weighted position in the block around each peak, less the block's least value."""
    hood = neighbourhood(image, peaks, half)
    low = F.min("intensity").over(Window.partitionBy("movie", "channel", "mol_id"))
    w = F.col("intensity") - low
    m = hood.withColumn("w", w).groupBy("movie", "channel", "mol_id").agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("cx"), F.try_divide(F.sum(F.col("y") * F.col("w")), F.sum("w")).alias("cy"))
    return m


def move_peaks(peaks: DataFrame, affine: tuple[float, float, float, float, float, float], channel: int, nx: int, ny: int, margin: int = 2) -> DataFrame:
    """Peaks in another channel by an affine map about the image's centre, rounded; those near the edge are dropped."""
    a, b, c, d, e, f = affine
    px, py = F.col("x") - (nx - 1) / 2, F.col("y") - (ny - 1) / 2
    x = F.floor(a * px + b * py + c + (nx - 1) / 2 + 0.5).cast("int")
    y = F.floor(d * px + e * py + f + (ny - 1) / 2 + 0.5).cast("int")
    out = peaks.select("movie", "mol_id", F.lit(channel).alias("channel"), x.alias("x"), y.alias("y"))
    return out.filter((F.col("x") >= margin) & (F.col("y") >= margin) & (F.col("x") < nx - margin) & (F.col("y") < ny - margin))


def align(source: DataFrame, target: DataFrame, distance: float, by: list[str], rounds: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Affine map (2 x 3) of source points (by, id, x, y) onto target points: closest pairs, normal equations on Spark, a 3 x 3 solve here."""
    t, error = np.array([[1.0, 0, 0], [0, 1.0, 0]]), np.inf
    for _ in range(rounds):
        moved = source.select(*by, "id", F.col("x").alias("sx"), F.col("y").alias("sy"), (t[0, 0] * F.col("x") + t[0, 1] * F.col("y") + t[0, 2]).alias("x"), (t[1, 0] * F.col("x") + t[1, 1] * F.col("y") + t[1, 2]).alias("y"))
        pairs = closest(moved, target, distance, by)
        terms = [F.lit(1.0) * F.col("sx"), F.col("sy"), F.lit(1.0)]
        s = pairs.agg(*[F.sum(p * q) for p in terms for q in terms], *[F.sum(p * F.col(c)) for c in ("tx", "ty") for p in terms], F.avg("d"), F.count("*")).first()
        if not s[-1]:
            break
        xtx, rhs = np.array(s[:9]).reshape(3, 3), np.array(s[9:15]).reshape(2, 3)
        t = np.linalg.lstsq(xtx, rhs.T, rcond=None)[0].T
        if abs(error - s[-2]) < tolerance:
            break
        error = s[-2]
    return t


def closest(points: DataFrame, target: DataFrame, distance: float, by: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Each point with its closest target within a distance, through grid cells: points' columns, tx, ty, the target's `carry`, d."""
    cell = lambda c: F.floor(F.col(c) / distance)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    places = target.select(*by, "x", "y", *carry).distinct()  # copies of a target are one
    spread = places.select(*by, F.col("x").alias("tx"), F.col("y").alias("ty"), *carry, cell("x").alias("cx"), cell("y").alias("cy"), F.explode(steps).alias("s"))
    spread = spread.select(*by, "tx", "ty", *carry, (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    d = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    near = points.withColumn("cx", cell("x")).withColumn("cy", cell("y")).join(spread, [*by, "cx", "cy"]).withColumn("d", d).filter(F.col("d") <= distance)
    best = F.row_number().over(Window.partitionBy(*by, "id").orderBy("d", "tx", "ty"))
    return near.withColumn("__k", best).filter("__k = 1").drop("__k", "cx", "cy")


def weber_contrast(image: DataFrame, threshold: float) -> DataFrame:
    """(mean above the threshold less mean below) over mean below."""
    hi, lo = F.avg(F.when(F.col("intensity") > threshold, F.col("intensity"))), F.avg(F.when(F.col("intensity") <= threshold, F.col("intensity")))
    return image.groupBy("movie", "channel").agg(F.try_divide(hi - lo, lo).alias("contrast"))


def misalignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Root mean square distance of centroids (movie, mol_id, cx, cy) of two channels."""
    pairs = a.select("movie", "mol_id", "cx", "cy").join(b.select("movie", "mol_id", F.col("cx").alias("ox"), F.col("cy").alias("oy")), ["movie", "mol_id"])
    return pairs.groupBy("movie").agg(F.sqrt(F.avg((F.col("cx") - F.col("ox")) ** 2 + (F.col("cy") - F.col("oy")) ** 2)).alias("rms"))


def integration_windows(image: DataFrame, peaks: DataFrame, half: int = 2, n: int = 9) -> DataFrame:
    """The n brightest pixels around each peak; ties by column, then row."""
    rank = F.row_number().over(Window.partitionBy("movie", "channel", "mol_id").orderBy(F.desc("intensity"), "x", "y"))
    return neighbourhood(image, peaks, half).withColumn("k", rank).filter(F.col("k") <= n).select("movie", "channel", "mol_id", "x", "y", "k")


def window_metrics(image: DataFrame, peaks: DataFrame, half: int = 2, n: int = 9) -> DataFrame:
    """By channel: share of window pixels used by more than one molecule, and mean share of the neighbourhood's light in the window."""
    windows = integration_windows(image, peaks, half, n)
    used = windows.groupBy("movie", "channel", "x", "y").agg(F.count("*").alias("c")).groupBy("movie", "channel").agg((F.count_if(F.col("c") > 1) / F.count("*")).alias("reused"))
    hood = neighbourhood(image, peaks, half).join(windows.select("movie", "channel", "mol_id", "x", "y", F.lit(1).alias("inside")), ["movie", "channel", "mol_id", "x", "y"], "left")
    each = hood.groupBy("movie", "channel", "mol_id").agg(F.try_divide(F.sum(F.when(F.col("inside") == 1, F.col("intensity"))), F.sum("intensity")).alias("e"))
    return used.join(each.groupBy("movie", "channel").agg(F.avg("e").alias("efficiency")), ["movie", "channel"])


def integrate(pixels: DataFrame, windows: DataFrame, background: DataFrame | None = None, photons: float = 1.0) -> DataFrame:
    """Sum of each molecule's window by frame, less the window's background: (movie, mol_id, frame, channel, value)."""
    out = pixels.join(windows.select("movie", "channel", "mol_id", "x", "y"), ["movie", "channel", "x", "y"])
    out = out.groupBy("movie", "mol_id", "frame", "channel").agg(F.sum("intensity").alias("value"))
    if background is not None:
        level = windows.join(background, ["movie", "channel", "x", "y"]).groupBy("movie", "mol_id", "channel").agg(F.sum("background").alias("b"))
        out = out.join(level, ["movie", "mol_id", "channel"], "left").withColumn("value", F.col("value") - F.coalesce("b", F.lit(0.0))).drop("b")
    return out.withColumn("value", F.col("value") * photons)


def demultiplex(traces: DataFrame, period: int = 2) -> DataFrame:
    """Frames of alternating lasers: the first laser's give donor and acceptor, the second's acceptor_direct; renumbered."""
    laser = (F.col("frame") - 1) % period
    at = (F.floor((F.col("frame") - 1) / period) + 1).cast("int")
    one = traces.filter(laser == 0).select("dataset", "trace_id", at.alias("frame"), "donor", "acceptor")
    two = traces.filter(laser == 1).select("dataset", "trace_id", at.alias("frame"), F.col("acceptor").alias("acceptor_direct"))
    return one.join(two, ["dataset", "trace_id", "frame"])


def extract(pixels: DataFrame, threshold: float, half: int = 1, n: int = 4, edge: int = 0, first: int = 10) -> DataFrame:
    """Pixels to traces: average, pick in channel 1, same places in channel 2, windows, integration; as trace_points."""
    image = stack_average(pixels, first)
    found = pick_peaks(image.filter("channel = 1"), threshold, edge)
    found = found.withColumn("mol_id", F.row_number().over(Window.partitionBy("movie").orderBy("y", "x")))
    width = image.groupBy("movie").agg((F.min(F.when(F.col("channel") == 2, F.col("x"))) - F.min(F.when(F.col("channel") == 1, F.col("x")))).alias("shift"))
    other = found.join(width, "movie").select("movie", F.lit(2).alias("channel"), "mol_id", (F.col("x") + F.col("shift")).alias("x"), "y")
    peaks = found.select("movie", "channel", "mol_id", "x", "y").unionByName(other)
    values = integrate(pixels, integration_windows(image, peaks, half, n))
    wide = values.groupBy(F.col("movie").alias("dataset"), F.col("mol_id").alias("trace_id"), "frame").agg(F.sum(F.when(F.col("channel") == 1, F.col("value"))).alias("donor"), F.sum(F.when(F.col("channel") == 2, F.col("value"))).alias("acceptor"))
    return wide.withColumn("fret", F.coalesce(F.try_divide(F.col("acceptor"), F.col("donor") + F.col("acceptor")), F.lit(0.0)))


def particles_by_frame(pixels: DataFrame, threshold: float, edge: int = 0) -> DataFrame:
    """Peaks of every frame."""
    frames = pixels.withColumn("movie", F.concat_ws("#", "movie", "frame"))
    n = pick_peaks(frames.select("movie", "channel", "y", "x", "intensity"), threshold, edge).groupBy("movie", "channel").agg(F.count("*").alias("n"))
    return n.select(F.split_part("movie", F.lit("#"), F.lit(1)).alias("movie"), F.split_part("movie", F.lit("#"), F.lit(2)).cast("int").alias("frame"), "channel", "n")


def in_polygon(points: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Points inside a polygon, by the parity of the edges to their right; points on its edges are outside."""
    crossings, on = F.lit(0), F.lit(False)
    x, y = F.col("x"), F.col("y")
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            at = x1 + (y - y1) * (x2 - x1) / (y2 - y1)
            crossings = crossings + (((y < y1) != (y < y2)) & (x < at)).cast("int")
            on = on | (y.between(min(y1, y2), max(y1, y2)) & (x == at))
        else:
            on = on | ((y == y1) & x.between(min(x1, x2), max(x1, x2)))
    return points.filter((crossings % 2 == 1) & ~on)


def beam_statistics(pixels: DataFrame, frames: int = 100) -> DataFrame:
    """Of the mean image less the mean of its lowest twentieth: centre of mass and relative spread, by movie."""
    image = pixels.filter(F.col("frame") <= frames).groupBy("movie", "y", "x").agg(F.avg("intensity").alias("v"))
    low = image.groupBy("movie").agg(F.percentile("v", 0.05).alias("lim"))
    base = image.join(low, "movie").filter("v <= lim").groupBy("movie").agg(F.avg("v").alias("b"))
    w = F.col("v") - F.col("b")
    return image.join(base, "movie").groupBy("movie").agg(F.try_divide(F.sum(w * F.col("x")), F.sum(w)).alias("cx"), F.try_divide(F.sum(w * F.col("y")), F.sum(w)).alias("cy"), F.try_divide(F.stddev_samp(w), F.avg(w)).alias("spread"))
