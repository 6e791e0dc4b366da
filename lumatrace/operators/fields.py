"""Images of movies field by field: interpolated background, noise, masks, quality of integration windows, frame baselines,
regions of interest, contrast against chance, and the whole way from pixels to raw traces.

pixels: movie, frame, channel, y, x, intensity. An image is the same without frame. A field is one channel of one movie; its
corner may lie anywhere, places are counted from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.operators import combine, pixels
from lumatrace.session import settle

FIELD = ["movie", "channel"]


def field_sizes(image: DataFrame) -> DataFrame:
    """(movie, channel, x0, y0, nx, ny): corner and extent of each field."""
    return image.groupBy(*FIELD).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("nx"), (F.max("y") - F.min("y") + 1).alias("ny"))


def in_field(image: DataFrame) -> DataFrame:
    """image with fx, fy: places from the field's corner, and nx, ny."""
    return image.join(field_sizes(image), FIELD).withColumns({"fx": F.col("x") - F.col("x0"), "fy": F.col("y") - F.col("y0")})


def dark_blocks(image: DataFrame, size: int = 6, share: float = 0.167) -> DataFrame:
    """Of every whole block of size x size pixels the value of rank floor(share * size**2), at least the first: (movie, channel, by, bx, level)."""
    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    df = in_field(image).withColumns({"by": cell("fy"), "bx": cell("fx")}).filter((F.col("by") < cell("ny")) & (F.col("bx") < cell("nx")))
    rank = F.row_number().over(Window.partitionBy(*FIELD, "by", "bx").orderBy("intensity", "y", "x"))
    return df.withColumn("__k", rank).filter(F.col("__k") == max(1, int(share * size * size))).select(*FIELD, "by", "bx", F.col("intensity").alias("level"))


def _kernel(d: Column, kind: str) -> Column:
    a = F.abs(d)
    if kind == "linear":
        return F.greatest(1 - a, F.lit(0.0))
    return F.when(a <= 1, 1.5 * a**3 - 2.5 * a**2 + 1).when(a <= 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2).otherwise(0.0)


def _taps(sizes: DataFrame, n: str, size: int, at: str, block: str, kind: str) -> DataFrame:
    """Weights of blocks for each place along one axis; blocks beyond the border are mirrored ones."""
    blocks = F.floor(F.col(n) / size)
    df = sizes.filter(blocks > 0).select(*FIELD, blocks.alias("m"), F.col(n).alias("n"), F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(at))
    df = df.withColumn("p", (F.col(at) + 1) * F.col("m") / F.col("n") + 0.5 * (1 - F.col("m") / F.col("n")))
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("i", F.floor(F.col("p") - 2) + F.col("i"))
    fold = F.pmod(F.col("i") - 1, 2 * F.col("m"))
    inside = F.when(fold < F.col("m"), fold).otherwise(2 * F.col("m") - 1 - fold).cast("int")
    return df.select(*FIELD, at, inside.alias(block), _kernel(F.col("p") - F.col("i"), kind).alias("w")).filter("w <> 0")


def background(image: DataFrame, size: int = 6, kind: str = "cubic") -> DataFrame:
    """The levels of dark_blocks() drawn over the whole field: (movie, channel, y, x, background).

    Interpolated along x, then along y, by cubic convolution of the four nearest blocks (or linearly of the two nearest), each
    an equi-join of places with their blocks. Fields smaller than a block have no rows.
    """
    sizes = field_sizes(image)
    across = _taps(sizes, "nx", size, "fx", "bx", kind).join(dark_blocks(image, size), [*FIELD, "bx"]).groupBy(*FIELD, "by", "fx").agg(F.sum(F.col("w") * F.col("level")).alias("level"))
    whole = _taps(sizes, "ny", size, "fy", "by", kind).join(across, [*FIELD, "by"]).groupBy(*FIELD, "fy", "fx").agg(F.sum(F.col("w") * F.col("level")).alias("background"))
    return whole.join(sizes, FIELD).select(*FIELD, (F.col("fy") + F.col("y0")).alias("y"), (F.col("fx") + F.col("x0")).alias("x"), "background")


def top_image(movies: DataFrame, first: int = 10, size: int = 6, subtract: bool = True, kind: str = "cubic") -> DataFrame:
    """Mean of the first frames, less its background unless told otherwise: movie, channel, y, x, intensity, background."""
    mean = pixels.stack_average(movies, first)
    df = mean.join(background(mean, size, kind), [*FIELD, "y", "x"], "left")
    return df.withColumn("intensity", F.col("intensity") - F.coalesce("background", F.lit(0.0))) if subtract else df


def end_noise(movies: DataFrame, frames: int = 11, share: float = 0.75) -> DataFrame:
    """(movie, noise): standard deviation of the lowest floor(share * n) values of the last frames but one, channels summed at
    the same place of their fields. Each frame's pixels count by themselves."""
    last = movies.groupBy("movie").agg(F.max("frame").alias("__last"))
    sizes = field_sizes(movies)
    part = movies.join(last, "movie").filter((F.col("frame") >= F.greatest(F.lit(1), F.col("__last") - frames)) & (F.col("frame") < F.col("__last")))
    total = part.join(sizes, FIELD).groupBy("movie", "frame", (F.col("y") - F.col("y0")).alias("fy"), (F.col("x") - F.col("x0")).alias("fx")).agg(F.sum("intensity").alias("v"))
    # As many values as a few images have pixels: a movie's length does not matter.
    ranked = total.withColumns({"__k": F.row_number().over(Window.partitionBy("movie").orderBy("v", "frame", "fy", "fx")), "__n": F.count("*").over(Window.partitionBy("movie"))})
    return ranked.filter(F.col("__k") <= F.floor(F.col("__n") * share)).groupBy("movie").agg(F.stddev_samp("v").alias("noise"))


def total_image(image: DataFrame) -> DataFrame:
    """Channels summed at the same place of their fields, as channel 0 with its corner at 0, 0."""
    return in_field(image).groupBy("movie", F.lit(0).alias("channel"), F.col("fy").alias("y"), F.col("fx").alias("x")).agg(F.sum("intensity").alias("intensity"))


def background_mask(image: DataFrame, windows: DataFrame) -> DataFrame:
    """Pixels (movie, channel, y, x) at least two steps from every window's pixel, diagonals included: what eroding the
    windows' complement by 3 x 3 leaves."""
    d = F.sequence(F.lit(-1), F.lit(1))
    grown = windows.select(*FIELD, "x", F.explode(d).alias("dx"), "y").select(*FIELD, (F.col("x") + F.col("dx")).alias("x"), "y", F.explode(d).alias("dy"))
    grown = grown.select(*FIELD, "x", (F.col("y") + F.col("dy")).alias("y")).distinct()
    return image.select(*FIELD, "y", "x").join(grown, [*FIELD, "y", "x"], "left_anti")


def window_quality(image: DataFrame, peaks: DataFrame, half: int = 2, n: int = 9) -> DataFrame:
    """By movie: molecules, reused (pixels that two windows share, over all window pixels; the worst channel), saturated (share of
    molecules whose surroundings hold the field's brightest value; the worst channel), efficiency (percent of the light around a
    molecule that its n brightest pixels hold) and psf_width (pixels, brightest first, that it takes to hold 70 % of it).

    Light around a molecule: its (2 half + 1)**2 pixels sorted by brightness in each channel, summed over the channels rank by
    rank, less the dimmest. Peaks (movie, channel, mol_id, x, y) have the same mol_id in all channels.
    """
    hood = pixels.neighbourhood(image, peaks, half)
    rank = F.row_number().over(Window.partitionBy(*FIELD, "mol_id").orderBy(F.desc("intensity"), "x", "y"))
    ranked = hood.withColumn("k", rank)
    molecules = peaks.groupBy(*FIELD).agg(F.countDistinct("mol_id").alias("molecules"))
    shared = ranked.filter(F.col("k") <= n).groupBy(*FIELD, "x", "y").agg(F.count("*").alias("c")).groupBy(*FIELD).agg(F.count_if(F.col("c") > 1).alias("shared"))
    top = image.groupBy(*FIELD).agg(F.max("intensity").alias("top"))
    full = ranked.filter("k = 1").join(top, FIELD).groupBy(*FIELD).agg(F.count_if(F.col("intensity") == F.col("top")).alias("full"))
    rates = molecules.join(shared, FIELD).join(full, FIELD).groupBy("movie").agg(F.max("molecules").alias("molecules"), F.max(F.col("shared") / F.col("molecules") / n).alias("reused"), F.max(F.col("full") / F.col("molecules")).alias("saturated"))
    mol = Window.partitionBy("movie", "mol_id")
    light = ranked.groupBy("movie", "mol_id", "k").agg(F.sum("intensity").alias("v")).withColumn("v", F.col("v") - F.min("v").over(mol))
    part = light.withColumn("c", F.sum("v").over(mol.orderBy("k"))).withColumn("f", F.try_divide(F.col("c"), F.max("c").over(mol)))
    each = part.groupBy("movie", "mol_id").agg(F.max(F.when(F.col("k") == n, F.col("f"))).alias("held"), (F.count_if(F.col("f") < 0.7) + 1).alias("width"))
    return rates.join(each.groupBy("movie").agg((100 * F.avg("held")).alias("efficiency"), F.avg("width").alias("psf_width")), "movie")


def frame_baseline(movies: DataFrame, mask: DataFrame, every: int = 10, step: int = 1) -> DataFrame:
    """(movie, channel, frame, baseline): mean of every tenth masked pixel, counted down the columns, in every frame.

    With a step above 1 only frames 1, 1 + step, ... are measured, and each frame has the value of the last one measured.
    """
    order = F.row_number().over(Window.partitionBy(*FIELD).orderBy("x", "y"))
    sample = mask.select(*FIELD, "y", "x").withColumn("__k", order).filter((F.col("__k") - 1) % every == 0).drop("__k")
    measured = movies.filter((F.col("frame") - 1) % step == 0).join(sample, [*FIELD, "y", "x"]).groupBy(*FIELD, F.col("frame").alias("__at")).agg(F.avg("intensity").alias("baseline"))
    frames = movies.select(*FIELD, "frame").distinct() if step > 1 else measured.select(*FIELD, F.col("__at").alias("frame"))
    last = (F.floor((F.col("frame") - 1) / step) * step + 1).cast("int")
    return frames.withColumn("__at", last).join(measured, [*FIELD, "__at"]).select(*FIELD, "frame", "baseline")


def integrate_frames(movies: DataFrame, windows: DataFrame, level: DataFrame | None = None, baseline: DataFrame | None = None, photons: dict[int, float] | None = None) -> DataFrame:
    """Light of each molecule by frame and channel: (movie, mol_id, frame, channel, value).

    Window pixels summed, less the frame's baseline at each, less the background image (movie, channel, y, x, background)
    under the window; then times the channel's photons a count.
    """
    out = movies.join(windows.select(*FIELD, "mol_id", "x", "y"), [*FIELD, "x", "y"]).groupBy(*FIELD, "mol_id", "frame").agg(F.sum("intensity").alias("value"), F.count("*").alias("__n"))
    if baseline is not None:
        out = out.join(baseline, [*FIELD, "frame"], "left").withColumn("value", F.col("value") - F.col("__n") * F.coalesce("baseline", F.lit(0.0)))
    if level is not None:
        under = windows.join(level, [*FIELD, "y", "x"]).groupBy(*FIELD, "mol_id").agg(F.sum("background").alias("__b"))
        out = out.join(under, [*FIELD, "mol_id"], "left").withColumn("value", F.col("value") - F.coalesce("__b", F.lit(0.0)))
    if photons:
        factor = F.lit(1.0)
        for channel, p in photons.items():
            factor = F.when(F.col("channel") == channel, float(p)).otherwise(factor)
        out = out.withColumn("value", F.col("value") * factor)
    return out.select("movie", "mol_id", "frame", "channel", "value")


def find_molecules(image: DataFrame, limits: DataFrame | float, half: int = 2, edge: int = 3, apart: float = 3.5) -> DataFrame:
    """Peaks of the summed channels: (movie, mol_id, x, y, cx, cy, rejected), numbered down the rows.

    limits: a threshold for all, or (movie, threshold). cx, cy: intensity centroid; a molecule is rejected if another one's
    centroid is no more than `apart` away.
    """
    total = total_image(image)
    found = pixels.pick_peaks(total, limits, edge) if not isinstance(limits, DataFrame) else pixels.pick_peaks(total.join(limits.select("movie", "threshold"), "movie"), F.col("threshold"), edge)
    found = found.withColumn("mol_id", F.row_number().over(Window.partitionBy("movie").orderBy("y", "x")).cast("long"))
    refined = found.select("movie", "mol_id", "x", "y").join(pixels.centroids(total, found, half).select("movie", "mol_id", "cx", "cy"), ["movie", "mol_id"], "left")
    places = refined.select("movie", F.col("mol_id").alias("id"), F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"))
    crowded = combine.near_pairs(places, apart, ["movie"]).select("movie", F.col("id").alias("mol_id")).distinct().withColumn("rejected", F.lit(True))
    return refined.join(crowded, ["movie", "mol_id"], "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))


def overlap_fraction(molecules: DataFrame) -> DataFrame:
    """(movie, picked, overlapped): molecules found, and the share of them that stand too close."""
    return molecules.groupBy("movie").agg(F.count("*").alias("picked"), F.avg(F.col("rejected").cast("double")).alias("overlapped"))


def in_channels(molecules: DataFrame, image: DataFrame) -> DataFrame:
    """The same place in every channel's field: (movie, channel, mol_id, x, y)."""
    return molecules.join(field_sizes(image), "movie").select("movie", "channel", "mol_id", (F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y"))


def extraction(movies: DataFrame, first: int = 10, size: int = 6, n_noise: float = 8.0, half: int = 2, n: int = 9, edge: int = 3, apart: float = 3.5, baseline: bool = False, photons: dict[int, float] | None = None, threshold: float | None = None) -> dict[str, DataFrame]:
    """Pixels to raw traces in one chain: `values` (movie, mol_id, frame, channel, value), `molecules`, `quality`, `overlap`, `mask`.

    Mean of the first frames less its interpolated background, peaks above n_noise times the noise of the last frames (or a
    given threshold), crowded ones rejected, windows of the n brightest pixels in each channel, a mask around all windows,
    sums by frame less the background. With `baseline` each frame's own level is taken off, and of the background image only
    what differs from its mean.
    """
    # An image and what is found in it are small beside the movie; each is read several times below, so each is made once.
    image = settle(top_image(movies, first, size))
    limits = end_noise(movies).select("movie", (n_noise * F.col("noise")).alias("threshold")) if threshold is None else threshold
    molecules = settle(find_molecules(image, limits, half, edge, apart))
    everywhere = in_channels(molecules, image)
    kept = molecules.filter("not rejected").select("movie", "mol_id")
    windows = settle(pixels.integration_windows(image, everywhere, half, n))
    mask = background_mask(image, windows)
    level = image.filter("background is not null").select(*FIELD, "y", "x", "background")
    if baseline:  # its level is in the frames' baselines already
        mean = level.join(mask, [*FIELD, "y", "x"], "left_semi").groupBy(*FIELD).agg(F.avg("background").alias("__mean"))
        level = level.join(mean, FIELD, "left").select(*FIELD, "y", "x", (F.col("background") - F.coalesce("__mean", F.lit(0.0))).alias("background"))
    values = integrate_frames(movies, windows.join(kept, ["movie", "mol_id"], "left_semi"), level, frame_baseline(movies, mask) if baseline else None, photons)
    quality = window_quality(image, everywhere.join(kept, ["movie", "mol_id"], "left_semi"), half, n)
    return {"values": values, "molecules": molecules, "quality": quality, "overlap": overlap_fraction(molecules), "mask": mask}


# --- layout and light -----------------------------------------------------------------------------------------------


def split_fields(movies: DataFrame, geometry: list[list[int]], ny: int, nx: int) -> DataFrame:
    """Side-by-side fields of a frame of ny x nx pixels as channels: geometry has a channel's number for each tile, 0 for none.

    Places are counted from each tile's corner. Frames that tiles of equal size don't fill raise.
    """
    rows, columns = len(geometry), len(geometry[0])
    if ny % rows or nx % columns or any(len(r) != columns for r in geometry):
        raise ValueError("the frame cannot be cut into equal fields")
    height, width = ny // rows, nx // columns
    tile = (F.floor(F.col("y") / height) * columns + F.floor(F.col("x") / width) + 1).cast("int")
    channel = F.element_at(F.array(*(F.lit(c) for r in geometry for c in r)), tile)
    return movies.withColumn("channel", channel).filter("channel > 0").withColumns({"y": F.col("y") % height, "x": F.col("x") % width})


def split_stack(movies: DataFrame, geometry: list[int]) -> DataFrame:
    """Channels that follow each other in blocks of frames: geometry has the channel of each block, 0 for none; frames are
    counted anew in each. A movie whose frames don't divide into so many blocks fails the job."""
    k = len(geometry)
    n = movies.groupBy("movie").agg(F.max("frame").alias("__n"))
    per = F.when(F.col("__n") % k == 0, F.col("__n") / k).otherwise(F.raise_error(F.concat(F.lit("frames do not divide into blocks: "), "movie")).cast("double")).cast("int")
    df = movies.join(n.withColumn("__per", per), "movie")
    block = (F.floor((F.col("frame") - 1) / F.col("__per")) + 1).cast("int")
    df = df.withColumn("channel", F.element_at(F.array(*(F.lit(c) for c in geometry)), block)).filter("channel > 0")
    return df.withColumn("frame", ((F.col("frame") - 1) % F.col("__per") + 1).cast("int")).drop("__n", "__per")


def one_movie(parts: DataFrame, starts: DataFrame, movie: str) -> DataFrame:
    """Recordings joined to one, in the order in which they began: frames counted on, time_ms continuous.

    starts: movie, started (sortable; of equal ones the name decides), frame_ms (null: only frames are known, time_ms is then
    the frame's number). The first one's interval holds for all.
    """
    n = parts.groupBy("movie").agg(F.max("frame").alias("n")).join(starts, "movie")
    order = Window.orderBy("started", "movie")  # a row for each recording
    before = n.select("movie", (F.sum("n").over(order) - F.col("n")).alias("__before"), F.first("frame_ms").over(order).alias("__step"))
    df = parts.join(before, "movie").withColumn("frame", (F.col("frame") + F.col("__before")).cast("int"))
    return df.withColumns({"movie": F.lit(movie), "time_ms": F.coalesce((F.col("frame") - 1) * F.col("__step"), F.col("frame")).cast("double")}).drop("__before", "__step")


def beam_profile(movies: DataFrame, width: float, height: float, frames: int = 100) -> DataFrame:
    """(movie, cx, cy, inside, uniformity): centre of light, the share of it inside a field of width x height pixels about that
    centre, and the root mean square deviation there over the mean.

    Light: the first frames' sum, less the mean of the lowest twentieth of its pixels (at least one), as a share of the whole.
    """
    image = movies.filter(F.col("frame") <= frames).groupBy("movie", "y", "x").agg(F.sum("intensity").alias("v"))
    all_ = Window.partitionBy("movie")  # one image: as many rows as it has pixels
    ranked = image.withColumns({"__k": F.row_number().over(all_.orderBy("v", "y", "x")), "__n": F.count("*").over(all_)})
    light = ranked.withColumn("v", F.col("v") - F.avg(F.when(F.col("__k") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 20)), F.col("v"))).over(all_))
    light = light.withColumn("v", F.try_divide(F.col("v"), F.sum("v").over(all_)))
    light = light.withColumns({"cx": F.sum(F.col("x") * F.col("v")).over(all_), "cy": F.sum(F.col("y") * F.col("v")).over(all_)})
    within = lambda c, m, size: (F.col(c) + 1 >= F.floor(F.col(m) + 1 - size / 2)) & (F.col(c) + 1 <= F.floor(F.col(m) + 1 + size / 2))
    inside = F.when(within("x", "cx", width) & within("y", "cy", height), F.col("v"))
    return light.groupBy("movie").agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.sum(inside).alias("inside"), F.try_divide(F.stddev_pop(inside), F.avg(inside)).alias("uniformity"))


# --- regions and contrast -------------------------------------------------------------------------------------------


def in_regions(points: DataFrame, corners: DataFrame, by: list[str], cell: float = 64.0) -> DataFrame:
    """Points (by, id, x, y) inside regions (by, region, corner, x, y): by, id, region; a point in several regions has several rows.

    A region is a polygon of any shape, its corners numbered in order. Its bounding box is cut into grid rows as high as
    `cell`; a point meets only the edges of its own rows, and is inside where an odd number of them lie to its right.
    Points of one place and regions of one shape are compared once and meet their copies afterwards.
    """
    shapes = corners.groupBy(*by, "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("__shape"))
    like = shapes.join(shapes.groupBy(*by, "__shape").agg(F.min("region").alias("__like")), [*by, "__shape"]).select(*by, "region", "__like")
    corners = corners.join(like.select(*by, F.col("__like").alias("region")).distinct(), [*by, "region"], "left_semi")
    order = Window.partitionBy(*by, "region").orderBy("corner")
    ring = corners.withColumns({"x2": F.coalesce(F.lead("x").over(order), F.first("x").over(order)), "y2": F.coalesce(F.lead("y").over(order), F.first("y").over(order))}).withColumnsRenamed({"x": "x1", "y": "y1"}).filter("y1 <> y2")
    row = lambda c: F.floor(c / cell)
    edges = ring.withColumn("__row", F.explode(F.sequence(row(F.least("y1", "y2")), row(F.greatest("y1", "y2"))))).select(*by, "region", "__row", "x1", "y1", "x2", "y2")
    crossed = ((F.col("y") < F.col("y1")) != (F.col("y") < F.col("y2"))) & (F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    met = points.select(*by, "x", "y").distinct().withColumn("__row", row(F.col("y"))).join(edges, [*by, "__row"]).filter(crossed)
    inside = met.groupBy(*by, "x", "y", "region").agg(F.count("*").alias("n")).filter("n % 2 = 1").select(*by, "x", "y", F.col("region").alias("__like"))
    return inside.join(points.select(*by, "id", "x", "y").distinct(), [*by, "x", "y"]).join(like, [*by, "__like"]).select(*by, "id", "region")


def shuffled(image: DataFrame, key: int) -> DataFrame:
    """The image's values dealt anew among its places by digest; a field's values stay in it.

    Places and values are ranked stretch by stretch (runs of equal first digest digits), so no task holds a whole field, and
    meet by rank.
    """
    digest = lambda salt: F.md5(F.concat_ws(":", F.lit(f"{salt}{key}"), "channel", "y", "x"))

    def ranked(df: DataFrame, salt: str, columns: list[str]) -> DataFrame:
        df = df.withColumn("__d", digest(salt)).withColumn("__s", F.substring("__d", 1, 2))
        sizes = df.groupBy(*FIELD, "__s").agg(F.count("*").alias("__n"))
        before = Window.partitionBy(*FIELD).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")  # 256 stretches at most
        return df.withColumn("__r", F.row_number().over(Window.partitionBy(*FIELD, "__s").orderBy("__d"))).join(starts, [*FIELD, "__s"]).select(*FIELD, (F.col("__first") + F.col("__r")).alias("__r"), *columns)

    places = ranked(image, "place", ["y", "x"])
    return places.join(ranked(image, "value", ["intensity"]), [*FIELD, "__r"]).select(*FIELD, "y", "x", "intensity")


def _contrast(total: DataFrame, threshold: float) -> DataFrame:
    over, under = F.avg(F.when(F.col("v") > threshold, F.col("v"))), F.avg(F.when(F.col("v") < threshold, F.col("v")))
    return total.groupBy("movie").agg(F.try_divide(over - under, under).alias("contrast"))


def contrast_above_chance(base: DataFrame, other: DataFrame, threshold: float, shuffles: int = 2) -> DataFrame:
    """How well two channels of each movie lie on each other: (movie, contrast, by_chance, quality).

    contrast: mean of the summed images above the threshold less their mean below, over that mean. by_chance: the mean of it
    with both images' pixels dealt anew. quality: one over the other. base and other: images of one channel each, places alike.
    """

    def total(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.select("movie", "y", "x", F.col("intensity").alias("__a")).join(b.select("movie", "y", "x", F.col("intensity").alias("__b")), ["movie", "y", "x"]).select("movie", (F.col("__a") + F.col("__b")).alias("v"))

    own = _contrast(total(base, other), threshold)
    chance = None
    for key in range(shuffles):
        one = _contrast(total(shuffled(base, 2 * key), shuffled(other, 2 * key + 1)), threshold)
        chance = one if chance is None else chance.unionByName(one)
    mean = chance.groupBy("movie").agg(F.avg("contrast").alias("by_chance"))
    return own.join(mean, "movie").withColumn("quality", F.try_divide(F.col("contrast"), F.col("by_chance")))
