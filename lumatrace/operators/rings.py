"""Circles through edge points of each quadrant of a field, found by agreement among many three-point draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.session import settle

#: Edge points are dealt to this many parts, each of which counts the points near every circle by itself.
PARTS = 16


def quadrants(edges: DataFrame, cx: float, cy: float) -> DataFrame:
    """edges (.., x, y) with quadrant: 1 both at or before the centre, 2 x beyond, 3 y beyond, 4 both."""
    return edges.withColumn("quadrant", (1 + (F.col("x") > cx).cast("int") + 2 * (F.col("y") > cy).cast("int")).cast("int"))


def _draw(group: list[str], salt: int) -> Column:
    """A whole number below 2**32 for each group and draw, from a digest that any SQL engine has."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *group, "s", F.lit(salt))), 1, 8), 16, 10).cast("long")


def fit_rings(edges: DataFrame, by: list[str], circles: int = 1, samples: int = 1000, within: float = 12.0, least: int = 10, radius: tuple[float, float] = (205.0, 280.0)) -> DataFrame:
    """(by, circle, cx, cy, r, inliers): up to `circles` circles in each group of edge points (by, id, x, y), best first.

    Each draw takes three different points of its group; the circle through them counts the points within a distance of it.
    The one with the most, at least `least`, wins if its radius lies inside the bounds (ties: the first draw). Its points are
    then taken away and the next circle is sought among the rest; a group without a circle leaves the rounds.

    Points get running numbers, draws name three of them, and joins fetch their places: no list of points is ever gathered.
    Groups need no common size; ids must be distinct in a group.
    """
    left = edges.select(*by, "id", "x", "y")
    found: DataFrame | None = None
    for circle in range(1, circles + 1):
        best = settle(_best(left, by, samples, within, least, radius).withColumn("circle", F.lit(circle)))
        found = best if found is None else found.unionByName(best)
        if circle == circles or best.isEmpty():
            break
        taken = F.abs(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r")) <= within
        left = settle(left.join(best.select(*by, "cx", "cy", "r"), by).filter(~taken).select(*by, "id", "x", "y"))
    return found.select(*by, "circle", "cx", "cy", "r", "inliers")


def _best(edges: DataFrame, by: list[str], samples: int, within: float, least: int, radius: tuple[float, float]) -> DataFrame:
    # A field has a bounded number of edge points, so has a quadrant of it.
    numbered = edges.withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy("id")) - 1)
    sizes = numbered.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") >= max(3, least))
    draws = sizes.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    first = _draw(by, 1) % F.col("n")
    second = _draw(by, 2) % (F.col("n") - 1)
    third = _draw(by, 3) % (F.col("n") - 2)
    draws = draws.withColumn("i1", first).withColumn("i2", second + (second >= F.col("i1")).cast("int"))
    draws = draws.withColumns({"lo": F.least("i1", "i2"), "hi": F.greatest("i1", "i2")})
    third = third + (third >= F.col("lo")).cast("int")
    draws = draws.withColumn("t", third).withColumn("i3", F.col("t") + (F.col("t") >= F.col("hi")).cast("int"))
    df = draws.select(*by, "s", "i1", "i2", "i3")
    for k in (1, 2, 3):
        df = df.join(numbered.select(*by, F.col("no").alias(f"i{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), [*by, f"i{k}"])
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2", "x3", "y3")}
    a1, b1, a2, b2 = c["x2"] - c["x1"], c["y2"] - c["y1"], c["x3"] - c["x2"], c["y3"] - c["y2"]
    r1 = 0.5 * (c["x2"] ** 2 - c["x1"] ** 2 + c["y2"] ** 2 - c["y1"] ** 2)
    r2 = 0.5 * (c["x3"] ** 2 - c["x2"] ** 2 + c["y3"] ** 2 - c["y2"] ** 2)
    det = a1 * b2 - b1 * a2
    rings = df.withColumn("det", det).filter(F.abs("det") >= 1e-10).withColumns({"cx": (r1 * b2 - r2 * b1) / F.col("det"), "cy": (a1 * r2 - a2 * r1) / F.col("det")})
    rings = rings.withColumn("r", F.hypot(c["x1"] - F.col("cx"), c["y1"] - F.col("cy"))).filter((F.col("r") > radius[0]) & (F.col("r") < radius[1]))
    rings = rings.select(*by, "s", "cx", "cy", "r").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    near = F.abs(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r")) <= within
    met = numbered.select(*by, (F.col("no") % PARTS).cast("int").alias("part"), "x", "y").join(rings, [*by, "part"]).filter(near)
    counted = met.groupBy(*by, "s", "cx", "cy", "r").agg(F.count("*").alias("inliers")).filter(F.col("inliers") >= least)
    return counted.groupBy(*by).agg(F.max_by(F.struct("cx", "cy", "r", "inliers"), F.struct("inliers", -F.col("s"))).alias("c")).select(*by, "c.*")


def quadrant_rings(edges: DataFrame, by: list[str], cx: float, cy: float, **how) -> DataFrame:
    """fit_rings() in each quadrant of each field that has edge points; quadrants without a circle have zeros, as has circle 1 there."""
    parted = quadrants(edges, cx, cy)
    keys = [*by, "quadrant"]
    rings = fit_rings(parted, keys, **how)
    all_ = parted.select(*keys).distinct().join(rings, keys, "left")
    zero = {"circle": F.lit(1), "cx": F.lit(0.0), "cy": F.lit(0.0), "r": F.lit(0.0), "inliers": F.lit(0)}
    return all_.withColumns({c: F.coalesce(c, v) for c, v in zero.items()})


def near_expected_rings(edges: DataFrame, nx: float, ny: float, pixel: float = 13 / 60, outer: tuple[float, float] = (160.0, 140.0), inner: tuple[float, float] = (170.0, 70.0)) -> DataFrame:
    """Edge points (x, y) of a field of nx x ny pixels where the border of one of four printed spots may run.

    outer and inner: distance between the spots' centres and diameter of a circle about each, in the unit of `pixel` (its
    size). A point stays that lies in an outer circle and in no inner one. The centres stand about the field's middle.
    """

    def within(distance: float, diameter: float) -> Column:
        off, radius, hit = distance / pixel / 2, diameter / pixel / 2, F.lit(False)
        for sx in (-off, off):
            for sy in (-off, off):
                hit = hit | (F.hypot(F.col("x") - (nx / 2 + sx), F.col("y") - (ny / 2 + sy)) <= radius)
        return hit

    return edges.filter(within(*outer) & ~within(*inner))
