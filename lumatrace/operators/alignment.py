"""Affine alignment of the channels of many movies at once, by closest points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatrace.operators.pixels import closest
from lumatrace.session import settle

_MAP = ["a", "b", "c", "d", "e", "f"]


def _moved(points: DataFrame, maps: DataFrame, by: list[str]) -> DataFrame:
    """Points with px, py (as given) and x, y (through their group's map x' = a x + b y + c, y' = d x + e y + f)."""
    both = points.join(maps, by)
    return both.withColumns({"px": F.col("x"), "py": F.col("y")}).withColumns({"x": F.col("a") * F.col("px") + F.col("b") * F.col("py") + F.col("c"), "y": F.col("d") * F.col("px") + F.col("e") * F.col("py") + F.col("f")})


def _fit(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Least squares of (fx, fy) on (px, py), by group, from sums about the means: a 2 x 2 system in closed form.

    Pairs that lie on one line, or fewer than three, fix no affine map: the group then gets the mean shift alone.
    """
    s = pairs.groupBy(*by).agg(
        *(F.avg(c).alias(f"m_{c}") for c in ("px", "py", "fx", "fy")), F.var_pop("px").alias("xx"), F.var_pop("py").alias("yy"), F.covar_pop("px", "py").alias("xy"),
        *(F.covar_pop(p, t).alias(f"{p}_{t}") for p in ("px", "py") for t in ("fx", "fy")), F.count("*").alias("pairs"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") ** 2
    good = (F.col("pairs") >= 3) & (det > 1e-12 * (F.col("xx") + F.col("yy")) ** 2)
    solve = lambda t: (F.when(good, (F.col(f"px_{t}") * F.col("yy") - F.col(f"py_{t}") * F.col("xy")) / det), F.when(good, (F.col(f"py_{t}") * F.col("xx") - F.col(f"px_{t}") * F.col("xy")) / det))
    (a, b), (d, e) = solve("fx"), solve("fy")
    s = s.withColumns({"a": F.coalesce(a, F.lit(1.0)), "b": F.coalesce(b, F.lit(0.0)), "d": F.coalesce(d, F.lit(0.0)), "e": F.coalesce(e, F.lit(1.0))})
    shift = lambda t, p, q: F.col(f"m_{t}") - F.col(p) * F.col("m_px") - F.col(q) * F.col("m_py")
    return s.withColumns({"c": shift("fx", "a", "b"), "f": shift("fy", "d", "e")}).select(*by, *_MAP, "pairs")


def align_groups(moving: DataFrame, fixed: DataFrame, distance: float, by: list[str], rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """The affine map of each group (movie) that brings its moving points onto its fixed ones.

    moving, fixed: (by, id, x, y), places from the image's centre. One row a group that has a pair within `distance`: by, a .. f
    (x' = a x + b y + c, y' = d x + e y + f), pairs, error (mean distance left between paired points), rounds, converged, and
    the distortion that the map undoes: dx, dy, theta (degrees), scale.

    Each round, in all groups still open: every fixed point meets its closest moving point through grid cells; sums by group
    give the normal equations; these are solved where they lie. A group whose error changes by less than `tolerance` has
    settled and leaves the rounds with all its points. Nothing but the number of open groups reaches the driver.
    """
    groups = fixed.select(*by).distinct().join(moving.select(*by).distinct(), by, "left_semi")
    state = settle(groups.select(*by, *(F.lit(v).alias(c) for c, v in zip(_MAP, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), strict=True)), F.lit(None).cast("double").alias("error")))
    done: DataFrame | None = None
    for k in range(1, rounds + 1):
        here = _moved(moving.select(*by, "x", "y"), state.drop("error"), by).select(*by, "x", "y", "px", "py")
        found = closest(fixed.select(*by, "id", "x", "y").join(state.select(*by), by, "left_semi"), here, distance, by, ("px", "py"))
        pairs = settle(found.select(*by, F.col("x").alias("fx"), F.col("y").alias("fy"), "px", "py"))
        new = _fit(pairs, by)
        left = _moved(pairs.withColumnsRenamed({"px": "x", "py": "y"}), new, by)
        error = left.groupBy(*by).agg(F.avg(F.hypot(F.col("x") - F.col("fx"), F.col("y") - F.col("fy"))).alias("error"))
        before = state.select(*by, F.col("error").alias("__before"))
        now = new.join(error, by).join(before, by).withColumn("rounds", F.lit(k)).withColumn("converged", F.coalesce(F.abs(F.col("error") - F.col("__before")) < tolerance, F.lit(False)))
        now = settle(now.drop("__before"))
        over = now.filter("converged") if k < rounds else now
        done = over if done is None else done.unionByName(over)
        state = now.filter("not converged").select(*by, *_MAP, "error")
        if state.isEmpty():
            break
    # The inverse map is the distortion itself.
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    sc, ss = F.col("e") / det, -F.col("b") / det
    dx, dy = (F.col("b") * F.col("f") - F.col("e") * F.col("c")) / det, (F.col("d") * F.col("c") - F.col("a") * F.col("f")) / det
    return done.select(*by, *_MAP, "pairs", "error", "rounds", "converged", dx.alias("dx"), dy.alias("dy"), F.degrees(F.atan2(ss, sc)).alias("theta"), F.hypot(ss, sc).alias("scale"))
