"""Unions, joins and comparisons of datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions import ranks
from lumatrace.operators import project
from lumatrace.schema import KEYS


def combine(parts: list[DataFrame], name: str, mode: str = "truncate") -> DataFrame:
    """Datasets as one: columns common to all, traces renumbered in order, lengths made equal (truncate or extend)."""
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    both = reduce(DataFrame.unionByName, [p.select(*common).withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])
    ids = both.select("__part", "dataset", "trace_id").distinct()
    counts = ids.groupBy("__part", "dataset").agg(F.count("*").alias("n"))  # a row for each dataset
    start = counts.select("__part", "dataset", (F.sum("n").over(Window.orderBy("__part", "dataset")) - F.col("n")).alias("__start"))
    ids = ranks.numbered(ids, ["__part", "dataset"], "trace_id", "__k").join(start, ["__part", "dataset"]).select("__part", "dataset", "trace_id", (F.col("__start") + F.col("__k")).alias("__id"))
    out = both.join(ids, ["__part", "dataset", "trace_id"]).withColumn("dataset", F.lit(name)).withColumn("trace_id", F.col("__id")).drop("__part", "__id")
    return project.resize(out, "min" if mode == "truncate" else "max").select(*common)


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Traces of b after those of a; columns that only one has are null in the other."""
    return a.unionByName(b, allowMissingColumns=True)


def append_recordings(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(points, traces) of b after those of a, which must have the same channels and lengths (else ValueError).

    Metadata are joined if both have the same fields; else only the keys of all traces are left of them.
    """
    if set(a[0].columns) != set(b[0].columns):
        raise ValueError(f"channels differ: {sorted(set(a[0].columns) ^ set(b[0].columns))}")
    lengths = [p.groupBy(*KEYS).agg(F.max("frame").alias("n")).agg(F.min("n"), F.max("n")).first() for p in (a[0], b[0])]
    if len({n for pair in lengths for n in pair if n is not None}) > 1:
        raise ValueError(f"lengths differ: {[tuple(x) for x in lengths]}")
    same = set(a[1].columns) == set(b[1].columns)
    traces = a[1].unionByName(b[1]) if same else a[1].select(*KEYS).unionByName(b[1].select(*KEYS))
    return a[0].unionByName(b[0]), traces


def with_states(points: DataFrame, idl: DataFrame) -> DataFrame:
    """Traces with their states; frames without one get 0."""
    return points.join(idl.select(*KEYS, "frame", "state"), [*KEYS, "frame"], "left").withColumn("state", F.coalesce("state", F.lit(0)))


def combine_states(points: list[DataFrame], idls: list[DataFrame], name: str, mode: str = "truncate") -> DataFrame:
    """combine() of datasets with their states: frames that have none, and those that extend a trace, get 0."""
    marked = [with_states(p, i) for p, i in zip(points, idls, strict=True)]
    if mode == "truncate":
        return combine(marked, name)
    ends = [m.groupBy(*KEYS).agg(F.max("frame").alias("__end")) for m in marked]
    out = combine([m.join(e, KEYS) for m, e in zip(marked, ends, strict=True)], name, mode)
    return out.withColumn("state", F.when(F.col("frame") <= F.col("__end"), F.col("state")).otherwise(0)).drop("__end")


def average_models(models: DataFrame) -> DataFrame:
    """One model (state, mu, sigma) from those of several datasets (dataset, state, mu, sigma [, sampling_ms]).

    Null throughout where the datasets differ in their number of states or in sampling: then there is nothing to average.
    """
    extra = ["sampling_ms"] if "sampling_ms" in models.columns else []
    sizes = models.groupBy("dataset", *extra).agg(F.count("*").alias("n"))
    agree = sizes.agg((F.countDistinct("n", *extra) == 1).alias("agree"))
    mean = models.groupBy("state").agg(F.avg("mu").alias("mu"), F.avg("sigma").alias("sigma"))
    return mean.crossJoin(F.broadcast(agree)).select("state", *[F.when(F.col("agree"), F.col(c)).alias(c) for c in ("mu", "sigma")])


def same_sampling(a: DataFrame, b: DataFrame) -> DataFrame:
    """Datasets whose sampling intervals (dataset, sampling_ms) differ."""
    return a.join(b.withColumnRenamed("sampling_ms", "other_ms"), "dataset").filter(F.abs(F.col("sampling_ms") - F.col("other_ms")) > 1e-9)


def compare_states(slow: DataFrame, fast: DataFrame, factor: int) -> DataFrame:
    """Share of the fast assignment's frames in which a slow one agrees, up to each trace's last slow state above 1."""
    last = slow.filter("state > 1").groupBy(*KEYS).agg(F.max("frame").alias("last"))
    at = F.ceil(F.col("frame") / factor).cast("int")
    pairs = fast.select(*KEYS, at.alias("frame"), F.col("state").alias("fast")).join(slow.select(*KEYS, "frame", F.col("state").alias("slow")), [*KEYS, "frame"]).join(last, KEYS).filter("frame <= last")
    return pairs.groupBy("dataset").agg(F.avg((F.col("fast") == F.col("slow")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def near_pairs(points: DataFrame, distance: float, by: list[str]) -> DataFrame:
    """Pairs (id, other, d) of different points of one group no more than `distance` apart.

    Points (by, id, x, y) meet through grid cells as wide as the distance: each is sent to its own and the eight around.
    """
    cell = lambda c: F.floor(F.col(c) / distance)
    own = points.select(*by, "id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = own.select(*by, F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy", F.explode(steps).alias("s"))
    spread = spread.select(*by, "other", "ox", "oy", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    d = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return own.join(spread, [*by, "cx", "cy"]).filter("id != other").withColumn("d", d).filter(F.col("d") <= distance).select(*by, "id", "other", "d")


def without_neighbours(points: DataFrame, distance: float, by: list[str]) -> DataFrame:
    return points.join(near_pairs(points, distance, by).select(*by, "id").distinct(), [*by, "id"], "left_anti")


def largest_dataset(points: DataFrame) -> DataFrame:
    """Each dataset's traces, and their share of the largest one's."""
    n = points.groupBy("dataset").agg(F.countDistinct("trace_id").alias("n_traces"))
    return n.withColumn("of_largest", F.col("n_traces") / F.max("n_traces").over(Window.partitionBy()))


def nearest_state(own: DataFrame, ensemble: DataFrame) -> DataFrame:
    """own (keys, state, mean) relabelled by the ensemble (ens_state, ens_mean) with the closest mean; the first on ties."""
    best = F.min(F.struct(F.round(F.abs(F.col("mean") - F.col("ens_mean")), 9).alias("d"), "ens_state"))
    # Without datasets, the ensemble has one row for each state of a model: a few.
    both = own.join(ensemble, "dataset") if "dataset" in ensemble.columns else own.crossJoin(F.broadcast(ensemble))
    return both.groupBy(*KEYS, "state").agg(best.alias("b")).select(*KEYS, "state", F.col("b.ens_state").alias("new_state"))
