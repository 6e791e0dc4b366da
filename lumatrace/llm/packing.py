"""Best-fit packing of documents into training sequences of several permitted lengths.

The packing itself is planned on the histogram of item lengths, whose size is bounded by the largest permitted length and
not by the data; the plan says which ranks of which length go into which bins, and Spark ranks and places the items.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.llm.common import materialize

CAPACITIES = (1024, 2048, 4096, 8192)
#: Ranks within one length are given in this many slices, so that no length has to be ordered by one task.
SLICES = 64


def sequence_cost(capacity: int, largest: int) -> float:
    """Relative cost of training on one sequence: linear work, attention, and a fixed part for each sequence."""
    return capacity * (1 + 0.15 * capacity / largest) + 16


class _Bins:
    """Open bins in classes of equal contents: (first bin, bins, used, capacity), found by what is left."""

    def __init__(self):
        self.left: list[int] = []
        self.classes: list[tuple[int, int, int, int]] = []

    def add(self, first: int, bins: int, used: int, capacity: int) -> None:
        i = bisect.bisect_left(self.left, capacity - used)
        self.left.insert(i, capacity - used)
        self.classes.insert(i, (first, bins, used, capacity))

    def best(self, length: int) -> tuple[int, int, int, int] | None:
        """Takes out the class with the least room that still holds length."""
        i = bisect.bisect_left(self.left, length)
        if i == len(self.left):
            return None
        self.left.pop(i)
        return self.classes.pop(i)


def plan(histogram: dict[int, int], capacities: tuple[int, ...]) -> tuple[list[tuple], list[tuple]]:
    """Best-fit decreasing over a histogram {length: items}, equal bins handled together.

    Returns placements (length, first rank, items, items a bin, first bin, used before) and bins (first bin, last bin,
    used, capacity). Among open bins of all sizes an item goes to the one with the least room left; a run of equal items
    fills it while they fit. Where none fits, a bin of that permitted size is opened whose cost for each token that it
    can be expected to hold, given the items still to come, is least. At the end each bin takes the smallest permitted
    size that holds its contents.
    """
    sizes = sorted(capacities)
    lengths = sorted(histogram)
    mass = [0]
    for n in lengths:
        mass.append(mass[-1] + n * histogram[n])
    cost = {c: sequence_cost(c, sizes[-1]) for c in sizes}

    def opened(length: int, items: int) -> int:
        def price(c: int) -> float:
            own = min(items, c // length) * length
            rest, at = c - own, bisect.bisect_left(lengths, length)
            while rest > 0:
                at = bisect.bisect_right(lengths, rest, 0, at) - 1
                if at < 0:
                    break
                take = min(histogram[lengths[at]], rest // lengths[at]) * lengths[at]
                own, rest = own + take, rest - take
            return cost[c] / own

        return min((c for c in sizes if c >= length), key=lambda c: (price(c), c))

    bins, placed, made, done = _Bins(), [], 0, []
    for length in reversed(lengths):
        items, rank = histogram[length], 0
        while rank < items:
            if (found := bins.best(length)) is None:
                capacity = opened(length, items - rank)
                found = (made, max(1, (items - rank) // (capacity // length)), 0, capacity)
                made += found[1]
            first, n, used, capacity = found
            each = (capacity - used) // length
            full = min(n, (items - rank) // each)
            if full:
                placed.append((length, rank, full * each, each, first, used))
                bins.add(first, full, used + each * length, capacity)
                rank += full * each
            if full < n:
                more = items - rank if full < n and items - rank < each else 0
                if more:
                    placed.append((length, rank, more, more, first + full, used))
                    bins.add(first + full, 1, used + more * length, capacity)
                    rank += more
                if n - full - bool(more) > 0:
                    bins.add(first + full + bool(more), n - full - bool(more), used, capacity)
    for first, n, used, _ in bins.classes:
        done.append((first, first + n - 1, used, sizes[bisect.bisect_left(sizes, used)]))
    return placed, sorted(done)


def cut(items: DataFrame, largest: int) -> DataFrame:
    """(doc_id, n_tokens) -> pieces (doc_id, piece, first_token, length) of at most `largest` tokens; empty ones have none."""
    last = F.floor((F.col("n_tokens") - 1) / F.lit(largest)).cast("long")
    out = items.filter("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return out.select("doc_id", "piece", (F.col("piece") * largest).alias("first_token"), F.least(F.lit(largest), F.col("n_tokens") - F.col("piece") * largest).cast("int").alias("length"))


def pack(items: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """Pack (doc_id, n_tokens) into bins: doc_id, piece, first_token, length, bin_id, bin_offset, bin_used, bin_capacity.

    Other columns are ignored. Texts longer than the largest capacity are cut into pieces of it. Items with null or no
    tokens are in no bin: they have no row. Repeated rows are separate items. Ties among equal lengths are placed in
    doc_id order within hash slices, so the result depends on the rows only, not on their order or partitioning.
    """
    spark, largest = items.sparkSession, max(capacities)
    pieces = cut(items, largest).withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)))
    pieces = materialize(pieces, "pieces")
    counts = materialize(pieces.groupBy("length", "slice").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `largest` rows
    placed, bins = plan(histogram, tuple(capacities))
    # Cut placements where bins end up in different classes, so that every row carries its bins' final size.
    ends = [b[0] for b in bins]
    rows = []
    for length, rank, n, each, first, used in placed:
        while n > 0:
            lo, hi, total, capacity = bins[bisect.bisect_right(ends, first) - 1]
            take = min(n, (hi - first + 1) * each)
            rows.append((length, rank, rank + take - 1, each, first, used, total, capacity))
            rank, n, first = rank + take, n - take, first + take // each
    plan_df = spark.createDataFrame(rows, "length int, lo long, hi long, each long, first long, before long, total long, capacity int")
    start = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).select("length", "slice", "base")
    ranked = pieces.withColumn("place", F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(start, ["length", "slice"]).withColumn("rank", F.col("place") + F.col("base"))
    # The plan's rows are bounded by the lengths, hence by `largest`; no data grows it.
    out = ranked.join(F.broadcast(plan_df), "length").filter("rank between lo and hi")
    at = F.col("rank") - F.col("lo")
    return out.select("doc_id", "piece", "first_token", "length", (F.col("first") + F.floor(at / F.col("each"))).alias("bin_id"), (F.col("before") + at % F.col("each") * F.col("length")).alias("bin_offset"), F.col("total").alias("bin_used"), F.col("capacity").alias("bin_capacity"))
