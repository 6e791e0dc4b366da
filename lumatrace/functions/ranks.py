"""Order statistics and numbers within groups that may hold most of a table: no task gets a whole group."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids that one task numbers.
BLOCK = 100_000
#: Relative error of the sketch that brackets an order statistic.
ACCURACY = 10_000


def _same(a: list[Column], b: list[Column]) -> Column:
    return reduce(Column.__and__, [x.eqNullSafe(y) for x, y in zip(a, b, strict=True)], F.lit(True))


def numbered(df: DataFrame, by: list[str], number: str, name: str) -> DataFrame:
    """df with `name`: 1, 2, ... by ascending `number` (whole numbers, one row each) within each group; null comes first.

    A task numbers the ids of one stretch; what comes before a stretch is summed up over counts of stretches. A group's
    range of ids is cut evenly into as many stretches as it has BLOCKs of rows, so running and hashed ids fare alike.
    """
    reach = df.groupBy(*by).agg(F.min(number).cast("double").alias("__low"), F.max(number).cast("double").alias("__high"), F.ceil(F.count("*") / BLOCK).alias("__parts"))
    reach = reach.select(*[F.col(c).alias(f"__r_{c}") for c in by], "__low", F.greatest(F.lit(1.0), (F.col("__high") - F.col("__low")) / F.col("__parts")).alias("__width"))
    df = df.join(reach, _same([F.col(c) for c in by], [F.col(f"__r_{c}") for c in by]))
    stretch = F.floor((F.col(number).cast("double") - F.col("__low")) / F.col("__width")).cast("long")
    df = df.withColumn("__block", F.coalesce(stretch, F.lit(-1))).drop("__low", "__width", *[f"__r_{c}" for c in by])
    counts = df.groupBy(*by, "__block").agg(F.count("*").alias("__many"))
    before = F.sum("__many").over(Window.partitionBy(*by).orderBy("__block")) - F.col("__many")
    starts = counts.select(*[F.col(c).alias(f"__s_{c}") for c in by], F.col("__block").alias("__s"), before.alias("__before"))
    df = df.withColumn(name, F.row_number().over(Window.partitionBy(*by, "__block").orderBy(number)))
    out = df.join(starts, _same([F.col(c) for c in (*by, "__block")], [F.col(f"__s_{c}") for c in by] + [F.col("__s")]))
    return out.withColumn(name, F.col(name) + F.col("__before")).drop("__block", "__s", "__before", *[f"__s_{c}" for c in by])


def percentile(df: DataFrame, by: list[str], column: str, share: float, name: str, discrete: bool = False, rank: Callable[[Column], Column] | None = None) -> DataFrame:
    """(by, name): the exact percentile of each group's values that are not null, as F.percentile() gives it.

    discrete: the first value with at least that share of the group at or below it. rank: from the number of values the
    place (from 0) of the value in order, which must be near share times it; null gives null. A mergeable sketch brackets the
    value; what is below the bracket is only counted, what is inside is counted by value, so that a window sees some
    8 / ACCURACY of a large group. Groups without a value get null; an empty table gives no rows.
    """
    v = df.select(*by, F.col(column).cast("double").alias("__v"))
    edge = 4 / ACCURACY
    low = F.percentile_approx("__v", max(0.0, share - edge), ACCURACY) if share > edge else F.lit(None).cast("double")
    high = F.percentile_approx("__v", min(1.0, share + edge), ACCURACY) if share < 1 - edge else F.lit(None).cast("double")
    bracket = v.groupBy(*by).agg(F.count("__v").alias("__n"), low.alias("__low"), high.alias("__high"))
    many = F.col("__n") > ACCURACY  # in small groups the edge may be less than one rank
    bracket = bracket.select(*[F.col(c).alias(f"__b_{c}") for c in by], "__n", *[F.when(many, F.col(c)).alias(c) for c in ("__low", "__high")])
    inside = v.join(bracket if by else F.broadcast(bracket), _same([F.col(c) for c in by], [F.col(f"__b_{c}") for c in by]))
    inside = inside.filter("__v is null or __high is null or __v <= __high")
    value = F.when(F.col("__low").isNull() | (F.col("__v") >= F.col("__low")), F.col("__v"))
    counts = inside.groupBy(*by, "__n", value.alias("__v")).agg(F.count(F.col("__v")).alias("__k"))
    upto = F.sum("__k").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("__v")))
    ranked = counts.withColumn("__upto", upto)
    at = rank(F.col("__n")) if rank else F.greatest(F.lit(1), F.ceil(F.round(F.col("__n") * share, 9))) - 1 if discrete else (F.col("__n") - 1) * share
    first = lambda rank: F.min(F.when(F.col("__v").isNotNull() & (F.col("__upto") > rank), F.col("__v")))
    found = ranked.groupBy(*by, "__n").agg(first(F.floor(at)).alias("__a"), first(F.ceil(at)).alias("__c"))
    part = at - F.floor(at)
    exact = F.when(F.col("__a").isNotNull() & F.col("__c").isNotNull(), F.when(F.col("__a") == F.col("__c"), F.col("__a")).otherwise((1 - part) * F.col("__a") + part * F.col("__c")))
    return found.select(*by, F.when(F.col("__n") > 0, F.when(at.isNotNull(), F.coalesce(exact, F.raise_error(F.lit("percentile: the sketch missed its bracket")).cast("double")))).alias(name))
