"""Views of relational tables in the library's shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def by_trace(rows: DataFrame, key: str | list[str], most: int = 150_000) -> DataFrame:
    """rows in as many partitions of whole traces as they have `most` rows, so that a task's windows don't grow with the table."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // most)), key)


def event_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace for each user: donor is the event's value, acceptor the number in its properties."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "props").withColumn("frame", F.row_number().over(order))
    points = rows.select(F.lit("events").alias("dataset"), F.col("user_id").alias("trace_id"), "frame", (40.0 * (F.col("frame") - 1)).alias("time_ms"), F.col("value").alias("donor"), F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("acceptor"))
    return with_fret(points)


def with_fret(points: DataFrame) -> DataFrame:
    total = F.col("donor") + F.col("acceptor")
    return points.withColumn("fret", F.round(F.coalesce(F.try_divide(F.col("acceptor"), total), F.lit(0.0)), 6))


def vector_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace for each vector, a dataset for each label: fret is the component plus one half."""
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("at", "x"))
    fret = F.round(0.5 + F.col("x").cast("double"), 6)
    return rows.select(F.col("label").cast("string").alias("dataset"), F.col("vec_id").alias("trace_id"), (F.col("at") + 1).alias("frame"), (40.0 * F.col("at")).alias("time_ms"), (100 * (1 - fret)).alias("donor"), (100 * fret).alias("acceptor"), fret.alias("fret"))


def lineitem_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace for each supplier, by ship date."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = by_trace(_read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"), "l_suppkey").withColumn("frame", F.row_number().over(order))
    points = rows.select(F.lit("lineitem").alias("dataset"), F.col("l_suppkey").alias("trace_id"), "frame", (40.0 * (F.col("frame") - 1)).alias("time_ms"), F.col("l_quantity").alias("donor"), (F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("acceptor"))
    return with_fret(points)


def bleached(points: DataFrame) -> DataFrame:
    """Points on a bright level for the first six tenths of each trace, then as they are; fret anew.

    While bright, the acceptor doubles in every second stretch of 40 frames, one frame in 97 is dark, and every third
    trace holds a second donor for the first fifth.
    """
    n, frame = F.count("*").over(Window.partitionBy("dataset", "trace_id")), F.col("frame")
    on = (frame <= F.floor(0.6 * n)) & (frame % 97 != 50)
    second = F.when((F.col("trace_id") % 3 == 0) & (frame <= F.floor(0.2 * n)), 400.0).otherwise(0.0)
    df = points.withColumn("__d", F.when(on, 500.0 + second).otherwise(0.0)).withColumn("__a", F.when(on, 300.0 * (1 + F.floor(frame / 40) % 2)).otherwise(0.0))
    return with_fret(df.withColumn("donor", F.col("donor") + F.col("__d")).withColumn("acceptor", F.col("acceptor") + F.col("__a")).drop("__d", "__a"))


def assigned(points: DataFrame) -> DataFrame:
    """State 1, 2 or 3 by fret, 0 after the last frame with fret."""
    last = F.max(F.when(F.col("fret") != 0, F.col("frame"))).over(Window.partitionBy("dataset", "trace_id"))
    state = F.when(F.col("frame") > F.coalesce(last, F.lit(0)), 0).otherwise(1 + (F.col("fret") >= 0.3).cast("int") + (F.col("fret") >= 0.6).cast("int"))
    return points.withColumn("state", state.cast("int"))


def positioned(points: DataFrame) -> DataFrame:
    """One row for each trace, with a place in the field and an identifier that holds its recording's path."""
    traces = points.select("dataset", "trace_id").distinct()
    return traces.select("dataset", "trace_id", ((F.col("trace_id") * 37) % 1152).cast("double").alias("donor_x"), ((F.col("trace_id") * 91) % 1152).cast("double").alias("donor_y"), F.concat(F.lit("/day"), F.col("trace_id") % 5, F.lit("/movie.rawtraces#"), F.col("trace_id")).alias("ids"))


def vector_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A movie for each label, a frame of 8 x 8 pixels for each vector; the right half is channel 2."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = _read(spark, sf_dir, "embeddings").withColumn("frame", F.row_number().over(order)).select("label", "frame", F.posexplode("embedding").alias("at", "v"))
    x = F.col("at") % 8
    return rows.select(F.col("label").cast("string").alias("movie"), "frame", F.when(x < 4, 1).otherwise(2).alias("channel"), F.floor(F.col("at") / 8).cast("int").alias("y"), x.cast("int").alias("x"), F.round(1000 * (1 + F.col("v").cast("double")), 4).alias("intensity"))
