"""New recordings as they arrive: Structured Streaming over folders. A file is complete when it appears (write, then rename)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lumatrace.operators import ensemble, project, select, stats
from lumatrace.plans import pipelines
from lumatrace.schema import CRITERIA


def stream(spark: SparkSession, folder: str, schema: StructType | str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").parquet(folder)


def each_batch(source: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "2 seconds") -> StreamingQuery:
    """Run work on every micro-batch; the checkpoint remembers which files are done. every=None: what is there now, then stop."""
    writer = source.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def auto_select(spark: SparkSession, folder: str, schema: StructType | str, out: str, checkpoint: str, criteria: dict[str, float | None] | None = None, every: str | None = "2 seconds") -> StreamingQuery:
    """Pick traces of new trace files; a repeated batch replaces its own output, so results are whole exactly once."""

    def work(batch: DataFrame, number: int) -> None:
        chosen = select.pick(stats.trace_stats(batch), CRITERIA if criteria is None else criteria)
        project.subset(batch, chosen).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each_batch(stream(spark, folder, schema), work, checkpoint, every)


def auto_extract(spark: SparkSession, folder: str, schema: StructType | str, out: str, checkpoint: str, threshold: float, every: str | None = "2 seconds") -> StreamingQuery:
    """Extract traces of new movies (pixel tables, whole movies to a file)."""

    def work(batch: DataFrame, number: int) -> None:
        pipelines.extract_traces(batch, threshold).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each_batch(stream(spark, folder, schema), work, checkpoint, every)


def auto_summary(spark: SparkSession, folder: str, schema: StructType | str, out: str, checkpoint: str, every: str | None = "2 seconds", files_a_batch: int = 100) -> StreamingQuery:
    """Counts for the fret contour and histogram of new selected datasets; summary_so_far() makes shares of them.

    A file holds whole traces; a dataset may come in many files and batches, so batches keep counts, which add up.
    """

    def work(batch: DataFrame, number: int) -> None:
        traces = batch.groupBy("dataset").agg(F.countDistinct("trace_id").alias("n"))
        for name, table in (("contour", ensemble.contour_counts(batch)), ("histogram", ensemble.histogram_counts(batch)), ("traces", traces)):
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return each_batch(stream(spark, folder, schema, files_a_batch), work, checkpoint, every)


def summary_so_far(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """contour (dataset, frame, bin, share) and histogram (dataset, bin, percent) of all that auto_summary() has seen."""
    added = lambda name, *by: spark.read.parquet(f"{out}/{name}").groupBy(*by).agg(F.sum("n").alias("n"))
    traces = added("traces", "dataset").withColumnRenamed("n", "__traces")
    contour = added("contour", "dataset", "frame", "bin").join(traces, "dataset").select("dataset", "frame", "bin", (F.col("n") / F.col("__traces")).alias("share"))
    share = 100 * F.col("n") / F.sum("n").over(Window.partitionBy("dataset"))
    return {"contour": contour, "histogram": added("histogram", "dataset", "bin").select("dataset", "bin", share.alias("percent"))}


def latest(files: DataFrame, n: int = 1) -> DataFrame:
    """The newest files of a listing (path, modificationTime)."""
    return files.orderBy(F.desc("modificationTime"), "path").limit(n)
