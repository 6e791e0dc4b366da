"""What reviewers say of traces, as a table that is only ever added to: updates by many hands, one state.

An update is a set of rows under one name: keys, version, and the fields it sets (null: left as it was): bins (names of the bins a
trace lies in), adjusted, crosstalk, gamma, background, threshold, and removed (forget what came before). Every row also says
how many rows its update has, so that readers leave out an update that is still being written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumatrace.schema import KEYS

FIELDS = {"bins": "array<string>", "adjusted": "boolean", "crosstalk": "double", "gamma": "double", "background": "double", "threshold": "double"}
SCHEMA = "dataset string, trace_id long, version long, removed boolean, " + ", ".join(f"{c} {t}" for c, t in FIELDS.items()) + ", update string, update_rows long"


def put(rows: DataFrame, path: str, update: str) -> None:
    """Add an update (keys, version, any of the fields, removed) under a name. Adding the same one again changes nothing.

    version orders updates of a trace, whoever writes them and whenever; of equal versions the one whose name sorts last
    counts. Rows of one update have distinct keys; a repeated key raises.
    """
    named = {c: F.col(c) if c in rows.columns else F.lit(None).cast(t) for c, t in FIELDS.items()}
    removed = F.coalesce(F.col("removed"), F.lit(False)) if "removed" in rows.columns else F.lit(False)
    own = rows.select(*KEYS, F.col("version").cast("long").alias("version"), removed.alias("removed"), *(v.cast(FIELDS[c]).alias(c) for c, v in named.items()))
    n, distinct = own.agg(F.count("*"), F.countDistinct(F.struct(*KEYS))).first()
    if n != distinct:
        raise ValueError(f"update {update} names a trace more than once")
    own.withColumns({"update": F.lit(update), "update_rows": F.lit(n).cast("long")}).write.mode("append").parquet(path)


def updates(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all whole updates, each once however often it was written."""
    once = spark.read.schema(SCHEMA).parquet(path).dropDuplicates([*KEYS, "version", "update"])
    # Row counts by update are joined back: an update of any size stays spread over tasks.
    seen = once.groupBy("update").agg(F.count("*").alias("__n"), F.max("update_rows").alias("__want"))
    return once.join(seen.filter("__n = __want").select("update"), "update", "left_semi").select(*KEYS, "version", "removed", *FIELDS, "update")


def state_of(rows: DataFrame) -> DataFrame:
    """(keys, fields, version): of each trace every field as the latest update that names it has it, none from before a removal.

    version is the latest update's; a trace whose latest word is its removal has no row.
    """
    order = F.struct("version", "update")
    cut = F.max(F.when(F.col("removed"), order)).over(Window.partitionBy(*KEYS))
    live = rows.withColumn("__cut", cut).filter(F.col("__cut").isNull() | (order > F.col("__cut")))
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in FIELDS]
    return live.groupBy(*KEYS).agg(*latest, F.max("version").alias("version"))


def state(spark: SparkSession, path: str) -> DataFrame:
    """The state of all traces that whole updates under a path name, at the time of the call."""
    return state_of(updates(spark, path))


def labels(reviewed: DataFrame) -> DataFrame:
    """(keys, bin) for select.review_bins()."""
    return reviewed.select(*KEYS, F.explode("bins").alias("bin"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The state as one update in a new folder, to which later updates of higher versions may be added."""
    put(state(spark, path), target, "state")
