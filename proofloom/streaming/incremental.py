"""Incremental scoring as a stream: idempotent appends, resumable, with snapshots, a budget and a progress log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from proofloom.sources.sinks import has_rows


def scored_stream(spark: SparkSession, source: str, schema: str, log: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], key: str = "step_hash", files: int = 1000) -> StreamingQuery:
    """Read new Parquet files below ``source``, score them and append rows with keys new to ``log``; stops when done.

    Every micro-batch goes through ``foreachBatch``: repeated keys within the batch and keys the log holds are left
    out, and a batch that runs again after a failure first finds its own rows, so each key is written once. The batch
    number is kept in the column batch. ``checkpoint`` must be in shared storage.
    """
    def write(batch: DataFrame, n: int) -> None:
        new = score(batch).dropDuplicates([key])
        if has_rows(batch.sparkSession, log):
            new = new.join(batch.sparkSession.read.parquet(log).select(key), key, "left_anti")
        new.withColumn("batch", F.lit(n)).write.mode("append").parquet(log)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, key: str, length: str, late: str) -> DataFrame:
    """Rows and sums of ``value`` per key and tumbling window, with a watermark of ``late``."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def within_budget(steps: DataFrame, cost: str, cap: float, order: list[str]) -> DataFrame:
    """The steps up to and including the one at which the running cost first exceeds ``cap``, in the given order.

    Costs are summed per bucket of the first order column before the running sum, so only bucket sums pass one task;
    inside the bucket where the cap is reached the steps are summed one by one.
    """
    first = order[0]
    sums = steps.groupBy(first).agg(F.sum(F.coalesce(F.col(cost), F.lit(0))).alias("__c"))
    w = Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(first, F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__b"))
    inside = Window.partitionBy(first).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    x = steps.join(before, first).withColumn("__r", F.col("__b") + F.coalesce(F.sum(F.coalesce(F.col(cost), F.lit(0))).over(inside), F.lit(0)))
    return x.filter(F.col("__r") <= cap).drop("__b", "__r")


def stale(runs: DataFrame, now: str, grace_minutes: int = 10, start_hours: int = 6) -> DataFrame:
    """Runs with ``state`` crashed where a running one's heartbeat is older than the grace, or has none since its start."""
    t = F.lit(now).cast("timestamp_ntz")
    old = F.col("heartbeat_at") < t - F.make_dt_interval(mins=F.lit(grace_minutes))
    never = F.col("heartbeat_at").isNull() & (F.col("started_at") < t - F.make_dt_interval(hours=F.lit(start_hours)))
    return runs.withColumn("state", F.when((F.col("status") == "running") & (F.coalesce(old, F.lit(False)) | never), "crashed").otherwise(F.col("status")))
