"""Incremental marker counts over a stream of events (an extension: the batch library has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.plans.shared import new_path


def counted(events: DataFrame, keys: list[str], window: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Counts by keys, in windows of event time behind a watermark if `window` is given. Works on streams and on tables."""
    if window is None:
        return events.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), *keys, "n")


def stream_marker_counts(spark: SparkSession, sf_dir: str, keys: list[str], window: str | None = None, name: str = "events") -> DataFrame:
    """Reads the table as a stream until its end and returns the counts.

    Every micro-batch's changed counts are written, with the batch's number, by a sink that overwrites a batch when it
    is run again; the last count of a key stands.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    out = new_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09d}/rows")

    counts = counted(stream, keys, window)
    job = counts.writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(keep).start()
    job.awaitTermination()
    columns = [c for c in counts.columns if c != "n"]
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return rows.groupBy(*columns).agg(F.max_by("n", "batch").alias("n"))
