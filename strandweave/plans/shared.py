"""The folder that driver and executors share, and tables stored there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W


#: Rows that spread() leaves to a task.
MANY = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new folder where that is unset and the master is local (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and a lost executor costs nothing."""
    path = new_path(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that stored() gave, once nothing will read it again."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, key: str | list[str], n: int) -> DataFrame:
    """df, of about n rows, dealt by key to a task every MANY rows, so that a task's share does not grow with the table.
    Tables of no more such tasks than there are cores are left to Spark."""
    tasks = -(-n // MANY)
    return df.repartition(tasks, key) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`, each row's place from 1 in `order`: rows are sorted over all tasks and stored, and each task's rows
    start where the tasks before it end. Only a row a task is ever together."""
    rows = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_task", F.shiftright("_at", 33))
    tasks = rows.groupBy("_task").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    starts = tasks.select("_task", "_low", F.coalesce(F.sum("_n").over(W.Window.orderBy("_task").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_task").withColumn(name, F.col("_start") + F.col("_at") - F.col("_low") + 1).drop("_task", "_at", "_low", "_start")

def running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each (out, column) of `sums`, the sum of the long column over all rows up to this one in `order`.

    Rows are sorted over all tasks and stored; each task adds up its own and starts where the tasks before it end. Only a
    row a task is ever together.
    """
    names = [*df.columns, *sums, "_task"]

    def add(batches):
        task, ends = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            made = {}
            for out, column in sums.items():
                made[out] = np.cumsum(batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False), dtype=np.int64) + ends[out]
                ends[out] = int(made[out][-1]) if len(made[out]) else ends[out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made.values()), pa.array(np.full(batch.num_rows, task, np.int64))], names=names)

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in (*sums, "_task"))])
    rows = stored(df.orderBy(*order).mapInArrow(add, schema), "sums")
    before = W.Window.orderBy("_task").rowsBetween(W.Window.unboundedPreceding, -1)
    tasks = rows.groupBy("_task").agg(*(F.sum(c).alias(f"_{o}") for o, c in sums.items()))
    starts = tasks.select("_task", *(F.coalesce(F.sum(f"_{o}").over(before), F.lit(0)).alias(f"_{o}") for o in sums))
    rows = rows.join(F.broadcast(starts), "_task")
    return rows.withColumns({o: F.col(o) + F.col(f"_{o}") for o in sums}).select(*names[:-1])
