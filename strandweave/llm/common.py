"""What several operators of this subpackage need: tables, the shared folder, global running sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.plans.shared import new_path, shared_dir, stored

__all__ = ["WORD", "crc_of_id", "fanout", "flagged", "new_path", "running", "shared_dir", "stored", "table"]

#: A word is a run of bytes that are not a space or U+0009 to U+000D; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fanout(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: Column | str) -> Column:
    """crc32 of an id written as decimal text; a null id counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


#: Bits of the bitmap of ids that flagged() broadcasts: 4 MB whatever the ids. More ids only flag more rows in vain.
FLAG_BITS = 1 << 25
_BITMAP = 1 << 15  # bits of one of Spark's bitmaps


def flagged(rows: DataFrame, column: str, ids: DataFrame, flag: str = "_flag") -> DataFrame:
    """Adds `flag`: false only where rows[column] is surely not among ids[column]. Null is not.

    Ids are hashed into a bitmap of fixed size, so that wide rows can be sorted out before a join moves them.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FLAG_BITS))
    found = ids.select(place(F.col(column)).alias("p")).groupBy((F.col("p") / _BITMAP).cast("int").alias("_bucket")).agg(F.bitmap_construct_agg((F.col("p") % _BITMAP).cast("int")).alias("_bits"))
    at = place(F.col(column))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at % _BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (at % 8).cast("int") + 1)) > 0
    joined = rows.withColumn("_bucket", (at / _BITMAP).cast("int")).join(F.broadcast(found), "_bucket", "left")
    return joined.withColumn(flag, F.coalesce(F.col(column).isNotNull() & bit, F.lit(False))).drop("_bucket", "_bits")


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Adds to each row, for each (out, column) in `sums`, the sum of the column over all rows before it in `order`.

    Rows are range partitioned and sorted; each task adds up its own rows, and the tasks' totals (one small row a task)
    give every task its start. Columns must be non-null longs. The result is stored, and `order` ties stay as stored.
    """
    spark, columns = df.sparkSession, list(sums.values())
    out = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in (*sums, "_task"))])

    def local(batches):
        total, task = dict.fromkeys(sums, 0), TaskContext.get().partitionId()
        for batch in batches:
            arrays = list(batch.columns)
            for name, column in sums.items():
                ends = np.cumsum(batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)) + total[name]
                arrays.append(pa.array(np.concatenate(([total[name]], ends[:-1])) if len(ends) else ends, pa.int64()))
                total[name] = int(ends[-1]) if len(ends) else total[name]
            arrays.append(pa.array(np.full(batch.num_rows, task), pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    ranged = df.repartitionByRange(fanout(spark), *order).sortWithinPartitions(*order)
    rows = stored(ranged.mapInArrow(local, out), "running")
    totals = sorted(rows.groupBy("_task").agg(*(F.sum(c).alias(f"_{i}") for i, c in enumerate(columns))).collect())
    starts, at = [], [0] * len(columns)
    for task, *sizes in totals:
        starts.append((task, *at))
        at = [a + b for a, b in zip(at, sizes)]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("_task", *(f"_{i}" for i in range(len(columns))))])
    rows = rows.join(F.broadcast(spark.createDataFrame(starts, schema)), "_task")  # a row a task
    return rows.withColumns({c: F.col(c) + F.col(f"_{i}") for i, c in enumerate(sums)}).select(*out.names[:-1])
