"""Contiguous byte-balanced shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Cuts the documents, in order of id, into `shards` contiguous runs of nearly equal bytes.

    A document's size is its UTF-8 length plus `overhead`. Its shard is where the middle of its bytes falls among equal
    targets, so each cut is within half a document of its target. Only ids, sizes and checksums are shuffled.
    Returns id, size, text_crc32, law, shard, slot (gapless from 0 in the shard's order) and grown_shard (null: adding a
    shard moves the cuts). Null text counts as empty; null ids come first; repeated rows each get a slot; an empty
    table gives no rows; other columns are ignored. A single document larger than a target fills its shard alone.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sized = docs.select(F.col(id_col), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit(1).cast("long").alias("one"))
    rows = running(sized, [F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size")], {"before": "size", "row": "one"})
    total = rows.agg(F.sum("size")).first()[0] or 0
    middle = (2 * F.col("before") + F.col("size")) * shards
    rows = rows.withColumn("shard", F.least(F.floor(middle / (2.0 * total)), F.lit(shards - 1)).cast("int") if total else F.lit(0))
    firsts = rows.groupBy("shard").agg(F.min("row").alias("first"))  # a row a shard
    return rows.join(F.broadcast(firsts), "shard").select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id") -> None:
    """Writes the documents as one folder a shard, sorted by id. Ids must be unique; rows with a null id go to shard 0."""
    cuts = shard_by_bytes(docs, shards, id_col).select(id_col, "shard", "slot")
    out = docs.join(cuts, id_col, "left").withColumn("shard", F.coalesce("shard", F.lit(0)))
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
