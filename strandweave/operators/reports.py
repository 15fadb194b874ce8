"""Tables of metrics: one wide table from several reports, and labels derived from file names."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandweave.functions.scalar import minutes
from strandweave.plans.shared import numbered


def stack_reports(reports: Iterable[DataFrame], drop: Iterable[str] = ()) -> DataFrame:
    """All rows of the reports, by column name, without the columns `drop`; columns that a report lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports).drop(*drop)


def readable(name: Column, words: dict[str, str]) -> Column:
    """A file name as a title: underscores become hyphens, then the first of each key of `words` its value, in order."""
    out = F.replace(name, F.lit("_"), F.lit("-"))
    for old, new in words.items():
        at = F.instr(out, old)
        out = F.when(at > 0, F.overlay(out, F.lit(new), at, F.lit(len(old)))).otherwise(out)
    return out


def picked(title: Column, *patterns: str) -> Column:
    """What the patterns find in a title, apart by spaces; those that find nothing leave nothing."""
    found = [F.regexp_extract(title, p, 0) for p in patterns]
    return F.concat_ws(" ", *(F.when(f != "", f) for f in found))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part / whole of two integers as a percentage, halves rounded up exactly."""
    unit = 10**digits
    scaled = F.floor((200 * unit * part.cast("decimal(30,0)") + whole) / (2 * whole.cast("decimal(30,0)"))).cast("double")
    return F.concat(F.format_number(scaled / unit, digits), F.lit("%"))


def lumped(rows: DataFrame, column: str, n: int, weight: Column | None = None, other: str = "Other") -> DataFrame:
    """rows with `column` kept where it is one of its n commonest values (or heaviest, by the sum of `weight`; ties: the smaller
    value) and `other` elsewhere; null stays. Only the n values are ranked together and broadcast."""
    weights = rows.filter(F.col(column).isNotNull()).groupBy(column).agg((F.count("*") if weight is None else F.sum(weight)).alias("_w"))
    top = weights.orderBy(F.desc("_w"), column).limit(n).select(F.col(column).alias("_top"))
    joined = rows.join(F.broadcast(top), F.col(column) == F.col("_top"), "left")
    kept = F.when(F.col(column).isNotNull(), F.coalesce(F.col("_top").cast("string"), F.lit(other)))
    return joined.withColumn(column, kept).select(*rows.columns)


def with_boundaries(bed: DataFrame) -> DataFrame:
    """Records of paths, as filter_bed gives them, with a row of nulls at position -1 before every path but path 0, and `boundary`:
    the number of such rows up to here, which names them and numbers the contigs between. Paths are numbered by a global sort."""
    heads = numbered(bed.filter("tid <> 0").select("tid").distinct(), [F.col("tid")], "boundary")
    empty = heads.select("tid", F.lit(-1).alias("pos"), *(F.lit(None).cast(t).alias(c) for c, t in bed.dtypes if c not in ("tid", "pos")), "boundary")
    rows = bed.join(heads, "tid", "left").withColumn("boundary", F.coalesce("boundary", F.lit(0).cast("long")))
    return rows.unionByName(empty)


def appearance_index(rows: DataFrame, column: str, order: list[Column], name: str = "index") -> DataFrame:
    """Adds the number, from 1, of each value of `column` by where it first appears in `order`."""
    keys = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    firsts = numbered(rows.groupBy(column).agg(F.min(keys).alias("_o")), [F.col("_o")], name).select(F.col(column).alias("_c"), name)
    return rows.join(firsts, F.col(column).eqNullSafe(F.col("_c"))).drop("_c")


def alternating(rows: DataFrame, group: str, index: Column, *order: Column) -> DataFrame:
    """Adds `colour`, 0 or 1 in turn along each group in order, starting from the parity of the group's index."""
    place = F.row_number().over(W.Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("colour", ((index + place) % 2).cast("int"))


def run_totals(steps: DataFrame) -> DataFrame:
    """(step, minutes, most) of steps(step, elapsed, memory): the minutes of all runs of a step and their peak memory."""
    return steps.groupBy("step").agg(F.sum(minutes(F.col("elapsed"))).alias("minutes"), F.max("memory").alias("most"))
