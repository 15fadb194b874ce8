"""Filters and counts over the sparse relation bxmx(bx, mx): which barcode holds which marker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandweave.plans.shared import spread, stored


def incidence(rows: DataFrame, bx: str, mx: str) -> DataFrame:
    """Distinct (bx, mx) without nulls. Rows are dealt first, so that no task tells apart a share that grows with them."""
    return spread(rows.select(F.col(bx).alias("bx"), F.col(mx).alias("mx")).dropna(), ["bx", "mx"], rows.count()).distinct()


def marker_depth(bxmx: DataFrame) -> DataFrame:
    """(mx, depth): how many barcodes hold each marker."""
    return bxmx.groupBy("mx").agg(F.count("*").alias("depth"))


def barcode_size(bxmx: DataFrame) -> DataFrame:
    """(bx, m): how many markers each barcode holds."""
    return bxmx.groupBy("bx").agg(F.count("*").alias("m"))


def count_markers(bxmx: DataFrame, least: int = 2) -> DataFrame:
    """(mx, depth) of markers in at least `least` barcodes."""
    return marker_depth(bxmx).filter(F.col("depth") >= least)


def drop_singletons(bxmx: DataFrame) -> DataFrame:
    """Without markers that only one barcode holds. Depths are counted map-side first, so a hot marker is one row a task."""
    return bxmx.join(marker_depth(bxmx).filter("depth >= 2").select("mx"), "mx", "left_semi").select("bx", "mx")


def bound_sizes(bxmx: DataFrame, least: int = 1, below: int | None = None) -> DataFrame:
    """Only barcodes with least <= size < below."""
    sizes = barcode_size(bxmx).filter(F.col("m") >= least)
    if below is not None:
        sizes = sizes.filter(F.col("m") < below)
    return bxmx.join(sizes.select("bx"), "bx", "left_semi").select("bx", "mx")


def filter_barcodes(bxmx: DataFrame, least: int = 1, below: int | None = None) -> DataFrame:
    """Singletons out, then barcodes by size."""
    return bound_sizes(drop_singletons(bxmx), least, below)


def histogram(values: DataFrame, column: str) -> DataFrame:
    """(value, n, upto): counts of each value and how many are at or below it. Its rows are the distinct values."""
    counts = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(W.Window.orderBy("value").rowsBetween(W.Window.unboundedPreceding, 0)))


def nearest_rank(values: DataFrame, column: str, *shares: float) -> list:
    """For each share p, the value at 0-based rank round-half-even(p * (n - 1)) in ascending order; None where there is none."""
    hist = histogram(values, column)
    total = F.sum("n").over(W.Window.partitionBy())
    hist = hist.withColumn("total", total)
    picks = [F.min(F.when(F.col("upto") > F.rint(F.lit(p) * (F.col("total") - 1)), F.col("value"))) for p in shares]
    return list(hist.agg(*picks).first())


def whisker(bxmx: DataFrame, reach: float = 1.5) -> int | None:
    """The depth from which a marker counts as repetitive: truncated Q3 + reach * (Q3 - Q1)."""
    q1, q3 = nearest_rank(marker_depth(bxmx), "depth", 0.25, 0.75)
    return None if q1 is None else int(q3 + reach * (q3 - q1))


def drop_repetitive(bxmx: DataFrame, depth: int = 0) -> DataFrame:
    """Without markers of at least `depth` barcodes; 0 takes the whisker. Barcodes left empty are gone."""
    depth = depth or whisker(bxmx)
    if depth is None:
        return bxmx
    return bxmx.join(marker_depth(bxmx).filter(F.col("depth") < depth).select("mx"), "mx", "left_semi").select("bx", "mx")


def filter_incidence(bxmx: DataFrame, least: int = 1, below: int | None = None, depth: int = 0) -> DataFrame:
    """Singletons, then sizes, then the singletons that this made, then repetitive markers by the depths that are left.

    Rows are stored before the last step, which reads them three times, and dealt anew for every step, so that no task sorts
    a share that grows with them."""
    n = bxmx.count()
    sized = bound_sizes(spread(drop_singletons(spread(bxmx, "mx", n)), "bx", n), least, below)
    return drop_repetitive(spread(stored(drop_singletons(spread(sized, "mx", n)), "deep"), "mx", n), depth)


def molecules_per_barcode(names: DataFrame, column: str = "id") -> DataFrame:
    """(bx, molecules): for names bx_i, the greatest i plus one; for names bx_i_j, how many there are."""
    name = F.col(column)
    twice, once = F.regexp_extract(name, r"^(\S*?)_(\d+)_(\d+)$", 1), F.regexp_extract(name, r"^(\S+)_(\d+)$", 1)
    rows = names.select(F.when(twice != "", twice).otherwise(once).alias("bx"), (twice != "").alias("twice"), F.try_to_number(F.regexp_extract(name, r"_(\d+)$", 1), F.lit("999999999")).cast("long").alias("i"))
    return rows.filter("bx <> ''").groupBy("bx").agg(F.when(F.max("twice"), F.count("*")).otherwise(F.max("i") + 1).cast("long").alias("molecules"))
