"""The library's relations, derived from the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandweave.operators.incidence import filter_incidence, incidence
from strandweave.operators.overlap import filter_percentile, overlap_edges

from .shared import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplied_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes are suppliers, markers the parts that they ship."""
    return incidence(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


BXMX = "bxmx AS (SELECT DISTINCT l_suppkey AS bx, l_partkey AS mx FROM lineitem)"
DEEP = "deep AS (SELECT bx, mx FROM bxmx WHERE mx IN (SELECT mx FROM bxmx GROUP BY mx HAVING count(*) >= 2))"
#: filter_incidence with sizes of at least 2.
FILTERED = f"""{BXMX}, {DEEP},
    sized AS (SELECT bx, mx FROM deep WHERE bx IN (SELECT bx FROM deep GROUP BY bx HAVING count(*) >= 2)),
    again AS (SELECT bx, mx FROM sized WHERE mx IN (SELECT mx FROM sized GROUP BY mx HAVING count(*) >= 2)),
    depth AS (SELECT mx, count(*) AS d FROM again GROUP BY mx),
    ranked AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM depth),
    quart AS (SELECT max(CASE WHEN r = round_even(0.25 * (n - 1), 0) THEN d END) AS q1, max(CASE WHEN r = round_even(0.75 * (n - 1), 0) THEN d END) AS q3 FROM ranked),
    fx AS (SELECT bx, mx FROM again WHERE mx IN (SELECT mx FROM depth, quart WHERE d < trunc(q3 + 1.5 * (q3 - q1))))"""
EDGES = f"{FILTERED}, e AS (SELECT a.bx AS u, b.bx AS v, count(*) AS m FROM fx a JOIN fx b ON a.mx = b.mx AND a.bx < b.bx GROUP BY 1, 2 HAVING count(*) >= 10)"
#: The edges at or over the 90th percentile, and the same from both ends.
GRAPH = f"""{EDGES},
    cut AS (SELECT m AS least FROM (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r, count(*) OVER () AS n FROM e) WHERE r = floor(n * 90 / 100.0)),
    g AS (SELECT u, v, m FROM e, cut WHERE m >= least),
    s AS (SELECT u, v, m FROM g UNION ALL SELECT v, u, m FROM g)"""


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(filter_incidence(stored(supplied(spark, sf_dir), "bxmx"), 2), "filtered")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(overlap_edges(filtered(spark, sf_dir), 10), "edges")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(filter_percentile(edges(spark, sf_dir), 90), "graph")


def ids(graph_edges: DataFrame) -> DataFrame:
    return graph_edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def nation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path a nation: its suppliers by key."""
    along = W.Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("tid"), (F.row_number().over(along) - 1).alias("pos"), F.col("s_suppkey").alias("elem"))


PATHS = "paths AS (SELECT CAST(s_nationkey AS BIGINT) AS tid, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS pos, s_suppkey AS elem FROM supplier)"


def customer_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, qpos, mx): the parts that a customer ordered, in order of time. Stored, since mapping counts them before it joins them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    along = W.Window.partitionBy("o_custkey").orderBy("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey")
    rows = lines.join(orders, "l_orderkey").select(F.col("o_custkey").alias("qid"), (F.row_number().over(along) - 1).alias("qpos"), F.col("l_partkey").alias("mx"))
    return stored(rows, "markers")


QUERY = "qmx AS (SELECT o_custkey AS qid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey) - 1 AS INTEGER) AS qpos, l_partkey AS mx FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, seq): 32 bases for every part, from the md5 of its key and name."""
    digest = F.md5(F.concat_ws("/", F.col("p_partkey").cast("string"), "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.translate(digest, "0123456789abcdef", "ACGTACGTACGTACGN").alias("seq"))


SEQUENCES = "seqs AS (SELECT CAST(p_partkey AS VARCHAR) AS name, translate(md5(concat_ws('/', CAST(p_partkey AS VARCHAR), p_name)), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq FROM part)"
