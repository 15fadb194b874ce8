"""Queries over the incidence relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.functions.scalar import fixed_md5, shingles
from strandweave.operators import incidence as inc
from strandweave.operators import scaffold

from .inputs import BXMX, DEEP, FILTERED, filtered, supplied, table
from .registry import query


@query(f"WITH {BXMX} SELECT bx, mx FROM bxmx")
def incidence_distinct(spark, sf_dir):
    return supplied(spark, sf_dir)


@query(f"WITH {BXMX} SELECT mx, count(*) AS depth FROM bxmx GROUP BY mx HAVING count(*) >= 2")
def count_markers(spark, sf_dir):
    return inc.count_markers(supplied(spark, sf_dir), 2)


@query(f"WITH {BXMX} SELECT bx, count(*) AS m FROM bxmx GROUP BY bx")
def barcode_sizes(spark, sf_dir):
    return inc.barcode_size(supplied(spark, sf_dir))


@query(f"WITH {BXMX}, {DEEP} SELECT bx, mx FROM deep")
def drop_singletons(spark, sf_dir):
    return inc.drop_singletons(supplied(spark, sf_dir))


@query(f"WITH {BXMX}, {DEEP} SELECT bx, mx FROM deep WHERE bx IN (SELECT bx FROM deep GROUP BY bx HAVING count(*) >= 100 AND count(*) < 520)")
def filter_barcodes(spark, sf_dir):
    return inc.filter_barcodes(supplied(spark, sf_dir), 100, 520)


@query(f"WITH {FILTERED} SELECT bx, mx FROM fx")
def filter_incidence(spark, sf_dir):
    return filtered(spark, sf_dir)


@query(f"""WITH {BXMX}, depth AS (SELECT mx, count(*) AS d FROM bxmx GROUP BY mx),
    ranked AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM depth),
    q AS (SELECT max(CASE WHEN r = round_even(0.25 * (n - 1), 0) THEN d END) AS q1, max(CASE WHEN r = round_even(0.75 * (n - 1), 0) THEN d END) AS q3 FROM ranked)
    SELECT bx, mx FROM bxmx WHERE mx IN (SELECT mx FROM depth, q WHERE d < trunc(q3 + 1.5 * (q3 - q1)))""")
def drop_repetitive(spark, sf_dir):
    return inc.drop_repetitive(supplied(spark, sf_dir))


@query(f"""WITH {BXMX}, x AS (SELECT count(*) AS m FROM bxmx GROUP BY bx), r AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r, count(*) OVER () AS n FROM x)
    SELECT p AS share, max(CASE WHEN r = round_even(p * (n - 1), 0) THEN m END) AS m FROM r, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS p) GROUP BY p""")
def size_quantiles(spark, sf_dir):
    shares = (0.0, 0.25, 0.5, 0.75, 1.0)
    found = inc.nearest_rank(inc.barcode_size(supplied(spark, sf_dir)), "m", *shares)
    return spark.createDataFrame(list(zip(shares, found)), "share double, m long")


@query(f"WITH {BXMX}, x AS (SELECT count(*) AS m FROM bxmx GROUP BY bx) SELECT CAST(floor(m / 10.0) * 10 AS BIGINT) AS bin, count(*) AS n FROM x GROUP BY 1")
def size_histogram(spark, sf_dir):
    sizes = inc.barcode_size(supplied(spark, sf_dir))
    return sizes.groupBy((F.floor(F.col("m") / 10) * 10).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {BXMX}, x AS (SELECT count(*) AS f FROM bxmx GROUP BY mx), h AS (SELECT f, count(*) AS n FROM x GROUP BY f),
    i AS (SELECT f, n, row_number() OVER (ORDER BY f) AS i, n > lag(n) OVER (ORDER BY f) AS rises FROM h),
    low AS (SELECT coalesce(min(CASE WHEN rises THEN i END) - 1, 1) AS low FROM i)
    SELECT i AS mode FROM i, low WHERE i >= low ORDER BY n DESC, f LIMIT 1""")
def depth_mode(spark, sf_dir):
    depth = inc.marker_depth(supplied(spark, sf_dir)).groupBy(F.col("depth").alias("f")).agg(F.count("*").alias("n"))
    return scaffold.depth_mode(depth)


def document_markers(spark, sf_dir):
    """Markers are hashes of a document's runs of three words."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.split(F.trim(F.lower("text")), r"\s+").alias("words"))
    return words.select(F.col("doc_id").alias("bx"), F.explode(shingles(F.col("words"), 3)).alias("g")).select("bx", fixed_md5(F.col("g")).alias("mx")).distinct()


@query(r"""WITH w AS (SELECT doc_id, string_split_regex(trim(lower(text), E' '), '\s+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3)),
    x AS (SELECT DISTINCT doc_id AS bx, ('0x' || substr(md5(g), 1, 15))::BIGINT AS mx FROM g)
    SELECT bx, count(*) AS m FROM x WHERE mx IN (SELECT mx FROM x GROUP BY mx HAVING count(*) >= 2) GROUP BY bx""")
def document_shared_shingles(spark, sf_dir):
    return inc.barcode_size(inc.drop_singletons(document_markers(spark, sf_dir)))


@query("""WITH n AS (SELECT s_nationkey || '_' || (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) AS id FROM supplier)
    SELECT regexp_extract(id, '^(\\S+)_(\\d+)$', 1) AS bx, max(CAST(regexp_extract(id, '_(\\d+)$', 1) AS BIGINT)) + 1 AS molecules FROM n GROUP BY 1""".replace("\\\\", "\\"))
def molecules_per_barcode(spark, sf_dir):
    return inc.molecules_per_barcode(_molecule_names(spark, sf_dir))


def _molecule_names(spark, sf_dir):
    from .inputs import nation_paths

    return nation_paths(spark, sf_dir).select(F.concat_ws("_", F.col("tid").cast("string"), F.col("pos").cast("string")).alias("id"))


@query("""WITH a AS (SELECT CAST(s_nationkey AS VARCHAR) AS bx, count(*) AS x FROM supplier GROUP BY 1), b AS (SELECT CAST(c_nationkey AS VARCHAR) AS bx, CAST(floor(count(*) / 15.0) AS BIGINT) AS y FROM customer GROUP BY 1)
    SELECT count(*) AS both, count(*) FILTER (x = y) AS consistent, count(*) FILTER (x < y) AS under, count(*) FILTER (x > y) AS over FROM a JOIN b USING (bx)""".replace("AS both", 'AS "both"').replace("AS over", 'AS "over"'))
def compare_molecule_counts(spark, sf_dir):
    truth = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("bx")).agg(F.floor(F.count("*") / 15).alias("molecules"))
    return scaffold.compare_molecule_counts(inc.molecules_per_barcode(_molecule_names(spark, sf_dir)), truth)
