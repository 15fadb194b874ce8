"""Queries over an overlap graph that has no edges."""

from strandweave.plans.registry import QUERIES


def test_filter_graph_without_edges(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1), (2, 2, 1)], "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["filter_graph"](spark, str(tmp_path))
    assert found.columns == ["u", "v", "m"] and found.count() == 0
