"""tiling_graph on tables whose paths are longer than the hops that its SQL searches."""

import duckdb

from strandweave.operators.graph import tiling_graph
from strandweave.plans.registry import ORACLE_SQL, QUERIES


def test_paths_longer_than_the_search(spark, tmp_path):
    chains = [list(range(14)), list(range(20, 33))]  # 13 and 12 hops
    groups = [c[i : i + 2] for c in chains for i in range(len(c) - 1)] + [[100 + 3 * i + k for k in range(3)] for i in range(12)]
    lines = [(0, bx, 10 * g + i) for g, group in enumerate(groups) for i in range(10) for bx in group]
    nation = {bx: n for n, c in enumerate(chains) for bx in c}
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(bx, nation.get(bx, 2)) for bx in {b for g in groups for b in g}], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    expected = sorted(con.sql(ORACLE_SQL["tiling_graph"]).fetchall())
    assert expected == [(u, u + 1, 10) for u in range(20, 32)]
    assert sorted(tuple(r) for r in QUERIES["tiling_graph"](spark, str(tmp_path)).collect()) == expected


def test_operator_without_a_bound(spark):
    edges = spark.createDataFrame([(u, u + 1, 1) for u in range(4)], "u long, v long, m long")
    paths = spark.createDataFrame([(0, 0, 0), (0, 1, 4)], "tid long, pos int, elem long")
    assert tiling_graph(edges, paths).count() == 4
    assert tiling_graph(edges, paths, most=4).count() == 4 and tiling_graph(edges, paths, most=3).count() == 0
