"""Graph files by seed: folders are few at every level that Spark lists in a task a folder."""

import glob
import os
import random

import pytest

from strandweave.operators import graph
from strandweave.sources import sinks


@pytest.mark.parametrize("form", ["tsv", "parquet"])
def test_seeds_are_in_groups(spark, tmp_path, form):
    rows = spark.range(200).selectExpr("id AS seed", "id AS u", "id + 1 AS v", "id % 5 AS m")
    sinks.write_by_seed(rows, f"{tmp_path}/out", form)
    groups = [d for d in os.listdir(f"{tmp_path}/out") if "=" in d]
    assert len(groups) <= sinks.GROUPS and sum(len(os.listdir(f"{tmp_path}/out/{d}")) for d in groups) == 200
    if form == "parquet":
        back = spark.read.parquet(f"{tmp_path}/out").select("seed", "u", "v", "m")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
        return
    found = {}
    for line in spark.read.schema("value string, seed long").text(f"{tmp_path}/out").collect():
        found.setdefault(line["seed"], []).append(line["value"])
    assert found == {i: ["U\tm", f"{i}\t1", f"{i + 1}\t1", "", "U\tV\tm", f"{i}\t{i + 1}\t{i % 5}"] if len(str(i)) == len(str(i + 1)) else found[i] for i in range(200)}


def test_text_computes_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(50).selectExpr("id % 10 AS seed", "id AS u", "id + 1 AS v", "id % 5 AS m")
    sinks.write_by_seed(rows.mapInArrow(look, rows.schema), f"{tmp_path}/out", "tsv")
    assert seen.value == 50 and len(glob.glob(f"{tmp_path}/out/group=*/seed=*")) == 10


@pytest.mark.parametrize("exclude_source", [False, True])
def test_subgraphs_around_all_vertices(spark, exclude_source):
    drawn = random.Random(5)
    pairs = [(u, v, drawn.randrange(9)) for u in range(25) for v in range(u + 1, 25) if drawn.random() < 0.3] + [(30, 31, 1)]
    near = {x: {x} | {b for a, b, _ in pairs if a == x} | {a for a, b, _ in pairs if b == x} for p in pairs for x in p[:2]}
    expected = sorted((s, u, v, m) for s, ids in near.items() for u, v, m in pairs if u in ids and v in ids and not (exclude_source and s in (u, v)))
    edges = spark.createDataFrame(pairs, "u long, v long, m long")
    for seeds in (None, edges.selectExpr("explode(array(u, v)) AS seed").distinct()):
        assert sorted(map(tuple, graph.subgraphs(edges, seeds, 1, exclude_source).collect())) == expected
    if not exclude_source:  # two hops go the general way
        seeds = edges.selectExpr("explode(array(u, v)) AS seed").distinct()
        assert sorted(map(tuple, graph.subgraphs(edges, None, 2).collect())) == sorted(map(tuple, graph.subgraphs(edges, seeds, 2).collect()))
