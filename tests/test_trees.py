"""Trees and components beyond one task, against the folds of one tree or component a task."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandweave.operators import tours, trees
from strandweave.plans.shared import running_sums


def random_edges(seed, n, count):
    r = random.Random(seed)
    pairs = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(count)})
    return [(u, v, r.randrange(1, 6)) for u, v in pairs]


def frame(spark, rows, schema="u long, v long, m long"):
    return spark.createDataFrame(rows, schema).coalesce(2)


def tree_of(rows):
    return trees.tree_of(pd.DataFrame([r[:3] for r in rows], columns=["u", "v", "m"]))


def grouped(block_of):
    found = {}
    for edge, block in block_of.items():
        found.setdefault(block, set()).add(edge)
    return sorted(map(sorted, found.values()))


def by_removal(edges):
    """Cut vertices: without them some neighbours of theirs no longer reach each other."""
    t, cuts = tree_of(edges), set()
    for x in t:
        left = {u: set(vs) - {x} for u, vs in t.items() if u != x}
        named = {u: i for i, group in enumerate(trees.components(left)) for u in group}
        if len({named[y] for y in t[x]}) > 1:
            cuts.add(x)
    return cuts


@pytest.mark.parametrize("block", [4])
def test_blocks_equal_the_fold(spark, monkeypatch, block):
    monkeypatch.setattr(tours, "BLOCK", block)
    edges = random_edges(block, 40, 46)
    fold = trees.blocks_of(tree_of(edges))
    got = {(r.u, r.v): r.block for r in tours.blocks(frame(spark, edges)).collect()}
    assert grouped(got) == grouped({(u, v): fold[u, v] for u, v, _ in edges}) and 1 < len(set(got.values())) < len(edges)
    named = frame(spark, [(*e, fold[e[0], e[1]]) for e in edges], "u long, v long, m long, block long")
    assert {r.id for r in tours.block_cut_vertices(named).collect()} == by_removal(edges)


@pytest.mark.parametrize("fold", [0, 100_000])
def test_cut_vertices_go_in_both_forms(spark, monkeypatch, fold):
    monkeypatch.setattr(trees, "FOLD", fold)
    edges = random_edges(7, 30, 36)
    cuts = by_removal(edges)
    got = trees.without_cut_vertices(frame(spark, edges))
    assert sorted(map(tuple, got.collect())) == [e for e in edges if not cuts & set(e[:2])] and cuts


def test_blocks_of_strings_hubs_and_nothing(spark):
    """A hub of many triangles is the only cut vertex; no edges give no blocks."""
    rows = [("h", f"x{i:02}", 1) for i in range(40)] + [(f"x{i:02}", f"x{i + 1:02}", 1) for i in range(0, 40, 2)]
    named = trees.biconnected_components(frame(spark, rows, "u string, v string, m long")).collect()
    assert len({r.block for r in named}) == 20
    assert [r.id for r in trees.articulation_points(frame(spark, rows, "u string, v string, m long")).collect()] == ["h"]
    assert trees.biconnected_components(frame(spark, rows, "u string, v string, m long").limit(0)).isEmpty()


def test_lengths_and_far_paths_equal_the_fold(spark, monkeypatch):
    monkeypatch.setattr(tours, "BLOCK", 8)
    r = random.Random(3)
    rows = [(r.randrange(max(0, i - 5), i), i, r.randrange(1, 9), 0) for i in range(1, 60)] + [(1000 + r.randrange(max(0, i - 2), i), 1000 + i, r.randrange(1, 9), 1000) for i in range(1, 30)]
    forest = frame(spark, rows, "u long, v long, m long, tree long")
    length = trees.branch_lengths(tree_of(rows))
    got = tours.branch_lengths(forest).collect()
    assert len(got) == len(rows) and all((x.lv, x.lu) == (length[x.u, x.v], length[x.v, x.u]) for x in got)
    paths = sorted((x.tree, x.pos, x.elem) for x in tours.far_paths(forest).collect())
    assert paths == [(name, i, u) for name in (0, 1000) for i, u in enumerate(trees.far_path(tree_of([e for e in rows if e[3] == name]), name))]


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    """Branches of a path of 20 000 vertices, with the stored tables counted: no round a vertex."""
    n, stored, count = 20_000, tours.stored, []
    monkeypatch.setattr(tours, "stored", lambda df, what, **o: count.append(what) or stored(df, what, **o))
    path = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1).cast("long").alias("m"), F.lit(0).cast("long").alias("tree"))
    rows = tours.branch_lengths(path)
    wrong = rows.filter((F.col("lu") != F.col("u") + 1) | (F.col("lv") != n - F.col("v")))
    assert rows.count() == n - 1 and wrong.isEmpty() and count.count("ranks") <= 17 and len(count) < 60


@pytest.mark.parametrize("fold", [12])
def test_bridges_go_in_both_forms(spark, monkeypatch, fold):
    """Components above FOLD edges are cut and joined again by rounds; what falls below is folded."""
    edges = random_edges(32, 20, 24)
    left = trees.unbridge(edges, 2, 4)
    assert 0 < len(left) < len(edges)
    monkeypatch.setattr(trees, "FOLD", fold)
    kept, forest = trees.unbridged(frame(spark, edges), 2, 4)
    assert sorted(map(tuple, kept.collect())) == sorted(e[:3] for e in left)
    assert sorted((r.u, r.v, r.m, r.tree) for r in forest.collect()) == sorted(e[:4] for e in left if e[4])


def test_running_sums_go_on_over_tasks(spark):
    rows = spark.range(997).select("id", (F.col("id") % 7 - 3).alias("x"), F.lit(1).cast("long").alias("one")).repartition(5)
    got = running_sums(rows, ["id"], {"sum": "x", "n": "one"}).orderBy("id").collect()
    assert [r["sum"] for r in got] == np.cumsum(np.arange(997) % 7 - 3).tolist() and [r.n for r in got] == list(range(1, 998))
    assert running_sums(rows.limit(0), ["id"], {"sum": "x"}).isEmpty()
