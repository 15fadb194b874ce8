"""Pairs of barcodes that share markers: pairs are no rows of a shuffle, and markers of many barcodes come in blocks."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from strandweave.operators import incidence, overlap
from strandweave.plans import shared


def rows_of(kind):
    some = random.Random(3)
    return sorted({(kind(some.randrange(40)), int(some.paretovariate(0.6)) % 300) for _ in range(1500)})


def brute(rows):
    held, common = defaultdict(set), {}
    for bx, mx in rows:
        held[bx].add(mx)
    for u, v in combinations(sorted(held), 2):
        if held[u] & held[v]:
            common[u, v] = sorted(held[u] & held[v])
    return common


@pytest.mark.parametrize("depth", [256, 3, 1])
@pytest.mark.parametrize("kind", [int, str])
def test_pairs_in_blocks(spark, monkeypatch, depth, kind):
    monkeypatch.setattr(overlap, "DEPTH", depth, raising=False)
    rows = rows_of(kind)
    expected = brute(rows)
    bxmx = spark.createDataFrame(rows, f"bx {'long' if kind is int else 'string'}, mx long").repartition(3)
    found = {(u, v): m for u, v, m in overlap.overlap_edges(bxmx, 2).collect()}
    assert found == {k: len(x) for k, x in expected.items() if len(x) >= 2}
    assert {(u, v): list(x) for u, v, x in overlap.shared_markers(bxmx).collect()} == expected


def test_no_pair_is_shuffled(spark):
    plan = overlap.overlap_edges(spark.createDataFrame([(1, 1), (2, 1)], "bx long, mx long"), 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(u" in plan and "Exchange hashpartitioning(v" not in plan
    assert not any("Exchange" in line and "v#" in line.split("hashpartitioning(")[1].split("]")[0] for line in plan.splitlines() if "hashpartitioning(" in line)


def test_filters_on_spread_rows(spark, monkeypatch):
    rows = spark.createDataFrame(rows_of(int), "bx long, mx long")
    expected = sorted(map(tuple, incidence.filter_incidence(rows, 2).collect()))
    monkeypatch.setattr(shared, "MANY", 50)
    assert sorted(map(tuple, incidence.filter_incidence(rows, 2).collect())) == expected and expected


def test_incidence_of_bounded_shares(spark, monkeypatch):
    """Repeated rows are told apart by as many tasks as there are shares, not by as many as Spark shuffles to."""
    held = rows_of(int)
    rows = spark.createDataFrame([*held, *held, (None, 1), (1, None)], "a long, b long")
    monkeypatch.setattr(shared, "MANY", 50)
    shares = [sorted(map(tuple, x)) for x in incidence.incidence(rows, "a", "b").rdd.glom().collect()]
    assert sorted(sum(shares, [])) == held
    assert len(shares) == -(-(2 * len(held) + 2) // 50) and max(map(len, shares)) < 100


def test_nulls_and_repeats(spark):
    rows = [(None, 1), (1, 1), (1, 1), (2, 1), (2, 1), (3, 1), (4, None), (5, None)]
    found = overlap.overlap_edges(spark.createDataFrame(rows, "bx long, mx long"), 1)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 4), (1, 3, 2), (2, 3, 2)]


@pytest.mark.parametrize("kind", [int, str])
def test_pairs_are_counted_from_lists(spark, kind):
    """Barcodes whose lists come in many batches, and batches of many barcodes; no pair is a row of Spark's."""
    rows = rows_of(kind)
    expected = {k: len(x) for k, x in brute(rows).items()}
    bxmx = spark.createDataFrame(rows, f"bx {'long' if kind is int else 'string'}, mx long")
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            edges = overlap.overlap_edges(bxmx, 1)
            assert {(u, v): m for u, v, m in edges.collect()} == expected
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Generate explode(vs" not in edges._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", [int, str])
@pytest.mark.parametrize("held", [1_000_000, 60, 0])
def test_shared_markers_are_gathered_in_arrays(spark, monkeypatch, kind, held):
    """Barcodes whose lists come in many batches, batches of many barcodes, and barcodes of too many pairs; no pair is a row of
    Spark's but for the last."""
    monkeypatch.setattr(overlap, "HELD", held, raising=False)
    rows = rows_of(kind)
    expected = {k: x for k, x in brute(rows).items() if len(x) >= 2}
    bxmx = spark.createDataFrame(rows, f"bx {'long' if kind is int else 'string'}, mx long")
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            pairs = overlap.shared_markers(bxmx, 2)
            assert sorted((u, v, list(x)) for u, v, x in pairs.collect()) == sorted((u, v, x) for (u, v), x in expected.items())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ("Generate explode(vs" in pairs._jdf.queryExecution().executedPlan().toString()) == (held < 1_000_000)


def test_shared_markers_of_nulls_and_repeats(spark):
    rows = [(None, "a"), (1, "a"), (1, "a"), (2, "b"), (2, "a"), (3, "a"), (3, "b"), (4, None), (5, None)]
    found = overlap.shared_markers(spark.createDataFrame(rows, "bx int, mx string"))
    assert sorted((u, v, list(x)) for u, v, x in found.collect()) == [(1, 2, ["a", "a"]), (1, 3, ["a", "a"]), (2, 3, ["a", "b"])]
