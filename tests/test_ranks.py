"""Ranks of groups whose values are never gathered, against sorted lists and against the gathered form."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandweave.operators import mapping, scaffold


@pytest.mark.parametrize("width", [4, 1024])
def test_values_at_places(spark, monkeypatch, width):
    monkeypatch.setattr(mapping, "WIDTH", width)
    r = random.Random(width)
    rows = [(k, r.randrange(-30, 30)) for k in "abc" for _ in range(r.randrange(1, 200))] + [("d", 7)]
    groups = defaultdict(list)
    for k, v in rows:
        groups[k].append(v)
    places = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "last": lambda n: n - 1}
    got = mapping.values_at(spark.createDataFrame(rows, "k string, v long").repartition(3), ["k"], "v", places).collect()
    want = {k: (len(v), sorted(v)[(len(v) - 1) // 2], sorted(v)[len(v) // 2], max(v)) for k, v in groups.items()}
    assert {x.k: (x.n, x.low, x.high, x["last"]) for x in got} == want


def test_long_queries_map_alike(spark, monkeypatch):
    r = random.Random(2)
    paths = spark.createDataFrame([(t, p, f"e{t}_{p}") for t in range(3) for p in range(6)], "tid long, pos int, elem string")
    index = spark.createDataFrame([(m, r.randrange(3), r.randrange(6)) for m in range(60) for _ in range(2)], "mx long, tid long, tpos int").distinct()
    queries = spark.createDataFrame([(q, i, r.randrange(60)) for q, n in ((1, 300), (2, 40), (3, 5)) for i in range(n)], "qid long, qpos int, mx long")

    def results():
        bed = mapping.map_to_bed(queries, index, 1, 2)
        return [sorted(map(tuple, x.collect())) for x in (bed, mapping.map_to_paf(queries, index, paths), scaffold.bed_to_path(bed))]

    whole = results()
    monkeypatch.setattr(mapping, "LONG", 30)
    monkeypatch.setattr(mapping, "WIDTH", 8)
    assert results() == whole and all(whole)
