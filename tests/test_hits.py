"""Mapping queries without hits as rows: lists of positions as bytes, whole queries folded in tasks, against the other form."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandweave.operators import mapping


def test_lists_of_positions_as_bytes():
    r = np.random.default_rng(1)
    for paths, places in ((3, 5), (2**31, 2**31), (30, 2400)):
        n = r.integers(1, 300, 40)
        spots = np.concatenate([np.sort((r.integers(0, paths, k) << 32) | r.integers(0, places, k)) for k in n])
        lists, upto = mapping._packed(spots, n), np.cumsum(n)
        for low, high in ((0, 40), (7, 27)):
            got, sizes = mapping._unpacked(lists.slice(low, high - low))
            assert (sizes == n[low:high]).all() and (got == spots[(upto - n)[low] : upto[high - 1]]).all()
    got, sizes = mapping._unpacked(pa.array([None, b""], pa.binary()))
    assert not len(got) and sizes.tolist() == [0, 0]


@pytest.fixture(scope="module")
def relations(spark):
    r = random.Random(5)
    index = [(m, t, p) for m in range(40) for t, p in {(r.randrange(4), r.randrange(12)) for _ in range(r.randrange(1, 9))}]
    queries = [(q, i, m) for q in range(25) for i, m in enumerate(r.choices([*range(45), None], k=r.randrange(1, 60)))]
    return queries, index


def frames(spark, relations, name=lambda t: t, kind="long"):
    queries, index = relations
    return spark.createDataFrame(queries, "qid long, qpos int, mx long"), spark.createDataFrame([(m, name(t), p) for m, t, p in index], f"mx long, tid {kind}, tpos int")


def maps(queries, index):
    return [sorted(map(str, x.collect())) for x in (mapping.map_to_bed(queries, index), mapping.map_to_bed(queries, index, 2, 3), mapping.map_trend(queries, index, 1, 0.05, 6), mapping.map_trend(queries, index, 1, 0.05))]


def test_folded_queries_map_as_rows_do(spark, monkeypatch, relations):
    queries, index = frames(spark, relations)
    paths = index.selectExpr("tid", "tpos AS pos", "tpos AS elem").distinct()
    whole = maps(queries, index), sorted(map(str, mapping.map_to_paf(queries, index, paths).collect()))
    monkeypatch.setattr(mapping, "SPOTS", 2)
    assert whole == (maps(queries, index), sorted(map(str, mapping.map_to_paf(queries, index, paths).collect())))
    monkeypatch.setattr(mapping, "LONG", 25)  # many queries go by rows
    assert whole == (maps(queries, index), sorted(map(str, mapping.map_to_paf(queries, index, paths).collect())))


def test_paths_of_any_name(spark, relations):
    """Names of paths that are text, null or beyond 32 bits."""
    plain = maps(*frames(spark, relations))
    for names, kind in (((None, "x", "y", "z"), "string"), ((-5, 7, 2**40, 2**62), "long")):
        got = maps(*frames(spark, relations, lambda t: names[t], kind))
        assert [sorted(x.replace(f"tname={t},", f"tname={n!r},") for x in rows for t, n in enumerate(names) if f"tname={t}," in x) for rows in plain] == got


def test_positions_come_in_bounded_parts(spark, monkeypatch):
    """Markers of many positions, in parts of up to SPOTS, one of them the first, however Arrow cuts the rows."""
    index = {(m, t, p) for m in range(9) for t in range(3) for p in range(1 + 7 * m)}
    monkeypatch.setattr(mapping, "SPOTS", 8)
    try:
        for size in ("5", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            rows = mapping._spots(spark.createDataFrame(sorted(index), "mx long, tid long, tpos int")).rows.collect()
            assert max(r["n"] for r in rows) <= 8 and sorted(r["mx"] for r in rows if r["first"]) == list(range(9))
            spots, n = mapping._unpacked(pa.array([bytes(r["spots"]) for r in rows], pa.binary()))
            assert n.tolist() == [r["n"] for r in rows]
            assert sorted(zip(np.repeat([r["mx"] for r in rows], n).tolist(), (spots >> 32).tolist(), (spots & 0xFFFFFFFF).tolist(), strict=True)) == sorted(index)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hits_are_not_shuffled(spark, relations):
    queries, index = frames(spark, relations)
    for found in (mapping.map_to_bed(queries, index), mapping.map_trend(queries, index)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "tpos" not in "".join(x for x in plan.splitlines() if "Exchange" in x) and "FlatMapGroups" not in plan


def test_trends_of_many_groups_are_those_of_one(monkeypatch):
    r = np.random.default_rng(3)
    sizes = np.concatenate([r.integers(1, 40, 200), [90, 300]])
    starts = np.cumsum(sizes) - sizes
    x = np.concatenate([np.sort(r.integers(0, 50, n)) if i % 3 else r.integers(0, 9, n) for i, n in enumerate(sizes)])
    t = r.integers(0, 30, len(x))
    got = mapping._trend_signs(x, t, starts, sizes, 0.01)
    for s, n, sign in zip(starts, sizes, got, strict=True):
        one, line = mapping.mann_kendall(x[s : s + n].astype(float), t[s : s + n].astype(float), alpha=0.01), n * (x[s : s + n] * t[s : s + n]).sum() - x[s : s + n].sum() * t[s : s + n].sum()
        assert sign == ("." if one.p >= 0.01 or line == 0 else "+" if line > 0 else "-")


def test_lifted_once(spark):
    """Queries whose markers are numbered without gaps, with gaps and with repeats; a record meets its query once."""
    paf = spark.createDataFrame([(q, 9, a, b, "x") for q in "abc" for a, b in ((0, 2), (1, 4), (2, 2))], "qname string, qlength long, qstart int, qend int, tname string")
    spots = [("a", i, i * 10) for i in range(4)] + [("b", i, i * 10) for i in (0, 1, 2, 4)] + [("c", i, p) for i, p in ((0, 5), (2, 7), (2, 8))]
    found = mapping.liftover(paf, spark.createDataFrame(spots, "qid string, idx int, pos long"))
    assert sorted(map(tuple, found.collect())) == sorted([
        ("a", 30, 0, 20, "x"), ("a", 30, 20, 20, "x"), ("b", 40, 0, 20, "x"), ("b", 40, 10, 40, "x"), ("b", 40, 20, 20, "x"),
        ("c", 8, 5, 7, "x"), ("c", 8, 5, 8, "x"), *[("c", 8, a, b, "x") for a in (7, 8) for b in (7, 8)],
    ])
    plain = mapping.liftover(paf, spark.createDataFrame(spots[:4], "qid string, idx int, pos long"))._jdf.queryExecution().executedPlan().toString()
    assert "qstart" not in "".join(x for x in plain.splitlines() if "Exchange hashpartitioning" in x)
