import numpy as np
import pytest

from strandweave.llm.common import table
from strandweave.llm.multiindex import cell_gaps, lloyd, nearest, probes
from strandweave.llm.topk import integer_neighbours

from .helpers import SF, clashing


def odd_vectors(spark):
    random = np.random.default_rng(1)
    rows = [(i, [float(x) for x in random.normal(size=4)]) for i in range(60)]
    rows += [(i, [0.5, 0.25, -0.5, 1.0]) for i in range(100, 220)]  # copies
    rows += [(500, None), (501, [1.0, None, 0.0, 2.0]), (502, [float("nan"), 0.0, 0.0, 1.0]), (503, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (100, [0.5, 0.25, -0.5, 1.0]), (700, [0.0] * 4), (800, [1e5, -1e5, 3e4, 2.0]), (900, [])]
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, label int")


def good(rows, zero):
    return [(r.vec_id, np.array(r.embedding, np.float32).astype(float)) for r in rows if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and (zero or any(r.embedding))]


def brute_top(rows, k, every):
    rows = [(i, np.floor(256 * v).astype(np.int64)) for i, v in good(rows, True)]
    out = []
    for q, v in {i: v for i, v in rows if i % every == 0}.items():
        found = sorted((-int(v @ w), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5])
def test_top_k_is_brute_force(spark, k):
    for frame, every in ((table(spark, SF, "embeddings"), 50), (clashing(odd_vectors(spark), "id", "v", "score", "rank"), 20)):
        got = sorted(tuple(r) for r in integer_neighbours(frame, k, every).select("query_id", "rank", "vec_id", "score").collect())
        assert got == brute_top(frame.collect(), k, every)
    assert integer_neighbours(frame.limit(0)).collect() == []


@pytest.mark.parametrize("bound", [("BLOCK_BYTES", 64 * 8 * 3), ("WORK_BYTES", 24 * (4 + 2048) * 3)])
def test_top_k_in_blocks(spark, monkeypatch, bound):
    from strandweave.llm import topk

    monkeypatch.setattr(topk, *bound)
    monkeypatch.setattr(topk, "BINS", 4)
    frame = table(spark, SF, "embeddings")
    got = sorted(tuple(r) for r in integer_neighbours(frame, 5, 25).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(frame.collect(), 5, 25)


def brute_near(rows, k, every):
    rows, out = good(rows, False), {}
    for q, v in {i: v for i, v in rows if i % every == 0}.items():
        out[q] = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))[:k]
    return out


def check_near(frame, k, every, least_recall, **options):
    got = {}
    for r in sorted(nearest(frame, k, every, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    true = {q: x for q, x in brute_near(frame.collect(), k, every).items() if x}
    assert set(got) == set(true) and all(x == sorted(x) for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in true[q]}) for q in true)
    assert hits / sum(len({i for _, i in x}) for x in true.values()) >= least_recall
    exact = {(q, i): s for q, x in true.items() for s, i in x}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, x in got.items() for s, i in x if (q, i) in exact)


def test_neighbours_reach_the_recall(spark):
    check_near(table(spark, "/root/testdata/sf0.1", "embeddings"), 10, 100, 0.9)


@pytest.mark.parametrize("spread, most", [(True, 0.9), (False, 0.2)])
def test_the_index_saves_work(spark, spread, most):
    """20,000 vectors, spread or in clusters: recall of 0.9 or more, with only a share of all pairs compared."""
    random = np.random.default_rng(6)
    v = random.normal(size=(20_000, 8))
    if not spread:
        v = random.normal(size=(300, 8))[random.integers(0, 300, 20_000)] + 0.05 * v
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = nearest(frame, 10, 100, sample=5000).collect()
    found, compared = {}, {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
        compared[r.query_id] = r.compared
    hits = 0
    for q in range(0, 20_000, 100):
        gaps = ((v - v[q]) ** 2).sum(1)
        gaps[q] = np.inf
        hits += len(found[q] & set(np.argsort(gaps)[:10].tolist()))
    assert hits >= 0.9 * 2000
    assert sum(compared.values()) <= most * 200 * 20_000


def test_neighbours_of_odd_rows(spark):
    frame = clashing(odd_vectors(spark), "id", "v", "cell", "ids", "score", "part", "compared")
    check_near(frame, 10, 20, 1.0, recall=1.0)
    assert nearest(frame.limit(0)).collect() == []


def test_crowded_cells_span_parts(spark, monkeypatch):
    from strandweave.llm import multiindex

    monkeypatch.setattr(multiindex, "PART", 7)
    check_near(odd_vectors(spark), 10, 20, 1.0, recall=1.0)


def test_least_ids():
    from strandweave.llm.multiindex import least_ids

    assert least_ids([5, 5, 5, 5, 1, 9, 7, 1], 2) == [1, 1, 5, 5, 7]
    assert least_ids([3], 10) == [3] and least_ids([], 3) == []


def test_probes_follow_summed_distance():
    random = np.random.default_rng(3)
    rows = random.normal(size=(500, 6))
    halves = lloyd(rows[:, :3], 7), lloyd(rows[:, 3:], 5)
    counts = np.ones(35, np.int64)
    for q in rows[:20]:
        gaps = cell_gaps(q, halves)
        assert np.allclose(gaps[probes(q, halves, counts, 35)], np.sort(gaps))
