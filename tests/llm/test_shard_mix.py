import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.llm.common import table
from strandweave.llm.mixing import fit_budget, mix_sources
from strandweave.llm.sharding import shard_by_bytes, write_shards

from .helpers import SF, clashing, odd_documents


def test_shards_are_contiguous_balanced_and_gapless(spark):
    docs = table(spark, SF, "documents")
    rows = sorted(shard_by_bytes(docs, 5).collect())
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert [r.doc_id for r in rows] == sorted(texts)
    assert all(r["size"] == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "bytes" and r.grown_shard is None for r in rows)
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    sums, at = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.slot == at[r.shard]
        at[r.shard] += 1
        sums[r.shard] += r["size"]
    share = sum(sums.values()) / 5
    assert all(abs(sums[s] - share) <= max(r["size"] for r in rows) for s in range(5))


def test_shards_of_odd_rows(spark, tmp_path):
    docs = clashing(odd_documents(spark), "size", "shard", "slot", "row", "before", "one")
    rows = shard_by_bytes(docs, 3).collect()
    assert len(rows) == docs.count()
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert shard_by_bytes(docs.limit(0), 3).collect() == []
    write_shards(table(spark, SF, "documents"), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == table(spark, SF, "documents").count()


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 6), max_size=6), st.integers(0, 400), st.sampled_from([4, 16, 1 << 16]))
def test_fit_budget(histogram, budget, width):
    lengths, counts = np.array(list(histogram), np.int64), np.array(list(histogram.values()), np.int64)
    take = fit_budget(lengths, counts, budget, width)
    assert (take >= 0).all() and (take <= counts).all() and (lengths * take).sum() <= max(budget, 0)
    if width > 400 and budget >= (lengths * counts).sum():
        assert (lengths * take).sum() == (lengths * counts).sum()


def test_fit_budget_is_exact_where_it_can_be():
    lengths = np.arange(1, 200)
    for budget in (1, 7, 1234, 9_999, 19_899):
        assert (lengths * fit_budget(lengths, np.ones_like(lengths), budget)).sum() == budget


def test_fit_budget_takes_documents_longer_than_the_knapsack():
    for lengths, counts, budget, best in (([70_000, 300_000], [1, 1], 100_000, 70_000), ([90_000, 40_000, 7], [1, 2, 1], 130_000, 130_000), ([400_000, 10], [3, 5], 800_049, 800_040)):
        assert (np.array(lengths) * fit_budget(np.array(lengths), np.array(counts), budget)).sum() == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8), st.integers(0, 120), st.sampled_from([2, 8, 1 << 16]))
def test_fit_budget_of_few_documents_is_near_the_best(sizes, budget, width):
    """Against all subsets: the best fill is missed by less than the longest document, and not at all within the knapsack."""
    lengths, counts = np.unique(sizes, return_counts=True)
    sums = {0}
    for x in sizes:
        sums |= {s + x for s in sums}
    best = max(s for s in sums if s <= budget)
    filled = (lengths * fit_budget(lengths, counts, budget, width)).sum()
    assert best - max(sizes) < filled <= best


def test_rows_without_an_id_do_not_meet_in_one_run(spark):
    docs = spark.createDataFrame([(None, "some four word text", "a" if i % 4 else "b") for i in range(4000)], "doc_id long, text string, source string").repartition(3)
    rows = mix_sources(docs).collect()
    taken = defaultdict(int)
    for r in rows:
        taken[r.source_size] += r.taken
    assert len(rows) == 4000 and all(abs(taken[s] - t) < 4 for s, t in {(r.source_size, r.target) for r in rows})
    name = F.concat(F.lit("null "), F.monotonically_increasing_id().cast("string"))
    assert docs.select(F.shiftrightunsigned(F.xxhash64(F.lit(17), name, F.lit(4)), 52)).distinct().count() > 1000


def brute_targets(sizes):
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in free}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def check_mix(spark, docs):
    rows = mix_sources(docs).collect()
    given = docs.collect()
    assert len(rows) == len(given)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in given:
        sizes[r.source] += len((r.text or "").encode().split())
    by_size = defaultdict(set)
    for s, n in sizes.items():
        by_size[n].add(s)
    expected = brute_targets(sizes)
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and r["source_size"] in by_size
    for (target, size) in {(r.target, r.source_size) for r in rows}:
        assert any(abs(expected[s] - target) < 1e-6 * max(1, target) for s in by_size[size])
        targets[size, round(target, 3)] = target
    for r in rows:
        taken[r.source_size, round(r.target, 3)] += r.taken
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs).collect()))
    return taken, targets


def test_mix_meets_targets(spark):
    taken, targets = check_mix(spark, table(spark, "/root/testdata/sf0.01", "documents"))
    assert all(abs(taken[k] - targets[k]) <= 1 for k in targets)


def test_mix_of_odd_rows(spark):
    docs = clashing(odd_documents(spark), "size", "key", "id", "n", "order", "run", "target")
    check_mix(spark, docs)
    assert mix_sources(docs.limit(0)).collect() == []
