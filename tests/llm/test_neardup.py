import random

import numpy as np
import pytest

from strandweave.llm import neardup
from strandweave.llm.common import table
from strandweave.llm.neardup import Plan, near_duplicates

from .helpers import clashing, odd_documents


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    """doc_id -> component: every pair's full sets, components by union."""
    sets = [(r.doc_id, shingles(r.text)) for r in rows if r.doc_id is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def check(frame, plan=Plan()):
    rows = frame.collect()
    got = near_duplicates(frame, plan).collect()
    true = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.kept) == ((true[r.doc_id], true[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(r.doc_id), len(shingles(r.text))) for r in rows)
    return got


def test_documents_match_brute_force(spark):
    got = check(table(spark, "/root/testdata/sf0.01", "documents"))
    assert sum(not r.kept for r in got) > 10


def test_odd_rows(spark):
    check(clashing(odd_documents(spark), "id", "digest", "node", "component", "n_shingles", "members", "key"))
    frame = odd_documents(spark)
    assert near_duplicates(frame.limit(0)).collect() == []
    check(spark.createDataFrame([(5, "one two three four five six seven"), (9, "other words altogether in this text"), (5, "other words altogether in this text")], "doc_id long, text string"))


@pytest.mark.parametrize("plan", [Plan(), Plan(bucket=3, group=4000)])
def test_large_group_of_near_copies(spark, plan):
    seeded = random.Random(4)
    base = [f"w{seeded.randrange(4000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(base)
        for _ in range(seeded.randrange(1, 8)):
            copy[seeded.randrange(300)] = f"x{seeded.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(f"y{seeded.randrange(10**6)}" for _ in range(40))) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), plan)


def test_groups_are_bounded_by_shingles(spark):
    """A group of 40 documents of 2000 words is confirmed in tasks of a few of them each."""
    words = [f"w{i}" for i in range(2000)]
    docs = spark.createDataFrame([(i, " ".join(words[:-1] + [f"x{i}"])) for i in range(40)], "doc_id long, text string")
    plan = Plan(group=20_000)
    groups = spark.createDataFrame([(i, 0, 1996) for i in range(40)], "id long, component long, n_shingles long")
    links = neardup.confirmed_links(docs, groups, plan, "doc_id", "text")
    assert {x for r in links.collect() for x in r} == set(range(40))
    dealt = links._jdf.queryExecution().toString()
    assert "low" in dealt and "high" in dealt


def test_sketch_estimates_similarity():
    plan, random_ = Plan(), np.random.default_rng(5)
    errors = []
    for j in (0.7, 0.85, 0.95):
        for _ in range(60):
            both = random_.integers(0, 2**63, 400, np.uint64)
            own = int(400 * (1 - j) / (2 * j))
            a, b = (np.concatenate([both, random_.integers(0, 2**63, own, np.uint64)]) for _ in range(2))
            x, y = (np.frombuffer(neardup.odd_sketch(neardup.minhash(s, plan.samples), plan.bits).tobytes(), np.uint64) for s in (a, b))
            odd = np.bitwise_count(x ^ y).sum()
            errors.append(neardup.estimate(odd, plan) - j)
            assert j < 0.85 or odd <= plan.sketch_limit
    assert abs(np.mean(errors)) < 0.02


def test_set_links_form_the_components():
    random_ = np.random.default_rng(6)
    sets = [np.unique(random_.integers(0, 30, 25)).astype(np.uint64) for _ in range(40)]
    links = neardup.set_links(sets, 60)
    assert len(links) < 40
    root = list(range(40))
    for i, j in links:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    pairs = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
    assert all(root[i] == root[j] for i, j in pairs) and all((max(i, j), min(i, j)) in pairs for i, j in links)
