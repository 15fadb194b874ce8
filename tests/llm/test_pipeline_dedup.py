import random
from collections import Counter

import corpus_pipeline
from strandweave.llm.common import table

from .test_neardup import shingles


def kept_by_brute_force(rows, percent):
    """Ids that stay when every pair's full sets are compared: the least of each component."""
    sets = [(r.doc_id, shingles(r.text)) for r in rows if r.doc_id is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return Counter(i for i in root if find(i) == i)


def test_near_dedup_takes_pairs_from_80_percent(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.collect()
    expected = kept_by_brute_force(rows, 80)
    assert len(expected) < len(kept_by_brute_force(rows, 85))
    assert Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == expected


def test_near_dedup_around_its_limit(spark):
    """Copies of one text with a tail of their own, from 0.70 to 0.95 similar."""
    seeded, rows = random.Random(8), []
    for n in range(60):
        base = [f"w{seeded.randrange(10**6)}" for _ in range(204)]
        rows.append((2 * n, " ".join(base)))
        changed = int(200 * (1 - (0.70 + 0.25 * n / 60)) / 2)
        rows.append((2 * n + 1, " ".join(base[: 204 - changed] + [f"x{seeded.randrange(10**6)}" for _ in range(changed)])))
    docs = spark.createDataFrame([(i, text, "en", "a", len(text)) for i, text in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == kept_by_brute_force(docs.collect(), 80)
