import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandweave.llm import resample as module
from strandweave.llm.common import table
from strandweave.llm.resample import Features, drawn_documents, feature_counts, resample

from .helpers import SF, clashing, odd_documents


def buckets_of(text, size=10_000):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % size for r in runs)


def brute(docs, target, percent=5):
    s, t = Counter(), Counter()
    for r in docs:
        s += buckets_of(r.text)[1]
    for r in target:
        t += buckets_of(r.text)[1]
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for r in docs:
        n, found = buckets_of(r.text)
        weight = sum(k * math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b, k in found.items())
        h = int(hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((n >= 20, r.doc_id, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    drawn = percent * len(able) // 100
    return sorted(map(repr, [(*r[1:], i + 1 if i < drawn else None) for i, r in enumerate(able)] + [(*r[1:], None) for r in rows if not r[0]]))


def rows_of(df):
    return sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


@pytest.mark.parametrize("block", [module.BLOCK, 7])
def test_against_whole_lists(spark, block):
    docs, target = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    features = Features()
    module_block, module.BLOCK = module.BLOCK, block
    try:
        assert rows_of(resample(docs, target, features=features)) == brute(docs.collect(), target.collect())
        for r in docs.limit(30).collect():  # blocks of any length have the same runs
            found = list(features.of(r.text.encode()))
            assert (sum(n for n, _ in found), Counter(b for _, a in found for b in a.tolist())) == buckets_of(r.text)
    finally:
        module.BLOCK = module_block


def test_odd_rows_empty_tables_and_clashing_columns(spark):
    docs, target = clashing(odd_documents(spark), "weight", "score", "rank", "n_words", "_row", "_one", "_place", "bucket"), table(spark, SF, "benchmark")
    assert rows_of(resample(docs, target, percent=50)) == brute(docs.collect(), target.collect(), 50)
    assert rows_of(resample(docs, target.limit(0), percent=100)) == brute(docs.collect(), [], 100)
    assert resample(docs.limit(0), target).collect() == []
    assert feature_counts(docs.limit(0)).collect() == []


def test_draws_what_is_like_the_target(spark):
    docs = spark.createDataFrame([(i, ("red green blue " if i % 4 == 0 else "one two three ") * 10) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([("red green blue " * 30,)] * 5, "text string")
    drawn = drawn_documents(docs.withColumn("weight", F.lit("x")), target, percent=20).collect()
    assert len(drawn) == 80 and all("red" in r.text for r in drawn) and sorted(r["rank"] for r in drawn) == list(range(1, 81))
