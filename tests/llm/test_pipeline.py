import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from strandweave.llm.bpe import TreeBPE
from strandweave.llm.common import table

from .helpers import odd_documents
from .test_neardup import brute
from .test_shard_mix import brute_targets


def through(spark, docs):
    """Each stage's input and output, written and read again between."""
    found = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, ""), name)
        found.append((docs, out))
        docs = out
    return found


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_stages(spark, which):
    docs = table(spark, "/root/testdata/sf0.01", "documents") if which == "sf" else odd_documents(spark)
    (before, spoken), (_, single), (_, mixed), (_, coded) = through(spark, docs)
    for frame in (spoken, single, mixed):
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    heard, kept = Counter(map(tuple, before.collect())), Counter(map(tuple, spoken.collect()))
    assert not kept - heard
    assert not any(r[1] and any(map(str.isalpha, r[1])) for r in heard - kept) and all(any(map(str.isalpha, r[1] or "")) for r in kept)

    true = brute(spoken.collect(), 80)
    assert Counter(r.doc_id for r in single.collect() if r.doc_id is not None) == Counter({i for i, c in true.items() if i == c})
    assert single.filter("doc_id IS NULL").count() == spoken.filter("doc_id IS NULL").count()

    sizes, taken = defaultdict(int), defaultdict(int)
    for frame, sums in ((single, sizes), (mixed, taken)):
        for r in frame.collect():
            sums[r.source] += len((r.text or "").encode().split())
    targets = brute_targets(sizes)
    longest = max(len((r.text or "").encode().split()) for r in single.collect())
    off = {s: (taken[s], t) for s, t in targets.items() if abs(taken[s] - t) > (0.005 * t if which == "sf" else longest)}
    assert not off

    core = TreeBPE(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).core
    expected = Counter()
    for r in mixed.collect():
        ids = core.encode_ordinary(r.text or "")
        expected[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded.collect()) == expected


def test_empty_table(spark):
    assert through(spark, odd_documents(spark).limit(0))[-1][1].count() == 0


def test_run_is_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    got = Counter(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert got == Counter(map(tuple, through(spark, table(spark, sf, "documents"))[-1][1].collect()))
