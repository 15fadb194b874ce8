import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from strandweave.llm import hpyp
from strandweave.llm.common import table
from strandweave.llm.hpyp import Corpus, Model, Part, Totals, draw_tables, draw_vast, log_gamma, log_seatings, perplexity, score_texts

from .helpers import SF, clashing, odd_documents

SMALL = Model(context_bits=4, block_tokens=300)


def check_base(rows, docs):
    texts = [(d.doc_id, (d.text or "").encode().lower().split() + [None]) for d in docs]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    counts = Counter(w for i, ws in texts if not fold(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    key = lambda x: (x[0] is None, x[0] or 0, round(x[3], 6))
    expected = sorted(((i, fold(i), len(ws), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), sum(counts[w] > 0 for w in ws)) for i, ws in texts), key=key)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.base_score, r.n_known) for r in rows), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[:3] == b[:3] and a[4] == b[4] and abs(a[3] - b[3]) <= 1e-9 * max(1, abs(b[3]))
    assert all(r.train_tokens == n and r.score <= 0 and np.isfinite(r.score) for r in rows)


def test_scores_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    scored = score_texts(docs).cache()
    check_base(scored.collect(), docs.collect())
    for r in perplexity(scored).collect():
        assert r.perplexity < r.base_perplexity


@pytest.mark.parametrize("model", [Model(), SMALL])
def test_odd_rows(spark, model):
    docs = clashing(odd_documents(spark), "held", "held_out", "score", "id", "block", "part")
    check_base(score_texts(docs, model=model).collect(), docs.collect())
    assert score_texts(docs.limit(0), model=model).collect() == []


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    rows = score_texts(docs).collect()
    assert rows and all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in rows)


def test_blocks_do_not_matter_to_counts(spark):
    docs = table(spark, SF, "documents")
    check_base(score_texts(docs, model=SMALL).collect(), docs.collect())


def part_of(tokens, model, discounts=(0.6, 0.7)):
    """One part over (context, word) tokens."""
    keys = Counter(tokens)
    words = sorted({w for _, w in keys})
    pairs = sorted((w, u, n) for (u, w), n in keys.items())
    of_word = Counter(p[0] for p in pairs)
    columns = {"sizes": [of_word[w] for w in words], "contexts": [p[1] for p in pairs], "counts": [p[2] for p in pairs]}
    seen = np.bincount([u for u, _ in tokens], minlength=model.contexts)
    return Part({k: hpyp._pack(np.array(v, np.int32)) for k, v in columns.items()}, model), Corpus(seen, len(tokens), discounts, len(words))


def sampled(tokens, model, seed=0, **kinds):
    """Averaged probabilities of the pairs, and each sweep's number of tables."""
    part, corpus = part_of(tokens, model, **kinds)
    random, average, tables = np.random.default_rng(seed), 0.0, []
    for sweep in range(model.sweeps):
        part.sweep(corpus, Totals.of(part.sums()), random)
        tables.append(int(part.tables.sum()))
        if model.is_sample(sweep):
            average = average + part.probabilities(corpus, Totals.of(part.sums())) / model.samples
    return {(int(u), int(w)): p for u, w, p in zip(part.context, part.word, average)}, tables


def some_tokens(n, contexts, words, seed=1):
    random = np.random.default_rng(seed)
    return [(int(u), int(min(w, words))) for u, w in zip(random.integers(0, contexts, n), random.zipf(1.5, n))]


def test_sweeps_keep_counts_and_probabilities_sum_to_one():
    model = Model(context_bits=2)
    part, corpus = part_of(some_tokens(6000, 4, 400), model)
    (d1, d2), v = corpus.discounts, corpus.vocabulary
    for sweep in range(5):
        part.sweep(corpus, Totals.of(part.sums()), np.random.default_rng(sweep))
        tables, customers, totals = part.tables, part.customers(), Totals.of(part.sums())
        assert (tables >= 1).all() and (tables <= part.count).all() and (tables[part.count == 1] == 1).all()
        assert (part.seated >= 1).all() and (part.seated <= customers).all()
        unknown = (1 + d1 * part.seated.sum()) / (v + 1) / (1 + customers.sum())
        prior = (customers - d1 * part.seated) / (1 + customers.sum()) + unknown
        assert abs(prior.sum() + unknown - 1) < 1e-12
        known = part.probabilities(corpus, totals)
        for u in range(4):
            mine = part.context == u
            share = (1 + d2 * totals.in_context[u]) / (1 + corpus.context_counts[u])
            unseen = np.setdiff1d(np.arange(v), part.word[mine])
            assert abs(known[mine].sum() + share * (prior[unseen].sum() + unknown) - 1) < 1e-9


def test_log_gamma():
    x = np.array([0.1, 0.5, 1, 2.5, 10, 1e3, 1e6])
    assert np.allclose(log_gamma(x), [math.lgamma(i) for i in x], rtol=1e-10, atol=1e-10)


def law_of(c, new, d):
    """Chances of 1 to c tables, by the recursion over customers in plain numbers of any size."""
    ways = [Fraction(1)]
    d = Fraction(d).limit_denominator(1000)
    for n in range(1, c):
        ways = [(ways[t - 1] if t else 0) + (n - d * (t + 1)) * (ways[t] if t < n else 0) for t in range(n + 1)]
    weights = [w * Fraction(new).limit_denominator(1000) ** t for t, w in enumerate(ways)]
    return np.array([float(w / sum(weights)) for w in weights])


@pytest.mark.parametrize("c, new, d", [(2, 0.4, 0.5), (6, 1.3, 0.5), (40, 0.3, 0.8), (40, 20, 0.8)])
def test_one_draw_has_the_exact_law(c, new, d):
    """Whatever the tables were, one draw has the law of a dish's seating."""
    exact, n = law_of(c, new, d), 40_000
    for old in (1, c):
        drawn = draw_tables(np.random.default_rng(2), np.full(n, c), np.full(n, old), d, lambda at, i: np.full(np.broadcast(at, i).shape, new), lambda at, t: (t - 1) * np.log(new))
        assert np.abs(np.bincount(drawn, minlength=c + 1)[1:] / n - exact).max() < 0.012


@pytest.mark.parametrize("d", [0.4, 0.7, 0.95])
@pytest.mark.parametrize("new", [0.02, 3, 90, 2000])
def test_many_customers_are_seated_nearly_by_the_law(d, new):
    c, n = 600, 20_000
    law = log_seatings(d, c)[c, 1:] + np.arange(1, c + 1) * np.log(new)
    chance = np.exp(law - law.max()) / np.exp(law - law.max()).sum()
    mean = (chance * np.arange(1, c + 1)).sum()
    spread = np.sqrt((chance * np.arange(1, c + 1) ** 2).sum() - mean**2)
    drawn = draw_vast(np.random.default_rng(3), np.full(n, float(c)), np.full(n, float(new)), d)
    assert abs(drawn.mean() - mean) < 0.1 * spread + 0.1 and abs(drawn.std() - spread) < 0.06 * spread + 0.1


def test_chains_from_far_starts_agree():
    """Every customer apart or all of a dish at one table: after the burn-in tables and probabilities are alike."""
    ids, tokens = {}, []
    for x in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()[:300]:
        words = [ids.setdefault(w, len(ids)) for w in (x or "").lower().split()]
        tokens += [(zlib.crc32(str(a).encode()) % 1024, b) for a, b in zip([-1, *words], words)]
    ends = [sampled(tokens, Model(context_bits=10, start_apart=apart), discounts=(0.7, 0.8)) for apart in (False, True)]
    tables = [np.mean(t[5:]) for _, t in ends]
    assert abs(tables[0] - tables[1]) < 0.005 * tables[0]
    rates = [np.mean([math.log10(p[t]) for t in tokens]) for p, _ in ends]
    assert abs(rates[0] - rates[1]) < 0.002


def one_by_one(tokens, theta, d1, d2, words, sweeps, seed=5):
    """Brute force: each customer leaves and sits down again by the seating rule, tables listed one by one; averaged P(word | context)."""
    random = np.random.default_rng(seed)
    tables = {k: [] for k in set(tokens)}
    parent = {w: [] for w in range(words)}
    count = Counter(u for u, _ in tokens)

    def prior(w):
        n, t = sum(map(sum, parent.values())), sum(map(len, parent.values()))
        return (sum(parent[w]) - d1 * len(parent[w]) + (theta + d1 * t) / (words + 1)) / (theta + n)

    def pick(weights):
        return int(np.searchsorted(np.cumsum(weights), random.random() * sum(weights), "right"))

    def sit(seats, discount, new):
        i = pick([x - discount for x in seats] + [new])
        if i == len(seats):
            seats.append(0)
        seats[i] += 1
        return seats[i] == 1

    def leave(seats):
        i = pick(seats)
        seats[i] -= 1
        return not seats[i] and seats.pop(i) == 0

    def enter(u, w):
        opened = sum(len(tables[k]) for k in tables if k[0] == u)
        if sit(tables[u, w], d2, (theta + d2 * opened) * prior(w)):
            sit(parent[w], d1, (theta + d1 * sum(map(len, parent.values()))) / (words + 1))

    for u, w in tokens:
        enter(u, w)
    average = Counter()
    for sweep in range(sweeps):
        for u, w in tokens:
            if leave(tables[u, w]):
                leave(parent[w])
            enter(u, w)
        if sweep >= sweeps // 5:
            for u, w in tables:
                opened = sum(len(tables[k]) for k in tables if k[0] == u)
                average[u, w] += (sum(tables[u, w]) - d2 * len(tables[u, w]) + (theta + d2 * opened) * prior(w)) / (theta + count[u])
    return {k: x / (sweeps - sweeps // 5) for k, x in average.items()}


def test_samples_are_those_of_brute_force():
    tokens = [(u, w - 1) for u, w in some_tokens(90, 4, 6, seed=4)]
    names = {w: i for i, w in enumerate(sorted({w for _, w in tokens}))}
    tokens = [(u, names[w]) for u, w in tokens]
    brute = one_by_one(tokens, 1.0, 0.6, 0.7, len(names), 800)
    ours, _ = sampled(tokens, Model(context_bits=2, burn_in=50, samples=1500, thin=1, groups=20))
    assert ours.keys() == brute.keys()
    for k in ours:
        assert abs(ours[k] - brute[k]) < 0.012 + 0.03 * brute[k], (k, ours[k], brute[k])


def test_the_model_is_not_cut(spark):
    """At least 4096 context classes, five sweeps before the first of three samples; and scores that are not rounded to 2^-14."""
    model = Model()
    assert model.contexts >= 4096 and model.burn_in >= 5 and model.thin >= 2 and model.samples >= 3
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(100)], "doc_id long, text string")
    steps = [r.score * 16384 for r in score_texts(docs).collect()]
    assert sum(abs(s - round(s)) > 0.01 for s in steps) > 50


def test_blocks_do_not_matter_to_scores(spark):
    """Discounts count words and pairs over the corpus, so how documents fall into blocks changes nothing."""
    docs = table(spark, SF, "documents").coalesce(1)
    small, large = ({r.doc_id: r.score for r in score_texts(docs, model=m).collect()} for m in (SMALL, Model(context_bits=4)))
    assert small.keys() == large.keys() and all(abs(small[i] - large[i]) <= 1e-6 * abs(large[i]) for i in large)


def test_once_in_each_block_is_not_once(spark):
    docs = spark.createDataFrame([(i, f"all share these w{i}") for i in range(200)], "doc_id long, text string").coalesce(1)
    held = hpyp.crc_of_id("doc_id") % 5 == 1
    model, words = Model(context_bits=12, block_tokens=5), sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(200))
    blocks = hpyp.make_blocks(docs, held, 3, model, "doc_id", "text").filter("part >= 0")
    dealt = blocks.select("part", "block", "words", "sizes", "contexts", "counts").repartition(2, "part").sortWithinPartitions("part", "block")
    ones = hpyp.added(hpyp.whole_parts(dealt, model), "sums").tolist()
    assert ones[:2] == [words, 0] and ones[4] == words + 4  # only the last words; each pair of them occurs once before it and once behind it
    assert ones[2] >= words and hpyp.discounts_of(ones)[0] == 0.95


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Parts are cut by bytes of text and draws are seeded by part, so one task or six give the same scores."""
    from strandweave.llm import hpyp

    monkeypatch.setattr(hpyp, "PART_BYTES", 100_000)
    docs = table(spark, SF, "documents")
    one, six = (sorted((r.doc_id, round(r.score, 6)) for r in hpyp.score_texts(docs.repartition(n)).collect()) for n in (1, 6))
    assert one == six
