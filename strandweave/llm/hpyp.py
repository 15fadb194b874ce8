"""Hierarchical Pitman-Yor language model: seating sampled by Gibbs, dealt out by word; averaged predictions score texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.plans.shared import discard

from .common import crc_of_id, new_path, stored
from .neardup import grouped, mixed

U = np.uint64
#: What no word can be (it holds a space): the end of a text, and what stands before its first word.
END, START = b" end", b" start"
#: Dishes of up to this many customers are seated by their exact law.
EXACT = 256
#: Bytes of text for one part of the words.
PART_BYTES = 8 << 20
#: Greatest numbers of customers of the dishes that are seated in one matrix, and the cells of such a matrix.
SIZES, CELLS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, EXACT), 1 << 19


@dataclass(frozen=True)
class Model:
    """Restaurants: one for each word before, all with one parent for words alone, whose base is uniform over the training
    words and one unknown word. A restaurant is named by context_bits bits of its word's hash (40 at most): with 40, one word
    in a million shares its restaurant in a vocabulary of a million words, one in a thousand among a billion."""

    context_bits: int = 40
    concentration: float = 1.0
    #: Gibbs sweeps before the first sample, samples, and sweeps between them. A sweep seats every customer anew.
    burn_in: int = 5
    samples: int = 3
    thin: int = 2
    #: The dishes of a part are seated in this many random groups a sweep; totals are brought up to date between them.
    groups: int = 4
    #: Tokens in a block of documents, the unit that a task holds.
    block_tokens: int = 4_000_000
    seed: int = 23
    #: Whether chains start with every customer at a table of their own instead of one table a dish.
    start_apart: bool = False

    @property
    def contexts(self) -> int:
        return 1 << self.context_bits

    @property
    def sweeps(self) -> int:
        return self.burn_in + 1 + (self.samples - 1) * self.thin

    def is_sample(self, sweep: int) -> bool:
        return sweep >= self.burn_in and (sweep - self.burn_in) % self.thin == 0


def _pack(a: np.ndarray) -> bytes:
    """First bytes of all numbers, then second bytes and so on, which pack shorter than number by number."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")


def _unpack(b: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack_sorted(names: np.ndarray) -> bytes:
    return _pack(np.diff(names, prepend=0).astype(np.int64))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.int64), dtype=np.int64)


def _pack_contexts(contexts: np.ndarray) -> bytes:
    """Distinct names in order, then each pair's place among them: a name is written once, however many pairs have it."""
    names, places = np.unique(contexts, return_inverse=True)
    head = _pack_sorted(names)
    return len(head).to_bytes(4, "little") + head + _pack(places.astype(np.int32))


def _unpack_contexts(b: bytes) -> np.ndarray:
    n = 4 + int.from_bytes(b[:4], "little")
    return _unpack_sorted(b[4:n])[_unpack(b[n:], np.int32)]


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


# --- blocks: documents as codes of (word, context) pairs, and the pairs with their training counts, by part

BLOCKS = "block long, part int, ids array<long>, held array<boolean>, lengths binary, codes binary, words binary, sizes binary, contexts binary, counts binary"
_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _block_rows(block: int, parts: int, model: Model, ids: list, held: list, docs: list[np.ndarray], words: _Ids):
    """The rows of a block: part -1 holds its documents, each other part the pairs of its words."""
    lengths = np.array([len(d) for d in docs], np.int64)
    tokens = np.concatenate(docs)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = words[START]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    part = (mixed(hashes ^ U(0x5851F42D4C957F2D)) % U(parts)).astype(np.int64)
    context = (mixed(hashes) >> U(64 - model.context_bits)).astype(np.int64)
    order = np.lexsort((hashes, part))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys, codes = np.unique((rank[tokens] << model.context_bits) | context[before], return_inverse=True)
    learned = np.repeat(~np.array(held, bool), lengths)
    counts = np.bincount(codes[learned], minlength=len(keys))
    word_of = keys >> model.context_bits
    used, firsts, sizes = np.unique(word_of, return_index=True, return_counts=True)
    yield block, -1, ids, held, _pack(lengths.astype(np.int32)), _pack(codes.astype(np.int32)), None, None, None, None
    ordered_hashes, ordered_part = hashes[order], part[order]
    cuts = np.flatnonzero(np.diff(ordered_part[used], prepend=-1, append=parts + 1))
    for a, b in zip(cuts, cuts[1:]):
        lo, hi = firsts[a], firsts[b] if b < len(firsts) else len(keys)
        yield block, int(ordered_part[used[a]]), None, None, None, None, _pack(ordered_hashes[used[a:b]]), _pack(sizes[a:b].astype(np.int32)), _pack_contexts(keys[lo:hi] & (model.contexts - 1)), _pack(counts[lo:hi].astype(np.int32))


def make_blocks(docs: DataFrame, held, parts: int, model: Model, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), held.alias("held"))
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 6]

    def emit(task, n, ids, held, found, words):
        made = list(_block_rows((task << 24) + n, parts, model, ids, held, found, words))
        for at in range(0, len(made), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made[at : at + 64]), kinds)], names=_NAMES)

    def block(batches):
        task, n = TaskContext.get().partitionId(), 0
        ids, held, found, total, words = [], [], [], 0, _Ids()
        for batch in batches:
            for ident, raw, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                tokens = (raw.as_py() or b"").lower().split()
                tokens.append(END)
                ids.append(ident)
                held.append(out)
                found.append(np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)))
                total += len(tokens)
                if total >= model.block_tokens:
                    yield from emit(task, n, ids, held, found, words)
                    ids, held, found, total, words, n = [], [], [], 0, _Ids(), n + 1
        if found:
            yield from emit(task, n, ids, held, found, words)

    path, spark = new_path(docs.sparkSession, "lm-blocks"), docs.sparkSession
    rows.mapInArrow(block, BLOCKS).withColumn("pairs", F.col("part") >= 0).write.partitionBy("pairs").parquet(path, compression="none")
    return spark.read.schema(f"{BLOCKS}, pairs boolean").parquet(path)


def discard_pairs(blocks: DataFrame) -> None:
    """Deletes the pairs of make_blocks, once they are merged; the documents stay."""
    files = [f for f in blocks.inputFiles() if "/pairs=true/" in f]
    if files:
        discard(blocks.sparkSession.read.schema(BLOCKS).parquet(files[0]))


# --- seating


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for positive numbers, by Stirling's series seven places on."""
    x = np.asarray(x, float)
    y = x + 7
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - np.log(x * (x + 1) * (x + 2)) - np.log((x + 3) * (x + 4) * (x + 5) * (x + 6))


@lru_cache(maxsize=4)
def log_seatings(discount: float, most: int = EXACT) -> np.ndarray:
    """[c, t]: log of the summed weights of all seatings of c customers at t tables (generalised Stirling numbers)."""
    law = np.full((most + 1, most + 1), -np.inf)
    law[0, 0] = law[1, 1] = 0
    tables = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore"):
            law[c + 1, 1:] = np.logaddexp(law[c, :-1], law[c, 1:] + np.log(np.maximum(c - discount * tables, 0)))
    return law


def vast_law(customers: np.ndarray, new: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(m, q): one plus a binomial of mean m and chance q is nearly the law of the tables of many customers, new tables of
    weight `new`; under q = 1e-6 one plus a Poisson of mean m.

    Table sizes are independent draws of one law and their number is Poisson, given that the sizes sum to the customers;
    m and q give the mean and variance of that number when the law is tilted to the sum.
    """
    low, high = np.full(len(customers), -5000.0), np.full(len(customers), -1e-12)
    for _ in range(60):  # log(1 - tilt) by halving
        half = (low + high) / 2
        over = np.log(new) + np.log1p(-np.exp(half)) + (discount - 1) * half > np.log(customers)
        low, high = np.where(over, half, low), np.where(over, high, half)
    gap = np.exp(low)
    tilt = 1 - gap
    mean = new / discount * (1 - gap**discount)
    size = customers / mean
    square = tilt**2 * (1 - discount) * np.maximum(gap, 1e-150) ** (discount - 2) * new / mean + size
    share = size**2 / square
    return np.maximum(0, mean - share), share


def draw_vast(random: np.random.Generator, customers: np.ndarray, new: np.ndarray, discount: float) -> np.ndarray:
    mean, q = vast_law(customers, new, discount)
    rare = q < 1e-6
    trials = np.round(mean / np.where(rare, 1, q)).astype(np.int64)
    more = np.where(rare, random.poisson(np.minimum(mean, 1e9)), random.binomial(np.where(rare, 0, trials), np.clip(q, 0, 1)))
    return np.clip(1 + more, 1, customers)


Steps = Callable[[np.ndarray, np.ndarray], np.ndarray]


def draw_tables(random: np.random.Generator, customers: np.ndarray, now: np.ndarray, discount: float, step: Steps, log_steps: Steps) -> np.ndarray:
    """Seats all customers of many dishes anew, each dish given all others, and returns their tables.

    step(dishes, i) is the weight of a new table where the dish has i, so t tables weigh log_steps(dishes, t), the sum of
    log step from 1 to t - 1, times the seatings of the customers at t tables. Up to EXACT customers t is drawn from that law itself;
    beyond, from the near law of a fixed weight, which stays approximate: it is kept or refused against `now` by the ratio
    of the weights of new tables (Metropolis), not by that of the seatings themselves.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    law, low = log_seatings(discount), 1
    for high in SIZES:
        dishes = np.flatnonzero((customers > low) & (customers <= high))
        low, rows, i = high, max(1, CELLS // high), np.arange(1, high)[None, :]
        for at in range(0, len(dishes), rows):
            some = dishes[at : at + rows]
            weight = law[customers[some], 1 : high + 1]
            weight[:, 1:] += np.cumsum(np.log(step(some[:, None], i)), 1)
            upto = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            tables[some] = 1 + (upto < (random.random(len(some)) * upto[:, -1])[:, None]).sum(1)
    vast = np.flatnonzero(customers > EXACT)
    if len(vast):
        many, old = customers[vast].astype(float), np.clip(now[vast], 1, customers[vast])
        mean, _ = vast_law(many, step(vast, np.ones(len(vast))), discount)
        fixed = step(vast, np.clip(mean, 1, many - 1))
        new = draw_vast(random, many, fixed, discount).astype(np.int64)
        gain = log_steps(vast, new) - log_steps(vast, old) - (new - old) * np.log(fixed)
        tables[vast] = np.where(np.log(np.maximum(random.random(len(vast)), 1e-300)) < gain, new, old)
    return tables


@dataclass(frozen=True)
class Corpus:
    """What is known before sampling: customers of each context (of those of a part), all tokens, discounts, distinct words."""

    context_counts: np.ndarray
    tokens: int
    discounts: tuple[float, float]
    vocabulary: int


@dataclass(frozen=True)
class Totals:
    """Tables in each context restaurant (of those of a part), and customers and tables of the parent, over all parts."""

    in_context: np.ndarray
    customers: int
    seated: int

    @staticmethod
    def of(sums: np.ndarray) -> Totals:
        return Totals(sums[:-2], int(sums[-2]), int(sums[-1]))

    def base(self, corpus: Corpus, theta: float) -> float:
        """Weight of a new table of any one word in the parent restaurant."""
        return (theta + corpus.discounts[0] * self.seated) / (corpus.vocabulary + 1)


class Part:
    """The words of one part, which are in no other: pairs with their training counts, and their tables as they stand.

    `contexts` are places in the part's sorted list of `names`. `closed` counts each word's pairs that occur once and are
    left out: each has one table whatever is drawn."""

    def __init__(self, row: dict, model: Model):
        self.model, self.context = model, _unpack(row["contexts"], np.int32).astype(np.int64)
        self.n_contexts = len(_unpack_sorted(row["names"])) if row.get("names") is not None else model.contexts
        self.closed = _unpack(row["closed"], np.int32).astype(np.int64) if row.get("closed") is not None else 0
        sizes = _unpack(row["sizes"], np.int32)
        self.word, self.n_words = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        self.count = _unpack(row["counts"], np.int32).astype(np.int64)
        self.tables = np.where(model.start_apart, self.count, np.minimum(self.count, 1)).astype(np.int64)
        self.seated = np.minimum(self.customers(), 1)
        if row.get("tables") is not None:
            self.tables, self.seated = _unpack(row["tables"], np.int32).astype(np.int64), _unpack(row["seated"], np.int32).astype(np.int64)

    def customers(self) -> np.ndarray:
        """Customers of each word in the parent restaurant: its tables in all contexts."""
        return np.bincount(self.word, self.tables, self.n_words).astype(np.int64) + self.closed

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, values, self.n_contexts).astype(np.int64)

    def sums(self) -> np.ndarray:
        """The part's share of the totals."""
        return np.concatenate([self.by_context(self.tables), [self.customers().sum(), self.seated.sum()]])

    def sweep(self, corpus: Corpus, totals: Totals, random: np.random.Generator) -> None:
        """Seats all customers anew: every dish of every context restaurant, in random groups, then every word's tables in
        the parent. Each draw is conditional on all other tables: this part's as they stand, other parts' as they
        stood after the last sweep. The parent's seating is summed out while the contexts' is drawn."""
        d1, d2 = corpus.discounts
        theta, base = self.model.concentration, totals.base(corpus, self.model.concentration)
        in_context, customers, all_customers = totals.in_context.astype(np.int64), self.customers(), totals.customers
        # Customers a word gains weigh like this where it has n: n - d1 * tables + base, averaged over the seatings of n.
        law = log_seatings(d1) + np.arange(EXACT + 1) * np.log(base)
        whole = np.logaddexp.reduce(law, 1)
        joining = np.append(np.exp(np.diff(whole)), EXACT - d1)
        open_ = np.flatnonzero(self.count > 1)
        for dishes in np.array_split(random.permutation(open_), self.model.groups) if len(open_) else []:
            dishes = np.sort(dishes)
            context, word, old = self.context[dishes], self.word[dishes], self.tables[dishes]
            others, rest = in_context[context] - old, customers[word] - old
            total = all_customers

            def step(at, i, others=others, rest=rest, total=total):
                n = rest[at] + i
                return (theta + d2 * (others[at] + i)) * np.where(n <= EXACT, joining[np.minimum(n, EXACT).astype(np.int64)], n - d1) / (theta + total + i)

            def log_steps(at, t, others=others, rest=rest, total=total):
                ratio = lambda x: log_gamma(x + t) - log_gamma(x + 1)  # noqa: E731  the sum of log(x + i) over i from 1 to t - 1
                return ratio(theta / d2 + others[at]) + (t - 1) * np.log(d2) + ratio(rest[at] - d1 + (rest[at] == 0)) - ratio(theta + total + 0.0)

            new = draw_tables(random, self.count[dishes], old, d2, step, log_steps)
            self.tables[dishes] = new
            in_context += np.bincount(context, new - old, self.n_contexts).astype(np.int64)
            customers += np.bincount(word, new - old, self.n_words).astype(np.int64)
            all_customers += int((new - old).sum())
        used = np.flatnonzero(customers > 0)
        fixed = lambda at, i: np.full(np.broadcast(at, i).shape, base)
        self.seated = np.zeros(self.n_words, np.int64)
        self.seated[used] = draw_tables(random, customers[used], np.ones(len(used), np.int64), d1, fixed, lambda at, t: (t - 1) * np.log(base))

    def probabilities(self, corpus: Corpus, totals: Totals) -> np.ndarray:
        """P(word | context) of every pair with the tables as they stand; totals must be of the same seating."""
        d1, d2 = corpus.discounts
        theta = self.model.concentration
        prior = (self.customers() - d1 * self.seated + totals.base(corpus, theta)) / (theta + totals.customers)
        return (self.count - d2 * self.tables + (theta + d2 * totals.in_context[self.context]) * prior[self.word]) / (theta + corpus.context_counts[self.context])


def discounts_of(ones: list[int]) -> tuple[float, float]:
    """Discounts of the parent and the contexts from the words seen once and twice and the pairs seen once and twice."""
    return tuple(min(0.95, max(0.3, a / (a + 2 * b))) if a else 0.6 for a, b in (ones[:2], ones[2:4]))


#: A part before any seating. of_block: for each block, the steps from each of its pairs to the next among the part's.
FIXED = "part int, names binary, sizes binary, contexts binary, counts binary, blocks array<long>, of_block array<binary>, sums binary"
#: What a sweep reads and changes: pairs that occur more than once, the contexts they are in, and those contexts' tables at
#: the `start` over all parts; customers and tables of the part's words in the parent.
STATE = "part int, names binary, sizes binary, contexts binary, counts binary, closed binary, start binary, tables binary, seated binary, samples array<binary>, customers long, seats long"
#: Values (one or several a name) that a part has for some names, cut by the owner of the names; and the owner's answer.
MESSAGES, ANSWERS = "owner int, part int, wanted boolean, names binary, sums binary", "part int, owner int, sums binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KINDS[k]) for n, k in columns], names=[n for n, _ in columns])


def whole_parts(dealt: DataFrame, model: Model) -> DataFrame:
    """A row a part: its pairs with counts over all blocks, before any seating. `sums` holds the words and then the pairs
    that occur once and twice in the corpus, the number of words that occur, of their tokens, and of tables at the start."""

    def merge(batches):
        for part, rows in _groups(batches, "part", ["block", "words", "sizes", "contexts", "counts"]):
            words, sizes = [_unpack(r["words"], U) for r in rows], [_unpack(r["sizes"], np.int32) for r in rows]
            distinct, inverse = np.unique(np.concatenate(words), return_inverse=True)
            contexts = np.concatenate([_unpack_contexts(r["contexts"]) for r in rows])
            keys, of_row = np.unique((np.repeat(inverse, np.concatenate(sizes)) << model.context_bits) | contexts, return_inverse=True)
            counts = np.bincount(of_row, np.concatenate([_unpack(r["counts"], np.int32) for r in rows]), len(keys)).astype(np.int64)
            word = keys >> model.context_bits
            by_word = np.bincount(word, counts, len(distinct)).astype(np.int64)
            names, places = np.unique(keys & (model.contexts - 1), return_inverse=True)
            columns = {"sizes": np.bincount(word, minlength=len(distinct)).astype(np.int32), "contexts": places.astype(np.int32), "counts": counts.astype(np.int32)}
            ones = [int((x == i).sum()) for x in (by_word, counts) for i in (1, 2)]
            ends = np.cumsum([s.sum() for s in sizes])
            steps = [_pack(np.diff(x, prepend=0).astype(np.int32)) for x in np.split(of_row, ends[:-1])]  # a block's pairs are in order
            sums = [*ones, (by_word > 0).sum(), counts.sum(), (counts if model.start_apart else np.minimum(counts, 1)).sum()]
            packed = {k: _pack(v) for k, v in columns.items()}
            yield _batch([{"part": part, "names": _pack_sorted(names), **packed, "blocks": [r["block"] for r in rows], "of_block": steps, "sums": _pack(np.array(sums, np.int64))}], FIXED)

    return stored(dealt.mapInArrow(merge, FIXED), "lm-parts", compression="none")


def added(rows: DataFrame, column: str) -> np.ndarray | None:
    """The sum of packed arrays of longs of one length, by way of about the square root of their number of tasks: no task
    and not the driver holds more than two such arrays at a time. None where there are no rows."""

    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column(0):
                mine = _unpack(x.as_py(), np.int64)
                total = mine if total is None else total + mine
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(total)], pa.binary())], names=[column])

    some = rows.select(column)
    middle = max(1, int(some.rdd.getNumPartitions() ** 0.5))
    found = some.repartition(middle).mapInArrow(add, f"{column} binary").coalesce(1).mapInArrow(add, f"{column} binary").first()
    return None if found is None else _unpack(found[0], np.int64)


def _groups(batches, key: str, columns: list[str]):
    """(key, its rows) with all rows of a key together; input is sorted by the key, its first column."""
    for rows, cuts in grouped(batches, 1):
        cuts = np.append(cuts, rows.num_rows) if cuts[-1] != rows.num_rows else cuts
        keys = rows.column(key).to_pylist()
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            yield keys[a], rows.slice(a, b - a).select(columns).to_pylist()


def messages(part: int, names: np.ndarray, values: np.ndarray, owners: int, model: Model, wanted: bool) -> list[dict]:
    """A part's values (a row of `values` a quantity) for its sorted names, a message an owner; names are hashes, and an owner has a range of them."""
    owner = (names * owners) >> model.context_bits
    cuts = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(names)).tolist()
    return [{"owner": int(owner[a]), "part": part, "wanted": wanted, "names": _pack_sorted(names[a:b]), "sums": _pack(np.ascontiguousarray(values[:, a:b]).reshape(-1))} for a, b in zip(cuts, cuts[1:])]


def exchanged(sent: DataFrame, owners: int) -> DataFrame:
    """For each message that wants an answer, the sums of its names' values over all messages, in its order. A name's
    values meet in the task of its owner: one entry a part that has the name."""

    def add(batches):
        for owner, rows in _groups(batches, "owner", ["part", "wanted", "names", "sums"]):
            names = [_unpack_sorted(r["names"]) for r in rows]
            distinct, inverse = np.unique(np.concatenate(names), return_inverse=True)
            values = np.concatenate([_unpack(r["sums"], np.int64).reshape(-1, len(x)) for r, x in zip(rows, names)], axis=1)
            sums = np.stack([np.bincount(inverse, v, len(distinct)).astype(np.int64) for v in values])
            for row, x in zip(rows, names):
                if row["wanted"]:
                    yield _batch([{"part": row["part"], "owner": owner, "sums": _pack(sums[:, np.searchsorted(distinct, x)].reshape(-1))}], ANSWERS)

    return sent.repartition(owners, "owner").sortWithinPartitions("owner", "part").mapInArrow(add, ANSWERS)


def _answer(rows: list[dict], quantities: int) -> np.ndarray:
    """All owners' answers to a part, [quantity, name]; rows are sorted by owner."""
    found = [_unpack(r["sums"], np.int64).reshape(quantities, -1) for r in rows]
    return np.concatenate(found, axis=1) if found else np.zeros((quantities, 0), np.int64)


def _with_answers(parts: int, answers: DataFrame, *tables: DataFrame) -> DataFrame:
    """Each part's rows together: of `tables` in order, then its answers by owner."""
    rows = [t.withColumn("owner", F.lit(i - len(tables))) for i, t in enumerate(tables)]
    for more in (*rows[1:], answers):
        rows[0] = rows[0].unionByName(more, allowMissingColumns=True)
    columns = [c for c in rows[0].columns if c not in ("part", "owner")]
    return rows[0].select("part", "owner", *columns).repartition(parts, "part").sortWithinPartitions("part", "owner")


def _opened(row: dict, model: Model) -> dict:
    """The state of a part before the first sweep, from its fixed row."""
    whole = Part(row, model)
    some = whole.count > 1
    used, places = np.unique(whole.context[some], return_inverse=True)
    sizes, closed = (np.bincount(whole.word[x], minlength=whole.n_words).astype(np.int32) for x in (some, whole.count == 1))
    columns = {"sizes": sizes, "closed": closed, "contexts": places.astype(np.int32), "counts": whole.count[some].astype(np.int32)}
    return {"part": row["part"], "names": _pack_sorted(_unpack_sorted(row["names"])[used]), **{k: _pack(v) for k, v in columns.items()}, "samples": []}


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def gibbs(fixed: DataFrame, parts: int, model: Model, corpus: Corpus, begin: Totals) -> tuple[DataFrame, list[Totals]]:
    """The parts' states after all sweeps with the tables of every sample, and each sample's totals of the parent.

    Before a sweep the parts exchange how many tables they have in every context restaurant with a pair that occurs more
    than once (the others' tables never change), keyed by context: a part gets the totals of its own contexts alone, and
    no task holds all contexts. The passes' tables replace each other in the shared folder; the samples' tables ride along, packed.
    """

    def first(batches):
        for row in _rows(batches):
            whole, state = Part(row, model), _opened(row, model)
            used = _unpack_sorted(state["names"])
            sent = messages(row["part"], _unpack_sorted(row["names"]), whole.by_context(whole.tables)[None], parts, model, False)
            yield _batch(sent + messages(row["part"], used, np.zeros((1, len(used)), np.int64), parts, model, True), MESSAGES)

    def opened(batches):
        for row in _rows(batches):
            yield _batch([_opened(row, model)], STATE)

    def send(batches):
        for row in _rows(batches):
            part, before = Part(row, model), Part({**row, "tables": None}, model)
            yield _batch(messages(row["part"], _unpack_sorted(row["names"]), part.by_context(part.tables - before.tables)[None], parts, model, True), MESSAGES)

    state, answers, totals, kept = fixed.mapInArrow(opened, STATE), exchanged(fixed.mapInArrow(first, MESSAGES), parts), begin, []
    for sweep in range(model.sweeps):

        def seat(batches, sweep=sweep, totals=totals):
            for number, (row, *rest) in _groups(batches, "part", [*(c.split()[0] for c in STATE.split(", ")), "sums"]):
                part, came = Part(row, model), _answer(rest, 1)[0]
                start = _unpack(row["start"], np.int64) if sweep else came
                part.sweep(corpus, replace(totals, in_context=start + came if sweep else start), np.random.default_rng([model.seed, number, sweep]))
                tables, seated = _pack(part.tables.astype(np.int32)), _pack(part.seated.astype(np.int32))
                now = {"start": _pack(start), "tables": tables, "seated": seated, "samples": row["samples"] + [tables, seated] * model.is_sample(sweep)}
                yield _batch([{**row, **now, "customers": int(part.customers().sum()), "seats": int(part.seated.sum())}], STATE)

        old, state = state, stored(_with_answers(parts, answers, state).mapInArrow(seat, STATE), "lm-seating", compression="none")
        if sweep:
            discard(old)
        customers, seats = state.agg(F.coalesce(F.sum("customers"), F.lit(0)), F.coalesce(F.sum("seats"), F.lit(0))).first()
        totals, answers = Totals(np.zeros(0, np.int64), customers, seats), exchanged(state.mapInArrow(send, MESSAGES), parts)
        if model.is_sample(sweep):
            kept.append(totals)
    return state, kept


def of_samples(fixed: DataFrame, state: DataFrame, parts: int, model: Model) -> DataFrame:
    """Answers to every part for all its contexts: training customers, and tables in each sample."""

    def whole(batches):
        for row in _rows(batches):
            part = Part(row, model)
            values = np.stack([part.by_context(part.count), *[part.by_context(part.tables)] * model.samples])
            yield _batch(messages(row["part"], _unpack_sorted(row["names"]), values, parts, model, True), MESSAGES)

    def changed(batches):
        for row in _rows(batches):
            before = Part({**row, "tables": None}, model)
            changes = [before.by_context(_unpack(x, np.int32) - before.tables) for x in row["samples"][::2]]
            values = np.stack([np.zeros(before.n_contexts, np.int64), *changes])
            yield _batch(messages(row["part"], _unpack_sorted(row["names"]), values, parts, model, False), MESSAGES)

    return exchanged(fixed.mapInArrow(whole, MESSAGES).unionByName(state.mapInArrow(changed, MESSAGES)), parts)


def score_texts(docs: DataFrame, folds: int = 5, held_fold: int = 1, model: Model = Model(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text with a model learned outside the held-out fold of crc32(id).

    Tokens: the words of the text with A-Z lowered, then one end. Blocks of documents turn tokens into pairs of word and
    word before; each word's pairs meet in one part (an entry a block and pair), where its counts over all blocks are
    summed, which give the discounts. Sweeps then seat all customers (gibbs), parts exchange the tables of their contexts
    by context, and every pair's probability is averaged over the samples; its logarithm goes to the blocks as a 32-bit
    float, which errs by less than one in 10 million. Each block adds up its documents. Nothing passes the driver but a few
    sums, and nothing that grows is broadcast.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null or empty text is the end alone; a
    very long text is one document of its block, and tokens in training count each time they occur; words tied in count
    are seated alike; a null id counts as the empty text in the fold; repeated rows learn and score each; an empty table
    gives no rows, and with no training rows every word is the unknown one, of probability 1. Other columns are ignored.
    """
    spark = docs.sparkSession
    # Parts grow with the text alone, not with how the table is cut up: so scores don't depend on that.
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    held = crc_of_id(id_col) % folds == held_fold
    blocks = make_blocks(docs, held, parts, model, id_col, text_col)
    heads, pairs = blocks.filter("not pairs"), blocks.filter("pairs").select("part", "block", "words", "sizes", "contexts", "counts")
    fixed = whole_parts(pairs.repartition(parts, "part").sortWithinPartitions("part", "block"), model)
    discard_pairs(blocks)
    found = added(fixed, "sums")
    *ones, vocabulary, tokens, tables = [0] * 7 if found is None else found.tolist()
    corpus = Corpus(np.zeros(0, np.int64), tokens, discounts_of(ones), vocabulary)
    state, totals = gibbs(fixed, parts, model, corpus, Totals(np.zeros(0, np.int64), tables, vocabulary))

    def predict(batches):
        """For every block, the logs of its pairs' probabilities, and the training count of each of its words in this part."""
        for _, (row, sampled, *rest) in _groups(batches, "part", ["part", "names", "sizes", "contexts", "counts", "blocks", "of_block", "samples", "sums"]):
            part, average, came = Part(row, model), 0.0, _answer(rest, 1 + model.samples)
            here, some = replace(corpus, context_counts=came[0]), part.count > 1
            for i, at in enumerate(totals):
                part.tables = np.minimum(part.count, 1)
                part.tables[some], part.seated = (_unpack(x, np.int32).astype(np.int64) for x in sampled["samples"][2 * i : 2 * i + 2])
                average = average + part.probabilities(here, replace(at, in_context=came[1 + i]))
            logs, learned = np.log10(average / len(totals)).astype(np.float32), np.bincount(part.word, part.count, part.n_words).astype(np.int64)
            for block, steps in zip(row["blocks"], row["of_block"]):
                pairs = np.cumsum(_unpack(steps, np.int32), dtype=np.int64)
                starts = np.flatnonzero(np.diff(part.word[pairs], prepend=-1))
                sizes = np.diff(starts, append=len(pairs)).astype(np.int32)
                values = (block, row["part"], _pack(logs[pairs]), _pack(learned[part.word[pairs[starts]]]), _pack(sizes))
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, (pa.int64(), pa.int32(), *[pa.binary()] * 3))], names=["block", "part", "scores", "learned", "sizes"])

    scored = _with_answers(parts, of_samples(fixed, state, parts, model), fixed.drop("sums"), state.select("part", "samples")).mapInArrow(predict, "block long, part int, scores binary, learned binary, sizes binary")
    both = heads.select("block", "part", "ids", "held", "lengths", "codes").unionByName(scored, allowMissingColumns=True)

    def finish(batches):
        for rows, cuts in grouped(batches, 1):
            cuts = np.append(cuts, rows.num_rows) if cuts[-1] != rows.num_rows else cuts
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                head, *rest = rows.slice(a, b - a).to_pylist()
                scores = np.concatenate([_unpack(r["scores"], np.float32) for r in rest]).astype(float)
                learned = np.concatenate([np.repeat(_unpack(r["learned"], np.int64), _unpack(r["sizes"], np.int32)) for r in rest])
                codes, lengths = _unpack(head["codes"], np.int32), _unpack(head["lengths"], np.int32).astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                base = np.log10((learned + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
                columns = [head["ids"], head["held"], lengths, np.add.reduceat((learned > 0).astype(np.int64)[codes], starts), np.full(len(lengths), tokens), np.add.reduceat(base[codes], starts), np.add.reduceat(scores[codes], starts)]
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.repartition(parts, "block").sortWithinPartitions("block", "part").mapInArrow(finish, schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, tokens, perplexity, base_perplexity) of scored texts."""
    rate = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), rate("score").alias("perplexity"), rate("base_score").alias("base_perplexity"))
