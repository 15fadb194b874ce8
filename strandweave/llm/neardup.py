"""Near-duplicate documents: banded MinHash, odd sketches to check candidates, full shingle sets to confirm links."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.components import connected_components

from .common import flagged, stored

U = np.uint64


@dataclass(frozen=True)
class Plan:
    """How documents are compared. A pair of similarity 0.85 shares none of 24 bands of 5 once in a million times.

    Its sketches differ in over `sketch_limit` bits less often than that: the limit is where a similarity of `sketch_floor`
    is expected, which lies six standard deviations of the MinHash samples below 0.85.
    """

    shingle: int = 5
    percent: int = 85
    bands: int = 24
    rows: int = 5
    bits: int = 512
    sketch_floor: float = 0.65
    #: Members of a bucket that are compared by sketch in one task; a larger bucket is taken as one candidate group.
    bucket: int = 20_000
    #: Shingles of a candidate group that one task confirms (8 bytes each, and its texts); a larger group is cut and every
    #: pair of cuts confirmed. A document of more is a cut of its own.
    group: int = 2_000_000

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def sketch_limit(self) -> int:
        """Odd bits expected in the XOR of two sketches at similarity sketch_floor."""
        return int(self.bits / 2 * (1 - np.exp(-4 * self.samples * (1 - self.sketch_floor) / self.bits)))


class _Words(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def shingle_set(raw: bytes | None, size: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's lower-cased words; a shorter text is one shingle."""
    tokens = (raw or b"").lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, U)
    h = np.fromiter(map(words.__getitem__, tokens), U, n)
    width = min(n, size)
    out = np.full(n - width + 1, width, U)
    for i in range(width):
        out = mixed(out + h[i : n - width + 1 + i])
    return np.unique(out)


def minhash(hashes: np.ndarray, samples: int) -> np.ndarray:
    """For each of `samples` orders of the hashes, the least."""
    random = np.random.default_rng(20_011)
    a = random.integers(0, 2**63, samples, U) * U(2) + U(1)
    b = random.integers(0, 2**63, samples, U)
    least = np.full(samples, 2**64 - 1, U)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024] * a[:, None] + b[:, None]).min(1))
    return least


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Each sample flips one bit: a bit is set where an odd number of samples fell. Packed to bytes."""
    place = mixed(samples + np.arange(len(samples), dtype=U) * U(0x9E3779B97F4A7C15)) % U(bits)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def estimate(odd_bits: np.ndarray, plan: Plan) -> np.ndarray:
    """Similarity from the number of odd bits in the XOR of two sketches (1 - n/4k * -ln(1 - 2x/n))."""
    inside = np.maximum(1e-9, 1 - 2 * np.asarray(odd_bits) / plan.bits)
    return 1 + plan.bits / (4 * plan.samples) * np.log(inside)


def signatures(docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, digest of the set, sketch, bands); the last three are null without words."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))

    def sign(batches):
        words = _Words()
        for batch in batches:
            made = []
            for raw in batch.column(1):
                hashes = shingle_set(raw.as_py(), plan.shingle, words)
                if not len(hashes):
                    made.append((0, None, None, None))
                    continue
                samples = minhash(hashes, plan.samples)
                keys = np.arange(plan.bands, dtype=U)
                for column in samples.reshape(plan.bands, plan.rows).T:
                    keys = mixed(keys * U(0x9E3779B97F4A7C15) + column)
                made.append((len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), odd_sketch(samples, plan.bits).tobytes(), keys.view(np.int64)))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds))], names=["id", "n_shingles", "digest", "sketch", "bands"])

    return rows.mapInArrow(sign, "id long, n_shingles long, digest binary, sketch binary, bands array<long>")


def grouped(batches, keys: int):
    """Runs of rows with equal values in the first `keys` columns, as tables; input must be sorted by them."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if held is None else pa.concat_tables([held, part])
        n = part.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for i in range(keys):
            column = part.column(i).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(change)
        if len(starts):
            yield part.slice(0, starts[-1]), np.append(0, starts)
            held = part.slice(starts[-1])
        else:
            held = part
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def sketch_links(sketches: np.ndarray, sizes: np.ndarray, plan: Plan) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sketches and sizes allow the similarity. Each member is compared only with
    those not yet reached, so a group of alike members costs about one comparison each."""
    left, links = np.arange(len(sketches)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            odd = np.bitwise_count(sketches[left] ^ sketches[i]).sum(1)
            near = (odd <= plan.sketch_limit) & (100 * np.minimum(sizes[left], sizes[i]) >= plan.percent * np.maximum(sizes[left], sizes[i]))
            found = left[near].tolist()
            links += [(i, j) for j in found]
            front += found
            left = left[~near]
    return links


def set_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * |A & B| >= percent * |A | B|, by exact counts over whole sets."""
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    terms, flat = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    left, links, marked = np.arange(len(sets)), [], np.zeros(len(terms), bool)
    part, starts = flat, ends - sizes
    while len(left):
        front, left = [left[0]], left[1:]
        stale = True
        while front and len(left):
            i = front.pop()
            if stale:  # the terms of the sets not yet reached, end to end
                part = np.concatenate([flat[ends[j] - sizes[j] : ends[j]] for j in left])
                starts, stale = np.cumsum(sizes[left]) - sizes[left], False
            mine = flat[ends[i] - sizes[i] : ends[i]]
            marked[mine] = True
            both = np.add.reduceat(marked[part].astype(np.int64), starts)
            marked[mine] = False
            near = 100 * both >= percent * (sizes[left] + sizes[i] - both)
            if near.any():
                found = left[near].tolist()
                links += [(i, j) for j in found]
                front += found
                left, stale = left[~near], True
    return links


def candidate_groups(nodes: DataFrame, plan: Plan) -> DataFrame:
    """nodes(node, n_shingles, sketch, bands) -> (id, component): groups that hold every pair worth confirming.

    Members of a bucket meet with their sketches; what the bucket sends on is a forest, never its pairs.
    """
    band_rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = band_rows.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("first")).filter("members > 1")
    members = band_rows.join(shared, "key")
    vast = members.filter(F.col("members") > plan.bucket).select(F.col("first").alias("u"), F.col("node").alias("v"))
    small = members.filter(F.col("members") <= plan.bucket).select("key", "node")
    small = small.join(nodes.select("node", "n_shingles", "sketch"), "node").select("key", "node", "n_shingles", "sketch")

    def compare(batches):
        for rows, cuts in grouped(batches, 1):
            node, sizes = rows.column("node").to_numpy(), rows.column("n_shingles").to_numpy()
            sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), U).reshape(len(node), -1)
            cuts = np.append(cuts, rows.num_rows) if cuts[-1] != rows.num_rows else cuts
            links = [(node[a + i], node[a + j]) for a, b in zip(cuts.tolist(), cuts[1:].tolist()) for i, j in sketch_links(sketches[a:b], sizes[a:b], plan)]
            pairs = np.unique(np.sort(np.array(links, np.int64).reshape(-1, 2), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    links = small.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "u long, v long")
    return connected_components(links.unionByName(vast))


def confirmed_links(docs: DataFrame, groups: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """(u, v) of documents in one candidate group of groups(id, component, n_shingles) whose full sets are similar enough,
    as a forest of each task's links."""
    sized = groups.join(groups.groupBy("component").agg(F.sum("n_shingles").alias("held")), "component")
    cuts = F.ceil(2 * F.col("held") / plan.group).cast("int")
    sized = sized.withColumn("cuts", F.when(F.col("held") <= plan.group, 1).otherwise(cuts)).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    # A cut meets every other in a task of its own; the task is named by the two.
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    dealt = sized.select("component", "id", "cut", other.alias("other"))
    dealt = dealt.select("component", F.least("cut", "other").alias("low"), F.greatest("cut", "other").alias("high"), "id")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    texts = flagged(texts, "id", groups).filter("_flag").drop("_flag")  # only grouped documents' texts are moved
    rows = dealt.join(texts, "id").select("component", "low", "high", "id", "text")

    def confirm(batches):
        words = _Words()
        for rows, cuts in grouped(batches, 3):
            ids, texts = rows.column("id").to_numpy(), rows.column("text")
            cuts = np.append(cuts, rows.num_rows) if cuts[-1] != rows.num_rows else cuts
            links = []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                sets = [shingle_set(texts[i].as_py(), plan.shingle, words) for i in range(a, b)]
                used = [i for i, s in enumerate(sets) if len(s)]
                if len(used) > 1:
                    links += [(ids[a + used[i]], ids[a + used[j]]) for i, j in set_links([sets[i] for i in used], plan.percent)]
            pairs = np.unique(np.sort(np.array(links, np.int64).reshape(-1, 2), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    dealt = rows.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "id")
    return dealt.mapInArrow(confirm, "u long, v long")


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of `docs`: id, n_shingles, component_id, kept.

    Rows with equal sets fold into one node first, so copies are never compared. Nodes that share a band and have near
    sketches form candidate groups; inside a group, full sets confirm the links and components follow. Nothing is lost
    to a bucket's size: vast buckets are candidate groups as they are, and vast groups are confirmed cut by cut.
    Texts without words (null, empty, white space) link with nothing. Rows with one id are one document: with different
    texts they share a component. A null id has a null component and is kept. Repeated rows get the same answer each,
    an empty table gives no rows, and other columns are ignored.
    """
    signed = stored(signatures(docs, plan, id_col, text_col), "signatures")
    known = signed.filter(F.col("id").isNotNull() & F.col("digest").isNotNull())
    sets = stored(known.groupBy("digest").agg(F.min("id").alias("node"), F.min_by(F.struct("n_shingles", "sketch", "bands"), "id").alias("s")), "sets")
    nodes = sets.select("node", "s.*")
    groups = candidate_groups(nodes, plan).join(nodes.select(F.col("node").alias("id"), "n_shingles"), "id")
    groups = stored(groups, "groups")
    links = confirmed_links(docs, groups, plan, id_col, text_col)
    # A repeated id with several texts ties its nodes together.
    texts = known.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high").select("id")
    tied = known.join(texts, "id").select("id", "digest").distinct().join(sets.select("digest", "node"), "digest").select(F.col("id").alias("u"), F.col("node").alias("v"))
    found = stored(connected_components(links.unionByName(tied)), "components")
    named = signed.select("id", "n_shingles", "digest").join(sets.select("digest", "node"), "digest", "left")
    named = named.withColumn("node", F.coalesce("node", "id")).join(found.select(F.col("id").alias("node"), "component"), "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node"))
    return named.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
