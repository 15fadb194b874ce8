"""Approximate nearest neighbours with an inverted multi-index over two quantised halves of the vectors."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import stored

#: The quantisers learn from at most this many rows; every row is indexed.
SAMPLE = 20_000
#: Entries of a part of the index, which a task holds, and queries that are compared with it at once.
PART, AT_ONCE = 20_000, 64


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) without null ids and null, empty, zero or non-finite vectors."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & finite & F.exists(x, lambda c: c != 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: c.cast("double")).alias("v"))


def lloyd(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k centroids of the rows by Lloyd's rounds from a seeded start; an emptied centroid moves to the farthest row."""
    random = np.random.default_rng(seed)
    distinct = np.unique(rows, axis=0)
    centres = distinct[random.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        gaps = (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)
        near = gaps.argmin(1)
        for i in range(len(centres)):
            mine = near == i
            centres[i] = rows[mine].mean(0) if mine.any() else rows[gaps.min(1).argmax()]
    return centres


def probes(query: np.ndarray, halves: tuple[np.ndarray, np.ndarray], counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of summed distance of their two centroids, until they hold `wanted` entries.

    The multi-sequence traversal: a heap of pairs of positions in the two sorted distance lists; a pair enters when
    both its predecessors have been taken.
    """
    half = len(halves[0][0])
    gaps = [((c - q) ** 2).sum(1) for c, q in zip(halves, (query[:half], query[half:]))]
    order = [np.argsort(g, kind="stable") for g in gaps]
    a, b = gaps[0][order[0]], gaps[1][order[1]]
    heap, seen, taken, held = [(a[0] + b[0], 0, 0)], np.zeros((len(a) + 1, len(b) + 1), bool), [], 0
    seen[-1, :] = seen[:, -1] = True  # nothing comes before the first position
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        seen[i, j] = True
        cell = int(order[0][i]) * len(b) + int(order[1][j])
        if counts[cell]:
            taken.append(cell)
            held += int(counts[cell])
        if i + 1 < len(a) and seen[i + 1, j - 1]:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and seen[i - 1, j + 1]:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return taken


def cell_gaps(query: np.ndarray, halves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Summed squared distance of the query to the two centroids of every cell."""
    half = len(halves[0][0])
    a, b = (((c - q) ** 2).sum(1) for c, q in zip(halves, (query[:half], query[half:])))
    return (a[:, None] + b[None, :]).ravel()


def cells_of(v: np.ndarray, halves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    half = len(halves[0][0])
    first, second = (((c**2).sum(1) - 2 * x @ c.T).argmin(1) for c, x in zip(halves, (v[:, :half], v[:, half:])))
    return first * len(halves[1]) + second


def share_for_recall(taught: np.ndarray, halves: tuple[np.ndarray, np.ndarray], k: int, recall: float, queries: int = 200) -> float:
    """The share of entries to visit so that `recall` of the true neighbours are met, measured within the sample by brute force.

    Neighbours within a sample are farther off than among all rows, so the share errs on the high side.
    """
    distinct = np.unique(taught, axis=0)
    if len(distinct) < 2:
        return 1.0
    cells = cells_of(distinct, halves)
    counts = np.bincount(cells, minlength=len(halves[0]) * len(halves[1]))
    needs = []
    for i in np.random.default_rng(11).permutation(len(distinct))[:queries]:
        gaps = ((distinct - distinct[i]) ** 2).sum(1)
        gaps[i] = np.inf
        true = np.argsort(gaps)[: min(k, len(distinct) - 1)]
        order = np.argsort(cell_gaps(distinct[i], halves), kind="stable")
        held = np.empty(len(order))
        held[order] = np.cumsum(counts[order])
        needs += (held[cells[true]] / len(distinct)).tolist()
    return float(np.quantile(needs, recall))


def codebook_size(n: int) -> int:
    """Centroids of each half: their pairs, the cells, hold about 16 of n rows, until the sample could teach no more."""
    return int(np.clip(round(n**0.5 / 4), 4, 512))


def least_ids(ids: list[int], k: int) -> list[int]:
    """Of the k + 1 smallest distinct ids, k of each at most: no query needs more, whatever its own id is."""
    kept: list[int] = []
    distinct = 0
    for x in sorted(ids):
        if not kept or x != kept[-1]:
            distinct += 1
            if distinct > k + 1:
                break
        elif len(kept) >= k and kept[-k] == x:
            continue
        kept.append(x)
    return kept


def build_index(rows: DataFrame, width: int, k: int, recall: float, sample: int = SAMPLE):
    """The stored index (part, cell, v, ids), the two codebooks, what each cell holds and where, and the share to visit.

    Equal vectors become one entry with the ids of least_ids(). Each batch first folds its own copies, so a vector that
    a third of all rows share sends a few ids from each. Parts are runs of cells with about PART entries; a crowded
    cell spans several, so no task holds it whole.
    """
    spark = rows.sparkSession
    n = rows.count()
    some = rows if n <= sample else rows.filter(F.pmod(F.xxhash64(F.lit(3), "id", "v"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    taught = np.array([r["v"] for r in some.select("v").limit(2 * sample).collect()], float).reshape(-1, width)
    half, size = width // 2, codebook_size(n)
    halves = lloyd(taught[:, :half], size), lloyd(taught[:, half:], size)
    share = share_for_recall(taught, halves, k, recall)
    books = spark.sparkContext.broadcast(halves)

    def assign(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) + 0.0
            folded: dict[bytes, list[int]] = {}
            for ident, cell, key in zip(batch.column(0).to_pylist(), cells_of(v, books.value).tolist(), (row.tobytes() for row in v)):
                folded.setdefault(key, [cell]).append(ident)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in folded.values()], pa.int32()), pa.array(list(folded), pa.binary()), pa.array([least_ids(x[1:], k) for x in folded.values()], pa.list_(pa.int64()))], names=["cell", "v", "ids"])

    ids = F.array_sort(F.flatten(F.collect_list("ids")))
    folded = rows.mapInArrow(assign, "cell int, v binary, ids array<long>").groupBy("v").agg(F.min("cell").alias("cell"), ids.alias("ids"))
    few = F.filter("ids", lambda x, i: F.coalesce(F.get("ids", i - k) != x, F.lit(True)))  # as least_ids
    last = F.element_at(F.slice(F.array_distinct("ids"), 1, k + 1), -1)
    entries = stored(folded.withColumn("last", last).withColumn("ids", few).select("cell", "v", F.filter("ids", lambda x: x <= F.col("last")).alias("ids")), "entries")
    counts = np.zeros(len(halves[0]) * len(halves[1]), np.int64)
    for cell, m in entries.groupBy("cell").agg(F.count("*")).collect():  # a row a cell, of centroids^2 at most
        counts[cell] = m
    ends = np.cumsum(counts)
    first, last = (ends - counts) // PART, np.maximum(ends - 1, ends - counts) // PART
    places = spark.createDataFrame([(int(c), int(first[c]), int(last[c] - first[c] + 1)) for c in np.flatnonzero(counts)], "cell int, first int, spans int")
    part = (F.col("first") + F.pmod(F.xxhash64("v"), F.col("spans"))).cast("int")
    return entries.join(F.broadcast(places), "cell").select(part.alias("part"), "cell", "v", "ids"), halves, (counts, first, last), share


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.96, sample: int = SAMPLE) -> DataFrame:
    """The k nearest rows by Euclidean distance found for each row whose id is divisible by `every`.

    Cells are visited in order of summed centroid distance until they hold the share of all distinct vectors that
    reaches `recall` on the sample that the quantisers learn from (and over k of them in any case); a query is sent to
    the parts of the index that hold its cells and compared with their entries there, and with no others, by the
    distance of the original vectors in double precision. Returns query_id, rank, vec_id, score and `compared`, the
    distinct vectors of the cells visited; ties go to the smaller id; a row with the query's id is never its neighbour.
    Null, empty, zero and non-finite vectors and null ids take no part; vectors of different lengths are searched
    apart. Repeated rows are entries of their own, an id repeated among queries is answered once, with its first vector
    met; an empty table gives no rows; other columns are ignored.
    """
    rows = usable(vectors, id_col, vector_col)
    widths = sorted(r[0] for r in rows.groupBy(F.size("v")).count().collect())
    out = None
    for width in widths:
        part = _nearest_of_width(rows if len(widths) == 1 else rows.filter(F.size("v") == width), width, k, every, recall, sample)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, compared long")


def _nearest_of_width(rows: DataFrame, width: int, k: int, every: int, recall: float, sample: int) -> DataFrame:
    spark = rows.sparkSession
    index, halves, (counts, first, last), share = build_index(rows, width, k, recall, sample)
    wanted = max(k + 1, int(np.ceil(share * counts.sum())))
    shared = spark.sparkContext.broadcast((halves, counts, first, last))
    names = ["part", "cell", "v", "ids", "id", "cells", "compared"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()), pa.int64()]

    def visit(batches):
        """A row for each part that a query's cells lie in, with those cells."""
        halves, counts, first, last = shared.value
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) + 0.0
            for ident, x in zip(batch.column(0).to_pylist(), v):
                cells = np.array(probes(x, halves, counts, wanted), np.int64)
                spans = last[cells] - first[cells] + 1
                parts = np.repeat(first[cells], spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
                cells, held, raw = np.repeat(cells, spans), int(counts[cells].sum()), x.tobytes()
                order = np.argsort(parts, kind="stable")
                cuts = np.flatnonzero(np.diff(parts[order], prepend=-1, append=-1))
                made = [(int(parts[order[a]]), None, raw, None, ident, cells[order[a:b]].tolist(), held) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made), kinds)], names=names)

    schema = "part int, cell int, v binary, ids array<long>, id long, cells array<int>, compared long"
    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id"]).mapInArrow(visit, schema)
    both = index.unionByName(asked, allowMissingColumns=True)
    parts = int(last[-1]) + 1 if len(last) else 1
    dealt = both.repartition(parts, "part").sortWithinPartitions("part", F.col("cell").asc_nulls_last(), "id")

    def search(batches):
        now, pieces, held = None, [], None
        for batch in batches:
            part, query = batch.column(0).to_numpy(), pc.is_null(batch.column(1)).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(2 * part.astype(np.int64) + query, prepend=-1, append=-1))
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                if part[a] != now:
                    now, pieces, held = part[a], [], None
                if not query[a]:
                    pieces.append(batch.slice(a, b - a))
                    continue
                held = held or Entries(pieces, width)
                for at in range(a, b, AT_ONCE):
                    yield held.answer(batch.slice(at, min(AT_ONCE, b - at)), k)

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double, compared long")
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "compared")


class Entries:
    """A part of the index: its entries in order of cell."""

    def __init__(self, pieces: list[pa.RecordBatch], width: int):
        self.width, self.cells = width, np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in pieces] or [np.zeros(0, np.int32)])
        self.v = np.frombuffer(b"".join(x for p in pieces for x in p.column(2).to_pylist()), float).reshape(-1, width)
        self.ids = [x for p in pieces for x in p.column(3).to_pylist()]
        self.norms = (self.v**2).sum(1)

    def answer(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """Each query's k nearest among the entries of its cells: only these are multiplied."""
        ids, visits = queries.column(4).to_pylist(), queries.column(5)
        q = np.frombuffer(b"".join(queries.column(2).to_pylist()), float).reshape(-1, self.width)
        own = (q**2).sum(1)
        rough = np.full((len(q), len(self.v)), np.inf)
        who, cell = np.repeat(np.arange(len(q)), pc.list_value_length(visits).to_numpy(zero_copy_only=False)), visits.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[order], prepend=-1, append=-1))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            lo, hi = np.searchsorted(self.cells, [cell[order[a]], cell[order[a]] + 1])
            some = who[order[a:b]]
            rough[some, lo:hi] = self.norms[lo:hi] - 2 * q[some] @ self.v[lo:hi].T + own[some, None]
        found, slack = [], 1e-12 * (own + self.norms.max(initial=0))
        for i, row in enumerate(rough):
            # An entry may hold only the query itself, so one more than k; what rounding could hide is kept too.
            last = np.partition(row, k)[k] if len(row) > k else np.inf
            pick = np.flatnonzero((row <= last + 2 * slack[i]) & (row < np.inf)) if last < np.inf else np.flatnonzero(row < np.inf)
            gaps = np.sqrt(((self.v[pick] - q[i]) ** 2).sum(1))
            best = sorted((gap, c) for gap, j in zip(gaps.tolist(), pick.tolist()) for c in self.ids[j] if c != ids[i])[:k]
            found += [(ids[i], c, gap, queries.column(6)[i].as_py()) for gap, c in best]
        columns = list(zip(*found)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["query_id", "vec_id", "score", "compared"])
