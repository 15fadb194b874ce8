"""Mapping ordered marker lists onto paths: positional index, best positions, intervals, orientation, chaining."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from strandweave.functions.scalar import bare_name, direction
from strandweave.plans.shared import numbered, stored


def positional_index(paths: DataFrame, bxmx: DataFrame, split: bool = False) -> DataFrame:
    """Distinct (mx, tid, tpos): the markers of each path element. Unless `split`, an element whose name has no markers
    falls back to the name without one, then two, trailing numbers."""
    elements = paths.select("tid", F.col("pos").alias("tpos"), F.col("elem").cast("string").alias("e"))
    markers = bxmx.select(F.col("bx").cast("string").alias("bx"), "mx")
    if split:
        return elements.join(markers, F.col("e") == F.col("bx")).select("mx", "tid", "tpos").distinct()
    names = elements.withColumn("n", F.array_distinct(F.array("e", bare_name(F.col("e")), bare_name(bare_name(F.col("e"))))))
    tries = names.select("tid", "tpos", F.posexplode("n").alias("rank", "bx"))
    there = tries.join(bxmx.select(F.col("bx").cast("string").alias("bx")).distinct(), "bx")
    first = there.groupBy("tid", "tpos").agg(F.min_by("bx", "rank").alias("bx"))
    return first.join(markers, "bx").select("mx", "tid", "tpos").distinct()


def median_low(values: Column) -> Column:
    """The middle of a sorted array, the lower of two."""
    return F.element_at(values, F.floor((F.size(values) - 1) / 2).cast("int") + 1)


def median_high(values: Column) -> Column:
    return F.element_at(values, F.floor(F.size(values) / 2).cast("int") + 1)


def hits(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, qpos, tid, tpos) of queries(qid, qpos, mx) in the index, repeats of a marker in a query included."""
    return queries.join(index, "mx").select("qid", "qpos", "tid", "tpos")


#: Rows of a group whose values are gathered in one array, and hits of a query that one task folds at once; ranks of larger
#: groups are found by chunks of WIDTH values.
LONG, WIDTH = 1_000_000, 1024
#: Positions of a marker in one row; those of a marker that stands at more are spread over several.
SPOTS = 256


def large_groups(rows: DataFrame, key: str) -> DataFrame | None:
    """(key) of the groups of more than LONG rows, None if there is none. They are fewer than the rows by LONG."""
    found = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > LONG).select(key)
    found = stored(found, "large")
    return None if found.isEmpty() else found


def values_at(rows: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, n, a column a place): the values of each group at 0-based places in ascending order; a place is computed from
    the number n of the group's rows.

    Equal values are counted. WIDTH neighbouring values make a chunk; only the chunks' counts meet a group, which tell the
    chunk of each place, and that chunk alone is opened. So a group of any size is spread over tasks.
    """
    counted = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    chunks = counted.groupBy(*keys, F.floor(F.col("_v") / WIDTH).alias("_c")).agg(F.array_sort(F.collect_list(F.struct("_v", "_k"))).alias("_a"), F.sum("_k").alias("_n"))
    chunks = stored(chunks, "chunks")
    group = W.Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy("_c"))
    spread = chunks.select(*keys, "_c", (upto - F.col("_n")).alias("_from"), upto.alias("_to"), F.sum("_n").over(group).alias("n"))
    wanted = spread.select("*", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), at(F.col("n")).cast("long").alias("at")) for name, at in places.items()))).alias("p"))
    wanted = wanted.filter((F.col("p.at") >= F.col("_from")) & (F.col("p.at") < F.col("_to")))
    opened = wanted.join(chunks.select(*keys, "_c", "_a"), [*keys, "_c"])
    # The running count within the chunk passes the place first at the value that stands there.
    start = F.struct((F.col("p.at") - F.col("_from")).alias("left"), F.lit(None).cast(rows.schema[value].dataType).alias("v"))
    step = lambda acc, x: F.struct((acc["left"] - x["_k"]).alias("left"), F.when((acc["left"] >= 0) & (acc["left"] < x["_k"]), x["_v"]).otherwise(acc["v"]).alias("v"))
    found = opened.select(*keys, "n", F.col("p.name").alias("name"), F.aggregate("_a", start, step)["v"].alias("v"))
    return found.groupBy(*keys, "n").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places))


class Spots(NamedTuple):
    """rows(mx, first, n, spots): the n positions of each marker in parts of up to SPOTS, one of them the first, as _packed
    gives them; the paths' names(tid, _t) where paths are numbered, None where tid is the number; and index, stored."""

    rows: DataFrame
    names: DataFrame | None
    index: DataFrame


def _packed(spots: np.ndarray, n: np.ndarray) -> pa.Array:
    """Lists of n ascending numbers path << 32 | tpos as bytes: what path and tpos gain on the one before, the latter with its
    sign in the lowest bit, each in groups of 7 bits of which all but the last have the eighth set."""
    heads = np.cumsum(n) - n
    gains = np.empty((len(spots), 2), np.int64)
    for i, part in enumerate((spots >> 32, spots & 0xFFFFFFFF)):
        gains[:, i] = np.diff(part, prepend=0)
        gains[heads, i] = part[heads]
    gains[:, 1] = (gains[:, 1] << 1) ^ (gains[:, 1] >> 63)
    values = gains.ravel()
    width = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        some = np.flatnonzero(width > k)
        out[ends[some] - width[some] + k] = (values[some] >> 7 * k & 127) | np.where(width[some] > k + 1, 128, 0)
    offsets = np.concatenate([[0], ends[2 * np.cumsum(n) - 1]]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists that _packed gave, and how many each has (null: none)."""
    lists = pc.fill_null(lists.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    held = lists.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    last = data < 128
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    values = (data[starts] & 127).astype(np.int64)
    for k in range(1, 5):
        some = np.flatnonzero(ends - starts > k)
        values[some] |= (data[starts[some] + k] & 127).astype(np.int64) << 7 * k
    upto = np.concatenate([[0], np.cumsum(last)])[offsets - offsets[0]] // 2
    n = np.diff(upto)
    path, tpos = values[::2], values[1::2]
    spots = np.zeros(len(path), np.int64)
    for gains, shift in ((path, 32), ((tpos >> 1) ^ -(tpos & 1), 0)):
        total = np.concatenate([[0], np.cumsum(gains)])
        spots += (total[1:] - np.repeat(total[upto[:-1]], n)) << shift
    return spots, n


def _spots(index: DataFrame) -> Spots:
    index = stored(index.select("mx", "tid", "tpos"), "index")
    names, rows = None, index.withColumn("_t", F.col("tid"))
    fits = isinstance(index.schema["tid"].dataType, T.IntegralType)
    if fits:
        low, high, null = index.agg(F.min("tid"), F.max("tid"), F.count_if(F.col("tid").isNull())).first()
        fits = not null and (low is None or (low >= 0 and high < 2**31))
    if not fits:
        names = stored(numbered(index.select("tid").distinct(), [F.col("tid")], "_t"), "paths")
        rows = index.join(names.withColumnRenamed("tid", "_name"), F.col("tid").eqNullSafe(F.col("_name")))
    spot = F.shiftleft(F.col("_t").cast("long"), 32).bitwiseOR(F.col("tpos").cast("long"))
    ordered = rows.select("mx", spot.alias("spot")).repartition("mx").sortWithinPartitions("mx", "spot")
    bound = SPOTS

    def pack(batches):
        last = None  # the marker of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("mx").dictionary_encode(null_encoding="encode").indices.to_numpy()
            heads = np.flatnonzero(np.diff(code, prepend=-1))  # codes rise, as markers come in order
            place = np.arange(len(code)) - np.repeat(heads, np.diff(heads, append=len(code)))
            starts = np.flatnonzero(place % bound == 0)
            n = np.diff(starts, append=len(code))
            first = place[starts] == 0
            first[0] = last is None or last != batch.column("mx")[:1]
            last = batch.column("mx")[-1:]
            yield pa.RecordBatch.from_arrays([batch.column("mx").take(pa.array(starts)), pa.array(first), pa.array(n), _packed(batch.column("spot").to_numpy(), n)], names=["mx", "first", "n", "spots"])

    kinds = T.StructType([index.schema["mx"], T.StructField("first", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("spots", T.BinaryType())])
    return Spots(stored(ordered.mapInArrow(pack, kinds), "spots"), names, index)


def _large_queries(queries: DataFrame, spots: Spots) -> DataFrame | None:
    """(qid) of the queries of more than LONG hits, None if there is none."""
    most = spots.rows.groupBy("mx").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    may = stored(queries.groupBy("qid").agg(F.count("*").alias("_n")).filter(F.col("_n") * most > LONG).select("qid"), "may")
    if may.isEmpty():
        return None
    weights = queries.join(may, "qid", "left_semi").join(spots.rows.select("mx", "n"), "mx").groupBy("qid").agg(F.sum("n").alias("_n"))
    large = stored(weights.filter(F.col("_n") > LONG).select("qid"), "large")
    return None if large.isEmpty() else large


class Found(NamedTuple):
    """Hits of whole queries, by query, position and query position: q numbers the queries, spot is path << 32 | tpos. Hits of
    one query and position are a group: starts, sizes, and the groups' q and spot."""

    qpos: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    q: np.ndarray
    spot: np.ndarray

    def at(self, places: np.ndarray) -> np.ndarray:
        """The query position at a 0-based place of each group."""
        return self.qpos[self.starts + places]


def _sorted_hits(q: np.ndarray, spot: np.ndarray, qpos: np.ndarray) -> Found:
    order = np.lexsort((qpos, spot, q))
    q, spot = q[order], spot[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (spot[1:] != spot[:-1])
    starts = np.flatnonzero(new)
    return Found(qpos[order], starts, np.diff(starts, append=len(q)), q[starts], spot[starts])


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of whole queries, from batches in the order of queries."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column("qid").dictionary_encode(null_encoding="encode").indices.to_numpy()
        last = int(np.searchsorted(code, code[-1]))  # codes rise, as queries come in order
        if held and last == 0 and held[-1].column("qid")[-1].as_py() == batch.column("qid")[0].as_py():
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _folded(queries: DataFrame, spots: Spots, columns: dict[str, T.DataType], make: Callable[[Found], tuple[np.ndarray, dict]]) -> DataFrame:
    """(qid, qlength, tid, tpos, score) and `columns` of the positions that make(hits) keeps, with the columns' values there.

    Only rows of queries are shuffled, each with the list of its marker's positions; a task sorts them by query and folds
    whole queries, some LONG hits at a time, so hits are never rows of Spark's.
    """
    lists = queries.select("qid", "qpos", "mx").join(spots.rows.drop("n"), "mx", "left").select("qid", F.col("qpos").cast("long").alias("qpos"), F.coalesce("first", F.lit(True)).alias("first"), "spots")
    ordered = lists.repartition("qid").sortWithinPartitions("qid", "qpos")
    bound = LONG
    kinds = [T.StructField("qid", queries.schema["qid"].dataType), *(T.StructField(c, T.LongType()) for c in ("qlength", "_t", "tpos", "score")), *(T.StructField(c, t) for c, t in columns.items())]

    def fold(batches):
        for table in _pieces(batches):
            if not table.num_rows:
                continue
            qid = table.column("qid").combine_chunks()
            code = qid.dictionary_encode(null_encoding="encode").indices.to_numpy()
            heads = np.flatnonzero(np.diff(code, prepend=-1))
            flat, counts = _unpacked(table.column("spots").combine_chunks())
            qpos, first = table.column("qpos").to_numpy(), table.column("first").to_numpy()
            lengths, upto = np.add.reduceat(first.astype(np.int64), heads), np.concatenate([[0], np.cumsum(counts)])
            ends = upto[np.append(heads[1:], len(code))]  # hits up to the end of each query
            done = 0
            while done < len(heads):
                begin = upto[heads[done]]
                until = max(int(np.searchsorted(ends, begin + bound, "right")), done + 1)
                rows = slice(heads[done], heads[until] if until < len(heads) else len(code))
                done = until
                if upto[rows.stop] == begin:
                    continue
                found = _sorted_hits(np.repeat(code[rows], counts[rows]), flat[begin : upto[rows.stop]], np.repeat(qpos[rows], counts[rows]))
                keep, made = make(found)
                q, spot = found.q[keep], found.spot[keep]
                values = [qid.take(pa.array(heads[q])), pa.array(lengths[q]), pa.array(spot >> 32), pa.array(spot & 0xFFFFFFFF), pa.array(found.sizes[keep]), *(pa.array(made[c]) for c in columns)]
                yield pa.RecordBatch.from_arrays(values, names=[k.name for k in kinds])

    rows = ordered.mapInArrow(fold, T.StructType(kinds))
    path, kind = F.col("_t"), spots.index.schema
    if spots.names is not None:
        rows, path = rows.join(spots.names, "_t"), F.col("tid")
    return rows.select("qid", "qlength", path.cast(kind["tid"].dataType).alias("tid"), F.col("tpos").cast(kind["tpos"].dataType).alias("tpos"), "score", *columns)


def _in_two(queries: DataFrame, index: DataFrame, small: Callable[[DataFrame, Spots], DataFrame], large: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """small(queries, spots) for most queries and large(queries, index) for those of more than LONG hits."""
    spots = _spots(index)
    long = _large_queries(queries, spots)
    if long is None:
        return small(queries, spots)
    rest = queries.join(long.withColumnRenamed("qid", "_q"), F.col("qid").eqNullSafe(F.col("_q")), "left_anti")
    return small(rest, spots).unionByName(large(queries.join(long, "qid", "left_semi"), spots.index))


def scored_positions(found: DataFrame) -> DataFrame:
    """(qid, tid, tpos, score, median): hits of each query at each position and the lower median of their query positions."""
    return values_at(found, ["qid", "tid", "tpos"], "qpos", {"median": lambda n: F.floor((n - 1) / 2)}).withColumnRenamed("n", "score")


def _turns(found: Found, here: np.ndarray, reach: int) -> np.ndarray:
    """The orientation of each group, as _neighbour_direction tells it."""
    n = len(here)
    if reach == 1:
        next_to = np.zeros(n + 1, bool)
        next_to[1:n] = (found.q[1:] == found.q[:-1]) & (found.spot[1:] == found.spot[:-1] + 1)
        has_before, has_after = next_to[:n], next_to[1:]
        before, after = np.roll(here, 1), np.roll(here, -1)
    else:
        has_before = has_after = np.ones(n, bool)
        before, after = (_middle(found, here, reach, side) for side in (-1, 1))
    rises = np.where(has_before & has_after, (before <= here) & (here <= after), np.where(has_before, before < here, has_after & (here < after)))
    falls = np.where(has_before & has_after, (before >= here) & (here >= after), np.where(has_before, before > here, has_after & (here > after)))
    return np.where(rises & ~falls, "+", np.where(falls & ~rises, "-", "."))


def _middle(found: Found, here: np.ndarray, reach: int, side: int) -> np.ndarray:
    """The lower median over the positions from reach - 1 before up to here (side -1), or the upper one over those after."""
    out = np.empty_like(here)
    rows = np.arange(len(here))
    step = max(1, LONG // reach)
    for low in range(0, len(here), step):
        own = rows[low : low + step, None]
        at = own + side * np.arange(min(reach, len(here)))[None, :]
        inside = (at >= 0) & (at < len(here))
        at = np.where(inside, at, own)
        inside &= (found.q[at] == found.q[own]) & (np.abs(found.spot[at] - found.spot[own]) < reach)
        values = np.sort(np.where(inside, here[at], np.iinfo(here.dtype).max), axis=1)
        n = inside.sum(axis=1)
        out[low : low + step] = values[np.arange(len(own)), (n - 1) // 2 if side < 0 else n // 2]
    return out


def _neighbour_direction(here: str, reach: int) -> Column:
    along = W.Window.partitionBy("qid", "tid").orderBy("tpos")
    if reach == 1:
        return direction(F.max(here).over(along.rangeBetween(-1, -1)), F.col(here), F.max(here).over(along.rangeBetween(1, 1)))
    before = F.array_sort(F.collect_list(here).over(along.rangeBetween(-(reach - 1), 0)))
    after = F.array_sort(F.collect_list(here).over(along.rangeBetween(0, reach - 1)))
    return direction(median_low(before), F.col(here), median_high(after))


def map_to_bed(queries: DataFrame, index: DataFrame, least: int = 1, reach: int = 1) -> DataFrame:
    """BED rows (tname, tstart, tend, qname, score, orientation): positions with at least `least` hits of a query.

    Orientation compares the medians at neighbouring positions: at one before and after, or with `reach` above 1 the
    lower median of those up to here and the upper median of those from here. It is taken before the score filter.
    """
    if reach < 1:
        raise ValueError("reach must be 1 or more")
    def small(some: DataFrame, spots: Spots) -> DataFrame:
        def make(found: Found) -> tuple[np.ndarray, dict]:
            keep = found.sizes >= least
            return keep, {"orientation": _turns(found, found.at((found.sizes - 1) // 2), reach)[keep]}

        return _folded(some, spots, {"orientation": T.StringType()}, make).drop("qlength")

    def large(some: DataFrame, index: DataFrame) -> DataFrame:
        return scored_positions(hits(some, index)).withColumn("orientation", _neighbour_direction("median", reach)).filter(F.col("score") >= least).drop("median")

    rows = _in_two(queries, index, small, large)
    return rows.select(F.col("tid").alias("tname"), F.col("tpos").alias("tstart"), (F.col("tpos") + 1).alias("tend"), F.col("qid").alias("qname"), "score", "orientation")


def rank_value(values: Column, share: float) -> Column:
    """Nearest rank, rounded half to even, in a sorted array."""
    return F.element_at(values, F.rint(F.lit(share) * (F.size(values) - 1)).cast("int") + 1)


def map_to_paf(queries: DataFrame, index: DataFrame, paths: DataFrame, least: int = 1, coef: float = 1.5) -> DataFrame:
    """PAF rows: as map_to_bed, with the query interval between the whiskers of the hits' query positions.

    mapq is 100 * score / (qend - qstart), truncated; where start and end are equal it is 0. Lengths are marker and element counts.
    """
    lengths = paths.groupBy("tid").agg(F.count("*").alias("tlength"))
    keys, shares = ["qid", "tid", "tpos"], {f"q{i}": i / 4 for i in range(5)}
    kind = queries.schema["qpos"].dataType

    def small(some: DataFrame, spots: Spots) -> DataFrame:
        def make(found: Found) -> tuple[np.ndarray, dict]:
            keep = found.sizes >= least
            q = {c: found.at(np.rint(p * (found.sizes - 1)).astype(np.int64)) for c, p in shares.items()}
            return keep, {c: v[keep] for c, v in q.items()} | {"orientation": _turns(found, q["q2"], 1)[keep]}

        rows = _folded(some, spots, dict.fromkeys(shares, T.LongType()) | {"orientation": T.StringType()}, make).filter("qid IS NOT NULL")
        return rows.withColumns({c: F.col(c).cast(kind) for c in shares})

    def large(some: DataFrame, index: DataFrame) -> DataFrame:
        places = {c: lambda n, p=p: F.rint(F.lit(p) * (n - 1)) for c, p in shares.items()}
        rows = values_at(hits(some, index), keys, "qpos", places).withColumnRenamed("n", "score").withColumn("orientation", _neighbour_direction("q2", 1))
        return rows.filter(F.col("score") >= least).join(some.groupBy("qid").agg(F.count("*").alias("qlength")), "qid")

    q0, q1, q3, q4 = (F.col(c) for c in ("q0", "q1", "q3", "q4"))
    reach = coef * (q3 - q1)
    rows = _in_two(queries, index, small, large).join(lengths, "tid")
    rows = rows.withColumns({"qstart": F.greatest(q0, (q1 - reach).cast("int")), "qend": F.least(q4, (q3 + reach).cast("int"))})
    mapq = F.coalesce(F.try_divide(100 * F.col("score"), F.col("qend") - F.col("qstart")).cast("int"), F.lit(0))
    return rows.select(
        F.col("qid").alias("qname"), "qlength", "qstart", "qend", "orientation", F.col("tid").alias("tname"), "tlength", F.col("tpos").alias("tstart"), (F.col("tpos") + 1).alias("tend"), "score", F.col("qlength").alias("length"), mapq.alias("mapq")
    )


class Trend(NamedTuple):
    """S of the Mann-Kendall test, its normal score, its p (see mann_kendall), whether the alternative is accepted, and the fitted line."""

    s: int
    z: float
    p: float
    accepted: bool
    slope: float
    intercept: float


def _earlier(x: np.ndarray, eps: float) -> tuple[int, int]:
    """Pairs of an earlier and a later value that rise, and that fall, by more than eps: blocks of 1, 2, 4, ... values are
    counted against their left neighbours, so it takes n log^2 n steps and memory for a few arrays."""
    n = len(x)
    if n <= 64:  # few pairs are compared outright
        gaps = (x[None, :] - x[:, None])[np.triu_indices(n, 1)]
        return int((gaps > eps).sum()), int((gaps < -eps).sum())
    ordered = np.sort(x)
    rank = np.empty(n, np.int64)
    rank[np.argsort(x, kind="stable")] = np.arange(n)
    below, upto = np.searchsorted(ordered, x - eps, "left"), np.searchsorted(ordered, x + eps, "right")
    place, rises, falls, width = np.arange(n), 0, 0, 1
    while width < n:
        block = place // width
        left, right = block % 2 == 0, block % 2 == 1
        keys = np.sort(block[left] * (n + 1) + rank[left])
        base = (block[right] - 1) * (n + 1)
        starts = np.searchsorted(keys, base)
        rises += int((np.searchsorted(keys, base + below[right]) - starts).sum())
        falls += int((np.searchsorted(keys, base + n) - np.searchsorted(keys, base + upto[right])).sum())
        width *= 2
    return rises, falls


def mann_kendall(x: np.ndarray, t: np.ndarray | None = None, eps: float = 1.0, alpha: float = 0.05, alternative: str = "upordown") -> Trend:
    """Tests the values x, in their order, for a trend: differences of up to eps are ties.

    `alternative` is up, down or upordown; it is accepted where the score reaches the normal quantile of 1 - alpha (of
    1 - alpha / 2 for upordown). p is the upper tail of the score for up, the lower for down, half the outer tail for
    upordown, and 0.5 where S is within eps of 0. The line is fitted by least squares over t (by default 0, 1, ...).
    """
    if alternative not in ("up", "down", "upordown"):
        raise ValueError("the alternative must be up, down or upordown")
    n, law = len(x), NormalDist()
    t = np.arange(n) if t is None else np.asarray(t, float)
    rises, falls = _earlier(x, eps)
    s = rises - falls
    ordered = np.sort(x)
    values = np.unique(x)
    ties = np.searchsorted(ordered, values + eps, "left") - np.searchsorted(ordered, values - eps, "right")
    spread = (n * (n - 1) * (2 * n + 5) - int((ties * (ties - 1) * (2 * ties + 5)).sum())) / 18
    z = float((s - np.sign(s)) / np.sqrt(spread)) if spread > 0 and abs(s) > eps else 0.0
    tails = {"up": 1 - law.cdf(z), "down": law.cdf(z), "upordown": 0.5 * (1 - law.cdf(abs(z)))}
    limit = law.inv_cdf(1 - alpha / 2 if alternative == "upordown" else 1 - alpha)
    accepted = {"up": z >= limit, "down": z <= -limit, "upordown": abs(z) >= limit}[alternative]
    around = t - t.mean()
    slope = float((around * (x - x.mean())).sum() / (around**2).sum()) if n and (around**2).sum() else 0.0
    return Trend(s, z, tails[alternative] if abs(s) > eps else 0.5, accepted, slope, float(x.mean() - slope * t.mean()) if n else 0.0)


#: Values of a group that are compared with each other in one matrix with other groups' values.
PAIRED = 256


def _trend_signs(x: np.ndarray, t: np.ndarray, starts: np.ndarray, sizes: np.ndarray, p_value: float) -> np.ndarray:
    """+, - or . of each group of integers x at t, in order: the sign of the line where mann_kendall's p is below p_value.

    Groups of up to PAIRED values are tested together, those of about the same size as one matrix.
    """
    owner, law = np.repeat(np.arange(len(sizes)), sizes), NormalDist()
    s, ties = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    width = -(-sizes // 16) * 16
    for w in np.unique(width[sizes <= PAIRED]):
        for part in np.array_split(np.flatnonzero(width == w), max(1, int((width == w).sum() * w // LONG))):
            places = np.arange(w)[None, :]
            inside = places < sizes[part, None]
            values = np.where(inside, x[np.where(inside, starts[part, None] + places, 0)], np.nan)
            for d in range(1, int(sizes[part].max(initial=0))):
                gap = values[:, d:] - values[:, :-d]
                s[part] += (gap > 1).sum(axis=1) - (gap < -1).sum(axis=1)
    for i in np.flatnonzero(sizes > PAIRED):
        rises, falls = _earlier(x[starts[i] : starts[i] + sizes[i]].astype(float), 1.0)
        s[i] = rises - falls
    order = np.lexsort((x, owner))
    heads = np.flatnonzero((np.diff(x[order], prepend=0) != 0) | (np.diff(owner[order], prepend=-1) != 0))
    same = np.diff(heads, append=len(x))
    np.add.at(ties, owner[order][heads], same * (same - 1) * (2 * same + 5))
    spread = (sizes * (sizes - 1) * (2 * sizes + 5) - ties) / 18
    tested = (spread > 0) & (np.abs(s) > 1)
    z = np.where(tested, (s - np.sign(s)) / np.sqrt(np.where(spread > 0, spread, 1)), 0.0)
    p = np.where(np.abs(s) > 1, [0.5 * (1 - law.cdf(v)) for v in np.abs(z).tolist()], 0.5)
    total = lambda v: np.add.reduceat(v, starts) if len(starts) else v
    x0, t0 = x - x[starts][owner], t - t[starts][owner]
    line = sizes * total(x0 * t0) - total(x0) * total(t0)
    return np.where((p >= p_value) | (line == 0), ".", np.where(line > 0, "+", "-"))


def _trends(found: Found, least: int, p_value: float, most: int) -> tuple[np.ndarray, dict]:
    median, head = found.at((found.sizes - 1) // 2), found.at(np.zeros_like(found.sizes))
    path = found.spot >> 32
    beside = np.zeros(len(median) + 1, bool)
    beside[1:-1] = (found.q[1:] == found.q[:-1]) & (found.spot[1:] == found.spot[:-1] + 1)
    joined = beside[:-1] | beside[1:]
    new = np.ones(len(median), bool)
    new[1:] = (found.q[1:] != found.q[:-1]) | (path[1:] != path[:-1])
    line = np.cumsum(new) - 1  # a query on a path
    count = lambda w: np.bincount(line, weights=w, minlength=line[-1] + 1).astype(np.int64)
    thin = (count(joined) > most) | (count(joined * found.sizes) > 50_000)
    times = np.where(joined, np.where(thin[line], 1, found.sizes), 0)
    group = np.repeat(np.arange(len(times)), times)
    place = np.arange(len(group)) - np.repeat(np.cumsum(times) - times, times)
    x = np.where(thin[line[group]], median[group], found.qpos[found.starts[group] + place])
    t = (found.spot & 0xFFFFFFFF)[group]
    order = np.lexsort((x, t, head[group], line[group]))
    signs = np.full(line[-1] + 1, ".", dtype="<U1")
    present, starts, sizes = np.unique(line[group], return_index=True, return_counts=True)
    signs[present] = _trend_signs(x[order], t[order], starts, sizes, p_value)
    keep = found.sizes >= least
    return keep, {"orientation": signs[line][keep]}


def map_trend(queries: DataFrame, index: DataFrame, least: int = 1, p_value: float = 0.01, most: int = 50) -> DataFrame:
    """BED rows as map_to_bed, oriented by a Mann-Kendall trend of query positions along each path.

    Positions without a neighbour one before or after do not count. With more than `most` positions, or 50000 points,
    each position's lower median stands for it. Points follow the order in which the query first meets a position; their
    trend says whether there is an orientation, and the slope of their line over the path which it is.
    """

    def small(some: DataFrame, spots: Spots) -> DataFrame:
        return _folded(some, spots, {"orientation": T.StringType()}, lambda found: _trends(found, least, p_value, most)).drop("qlength")

    rows = _in_two(queries, index, small, lambda some, index: _trends_by_path(some, index, least, p_value, most))
    return rows.select(F.col("tid").alias("tname"), F.col("tpos").alias("tstart"), (F.col("tpos") + 1).alias("tend"), F.col("qid").alias("qname"), "score", "orientation")


def _trends_by_path(queries: DataFrame, index: DataFrame, least: int, p_value: float, most: int) -> DataFrame:
    """map_trend's rows for queries of many hits, whose hits on one path meet in a task."""
    found = hits(queries, index)
    spots = scored_positions(found)
    along = W.Window.partitionBy("qid", "tid").orderBy("tpos").rangeBetween
    joined = (F.max("median").over(along(-1, -1)).isNotNull()) | (F.max("median").over(along(1, 1)).isNotNull())
    trended = spots.withColumn("joined", joined).filter("joined").select("qid", "tid", "tpos", "median")
    points = found.join(trended, ["qid", "tid", "tpos"])

    def trend(group: pd.DataFrame) -> pd.DataFrame:
        t, q, median = (group[c].to_numpy() for c in ("tpos", "qpos", "median"))
        order = np.lexsort((q, t))
        t, q, median = t[order], q[order], median[order]
        starts = np.flatnonzero(np.diff(t, prepend=t[0] - 1))
        first = np.repeat(q[starts], np.diff(starts, append=len(t)))  # where the query first meets each position
        if len(starts) > most or len(t) > 50_000:
            t, q, first = t[starts], median[starts], first[starts]
        order = np.lexsort((q, t, first))
        found = mann_kendall(q[order].astype(float), t[order].astype(float), alpha=p_value)
        sign = "." if found.p >= p_value or not found.slope else "+" if found.slope > 0 else "-"
        return pd.DataFrame({"qid": group["qid"].iloc[:1], "tid": group["tid"].iloc[:1], "trend": [sign]})

    kinds = dict(points.dtypes)
    trends = points.groupBy("qid", "tid").applyInPandas(trend, f"qid {kinds['qid']}, tid {kinds['tid']}, trend string")
    rows = spots.filter(F.col("score") >= least).join(trends, ["qid", "tid"], "left")
    return rows.select("qid", "tid", "tpos", "score", F.coalesce("trend", F.lit(".")).alias("orientation"))


def liftover(paf: DataFrame, positions: DataFrame) -> DataFrame:
    """PAF intervals in marker numbers as nucleotide positions, by positions(qid, idx, pos); qlength becomes the last position."""
    columns, own = paf.columns, positions.select(F.col("qid").alias("qname"), "idx", "pos")
    counts = own.groupBy("qname").agg(F.count("*").alias("_n"), F.min("idx").alias("_low"), F.max("idx").alias("_high"), F.count_distinct("idx").alias("_idx"))
    # Queries whose numbers run without a gap or a repeat are a list each, so that a record meets its query once.
    plain = (F.col("_n") <= LONG) & (F.col("_n") == F.col("_idx")) & (F.col("_n") == F.col("_high") - F.col("_low") + 1)
    rest = stored(counts.filter(~plain).select("qname"), "rest")
    none = rest.isEmpty()
    lists = (own if none else own.join(rest, "qname", "left_anti")).groupBy("qname").agg(F.array_sort(F.collect_list(F.struct("idx", "pos"))).alias("_a"), F.max("pos").alias("_last"))
    low, n = F.col("_a")[0]["idx"], F.size("_a")
    inside = lambda c: (F.col(c) >= low) & (F.col(c) < low + n)
    lifted = lambda c: F.get("_a", (F.col(c) - low).cast("int"))["pos"]
    found = paf.join(lists, "qname").filter(inside("qstart") & inside("qend"))
    rows = found.select(*({"qstart": lifted("qstart"), "qend": lifted("qend"), "qlength": F.col("_last")}.get(c, F.col(c)).alias(c) for c in columns))
    if none:
        return rows
    own = own.join(rest, "qname", "left_semi")
    start, end = own.withColumnsRenamed({"idx": "qstart", "pos": "lifted_start"}), own.withColumnsRenamed({"idx": "qend", "pos": "lifted_end"})
    last = own.groupBy("qname").agg(F.max("pos").alias("last"))
    other = paf.join(start, ["qname", "qstart"]).join(end, ["qname", "qend"]).join(last, "qname")
    return rows.unionByName(other.withColumns({"qstart": F.col("lifted_start"), "qend": F.col("lifted_end"), "qlength": F.col("last")}).select(*columns))


def best_per_position(bed: DataFrame) -> DataFrame:
    """The record with the highest score at each (tname, tstart, tend); ties: the smaller qname."""
    rank = F.row_number().over(W.Window.partitionBy("tname", "tstart", "tend").orderBy(F.desc("score"), "qname"))
    return bed.withColumn("_r", rank).filter("_r = 1").drop("_r")


def paf_to_bed(paf: DataFrame) -> DataFrame:
    return paf.select(F.col("qname").alias("tname"), F.col("qstart").alias("tstart"), F.col("qend").alias("tend"), F.concat_ws("_", "tname", "tstart").alias("qname"), "score", "orientation")


def chain(paf: DataFrame, least_tlength: int = 100, least_mapq: int = 1, qgap: int = 500_000, tgap: int = 10, dropped: str = "NW_") -> DataFrame:
    """Chains of PAF records: one row a (qname, tname, segment).

    Short or unplaced targets and low mapping qualities go; the best record stays at each target position; records must
    overlap their target's previous or next in query order; a gap of `qgap` in the query or `tgap` in the target starts
    a new segment. Orientation is the commonest, of several the smallest.
    """
    kept = paf.filter((F.col("tlength") >= least_tlength) & (F.col("mapq") >= least_mapq) & ~F.col("qname").cast("string").contains(dropped))
    best = W.Window.partitionBy("tname", "tstart").orderBy(F.desc("score"), "qname", "qstart", "qend")
    rows = kept.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
    along = W.Window.partitionBy("qname", "tname").orderBy("qstart", "qend", "tstart")
    before, after = (lambda c: F.lag(c).over(along)), (lambda c: F.lead(c).over(along))
    touch = F.coalesce((F.col("qstart") <= before("qend")) & (before("qstart") <= F.col("qend")), F.lit(False)) | F.coalesce((F.col("qstart") <= after("qend")) & (after("qstart") <= F.col("qend")), F.lit(False))
    rows = rows.withColumn("_t", touch).filter("_t").drop("_t")
    gap = lambda s, e: F.greatest(F.col(s) - before(e), before(s) - F.col(e), F.lit(0))
    new = F.coalesce((gap("qstart", "qend") >= qgap) | (gap("tstart", "tend") >= tgap), F.lit(False))
    rows = rows.withColumn("_n", new).withColumn("segment", F.sum(F.col("_n").cast("int")).over(along))
    return rows.groupBy("qname", "tname", "segment").agg(
        F.min("qstart").alias("qstart"), F.max("qend").alias("qend"), F.min("tstart").alias("tstart"), F.max("tend").alias("tend"), F.sum("score").alias("matches"),
        median_low(F.array_sort(F.collect_list("mapq"))).alias("mapq"), F.count("*").alias("n"), F.mode("orientation", True).alias("orientation"),
    )
