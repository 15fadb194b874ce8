"""Column expressions on sequences, names, intervals and evidence; nothing here leaves the JVM unless its docstring says so."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: IUPAC codes and their complements (fixed values).
IUPAC = "ACGTUNMRWSYKVHDBacgtunmrwsykvhdb"
COMPLEMENT = "TGCAANKYWSRMBDHVtgcaankywsrmbdhv"
#: Standard normal quantile of 0.95 (fixed value).
Z95 = 1.6448536269514722


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def oriented(seq: Column, name: Column) -> Column:
    """The sequence as the last character of its name says: + as it is, - reverse complement, else null."""
    sign = F.right(name, F.lit(1))
    return F.when(sign == "+", seq).when(sign == "-", reverse_complement(seq))


def pack_kmer(kmer: Column) -> Column:
    """Two bits a base (A 0, C 1, G 2, T 3) in a long; for up to 31 bases, null for others."""
    digits = F.translate(kmer, "ACGT", "0123")
    fits = (F.length(kmer) <= 31) & kmer.rlike("^[ACGT]*$")
    return F.when(fits, F.coalesce(F.conv(F.when(digits != "", digits), 4, 10).cast("long"), F.lit(0)))


def unpack_kmer(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


@F.pandas_udf(T.LongType())
def hash_long(values: pd.Series) -> pd.Series:
    """An invertible mix of 64 bits by shifts and additions, on unsigned values kept in longs (numpy: the JVM's ANSI
    arithmetic refuses to wrap)."""
    with np.errstate(over="ignore"):
        h = values.to_numpy(np.int64).view(np.uint64).copy()
        h = ~h + (h << np.uint64(21))
        h ^= h >> np.uint64(24)
        h *= np.uint64(265)
        h ^= h >> np.uint64(14)
        h *= np.uint64(21)
        h ^= h >> np.uint64(28)
        h += h << np.uint64(31)
    return pd.Series(h.view(np.int64))


def _unshift(h: np.ndarray, n: int) -> np.ndarray:
    """The x with x ^ (x >> n) = h."""
    x = h.copy()
    for _ in range(64 // n):
        x = h ^ (x >> np.uint64(n))
    return x


@F.pandas_udf(T.LongType())
def unhash_long(values: pd.Series) -> pd.Series:
    """The inverse of hash_long: multiplications by the inverses of its odd factors, and xor-shifts undone."""
    with np.errstate(over="ignore"):
        h = values.to_numpy(np.int64).view(np.uint64)
        h = h * np.uint64(pow((1 << 31) + 1, -1, 1 << 64))
        h = _unshift(h, 28) * np.uint64(pow(21, -1, 1 << 64))
        h = _unshift(h, 14) * np.uint64(pow(265, -1, 1 << 64))
        # The first step was h * (2^21 - 1) - 1.
        h = (_unshift(h, 24) + np.uint64(1)) * np.uint64(pow((1 << 21) - 1, -1, 1 << 64))
    return pd.Series(h.view(np.int64))


def unsigned_order(h: Column) -> Column:
    """Sorts longs as the unsigned values whose bits they are."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def parse_unsigned(text: Column) -> Column:
    """An unsigned 64-bit number as the long of the same bits."""
    return F.conv(text, 10, -10).cast("long")


def print_unsigned(code: Column) -> Column:
    return F.conv(code.cast("string"), 10, 10)


def fixed_md5(text: Column) -> Column:
    """60 bits of the md5 as a long: a hash that other engines compute alike."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def direction(before: Column, here: Column, after: Column) -> Column:
    """+ where values rise, - where they fall, . where they do neither, from the neighbours there are (null: none)."""
    both = F.when((before == here) & (here == after), ".").when((before <= here) & (here <= after), "+").when((before >= here) & (here >= after), "-").otherwise(".")
    left = F.when(before < here, "+").when(before > here, "-").otherwise(".")
    right = F.when(here < after, "+").when(here > after, "-").otherwise(".")
    return F.when(before.isNotNull() & after.isNotNull(), both).when(before.isNotNull(), left).when(after.isNotNull(), right).otherwise(".")


def natural_key(name: Column) -> list[Column]:
    """Sort keys of chromosome names: numbers first, in order, then the rest as text; a chr prefix does not count."""
    bare = F.regexp_replace(name, "^chr", "")
    number = F.when(bare.rlike("^[0-9]+$"), bare).cast("decimal(38,0)")
    return [number.isNull(), number, bare]


def significant_link(evidence: list[Column]) -> Column:
    """The 0-based place of the largest count (the first of several) if it stands out against the second largest under
    a normal estimate at 5 %, else -1. Counts that are all zero give -1."""
    counts = F.array(*evidence)
    ordered = F.sort_array(counts, asc=False)
    top, both = ordered[0], ordered[0] + ordered[1]
    return F.when((both > 0) & ((top - both / 2) > Z95 * F.sqrt(both / 4)), F.array_position(counts, top).cast("int") - 1).otherwise(-1)


@F.pandas_udf(T.DoubleType())
def normal_estimate(x: pd.Series, p: pd.Series, n: pd.Series) -> pd.Series:
    """The normal approximation to the binomial distribution function at x (pandas: there is no erf in SQL)."""
    spread = np.sqrt(n * p * (1 - p) * 2)
    return ((x - n * p) / spread).map(lambda z: 0.5 * (1 + math.erf(z)))


def valid_pair(bx1: Column, bx2: Column, name1: Column, name2: Column, whole: bool = True) -> Column:
    """Barcodes present and equal and names alike: without /1 or /2, or (`whole` false) in the first character."""
    bare = (lambda n: F.regexp_replace(n, "/[12]$", "")) if whole else (lambda n: F.substring(n, 1, 1))
    return F.coalesce((bx1 == bx2) & (bare(name1) == bare(name2)), F.lit(False))


def overlaps(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    return (start1 <= end2) & (start2 <= end1)


def interval_distance(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    return F.greatest(start2 - end1, start1 - end2, F.lit(0))


def bare_name(name: Column) -> Column:
    """The name without its last _number."""
    return F.regexp_replace(name, r"_\d+$", "")


def plain_elements(token: Column) -> Column:
    """Elements of a path token: (a,b) is two, any other one."""
    return F.split(F.translate(token, "()", ""), ",")


def minutes(elapsed: Column) -> Column:
    """h:m:s or m:s as minutes."""
    part = F.transform(F.split(elapsed, ":"), lambda x: x.cast("double"))
    return F.aggregate(part, F.lit(0.0), lambda a, x: a * 60 + x) / 60


def shingles(words: Column, k: int) -> Column:
    """All runs of k words joined by a space; none where there are fewer."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))


def hash_kmer(kmer: Column) -> Column:
    """hash_long of the packed k-mer (see pack_kmer)."""
    return hash_long(pack_kmer(kmer))


def unhash_kmer(code: Column, k: int) -> Column:
    """The k-mer whose hash_kmer is `code`."""
    return unpack_kmer(unhash_long(code), k)


def kmers(seq: Column, k: int) -> Column:
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used: the optimizer repeats an expression for every
    use, but not the variable of a lambda."""
    return F.transform(F.array(value), use)[0]


def window_minimizers(hashes: Column, w: int) -> Column:
    """array<struct(pos, mx)> of the minimum of every w consecutive hashes (the right-most of equal ones), each position once.

    Null hashes are masked: they lose to all others and are not given out. Fewer than w hashes give none. Time is in
    proportion to the hashes times w: each hash is computed once, and of the picks, whose positions never fall, runs of
    equal ones become one.
    """

    def pick(place: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(place) - (w - 1)), lambda i: F.array_min(F.slice(place, i, w)))

    def distinct(picks: Column) -> Column:
        new = F.filter(picks, lambda p, i: ~p["masked"] & ((i == 0) | (F.get(picks, i - 1)["back"] != p["back"])))
        return F.transform(new, lambda p: F.struct((-p["back"]).alias("pos"), p["mx"].alias("mx")))

    def minimizers(place: Column) -> Column:
        return F.when(F.size(place) >= w, once(pick(place), distinct)).otherwise(F.array().cast("array<struct<pos:int,mx:bigint>>"))

    return once(F.transform(hashes, lambda h, i: F.struct(h.isNull().alias("masked"), F.coalesce(h, F.lit(0)).alias("mx"), (-i).alias("back"))), minimizers)


def ordered_minimizers(kmers: Column, w: int, order, emit) -> Column:
    """array<struct(pos, mx)> of window_minimizers with two hashes a k-mer: order(kmer) says which of w consecutive k-mers is
    least (null: masked), emit(kmer) is what is given out for it."""
    return once(kmers, lambda ks: F.transform(window_minimizers(F.transform(ks, order), w), lambda p: F.struct(p["pos"].alias("pos"), emit(F.get(ks, p["pos"])).alias("mx"))))
