import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandweave.llm.common import new_path, table
from strandweave.llm.merkle import build_manifest, fold, prove, verify_altered

from .helpers import SCHEMA, SF, clashing, odd_documents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    text = row.text.translate({c: c + 32 for c in range(65, 91)}) if lower and row.text is not None else row.text
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def levels(digests):
    found = [digests]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([sha("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return found


def brute(docs):
    """Every row of verify_altered, from whole lists."""
    groups = defaultdict(list)
    for r in docs:
        groups[r.source].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
    trees = {g: levels([leaf_of(r) for r in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            changed = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0
            proof, at = "", leaf_of(r, changed)
            for tree, place in ((trees[g], i), (top, k)):
                for level in tree[:-1]:
                    start = place // 16 * 16
                    left, right = "".join(level[start:place]), "".join(level[place + 1 : start + 16])
                    proof, at, place = proof + left + right, sha(left + at + right), place // 16
            out.append((str(r.doc_id), leaf_of(r), trees[g][-1][0], top[-1][0], sha(proof), at, at == top[-1][0]))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def many(spark):
    """A source of 700 rows (three levels), twenty more sources (two levels on top), one of a single row, and repeats."""
    rows = [(i, f"Text {i % 50}", "en", "big", i) for i in range(700)] + [(1000 + i, "Y", None, f"s{i % 19}é", 1) for i in range(60)] + [(5000, "Lone", "en", None, None)] + [(6000, "SAME", "de", "same", 1)] * 40
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("which", ["table", "odd", "many", "one", "one_source"])
def test_against_whole_lists(spark, which):
    docs = {
        "table": lambda: table(spark, SF, "documents"), "odd": lambda: clashing(odd_documents(spark), "leaf", "altered", "tree", "place", "n", "group", "id", "root"), "many": lambda: many(spark),
        "one": lambda: many(spark).filter("doc_id = 5000"), "one_source": lambda: many(spark).filter("source = 'big' AND doc_id < 40"),
    }[which]()
    got = rows_of(verify_altered(docs))
    assert got == brute(docs.collect())
    assert any(not r[-1] for r in got) or which in ("one", "odd")


def test_empty_table(spark):
    assert verify_altered(many(spark).limit(0)).collect() == []


def test_single_requests_and_wrong_leaves(spark):
    """A few requests descend alone; another leaf in place of the found one leads to another root; the rest get no row."""
    docs = many(spark)
    manifest = build_manifest(docs, new_path(spark, "manifest"))
    ids = [3, 699, 1005, 5000]
    few = manifest.leaves.filter(F.col("id").isin(ids)).select("id", "tree", "place", "leaf")
    found = prove(manifest, few).withColumn("folded", fold(F.col("leaf"), F.col("proof"))).withColumn("wrong", fold(F.unhex(F.sha2(F.lit("x"), 256)), F.col("proof"))).collect()
    assert sorted(r.id for r in found) == ids
    assert all(r.folded == manifest.root and r.found == r.leaf and r.wrong != manifest.root for r in found)
    beyond = few.limit(1).withColumn("place", F.lit(700).cast("long")).withColumn("tree", F.lit(99).cast("long"))
    assert prove(manifest, beyond).collect() == []
