"""A Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups' roots.

Nodes are kept as records from a digest to the digests of its children. Requests for leaves descend from the root by the
digits of their ranks; those with the same digits so far descend as one row, so no node is met by more than one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.plans.shared import discard

from .common import crc_of_id, new_path, running, stored

#: Bytes of a digest.
SIZE = 32
#: A table of groups of up to this many rows is broadcast; a larger one is joined, and AQE splits groups of many rows.
FEW = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _sha(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as `-` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return _sha(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def _depth(n: int, arity: int) -> int:
    depth = 0
    while n > 1:
        n, depth = -(-n // arity), depth + 1
    return depth


@dataclass
class Manifest:
    """leaves: id, group, what the caller added, leaf, tree, place; trees: tree, group, n (its leaves), depth, subroot;
    nodes: digest, children (end to end), level; root. `root` is None for an empty table."""

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame | None
    root: bytes | None
    arity: int
    depth: int
    top: int


def build_manifest(docs: DataFrame, path: str, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", arity: int = 16, extra: dict[str, Column] | None = None) -> Manifest:
    """Writes the manifest of the rows to folders under `path`.

    A group's leaves are in order of id (nulls first; rows of one id by digest); while a level has more than one node,
    every `arity` consecutive ones have a parent, the last run being shorter where need be. The groups' roots, in order
    of group (null first), have a tree of the same kind. Null and empty values have digests of their own, texts count
    whole, repeated rows are leaves each, columns not among `fields` are not covered. Only ids, groups, digests and
    `extra` are shuffled; rows are ranked by a global sort with a count a task, so a group may hold any share of them.
    """
    spark, extra = docs.sparkSession, extra or {}
    made = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf_digest([F.col(f) for f in fields]).alias("leaf"), *(c.alias(n) for n, c in extra.items()), F.lit(1).cast("long").alias("_one"), F.monotonically_increasing_id().alias("_row"))
    digests = stored(made, "digests")  # the sort samples its input: rows are hashed once
    rows = running(digests, [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("_row")], {"_at": "_one"})
    groups = stored(rows.groupBy("group").agg(F.count("*").alias("n"), F.min("_at").alias("first")).withColumn("_one", F.lit(1).cast("long")), "groups")
    trees = running(groups, [F.col("first")], {"tree": "_one"}).drop("_one")
    few, most = groups.agg(F.count("*"), F.max("n")).first()
    depth, top = _depth(most or 0, arity), _depth(few, arity)
    side = trees.select(F.col("group").alias("_group"), "tree", "first", "n")
    found = rows.join(F.broadcast(side) if few <= FEW else side, F.col("group").eqNullSafe(F.col("_group")))
    found.select("id", "group", "leaf", *extra, "tree", (F.col("_at") - F.col("first")).alias("place"), "n").write.parquet(f"{path}/leaves")
    leaves = spark.read.parquet(f"{path}/leaves")
    discard(digests)
    level = leaves.select("tree", "place", "n", F.col("leaf").alias("digest"))
    subroots = level.filter("n = 1").select("tree", F.col("digest").alias("subroot"))
    for k in range(1, depth + 1):
        level = _parents(level, arity, f"{path}/nodes/level={k}")
        subroots = subroots.unionByName(level.filter("n = 1").select("tree", F.col("digest").alias("subroot")))
    steps = F.lit(0)
    for k in range(depth):
        steps = steps + (F.col("n") > arity**k).cast("int")
    trees.withColumn("depth", steps).join(subroots, "tree").drop("first").write.parquet(f"{path}/trees")
    trees = spark.read.parquet(f"{path}/trees")
    level = trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(few).cast("long").alias("n"), F.col("subroot").alias("digest"))
    for k in range(depth + 1, depth + top + 1):
        level = _parents(level, arity, f"{path}/nodes/level={k}")
    root = level.select("digest").first()
    nodes = spark.read.parquet(f"{path}/nodes") if depth + top else None
    return Manifest(leaves, trees, nodes, root and bytes(root[0]), arity, depth, top)


def _parents(level: DataFrame, arity: int, path: str) -> DataFrame:
    """The level above: nodes whose tree has more than one are put in runs, and each run's record is written."""
    runs = level.filter("n > 1").groupBy("tree", F.floor(F.col("place") / arity).alias("place"), F.ceil(F.col("n") / arity).alias("n"))
    children = F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda c: F.hex(c["digest"]))
    made = runs.agg(F.unhex(F.concat_ws("", children)).alias("children")).withColumn("digest", _sha(_hex(F.col("children"))))
    made.write.parquet(path)
    return level.sparkSession.read.parquet(path)


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """Adds to the requests (rows with tree and place, such as those of manifest.leaves) what the descent finds: `found`,
    the leaf; `subroot`; and `proof`, from the leaf's level up to the root, the siblings left and right of the path.

    Requests beyond the tree's leaves get no row; repeated requests are answered each.
    """
    spark, arity = requests.sparkSession, manifest.arity
    run = F.floor(F.col("place") / arity)
    if manifest.root is None:
        return requests.withColumns({"found": F.lit(None).cast("binary"), "subroot": F.lit(None).cast("binary"), "proof": F.array().cast("array<struct<left:binary,right:binary>>")}).filter("false")
    wanted = {1: stored(requests.select("tree", run.alias("at")).distinct(), "wanted")}
    for k in range(2, manifest.depth + 1):
        wanted[k] = wanted[k - 1].select("tree", F.floor(F.col("at") / arity).alias("at")).distinct()
    asked = wanted[1].select("tree").distinct()
    top = {manifest.depth: asked.select(F.col("tree").alias("at"))}
    for k in range(manifest.depth + 1, manifest.depth + manifest.top):
        top[k] = top[k - 1].select(F.floor(F.col("at") / arity).alias("at")).distinct()

    at = spark.range(1).select(F.lit(0).cast("long").alias("at"), F.lit(manifest.root).alias("digest"), F.array().cast("array<struct<left:binary,right:binary>>").alias("path"))
    for k in range(manifest.depth + manifest.top, manifest.depth, -1):
        at = _descend(at, _records(manifest, k), arity, []).join(top[k - 1], "at", "left_semi")
    trees = manifest.trees.select("tree", "depth")
    starts = at.select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), F.col("digest").alias("subroot"), "digest", "path").join(trees, "tree").join(asked, "tree", "left_semi")
    starts = stored(starts, "starts")  # a row a group asked for
    open_runs = None
    for k in range(manifest.depth, 0, -1):
        fresh = starts.filter(F.col("depth") == k).drop("depth")
        open_runs = fresh if open_runs is None else open_runs.unionByName(fresh)
        if k > 1:
            open_runs = _descend(open_runs, _records(manifest, k), arity, ["tree", "subroot"]).join(wanted[k - 1], ["tree", "at"], "left_semi")
    lone = starts.filter("depth = 0").select("tree", "at", "subroot", "path", F.col("digest").alias("children"), F.lit(True).alias("alone"))
    if open_runs is None:
        runs = lone
    else:
        last = open_runs.join(_records(manifest, 1), "digest").select("tree", "at", "subroot", "path", "children", F.lit(False).alias("alone"))
        runs = last.unionByName(lone)
    # The last digit of the rank picks the leaf among the run's children; the others are its first siblings.
    digit = F.col("place") % arity
    met = requests.withColumn("at", run).join(runs, ["tree", "at"])
    own = F.when(F.col("alone"), F.array().cast("array<struct<left:binary,right:binary>>")).otherwise(F.array(_around(F.col("children"), digit)))
    met = met.withColumn("found", _child(F.col("children"), digit)).filter(F.octet_length("found") == SIZE)
    return met.withColumn("proof", F.concat(own, F.reverse("path"))).drop("at", "path", "children", "alone")


def _records(manifest: Manifest, level: int) -> DataFrame:
    """One record a digest: equal runs of a level have equal digests."""
    return manifest.nodes.filter(F.col("level") == level).groupBy("digest").agg(F.first("children").alias("children"))


def _child(children: Column, digit: Column) -> Column:
    return F.substring(children, (digit * SIZE + 1).cast("int"), F.lit(SIZE))


def _around(children: Column, digit: Column) -> Column:
    left = F.substring(children, F.lit(1), (digit * SIZE).cast("int"))
    right = F.substring(children, ((digit + 1) * SIZE + 1).cast("int"), F.octet_length(children))
    return F.struct(left.alias("left"), right.alias("right"))


def _descend(rows: DataFrame, records: DataFrame, arity: int, keep: Sequence[str]) -> DataFrame:
    """One level down: each row becomes a row a child, its path longer by the siblings of that child."""
    met = rows.join(records, "digest").withColumn("digit", F.explode(F.sequence(F.lit(0), (F.octet_length("children") / SIZE).cast("int") - 1)))
    path = F.concat("path", F.array(_around(F.col("children"), F.col("digit"))))
    return met.select(*keep, (F.col("at") * arity + F.col("digit")).alias("at"), _child(F.col("children"), F.col("digit")).alias("digest"), path.alias("path"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, step: _sha(_hex(F.concat(step["left"], digest, step["right"]))))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: _hex(F.concat(s["left"], s["right"])))), 256)


def verify_altered(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Builds the manifest of the documents, alters those whose crc32(doc_id) is a multiple of 5 by lower-casing the A-Z
    of their text, and checks every document, altered or not, against the root by the path that descent gives.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified (false where a text changed). A null id
    counts as the empty text in the checksum; a null text stays null; else as in build_manifest. An empty table: no rows.
    """
    lower = F.translate("text", UPPER, LOWER)
    chosen = crc_of_id("doc_id") % 5 == 0
    altered = F.when(chosen, leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lower]))
    manifest = build_manifest(docs, path or new_path(docs.sparkSession, "manifest"), extra={"altered": altered})
    rows = prove(manifest, manifest.leaves.select("id", "tree", "place", "leaf", "altered"))
    folded = rows.withColumn("folded", fold(F.coalesce("altered", "leaf"), F.col("proof")))
    root = F.lit(manifest.root).cast("binary")
    return folded.select(
        F.col("id").alias("doc_id"), _hex(F.col("found")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(root).alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"),
        _hex(F.col("folded")).alias("folded_root"), (F.col("folded") == root).alias("verified"),
    )
