"""The library's operators in the order of its three goals: a physical map, scaffolds of a draft, and the map's quality."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from strandweave.operators import communities, incidence, mapping, overlap, scaffold, trees

from .shared import stored


class PhysicalMap(NamedTuple):
    """bxmx(bx, mx) after the filters, the molecule graph, and its backbones (tid, pos, elem)."""

    bxmx: DataFrame
    vertices: DataFrame
    edges: DataFrame
    paths: DataFrame


def physical_map(bxmx: DataFrame, least: int = 100, below: int | None = 5000, depth: int = 0, shared: int = 10, percent: float = 90, strategy: str = "distributed+sqcosbin", branch: int = 10, bridge: int = 10, junction: int = 200) -> PhysicalMap:
    """From barcode x marker rows to backbones. The filtered rows, the thinned graph and the molecule graph are stored."""
    rows = stored(incidence.filter_incidence(stored(incidence.filter_barcodes(bxmx, least, below), "barcodes"), 1, None, depth), "filtered")
    thin = stored(overlap.filter_percentile(stored(overlap.overlap_edges(rows, shared), "edges"), percent), "graph")
    edges = stored(communities.molecule_graph(thin, strategy)[1], "molecules")
    vertices = overlap.ends(edges).distinct()
    core = stored(trees.backbone_graph(edges, least_branch=branch, bridge_length=bridge, least_junction=junction), "backbone_graph")
    return PhysicalMap(rows, vertices, edges, stored(trees.backbones(core, 0), "backbones"))


def mapped(found: PhysicalMap, queries: DataFrame, least: int = 10, reach: int = 10) -> DataFrame:
    """BED rows of queries(qid, qpos, mx) on the map's backbones, by the markers of each molecule alone."""
    rows = found.bxmx.selectExpr("cast(bx AS string) AS bx", "mx")
    own = overlap.split_markers(found.edges, rows, found.vertices).selectExpr("id AS bx", "explode(mxs) AS mx")
    return mapping.map_to_bed(queries, mapping.positional_index(found.paths, own, split=True), least, reach)


def scaffolds(found: PhysicalMap, queries: DataFrame, sequences: DataFrame, least: int = 10, reach: int = 10, gap: int = 100, shortest: int = 0) -> DataFrame:
    """Draft sequences(name, seq), whose markers are queries(qid, qpos, mx), ordered and joined along the map; those left over follow."""
    paths = stored(scaffold.bed_to_path(stored(mapping.best_per_position(mapped(found, queries, least, reach)), "best")), "paths")
    return scaffold.number_scaffolds(scaffold.assemble(paths, sequences, gap, shortest), scaffold.unused_sequences(paths, sequences, shortest))


def map_quality(found: PhysicalMap, queries: DataFrame, expected: float, least: int = 10) -> DataFrame:
    """Size metrics of the chained mappings of a reference's sequences onto the backbones."""
    index = mapping.positional_index(found.paths, found.bxmx)
    return scaffold.paf_metrics(mapping.map_to_paf(queries, index, found.paths, least), expected)
