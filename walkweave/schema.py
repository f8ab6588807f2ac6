"""Names, types and tables of a bidirected sequence graph.

A segment has two oriented nodes, `<id>_+` and `<id>_-`, of which the second reads the reverse complement. A link joins two oriented nodes and is the same as its complement, which joins
the flipped nodes the other way round; so edges have a number, `idx`, for both readings.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, ByteType, IntegerType, LongType, StringType, StructType

#: Fixed names of the two synthetic segments at which walks begin and end.
PLUS_TERMINUS, MINUS_TERMINUS = "+_terminus", "-_terminus"
TERMINI = (PLUS_TERMINUS, MINUS_TERMINUS)
SOURCE, SINK = f"{PLUS_TERMINUS}_+", f"{MINUS_TERMINUS}_+"
TERMINAL_NODES = tuple(f"{t}_{o}" for t in TERMINI for o in "+-")

#: Fixed column names of the files that others read.
NODE_ATTRIBUTES = ("direction", "sequence", "position", "right_position", "distance_from_reference", "on_reference_path")
BIEDGE_ATTRIBUTES = ("index", "weight", "is_in_tree", "branch_point", "is_back_edge")
VCF_ATTRIBUTES = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def struct(**fields) -> StructType:
    out = StructType()
    for name, kind in fields.items():
        out.add(name, kind)
    return out


S, L, I, B = StringType(), LongType(), IntegerType(), BooleanType()  # noqa: E741

SEGMENTS = struct(graph_id=S, seg_id=S, seq=S)
LINKS = struct(graph_id=S, idx=L, u=S, v=S)
WALKS = struct(graph_id=S, walk_idx=L, sample=S, hap=S, is_ref=B, steps=ArrayType(S))
#: chain, chain_pos: the node's place in a decomposition of the tree into downward paths, of which any path meets few; plen: letters from the root to the node's end.
NODES = struct(graph_id=S, node=S, seg_id=S, orient=S, seq=S, direction=ByteType(), position=L, right_position=L, distance=L, on_ref=B, parent=S, depth=I, tin=L, tout=L, chain=L, chain_pos=L, plen=L)
EDGES = struct(graph_id=S, idx=L, u=S, v=S, weight=L, in_tree=B, is_back=B, branch_point=S)


@dataclass(frozen=True)
class BiGraph:
    """The tables of one or more graphs. paths: for each variant's alleles, the chain segments of its tree path (graph_id, idx, allele, chain, low, high, rank).

    plain: names tell what else would be looked up. An edge's number is edge_number of its reading that canonical gives, which is the one it has; the graph has every edge that its walks take, and each node's edge from its parent; every end and branch point is a node;
    forward nodes are those named +; no edge has a terminus."""

    nodes: DataFrame
    edges: DataFrame
    walks: DataFrame
    paths: DataFrame | None = None
    plain: bool = False

    def but(self, **tables) -> BiGraph:
        return replace(self, **tables)
