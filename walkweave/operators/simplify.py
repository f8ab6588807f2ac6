"""Simplifying a graph: small variants, tips and unary paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkweave.functions.columns import node_complement
from walkweave.operators import variants as V
from walkweave.plans.build import both_readings
from walkweave.plans.store import materialise
from walkweave.schema import BiGraph


def delete_small_variants(graph: BiGraph, pos_range: tuple[int, int] | None = None, minimum: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes and oriented edges (graph_id, u, v) without variants of less than `minimum` letters in both alleles. In a range: nodes from low to before high, those at high if they lie on the reference; only variants
    wholly within the range are judged."""
    nodes, small = graph.nodes, V.variants(graph, False).where(F.col("ref_len") + F.col("alt_len") < minimum)
    if pos_range:
        low, high = pos_range
        nodes = nodes.where(((F.col("position") >= low) & (F.col("position") < high)) | ((F.col("position") == high) & F.col("on_ref")))
        small = small.where((F.least("u_position", "v_position") >= low) & (F.greatest("u_position", "v_position") <= high))
    edges = both_readings(graph.edges.join(small.select("graph_id", "idx"), ["graph_id", "idx"], "left_anti").select("graph_id", "idx", "u", "v"))
    inside = lambda end: nodes.select("graph_id", F.col("node").alias(end))
    edges = edges.join(inside("u"), ["graph_id", "u"], "left_semi").join(inside("v"), ["graph_id", "v"], "left_semi")
    return nodes, edges.select("graph_id", "u", "v")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node, ins, outs of every node."""
    outs = edges.groupBy("graph_id", F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("outs"))
    ins = edges.groupBy("graph_id", F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("ins"))
    return nodes.select("graph_id", "node").join(outs, ["graph_id", "node"], "left").join(ins, ["graph_id", "node"], "left").fillna(0, ["ins", "outs"])


def default_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node: nodes on the reference without ways in or out. A graph has four, or it is an error."""
    ends = degrees(nodes, edges).where("ins = 0 or outs = 0").join(nodes.where("on_ref").select("graph_id", "node"), ["graph_id", "node"], "left_semi")
    four = ends.groupBy("graph_id").agg(F.collect_list("node").alias("n"))
    ok = F.when(F.size("n") == 4, F.col("n")).otherwise(F.raise_error(F.lit("a graph has four end points")).cast("array<string>"))
    return four.select("graph_id", F.explode(ok).alias("node"))


def delete_tips(nodes: DataFrame, edges: DataFrame, endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes dead ends: a node with one way in and none out that is no end point, then its predecessor if that is left so, and so on; twins too. Ways out are counted down, ways in never,
    and end points stay and end a climb, so a tip that hangs on the last node of a reference doesn't take the reference along. A round takes all tips at once and writes what is left."""
    d = materialise(degrees(nodes, edges), "degrees")
    climb = d.where("ins = 1 and outs = 0").join(endpoints, ["graph_id", "node"], "left_anti").select("graph_id", "node")
    gone = materialise(climb, "tips")
    front = gone
    while not front.isEmpty():
        above = front.join(edges.select("graph_id", F.col("v").alias("node"), "u"), ["graph_id", "node"]).groupBy("graph_id", F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("lost"))
        d = materialise(d.join(above, ["graph_id", "node"], "left").select("graph_id", "node", "ins", (F.col("outs") - F.coalesce("lost", F.lit(0))).alias("outs"), F.col("lost").isNotNull().alias("hit")), "degrees")
        front = materialise(d.where("hit and ins = 1 and outs = 0").select("graph_id", "node").join(endpoints, ["graph_id", "node"], "left_anti").join(gone, ["graph_id", "node"], "left_anti"), "tips")
        d, gone = d.drop("hit"), materialise(gone.union(front), "tips")
    both = gone.union(gone.select("graph_id", node_complement("node").alias("node"))).distinct()
    left = nodes.join(both, ["graph_id", "node"], "left_anti")
    drop = lambda e, end: e.join(both.select("graph_id", F.col("node").alias(end)), ["graph_id", end], "left_anti")
    return left, drop(drop(edges, "u"), "v").select("graph_id", "u", "v")


def contract_paths(nodes: DataFrame, edges: DataFrame, endpoints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges unary paths into their first node: a node with one way in and one out goes into the node before it if that has one way out itself; the twin is merged the other way round. Paths hang on end points
    and on forward nodes with several ways; the first node after several ways out heads its own path. End points stay.

    A path's head is found by pointer jumping, so rounds grow with the logarithm of its length. Gives nodes (with their sequences put together), edges, and node -> into."""
    d = degrees(nodes, edges)
    starts = endpoints.union(d.where("outs > 1 or ins > 1").join(nodes.where("direction = 1").select("graph_id", "node"), ["graph_id", "node"], "left_semi").select("graph_id", "node")).distinct()
    unary = d.where("ins = 1 and outs = 1").join(endpoints, ["graph_id", "node"], "left_anti").join(nodes.where("direction = 1").select("graph_id", "node"), ["graph_id", "node"], "left_semi").select("graph_id", "node")
    one_out = d.where("outs = 1").select("graph_id", F.col("node").alias("u"))
    # node -> the node before it, where they merge
    up = edges.join(unary.select("graph_id", F.col("node").alias("v")), ["graph_id", "v"], "left_semi").join(one_out, ["graph_id", "u"], "left_semi")
    up = materialise(up.select("graph_id", F.col("v").alias("node"), F.col("u").alias("into"), F.lit(1).alias("far")), "merges")
    while True:
        on = up.select("graph_id", F.col("node").alias("into"), F.col("into").alias("next"), F.col("far").alias("more"))
        new = up.join(on, ["graph_id", "into"], "left")
        moved = materialise(new.select("graph_id", "node", F.coalesce("next", "into").alias("into"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved")), "merges")
        up = moved.drop("moved")
        if moved.where("moved").isEmpty() or moved.where("node = into").limit(1).count():
            break
    reached = up.where("node <> into")
    # Paths that no start leads to stay as they are.
    heads = reached.select("graph_id", F.col("into").alias("node")).distinct()
    led = heads.join(starts, ["graph_id", "node"], "left_semi").union(edges.join(starts.select("graph_id", F.col("node").alias("u")), ["graph_id", "u"], "left_semi").select("graph_id", F.col("v").alias("node")).join(heads, ["graph_id", "node"], "left_semi")).distinct()
    merged = materialise(reached.join(led.select("graph_id", F.col("node").alias("into")), ["graph_id", "into"], "left_semi").select("graph_id", "node", "into", "far"), "merges")
    seq = nodes.select("graph_id", "node", "seq")
    added = merged.join(seq, ["graph_id", "node"]).groupBy("graph_id", F.col("into").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("far", "seq"))), lambda x: x["seq"]), "").alias("added"))
    twins = added.select("graph_id", node_complement("node").alias("node"), F.translate(F.reverse("added"), "ACGT", "TGCA").alias("before"))
    gone = merged.select("graph_id", "node").union(merged.select("graph_id", node_complement("node").alias("node")))
    out = nodes.join(gone, ["graph_id", "node"], "left_anti").join(added, ["graph_id", "node"], "left").join(twins, ["graph_id", "node"], "left")
    out = out.withColumn("seq", F.concat(F.coalesce("before", F.lit("")), "seq", F.coalesce("added", F.lit("")))).select(nodes.columns)
    # An edge out of a merged node goes out of its head; of the twins, into it.
    to = merged.select("graph_id", "node", "into").union(merged.select("graph_id", node_complement("node").alias("node"), node_complement("into").alias("into")))
    at = lambda end: to.select("graph_id", F.col("node").alias(end), F.col("into").alias(f"{end}_into"))
    e = edges.join(at("u"), ["graph_id", "u"], "left").join(at("v"), ["graph_id", "v"], "left")
    inner = F.coalesce("u_into", "u") == F.coalesce("v_into", "v")
    e = e.where(~(inner & (F.col("u_into").isNotNull() | F.col("v_into").isNotNull()))).select("graph_id", F.coalesce("u_into", "u").alias("u"), F.coalesce("v_into", "v").alias("v")).distinct()
    return out, e, merged.select("graph_id", "node", "into")


def simplify(graph: BiGraph, pos_range: tuple[int, int] | None = None, endpoints: DataFrame | None = None, minimum: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The three steps in turn."""
    nodes, edges = delete_small_variants(graph, pos_range, minimum)
    nodes, edges = materialise(nodes, "nodes"), materialise(edges, "edges")
    ends = materialise(default_endpoints(nodes, edges) if endpoints is None else endpoints, "endpoints")
    nodes, edges = delete_tips(nodes, edges, ends)
    nodes, edges, _ = contract_paths(materialise(nodes, "nodes"), materialise(edges, "edges"), ends)
    return nodes, edges
