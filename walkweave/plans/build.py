"""From segments, links and walks to labelled graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkweave.functions.columns import edge_complement
from walkweave.operators.ranks import global_rank
from walkweave.plans import kernel
from walkweave.plans.store import materialise
from walkweave.schema import BiGraph
from walkweave.sources.gfa import read_gfa


def oriented_nodes(segments: DataFrame) -> DataFrame:
    """Two nodes per segment."""
    rows = segments.select("graph_id", "seg_id", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("orient"), "seq")
    seq = F.when(F.col("orient") == "+", F.col("seq")).otherwise(F.translate(F.reverse("seq"), "ACGT", "TGCA"))
    return rows.select("graph_id", F.concat_ws("_", "seg_id", "orient").alias("node"), "seg_id", "orient", seq.alias("seq"))


def both_readings(edges: DataFrame) -> DataFrame:
    """Each edge and its complement, with is_representative; a link that is its own complement is there once."""
    columns = [c for c in edges.columns if c not in ("u", "v")]
    own = edges.select(*columns, "u", "v", F.lit(True).alias("is_representative"))
    other = edges.select(*columns, edge_complement("u", "v").alias("e")).select(*columns, "e.u", "e.v", F.lit(False).alias("is_representative"))
    return own.union(other.join(edges.select("graph_id", "u", "v"), ["graph_id", "u", "v"], "left_anti").select(own.columns))


def duplicate_links(links: DataFrame) -> DataFrame:
    """Links that are there more than once, in either reading: graph_id, u, v of the smaller reading, n."""
    other = edge_complement("u", "v")
    smaller = F.when(F.struct("u", "v") <= other, F.struct("u", "v")).otherwise(other)
    return links.groupBy("graph_id", smaller.alias("e")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("graph_id", "e.u", "e.v", "n")


def walk_pairs(walks: DataFrame, *keys: str) -> DataFrame:
    """keys, at, u, v: neighbours on each walk. No shuffle: a walk's steps are an array."""
    pairs = F.zip_with(F.expr("slice(steps, 1, greatest(size(steps) - 1, 0))"), F.expr("slice(steps, 2, greatest(size(steps) - 1, 0))"), lambda a, b: F.struct(a.alias("u"), b.alias("v")))
    return walks.select(*keys, F.posexplode(pairs).alias("at", "e")).select(*keys, "at", "e.u", "e.v")


def edge_weights(edges: DataFrame, walks: DataFrame, strict: bool = True) -> DataFrame:
    """The edges with weight, the times that walks take them in either reading. Counting comes before the join, so a hot edge is one row of each task.
    strict: a step without an edge is an error."""
    counts = walk_pairs(walks, "graph_id").groupBy("graph_id", "u", "v").agg(F.count(F.lit(1)).alias("n"))
    readings = both_readings(edges.select("graph_id", "idx", "u", "v")).select("graph_id", "u", "v", "idx")
    found = counts.join(readings, ["graph_id", "u", "v"], "left")
    if strict:
        error = F.raise_error(F.concat(F.lit("a walk takes an edge that isn't there: "), F.col("u"), F.lit(" "), F.col("v"))).cast("long")
        found = found.withColumn("idx", F.when(F.col("idx").isNull(), error).otherwise(F.col("idx")))
    total = found.where("idx is not null").groupBy("graph_id", "idx").agg(F.sum("n").alias("weight"))
    return edges.drop("weight").join(total, ["graph_id", "idx"], "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))


def build(segments: DataFrame, links: DataFrame, walks: DataFrame, nodeinfo: DataFrame | None = None, edgeinfo: DataFrame | None = None) -> BiGraph:
    """Labels the graphs. Errors: a link that is there twice, a walk's step without a link, no or several reference walks, a reference walk that visits a node twice.

    nodeinfo, edgeinfo: tables as `sources.info` reads them; what they say goes over what is computed."""
    weighted = edge_weights(links, walks)
    twice = duplicate_links(links)
    references = walks.where("is_ref").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.first("steps").alias("steps"))
    single = F.when(F.col("n") == 1, F.col("steps")).otherwise(F.raise_error(F.lit("a graph has one reference walk")).cast("array<string>"))
    null = lambda kind: F.lit(None).cast(kind)
    fact = lambda rows, kind, idx, a, b, n: rows.select("graph_id", F.lit(kind).alias("kind"), idx.cast("long").alias("idx"), a.alias("a"), b.alias("b"), n.cast("long").alias("n"))
    facts = fact(segments, "S", null("long"), F.col("seg_id"), null("string"), F.length("seq"))
    facts = facts.union(fact(weighted, "L", F.col("idx"), F.col("u"), F.col("v"), F.col("weight")))
    error = F.raise_error(F.concat_ws(" ", F.lit("a link is there twice:"), F.col("u"), F.col("v")))
    facts = facts.union(fact(twice, "X", null("long"), error.cast("string"), null("string"), null("long")))
    facts = facts.union(fact(references.select("graph_id", F.posexplode(single).alias("at", "node")), "R", F.col("at"), F.col("node"), null("string"), null("long")))
    for kind, end in (("B", "element_at(steps, 1)"), ("E", "element_at(steps, -1)")):
        ends = walks.where("size(steps) > 0").select("graph_id", F.expr(end).alias("node")).distinct()
        facts = facts.union(fact(ends, kind, null("long"), F.col("node"), null("string"), null("long")))
    labels = materialise(facts.groupBy("graph_id").applyInPandas(kernel.run, kernel.LABELS), "labels")
    termini = segments.select("graph_id").distinct().select("graph_id", F.explode(F.array(F.lit("+_terminus"), F.lit("-_terminus"))).alias("seg_id"), F.lit("").alias("seq"))
    nodes = labels.where("kind = 'N'").join(oriented_nodes(segments.union(termini)), ["graph_id", "node"])
    nodes = nodes.select("graph_id", "node", "seg_id", "orient", "seq", "direction", "position", "right_position", "distance", "on_ref", "parent", "depth", "tin", "tout", "chain", "chain_pos", "plen")
    edges = labels.where("kind = 'E'").select("graph_id", "idx", "u", "v", "weight", "in_tree", "is_back", "branch_point")
    paths = labels.where("kind = 'P'").select("graph_id", "idx", "allele", "chain", "low", "high", "rank")
    graph = BiGraph(nodes, edges, walks, paths)
    if nodeinfo is not None:
        graph = with_nodeinfo(graph, nodeinfo)
    return with_edgeinfo(graph, edgeinfo) if edgeinfo is not None else graph


def from_gfa(spark: SparkSession, path: str | list[str], ref_name: str = "GRCh38", graph_id: str | None = None, nodeinfo: DataFrame | None = None, edgeinfo: DataFrame | None = None) -> BiGraph:
    """A file is a graph, named by its path unless graph_id is given."""
    return build(**read_gfa(spark, path, ref_name, graph_id), nodeinfo=nodeinfo, edgeinfo=edgeinfo)


def with_nodeinfo(graph: BiGraph, info: DataFrame) -> BiGraph:
    """info: node and any of direction, position, right_position, distance, on_ref."""
    named = [c for c in info.columns if c in ("direction", "position", "right_position", "distance", "on_ref")]
    new = info.select("node", *[F.col(c).alias(f"new_{c}") for c in named])
    nodes = graph.nodes.join(new, "node", "left").withColumns({c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in named})
    return graph.but(nodes=nodes.select(graph.nodes.columns))


def with_edgeinfo(graph: BiGraph, info: DataFrame) -> BiGraph:
    """info: idx, weight, in_tree, branch_point, is_back. The tree's parents follow in_tree; a root other than the plus terminus hangs on it."""
    new = info.select("idx", *[F.col(c).alias(f"new_{c}") for c in ("weight", "in_tree", "branch_point", "is_back")])
    edges = graph.edges.join(new, "idx", "left")
    edges = edges.withColumns({c: F.when(F.col("new_in_tree").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("weight", "branch_point", "is_back")}).withColumn("in_tree", F.coalesce("new_in_tree", "in_tree")).select(graph.edges.columns)
    nodes = graph.nodes
    forward = nodes.where("direction = 1").select("graph_id", "node")
    tree = both_readings(edges.where("in_tree")).join(forward.withColumnRenamed("node", "u"), ["graph_id", "u"], "left_semi").join(forward.withColumnRenamed("node", "v"), ["graph_id", "v"], "left_semi")
    parents = tree.groupBy("graph_id", F.col("v").alias("node")).agg(F.min("u").alias("above"))
    root = F.when((F.col("direction") == 1) & (F.col("node") != "+_terminus_+"), F.lit("+_terminus_+"))
    nodes = nodes.join(parents, ["graph_id", "node"], "left").withColumn("parent", F.coalesce("above", root)).select(graph.nodes.columns)
    return graph.but(nodes=nodes, edges=edges)


def terminal_sources_sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node, kind: forward nodes into which (source) or out of which (sink) no forward edge leads. nodes: graph_id, node, direction."""
    forward = nodes.where("direction = 1").select("graph_id", "node")
    at = lambda end: forward.select("graph_id", F.col("node").alias(end))
    inner = both_readings(edges).select("graph_id", "u", "v").join(at("u"), ["graph_id", "u"], "left_semi").join(at("v"), ["graph_id", "v"], "left_semi")
    sources = forward.join(inner.select("graph_id", F.col("v").alias("node")), ["graph_id", "node"], "left_anti").select("graph_id", "node", F.lit("source").alias("kind"))
    sinks = forward.join(inner.select("graph_id", F.col("u").alias("node")), ["graph_id", "node"], "left_anti").select("graph_id", "node", F.lit("sink").alias("kind"))
    return sources.union(sinks)


def graph_counts(graph: BiGraph) -> DataFrame:
    """graph_id, binodes, biedges: segments and links of each graph, each counted once for both readings, termini and their links included."""
    nodes = graph.nodes.groupBy("graph_id").agg(F.count_if(F.col("orient") == "+").alias("binodes"))
    edges = graph.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("biedges"))
    return nodes.join(edges, "graph_id", "left").withColumn("biedges", F.coalesce("biedges", F.lit(0).cast("long")))


def nodes_by_position(nodes: DataFrame) -> DataFrame:
    """The forward nodes of each graph with their place along the reference, from 0: by position, those on the reference first, then by distance and name. Nodes without a position come last."""
    forward = nodes.where("direction = 1")
    return global_rank(forward, [F.asc_nulls_last("position"), F.desc("on_ref"), "distance", "node"], "place", "graph_id")


def degrees(edges: DataFrame) -> DataFrame:
    """graph_id, node, out_degree, in_degree over both readings; nodes without edges aren't there."""
    readings = both_readings(edges.select("graph_id", "idx", "u", "v"))
    ends = readings.select("graph_id", F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("graph_id", "e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


