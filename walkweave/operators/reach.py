"""Minima over what can be reached, in rounds that only follow what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkweave.plans.build import both_readings
from walkweave.plans.store import delete, materialise, scope
from walkweave.schema import BiGraph


def reached_minima(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: graph_id, node, value (null: to be found). edges: graph_id, u, v, each once. Gives graph_id, node, value: known values as they are, others the least known value that a way ahead leads to without passing another known node; null where none does.

    A round sends the values that the last one lowered back along the edges into them and keeps the least at each node, so a node is looked at again only if one ahead of it changed. Rounds end when nothing changes: as many as the
    longest of the ways that give a minimum, whether or not edges go in circles. A node with many edges sends and receives by partial minima."""
    with scope(nodes.sparkSession):
        return materialise(_reached(nodes, edges), "reached", keep=True)


def _reached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    spark = nodes.sparkSession
    known = nodes.where("value is not null").select("graph_id", "node", "value")
    sought = materialise(nodes.where("value is null").select("graph_id", "node"), "reach-sought")
    # Only edges out of nodes that are sought ever carry a value.
    into = materialise(edges.join(sought.withColumnRenamed("node", "u"), ["graph_id", "u"], "left_semi").select("graph_id", "u", F.col("v").alias("node")), "reach-edges")
    found = materialise(sought.withColumn("value", F.lit(None).cast(nodes.schema["value"].dataType)), "reach-values")
    moved = known
    while True:
        sent = moved.join(into, ["graph_id", "node"]).groupBy("graph_id", F.col("u").alias("node")).agg(F.min("value").alias("new"))
        better = sent.join(found, ["graph_id", "node"]).where("value is null or new < value").select("graph_id", "node", F.col("new").alias("value"))
        moved = materialise(better, "reach-moved")
        if moved.isEmpty():
            return known.unionByName(found)
        old = found.inputFiles()
        changed = found.join(moved.withColumnRenamed("value", "new"), ["graph_id", "node"], "left")
        found = materialise(changed.select("graph_id", "node", F.coalesce("new", "value").alias("value")), "reach-values")
        delete(spark, sorted({f.rsplit("/", 1)[0] for f in old}))


def right_positions(graph: BiGraph) -> DataFrame:
    """graph_id, node, right_position of forward nodes: on the reference the node's position, elsewhere the least right position among the nodes after it, over forward edges that don't go back."""
    forward = graph.nodes.where("direction = 1")
    at = lambda end: forward.select("graph_id", F.col("node").alias(end))
    ahead = both_readings(graph.edges.where("not coalesce(is_back, false)").select("graph_id", "idx", "u", "v")).select("graph_id", "u", "v")
    ahead = ahead.join(at("u"), ["graph_id", "u"], "left_semi").join(at("v"), ["graph_id", "v"], "left_semi")
    found = reached_minima(forward.select("graph_id", "node", F.when(F.col("on_ref"), F.col("position")).alias("value")), ahead)
    return found.withColumnRenamed("value", "right_position")
