"""Edge weights kept up to date over a stream of walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkweave.plans.build import both_readings, walk_pairs


def streaming_edge_weights(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """walks: a stream with graph_id and steps. A streaming table graph_id, idx, weight for output mode update or complete; its state is a row per edge. Steps without an edge are left out."""
    readings = both_readings(edges.select("graph_id", "idx", "u", "v")).select("graph_id", "u", "v", "idx")
    return walk_pairs(walks, "graph_id").join(readings, ["graph_id", "u", "v"]).groupBy("graph_id", "idx").agg(F.count(F.lit(1)).alias("weight"))


def streaming_transitions(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events: a stream with ts, event_type. Counts by window and type; rows later than `late` are left out, so state ends."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
