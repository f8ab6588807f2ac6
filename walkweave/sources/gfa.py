"""Reading GFA 1.1: segments, links and walks of one or more files, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkweave.functions.columns import tokenize_walk
from walkweave.schema import LINKS, SEGMENTS, WALKS


def _lines(spark: SparkSession, path: str | list[str], graph_id: str | None) -> DataFrame:
    """graph_id (the file's path unless given), kind, f (fields), at (the line's place in its file)."""
    own = F.lit(graph_id) if graph_id else F.col("_metadata.file_path")
    text = spark.read.text(path).select(own.alias("graph_id"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))
    fields = F.split("value", "\t")
    return text.select("graph_id", "at", F.element_at(fields, 1).alias("kind"), fields.alias("f")).where(F.col("kind").isin("S", "L", "W"))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Dense numbers from 0 in the order of lines. Each task counts its lines, and the counts of tasks, one row each, are summed up: lines aren't brought together."""
    task, counts = F.shiftright("at", 33), Window.partitionBy("graph_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("task", task)
    before = rows.groupBy("graph_id", "task").agg(F.count(F.lit(1)).alias("n")).select("graph_id", "task", F.coalesce(F.sum("n").over(counts), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("graph_id", "task").orderBy("at")) - 1
    return rows.withColumn("within", within).join(before, ["graph_id", "task"]).withColumn(name, F.col("before") + F.col("within")).drop("task", "within", "before", "at")


def read_gfa(spark: SparkSession, path: str | list[str], ref_name: str = "GRCh38", graph_id: str | None = None) -> dict[str, DataFrame]:
    """segments, links and walks. Other records, tags, overlaps and a walk's contig and range are ignored."""
    lines = _lines(spark, path, graph_id)
    f = lambda i: F.get("f", F.lit(i))
    segments = lines.where("kind = 'S'").select("graph_id", f(1).alias("seg_id"), F.coalesce(f(2), F.lit("")).alias("seq"))
    links = _numbered(lines.where("kind = 'L'"), "idx").select("graph_id", "idx", F.concat(f(1), F.lit("_"), f(2)).alias("u"), F.concat(f(3), F.lit("_"), f(4)).alias("v"))
    walks = _numbered(lines.where("kind = 'W'"), "walk_idx").select("graph_id", "walk_idx", f(1).alias("sample"), f(2).alias("hap"), (f(1) == ref_name).alias("is_ref"), tokenize_walk(f(6)).alias("steps"))
    return {"segments": segments.to(SEGMENTS), "links": links.to(LINKS), "walks": walks.to(WALKS)}


def reference_index(walks: DataFrame) -> DataFrame:
    """graph_id, reference_index: walks before the first reference walk, all of them if there is none."""
    return walks.groupBy("graph_id").agg(F.coalesce(F.min(F.when(F.col("is_ref"), F.col("walk_idx"))), F.count(F.lit(1))).alias("reference_index"))


def walks_by_name(walks: DataFrame) -> DataFrame:
    """graph_id, name (sample_hap), walks: the steps of a haplotype's walks, in order."""
    rows = walks.groupBy("graph_id", F.concat_ws("_", "sample", "hap").alias("name")).agg(F.array_sort(F.collect_list(F.struct("walk_idx", "steps"))).alias("w"))
    return rows.select("graph_id", "name", F.col("w.steps").alias("walks"))
