"""Node and edge tables as CSV, BED, VCF and snarl tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkweave.functions.columns import bubble_ends, bubble_nodes, info_map, node_convert
from walkweave.operators.regions import bubble_variants
from walkweave.plans.build import both_readings
from walkweave.schema import MINUS_TERMINUS, PLUS_TERMINUS, BiGraph


def read_nodeinfo(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; `node` is the key. Known columns get their names and types here, others stay text."""
    rows = spark.read.csv(path, header=True)
    names = {"distance_from_reference": "distance", "on_reference_path": "on_ref"}
    whole = lambda c: F.col(c).cast("double").cast("long")
    kinds = {"direction": lambda c: whole(c).cast("byte"), "on_reference_path": lambda c: whole(c) == 1} | dict.fromkeys(("position", "right_position", "distance_from_reference"), whole)
    return rows.select([kinds[c](c).alias(names.get(c, c)) if c in kinds else F.col(c) for c in rows.columns])


def read_edgeinfo(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose columns are index, weight, is_in_tree, branch_point and is_back_edge by their places; the header's names don't matter. A branch point of 0 is none."""
    rows = spark.read.csv(path, header=True)
    if len(rows.columns) < 5:
        raise ValueError("an edge table has five columns: index, weight, is_in_tree, branch_point, is_back_edge")
    c = [F.col(f"`{n}`") for n in rows.columns]
    whole = lambda x: x.cast("double").cast("long")
    return rows.select(whole(c[0]).alias("idx"), whole(c[1]).alias("weight"), (whole(c[2]) == 1).alias("in_tree"), F.when(c[3] != "0", c[3]).alias("branch_point"), (whole(c[4]) == 1).alias("is_back"))


def read_bed(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """start, end, name: a line's range moved up by one, half-open; name is null without a fourth column."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(F.element_at(f, 1) == chrom)
    at = lambda i: F.get(f, F.lit(i))
    return lines.select((at(1).cast("long") + 1).alias("start"), (at(2).cast("long") + 1).alias("end"), at(3).alias("name"))


def read_vcf_lines(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The header's column names (the first without its #), and a row per record: at (the line's place), f (fields). A record with another number of fields is an error."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value")
    head = lines.where(F.col("value").startswith("#") & ~F.col("value").startswith("##")).orderBy("at").first()
    if head is None:
        raise ValueError("a VCF has a header line")
    names = head.value.lstrip("#").split("\t")
    records = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select("at", F.split("value", "\t").alias("f"))
    ok = F.when(F.size("f") == len(names), F.col("f")).otherwise(F.raise_error(F.lit(f"a record has {len(names)} fields")).cast("array<string>"))
    return names, records.select("at", ok.alias("f"))


def read_vcf(spark: SparkSession, path: str, meta: bool = False):
    """A column of text per field; with meta also the lines that begin with ##."""
    names, records = read_vcf_lines(spark, path)
    table = records.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if meta:
        return table, spark.read.text(path).where(F.col("value").startswith("##"))
    return table


def read_bubble_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """bubbles (bubble, a, b, pos, ref, alt, info) and their nodes (node, bubble), which INFO's AT names. Of several records of a bubble the last counts."""
    names, records = read_vcf_lines(spark, path)
    at = lambda n: F.get("f", F.lit(names.index(n)))
    last = F.row_number().over(Window.partitionBy("bubble").orderBy(F.desc("at")))
    rows = records.select("at", at("ID").alias("bubble"), at("POS").cast("long").alias("pos"), at("REF").alias("ref"), at("ALT").alias("alt"), info_map(at("INFO")).alias("info"))
    rows = rows.withColumn("last", last).where("last = 1").withColumn("ends", bubble_ends("bubble"))
    bubbles = rows.select("bubble", F.get("ends", F.lit(0)).alias("a"), F.get("ends", F.lit(1)).alias("b"), "pos", "ref", "alt", "info")
    nodes = rows.select("bubble", F.explode(bubble_nodes(F.col("info").getItem("AT"))).alias("node")).select("node", "bubble").distinct()
    return bubbles, nodes


def read_snarls(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """bubbles (bubble, a, b, level, parent, content) and their nodes (node, bubble): both ends and all contents, in both readings. Lines that begin with # are left out."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    rows = rows.select(at(0).alias("bubble"), at(1).cast("int").alias("level"), at(2).alias("parent"), F.filter(F.split(F.coalesce(at(3), F.lit("")), ","), lambda x: x != "").alias("content")).withColumn("ends", bubble_ends("bubble"))
    bubbles = rows.select("bubble", F.get("ends", F.lit(0)).alias("a"), F.get("ends", F.lit(1)).alias("b"), "level", "parent", "content")
    nodes = rows.select("bubble", F.explode(F.concat("ends", "content")).alias("seg")).select(F.explode(F.array(F.concat("seg", F.lit("_+")), F.concat("seg", F.lit("_-")))).alias("node"), "bubble").distinct()
    return bubbles, nodes


def variants_of_bubbles(spark: SparkSession, path: str, graph: BiGraph, partition: DataFrame) -> DataFrame:
    """bubble, id, idx, within: the variants of a called VCF, found again in the graph by their ids (u and v, each with its sign in front), and the bubbles that hold or are crossed by them. Of ids that stand twice one counts; an id that is
    no edge of the graph is an error."""
    names, records = read_vcf_lines(spark, path)
    ids = records.select(F.get("f", F.lit(names.index("ID"))).alias("id")).distinct()
    # An id's signs say how to read each end; a terminus has a name of its own.
    step = F.regexp_extract_all("id", F.lit(r"[<>][^<>]+"), F.lit(0))
    node = lambda i: F.replace(F.replace(node_convert(F.get(step, F.lit(i))), F.lit("startTerminus"), F.lit(PLUS_TERMINUS)), F.lit("endTerminus"), F.lit(MINUS_TERMINUS))
    ends = ids.select("id", node(0).alias("u"), node(1).alias("v"))
    edges = both_readings(graph.edges.select("graph_id", "idx", "u", "v")).select("u", "v", "idx")
    missing = F.raise_error(F.concat(F.lit("no such edge: "), "id")).cast("long")
    found = ends.join(edges, ["u", "v"], "left").withColumn("idx", F.when(F.col("idx").isNull(), missing).otherwise(F.col("idx")))
    return bubble_variants(found.select("idx", "u", "v"), partition).join(found.select("idx", "id").distinct(), "idx").select("bubble", "id", "idx", "within")
