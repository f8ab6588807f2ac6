"""Calls the variants of the parts graph for every sample: how often its walks take a variant and the tree edge that competes with it, and which part of the reference its walks cover.

    python -m jobs.sample_calls TABLES OUT [--config FILE]

TABLES is the folder of part, orders, lineitem and customer. OUT gets three tables by explicit path: `variants` (type, place and allele lengths of each variant that is called), `calls` (partitioned by sample) and `coverage` (a row per sample, or per
haplotype). Each is overwritten as a whole, so a run after a crash or over the same input leaves the same rows. Variants without any call, and samples without walks, have no rows.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from walkweave import adapters
from walkweave.operators import genotypes, variants
from walkweave.plans.store import materialise, scope

log = logging.getLogger("jobs.sample_calls")
#: by: `sample`, or `hap` for a row per haplotype of each sample. least: visits of a variant that make a call.
DEFAULTS = {"by": "sample", "least": 1}
CALLS = "hap string, idx long, alt_count long, ref_count long, sample string"


def run(spark: SparkSession, tables: str, out: str, options: dict | None = None) -> DataFrame:
    """Writes the three tables and returns them read back and joined: sample, hap (null by sample), idx, vtype, pos, ref_len, alt_len, alt_count, ref_count, low, high."""
    o = DEFAULTS | (options or {})
    if o["by"] not in ("sample", "hap"):
        raise ValueError("by is sample or hap")
    hap = F.col("hap") if o["by"] == "hap" else F.lit(None).cast("string")
    with scope(spark):
        graph = adapters.parts_graph(spark, tables)
        # Counting by sample comes first, so a variant and its competing edge are a row per sample when they meet.
        taken = genotypes.edge_visits_of_walks(graph, strict=False).groupBy("sample", hap.alias("hap"), "idx").agg(F.sum("n").alias("n"))
        taken = materialise(taken, "taken")
        same = lambda a, b: (F.col(f"{a}.sample") == F.col(f"{b}.sample")) & F.col(f"{a}.hap").eqNullSafe(F.col(f"{b}.hap"))
        # Of the tree's edges few are taken beside the variants; they are written, so that calls are dealt to them only where they are many.
        tree = variants.tree_edges(graph).select("node", F.col("ref_idx").alias("idx"))
        refs = materialise(taken.join(tree, "idx").select("sample", "hap", "node", "n"), "refs")
        ends = variants.variant_ends(graph).select("idx", "node")
        alt = taken.where(F.col("n") >= o["least"]).join(ends, "idx")
        calls = alt.alias("a").join(refs.alias("r"), same("a", "r") & (F.col("a.node") == F.col("r.node")), "left")
        # Dealt by idx or by node and not by sample: a sample may have most calls.
        calls = calls.select("a.hap", "a.idx", F.col("a.n").alias("alt_count"), F.coalesce("r.n", F.lit(0)).alias("ref_count"), "a.sample")
        found = variants.variants(graph)
        if not graph.plain:  # else no variant is terminal, so all with ends are found
            calls = calls.join(found.select("idx"), "idx", "left_semi")
        calls.write.mode("overwrite").option("compression", "zstd").partitionBy("sample").parquet(f"{out}/calls")
        written = spark.read.schema(CALLS).parquet(f"{out}/calls")
        shown = found.select("idx", "vtype", variants.vcf_position().cast("long").alias("pos"), F.col("ref_len").cast("long").alias("ref_len"), F.col("alt_len").cast("long").alias("alt_len"))
        shown.join(written.select("idx"), "idx", "left_semi").write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/variants")
        by = ("graph_id", "sample", "hap") if o["by"] == "hap" else ("graph_id", "sample")
        coverage = genotypes.linear_coverage(graph, False, by)
        coverage.select("sample", hap.alias("hap"), "low", "high").write.mode("overwrite").parquet(f"{out}/coverage")
        log.info("read %d nodes, %d edges and %d walks from %s", graph.nodes.count(), graph.edges.count(), graph.walks.count(), tables)
    shown, coverage = spark.read.parquet(f"{out}/variants"), spark.read.parquet(f"{out}/coverage")
    log.info("wrote %d calls, %d variants and coverage of %d to %s", written.count(), shown.count(), coverage.count(), out)
    both = written.alias("c").join(coverage.alias("v"), same("c", "v")).select("c.*", "v.low", "v.high")
    return both.join(shown, "idx").select("sample", "hap", "idx", "vtype", "pos", "ref_len", "alt_len", "alt_count", "ref_count", "low", "high")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.sample_calls", description="Calls the variants of the parts graph for every sample.")
    parser.add_argument("tables", help="the folder of part, orders, lineitem and customer")
    parser.add_argument("out", help="the folder of the tables variants, calls and coverage")
    parser.add_argument("--config", help="a JSON file of settings, such as jobs/sample_calls.json")
    a = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("sample-calls").getOrCreate()
    try:
        run(spark, a.tables, a.out, settings.read(spark, a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
