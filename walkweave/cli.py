"""walkweave GFA VCF [--chr-id chr0] [--ref_name GRCh38] [--no-genotypes]: calls the variants of a graph."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from walkweave.plans.build import from_gfa
from walkweave.sinks.files import write_vcf


def parse(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="walkweave", description="Calls the variants of a bidirected sequence graph.")
    p.add_argument("gfa_file")
    p.add_argument("vcf_file")
    p.add_argument("--chr-id", default="chr0")
    p.add_argument("--ref_name", default="GRCh38")
    p.add_argument("--no-genotypes", action="store_true")
    return p.parse_args(args)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parse(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = spark or SparkSession.builder.appName("walkweave").getOrCreate()
    graph = from_gfa(spark, a.gfa_file, a.ref_name)
    write_vcf(graph, a.vcf_file, a.chr_id, not a.no_genotypes)


if __name__ == "__main__":
    main()
