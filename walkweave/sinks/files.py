"""Writing graphs: VCF, tree, node and edge tables, GFA, sequences and lists. Each file is a folder of parts in order, a part per range of the order; `single` asks for one part, which goes through one task. Tables with a header have it in each part."""

from __future__ import annotations

import logging
import resource
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkweave.functions.columns import node_id_symbol, node_recover
from walkweave.operators import genotypes as G
from walkweave.operators import trees
from walkweave.operators import variants as V
from walkweave.plans.build import both_readings
from walkweave.schema import TERMINI, VCF_ATTRIBUTES, BiGraph

log = logging.getLogger("walkweave")

#: Fixed texts of the header: kind, id, number, type, description.
META = (
    ("FORMAT", "GT", "1", "String", "Genotype"),
    ("FORMAT", "CR", ".", "Integer", "The reference allele count for each sample's haplotypes"),
    ("FORMAT", "CA", ".", "Integer", "The alternative allele count for each sample's haplotypes"),
    ("INFO", "NR", "1", "String", "Non-reference allele"),
    ("INFO", "VT", "1", "String", "Variant type"),
    ("INFO", "DR", "2", "Integer", "Distance from reference (variant edge's two nodes)"),
    ("INFO", "RC", "1", "Integer", "The REF allele count"),
    ("INFO", "AC", "A", "Integer", "The ALT allele count"),
    ("INFO", "AN", "1", "Integer", "Total number of alleles in called genotypes"),
    ("INFO", "PV", "2", "Integer", "Position of variant edge's two nodes"),
    ("INFO", "TR_MOTIF", "1", "String", "Tandem repeat motif"),
    ("INFO", "NIA", "1", "Integer", "Nearly identical alleles (1=yes, 0=no)"),
)


def log_action(action: str) -> None:
    """Logs what is done and the driver's largest memory so far in MB; Spark's own pages show the executors'."""
    log.info("%s, %d MB", action, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)


def write_lines(lines: DataFrame, path: str, single: bool = True, order: list[str | Column] | None = None) -> None:
    """lines: value and the columns of `order`."""
    rows = lines.orderBy(*order) if order else lines
    rows = rows.select("value")
    (rows.coalesce(1) if single else rows).write.mode("overwrite").text(path)


def vcf_records(graph: BiGraph, chrom: str, exclude_terminus: bool = True, size_threshold: int | None = None, check_degenerate: bool = False) -> DataFrame:
    """graph_id, idx, rank and the nine fixed fields, in the order that rank gives."""
    v = V.alleles(graph, V.rank_of(V.variants(graph, exclude_terminus)))
    v = V.allele_counts(graph, V.with_motif(graph, v))
    if check_degenerate:
        v = v.where("ref <> alt")
    forward = (F.col("du") == 1) & F.col("v_on_ref")
    prepend = ((F.col("ref") == "") | (F.col("alt") == "")) & forward
    v = v.withColumn("prepend", prepend).withColumn("nr", F.when(forward, ".").when(F.col("ref") == "", ".").otherwise(F.col("ref")))
    before = F.when(F.col("prepend"), F.col("b_last")).otherwise("")
    v = v.withColumns({"REF": F.when(forward, F.concat(before, "ref")).otherwise("."), "ALT": F.concat(before, "alt")})
    if size_threshold:
        v = v.withColumns({c: F.left(c, F.lit(size_threshold)) for c in ("REF", "ALT")})
    from walkweave.functions.columns import nearly_identical

    number = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("string")
    inverted = F.col("vtype") == "INV"
    less = lambda c: F.when(F.coalesce(inverted, F.lit(False)), ".").otherwise(number(c))
    info = F.concat(
        F.lit("NR="), "nr", F.lit(";VT="), F.coalesce("vtype", F.lit("None")), F.lit(";DR="), number("u_distance"), F.lit(","), number("v_distance"), F.lit(";RC="), less("rc"), F.lit(";AC="), number("ac"),
        F.lit(";AN="), less(F.coalesce("rc", F.lit(0)) + F.coalesce("ac", F.lit(0))), F.lit(";PV="), number("u_position"), F.lit(","), number("v_position"), F.lit(";TR_MOTIF="), F.coalesce("motif", F.lit(".")),
        F.lit(";NIA="), nearly_identical("REF", "ALT").cast("int").cast("string"),
    )
    dot = lambda c: F.when(F.col(c) == "", ".").otherwise(F.col(c))
    return v.select(
        "graph_id", "idx", "rank", F.lit(chrom).alias("CHROM"), V.vcf_position(F.col("prepend")).alias("POS"), F.concat(node_recover("pu"), node_recover("pv")).alias("ID"), dot("REF").alias("REF"), dot("ALT").alias("ALT"),
        F.lit("60").alias("QUAL"), F.lit("PASS").alias("FILTER"), info.alias("INFO"), F.lit("GT:CR:CA").alias("FORMAT"),
    )


def vcf_lines(graph: BiGraph, chrom: str, genotypes: bool = True, **options) -> tuple[list[str], DataFrame]:
    """Header lines, and value, rank. Samples are columns in order of their names; the list of names, not the genotypes, is read on the driver."""
    records = vcf_records(graph, chrom, **options)
    names = sorted(r.sample for r in graph.walks.select("sample").distinct().collect()) if genotypes else []
    text = [F.col(c).cast("string") for c in VCF_ATTRIBUTES]
    if names:
        fields = G.sample_fields(graph, V.variants(graph, options.get("exclude_terminus", True)))
        cells = fields.groupBy("graph_id", "idx").agg(F.array_sort(F.collect_list(F.struct("sample", "field"))).alias("cells"))
        records = records.join(cells, ["graph_id", "idx"], "left")
        text.append(F.array_join(F.transform("cells", lambda c: c["field"]), "\t"))
    head = ["##fileformat=VCFv4.2", *(f'##{kind}=<ID={id_},Number={n},Type={t},Description="{d}">' for kind, id_, n, t, d in META), f"##contig=<ID={chrom}>", "#" + "\t".join([*VCF_ATTRIBUTES, *names])]
    return head, records.select("rank", F.concat_ws("\t", *text).alias("value"))


def write_vcf(graph: BiGraph, path: str, chrom: str, genotypes: bool = True, single: bool = True, **options) -> None:
    """Options: exclude_terminus, size_threshold (alleles are cut to so many letters), check_degenerate (skips variants whose alleles are equal)."""
    log_action(f"writing VCF {path}")
    head, lines = vcf_lines(graph, chrom, genotypes, **options)
    spark = lines.sparkSession
    top = spark.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "rank long, value string")
    write_lines(top.union(lines.select(F.col("rank").cast("long"), "value")), path, single, ["rank"])


def tree_lines(graph: BiGraph) -> DataFrame:
    """graph_id, node, line, parent_line (-1: root), seq: nodes of the tree, parents first."""
    n = graph.nodes.where("direction = 1 and tin is not null")
    return trees.tree_lines(n).select("graph_id", "node", "line", "parent_line", "seq")


def write_tree(graph: BiGraph, path: str, single: bool = False) -> DataFrame:
    lines = tree_lines(graph)
    write_lines(lines.select("line", F.concat_ws(",", "node", "parent_line", "seq").alias("value")), path, single, ["line"])
    return lines.select("graph_id", "node", "line")


def edgeinfo(graph: BiGraph) -> DataFrame:
    """index, weight, is_in_tree, branch_point (0: none), is_back_edge."""
    flag = lambda c: F.col(c).cast("int")
    return graph.edges.select(F.col("idx").alias("index"), "weight", flag("in_tree").alias("is_in_tree"), F.coalesce("branch_point", F.lit("0")).alias("branch_point"), flag("is_back").alias("is_back_edge"))


def nodeinfo(graph: BiGraph) -> DataFrame:
    """node and its attributes but the sequence; no termini."""
    n = graph.nodes.where(~F.col("seg_id").isin(*TERMINI))
    return n.select("node", "direction", "position", "right_position", F.col("distance").alias("distance_from_reference"), F.col("on_ref").cast("int").alias("on_reference_path"))


def write_table(rows: DataFrame, path: str, order: str, single: bool, sep: str = ",") -> None:
    rows = rows.orderBy(order)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, header=True, sep=sep)


def write_edgeinfo(graph: BiGraph, path: str, single: bool = True) -> None:
    write_table(edgeinfo(graph), path, "index", single)


def write_nodeinfo(graph: BiGraph, path: str, single: bool = True) -> None:
    write_table(nodeinfo(graph), path, "node", single)


def gfa_lines(graph: BiGraph, only_tree: bool = False) -> DataFrame:
    """value, rank: S lines of all oriented nodes and L lines of all oriented edges (or the tree's); signs are those of the nodes' directions."""
    sign = F.when(F.col("direction") == 1, "+").otherwise("-")
    nodes = graph.nodes.select("graph_id", "node", node_id_symbol("node")["id"].alias("seg"), sign.alias("sign"), "seq", "tin")
    if only_tree:
        nodes = nodes.where("tin is not null")
    at = lambda end: nodes.select("graph_id", F.col("node").alias(end), F.col("seg").alias(f"{end}s"), F.col("sign").alias(f"{end}o"))
    edges = both_readings((graph.edges.where("in_tree") if only_tree else graph.edges).select("graph_id", "idx", "u", "v"))
    edges = edges.join(at("u"), ["graph_id", "u"]).join(at("v"), ["graph_id", "v"])
    s = nodes.select(F.lit(0).alias("rank"), F.concat_ws("\t", F.lit("S"), "seg", "seq").alias("value"))
    return s.union(edges.select(F.lit(1).alias("rank"), F.concat_ws("\t", F.lit("L"), "us", "uo", "vs", "vo", F.lit("0M")).alias("value")))


def write_gfa(graph: BiGraph, path: str, only_tree: bool = False, single: bool = False) -> None:
    write_lines(gfa_lines(graph, only_tree), path, single, ["rank", "value"])


def write_source_gfa(segments: DataFrame, links: DataFrame, walks: DataFrame, path: str, contig: str = "*") -> None:
    """Segments, links and walks as the GFA text that `sources.gfa` reads, a folder of parts in no order: S, L and W lines. A walk's range is left open."""
    tabs = lambda *c: F.concat_ws("\t", *c).alias("value")
    end = lambda c: (node_id_symbol(c)["id"], node_id_symbol(c)["symbol"])
    lines = segments.select(tabs(F.lit("S"), "seg_id", "seq")).union(links.select(tabs(F.lit("L"), *end("u"), *end("v"), F.lit("0M"))))
    open_ = F.lit("*")
    lines = lines.union(walks.select(tabs(F.lit("W"), "sample", "hap", F.lit(contig), open_, open_, F.array_join(F.transform("steps", node_recover), ""))))
    lines.write.mode("overwrite").text(path)


def node_sequences(graph: BiGraph) -> DataFrame:
    """NodeID, Sequence: each segment once, as its forward node reads it."""
    return graph.nodes.where("direction = 1").select(F.col("seg_id").alias("NodeID"), F.col("seq").alias("Sequence")).distinct()


def write_node_sequences(graph: BiGraph, path: str, single: bool = True) -> None:
    write_table(node_sequences(graph), path, "NodeID", single)


def write_nodes(nodes: DataFrame, path: str, single: bool = False) -> None:
    write_lines(nodes.select(F.col("node").alias("value")), path, single, ["value"])


def subset_gfa_to_tree(spark, gfa: str, path: str, graph: BiGraph, single: bool = False) -> None:
    """Copies S lines, and the L lines whose edge is in the tree."""
    text = spark.read.text(gfa).withColumn("at", F.monotonically_increasing_id())
    f = F.split(F.regexp_replace("value", r"\s+$", ""), "\t")
    end = lambda i: F.concat(F.get(f, F.lit(i)), F.lit("_"), F.get(f, F.lit(i + 1)))
    tree = graph.edges.where("in_tree").select("u", "v")
    links = text.where(F.col("value").startswith("L\t")).withColumns({"u": end(1), "v": end(3)}).join(tree, ["u", "v"], "left_semi")
    write_lines(text.where(F.col("value").startswith("S\t")).select("value", "at").union(links.select("value", "at")), path, single, ["at"])


def write_bubble_summary(summary: DataFrame, folder: str, chrom: str, method: str = "AT", single: bool = True) -> str:
    """A tab-separated table named after chromosome and method; AT is the only method."""
    if method != "AT":
        raise ValueError("the only method is AT")
    path = str(Path(folder) / f"bubble_variant_counts_{chrom}_{method}.tsv") if "://" not in folder else f"{folder}/bubble_variant_counts_{chrom}_{method}.tsv"
    names = {"bubble": "Bubble", "level": "Level", "total_count": "Total_count", "within_count": "Within_count", "crossing_count": "Crossing_count", "within": "Within", "crossing": "Crossing"}
    write_table(summary.select([F.col(a).alias(b) for a, b in names.items()]), path, "Bubble", single, "\t")
    return path


