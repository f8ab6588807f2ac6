"""Variants: edges outside the reference tree, their alleles, types, places and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkweave.functions.columns import canonical, edge_number, is_terminal_node, nearly_identical, node_complement, repeat_motif, segment_of, sequence_complement
from walkweave.operators.ranks import global_rank
from walkweave.schema import BiGraph

#: Chains are cut into blocks of so many nodes for joining paths with nodes, so a long chain is not one join key.
BLOCK = 256


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges in forward form (pu, pv: complemented if both ends are backward), with du, dv (directions) and, for each end, position, right position, distance, flag and length; letters from the root and own letters of the forward
    twins of pu and pv, too (pu_plen, pu_len, pv_plen, pv_len).

    A segment's row has what both its nodes say, so an edge meets each of its ends once, whichever of the two nodes is asked for later, and columns that nobody reads are not dealt."""
    said = ["position", "right_position", "distance", "on_ref", "parent", "depth", "plen", "len"]
    side = lambda sign, mark: nodes.where(F.col("orient") == sign).select("graph_id", "seg_id", *[F.col(c).alias(f"{mark}{c}") for c in ["direction", *said[:-1]]], F.length("seq").alias(f"{mark}len"))
    both = side("+", "p_").join(side("-", "m_"), ["graph_id", "seg_id"])
    both = both.withColumns({f"f_{c}": F.when(F.col("p_direction") == 1, F.col(f"p_{c}")).when(F.col("m_direction") == 1, F.col(f"m_{c}")) for c in ("plen", "len")}).where("p_direction = 1 or m_direction = 1")

    def met(e: DataFrame, end: str) -> DataFrame:
        """Adds what the end's own node (o) and its twin (t) say."""
        s = both.select("graph_id", F.col("seg_id").alias("__seg"), *[F.col(c).alias(f"__{c}") for c in both.columns[2:]])
        plus = F.right(end, F.lit(1)) == "+"
        pick = lambda c, a, b: F.when(plus, F.col(f"__{a}_{c}")).otherwise(F.col(f"__{b}_{c}"))
        e = e.withColumn("__seg", segment_of(end)).join(s, ["graph_id", "__seg"])
        found = {f"__{end}o_{c}": pick(c, "p", "m") for c in ["direction", *said]} | {f"__{end}t_{c}": pick(c, "m", "p") for c in said}
        return e.select(*edges.columns, *more, *[x.alias(n) for n, x in found.items()], *[F.col(f"__f_{c}").alias(f"__{end}f_{c}") for c in ("plen", "len")])

    more: list[str] = []
    e = met(edges, "u")
    more = e.columns[len(edges.columns) :]
    e = met(e, "v")
    back = (F.col("__uo_direction") == -1) & (F.col("__vo_direction") == -1)
    turn = lambda end, other: {f"{end}_{c}": F.when(back, F.col(f"__{other}t_{c}")).otherwise(F.col(f"__{end}o_{c}")) for c in said} | {f"p{end}_{c}": F.when(back, F.col(f"__{other}f_{c}")).otherwise(F.col(f"__{end}f_{c}")) for c in ("plen", "len")}
    new = {"__turned": back, "pu": F.when(back, node_complement("v")).otherwise(F.col("u")), "pv": F.when(back, node_complement("u")).otherwise(F.col("v"))}
    new |= {f"d{x}": F.when(back, F.lit(1)).otherwise(F.col(f"__{x}o_direction").cast("int")) for x in "uv"}
    return e.select(*edges.columns, *[x.alias(n) for n, x in (new | turn("u", "v") | turn("v", "u")).items()])


def variants(graph: BiGraph, exclude_terminus: bool = True) -> DataFrame:
    """One row per edge outside the tree, with its type. Allele lengths come from prefix sums along the tree; no allele is written out.

    A terminal variant has its branch point or its end v at a terminus."""
    e = graph.edges.where("not in_tree and branch_point is not null")
    # What is asked of the names is asked before names are left behind, so they are dealt only to where they are read.
    e = e.withColumns({"__ub": F.col("branch_point") == F.col("u"), "__vb": F.col("branch_point") == node_complement("v"), "__ut": is_terminal_node("u"), "__vt": is_terminal_node("v"), "__bt": is_terminal_node("branch_point")})
    e = with_ends(e, graph.nodes)
    e = e.withColumn("__from", F.when(F.col("__turned"), F.col("__vb")).otherwise(F.col("__ub")))
    e = e.withColumn("terminal", F.col("__bt") | F.when(F.col("__turned"), F.col("__ut")).otherwise(F.col("__vt")))
    b = graph.nodes.select("graph_id", F.col("node").alias("branch_point"), F.col("plen").alias("b_plen"), F.right("seq", F.lit(1)).alias("b_last"))
    e = e.join(b, ["graph_id", "branch_point"])
    down = lambda n, whole: F.greatest(F.col(f"{n}_plen") - F.col("b_plen") - F.when(whole, F.lit(0)).otherwise(F.col(f"{n}_len")), F.lit(0))
    forward, inner = F.col("du") == 1, F.col("dv") == -1
    e = e.withColumn("ref_len", F.when(forward, down("pv", inner)).otherwise(down("pu", F.lit(False))))
    e = e.withColumn("alt_len", F.when(forward, down("pu", F.lit(True))).otherwise(down("pv", inner)))
    if exclude_terminus:
        e = e.where("not terminal")
    return e.withColumn("vtype", variant_type()).drop("__ub", "__vb", "__ut", "__vt", "__bt", "__turned", "__from")


def variant_type() -> Column:
    """One rule after the other; a crossing edge whose alternative allele alone is empty has no type."""
    crossing = ~(F.col("du") != F.col("dv")) & ~F.col("is_back") & ~F.col("__from")
    r, a = F.col("ref_len"), F.col("alt_len")
    return (
        F.when(F.col("du") != F.col("dv"), "INV")
        .when(F.col("is_back"), "DUP")
        .when(~crossing, "DEL")
        .when((r == 0), "INS")
        .when((a > 0) & (r != a), "REP")
        .when((r == 1) & (a == 1), "SNP")
        .when((r == a), "MNP")
    )


def allele_lengths(graph: BiGraph) -> DataFrame:
    """graph_id, idx, allele_length: letters of both alleles, terminal variants too."""
    return variants(graph, False).select("graph_id", "idx", (F.col("ref_len") + F.col("alt_len")).alias("allele_length"))


def alleles(graph: BiGraph, variants: DataFrame) -> DataFrame:
    """The variants with ref and alt written out, and b_last ('N' for an empty branch point).

    A tree path is a few pieces of chains; a piece joins the nodes of its chain by block and place. Alleles that read backward are reverse complements."""
    pieces = graph.paths.join(variants.select("graph_id", "idx"), ["graph_id", "idx"], "left_semi")
    pieces = pieces.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))))
    nodes = graph.nodes.where("chain is not null").select("graph_id", "chain", "chain_pos", "seq", F.floor(F.col("chain_pos") / BLOCK).alias("block"))
    found = pieces.join(nodes, ["graph_id", "chain", "block"]).where("chain_pos between low and high")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chain_pos", "seq"))), lambda x: x["seq"]), "")
    read = found.groupBy("graph_id", "idx").pivot("allele", ["ref", "alt"]).agg(text)
    out = variants.join(read, ["graph_id", "idx"], "left")
    turned = lambda c: F.when(F.col("du") == 1, F.coalesce(c, F.lit(""))).otherwise(sequence_complement(F.coalesce(F.col(c), F.lit(""))))
    out = out.withColumns({c: turned(c) for c in ("ref", "alt")})
    return out.withColumn("b_last", F.when(F.col("b_last") == "", "N").otherwise(F.col("b_last")))


def vcf_position(prepend: Column | None = None) -> Column:
    """Position of u + 1, less 1 where the branch point's last letter goes before the alleles: one is empty and the reference allele lies forward on the reference."""
    plain = ((F.col("ref_len") == 0) | (F.col("alt_len") == 0)) & (F.col("du") == 1) & F.col("v_on_ref")
    return F.col("u_position") + 1 - (plain if prepend is None else prepend).cast("int")


def sorted_variants(variants: DataFrame) -> DataFrame:
    """By place, distances of both ends, and names in order of code point."""
    return variants.withColumn("pos", vcf_position()).orderBy("graph_id", "pos", "u_distance", "v_distance", "pu", "pv")


def allele_counts(graph: BiGraph, variants: DataFrame) -> DataFrame:
    """Adds rc, the weight of the tree edge into the end v (forward twin), and ac, the variant's own."""
    weight = graph.edges.where("in_tree").select("graph_id", F.col("idx").alias("ref_idx"), F.col("weight").alias("rc"))
    tree = tree_edges(graph).join(weight, ["graph_id", "ref_idx"])
    return _with_end(variants).join(tree, ["graph_id", "node"], "left").drop("node").withColumn("ac", F.col("weight"))


def reference_edges(graph: BiGraph, variants: DataFrame) -> DataFrame:
    """graph_id, idx, ref_idx: the tree edge that competes with each variant, the one into v's forward twin."""
    return _with_end(variants).select("graph_id", "idx", "node").join(tree_edges(graph), ["graph_id", "node"]).select("graph_id", "idx", "ref_idx")


def variant_names(graph: BiGraph) -> DataFrame:
    """graph_id, idx, u, v: the variants that `variants` gives. In a plain graph all ends are there, so none need be asked."""
    of = graph.edges.where("not in_tree and branch_point is not null") if graph.plain else variants(graph)
    return of.select("graph_id", "idx", "u", "v")


def places(graph: BiGraph) -> DataFrame:
    """graph_id, idx, u_position, v_position, u_right_position, v_right_position as `variants` gives them. In a plain graph an edge meets each of its ends once and its branch point not at all."""
    if not graph.plain:
        return variants(graph).select("graph_id", "idx", *[f"{x}_{c}" for c in ("position", "right_position") for x in "uv"])
    turned = (F.right("u", F.lit(1)) == "-") & (F.right("v", F.lit(1)) == "-")
    e = variant_names(graph).select("graph_id", "idx", F.when(turned, node_complement("v")).otherwise(F.col("u")).alias("u"), F.when(turned, node_complement("u")).otherwise(F.col("v")).alias("v"))
    at = lambda end: graph.nodes.select("graph_id", F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("position", "right_position")])
    return e.join(at("u"), ["graph_id", "u"]).drop("u").join(at("v"), ["graph_id", "v"]).drop("v")


def variant_ends(graph: BiGraph) -> DataFrame:
    """graph_id, idx, node: the forward twin of each variant's end v, terminal variants too."""
    if not graph.plain:
        return ends_of(variants(graph, False))
    turned = (F.right("u", F.lit(1)) == "-") & (F.right("v", F.lit(1)) == "-")
    end = segment_of(F.when(turned, F.col("u")).otherwise(F.col("v")))
    return graph.edges.where("not in_tree and branch_point is not null").select("graph_id", "idx", F.concat(end, F.lit("_+")).alias("node"))


def ends_of(variants: DataFrame) -> DataFrame:
    return _with_end(variants).select("graph_id", "idx", "node")


def _with_end(variants: DataFrame) -> DataFrame:
    """Adds node, v's forward twin."""
    return variants.withColumn("node", F.when(F.col("dv") == 1, F.col("pv")).otherwise(node_complement("pv")))


def tree_edges(graph: BiGraph) -> DataFrame:
    """graph_id, node, ref_idx: the edge from a forward node's parent to it."""
    from walkweave.plans.build import both_readings

    if graph.plain:
        named = graph.nodes.where("direction = 1 and parent is not null").withColumn("e", canonical("parent", "node"))
        return named.select("graph_id", "node", edge_number("e.u", "e.v").alias("ref_idx"))
    inside = both_readings(graph.edges.where("in_tree").select("graph_id", "idx", "u", "v"))
    parents = graph.nodes.where("direction = 1 and parent is not null").select("graph_id", "node", F.col("parent").alias("u"))
    return parents.join(inside.select("graph_id", "u", F.col("v").alias("node"), F.col("idx").alias("ref_idx")), ["graph_id", "u", "node"]).select("graph_id", "node", "ref_idx")


def variant_summary(variants: DataFrame) -> DataFrame:
    """Counts by kind, which overlap; one row per graph."""
    count = lambda *types: F.count_if(F.col("vtype").isin(*types))
    crossing = F.count_if(F.col("vtype").isNull() | F.col("vtype").isin("INS", "REP", "SNP", "MNP"))
    return variants.groupBy("graph_id").agg(
        count("INV").alias("inversion"), count("REP").alias("replacement"), count("INS").alias("insertion"), count("SNP").alias("snps"), count("MNP").alias("mnps"),
        crossing.alias("crossing_edges"), count("DUP").alias("back_edges"), count("DEL").alias("forward_edges"), F.count(F.lit(1)).alias("total"),
    )


#: The rows of the summary table and the counters that they show.
SUMMARY_ROWS = (("Total", "total"), ("Inversion", "inversion"), ("Duplication", "back_edges"), ("Deletion", "forward_edges"), ("Forward", "forward_edges"), ("Crossing", "crossing_edges"), ("Insertion", "insertion"), ("Replacement", "replacement"), ("SNP", "snps"), ("MNP", "mnps"))


def summary_table(summary: DataFrame) -> DataFrame:
    """graph_id, type, count: ten rows per graph."""
    pairs = ", ".join(f"'{name}', coalesce({column}, 0)" for name, column in SUMMARY_ROWS)
    return summary.select("graph_id", F.expr(f"stack({len(SUMMARY_ROWS)}, {pairs}) as (type, count)"))


def interval_variants(variants: DataFrame, start: int, end: int, strict: bool = False) -> DataFrame:
    """Variants whose range of positions meets [start, end). Edges that begin at the plus terminus or end at the minus terminus's reverse are left out; strict: any terminal end."""
    inside = (F.least("u_position", "v_position") < end) & (F.greatest("u_position", "v_position") >= start)
    ends = ~((F.col("u") == "+_terminus_+") | (F.col("v") == "+_terminus_-"))
    return variants.where(inside & ((~is_terminal_node("u") & ~is_terminal_node("v")) if strict else ends))


def with_motif(graph: BiGraph, variants: DataFrame) -> DataFrame:
    """variants with ref and alt. Adds motif: the repeated unit of an insertion or deletion that also stands right before or after it; null otherwise.

    An allele without the other is a repeat if its unit ends the letters from the root to the branch point or begins a way down from v; back edges need neither."""
    one = (F.col("du") == F.col("dv")) & ((F.col("ref") == "") != (F.col("alt") == ""))
    v = variants.withColumn("unit", F.when(one, repeat_motif(F.when(F.col("alt") == "", F.col("ref")).otherwise(F.col("alt")))))
    some = v.where("unit is not null and not is_back").select("graph_id", "idx", "unit", "branch_point", F.col("pv").alias("end"))
    up = match_up_tree(graph, some.select("graph_id", "idx", "unit", F.col("branch_point").alias("node")))
    down = match_down_tree(graph, some.select("graph_id", "idx", "unit", F.col("end").alias("node")))
    hits = up.union(down).distinct().withColumn("hit", F.lit(True))
    v = v.join(hits, ["graph_id", "idx"], "left")
    return v.withColumn("motif", F.when(F.col("is_back") | F.col("hit"), F.col("unit"))).drop("unit", "hit")


def _hops(rows: DataFrame, step, done: Column) -> DataFrame:
    """Follows rows (graph_id, idx, rest, node) hop by hop; `step` gives the rows after one more node. Rounds end when no row goes on; each is written, so plans stay short."""
    from walkweave.plans.store import materialise

    rows = materialise(step(rows), "hops")
    found = rows.where(done).select("graph_id", "idx")
    while not (rows := rows.where(~done)).isEmpty():
        rows = materialise(step(rows), "hops")
        found = found.union(rows.where(done).select("graph_id", "idx"))
    return found.distinct()


def match_up_tree(graph: BiGraph, rows: DataFrame) -> DataFrame:
    """rows: graph_id, idx, unit, node. Those (graph_id, idx) whose unit ends the letters from the root to the node."""
    nodes = graph.nodes.where("direction = 1").select("graph_id", "node", "seq", "parent")

    def step(r: DataFrame) -> DataFrame:
        n = r.join(nodes, ["graph_id", "node"])
        taken = F.least(F.length("rest"), F.length("seq"))
        same = F.right("rest", taken) == F.right("seq", taken)
        n = n.where(same & ((taken > 0) | (F.length("rest") == 0)))
        n = n.select("graph_id", "idx", F.left("rest", F.length("rest") - taken).alias("rest"), F.col("parent").alias("node"))
        return n.where("rest = '' or node is not null")

    return _hops(rows.withColumnRenamed("unit", "rest"), step, F.col("rest") == "")


def match_down_tree(graph: BiGraph, rows: DataFrame) -> DataFrame:
    """rows: graph_id, idx, unit, node. Those whose unit begins the letters of some way down the tree that starts with the node."""
    nodes = graph.nodes.where("direction = 1").select("graph_id", "node", "seq")
    children = graph.nodes.where("direction = 1 and parent is not null").select("graph_id", F.col("parent").alias("node"), F.col("node").alias("child"))

    def step(r: DataFrame) -> DataFrame:
        n = r.join(nodes, ["graph_id", "node"])
        taken = F.least(F.length("rest"), F.length("seq"))
        n = n.where(F.left("rest", taken) == F.left("seq", taken)).withColumn("rest", F.substring("rest", taken + 1, F.length("rest")))
        on = n.join(children, ["graph_id", "node"], "left")
        return on.select("graph_id", "idx", "rest", F.coalesce("child", F.lit(None)).alias("node")).where("rest = '' or node is not null").distinct()

    return _hops(rows.withColumnRenamed("unit", "rest"), step, F.col("rest") == "")


def match_down_graph(graph: BiGraph, rows: DataFrame) -> DataFrame:
    """rows: graph_id, idx, unit, node, end. Those whose unit is spelt by some way through the whole graph from node to end. A place reached with the same rest twice is followed once,
    so loops of empty nodes end."""
    from walkweave.plans.build import both_readings
    from walkweave.plans.store import materialise

    nodes = graph.nodes.select("graph_id", "node", "seq")
    ahead = both_readings(graph.edges.select("graph_id", "idx", "u", "v")).select("graph_id", F.col("u").alias("node"), F.col("v").alias("to"))
    key = ["graph_id", "idx", "node", "rest"]

    def read(r: DataFrame) -> DataFrame:
        n = r.join(nodes, ["graph_id", "node"]).where(F.startswith("rest", F.col("seq")))
        return n.select("graph_id", "idx", "end", "node", F.substring("rest", F.length("seq") + 1, F.length("rest")).alias("rest"))

    now = materialise(read(rows.withColumnRenamed("unit", "rest")).distinct(), "ways")
    seen = now
    while True:
        moved = now.join(ahead, ["graph_id", "node"]).select("graph_id", "idx", "rest", F.col("to").alias("node"), "end")
        now = materialise(read(moved).distinct().join(seen.select(key), key, "left_anti"), "ways")
        if now.isEmpty():
            return seen.where("rest = '' and node = end").select("graph_id", "idx").distinct()
        seen = seen.union(now)


def missing_inversions(graph: BiGraph, variants: DataFrame, minimum: int = 10) -> DataFrame:
    """Crossing variants (with ref, alt) of at least `minimum` alternative letters whose reverse complement is spelt by another way from branch point to v: graph_id, idx, alt."""
    crossing = variants.where("vtype is null or vtype in ('INS', 'REP', 'SNP', 'MNP')").where(F.length("alt") >= minimum)
    seq = lambda end, name: graph.nodes.select("graph_id", F.col("node").alias(end), F.col("seq").alias(name))
    r = crossing.join(seq("branch_point", "s"), ["graph_id", "branch_point"]).join(seq("pv", "t"), ["graph_id", "pv"])
    r = r.select("graph_id", "idx", F.concat("s", sequence_complement("alt"), "t").alias("unit"), F.col("branch_point").alias("node"), F.col("pv").alias("end"))
    return crossing.select("graph_id", "idx", "alt").join(match_down_graph(graph, r), ["graph_id", "idx"])


def nearly_identical_alleles(variants: DataFrame) -> DataFrame:
    return variants.withColumn("nia", nearly_identical("ref", "alt").cast("int"))


def rank_of(variants: DataFrame, name: str = "rank") -> DataFrame:
    """Each variant's place in the order of sorted_variants; graphs are ranked on their own."""
    return global_rank(variants.withColumn("pos", vcf_position()), ["pos", "u_distance", "v_distance", "pu", "pv"], name, "graph_id")
