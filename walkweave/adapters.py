"""Ordinary tables recast as graphs.

Parts graph: a segment per part; walks are orders, which step through their lines' parts. Parts whose key modulo 3 isn't 2 are the reference path in key order, each of the others hangs on the part before it, so the
tree and all its labels have closed forms and no search is needed. Events graph: a segment per event type; walks are users' events in time; the reference path is all types by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkweave.functions.columns import canonical, edge_number, node_complement
from walkweave.operators.trees import branch_points, tour
from walkweave.plans.build import build, walk_pairs
from walkweave.plans.store import materialise
from walkweave.schema import EDGES, NODES, BiGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(text: Column) -> Column:
    """A sequence from a text's MD5."""
    return F.translate(F.md5(text), "0123456789abcdef", "ACGTACGTACGTACGT")


def part_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    seq = F.left(letters(F.col("p_partkey").cast("string")), 1 + F.col("p_size") % 12)
    return p.select(F.lit("parts").alias("graph_id"), "p_partkey", F.col("p_partkey").cast("string").alias("seg_id"), seq.alias("seq"))


def _walks_of(spark: SparkSession, sf_dir: str, nodes: DataFrame, *more: str) -> DataFrame:
    """The orders' walks. nodes: l_orderkey, node (an order's steps)."""
    # Orders meet their customers while they are narrow; their lines come last and are dealt once.
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_nationkey")
    o = o.join(nodes, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.lit("parts").alias("graph_id"), F.col("o_orderkey").alias("walk_idx"), F.col("c_nationkey").cast("string").alias("sample"), F.col("o_custkey").cast("string").alias("hap"), F.lit(False).alias("is_ref"), F.col("node").alias("steps"), *more)


def order_walks(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """graph_id, walk_idx (order), sample (nation), hap (customer), is_ref, steps. Steps go by line number, part, supplier, date, price; lines returned are read backward. only: orders (l_orderkey) to which it's kept."""
    lines = table(spark, sf_dir, "lineitem")
    if only is not None:
        lines = lines.join(only, "l_orderkey", "left_semi")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag")
    steps = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    node = F.transform("lines", lambda x: F.concat(x["l_partkey"].cast("string"), F.when(x["l_returnflag"] == "R", "_-").otherwise("_+")))
    return _walks_of(spark, sf_dir, steps.select("l_orderkey", node.alias("node")))


#: Bits of a part's key, and of a line's number, in a line that is dealt as one number.
_PART, _LINE = 42, 20


def written_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_walks, written. Lines are dealt as order and one number of line number, part and direction. Supplier, date and price only tell apart lines that agree in number and part; they change a walk where such lines have different directions, and the few orders
    that have those are read again with all of it."""
    number, part = F.col("l_linenumber").cast("long"), F.col("l_partkey").cast("long")
    back = F.coalesce(F.col("l_returnflag") == "R", F.lit(False))
    fits = number.between(0, (1 << _LINE) - 1) & part.between(0, (1 << _PART) - 1)
    packed = F.shiftleft(number, _PART + 1).bitwiseOR(F.shiftleft(part, 1)).bitwiseOR(back.cast("long"))
    whole = F.struct(number.alias("number"), part.alias("part"), back.alias("back"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(fits, packed).alias("packed"), F.when(F.coalesce(~fits, F.lit(True)), whole).alias("whole")).repartition("l_orderkey")
    p = F.col("packed")
    read = F.struct(F.shiftright(p, _PART + 1).alias("number"), F.shiftright(p, 1).bitwiseAND((1 << _PART) - 1).alias("part"), (p.bitwiseAND(1) == 1).alias("back"))
    steps = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.coalesce("whole", read))).alias("x"))
    same = lambda a, b: a["number"].eqNullSafe(b["number"]) & a["part"].eqNullSafe(b["part"]) & (a["back"] != b["back"])
    tied = F.exists(F.zip_with(F.expr("slice(x, 1, size(x) - 1)"), F.expr("slice(x, 2, size(x) - 1)"), same), lambda t: t)
    node = F.transform("x", lambda x: F.concat(x["part"].cast("string"), F.when(x["back"], "_-").otherwise("_+")))
    walks = materialise(_walks_of(spark, sf_dir, steps.select("l_orderkey", node.alias("node"), tied.alias("tied")), "tied"), "walks")
    again = walks.where("tied").select(F.col("walk_idx").alias("l_orderkey"))
    if not again.isEmpty():
        again = materialise(order_walks(spark, sf_dir, materialise(again.distinct(), "tied")), "walks")
        return walks.where("not tied").drop("tied").union(again)
    return walks.drop("tied")


def _above(key: Column) -> Column:
    """The part above a part in the tree: before a reference part the reference part before it, before another the part before it."""
    return F.when((key % 3 == 2) | (key % 3 == 1), key - 1).otherwise(key - 2)


def parts_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled nodes of the parts graph. Running sums go along the parts in key order, by blocks of keys: a block's own sum, the sum of the blocks before it (one row each), and within the block."""
    s = part_segments(spark, sf_dir).withColumnRenamed("p_partkey", "k")
    on_ref = F.col("k") % 3 != 2
    block = F.floor(F.col("k") / 4096)
    s = s.withColumns({"on_ref": on_ref, "block": block, "len": F.length("seq"), "ref_len": F.when(on_ref, F.length("seq")).otherwise(0)})
    blocks = s.groupBy("block").agg(F.sum("ref_len").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("ref_len").over(Window.partitionBy("block").orderBy("k"))
    s = s.withColumn("within", within).join(blocks, "block")
    position = F.col("before") + F.col("within")
    last = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("last"))
    s = s.join(F.broadcast(last))  # one row
    above, refs = _above(F.col("k")), lambda k: k - F.floor(k / 3)
    row = s.select(
        "graph_id", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("orient"), F.col("seg_id"), "seq", position.alias("position"), position.alias("right_position"), F.when(on_ref, F.lit(0)).otherwise(F.col("len")).alias("distance"), "on_ref", "k", "last",
        F.when(F.col("k") > 0, F.concat(above.cast("string"), F.lit("_+"))).alias("parent"),
        # Reference parts before it, by which depth and chain go; the parts between hang one deeper.
        refs(F.col("k")).cast("int").alias("depth"), F.col("k").alias("tin"), F.when(on_ref, F.col("last")).otherwise(F.col("k")).alias("tout"), F.when(on_ref, F.lit(-1)).otherwise(F.col("k")).alias("chain"), refs(F.col("k")).alias("chain_pos"),
        (position + F.when(on_ref, F.lit(0)).otherwise(F.col("len"))).alias("plen"),
    )
    forward = F.col("orient") == "+"
    only = lambda c: F.when(forward, F.col(c))
    nodes = row.withColumns({"node": F.concat_ws("_", "seg_id", "orient"), "seq": F.when(forward, F.col("seq")).otherwise(F.translate(F.reverse("seq"), "ACGT", "TGCA")), "direction": F.when(forward, 1).otherwise(-1)} | {c: only(c) for c in ("parent", "depth", "tin", "tout", "chain", "chain_pos", "plen")})
    return nodes.select([F.col(f.name).cast(f.dataType) for f in NODES])


def parts_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, node, parent, k, len, ref_len: the parts graph's tree as what hangs on what, without labels."""
    s, k = part_segments(spark, sf_dir), F.col("p_partkey")
    parent = F.when(k > 0, F.concat(_above(k).cast("string"), F.lit("_+")))
    return s.select("graph_id", F.concat("seg_id", F.lit("_+")).alias("node"), parent.alias("parent"), k.alias("k"), F.length("seq").alias("len"), F.when(k % 3 != 2, F.length("seq")).otherwise(0).alias("ref_len"))


def parts_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's labels by its tour: graph_id, node, parent, depth, tin, tout, position, distance, plen. Places on the reference and distances from it are sums along the path from the root."""
    return tour(parts_tree(spark, sf_dir), {"position": "ref_len", "distance": F.col("len") - F.col("ref_len"), "plen": "len"}, ["k"])


def nearby_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, node, parent, k, len: a tree that only the orders tell. A part hangs on the part with a smaller key that stands next to it most often on the walks, of equally frequent ones on the one with the largest key; parts without one are roots."""
    key = lambda c: F.substring(c, F.lit(1), F.length(c) - 2).cast("long")
    x, y = key(F.col("u")), key(F.col("v"))
    pairs = walk_pairs(order_walks(spark, sf_dir), "graph_id").where(x != y).groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    above = pairs.groupBy("k").agg(F.max(F.struct("n", "a"))["a"].alias("a"))
    s = part_segments(spark, sf_dir).withColumnRenamed("p_partkey", "k")
    name = lambda c: F.concat(F.col(c).cast("string"), F.lit("_+"))
    return s.join(above, "k", "left").select("graph_id", name("k").alias("node"), name("a").alias("parent"), "k", F.length("seq").alias("len"))


def nearby_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, a, b: different parts that stand next to each other on a walk, each pair once, the smaller key first."""
    key = lambda c: F.substring(c, F.lit(1), F.length(c) - 2).cast("long")
    x, y = key(F.col("u")), key(F.col("v"))
    name = lambda c: F.concat(c.cast("string"), F.lit("_+"))
    return walk_pairs(order_walks(spark, sf_dir), "graph_id").where(x != y).select("graph_id", name(F.least(x, y)).alias("a"), name(F.greatest(x, y)).alias("b")).distinct()


def parts_edges(spark: SparkSession, sf_dir: str, walks: DataFrame) -> DataFrame:
    """Its labelled edges: those that walks take, and the tree's."""
    taken = walk_pairs(walks, "graph_id").select("graph_id", canonical(F.col("u"), F.col("v")).alias("e"), F.lit(1).cast("long").alias("weight"), F.lit(False).alias("in_tree"))
    tree = part_segments(spark, sf_dir).where("p_partkey > 0").select("graph_id", canonical(F.concat(_above(F.col("p_partkey")).cast("string"), F.lit("_+")), F.concat(F.col("seg_id"), F.lit("_+"))).alias("e"), F.lit(0).cast("long").alias("weight"), F.lit(True).alias("in_tree"))
    e = taken.union(tree).groupBy("graph_id", "e").agg(F.sum("weight").alias("weight"), F.max("in_tree").alias("in_tree"))
    e = e.select("graph_id", edge_number(F.col("e.u"), F.col("e.v")).alias("idx"), "e.u", "e.v", "weight", "in_tree")
    key = lambda c: F.substring(c, F.lit(1), F.length(c) - 2).cast("long")
    x, y = key(F.col("u")), key(F.col("v"))
    up = lambda k: F.when(k % 3 == 2, k - 1).otherwise(k)
    lca = F.when(x == y, x).otherwise(F.least(up(x), up(y)))
    sign = lambda c: F.right(c, F.lit(1))
    u_plus, v_plus = sign(F.col("u")) == "+", sign(F.col("v")) == "+"
    e = e.withColumns({"lca": F.when(~F.col("in_tree"), lca), "back": (v_plus & (lca == y)) | (~u_plus & (lca == x))})
    e = e.withColumn("is_back", ~F.col("in_tree") & F.col("back"))
    branch = F.when(F.col("is_back"), F.when(F.col("lca") > 0, _above(F.col("lca")))).otherwise(F.col("lca"))
    edges = e.withColumn("branch_point", F.concat(branch.cast("string"), F.lit("_+")))
    return edges.select([F.col(f.name).cast(f.dataType) for f in EDGES])


def _known(spark: SparkSession, sf_dir: str) -> bool:
    """Whether parts' keys go from 0 on without holes or repeats and all lines have one of them, so that every node that is named is there."""
    k = F.col("p_partkey")
    n, different, low, high = table(spark, sf_dir, "part").agg(F.count(F.lit(1)), F.count_distinct(k), F.min(k), F.max(k)).first()
    l = F.col("l_partkey")  # noqa: E741
    nulls, first, last = table(spark, sf_dir, "lineitem").agg(F.count_if(l.isNull()), F.min(l), F.max(l)).first()
    return n == different and low == 0 and high == n - 1 and not nulls and (first is None or (first >= 0 and last <= high))


def parts_graph(spark: SparkSession, sf_dir: str, with_edges: bool = True) -> BiGraph:
    """The labelled parts graph. Operators read its tables several times, so they are written once and the lines of orders are read once.
    with_edges: False leaves edges unwritten, for operators that may do without them."""
    walks = written_walks(spark, sf_dir)
    edges = parts_edges(spark, sf_dir, walks)
    return BiGraph(materialise(parts_nodes(spark, sf_dir), "nodes"), materialise(edges, "edges") if with_edges else edges, walks, plain=_known(spark, sf_dir))


def toured_parts_graph(spark: SparkSession, sf_dir: str) -> BiGraph:
    """The parts graph with the labels that the tour of its tree gives, and branch points by range minima, in place of the closed forms."""
    graph, labels = parts_graph(spark, sf_dir), parts_labels(spark, sf_dir)
    both = labels.union(labels.withColumn("node", node_complement("node")))
    nodes = graph.nodes.drop("position", "right_position", "distance", "plen").join(both.select("graph_id", "node", "position", F.col("position").alias("right_position"), "distance", "plen"), ["graph_id", "node"]).select(graph.nodes.columns)
    points = branch_points(labels, graph.edges.where("not in_tree"))
    edges = graph.edges.drop("branch_point", "is_back").join(points, ["graph_id", "idx"], "left").withColumn("is_back", F.coalesce("is_back", F.lit(False))).select(graph.edges.columns)
    return graph.but(nodes=nodes, edges=edges)


def event_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk per user; every fourth event is read backward."""
    e = table(spark, sf_dir, "events")
    steps = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    node = F.transform("x", lambda x: F.concat(x["event_type"], F.when(x["event_id"] % 4 == 0, "_-").otherwise("_+")))
    return steps.select(F.lit("events").alias("graph_id"), F.col("user_id").alias("walk_idx"), F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("sample"), (1 + F.col("user_id") % 2).cast("string").alias("hap"), F.lit(False).alias("is_ref"), node.alias("steps"))


def event_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """segments, links and walks, the reference walk with number -1."""
    types = table(spark, sf_dir, "events").select(F.col("event_type").alias("seg_id")).distinct()
    segments = types.select(F.lit("events").alias("graph_id"), "seg_id", F.left(letters(F.col("seg_id")), 1 + F.length("seg_id") % 3).alias("seq"))
    ref = types.agg(F.array_sort(F.collect_list(F.concat("seg_id", F.lit("_+")))).alias("steps"))  # a row per event type
    ref = ref.select(F.lit("events").alias("graph_id"), F.lit(-1).cast("long").alias("walk_idx"), F.lit("REF").alias("sample"), F.lit("0").alias("hap"), F.lit(True).alias("is_ref"), "steps")
    walks = event_walks(spark, sf_dir).union(ref)
    pairs = walk_pairs(walks, "graph_id").select("graph_id", canonical(F.col("u"), F.col("v")).alias("e")).distinct()
    links = pairs.select("graph_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("e")) - 1).cast("long").alias("idx"), "e.u", "e.v")
    return {"segments": segments, "links": links, "walks": walks}


def events_graph(spark: SparkSession, sf_dir: str) -> BiGraph:
    return build(**event_inputs(spark, sf_dir))
