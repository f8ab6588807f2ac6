"""Every operator as a query over the given tables, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkweave import adapters as A
from walkweave.functions import columns as C
from walkweave.operators import genotypes as G
from walkweave.operators import nesting as N
from walkweave.operators import reach as H
from walkweave.operators import regions as R
from walkweave.operators import simplify as S
from walkweave.operators import trees as T
from walkweave.operators import variants as V
from walkweave.plans import build as B
from walkweave.plans import store
from walkweave.sinks import files as K
from walkweave.sources import gfa

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the SQL; each query names those that it needs first.
CTES = {
    "seg": "seg AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS seg_id, translate(substr(md5(p_partkey::VARCHAR), 1, (1 + p_size % 12)::INT), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, length(translate(substr(md5(p_partkey::VARCHAR), 1, (1 + p_size % 12)::INT), 'x', 'x')) AS len, p_partkey % 3 <> 2 AS on_ref FROM part)",
    "node": "node AS (SELECT k, seg_id, seq, len, on_ref, sum(CASE WHEN on_ref THEN len ELSE 0 END) OVER (ORDER BY k)::BIGINT AS position, CASE WHEN on_ref THEN 0 ELSE len END::BIGINT AS distance, CASE WHEN k = 0 THEN NULL WHEN k % 3 = 0 THEN k - 2 ELSE k - 1 END AS above FROM seg)",
    "step": "step AS (SELECT l_orderkey AS w, o_custkey AS cust, c_nationkey AS nation, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_returnflag) AS i, l_partkey AS k, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)",
    "pair": "pair AS (SELECT * FROM (SELECT w, cust, nation, i, k AS uk, o AS uo, lead(k) OVER (PARTITION BY w ORDER BY i) AS vk, lead(o) OVER (PARTITION BY w ORDER BY i) AS vo FROM step) WHERE vk IS NOT NULL)",
    "named": "named AS (SELECT w, cust, nation, uk || '_' || uo AS u, vk || '_' || vo AS v, vk || '_' || CASE vo WHEN '+' THEN '-' ELSE '+' END AS cu, uk || '_' || CASE uo WHEN '+' THEN '-' ELSE '+' END AS cv FROM pair)",
    "canon": "canon AS (SELECT w, cust, nation, CASE WHEN u < cu OR (u = cu AND v <= cv) THEN u ELSE cu END AS u, CASE WHEN u < cu OR (u = cu AND v <= cv) THEN v ELSE cv END AS v FROM named)",
    "tree": "tree AS (SELECT CASE WHEN a < b OR (a = b AND c <= d) THEN a ELSE b END AS u, CASE WHEN a < b OR (a = b AND c <= d) THEN c ELSE d END AS v FROM (SELECT above || '_+' AS a, k || '_-' AS b, k || '_+' AS c, above || '_-' AS d FROM node WHERE k > 0))",
    "edge0": "edge0 AS (SELECT u, v, sum(n)::BIGINT AS weight, max(t) = 1 AS in_tree FROM (SELECT u, v, count(*) AS n, 0 AS t FROM canon GROUP BY u, v UNION ALL SELECT u, v, 0, 1 FROM tree) GROUP BY u, v)",
    "edge": "edge AS (SELECT *, ('0x' || substr(md5(u || '|' || v), 1, 15))::BIGINT AS idx, left(u, length(u) - 2)::BIGINT AS x, left(v, length(v) - 2)::BIGINT AS y, right(u, 1) AS uo, right(v, 1) AS vo FROM edge0)",
    "lca": "lca AS (SELECT *, CASE WHEN x = y THEN x ELSE least(CASE WHEN x % 3 = 2 THEN x - 1 ELSE x END, CASE WHEN y % 3 = 2 THEN y - 1 ELSE y END) END AS l FROM edge WHERE NOT in_tree)",
    "back": "back AS (SELECT *, (vo = '+' AND l = y) OR (uo = '-' AND l = x) AS is_back FROM lca)",
    "branch": "branch AS (SELECT *, CASE WHEN is_back THEN CASE WHEN l = 0 THEN NULL WHEN l % 3 = 0 THEN l - 2 ELSE l - 1 END ELSE l END AS b FROM back)",
    # forward form: both ends flipped and swapped if both are backward
    "fwd": "fwd AS (SELECT idx, u, v, weight, is_back, b, CASE WHEN uo = '-' AND vo = '-' THEN y ELSE x END AS pu, CASE WHEN uo = '-' AND vo = '-' THEN x ELSE y END AS pv, CASE WHEN uo = '-' AND vo = '+' THEN -1 ELSE 1 END AS du, CASE WHEN uo = '+' AND vo = '-' THEN -1 ELSE 1 END AS dv FROM branch WHERE b IS NOT NULL)",
    "lens": "lens AS (SELECT f.*, nu.position AS u_position, nv.position AS v_position, nu.distance AS u_distance, nv.distance AS v_distance, nv.on_ref AS v_on_ref, nu.position + nu.distance AS u_plen, nv.position + nv.distance AS v_plen, nu.len AS u_len, nv.len AS v_len, nb.position + nb.distance AS b_plen FROM fwd f JOIN node nu ON nu.k = f.pu JOIN node nv ON nv.k = f.pv JOIN node nb ON nb.k = f.b)",
    "var": "var AS (SELECT *, CASE WHEN du = 1 THEN greatest(v_plen - b_plen - CASE WHEN dv = -1 THEN 0 ELSE v_len END, 0) ELSE greatest(u_plen - b_plen - u_len, 0) END AS ref_len, CASE WHEN du = 1 THEN greatest(u_plen - b_plen, 0) ELSE greatest(v_plen - b_plen - CASE WHEN dv = -1 THEN 0 ELSE v_len END, 0) END AS alt_len FROM lens)",
    "typed": "typed AS (SELECT *, CASE WHEN du <> dv THEN 'INV' WHEN is_back THEN 'DUP' WHEN b = pu AND du = 1 THEN 'DEL' WHEN ref_len = 0 THEN 'INS' WHEN alt_len > 0 AND ref_len <> alt_len THEN 'REP' WHEN ref_len = 1 AND alt_len = 1 THEN 'SNP' WHEN ref_len = alt_len THEN 'MNP' END AS vtype, (u_position + 1 - CASE WHEN (ref_len = 0 OR alt_len = 0) AND du = 1 AND v_on_ref THEN 1 ELSE 0 END)::BIGINT AS pos, pu || CASE du WHEN 1 THEN '_+' ELSE '_-' END AS pun, pv || CASE dv WHEN 1 THEN '_+' ELSE '_-' END AS pvn FROM var)",
    "region": "region AS (SELECT n_nationkey AS r, n_nationkey * 900 AS s, n_nationkey * 900 + 500 AS e FROM nation)",
    "bubble": "bubble AS (SELECT p_brand || '/' || (p_partkey // 64) AS bubble, min(n.position) AS s, max(n.position) AS e, min(p_size % 4) AS level FROM part JOIN node n ON n.k = p_partkey GROUP BY ALL)",
    "estep": "estep AS (SELECT user_id AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, event_type) AS i, event_type || CASE WHEN event_id % 4 = 0 THEN '_-' ELSE '_+' END AS n FROM events)",
    "epair": "epair AS (SELECT * FROM (SELECT w, n AS u, lead(n) OVER (PARTITION BY w ORDER BY i) AS v FROM estep) WHERE v IS NOT NULL UNION ALL SELECT -1, t || '_+', lead(t) OVER (ORDER BY t) || '_+' FROM (SELECT DISTINCT event_type AS t FROM events) QUALIFY lead(t) OVER (ORDER BY t) IS NOT NULL)",
    "ecanon": "ecanon AS (SELECT w, CASE WHEN u < cu OR (u = cu AND v <= cv) THEN u ELSE cu END AS u, CASE WHEN u < cu OR (u = cu AND v <= cv) THEN v ELSE cv END AS v FROM (SELECT w, u, v, left(v, length(v) - 1) || CASE right(v, 1) WHEN '+' THEN '-' ELSE '+' END AS cu, left(u, length(u) - 1) || CASE right(u, 1) WHEN '+' THEN '-' ELSE '+' END AS cv FROM epair))",
}
#: Trees and ways that the SQL walks step by step.
CTES |= {
    "near": "near AS (SELECT least(uk, vk) AS a, greatest(uk, vk) AS k, count(*) AS n FROM pair WHERE uk <> vk GROUP BY ALL)",
    "hang": "hang AS (SELECT seg.k, len, t.a FROM seg LEFT JOIN (SELECT k, a FROM near QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, a DESC) = 1) t ON t.k = seg.k)",
    "climb": "climb(k, way, letters) AS (SELECT k, [k], len FROM hang WHERE a IS NULL UNION ALL SELECT h.k, list_append(c.way, h.k), c.letters + h.len FROM climb c JOIN hang h ON h.a = c.k)",
    "ahead": "ahead AS (SELECT DISTINCT CASE WHEN e.uo = '+' THEN e.x ELSE e.y END AS p, CASE WHEN e.uo = '+' THEN e.y ELSE e.x END AS q FROM edge e LEFT JOIN back b ON b.idx = e.idx WHERE e.uo = e.vo AND NOT coalesce(b.is_back, false))",
    "ways": "ways(k, x) AS (SELECT k, k FROM node WHERE NOT on_ref UNION SELECT w.k, a.q FROM ways w JOIN ahead a ON a.p = w.x JOIN node n ON n.k = a.q WHERE NOT n.on_ref)",
}
_RECURSIVE = {"climb", "ways"}
NEEDS = ["seg", "node"], ["step", "pair", "named", "canon"], ["tree", "edge0", "edge"], ["lca", "back", "branch", "fwd", "lens", "var", "typed"]
EDGE = [*NEEDS[0], *NEEDS[1], *NEEDS[2]]
TYPED = [*EDGE, *NEEDS[3]]


def query(sql: str | None = None, ctes: list[str] = []):  # noqa: B006
    """Registers the function under its name, with the SQL after its common tables."""

    def add(f):
        @wraps(f)
        def run(spark, sf_dir):
            """Scratch tables go with the query; where there are any, its rows are written first, since they are read from those tables."""
            with store.scope(spark) as scratch:
                rows = f(spark, sf_dir)
                return store.materialise(rows, f.__name__, keep=True) if scratch else rows

        QUERIES[f.__name__] = run
        if sql:
            word = "WITH RECURSIVE" if any(c in _RECURSIVE for c in ctes) else "WITH"
            SQL[f.__name__] = (f"{word} {', '.join(CTES[c] for c in ctes)} " if ctes else "") + sql
        return run

    return add


def _parts_variants(spark: SparkSession, sf_dir: str):
    graph = A.parts_graph(spark, sf_dir)
    return graph, V.variants(graph)


def _regions(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    n = A.table(spark, sf_dir, "nation")
    start = F.col("n_nationkey").cast("long") * 900 + shift
    return n.select(start.alias("start"), (start + 500).alias("end"))


def _run_of_brand(keys: int):
    """A name per brand and run of so many part keys."""
    return F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / keys).cast("string"))


def _bubbles(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    """A bubble per brand and run of 64 part keys: the range of its parts."""
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("seg_id"), _run_of_brand(64).alias("bubble"), (F.col("p_size") % 4).alias("level"))
    nodes = nodes.where("orient = '+'").select("seg_id", "position")
    return p.join(nodes, "seg_id").groupBy("bubble").agg(F.min("position").alias("start"), F.max("position").alias("end"), F.min("level").alias("level"))


@query("SELECT seg_id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM seg", ["seg"])
def revcomp(spark, sf_dir):
    return A.part_segments(spark, sf_dir).select("seg_id", "seq", C.sequence_complement("seq").alias("rc"))


@query("SELECT w AS walk, list(k || '_' || o ORDER BY i)[1] AS first, list(k || '_' || CASE o WHEN '+' THEN '-' ELSE '+' END ORDER BY i DESC)[1] AS first_back, array_to_string(list(k || '_' || CASE o WHEN '+' THEN '-' ELSE '+' END ORDER BY i DESC), ',') AS complement FROM step GROUP BY w", ["step"])
def walk_complement(spark, sf_dir):
    w = A.order_walks(spark, sf_dir).select(F.col("walk_idx").alias("walk"), "steps", C.walk_complement("steps").alias("c"))
    return w.select("walk", F.get("steps", F.lit(0)).alias("first"), C.node_complement(F.element_at("steps", -1)).alias("first_back"), F.array_join("c", ",").alias("complement"))


@query("SELECT u, v, cu, cv, count(*) AS n FROM named GROUP BY ALL", ["step", "pair", "named"])
def edge_complement(spark, sf_dir):
    p = B.walk_pairs(A.order_walks(spark, sf_dir), "graph_id").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    e = C.edge_complement("u", "v")
    return p.select("u", "v", e["u"].alias("cu"), e["v"].alias("cv"), "n")


@query("SELECT w AS walk, array_to_string(list(k || '_' || o ORDER BY i), ' ') AS steps FROM step GROUP BY w", ["step"])
def gfa_tokenize(spark, sf_dir):
    text = F.array_join(F.transform("steps", C.node_recover), "")
    return A.order_walks(spark, sf_dir).select(F.col("walk_idx").alias("walk"), F.array_join(C.tokenize_walk(text), " ").alias("steps"))


@query("SELECT idx, u, v, weight, in_tree FROM edge", EDGE)
def edge_weights(spark, sf_dir):
    """The weights are counted anew over the walks, against the graph's edges."""
    graph = A.parts_graph(spark, sf_dir)
    return B.edge_weights(graph.edges, graph.walks).select("idx", "u", "v", "weight", "in_tree")


@query("SELECT u, v, count(*) AS weight FROM ecanon GROUP BY u, v", ["estep", "epair", "ecanon"])
def events_edge_weights(spark, sf_dir):
    i = A.event_inputs(spark, sf_dir)
    return B.edge_weights(i["links"], i["walks"]).select("u", "v", "weight")


#: Both readings of each edge.
_READ = "SELECT u, v FROM edge UNION SELECT y || '_' || CASE vo WHEN '+' THEN '-' ELSE '+' END, x || '_' || CASE uo WHEN '+' THEN '-' ELSE '+' END FROM edge"


@query(f"SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT u AS node, 1 AS o, 0 AS i FROM ({_READ}) UNION ALL SELECT v, 0, 1 FROM ({_READ})) GROUP BY node", EDGE)
def degrees(spark, sf_dir):
    return B.degrees(A.parts_graph(spark, sf_dir).edges).select("node", "out_degree", "in_degree")


@query("SELECT u, v, count(*) AS n FROM canon GROUP BY u, v HAVING count(*) > 1", ["step", "pair", "named", "canon"])
def duplicate_links(spark, sf_dir):
    return B.duplicate_links(B.walk_pairs(A.order_walks(spark, sf_dir), "graph_id")).select("u", "v", "n")


@query(
    f"SELECT k || '_+' AS node, 'source' AS kind FROM node WHERE k || '_+' NOT IN (SELECT v FROM ({_READ}) WHERE right(u, 1) = '+' AND right(v, 1) = '+') UNION ALL SELECT k || '_+', 'sink' FROM node WHERE k || '_+' NOT IN (SELECT u FROM ({_READ}) WHERE right(u, 1) = '+' AND right(v, 1) = '+')",
    EDGE,
)
def terminal_sources_sinks(spark, sf_dir):
    g = A.parts_graph(spark, sf_dir)
    return B.terminal_sources_sinks(g.nodes, g.edges).select("node", "kind")


@query("SELECT k || '_+' AS node, position FROM node WHERE on_ref", NEEDS[0])
def ref_positions(spark, sf_dir):
    """By the tour of the tree: the letters of reference parts on the path from the root."""
    return A.parts_labels(spark, sf_dir).join(A.parts_tree(spark, sf_dir).where("ref_len > 0").select("node"), "node", "left_semi").select("node", "position")


@query("SELECT k || '_+' AS node, distance FROM node", NEEDS[0])
def distance_from_ref(spark, sf_dir):
    """By the tour of the tree: the letters of other parts on the path from the root."""
    return A.parts_labels(spark, sf_dir).select("node", "distance")


@query("SELECT d.k || '_+' AS descendant, a.k || '_+' AS node, (SELECT count(*) FROM node x WHERE x.k BETWEEN a.k AND d.k AND (x.on_ref OR x.k = d.k)) - 1 AS steps FROM node d JOIN node a ON a.k BETWEEN greatest(d.k - 12, 0) AND d.k AND (a.on_ref OR a.k = d.k)", NEEDS[0])
def tree_ancestors(spark, sf_dir):
    """From each part up to the part twelve keys before it (the reference part above, if it hangs)."""
    nodes = A.parts_nodes(spark, sf_dir)
    k = F.col("seg_id").cast("long")
    top = F.greatest(k - 12, F.lit(0))
    top = F.when((top % 3 == 2) & (top < k), top - 1).otherwise(top)
    pairs = nodes.where("orient = '+'").select("graph_id", F.concat(top.cast("string"), F.lit("_+")).alias("ancestor"), F.col("node").alias("descendant"))
    return T.tree_paths(nodes, pairs).where(F.expr("cast(left(node, length(node) - 2) as long) >= greatest(cast(left(descendant, length(descendant) - 2) as long) - 12, 0)")).select("descendant", "node", F.col("steps").cast("long").alias("steps"))


@query("SELECT idx, b || '_+' AS branch_point, is_back FROM branch", [*EDGE, "lca", "back", "branch"])
def lca(spark, sf_dir):
    """By range minima over the tour of the tree."""
    edges = A.parts_edges(spark, sf_dir, A.order_walks(spark, sf_dir)).where("not in_tree")
    return T.branch_points(A.parts_labels(spark, sf_dir), edges).select("idx", "branch_point", "is_back")


CTES["box"] = "box AS (SELECT k FROM node WHERE (position >= 3000 AND position < 9000) OR (position = 9000 AND on_ref))"
CTES["low"] = "low AS (SELECT u, v FROM typed WHERE ref_len + alt_len < 40 AND least(u_position, v_position) >= 3000 AND greatest(u_position, v_position) <= 9000), low_both AS (SELECT u, v FROM low UNION SELECT left(v, length(v) - 1) || CASE right(v, 1) WHEN '+' THEN '-' ELSE '+' END, left(u, length(u) - 1) || CASE right(u, 1) WHEN '+' THEN '-' ELSE '+' END FROM low)"
_NEARBY = ["seg", "step", "pair", "near", "hang", "climb"]


@query("SELECT k || '_+' AS node, len(way) - 1 AS depth, row_number() OVER (ORDER BY way) - 1 AS tin, row_number() OVER (ORDER BY way) - 2 + s.n AS tout, letters::BIGINT AS letters FROM climb JOIN (SELECT t, count(*) AS n FROM (SELECT unnest(way) AS t FROM climb) GROUP BY t) s ON s.t = climb.k", _NEARBY)
def tour_labels(spark, sf_dir):
    """Depths, preorder places and letters from the root of the tree of nearby parts, whose shape comes from the orders."""
    return T.tour(A.nearby_tree(spark, sf_dir), {"letters": "len"}, ["k"]).select("node", "depth", "tin", "tout", "letters")


@query("SELECT p.a || '_+' AS a, p.k || '_+' AS b, list_filter(x.way, lambda n: list_contains(y.way, n))[-1] || '_+' AS common FROM near p JOIN climb x ON x.k = p.a JOIN climb y ON y.k = p.k", _NEARBY)
def tree_lca(spark, sf_dir):
    """The lowest part above both of any two parts that stand next to each other on a walk, in the tree of nearby parts."""
    return T.lowest_common(T.tour(A.nearby_tree(spark, sf_dir), order=["k"]), A.nearby_pairs(spark, sf_dir)).select("a", "b", "common")


@query("SELECT k || '_+' AS descendant, unnest(way) || '_+' AS node, len(way) - generate_subscripts(way, 1) AS steps FROM climb", _NEARBY)
def tree_paths(spark, sf_dir):
    """From every part to its root in the tree of nearby parts."""
    labels = T.tour(A.nearby_tree(spark, sf_dir), order=["k"])
    roots = labels.where("depth = 0").select("graph_id", F.col("node").alias("ancestor"), "tin", "tout")
    nodes = labels.select("graph_id", F.col("node").alias("descendant"), F.col("tin").alias("at"))
    pairs = R.range_join(nodes, roots.select("graph_id", "ancestor", F.col("tin").alias("start"), F.col("tout").alias("end")), "at", closed=True, keys=("graph_id",))
    return T.tree_paths(labels, pairs.select("graph_id", "ancestor", "descendant")).select("descendant", "node", "steps")


@query("SELECT row_number() OVER (ORDER BY len(c.way), c.way) - 1 AS line, c.k || '_+' AS node, coalesce(p.line, -1) AS parent_line FROM climb c LEFT JOIN hang h ON h.k = c.k LEFT JOIN (SELECT k, row_number() OVER (ORDER BY len(way), way) - 1 AS line FROM climb) p ON p.k = h.a", _NEARBY)
def tree_order(spark, sf_dir):
    """Lines of the tree of nearby parts, parents first."""
    labels = T.tour(A.nearby_tree(spark, sf_dir), order=["k"])
    return T.tree_lines(labels).select("line", "node", "parent_line")


@query(
    "SELECT k || '_+' AS node, position AS right_position FROM node WHERE on_ref UNION ALL SELECT w.k || '_+', coalesce(min(n.position), -1) FROM ways w LEFT JOIN ahead a ON a.p = w.x LEFT JOIN node n ON n.k = a.q AND n.on_ref GROUP BY w.k",
    [*EDGE, "lca", "back", "ahead", "ways"],
)
def right_positions(spark, sf_dir):
    """Of parts off the reference, the least position of a reference part that a way ahead reaches; -1 where none does."""
    return H.right_positions(A.parts_graph(spark, sf_dir)).select("node", F.coalesce("right_position", F.lit(-1)).cast("long").alias("right_position"))


@query("SELECT idx, vtype = 'DUP' AS back, vtype = 'DEL' AS forward, coalesce(vtype, '') IN ('', 'INS', 'REP', 'SNP', 'MNP') AS crossing FROM typed", TYPED)
def back_forward_cross(spark, sf_dir):
    _, v = _parts_variants(spark, sf_dir)
    return v.select("idx", (F.col("vtype") == "DUP").alias("back"), (F.col("vtype") == "DEL").alias("forward"), F.coalesce("vtype", F.lit("")).isin("", "INS", "REP", "SNP", "MNP").alias("crossing"))


@query("SELECT idx, vtype FROM typed", TYPED)
def variant_types(spark, sf_dir):
    return _parts_variants(spark, sf_dir)[1].select("idx", "vtype")


@query("SELECT idx, (ref_len + alt_len)::BIGINT AS allele_length FROM typed", TYPED)
def allele_length(spark, sf_dir):
    return V.allele_lengths(A.parts_graph(spark, sf_dir)).select("idx", "allele_length")


@query("SELECT idx, pos FROM typed", TYPED)
def vcf_position(spark, sf_dir):
    return _parts_variants(spark, sf_dir)[1].select("idx", V.vcf_position().cast("long").alias("pos"))


_TREE_INTO = "(SELECT k, e.weight AS rc, e.idx AS ref_idx FROM node JOIN (SELECT weight, idx, greatest(x, y) AS t FROM edge WHERE in_tree) e ON e.t = node.k)"


@query(f"SELECT typed.idx, r.rc, typed.weight AS ac FROM typed LEFT JOIN {_TREE_INTO} r ON r.k = typed.pv", TYPED)
def allele_counts(spark, sf_dir):
    g, v = _parts_variants(spark, sf_dir)
    return V.allele_counts(g, v).select("idx", "rc", "ac")


_COUNTS = "count(*) FILTER (vtype = 'INV') AS inversion, count(*) FILTER (vtype = 'REP') AS replacement, count(*) FILTER (vtype = 'INS') AS insertion, count(*) FILTER (vtype = 'SNP') AS snps, count(*) FILTER (vtype = 'MNP') AS mnps, count(*) FILTER (vtype IS NULL OR vtype IN ('INS', 'REP', 'SNP', 'MNP')) AS crossing_edges, count(*) FILTER (vtype = 'DUP') AS back_edges, count(*) FILTER (vtype = 'DEL') AS forward_edges, count(*) AS total"


@query(f"SELECT {_COUNTS} FROM typed", TYPED)
def variant_summary(spark, sf_dir):
    return V.variant_summary(_parts_variants(spark, sf_dir)[1]).drop("graph_id")


@query(" UNION ALL ".join(f"SELECT '{a}' AS type, {b} AS count FROM (SELECT {_COUNTS} FROM typed)" for a, b in V.SUMMARY_ROWS), TYPED)
def variant_summary_table(spark, sf_dir):
    return V.summary_table(V.variant_summary(_parts_variants(spark, sf_dir)[1])).drop("graph_id")


@query("SELECT row_number() OVER (ORDER BY pos, u_distance, v_distance, pun, pvn) - 1 AS rank, idx FROM typed", TYPED)
def sorted_variants(spark, sf_dir):
    v = _parts_variants(spark, sf_dir)[1].select("graph_id", "idx", "ref_len", "alt_len", "du", "pu", "pv", "u_position", "u_distance", "v_distance", "v_on_ref")
    return V.rank_of(v).select(F.col("rank").cast("long").alias("rank"), "idx")


@query(
    "SELECT w AS walk, e.idx, CASE WHEN NOT e.in_tree THEN 'alt' ELSE 'ref' END AS kind, count(*) AS n FROM canon c JOIN edge e ON c.u = e.u AND c.v = e.v WHERE NOT e.in_tree OR greatest(e.x, e.y) IN (SELECT pv FROM typed) GROUP BY ALL",
    TYPED,
)
def genotype_counts(spark, sf_dir):
    return G.genotype(A.parts_graph(spark, sf_dir), strict=False).select(F.col("walk_idx").alias("walk"), "idx", "kind", "n")


@query("SELECT cust AS hap, e.idx, count(*) AS n FROM canon c JOIN edge e ON c.u = e.u AND c.v = e.v WHERE NOT e.in_tree GROUP BY ALL", EDGE)
def haplotype_counts(spark, sf_dir):
    g = G.by_haplotype(G.genotype(A.parts_graph(spark, sf_dir), strict=False)).where("kind = 'alt'")
    return g.select(F.col("hap").cast("long").alias("hap"), "idx", "n")


@query("SELECT c.w AS walk, min(least(a.position, b.position)) AS low, max(greatest(a.position, b.position)) AS high FROM pair c JOIN node a ON a.k = uk JOIN node b ON b.k = vk GROUP BY c.w", [*NEEDS[0], "step", "pair"])
def linear_coverage(spark, sf_dir):
    return G.linear_coverage(A.parts_graph(spark, sf_dir, False), False, ("graph_id", "walk_idx")).select(F.col("walk_idx").alias("walk"), "low", "high")


@query("SELECT DISTINCT idx FROM typed WHERE least(u_position, v_position) < 9000 AND greatest(u_position, v_position) >= 3000", TYPED)
def interval_variants(spark, sf_dir):
    return V.interval_variants(_parts_variants(spark, sf_dir)[1], 3000, 9000).select("idx")


@query("SELECT idx FROM typed WHERE EXISTS (SELECT 1 FROM region WHERE u_position >= s AND u_position < e)", [*TYPED, "region"])
def variants_in_region(spark, sf_dir):
    return R.variants_in_regions(_parts_variants(spark, sf_dir)[1], _regions(spark, sf_dir)).select("idx")


@query("SELECT idx FROM typed WHERE NOT EXISTS (SELECT 1 FROM region WHERE u_position >= s AND u_position < e)", [*TYPED, "region"])
def variants_outside_region(spark, sf_dir):
    return R.variants_outside_regions(_parts_variants(spark, sf_dir)[1], _regions(spark, sf_dir)).select("idx")


@query("SELECT idx FROM typed WHERE NOT EXISTS (SELECT 1 FROM region WHERE (u_position >= s AND u_position < e) OR (u_position >= s + 300 AND u_position < e + 300))", [*TYPED, "region"])
def variant_outliers(spark, sf_dir):
    return R.variant_outliers(_parts_variants(spark, sf_dir)[1], [_regions(spark, sf_dir), _regions(spark, sf_dir, 300)]).select("idx")


@query(f"SELECT {_COUNTS} FROM typed WHERE EXISTS (SELECT 1 FROM region WHERE u_position >= s AND u_position < e)", [*TYPED, "region"])
def summary_by_region(spark, sf_dir):
    return R.summary_by_region(_parts_variants(spark, sf_dir)[1], _regions(spark, sf_dir)).drop("graph_id")


@query("SELECT k || o AS node, bubble FROM node, (VALUES ('_+'), ('_-')) t(o), bubble WHERE position BETWEEN s AND e", [*NEEDS[0], "bubble"])
def node_partition(spark, sf_dir):
    nodes = A.parts_nodes(spark, sf_dir)
    return R.node_partition(nodes, _bubbles(spark, sf_dir, nodes), 1 << 10)


CTES["inside"] = "inside AS (SELECT a.bubble, arg_max(b.bubble, b.place) AS parent FROM placed a JOIN placed b ON b.place < a.place AND b.e >= a.e GROUP BY a.bubble)"
CTES["placed"] = "placed AS (SELECT bubble, s, e, row_number() OVER (ORDER BY s, e DESC, bubble) - 1 AS place FROM bubble)"
CTES["deep"] = "deep(bubble, level) AS (SELECT bubble, 0 FROM placed WHERE bubble NOT IN (SELECT bubble FROM inside) UNION ALL SELECT i.bubble, d.level + 1 FROM deep d JOIN inside i ON i.parent = d.bubble)"
_RECURSIVE |= {"deep"}


@query("SELECT p.bubble, p.place, i.parent, d.level::BIGINT AS level FROM placed p JOIN deep d ON d.bubble = p.bubble LEFT JOIN inside i ON i.bubble = p.bubble", [*NEEDS[0], "bubble", "placed", "inside", "deep"])
def bubble_nesting(spark, sf_dir):
    """Bubbles in the order of the reference, and which stands in which."""
    return N.nesting(_bubbles(spark, sf_dir, A.parts_nodes(spark, sf_dir)))


def _brand_partition(spark, sf_dir) -> DataFrame:
    """A part's nodes lie in the bubble of its brand and in the one of its brand and size class."""
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("seg"), F.explode(F.array(F.col("p_brand"), F.concat("p_brand", F.lit("/"), (F.col("p_size") % 2).cast("string")))).alias("bubble"))
    return p.select(F.explode(F.array(F.concat("seg", F.lit("_+")), F.concat("seg", F.lit("_-")))).alias("node"), "bubble")


_BRAND = "bp AS (SELECT p_partkey AS k, p_brand AS bubble FROM part UNION ALL SELECT p_partkey, p_brand || '/' || (p_size % 2) FROM part), e2 AS (SELECT DISTINCT typed.idx, bubble, bp.k, CASE WHEN pu = pv THEN 1 ELSE 2 END AS need FROM typed JOIN bp ON bp.k IN (pu, pv)), h AS (SELECT idx, bubble, count(*) AS n, max(need) AS need FROM e2 GROUP BY idx, bubble), f AS (SELECT idx, bubble, true AS within FROM h WHERE n = need UNION ALL SELECT idx, bubble, false FROM h WHERE n < need AND idx NOT IN (SELECT idx FROM h WHERE n = need))"
CTES["brand"] = _BRAND


@query("SELECT bubble, idx, within FROM f", [*TYPED, "brand"])
def bubble_within_crossing(spark, sf_dir):
    return R.bubble_variants(_segment_ends(V.variant_names(A.parts_graph(spark, sf_dir))), _brand_partition(spark, sf_dir))


def _segment_ends(v: DataFrame) -> DataFrame:
    """Variants by their segments' forward nodes."""
    plus = lambda c: F.concat(F.left(c, F.length(c) - 1), F.lit("+"))
    return v.select("idx", plus("u").alias("u"), plus("v").alias("v"))


@query("SELECT b.bubble, 0 AS level, count(idx) AS total_count, count(*) FILTER (within) AS within_count, count(*) FILTER (NOT within) AS crossing_count, coalesce(string_agg(idx::VARCHAR, ',' ORDER BY idx::VARCHAR) FILTER (within), '') AS within, coalesce(string_agg(idx::VARCHAR, ',' ORDER BY idx::VARCHAR) FILTER (NOT within), '') AS crossing FROM (SELECT DISTINCT bubble FROM bp) b LEFT JOIN f ON f.bubble = b.bubble GROUP BY b.bubble", [*TYPED, "brand"])
def bubble_summary(spark, sf_dir):
    v = _segment_ends(V.variant_names(A.parts_graph(spark, sf_dir)))
    part = _brand_partition(spark, sf_dir)
    return R.bubble_summary(part.select("bubble", F.lit(0).alias("level")), R.bubble_variants(v, part))


@query("SELECT level, count(*) AS count FROM bubble GROUP BY level", [*NEEDS[0], "bubble"])
def level_summary(spark, sf_dir):
    return R.level_summary(_bubbles(spark, sf_dir, A.parts_nodes(spark, sf_dir)))


@query("SELECT bubble, level, s AS pos, a.n FROM bubble LEFT JOIN (SELECT p_brand || '/' || (p_partkey // 128) AS brand, count(*) AS n FROM part GROUP BY ALL) a ON a.brand = bubble WHERE level = 0 AND s BETWEEN 0 AND 100000", [*NEEDS[0], "bubble"])
def combined_info(spark, sf_dir):
    vcf = _bubbles(spark, sf_dir, A.parts_nodes(spark, sf_dir)).select("bubble", F.col("start").alias("pos"), F.create_map(F.lit("Level"), F.col("level").cast("string")).alias("info"))
    snarls = A.table(spark, sf_dir, "part").groupBy(_run_of_brand(128).alias("bubble")).agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(None).cast("int"))
    return R.combined_info(vcf, snarls, 0, 0, 100000).select("bubble", "level", "pos", "n")


@query("SELECT event_id, 'user=' || user_id || ';type=' || event_type || ';flag' AS info, user_id::VARCHAR AS usr, event_type AS type FROM events")
def info_map(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(";type="), "event_type", F.lit(";flag")).alias("info"))
    m = C.info_map("info")
    return e.select("event_id", "info", m.getItem("user").alias("usr"), m.getItem("type").alias("type"))


@query("SELECT a.k AS k, length(a.seq) + length(b.seq) >= 8 AND levenshtein(a.seq, b.seq) <= 1 AS near FROM seg a JOIN seg b ON b.k = a.k + 1", ["seg"])
def nearly_identical(spark, sf_dir):
    s = A.part_segments(spark, sf_dir)
    b = s.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("seq").alias("other"))
    return s.join(b, "p_partkey").select(F.col("p_partkey").alias("k"), C.nearly_identical("seq", "other", 4).alias("near"))


@query("SELECT k, CASE WHEN s LIKE '%N%' THEN NULL ELSE left(s, (SELECT min(d) FROM range(1, 80) r(d) WHERE d <= length(s) AND length(s) % d = 0 AND repeat(left(s, d), (length(s) // d)::INT) = s)) END AS motif FROM (SELECT k, repeat(left(seq, 3), (1 + k % 5)::INT) AS s FROM seg)", ["seg"])
def repeat_motif(spark, sf_dir):
    s = A.part_segments(spark, sf_dir)
    return s.select(F.col("p_partkey").alias("k"), C.repeat_motif(F.expr("repeat(left(seq, 3), int(1 + p_partkey % 5))")).alias("motif"))


@query("SELECT t || '_+' AS node, 1 AS direction, CASE WHEN row_number() OVER (ORDER BY t) = 1 THEN '+_terminus_+' ELSE lag(t) OVER (ORDER BY t) || '_+' END AS parent, row_number() OVER (ORDER BY t) AS depth, sum(1 + length(t) % 3) OVER (ORDER BY t)::BIGINT AS position, sum(1 + length(t) % 3) OVER (ORDER BY t)::BIGINT AS right_position FROM (SELECT DISTINCT event_type AS t FROM events)")
def reference_tree(spark, sf_dir):
    """The search itself, on the events graph: its reference walk visits all segments, so directions, tree and positions are known."""
    n = A.events_graph(spark, sf_dir).nodes.where("direction = 1 and seg_id not like '%terminus'")
    return n.select("node", F.col("direction").cast("int").alias("direction"), "parent", F.col("depth").cast("long").alias("depth"), "position", "right_position")


@query("SELECT w AS walk, e.idx, count(*) AS n FROM canon c JOIN edge e ON c.u = e.u AND c.v = e.v GROUP BY ALL", EDGE)
def parts_edge_visits(spark, sf_dir):
    """Every edge's visits by each order, from its visits of variants and its first and last part alone."""
    g = A.parts_graph(spark, sf_dir)
    counts = G.genotype(g, strict=False).where("kind = 'alt'").select("graph_id", "walk_idx", "idx", "n")
    bounds = g.walks.select("graph_id", "walk_idx", F.element_at("steps", 1).alias("first"), F.element_at("steps", -1).alias("last"))
    return G.edge_visits(g, counts, "graph_id", "walk_idx", bounds=bounds).select(F.col("walk_idx").alias("walk"), "idx", "n")


def _covered(spark, sf_dir, with_edges=False):
    """The parts graph, and what each order covers."""
    g = A.parts_graph(spark, sf_dir, with_edges)
    return g, G.linear_coverage(g, strict=False)


CTES["cover"] = "cover AS (SELECT c.w, c.nation, c.cust, min(least(a.position, b.position)) AS low, max(greatest(a.position, b.position)) AS high FROM pair c JOIN node a ON a.k = uk JOIN node b ON b.k = vk GROUP BY ALL)"
CTES["gap"] = """gap AS (SELECT s.nation, s.cust, s.p AS start, t.p AS stop
 FROM (SELECT nation, cust, p, row_number() OVER (PARTITION BY cust ORDER BY p) AS i FROM (SELECT nation, cust, high AS p FROM cover UNION ALL SELECT DISTINCT nation, cust, 0 FROM cover)) s
 JOIN (SELECT cust, p, row_number() OVER (PARTITION BY cust ORDER BY p) AS i FROM (SELECT cust, low AS p FROM cover UNION ALL SELECT DISTINCT cust, (SELECT max(position) FROM node) FROM cover)) t ON s.cust = t.cust AND s.i = t.i WHERE s.p <= t.p)"""


@query("SELECT nation::VARCHAR AS sample, min(low) AS low, max(high) AS high FROM cover GROUP BY nation", [*NEEDS[0], "step", "pair", "cover"])
def sample_coverage(spark, sf_dir):
    return G.linear_coverage(A.parts_graph(spark, sf_dir, False), False, ("graph_id", "sample")).select("sample", "low", "high")


def _reference_ends(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id").agg(F.lit(0).cast("long").alias("first"), F.max("position").alias("last"))


@query("SELECT nation::VARCHAR AS sample, cust::VARCHAR AS hap, start, stop AS end FROM gap", [*NEEDS[0], "step", "pair", "cover", "gap"])
def coverage_gaps(spark, sf_dir):
    g, cover = _covered(spark, sf_dir)
    return G.coverage_gaps(g, cover, _reference_ends(g.nodes)).select("sample", "hap", "start", "end")


@query("SELECT DISTINCT nation::VARCHAR AS sample, cust::VARCHAR AS hap, idx FROM typed JOIN gap ON least(u_position, v_position) BETWEEN start AND stop AND greatest(u_position, v_position) <= stop", [*TYPED, "cover", "gap"])
def missing_by_haplotype(spark, sf_dir):
    """Variants that lie where no order of a customer covers the reference."""
    g, cover = _covered(spark, sf_dir, True)
    return G.missing_variants(g, cover, V.variants(g), _reference_ends(g.nodes)).select("sample", "hap", "idx")


@query("SELECT (SELECT count(*) FROM node) AS binodes, (SELECT count(*) FROM edge) AS biedges", EDGE)
def graph_counts(spark, sf_dir):
    return B.graph_counts(A.parts_graph(spark, sf_dir)).select("binodes", "biedges")


@query("SELECT row_number() OVER (ORDER BY position, on_ref DESC, distance, k || '_+') - 1 AS place, k || '_+' AS node FROM node", NEEDS[0])
def nodes_by_position(spark, sf_dir):
    return B.nodes_by_position(A.parts_nodes(spark, sf_dir)).select("place", "node")


@query("SELECT bubble, a, b, least(x.position, y.position) AS start, greatest(x.position, y.position) AS end FROM (SELECT p_brand AS bubble, max(p_partkey) AS a, min(p_partkey) AS b FROM part GROUP BY p_brand) z JOIN node x ON x.k = a JOIN node y ON y.k = b", NEEDS[0])
def bubble_positions(spark, sf_dir):
    """Where the bubble between a brand's last and first part lies."""
    ends = A.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("bubble")).agg(F.max("p_partkey").cast("string").alias("a"), F.min("p_partkey").cast("string").alias("b"))
    found = R.bubbles_with_positions(ends, A.parts_nodes(spark, sf_dir).where("orient = '+'").select("seg_id", "position"))
    return found.select("bubble", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "start", "end")


@query(
    f"SELECT u, v FROM ({_READ}) r WHERE left(u, length(u) - 2)::BIGINT IN (SELECT k FROM box) AND left(v, length(v) - 2)::BIGINT IN (SELECT k FROM box) EXCEPT SELECT u, v FROM low_both",
    [*TYPED, "box", "low"],
)
def delete_small_in_range(spark, sf_dir):
    """Small variants between two places of the reference are deleted, and only that part of the graph is kept."""
    return S.delete_small_variants(A.parts_graph(spark, sf_dir), (3000, 9000), 40)[1].select("u", "v")


_GT = {c: f"string_agg({c}, '{m}' ORDER BY hap)" for c, m in (("gt", "|"), ("cr", ","), ("ca", ","))}
CTES["home"] = "home AS (SELECT n_nationkey AS nation, n_regionkey::VARCHAR AS sample FROM nation)"
CTES["seen"] = "seen AS (SELECT h.sample, 1 + c.cust % 2 AS hap, min(least(a.position, b.position)) AS low, max(greatest(a.position, b.position)) AS high FROM pair c JOIN home h ON h.nation = c.nation JOIN node a ON a.k = uk JOIN node b ON b.k = vk GROUP BY c.w, h.sample, c.cust)"
CTES["open"] = """open AS (SELECT s.sample, s.hap, s.p AS start, t.p AS stop
 FROM (SELECT *, row_number() OVER (PARTITION BY sample, hap ORDER BY p) AS i FROM (SELECT sample, hap, high AS p FROM seen UNION ALL SELECT DISTINCT sample, hap, 0 FROM seen)) s
 JOIN (SELECT *, row_number() OVER (PARTITION BY sample, hap ORDER BY p) AS i FROM (SELECT sample, hap, low AS p FROM seen UNION ALL SELECT DISTINCT sample, hap, (SELECT max(position) FROM node) FROM seen)) t ON s.sample = t.sample AND s.hap = t.hap AND s.i = t.i WHERE s.p <= t.p)"""
CTES["lost"] = "lost AS (SELECT DISTINCT sample, hap, idx FROM typed JOIN open ON least(u_position, v_position) BETWEEN start AND stop AND greatest(u_position, v_position) <= stop)"
CTES["took"] = "took AS (SELECT sample, 1 + cust % 2 AS hap, e.idx, e.in_tree, greatest(e.x, e.y) AS k, count(*) AS n FROM canon c JOIN home h ON h.nation = c.nation JOIN edge e ON c.u = e.u AND c.v = e.v GROUP BY ALL)"
CTES["cell"] = """cell AS (SELECT t.idx, s.sample, s.hap, coalesce(vtype = 'INV', false) AS inv, l.idx IS NULL AS known, coalesce(a.n, 0) AS an, coalesce(r.n, 0) AS rn
 FROM typed t CROSS JOIN (SELECT DISTINCT sample, 1 + c_custkey % 2 AS hap FROM orders JOIN customer ON o_custkey = c_custkey JOIN home ON nation = c_nationkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) s
 LEFT JOIN lost l ON l.sample = s.sample AND l.hap = s.hap AND l.idx = t.idx
 LEFT JOIN took a ON a.sample = s.sample AND a.hap = s.hap AND a.idx = t.idx LEFT JOIN took r ON r.in_tree AND r.sample = s.sample AND r.hap = s.hap AND r.k = t.pv)"""
CTES["text"] = "text AS (SELECT idx, sample, hap, CASE WHEN known AND (inv OR rn <> 0 OR an <> 0) THEN (an > 0)::INT::VARCHAR ELSE '.' END AS gt, CASE WHEN known AND NOT inv THEN rn::VARCHAR ELSE '.' END AS cr, CASE WHEN known THEN an::VARCHAR ELSE '.' END AS ca FROM cell)"


@query(f"SELECT idx, sample, {_GT['gt']} || ':' || {_GT['cr']} || ':' || {_GT['ca']} AS field FROM text GROUP BY idx, sample", [*TYPED, "home", "seen", "open", "lost", "took", "cell", "text"])
def region_fields(spark, sf_dir):
    """GT:CR:CA of every variant of the parts graph and every region of the world; customers with even and odd keys are its two haplotypes."""
    g = A.parts_graph(spark, sf_dir)
    home = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("sample"), F.col("n_regionkey").cast("string").alias("region"))
    walks = g.walks.join(home, "sample").withColumns({"sample": F.col("region"), "hap": (1 + F.col("hap").cast("long") % 2).cast("string")}).select(g.walks.columns)
    return G.sample_fields(g.but(walks=walks), None, False, _reference_ends(g.nodes)).select("idx", "sample", "field")


def _written_gfa(spark, sf_dir):
    """The parts graph's segments, links and walks, written as GFA text and read again."""
    walks = store.materialise(A.order_walks(spark, sf_dir), "walks")
    path = store.scratch_path(spark, "gfa")
    K.write_source_gfa(A.part_segments(spark, sf_dir), A.parts_edges(spark, sf_dir, walks), walks, path)
    return gfa.read_gfa(spark, path, graph_id="parts")


@query("SELECT k::VARCHAR AS seg_id, seq FROM seg", ["seg"])
def gfa_segments(spark, sf_dir):
    return _written_gfa(spark, sf_dir)["segments"].select("seg_id", "seq")


@query("SELECT u, v, weight FROM edge", EDGE)
def gfa_weights(spark, sf_dir):
    """The weights of the links of a GFA text by its walks."""
    tables = _written_gfa(spark, sf_dir)
    return B.edge_weights(tables["links"], tables["walks"]).select("u", "v", "weight")


_TAB = "chr(9)"
_SIDES = "left(u, length(u) - 2) || chr(9) || right(u, 1) || chr(9) || left(v, length(v) - 2) || chr(9) || right(v, 1) || chr(9) || '0M'"


@query(f"SELECT 'S' || {_TAB} || k || {_TAB} || seq AS value FROM node UNION ALL SELECT 'S' || {_TAB} || k || {_TAB} || reverse(translate(seq, 'ACGT', 'TGCA')) FROM node UNION ALL SELECT 'L' || {_TAB} || {_SIDES} FROM ({_READ})", EDGE)
def gfa_text(spark, sf_dir):
    return K.gfa_lines(A.parts_graph(spark, sf_dir)).select("value")


@query(f"SELECT 'S' || {_TAB} || k || {_TAB} || seq AS value FROM node UNION ALL SELECT 'L' || {_TAB} || above || {_TAB} || '+' || {_TAB} || k || {_TAB} || '+' || {_TAB} || '0M' FROM node WHERE k > 0", NEEDS[0])
def tree_gfa(spark, sf_dir):
    return K.gfa_lines(A.parts_graph(spark, sf_dir), True).select("value")


CTES["et"] = "et AS (SELECT t, row_number() OVER (ORDER BY t) AS r, translate(substr(md5(t), 1, (1 + length(t) % 3)::INT), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM (SELECT DISTINCT event_type AS t FROM events))"
CTES["eedge"] = "eedge AS (SELECT u, v, count(*) AS weight, row_number() OVER (ORDER BY u, v) - 1 AS idx, (SELECT r FROM et WHERE t = left(u, length(u) - 2)) AS x, (SELECT r FROM et WHERE t = left(v, length(v) - 2)) AS y, right(u, 1) AS uo, right(v, 1) AS vo FROM ecanon GROUP BY u, v)"
CTES["evar"] = "evar AS (SELECT *, CASE WHEN uo = '-' AND vo = '-' THEN y ELSE x END AS pu, CASE WHEN uo = '-' AND vo = '-' THEN x ELSE y END AS pv, CASE WHEN uo = '-' AND vo = '+' THEN -1 ELSE 1 END AS du, CASE WHEN uo = '+' AND vo = '-' THEN -1 ELSE 1 END AS dv, least(x, y) AS l, (vo = '+' AND least(x, y) = y) OR (uo = '-' AND least(x, y) = x) AS is_back FROM eedge WHERE NOT ((uo = vo AND uo = '+' AND y = x + 1) OR (uo = vo AND uo = '-' AND x = y + 1)))"
CTES["ebr"] = "ebr AS (SELECT *, CASE WHEN is_back THEN l - 1 ELSE l END AS b FROM evar)"
CTES["eall"] = "eall AS (SELECT idx, weight, b, du, dv, pu, pv, is_back, coalesce((SELECT string_agg(seq, '' ORDER BY r) FROM et WHERE r > b AND CASE WHEN du = 1 THEN (r < pv OR (dv = -1 AND r = pv)) ELSE r < pu END), '') AS f, coalesce((SELECT string_agg(seq, '' ORDER BY r) FROM et WHERE r > b AND CASE WHEN du = 1 THEN r <= pu ELSE (r < pv OR (dv = -1 AND r = pv)) END), '') AS a FROM ebr WHERE b > 0)"
_EVENTS = ["estep", "epair", "ecanon", "et", "eedge", "evar", "ebr", "eall"]
_REF, _ALT = ("CASE WHEN du = 1 THEN {0} ELSE reverse(translate({0}, 'ACGT', 'TGCA')) END".format(c) for c in "fa")  # noqa: UP032


@query(f"SELECT idx, {_REF} AS ref, {_ALT} AS alt FROM eall", _EVENTS)
def alleles(spark, sf_dir):
    g = A.events_graph(spark, sf_dir)
    return V.alleles(g, V.variants(g)).select("idx", "ref", "alt")


@query("SELECT idx FROM ebr WHERE b > 0", [*_EVENTS[:-1]])
def variants_without_termini(spark, sf_dir):
    return R.without_termini(V.variants(A.events_graph(spark, sf_dir), False)).select("idx")


@query()
def vcf(spark, sf_dir):
    """The whole VCF's records, genotypes included."""
    g = A.events_graph(spark, sf_dir)
    return K.vcf_lines(g, "events")[1].select(F.col("rank").cast("long").alias("rank"), "value")


@query("SELECT u, v, w AS walk, count(*) AS n FROM ecanon WHERE w >= 0 GROUP BY ALL", ["estep", "epair", "ecanon"])
def edge_visits(spark, sf_dir):
    """Every edge's visits by each walk, from its visits of variants alone; edges of termini left out."""
    g = A.events_graph(spark, sf_dir)
    counts = G.genotype(g).where("kind = 'alt'").select("graph_id", "walk_idx", "idx", "n")
    found = G.edge_visits(g, counts, "graph_id", "walk_idx").join(g.edges.where("u not like '%terminus%' and v not like '%terminus%'"), ["graph_id", "idx"])
    return found.where("walk_idx >= 0").select("u", "v", F.col("walk_idx").alias("walk"), "n")


@query()
def gt_strings(spark, sf_dir):
    g = A.events_graph(spark, sf_dir)
    return G.sample_fields(g, V.variants(g)).select("idx", "sample", "field")


@query()
def missing_variants(spark, sf_dir):
    g = A.events_graph(spark, sf_dir)
    return G.missing_variants(g, G.linear_coverage(g), V.variants(g)).select("sample", "hap", "idx")


@query()
def missing_inversions(spark, sf_dir):
    g = A.events_graph(spark, sf_dir)
    return V.missing_inversions(g, V.alleles(g, V.variants(g)), 2).select("idx", "alt")


@query()
def variant_motifs(spark, sf_dir):
    g = A.events_graph(spark, sf_dir)
    return V.with_motif(g, V.alleles(g, V.variants(g))).select("idx", "motif")


CTES["small"] = "small AS (SELECT u, v FROM typed WHERE ref_len + alt_len < 40), small_both AS (SELECT u, v FROM small UNION SELECT left(v, length(v) - 1) || CASE right(v, 1) WHEN '+' THEN '-' ELSE '+' END, left(u, length(u) - 1) || CASE right(u, 1) WHEN '+' THEN '-' ELSE '+' END FROM small)"


@query(f"SELECT u, v FROM ({_READ}) EXCEPT SELECT u, v FROM small_both", [*TYPED, "small"])
def delete_small(spark, sf_dir):
    return S.delete_small_variants(A.parts_graph(spark, sf_dir), None, 40)[1].select("u", "v")


def _tree_only(spark, sf_dir):
    """The parts graph with its tree edges alone: parts that hang are tips, the reference is one path."""
    g = A.parts_graph(spark, sf_dir)
    e = B.both_readings(g.edges.where("in_tree").select("graph_id", "idx", "u", "v")).select("graph_id", "u", "v")
    last = g.nodes.where("on_ref").agg(F.max(F.col("seg_id").cast("long")).alias("k"))
    ends = last.select(F.lit("parts").alias("graph_id"), F.explode(F.array(F.lit(0).cast("long"), F.col("k"))).alias("k")).select("graph_id", F.explode(F.array(F.concat(F.col("k").cast("string"), F.lit("_+")), F.concat(F.col("k").cast("string"), F.lit("_-")))).alias("node"))
    materialise = store.materialise
    return materialise(g.nodes.select("graph_id", "node", "seq", "direction"), "nodes"), materialise(e, "edges"), materialise(ends, "ends")


@query("SELECT k || o AS node FROM seg, (VALUES ('_+'), ('_-')) t(o) WHERE on_ref", ["seg"])
def tips(spark, sf_dir):
    nodes, e, ends = _tree_only(spark, sf_dir)
    return S.delete_tips(nodes, e, ends)[0].select("node")


@query("WITH " + CTES["seg"] + " SELECT k || '_+' AS node, seq FROM (SELECT (SELECT min(k) FROM seg WHERE on_ref) AS k, (SELECT string_agg(seq, '' ORDER BY k) FROM seg WHERE on_ref AND k < (SELECT max(k) FROM seg WHERE on_ref)) AS seq UNION ALL SELECT (SELECT max(k) FROM seg WHERE on_ref), (SELECT seq FROM seg WHERE on_ref ORDER BY k DESC LIMIT 1))")
def contract(spark, sf_dir):
    nodes, e, ends = _tree_only(spark, sf_dir)
    nodes, e = S.delete_tips(nodes, e, ends)
    return S.contract_paths(store.materialise(nodes, "nodes"), store.materialise(e, "edges"), ends)[0].where("node like '%+'").select("node", "seq")


@query()
def triallelic(spark, sf_dir):
    """Bubbles between the ends of the events graph's forward variants, two and two."""
    g = A.events_graph(spark, sf_dir)
    v = V.variants(g).where("du = dv").select("graph_id", "idx", "branch_point", "pv")
    two = v.alias("a").join(v.alias("b"), (F.col("a.branch_point") == F.col("b.branch_point")) & (F.col("a.idx") < F.col("b.idx")))
    b = two.select("a.graph_id", F.concat_ws("-", F.col("a.idx").cast("string"), F.col("b.idx").cast("string")).alias("bubble"), C.segment_of("a.branch_point").alias("a"), C.segment_of("b.pv").alias("b"), F.array("a.idx", "b.idx").alias("idx"))
    d = B.degrees(g.edges.where("u not like '%terminus%' and v not like '%terminus%'"))
    small = d.where("out_degree <= 3").select(F.col("node").alias("s")), d.where("in_degree <= 3").select(F.col("node").alias("t"))
    b = b.join(small[0], F.concat("a", F.lit("_+")) == F.col("s"), "left_semi").join(small[1], F.concat("b", F.lit("_+")) == F.col("t"), "left_semi")
    return R.triallelic_class(g, b).select("bubble", "class")


@query("SELECT row_number() OVER (ORDER BY r) AS line, t || '_+' AS node, row_number() OVER (ORDER BY r) - 1 AS parent_line, seq FROM et", ["et"])
def tree_file(spark, sf_dir):
    t = K.tree_lines(A.events_graph(spark, sf_dir)).where("node not like '%terminus%'")
    return t.select(F.col("line").cast("long").alias("line"), "node", F.col("parent_line").cast("long").alias("parent_line"), "seq")


@query("SELECT k || o AS node, CASE o WHEN '_+' THEN 1 ELSE -1 END AS direction, position, position AS right_position, distance AS distance_from_reference, on_ref::INT AS on_reference_path FROM node, (VALUES ('_+'), ('_-')) t(o)", NEEDS[0])
def nodeinfo(spark, sf_dir):
    return K.nodeinfo(A.toured_parts_graph(spark, sf_dir)).withColumn("direction", F.col("direction").cast("int"))


@query("SELECT e.idx AS index, e.weight, e.in_tree::INT AS is_in_tree, coalesce(b.b || '_+', '0') AS branch_point, coalesce(b.is_back, false)::INT AS is_back_edge FROM edge e LEFT JOIN branch b ON b.idx = e.idx", [*EDGE, "lca", "back", "branch"])
def edgeinfo(spark, sf_dir):
    return K.edgeinfo(A.toured_parts_graph(spark, sf_dir))


@query("SELECT k::VARCHAR AS NodeID, seq AS Sequence FROM seg", ["seg"])
def node_sequences(spark, sf_dir):
    return K.node_sequences(A.parts_graph(spark, sf_dir))
