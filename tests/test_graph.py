"""The c4a fixture against its known tables, random graphs against a small independent oracle, and invariants."""

import glob
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from walkweave.functions import columns as C
from walkweave.operators import genotypes as G
from walkweave.operators import regions as R
from walkweave.operators import simplify as S
from walkweave.operators import variants as V
from walkweave.plans import build as B
from walkweave.plans import store
from walkweave.sinks import files as K
from walkweave.sources import gfa, info
from walkweave.streaming.weights import streaming_edge_weights

# Fixed values of the fixture: its segments, its links, how often each walk is there, and the variants that are known of it. Segments have the sequence `*`, so alleles are written in stars.
SEGMENTS = (
    "SKIC2",
    "DXO",
    "STK19",
    "C4A",
    "C4B",
    "CYP21A2",
    "TNXB",
    "ATF6B",
)
LINKS = (
    ("SKIC2", "+", "DXO", "-"),
    ("DXO", "-", "STK19", "+"),
    ("STK19", "+", "C4A", "+"),
    ("STK19", "+", "C4B", "+"),
    ("STK19", "+", "C4B", "-"),
    ("C4A", "+", "C4A", "+"),
    ("C4A", "+", "C4B", "+"),
    ("C4A", "+", "CYP21A2", "+"),
    ("C4A", "-", "CYP21A2", "+"),
    ("C4A", "-", "C4B", "-"),
    ("C4B", "+", "C4B", "+"),
    ("C4B", "+", "CYP21A2", "+"),
    ("C4B", "-", "CYP21A2", "-"),
    ("CYP21A2", "+", "TNXB", "-"),
    ("TNXB", "-", "ATF6B", "-"),
)
WALKS = (
    (68, ">SKIC2<DXO>STK19>C4A>C4B>CYP21A2<TNXB<ATF6B"),
    (13, ">SKIC2<DXO>STK19>C4A>CYP21A2<TNXB<ATF6B"),
    (10, ">SKIC2<DXO>STK19>C4A>C4A>CYP21A2<TNXB<ATF6B"),
    (3, ">SKIC2<DXO>STK19>C4A>C4B>C4B>CYP21A2<TNXB<ATF6B"),
    (2, ">SKIC2<DXO>STK19>C4B>C4A>CYP21A2>C4B>CYP21A2<TNXB<ATF6B"),
    (1, ">SKIC2<DXO>STK19>C4A>CYP21A2>C4B>CYP21A2<TNXB<ATF6B"),
    (1, ">SKIC2<DXO>STK19>C4A>C4B>CYP21A2>C4B>CYP21A2<TNXB<ATF6B"),
)
#: POS, ID, VT, REF, ALT, NR, RC, AC, AN, PV, motif
EXPECTED = (
    "3 >STK19>C4B DEL ** * . 72 2 74 3,5 *",
    "3 >STK19<C4B INV *** * . . 0 . 3,5 .",
    "4 >C4A>C4A DUP * ** . 96 10 106 4,4 *",
    "4 >C4A>CYP21A2 DEL ** * . 76 26 102 4,6 *",
    "5 <C4A>CYP21A2 INV . ** . . 0 . 4,6 .",
    "5 >C4B>C4A DUP * *** . 96 2 98 5,4 *",
    "5 >C4B>C4B DUP * ** . 72 3 75 5,5 *",
    "6 >CYP21A2>C4B DUP * *** . 72 4 76 6,5 *",
)


@pytest.fixture(scope="module")
def c4a_file(tmp_path_factory):
    lines = [f"S\t{s}\t*\tLN:i:1" for s in SEGMENTS]
    lines += [f"L\t{a}\t{ao}\t{b}\t{bo}\t0M" for a, ao, b, bo in LINKS]
    walks = [w for n, w in WALKS for _ in range(n)]
    names = [("GRCh38", 0), ("CHM13", 0)] + [(f"HG{i // 2}", 1 + i % 2) for i in range(len(walks) - 2)]
    lines += [f"W\t{s}\t{h}\tchr6\t*\t*\t{w}\ttag" for (s, h), w in zip(names, walks, strict=True)] + ["H\tVN:Z:1.1"]
    path = tmp_path_factory.mktemp("gfa") / "c4a.gfa"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def c4a(spark, c4a_file):
    return B.from_gfa(spark, c4a_file, graph_id="c4a")


def one_file(path):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part*")))


def test_weights_and_tree(c4a):
    e = c4a.edges.orderBy("idx").collect()
    assert [r.weight for r in e] == [98, 98, 96, 2, 0, 10, 72, 26, 0, 2, 3, 76, 4, 98, 98, 0, 0]
    assert [int(r.in_tree) for r in e] == [1, 1, 1, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 1, 1, 1, 1]
    n = {r.node: r for r in c4a.nodes.collect()}
    path = ["+_terminus_+", "SKIC2_+", "DXO_-", "STK19_+", "C4A_+", "C4B_+", "CYP21A2_+", "TNXB_-", "ATF6B_-", "-_terminus_+"]
    assert [n[p].position for p in path] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 8] and all(n[p].direction == 1 for p in path)
    assert [n[p].parent for p in path] == [None, *path[:-1]]


def test_vcf(c4a, tmp_path):
    K.write_vcf(c4a, str(tmp_path / "x.vcf"), "chr6")
    lines = one_file(tmp_path / "x.vcf").splitlines()
    assert lines[0] == "##fileformat=VCFv4.2" and lines[13] == "##contig=<ID=chr6>"
    names, got = lines[14].split("\t"), []
    assert names[:9] == ["#CHROM", *K.VCF_ATTRIBUTES[1:]] and names[9:] == sorted(names[9:]) and len(names) == 9 + 50
    for line in lines[15:]:
        f = line.split("\t")
        i = dict(x.split("=") for x in f[7].split(";"))
        got.append(" ".join([f[1], f[2], i["VT"], f[3], f[4], i["NR"], i["RC"], i["AC"], i["AN"], i["PV"], i["TR_MOTIF"]]))
        assert i["DR"] == "0,0" and i["NIA"] == "0" and len(f) == len(names)
    assert tuple(got) == EXPECTED
    assert lines[15].split("\t")[names.index("GRCh38")] == "0:1:0" and lines[16].split("\t")[names.index("GRCh38")] == "0:.:0"


def test_vcf_options(c4a):
    head, lines = K.vcf_lines(c4a, "c", genotypes=False, size_threshold=1, check_degenerate=True)
    f = [r.value.split("\t") for r in lines.collect()]
    assert len(head[-1].split("\t")) == 9 and all(len(x) == 9 and len(x[3]) <= 1 and len(x[4]) <= 1 for x in f)


def test_summary(c4a):
    r = V.variant_summary(V.variants(c4a)).first()
    assert (r.inversion, r.back_edges, r.forward_edges, r.crossing_edges, r.total) == (2, 4, 2, 0, 8)
    t = {x.type: x["count"] for x in V.summary_table(V.variant_summary(V.variants(c4a))).collect()}
    assert t["Deletion"] == t["Forward"] == 2 and len(t) == 10


def test_edge_visits_round_trip(c4a):
    truth = G.edge_visits_of_walks(c4a)
    counts = G.genotype(c4a).where("kind = 'alt'").select("graph_id", "walk_idx", "idx", "n")
    got = Counter((r.walk_idx, r.idx, r.n) for r in G.edge_visits(c4a, counts, "graph_id", "walk_idx").collect())
    walks = {k[0] for k in got}
    assert got == Counter((r.walk_idx, r.idx, r.n) for r in truth.collect() if r.walk_idx in walks) and len(walks) == 30
    with pytest.raises(Exception, match="no walk has these counts"):
        G.edge_visits(c4a, counts.where("walk_idx = 98").union(counts.limit(1).selectExpr("graph_id", "-7L", "4L", "2L")), "graph_id", "walk_idx").collect()


def test_what_is_visited_is_not_missing(c4a):
    missing = {(r.sample, r.hap, r.idx) for r in G.missing_variants(c4a, G.linear_coverage(c4a), V.variants(c4a)).collect()}
    assert not missing & {(r.sample, r.hap, r.idx) for r in G.genotype(c4a).where("kind = 'alt'").collect()}


def test_triallelic(c4a, spark):
    number = {(r.u, r.v): r.idx for r in c4a.edges.collect()}
    case = lambda name, a, b, *e: (name, "c4a", a, b, [number[x] for x in e])
    rows = [case("x", "STK19", "CYP21A2", ("STK19_+", "C4B_+"), ("C4A_+", "CYP21A2_+")), case("y", "STK19", "CYP21A2", ("C4A_+", "C4A_+"), ("C4A_+", "CYP21A2_+"))]
    got = {r.bubble: r["class"] for r in R.triallelic_class(c4a, spark.createDataFrame(rows, "bubble string, graph_id string, a string, b string, idx array<long>")).collect()}
    assert got == {"x": "properly_triallelic", "y": "not_triallelic"}


def test_files_round_trip(c4a, spark, tmp_path, c4a_file):
    order = K.write_tree(c4a, str(tmp_path / "tree"))
    assert one_file(tmp_path / "tree").splitlines()[:3] == ["+_terminus_+,-1,", "SKIC2_+,0,*", "DXO_-,1,*"] and order.count() == 10
    K.write_nodeinfo(c4a, str(tmp_path / "n"))
    K.write_edgeinfo(c4a, str(tmp_path / "e"))
    again = B.from_gfa(spark, c4a_file, graph_id="c4a", nodeinfo=info.read_nodeinfo(spark, str(tmp_path / "n")), edgeinfo=info.read_edgeinfo(spark, str(tmp_path / "e")))
    for t in ("nodes", "edges"):
        columns = [c for c in getattr(c4a, t).columns if c not in ("chain",)]
        assert Counter(map(str, getattr(again, t).select(columns).collect())) == Counter(map(str, getattr(c4a, t).select(columns).collect()))
    K.write_gfa(c4a, str(tmp_path / "g"), only_tree=True)
    assert sum(x.startswith("L") for x in one_file(tmp_path / "g").splitlines()) == 9
    K.subset_gfa_to_tree(spark, c4a_file, str(tmp_path / "sub"), c4a)
    assert Counter(x[0] for x in one_file(tmp_path / "sub").splitlines()) == {"S": 8, "L": 7}
    store.save_graph(c4a, str(tmp_path / "saved"))
    assert store.load_graph(spark, str(tmp_path / "saved")).edges.count() == 17
    assert K.node_sequences(c4a).count() == 10
    K.write_nodes(c4a.nodes.select("node"), str(tmp_path / "t"))
    assert len(one_file(tmp_path / "t").split()) == 20


def test_gfa_reader(spark, c4a_file):
    t = gfa.read_gfa(spark, c4a_file)
    assert gfa.reference_index(t["walks"]).first().reference_index == 0
    assert gfa.reference_index(gfa.read_gfa(spark, c4a_file, "nobody")["walks"]).first().reference_index == 98
    assert gfa.walks_by_name(t["walks"]).where("name = 'HG3_1'").first().walks[0][0] == "SKIC2_+"
    assert [r.idx for r in t["links"].orderBy("idx").collect()] == list(range(15))


@pytest.mark.parametrize("change, message", [("L\ta\t+\tb\t+\t0M", "twice"), ("W\tR\t0\tc\t*\t*\t>a>b", "one reference walk"), ("W\tX\t1\tc\t*\t*\t>b>a", "isn't there"), (None, "twice")])
def test_errors(spark, tmp_path, change, message):
    lines = ["S\ta\tA", "S\tb\tC", "L\ta\t+\tb\t+\t0M"]
    lines += [change, "W\tR\t0\tc\t*\t*\t>a>b"] if change else ["L\tb\t+\ta\t+\t0M", "W\tR\t0\tc\t*\t*\t>a>b>a"]
    (tmp_path / "x.gfa").write_text("\n".join(lines))
    with pytest.raises(Exception, match=message):
        B.from_gfa(spark, str(tmp_path / "x.gfa"), "R").edges.count()


# --- random graphs against a small oracle that walks step by step


def flip(n):
    return n[:-1] + ("-" if n[-1] == "+" else "+")


def reverse_complement(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def random_gfa(seed):
    rng = random.Random(seed)
    n = 14
    seq = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 4))) for i in range(n)}
    ref = [f"s{i}_+" for i in range(8)]
    walks, links = [("R", "0", ref)], {}
    for k in range(6):
        w = [rng.choice(ref[:3])]
        for _ in range(rng.randrange(2, 9)):
            w.append(f"s{rng.randrange(n)}_{rng.choice('+++-')}")
        walks.append((f"P{k // 2}", str(1 + k % 2), w if rng.random() < 0.7 else [flip(x) for x in reversed(w)]))
    for _, _, w in walks:
        for u, v in zip(w, w[1:], strict=False):
            if (u, v) not in links and (flip(v), flip(u)) not in links:
                links[(u, v)] = 0
    lines = [f"S\t{s}\t{q}" for s, q in seq.items()] + ["\t".join(["L", u[:-2], u[-1], v[:-2], v[-1], "0M"]) for u, v in links]
    lines += [f"W\t{s}\t{h}\tc\t*\t*\t{''.join(('>' if x[-1] == '+' else '<') + x[:-2] for x in w)}" for s, h, w in walks]
    return lines, walks, seq


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, tmp_path, seed):
    lines, walks, seq = random_gfa(seed)
    (tmp_path / "r.gfa").write_text("\n".join(lines))
    g = B.from_gfa(spark, str(tmp_path / "r.gfa"), "R", graph_id="r")
    nodes = {r.node: r for r in g.nodes.collect()}
    edges = g.edges.collect()
    # directions and positions of twins, one parent each, depths
    for x, r in nodes.items():
        t = nodes[flip(x)]
        assert r.direction == -t.direction and r.position == t.position and r.distance == t.distance
        if r.parent:
            p = nodes[r.parent]
            assert r.direction == p.direction == 1 and r.depth == p.depth + 1 and p.tin < r.tin <= p.tout
            assert r.on_ref or (r.position == p.position and r.distance == p.distance + len(r.seq))
    weight = Counter()
    for _, _, w in walks:
        for u, v in zip(w, w[1:], strict=False):
            weight[min((u, v), (flip(v), flip(u)))] += 1
    for e in edges:
        assert e.weight == weight[min((e.u, e.v), (flip(e.v), flip(e.u)))]

    def above(x):
        out = [x]
        while nodes[out[-1]].parent:
            out.append(nodes[out[-1]].parent)
        return out

    forward = lambda x: x if nodes[x].direction == 1 else flip(x)
    v = {r.idx: r for r in V.alleles(g, V.variants(g, False)).collect()}
    for e in edges:
        if e.in_tree or not e.branch_point:
            continue
        up, vp = above(forward(e.u)), above(forward(e.v))
        lca = next(x for x in up if x in vp)
        back = lca in (e.v, flip(e.u))
        assert e.is_back == back and e.branch_point == (nodes[lca].parent if back else lca)
        u, w = (flip(e.v), flip(e.u)) if nodes[e.u].direction == nodes[e.v].direction == -1 else (e.u, e.v)
        b, du, dw = e.branch_point, nodes[u].direction, nodes[w].direction
        path = lambda x: [y for y in reversed(above(x)) if nodes[y].depth > nodes[b].depth]  # noqa: B023, E731
        if du == 1:
            ref, alt = path(forward(w)), path(u)
            ref = ref[:-1] if dw == 1 else ref
        else:
            ref, alt = path(forward(u))[:-1], path(forward(w))
            alt = alt[:-1] if dw == 1 else alt
        text = lambda p: "".join(nodes[y].seq for y in p)
        want = [text(ref), text(alt)] if du == 1 else [reverse_complement(text(ref)), reverse_complement(text(alt))]
        assert [v[e.idx].ref, v[e.idx].alt] == want and [v[e.idx].ref_len, v[e.idx].alt_len] == [len(x) for x in want]
    # a walk's visits come back from its visits of variants
    geno = G.genotype(g).where("kind = 'alt'")
    truth = defaultdict(Counter)
    for r in G.edge_visits_of_walks(g).collect():
        truth[r.walk_idx][r.idx] = r.n
    got = defaultdict(Counter)
    for r in G.edge_visits(g, geno.select("graph_id", "walk_idx", "idx", "n"), "graph_id", "walk_idx").collect():
        got[r.walk_idx][r.idx] = r.n
    for w, c in got.items():
        assert c == truth[w]
    assert K.vcf_lines(g, "c")[1].count() == V.variants(g).count()


# --- functions, regions, simplification, streaming


def test_column_functions(spark):
    row = spark.range(1).select(
        C.sequence_complement(F.lit("ACGTNa*")).alias("a"), C.node_complement(F.lit("x_+")).alias("b"), C.node_recover(F.lit("-_terminus_+")).alias("c"), C.node_convert(F.lit("<é")).alias("d"),
        C.tokenize_walk(F.lit(">s1.2<é>b_1")).alias("e"), C.nearly_identical(F.lit("A" * 10), F.lit("A" * 9 + "C")).alias("f"), C.nearly_identical(F.lit("A" * 9), F.lit("A" * 10)).alias("g"),
        C.info_map(F.lit("A=1;F;B=2=3")).alias("h"), C.bubble_ends(F.lit(">1<22"), True).alias("i"), C.repeat_motif(F.lit("ACACAC")).alias("j"), C.repeat_motif(F.lit("ACA")).alias("k"), C.repeat_motif(F.lit("")).alias("l"), C.repeat_motif(F.lit("ANAN")).alias("m"),
    ).first()
    assert row.a == "*aNACGT" and row.b == "x_-" and row.c == ">endTerminus" and row.d == "é_-" and row.e == ["s1_+", "é_-", "b_1_+"]
    assert row.f and not row.g and row.h == {"A": "1", "F": None, "B": "2"} and row.i == ["1_+", "22_-"]
    assert (row.j, row.k, row.l, row.m) == ("AC", "ACA", None, None)
    for bad in (C.flip(F.lit("x")), C.bubble_ends(F.lit(">1>2>3"))):
        with pytest.raises(Exception, match="orientation|two nodes"):
            spark.range(1).select(bad).collect()


def test_range_join(spark):
    rng = random.Random(1)
    points = [(i, rng.randrange(0, 3000)) for i in range(200)]
    spans = [(a, a + rng.randrange(0, 90)) for a in (rng.randrange(0, 3000) for _ in range(60))]
    p, s = spark.createDataFrame(points, "id long, at long"), spark.createDataFrame(spans, "start long, end long")
    assert Counter((r.id, r.start, r.end) for r in R.range_join(p, s, "at", 16).collect()) == Counter((i, a, b) for i, x in points for a, b in spans if a <= x < b)
    inside = {i for i, x in points if any(a <= x < b for a, b in spans)}
    assert {r.id for r in R.range_join(p, s, "at", 16, "left_semi").collect()} == inside
    assert {r.id for r in R.range_join(p, s, "at", 16, "left_anti").collect()} == {i for i, _ in points} - inside


def test_region_files(spark, tmp_path):
    (tmp_path / "r.bed").write_text("c1\t0\t10\tx\nc2\t5\t9\nc1\t20\t30\n")
    assert [tuple(r) for r in info.read_bed(spark, str(tmp_path / "r.bed"), "c1").collect()] == [(1, 11, "x"), (21, 31, None)]
    (tmp_path / "b.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\t5\t>1>4\tA\tC\t.\t.\tAT=>1>2>4,>1>3>4;LV=0\nc\t6\t>1>4\tA\tG\t.\t.\tAT=>1>4\n")
    bubbles, nodes = info.read_bubble_vcf(spark, str(tmp_path / "b.vcf"))
    b = bubbles.first()
    assert (b.a, b.b, b.pos) == ("1", "4", 6) and {r.node for r in nodes.collect()} == {"1_+", "4_+"}
    table, meta = info.read_vcf(spark, str(tmp_path / "b.vcf"), meta=True)
    assert table.columns[0] == "CHROM" and table.count() == 2 and meta.count() == 1
    (tmp_path / "s.tsv").write_text("#ID\n>1>4\t0\t.\t2,3\n")
    bubbles, nodes = info.read_snarls(spark, str(tmp_path / "s.tsv"))
    assert bubbles.first().content == ["2", "3"] and nodes.count() == 8


def test_bubbles(c4a, spark):
    v = V.variants(c4a)
    part = spark.createDataFrame([(n, b) for b, seg in (("p", ("STK19", "C4A", "C4B")), ("q", ("CYP21A2",))) for s in seg for n in (f"{s}_+", f"{s}_-")], "node string, bubble string")
    found = {(r.bubble, r.idx): r.within for r in R.bubble_variants(v, part).collect()}
    assert found[("p", 3)] and found[("p", 5)] and not found[("p", 7)] and not found[("q", 7)]
    s = {r.bubble: r for r in R.bubble_summary(part.select("bubble", F.lit(0).alias("level")), R.bubble_variants(v, part), v.select("idx", F.col("idx").cast("string").alias("name"))).collect()}
    assert s["p"].within_count == 5 and s["p"].crossing_count == 3 == s["q"].total_count


def test_bubbles_of_a_called_vcf(c4a, spark, tmp_path):
    """The variants that a VCF names are those of the graph, and so are their bubbles."""
    K.write_vcf(c4a, str(tmp_path / "v"), "chr6", False, exclude_terminus=False)
    part = spark.createDataFrame([(f"{s}_{o}", b) for b, segs in (("p", ("STK19", "C4A", "C4B")), ("q", ("CYP21A2", "+_terminus"))) for s in segs for o in "+-"], "node string, bubble string")
    got = info.variants_of_bubbles(spark, str(tmp_path / "v"), c4a, part)
    want = R.bubble_variants(V.variants(c4a, False), part)
    assert sorted(map(tuple, got.select("bubble", "idx", "within").collect())) == sorted(map(tuple, want.collect()))
    (tmp_path / "w.vcf").write_text("#CHROM\tPOS\tID\nchr6\t1\t>C4A>nowhere\n")
    with pytest.raises(Exception, match="no such edge"):
        info.variants_of_bubbles(spark, str(tmp_path / "w.vcf"), c4a, part).collect()


def test_parts_of_a_written_tree_are_in_order(spark, c4a, tmp_path):
    """Several parts, one range of lines each, are together the one file."""
    K.write_tree(c4a, str(tmp_path / "one"), True)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        K.write_tree(c4a, str(tmp_path / "many"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(str(tmp_path / "many/part*"))) > 1
    assert one_file(tmp_path / "many") == one_file(tmp_path / "one")


def test_actions_are_logged_with_memory(caplog):
    caplog.set_level("INFO", "walkweave")
    K.log_action("reading")
    assert caplog.messages[0].startswith("reading, ") and caplog.messages[0].endswith(" MB")


def test_counts_and_orders(c4a):
    assert B.graph_counts(c4a).first().asDict() == {"graph_id": "c4a", "binodes": 10, "biedges": 17}
    placed = B.nodes_by_position(c4a.nodes).orderBy("place").collect()
    assert [r.place for r in placed] == list(range(10))
    assert [r.position for r in placed] == sorted(r.position for r in placed)


def test_simplify(spark, tmp_path):
    lines = ["S\ta\tAA", "S\tb\tC", "S\tc\tG", "S\td\tTT", "S\tx\tGATTACA" + "A" * 30, "S\ty\tC", "S\ttip\tT"]
    for u, v in ("ab", "bc", "cd", "ax", "xc", "by", "yd"):
        lines.append(f"L\t{u}\t+\t{v}\t+\t0M")
    lines += ["L\tb\t+\ttip\t+\t0M", "W\tR\t0\tc\t*\t*\t>a>b>c>d", "W\tP\t1\tc\t*\t*\t>a>x>c>d", "W\tP\t2\tc\t*\t*\t>a>b>y>d"]
    (tmp_path / "s.gfa").write_text("\n".join(lines))
    g = B.from_gfa(spark, str(tmp_path / "s.gfa"), "R", graph_id="s")
    nodes, edges = S.simplify(g, None, None, 20)
    seqs = {r.node: r.seq for r in nodes.collect() if nodes is not None and r.node.endswith("+")}
    spelt = {(r.u, r.v) for r in edges.collect()}
    # the long insertion stays, the short way over y goes, and what is left unary is merged
    assert "y_+" not in seqs and "tip_+" not in seqs and any("GATTACA" in s for s in seqs.values()) and len(spelt) % 2 == 0
    assert sum(len(s) for s in seqs.values()) == 2 + 1 + 1 + 2 + 37


def test_streaming_weights(spark, tmp_path, c4a):
    walks = c4a.walks.select("graph_id", "steps")
    walks.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(walks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_edge_weights(stream, c4a.edges).writeStream.outputMode("complete").format("memory").queryName("weights").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.idx: r.weight for r in spark.table("weights").collect()}
    assert got == {r.idx: r.weight for r in c4a.edges.where("weight > 0").collect()}


def test_command_line(spark, tmp_path, c4a_file):
    from walkweave import cli

    cli.main([c4a_file, str(tmp_path / "out.vcf"), "--chr-id", "chr6", "--no-genotypes"], spark)
    assert sum(not x.startswith("#") for x in one_file(tmp_path / "out.vcf").splitlines()) == 8
