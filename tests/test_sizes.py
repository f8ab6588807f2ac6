"""What the findings on larger tables asked for: small cases that failed, or took a round or a wide row for each node, before."""

from __future__ import annotations

from walkweave.operators import simplify as S

COLUMNS = "graph_id string, node string"


def _both(edges):
    flip = lambda n: n[:-1] + ("-" if n[-1] == "+" else "+")
    return [("g", u, v) for u, v in edges] + [("g", flip(v), flip(u)) for u, v in edges]


def test_a_tip_on_the_last_reference_node_leaves_the_reference(spark):
    """the climb from a tip ends at an end point."""
    edges = spark.createDataFrame(_both([("0_+", "1_+"), ("1_+", "3_+"), ("3_+", "4_+"), ("4_+", "5_+")]), "graph_id string, u string, v string")
    nodes = spark.createDataFrame([("g", f"{i}_{o}") for i in (0, 1, 3, 4, 5) for o in "+-"], COLUMNS)
    ends = spark.createDataFrame([("g", f"{i}_{o}") for i in (0, 4) for o in "+-"], COLUMNS)
    left, kept = S.delete_tips(nodes, edges, ends)
    assert {r["node"] for r in left.collect()} == {f"{i}_{o}" for i in (0, 1, 3, 4) for o in "+-"}
    assert kept.count() == 6


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_variants_meet_their_ends_once(spark):
    """F11 to F26: an edge is dealt to its two ends and its branch point, and was to seven places before."""
    from walkweave import adapters as A
    from walkweave.operators import variants as V

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        v = V.variants(A.parts_graph(spark, "/root/testdata/sf0.001")).select("idx", "vtype")
        # Three joins deal both sides; a segment's two nodes are dealt for each of two ends.
        assert _shuffles(v) <= 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_sums_over_stretches(spark):
    """F7, F8, F9: steps are followed within stretches of keys first; only what another stretch leads to goes through rounds."""
    from walkweave.operators import trees as T

    to = {i: i + 7 if i + 7 < 60 else None for i in range(60)}
    steps = spark.createDataFrame([(k, t, k + 1) for k, t in to.items()], "key long, to long, n long")
    got = {r["key"]: r["n"] for r in T.suffix_sums(steps, "key", "to", ["n"], stretch=16).collect()}
    assert got == {k: sum(x + 1 for x in range(k, 60, 7)) for k in to}


def test_missing_variants_are_neither_dealt_again_nor_twice(spark, monkeypatch):
    """rows, far more than the input, were dealt once more to drop those that stand in two touching gaps; a bin's variants met all its gaps in one task."""
    import random

    from walkweave.operators import genotypes as G

    rng = random.Random(4)
    cover = []
    for w in range(60):
        low = rng.randrange(0, 12)
        cover.append(("g", w, "s", str(w % 7), low, low + rng.choice([0, 0, 1, 3, 5])))
    spots = [(i, low, high) for i, (low, high) in enumerate((a, b) for a in range(16) for b in range(a, 16))]
    coverage = spark.createDataFrame(cover, "graph_id string, walk_idx long, sample string, hap string, low long, high long")
    variants = spark.createDataFrame([("g", *x, *x[1:]) for x in spots], "graph_id string, idx long, u_position long, v_position long, u_right_position long, v_right_position long")
    bounds = spark.createDataFrame([("g", 0, 15)], "graph_id string, first long, last long")
    want = set()
    for hap in {c[3] for c in cover}:
        mine = [c for c in cover if c[3] == hap]
        gaps = zip(sorted([0, *[c[5] for c in mine]]), sorted([15, *[c[4] for c in mine]]), strict=True)
        want |= {(hap, i) for start, end in gaps for i, low, high in spots if start <= low and high <= end}
    for split in (4096, 3):
        monkeypatch.setattr(G, "SPLIT", split)
        got = G.missing_variants(None, coverage, variants, bounds)
        assert sorted((r["hap"], r["idx"]) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate date, l_extendedprice double, l_returnflag string"


def _tables(spark, folder, lines, parts=6):
    spark.createDataFrame([(k, "b", k % 7) for k in range(parts)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(1, 2), (3, 4)], "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(o, 1 + o % 2 * 2) for o in {x[0] for x in lines}], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, LINES).write.parquet(f"{folder}/lineitem.parquet")


def test_narrow_lines_make_the_same_walks(spark, tmp_path):
    """F1, F4 to F10: lines were dealt with supplier, date and price, which only tell apart lines of equal number and part."""
    from walkweave import adapters as A
    from walkweave.plans import store

    lines = [(1, 2, 9, 1, None, 1.0, "R"), (1, 2, 3, 1, None, 1.0, "N"), (1, 0, 1, 0, None, 1.0, None), (2, 5, 1, -3, None, 2.0, "R"), (2, 4, 1, 2**30, None, 2.0, "N"), (2, 1 << 50, 1, 7, None, 2.0, "R")]
    lines += [(3, 1, 1, 2, None, 2.0, "N"), (3, 1, 1, 2, None, 2.0, "A"), (4, 3, 1, 5, None, 5.0, "R"), (4, 3, 1, 5, None, 4.0, "N"), (4, 0, 1, 6, None, 4.0, "N")]
    _tables(spark, str(tmp_path), lines)
    with store.scope(spark):
        walks = lambda df: sorted(map(tuple, df.collect()))
        got = walks(A.written_walks(spark, str(tmp_path)))
        assert got == walks(A.order_walks(spark, str(tmp_path)))
        assert {r[1]: r[5] for r in got}[1] == ["0_+", "2_+", "2_-"]
        assert not A.parts_graph(spark, str(tmp_path)).plain  # a line's part is none of the parts


def test_visits_and_coverage_by_names(spark):
    """F1, F4, F5, F8, F9, F10: visits met both readings of all edges and were dealt four times; plain graphs tell them from the walk's row."""
    from walkweave import adapters as A
    from walkweave.operators import genotypes as G
    from walkweave.plans import store

    with store.scope(spark):
        g = A.parts_graph(spark, "/root/testdata/sf0.001")
        assert g.plain
        assert _shuffles(G.edge_visits_of_walks(g, False)) == 0
        rows = lambda df: sorted(map(tuple, df.collect()))
        for f in (G.edge_visits_of_walks, G.genotype, G.linear_coverage):
            assert rows(f(g, False)) == rows(f(g.but(plain=False), False))
        by = ("graph_id", "sample")
        assert rows(G.linear_coverage(g, False, by)) == rows(G.coverage_by(G.linear_coverage(g.but(plain=False), False)))


def test_counts_within_a_walk(spark):
    from walkweave.operators import genotypes as G

    walks = spark.createDataFrame([(1, ["a_+", "b_+", "a_+", "b_+", "b_+"]), (2, ["a_+"]), (3, []), (4, ["b_-", "a_-"])], "walk_idx long, steps array<string>")
    assert sorted(map(tuple, G.visits_on(walks, "walk_idx").collect())) == [(1, "a_+", "b_+", 2), (1, "a_-", "b_-", 1), (1, "b_+", "b_+", 1), (4, "a_+", "b_+", 1)]


def test_shuffle_files_go_with_their_action(spark):
    """F1 to F10: the disk held the shuffle files of all steps before, until the driver's garbage was collected."""
    from walkweave.plans import store

    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(store._TIDY, None)
    with store.scope(spark):
        store.materialise(spark.range(1000).groupBy("id").count(), "t")
        assert not files() - before
    assert spark.conf.get(store._TIDY, None) == setting


def test_cells_are_filled_in_the_variants_row(spark, monkeypatch):
    """cells, a row for each variant and haplotype, were dealt four times; variants stood in a bin of each of four levels to meet the gaps."""
    from walkweave import adapters as A
    from walkweave.operators import genotypes as G
    from walkweave.operators import variants as V
    from walkweave.plans import store

    rows = lambda df: sorted(map(tuple, df.collect()))
    with store.scope(spark):
        g = A.parts_graph(spark, "/root/testdata/sf0.001")
        walks = g.walks.selectExpr("graph_id", "walk_idx", "if(sample = '7', 'CHM', cast(cast(sample as int) % 3 as string)) as sample", "if(sample = '7', '0', cast(1 + cast(hap as int) % 2 as string)) as hap", "is_ref", "steps").where("not (sample = '2' and hap = '1')")
        g = g.but(walks=walks)
        bounds = g.nodes.groupBy("graph_id").agg({"position": "max"}).selectExpr("graph_id", "0L as first", "`max(position)` as last")
        got = G.sample_fields(g, None, False, bounds)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 1
        want = rows(got)
        cells = {r["sample"]: r["field"] for r in got.collect()}
        assert set(cells) == {"0", "1", "2", "CHM"} and "|" not in cells["CHM"] and cells["2"].startswith(".|")
        assert len(want) == 4 * V.variants(g).count()
        monkeypatch.setattr(G, "FEW", -1)
        assert rows(G.sample_fields(g.but(plain=False), V.variants(g), False, bounds)) == want


def test_bubble_summary_by_numbers(spark):
    """a bubble's variants met their names by a join of all pairs, and were dealt as text."""
    from walkweave.operators import regions as R

    bubbles = spark.createDataFrame([("a", 0), ("b", 1)], "bubble string, level int")
    found = spark.createDataFrame([("a", 10, True), ("a", 9, True), ("a", 100, False)], "bubble string, idx long, within boolean")
    got = R.bubble_summary(bubbles, found)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted(map(tuple, got.collect())) == [("a", 0, 3, 2, 1, "10,9", "100"), ("b", 1, 0, 0, 0, "", "")]
    assert sorted(map(tuple, R.bubble_summary(bubbles, found, found.selectExpr("idx", "cast(idx as string) as name")).collect())) == sorted(map(tuple, got.collect()))
