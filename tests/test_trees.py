"""Ranks, tours, range minima, branch points and paths against brute force on trees of several shapes."""

import random

import pytest
from pyspark.sql import functions as F

from walkweave import adapters
from walkweave.operators import nesting, ranks, regions, trees

TREE = "graph_id string, node string, parent string, w long, o long"
SHAPES = {
    "random": lambda rng, i: rng.randrange(i),
    "path": lambda rng, i: i - 1,
    "star": lambda rng, i: 0,
    "caterpillar": lambda rng, i: i - 1 if i % 3 else max(i - 3, 0),
    "forest": lambda rng, i: None if rng.random() < 0.2 else rng.randrange(i),
}


def grown(shape, n, seed, graph="g"):
    """Rows of TREE; names and the order of children say nothing of the shape."""
    rng = random.Random(seed)
    names = [f"n{x}" for x in rng.sample(range(10 * n), n)]
    above = [None] + [SHAPES[shape](rng, i) for i in range(1, n)]
    return [(graph, f"{names[i]}_+", None if above[i] is None else f"{names[above[i]]}_+", rng.randrange(-5, 20), rng.randrange(3)) for i in range(n)]


def walked(rows):
    """node -> depth, tin, tout, sum, by graph, and each node's path to its root."""
    out, paths = {}, {}
    for g in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == g}
        children = {}
        for r in own.values():
            children.setdefault(r[2], []).append(r)
        place, todo = 0, [(None, iter(sorted(children.get(None, []), key=lambda r: (r[4], r[1]))))]
        while todo:
            node = next(todo[-1][1], None)
            if node is None:
                above = todo.pop()[0]
                if above:
                    out[g, above] = (*out[g, above][:2], place - 1, out[g, above][3])
                continue
            top = out.get((g, node[2]), (-1, 0, 0, 0))
            out[g, node[1]] = (top[0] + 1, place, place, top[3] + node[3])
            paths[g, node[1]] = [node[1], *paths.get((g, node[2]), [])]
            place += 1
            todo.append((node[1], iter(sorted(children.get(node[1], []), key=lambda r: (r[4], r[1])))))
    return out, paths


@pytest.mark.parametrize("shape", SHAPES)
def test_labels_and_branch_points(spark, shape):
    rng = random.Random(7)
    rows = grown(shape, 60, 1) + grown(shape, 1, 2, "single") + grown("random", 25, 3, "other")
    want, paths = walked(rows)
    labels = trees.tour(spark.createDataFrame(rows, TREE), {"total": "w"}, ["o"])
    got = {(r["graph_id"], r["node"]): (r["depth"], r["tin"], r["tout"], r["total"]) for r in labels.collect()}
    assert got == want
    keys = list(want)
    pairs = [(g, i, a, b) for i in range(200) for g, a in [rng.choice(keys)] for b in [rng.choice([n for h, n in keys if h == g])]]
    found = trees.lowest_common(labels, spark.createDataFrame(pairs, "graph_id string, i long, a string, b string"))
    common = {r["i"]: r["common"] for r in found.collect()}
    assert common == {i: next((n for n in paths[g, a] if n in set(paths[g, b])), None) for g, i, a, b in pairs}
    climbs = [(g, rng.choice(p), p[0]) for g, p in ((g, paths[g, n]) for g, n in keys)]
    steps = trees.tree_paths(labels, spark.createDataFrame(climbs, "graph_id string, ancestor string, descendant string"))
    assert sorted((r["graph_id"], r["ancestor"], r["descendant"], r["steps"], r["node"]) for r in steps.collect()) == sorted((g, a, d, i, n) for g, a, d in climbs for i, n in enumerate(paths[g, d][: paths[g, d].index(a) + 1]))


def test_errors_and_empty_trees(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), TREE)
    assert trees.tour(spark.createDataFrame([], TREE), {"total": "w"}).count() == 0
    with pytest.raises(Exception, match="a parent isn't there"):
        trees.tour(make(("g", "a", None, 1, 0), ("g", "b", "x", 1, 0)))
    with pytest.raises(Exception, match="a parent is there twice"):
        trees.tour(make(("g", "a", None, 1, 0), ("g", "a", None, 1, 0), ("g", "b", "a", 1, 0)))
    with pytest.raises(ValueError, match="circle"):
        trees.tour(make(("g", "r", None, 1, 0), ("g", "a", "b", 1, 0), ("g", "b", "a", 1, 0)))
    labels = trees.tour(make(("g", "a", None, 1, 0)))
    none = spark.createDataFrame([], "graph_id string, a string, b string")
    assert trees.lowest_common(labels, none).count() == 0
    assert trees.tree_paths(labels, none.toDF("graph_id", "ancestor", "descendant")).count() == 0


@pytest.mark.parametrize("n", [1, 5, 64, 150])
def test_range_minima(spark, n):
    """Blocks of four give four levels for 150 values."""
    rng = random.Random(n)
    values = {"g": [rng.randrange(30) for _ in range(n)], "h": [3, 1, 2]}
    queries = [(g, i, low, high) for i in range(300) for g in [rng.choice("gh")] for low in [rng.randrange(len(values[g]))] for high in [rng.randrange(low - 1, len(values[g]))]]
    rows = [(g, i, v) for g, x in values.items() for i, v in enumerate(x)]
    got = trees.range_minima(spark.createDataFrame(rows, "graph_id string, at long, value long"), spark.createDataFrame(queries, "graph_id string, i long, low long, high long"), block=4)
    assert {r["i"]: r["minimum"] for r in got.collect()} == {i: min(values[g][low : high + 1], default=None) for g, i, low, high in queries}


def test_global_rank(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(50), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, x long, i long").repartition(7)
    got = {r["i"]: r["rank"] for r in ranks.global_rank(df, ["x", F.desc("i")]).collect()}
    assert got == {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], -r[2])))}
    got = {r["i"]: r["place"] for r in ranks.global_rank(df, ["x", "i"], "place", "g").collect()}
    assert got == {r[2]: n for g in "ab" for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])))}
    assert ranks.global_rank(df.where("false"), ["x"]).count() == 0


def test_tour_gives_the_closed_forms_of_the_parts_graph(spark):
    sf = "/root/testdata/sf0.001"
    nodes = adapters.parts_nodes(spark, sf).where("orient = '+'")
    labels = adapters.parts_labels(spark, sf)
    columns = ["node", "parent", "depth", "position", "distance", "plen"]
    assert sorted(map(tuple, labels.select(columns).collect())) == sorted(map(tuple, nodes.select(columns).collect()))


@pytest.mark.parametrize("n", [0, 1, 9, 90])
def test_nesting(spark, n):
    """Blocks of four give four levels for 90 bubbles; many begin or end together, and some are equal."""
    rng = random.Random(n)
    rows = []
    for i in range(n):
        start = rng.randrange(40)
        rows.append((f"b{i:02}", start, start + rng.choice([0, 1, 5, 20, 60])))
    got = nesting.nesting(spark.createDataFrame(rows, "bubble string, start long, end long"), 4)
    order = sorted(rows, key=lambda r: (r[1], -r[2], r[0]))
    parent = {r[0]: next((p[0] for p in reversed(order[:i]) if p[2] >= r[2]), None) for i, r in enumerate(order)}
    level = lambda b: 0 if parent[b] is None else 1 + level(parent[b])
    assert sorted(map(tuple, got.select("bubble", "place", "parent", "level").collect())) == sorted((r[0], i, parent[r[0]], level(r[0])) for i, r in enumerate(order))


@pytest.mark.parametrize("closed", [False, True])
def test_tree_range_join(spark, closed):
    """Intervals from nothing to far beyond the top level's bins, on both sides of 0."""
    rng = random.Random(11)
    far = 4 * 16**3 * 20
    points = [(rng.choice("ab"), i, rng.choice([rng.randrange(-50, 50), rng.randrange(-far, far)])) for i in range(150)] + [("a", 150, None)]
    spans = []
    for i in range(60):
        start = rng.choice([rng.randrange(-60, 60), rng.randrange(-far, far)])
        spans.append((rng.choice("ab"), f"s{i}", start, start + rng.choice([-3, 0, 1, 4, 64, 70, 1000, rng.randrange(far)])))
    p = spark.createDataFrame(points, "g string, i long, at long")
    s = spark.createDataFrame(spans, "g string, name string, start long, end long")
    got = sorted((r["i"], r["name"]) for r in regions.tree_range_join(p, s, "at", 4, closed, ("g",)).collect())
    assert got == sorted((i, name) for g, i, at in points if at is not None for h, name, a, b in spans if g == h and (a <= at <= b if closed else a <= at < b))
    sizes = s.select(F.size(regions.bins_of(F.col("start"), F.greatest("start", "end"), 4)).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] < 3 * 30 + 2 * far / (4 * 16**3) + 2
