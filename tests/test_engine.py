import random

import pytest
from pyspark.sql import functions as F

from lacewing import Graph
from lacewing.model import CompressedGraph, GraphMeta
from lacewing.operators import bfs, bfs_compressed, cc_directed, decompress, filter_rules, filter_rules_decomposed, flatten_rules, hits, hits_top, pagerank, repair, sssp, topo_levels, wcc
from lacewing.plans import RoundProgram, VertexProgram, edge_map, run_program, run_rounds, vertex_map, vertex_subset

G3 = [[1, 2], [], [0, 1]]
G6 = [[2, 3, 4, 5], [2, 3, 4, 5], [3, 4, 5], [], [5], [0]]
DAG6 = [[2, 3, 4], [2, 3, 4], [3, 4, 5], [4, 5], [5], []]


def graph(spark, rows, ordered=True):
    edges = [(v, d, p) for v, row in enumerate(rows) for p, d in enumerate(row)]
    df = spark.createDataFrame(edges, "src long, dst long, pos long")
    return Graph(df if ordered else df.drop("pos"), spark.range(len(rows)))


def bodies(c):
    return {r["id"]: r["body"] for r in c.nodes().collect()}


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_golden_grammars(spark):
    c = repair(graph(spark, G6), batch=1)
    assert bodies(c) == {0: [8], 1: [8], 2: [7], 3: [], 4: [5], 5: [0], 6: [3, 4], 7: [6, 5], 8: [2, 7]}
    assert c.ratio() == pytest.approx(20 / 21)
    assert {r["id"]: r["level"] for r in c.rule_order.collect()} == {6: 2, 7: 1, 8: 0}
    assert bodies(filter_rules(c, -1)) == {0: [7], 1: [7], 2: [6], 3: [], 4: [5], 5: [0], 6: [3, 4, 5], 7: [2, 6]}
    assert bodies(filter_rules(c, 0)) == {0: [2, 6], 1: [2, 6], 2: [6], 3: [], 4: [5], 5: [0], 6: [3, 4, 5]}
    assert bodies(filter_rules(c, 16)) == dict(enumerate(G6))
    assert bodies(filter_rules_decomposed(c)) == {0: [6], 1: [6], 2: [3, 4, 5], 3: [], 4: [5], 5: [0], 6: [2, 3, 4, 5]}
    assert bodies(filter_rules_decomposed(c, mode="or")) == dict(enumerate(G6))
    d = repair(graph(spark, DAG6), batch=1)
    assert bodies(d) == {0: [7], 1: [7], 2: [6, 5], 3: [4, 5], 4: [5], 5: [], 6: [3, 4], 7: [2, 6]}


def test_edge_case_grammars(spark):
    assert bodies(repair(graph(spark, [[1, 1, 1, 1, 1], []]), batch=1)) == {0: [1, 2, 2], 1: [], 2: [1, 1]}
    assert bodies(repair(graph(spark, [[3, 1, 2], [3, 1, 2], [], []]), batch=1)) == {0: [5], 1: [5], 2: [], 3: [], 4: [1, 2], 5: [3, 4]}
    assert repair(graph(spark, [[0, 1], [2, 3], [], []])).meta.rule_cnt == 0
    empty = graph(spark, [[], [], []])
    assert repair(empty).ratio() == 1
    assert column(pagerank(empty), "rank") == pytest.approx([0.05] * 3)
    assert column(topo_levels(empty), "level") == [0, 0, 0]
    gap = Graph.from_edges(spark.createDataFrame([(5, 900)], "src long, dst long"))
    assert (gap.meta.rule_base, gap.meta.vertex_cnt) == (901, 2)


def test_golden_algorithms(spark):
    for rows, root0, labels, topo in ((G3, [0, 1, 1], [0, 0, 0], [None] * 3), (G6, [0, None, 1, 1, 1, 1], [0, 1, 0, 0, 0, 0], [None, 0, None, None, None, None]), (DAG6, [0, None, 1, 1, 1, 2], [0, 1, 0, 0, 0, 0], [0, 0, 1, 2, 3, 4])):
        g = graph(spark, rows)
        assert column(sssp(g, 0), "dist") == root0
        assert column(bfs(g, 0), "level") == root0
        assert column(cc_directed(g), "label") == labels
        assert column(wcc(g), "label") == [0] * len(rows)
        assert column(topo_levels(g), "level") == topo
    assert column(bfs(graph(spark, DAG6), 0), "parent") == [0, None, 0, 0, 0, 2]
    assert column(pagerank(graph(spark, G6)), "rank") == pytest.approx([0.1571725, 0.025, 0.06423773, 0.08266001, 0.08266001, 0.15371964], abs=1e-7)
    c = repair(graph(spark, G6), batch=1)
    assert column(pagerank(c, teleport="V+R"), "rank") == pytest.approx([0.10967045, 0.01666667, 0.04425365, 0.05709824, 0.05709824, 0.10677607], abs=1e-7)
    h = hits(c, 1, norm="sumsq", naming="reference")
    assert column(h, "authority") == pytest.approx([4 / 43, 4 / 43, 3 / 43, 0, 1 / 43, 1 / 43])
    assert column(h, "hub") == pytest.approx([1 / 39, 0, 2 / 39, 3 / 39, 3 / 39, 4 / 39])
    assert [r["id"] for r in hits_top(h, 2).collect()] == [0, 1]


def shuffled_runs(seed, n=10):
    """Rows from a small pool of runs, some with multi-edges."""
    rng = random.Random(seed)
    pool = [rng.sample(range(n), rng.randrange(2, 6)) for _ in range(4)]
    return [sum((rng.choice(pool) for _ in range(rng.randrange(3))), []) + [rng.randrange(n)] * rng.randrange(3) for _ in range(n)]


def expanded(c):
    """The plain rows of a grammar, in Python, and checks of its form on the way."""
    body = bodies(c)
    base = c.meta.rule_base
    rules = sorted(i for i in body if i >= base)
    assert rules == list(range(base, base + c.meta.rule_cnt))
    assert all(x < i for i in rules for x in body[i])
    used = {x for r in body.values() for x in r}
    assert set(rules) <= used

    def spell(x):
        return [x] if x < base else [y for z in body[x] for y in spell(z)]

    return {i: [y for x in r for y in spell(x)] for i, r in body.items() if i < base}


@pytest.fixture(scope="module")
def twenty(spark):
    """Twenty random graphs of ten vertices side by side, as one graph of two hundred."""
    rows = [[d + 10 * seed for d in row] for seed in range(20) for row in shuffled_runs(seed)]
    g = graph(spark, rows)
    return rows, g, repair(g)


@pytest.mark.parametrize("prune", [None, 0, -1, "and", "or", "flat"])
def test_grammars_of_twenty_graphs_are_lossless(spark, twenty, prune):
    rows, _, full = twenty
    if prune is None:
        c = full
    elif prune == "flat":
        c = flatten_rules(filter_rules(full, 0))
        assert c.strings.filter(c.is_rule("id") & c.is_rule("sym")).isEmpty()
    else:
        c = filter_rules(full, prune) if isinstance(prune, int) else filter_rules_decomposed(full, 3, 3, mode=prune)
    if prune != "flat":
        assert expanded(c) == dict(enumerate(rows))
    assert c.uses_rules()
    back = {}
    for r in decompress(c).edges.orderBy("src", "pos").collect():
        back.setdefault(r["src"], []).append(r["dst"])
    assert [back.get(v, []) for v in range(len(rows))] == rows


def brute_levels(rows):
    """Longest paths from vertices without in-edges; None on or behind a cycle."""
    waits = [sum(row.count(v) for row in rows) for v in range(len(rows))]
    level, fresh = {v: 0 for v, w in enumerate(waits) if not w}, [v for v, w in enumerate(waits) if not w]
    top = dict.fromkeys(range(len(rows)), 0)
    while fresh:
        v = fresh.pop()
        for d in rows[v]:
            top[d], waits[d] = max(top[d], level[v] + 1), waits[d] - 1
            if not waits[d]:
                level[d] = top[d]
                fresh.append(d)
    return [level.get(v) for v in range(len(rows))]


@pytest.mark.parametrize("schedule", ["flat", "levels"])
def test_answers_on_the_grammar_of_twenty_graphs_are_the_plain_ones(spark, twenty, schedule):
    rows, g, full = twenty
    c = full.scheduled(schedule)
    assert c.max_level >= 1
    # a root in each of the twenty
    starts = VertexProgram(lambda x: x.vertices.filter("id % 10 = 0").select("id", F.lit(0).cast("long").alias("val")), lambda _, val, weight: val + weight)
    hops = {r["id"]: r["val"] for r in run_program(c, starts).collect()}
    want = {}
    for seed in range(20):
        near, seen = [10 * seed], {10 * seed: 0}
        while near:
            near = [d for v in near for d in rows[v] if seen.setdefault(d, seen[v] + 1) == seen[v] + 1]
            near = [d for d in dict.fromkeys(near) if seen[d] == max(seen.values())]
        want |= seen
    assert hops == want
    assert column(topo_levels(c), "level") == brute_levels(rows)
    assert column(cc_directed(c), "label") == column(cc_directed(g), "label")
    assert column(wcc(c), "label") == column(wcc(g), "label")
    assert column(pagerank(c, 0.85, 3, eps=None), "rank") == pytest.approx(column(pagerank(g, 0.85, 3, eps=None), "rank"))
    for x in ("hub", "authority"):
        assert column(hits(c, 2), x) == pytest.approx(column(hits(g, 2), x))
    assert column(c.out_degrees(), "out_degree") == [len(r) for r in rows]
    assert column(c.in_degrees(), "in_degree") == [sum(r.count(v) for r in rows) for v in range(len(rows))]


def test_searches_on_a_grammar(spark, twenty):
    rows, g, full = twenty
    assert column(sssp(full, 30), "dist") == column(sssp(g, 30), "dist")
    assert column(bfs(full, 30), "parent") == column(bfs(g, 30), "parent")
    reach = {r["id"] for r in bfs_compressed(full, 30).filter("parent IS NOT NULL").collect() if r["id"] < len(rows)}
    assert reach == {r["id"] for r in bfs(g, 30).filter("level IS NOT NULL").collect()}


def test_long_paths_are_compacted_on_the_way_and_nothing_is_left(spark, tmp_path):
    n = 30
    g = graph(spark, [[v + 1] if v + 1 < n else [0] for v in range(n)])
    assert column(sssp(g, 0), "dist") == list(range(n))
    assert column(cc_directed(g), "label") == [0] * n
    line = graph(spark, [[v + 1] if v + 1 < n else [] for v in range(n)])
    assert column(topo_levels(line), "level") == list(range(n))
    with pytest.raises(RuntimeError, match="not settled after 3 rounds"):
        run_program(g, VertexProgram(lambda x: x.vertices.filter("id = 0").select("id", F.lit(0).cast("long").alias("val")), lambda _, val, weight: val + weight), max_iter=3)


def test_programs_in_rounds(spark):
    g = graph(spark, DAG6)
    # how many walks of up to two edges end at each vertex
    walks = RoundProgram(
        init=lambda x: x.vertices.select("id", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("all")),
        send=lambda: {"got": F.col("n")},
        combine={"got": "sum"},
        apply=lambda joined, _: joined.select("id", F.coalesce("got", F.lit(0)).alias("n"), (F.col("all") + F.coalesce("got", F.lit(0))).alias("all")),
    )
    for x in (g, repair(g, batch=1)):
        assert column(run_rounds(x, walks, 2), "all") == [1, 1, 3, 6, 10, 13]
    stops = RoundProgram(walks.init, walks.send, walks.combine, walks.apply, unfinished=lambda s: not s.filter("n > 0").isEmpty())
    assert column(run_rounds(g, stops, 100, settles=True), "all") == [1, 1, 3, 6, 12, 22]


def test_programs_weights_and_frontiers(spark):
    e = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double")
    g = Graph.from_edges(e)
    assert column(sssp(g, 0, weighted=True), "dist") == [0, 2, 1]
    bad = Graph.from_edges(spark.createDataFrame([(0, 1, -1.0), (1, 0, -1.0)], "src long, dst long, weight double"))
    with pytest.raises(ValueError, match="negative cycle"):
        sssp(bad, 0, weighted=True)
    widest = VertexProgram(lambda x: x.vertices.select("id", F.col("id").alias("val")), lambda _, val, __: val, combine="max")
    assert column(run_program(g, widest), "val") == [0, 2, 2]
    start = vertex_map(vertex_subset(g, 0), one=F.lit(1))
    assert column(edge_map(g, start, {"one": "sum"}), "id") == [1, 2]
    with pytest.raises(ValueError, match="not a vertex"):
        Graph(e, spark.range(2)).validate()


@pytest.mark.parametrize("part", [1, 3, 4096])
def test_decompress_spells_out_rules_in_one_join(spark, part):
    # rules 100 to 103, one within the next, and 104 without a body; places have gaps, rows have segments
    bodies = {100: [7, 8, 9], 101: [1, 100, 2], 102: [101, 101], 103: [100, 102, 5]}
    symbols = {0: [[103, 3], [100]], 1: [[4, 102, 104, 4]], 2: [[6]]}
    strings = [(r, 0, 10 * k - 1, x) for r, body in bodies.items() for k, x in enumerate(body)]
    strings += [(v, seg, 5 * k, x) for v, segs in symbols.items() for seg, xs in enumerate(segs) for k, x in enumerate(xs)]

    def spelt(x):
        return [x] if x < 100 else [z for y in bodies.get(x, []) for z in spelt(y)]

    c = CompressedGraph(spark.createDataFrame(strings, "id long, seg long, pos long, sym long"), spark.range(10), None, GraphMeta(10, 5, 100))
    got = decompress(c, part).edges
    want = sorted((v, z, k) for v, segs in symbols.items() for k, z in enumerate(z for xs in segs for x in xs for z in spelt(x)))
    assert sorted(map(tuple, got.select("src", "dst", "pos").collect())) == want
    # what spells out the rows is neither sorted by place nor numbered, where nobody asks for places
    assert "Window" not in got.select("src", "dst")._jdf.queryExecution().optimizedPlan().toString()
