import random

from pyspark.sql import functions as F

from lacewing import Graph
from lacewing.operators import decompress, filter_rules, grammar, repair


def replaced(monkeypatch):
    """The rules of each round, as they come."""
    rounds, plain = [], grammar._replaced

    def counted(segments, new, *more):
        rounds.append(len(new))
        return plain(segments, new, *more)

    monkeypatch.setattr(grammar, "_replaced", counted)
    return rounds


def test_rounds_do_not_grow_with_the_number_of_different_pairs(spark, monkeypatch):
    """Rows 3k and 3k + 1 both hold a pair that no others hold: all pairs go in one round."""
    n, rounds = 40_000, replaced(monkeypatch)
    rows = spark.range(n).select(F.explode(F.array(F.col("id") * 3, F.col("id") * 3 + 1)).alias("src"), (F.col("id") * 2 + 1_000_000).alias("a"))
    edges = rows.select("src", F.explode(F.array("a", F.col("a") + 1)).alias("dst"))
    c = repair(Graph.from_edges(edges))
    assert rounds == [n] and c.meta.rule_cnt == n
    assert c.strings.filter(~c.is_rule("id")).count() == 2 * n
    assert decompress(c).edges.select("src", "dst").exceptAll(edges).isEmpty()


def test_executors_choose_and_filter_pairs(spark, monkeypatch):
    """With next to nothing gathered by the driver: disjoint pairs, none left that repeats, the same rows."""
    monkeypatch.setattr(grammar, "GATHERED", 3)
    rounds, rng = replaced(monkeypatch), random.Random(5)
    motifs = [[rng.randrange(40) for _ in range(rng.randint(2, 6))] for _ in range(12)]
    rows = [[x for _ in range(rng.randint(0, 6)) for x in rng.choice([*motifs, [rng.randrange(60)], [7] * rng.randint(1, 5)])] for _ in range(60)]
    edges = spark.createDataFrame([(v, d, p) for v, row in enumerate(rows) for p, d in enumerate(row)], "src long, dst long, pos long")
    c = repair(Graph(edges, spark.range(60)), segment=16)
    bodies = c.strings.filter(c.is_rule("id")).groupBy("id").count()
    assert c.meta.rule_cnt == sum(rounds) == bodies.count() == bodies.filter("count = 2").count() > 20
    assert grammar.pair_frequency(c.strings.filter(~c.is_rule("id"))).isEmpty()
    back = {v: [] for v in range(60)}
    for r in decompress(c).edges.orderBy("src", "pos").collect():
        back[r["src"]].append(r["dst"])
    assert list(back.values()) == rows


def test_done_segments_are_not_read_again(spark, monkeypatch):
    """Rows without a pair that repeats are looked at in the first round only."""
    sizes, plain = [], grammar._frequencies

    def counted(segments, *known):
        sizes.append(segments.count())
        return plain(segments, *known)

    monkeypatch.setattr(grammar, "_frequencies", counted)
    rows = [[1, 2, 3, 4, 5, 6, 7, 8]] * 2 + [[100 + 2 * k, 101 + 2 * k] for k in range(500)]
    edges = spark.createDataFrame([(v, d, p) for v, row in enumerate(rows) for p, d in enumerate(row)], "src long, dst long, pos long")
    repair(Graph(edges, spark.range(2000)))
    assert len(sizes) > 2 and sizes[0] == 502 and max(sizes[1:]) < 60 and sizes[2] == 2


def test_segments_of_sorted_edges(spark):
    """Cut as edges come sorted, over partitions and batches, or by places: the same segments."""
    rng = random.Random(3)
    edges = [(v, rng.randrange(500)) for v in range(300) for _ in range(rng.choice([1, 2, 9]))] + [(v, rng.randrange(900)) for v in (50, 51, 299) for _ in range(4000)]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"))
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = sorted(map(tuple, grammar._sorted_segments(g.edges, 64)[0].collect()))
        want = sorted(map(tuple, grammar._segments(g.symbols(64)).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old[1])
    assert got == want


def test_pruning_by_places_and_anew(spark, monkeypatch):
    """Bodies spliced by places give the rows that numbering everything anew gives."""
    rng = random.Random(8)
    motifs = [sorted(rng.sample(range(60), rng.randint(2, 7))) for _ in range(6)]
    rows = [[x for _ in range(4) for x in rng.choice(motifs)] for _ in range(40)]
    edges = spark.createDataFrame([(v, d, p) for v, row in enumerate(rows) for p, d in enumerate(row)], "src long, dst long, pos long")
    c = repair(Graph(edges, spark.range(60)))
    # a place this far off leaves no room for bodies
    far = c.strings.withColumn("pos", F.col("pos") + (1 << 61))
    anew = type(c)(far, c.vertices, c.edges, c.meta)
    near, other = filter_rules(c, 0), filter_rules(anew, 0)
    assert 0 < near.meta.rule_cnt < c.meta.rule_cnt
    assert {r["id"]: r["body"] for r in near.nodes().collect()} == {r["id"]: r["body"] for r in other.nodes().collect()}
    assert decompress(near).edges.select("src", "dst").exceptAll(edges.select("src", "dst")).isEmpty()
