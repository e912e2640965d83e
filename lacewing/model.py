"""Graphs, plain and rule-compressed.

A plain graph is an edge multiset with an explicit vertex table. A compressed graph
holds one symbol per row: a vertex, or a rule standing for a run of symbols. Rules are
numbered from ``rule_base``, above every vertex id, so ids may have gaps.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.session import settled, written

#: Symbols of one adjacency row that are compressed together. Longer rows are cut, so
#: that no hub becomes one group; a rule never spans a cut.
SEGMENT = 4096


@dataclass(frozen=True)
class GraphMeta:
    vertex_cnt: int
    rule_cnt: int
    rule_base: int

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.vertex_cnt, self.rule_cnt)], "vertex_cnt long, rule_cnt long")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _with_zero(vertices: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    return vertices.join(counts, "id", "left").select("id", F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name))


@dataclass
class Graph:
    """``edges(src, dst [, pos] [, weight])`` and ``vertices(id)``.

    ``pos`` gives the order within an adjacency row; without it a row is sorted by
    ``dst``. Duplicate edges and self-loops are kept. ``derived`` says that the vertices
    are the ends of the edges and no others.
    """

    edges: DataFrame
    vertices: DataFrame
    derived: bool = False
    spark: SparkSession = field(init=False)

    def __post_init__(self) -> None:
        self.spark = self.edges.sparkSession

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, dense: bool = False) -> Graph:
        """A graph from any table with ``src`` and ``dst``; rows with a null end are refused.

        ``vertices`` defaults to the ends of edges, or with ``dense`` to all of 0..max.
        """
        more = [c for c in ("pos", "weight") if c in edges.columns]
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *more)
        if vertices is None and dense:
            top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
            vertices = edges.sparkSession.range(0 if top is None else top + 1)
        elif vertices is None:
            return cls(edges, _ends(edges), derived=True)
        return cls(edges, vertices.select(F.col("id").cast("long").alias("id")))

    @cached_property
    def kept(self) -> Graph:
        """This graph as tables in the shared folder, written once: what makes it is not run again."""
        edges = written(self.edges, "edges")
        out = Graph(edges, written(_ends(edges) if self.derived else self.vertices, "vertices"))
        out.__dict__["kept"] = out
        return out

    def out_degrees(self) -> DataFrame:
        return _with_zero(self.vertices, self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree")), "out_degree")

    def in_degrees(self) -> DataFrame:
        return _with_zero(self.vertices, self.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree")), "in_degree")

    def validate(self) -> Graph:
        """Raise unless each edge joins two known vertices."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        if ends.join(self.vertices, "id", "left_anti").limit(1).count():
            raise ValueError("an edge ends at an id that is not a vertex")
        return self

    @cached_property
    def meta(self) -> GraphMeta:
        n, top = self.vertices.agg(F.count(F.lit(1)), F.max("id")).first()
        return GraphMeta(n, 0, (-1 if top is None else top) + 1)

    @cached_property
    def links(self) -> DataFrame:
        """``(src, dst, mult [, weight])``: equal edges are one row."""
        keys = ["src", "dst", *(["weight"] if "weight" in self.edges.columns else [])]
        return written(self.edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("mult")), "links")

    def symbols(self, segment: int = SEGMENT) -> DataFrame:
        """``(id, seg, pos, sym)``: adjacency rows as strings, in order, cut into segments."""
        from lacewing.functions import placed_in_group

        if "pos" in self.edges.columns:
            placed = self.edges.select("src", "dst", F.col("pos").cast("long").alias("pos"))
        else:
            placed = placed_in_group(self.edges.select("src", "dst"), "src", ["dst"])
        return placed.select(F.col("src").alias("id"), F.floor(F.col("pos") / segment).alias("seg"), "pos", F.col("dst").alias("sym"))

    def symmetrized(self) -> Graph:
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return Graph(self.edges.select("src", "dst").unionByName(back), self.vertices)

    def transposed(self) -> Graph:
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), self.vertices)

    def deduplicated(self) -> Graph:
        return Graph(self.edges.select("src", "dst").distinct(), self.vertices)

    def csr(self, dense: bool = False) -> tuple[DataFrame, DataFrame]:
        """``vlist(idx, offset)`` with one closing row, and ``elist(idx, dst)``.

        ``idx`` counts vertices in id order; ``dst`` keeps original ids, or with ``dense`` is
        such a number too, as the file formats need where ids have gaps.
        """
        return _csr(self.out_degrees().withColumnRenamed("out_degree", "size"), self.symbols().select("id", "pos", F.col("sym").alias("dst")), ["id", "pos"], dense)


def _csr(sizes: DataFrame, targets: DataFrame, order: list[str], dense: bool) -> tuple[DataFrame, DataFrame]:
    """Offsets of rows ``sizes(id, size)``, and ``targets(id, ..., dst)`` in ``order``."""
    from lacewing.functions import indexed, running_total

    rows = written(indexed(running_total(sizes, ["id"], "size"), ["id"]).select("id", "idx", "offset", "size"), "rows")
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    vlist = rows.select("idx", "offset").unionByName(sizes.sparkSession.createDataFrame([(n, total or 0)], "idx long, offset long"))
    elist = indexed(targets, order)
    if dense:
        elist = elist.join(rows.select(F.col("id").alias("dst"), F.col("idx").alias("to")), "dst").select("idx", F.col("to").alias("dst"))
    return vlist, elist.select("idx", "dst")


@dataclass
class CompressedGraph:
    """A grammar: ``strings(id, seg, pos, sym)`` for vertices and, from ``rule_base``, rules.

    ``edges`` are those of the plain graph, where they are at hand; algorithms don't need them.
    ``schedule`` says how values pass through rules within rules: ``"flat"`` expands each
    rule that a row uses to its vertices, once; ``"levels"`` hands partial results down (or up)
    level by level, so that rules share the work of the rules in them.
    """

    strings: DataFrame
    vertices: DataFrame
    edges: DataFrame | None
    meta: GraphMeta
    order: DataFrame | None = None
    schedule: str = "flat"

    def __post_init__(self) -> None:
        self.spark = self.strings.sparkSession
        if self.schedule not in ("flat", "levels"):
            raise ValueError(f"schedule is 'flat' or 'levels', not {self.schedule!r}")

    def scheduled(self, schedule: str) -> CompressedGraph:
        return CompressedGraph(self.strings, self.vertices, self.edges, self.meta, self.order, schedule)

    def uses_rules(self) -> bool:
        """Whether the row of any vertex has a rule in it."""
        return not self.strings.filter(~self.is_rule("id") & self.is_rule("sym")).isEmpty()

    @cached_property
    def degrees(self) -> DataFrame:
        """``(id, out_degree)`` in the plain graph, from the lengths that symbols stand for."""
        from lacewing.plans.propagate import push

        one = self.vertices.select("id", F.lit(1).cast("long").alias("out_degree"))
        return written(_with_zero(self.vertices, push(self, one, {"out_degree": "sum"}, reverse=True), "out_degree"), "degrees")

    def out_degrees(self) -> DataFrame:
        return self.degrees

    def in_degrees(self) -> DataFrame:
        from lacewing.plans.propagate import push

        one = self.vertices.select("id", F.lit(1).cast("long").alias("in_degree"))
        return _with_zero(self.vertices, push(self, one, {"in_degree": "sum"}), "in_degree")

    def nodes(self) -> DataFrame:
        """``(id, is_rule, body)``, with empty rows: for inspection, as it gathers rows."""
        body = self.strings.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seg", "pos", "sym"))).alias("s")).select("id", F.transform("s", lambda x: x["sym"]).alias("body"))
        ids = self.vertices.unionByName(self.strings.filter(F.col("id") >= self.meta.rule_base).select("id").distinct())
        empty = F.array().cast("array<long>")
        return ids.join(body, "id", "left").select("id", (F.col("id") >= self.meta.rule_base).alias("is_rule"), F.coalesce("body", empty).alias("body"))

    def csr(self) -> tuple[DataFrame, DataFrame]:
        """The CSR of V rows of vertices and R of rules, numbered densely in id order: ``vlist``, ``elist``."""
        ids = self.vertices.unionByName(self.strings.filter(self.is_rule("id")).select("id").distinct())
        sizes = _with_zero(ids, self.strings.groupBy("id").agg(F.count(F.lit(1)).alias("size")), "size")
        return _csr(sizes, self.strings.select("id", "seg", "pos", F.col("sym").alias("dst")), ["id", "seg", "pos"], dense=True)

    @classmethod
    def from_csr(cls, plain: Graph, vertex_cnt: int, rule_cnt: int, edges: DataFrame | None = None) -> CompressedGraph:
        """The grammar in a graph of ``vertex_cnt`` rows of vertices and then ``rule_cnt`` of rules."""
        strings = plain.symbols().select("id", "seg", "pos", "sym")
        return cls(strings, plain.vertices.filter(F.col("id") < vertex_cnt), edges, GraphMeta(vertex_cnt, rule_cnt, vertex_cnt))

    def is_rule(self, column: str):
        return F.col(column) >= F.lit(self.meta.rule_base)

    @cached_property
    def rule_order(self) -> DataFrame:
        if self.order is None:
            from lacewing.operators.levels import rule_levels

            self.order = rule_levels(self)
        return self.order

    @cached_property
    def max_level(self) -> int:
        top = self.rule_order.agg(F.max("level")).first()[0]
        return -1 if top is None else top

    @cached_property
    def cedges(self) -> DataFrame:
        return written(self.strings.groupBy(F.col("id").alias("src"), F.col("sym").alias("dst")).agg(F.count(F.lit(1)).alias("mult")), "cedges")

    @cached_property
    def links(self) -> DataFrame:
        """``(src, dst, mult)`` of the rows of vertices; ``dst`` is a vertex or a rule."""
        return self.cedges.filter(~self.is_rule("src"))

    @cached_property
    def level_links(self) -> DataFrame:
        """``(src, dst, mult, level)`` of the bodies of rules; ``level`` is that of the rule ``src``."""
        level = self.rule_order.filter("level IS NOT NULL").select(F.col("id").alias("src"), "level")
        return written(self.cedges.filter(self.is_rule("src")).join(level, "src"), "levels")

    @cached_property
    def rule_links(self) -> DataFrame:
        """``(src, dst, mult)``: the vertices that a rule used in a row stands for, and how often.

        Rules within rules are expanded here, once, in as many rounds as the logarithm of
        their depth. Rows spell out the plain graph, so this is no longer than its edges.
        """
        links = self.cedges.filter(self.is_rule("src"))
        while not links.filter(self.is_rule("dst")).isEmpty():
            inner = links.select(F.col("src").alias("rule"), F.col("dst").alias("to"), F.col("mult").alias("times"))
            nested = links.filter(self.is_rule("dst")).join(inner, F.col("dst") == F.col("rule"))
            nested = nested.select("src", F.col("to").alias("dst"), (F.col("mult") * F.col("times")).alias("mult"))
            links = links.filter(~self.is_rule("dst")).unionByName(nested)
            links = settled(links.groupBy("src", "dst").agg(F.sum("mult").alias("mult")))
        used = self.links.filter(self.is_rule("dst")).select(F.col("dst").alias("src")).distinct()
        return written(links.join(used, "src", "left_semi"), "rule-links")

    def size(self) -> int:
        """Offsets plus symbols, as a CSR of rows and rules has them."""
        return self.meta.vertex_cnt + self.meta.rule_cnt + 1 + self.strings.count()

    def ratio(self) -> float:
        """Size of the plain CSR over that of the grammar; over 1 means smaller."""
        edge_cnt = self.degrees.agg(F.coalesce(F.sum("out_degree"), F.lit(0))).first()[0]
        return (self.meta.vertex_cnt + 1 + edge_cnt) / self.size()
