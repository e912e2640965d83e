"""The engine's queries over the driver's tables, and what DuckDB should say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacewing import datasets as D
from lacewing.model import CompressedGraph, Graph
from lacewing.operators import grammar, pruning, ranking, traversal
from lacewing.operators.levels import rule_levels

Query = Callable[[SparkSession, str], DataFrame]
ROOT = D.BASE["region"]
#: Prunes some of the rules of the given grammar at each scale.
GIVEN_THRESHOLD = 150


def _ruled(c: CompressedGraph) -> CompressedGraph:
    """``c``, unless no row has a rule in it: a query on it would only look at the plain graph again."""
    if not c.uses_rules():
        raise RuntimeError("no rule is left in the rows of the compressed graph")
    return c


def _compressed(make: Callable[[SparkSession, str], Graph], threshold: int | None = 0, schedule: str = "flat") -> Callable[[SparkSession, str], CompressedGraph]:
    """The grammar of a graph, pruned at ``threshold`` (None: not at all); rows that use rules are certain."""

    def made(spark: SparkSession, d: str) -> CompressedGraph:
        c = grammar.repair(make(spark, d))
        c = c if threshold is None else pruning.filter_rules(c, threshold)
        return _ruled(c).scheduled(schedule)

    return made


def _ends(g: Graph) -> DataFrame:
    return g.edges.select("src", "dst")


def _ranks(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("rank", 6).alias("rank"))


def _scores(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    c = grammar.repair(D.supplier_parts(spark, d))
    kept = pruning.filter_rules(c, 0)
    rows = [("unfiltered", c.meta.rule_cnt, c.ratio(), c.max_level, c.uses_rules()), ("filter 0", kept.meta.rule_cnt, kept.ratio(), kept.max_level, kept.uses_rules())]
    return spark.createDataFrame(rows, "grammar string, rules long, ratio double, max_level long, used boolean")


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    """The rows and bodies that are left of the given grammar, rules without rules in them, symbol by symbol."""
    c = pruning.filter_rules(D.given_grammar(spark, d, nested=False), GIVEN_THRESHOLD)
    return c.strings.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("seg", "pos")) - 1).cast("long").alias("pos"), "sym")


def _compressed_csr(spark: SparkSession, d: str, which: int) -> DataFrame:
    return D.given_grammar(spark, d).csr()[which]


def queries() -> dict[str, Query]:
    sp, lines, hier, ev, cs = D.supplier_parts, D.supplier_lines, D.hierarchy, D.event_chain, D.customer_suppliers
    csp, chier, cev = _compressed(sp), _compressed(hier), _compressed(ev)
    return {
        "degree": lambda s, d: hier(s, d).out_degrees(),
        "degree_compressed": lambda s, d: csp(s, d).out_degrees(),
        "in_degree": lambda s, d: hier(s, d).in_degrees(),
        "csr_offsets": lambda s, d: hier(s, d).csr()[0],
        "csr_targets": lambda s, d: hier(s, d).csr()[1],
        "csr_compressed_offsets": lambda s, d: _compressed_csr(s, d, 0),
        "csr_compressed_targets": lambda s, d: _compressed_csr(s, d, 1),
        "pair_frequency": lambda s, d: grammar.pair_frequency(lines(s, d).symbols()),
        "roundtrip_edges": lambda s, d: _ends(grammar.decompress(_ruled(grammar.repair(sp(s, d))))),
        "roundtrip_multigraph": lambda s, d: _ends(grammar.decompress(_compressed(lines, None)(s, d))),
        "roundtrip_filtered": lambda s, d: _ends(grammar.decompress(csp(s, d))),
        "roundtrip_filter_decomp": lambda s, d: _ends(grammar.decompress(_ruled(pruning.filter_rules_decomposed(grammar.repair(sp(s, d)))))),
        "roundtrip_flattened": lambda s, d: _ends(grammar.decompress(_ruled(pruning.flatten_rules(csp(s, d))))),
        "roundtrip_given": lambda s, d: _ends(grammar.decompress(D.given_grammar(s, d))),
        "filter_given": _filtered,
        "bfs_levels": lambda s, d: traversal.bfs(hier(s, d), ROOT).select("id", "level"),
        "bfs_parents": lambda s, d: traversal.bfs(hier(s, d), ROOT).select("id", "parent"),
        "bfs_levels_compressed": lambda s, d: traversal.bfs(chier(s, d), ROOT).select("id", "level"),
        "bfs_reach_compressed": lambda s, d: _reach(_compressed(hier, None)(s, d)),
        "sssp": lambda s, d: traversal.sssp(hier(s, d), ROOT),
        "sssp_compressed": lambda s, d: traversal.sssp(chier(s, d), ROOT),
        "sssp_weighted": lambda s, d: traversal.sssp(_weighted(hier(s, d)), ROOT, weighted=True),
        "cc_directed": lambda s, d: traversal.cc_directed(ev(s, d)),
        "cc_directed_compressed": lambda s, d: traversal.cc_directed(cev(s, d)),
        "cc_directed_hierarchy": lambda s, d: traversal.cc_directed(hier(s, d)),
        "cc_directed_compressed_hierarchy": lambda s, d: traversal.cc_directed(chier(s, d)),
        "wcc": lambda s, d: traversal.wcc(ev(s, d)),
        "wcc_compressed": lambda s, d: traversal.wcc(cev(s, d)),
        "wcc_hierarchy": lambda s, d: traversal.wcc(hier(s, d)),
        "topo_levels": lambda s, d: traversal.topo_levels(hier(s, d)),
        "topo_levels_compressed": lambda s, d: traversal.topo_levels(chier(s, d)),
        "pagerank_10": lambda s, d: _ranks(ranking.pagerank(ev(s, d), eps=None)),
        "pagerank_compressed_10": lambda s, d: _ranks(ranking.pagerank(cev(s, d), eps=None)),
        "pagerank_by_levels_10": lambda s, d: _ranks(ranking.pagerank(_compressed(ev, 0, "levels")(s, d), eps=None)),
        "pagerank_bipartite_10": lambda s, d: _ranks(ranking.pagerank(cs(s, d), eps=None)),
        "pagerank_dangling_10": lambda s, d: _ranks(ranking.pagerank(cs(s, d), eps=None, dangling="uniform")),
        "hits_5": lambda s, d: _scores(ranking.hits(sp(s, d), 5)),
        "hits_compressed_5": lambda s, d: _scores(ranking.hits(csp(s, d), 5)),
        "hits_by_levels_5": lambda s, d: _scores(ranking.hits(_compressed(sp, 0, "levels")(s, d), 5)),
        "hits_topk": lambda s, d: ranking.hits_top(_scores(ranking.hits(sp(s, d), 5)), 20),
        "edge_list_symmetrize": lambda s, d: _ends(ev(s, d).symmetrized()),
        "transpose": lambda s, d: _ends(ev(s, d).transposed()),
        "dedup": lambda s, d: _ends(ev(s, d).deduplicated()),
        "compression_stats": _statistics,
        "rule_order": lambda s, d: rule_levels(grammar.repair(sp(s, d))),
        "rule_order_given": lambda s, d: rule_levels(D.given_grammar(s, d)),
        "rule_stats": lambda s, d: pruning.rule_statistics(grammar.repair(sp(s, d))),
        "rule_stats_given": lambda s, d: pruning.rule_statistics(D.given_grammar(s, d)),
    }


def _reach(c: CompressedGraph) -> DataFrame:
    return traversal.bfs_compressed(c, ROOT).filter((F.col("id") < c.meta.rule_base) & F.col("parent").isNotNull()).select("id")


def _weighted(g: Graph) -> Graph:
    return Graph(g.edges.withColumn("weight", (F.col("dst") % 7 + 1).cast("double")), g.vertices)


_SP = "SELECT DISTINCT l_suppkey + 1000 AS src, l_partkey + 100000 AS dst FROM lineitem"
_HIER = """SELECT DISTINCT * FROM (
  SELECT n_regionkey::BIGINT AS src, n_nationkey::BIGINT + 100 AS dst FROM nation
  UNION ALL SELECT s_nationkey + 100, s_suppkey + 1000 FROM supplier
  UNION ALL SELECT c_nationkey + 100, c_custkey + 1000000 FROM customer
  UNION ALL SELECT o_custkey + 1000000, o_orderkey + 10000000 FROM orders
  UNION ALL SELECT l_suppkey + 1000, l_partkey + 100000 FROM lineitem
  UNION ALL SELECT l_orderkey + 10000000, l_partkey + 100000 FROM lineitem)"""
_EV = """SELECT src, dst FROM (SELECT user_id AS src,
  lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events)
  WHERE src IS NOT NULL AND dst IS NOT NULL"""
_LINES = "SELECT l_suppkey + 1000 AS src, l_partkey + 100000 AS dst FROM lineitem"
#: Rows and bodies of the given grammar; its rules are nations.
_GIVEN = """SELECT s_suppkey::BIGINT + 1000 AS id, 0 AS pos, s_nationkey::BIGINT + 10000000 AS sym FROM supplier
  UNION ALL SELECT c_nationkey + 10000000, c_custkey, c_custkey + 1000000 FROM customer"""
_NESTED = _GIVEN + " UNION ALL SELECT n_nationkey + 10000000, -1, n_nationkey + 10000000 - 5 FROM nation WHERE n_nationkey >= 5"
_CS = "SELECT o_custkey + 1000000 AS src, l_suppkey + 1000 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _with(edges: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}e AS ({edges}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e){more}"


def _walk(edges: str, cost: str = "1") -> str:
    return _with(edges, f", w AS (SELECT {ROOT}::BIGINT AS id, 0::BIGINT AS d UNION SELECT e.dst, w.d + {cost} FROM w JOIN e ON e.src = w.id WHERE w.d < 100)", True)


def _label(edges: str) -> str:
    return _with(edges, ", w AS (SELECT id, id AS label FROM v UNION SELECT e.dst, w.label FROM w JOIN e ON e.src = w.id)", True) + " SELECT id, min(label) AS label FROM w GROUP BY id"


def _pagerank(edges: str, rounds: int, uniform: bool = False) -> str:
    out = _with(edges, """, o AS (SELECT src, count(*) AS n FROM e GROUP BY src), c AS (SELECT count(*) AS n FROM v),
      l AS (SELECT src, dst, count(*) AS m FROM e GROUP BY src, dst),
      r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT n FROM c) AS rank FROM v)""")
    for i in range(rounds):
        lost = f"+ 0.85::DOUBLE * (SELECT sum(rank) FROM r{i} WHERE id NOT IN (SELECT src FROM o)) / (SELECT n FROM c)" if uniform else ""
        out += f""", r{i + 1} AS MATERIALIZED (SELECT v.id, 0.85::DOUBLE * coalesce(s, 0) + 0.15::DOUBLE / (SELECT n FROM c) {lost} AS rank
          FROM v LEFT JOIN (SELECT l.dst, sum(r.rank * l.m / o.n) AS s FROM l JOIN r{i} r ON r.id = l.src JOIN o ON o.src = l.src GROUP BY l.dst) g ON g.dst = v.id)"""
    return out + f" SELECT id, round(rank, 6) AS rank FROM r{rounds}"


def _hits(edges: str, rounds: int) -> str:
    out = _with(edges, ", h0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS authority FROM v)")
    for i in range(rounds):
        out += f""", n{i} AS MATERIALIZED (SELECT v.id, coalesce(h, 0) AS h, coalesce(a, 0) AS a FROM v
            LEFT JOIN (SELECT dst, sum(hub) AS a FROM e JOIN h{i} ON h{i}.id = src GROUP BY dst) x ON x.dst = v.id
            LEFT JOIN (SELECT src, sum(authority) AS h FROM e JOIN h{i} ON h{i}.id = dst GROUP BY src) y ON y.src = v.id),
          h{i + 1} AS MATERIALIZED (SELECT id, h / (SELECT sqrt(sum(h * h)) FROM n{i}) AS hub, a / (SELECT sqrt(sum(a * a)) FROM n{i}) AS authority FROM n{i})"""
    return out + f" SELECT id, round(hub, 6) AS hub, round(authority, 6) AS authority FROM h{rounds}"


def oracle_sql() -> dict[str, str]:
    levels = _walk(_HIER) + " SELECT v.id, min(w.d) AS level FROM v LEFT JOIN w ON w.id = v.id GROUP BY v.id"
    distances = _walk(_HIER) + " SELECT v.id, min(w.d) AS dist FROM v LEFT JOIN w ON w.id = v.id GROUP BY v.id"
    parents = _walk(_HIER) + f""", b AS (SELECT v.id, min(w.d) AS level FROM v LEFT JOIN w ON w.id = v.id GROUP BY v.id)
      SELECT b.id, CASE WHEN b.id = {ROOT} THEN b.id ELSE min(p.id) END AS parent FROM b LEFT JOIN e ON e.dst = b.id
      LEFT JOIN b p ON p.id = e.src AND p.level = b.level - 1 GROUP BY b.id"""
    topo = _with(_HIER, ", w AS (SELECT id, 0::BIGINT AS d FROM v WHERE id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.id)", True) + " SELECT id, max(d) AS level FROM w GROUP BY id"
    edges = f"SELECT src, dst FROM ({_SP})"
    both = f"SELECT src, dst FROM ({_EV}) UNION SELECT dst, src FROM ({_EV})"
    given = f"WITH RECURSIVE g AS ({_NESTED})"
    order = "row_number() OVER (ORDER BY {}) - 1 AS idx"
    return {
        "degree": _with(_HIER) + " SELECT v.id, count(e.dst) AS out_degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id",
        "in_degree": _with(_HIER) + " SELECT v.id, count(e.src) AS in_degree FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id",
        "csr_offsets": _with(_HIER) + f""", g AS (SELECT v.id, count(e.dst) AS n FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)
          SELECT {order.format("id")}, coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM g
          UNION ALL SELECT count(*), (SELECT count(*) FROM e) FROM g""",
        "csr_targets": _with(_HIER) + f" SELECT {order.format('src, dst')}, dst FROM e",
        "degree_compressed": _with(_SP) + " SELECT v.id, count(e.dst) AS out_degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id",
        # a row is sorted: runs of one symbol, which pair up from the right, and a pair at each border of runs
        "pair_frequency": _with(_LINES) + """, r AS (SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst),
          p AS (SELECT dst AS a, dst AS b, n // 2 AS k FROM r UNION ALL SELECT dst, lead(dst) OVER (PARTITION BY src ORDER BY dst), 1 FROM r)
          SELECT a AS "left", b AS "right", sum(k)::BIGINT AS freq FROM p WHERE b IS NOT NULL GROUP BY a, b HAVING sum(k) >= 2""",
        "roundtrip_multigraph": f"SELECT src, dst FROM ({_LINES})",
        "roundtrip_given": given + """, w AS (SELECT id AS src, sym FROM g WHERE id < 10000000 UNION ALL SELECT w.src, g.sym FROM w JOIN g ON g.id = w.sym)
          SELECT src, sym AS dst FROM w WHERE sym < 10000000""",
        "rule_order_given": given + """, u AS (SELECT id, sym FROM g WHERE sym >= 10000000), w AS (SELECT sym AS id, 0::BIGINT AS level FROM u UNION SELECT u.sym, w.level + 1 FROM w JOIN u ON u.id = w.id)
          SELECT r.id, max(w.level)::INT AS level FROM (SELECT DISTINCT id FROM g WHERE id >= 10000000) r LEFT JOIN w ON w.id = r.id GROUP BY r.id""",
        "rule_stats_given": given + """ SELECT id, (SELECT count(*) FROM g u WHERE u.sym = r.id) AS freq, count(*) AS length FROM g r WHERE id >= 10000000 GROUP BY id""",
        "csr_compressed_offsets": given + """, i AS (SELECT id FROM g UNION SELECT c_custkey + 1000000 FROM customer), n AS (SELECT i.id, count(g.sym) AS n FROM i LEFT JOIN g ON g.id = i.id GROUP BY i.id)
          SELECT row_number() OVER (ORDER BY id) - 1 AS idx, coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM n
          UNION ALL SELECT count(*), (SELECT count(*) FROM g) FROM i""",
        "csr_compressed_targets": given + """, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT id FROM g UNION SELECT c_custkey + 1000000 FROM customer))
          SELECT row_number() OVER (ORDER BY g.id, g.pos) - 1 AS idx, i.k AS dst FROM g JOIN i ON i.id = g.sym""",
        "filter_given": f"WITH g AS ({_GIVEN})" + f""", r AS (SELECT id, (SELECT count(*) FROM g u WHERE u.sym = r.id) AS freq, count(*) AS length FROM g r WHERE id >= 10000000 GROUP BY id),
          m AS (SELECT id FROM r WHERE (freq - 1) * (length - 1) - 1 <= {GIVEN_THRESHOLD}), k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 + 10000000 AS new FROM r WHERE id NOT IN (SELECT id FROM m)),
          x AS (SELECT g.id, g.pos, b.pos AS inside, coalesce(b.sym, g.sym) AS sym FROM g LEFT JOIN g b ON b.id = g.sym AND b.id IN (SELECT id FROM m) WHERE g.id NOT IN (SELECT id FROM m))
          SELECT coalesce(k.new, x.id) AS id, row_number() OVER (PARTITION BY x.id ORDER BY pos, inside) - 1 AS pos, coalesce(s.new, x.sym) AS sym
          FROM x LEFT JOIN k ON k.id = x.id LEFT JOIN k s ON s.id = x.sym""",
        **dict.fromkeys(("roundtrip_edges", "roundtrip_filtered", "roundtrip_filter_decomp", "roundtrip_flattened"), edges),
        **dict.fromkeys(("bfs_levels", "bfs_levels_compressed"), levels),
        **dict.fromkeys(("sssp", "sssp_compressed"), distances),
        "bfs_parents": parents,
        "bfs_reach_compressed": _walk(_HIER) + " SELECT DISTINCT id FROM w",
        "sssp_weighted": _walk(_HIER, "(e.dst % 7 + 1)::DOUBLE").replace("0::BIGINT AS d", "0::DOUBLE AS d") + " SELECT v.id, min(w.d) AS dist FROM v LEFT JOIN w ON w.id = v.id GROUP BY v.id",
        **dict.fromkeys(("cc_directed", "cc_directed_compressed"), _label(_EV)),
        **dict.fromkeys(("cc_directed_hierarchy", "cc_directed_compressed_hierarchy"), _label(_HIER)),
        **dict.fromkeys(("wcc", "wcc_compressed"), _label(both)),
        # none for wcc_hierarchy: pairs of a vertex and a label grow with the square of the component
        **dict.fromkeys(("topo_levels", "topo_levels_compressed"), topo),
        **dict.fromkeys(("pagerank_10", "pagerank_compressed_10", "pagerank_by_levels_10"), _pagerank(_EV, 10)),
        "pagerank_bipartite_10": _pagerank(_CS, 10),
        "pagerank_dangling_10": _pagerank(_CS, 10, True),
        **dict.fromkeys(("hits_5", "hits_compressed_5", "hits_by_levels_5"), _hits(_SP, 5)),
        "hits_topk": _hits(_SP, 5) + " ORDER BY authority DESC, id LIMIT 20",
        "edge_list_symmetrize": f"SELECT src, dst FROM ({_EV}) UNION ALL SELECT dst, src FROM ({_EV})",
        "transpose": f"SELECT dst AS src, src AS dst FROM ({_EV})",
        "dedup": f"SELECT DISTINCT src, dst FROM ({_EV})",
    }
