"""Graphs derived from the driver's relational tables; each kind of entity has its own id range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacewing.model import CompressedGraph, Graph, GraphMeta

#: First id of each kind of entity.
BASE = {"region": 0, "nation": 100, "supplier": 1_000, "part": 100_000, "customer": 1_000_000, "order": 10_000_000}


def _edges(df: DataFrame, kind: str, src: str, to: str, dst: str) -> DataFrame:
    return df.select((F.col(src).cast("long") + BASE[kind]).alias("src"), (F.col(dst).cast("long") + BASE[to]).alias("dst"))


def supplier_parts(spark: SparkSession, sf_dir: str) -> Graph:
    """Bipartite, dense: which parts a supplier has delivered."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return Graph.from_edges(_edges(line, "supplier", "l_suppkey", "part", "l_partkey").distinct())


def supplier_lines(spark: SparkSession, sf_dir: str) -> Graph:
    """The same as a multigraph, an edge for each delivery: rows have runs of one symbol."""
    return Graph.from_edges(_edges(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "supplier", "l_suppkey", "part", "l_partkey"))


def hierarchy(spark: SparkSession, sf_dir: str) -> Graph:
    """Acyclic: region, nation, supplier, part and nation, customer, order, part."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    line = read("lineitem")
    kinds = [
        _edges(read("nation"), "region", "n_regionkey", "nation", "n_nationkey"),
        _edges(read("supplier"), "nation", "s_nationkey", "supplier", "s_suppkey"),
        _edges(read("customer"), "nation", "c_nationkey", "customer", "c_custkey"),
        _edges(read("orders"), "customer", "o_custkey", "order", "o_orderkey"),
        _edges(line, "supplier", "l_suppkey", "part", "l_partkey"),
        _edges(line, "order", "l_orderkey", "part", "l_partkey"),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return Graph.from_edges(out.distinct())


def event_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Cyclic multigraph with self-loops: the next user after each, by type of event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    nxt = F.lead("user_id").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    edges = events.select(F.col("user_id").alias("src"), nxt.alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")
    return Graph.from_edges(edges)


def customer_suppliers(spark: SparkSession, sf_dir: str) -> Graph:
    """Bipartite multigraph that hardly compresses: whom a customer's orders were filled by."""
    line, orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    joined = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
    return Graph.from_edges(_edges(joined, "customer", "o_custkey", "supplier", "l_suppkey"))


def given_grammar(spark: SparkSession, sf_dir: str, nested: bool = True) -> CompressedGraph:
    """A grammar that no compressor made: a supplier's row is its nation, a rule for that nation's customers.

    With ``nested`` a nation's body also has, in front, the nation five below it.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rule = lambda c: F.col(c).cast("long") + BASE["order"]
    suppliers, customers, nations = read("supplier"), read("customer"), read("nation")
    zero = F.lit(0).cast("long")
    rows = suppliers.select((F.col("s_suppkey").cast("long") + BASE["supplier"]).alias("id"), zero.alias("seg"), zero.alias("pos"), rule("s_nationkey").alias("sym"))
    bodies = customers.select(rule("c_nationkey").alias("id"), zero.alias("seg"), F.col("c_custkey").cast("long").alias("pos"), (F.col("c_custkey").cast("long") + BASE["customer"]).alias("sym"))
    strings = rows.unionByName(bodies)
    if nested:
        inner = nations.filter("n_nationkey >= 5").select(rule("n_nationkey").alias("id"), zero.alias("seg"), F.lit(-1).cast("long").alias("pos"), (rule("n_nationkey") - 5).alias("sym"))
        strings = strings.unionByName(inner)
    ids = rows.select("id").unionByName(customers.select((F.col("c_custkey").cast("long") + BASE["customer"]).alias("id")))
    rules = strings.filter(F.col("id") >= BASE["order"]).select("id").distinct().count()
    return CompressedGraph(strings, ids, None, GraphMeta(ids.count(), rules, BASE["order"]))
