"""Graph files: edge lists, adjacency text, MatrixMarket, raw int32 CSR, separator streams.

Text is read by Spark's text source. Where the meaning of a token depends on its place in
the file, places are (file, block, row), and tokens are numbered by a sort. Raw integers are
read in blocks, each a slice of a file that one task turns into a column. A path may be a file
or a folder of part files in the order of their names. Malformed input raises.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.functions import indexed, running_total
from lacewing.model import CompressedGraph, Graph
from lacewing.session import settled, written

#: Bytes of a raw file that a task reads at once.
BLOCK = 16 << 20
#: An unsigned or negative whole number. Fixed value.
WHOLE = r"^-?[0-9]+$"


def _require(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)


def _lines(spark: SparkSession, path: str, comments: str = "") -> DataFrame:
    """``(file, block, row, words)`` of the lines that are neither blank nor comments; places are in file order."""
    _require(spark, path)
    rows = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("value", F.trim(F.regexp_replace("value", r"[\s,]+", " "))).filter("value != ''")
    if comments:
        rows = rows.filter(~F.substring("value", 1, 1).isin(list(comments)))
    return rows.select("file", "block", "row", F.split("value", " ").alias("words"))


PLACE = ["file", "block", "row"]


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, token)``: the white-space separated tokens of a file in order."""
    each = _lines(spark, path).select(*PLACE, F.posexplode("words").alias("at", "token"))
    return settled(indexed(each, [*PLACE, "at"]).select("idx", "token"))


def _numbers(token: str) -> Column:
    """The token as a number; anything else is an error of the cast."""
    return F.col(token).cast("long")


def read_edge_list(spark: SparkSession, path: str, dense: bool = True) -> Graph:
    """``src dst [weight]`` lines; one header line and ``#``/``%`` comments are skipped.

    ``dense`` makes every id from 0 to the largest a vertex. A line that does not begin with two
    whole numbers is a header if it is the first and begins with a letter, else an error.
    """
    lines = _lines(spark, path, "#%")
    edge = (F.size("words") >= 2) & F.get("words", 0).rlike(WHOLE) & F.coalesce(F.get("words", 1).rlike(WHOLE), F.lit(False))
    place = F.struct(*PLACE)
    bad, first, odd, most = lines.agg(F.count_if(~edge), F.min(place), F.min(F.when(~edge, F.struct(place.alias("place"), "words"))), F.max(F.when(edge, F.size("words")))).first()
    if bad and (bad > 1 or odd["place"] != first or not odd["words"][0][:1].isalpha()):
        raise ValueError(f"{path}: {bad} lines are not edges, first: {' '.join(odd['words'])!r}")
    weight = [F.get("words", 2).cast("double").alias("weight")] if (most or 0) > 2 else []
    edges = lines.filter(edge).select(*[F.get("words", k).cast("long").alias(c) for k, c in enumerate(("src", "dst"))], *weight)
    return Graph.from_edges(edges, dense=dense)


def _from_offsets(offsets: DataFrame, targets: DataFrame, n: int) -> Graph:
    """``offsets(v, start, stop)`` and ``targets(idx, dst)``: each position belongs to one row."""
    owners = offsets.filter("stop > start").select("v", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("idx"), "start")
    edges = targets.join(owners, "idx").select(F.col("v").alias("src"), "dst", (F.col("idx") - F.col("start")).alias("pos"))
    return Graph(edges, targets.sparkSession.range(n)).validate()


def _rows(vlist: DataFrame, edge_cnt: int) -> DataFrame:
    after = vlist.select((F.col("v") - 1).alias("v"), F.col("start").alias("stop"))
    return vlist.join(after, "v", "left").select("v", "start", F.coalesce("stop", F.lit(edge_cnt)).alias("stop"))


def read_adjacency(spark: SparkSession, path: str) -> Graph:
    """``AdjacencyGraph V E``, V offsets, E targets, one token each; rows keep file order."""
    t = _tokens(spark, path)
    head = {r["idx"]: r["token"] for r in t.filter("idx < 3").collect()}
    if head.get(0) != "AdjacencyGraph" or len(head) < 3:
        raise ValueError(f"{path}: not an AdjacencyGraph file")
    n, m = int(head[1]), int(head[2])
    if t.count() != 3 + n + m:
        raise ValueError(f"{path}: {n} offsets and {m} targets are announced")
    vlist = t.filter((F.col("idx") >= 3) & (F.col("idx") < 3 + n)).select((F.col("idx") - 3).alias("v"), _numbers("token").alias("start"))
    return _from_offsets(_rows(vlist, m), t.filter(F.col("idx") >= 3 + n).select((F.col("idx") - 3 - n).alias("idx"), _numbers("token").alias("dst")), n)


def read_matrix_market(spark: SparkSession, path: str) -> Graph:
    """``coordinate pattern`` or ``coordinate real`` files, 1-based; V is the larger dimension."""
    lines = written(_lines(spark, path, "%"), "lines")
    head = lines.orderBy(*PLACE).first()
    if head is None or len(head["words"]) != 3:
        raise ValueError(f"{path}: no line of dimensions")
    n, m = max(int(head["words"][0]), int(head["words"][1])), int(head["words"][2])
    body = lines.filter((F.col("file") != head["file"]) | (F.col("block") != head["block"]) | (F.col("row") != head["row"]))
    found, least, most = body.agg(F.count(F.lit(1)), F.min(F.size("words")), F.max(F.size("words"))).first()
    if found != m or (m and least < 2):
        raise ValueError(f"{path}: {m} entries are announced")
    weight = [F.get("words", 2).cast("double").alias("weight")] if m and most > 2 else []
    edges = body.select(*[(F.get("words", k).cast("long") - 1).alias(c) for k, c in enumerate(("src", "dst"))], *weight)
    return Graph(edges, spark.range(n)).validate()


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, value)`` of raw int32 numbers in this machine's byte order."""
    _require(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((x.getPath().toUri().toString(), x.getLen()) for x in fs.listStatus(target) if x.isFile() and not x.getPath().getName().startswith(("_", ".")))
    blocks, before = [], 0
    for name, size in files:
        if size % 4:
            raise ValueError(f"{name}: {size} bytes are no whole numbers of 4 each")
        blocks += [(name, at, min(BLOCK, size - at), (before + at) // 4) for at in range(0, size, BLOCK)]
        before += size
    kind = "<i4" if sys.byteorder == "little" else ">i4"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as store

        for b in batches:
            for name, at, size, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                source, inner = store.FileSystem.from_uri(name if "://" in name else name.replace(":/", ":///", 1))
                with source.open_input_file(inner) as f:
                    values = np.frombuffer(f.read_at(size, at), kind).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(values))), pa.array(values)], names=["idx", "value"])

    rows = spark.createDataFrame(blocks, "name string, at long, size long, first long")
    return rows.repartition(max(len(blocks), 1), "name", "at").mapInArrow(read, "idx long, value long")


def read_csr(spark: SparkSession, vlist: str, elist: str) -> Graph:
    """A graph from its raw offset (V+1 numbers) and target files."""
    v, e = settled(read_binary(spark, vlist)), settled(read_binary(spark, elist))
    n, m = v.count() - 1, e.count()
    last = v.filter(F.col("idx") == n).first()
    if last is None or last["value"] != m:
        raise ValueError(f"{vlist}: its last offset isn't the number of targets in {elist}")
    starts = v.filter(F.col("idx") < n).select(F.col("idx").alias("v"), F.col("value").alias("start"))
    return _from_offsets(_rows(starts, m), e.select("idx", F.col("value").alias("dst")), n)


def read_compressed_csr(spark: SparkSession, folder: str) -> CompressedGraph:
    """The grammar in ``csr_vlist.bin``, ``csr_elist.bin`` and ``info.bin`` of a folder: V rows of vertices, R of rules.

    A rule may only hold vertices and rules of lesser ids, as the grammar's expansion has to end.
    """
    both = {r["idx"]: r["value"] for r in read_binary(spark, f"{folder}/info.bin").collect()}
    if len(both) != 2:
        raise ValueError(f"{folder}/info.bin: not the numbers of vertices and rules")
    n, rules = both[0], both[1]
    plain = read_csr(spark, f"{folder}/csr_vlist.bin", f"{folder}/csr_elist.bin").kept
    if plain.meta.vertex_cnt != n + rules:
        raise ValueError(f"{folder}: {plain.meta.vertex_cnt} rows for {n} vertices and {rules} rules")
    if not plain.edges.filter((F.col("src") >= n) & (F.col("dst") >= F.col("src"))).isEmpty():
        raise ValueError(f"{folder}: a rule holds itself or a later one")
    c = CompressedGraph.from_csr(plain, n, rules)
    c.strings = settled(c.strings)
    return c


def read_separated(spark: SparkSession, path: str) -> Graph:
    """``V E`` and a symbol stream in which each symbol >= V ends a row; exactly V rows."""
    t = _tokens(spark, path).select("idx", _numbers("token").alias("sym"))
    head = {r["idx"]: r["sym"] for r in t.filter("idx < 2").collect()}
    if len(head) < 2:
        raise ValueError(f"{path}: no numbers of vertices and edges")
    n = head[0]
    stream = t.filter("idx >= 2").withColumn("ends", (F.col("sym") >= n).cast("long"))
    rows = running_total(stream, ["idx"], "ends", "src")
    edges = rows.filter("ends = 0").select("src", F.col("sym").alias("dst"), F.col("idx").alias("pos"))
    return Graph(edges.filter(F.col("src") < n), spark.range(n)).validate()


def load_graph(spark: SparkSession, path: str, elist: str | None = None) -> Graph:
    """Choose the reader by extension: ``.mtx``, ``.bin`` (with ``elist``), ``.adj``/``.txt``, ``.parquet``, edge lists."""
    kind = PurePosixPath(path).suffix
    if kind == ".mtx":
        return read_matrix_market(spark, path)
    if kind == ".bin" and elist:
        return read_csr(spark, path, elist)
    if kind in (".adj", ".txt"):
        return read_adjacency(spark, path)
    if kind == ".parquet":
        return Graph.from_edges(spark.read.parquet(path))
    if kind in (".el", ".edges", ".csv", ".tsv"):
        return read_edge_list(spark, path)
    raise ValueError(f"{path}: unknown kind of graph file")
