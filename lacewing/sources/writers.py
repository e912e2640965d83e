"""Graph sinks. Parquet is the native form; the others are export formats.

All number vertices (and then rules) densely in id order, as the formats need. With
``single``, the default, a format is the one file that other tools read: executors make its
bytes, and the driver appends them, a block at a time. Otherwise it is a folder of part files
that executors write, in the order of their names, which our readers take as well.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.model import CompressedGraph, Graph, GraphMeta
from lacewing.session import drop_path, written


def _output(uri: str):
    """An Arrow stream to a path or URI, its folder made."""
    from pyarrow import fs as store

    target, inner = store.FileSystem.from_uri(uri) if "://" in uri else (store.LocalFileSystem(), uri)
    target.create_dir(inner.rpartition("/")[0] or ".", recursive=True)
    return target, inner


def _write(lead: bytes, df: DataFrame, order: list[str], kind: str, path: str, single: bool) -> None:
    """``lead``, then the rows of ``df`` in ``order``: its other columns as int32 (``kind="int"``) or lines of text.

    A task that is run again writes its part file again.
    """
    values = [c for c in df.columns if c not in order] or order
    ready = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*values)

    def encoded(b: pa.RecordBatch) -> bytes:
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if kind == "int":
            if len(columns[0]) and max(int(np.abs(c).max()) for c in columns) >= 1 << 31:
                raise ValueError(f"{path}: a number is too large for 32 bits")
            return np.stack(columns, axis=1).astype("=i4").tobytes()
        lines = columns[0].astype(str)
        for c in columns[1:]:
            lines = np.char.add(np.char.add(lines, " "), c.astype(str))
        return ("\n".join(lines.tolist()) + "\n").encode() if len(lines) else b""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encoded(b)], pa.binary())], names=["data"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId()
        target, inner = _output(f"{path}/part-{k + 1:06d}")
        with target.open_output_stream(f"{inner}-{TaskContext.get().taskAttemptId()}.tmp") as f:
            n = sum(f.write(encoded(b)) for b in batches)
        target.move(f"{inner}-{TaskContext.get().taskAttemptId()}.tmp", inner)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    if single:
        target, inner = _output(path)
        with target.open_output_stream(inner) as f:
            f.write(lead)
            for r in ready.mapInArrow(blocks, "data binary").toLocalIterator():
                f.write(r["data"])
        return
    drop_path(df.sparkSession, path)
    target, inner = _output(f"{path}/part-000000")
    with target.open_output_stream(inner) as f:
        f.write(lead)
    ready.mapInArrow(parts, "n long").agg(F.sum("n")).collect()


def write_csr(graph: Graph | CompressedGraph, folder: str, single: bool = True) -> None:
    """``csr_vlist.bin``, ``csr_elist.bin`` and ``info.bin``, raw int32; of a grammar, V rows and then R bodies."""
    vlist, elist = _dense(graph)
    _write(b"", vlist, ["idx"], "int", f"{folder}/csr_vlist.bin", single)
    _write(b"", elist, ["idx"], "int", f"{folder}/csr_elist.bin", single)
    write_info(graph, f"{folder}/info.bin")


def _dense(graph: Graph | CompressedGraph) -> tuple[DataFrame, DataFrame]:
    vlist, elist = graph.csr(dense=True) if isinstance(graph, Graph) else graph.csr()
    return written(vlist, "vlist"), written(elist, "elist")


def write_info(graph: Graph | CompressedGraph, path: str) -> None:
    """The numbers of vertices and rules, raw int32."""
    target, inner = _output(path)
    with target.open_output_stream(inner) as f:
        f.write(np.array([graph.meta.vertex_cnt, graph.meta.rule_cnt], "=i4").tobytes())


def write_degree(graph: Graph | CompressedGraph, path: str, single: bool = True) -> None:
    """Out-degrees of the original graph in id order, raw int32."""
    _write(b"", graph.out_degrees().select("id", "out_degree"), ["id"], "int", path, single)


def write_order(c: CompressedGraph, path: str, unused: int = 100_000, single: bool = True) -> None:
    """Rule levels in id order, raw int32; a rule that nothing uses gets ``unused``."""
    _write(b"", c.rule_order.select("id", F.coalesce("level", F.lit(unused)).cast("long").alias("level")), ["id"], "int", path, single)


def write_adjacency(graph: Graph | CompressedGraph, path: str, single: bool = True) -> None:
    """AdjacencyGraph text: the counts, an offset for each vertex (and rule), the targets."""
    vlist, elist = _dense(graph)
    n, m = vlist.count() - 1, elist.count()
    rows = vlist.filter(F.col("idx") < n).select(F.lit(0).alias("part"), "idx", F.col("offset").alias("number"))
    rows = rows.unionByName(elist.select(F.lit(1).alias("part"), "idx", F.col("dst").alias("number")))
    _write(f"AdjacencyGraph\n{n}\n{m}\n".encode(), rows, ["part", "idx"], "text", path, single)


def write_matrix_market(graph: Graph | CompressedGraph, path: str, single: bool = True) -> None:
    """MatrixMarket ``coordinate pattern general``, 1-based; of a grammar, V + R rows and columns."""
    from lacewing.sources.readers import _rows

    vlist, elist = _dense(graph)
    n, m = vlist.count() - 1, elist.count()
    starts = _rows(vlist.filter(F.col("idx") < n).select(F.col("idx").alias("v"), F.col("offset").alias("start")), m)
    owners = starts.filter("stop > start").select("v", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("idx"))
    entries = elist.join(owners, "idx").select("idx", (F.col("v") + 1).alias("i"), (F.col("dst") + 1).alias("j"))
    _write(f"%%MatrixMarket matrix coordinate pattern general\n{n} {n} {m}\n".encode(), entries, ["idx"], "text", path, single)


def write_edge_list(graph: Graph, path: str) -> None:
    """A folder of ``src dst`` text files, written in parallel."""
    graph.edges.select(F.format_string("%d %d", "src", "dst")).write.mode("overwrite").text(path)


def save_compressed(c: CompressedGraph, path: str) -> None:
    """All of a compressed graph as Parquet tables under ``path``."""
    for name, df in (("strings", c.strings), ("vertices", c.vertices), *([("edges", c.edges.select("src", "dst"))] if c.edges is not None else []), ("order", c.rule_order)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = json.dumps([c.meta.vertex_cnt, c.meta.rule_cnt, c.meta.rule_base, c.edges is not None])
    c.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_compressed(spark: SparkSession, path: str) -> CompressedGraph:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    *meta, edges = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return CompressedGraph(read("strings"), read("vertices"), read("edges") if edges else None, GraphMeta(*meta), read("order"))
