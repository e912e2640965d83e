"""Token ids in files of Huffman-coded blocks.

A file set has ``code`` (a row per used id: its bits) and ``blocks``, Parquet files whose
rows are independent blocks of whole documents: ids of the documents, ids per document,
coded bytes and bit-offset checkpoints. Blocks are numbered by ``part``, a range of
``doc_id``, and ``block`` within it; in that order they hold the documents by ascending
``doc_id``. Spark's committers write them, so a lost executor leaves no broken file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.llm.encode import encoder
from lacewing.llm.huffman import SEGMENT, Code, code_lengths
from lacewing.session import drop_path, table_path, tidy, written

#: Ids in a block, unless one document has more.
BLOCK = 1 << 18
#: Most ranges of ``doc_id``.
MAX_PARTS = 4096


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def tokenized(docs: DataFrame, tokenizer: str, end: int | None) -> DataFrame:
    """``(doc_id, ids)``: ids of the whole text, little-endian, 2 bytes each where they fit, and the end id."""
    tail = np.array([] if end is None else [end], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        kind = "<u2" if e.size <= 1 << 16 else "<u4"
        for b in _slices(batches):
            ids = [np.concatenate([e.ids(t or ""), tail]).astype(kind).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def _counted(ids: DataFrame, size: int, kind: str) -> DataFrame:
    """``(id, n)``: global counts, summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in _slices(batches):
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _bounds(ids: DataFrame, parts: int) -> list[int]:
    """About equal ranges of ``doc_id``: the first id of each but the first."""
    if parts < 2:
        return []
    found = ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)
    return sorted({int(x) for x in found})


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int | None = 1, parts: int | None = None) -> None:
    """Write the ids of ``docs(doc_id, text)`` under ``path`` by ascending ``doc_id``.

    Null ids come first; rows with equal ids are ordered by their coded ids. Null text
    counts as empty. Repeated rows are written each, and very long texts whole, in a block of
    their own; other columns are ignored; an empty table makes empty files. ``parts`` defaults to the session's shuffle partitions.
    """
    spark = docs.sparkSession
    raw = table_path(spark, "ids")
    ids = written(tokenized(docs, tokenizer, end), "ids", raw, "zstd")
    size = encoder(tokenizer).size
    kind = "<u2" if size <= 1 << 16 else "<u4"
    counts = np.zeros(size, np.int64)
    for r in _counted(ids, size, kind).collect():  # a row per id of the vocabulary at most
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    parts = min(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_PARTS)
    bounds = np.array(_bounds(ids, parts), np.int64)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for b in _slices(batches):
            texts = [np.frombuffer(x, kind) for x in b.column(1).to_pylist()]
            counts = np.array([len(x) for x in texts], np.int64)
            data, taken, marks = code.encode(np.concatenate(texts).astype(np.int64), counts)
            pieces = np.cumsum(-(-counts // SEGMENT))
            starts, part = np.cumsum(taken) - taken, np.searchsorted(bounds, b.column(0).fill_null(-(1 << 63)).to_numpy(), side="right")
            coded, checks, low = [], [], 0
            for k in range(len(texts)):
                coded.append(data[starts[k] : starts[k] + taken[k]].tobytes())
                checks.append((marks[low : pieces[k]] - starts[k] * 8).astype("<u4").tobytes())
                low = pieces[k]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0), pa.array(counts), pa.array(coded, pa.binary()), pa.array(checks, pa.binary())], names=["part", "doc_id", "n", "data", "marks"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        state = {"part": None, "block": 0, "before": 0, "n": 0}

        def block() -> pa.RecordBatch:
            data, marks, base = b"".join(x[2] for x in held), [], 0
            for x in held:
                marks.append(np.frombuffer(x[3], "<u4") + np.uint32(base * 8))
                base += len(x[2])
            row = [[state["part"]], [state["block"]], [state["before"]], [[x[0] for x in held]], [[x[1] for x in held]], [data], [np.concatenate(marks).astype("<u4").tobytes()]]
            state["block"] += 1
            state["before"] += state["n"]
            state["n"] = 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            for part, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (part != state["part"] or state["n"] + x[1] > BLOCK):
                    yield block()
                if part != state["part"]:
                    state |= {"part": part, "block": 0, "before": 0}
                held.append(tuple(x))
                state["n"] += x[1]
        if held:
            yield block()

    names = ["part", "block", "before", "doc_ids", "counts", "data", "checkpoints"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    dealt = ids.mapInArrow(coded, "part int, doc_id long, n long, data binary, marks binary").repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "n", "data")
    made = dealt.mapInArrow(blocks, "part int, block int, before long, doc_ids array<long>, counts array<long>, data binary, checkpoints binary")
    made.write.option("compression", "none").parquet(f"{path}/blocks")
    drop_path(spark, raw)
    tidy(spark)


def _code(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return lengths


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32 [, ids])`` of each document, decoded from the files.

    ``start`` is the number of ids of all documents before it; ``ids_crc32`` is that of its
    ids as little-endian unsigned 32-bit integers.
    """
    lengths = _code(spark, path)
    rows = spark.read.parquet(f"{path}/blocks")
    totals = rows.select("part", (F.col("before") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).groupBy("part").agg(F.max("n").alias("n")).orderBy("part").collect()
    offset, base = {}, 0  # a row per part: MAX_PARTS at most
    for r in totals:
        offset[r["part"]], base = base, base + r["n"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for b in batches:
            for k in range(b.num_rows):
                part, before, doc_ids, counts, data, marks = (b.column(c)[k] for c in ("part", "before", "doc_ids", "counts", "data", "checkpoints"))
                n = counts.values.to_numpy()
                out = code.decode(np.frombuffer(data.as_py(), np.uint8), n, np.frombuffer(marks.as_py(), "<u4"))
                ends = np.cumsum(n)
                own = [out[e - c : e] for e, c in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = [doc_ids.values, pa.array(ends - n + (before.as_py() + offset[part.as_py()])), pa.array(n), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64())]
                if ids:
                    columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return rows.select("part", "before", "doc_ids", "counts", "data", "checkpoints").mapInArrow(decoded, schema)
