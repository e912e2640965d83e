"""Exact duplicates by a persistent digest index.

DataFrame functions only. The index is a table bucketed and sorted by digest, one row
per different text and batch that had it. A batch is aggregated to one row per digest (copies
combine before the shuffle), anti-joined to the index by a sort-merge join, and its
counts are appended, of new digests and of known ones; reading adds them up. A batch has an
id: one that is given again after a lost driver sees the index without its own rows, and rows
that it had appended before count once. Verdicts go back to the rows by a join on the digest
in which digests with many copies are broadcast, so that no task gets a whole group of copies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.llm.common import free_name, squeezed
from lacewing.session import table_path, written

#: Groups with more than this share of the rows are broadcast: so many rows at most.
HEAVY = 2000
#: Rows to drop that are broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: The file beside an index that says how it is laid out; Spark's readers skip names that begin so.
LAYOUT = "_layout"


def text_digest(text: Column) -> Column:
    """SHA-256 in lowercase hex of the text with runs of white space as one space."""
    return F.sha2(F.encode(squeezed(text), "UTF-8"), 256)


class DigestIndex:
    """``(digest, keep_id, copies, batch)`` at ``path``, bucketed and sorted by digest.

    Opening a path that has an index goes on with it, in the buckets it was made with; to
    ask for another number raises. Without a path the index ends with the application.
    ``close`` takes the table out of the session's catalog and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.path = path or table_path(spark, "digests")
        self.buckets = self._layout(buckets)
        self.name = f"lacewing_digests_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, copies BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def _layout(self, buckets: int | None) -> int:
        """The number of buckets that the index was made with, or from now on has."""
        jvm = self.spark._jvm
        file = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{LAYOUT}")
        fs = file.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(file):
            stream = fs.open(file)
            try:
                made = int(stream.readLine())
            finally:
                stream.close()
            if buckets not in (None, made):
                raise ValueError(f"{self.path}: the index has {made} buckets, not {buckets}")
            return made
        if fs.exists(file.getParent()) and any(not x.getPath().getName().startswith(("_", ".")) for x in fs.listStatus(file.getParent())):
            raise ValueError(f"{self.path}: its files are not an index with a known number of buckets")
        stream = fs.create(file, False)
        try:
            stream.writeBytes(f"{buckets or 64}\n")
        finally:
            stream.close()
        return buckets or 64

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self, without: str | None = None) -> DataFrame:
        """A row per different text, with its copies in all batches but ``without``; bucketed, so nothing is shuffled."""
        self.spark.catalog.refreshTable(self.name)
        rows = self.spark.table(self.name)
        if without is not None:
            rows = rows.filter(F.col("batch") != without)
        once = rows.groupBy("digest", "batch").agg(F.max("keep_id").alias("keep_id"), F.max("copies").alias("copies"))
        return once.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))

    def add(self, docs: DataFrame, batch: str | None = None, row: str | None = None) -> DataFrame:
        """Verdicts for ``docs(doc_id, text)``, whose digests and their counts join the index.

        ``(doc_id, keep_id, group_size, kept, text_sha256)`` and, if named, the column ``row``
        of docs, a number that differs from row to row. Of equal texts the one in the index stays,
        else the row with the least ``doc_id`` (nulls last, then any one of equal rows).
        ``group_size`` counts the copies of all batches so far. ``batch`` names the same rows if
        they are given again; None is a new batch. Null text counts as empty, and very long texts
        are read whole; other columns are ignored, whatever they are called; an empty table gives no rows.
        """
        batch = uuid.uuid4().hex if batch is None else batch
        number = F.monotonically_increasing_id() if row is None else F.col(row)
        rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("row"), text_digest(F.col("text")).alias("digest")), "digests")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
        groups = written(rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")), "groups")
        total = rows.count()
        old = self.table(without=batch)
        fresh = groups.hint("merge").join(old, "digest", "left_anti").select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.col("n").alias("size"), "n")
        known = groups.hint("merge").join(old, "digest").select("digest", "keep_id", F.lit(None).cast("long").alias("keep_row"), (F.col("n") + F.col("copies")).alias("size"), "n")
        verdicts = written(fresh.unionByName(known), "verdicts")
        added = verdicts.select("digest", "keep_id", F.col("n").alias("copies"), F.lit(batch).alias("batch"))
        added.repartition("digest").sortWithinPartitions("digest").write.insertInto(self.name)
        heavy = F.col("n") > F.lit(max(total // HEAVY, 1))
        own = [] if row is None else [F.col("row").alias(row)]
        result = lambda x: x.select("doc_id", "keep_id", F.col("size").alias("group_size"), F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"), *own)
        hot = F.broadcast(verdicts.filter(heavy))  # fewer than HEAVY rows
        return result(rows.join(hot, "digest")).unionByName(result(rows.join(F.broadcast(verdicts.filter(heavy).select("digest")), "digest", "left_anti").join(verdicts.filter(~heavy), "digest")))


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, row: str | None = None) -> DataFrame:
    """Verdicts on ``docs`` against ``index``, a new one if not given; see ``DigestIndex.add``."""
    if index is not None:
        return index.add(docs, batch, row)
    index = DigestIndex(docs.sparkSession)
    try:
        return index.add(docs, batch, row)  # verdicts are tables by now
    finally:
        index.close()


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = free_name(docs, "__row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    gone = written(exact_duplicates(rows, index, batch, row).filter("NOT kept").select(row), "gone")
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return rows.join(gone, row, "left_anti").drop(row)
