"""Edges that arrive as a stream: kept as Parquet, and counted as they come.

Compressed graphs are built from tables, so a stream lands in one first; a rebuild
reads what has been committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def streaming_degrees(edges: DataFrame) -> DataFrame:
    """``(id, out_degree)`` as running counts, for ``outputMode("complete")`` or ``"update"``."""
    return edges.groupBy(F.col("src").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))


def keep_edges(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream's edges to the Parquet table at ``path``, all that is there now."""
    cast = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return cast.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
