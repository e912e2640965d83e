"""A corpus pipeline: each stage reads what its predecessor wrote.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
table, written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.

A stage's result has to be written before the next stage is called: that one deletes
the intermediate tables of its predecessor, which no longer serve.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lacewing.llm.exact import drop_exact_duplicates
from lacewing.llm.minhash import drop_near_duplicates
from lacewing.llm.mixing import mix_sources
from lacewing.llm.packing import pack_documents
from lacewing.llm.quality import keep_good_documents
from lacewing.session import drop_path, recording, table_path, tidy, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules by themselves, or whose host fails, go."""
    return keep_good_documents(docs).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return drop_exact_duplicates(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return drop_near_duplicates(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their weights by repetition, and all rows shuffled."""
    return mix_sources(docs, temperature=0.7, seed=1).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids; copies of a document are packed each."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0, length=1024)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _stage(first: bool, work: Stage) -> Stage:
    """``work``, after deleting what the stage before it has left; the first one deletes nothing."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            for path in _left:
                drop_path(spark, path)
            tidy(spark)
        _left.clear()
        with recording() as made:
            out = work(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


_STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]
STAGES = [(name, _stage(k == 0, work)) for k, (name, work) in enumerate(_STAGES)]

#: SQL cannot express near duplicates or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else written(out, "stage", table_path(spark, "stage"))
    return docs
