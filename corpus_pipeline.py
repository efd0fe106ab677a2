"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing,
packing, each by the operator of its name in ``tidewatch.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, mixing, packing, quality_rules, simhash
from tidewatch.llm.common import col, prepare
from tidewatch.session import scratch_path
from tidewatch.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    prepare(spark)
    return quality_rules.keep_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks go where they repeat; ``n_chars``, if there, follows."""
    prepare(spark)
    x = line_dedup.dedup_lines(docs)
    size = lambda c: F.coalesce(F.length("text").cast(x.schema[c].dataType), col(c)).alias(c)
    return x.select(*[size(c) if c == "n_chars" else col(c) for c in x.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    prepare(spark)
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's token-prefix stays."""
    prepare(spark)
    return mixing.chosen(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates),
          ("mixing", mix), ("packing", pack)]

#: Fingerprints (XXH64) and token ids have no DuckDB form; the tests compare
#: the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written as Parquet to the
    shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, os.path.join("pipeline-" + uuid.uuid4().hex, name))
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
