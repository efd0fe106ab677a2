"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_path
from tidewatch.sources.tables import table

#: Rows of one Arrow batch sent to a Python worker. Texts are a few KB on
#: average but can be megabytes, so batches hold few rows.
ARROW_ROWS = 500

#: Word separators of every operator here: space and \x09-\x0D, the bytes that
#: ``bytes.split()`` splits on.
WORD = "[^\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the Python-backed operators (batch size only)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, name)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it
    back: cuts the lineage with a copy that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names built from ``names`` that ``df`` doesn't have (in any
    case), so that temporary columns never clash with a table's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text mod 3 is 1: rows whose labels no model
    may learn from. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))
