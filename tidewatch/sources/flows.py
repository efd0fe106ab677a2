"""Flow-record ingest: CIC-style and UNSW-style CSVs -> one labelled table
(S1-S5, P1-P5, U1-U2, K1).

Traps handled (all on Spark's CSV reader): padded header names are stripped;
a duplicated header (``Fwd Header Length`` twice) becomes ``..._1`` as pandas
would name it ``.1``; names are made snake_case so ``Label`` and UNSW's own
``label`` cannot collide under Spark's case-insensitive resolution; numeric
text is parsed with ``try_cast`` (ANSI mode would fail on ``inf``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import cic_label, unsw_label

# Text columns of the flow datasets; every other column is numeric.
TEXT_COLUMNS = {"flow_id", "source_ip", "destination_ip", "timestamp", "label", "attack_cat", "proto", "service",
                "state", "srcip", "dstip"}
# Columns dropped before modelling (identifiers, the label, leak-prone copies).
LEAK_SAFE_DROP = ["label", "attack_cat", "unsw_label", "id", "flow_id", "timestamp", "packet_length",
                  "fwd_header_length_1"]


def snake(name: str) -> str:
    s = re.sub(r"[^0-9a-zA-Z]+", "_", name.strip()).strip("_")
    return re.sub(r"_+", "_", s).lower()


def clean_names(raw: Sequence[str]) -> list[str]:
    """P1 + duplicate handling: strip, snake_case, then suffix repeats _1, _2."""
    seen: dict[str, int] = {}
    out = []
    for r in raw:
        base = snake(str(r))
        n = seen.get(base, 0)
        out.append(base if n == 0 else f"{base}_{n}")
        seen[base] = n + 1
    return out


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Skip missing files (S1), through the Hadoop file system of each path."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    keep = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            keep.append(p)
    return keep


def csv_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files behind ``paths``: a directory stands for its ``*.csv``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in existing_paths(spark, paths):
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        if fs.getFileStatus(hp).isDirectory():
            out += sorted(f.getPath().toString() for f in fs.listStatus(hp)
                          if f.isFile() and f.getPath().getName().endswith(".csv"))
        else:
            out.append(p)
    return out


def _header(spark: SparkSession, path: str) -> list[str]:
    """The first line of a file, read alone through its file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hp = jvm.org.apache.hadoop.fs.Path(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(hp.getFileSystem(conf).open(hp), "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return [] if line is None else line.lstrip("\ufeff").split(",")


def read_flow_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """Read CSV files into typed columns (numeric -> DOUBLE via try_cast, text
    kept). Files are read in groups of one header each and united by name, so
    columns may come in any order and be missing (NULL). Empty files have no
    rows. Returns None when no file has a header."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in csv_files(spark, paths):
        names = tuple(clean_names(_header(spark, f)))
        if names:
            groups.setdefault(names, []).append(f)
    frames = []
    for cols, files in groups.items():
        schema = StructType([StructField(c, StringType()) for c in cols])
        raw = spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(files)
        frames.append(raw.select(*[F.trim(F.col(c)).alias(c) if c in TEXT_COLUMNS else
                                   F.col(c).try_cast("double").alias(c) for c in cols]))
    return combine(frames)


def _label_cic(df: DataFrame) -> DataFrame:
    return df.withColumn("attack_cat", F.col("label")).withColumn("label", cic_label("attack_cat"))


def _label_unsw(df: DataFrame) -> DataFrame:
    if "label" in df.columns:
        df = df.withColumnRenamed("label", "unsw_label")
    return df.withColumn("label", unsw_label("attack_cat"))


def load_cic(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """S1 + P2: label = 0 for BENIGN, else 1 (attack name kept in attack_cat)."""
    df = read_flow_csv(spark, paths)
    return None if df is None else _label_cic(df)


def load_unsw(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """S2 + P3 + P4: attack_cat is the label text ('normal' -> 0); UNSW's own
    0/1 ``label`` column is kept as ``unsw_label``."""
    df = read_flow_csv(spark, paths)
    return None if df is None else _label_unsw(df)


def load_glob(spark: SparkSession, directory: str) -> DataFrame | None:
    """Every *.csv of a directory, typed and labelled: files with an
    ``attack_cat`` column by category, others with a ``label`` by its text."""
    by_kind: dict[bool, list[str]] = {True: [], False: []}
    for f in csv_files(spark, [directory]):
        by_kind["attack_cat" in clean_names(_header(spark, f))].append(f)
    return combine([load_unsw(spark, by_kind[True]), load_cic(spark, by_kind[False])])


def combine(frames: Sequence[DataFrame | None]) -> DataFrame | None:
    """Union by name, missing columns as NULL."""
    out = None
    for f in frames:
        if f is None:
            continue
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def load_flows(spark: SparkSession, cic_paths: Sequence[str], unsw_paths: Sequence[str],
               processed_path: str | None = None) -> DataFrame | None:
    """S3: reuse the processed parquet if present, else ingest both sources,
    union them and materialise the result as parquet (K1)."""
    if processed_path and existing_paths(spark, [processed_path]):
        return spark.read.parquet(processed_path)
    df = combine([load_cic(spark, cic_paths), load_unsw(spark, unsw_paths)])
    if df is None:
        return None
    if processed_path:
        df.write.mode("overwrite").parquet(processed_path)
        return spark.read.parquet(processed_path)
    return df


def class_counts(flows: DataFrame) -> DataFrame:
    """Rows, columns, class counts."""
    return flows.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(flows.columns)).alias("columns"),
                     F.count(F.when(F.col("label") == 0, 1)).alias("benign"),
                     F.count(F.when(F.col("label") == 1, 1)).alias("attack"))


def feature_matrix(flows: DataFrame, drop: Sequence[str] = LEAK_SAFE_DROP) -> DataFrame:
    """P5: features = everything but identifiers, label and leak-prone
    copies (missing names ignored); label kept as INT."""
    return flows.withColumn("label", F.col("label").cast("int")).drop(*[c for c in drop if c != "label"])
