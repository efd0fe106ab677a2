"""Sinks: mitigation log (K2, S10), feedback log (K3), model and
explanation persistence (K5), metric series (K7)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forest import Forest

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
# Columns of the log files: a file format, fixed values.
MITIGATION_FILE = ("timestamp string, mitm_types string, severity string, actions string, auto_mitigated boolean, "
                   "action_count int, event_id bigint")
FEEDBACK_FILE = "timestamp string, alert_idx bigint, true_label int, predicted int, user_decision string, correct int"


# -- log folders with idempotent commits ------------------------------------
# A log is a folder: ``batches/epoch=N`` holds the rows of one commit and
# ``manifest/epoch=N`` says that they are complete. A batch that runs again
# (a retried micro-batch, a lost driver) replaces its own folder, so nothing
# is ever in the log twice; readers see committed epochs only.
def commit_batch(rows: DataFrame, path: str, epoch: int) -> None:
    """Writes one batch of a log, once however often it is called for an
    epoch."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/batches/epoch={epoch:012d}")
    rows.sparkSession.range(1).select(F.lit(epoch).cast("bigint").alias("committed")).coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/manifest/epoch={epoch:012d}")


def committed_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed batches, with ``epoch``."""
    done = spark.read.schema("committed bigint").parquet(f"{path}/manifest/epoch=*").select(F.col("committed").alias("_done"))
    rows = spark.read.option("header", True).schema(schema + ", epoch bigint").option("basePath", f"{path}/batches").csv(f"{path}/batches/epoch=*")
    return rows.join(done, F.col("epoch") == F.col("_done"), "left_semi")


def log_sink(path: str, flat=None):
    """A ``foreachBatch`` function that commits each micro-batch under its
    epoch; ``flat`` turns it into file columns."""
    def sink(batch: DataFrame, epoch: int) -> None:
        commit_batch(flat(batch) if flat else batch, path, epoch)
    return sink


def mitigation_file_rows(log: DataFrame) -> DataFrame:
    """K2: the flat columns and the event's id, which orders equal times."""
    return log.select(*_flat_mitigation(), "event_id")


def newest_rows(rows: DataFrame, id_col: str, limit: int = 50) -> DataFrame:
    """The newest rows of a log by time, then id."""
    return rows.orderBy(F.desc("timestamp"), F.desc(id_col)).limit(limit)


def feedback_rows(decisions: DataFrame) -> DataFrame:
    """K3: the file columns of a decision log."""
    return decisions.select(F.date_format("ts", ISO).alias("timestamp"), F.col("alert_idx").cast("bigint").alias("alert_idx"),
                            *[F.col(c).cast("int").alias(c) for c in ("true_label", "predicted")], "user_decision",
                            F.col("correct").cast("int").alias("correct"))



def mitigation_rows(log: DataFrame) -> DataFrame:
    """Flat form of :func:`operators.response.mitigation_log` (lists joined
    by ';', actions as action:target with '->')."""
    return log.select(*_flat_mitigation())


def _flat_mitigation() -> list:
    return [F.date_format("ts", ISO).alias("timestamp"), F.array_join("mitm_type", ";").alias("mitm_types"), F.col("severity"),
            F.col("actions_text").alias("actions"), F.col("auto_mitigated"), F.col("action_count")]


def append_mitigation_log(log: DataFrame, path: str) -> None:
    """K2: append; every part file carries the header, so readers of the
    directory skip it per file."""
    mitigation_rows(log).write.mode("append").option("header", True).csv(path)


def mitigation_log_stream_sink(path: str):
    """K2 for a streaming log: a ``foreachBatch`` function that appends."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        append_mitigation_log(batch, path)
    return sink


def read_mitigation_log(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The newest ``limit`` log rows."""
    df = spark.read.option("header", True).schema(
        "timestamp string, mitm_types string, severity string, actions string, auto_mitigated boolean, "
        "action_count int").csv(path)
    return df.orderBy(F.desc("timestamp")).limit(limit)


def append_feedback(decisions: DataFrame, path: str) -> None:
    """K3: feedback log rows (timestamp, alert_idx, true_label, predicted,
    user_decision, correct) appended."""
    cols = ["timestamp", "alert_idx", "true_label", "predicted", "user_decision", "correct"]
    decisions.select(*cols).write.mode("append").option("header", True).csv(path)


def save_model(model: PipelineModel | Forest, path: str, explanations: DataFrame | None = None) -> None:
    """K5: the fitted pipeline (assembler + model) or forest and, optionally,
    the nested explanations table beside it."""
    if isinstance(model, Forest):
        model.save(f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    if explanations is not None:
        explanations.write.mode("overwrite").parquet(f"{path}/explanations")


def write_metric_series(series: DataFrame, path: str) -> None:
    """K7: long-form (target, value, ts_ms, tag) partitioned by target."""
    series.write.mode("overwrite").partitionBy("target").parquet(path)
