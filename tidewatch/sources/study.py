"""User-study files (S7, S8) and their sinks (K4, K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ragged session CSVs (decision rows, a blank line, a
    ``questionnaire,q1..`` row and an ``answer,..`` row in one file) ->
    (decisions, answers). Lines are classified by their first field; the
    answer row is parsed whole, however many questions there are. A decision line
    is one that is neither a header nor part of the questionnaire."""
    lines = (spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
             .filter(F.trim("line") != ""))
    parts = F.split("line", ",")
    kind = parts[0]
    # the file's name without .csv; a regular expression would try every start of the path, for every line
    name = F.substring_index("file", "/", -1)
    session = F.when(name.endswith(".csv") & (F.length(name) > 4), F.substring(name, F.lit(1), F.length(name) - 4)).otherwise(name)
    dec = lines.filter(~kind.isin("phase", "questionnaire", "answer")).select(session.alias("session"), parts.alias("p"))
    decisions = dec.select(
        "session", F.col("p")[0].alias("phase"), F.col("p")[1].try_cast("int").alias("alert_idx"),
        F.col("p")[2].alias("user_decision"), F.col("p")[3].try_cast("double").alias("time_seconds"),
        F.col("p")[4].try_cast("int").alias("model_prediction"), F.col("p")[5].try_cast("int").alias("true_label"),
        F.when(F.size("p") > 6, F.nullif(F.col("p")[6], F.lit(""))).alias("feedback"))
    ans = lines.filter(kind == "answer").select(session.alias("session"), parts.alias("p"))
    answers = ans.select("session", F.posexplode(F.slice("p", F.lit(2), F.size("p"))).alias("i", "a")).select(
        "session", F.concat(F.lit("q"), (F.col("i") + 1).cast("string")).alias("question"),
        F.col("a").try_cast("int").alias("answer"))
    return decisions, answers


def read_combined(spark: SparkSession, results_path: str, questionnaire_path: str) -> tuple[DataFrame, DataFrame]:
    """Combined decisions and questionnaire CSVs with declared schemas."""
    d = spark.read.option("header", True).schema(
        "user_id int, phase string, alert_idx int, user_decision string, time_seconds double, "
        "model_prediction int, true_label int, correct int, feedback string").csv(results_path)
    q = spark.read.option("header", True).schema(
        "user int, q1 int, q2 int, q3 int, q4 int, q5 int").csv(questionnaire_path)
    return d, q


def with_user_index(decisions: DataFrame) -> DataFrame:
    """user_id = rank of the session name (sessions are few: one per analyst)."""
    users = decisions.select("session").distinct()
    from pyspark.sql import Window
    idx = users.withColumn("user_id", F.dense_rank().over(Window.orderBy("session")) - 1)
    return decisions.join(idx, "session")


def write_study(decisions: DataFrame, answers: DataFrame, out_dir: str, fmt: str = "csv") -> None:
    """K4/K6: the decision log and the answers as two tables."""
    for name, df in (("decisions", decisions), ("answers", answers)):
        w = df.write.mode("overwrite")
        (w.option("header", True).csv if fmt == "csv" else w.parquet)(f"{out_dir}/{name}")
