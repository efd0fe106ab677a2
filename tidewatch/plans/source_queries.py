"""File sources and sinks, on files that Spark writes from the given tables to
the checkpoint folder and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import correct_flag, question_code
from ..session import scratch_path
from ..sources import flows as fl
from ..sources import study
from ..sources.tables import table
from ..sources.views import answers, decisions
from .common import r6
from .registry import register
from .sql_views import ANSWERS_CTE, DECISIONS_CTE


def _folder(spark, name: str) -> str:
    return scratch_path(spark, f"files-{name}-{uuid.uuid4().hex}")


@register("ingested_flows", sql="""
SELECT 'cic' AS kind, CASE WHEN l_returnflag = 'N' THEN 'BENIGN' ELSE 'DoS' END AS attack_cat,
       CAST(l_returnflag <> 'N' AS INTEGER) AS label, count(*) AS n, ROUND(sum(l_quantity), 4) AS lengths,
       count(*) FILTER (WHERE l_linenumber > 3) AS with_extra, CAST(0 AS BIGINT) AS own_labels
FROM lineitem GROUP BY ALL
UNION ALL
SELECT 'unsw', CASE WHEN o_orderstatus = 'O' THEN 'Normal' ELSE 'Exploits' END, CAST(o_orderstatus <> 'O' AS INTEGER), count(*),
       NULL, 0, count(*) FROM orders GROUP BY ALL""")
def ingested_flows(spark, sf_dir):
    """Two CIC-style folders whose columns come in
    another order, one with a column more, and a UNSW-style folder; ingested,
    united, written as parquet and read from there."""
    li, at = table(spark, sf_dir, "lineitem"), _folder(spark, "flows")
    text = F.when(F.col("l_returnflag") == "N", " BENIGN ").otherwise("DoS")
    one, two = li.filter("l_linenumber <= 3"), li.filter("l_linenumber > 3")
    one.select(F.col("l_orderkey").cast("string").alias(" Flow ID"), F.col("l_quantity").alias(" Packet Length"),
               text.alias(" Label")).write.option("header", True).csv(f"{at}/one")
    two.select(text.alias("Label"), F.col("l_tax").alias("Extra Rate"), F.col("l_quantity").alias("Packet Length"),
               F.col("l_orderkey").cast("string").alias("Flow ID")).write.option("header", True).csv(f"{at}/two")
    o = table(spark, sf_dir, "orders")
    o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", " Normal").otherwise("Exploits").alias("attack_cat"),
             F.lit(1).alias("label")).write.option("header", True).csv(f"{at}/unsw")
    f = fl.load_flows(spark, [f"{at}/one", f"{at}/two", f"{at}/missing"], [f"{at}/unsw"], f"{at}/processed")
    kind = F.when(F.col("flow_id").isNull(), "unsw").otherwise("cic").alias("kind")
    return f.groupBy(kind, F.trim("attack_cat").alias("attack_cat"), "label").agg(
        F.count(F.lit(1)).alias("n"), r6(F.round(F.sum("packet_length"), 4), "lengths"), F.count("extra_rate").alias("with_extra"),
        F.count("unsw_label").alias("own_labels"))


@register("globbed_flows", sql="""
SELECT count(*) AS rows, count(*) FILTER (WHERE l_returnflag = 'N') AS benign, count(*) FILTER (WHERE l_returnflag <> 'N') AS attack,
       'flow_duration;label' AS features FROM lineitem""")
def globbed_flows(spark, sf_dir):
    """Every CSV file of a folder, its class counts, and the columns
    that the leak-safe drop list leaves for features (and the label)."""
    at = _folder(spark, "glob")
    li = table(spark, sf_dir, "lineitem")
    li.select(F.col("l_orderkey").cast("string").alias("Flow ID"), F.col("l_quantity").alias(" Packet Length "),
              F.col("l_tax").alias("Flow Duration"), F.when(F.col("l_returnflag") == "N", "BENIGN").otherwise("DoS").alias("Label")).write.option("header", True).csv(at)
    f = fl.load_glob(spark, at)
    kept = ";".join(sorted(c for c in fl.feature_matrix(f).columns if c in ("flow_id", "label", "packet_length", "flow_duration", "attack_cat")))
    return fl.class_counts(f).select("rows", "benign", "attack", F.lit(kept).alias("features"))


@register("combined_study", sql=f"""WITH {DECISIONS_CTE}, {ANSWERS_CTE}
SELECT 'decisions' AS name, count(*) AS n, CAST(sum(correct) AS BIGINT) AS total FROM decisions
UNION ALL SELECT question, count(*), CAST(sum(answer) AS BIGINT) FROM answers GROUP BY question""")
def combined_study(spark, sf_dir):
    """The combined decision and questionnaire files, written and read
    with declared schemas; answers are codes of the labels analysts chose."""
    at = _folder(spark, "combined")
    d = decisions(spark, sf_dir).withColumn("correct", correct_flag("user_decision", "true_label"))
    d.select((F.col("user_id") % 1_000_000).cast("int").alias("user_id"), "phase", F.lit(0).alias("alert_idx"), "user_decision", "time_seconds",
             "model_prediction", "true_label", "correct", F.lit("").alias("feedback")).write.option("header", True).csv(f"{at}/results")
    chosen = F.concat(F.col("answer").cast("string"), F.lit(" - chosen"))
    code = question_code(chosen)
    a = answers(spark, sf_dir)
    a.select((F.col("user_id") % 1_000_000).cast("int").alias("user"),
             *[F.when(F.col("question") == f"q{i}", code).alias(f"q{i}") for i in range(1, 6)]).write.option("header", True).csv(f"{at}/answers")
    r, q = study.read_combined(spark, f"{at}/results", f"{at}/answers")
    long = q.unpivot(["user"], [f"q{i}" for i in range(1, 6)], "name", "v").filter("v is not null")
    return r.agg(F.lit("decisions").alias("name"), F.count("*").alias("n"), F.sum("correct").alias("total")).unionByName(
        long.groupBy("name").agg(F.count("*").alias("n"), F.sum("v").alias("total")))


@register("study_files", sql=f"""WITH {DECISIONS_CTE}, {ANSWERS_CTE}
SELECT phase AS name, count(*) AS n, ROUND(sum(time_seconds), 4) AS total FROM decisions GROUP BY phase
UNION ALL SELECT question, count(*), CAST(sum(answer) AS DOUBLE) FROM answers GROUP BY question""")
def study_files(spark, sf_dir):
    """Session files of decision and answer lines, read as tables,
    written by the sink and read again."""
    at = _folder(spark, "study")
    # dealt by their values, so that there are more files than the table has row groups
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = decisions(spark, sf_dir).repartition(parts, "alert_idx").select(F.concat_ws(",", "phase", F.col("alert_idx").cast("string"), "user_decision",
                                                    F.col("time_seconds").cast("string"), F.col("model_prediction").cast("string"),
                                                    F.col("true_label").cast("string"), F.lit("")).alias("value"))
    # an answer line has a place for each of q1..q5; a question without an answer stays empty
    lines = answers(spark, sf_dir).repartition(parts, "user_id", "question", "answer").select(F.concat(F.lit("answer,"), F.array_join(F.transform(
        F.array(*[F.lit(f"q{i}") for i in range(1, 6)]), lambda q: F.when(q == F.col("question"), F.col("answer").cast("string")).otherwise("")),
        ",")).alias("value"))
    head = spark.createDataFrame([("phase,alert_idx,user_decision,time_seconds,model_prediction,true_label,feedback",), ("",),
                                  ("questionnaire,q1,q2,q3,q4,q5",)], "value string")
    head.unionAll(d).unionAll(lines).write.text(f"{at}/sessions")
    dec, ans = study.read_sessions(spark, f"{at}/sessions")
    study.write_study(dec, ans, f"{at}/tables", "parquet")
    dec, ans = spark.read.parquet(f"{at}/tables/decisions"), spark.read.parquet(f"{at}/tables/answers")
    per = dec.groupBy(F.col("phase").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("time_seconds"), 4).alias("total"))
    return per.unionByName(ans.filter("answer is not null").groupBy(F.col("question").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("answer").cast("double").alias("total")))
