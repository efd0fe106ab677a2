"""Domain views over the driver test tables (FIXTURES.md part B).

The reference works on packet records, flow records, model predictions and
user-study decisions. The test tables are a star schema plus an event stream,
so each view below is a pure projection that Catalyst folds into the scan:
only the columns a query finally uses are read from parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Fixed mapping of event types to protocols (FIXTURES B1).
PROTO_OF_EVENT = {"click": "TCP", "view": "UDP", "error": "ARP", "signup": "DNS", "purchase": "OTHER"}
DNS_BASELINE_TTL = 100.0


def _proto(col: Column) -> Column:
    expr = F.lit("OTHER")
    for ev, proto in reversed(list(PROTO_OF_EVENT.items())):
        expr = F.when(col == ev, F.lit(proto)).otherwise(expr)
    return expr


def line_id() -> Column:
    """Unique lineitem row id: 60 bits of md5 over the columns that are
    unique together (orderkey, linenumber, partkey, suppkey, quantity).
    ``orderkey*10+linenumber`` is not unique in the test data."""
    parts = [F.col(c).cast("bigint").cast("string")
             for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per event. Every packet carries the fields of every record
    kind (arp/dns/tcp/captured) so each detector can run over all of them."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return e.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("src"),
        F.lit(None).cast("bigint").alias("dst"),
        F.col("event_type"),
        _proto(F.col("event_type")).alias("proto"),
        k.alias("k"),
        (k * k).alias("dport"),
        F.col("value").alias("length"),
        F.col("user_id").alias("ip"),
        F.when(k < 10, F.lit("m2")).otherwise(F.lit("m1")).alias("mac"),
        F.col("user_id").alias("query_id"),
        F.when(k == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("response_id"),
        F.col("value").alias("ttl"),
        F.lit(DNS_BASELINE_TTL).alias("baseline_ttl"),
        F.col("value").alias("rtt"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records from lineitem: Flow ID, Timestamp, Packet Length,
    Destination Port, a 0/1 label and four numeric features."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        line_id().alias("row_id"),
        F.col("l_orderkey").alias("flow_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_quantity").alias("packet_length"),
        F.col("l_suppkey").alias("dst_port"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("attack_cat"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions hub: row_id, y_true, y_score, y_pred (model a) and
    y_pred_b (model b)."""
    return predictions_of(table(spark, sf_dir, "lineitem"))


def predictions_of(li: DataFrame) -> DataFrame:
    """The same projection of any table or stream of lines."""
    score = F.col("l_quantity") / 50.0
    return li.select(
        line_id().alias("row_id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_true"),
        score.alias("y_score"),
        F.when(score > 0.5, 1).otherwise(0).alias("y_pred"),
        F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("y_pred_b"),
        F.col("l_suppkey").alias("group_key"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-study decision log: user_id, phase, alert_idx, user_decision,
    time_seconds, model_prediction, true_label (``correct`` comes from
    :func:`tidewatch.functions.columns.correct_flag`)."""
    li = table(spark, sf_dir, "lineitem")
    true_label = F.when(F.col("l_discount") > 0.05, 1).otherwise(0)
    right = F.col("l_returnflag") == "R"
    # the analyst is right on returned lines; the decision text follows from that
    says_attack = F.when(right, true_label == 1).otherwise(true_label == 0)
    return li.select(
        F.col("l_suppkey").alias("user_id"),
        F.when(F.col("l_linestatus") == "O", "baseline").otherwise("assisted").alias("phase"),
        line_id().alias("alert_idx"),
        F.when(says_attack, "attack").otherwise("benign").alias("user_decision"),
        F.col("l_quantity").alias("time_seconds"),
        F.when(F.col("l_quantity") / 50.0 > 0.5, 1).otherwise(0).alias("model_prediction"),
        true_label.alias("true_label"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questionnaire answers in long form: user_id, question q1..q5, answer 1-5
    (every line of the table answers one of the five questions)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("user_id"),
                     F.concat(F.lit("q"), ((F.col("l_linenumber") - 1) % 5 + 1).cast("string")).alias("question"),
                     (F.col("l_partkey") % 5 + 1).alias("answer"))
