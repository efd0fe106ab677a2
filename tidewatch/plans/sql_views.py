"""DuckDB CTEs for the domain views, written independently of the Spark code
(FIXTURES.md part B). Compose as ``WITH {PACKETS_CTE}, ... SELECT``."""

LINE_ID = ("CAST(('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
           "CAST(l_quantity AS BIGINT))), 1, 15)) AS BIGINT)")

PACKETS_CTE = """packets AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS src, CAST(NULL AS BIGINT) AS dst, event_type,
         CASE event_type WHEN 'click' THEN 'TCP' WHEN 'view' THEN 'UDP' WHEN 'error' THEN 'ARP'
                         WHEN 'signup' THEN 'DNS' ELSE 'OTHER' END AS proto,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(json_extract_string(props, '$.k') AS INTEGER) * CAST(json_extract_string(props, '$.k') AS INTEGER) AS dport,
         value AS length, user_id AS ip,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 10 THEN 'm2' ELSE 'm1' END AS mac,
         user_id AS query_id,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) = 0 THEN user_id + 1 ELSE user_id END AS response_id,
         value AS ttl, 100.0 AS baseline_ttl, value AS rtt
  FROM events)"""

FLOWS_CTE = f"""flows AS (
  SELECT {LINE_ID} AS row_id, l_orderkey AS flow_id, l_shipdate AS "timestamp",
         l_quantity AS packet_length, l_suppkey AS dst_port, l_partkey AS part_key,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         l_linenumber AS line, l_returnflag AS attack_cat,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem)"""

PREDICTIONS_CTE = f"""preds AS (
  SELECT {LINE_ID} AS row_id,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
         l_quantity / 50.0 AS y_score,
         CASE WHEN l_quantity / 50.0 > 0.5 THEN 1 ELSE 0 END AS y_pred,
         CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS y_pred_b,
         l_suppkey AS group_key
  FROM lineitem)"""

DECISIONS_CTE = f"""decisions AS (
  SELECT l_suppkey AS user_id,
         CASE WHEN l_linestatus = 'O' THEN 'baseline' ELSE 'assisted' END AS phase,
         {LINE_ID} AS alert_idx,
         CASE WHEN (l_returnflag = 'R') = (l_discount > 0.05) THEN 'attack' ELSE 'benign' END AS user_decision,
         l_quantity AS time_seconds,
         CASE WHEN l_quantity / 50.0 > 0.5 THEN 1 ELSE 0 END AS model_prediction,
         CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS true_label,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS correct
  FROM lineitem)"""

ANSWERS_CTE = """answers AS (
  SELECT l_suppkey AS user_id, 'q' || CAST((l_linenumber - 1) % 5 + 1 AS VARCHAR) AS question, l_partkey % 5 + 1 AS answer
  FROM lineitem)"""

TS_FMT = "'%Y-%m-%d %H:%M:%S.%f'"


def ts(col: str) -> str:
    return f"strftime({col}, {TS_FMT})"
