"""Streaming twins: each runs a Structured Streaming query over the events
file to completion and returns its sink; the oracle is the batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import feedback as fb
from ..operators import packets as pk
from ..session import scratch_path
from ..sources import capture
from ..sources.tables import table
from ..sources.views import packets, predictions_of
from ..streaming import detectors as sd
from ..streaming import stateful as st
from .common import fmt_ts, r6
from .packet_queries import CAPTURE_ALERTS_SQL, HIJACK_SQL, SCAN_SQL, W
from .registry import oracle, register
from .sql_views import PREDICTIONS_CTE, ts


def _stream(spark, sf_dir):
    return sd.packet_stream(spark, sf_dir, file_glob="events.parquet")


@register("stream_port_scan", sql=f"""{SCAN_SQL}
SELECT alert_id, type, severity, src, detail, {ts('ts')} AS ts, event_id, n_ports FROM scan""")
def stream_port_scan(spark, sf_dir):
    out = sd.run_to_table(sd.port_scan_stream(_stream(spark, sf_dir)), "port_scan")
    return out.select("alert_id", "type", "severity", "src", "detail", fmt_ts("ts").alias("ts"), "event_id", "n_ports")


@register("stream_arp_spoof", sql=f"""{W}
SELECT event_id, ip, mac, first_mac FROM (
  SELECT event_id, ip, mac, first_value(mac) OVER (PARTITION BY ip ORDER BY ts, event_id) AS first_mac
  FROM packets) WHERE mac <> first_mac""")
def stream_arp_spoof(spark, sf_dir):
    return sd.run_to_table(sd.arp_spoof_stream(_stream(spark, sf_dir)), "arp_spoof")


@register("stream_session_hijack", sql=HIJACK_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT event_id, src, alert AS hijack_alert, ROUND(mean, 6) AS rtt_mean, ROUND(std, 6) AS rtt_std, n AS n_baseline FROM s""")
def stream_session_hijack(spark, sf_dir):
    h = sd.run_to_table(sd.session_hijack_stream(_stream(spark, sf_dir)), "session_hijack")
    return h.select("event_id", "src", "hijack_alert", r6("rtt_mean", "rtt_mean"), r6("rtt_std", "rtt_std"),
                    "n_baseline")


@register("stream_rate", sql=f"""{W}
SELECT {ts("date_trunc('hour', ts)")} AS window_start, count(*) AS packets FROM packets GROUP BY date_trunc('hour', ts)""")
def stream_rate(spark, sf_dir):
    r = sd.run_to_table(sd.rate_stream(_stream(spark, sf_dir), "1 hour"), "rate", output_mode="update", keys=("w",))
    return r.select(fmt_ts("w.start").alias("window_start"), "packets")


@register("stream_blocks", sql=f"""{W},
a AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts, event_id) AS rn FROM packets
      WHERE proto = 'DNS' AND (abs(ttl - baseline_ttl) > 50 OR query_id <> response_id)),
b AS (SELECT src, rn, ts, true AS opens, epoch_us(ts) + 1800000000 AS expires FROM a WHERE rn = 1
      UNION ALL
      SELECT a.src, a.rn, a.ts, epoch_us(a.ts) > b.expires,
             CASE WHEN epoch_us(a.ts) > b.expires THEN epoch_us(a.ts) + 1800000000 ELSE b.expires END
      FROM b JOIN a ON a.src = b.src AND a.rn = b.rn + 1)
SELECT src AS ip, {ts('ts')} AS blocked_at, {ts('make_timestamp(expires)')} AS expires_at, 1800 AS duration
FROM b WHERE opens""".replace("WITH ", "WITH RECURSIVE ", 1))
def stream_blocks(spark, sf_dir):
    b = sd.run_to_table(sd.dns_block_stream(_stream(spark, sf_dir)), "blocks")
    return b.select("ip", fmt_ts("blocked_at").alias("blocked_at"), fmt_ts("expires_at").alias("expires_at"),
                    "duration")


@register("stream_verdicts", sql=oracle("packet_verdict"))
def stream_verdicts(spark, sf_dir):
    """T4 as a stream: a verdict for every packet."""
    v = st.run_stateful(st.verdict_stream(_stream(spark, sf_dir)), "verdicts")
    return v.select("event_id", "src", "proto", "mitm_alert", F.array_join("mitm_type", ";").alias("mitm_type"), r6("mitm_score", "mitm_score"))


#: Analysts' sites: a stream of predictions belongs to one of so many.
SITES = 16


@register("stream_feedback", sql=f"""WITH RECURSIVE {PREDICTIONS_CTE},
n AS (SELECT row_id, group_key % {SITES} AS site, CASE WHEN y_pred = 1 AND y_true = 1 THEN '{fb.CONFIRMED}'
             WHEN y_pred = 1 AND y_true = 0 THEN '{fb.DISMISSED}' ELSE 'none' END AS verdict,
             row_number() OVER (PARTITION BY group_key % {SITES} ORDER BY row_id) AS rn FROM preds),
b AS (SELECT site, (rn - 1) // 50 AS batch, count(*) AS size, count(*) FILTER (WHERE verdict <> 'none') AS k FROM n GROUP BY ALL),
s AS (SELECT site, batch, 0::BIGINT AS cycle, size = 50 AND k >= 100 AS closes, k AS held FROM b WHERE batch = 0
      UNION ALL
      SELECT b.site, b.batch, s.cycle + s.closes::BIGINT, b.size = 50 AND q.h >= 100, q.h
      FROM s JOIN b ON b.site = s.site AND b.batch = s.batch + 1
      CROSS JOIN LATERAL (SELECT CASE WHEN s.closes THEN 0 ELSE s.held END + b.k AS h) q),
c AS (SELECT DISTINCT site, cycle FROM s WHERE closes)
SELECT n.site, s.cycle, n.row_id, n.rn, n.verdict, (n.verdict = '{fb.CONFIRMED}')::INT AS label
FROM n JOIN s ON s.site = n.site AND s.batch = (n.rn - 1) // 50 JOIN c ON c.site = s.site AND c.cycle = s.cycle WHERE n.verdict <> 'none'""")
def stream_feedback(spark, sf_dir):
    """T11 as a stream: retraining rows of every cycle that closes at a site."""
    lines = table(spark, sf_dir, "lineitem")
    p = predictions_of(spark.readStream.schema(lines.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir))
    verdict = (F.when((F.col("y_pred") == 1) & (F.col("y_true") == 1), fb.CONFIRMED)
               .when((F.col("y_pred") == 1) & (F.col("y_true") == 0), fb.DISMISSED).otherwise("none"))
    d = p.select((F.col("group_key") % SITES).alias("site"), "row_id", verdict.alias("verdict"))
    return st.run_stateful(st.feedback_stream(d), "feedback").select("site", "cycle", "row_id", "rn", "verdict", "label")


@register("stream_traffic", sql=oracle("traffic_report"))
def stream_traffic(spark, sf_dir):
    """T8 as a stream: counts, alerts, and heavy hitters of sources and ports
    by mergeable summaries with an exact second pass."""
    return st.traffic_report(_stream(spark, sf_dir), packets(spark, sf_dir).select(*pk.ORDER, "src", "dport", "proto"))


@register("packet_source", sql=f"""{W},
x AS (SELECT *, CASE WHEN event_id % 97 = 5 THEN 'not JSON' WHEN event_id % 89 = 7 THEN 'bad dport'
                     WHEN event_id % 83 = 11 THEN 'no len' END AS reason FROM packets)
SELECT CASE WHEN reason IS NULL THEN event_id END AS event_id, CASE WHEN reason IS NULL THEN {ts('ts')} END AS ts,
       CASE WHEN reason IS NULL THEN proto END AS proto, CASE WHEN reason IS NULL THEN CAST(src AS VARCHAR) END AS src,
       CASE WHEN reason IS NULL THEN dport END AS dport, CASE WHEN reason IS NULL THEN ROUND(length, 6) END AS length, reason FROM x""")
def packet_source(spark, sf_dir):
    """Events written as a capture, some lines broken, and read by the
    capture source as a stream; every line comes back, as packet or rejected."""
    path = scratch_path(spark, "capture-" + uuid.uuid4().hex)
    i = F.col("event_id")
    p = packets(spark, sf_dir).select("event_id", "ts", "proto", "length", F.col("src").cast("string").alias("src"),
                                      F.when(i % 89 == 7, F.col("dport") + 70_000).otherwise(F.col("dport")).alias("dport"))
    line = capture.record_line(p)
    line = F.when(i % 97 == 5, F.substring(line, 1, 25)).when((i % 89 != 7) & (i % 83 == 11), F.regexp_replace(line, '"len":[^,}]*,?', "")).otherwise(line)
    p.select(line.alias("value")).write.text(path)
    got = sd.run_to_table(capture.capture_stream(spark, path, None), "capture")
    return got.select("event_id", fmt_ts("ts").alias("ts"), "proto", "src", "dport", r6("length", "length"), "reason")
