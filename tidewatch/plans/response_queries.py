"""Mitigation decisions and feedback cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

import uuid

from ..functions.columns import band, correct_flag
from ..operators import feedback as fb
from ..operators import metrics as mt
from ..operators import packets as pk
from ..operators import response as rs
from ..session import scratch_path
from ..sources import sinks
from ..sources.views import decisions, packets, predictions
from .common import fmt_ts, r6
from .packet_queries import CAPTURE_ALERTS_SQL, HIJACK_SQL, W
from .registry import register
from .sql_views import DECISIONS_CTE, PREDICTIONS_CTE, ts

# DuckDB: verdicts per packet (T4), then per-source block recursion.
VERDICT_SQL = f"""{W},
arp AS (SELECT event_id, CASE WHEN mac <> first_value(mac) OVER (PARTITION BY ip ORDER BY ts, event_id)
                              THEN 'ARP_SPOOFING' END AS t FROM packets WHERE proto = 'ARP'),
dns AS (SELECT event_id, CASE WHEN abs(ttl - baseline_ttl) > 50 OR query_id <> response_id
                              THEN 'DNS_POISONING' END AS t FROM packets WHERE proto = 'DNS'),
{HIJACK_SQL.replace(f"{W},", "", 1).replace("FROM packets)", "FROM packets WHERE proto = 'TCP')", 1)},
tcp AS (SELECT event_id, CASE WHEN alert THEN 'SESSION_HIJACKING' END AS t FROM s),
flagged AS (SELECT * FROM arp UNION ALL SELECT * FROM dns UNION ALL SELECT * FROM tcp),
v AS (SELECT p.event_id, p.ts, p.src, p.dst, f.t AS mitm_type,
             CASE WHEN f.t IN ('SESSION_HIJACKING', 'DNS_POISONING') THEN 'critical' ELSE 'high' END AS severity
      FROM packets p JOIN flagged f USING (event_id) WHERE f.t IS NOT NULL),
vr AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts, event_id) AS rn FROM v),
blk AS (
  SELECT src, rn, event_id, true AS opens, epoch_us(ts) + 1800000000 AS expires FROM vr WHERE rn = 1
  UNION ALL
  SELECT vr.src, vr.rn, vr.event_id, epoch_us(vr.ts) > blk.expires,
         CASE WHEN epoch_us(vr.ts) > blk.expires THEN epoch_us(vr.ts) + 1800000000 ELSE blk.expires END
  FROM blk JOIN vr ON vr.src = blk.src AND vr.rn = blk.rn + 1),
dec AS (SELECT vr.*, blk.opens, blk.expires FROM vr JOIN blk USING (src, rn))""".replace("WITH ", "WITH RECURSIVE ", 1)


def _decisions(spark, sf_dir, auto=True):
    v = pk.packet_verdict(packets(spark, sf_dir))
    return rs.block_decisions(v, auto=auto, duration_s=1800)


@register("severity", sql=f"""{VERDICT_SQL}
SELECT severity, count(*) AS alerts FROM v GROUP BY severity""")
def severity(spark, sf_dir):
    """Alert severity counts over all MITM verdicts."""
    v = rs.with_severity(pk.packet_verdict(packets(spark, sf_dir)).filter("mitm_alert"))
    return v.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))


@register("block_intervals", sql=f"""{VERDICT_SQL}
SELECT src AS ip, 'MITM: ' || mitm_type AS reason, {ts('ts')} AS blocked_at, {ts('make_timestamp(expires)')} AS expires_at,
       1800 AS duration FROM dec WHERE opens""")
def block_intervals(spark, sf_dir):
    """A source is not re-blocked while its 1800 s block is in force."""
    b = rs.block_intervals(_decisions(spark, sf_dir), 1800)
    return b.select("ip", "reason", fmt_ts("blocked_at").alias("blocked_at"),
                    fmt_ts("expires_at").alias("expires_at"), "duration")


@register("active_blocks", sql=f"""{VERDICT_SQL},
t AS (SELECT max(ts) - INTERVAL 6 HOUR AS at_ts FROM packets)
SELECT src AS ip, {ts('ts')} AS blocked_at FROM dec, t
WHERE opens AND ts <= at_ts AND make_timestamp(expires) >= at_ts""")
def active_blocks(spark, sf_dir):
    """Blocks in force six hours before the end of the stream."""
    p = packets(spark, sf_dir)
    at = p.agg((F.max("ts") - F.expr("INTERVAL 6 HOURS")).alias("at"))
    b = rs.block_intervals(_decisions(spark, sf_dir), 1800).crossJoin(F.broadcast(at))
    return rs.active_blocks(b, F.col("at")).select("ip", fmt_ts("blocked_at").alias("blocked_at"))


@register("mitigation_log", sql=f"""{VERDICT_SQL}
SELECT event_id, {ts('ts')} AS "timestamp", mitm_type AS mitm_types, severity,
       CASE WHEN opens THEN 'block_ip:' || CAST(src AS VARCHAR) || ';' ELSE '' END
         || 'terminate_session:' || coalesce(CAST(src AS VARCHAR), '') || '->' || coalesce(CAST(dst AS VARCHAR), '')
         AS actions, true AS auto_mitigated, CASE WHEN opens THEN 2 ELSE 1 END AS action_count FROM dec""")
def mitigation_log(spark, sf_dir):
    """One log row per alert with auto mitigation on."""
    m = rs.mitigation_log(_decisions(spark, sf_dir), auto=True)
    return m.select("event_id", fmt_ts("ts").alias("timestamp"), F.array_join("mitm_type", ";").alias("mitm_types"),
                    "severity", F.col("actions_text").alias("actions"), "auto_mitigated",
                    F.col("action_count").cast("int").alias("action_count"))


# Control events: purchases with k below 2 stand for an analyst's unblock of
# their source.
UNBLOCK_SQL = f"""{VERDICT_SQL},
ev AS (SELECT event_id, ts, src, false AS ctl FROM v
       UNION ALL SELECT event_id, ts, src, true FROM packets WHERE proto = 'OTHER' AND k < 2),
er AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts, event_id) AS rn FROM ev),
ub AS (
  SELECT src, rn, event_id, NOT ctl AS opens, CASE WHEN NOT ctl THEN epoch_us(ts) + 1800000000 END AS expires,
         CASE WHEN NOT ctl THEN event_id END AS opened, CAST(NULL AS BIGINT) AS ends FROM er WHERE rn = 1
  UNION ALL
  SELECT er.src, er.rn, er.event_id, q.opens,
         CASE WHEN er.ctl THEN NULL WHEN q.opens THEN epoch_us(er.ts) + 1800000000 ELSE ub.expires END,
         CASE WHEN er.ctl THEN NULL WHEN q.opens THEN er.event_id ELSE ub.opened END,
         CASE WHEN er.ctl AND ub.expires IS NOT NULL AND epoch_us(er.ts) <= ub.expires THEN ub.opened END
  FROM ub JOIN er ON er.src = ub.src AND er.rn = ub.rn + 1
  CROSS JOIN LATERAL (SELECT NOT er.ctl AND (ub.expires IS NULL OR epoch_us(er.ts) > ub.expires) AS opens) q),
ui AS (SELECT er.src AS ip, er.event_id, er.ts AS blocked_at, u.event_id IS NOT NULL AS unblocked,
              least(make_timestamp(ub.expires), ue.ts) AS expires_at
       FROM ub JOIN er USING (src, rn) LEFT JOIN ub u ON u.ends = ub.event_id AND u.src = ub.src
       LEFT JOIN er ue ON ue.src = u.src AND ue.rn = u.rn WHERE ub.opens)"""


def _controlled(spark, sf_dir):
    p = packets(spark, sf_dir)
    v = pk.packet_verdict(p).select("event_id", "ts", "src", "dst", "mitm_alert", "mitm_type")
    control = p.filter((F.col("proto") == "OTHER") & (F.col("k") < 2)).select(
        "event_id", "ts", "src", "dst", F.lit(False).alias("mitm_alert"), F.lit(None).cast("array<string>").alias("mitm_type"))
    both = v.filter("mitm_alert").withColumn("action", F.lit("alert")).unionByName(control.withColumn("action", F.lit("unblock")))
    return rs.block_decisions(both, auto=True, duration_s=1800)


@register("unblock_events", sql=f"""{UNBLOCK_SQL}
SELECT ip, event_id, {ts('blocked_at')} AS blocked_at, {ts('expires_at')} AS expires_at FROM ui""")
def unblock_events(spark, sf_dir):
    """Blocks when control events end them early; an alert after an
    unblock opens a new block."""
    b = rs.block_intervals(_controlled(spark, sf_dir), 1800, keep=["event_id"])
    return b.select("ip", "event_id", fmt_ts("blocked_at").alias("blocked_at"), fmt_ts("expires_at").alias("expires_at"))


@register("blocked_alerts", sql=f"""{UNBLOCK_SQL}
SELECT v.event_id, v.src, {ts('ui.blocked_at')} AS blocked_at FROM v JOIN ui ON v.src = ui.ip
       AND v.ts > ui.blocked_at AND v.ts <= ui.expires_at""")
def blocked_alerts(spark, sf_dir):
    """Alerts that come while their source is blocked."""
    d = _controlled(spark, sf_dir)
    b = rs.block_intervals(d, 1800)
    a = d.filter("action = 'alert'").select("event_id", "src", "ts")
    return rs.alerts_on_blocked(a, b).select("event_id", "src", fmt_ts("blocked_at").alias("blocked_at"))


# Toggle events: purchases with k of 2, 3 and 4 switch automatic mitigation on,
# off and over.
TOGGLE_SQL = f"""{VERDICT_SQL},
tg AS (SELECT event_id, ts, CASE k WHEN 2 THEN 'on' WHEN 3 THEN 'off' ELSE 'flip' END AS toggle FROM packets
       WHERE proto = 'OTHER' AND k BETWEEN 2 AND 4),
mx AS (SELECT event_id, ts, CAST(NULL AS VARCHAR) AS toggle FROM v UNION ALL SELECT * FROM tg),
m1 AS (SELECT *, count(*) FILTER (WHERE toggle = 'flip') OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS flips FROM mx),
m2 AS (SELECT event_id, toggle, flips,
              last_value(CASE WHEN toggle IN ('on', 'off') THEN toggle = 'on' END IGNORE NULLS) OVER w AS flag,
              last_value(CASE WHEN toggle IN ('on', 'off') THEN flips END IGNORE NULLS) OVER w AS set_at
       FROM m1 WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
el AS (SELECT v.*, coalesce(flag, true) <> ((flips - coalesce(set_at, 0)) % 2 = 1) AS auto FROM v JOIN m2 USING (event_id)),
ea AS (SELECT *, auto OR severity = 'critical' AS acts FROM el),
eo AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts, event_id) AS rn2 FROM ea WHERE acts),
eb AS (SELECT src, rn2, event_id, true AS opens, epoch_us(ts) + 1800000000 AS expires FROM eo WHERE rn2 = 1
       UNION ALL
       SELECT eo.src, eo.rn2, eo.event_id, epoch_us(eo.ts) > eb.expires,
              CASE WHEN epoch_us(eo.ts) > eb.expires THEN epoch_us(eo.ts) + 1800000000 ELSE eb.expires END
       FROM eb JOIN eo ON eo.src = eb.src AND eo.rn2 = eb.rn2 + 1)"""


@register("auto_toggle", sql=f"""{TOGGLE_SQL}
SELECT ea.event_id, ea.src, severity, auto, CASE WHEN NOT acts THEN 0 WHEN opens THEN 2 ELSE 1 END AS action_count
FROM ea LEFT JOIN eb USING (event_id)""")
def auto_toggle(spark, sf_dir):
    """Alerts under the automatic mode that the last toggle before them
    left; with it off only critical alerts act."""
    p = packets(spark, sf_dir)
    v = pk.packet_verdict(p).filter("mitm_alert").select("event_id", "ts", "src", "dst", "mitm_alert", "mitm_type")
    k = F.col("k")
    toggles = p.filter((F.col("proto") == "OTHER") & k.between(2, 4)).select(
        "event_id", "ts", "src", "dst", F.lit(False).alias("mitm_alert"), F.lit(None).cast("array<string>").alias("mitm_type"),
        F.when(k == 2, "on").when(k == 3, "off").otherwise("flip").alias("toggle"))
    x = rs.auto_mode(v.withColumn("toggle", F.lit(None).cast("string")).unionByName(toggles)).filter("toggle is null")
    m = rs.mitigation_log(rs.block_decisions(x, auto="auto"), auto="auto")
    return m.select("event_id", "src", "severity", F.col("auto_mitigated").alias("auto"), F.col("action_count").cast("int").alias("action_count"))


def _commit_in_batches(df, path, epoch, batches=5):
    """Commits ``df`` to a log in several batches, each twice, as a retried
    micro-batch would."""
    for e in range(batches):
        part = df.filter(F.pmod(epoch, F.lit(batches)) == e)
        for _ in range(2):
            sinks.commit_batch(part.drop("_epoch"), path, e)


@register("mitigation_log_file", sql=f"""{VERDICT_SQL}
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp", mitm_type AS mitm_types, severity,
       CASE WHEN opens THEN 'block_ip:' || CAST(src AS VARCHAR) || ';' ELSE '' END
         || 'terminate_session:' || coalesce(CAST(src AS VARCHAR), '') || '->' || coalesce(CAST(dst AS VARCHAR), '')
         AS actions, true AS auto_mitigated, CASE WHEN opens THEN 2 ELSE 1 END AS action_count FROM dec""")
def mitigation_log_file(spark, sf_dir):
    """The log written as files in batches that are each run twice,
    and read back: every row is there once."""
    path = scratch_path(spark, "mitigation-log-" + uuid.uuid4().hex)
    rows = sinks.mitigation_file_rows(rs.mitigation_log(_decisions(spark, sf_dir), auto=True))
    rows = rs._written(rows, "log")
    _commit_in_batches(rows, path, F.col("event_id"))
    back = sinks.committed_rows(spark, path, sinks.MITIGATION_FILE)
    return back.select("event_id", "timestamp", "mitm_types", "severity", "actions", "auto_mitigated", "action_count")


@register("feedback_log_file", sql=f"""WITH {DECISIONS_CTE},
f AS (SELECT strftime(DATE '2024-01-01' + to_seconds(CAST(alert_idx % 86400 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp",
             alert_idx, true_label, model_prediction AS predicted, user_decision, correct FROM decisions)
SELECT * FROM f ORDER BY "timestamp" DESC, alert_idx DESC LIMIT 50""")
def feedback_log_file(spark, sf_dir):
    """The feedback log committed as files in batches that are each run
    twice; its newest 50 rows (the length is the feature), equal times by id."""
    d = decisions(spark, sf_dir)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("alert_idx") % 86400)
    rows = sinks.feedback_rows(d.select(at.alias("ts"), "alert_idx", "true_label", F.col("model_prediction").alias("predicted"),
                                        "user_decision", correct_flag("user_decision", "true_label").alias("correct")))
    path = scratch_path(spark, "feedback-log-" + uuid.uuid4().hex)
    _commit_in_batches(rows, path, F.col("alert_idx"))
    return sinks.newest_rows(sinks.committed_rows(spark, path, sinks.FEEDBACK_FILE), "alert_idx").drop("epoch")


@register("capture_mitigation", sql=f"""{CAPTURE_ALERTS_SQL}
SELECT upper(replace(type, ' ', '_')) AS mitm_type, 'high' AS severity, count(*) AS alerts, count(DISTINCT src) AS sources
FROM alerts GROUP BY type""")
def capture_mitigation(spark, sf_dir):
    """Capture alerts as verdicts on the mitigation path."""
    v = rs.with_severity(rs.normalise_capture_alerts(pk.capture_alerts(packets(spark, sf_dir))))
    return v.groupBy(F.array_join("mitm_type", ";").alias("mitm_type"), "severity").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_distinct("src").alias("sources"))


@register("mitm_bands", sql=f"""{VERDICT_SQL}
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS alerts,
       CASE WHEN count(*) < 3 THEN 'green' WHEN count(*) < 10 THEN 'yellow' ELSE 'red' END AS band
FROM v GROUP BY date_trunc('day', ts)""")
def mitm_bands(spark, sf_dir):
    """MITM alerts per day with the 0/3/10 colour bands."""
    v = pk.packet_verdict(packets(spark, sf_dir)).filter("mitm_alert")
    d = v.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count(F.lit(1)).alias("alerts"))
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "alerts",
                    band("alerts", [3, 10], ["green", "yellow", "red"]).alias("band"))


@register("mitigation_stats", sql=f"""{VERDICT_SQL},
t AS (SELECT max(ts) - INTERVAL 6 HOUR AS at_ts FROM packets),
acts AS (SELECT ts, event_id, 0 AS pos, 'block_ip' AS action, CAST(src AS VARCHAR) AS target FROM dec WHERE opens
         UNION ALL SELECT ts, event_id, opens::INT, 'terminate_session',
                          coalesce(CAST(src AS VARCHAR), '') || '->' || coalesce(CAST(dst AS VARCHAR), '') FROM dec),
la AS (SELECT * FROM acts ORDER BY ts DESC, event_id DESC, pos DESC LIMIT 20),
lt AS (SELECT * FROM acts WHERE action = 'terminate_session' ORDER BY ts DESC, event_id DESC, pos DESC LIMIT 50)
SELECT (SELECT count(*) FROM dec) AS total_mitigated, (SELECT count(*) FROM acts) AS total_actions,
       (SELECT count(*) FROM dec, t WHERE opens AND ts <= at_ts AND make_timestamp(expires) >= at_ts) AS active_blocks,
       (SELECT string_agg(action || ':' || target, ';' ORDER BY ts DESC, event_id DESC, pos DESC) FROM la) AS last_actions,
       (SELECT string_agg(action || ':' || target, ';' ORDER BY ts DESC, event_id DESC, pos DESC) FROM lt) AS terminated_sessions""")
def mitigation_stats(spark, sf_dir):
    """Totals, blocks in force, last 20 actions, last 50 terminated
    sessions (the list lengths are the feature)."""
    p = packets(spark, sf_dir)
    d = _decisions(spark, sf_dir)
    at = p.agg((F.max("ts") - F.expr("INTERVAL 6 HOURS")).alias("at"))
    blocks = rs.block_intervals(d, 1800).crossJoin(F.broadcast(at))
    return rs.mitigation_stats(rs.mitigation_log(d), blocks, F.col("at"))


FEEDBACK_SQL = f"""WITH RECURSIVE {PREDICTIONS_CTE},
f AS (SELECT row_id, y_true, y_pred, CASE WHEN y_pred = 1 AND y_true = 1 THEN 'confirmed_tp'
                                    WHEN y_pred = 1 AND y_true = 0 THEN 'dismissed_fp' ELSE 'none' END AS verdict
      FROM preds),
n AS (SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM f),
b AS (SELECT (rn - 1) // 50 AS batch, count(*) FILTER (WHERE verdict = 'confirmed_tp') AS ntp,
             count(*) FILTER (WHERE verdict = 'dismissed_fp') AS nfp FROM n GROUP BY 1),
s AS (
  SELECT batch, 0::BIGINT AS cycle, least(ntp, 500) + least(nfp, 500) >= 100 AS closes,
         CASE WHEN least(ntp, 500) + least(nfp, 500) >= 100 THEN 0 ELSE least(ntp, 500) END AS tp,
         CASE WHEN least(ntp, 500) + least(nfp, 500) >= 100 THEN 0 ELSE least(nfp, 500) END AS fp,
         CASE WHEN least(ntp, 500) + least(nfp, 500) >= 100 THEN 1 ELSE 0 END::BIGINT AS next_cycle
  FROM b WHERE batch = 0
  UNION ALL
  SELECT b.batch, s.next_cycle, q.t + q.f >= 100,
         CASE WHEN q.t + q.f >= 100 THEN 0 ELSE q.t END, CASE WHEN q.t + q.f >= 100 THEN 0 ELSE q.f END,
         CASE WHEN q.t + q.f >= 100 THEN s.next_cycle + 1 ELSE s.next_cycle END
  FROM s JOIN b ON b.batch = s.batch + 1
  CROSS JOIN LATERAL (SELECT least(s.tp + b.ntp, 500) AS t, least(s.fp + b.nfp, 500) AS f) q),
lastc AS (SELECT max(cycle) AS last FROM s WHERE closes),
cyc AS (SELECT n.*, CASE WHEN s.cycle <= lastc.last THEN s.cycle END AS cycle
        FROM n JOIN s ON s.batch = (n.rn - 1) // 50, lastc)"""


def _cycles(spark, sf_dir):
    p = predictions(spark, sf_dir)
    verdict = (F.when((F.col("y_pred") == 1) & (F.col("y_true") == 1), fb.CONFIRMED)
               .when((F.col("y_pred") == 1) & (F.col("y_true") == 0), fb.DISMISSED).otherwise("none"))
    f = p.select("row_id", "y_true", "y_pred", verdict.alias("verdict"))
    return fb.assign_cycles(f, ["row_id"], batch_size=50, interval=100)


@register("feedback_cycles", sql=f"""{FEEDBACK_SQL},
rs AS (SELECT *, row_number() OVER (PARTITION BY cycle, verdict ORDER BY rn DESC) AS age FROM cyc
       WHERE cycle IS NOT NULL AND verdict IN ('confirmed_tp', 'dismissed_fp'))
SELECT cycle, count(*) FILTER (WHERE verdict = 'confirmed_tp') AS n_tp,
       count(*) FILTER (WHERE verdict = 'dismissed_fp') AS n_fp, min(rn) AS first_rn, max(rn) AS last_rn
FROM rs WHERE age <= 500 GROUP BY cycle""")
def feedback_cycles(spark, sf_dir):
    """Batches of 50, a cycle closes when >= 100 rows are buffered."""
    r = fb.retraining_set(_cycles(spark, sf_dir))
    return r.groupBy("cycle").agg(F.count(F.when(F.col("label") == 1, 1)).alias("n_tp"),
                                  F.count(F.when(F.col("label") == 0, 1)).alias("n_fp"),
                                  F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"))


@register("retraining_set", sql=f"""{FEEDBACK_SQL},
rs AS (SELECT *, row_number() OVER (PARTITION BY cycle, verdict ORDER BY rn DESC) AS age FROM cyc
       WHERE cycle IS NOT NULL AND verdict IN ('confirmed_tp', 'dismissed_fp'))
SELECT row_id, cycle, CASE WHEN verdict = 'confirmed_tp' THEN 1 ELSE 0 END AS label FROM rs WHERE age <= 500""")
def retraining_set(spark, sf_dir):
    """U4: confirmed -> 1, dismissed -> 0, per closed cycle."""
    r = fb.retraining_set(_cycles(spark, sf_dir))
    return r.select("row_id", "cycle", F.col("label").cast("int").alias("label"))


@register("feedback_stats", sql=f"""{FEEDBACK_SQL}
SELECT least(count(*) FILTER (WHERE cycle IS NULL AND verdict = 'confirmed_tp'), 500) AS tp_buffer_size,
       least(count(*) FILTER (WHERE cycle IS NULL AND verdict = 'dismissed_fp'), 500) AS fp_buffer_size,
       coalesce(max(cycle) + 1, 0) AS retraining_cycles FROM cyc""")
def feedback_stats(spark, sf_dir):
    """A15."""
    return fb.feedback_stats(_cycles(spark, sf_dir))


@register("fpr_by_cycle", sql=f"""{FEEDBACK_SQL}
SELECT cycle, ROUND(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS fpr FROM (
  SELECT cycle, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
         count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn FROM cyc WHERE cycle IS NOT NULL GROUP BY cycle)""")
def fpr_by_cycle(spark, sf_dir):
    """FPR of the scored rows of each retraining cycle."""
    m = mt.binary_metrics(_cycles(spark, sf_dir).filter(F.col("cycle").isNotNull()), ["cycle"])
    return m.select("cycle", r6("fpr", "fpr"))
