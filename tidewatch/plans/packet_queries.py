"""Packet detectors and traffic statistics over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packets as pk
from ..sources.views import packets
from .common import fmt_ts, r6
from .registry import register
from .sql_views import PACKETS_CTE, ts

W = f"WITH {PACKETS_CTE}"
PORT_PACKETS = "pp AS (SELECT * FROM packets WHERE src IS NOT NULL AND dport IS NOT NULL AND dport <> 0)"
SCAN_SQL = f"""{W}, {PORT_PACKETS},
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY src, dport ORDER BY ts, event_id) = 1
                     THEN 1 ELSE 0 END AS is_new FROM pp),
c AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY src ORDER BY ts, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_ports FROM f),
scan AS (SELECT event_id * 4 + 1 AS alert_id, 'Port Scan' AS type, 'High' AS severity, src,
                CAST(src AS VARCHAR) || ' contacted ' || CAST(n_ports AS VARCHAR) || ' unique ports — possible scan' AS detail,
                ts, event_id, n_ports
         FROM c WHERE n_ports >= 10 AND n_ports % 5 = 0)"""


def _alert_out(df):
    return df.select("alert_id", "type", "severity", "src", "detail", fmt_ts("ts").alias("ts"), "event_id")


@register("top_scan_sources", sql=f"""{SCAN_SQL}
SELECT src, alerts FROM (
  SELECT src, count(*) AS alerts, min(ts) AS f_ts, arg_min(event_id, (ts, event_id)) AS f_id
  FROM scan GROUP BY src) ORDER BY alerts DESC, f_ts, f_id LIMIT 5""")
def top_scan_sources(spark, sf_dir):
    """Flagship: port-scan alerts -> top-5 sources by alert count (ties: first alert first)."""
    alerts = pk.port_scan_alerts(packets(spark, sf_dir))
    return (alerts.groupBy("src").agg(F.count(F.lit(1)).alias("alerts"),
                                      F.min(F.struct("ts", "event_id")).alias("first"))
            .orderBy(F.desc("alerts"), F.asc("first")).limit(5).select("src", "alerts"))


@register("port_scan", sql=f"""{SCAN_SQL}
SELECT alert_id, type, severity, src, detail, {ts('ts')} AS ts, event_id, n_ports FROM scan""")
def port_scan(spark, sf_dir):
    """Running distinct ports per source (segmented scan), alert rows."""
    al = pk.port_scan_alerts(packets(spark, sf_dir))
    return al.select("alert_id", "type", "severity", "src", "detail", fmt_ts("ts").alias("ts"), "event_id", "n_ports")


@register("unusual_port", sql=f"""{W}, {PORT_PACKETS}
SELECT event_id * 4 AS alert_id, 'Unusual Port' AS type, 'Medium' AS severity, src,
       'Traffic on unusual port ' || CAST(dport AS VARCHAR) || '/' || proto AS detail, {ts('ts')} AS ts, event_id
FROM pp
WHERE dport IN (7, 9, 19, 21, 23, 135, 137, 139, 389, 502, 2323, 3128, 4444, 6660, 6661, 6662, 6663, 6664,
                6665, 6666, 6667, 6668, 6669, 12345, 31337, 44444, 65535)
   OR (dport < 1024 AND dport NOT IN (22, 25, 53, 80, 110, 123, 143, 443, 445, 993, 995, 3306, 3389, 5432, 8080, 8443))""")
def unusual_port(spark, sf_dir):
    return _alert_out(pk.unusual_port_alerts(packets(spark, sf_dir)))


@register("arp_activity", sql=f"""{W}
SELECT event_id * 4 + 2 AS alert_id, 'ARP Activity' AS type, 'Info' AS severity, src,
       'ARP packet detected — possible MITM reconnaissance' AS detail, {ts('ts')} AS ts, event_id
FROM packets WHERE proto = 'ARP'""")
def arp_activity(spark, sf_dir):
    return _alert_out(pk.arp_activity_alerts(packets(spark, sf_dir)))


@register("arp_spoof", sql=f"""{W}
SELECT event_id, ip, mac, first_mac FROM (
  SELECT event_id, ip, mac, first_value(mac) OVER (PARTITION BY ip ORDER BY ts, event_id) AS first_mac
  FROM packets) WHERE mac <> first_mac""")
def arp_spoof(spark, sf_dir):
    return (pk.arp_spoof(packets(spark, sf_dir)).filter("arp_alert")
            .select("event_id", "ip", "mac", "first_mac"))


@register("dns_poison", sql=f"""{W}
SELECT event_id, src, query_id, response_id, ROUND(ttl, 6) AS ttl,
       ROUND(abs(ttl - baseline_ttl), 6) AS deviation
FROM packets WHERE abs(ttl - baseline_ttl) > 50 OR query_id <> response_id""")
def dns_poison(spark, sf_dir):
    d = pk.dns_poison(packets(spark, sf_dir)).filter("dns_alert")
    return d.select("event_id", "src", "query_id", "response_id", r6("ttl", "ttl"),
                    r6(F.abs(F.col("ttl") - F.col("baseline_ttl")), "deviation"))


HIJACK_SQL = f"""{W},
p AS (SELECT src, event_id, rtt, row_number() OVER (PARTITION BY src ORDER BY ts, event_id) AS rn FROM packets),
s AS (
  SELECT src, rn, event_id, false AS alert, rtt AS mean, 0.0::DOUBLE AS std, 1::BIGINT AS n FROM p WHERE rn = 1
  UNION ALL
  SELECT p.src, p.rn, p.event_id, q.alert,
         CASE WHEN q.alert THEN s.mean ELSE (s.mean * s.n + p.rtt) / (s.n + 1) END,
         CASE WHEN q.alert THEN s.std
              ELSE sqrt((s.std * s.std * s.n + (p.rtt - (s.mean * s.n + p.rtt) / (s.n + 1)) ^ 2) / (s.n + 1)) END,
         CASE WHEN q.alert THEN s.n ELSE s.n + 1 END
  FROM s JOIN p ON p.src = s.src AND p.rn = s.rn + 1
  CROSS JOIN LATERAL (SELECT s.n > 10 AND abs(p.rtt - s.mean) > 2.5 * greatest(s.std, 1e-6) AS alert) q)"""


@register("session_hijack", sql=HIJACK_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT event_id, src, alert AS hijack_alert, ROUND(mean, 6) AS rtt_mean, ROUND(std, 6) AS rtt_std, n AS n_baseline FROM s""")
def session_hijack(spark, sf_dir):
    h = pk.session_hijack(packets(spark, sf_dir))
    return h.select("event_id", "src", "hijack_alert", r6("rtt_mean", "rtt_mean"),
                    r6("rtt_std", "rtt_std"), "n_baseline")


@register("proto_counts", sql=f"""{W}
SELECT count(*) AS total, count(*) FILTER (WHERE proto = 'TCP') AS tcp, count(*) FILTER (WHERE proto = 'UDP') AS udp,
       count(*) FILTER (WHERE proto = 'ARP') AS arp, CAST(0 AS BIGINT) AS dns,
       greatest(count(*) - count(*) FILTER (WHERE proto IN ('TCP', 'UDP', 'ARP')), 0) AS other
FROM packets""")
def proto_counts(spark, sf_dir):
    return pk.proto_counts(packets(spark, sf_dir))


def _top_sql(key: str, where: str) -> str:
    return f"""{W}
SELECT {key}, n, {ts('first_ts')} AS first_ts FROM (
  SELECT {key}, count(*) AS n, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS first_id
  FROM packets WHERE {where} GROUP BY {key}) ORDER BY n DESC, first_ts, first_id LIMIT 5"""


@register("top_sources", sql=_top_sql("src", "proto <> 'ARP' AND src IS NOT NULL"))
def top_sources(spark, sf_dir):
    t = pk.top_by_count(packets(spark, sf_dir), "src", 5)
    return t.select("src", "n", fmt_ts("first_ts").alias("first_ts"))


@register("top_ports", sql=_top_sql("dport", "proto IN ('TCP', 'UDP') AND dport IS NOT NULL"))
def top_ports(spark, sf_dir):
    t = pk.top_by_count(packets(spark, sf_dir), "dport", 5)
    return t.select("dport", "n", fmt_ts("first_ts").alias("first_ts"))


@register("src_counts", sql=f"""{W}
SELECT src, count(*) AS n FROM packets WHERE proto <> 'ARP' AND src IS NOT NULL GROUP BY src""")
def src_counts(spark, sf_dir):
    return pk.key_counts(packets(spark, sf_dir), "src").select("src", "n")


@register("distinct_ports", sql=f"""{W}, {PORT_PACKETS}
SELECT src, count(DISTINCT dport) AS n_ports FROM pp GROUP BY src""")
def distinct_ports(spark, sf_dir):
    return pk.distinct_ports_per_source(packets(spark, sf_dir))


CAPTURE_ALERTS_SQL = f"""{SCAN_SQL},
unusual AS (SELECT event_id * 4 AS alert_id, 'Unusual Port' AS type, 'Medium' AS severity, src,
                   'Traffic on unusual port ' || CAST(dport AS VARCHAR) || '/' || proto AS detail, ts, event_id
            FROM pp WHERE dport IN (7, 9, 19, 21, 23, 135, 137, 139, 389, 502, 2323, 3128, 4444, 6660, 6661, 6662,
                  6663, 6664, 6665, 6666, 6667, 6668, 6669, 12345, 31337, 44444, 65535)
               OR (dport < 1024 AND dport NOT IN (22, 25, 53, 80, 110, 123, 143, 443, 445, 993, 995, 3306, 3389,
                  5432, 8080, 8443))),
arpa AS (SELECT event_id * 4 + 2 AS alert_id, 'ARP Activity' AS type, 'Info' AS severity, src,
                'ARP packet detected — possible MITM reconnaissance' AS detail, ts, event_id
         FROM packets WHERE proto = 'ARP'),
alerts AS (SELECT alert_id, type, severity, src, detail, ts, event_id FROM unusual
           UNION ALL SELECT alert_id, type, severity, src, detail, ts, event_id FROM scan
           UNION ALL SELECT alert_id, type, severity, src, detail, ts, event_id FROM arpa)"""


@register("recent_alerts", sql=f"""{CAPTURE_ALERTS_SQL}
SELECT alert_id, type, severity, src, detail FROM alerts ORDER BY ts DESC, event_id DESC, alert_id DESC LIMIT 10""")
def recent_alerts(spark, sf_dir):
    a = pk.capture_alerts(packets(spark, sf_dir))
    return pk.recent(a, 10, order=("ts", "event_id", "alert_id")).select(
        "alert_id", "type", "severity", "src", "detail")


@register("traffic_summary", sql=f"""{CAPTURE_ALERTS_SQL},
st AS (SELECT count(*) AS total, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed,
              count(*) FILTER (WHERE proto = 'TCP') AS tcp, count(*) FILTER (WHERE proto = 'UDP') AS udp,
              count(*) FILTER (WHERE proto = 'ARP') AS arp FROM packets)
SELECT total, round(elapsed, 1) AS elapsed, round(CASE WHEN elapsed > 0 THEN total / elapsed ELSE 0.0 END, 1) AS rate,
       tcp, udp, arp, (SELECT count(*) FROM alerts) AS alert_count FROM st""")
def traffic_summary(spark, sf_dir):
    p = packets(spark, sf_dir)
    return pk.traffic_summary(p, pk.capture_alerts(p))


@register("packet_rate", sql=f"""{W}
SELECT {ts("date_trunc('hour', ts)")} AS window_start, count(*) AS packets, round(count(*) / 3600.0, 6) AS rate
FROM packets GROUP BY date_trunc('hour', ts)""")
def packet_rate(spark, sf_dir):
    r = pk.packet_rate(packets(spark, sf_dir), "1 hour")
    return r.select(fmt_ts("window_start").alias("window_start"), "packets", r6("rate", "rate"))


@register("arp_alert_counter", sql=f"""{W},
a AS (SELECT event_id, ip, ts, mac, first_value(mac) OVER (PARTITION BY ip ORDER BY ts, event_id) AS first_mac
      FROM packets),
h AS (SELECT event_id, ip, count(*) OVER (PARTITION BY ip ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM a WHERE mac <> first_mac)
SELECT event_id, ip, hits FROM h WHERE hits >= 3""")
def arp_alert_counter(spark, sf_dir):
    """Per-IP running count of ARP-spoof alerts, kept from the 3rd on."""
    a = pk.arp_spoof(packets(spark, sf_dir)).filter("arp_alert").select("event_id", "ip", "ts")
    return pk.running_alert_counter(a, key="ip", threshold=3).select("event_id", "ip", "hits")


@register("packet_verdict", sql=f"""{W},
arp AS (SELECT event_id, CASE WHEN mac <> first_value(mac) OVER (PARTITION BY ip ORDER BY ts, event_id)
                              THEN 'ARP_SPOOFING' END AS t FROM packets WHERE proto = 'ARP'),
dns AS (SELECT event_id, CASE WHEN abs(ttl - baseline_ttl) > 50 OR query_id <> response_id
                              THEN 'DNS_POISONING' END AS t FROM packets WHERE proto = 'DNS'),
{HIJACK_SQL.replace(f"{W},", "", 1).replace("FROM packets)", "FROM packets WHERE proto = 'TCP')", 1)},
tcp AS (SELECT event_id, CASE WHEN alert THEN 'SESSION_HIJACKING' END AS t FROM s),
flagged AS (SELECT * FROM arp UNION ALL SELECT * FROM dns UNION ALL SELECT * FROM tcp)
SELECT p.event_id, p.src, p.proto, f.t IS NOT NULL AS mitm_alert, f.t AS mitm_type,
       ROUND(CASE WHEN f.t IS NOT NULL THEN 1 ELSE 0 END / 3.0, 6) AS mitm_score
FROM packets p LEFT JOIN flagged f USING (event_id)""".replace("WITH ", "WITH RECURSIVE ", 1))
def packet_verdict(spark, sf_dir):
    v = pk.packet_verdict(packets(spark, sf_dir))
    return v.select("event_id", "src", "proto", "mitm_alert",
                    F.array_join("mitm_type", ";").alias("mitm_type"), r6("mitm_score", "mitm_score"))


@register("port_counts", sql=f"""{W}
SELECT dport, count(*) AS n FROM packets WHERE proto IN ('TCP', 'UDP') AND dport IS NOT NULL GROUP BY dport""")
def port_counts(spark, sf_dir):
    """Packets per destination port."""
    return pk.key_counts(packets(spark, sf_dir), "dport").select("dport", "n")


@register("recent_packets", sql=f"""{W}
SELECT event_id, src, proto, dport FROM packets ORDER BY ts DESC, event_id DESC LIMIT 500""")
def recent_packets(spark, sf_dir):
    """L2: the newest 500 packets (the length of the buffer is the feature)."""
    return pk.recent(packets(spark, sf_dir), 500).select("event_id", "src", "proto", "dport")


@register("traffic_report", sql=f"""{CAPTURE_ALERTS_SQL},
st AS (SELECT count(*) AS total, count(*) FILTER (WHERE proto = 'TCP') AS tcp, count(*) FILTER (WHERE proto = 'UDP') AS udp,
              count(*) FILTER (WHERE proto = 'ARP') AS arp FROM packets),
ts5 AS (SELECT src, count(*) AS n, min(ts) AS f, arg_min(event_id, (ts, event_id)) AS fi FROM packets
        WHERE proto <> 'ARP' AND src IS NOT NULL GROUP BY src ORDER BY n DESC, f, fi LIMIT 5),
tp5 AS (SELECT dport, count(*) AS n, min(ts) AS f, arg_min(event_id, (ts, event_id)) AS fi FROM packets
        WHERE proto IN ('TCP', 'UDP') AND dport IS NOT NULL GROUP BY dport ORDER BY n DESC, f, fi LIMIT 5),
la AS (SELECT * FROM alerts ORDER BY ts DESC, event_id DESC, alert_id DESC LIMIT 10)
SELECT total, tcp, udp, arp, greatest(total - tcp - udp - arp, 0) AS other, (SELECT count(*) FROM alerts) AS alert_count,
       (SELECT string_agg(src || ':' || n, ';' ORDER BY n DESC, f, fi) FROM ts5) AS top_sources,
       (SELECT string_agg(dport || ':' || n, ';' ORDER BY n DESC, f, fi) FROM tp5) AS top_ports,
       (SELECT string_agg(CAST(alert_id AS VARCHAR), ';' ORDER BY ts DESC, event_id DESC, alert_id DESC) FROM la) AS last_alerts FROM st""")
def traffic_report(spark, sf_dir):
    """The whole summary: counts, alerts, top sources and ports, last 10
    alerts."""
    p = packets(spark, sf_dir)
    return pk.traffic_report(p, pk.capture_alerts(p))
