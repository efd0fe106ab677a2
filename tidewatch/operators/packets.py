"""Packet-stream detectors and traffic statistics, batch form.

Input: a packets DataFrame with at least ``event_id, ts, src, dst, proto,
dport`` (see :func:`tidewatch.sources.views.packets`); detectors that need
more (``mac``, ``ttl``, ``rtt`` ...) say so. Arrival order is the total order
``(ts, event_id)``.

Alert rows share one schema (ALERT_COLUMNS). ``alert_id`` is
``event_id * 4 + kind`` instead of a global counter: unique, ordered like
arrival, and computed without a single-partition sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (DETAIL_ARP, DETAIL_SCAN, DETAIL_UNUSUAL, is_unusual_port)
from .scan import SEGMENT_ROWS, halo_segments, running_sum, time_bucket
from .sequential import fold_by_key

ALERT_COLUMNS = ["alert_id", "type", "severity", "src", "dst", "detail", "ts", "event_id"]
KIND = {"Unusual Port": 0, "Port Scan": 1, "ARP Activity": 2}
ORDER = ["ts", "event_id"]


def _alerts(df: DataFrame, kind: str, severity: str, detail) -> DataFrame:
    return df.select(
        (F.col("event_id") * 4 + KIND[kind]).alias("alert_id"),
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
        "src", "dst", detail.alias("detail"), "ts", "event_id")


def port_packets(packets: DataFrame) -> DataFrame:
    """Packets the capture detector looks at: a source and a non-zero port."""
    return packets.filter(F.col("src").isNotNull() & F.col("dport").isNotNull() & (F.col("dport") != 0))


# -- T5 ---------------------------------------------------------------------
def unusual_port_alerts(packets: DataFrame) -> DataFrame:
    p = port_packets(packets).filter(is_unusual_port("dport"))
    return _alerts(p, "Unusual Port", "Medium", F.format_string(DETAIL_UNUSUAL, F.col("dport"), F.col("proto")))


# -- T6 / W3 ----------------------------------------------------------------
def distinct_port_counts(packets: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Adds ``is_new`` (first time this source used this port) and ``n_ports``
    (distinct ports of the source so far, this packet included).

    ``count(distinct) over`` is not allowed in Spark and ``collect_set`` over a
    running frame is quadratic. Instead: first occurrence per (src, dport) is a
    partial aggregate; the running count is a segmented running sum of the
    first-occurrence flags, so a hot source is spread over its time buckets.
    """
    p = port_packets(packets)
    firsts = p.groupBy("src", "dport").agg(F.min(F.struct(*ORDER)).alias("_first"))
    flagged = (p.join(firsts, ["src", "dport"])
               .withColumn("is_new", (F.struct(*ORDER) == F.col("_first")).cast("int"))
               .drop("_first"))
    return running_sum(flagged, ["src"], ORDER, "is_new", time_bucket("ts", bucket_seconds), "n_ports")


def port_scan_alerts(packets: DataFrame, once_per_level: bool = False, bucket_seconds: int = 3600) -> DataFrame:
    """An alert on every packet while the running distinct-port count is >= 10
    and a multiple of 5 (``once_per_level``: only when the level is reached).
    Alert columns plus ``n_ports``."""
    c = distinct_port_counts(packets, bucket_seconds)
    cond = (F.col("n_ports") >= 10) & (F.col("n_ports") % 5 == 0)
    if once_per_level:
        cond = cond & (F.col("is_new") == 1)
    hits = c.filter(cond)
    return hits.select(
        (F.col("event_id") * 4 + KIND["Port Scan"]).alias("alert_id"), F.lit("Port Scan").alias("type"),
        F.lit("High").alias("severity"), "src", "dst",
        F.format_string(DETAIL_SCAN, F.col("src").cast("string"), F.col("n_ports")).alias("detail"),
        "ts", "event_id", "n_ports")


# -- T7 ---------------------------------------------------------------------
def arp_activity_alerts(packets: DataFrame) -> DataFrame:
    return _alerts(packets.filter(F.col("proto") == "ARP"), "ARP Activity", "Info", F.lit(DETAIL_ARP))


def capture_alerts(packets: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """All capture alerts (T5 + T6 + T7)."""
    return (unusual_port_alerts(packets)
            .unionByName(port_scan_alerts(packets, bucket_seconds=bucket_seconds).drop("n_ports"))
            .unionByName(arp_activity_alerts(packets)))


# -- T1 / W2 ----------------------------------------------------------------
def arp_spoof(packets: DataFrame) -> DataFrame:
    """First MAC seen for an IP is kept forever; a packet whose MAC differs
    raises ``arp_alert``. First MAC per IP is an aggregate (map-side combined,
    one row per IP) joined back; AQE broadcasts it when the measured size is
    under the broadcast threshold and splits hot IPs otherwise. A packet
    without an IP is kept and raises nothing."""
    firsts = packets.groupBy("ip").agg(F.min_by("mac", F.struct(*ORDER)).alias("first_mac"))
    return (packets.join(firsts, "ip", "left")
            .withColumn("arp_alert", F.coalesce(F.col("mac") != F.col("first_mac"), F.lit(False))))


# -- T2 ---------------------------------------------------------------------
def dns_poison(packets: DataFrame, max_deviation: float = 50.0) -> DataFrame:
    """The TTL is far from the baseline, or the response's id isn't the
    query's (an unanswered query counts as such). A missing TTL is no
    deviation."""
    dev = F.abs(F.col("ttl") - F.coalesce(F.col("baseline_ttl"), F.lit(300.0)))
    return packets.withColumn("dns_alert", F.coalesce(dev > max_deviation, F.lit(False))
                              | ~F.col("query_id").eqNullSafe(F.col("response_id")))


# -- T3 ---------------------------------------------------------------------
def _hijack_step(rtt_std_threshold: float, min_count: int):
    def step(state, row):
        rtt = row.rtt
        if rtt is None or math.isnan(rtt):   # nothing measured: no alert, baseline as it was
            return state, (False, *(state or (None, None, 0)))
        if state is None:
            return (rtt, 0.0, 1), (False, rtt, 0.0, 1)
        mean, std, n = state
        if n > min_count and abs(rtt - mean) > rtt_std_threshold * max(std, 1e-6):
            return state, (True, mean, std, n)
        new_mean = (mean * n + rtt) / (n + 1)
        new_std = math.sqrt((std ** 2 * n + (rtt - new_mean) ** 2) / (n + 1))
        new = (new_mean, new_std, n + 1)
        return new, (False,) + new
    return step


def session_hijack(packets: DataFrame, rtt_std_threshold: float = 2.5, min_count: int = 10,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Per source RTT baseline (mean, std, n). An outlier once n > min_count
    raises ``hijack_alert`` and leaves the baseline unchanged; otherwise the
    baseline absorbs the row. The recurrence is sequential per key, so it is
    a sorted streaming fold (bounded memory, parallel across keys). A packet
    without an RTT changes nothing. ``keep`` names further columns to return."""
    return fold_by_key(
        packets.select("src", "ts", "event_id", "rtt", *keep),
        key="src", order=ORDER, step=_hijack_step(rtt_std_threshold, min_count),
        out_schema="hijack_alert boolean, rtt_mean double, rtt_std double, n_baseline bigint")


# -- T4 ---------------------------------------------------------------------
def packet_verdict(packets: DataFrame) -> DataFrame:
    """Dispatch on packet type: ARP -> T1 over ARP packets, DNS -> T2,
    TCP -> T3 over TCP packets; any other type -> no alert. The four parts are
    disjoint by protocol and carry the packet's columns, so they are united and
    not joined back."""
    base = ["event_id", "ts", "src", "dst", "proto"]
    proto = F.col("proto")
    arp = arp_spoof(packets.filter(proto == "ARP")).select(*base, F.when(F.col("arp_alert"), "ARP_SPOOFING").alias("t"))
    dns = dns_poison(packets.filter(proto == "DNS")).select(*base, F.when(F.col("dns_alert"), "DNS_POISONING").alias("t"))
    tcp = session_hijack(packets.filter(proto == "TCP"), keep=["dst", "proto"]).select(
        *base, F.when(F.col("hijack_alert"), "SESSION_HIJACKING").alias("t"))
    rest = packets.filter(~F.coalesce(proto.isin("ARP", "DNS", "TCP"), F.lit(False))).select(
        *base, F.lit(None).cast("string").alias("t"))
    out = arp.unionByName(dns).unionByName(tcp).unionByName(rest)
    types = F.when(F.col("t").isNotNull(), F.array(F.col("t")))
    return out.select(
        "event_id", "ts", "src", "dst", "proto",
        F.col("t").isNotNull().alias("mitm_alert"),
        types.alias("mitm_type"),
        (F.when(F.col("t").isNotNull(), 1).otherwise(0) / 3.0).alias("mitm_score"))


# -- A7 / A8 / A9 / L1 / L2 / T8 / T9 ---------------------------------------
def proto_counts(packets: DataFrame) -> DataFrame:
    """total, tcp, udp, arp, dns (never counted, as in the reference: DNS
    traffic is counted as its transport), other = total - (tcp+udp+arp)."""
    p = F.col("proto")
    agg = packets.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(p == "TCP", 1)).alias("tcp"),
        F.count(F.when(p == "UDP", 1)).alias("udp"),
        F.count(F.when(p == "ARP", 1)).alias("arp"))
    return agg.select("total", "tcp", "udp", "arp", F.lit(0).cast("bigint").alias("dns"),
                      F.greatest(F.col("total") - F.col("tcp") - F.col("udp") - F.col("arp"),
                                 F.lit(0)).alias("other"))


def key_counts(packets: DataFrame, key: str) -> DataFrame:
    """Packet count and first-seen position per key (src, dst or dport).
    Ports are counted for TCP/UDP packets only; addresses for IP packets."""
    if key == "dport":
        p = packets.filter(F.col("proto").isin("TCP", "UDP") & F.col("dport").isNotNull())
    else:
        p = packets.filter((F.col("proto") != "ARP") & F.col(key).isNotNull())
    return p.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER)).alias("first_seen"))


def top_by_count(packets: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Top-k keys by count; ties in first-seen order. orderBy+limit plans as
    TakeOrderedAndProject: per-partition top-k, then a k-row merge."""
    c = key_counts(packets, key)
    return (c.orderBy(F.desc("n"), F.asc("first_seen")).limit(k)
            .select(key, "n", F.col("first_seen.ts").alias("first_ts")))


def distinct_ports_per_source(packets: DataFrame, approx: bool = False) -> DataFrame:
    p = port_packets(packets)
    agg = (F.approx_count_distinct("dport") if approx else F.count_distinct("dport")).alias("n_ports")
    return p.groupBy("src").agg(agg)


def recent(df: DataFrame, n: int, order=("ts", "event_id")) -> DataFrame:
    """Last-n ring buffer as a query: newest first, total order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def traffic_summary(packets: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: total, elapsed seconds, rate, tcp, udp, arp, alert_count."""
    p = F.col("proto")
    stats = packets.agg(
        F.count(F.lit(1)).alias("total"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("elapsed"),
        F.count(F.when(p == "TCP", 1)).alias("tcp"),
        F.count(F.when(p == "UDP", 1)).alias("udp"),
        F.count(F.when(p == "ARP", 1)).alias("arp"))
    n_alerts = alerts.agg(F.count(F.lit(1)).alias("alert_count"))
    return stats.crossJoin(n_alerts).select(
        "total", F.round("elapsed", 1).alias("elapsed"),
        F.round(F.when(F.col("elapsed") > 0, F.col("total") / F.col("elapsed")).otherwise(0.0), 1).alias("rate"),
        "tcp", "udp", "arp", "alert_count")


def traffic_report(packets: DataFrame, alerts: DataFrame, k: int = 5, last: int = 10) -> DataFrame:
    """T8 whole: one row of counts, ``top_sources`` and ``top_ports`` as
    ``key:count`` and ``last_alerts`` as ids, newest first. Each list is cut to
    its length by top-k before it is gathered."""
    def listed(df: DataFrame, order: Sequence, text, name: str) -> DataFrame:
        return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))),
                                               lambda s: s["t"]), ";").alias(name))

    def top(key: str, name: str) -> DataFrame:
        c = key_counts(packets, key).orderBy(F.desc("n"), F.asc("first_seen")).limit(k)
        return listed(c, [(-F.col("n")).alias("a"), F.col("first_seen").alias("b")], F.concat_ws(":", F.col(key), F.col("n")), name)

    newest = recent(alerts, last, order=("ts", "event_id", "alert_id"))
    tail = listed(newest, [(-F.unix_micros("ts")).alias("a"), (-F.col("event_id")).alias("b"), (-F.col("alert_id")).alias("c")],
                  F.col("alert_id").cast("string"), "last_alerts")
    counts = proto_counts(packets).drop("dns")
    n = alerts.agg(F.count(F.lit(1)).alias("alert_count"))
    return counts.crossJoin(n).crossJoin(top("src", "top_sources")).crossJoin(top("dport", "top_ports")).crossJoin(tail)


def packet_rate(packets: DataFrame, window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Packets per second in tumbling (or sliding) event-time windows."""
    secs = _seconds(window)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (packets.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("packets"))
            .select(F.col("w.start").alias("window_start"), "packets",
                    (F.col("packets") / float(secs)).alias("rate")))


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    mult = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(n) * mult


def running_alert_counter(alerts: DataFrame, key: str = "src", threshold: int = 3,
                          bucket_seconds: int = 3600) -> DataFrame:
    """Per-key running count of alerts; keep every alert once the count
    reaches ``threshold``. Segmented running sum, so hot keys stay balanced."""
    x = alerts.withColumn("_one", F.lit(1))
    c = running_sum(x, [key], ORDER, "_one", time_bucket("ts", bucket_seconds), "hits").drop("_one")
    return c.filter(F.col("hits") >= threshold)


def consecutive_gaps(df: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Gap in microseconds between each row and the previous one in
    global ``(ts, event_id)`` order. A global ``lag`` would sort everything in
    one task; instead the order is cut into segments of equal size, each with
    a copy of the row before it."""
    x = halo_segments(df.select("ts", "event_id"), ORDER, 1, segment_rows)
    prev = F.lag("ts").over(Window.partitionBy("_seg").orderBy("_pos"))
    return (x.withColumn("_prev", prev).filter(~F.col("_halo") & F.col("_prev").isNotNull())
            .select((F.unix_micros("ts") - F.unix_micros("_prev")).alias("gap_us")))


def latency_stats(df: DataFrame, bucket_seconds: int | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``bucket_seconds`` is accepted from callers of the time-bucket form and
    has no effect: segments hold equally many rows."""
    g = consecutive_gaps(df, segment_rows)
    return g.agg((F.avg("gap_us") / 1000.0).alias("mean_latency_ms"),
                 (F.max("gap_us") / 1000.0).alias("max_latency_ms"),
                 (F.min("gap_us") / 1000.0).alias("min_latency_ms"))
