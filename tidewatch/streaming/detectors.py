"""Streaming detectors.

Sources are ``readStream`` over parquet/JSON packet files (or Kafka in a
deployment); every detector is keyed state via ``applyInPandasWithState``
(per key: sort the micro-batch rows by ``(ts, event_id)``, fold them into the
state, emit rows). Event time is ``ts`` with a watermark so state stores and
window aggregates stay bounded; ``state_ttl`` drops idle keys' state after
the watermark passes their last packet by that much (the reference never
expires state).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import DETAIL_SCAN
from ..session import checkpoint_dir, scratch_path
from ..sources.views import PROTO_OF_EVENT, DNS_BASELINE_TTL

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def packet_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = 64,
                  watermark: str = "1 hour", file_glob: str | None = None) -> DataFrame:
    """Packets from a directory of event files (new files are new data), same
    projection as the batch view; ``ts`` is cast to TIMESTAMP (watermarks
    reject TIMESTAMP_NTZ). ``file_glob`` picks files inside the directory."""
    r = spark.readStream.format("parquet").schema(EVENTS_SCHEMA)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    e = r.load(path)
    k = F.get_json_object("props", "$.k").cast("int")
    proto = F.lit("OTHER")
    for ev, p in reversed(list(PROTO_OF_EVENT.items())):
        proto = F.when(F.col("event_type") == ev, F.lit(p)).otherwise(proto)
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("src"), proto.alias("proto"),
        (k * k).alias("dport"), F.col("user_id").alias("ip"), F.when(k < 10, "m2").otherwise("m1").alias("mac"),
        F.col("user_id").alias("query_id"),
        F.when(k == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("response_id"),
        F.col("value").alias("ttl"), F.lit(DNS_BASELINE_TTL).alias("baseline_ttl"), F.col("value").alias("rtt"),
    ).withWatermark("ts", watermark)


def _timeout(state_ttl: str | None):
    return GroupStateTimeout.EventTimeTimeout if state_ttl else GroupStateTimeout.NoTimeout


def _ttl_ms(state_ttl: str | None) -> int:
    if not state_ttl:
        return 0
    n, unit = state_ttl.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def _expire(state: GroupState, ttl_ms: int, last_ts: pd.Timestamp) -> bool:
    if state.hasTimedOut:
        state.remove()
        return True
    if ttl_ms:
        state.setTimeoutTimestamp(int(last_ts.value // 1_000_000) + ttl_ms)
    return False


def arp_spoof_stream(packets: DataFrame, state_ttl: str | None = None) -> DataFrame:
    """First MAC per IP kept in state; later packets with another MAC alert."""
    ttl = _ttl_ms(state_ttl)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        first = state.get[0] if state.exists else None
        out = []
        for row in pdf.itertuples(index=False):
            if first is None:
                first = row.mac
            elif row.mac != first:
                out.append((row.event_id, row.ip, row.mac, first))
        state.update((first,))
        _expire(state, ttl, pdf["ts"].iloc[-1])
        if out:
            yield pd.DataFrame(out, columns=["event_id", "ip", "mac", "first_mac"])

    return packets.select("event_id", "ts", "ip", "mac").groupBy("ip").applyInPandasWithState(
        fn, "event_id long, ip long, mac string, first_mac string", "first_mac string", "append", _timeout(state_ttl))


def session_hijack_stream(packets: DataFrame, rtt_std_threshold: float = 2.5, min_count: int = 10,
                          state_ttl: str | None = None) -> DataFrame:
    """RTT baseline (mean, std, n) per source in state; outliers alert and
    leave the baseline unchanged."""
    ttl = _ttl_ms(state_ttl)

    def fn(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        st = state.get if state.exists else None
        out = []
        for row in pdf.itertuples(index=False):
            rtt = row.rtt
            if st is None:
                st = (rtt, 0.0, 1)
                out.append((row.event_id, row.src, False) + st)
                continue
            mean, std, n = st
            if n > min_count and abs(rtt - mean) > rtt_std_threshold * max(std, 1e-6):
                out.append((row.event_id, row.src, True) + st)
                continue
            m2 = (mean * n + rtt) / (n + 1)
            st = (m2, math.sqrt((std ** 2 * n + (rtt - m2) ** 2) / (n + 1)), n + 1)
            out.append((row.event_id, row.src, False) + st)
        state.update(st)
        _expire(state, ttl, pdf["ts"].iloc[-1])
        yield pd.DataFrame(out, columns=["event_id", "src", "hijack_alert", "rtt_mean", "rtt_std", "n_baseline"])

    return packets.select("event_id", "ts", "src", "rtt").groupBy("src").applyInPandasWithState(
        fn, "event_id long, src long, hijack_alert boolean, rtt_mean double, rtt_std double, n_baseline long",
        "mean double, std double, n long", "append", _timeout(state_ttl))


def port_scan_stream(packets: DataFrame, state_ttl: str | None = None) -> DataFrame:
    """Distinct ports per source in state (an array); every packet alerts
    while the count is >= 10 and a multiple of 5."""
    ttl = _ttl_ms(state_ttl)

    def fn(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        ports = set(state.get[0]) if state.exists else set()
        out = []
        for row in pdf.itertuples(index=False):
            ports.add(int(row.dport))
            n = len(ports)
            if n >= 10 and n % 5 == 0:
                out.append((row.event_id * 4 + 1, "Port Scan", "High", row.src, DETAIL_SCAN % (str(row.src), n),
                            row.ts, row.event_id, n))
        state.update((sorted(ports),))
        _expire(state, ttl, pdf["ts"].iloc[-1])
        if out:
            yield pd.DataFrame(out, columns=["alert_id", "type", "severity", "src", "detail", "ts", "event_id",
                                             "n_ports"])

    p = packets.filter(F.col("src").isNotNull() & F.col("dport").isNotNull() & (F.col("dport") != 0))
    return p.select("event_id", "ts", "src", "dport").groupBy("src").applyInPandasWithState(
        fn, "alert_id long, type string, severity string, src long, detail string, ts timestamp, event_id long, "
            "n_ports long", "ports array<int>", "append", _timeout(state_ttl))


def dns_block_stream(packets: DataFrame, duration_s: int = 1800, max_deviation: float = 50.0) -> DataFrame:
    """T2 -> R1/R3: DNS poisoning verdicts (critical) open a block on the
    source unless one is in force; the block's expiry is the keyed state, and
    the state goes when the watermark has passed it (a later verdict opens a
    block with or without it)."""
    dur = duration_s * 1_000_000
    dev = F.abs(F.col("ttl") - F.col("baseline_ttl"))
    alerts = packets.filter(F.col("proto") == "DNS").filter(
        F.coalesce(dev > max_deviation, F.lit(False)) | ~F.col("query_id").eqNullSafe(F.col("response_id")))

    def fn(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        expires = state.get[0] if state.exists else None
        out = []
        for row in pdf.itertuples(index=False):
            t = int(row.ts.value // 1000)
            if expires is None or t > expires:
                expires = t + dur
                out.append((row.src, row.ts, pd.Timestamp(expires * 1000, tz="UTC"), duration_s))
        state.update((expires,))
        state.setTimeoutTimestamp(max(expires // 1000, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=["ip", "blocked_at", "expires_at", "duration"])

    return alerts.select("event_id", "ts", "src").groupBy("src").applyInPandasWithState(
        fn, "ip long, blocked_at timestamp, expires_at timestamp, duration int", "expires long", "append",
        GroupStateTimeout.EventTimeTimeout)


def rate_stream(packets: DataFrame, window: str = "1 hour") -> DataFrame:
    """Packets per event-time window (watermarked aggregate)."""
    return packets.groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("packets"))


def run_to_table(df: DataFrame, name: str, output_mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a streaming DataFrame to completion (``availableNow``) into parquet
    under the checkpoint folder (state and offsets checkpointed beside it) and
    return the result as a batch DataFrame. ``update`` writes what each
    micro-batch changed to a folder of its own (a batch that runs again
    replaces its folder) and returns the last row of each of ``keys``."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    run = f"stream-{name}-{uuid.uuid4().hex[:8]}"
    out = scratch_path(spark, run + "/out")
    ckpt = scratch_path(spark, run + "/state")
    w = df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True).outputMode(output_mode)
    if output_mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        def sink(batch: DataFrame, epoch: int):
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        q = w.foreachBatch(sink).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if output_mode == "append":
        return spark.read.schema(df.schema).parquet(out)
    rows = spark.read.parquet(out)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "epoch")]), "epoch").alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")
