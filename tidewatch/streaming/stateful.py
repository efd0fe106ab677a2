"""Streaming operators with several state variables a key
(``transformWithStateInPandas``): MITM verdicts (T4), analyst feedback (T11)
and heavy hitters of traffic (T8).

State lives in Spark's RocksDB store, so a key's lists and maps are read and
written entry by entry and needn't fit a worker's memory. A key's rows of one
micro-batch are put into arrival order ``(ts, event_id)`` before they meet the
state; ``maxFilesPerTrigger`` of the source bounds them.
"""

from __future__ import annotations

import heapq
import math
import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.feedback import CONFIRMED, DISMISSED
from ..operators.packets import ORDER, arp_activity_alerts, dns_poison, unusual_port_alerts
from ..session import checkpoint_dir, scratch_path
from .detectors import port_scan_stream, run_to_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def arrived(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


def in_order(rows: Iterator[pd.DataFrame], key: str, kind: str, kinds: Sequence[str], run_rows: int) -> Iterator[tuple[int | None, int]]:
    """(``key``, number of ``kind`` in ``kinds`` or -1) of all rows in stable
    order of ``key``, nulls last. Rows are sorted in runs of about ``run_rows``
    that lie in a temporary file, 17 bytes a row, and are merged from there."""
    form = np.dtype([("null", "?"), ("key", "<i8"), ("kind", "<i8")])
    number = {k: i for i, k in enumerate(kinds)}

    def run(chunks: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(chunks)
        return x[np.lexsort((x["key"], x["null"]))]

    def entries(x: np.ndarray, step: int = 4096) -> Iterator[tuple[bool, int, int]]:
        for i in range(0, len(x), step):
            yield from x[i:i + step].tolist()

    with tempfile.TemporaryFile() as f:
        chunks, ends = [], [0]
        for pdf in rows:
            x = np.empty(len(pdf), form)
            x["null"] = pdf[key].isna()
            x["key"] = pdf[key].fillna(0).astype("int64")
            x["kind"] = pdf[kind].map(number).fillna(-1).astype("int64")
            chunks.append(x)
            if sum(map(len, chunks)) >= run_rows:
                run(chunks).tofile(f)
                ends.append(ends[-1] + sum(map(len, chunks)))
                chunks = []
        f.flush()
        runs = [np.memmap(f, form, "r", a * form.itemsize, (b - a,)) for a, b in zip(ends, ends[1:])]
        if chunks:
            runs.append(run(chunks))
        del chunks
        for null, k, code in heapq.merge(*map(entries, runs), key=lambda e: e[:2]):
            yield None if null else k, code


class _Idle(StatefulProcessor):
    """A processor whose key is forgotten ``ttl_ms`` after its latest row's
    event time (0: never): by the key's next micro-batch if that begins later,
    else by a timer when the watermark has passed. The timer only ever moves
    forward, so late rows don't shorten a key's life."""

    ttl_ms = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ms long") if self.ttl_ms else None

    def begin(self, first: pd.Timestamp) -> None:
        if self.ttl_ms and self.latest.exists():
            ends = self.latest.get()[0] + self.ttl_ms
            if first.value // 1_000_000 > ends:
                self.handle.deleteTimer(ends)
                self.forget()
                self.latest.clear()

    def touch(self, last: pd.Timestamp) -> None:
        if not self.ttl_ms:
            return
        now, before = last.value // 1_000_000, self.latest.get()[0] if self.latest.exists() else None
        if before is None or now > before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl_ms)
            self.handle.registerTimer(now + self.ttl_ms)
            self.latest.update((now,))

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


# -- T4 ---------------------------------------------------------------------
class Verdicts(_Idle):
    """First MAC of an address (T1) or RTT baseline of a source."""

    def __init__(self, rtt_std_threshold: float, min_count: int, ttl_ms: int):
        self.threshold, self.min_count, self.ttl_ms = rtt_std_threshold, min_count, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.first = handle.getValueState("first", "mac string")
        self.baseline = handle.getValueState("baseline", "mean double, std double, n long")

    def forget(self) -> None:
        self.first.clear()
        self.baseline.clear()

    def spoofed(self, macs: pd.Series) -> np.ndarray:
        if not self.first.exists():
            self.first.update((macs.iloc[0],))
        first = self.first.get()[0]
        return (macs.notna() & (first is not None) & (macs != first)).to_numpy(bool)

    def hijacked(self, rtts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rtts), bool)
        mean, std, n = self.baseline.get() if self.baseline.exists() else (0.0, 0.0, 0)
        for i in np.flatnonzero(~np.isnan(rtts)).tolist():
            rtt = float(rtts[i])
            if n > self.min_count and abs(rtt - mean) > self.threshold * max(std, 1e-6):
                out[i] = True
                continue
            if n:
                new = (mean * n + rtt) / (n + 1)
                mean, std = new, math.sqrt((std ** 2 * n + (rtt - new) ** 2) / (n + 1))
            else:
                mean = rtt
            n += 1
        if n:
            self.baseline.update((mean, std, n))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = arrived(rows, ORDER)
        self.begin(x["ts"].iloc[0])
        if x["proto"].iloc[0] == "ARP":
            kind, hit = "ARP_SPOOFING", self.spoofed(x["mac"])
        else:
            kind, hit = "SESSION_HIJACKING", self.hijacked(x["rtt"].to_numpy(float))
        self.touch(x["ts"].iloc[-1])
        yield pd.DataFrame({"event_id": x["event_id"], "ts": x["ts"], "src": x["src"], "proto": x["proto"],
                            "t": np.where(hit, kind, None)})


def verdict_stream(packets: DataFrame, rtt_std_threshold: float = 2.5, min_count: int = 10, ttl_ms: int = 0) -> DataFrame:
    """T4: a verdict for every packet, as :func:`operators.packets.packet_verdict`
    gives it: ARP by the address's first MAC, TCP by the source's RTT baseline,
    DNS by its own answer, others none. ARP packets without an address and TCP
    packets without a source raise nothing."""
    proto = F.col("proto")
    key = F.when(proto == "ARP", F.col("ip")).when(proto == "TCP", F.col("src")).cast("string")
    x = packets.withColumn("key", F.concat_ws(":", proto, key)).withColumn("keyed", F.coalesce(key.isNotNull(), F.lit(False)))
    base = ["event_id", "ts", "src", "proto"]
    kept = x.filter("keyed").select("key", *base, "mac", "rtt").groupBy("key").transformWithStateInPandas(
        Verdicts(rtt_std_threshold, min_count, ttl_ms), "event_id long, ts timestamp, src long, proto string, t string",
        "append", "EventTime" if ttl_ms else "None")
    rest = dns_poison(x.filter(~F.col("keyed"))).withColumn("t", F.when((proto == "DNS") & F.col("dns_alert"), "DNS_POISONING"))
    hit = F.col("t").isNotNull()
    return kept.unionByName(rest.select(*base, "t")).select(
        *base, hit.alias("mitm_alert"), F.when(hit, F.array("t")).alias("mitm_type"), (hit.cast("int") / 3.0).alias("mitm_score"))


# -- T11 --------------------------------------------------------------------
FEEDBACK_OUT = "site long, cycle long, row_id long, rn long, verdict string, label int"


class Feedback(_Idle):
    """Two buffers of the newest ``max_buffer`` rows and a counter of cycles.
    Buffers are looked at after every ``batch_size`` rows of the key; with
    ``interval`` rows or more in both, they are emitted and cleared, so a
    task holds the buffers, ``run_rows`` rows that are being sorted and
    ``out_rows`` results, however many rows a micro-batch brings."""

    run_rows, out_rows = 1 << 20, 10_000
    columns = ("site", "cycle", "row_id", "rn", "verdict", "label")

    def __init__(self, batch_size: int, interval: int, max_buffer: int):
        self.batch_size, self.interval, self.max_buffer = batch_size, interval, max_buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.lists = {v: handle.getListState(v, "row_id long, rn long") for v in (CONFIRMED, DISMISSED)}
        self.progress = handle.getValueState("progress", "seen long, cycle long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, cycle = self.progress.get() if self.progress.exists() else (0, 0)
        # the oldest goes when a buffer is full
        held = {v: deque(s.get() if s.exists() else (), self.max_buffer) for v, s in self.lists.items()}
        out = []
        for row_id, code in in_order(rows, "row_id", "verdict", tuple(held), self.run_rows):
            seen += 1
            if code >= 0:
                held[tuple(held)[code]].append((row_id, seen))
            if seen % self.batch_size == 0 and sum(map(len, held.values())) >= self.interval:
                for v, label in ((CONFIRMED, 1), (DISMISSED, 0)):
                    out += [(key[0], cycle, r, n, v, label) for r, n in held[v]]
                    held[v].clear()
                cycle += 1
                if len(out) >= self.out_rows:
                    yield pd.DataFrame(out, columns=self.columns)
                    out = []
        for v, s in self.lists.items():
            s.put(list(held[v])) if held[v] else s.clear()
        self.progress.update((seen, cycle))
        if out:
            yield pd.DataFrame(out, columns=self.columns)


def feedback_stream(decisions: DataFrame, batch_size: int = 50, interval: int = 100, max_buffer: int = 500) -> DataFrame:
    """The retraining rows of every cycle that closes, per ``site`` (the
    place whose analysts share buffers; sites are independent and spread).
    ``decisions`` has ``site, row_id, verdict``; a site's rows come in the
    order of ``row_id`` across micro-batches."""
    return decisions.select("site", "row_id", "verdict").groupBy("site").transformWithStateInPandas(
        Feedback(batch_size, interval, max_buffer), FEEDBACK_OUT, "append", "None")


def refit_sink(out: str, rows: DataFrame, fit: Callable[[DataFrame], object], save: Callable[[object, str], None] | None = None):
    """A ``foreachBatch`` function: every (site, cycle) that closed in a
    micro-batch is joined with its rows' features (``rows`` by ``row_id``),
    ``fit`` once, and noted as ``site, cycle, n_rows, epoch`` in a folder of
    the micro-batch, which a repeated micro-batch replaces."""
    def sink(batch: DataFrame, epoch: int) -> None:
        closed = batch.persist()
        try:
            cycles = closed.groupBy("site", "cycle").agg(F.count("*").alias("n_rows"))
            for c in cycles.orderBy("site", "cycle").toLocalIterator():
                chosen = closed.where((F.col("site") == c["site"]) & (F.col("cycle") == c["cycle"])).select("row_id", "label")
                model = fit(rows.join(chosen, "row_id"))
                if save:
                    save(model, f"{out}/models/site={c['site']}/cycle={c['cycle']}")
            cycles.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/cycles/{epoch:012d}")
        finally:
            closed.unpersist()
    return sink


# -- T8 ---------------------------------------------------------------------
class HeavyHitters(StatefulProcessor):
    """Space-saving summary of one shard of the packets: at most ``capacity``
    keys with a count and its greatest possible error. A key that isn't in a
    full summary begins at the least count in it, which is also its error.
    Counts never fall short, exceed the truth by their error at most, and no
    key outside has more packets than the least count."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "key string", "n long, error long")

    def held(self) -> dict[str, tuple[int, int]]:
        return {k[0]: (v[0], v[1]) for k, v in self.counts.iterator()}

    def least(self, held: dict[str, tuple[int, int]]) -> int:
        return min(n for n, _ in held.values()) if len(held) >= self.capacity else 0

    def merged(self, held: dict[str, tuple[int, int]], fresh: pd.Series) -> dict[str, tuple[int, int]]:
        least = self.least(held)
        for k, n in fresh.items():
            n0, e0 = held.get(k, (least, least))
            held[k] = (n0 + int(n), e0)
        return dict(sorted(held.items(), key=lambda x: (-x[1][0], x[0]))[:self.capacity])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.held()
        held = dict(before)
        for pdf in rows:   # counted chunk by chunk: repeats of a hot key never pile up
            held = self.merged(held, pdf["key"].value_counts())
        for k in before.keys() - held.keys():
            self.counts.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.counts.updateValue((k,), v)
        least = self.least(held)
        yield pd.DataFrame([(key[0], k, n, e, least) for k, (n, e) in held.items()], columns=["shard", "key", "n", "error", "least"])

    def close(self) -> None:
        pass


def heavy_hitters_stream(packets: DataFrame, key: str, capacity: int = 1024, shards: int = 32) -> DataFrame:
    """Every shard's summary after each micro-batch: ``shard, key, n, error,
    least`` (what a key outside the summary may have at most). Packets are
    dealt to shards by ``event_id``, so a hot key is counted in all of them."""
    x = packets.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"),
                                                      F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int").alias("shard"))
    return x.groupBy("shard").transformWithStateInPandas(
        HeavyHitters(capacity), "shard int, key string, n long, error long, least long", "update", "None")


def merged_summary(summaries: DataFrame) -> DataFrame:
    """``key, n, most`` over all shards' last summaries (rows of
    :func:`heavy_hitters_stream` with ``epoch``), ``most`` being the most
    packets that the key may have; the key NULL stands for all keys that are
    in no summary."""
    last = summaries.groupBy(F.col("shard").alias("_shard")).agg(F.max("epoch").alias("_epoch"))
    x = summaries.join(last, (F.col("shard") == F.col("_shard")) & (F.col("epoch") == F.col("_epoch")))
    slack = x.groupBy("shard").agg(F.max("least").alias("least")).agg(F.coalesce(F.sum("least"), F.lit(0)).alias("slack"))
    keys = x.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.col("least")).alias("own"))
    return keys.crossJoin(F.broadcast(slack)).select("key", "n", (F.col("own") + F.col("slack")).alias("most")).unionAll(
        slack.select(F.lit(None).cast("string"), F.lit(0).cast("bigint"), "slack"))


def top_keys(summaries: DataFrame, packets: DataFrame, key: str, k: int, order: Sequence[str] = tuple(ORDER)) -> DataFrame:
    """``key, n, first_seen`` of the ``k`` commonest keys of ``packets`` (the
    same that the summaries have seen), exact: the likeliest ``4 * k`` are
    counted in a second pass; if the k-th of them isn't above all that any
    other may have, all keys are counted."""
    count = lambda df: df.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first_seen"))
    first = lambda df: df.orderBy(F.desc("n"), "first_seen").limit(k)
    ranked = merged_summary(summaries).orderBy(F.desc(F.col("key").isNotNull()), F.desc("most"), "key").limit(4 * k + 1).collect()
    likely, others = [r["key"] for r in ranked if r["key"] is not None][:4 * k], [r["most"] for r in ranked]
    beyond = max([others[-1] if len(others) > len(likely) else 0, merged_summary(summaries).where("key is null").first()["most"]])
    x = packets.filter(F.col(key).isNotNull())
    got = first(count(x.filter(F.col(key).cast("string").isin(likely))))
    sure = got.agg(F.min("n").alias("n"), F.count("*").alias("k")).first()
    if beyond == 0 or (sure["k"] == k and sure["n"] > beyond):
        return got
    return first(count(x))


def traffic_report(stream: DataFrame, packets: DataFrame, k: int = 5, last: int = 10, capacity: int = 1024) -> DataFrame:
    """T8 from a stream, the row of :func:`operators.packets.traffic_report`:
    protocol counts and alerts are streaming results, the top lists come of
    heavy-hitter summaries and a second pass over ``packets`` (the stream's
    packets at rest: ``ts, event_id, src, dport, proto``)."""
    protos = run_to_table(stream.groupBy("proto").agg(F.count("*").alias("n")), "protocols", output_mode="update", keys=("proto",))
    shared = ["alert_id", "ts", "event_id"]
    plain = stream.withColumn("dst", F.lit(None).cast("bigint"))
    alerts = run_to_table(unusual_port_alerts(plain).unionByName(arp_activity_alerts(plain)).select(*shared), "plain-alerts") \
        .unionByName(run_to_table(port_scan_stream(stream).select(*shared), "scan-alerts"))
    alerts = alerts.checkpoint()
    count = lambda *p: F.coalesce(F.sum(F.when(F.col("proto").isin(*p), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    counts = protos.agg(total.alias("total"), count("TCP").alias("tcp"), count("UDP").alias("udp"), count("ARP").alias("arp")) \
        .withColumn("other", F.greatest(F.col("total") - F.col("tcp") - F.col("udp") - F.col("arp"), F.lit(0)))

    def top(key: str, name: str) -> DataFrame:
        seen = (lambda df: df.filter(F.col("proto") != "ARP")) if key == "src" else (lambda df: df.filter(F.col("proto").isin("TCP", "UDP")))
        summaries = run_stateful(heavy_hitters_stream(seen(stream), key, capacity), f"top-{key}", "update")
        best = top_keys(summaries, seen(packets), key, k)
        order = F.struct((-F.col("n")).alias("a"), F.col("first_seen").alias("b"), F.concat_ws(":", F.col(key), F.col("n")).alias("t"))
        return best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["t"]), ";").alias(name))

    newest = F.struct((-F.unix_micros("ts")).alias("a"), (-F.col("event_id")).alias("b"), (-F.col("alert_id")).alias("c"))
    tail = alerts.orderBy(F.desc("ts"), F.desc("event_id"), F.desc("alert_id")).limit(last).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(newest)), lambda s: (-s["c"]).cast("string")), ";").alias("last_alerts"))
    n = alerts.agg(F.count("*").alias("alert_count"))
    return counts.crossJoin(n).crossJoin(top("src", "top_sources")).crossJoin(top("dport", "top_ports")).crossJoin(tail)


# -- running ----------------------------------------------------------------
def run_stateful(df: DataFrame, name: str, output_mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs a stream of this module to completion (``availableNow``) and
    returns its rows; in ``update`` mode those of each micro-batch, with
    ``epoch``. A repeated micro-batch replaces its own folder. The store
    provider is set for the start of this query only."""
    spark: SparkSession = df.sparkSession
    checkpoint_dir(spark)
    run = f"stream-{name}-{uuid.uuid4().hex[:8]}"
    out = scratch_path(spark, run + "/out")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = df.writeStream.option("checkpointLocation", scratch_path(spark, run + "/state")).trigger(availableNow=True) \
              .outputMode(output_mode).foreachBatch(sink or write).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    if q.exception():
        raise q.exception()
    if sink:
        return None
    rows = spark.createDataFrame([], df.schema).withColumn("epoch", F.lit(0))
    if any(p.numInputRows for p in q.recentProgress):
        rows = spark.read.schema(rows.schema).option("basePath", out).parquet(f"{out}/batch=*").select(*rows.columns)
    return rows
