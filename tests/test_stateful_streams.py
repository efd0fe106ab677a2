"""Streams with several state variables over five files in five micro-batches
against their batch forms."""

import os
import random
import shutil
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import feedback as fb
from tidewatch.operators import packets as pk
from tidewatch.operators import response as rs
from tidewatch.sources import sinks
from tidewatch.sources.views import packets
from tidewatch.streaming import detectors as sd
from tidewatch.streaming import stateful as st


def five_files(df, folder, order):
    """``df`` in five files whose times of change follow ``order``."""
    pdf = df.orderBy(order).toPandas()
    os.makedirs(folder)
    for i in range(5):
        part = pdf.iloc[len(pdf) * i // 5:len(pdf) * (i + 1) // 5]
        path = os.path.join(folder, f"{i}.parquet")
        part.to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


@pytest.fixture(scope="module")
def events(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events") / "files"
    five_files(spark.read.parquet(f"{sf}/events.parquet"), folder, "event_id")
    shutil.copyfile(f"{sf}/events.parquet", folder.parent / "events.parquet")
    return str(folder), str(folder.parent)


def stream(spark, events):
    return sd.packet_stream(spark, events[0], max_files_per_trigger=1)


def test_verdicts(spark, events):
    got = st.run_stateful(st.verdict_stream(stream(spark, events)), "verdicts")
    assert got.select("epoch").distinct().count() == 5
    cols = ["event_id", "ts", "src", "proto", "mitm_alert", "mitm_type", "mitm_score"]
    want = pk.packet_verdict(packets(spark, events[1])).select(cols)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.collect()))


def test_idle_keys_are_forgotten(spark, tmp_path):
    """Beyond the time to live an address may come back with another MAC."""
    t0 = pd.Timestamp("2024-01-01")
    rows = [(i, t0 + pd.Timedelta(hours=h), "error", k) for i, (h, k) in enumerate([(0, 50), (1, 5), (2, 50), (30, 50), (60, 5), (61, 50)])]
    df = spark.createDataFrame([(i, t.to_pydatetime(), 7, e, 1.0, '{"k": %d}' % k) for i, t, e, k in rows], sd.EVENTS_SCHEMA)
    folder = tmp_path / "f"
    pdf = df.toPandas()
    os.makedirs(folder)
    for i in range(len(pdf)):
        p = folder / f"{i}.parquet"
        pdf.iloc[i:i + 1].to_parquet(p, coerce_timestamps="us")
        os.utime(p, (1_700_000_000 + i,) * 2)

    def alerts(ttl):
        s = st.verdict_stream(sd.packet_stream(spark, str(folder), max_files_per_trigger=1), ttl_ms=ttl)
        return {r.event_id for r in st.run_stateful(s, "idle").where("mitm_alert").collect()}
    assert alerts(0) == {1, 4}
    # the state of hour 30 is gone at hour 60, so its MAC is the first again
    assert alerts(10 * 3_600_000) == {1, 5}


def decisions(n=3000):
    rng = random.Random(4)
    return [(rng.choice([1, 1, 1, 2, 3]), i, rng.choice([fb.CONFIRMED, fb.DISMISSED, "none"])) for i in range(n)]


def plain_cycles(rows, batch, interval, most):
    out, state = [], {}
    for site, row_id, verdict in rows:
        seen, cycle, held = state.get(site, (0, 0, {fb.CONFIRMED: [], fb.DISMISSED: []}))
        seen += 1
        if verdict in held:
            held[verdict] = (held[verdict] + [(row_id, seen)])[-most:]
        if seen % batch == 0 and sum(map(len, held.values())) >= interval:
            out += [(site, cycle, r, n, v, int(v == fb.CONFIRMED)) for v, x in held.items() for r, n in x]
            cycle, held = cycle + 1, {fb.CONFIRMED: [], fb.DISMISSED: []}
        state[site] = (seen, cycle, held)
    return sorted(out)


@pytest.mark.parametrize("batch, interval, most", [(50, 100, 500), (10, 100, 40)])
def test_feedback(spark, tmp_path, batch, interval, most):
    rows = decisions()
    folder = five_files(spark.createDataFrame(rows, "site long, row_id long, verdict string"), tmp_path / "d", "row_id")
    s = spark.readStream.schema("site long, row_id long, verdict string").option("maxFilesPerTrigger", 1).parquet(folder)
    got = st.run_stateful(st.feedback_stream(s, batch, interval, most), "feedback")
    assert sorted(tuple(r)[:6] for r in got.collect()) == plain_cycles(rows, batch, interval, most)


@pytest.mark.parametrize("run_rows", [1, 700, 100_000])
def test_rows_in_order_hold_one_run(run_rows):
    rng = random.Random(5)
    rows = [(rng.randrange(2000), rng.choice([fb.CONFIRMED, fb.DISMISSED, "none", None])) for _ in range(5000)]
    parts = [pd.DataFrame(rows[i:i + 250], columns=["row_id", "verdict"]) for i in range(0, len(rows), 250)]
    code = {fb.CONFIRMED: 0, fb.DISMISSED: 1}
    got = list(st.in_order(iter(parts), "row_id", "verdict", tuple(code), run_rows))
    assert got == sorted(((r, code.get(v, -1)) for r, v in rows), key=lambda r: r[0])
    assert list(st.in_order(iter([pd.DataFrame({"row_id": [None, 2], "verdict": ["none", fb.DISMISSED]})]), "row_id", "verdict", tuple(code), run_rows)) \
        == [(2, 1), (None, -1)]


def test_feedback_of_one_large_batch_is_bounded():
    """A site's million rows in one micro-batch: no list of all of them."""
    n, step = 1_000_000, 10_000
    ids = np.random.default_rng(2).permutation(n)
    verdicts = np.array([fb.CONFIRMED, fb.DISMISSED, "none"], object)

    class State:
        value = None
        def exists(self): return self.value is not None
        def get(self): return self.value
        def put(self, v): self.value = v
        def update(self, v): self.value = v
        def clear(self): self.value = None

    p = st.Feedback(50, 100, 500)
    p.run_rows, p.lists, p.progress = 1 << 16, {fb.CONFIRMED: State(), fb.DISMISSED: State()}, State()
    parts = (pd.DataFrame({"row_id": ids[i:i + step], "verdict": verdicts[ids[i:i + step] % 3]}) for i in range(0, n, step))
    tracemalloc.start()
    try:
        rows = sum(len(x) for x in p.handleInputRows((1,), parts, None))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 0.6 * n and p.progress.get()[0] == n and peak < 30 << 20


def test_each_closed_cycle_is_fitted_once(spark, tmp_path):
    rows = decisions(1500)
    folder = five_files(spark.createDataFrame(rows, "site long, row_id long, verdict string"), tmp_path / "d", "row_id")
    s = spark.readStream.schema("site long, row_id long, verdict string").option("maxFilesPerTrigger", 1).parquet(folder)
    features = spark.range(1500).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("x"))
    fitted, saved = [], []
    sink = st.refit_sink(str(tmp_path / "out"), features, lambda df: fitted.append(df.agg(F.count("*"), F.sum("label")).first()) or "m",
                         lambda m, path: saved.append(path))
    st.run_stateful(st.feedback_stream(s, 50, 100), "refit", sink=sink)
    want = Counter((s, c) for s, c, *_ in plain_cycles(rows, 50, 100, 500))
    assert sorted(n for n, _ in fitted) == sorted(want.values()) and len(set(saved)) == len(want)
    noted = spark.read.parquet(str(tmp_path / "out" / "cycles" / "*"))
    assert {(r.site, r.cycle): r.n_rows for r in noted.collect()} == want


def skewed(spark, tmp_path, n=6000):
    rng = random.Random(8)
    keys = [f"k{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(n)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "event_id long, key string")
    folder = five_files(df, tmp_path / "s", "event_id")
    return Counter(keys), df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_heavy_hitters_keep_their_bounds(spark, tmp_path):
    true, df, s = skewed(spark, tmp_path)
    got = st.run_stateful(st.heavy_hitters_stream(s, "key", capacity=20, shards=2), "top", "update")
    last = got.where(F.col("epoch") == 4)
    assert last.groupBy("shard").count().where("count > 20").count() == 0
    shard = {r.event_id: r.s for r in df.select("event_id", F.pmod(F.xxhash64("event_id"), F.lit(2)).cast("int").alias("s")).collect()}
    own = Counter((shard[r.event_id], r.key) for r in df.collect())
    held = {(r.shard, r.key): r for r in last.collect()}
    least = {r.shard: r.least for r in held.values()}
    total = Counter(s for s, _ in own.elements())
    for k, r in held.items():
        assert own[k] <= r.n <= own[k] + r.error
    for (s, k), n in own.items():
        assert (s, k) in held or n <= least[s]
    assert all(least[s] <= total[s] / 20 for s in least)
    for r in st.merged_summary(got).collect():
        assert r.key is None or true[r.key] <= r.most
    ordered = df.withColumn("ts", F.timestamp_seconds("event_id"))
    for k in (3, 30):   # beyond what 20 keys a shard can tell, all keys are counted
        best = st.top_keys(got, ordered, "key", k).collect()
        assert [r.n for r in best] == [n for _, n in true.most_common(k)]


def test_traffic(spark, events):
    want = pk.traffic_report(packets(spark, events[1]), pk.capture_alerts(packets(spark, events[1]))).first()
    got = st.traffic_report(stream(spark, events), packets(spark, events[1])).first()
    assert got.asDict() == want.asDict()


def test_a_retried_batch_is_in_the_log_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("2024-01-01T00:00:00.000000", i, 1, 1, "attack", 1) for i in range(9)], sinks.FEEDBACK_FILE)
    for epoch in (0, 1, 1, 0):
        sinks.commit_batch(rows.where(F.col("alert_idx") % 2 == epoch), path, epoch)
    rows.write.option("header", True).csv(f"{path}/batches/epoch=000000000007")   # never committed
    back = sinks.committed_rows(spark, path, sinks.FEEDBACK_FILE)
    assert sorted(r.alert_idx for r in back.collect()) == list(range(9))
    # equal times: the larger id first
    assert [r.alert_idx for r in sinks.newest_rows(back, "alert_idx", 3).collect()] == [8, 7, 6]


def test_automatic_mode_follows_the_last_toggle(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(40) * 600, rng.choice([None, None, None, "on", "off", "flip"])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, s long, toggle string").withColumn("ts", F.timestamp_seconds("s"))
    for default in (True, False):
        flag, want = default, {}
        for i, _, toggle in sorted(rows, key=lambda r: (r[1], r[0])):
            if toggle is None:
                want[i] = flag
            else:
                flag = {"on": True, "off": False, "flip": not flag}[toggle]
        got = rs.auto_mode(df, default).where("toggle is null")
        assert {r.event_id: r.auto for r in got.collect()} == want
