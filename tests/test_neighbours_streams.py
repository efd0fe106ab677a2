"""Neighbours and synthetic rows, and streams that arrive in several files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import models as md
from tidewatch.operators import packets as pk
from tidewatch.sources.views import packets
from tidewatch.streaming import detectors as sd


def exact_neighbours(ids, x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return {ids[i]: [ids[j] for j in np.lexsort((ids, d[i]))[:k]] for i in range(len(ids))}


def points(spark, n, dim, seed, classes=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) @ np.diag(1.0 / np.arange(1, dim + 1))
    c = rng.integers(0, classes, n)
    df = spark.createDataFrame([(i, x[i].tolist(), int(c[i])) for i in range(n)], "id long, v array<double>, c int")
    return df, x, c


def test_small_classes_have_exact_neighbours(spark):
    df, x, c = points(spark, 150, 6, 1, 3)
    got = {}
    for r in md.knn_within_class(df, "id", "v", "c", 4).collect():
        got.setdefault(r.id, {})[r.nn_rank] = r.nn_id
    for k in range(3):
        own = np.flatnonzero(c == k)
        for i, want in exact_neighbours(own, x[own], 4).items():
            assert [got[i][r] for r in (1, 2, 3, 4)] == want


def test_cells_find_most_neighbours(spark):
    df, x, _ = points(spark, 3000, 12, 2)
    want = exact_neighbours(np.arange(3000), x, 5)
    got = {}
    for r in md.knn_within_class(df, "id", "v", "c", 5).collect():
        got.setdefault(r.id, set()).add(r.nn_id)
    assert all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[i] & set(want[i])) / 5 for i in want]) >= 0.9


def test_equal_vectors_are_dealt_to_parts(spark):
    df = spark.range(700).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"), F.lit(0).alias("c"))
    got = md.knn_within_class(df, "id", "v", "c", 3, leaf=100, max_leaf=50).groupBy("id").count().collect()
    assert len(got) == 700 and {r["count"] for r in got} == {3}


def test_synthetic_rows_lie_between_donor_and_neighbour(spark):
    df, x, c = points(spark, 200, 5, 3)
    df = df.withColumn("c", F.when(F.col("id") < 130, 0).when(F.col("id") < 190, 1).otherwise(2))
    df = df.unionByName(spark.createDataFrame([(900, None, 1), (901, [0.0] * 5, None)], "id long, v array<double>, c int"))
    rows = md.smote(df, "id", "v", "c", 4, trace=True).collect()
    assert sum(not r.synthetic for r in rows) == 202
    count = {k: sum(r.synthetic and r.c == k for r in rows) for k in (0, 1, 2)}
    assert count == {0: 0, 1: 130 - 60, 2: 130 - 10}
    label = np.array([0] * 130 + [1] * 60 + [2] * 10)
    for r in (r for r in rows if r.synthetic):
        assert 0 <= r.u < 1 and label[r.donor_id] == label[r.nn_id] == r.c and r.donor_id != r.nn_id
        assert np.allclose(r.v, x[r.donor_id] + r.u * (x[r.nn_id] - x[r.donor_id]))
    donors = [r.donor_id for r in rows if r.synthetic and r.c == 2]
    assert {donors.count(i) for i in range(190, 200)} == {12}
    one = md.smote(df.filter("id in (0, 1, 190)"), "id", "v", "c").filter("synthetic").collect()
    assert len(one) == 1 and np.allclose(one[0].v, x[190])     # no neighbour: the donor itself


@pytest.fixture(scope="module")
def several_files(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    import pyarrow.parquet as pq
    t = pq.read_table(f"{sf}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    step = len(t) // 5 + 1
    import os
    for i in range(5):
        path = folder / f"part{i}.parquet"
        pq.write_table(t.slice(i * step, step), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))   # the stream takes older files first
    return str(folder)


def test_state_is_carried_over_micro_batches(spark, sf, several_files):
    batch, stream = packets(spark, sf), lambda: sd.packet_stream(spark, several_files, max_files_per_trigger=1)
    ids = lambda df: sorted(r.event_id for r in df.select("event_id").collect())
    assert ids(pk.port_scan_alerts(batch)) == ids(sd.run_to_table(sd.port_scan_stream(stream()), "m_scan"))
    assert ids(pk.arp_spoof(batch).filter("arp_alert")) == ids(sd.run_to_table(sd.arp_spoof_stream(stream()), "m_arp"))
    alerts = lambda df: sorted((r.event_id, r.hijack_alert) for r in df.collect())
    assert alerts(pk.session_hijack(batch)) == alerts(sd.run_to_table(sd.session_hijack_stream(stream()), "m_hijack"))


def test_blocks_and_windows_over_micro_batches(spark, several_files):
    one = lambda: sd.packet_stream(spark, several_files, max_files_per_trigger=1)
    every = lambda: sd.packet_stream(spark, several_files)
    blocks = lambda s: sorted((r.ip, r.blocked_at) for r in sd.run_to_table(sd.dns_block_stream(s), "m_blocks").collect())
    assert blocks(one()) == blocks(every())
    rate = lambda s: sorted((r.w.start, r.packets) for r in
                            sd.run_to_table(sd.rate_stream(s), "m_rate", "update", ("w",)).collect())
    assert rate(one()) == rate(every())
