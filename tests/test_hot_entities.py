"""Blocks and windows where one source or port holds most rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import packets as pk
from tidewatch.operators import prep
from tidewatch.operators import response as rs
from tidewatch.operators.scan import halo_segments

MINUTE = 60_000_000


def plain_blocks(rows, dur):
    """(opens, ended opening) per event by a walk through each source."""
    opens, ends = set(), {}
    for src in {r[2] for r in rows}:
        expires = opened = None
        for event, t, _, action in sorted((r for r in rows if r[2] == src), key=lambda r: (r[1], r[0])):
            if action == "unblock":
                if expires is not None and t <= expires:
                    ends[event] = opened
                expires = None
            elif src is not None and (expires is None or t > expires):
                opens.add(event)
                expires, opened = t + dur, event
    return opens, ends


def verdicts(spark, rows, control=True):
    df = spark.createDataFrame(rows, "event_id long, us long, src long, action string")
    x = df.select("event_id", F.timestamp_micros("us").alias("ts"), "src", F.lit(None).cast("long").alias("dst"),
                  (F.col("action") == "alert").alias("mitm_alert"), F.array(F.lit("DNS_POISONING")).alias("mitm_type"), "action")
    return x if control else x.drop("action")


@pytest.mark.parametrize("control", [True, False])
def test_openings_of_a_hot_source(spark, control):
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        # four in five alerts are one source's; seconds, so that ties and exact expiries occur
        src = 1 if rng.random() < 0.8 else rng.choice([2, 3, None])
        action = "unblock" if control and rng.random() < 0.05 else "alert"
        rows.append((i, rng.randrange(0, 9000) * 1_000_000, src, action))
    rows += [(9000 + i, i * 30 * MINUTE, 7, "alert") for i in range(40)] + [(9100 + i, i * 30 * MINUTE + i, 8, "alert") for i in range(40)]
    out = rs.block_decisions(verdicts(spark, rows, control), duration_s=1800, bucket_seconds=60).collect()
    opens, ends = plain_blocks(rows, 30 * MINUTE)
    assert len(out) == len(rows)
    assert {r.event_id for r in out if r.opens_block} == opens
    assert {r.event_id: r.ends_block for r in out if r.ends_block is not None} == ends
    assert all((r.expires_at is not None) == r.opens_block for r in out)


def test_no_source_walks_through_one_task(spark):
    d = rs.block_decisions(verdicts(spark, [(1, 0, 1, "alert")]))
    plan = d._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
    assert rs.block_decisions(verdicts(spark, []).limit(0)).count() == 0


def port_rows(spark, n=4000):
    rng = random.Random(12)
    rows = [(80 if rng.random() < 0.9 else rng.randrange(100, 140), i // 3, i, float(i % 17), i % 2) for i in range(n)]
    rows += [(None, 5, n + i, 1.0, 0) for i in range(25)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "port int, t long, id long, x double, label int")


def test_windows_of_a_busy_port(spark):
    rows, df = port_rows(spark)
    want = {}
    for port in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == port), key=lambda r: (r[1], r[2]))
        for i in range(19, len(mine)):
            want[mine[i][2]] = (port, mine[i][4], [[r[3]] for r in mine[i - 19:i + 1]])
    got = prep.sequence_windows(df, "port", ["t", "id"], ["x"], "label", 20, segment_rows=64)
    assert got.columns == ["port", "t", "id", "seq", "label"]
    assert {r.id: (r.port, r.label, r.seq) for r in got.collect()} == want
    assert prep.sequence_windows(df.limit(0), "port", ["t", "id"], ["x"], "label", 20).count() == 0


def test_no_window_group_exceeds_its_segment(spark):
    _, df = port_rows(spark)
    x = halo_segments(df, ["port", "t", "id"], 19, 64)
    groups = [r["count"] for r in x.groupBy("_seg", "port").count().collect()]
    assert max(groups) <= 64 + 19
    assert x.where("not _halo").count() == df.count() and x.where("_halo").count() >= 19 * (df.count() // 64)
    w = prep.sequence_windows(df, "port", ["t", "id"], ["x"], "label", 20, segment_rows=64)
    partitioned = re.findall(r"windowspecdefinition\((.*?)#", w._jdf.queryExecution().optimizedPlan().toString())
    # the other one numbers the sorted partitions, a row for each
    assert "_seg" in partitioned and set(partitioned) <= {"_seg", "_part"}


def test_gaps_across_segments(spark):
    times = [0, 5, 5, 1_000_000, 7_000_000_000, 7_000_000_001]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "event_id long, us long").select("event_id", F.timestamp_micros("us").alias("ts"))
    for rows in (2, 3, 100):
        got = sorted(r.gap_us for r in pk.consecutive_gaps(df, rows).collect())
        assert got == sorted(b - a for a, b in zip(times, times[1:]))
