"""The capture data source: every line is read once, whatever the ranges, and
broken ones become rejected rows."""

import io
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import capture

GOOD = {"id": 1, "time": 1704067207.179575, "proto": "TCP", "len": 60, "src": "10.0.0.1", "dst": "10.0.0.2", "sport": 4242, "dport": 80}
BAD = {"not JSON": '{"id": 3, "time"', "not a record": "[1, 2]", "no time": {"proto": "TCP", "len": 1}, "no proto": {"time": 1, "len": 1},
       "no len": {"time": 1, "proto": "ARP"}, "bad proto": dict(GOOD, proto="ICMP"), "bad dport": dict(GOOD, dport=70000),
       "bad sport": dict(GOOD, sport="80"), "bad src": dict(GOOD, src=7), "bad time": dict(GOOD, time=-1), "bad len": dict(GOOD, len=True),
       "bad id": dict(GOOD, id=1.5)}


def line(x):
    return x if isinstance(x, str) else json.dumps(x)


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "capture"
    d.mkdir()
    (d / "a-0.json").write_text("\n".join([line(GOOD), "", *map(line, BAD.values())]))
    (d / "a-1.json").write_text("".join(line(dict(GOOD, id=100 + i, src="é" * (i % 50), dport=None)) + "\r\n" * (1 + i % 2) for i in range(300)))
    (d / "_SUCCESS").write_text("")
    (d / "b-0.json").write_text("")
    return str(d)


def test_lines_and_reasons(spark, folder):
    got = capture.read_capture(spark, folder).collect()
    assert len(got) == 1 + len(BAD) + 300
    assert {r.reason: r.rejected for r in got if r.reason} == {k: line(v) for k, v in BAD.items()}
    assert all(r.event_id is None and r.ts is None for r in got if r.reason)
    one = next(r for r in got if r.event_id == 1)
    assert (one.ts.microsecond, one.proto, one.length, one.src, one.dst, one.sport, one.dport) == (179575, "TCP", 60.0, "10.0.0.1", "10.0.0.2", 4242, 80)
    assert sorted(r.event_id for r in got if r.event_id and r.event_id >= 100) == list(range(100, 400))


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_ranges_share_no_line(size, monkeypatch):
    monkeypatch.setattr(capture, "CHUNK", 13)
    data = b"\n".join(b"x" * (i % 23) for i in range(200)) + b"\nlast"
    lines = []
    for at in range(0, len(data), size):
        lines += capture.lines_of(io.BytesIO(data), at, min(len(data), at + size))
    assert lines == data.split(b"\n")


def test_small_ranges_in_spark(spark, folder):
    whole = capture.read_capture(spark, folder)
    cut = capture.read_capture(spark, folder, splitBytes=101)
    assert cut.rdd.getNumPartitions() > 20
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))


def test_stream_takes_files_in_turn_and_goes_on(spark, folder, tmp_path):
    import os
    seen = []

    def run():
        q = capture.capture_stream(spark, folder, None).writeStream.option("checkpointLocation", str(tmp_path / "ckpt")) \
            .foreachBatch(lambda b, e: seen.append((e, b.count()))).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    run()
    assert sum(n for _, n in seen) == 1 + len(BAD) + 300
    with open(os.path.join(folder, "c-0.json"), "w") as f:
        f.write(line(dict(GOOD, id=999)))
    before = len(seen)
    run()
    assert sum(n for _, n in seen[before:]) == 1


def test_written_packets_come_back(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 333_333 + 1_704_067_200_000_001).alias("ts"),
                                F.lit("UDP").alias("proto"), F.lit(3.5).alias("length"), F.when(F.col("id") % 2 == 0, "a").alias("src"))
    capture.write_capture(df, str(tmp_path / "out"))
    back = capture.read_capture(spark, str(tmp_path / "out"))
    cols = ["event_id", "ts", "proto", "length", "src"]
    assert sorted(map(tuple, back.select(cols).collect()), key=str) == sorted(map(tuple, df.select(cols).collect()), key=str)


def test_no_files(spark, tmp_path):
    assert capture.read_capture(spark, str(tmp_path / "none")).count() == 0
