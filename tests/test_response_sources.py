"""Response decisions, feedback cycles, file sources and sinks."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import feedback as fb
from tidewatch.operators import response as rs
from tidewatch.sources import flows as fl
from tidewatch.sources import sinks, study

T0 = dt.datetime(2024, 1, 1)


def _verdicts(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, src long, dst long, t string")
    return df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "src", "dst",
                     F.lit(True).alias("mitm_alert"), F.array("t").alias("mitm_type"))


def test_block_not_renewed_until_expiry(spark):
    s = lambda x: T0 + dt.timedelta(seconds=x)
    rows = [(1, s(0), 7, None, "ARP_SPOOFING"), (2, s(100), 7, None, "ARP_SPOOFING"),
            (3, s(1800), 7, None, "ARP_SPOOFING"), (4, s(1801), 7, None, "ARP_SPOOFING"),
            (5, s(50), 8, None, "DNS_POISONING")]
    d = rs.block_decisions(_verdicts(spark, rows), auto=True, duration_s=1800)
    opened = sorted(r.event_id for r in d.filter("opens_block").collect())
    assert opened == [1, 4, 5]          # expires_at < now is expired: 1800 is still blocked


def test_only_critical_acts_without_auto(spark):
    rows = [(1, T0, 7, None, "ARP_SPOOFING"), (2, T0, 8, None, "SESSION_HIJACKING")]
    d = rs.block_decisions(_verdicts(spark, rows), auto=False)
    log = {r.event_id: (r.severity, r.action_count, r.actions_text)
           for r in rs.mitigation_log(d, auto=False).collect()}
    assert log[1] == ("high", 0, "")
    assert log[2] == ("critical", 2, "block_ip:8;terminate_session:8->")


def test_unblock_event_resets(spark):
    s = lambda x: T0 + dt.timedelta(seconds=x)
    v = _verdicts(spark, [(1, s(0), 7, None, "X"), (2, s(10), 7, None, "X"), (3, s(20), 7, None, "X")])
    v = v.withColumn("action", F.when(F.col("event_id") == 2, "unblock").otherwise("alert"))
    d = rs.block_decisions(v, auto=True)
    assert sorted(r.event_id for r in d.filter("opens_block").collect()) == [1, 3]


def test_feedback_cycles_close_at_interval(spark):
    rows = [(i, fb.CONFIRMED if i % 2 else (fb.DISMISSED if i % 3 else "other"), 1) for i in range(260)]
    df = spark.createDataFrame(rows, "row_id long, verdict string, y_true int")
    c = fb.assign_cycles(df, ["row_id"], batch_size=50, interval=100)
    per = {r.cycle: r["count"] for r in c.filter(F.col("cycle").isNotNull()).groupBy("cycle").count().collect()}
    # brute force: two buffers, checked after every batch of 50
    want, tp, fp, cyc, start = {}, 0, 0, 0, 0
    for b in range(0, 260, 50):
        batch = rows[b:b + 50]
        tp += sum(v == fb.CONFIRMED for _, v, _ in batch)
        fp += sum(v == fb.DISMISSED for _, v, _ in batch)
        if tp + fp >= 100:
            want[cyc] = b + len(batch) - start
            cyc, tp, fp, start = cyc + 1, 0, 0, b + len(batch)
    assert per == want and per == {0: 150}
    st = fb.feedback_stats(c).first()
    assert st.retraining_cycles == 1


def test_flow_csv_ingest(spark, tmp_path):
    cic = tmp_path / "cic.csv"
    cic.write_text(" Destination Port, Flow Bytes/s, Fwd Header Length, Fwd Header Length, Label\n"
                   "80,Infinity,20,20,BENIGN\n443,12.5,40,40, DoS Hulk\n22,inf,10,10,BENIGN\n")
    unsw = tmp_path / "unsw.csv"
    unsw.write_text("id,proto,sbytes,attack_cat,label\n1,tcp,100,Normal,0\n2,udp,50,Exploits,1\n")
    df = fl.load_flows(spark, [str(cic), str(tmp_path / "missing.csv")], [str(unsw)], str(tmp_path / "processed"))
    assert "fwd_header_length_1" in df.columns and "unsw_label" in df.columns
    labels = sorted((r.attack_cat, r.label) for r in df.collect())
    assert labels == [("BENIGN", 0), ("BENIGN", 0), ("DoS Hulk", 1), ("Exploits", 1), ("Normal", 0)]
    rates = [r.flow_bytes_s for r in df.filter("proto IS NULL").collect()]
    assert 12.5 in rates and all(r in (12.5, float("inf")) or r is None for r in rates)
    from tidewatch.operators.prep import nonfinite_to_null
    cleaned = nonfinite_to_null(df.filter("proto IS NULL"), ["flow_bytes_s"]).collect()
    assert sorted(r.flow_bytes_s for r in cleaned if r.flow_bytes_s is not None) == [12.5]
    assert fl.load_flows(spark, [], [], str(tmp_path / "processed")).count() == 5   # parquet reused


def test_ragged_session_files(spark, tmp_path):
    f = tmp_path / "test_session_a.csv"
    f.write_text("phase,alert_idx,user_decision,time_seconds,model_prediction,true_label,feedback\n"
                 "baseline,0,attack,5.5,1,1,\nassisted,0,benign,3.0,0,0,confirmed\n\n"
                 "questionnaire,q1,q2,q3,q4,q5\nanswer,1,2,1,1,1\n")
    d, a = study.read_sessions(spark, str(tmp_path))
    assert sorted((r.phase, r.feedback) for r in d.collect()) == [("assisted", "confirmed"), ("baseline", None)]
    assert [r.answer for r in a.orderBy("question").collect()] == [1, 2, 1, 1, 1]


def test_mitigation_log_roundtrip(spark, tmp_path):
    rows = [(1, T0, 7, None, "SESSION_HIJACKING")]
    d = rs.block_decisions(_verdicts(spark, rows), auto=True)
    path = str(tmp_path / "mitigation")
    sinks.append_mitigation_log(rs.mitigation_log(d), path)
    sinks.append_mitigation_log(rs.mitigation_log(d), path)
    back = sinks.read_mitigation_log(spark, path, 50).collect()
    assert len(back) == 2 and back[0].actions == "block_ip:7;terminate_session:7->" and back[0].action_count == 2
