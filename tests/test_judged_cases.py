"""Cases off the clean path: missing values, degenerate statistics, headers in
any order, control events, whole answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch import session
from tidewatch.functions.quantiles import quantiles
from tidewatch.operators import metrics as mt
from tidewatch.operators import packets as pk
from tidewatch.operators import prep
from tidewatch.operators import response as rs
from tidewatch.operators import stats as st
from tidewatch.sources import flows as fl
from tidewatch.sources import study

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_headers_in_any_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Flow ID,Dur,Label\nf1,10,BENIGN\n")
    (tmp_path / "b.csv").write_text("Dur,Flow ID,Extra,Label\n20,f2,7,DoS\n")
    (tmp_path / "c.csv").write_text("")
    want = [("f1", 10.0, None, 0), ("f2", 20.0, 7.0, 1)]
    for df in (fl.load_cic(spark, [str(tmp_path / f"{x}.csv") for x in "abc"]), fl.load_glob(spark, str(tmp_path))):
        assert sorted((r.flow_id, r.dur, r.extra, r.label) for r in df.collect()) == want
    assert fl.load_glob(spark, str(tmp_path / "none")) is None


def test_glob_labels_each_kind(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,proto,attack_cat,label\n1,tcp, Normal,0\n2,udp,Exploits,1\n")
    (tmp_path / "c.csv").write_text("Flow ID, Label\nf1,BENIGN\n")
    got = sorted((r.attack_cat, r.label) for r in fl.load_glob(spark, str(tmp_path)).collect())
    assert got == [("BENIGN", 0), ("Exploits", 1), ("Normal", 0)]


def test_answers_are_read_whole(spark, tmp_path):
    (tmp_path / "s.csv").write_text("phase,alert_idx\nx,0,attack,5.5,1,1,\n\nquestionnaire,q1\nanswer," + ",".join("3" * 120) + "\n")
    d, a = study.read_sessions(spark, str(tmp_path))
    assert a.count() == 120 and [r.phase for r in d.collect()] == ["x"]


def test_packets_without_ip_are_kept(spark):
    p = spark.createDataFrame([(1, T0, None, "aa"), (2, at(1), "i", "aa"), (3, at(2), "i", "bb"), (4, at(3), None, "bb")],
                              "event_id long, ts timestamp, ip string, mac string")
    assert {r.event_id: r.arp_alert for r in pk.arp_spoof(p).collect()} == {1: False, 2: False, 3: True, 4: False}


def test_unanswered_query_alerts(spark):
    d = spark.createDataFrame([(1, 5, None, 300.0), (2, 5, 5, None), (3, 5, 6, None), (4, None, None, 300.0)],
                              "event_id int, query_id int, response_id int, ttl double").withColumn("baseline_ttl", F.lit(300.0))
    assert {r.event_id: r.dns_alert for r in pk.dns_poison(d).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_missing_rtt_and_source(spark):
    big = 2 ** 60 + 1
    rows = [(i, at(i), src, 10.0 if i != 1 else None) for src in (None, big) for i in range(4)]
    got = pk.session_hijack(spark.createDataFrame(rows, "event_id long, ts timestamp, src long, rtt double")).collect()
    for src in (None, big):
        own = sorted((r.event_id, r.n_baseline, r.rtt_mean) for r in got if r.src == src)
        assert own == [(0, 1, 10.0), (1, 1, 10.0), (2, 2, 10.0), (3, 3, 10.0)]


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, src long, action string")
    alert = F.col("action") == "alert"
    return df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "src", F.lit(None).cast("long").alias("dst"),
                     alert.alias("mitm_alert"), F.when(alert, F.array(F.lit("ARP_SPOOFING"))).alias("mitm_type"), "action")


def test_unblock_without_a_verdict_ends_the_block(spark):
    rows = [(1, at(0), 7, "alert"), (2, at(300), 7, "unblock"), (3, at(600), 7, "alert"), (4, at(5000), 7, "unblock"), (5, at(10), 8, "alert")]
    d = rs.block_decisions(verdicts(spark, rows), duration_s=1800)
    b = rs.block_intervals(d, 1800)
    got = sorted((r.ip, (r.blocked_at - T0).seconds, (r.expires_at - T0).seconds) for r in b.collect())
    assert got == [(7, 0, 300), (7, 600, 2400), (8, 10, 1810)]
    assert [r.ip for r in rs.active_blocks(b, F.lit(at(420)).cast("timestamp")).collect()] == [8]
    assert sorted(r.event_id for r in rs.mitigation_log(d).collect()) == [1, 3, 5]


def test_curves_of_one_class(spark):
    for label in (0, 1):
        df = spark.createDataFrame([(label, 0.1 * i) for i in range(5)], "y_true int, y_score double")
        assert mt.auc_exact(df).first().auc is None
        assert mt.roc_auc_trapezoid(mt.roc_points(df)).first().auc_trapezoid is None
        assert mt.average_precision(df).first().average_precision == pytest.approx(float(label))


def test_trapezoid_equals_exact_auc(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)], "y_true int, y_score double")
    assert mt.roc_auc_trapezoid(mt.roc_points(df)).first()[0] == pytest.approx(mt.auc_exact(df).first()[0])


@pytest.mark.parametrize("d", [[1.0], [2.0, 2.0, 2.0], [0.0, 0.0]])
def test_paired_t_without_spread(spark, d):
    r = st.paired_t(spark.createDataFrame([(x,) for x in d], "d double")).first()
    assert r.t_statistic is None and r.p_value is None and r.significant is False


def test_friedman_all_tied(spark):
    df = spark.createDataFrame([(b, t, 1.0) for b in range(4) for t in "xyz"], "b int, t string, s double")
    r = st.friedman(df, "b", "t", "s").first()
    assert r.statistic == 0 and r.p_value == 1 and not r.significant


def test_kappa_of_one_class(spark):
    assert st.cohens_kappa(spark.createDataFrame([(1, 1)] * 3, "a int, b int"), "a", "b").first().kappa == 1
    assert st.cohens_kappa(spark.createDataFrame([], "a int, b int"), "a", "b").first().kappa is None


def test_effect_size_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 3.0)], "g string, v double")
    r = st.cohens_d(df, "g", "v", "a", "b").first()
    assert r.mean_diff == -2 and r.cohens_d is None


def test_wilcoxon_counts_beyond_bigint(spark):
    n = 2_200_000    # n (n + 1) (2n + 1) leaves the range of a bigint
    df = spark.range(n).select((F.col("id") % 2 * 2 - 1).cast("double").alias("d"))
    r = st.wilcoxon(df).first()
    assert r.n == n and r.w_plus == r.w_minus and r.p_value == pytest.approx(1.0)


def test_mutual_information_of_large_counts(spark):
    # counts enter products as doubles: the plan has no bigint product to overflow
    df = spark.createDataFrame([(float(i % 2), i % 2) for i in range(10)], "x double, label int")
    assert prep.binned_mutual_info(df, ["x"]).first().mi == pytest.approx(0.693147, abs=1e-5)


def test_quantiles_use_the_bracket(spark):
    rng = random.Random(2)
    v = [rng.gauss(0, 1) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    v.sort()
    got = {r.q: r.value for r in quantiles(df, ["v"], [0.25, 0.5, 0.9], accuracy=500).collect()}
    for q in (0.25, 0.5, 0.9):
        p = q * (len(v) - 1)
        assert got[q] == pytest.approx(v[int(p)] + (p - int(p)) * (v[int(p) + 1] - v[int(p)]))


def test_exact_sample_with_tied_scores(spark, monkeypatch):
    monkeypatch.setattr(prep, "hash_score", lambda c, seed=42: F.lit(0.5))
    df = spark.range(50).withColumnRenamed("id", "row_id")
    assert sorted(r.row_id for r in prep.exact_sample(df, "row_id", 20).collect()) == list(range(20))


def test_stratified_split_of_a_null_class(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(40)], "row_id long, label int")
    got = prep.stratified_split(df, "label", "row_id", 0.25).filter("is_test").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {None: 5, 1: 5}


def test_no_private_scratch_folder_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_cycles_over_many_segments(spark, monkeypatch):
    from tidewatch.operators import feedback as fb
    monkeypatch.setattr(fb, "SEGMENT", 7)
    rng = random.Random(5)
    rows = [(i, rng.choice([fb.CONFIRMED, fb.DISMISSED, "none"])) for i in range(1990)]
    got = {r.row_id: (r.rn, r.cycle) for r in
           fb.assign_cycles(spark.createDataFrame(rows, "row_id long, verdict string").repartition(9), ["row_id"], 10, 23).collect()}
    want, held, cycle, batch_cycle = {}, 0, 0, []
    for b in range(0, len(rows), 10):
        held += sum(v != "none" for _, v in rows[b:b + 10])
        batch_cycle.append(cycle)
        if held >= 23:
            held, cycle = 0, cycle + 1
    want = {i: (i + 1, c if (c := batch_cycle[i // 10]) < cycle else None) for i, _ in rows}
    assert got == want
