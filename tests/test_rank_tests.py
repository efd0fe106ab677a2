"""Rank tests by counts per value: whole results, no group sorted in one task."""

import random

import pytest

from tidewatch.operators import stats as st


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("by", [[], ["g"]])
def test_wilcoxon_ranks_by_counts(spark, by):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y"]), rng.choice([-1, 1]) * rng.choice([rng.randint(0, 9), rng.random() * 50])) for _ in range(3000)]
    df = spark.createDataFrame([(g, float(d)) for g, d in rows], "g string, d double")
    out = st.wilcoxon(df, by)
    assert "rank(" not in plan_of(out)
    for r in out.collect():
        d = [v for g, v in rows if v != 0 and (not by or g == r.g)]
        a = sorted(map(abs, d))
        first, last = {}, {}
        for i, v in enumerate(a, 1):
            first.setdefault(v, i)
            last[v] = i
        rank = {v: (first[v] + last[v]) / 2 for v in first}
        assert (r.n, r.w_plus, r.w_minus) == (len(d), sum(rank[v] for v in d if v > 0), sum(rank[-v] for v in d if v < 0))
    none = st.wilcoxon(df.filter("d = 0")).first()
    assert (none.n, none.w_plus, none.statistic) == (0, None, None)


def test_shapiro_positions_by_counts(spark):
    # published example (weights of 11 men): W = 0.79, p below 0.01
    men = [float(v) for v in (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236)]
    rng = random.Random(6)
    big = [round(rng.gauss(0, 1), 1) for _ in range(6000)]
    rows = [("men", v) for v in men] + [("big", v) for v in big] + [(None, v) for v in men] + [("flat", 1.0)] * 2500 + [("two", 1.0), ("two", 2.0)] \
        + [("three", v) for v in (1.0, 2.0, 3.0)] + [("men", None)]
    out = st.shapiro_wilk(spark.createDataFrame(rows, "g string, x double"), "x", ["g"])
    assert "row_number" not in plan_of(out)
    got = {r.g: r for r in out.collect()}
    assert got["men"].n == 11 and got["men"].w == pytest.approx(0.7888, abs=2e-4) and got["men"].p_value < 0.01
    assert got[None].w == pytest.approx(got["men"].w) and got["big"].n == 6000 and got["big"].w > 0.99
    assert got["three"].w == pytest.approx(1)
    assert (got["flat"].n, got["flat"].w, got["flat"].p_value) == (2500, None, None) and got["two"].w is None
