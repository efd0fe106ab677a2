"""User-study analysis: rollups, paired tests, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as st
from ..operators import study as sd
from ..sources.views import answers, decisions
from .common import r6, rnd
from .registry import register
from .sql_views import ANSWERS_CTE, DECISIONS_CTE

WD = f"WITH {DECISIONS_CTE}"
ROLLUP_SQL = f"""{WD},
dc AS (SELECT *, CAST(user_decision = CASE WHEN true_label = 1 THEN 'attack' ELSE 'benign' END AS INTEGER) AS ok
       FROM decisions),
r AS (SELECT user_id, phase, avg(ok) AS accuracy, avg(time_seconds) AS mean_time, CAST(sum(ok) AS BIGINT) AS n_correct,
             count(*) AS n FROM dc GROUP BY user_id, phase)"""
PAIRS_SQL = f"""{ROLLUP_SQL},
pr AS (SELECT user_id, max(accuracy) FILTER (WHERE phase = 'baseline') AS a,
              max(accuracy) FILTER (WHERE phase = 'assisted') AS b FROM r GROUP BY user_id),
d AS (SELECT user_id, a, b, a - b AS d FROM pr WHERE a IS NOT NULL AND b IS NOT NULL)"""


def _rollup(spark, sf_dir):
    return sd.user_phase_rollup(sd.with_correct(decisions(spark, sf_dir)))


def _pairs(spark, sf_dir):
    return st.paired_differences(_rollup(spark, sf_dir), "user_id", "phase", "accuracy", "baseline", "assisted")


@register("user_phase_rollup", sql=f"""{ROLLUP_SQL}
SELECT user_id, phase, ROUND(accuracy, 6) AS accuracy, ROUND(mean_time, 6) AS mean_time, n_correct, n FROM r""")
def user_phase_rollup(spark, sf_dir):
    """A2 (with P8's correct flag recomputed from the decision text)."""
    r = _rollup(spark, sf_dir)
    return r.select("user_id", "phase", r6("accuracy", "accuracy"), r6("mean_time", "mean_time"), "n_correct", "n")


@register("phase_summary", sql=f"""{ROLLUP_SQL}
SELECT phase, ROUND(avg(accuracy), 6) AS accuracy_mean, ROUND(stddev_samp(accuracy), 6) AS accuracy_std,
       ROUND(avg(mean_time), 6) AS time_mean, ROUND(stddev_samp(mean_time), 6) AS time_std, count(*) AS users
FROM r GROUP BY phase""")
def phase_summary(spark, sf_dir):
    """A3: per phase mean and sample std of per-user means."""
    s = sd.phase_summary(_rollup(spark, sf_dir))
    return s.select("phase", *[r6(c, c) for c in ("accuracy_mean", "accuracy_std", "time_mean", "time_std")], "users")


@register("describe_by_phase", sql=f"""{ROLLUP_SQL},
long AS (UNPIVOT (SELECT phase, accuracy, mean_time FROM r) ON accuracy, mean_time INTO NAME c_name VALUE v)
SELECT phase, c_name AS "column", count(*) AS count, ROUND(avg(v), 4) AS mean, ROUND(stddev_samp(v), 4) AS std,
       ROUND(min(v), 4) AS min, ROUND(quantile_cont(v, 0.25), 4) AS p25, ROUND(quantile_cont(v, 0.5), 4) AS p50,
       ROUND(quantile_cont(v, 0.75), 4) AS p75, ROUND(max(v), 4) AS max
FROM long GROUP BY phase, c_name""")
def describe_by_phase(spark, sf_dir):
    """describe() of per-user accuracy and time by phase, round 4."""
    d = sd.describe(_rollup(spark, sf_dir), ["accuracy", "mean_time"], ["phase"])
    return d.select("phase", "column", "count",
                    *[rnd(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@register("question_summary", sql=f"""WITH {ANSWERS_CTE}
SELECT question, ROUND(avg(answer), 6) AS mean, ROUND(stddev_samp(answer), 6) AS std, count(*) AS n,
       ROUND(median(answer), 6) AS median FROM answers GROUP BY question""")
def question_summary(spark, sf_dir):
    """Mean, sample std, median per question."""
    q = sd.question_summary(answers(spark, sf_dir))
    return q.select("question", r6("mean", "mean"), r6("std", "std"), "n", r6("median", "median"))


@register("distinct_users", sql=f"{WD} SELECT count(DISTINCT user_id) AS users FROM decisions")
def distinct_users(spark, sf_dir):
    """A6."""
    return sd.distinct_users(decisions(spark, sf_dir))


@register("session_summary", sql=f"""{ROLLUP_SQL}
SELECT phase, ROUND(avg(time_seconds), 6) AS mean_time, CAST(sum(ok) AS BIGINT) AS n_correct, count(*) AS decisions
FROM dc GROUP BY phase""")
def session_summary(spark, sf_dir):
    """A13."""
    s = sd.session_summary(sd.with_correct(decisions(spark, sf_dir)))
    return s.select("phase", r6("mean_time", "mean_time"), "n_correct", "decisions")


@register("paired_t", sql=f"""{PAIRS_SQL}
SELECT count(*) AS n, ROUND(avg(d), 6) AS mean_d, ROUND(stddev_samp(d), 6) AS sd_d,
       ROUND(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t_statistic FROM d""")
def paired_t(spark, sf_dir):
    """Paired t on per-user accuracy, baseline vs assisted (statistic;
    p-value is unit-tested)."""
    t = st.paired_t(_pairs(spark, sf_dir))
    return t.select("n", r6("mean_d", "mean_d"), r6("sd_d", "sd_d"), r6("t_statistic", "t_statistic"))


@register("wilcoxon", sql=f"""{PAIRS_SQL},
x AS (SELECT d, abs(d) AS ad FROM d WHERE d <> 0),
rk AS (SELECT d, rank() OVER (ORDER BY ad) + (count(*) OVER (PARTITION BY ad) - 1) / 2.0 AS r FROM x)
SELECT count(*) AS n, ROUND(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 6) AS w_plus,
       ROUND(sum(CASE WHEN d < 0 THEN r ELSE 0 END), 6) AS w_minus,
       ROUND(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)), 6) AS statistic
FROM rk""")
def wilcoxon(spark, sf_dir):
    """Signed-rank statistic on per-user accuracy differences."""
    w = st.wilcoxon(_pairs(spark, sf_dir))
    return w.select("n", r6("w_plus", "w_plus"), r6("w_minus", "w_minus"), r6("statistic", "statistic"))


@register("cohens_d", sql=f"""{ROLLUP_SQL},
s AS (SELECT phase, count(*) AS n, avg(accuracy) AS m, var_samp(accuracy) AS v FROM r GROUP BY phase),
a AS (SELECT n AS na, m AS ma, v AS va FROM s WHERE phase = 'baseline'),
b AS (SELECT n AS nb, m AS mb, v AS vb FROM s WHERE phase = 'assisted')
SELECT ROUND(ma - mb, 6) AS mean_diff, ROUND(sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS pooled_sd,
       ROUND((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohens_d FROM a, b""")
def cohens_d(spark, sf_dir):
    """Effect size with the pooled sample SD."""
    d = st.cohens_d(_rollup(spark, sf_dir), "phase", "accuracy", "baseline", "assisted")
    return d.select(*[r6(c, c) for c in d.columns])


@register("accuracy_histogram", sql=f"""{ROLLUP_SQL},
rg AS (SELECT phase, min(accuracy) AS lo, max(accuracy) AS hi FROM r GROUP BY phase),
b AS (SELECT r.phase, lo, hi, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((accuracy - lo) / ((hi - lo) / 10)), 9) END
             AS INTEGER) AS bin FROM r JOIN rg USING (phase))
SELECT phase, bin, ROUND(lo + bin * (hi - lo) / 10, 6) AS lo, ROUND(lo + (bin + 1) * (hi - lo) / 10, 6) AS hi,
       count(*) AS n FROM b GROUP BY phase, bin, lo, hi""")
def accuracy_histogram(spark, sf_dir):
    """10 equal-width bins of per-user accuracy per phase."""
    h = st.histogram(_rollup(spark, sf_dir), "accuracy", ["phase"], 10)
    return h.select("phase", "bin", r6("lo", "lo"), r6("hi", "hi"), "n")


@register("paired_points", sql=f"""{PAIRS_SQL}
SELECT user_id, ROUND(a, 6) AS baseline, ROUND(b, 6) AS assisted, ROUND(d, 6) AS diff FROM d""")
def paired_points(spark, sf_dir):
    """Users with both phases, paired by a fixed-value pivot."""
    p = _pairs(spark, sf_dir)
    return p.select("user_id", r6("a", "baseline"), r6("b", "assisted"), r6("d", "diff"))


@register("shapiro")
def shapiro(spark, sf_dir):
    """Shapiro-Wilk W and p per (metric, phase) on per-user means
    (Royston approximation; no SQL oracle)."""
    r = _rollup(spark, sf_dir)
    long = r.select("phase", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")).unionByName(
        r.select("phase", F.lit("mean_time").alias("metric"), F.col("mean_time").alias("value")))
    s = st.shapiro_wilk(long, "value", ["metric", "phase"])
    return s.select("metric", "phase", "n", r6("w", "w"), r6("p_value", "p_value"))
