"""Statistical tests as grouped aggregates. Each returns the statistic
computed in Spark SQL plus a p-value column from :mod:`functions.stats`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf_udf, inv_norm_udf, normal_sf_udf, shapiro_p_udf, t_p_udf
from ..session import checkpoint_dir
from .scan import running_sum


def mcnemar(preds: DataFrame, y_true: str = "y_true", a: str = "y_pred", b: str = "y_pred_b",
            alpha: float = 0.05) -> DataFrame:
    """b = A wrong & B right, c = A right & B wrong; continuity-corrected
    chi-square; n = 0 -> (0, 1, false)."""
    ra, rb = F.col(a) == F.col(y_true), F.col(b) == F.col(y_true)
    cnt = preds.agg(F.count(F.when(~ra & rb, 1)).alias("b"), F.count(F.when(ra & ~rb, 1)).alias("c"))
    n = F.col("b") + F.col("c")
    stat = F.when(n == 0, F.lit(0.0)).otherwise(F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / n)
    out = cnt.withColumn("statistic", stat)
    out = out.withColumn("p_value", F.when(n == 0, F.lit(1.0)).otherwise(chi2_sf_udf("statistic", F.lit(1.0))))
    return out.withColumn("significant", F.col("p_value") < alpha)


def paired_differences(df: DataFrame, subject: str, condition: str, value: str,
                       first: str, second: str) -> DataFrame:
    """One row per subject with both conditions: (subject, a, b, d=a-b).
    A pivot with fixed values: one shuffle, no self join."""
    p = (df.groupBy(subject).pivot(condition, [first, second]).agg(F.first(value))
         .withColumnRenamed(first, "a").withColumnRenamed(second, "b"))
    return p.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("d", F.col("a") - F.col("b"))


def paired_t(diffs: DataFrame, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """t = mean(d) / (sd(d)/sqrt(n)), df = n-1, two-sided p. No spread or
    fewer than two pairs: t and p are NULL and nothing is significant."""
    s = diffs.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("mean_d"),
                               F.stddev_samp("d").alias("sd_d"))
    t = F.try_divide(F.col("mean_d"), F.try_divide(F.col("sd_d"), F.sqrt("n")))
    out = s.withColumn("t_statistic", t).withColumn("df", (F.col("n") - 1).cast("double"))
    out = out.withColumn("p_value", F.nanvl(t_p_udf("t_statistic", "df"), F.lit(None).cast("double")))
    return out.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def average_rank(value: str, partition: Sequence[str]) -> F.Column:
    """Average rank of ``value`` within ``partition`` (ties share the mean
    rank): rank() + (ties - 1)/2."""
    w = Window.partitionBy(*partition).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return F.rank().over(w) + (ties - 1) / 2.0


def ranked_counts(counts: DataFrame, value: str, n: str, by: Sequence[str], buckets: int = 64) -> DataFrame:
    """Adds ``upto``, the rows of a group up to each distinct value, to a table
    of distinct values with their numbers of rows ``n``. Sums run inside value
    buckets, so no group is sorted in one task."""
    checkpoint_dir(counts.sparkSession)
    # a struct: groups with a NULL key stay
    x = counts.withColumn("_g", F.struct(*by) if by else F.lit(0)).checkpoint()
    qs = [i / buckets for i in range(1, buckets)]
    cuts = x.groupBy(F.col("_g").alias("_g2")).agg(F.percentile_approx(value, qs, 10_000).alias("_cuts"))
    x = x.join(cuts, F.col("_g") == F.col("_g2")).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    return running_sum(x, ["_g"], [value], n, F.col("_b"), "upto").drop("_g", "_g2", "_cuts", "_b")


def friedman(df: DataFrame, block: str, treatment: str, score: str, alpha: float = 0.05) -> DataFrame:
    """Friedman chi-square over complete blocks with the tie correction.
    Ranks are taken within each block (a bounded group: one row per
    treatment). All ranks tied, no complete block or one treatment: statistic
    0, p 1."""
    k_tbl = df.agg(F.count_distinct(treatment).alias("k"))
    complete = (df.groupBy(block).agg(F.count(F.lit(1)).alias("_m"))
                .crossJoin(F.broadcast(k_tbl)).filter(F.col("_m") == F.col("k")).select(block))
    x = df.join(complete, block).withColumn("r", average_rank(score, [block]))
    ties = (x.groupBy(block, score).agg(F.count(F.lit(1)).alias("t"))
            .agg(F.sum(F.pow("t", 3) - F.col("t")).alias("tie_sum")))
    rsum = x.groupBy(treatment).agg(F.sum("r").alias("R"))
    agg = rsum.agg(F.sum(F.pow("R", 2)).alias("sum_r2"), F.count(F.lit(1)).alias("k"))
    nb = complete.agg(F.count(F.lit(1)).alias("n"))
    j = agg.crossJoin(nb).crossJoin(ties)
    n, k = F.col("n"), F.col("k")
    nd, kd = n.cast("double"), k.cast("double")
    raw = F.try_divide(F.lit(12.0), nd * kd * (kd + 1)) * F.col("sum_r2") - 3.0 * nd * (kd + 1)
    corr = 1.0 - F.try_divide(F.col("tie_sum"), nd * kd * (kd * kd - 1))
    # a correction of 0 (every block tied) is rounded to about 1e-16
    stat = F.when(F.abs(corr) < 1e-12, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(raw, corr), F.lit(0.0)))
    out = j.select("n", "k", stat.alias("statistic"))
    p = F.nanvl(chi2_sf_udf("statistic", F.greatest(F.col("k") - 1, F.lit(1)).cast("double")), F.lit(1.0))
    out = out.withColumn("p_value", p)
    return out.withColumn("significant", F.col("p_value") < alpha)


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(po - pe) / (1 - pe) for any number of classes; 1 when both raters use
    one and the same class throughout, NULL without rows."""
    cells = df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("c"))
    n = cells.agg(F.sum("c").alias("n"))
    po = cells.filter(F.col("_a") == F.col("_b")).agg(F.sum("c").alias("agree"))
    ma = cells.groupBy(F.col("_a").alias("cls")).agg(F.sum("c").alias("ra"))
    mb = cells.groupBy(F.col("_b").alias("cls")).agg(F.sum("c").alias("rb"))
    pe = ma.join(mb, "cls").agg(F.sum(F.col("ra").cast("double") * F.col("rb")).alias("pe_num"))
    j = n.crossJoin(po).crossJoin(pe)
    nd = F.col("n").cast("double")
    p_o = F.try_divide(F.coalesce(F.col("agree"), F.lit(0)), nd)
    p_e = F.try_divide(F.coalesce(F.col("pe_num"), F.lit(0.0)), nd * nd)
    return j.select(F.when(p_e == 1, F.lit(1.0)).otherwise(F.try_divide(p_o - p_e, 1 - p_e)).alias("kappa"))


def wilcoxon(diffs: DataFrame, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Signed-rank test: zero differences dropped, average ranks of |d|,
    W = min(W+, W-); p from the tie-corrected normal approximation (1 when
    its variance is 0). n is multiplied as a double."""
    by = list(by)
    x = diffs.filter(F.col("d") != 0).groupBy(*by, F.abs("d").alias("ad")) \
             .agg(F.count(F.lit(1)).alias("t"), F.count(F.when(F.col("d") > 0, 1)).alias("pos"))
    # ties share the mean of their ranks
    x = ranked_counts(x, "ad", "t", by).withColumn("r", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2.0)
    s = x.groupBy(*by).agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.sum(F.col("pos") * F.col("r")).alias("w_plus"),
                           F.sum((F.col("t") - F.col("pos")) * F.col("r")).alias("w_minus"),
                           F.sum(F.pow("t", 3) - F.col("t")).alias("tie_sum"))
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tie_sum") / 48.0
    out = s.withColumn("statistic", F.least("w_plus", "w_minus"))
    z = F.coalesce(F.try_divide(F.col("statistic") - mean, F.sqrt(F.greatest(var, F.lit(0.0)))), F.lit(0.0))
    out = out.withColumn("z", z).withColumn("p_value", F.least(F.lit(1.0), 2.0 * normal_sf_udf(F.abs(F.col("z")))))
    return out.drop("tie_sum").withColumn("significant", F.col("p_value") < alpha)


def shapiro_wilk(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Shapiro-Wilk W with Royston's coefficients and p approximation (its p
    is made for 3 <= n <= 5000; W is given for any n). Positions come from
    counts per distinct value, so no group is sorted in one task. Fewer than
    three rows or no spread: W and p are NULL."""
    by, block = list(by), 1000
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("x")) \
               .agg(F.count(F.lit(1)).alias("t"))
    x = ranked_counts(counts, "x", "t", by).withColumn("_g", F.struct(*by) if by else F.lit(0))
    sizes = x.groupBy(F.col("_g").alias("_g2")).agg(F.sum("t").alias("n"))
    # in blocks dealt anew, so that a common value's rows are not made in one task
    x = x.join(sizes, F.col("_g") == F.col("_g2")).withColumn("blk", F.explode(F.expr(f"sequence(0L, (t - 1) div {block})"))) \
         .repartition("_g", "x", "blk") \
         .withColumn("i", F.explode(F.expr(f"sequence(upto - t + 1 + blk * {block}, least(upto, upto - t + (blk + 1) * {block}))")))
    x = x.withColumn("m", inv_norm_udf((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    at = lambda i, c, name: F.max(F.when(F.col("i") == i, F.col(c))).alias(name)
    last = F.col("n")
    s = x.groupBy(*by).agg(F.first("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("ssm"), F.sum(F.col("m") * F.col("x")).alias("smx"),
                           at(last, "m", "mn"), at(last - 1, "m", "mn1"), at(1, "x", "x1"), at(2, "x", "x2"),
                           at(last - 1, "x", "xn1"), at(last, "x", "xn"), F.var_pop("x").alias("vp"))
    # Royston's polynomial corrections for the two extreme coefficients
    u = 1.0 / F.sqrt(F.col("n").cast("double"))
    an = (-2.706056 * F.pow(u, 5) + 4.434685 * F.pow(u, 4) - 2.071190 * F.pow(u, 3)
          - 0.147981 * F.pow(u, 2) + 0.221157 * u)
    an1 = (-3.582633 * F.pow(u, 5) + 5.682633 * F.pow(u, 4) - 1.752461 * F.pow(u, 3)
           - 0.293762 * F.pow(u, 2) + 0.042981 * u)
    a_n = an + F.try_divide(F.col("mn"), F.sqrt("ssm"))
    a_n1 = an1 + F.try_divide(F.col("mn1"), F.sqrt("ssm"))
    big = F.col("n") > 5
    outer, inner = F.col("xn") - F.col("x1"), F.col("xn1") - F.col("x2")
    eps = F.when(big, F.try_divide(F.col("ssm") - 2 * F.col("mn") ** 2 - 2 * F.col("mn1") ** 2, 1 - 2 * a_n ** 2 - 2 * a_n1 ** 2)) \
           .otherwise(F.try_divide(F.col("ssm") - 2 * F.col("mn") ** 2, 1 - 2 * a_n ** 2))
    # the coefficients are odd: the middle is what the extremes leave of the sum of m x
    middle = F.col("smx") - F.col("mn") * outer - F.when(big, F.col("mn1") * inner).otherwise(F.lit(0.0))
    num = F.when(F.col("n") == 3, F.lit(0.7071067811865476) * outer) \
           .otherwise(a_n * outer + F.when(big, a_n1 * inner).otherwise(F.lit(0.0)) + F.try_divide(middle, F.sqrt(eps)))
    w = F.when(F.col("n") >= 3, F.try_divide(F.pow(num, 2), F.col("vp") * F.col("n")))
    out = s.select(*by, "n", w.alias("w"))
    return out.withColumn("p_value", F.nanvl(shapiro_p_udf("w", F.col("n").cast("double")), F.lit(None).cast("double")))


def cohens_d(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """(mean_a - mean_b) / pooled sample SD; without spread, or with fewer than
    three values, the effect size is NULL."""
    s = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    a = s.filter(F.col(group) == first).select(F.col("n").alias("na"), F.col("m").alias("ma"), F.col("v").alias("va"))
    b = s.filter(F.col(group) == second).select(F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("v").alias("vb"))
    j = a.crossJoin(b)
    var = lambda v: F.coalesce(F.col(v), F.lit(0.0))  # noqa: E731  one value has no spread
    pooled = F.sqrt(F.try_divide((F.col("na") - 1) * var("va") + (F.col("nb") - 1) * var("vb"),
                                 (F.col("na") + F.col("nb") - 2).cast("double")))
    return j.select((F.col("ma") - F.col("mb")).alias("mean_diff"), pooled.alias("pooled_sd"),
                    F.try_divide(F.col("ma") - F.col("mb"), pooled).alias("cohens_d"))


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Equal-width bins over each group's [min, max]; the max falls in the
    last bin (numpy semantics). Returns (by..., bin, lo, hi, n)."""
    by = list(by)
    rng = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = df.join(rng, by) if by else df.crossJoin(F.broadcast(rng))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(
        F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    h = x.withColumn("bin", b).groupBy(*by, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    return h.select(*by, "bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("hi"), "n")
