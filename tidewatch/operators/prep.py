"""Cleaning, feature extraction, scaling, selection, sampling and splits.

Fitted parameters (medians, means, bounds) are one-row DataFrames joined
back with a broadcast cross join: a proven one-row size, and the whole
operator stays one lazy plan with no driver round trip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.quantiles import few, medians_row, to_long
from ..session import checkpoint_dir
from .scan import SEGMENT_ROWS, global_row_number, halo_segments, running_sum


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


# -- D1 / D2 ----------------------------------------------------------------
def dedupe(df: DataFrame) -> DataFrame:
    """Full-row duplicates (NULL = NULL, NaN = NaN, 0.0 = -0.0)."""
    return df.dropDuplicates()


def nonfinite_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN and +-inf become NULL; numeric columns become DOUBLE."""
    def fix(c):
        x = F.col(c).cast("double")
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x).alias(c)
    cs = set(cols)
    return df.select(*[fix(c) if c in cs else F.col(c) for c in df.columns])


# -- D3 ---------------------------------------------------------------------
def median_impute(df: DataFrame, cols: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Fill NULLs with the column's exact median (nulls skipped)."""
    if not cols:
        return df
    med = medians_row(df, cols, accuracy).select(*[F.col(c).alias(f"_med_{c}") for c in cols])
    cs = set(cols)
    joined = df.crossJoin(F.broadcast(med))
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_med_{c}")).alias(c) if c in cs else F.col(c)
                           for c in df.columns])


# -- D4 ---------------------------------------------------------------------
def category_dictionary(df: DataFrame, cols: Sequence[str], missing: str = "missing") -> DataFrame:
    """(c_name, value, code): codes 0..k-1 by binary order of the distinct
    values, NULL counted as ``missing``. Distinct values of all columns are
    sorted once (range-partitioned) and numbered globally, so even a
    high-cardinality column is never ranked inside one task."""
    vals = (df.select(*[F.coalesce(F.col(c), F.lit(missing)).alias(c) for c in cols])
            .unpivot([], list(cols), "c_name", "value").distinct())
    d = global_row_number(vals, ["c_name", "value"], "idx")
    start = d.groupBy("c_name").agg(F.min("idx").alias("_start"))
    return d.join(F.broadcast(start), "c_name").select(
        "c_name", "value", (F.col("idx") - F.col("_start")).alias("code"))


def category_encode(df: DataFrame, cols: Sequence[str], missing: str = "missing",
                    dictionary: DataFrame | None = None) -> DataFrame:
    d = dictionary if dictionary is not None else category_dictionary(df, cols, missing)
    out = df
    for c in cols:
        m = d.filter(F.col("c_name") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_code_{c}"))
        out = (out.join(m, F.coalesce(F.col(c), F.lit(missing)) == F.col(f"_v_{c}"), "left")
               .withColumn(c, F.col(f"_code_{c}").cast("int")).drop(f"_v_{c}", f"_code_{c}"))
    return out.select(*df.columns)


def clean(df: DataFrame, exclude: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Dedupe, then non-finite -> NULL, median impute numerics, category-code
    strings (columns in ``exclude`` are left alone)."""
    d = dedupe(df)
    num = numeric_columns(d, exclude)
    cat = string_columns(d, exclude)
    d = nonfinite_to_null(d, num)
    d = median_impute(d, num, accuracy)
    return category_encode(d, cat) if cat else d


# -- D6 / D7 ----------------------------------------------------------------
def flow_features(df: DataFrame, flow_id: str = "flow_id", ts: str = "timestamp",
                  length: str = "packet_length") -> DataFrame:
    """Per-flow count of timestamps, byte sum and mean packet size broadcast to
    every row. A grouped aggregate joined back (not an unordered window): the
    aggregate combines map-side and AQE splits a hot flow on the join."""
    agg = df.groupBy(flow_id).agg(
        F.count(ts).alias("packet_rate"),
        F.coalesce(F.sum(length), F.lit(0.0)).cast("double").alias("byte_rate"),
        F.avg(length).alias("mean_packet_size"))
    return df.join(agg.filter(F.col(flow_id).isNotNull()), flow_id, "left")


def port_mean_features(df: DataFrame, port: str = "dst_port", length: str | None = "packet_length",
                       fwd: str | None = None, bwd: str | None = None,
                       pkt_rate: str | None = None, byte_rate: str | None = None) -> DataFrame:
    """Fallback branch: packet length (given, else fwd+bwd, else 0), rates
    copied (else 0), mean length per destination port, NULL -> global median."""
    if length and length in df.columns:
        pl = F.col(length)
    elif fwd and bwd and fwd in df.columns and bwd in df.columns:
        pl = F.col(fwd) + F.col(bwd)
    else:
        pl = F.lit(0.0)
    x = df.withColumn("_pl", pl.cast("double"))
    per_port = x.groupBy(port).agg(F.avg("_pl").alias("_port_mean"))
    med = medians_row(x, ["_pl"]).select(F.col("_pl").alias("_pl_median"))
    out = (x.join(per_port.filter(F.col(port).isNotNull()), port, "left")
           .crossJoin(F.broadcast(med))
           .withColumn("packet_rate", F.col(pkt_rate).cast("double") if pkt_rate in df.columns else F.lit(0.0))
           .withColumn("byte_rate", F.col(byte_rate).cast("double") if byte_rate in df.columns else F.lit(0.0))
           .withColumn("mean_packet_size", F.coalesce("_port_mean", "_pl_median")))
    return out.drop("_pl", "_port_mean", "_pl_median")


def extract_features(df: DataFrame) -> DataFrame:
    """The flow branch when the table has flow ids, timestamps and packet
    lengths, else the port branch with what there is of packet lengths and
    rates (chosen from the columns when the plan is built)."""
    has = {c.lower() for c in df.columns}
    if {"flow_id", "timestamp", "packet_length"} <= has:
        return flow_features(df)
    named = lambda *names: next((n for n in names if n in has), None)
    return port_mean_features(df, named("dst_port", "destination_port"), named("packet_length"),
                              named("total_length_of_fwd_packets"), named("total_length_of_bwd_packets"),
                              named("flow_packets_s"), named("flow_bytes_s"))


# -- D8 / D9 / D10 ----------------------------------------------------------
def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "zscore") -> DataFrame:
    """One-row parameter table. zscore: mean and population std; minmax:
    min and max. Persist it with ``write.parquet`` to reuse (fit=False)."""
    if method == "zscore":
        aggs = [e for c in cols for e in (F.avg(c).alias(f"{c}__a"), F.stddev_pop(c).alias(f"{c}__b"))]
    elif method == "minmax":
        aggs = [e for c in cols for e in (F.min(c).cast("double").alias(f"{c}__a"),
                                          F.max(c).cast("double").alias(f"{c}__b"))]
    else:
        raise ValueError(method)
    return df.agg(*aggs).withColumn("_method", F.lit(method))


def apply_scaler(df: DataFrame, params: DataFrame, cols: Sequence[str], method: str = "zscore") -> DataFrame:
    """zscore: (x-mean)/std with std 0 -> 1; minmax: (x-min)/(max-min), constant -> 0."""
    j = df.crossJoin(F.broadcast(params.drop("_method")))
    cs = set(cols)

    def scaled(c):
        a, b = F.col(f"{c}__a"), F.col(f"{c}__b")
        if method == "zscore":
            return ((F.col(c) - a) / F.when(b == 0, 1.0).otherwise(b)).alias(c)
        rng = b - a
        return F.when(rng == 0, F.lit(0.0)).otherwise((F.col(c) - a) / rng).alias(c)
    return j.select(*[scaled(c) if c in cs else F.col(c) for c in df.columns])


def normalize(df: DataFrame, cols: Sequence[str], method: str = "zscore",
              params: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    p = params if params is not None else fit_scaler(df, cols, method)
    return apply_scaler(df, p, cols, method), p


# -- D11 --------------------------------------------------------------------
def binned_mutual_info(df: DataFrame, cols: Sequence[str], label: str = "label", bins: int = 10,
                       binning: str = "width", accuracy: int = 10_000) -> DataFrame:
    """Mutual information (nats) between each binned feature and the label:
    (feature, mi). Features are unpivoted once; one groupBy gives all joint
    counts. ``width``: equal-width bins over [min, max]; ``quantile``: bins at
    approximate quantiles (skew-robust)."""
    long = to_long(df, cols, [label])
    if binning == "width":
        rng = long.groupBy("c_name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        b = (long.join(F.broadcast(rng), "c_name")
             .withColumn("bin", F.when(F.col("hi") == F.col("lo"), 0).otherwise(
                 F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))))
    else:
        qs = [i / bins for i in range(1, bins)]
        cuts = (long.groupBy("c_name").agg(F.percentile_approx("v", qs, accuracy).alias("cuts")))
        b = (long.join(F.broadcast(cuts), "c_name")
             .withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("v")))))
    joint = b.groupBy("c_name", "bin", label).agg(F.count(F.lit(1)).alias("nxy"))
    w_f = Window.partitionBy("c_name")
    w_x = Window.partitionBy("c_name", "bin")
    w_y = Window.partitionBy("c_name", label)
    j = (joint.withColumn("n", F.sum("nxy").over(w_f))
         .withColumn("nx", F.sum("nxy").over(w_x))
         .withColumn("ny", F.sum("nxy").over(w_y)))
    term = (F.col("nxy") / F.col("n")) * F.log((F.col("nxy").cast("double") * F.col("n")) / (F.col("nx").cast("double") * F.col("ny")))
    return j.groupBy(F.col("c_name").alias("feature")).agg(F.sum(term).alias("mi"))


def digamma(x):
    """Digamma of a column of numbers >= 1: the asymptotic series at x + 6,
    error below 1e-10."""
    y = x.cast("double") + 6
    z = 1 / (y * y)
    series = F.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))
    for i in range(6):
        series = series - 1 / (x.cast("double") + i)
    return series


def neighbour_mutual_info(df: DataFrame, cols: Sequence[str], label: str = "label", k: int = 3,
                          segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Mutual information (nats) between each continuous feature and the
    label by nearest neighbours (Ross 2014), without binning: (feature, mi).

    A row's radius is the distance to its ``k``-th neighbour of the same class
    (``n - 1``-th in a class of ``n <= k`` rows; classes of one row are left out).
    It is compared with the rows of any class nearer than that, ``v - r < u <
    v + r`` in doubles, or equal to it where the radius is 0, itself included.

    Rows are first counted per distinct (feature, class, value). ``k + 1`` copies
    of a value settle every radius, which is then a window of ``k`` rows on
    either side over segments of the order with halos; rows inside a radius are
    the difference of two running counts over the ordered values. So neither a
    frequent value, a large class nor one feature fills a task. Null, NaN and
    infinite values are left out; a null label is a class."""
    long = to_long(df, cols, [label]).where(F.abs("v") < F.lit(float("inf")))
    long = long.select("c_name", F.col(label).alias("_class"), (F.col("v") + 0.0).alias("v"))
    counts = long.groupBy("c_name", "_class", "v").agg(F.count(F.lit(1)).alias("_n"))
    # a row per feature and class
    classes = counts.groupBy("c_name", "_class").agg(F.sum("_n").alias("_size")).where("_size > 1")
    sized = classes.select(F.col("c_name").alias("_f"), F.col("_class").alias("_c"), "_size")
    points = (counts.join(sized, (F.col("c_name") == F.col("_f")) & F.col("_class").eqNullSafe(F.col("_c")))
              .drop("_f", "_c").withColumn("_k", F.least(F.lit(k), F.col("_size") - 1)))
    copies = points.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(k + 1)).cast("int"))))
    x = halo_segments(copies, ["c_name", "_class", "v", "_copy"], k, segment_rows, after=k)
    w = Window.partitionBy("_seg", "c_name", "_class").orderBy("_pos")

    def radius(m: int):
        # the m nearest others lie in one of the m + 1 runs of m + 1 rows around the row
        spans = [F.when(F.lead("v", m - j).over(w).isNotNull() & F.lag("v", j).over(w).isNotNull(),
                        F.greatest(F.col("v") - F.lag("v", j).over(w), F.lead("v", m - j).over(w) - F.col("v"))) for j in range(m + 1)]
        return F.least(*spans)

    r = F.coalesce(*[F.when(F.col("_k") == m, radius(m)) for m in range(1, k + 1)], F.lit(None).cast("double"))
    x = x.withColumn("_r", r).where(~F.col("_halo") & (F.col("_copy") == 1)).select("c_name", "_class", "v", "_n", "_r")
    tied = F.col("_r") == 0
    # kind 0 lies before the values equal to it, kind 2 behind them
    event = lambda at, kind, sign, n: F.struct(at.alias("at"), kind.cast("int").alias("kind"), F.lit(sign).alias("sign"), n.cast("bigint").alias("rows"))
    events = x.select("c_name", "_class", "v", "_n", F.explode(F.array(
        event(F.col("v"), F.lit(1), 0, F.col("_n")),
        event(F.col("v") + F.col("_r"), F.when(tied, 2).otherwise(0), 1, F.lit(0)),
        event(F.col("v") - F.col("_r"), F.when(tied, 0).otherwise(2), -1, F.lit(0)))).alias("e")).select("c_name", "_class", "v", "_n", "e.*")
    ordered = global_row_number(events, ["c_name", "at", "kind", "_class", "v"], "_at")
    run = running_sum(ordered, ["c_name"], ["_at"], "rows", F.floor(F.col("_at") / segment_rows), "_run")
    near = run.groupBy("c_name", "_class", "v", "_n").agg(F.sum(F.col("sign") * F.col("_run")).alias("_m"))
    around = near.groupBy("c_name").agg(F.sum(F.col("_n") * digamma(F.col("_m"))).alias("_near"), F.sum("_n").alias("_all"))
    within = classes.groupBy("c_name").agg(F.sum(F.col("_size") * (digamma(F.least(F.lit(k), F.col("_size") - 1)) - digamma(F.col("_size")))).alias("_own"))
    mi = digamma(F.col("_all")) + (F.col("_own") - F.col("_near")) / F.col("_all")
    return around.join(within, "c_name").select(F.col("c_name").alias("feature"), F.greatest(mi, F.lit(0.0)).alias("mi"))


def select_k_best(mi: DataFrame, k: int) -> DataFrame:
    """Top-k features by MI (ties by name)."""
    return mi.orderBy(F.desc("mi"), F.asc("feature")).limit(k)


# -- D13 / D14 / D15 --------------------------------------------------------
def hash_score(id_col: str, seed: int = 42):
    """Deterministic uniform score in [0, 1) from md5(seed:id) (same in DuckDB)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 15), 16, 10)
    return h.cast("double") / float(16 ** 15)


def stratified_split(df: DataFrame, label: str, id_col: str, test_frac: float = 0.15, seed: int = 42,
                     accuracy: int = 10_000) -> DataFrame:
    """Adds ``is_test``: in every class exactly round(test_frac * n_class)
    rows (by smallest hash score) go to test. The per-class cut is an exact
    rank found by the distributed quantile search, so no class is ever
    gathered into one task."""
    x = df.withColumn("_score", hash_score(id_col, seed))
    long = x.select(F.col(label), F.col("_score").alias("v"))
    cuts = _rank_values(long, label, test_frac, accuracy).withColumnRenamed(label, "_cut_class")
    return x.join(few(cuts), F.col(label).eqNullSafe(F.col("_cut_class")), "left").withColumn(
        "is_test", F.coalesce(F.col("_score") <= F.col("_cut"), F.lit(False))).drop("_score", "_cut", "_cut_class")


def _brackets(long: DataFrame, label: str, rank, frac: float, accuracy: int) -> DataFrame:
    """``_class, _n, _r, L, H``: per class its rows and values around the
    rank; NULL is a class like any other."""
    eps = 1.0 / accuracy
    lo_q, hi_q = max(frac - 3 * eps, 0.0), min(frac + 3 * eps, 1.0)
    br = long.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("v", [lo_q, hi_q], accuracy).alias("_br"))
    return (br.withColumn("_r", rank)
            .withColumn("L", F.when(F.col("_n") <= 2 * accuracy, float("-inf")).otherwise(F.col("_br")[0]))
            .withColumn("H", F.when(F.col("_n") <= 2 * accuracy, float("inf")).otherwise(F.col("_br")[1]))
            .drop("_br"))


def _rank_values(long: DataFrame, label: str, frac: float, accuracy: int) -> DataFrame:
    meta = few(_brackets(long, label, (F.round(F.col("_n") * frac) - 1).cast("bigint"), frac, accuracy))
    # one pass: rows below the bracket are counted under NULL, those inside by value
    inside = (F.col("v") >= F.col("L")) & (F.col("v") <= F.col("H"))
    seen = (long.join(meta, F.col(label).eqNullSafe(F.col("_class"))).filter(F.col("v") <= F.col("H"))
            .groupBy("_class", "_r", F.when(inside, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("_cnt")))
    hit = _at_rank(seen)
    cuts = hit.select(F.col("_class").alias("_hit_class"), F.col("v").alias("_cut"))
    # classes whose share rounds to zero rows get no cut (nothing in test); any
    # other class without one is an error
    missed = F.raise_error(F.lit("a class's rank lies outside its bracket")).cast("double")
    return meta.join(cuts, F.col("_class").eqNullSafe(F.col("_hit_class")), "left") \
               .select(F.col("_class").alias(label), F.when(F.col("_r") < 0, F.lit(-1.0)).otherwise(F.coalesce("_cut", missed)).alias("_cut"))


def _at_rank(seen: DataFrame) -> DataFrame:
    """The value of rank ``_r`` per class, from the counts of the values."""
    w = Window.partitionBy("_class").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = seen.withColumn("_last", F.sum("_cnt").over(w) - 1).withColumn("_first", F.col("_last") - F.col("_cnt") + 1)
    return r.filter(F.col("v").isNotNull() & (F.col("_first") <= F.col("_r")) & (F.col("_r") <= F.col("_last")))


def exact_sample(df: DataFrame, id_col: str, n: int, seed: int = 42, accuracy: int = 10_000) -> DataFrame:
    """Exactly ``n`` rows, uniform by hash score, with no top-n funnel through
    one task: one pass brackets the score of rank n-1, a second one keeps the
    rows up to the bracket (``n`` and a few in 10,000 of all), and the rank is
    found among those. Rows that share the last score are told apart by id. The
    row count is one cheap action."""
    total = df.count()
    if n >= total:
        return df
    x = df.withColumn("_score", hash_score(id_col, seed)).withColumn("_all", F.lit(0))
    long = x.select("_all", F.col("_score").alias("v"))
    meta = few(_brackets(long, "_all", F.lit(n - 1).cast("bigint"), n / total, accuracy).select("_class", "_r", "H"))
    kept = x.join(meta, F.col("_all") == F.col("_class")).filter(F.col("_score") <= F.col("H")).checkpoint()
    cut = _at_rank(kept.groupBy("_class", "_r", F.col("_score").alias("v")).agg(F.count(F.lit(1)).alias("_cnt")))
    missed = F.raise_error(F.lit("the sample's rank lies outside its bracket")).cast("double")
    near = kept.crossJoin(F.broadcast(cut.agg(F.coalesce(F.max("v"), missed).alias("_cut"))))   # one row
    below = near.filter(F.col("_score") < F.col("_cut"))
    room = below.agg((F.lit(n) - F.count(F.lit(1))).alias("_room"))
    # scores are 53 bits of a hash: a handful of rows share the last one
    last = near.filter(F.col("_score") == F.col("_cut")) \
               .withColumn("_rank", F.row_number().over(Window.partitionBy("_all").orderBy(id_col))) \
               .crossJoin(F.broadcast(room)).filter(F.col("_rank") <= F.col("_room")).drop("_rank", "_room")
    return below.unionByName(last).select(*df.columns)


def stratified_pick(df: DataFrame, label: str, id_col: str, per_class: int, seed: int = 42,
                    salt_buckets: int = 64) -> DataFrame:
    """``per_class`` rows per class, smallest hash score first, with
    ``pick_rank``. Two-stage top-n: first per (class, salt) so a big class is
    spread over ``salt_buckets`` tasks, then per class over at most
    ``per_class * salt_buckets`` survivors."""
    x = (df.withColumn("_score", hash_score(id_col, seed))
         .withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salt_buckets))))
    w1 = Window.partitionBy(label, "_salt").orderBy("_score", id_col)
    pre = x.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= per_class)
    w2 = Window.partitionBy(label).orderBy("_score", id_col)
    return (pre.withColumn("pick_rank", F.row_number().over(w2)).filter(F.col("pick_rank") <= per_class)
            .drop("_score", "_salt", "_r1"))


# -- D16 --------------------------------------------------------------------
def sequence_windows(df: DataFrame, entity: str, order: Sequence[str], features: Sequence[str],
                     label: str, length: int = 20, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Sliding windows of ``length`` rows per entity: (entity, order keys of
    the last row, seq ARRAY<ARRAY<DOUBLE>>, label of the last row). Only full
    windows are kept. Rows are cut into segments of the order (entity,
    ``order``) with the ``length - 1`` rows before each, so a busy entity is
    no single task's sort."""
    vec = F.array(*[F.col(c).cast("double") for c in features])
    narrow = df.select(F.col(entity).alias("_entity"), *order, vec.alias("_vec"), F.col(label).alias("label"))
    x = halo_segments(narrow, ["_entity", *order], length - 1, segment_rows)
    w = Window.partitionBy("_seg", "_entity").orderBy("_pos").rowsBetween(-(length - 1), Window.currentRow)
    return (x.withColumn("seq", F.collect_list("_vec").over(w))
            .filter(~F.col("_halo") & (F.size("seq") == length))
            .select(F.col("_entity").alias(entity), *order, "seq", "label"))
