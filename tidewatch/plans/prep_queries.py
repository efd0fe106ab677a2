"""Preparation operators (D*, P*, U*, A1) over flows derived from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import cic_label, unsw_label
from ..operators import prep
from ..sources.tables import table
from ..sources.views import flows
from .common import r6, rnd
from .registry import register
from .sql_views import FLOWS_CTE

WF = f"WITH {FLOWS_CTE}"
NUM = ["quantity", "price", "discount", "tax"]

# Dirty copy of the flows: missing quantity on line 4, +inf price on line 5,
# NaN discount on line 6, -inf tax on line 7 (exercises D2/D3).
DIRTY_SQL = """dirty AS (
  SELECT row_id, dst_port, label,
         CASE WHEN line = 4 THEN NULL ELSE quantity END AS quantity,
         CASE WHEN line = 5 THEN 'inf'::DOUBLE ELSE price END AS price,
         CASE WHEN line = 6 THEN 'nan'::DOUBLE ELSE discount END AS discount,
         CASE WHEN line = 7 THEN '-inf'::DOUBLE ELSE tax END AS tax
  FROM flows)"""


def dirty_flows(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.select(
        "row_id", "dst_port", "label",
        F.when(F.col("line") == 4, F.lit(None).cast("double")).otherwise(F.col("quantity")).alias("quantity"),
        F.when(F.col("line") == 5, F.lit(float("inf"))).otherwise(F.col("price")).alias("price"),
        F.when(F.col("line") == 6, F.lit(float("nan"))).otherwise(F.col("discount")).alias("discount"),
        F.when(F.col("line") == 7, F.lit(float("-inf"))).otherwise(F.col("tax")).alias("tax"))


@register("class_balance", sql=f"""{WF}
SELECT count(*) AS total, count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 1) AS attack,
       ROUND(avg(label), 6) AS attack_share FROM flows""")
def class_balance(spark, sf_dir):
    """The scan is pruned to the one column the label needs."""
    f = flows(spark, sf_dir).select("label")
    return f.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("label") == 0, 1)).alias("benign"),
                 F.count(F.when(F.col("label") == 1, 1)).alias("attack"), r6(F.avg("label"), "attack_share"))


@register("label_map", sql="""WITH src AS (
  SELECT 'cic' AS source, CASE WHEN ' ' || CASE WHEN l_returnflag = 'N' THEN 'BENIGN' ELSE 'DoS' END || ' ' IS NULL
         THEN NULL ELSE trim(' ' || CASE WHEN l_returnflag = 'N' THEN 'BENIGN' ELSE 'DoS' END || ' ') END AS raw
  FROM lineitem
  UNION ALL
  SELECT 'unsw', CASE WHEN l_linestatus = 'O' THEN ' Normal' ELSE 'Exploits' END FROM lineitem)
SELECT source, CASE WHEN source = 'cic' THEN (CASE WHEN trim(raw) = 'BENIGN' THEN 0 ELSE 1 END)
                    ELSE (CASE WHEN lower(trim(raw)) = 'normal' THEN 0 ELSE 1 END) END AS label,
       count(*) AS n
FROM src GROUP BY ALL""")
def label_map(spark, sf_dir):
    """CIC text labels (BENIGN -> 0) and UNSW categories (normal -> 0)."""
    li = table(spark, sf_dir, "lineitem")
    cic = li.select(F.lit("cic").alias("source"),
                    F.concat(F.lit(" "), F.when(F.col("l_returnflag") == "N", "BENIGN").otherwise("DoS"),
                             F.lit(" ")).alias("raw")).withColumn("label", cic_label("raw"))
    unsw = li.select(F.lit("unsw").alias("source"),
                     F.when(F.col("l_linestatus") == "O", " Normal").otherwise("Exploits").alias("raw")
                     ).withColumn("label", unsw_label("raw"))
    return cic.unionByName(unsw).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


@register("union_sources", sql="""
SELECT 'orders' AS source, o_orderkey AS id, o_custkey AS cust, ROUND(o_totalprice, 6) AS amount,
       o_orderpriority AS priority, CAST(NULL AS VARCHAR) AS segment FROM orders
UNION ALL
SELECT 'customer', c_custkey, CAST(NULL AS BIGINT), ROUND(c_acctbal, 6), CAST(NULL AS VARCHAR), c_mktsegment
FROM customer""")
def union_sources(spark, sf_dir):
    """Union by name with missing columns filled with NULL."""
    o = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"),
        r6("o_totalprice", "amount"), F.col("o_orderpriority").alias("priority"))
    c = table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), r6("c_acctbal", "amount"),
        F.col("c_mktsegment").alias("segment"))
    return o.unionByName(c, allowMissingColumns=True)


@register("clean_dedupe", sql="""
SELECT DISTINCT l_suppkey AS dst_port, l_returnflag AS attack_cat, l_linestatus AS status, l_tax AS tax
FROM lineitem""")
def clean_dedupe(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("dst_port"), F.col("l_returnflag").alias("attack_cat"),
        F.col("l_linestatus").alias("status"), F.col("l_tax").alias("tax"))
    return prep.dedupe(li)


@register("median_impute", sql=f"""{WF}, {DIRTY_SQL},
fin AS (SELECT row_id,
        CASE WHEN isnan(quantity) OR isinf(quantity) THEN NULL ELSE quantity END AS quantity,
        CASE WHEN isnan(price) OR isinf(price) THEN NULL ELSE price END AS price,
        CASE WHEN isnan(discount) OR isinf(discount) THEN NULL ELSE discount END AS discount,
        CASE WHEN isnan(tax) OR isinf(tax) THEN NULL ELSE tax END AS tax FROM dirty),
med AS (SELECT median(quantity) AS mq, median(price) AS mp, median(discount) AS md, median(tax) AS mt FROM fin)
SELECT ROUND(mq, 6) AS med_quantity, ROUND(mp, 6) AS med_price, ROUND(md, 6) AS med_discount,
       ROUND(mt, 6) AS med_tax,
       ROUND(sum(coalesce(quantity, mq)), 4) AS sum_quantity, CAST(sum(round(coalesce(price, mp) * 100)) AS BIGINT) AS sum_price_cents,
       ROUND(sum(coalesce(discount, md)), 4) AS sum_discount, ROUND(sum(coalesce(tax, mt)), 4) AS sum_tax
FROM fin, med GROUP BY mq, mp, md, mt""")
def median_impute(spark, sf_dir):
    """D2 + D3: non-finite -> NULL, then exact-median imputation."""
    d = prep.nonfinite_to_null(dirty_flows(spark, sf_dir), NUM)
    from ..functions.quantiles import medians_row
    med = medians_row(d, NUM)
    filled = prep.median_impute(d, NUM)
    sums = filled.agg(rnd(F.sum("quantity"), 4).alias("sum_quantity"), F.sum(F.round(F.col("price") * 100, 0)).cast("bigint").alias("sum_price_cents"),
                      rnd(F.sum("discount"), 4).alias("sum_discount"), rnd(F.sum("tax"), 4).alias("sum_tax"))
    return med.select(*[r6(c, f"med_{c}") for c in NUM]).crossJoin(sums)


CATS_SQL = """src AS (
  SELECT o_orderpriority AS priority,
         CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderstatus END AS status FROM orders)"""


@register("category_codes", sql=f"""WITH {CATS_SQL},
long AS (SELECT 'priority' AS c_name, coalesce(priority, 'missing') AS value FROM src
         UNION ALL SELECT 'status', coalesce(status, 'missing') FROM src),
d AS (SELECT c_name, value, count(*) AS n FROM long GROUP BY ALL)
SELECT c_name, value, CAST(dense_rank() OVER (PARTITION BY c_name ORDER BY value) - 1 AS INTEGER) AS code, n FROM d""")
def category_codes(spark, sf_dir):
    """Codes by sorted distinct value, NULL -> 'missing'; then the encoded
    table is counted per code to check the join back."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderpriority").like("5%"), F.lit(None).cast("string"))
        .otherwise(F.col("o_orderstatus")).alias("status"))
    cols = ["priority", "status"]
    d = prep.category_dictionary(o, cols)
    enc = prep.category_encode(o, cols, dictionary=d)
    counts = (enc.unpivot([], cols, "c_name", "code").groupBy("c_name", "code").agg(F.count(F.lit(1)).alias("n")))
    return d.withColumn("code", F.col("code").cast("int")).join(counts, ["c_name", "code"]).select(
        "c_name", "value", "code", "n")


@register("flow_features", sql=f"""{WF},
g AS (SELECT flow_id, count("timestamp") AS packet_rate, coalesce(sum(packet_length), 0) AS byte_rate,
             avg(packet_length) AS mean_packet_size FROM flows GROUP BY flow_id)
SELECT row_id, packet_rate, ROUND(byte_rate, 6) AS byte_rate, ROUND(mean_packet_size, 6) AS mean_packet_size
FROM flows LEFT JOIN g USING (flow_id)""")
def flow_features(spark, sf_dir):
    f = prep.flow_features(flows(spark, sf_dir))
    return f.select("row_id", "packet_rate", r6("byte_rate", "byte_rate"), r6("mean_packet_size", "mean_packet_size"))


@register("port_mean_features", sql=f"""{WF},
g AS (SELECT dst_port, avg(packet_length) AS m FROM flows GROUP BY dst_port),
med AS (SELECT median(packet_length) AS med FROM flows)
SELECT row_id, 0.0 AS packet_rate, 0.0 AS byte_rate, ROUND(coalesce(m, med), 6) AS mean_packet_size
FROM flows LEFT JOIN g USING (dst_port), med""")
def port_mean_features(spark, sf_dir):
    f = prep.port_mean_features(flows(spark, sf_dir))
    return f.select("row_id", "packet_rate", "byte_rate", r6("mean_packet_size", "mean_packet_size"))


def _scaled_sql(method: str) -> str:
    if method == "zscore":
        params = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}" for c in NUM)
        cols = ", ".join(f"ROUND(({c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END, 6) + 0.0 AS {c}" for c in NUM)
    else:
        params = ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in NUM)
        cols = ", ".join(f"ROUND(CASE WHEN b_{c} = a_{c} THEN 0.0 ELSE ({c} - a_{c}) / (b_{c} - a_{c}) END, 6) AS {c}"
                         for c in NUM)
    return f"{WF}, p AS (SELECT {params} FROM flows) SELECT row_id, {cols} FROM flows, p"


@register("zscore", sql=_scaled_sql("zscore"))
def zscore(spark, sf_dir):
    """Population std; zero std divides by 1."""
    f = flows(spark, sf_dir).select("row_id", *NUM)
    out, _ = prep.normalize(f, NUM, "zscore")
    return out.select("row_id", *[r6(c, c) for c in NUM])


@register("minmax", sql=_scaled_sql("minmax"))
def minmax(spark, sf_dir):
    """Constant column -> 0."""
    f = flows(spark, sf_dir).select("row_id", *NUM)
    out, _ = prep.normalize(f, NUM, "minmax")
    return out.select("row_id", *[r6(c, c) for c in NUM])


@register("binned_mutual_info", sql=f"""{WF},
long AS (UNPIVOT (SELECT label, quantity, price, discount, tax FROM flows) ON quantity, price, discount, tax
         INTO NAME c_name VALUE v),
rng AS (SELECT c_name, min(v) AS lo, max(v) AS hi FROM long GROUP BY c_name),
b AS (SELECT c_name, label, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / (hi - lo) * 10), 9) END AS bin
      FROM long JOIN rng USING (c_name)),
j AS (SELECT c_name, bin, label, count(*) AS nxy FROM b GROUP BY ALL),
m AS (SELECT *, sum(nxy) OVER (PARTITION BY c_name) AS n, sum(nxy) OVER (PARTITION BY c_name, bin) AS nx,
             sum(nxy) OVER (PARTITION BY c_name, label) AS ny FROM j)
SELECT c_name AS feature, ROUND(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS mi FROM m GROUP BY c_name""")
def binned_mutual_info(spark, sf_dir):
    """MI between 10 equal-width bins of each feature and the label."""
    mi = prep.binned_mutual_info(flows(spark, sf_dir), NUM, "label", bins=10)
    return mi.select("feature", r6("mi", "mi"))


def _digamma_sql(x: str) -> str:
    # by the recurrence from x + 20, where three terms suffice
    down = " + ".join(f"1.0 / ({x} + {i})" for i in range(20))
    return f"(ln({x} + 20.0) - 0.5 / ({x} + 20.0) - 1.0 / (12.0 * pow({x} + 20.0, 2)) + 1.0 / (120.0 * pow({x} + 20.0, 4)) - ({down}))"


NEIGHBOUR_MI_SQL = f"""{WF},
long AS (UNPIVOT (SELECT label, CAST(quantity AS DOUBLE) AS quantity, CAST(price AS DOUBLE) AS price,
                         CAST(discount AS DOUBLE) AS discount, CAST(tax AS DOUBLE) AS tax FROM flows)
         ON quantity, price, discount, tax INTO NAME c_name VALUE v),
sides AS (SELECT *, lag(v, 1) OVER w AS b1, lag(v, 2) OVER w AS b2, lag(v, 3) OVER w AS b3, lead(v, 1) OVER w AS a1,
                 lead(v, 2) OVER w AS a2, lead(v, 3) OVER w AS a3, count(*) OVER (PARTITION BY c_name, label) AS size
          FROM long WINDOW w AS (PARTITION BY c_name, label ORDER BY v)),
rad AS (SELECT c_name, v, size, list_sort([v - b1, v - b2, v - b3, a1 - v, a2 - v, a3 - v], 'ASC', 'NULLS LAST')[3] AS r FROM sides),
cum AS (SELECT c_name, v, sum(count(*)) OVER (PARTITION BY c_name ORDER BY v) AS upto FROM long GROUP BY c_name, v),
hi AS (SELECT q.*, cum.upto AS h FROM (SELECT *, CASE WHEN r = 0 THEN v ELSE v + r END AS top FROM rad) q ASOF JOIN cum
       ON q.c_name = cum.c_name AND q.top >= cum.v),
eq AS (SELECT hi.*, h - CASE WHEN r > 0 THEN coalesce(e.n, 0) ELSE 0 END AS below_top FROM hi LEFT JOIN
       (SELECT c_name, v, count(*) AS n FROM long GROUP BY c_name, v) e ON e.c_name = hi.c_name AND e.v = hi.top),
lo AS (SELECT eq.*, below_top - coalesce(cum.upto, 0) + CASE WHEN r = 0 THEN coalesce(e.n, 0) ELSE 0 END AS m
       FROM (SELECT *, CASE WHEN r = 0 THEN v ELSE v - r END AS bottom FROM eq) eq ASOF LEFT JOIN cum
       ON eq.c_name = cum.c_name AND eq.bottom >= cum.v
       LEFT JOIN (SELECT c_name, v, count(*) AS n FROM long GROUP BY c_name, v) e ON e.c_name = eq.c_name AND e.v = eq.v),
mi AS (SELECT c_name AS feature, greatest(0, {_digamma_sql('count(*)')} + {_digamma_sql('3')}
              - avg({_digamma_sql('size')}) - avg({_digamma_sql('m')})) AS mi FROM lo GROUP BY c_name)"""


@register("neighbour_mutual_info", sql=f"{NEIGHBOUR_MI_SQL} SELECT feature, ROUND(mi, 6) AS mi FROM mi")
def neighbour_mutual_info(spark, sf_dir):
    """Information of each feature on the label from its three nearest
    neighbours, no bins."""
    return prep.neighbour_mutual_info(flows(spark, sf_dir), NUM, "label").select("feature", r6("mi", "mi"))


@register("neighbour_selected_features", sql=f"{NEIGHBOUR_MI_SQL} SELECT feature, ROUND(mi, 6) AS mi FROM mi ORDER BY mi.mi DESC, feature LIMIT 2")
def neighbour_selected_features(spark, sf_dir):
    """The two features with the most such information (the number is the feature)."""
    mi = prep.neighbour_mutual_info(flows(spark, sf_dir), NUM, "label")
    return prep.select_k_best(mi, 2).select("feature", r6("mi", "mi"))


SCORE_SQL = "CAST(('0x' || substr(md5('42:' || CAST(row_id AS VARCHAR)), 1, 15)) AS BIGINT) / 1152921504606846976.0"


@register("stratified_split", sql=f"""{WF},
s AS (SELECT row_id, label, {SCORE_SQL} AS score FROM flows),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM s)
SELECT row_id, label, rn <= round(n * 0.15) AS is_test FROM r""")
def stratified_split(spark, sf_dir):
    """Exactly round(0.15 * n_class) test rows per class."""
    f = flows(spark, sf_dir).select("row_id", "label")
    return prep.stratified_split(f, "label", "row_id", 0.15).select("row_id", "label", "is_test")


@register("stratified_pick", sql=f"""{WF},
s AS (SELECT row_id, label, {SCORE_SQL} AS score FROM flows),
r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY score, row_id) AS pick_rank FROM s)
SELECT row_id, label, CAST(pick_rank AS INTEGER) AS pick_rank FROM r WHERE pick_rank <= 6""")
def stratified_pick(spark, sf_dir):
    """6 rows per class by hash order (the pick size is the feature)."""
    f = flows(spark, sf_dir).select("row_id", "label")
    return prep.stratified_pick(f, "label", "row_id", 6).select("row_id", "label", "pick_rank")


@register("exact_sample", sql=f"""{WF}
SELECT row_id FROM flows ORDER BY {SCORE_SQL} LIMIT 1000""")
def exact_sample(spark, sf_dir):
    """Exactly 1,000 rows, uniform by hash (the sample size is the feature)."""
    return prep.exact_sample(flows(spark, sf_dir).select("row_id"), "row_id", 1000)


@register("sequence_windows", sql=f"""{WF},
w AS (SELECT dst_port, row_id, label,
             list(quantity) OVER (PARTITION BY dst_port ORDER BY "timestamp", flow_id, line, part_key, quantity
                                  ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS seq
      FROM flows)
SELECT dst_port, row_id, label, CAST(len(seq) AS INTEGER) AS n,
       ROUND(list_sum(list_transform(seq, lambda x, i: x * i)), 6) AS weighted
FROM w WHERE len(seq) = 20""")
def sequence_windows(spark, sf_dir):
    """20-row sliding windows per destination port (entity), ordered
    by time with a unique tie-break; label of the last row."""
    f = flows(spark, sf_dir)
    order = ["timestamp", "flow_id", "line", "part_key", "quantity"]
    s = prep.sequence_windows(f.withColumn("rid", F.col("row_id")), "dst_port", order + ["rid"],
                              ["quantity"], "label", 20)
    weighted = F.aggregate(F.transform("seq", lambda v, i: v[0] * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return s.select("dst_port", F.col("rid").alias("row_id"), "label", F.size("seq").alias("n"),
                    r6(weighted, "weighted"))


FALLBACK_SQL = """fb AS (SELECT row_id, dst_port, quantity AS fwd, tax AS bwd, price AS rate, discount AS bytes FROM flows),
g AS (SELECT dst_port, avg(fwd + bwd) AS m FROM fb GROUP BY dst_port),
med AS (SELECT median(fwd + bwd) AS med FROM fb)"""


@register("extracted_features", sql=f"""{WF}, {FALLBACK_SQL},
own AS (SELECT flow_id, count("timestamp") AS pr, coalesce(sum(packet_length), 0) AS br, avg(packet_length) AS ms FROM flows GROUP BY flow_id)
SELECT 'flow' AS branch, row_id, CAST(pr AS DOUBLE) AS packet_rate, ROUND(br, 6) AS byte_rate, ROUND(ms, 6) AS mean_packet_size
FROM flows LEFT JOIN own USING (flow_id)
UNION ALL
SELECT 'port', row_id, ROUND(rate, 6), ROUND(bytes, 6), ROUND(coalesce(m, med), 6) FROM fb LEFT JOIN g USING (dst_port), med""")
def extracted_features(spark, sf_dir):
    """The branch is chosen from the columns: flows with ids and
    lengths, and the same rows with forward and backward totals and rates."""
    f = flows(spark, sf_dir)
    totals = f.select("row_id", "dst_port", F.col("quantity").alias("total_length_of_fwd_packets"),
                      F.col("tax").alias("total_length_of_bwd_packets"), F.col("price").alias("flow_packets_s"),
                      F.col("discount").alias("flow_bytes_s"))
    out = lambda df, name: prep.extract_features(df).select(
        F.lit(name).alias("branch"), "row_id", r6(F.col("packet_rate").cast("double"), "packet_rate"), r6("byte_rate", "byte_rate"),
        r6("mean_packet_size", "mean_packet_size"))
    return out(f, "flow").unionByName(out(totals, "port"))


@register("scaler_transfer", sql=f"""{WF},
p AS (SELECT {", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}" for c in NUM)} FROM flows WHERE label = 0)
SELECT row_id, {", ".join(f"ROUND(({c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END, 6) + 0.0 AS {c}" for c in NUM)}
FROM flows, p WHERE label = 1""")
def scaler_transfer(spark, sf_dir):
    """A scaler fitted on benign rows applied to attack rows."""
    f = flows(spark, sf_dir).select("row_id", "label", *NUM)
    out = prep.apply_scaler(f.filter("label = 1"), prep.fit_scaler(f.filter("label = 0"), NUM), NUM)
    return out.select("row_id", *[r6(c, c) for c in NUM])


@register("selected_features", sql=f"""{WF},
long AS (UNPIVOT (SELECT label, quantity, price, discount, tax FROM flows) ON quantity, price, discount, tax
         INTO NAME c_name VALUE v),
rng AS (SELECT c_name, min(v) AS lo, max(v) AS hi FROM long GROUP BY c_name),
b AS (SELECT c_name, label, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / (hi - lo) * 10), 9) END AS bin
      FROM long JOIN rng USING (c_name)),
j AS (SELECT c_name, bin, label, count(*) AS nxy FROM b GROUP BY ALL),
m AS (SELECT *, sum(nxy) OVER (PARTITION BY c_name) AS n, sum(nxy) OVER (PARTITION BY c_name, bin) AS nx,
             sum(nxy) OVER (PARTITION BY c_name, label) AS ny FROM j),
mi AS (SELECT c_name AS feature, sum(nxy / n * ln(nxy * n / (nx * ny))) AS mi FROM m GROUP BY c_name)
SELECT feature, ROUND(mi, 6) AS mi FROM mi ORDER BY mi.mi DESC, feature LIMIT 2""")
def selected_features(spark, sf_dir):
    """The two features with the most information on the label."""
    mi = prep.binned_mutual_info(flows(spark, sf_dir), NUM, "label", bins=10)
    return prep.select_k_best(mi, 2).select("feature", r6("mi", "mi"))


@register("clean_exclude", sql="""WITH s AS (SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS label FROM orders),
k AS (SELECT status, CAST(dense_rank() OVER (ORDER BY status) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT status FROM s))
SELECT code AS status, label FROM s JOIN k USING (status)""")
def clean_exclude(spark, sf_dir):
    """Distinct rows, categories coded, the label column left out."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("label"))
    return prep.clean(o, exclude=["label"])
