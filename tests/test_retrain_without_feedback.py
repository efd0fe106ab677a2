"""Retraining when no feedback cycle closes."""

import datetime

import __spark_entry__ as entry


def test_the_base_model_stays(spark, tmp_path):
    """Alike rows, a third of them alerts: none is predicted one, so analysts
    have nothing to judge."""
    rows = [(i, i, i, 1, 5.0, 100.0, 0.05, 0.02, "R" if i % 3 == 0 else "N", "O", datetime.datetime(2024, 1, 1)) for i in range(90)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp") \
        .write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.pop("model"): r for r in (r.asDict() for r in entry.queries()["retrain_comparison"](spark, str(tmp_path)).collect())}
    assert set(got) == {"base", "new_only"} and got["base"] == got["new_only"]
    assert got["base"]["recall"] == got["base"]["fpr"] == 0.0
