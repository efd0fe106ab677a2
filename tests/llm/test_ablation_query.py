"""The ablation over a whole table."""

import brute

import __spark_entry__ as entry
from tidewatch.llm import quality_rules

SF = "/root/testdata/sf0.001"


def test_ablation_of_all_documents(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    got = entry.queries()["rule_ablation"](spark, SF).collect()
    mask = quality_rules.POLICIES[quality_rules.DEFAULT_POLICY].mask
    assert {r.rule for r in got} == {r for i, r in enumerate(quality_rules.RULES) if mask >> i & 1}
    rejected = sum(not brute.kept_by_rules(t) for t in texts)
    assert rejected > 0
    for r in got:
        assert r.n_only == rejected - r.n_rejected_without and r.n_only <= r.n_failed <= len(texts)
