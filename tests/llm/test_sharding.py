"""Uniform sharding: exact sizes, gapless slots, and the distribution of the
communication matrix against the one of a plain shuffle."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import queries, sharding

DOCS = "doc_id long, text string, shard string, Slot int, c0 double"


def rows(n):
    texts = [None, "", "é\U0001f600", "x" * 300_000, "same", "same"]
    return [(None if i % 17 == 0 else i % 40, texts[i % 6], f"s{i}", i, None) for i in range(n)]


@pytest.mark.parametrize("n, parts, shards", [(0, 1, 4), (3, 2, 5), (200, 7, 24)])
def test_sizes_slots_and_rows(spark, n, parts, shards):
    df = spark.createDataFrame(rows(n), DOCS).repartition(parts)
    out = sharding.shuffle(df, shards=shards, fanout=3, slice_rows=4)
    assert out.columns == [*df.columns, "_shard", "_slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.shard, r.Slot) for r in got) == Counter((a, b, c, d) for a, b, c, d, _ in rows(n))
    slots = {}
    for r in got:
        slots.setdefault(r._shard, []).append(r._slot)
    sizes = [len(slots.get(s, ())) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_matrix_has_its_margins(spark):
    sizes = {i: (i * 37) % 90 for i in range(60)}
    total = sum(sizes.values())
    shards = [total // 3 + (s < total % 3) for s in range(3)]
    df = spark.createDataFrame([(p, n) for p, n in sizes.items() if n], "part long, n long")
    for fanout in (4, 1024):
        got = {r.part: list(r.counts) for r in sharding.communication_matrix(df, shards, 5, fanout).collect()}
        assert {p: sum(c) for p, c in got.items()} == {p: n for p, n in sizes.items() if n}
        assert [sum(c[s] for c in got.values()) for s in range(3)] == shards
        again = {r.part: list(r.counts) for r in sharding.communication_matrix(df, shards, 5, fanout).collect()}
        assert got == again


@pytest.mark.parametrize("good, bad, n", [(5, 7, 4), (30, 2, 20), (1, 1, 1), (400, 900, 333), (10, 0, 3), (0, 9, 4)])
def test_hypergeometric_numbers(good, bad, n):
    rng, times = np.random.default_rng(3), 4000
    got = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(times))
    whole, chi, cells = math.comb(good + bad, n), 0.0, 0
    for k in range(max(0, n - bad), min(good, n) + 1):
        want = times * math.comb(good, k) * math.comb(bad, n - k) / whole
        if want >= 5:
            chi, cells = chi + (got[k] - want) ** 2 / want, cells + 1
    assert set(got) <= set(range(max(0, n - bad), min(good, n) + 1))
    assert chi < cells + 5 * math.sqrt(2 * cells + 1)


def test_large_populations():
    rng = np.random.default_rng(1)
    got = [sharding.hypergeometric(rng, 10 ** 11, 23 * 10 ** 11, 10 ** 9) for _ in range(60)]
    mean, sd = 10 ** 9 / 24, math.sqrt(10 ** 9 / 24 * 23 / 24)
    assert all(abs(k - mean) < 6 * sd for k in got) and abs(sum(got) / 60 - mean) < sd and np.std(got) > 0.6 * sd


def test_every_row_may_come_anywhere(spark):
    """Neighbours of a partition part as often as rows far apart, and places
    have nothing to do with a row's place before."""
    n, shards = 4000, 4
    df = spark.range(n, numPartitions=3)
    a, b = ({r.id: (r.shard, r.slot) for r in sharding.shuffle(df, shards=shards, seed=s).collect()} for s in (1, 2))
    for at in (a, b):
        for gap in (1, 2, n // 2):
            assert abs(sum(at[i][0] == at[i + gap][0] for i in range(n - gap)) / (n - gap) - 1 / shards) < 0.05
        slots = np.array([at[i][1] for i in range(n)])
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.08
        assert abs(np.corrcoef(slots[:-1], slots[1:])[0, 1]) < 0.08
        assert all(abs(sum(at[i][0] == s for i in range(500)) - 125) < 50 for s in range(shards))
    assert abs(sum(a[i][0] == b[i][0] for i in range(n)) / n - 1 / shards) < 0.05


def test_query_rows(spark, sf):
    got = queries.op11(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(docs)
    for r in got:
        octets = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(octets) + 8, zlib.crc32(octets), "rows", None)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1


def test_written_shards(spark, tmp_path):
    out = sharding.shuffle(spark.range(100).repartition(5), shards=6)
    sharding.write_shards(out, str(tmp_path / "shards"), 6)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).where("n <> top + 1").count() == 0
    assert back.count() == 100
