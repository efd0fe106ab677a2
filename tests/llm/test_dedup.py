"""Line dedup, SimHash near-duplicates and components against plain versions."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, simhash
from tidewatch.llm.components import connected_components

DOCS = "doc_id long, text string"


def passages(rng):
    """Documents that share passages, and odd ones."""
    shared = [brute.make_text(rng, 40, 4) for _ in range(4)]
    docs = []
    for i in range(60):
        own = brute.make_text(rng, rng.randint(0, 60), 5)
        parts = [own] + rng.sample(shared, rng.randint(0, 2)) + [brute.make_text(rng, 10, 5)]
        docs.append((i, "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, docs[7][1]), (105, docs[7][1]), (None, docs[7][1]), (None, None),
             (106, "same line\n" * 400), (107, "x"), (108, "é\n\U0001f600\né\n\U0001f600\né\n\U0001f600")]
    return docs


def test_lines_match_plain_version(spark):
    docs = passages(random.Random(3))
    df = spark.createDataFrame([(t, d, "c", i) for i, (d, t) in enumerate(docs)], "text string, doc_id long, cut_id string, body int")
    out = line_dedup.dedup_lines(df, removed_col="removed")
    assert out.columns == [*df.columns, "removed"]
    got = {r.body: (r.doc_id, r.text, r.removed) for r in out.collect()}
    assert got == dict(enumerate(brute.dedup_lines(docs)))
    assert sum(r[2] for r in got.values()) > 200
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_shifted_passage_is_found(spark):
    rng = random.Random(4)
    passage = brute.make_text(rng, 200, 5)
    docs = [(1, passage), (2, "one more line\n" + passage), (3, brute.make_text(rng, 31, 5) + "\n" + passage + "\nend")]
    got = {r.doc_id: r.removed for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS), removed_col="removed").collect()}
    assert got[1] == 0 and min(got[2], got[3]) > 20


def test_rows_that_repeat_an_id_share_decisions(spark):
    text = brute.make_text(random.Random(9), 80, 4)
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], DOCS)
    out = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()]
    assert len(out) == 3 and sorted(t for d, t in out if d == 1) == [text, text]
    assert len(dict(out)[2]) < len(text)


def test_unique_lines_survive_a_repeated_id(spark):
    rng = random.Random(10)
    shared, own = brute.make_text(rng, 80, 4), brute.make_text(rng, 48, 4)
    df = spark.createDataFrame([(1, shared), (2, shared), (2, own), (2, None)], DOCS)
    out = {(r.doc_id, r.text): r.removed for r in line_dedup.dedup_lines(df, removed_col="removed").collect()}
    assert out[(1, shared)] == 0 and out[(2, own)] == 0 and (2, None) in out
    assert [n for (d, t), n in out.items() if d == 2 and t not in (own, None)][0] > 10


def test_every_text_keeps_a_document_under_a_repeated_id(spark):
    rng = random.Random(12)
    a, b = brute.make_text(rng, 60), brute.make_text(rng, 60)
    rows = [(2, a, "x", None), (2, b, "y", 1), (2, b, "z", 1), (3, b, "x", 2), (4, a, "x", None), (None, a, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, fp int")
    for parts in (1, 4):
        got = simhash.keep_one(df.repartition(parts))
        assert got.columns == df.columns
        kept = sorted((tuple(r) for r in got.collect()), key=str)
        assert [(d, t) for d, t, _, _ in kept] == sorted([(2, a), (2, b), (None, a)], key=str)
        if parts == 1:
            first = kept
        assert kept == first


def near_copies(rng):
    docs = [(i, brute.make_text(rng, rng.randint(30, 200))) for i in range(40)]
    n = 100
    for i in range(12):
        words = docs[i][1].split(" ")
        for _ in range(4):
            w = list(words)
            for _ in range(rng.randint(1, 2)):
                w[rng.randrange(len(w))] = rng.choice(brute.SYLLABLES)
            docs.append((n, " ".join(w)))
            n += 1
    docs += [(n, docs[3][1]), (n + 1, docs[3][1].upper()), (n + 2, None), (n + 3, ""), (n + 4, "\t\n"), (n + 5, "one"), (n + 6, "two words"),
             (n + 7, "two words"), (None, docs[5][1]), (None, "nobody has this text at all, really"), (5, docs[5][1]), (n + 8, "w " * 70_000)]
    rng.shuffle(docs)
    return docs


def test_near_duplicates_match_plain_version(spark):
    docs = near_copies(random.Random(8))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, fp int, component_id string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    want = sorted(brute.near_components(docs), key=str)
    assert got == want
    assert len({c for _, _, c in want}) < len(docs) - 15
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in want if c is not None}) and ids.count(None) == 2
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [simhash.SMALL_GROUP, 3])
def test_links_connect_all_near_fingerprints(limit, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_GROUP", limit)
    rng = random.Random(limit)
    keys, fps = [], []
    for key in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 30, 90])):
            f = centre
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            keys.append(key)
            fps.append(f)
    a, b = simhash.links(np.array(keys), np.array(fps, np.uint64), 3)
    nodes = sorted(set(fps))
    want = brute.roots(nodes, [(fps[i], fps[j]) for i in range(len(fps)) for j in range(i)
                               if keys[i] == keys[j] and (fps[i] ^ fps[j]).bit_count() <= 3])
    assert brute.roots(nodes, zip(a.tolist(), b.tolist(), strict=True)) == want


def test_pairs_at_every_distance_meet_under_a_key(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(300):
        f = rng.getrandbits(64)
        g = f
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            g ^= 1 << bit
        pairs.append((f - (f >> 63 << 64), g - (g >> 63 << 64)))
    df = spark.createDataFrame(pairs, "f long, g long")
    both = df.select(F.expr(simhash.segment_keys("f")).alias("kf"), F.expr(simhash.segment_keys("g")).alias("kg"))
    assert both.where(~F.arrays_overlap("kf", "kg")).count() == 0
    assert both.select(F.max(F.size("kf"))).first()[0] <= 66


@pytest.mark.parametrize("shape", ["chain", "star", "random", "clique", "empty"])
def test_components(spark, shape):
    rng = random.Random(1)
    n = 120
    edges = {"chain": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)] + [(0, 0)],
             "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(80)] * 2,
             "clique": [(i, j) for i in range(12) for j in range(12)], "empty": []}[shape]
    rows = [*edges, (None, 1), (5, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == brute.roots(nodes, [e for e in edges if e[0] != e[1]])


def test_components_of_strings(spark):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
