"""Whole repeated runs of lines, wherever they lie."""

import random

import brute
import pytest
from test_dedup import DOCS, passages

from tidewatch.llm import line_dedup


def plain_runs(docs):
    """(doc_id, text, removed lines), for ids that don't repeat."""
    pairs = lambda t: list(zip(t.split("\n"), t.split("\n")[1:], strict=False))
    first = {}
    for d, t in sorted((d, t) for d, t in docs if d is not None and t is not None):
        for i, p in enumerate(pairs(t)):
            first.setdefault(p, (d, i))
    out = []
    for d, t in docs:
        if d is None or t is None:
            out.append((d, t, 0))
            continue
        gone = {j for i, p in enumerate(pairs(t)) if any(brute.WORD.search(x) for x in p) and first[p] != (d, i) for j in (i, i + 1)}
        out.append((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone), len(gone)))
    return out


def test_runs_match_plain_version(spark):
    docs = passages(random.Random(3))
    df = spark.createDataFrame([(t, d, "c", i) for i, (d, t) in enumerate(docs)], "text string, doc_id long, cut_id string, body int")
    out = line_dedup.dedup_runs(df, removed_col="removed")
    assert out.columns == [*df.columns, "removed"]
    assert {r.body: (r.doc_id, r.text, r.removed) for r in out.collect()} == dict(enumerate(plain_runs(docs)))
    assert line_dedup.dedup_runs(df.limit(0)).count() == 0


@pytest.mark.parametrize("dedup", [line_dedup.dedup_lines, line_dedup.dedup_runs])
@pytest.mark.parametrize("n", [2, 3, 5, 10])
def test_short_passages_go_whole(spark, n, dedup):
    rng = random.Random(n)
    docs, at = [], {}
    for k in range(40):
        passage = brute.make_text(rng, n * 5, 5)
        for d in (2 * k, 2 * k + 1):
            before, after = (brute.make_text(rng, rng.randint(1, 8) * 5, 5) for _ in range(2))
            docs.append((d, f"{before}\n{passage}\n{after}"))
            at[d] = f"{before}\n{after}" if d % 2 else docs[-1][1]
    assert {r.doc_id: r.text for r in dedup(spark.createDataFrame(docs, DOCS)).collect()} == at


def test_other_text_under_the_same_id_keeps_its_lines(spark):
    text, other = (brute.make_text(random.Random(i), 40, 4) for i in (1, 2))
    df = spark.createDataFrame([(1, text), (2, text), (2, other)], DOCS)
    assert sorted(r.text for r in line_dedup.dedup_runs(df).collect()) == sorted([text, "", other])
