"""Source divergence by count cells against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatch.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, source string, term string, c int, part double"


def plain(docs, top=200):
    seen, df, groups = defaultdict(Counter), Counter(), set()
    for lang, source, text in docs:
        key = (lang or "", source or "")
        groups.add(key)
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]
        seen[key].update(words)
        df.update((key[0], w) for w in set(words))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(w for (g, w), n in df.items() if g == lang and n >= 3)
        sources = sorted(s for g, s in groups if g == lang)
        whole = Counter({w: sum(seen[lang, s][w] for s in sources) for w in kept})

        def freq(count):
            n = sum(count[w] for w in kept)
            return {w: 1 + 10 ** 9 * (count[w] + 1) // (n + len(kept)) for w in kept}

        p, q = {s: freq(seen[lang, s]) for s in sources}, freq(whole)
        for s in sources:
            two = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in sources if o != s]
            own = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if seen[lang, s][w] and p[s][w] > q[w]]
            for part, found, limit in (("pair", two, None), ("term", own, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def corpus(rng, n, sources):
    vocabulary = ["w" + "".join(rng.choice("abcdeé😀") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    docs = []
    for _ in range(n):
        s = rng.randrange(sources)
        words = rng.choices(vocabulary, k=rng.randint(0, 40)) + rng.choices(vocabulary[5 * (s % 20):5 * (s % 20) + 9], k=rng.randint(0, 9))
        docs.append((rng.choice(["en", "de"]), f"src{s}", rng.choice([" ", "\n", "1", "_"]).join(words)))
    return docs


def got(spark, docs, **options):
    df = spark.createDataFrame([(i % 5, t, lang, s, "x", i, None) for i, (lang, s, t) in enumerate(docs)], DOCS)
    out = divergence.audit(df, **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("options", [{}, {"block_terms": 16, "tile": 3}, {"top": 4}])
def test_against_plain_version(spark, options):
    rng = random.Random(5)
    docs = corpus(rng, 160, 9)
    # nulls, no terms at all, a language without kept terms, a lone source, ties, a very long text, capitals beyond ASCII
    docs += [(None, None, "Äa äa ÄA"), (None, "src1", None), ("en", "empty", None), ("en", "digits", "12 34"), ("fr", "a", "once"), ("fr", "b", "twice"),
             ("it", "lone", "ja Ja JA nein"), ("it", "lone", "ja nein"), ("it", "lone", "ja nein nein"),
             ("en", "src0", "wa " * 60_000 + "z" * 50_000)] + [("en", "src3", "same line")] * 5
    assert got(spark, docs, **options) == plain(docs, options.get("top", 200))


def test_more_ties_than_ranks(spark):
    words = [f"w{a}{b}" for a in "abcdefghijklmnopqr" for b in "abcdefghijklmnopqr"]
    docs = [("en", "a", " ".join(words))] * 3 + [("en", "b", "other words here")] * 4
    assert got(spark, docs) == plain(docs)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_cells_do_not_overflow():
    counts = np.array([[10 ** 12, 0], [0, 10 ** 12], [3, 3], [3, 3]])
    n, v = [10 ** 12 + 6] * 2, 4
    p = [[1 + 10 ** 9 * (int(c) + 1) // (n[s] + v) for s, c in enumerate(row)] for row in counts]
    want = sum((a - b) ** 2 // b for a, b in p)
    assert divergence.cell_sums(counts, n, v).tolist() == [[0, want], [want, 0]]
