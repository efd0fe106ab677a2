"""Spelling variants against a plain version."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from tidewatch.llm import spelling

DOCS = "doc_id long, text string, word string, n int, level string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    form, n_near = {}, {}
    for w, n in count.items():
        others = [x for x in count if abs(len(x) - len(w)) < 2 and near(w, x)]
        n_near[w] = len(others)
        if others:
            best = min(others, key=lambda x: (-count[x], x))
            if count[best] >= 10 * n:
                form[w] = best
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, n_near[w], count[form[w]] if w in form else None))
    return sorted(out)


def edited(rng, w, alphabet="abcé"):
    i = rng.randrange(len(w) + 1)
    kind = rng.randrange(3)
    return w[:i] + rng.choice(alphabet) + w[i + (kind == 1):] if kind else w[:i] + w[i + 1:]


def corpus(rng):
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 11))) for _ in range(30)] + ["aaaaaaaa", "abababab", "straßeÜber", "Ünübersehbar"]
    stems += ["".join(rng.choice("ab") for _ in range(n)) for n in (31, 32, 33, 34, 47, 48, 49, 50, 63, 64, 65, 120, 700)]
    words = list(stems)
    for w in stems:
        for _ in range(6):
            v = edited(rng, w)
            words += [v, edited(rng, v)]
    docs = []
    for i in range(150):
        docs.append((None if i % 50 == 0 else i % 60, " ".join(rng.choices(words, k=40))))
    # chains of forms: each ten times as common as the one before
    docs += [(500 + i, "grundwert " * 400 + "grundwerd " * 30 + "grundward " * 2) for i in range(1)]
    docs += [(600, None), (601, ""), (602, "a1b 2222 ×÷×÷×÷×÷ ×÷×÷×÷×÷ ĀāĂ"), (603, "SHOUTING shouting Shoutinġ shoutin"), (604, "shouting\nshoutinx shoutinx")]
    return docs


def got(spark, docs, **options):
    df = spark.createDataFrame([(d, t, "x", i, None) for i, (d, t) in enumerate(docs)], DOCS)
    out = spelling.group_variants(df, **options)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


def test_against_plain_version(spark):
    docs = corpus(random.Random(2))
    want = plain(docs)
    assert got(spark, docs) == want
    assert sum(r[4] for r in want) > 300 and max(len(r[0]) for r in want) > 600
    by = {r[0]: r for r in want}
    assert any(r[1] is not None and r[2] != r[1] for r in want) and by["shouting"][4] >= 1


def test_labels_of_several_points(spark):
    """The same pairs if long labels begin at depth 3."""
    docs = corpus(random.Random(4))
    assert got(spark, docs, single=3) == plain(docs)


def test_words_of_thousands_of_points(spark):
    base = "".join(random.Random(7).choice("abcdefgh") for _ in range(4_000))
    variants = [base, base[:100] + base[101:], base[:3_900] + "z" + base[3_900:], base + "q", "q" + base, base[:2_000] + "z" + base[2_001:]]
    docs = [(i, " ".join(variants)) for i in range(4)]
    found = got(spark, docs)
    assert found == plain(docs)


@pytest.mark.parametrize("docs", [[], [(1, None), (2, "short words only")]])
def test_nothing_to_group(spark, docs):
    assert got(spark, docs) == []


def test_every_edit_is_found(spark):
    """All words one edit from a word, at every place."""
    w = "abcdefgh"
    others = {w[:i] + w[i + 1:] for i in range(8)} | {w[:i] + c + w[i + 1:] for i in range(8) for c in "xa"} | {w[:i] + c + w[i:] for i in range(9) for c in "xa"}
    others -= {w}
    words = spark.createDataFrame([(x,) for x in sorted(others | {w})], "word string")
    pairs = {(r.word, r.near) for r in spelling.near_pairs(words).collect()}
    assert {b for a, b in pairs if a == w} == others
    assert pairs == {(a, b) for a in others | {w} for b in others | {w} if a != b and near(a, b)}


def test_short_words(spark):
    """Words of one to four points, whose middle is near their end."""
    words = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.product("abé", repeat=n)]
    found = [tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(x,) for x in words], "word string")).collect()]
    assert sorted(found) == sorted((a, b) for a in words for b in words if a != b and near(a, b))


def test_few_rows_are_written(spark, monkeypatch):
    """A pair is searched from one of its words, and an edited word isn't
    walked on: about a row a level for each word's own path, and the pairs."""
    rng, written = random.Random(9), []
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 10))) + tail for _ in range(150) for tail in ("end", "ende", "enda", "ends", "nd")})

    def counted(df, tag, plain=spelling.materialize):
        out = plain(df, tag)
        if tag == "frontier":
            written.append(out.count())
        return out
    monkeypatch.setattr(spelling, "materialize", counted)
    pairs = spelling.near_pairs(spark.createDataFrame([(x,) for x in words], "word string"))
    n = pairs.count()
    assert n == sum(near(a, b) for a in words for b in words if a != b)
    assert sum(written) < 8 * len(words) + n
