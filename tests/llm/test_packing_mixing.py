"""Packing as an exact round trip, and mixing against a plain version."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import mixing, packing

ODD = ["", None, " ", "one", "don't we'll it's 123 a1b2", "É́ é ẞ İ ΟΔΟΣ ς", "a\x0bb\x0cc\x1cd\x85e\xa0f g　h",
       "x<|endoftext|>y <|startoftext|>", "\U0001f600\U0001f600 !!! ***word***", "漢字 かな 한국어 한", "tab\tnew\nline\r\nend", "'S 'LL 've",
       "﻿bom ​zero", "à̖ ̀start", "9999999999 ½ ²"]


@lru_cache
def tokenizer():
    return Tokenizer.from_file(packing.default_vocabulary())


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_words_give_the_ids_of_the_text():
    cache = packing.WordCache(packing.default_vocabulary())
    for text in ODD:
        assert np.frombuffer(cache.ids(text), "<u4").tolist() == ids_of(text)[:-1], text


def test_direct_words_give_the_same_ids():
    cache = packing.WordCache(packing.default_vocabulary())
    assert cache.direct
    rng = random.Random(7)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
    words = letters + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + "".join(rng.choice(".,;:!?*#%&$|") for _ in range(rng.randint(0, 4)))
                       for _ in range(3000)]
    for w in words:
        assert packing._PLAIN.fullmatch(w) and cache.plain_ids(packing._PLAIN.fullmatch(w)) == cache.whole_ids(w), w


def test_letters_are_tokenised_once():
    """Whatever their case and punctuation, and after the words are dropped."""
    cache, asked = packing.WordCache(packing.default_vocabulary()), []
    model, text = cache.model, "haus Haus HAUS, haus. Haus! Über, über ÜBER. Ü."

    class Counting:
        def tokenize(self, part):
            asked.append(part)
            return model.tokenize(part)
    cache.model = Counting()
    cache.parts.clear()
    for _ in range(2):
        assert np.frombuffer(cache.ids(text), "<u4").tolist() == ids_of(text)[:-1]
        cache.clear()
    assert len(asked) == len(set(asked)) == 6


def test_words_held_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    cache = packing.WordCache(packing.default_vocabulary())
    for i in range(50):
        text = f"{chr(97 + i % 26) * (i + 1)} B{'x' * i}, word."
        assert np.frombuffer(cache.ids(text), "<u4").tolist() == ids_of(text)[:-1]
        assert len(cache) <= 20 + 3 and len(cache.parts) <= 10 + 6


def check_pieces(rows, ids, max_tokens=packing.MAX_TOKENS, max_segments=packing.MAX_SEGMENTS):
    """Every id in one piece, sequences gapless and within the limits; the
    share of padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        sequences[r.sequence_id].append(r)
    for key, own in pieces.items():
        lists = ids[key]
        for want in {tuple(x) for x in lists}:
            copies = sum(tuple(x) == want for x in lists)
            mine = sorted((r.start, r.length, r.ids_crc32) for r in own)
            covered = defaultdict(int)
            for start, n, crc in mine:
                assert n > 0 and crc == zlib.crc32(np.array(want[start:start + n], "<u4").tobytes())
                covered[start] += 1
                covered[start + n] -= 1
            level = 0
            for at in sorted(covered):
                level += covered[at]
                assert level == (copies if at < len(want) else 0)
    assert {k: len(v) for k, v in ids.items()}.keys() == pieces.keys()
    padding = total = 0
    for own in sequences.values():
        own = sorted(own, key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
        n = sum(r.length for r in own)
        assert n <= max_tokens and len(own) <= max_segments
        padding += 0 if n & (n - 1) == 0 else max_tokens - n
        total += n
    return padding / total


def test_pack_is_a_round_trip(spark):
    rng = random.Random(2)
    texts = ODD + [brute.make_text(rng, int(rng.paretovariate(0.7) * 20) % 9000) for _ in range(300)] + ["word " * 20_000]
    rows = list(enumerate(texts)) + [(20, texts[20]), (None, "no id")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id int, text string, start string, offset int").repartition(3)
    ids = defaultdict(list)
    for d, t in rows:
        ids[(d, len(ids_of(t)))].append(ids_of(t))
    out = packing.pack(df)
    assert dict(out.dtypes)["doc_id"] == "int"
    assert check_pieces(out.collect(), ids) < 0.02
    assert packing.pack(df.limit(0)).count() == 0


def test_prompts_bear_no_loss(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        prompt = brute.make_text(rng, rng.randint(0, 60))
        rows.append((i, prompt, prompt + "\n" + brute.make_text(rng, rng.randint(1, 60))))
    df = spark.createDataFrame(rows, "doc_id long, prompt string, text string").coalesce(1)
    out = packing.pack(df, max_tokens=256, max_segments=5, max_loss=100, prompt_col="prompt").collect()
    loss = defaultdict(int)
    for r in out:
        loss[r.sequence_id] += r.loss_tokens
    assert max(loss.values()) <= 100
    want = {d: len(ids_of(t)) - len(ids_of(p)) + 1 for d, p, t in rows}
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += r.loss_tokens
    assert got == want
    assert check_pieces(out, {(d, len(ids_of(t))): [ids_of(t)] for d, _, t in rows}, 256, 5) >= 0


def test_packer_keeps_examples_whole_if_asked():
    rng = random.Random(4)
    sizes = [(rng.randint(1, 50), rng.random()) for _ in range(500)]
    p = packing.Packer(64, 4, 40, cut=False, pool=64)
    done = []
    for i, (n, share) in enumerate(sizes):
        done += p.put(i, n, min(int(n * share), 40))
    done += p.close()
    assert sorted(e for s in done for e, _, _ in s) == list(range(500))
    for s in done:
        assert all(start == 0 and n == sizes[e][0] for e, start, n in s)
        assert sum(n for _, _, n in s) <= 64 and len(s) <= 4 and sum(min(int(n * sizes[e][1]), 40) for e, _, n in s) <= 40
    with pytest.raises(ValueError):
        p.put(0, 65)


def test_powers_of_two():
    out = packing.powers_of_two([("a", 3, 700), ("b", 0, 1)], 4096)
    assert [sum(n for _, _, n in s) for s in out] == [512, 128, 32, 16, 8, 4, 1]
    assert packing.powers_of_two([("a", 0, 4096)], 4096) == [[("a", 0, 4096)]]


COLUMNS = "doc_id long, text string, lang string, source string"


def corpus(rng, n=400):
    rows = []
    for i in range(n):
        source = rng.choice(["src0"] * 6 + ["src1", "src4", "src2", "src7", "other", None, "src99999999999"])
        rows.append((i, rng.choice([None, "", brute.make_text(rng, rng.randint(1, 90))]), rng.choice(["en", "en", "de", "fr", None]), source))
    return rows


@pytest.mark.parametrize("percent,epochs", [(60, 1), (250, 3), (0, 2), (1000, 2)])
def test_mix_matches_plain_version(spark, percent, epochs):
    rows = corpus(random.Random(percent))
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, "a b", "en", "src0", "y")], COLUMNS + ", tokens string")
    got = {r.doc_id: r.mix.copies for r in mixing.mix(df, percent, epochs).collect()}
    assert got == brute.mix(rows, percent, epochs, mixing.SEED, mixing.WEIGHTS)
    out = mixing.chosen(df, percent, epochs)
    assert out.columns == df.columns
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id] += 1
    assert count == {d: c for d, c in got.items() if c}


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("d0", "en", "src0", 100), ("d0", "en", "src4", 10), ("d0", "de", "src0", 1000), ("d1", "en", "src1", 1000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.share for r in mixing.leaf_budgets(df, F.lit(400), 1, {}).collect()}
    # en of d0 gets half of d0's 200: src4 can give 10 and src0 makes up for it
    assert got == {("d0", "en", "src4"): 10, ("d0", "en", "src0"): 90, ("d0", "de", "src0"): 100, ("d1", "en", "src1"): 200}
    got = {(r.domain, r.lang, r.source): r.share for r in mixing.leaf_budgets(df, F.lit(2000), 1, {}).collect()}
    # en of d0 is exhausted (110 of 500), de of d0 makes up for it before d1 does
    assert got == {("d0", "en", "src4"): 10, ("d0", "en", "src0"): 100, ("d0", "de", "src0"): 890, ("d1", "en", "src1"): 1000}


def test_mix_of_odd_tables(spark):
    df = spark.createDataFrame(corpus(random.Random(1), 30), COLUMNS)
    assert mixing.chosen(df.limit(0)).count() == 0
    twice = df.unionAll(df)
    got = defaultdict(set)
    for r in mixing.mix(twice, 50).collect():
        got[r.doc_id].add(r.mix.copies)
    assert all(len(v) == 1 for v in got.values())
    clash = df.withColumn("mix", F.col("doc_id")).withColumn("share", F.lit(1))
    assert mixing.chosen(clash).columns == clash.columns
    assert sorted(r.doc_id for r in mixing.chosen(clash).collect()) == sorted(r.doc_id for r in mixing.chosen(df).collect())
