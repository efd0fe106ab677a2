"""Quality rules, URL filter and secret scan against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import quality_rules, secrets, url_equivalence

DOCS = "doc_id long, text string"


def odd_texts(rng):
    base = brute.make_text(rng, 60)
    return [None, "", " \n\t ", "one", "a b c d e f g h i j", base, base + "\n" + base, base.upper(), "x " * 40, "ab cd " * 30,
            " ".join(f"{w}###" for w in base.split()), "é è ü " * 12, "l1 a\nl1 a\n \nl1 a\n", "word " * 5000,
            "\x0b\x0c w\x1cx \x85 y", "\U0001f600 " * 11, " ".join(str(i) for i in range(9000)) + " 1 2 3 4 5"]


def test_measures_match_plain_version(spark):
    rng = random.Random(1)
    texts = odd_texts(rng) + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(3, texts[5]), (3, texts[5]), (None, "no id at all")]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash")).withColumn("measures", F.lit(0))
    led = quality_rules.apply_policy(quality_rules.ledger(df)).collect()
    assert len(led) == len(rows)
    for r, (_, t) in zip(led, rows, strict=True):
        want = brute.measures(t)
        assert {k: r[k] for k in want} == want, t
        assert r.kept == brute.kept_by_rules(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    kept = quality_rules.keep_documents(df)
    assert kept.columns == df.columns
    assert sorted(r.text for r in kept.collect()) == sorted(t for _, t in rows if brute.kept_by_rules(t))
    assert quality_rules.keep_documents(df.limit(0)).count() == 0 and quality_rules.ledger(df.limit(0)).count() == 0


def test_wide_vocabulary_windows_are_exact():
    words = [str(i).encode() for i in range(20_000)]
    assert quality_rules.repeated_words(words) == 0
    assert quality_rules.repeated_words(words + words[7:13]) == 12
    assert quality_rules.repeated_words(words + words[7:11]) == 0


def test_ablation_counts(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts(random.Random(2)))]
    led = quality_rules.ledger(spark.createDataFrame(rows, DOCS)).cache()
    bits = [r.fail_bits for r in led.collect()]
    policy = quality_rules.POLICIES["strict-1"]
    for r in quality_rules.ablation(led, policy).collect():
        bit = 1 << list(quality_rules.RULES).index(r.rule)
        assert (r.n_failed, r.n_only, r.n_rejected_without) == (
            sum(1 for b in bits if b & bit), sum(1 for b in bits if b & policy.mask == bit),
            sum(1 for b in bits if b & policy.mask & ~bit))


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host):])[0]


def plain_rule(host, path):
    fits = []
    for action, rule in url_equivalence.RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), action == "allow", rule, action))
    return max(fits)[2:] if fits else (None, None)


URLS = ["http://a.net/x", "https://a.net", "net://net/", "http://sub.EXAMPLE.net/en/1", "https://example.net/en/?q", "http://example.com/de/1",
        "http://x.example.com/de/2#f", "http://a.org/fr/1", "http://a.org/de/1", "http://www.a.org/de/1/", "https://m.a.org/de/1.html?utm_source=x",
        "no scheme", "", None, "http://", "http:///path", "http://exam\nple.com/de/x", "http://ÄB.net/ü", "http://b.com/p?b=2&a=1&ref=z",
        "https://b.com:443/p/index.html?a=1&b=2", "http://c.com/1", "http://d.com/2", "http://e.com/3", "http://f.org/fr/9", "ftp://u:p@g.net:21/x"]


def test_urls_match_plain_version(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(3, URLS[3], ""), (None, "http://h.net/1", "<p>")]
    out = url_equivalence.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1)))
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in out.collect()), key=str)
    assert got == sorted(((i, *plain_url(u), plain_rule(*plain_url(u))[0]) for i, u, _ in rows), key=str)
    for r in out.collect():
        if r.rule:
            assert r.verdict == dict((t, a) for a, t in url_equivalence.RULES)[r.rule]


def test_decisions_spread_over_links(spark):
    link = lambda u: f'<html><LINK data-x=1 href="{u}" rel="canonical"><p>'
    rows = [(1, "http://plain.com/a", link("https://bad.net/a")), (2, "https://bad.net/a", None), (3, "http://www.plain.com/a/", ""),
            (4, "http://other.com/b", '<meta http-equiv="refresh" content="0; URL=http://plain.com/a">'),
            (5, "http://good.com/c", link("http://bad.net/c")), (6, "http://bad.net/c", link("http://x.org/fr/c")), (7, "http://x.org/fr/c", None),
            (8, "http://alone.com/", link("/relative")), (9, "http://alone.com", link("http://alone.com/#x")),
            (10, "http://far.com/1", None), (11, "http://chain.com/1", None), (12, None, link("http://bad.net/a"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    hops = [("http://chain.com/1", "http://chain.com/2"), ("http://chain.com/2", "http://chain.com/3"), ("http://chain.com/3", "http://gone.net/z"),
            (None, "http://bad.net/a"), ("http://far.com/1", None), ("", "x")]
    got = {r.page_id: r.verdict for r in url_equivalence.judge(df, redirects=spark.createDataFrame(hops, "from_url string, to_url string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow",
                   11: "block", 12: "allow"}
    assert {r.page_id: r.verdict for r in url_equivalence.judge(df).collect()}[11] == "allow"
    assert url_equivalence.judge(df.limit(0)).count() == 0


KINDS = ["assign", "access", "hex", "random"]


def plain_spans(text):
    out = {k: [] for k in KINDS}
    kw = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({kw})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out["assign"].append(m.span())
    out["access"] = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out["hex"] = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def plain_chain(texts):
    """Counts of neighbouring symbol classes in words of 8 to 19 code characters."""
    place = {s: i for i, c in enumerate(secrets.CLASSES) for s in c}
    out = Counter()
    for t in texts:
        for w in re.findall("[A-Za-z0-9+/_-]+", t or ""):
            if 8 <= len(w) <= 19:
                out.update((place[u], place[v]) for u, v in zip(w, w[1:]))
    return out


def plain_against_writing(t, alphabet, chain):
    """Smaller of the two 1 / likelihood ratios of ``t``, symbol by symbol."""
    place = {s: i for i, c in enumerate(secrets.CLASSES) for s in c}
    one_kind = alphabet.isdigit() or (alphabet.isalpha() and (alphabet.islower() or alphabet.isupper()))
    kind = {s: s.lower() in "aeiou" if one_kind else (s.islower(), s.isupper(), s.isdigit()) for s in alphabet}
    if alphabet.isdigit():
        kind = dict.fromkeys(alphabet, 0)
    log_runs = log_serial = 0.0
    kinds, letters = Counter(), Counter()
    for (a, b), m in chain.items():
        kinds[secrets.KIND_OF[a], secrets.KIND_OF[b]] += m
        if a < 6 and b < 6:
            letters[a % 3, b % 3] += m
    stay = (sum(m for (a, b), m in kinds.items() if a == b) + 1) / (sum(kinds.values()) + 2)
    after = {}
    for u in set(t):
        raw, a = {}, place[u]
        for s in alphabet:
            b = place[s]
            ka, kb = secrets.KIND_OF[a], secrets.KIND_OF[b]
            row = sum(kinds[ka, c] for c in range(4))
            raw[s] = (kinds[ka, kb] + secrets.PRIOR * (stay if ka == kb else (1 - stay) / 3)) / (row + secrets.PRIOR) / len(secrets.CLASSES[b])
            if b < 6:
                before = [a % 3] if a < 6 else [0, 1, 2]
                raw[s] *= sum(letters[c, b % 3] + 1 for c in before) / sum(letters[c, d] + 1 for c in before for d in range(3))
        total = sum(raw.values())
        after[u] = {s: (1 - secrets.HEDGE) * r / total + secrets.HEDGE / len(alphabet) for s, r in raw.items()}
    for u, v in zip(t, t[1:]):
        log_serial -= math.log(after[u][v] * len(alphabet))
        same = [s for s in alphabet if (kind[s] == kind[u]) == (kind[v] == kind[u])]
        log_runs += math.log(len(same) / len(alphabet) / sum(after[u][s] for s in same))
    return math.exp(min(0, -log_serial)) if log_serial > log_runs else math.exp(min(0, -log_runs))


def plain_battery(token, chain):
    t = token.rstrip("=")
    a = next(a for p, a in secrets.ENCODINGS if re.search(p, t))
    n, k = len(t), len(a)
    x = [a.index(c) for c in t]
    q = sum(t.count(c) ** 2 for c in a)
    z_chi = (q * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    high = [v >= k // 2 for v in x]
    pairs = 2 * sum(high) * (n - sum(high))
    spread = pairs * (pairs - n) / (n * n * (n - 1))
    runs = 1 + sum(u != v for u, v in zip(high, high[1:]))
    z_runs = (runs - (pairs / n + 1)) / math.sqrt(spread) if spread > 0 else 99
    mu = sum(x) / n
    power = sum((v - mu) ** 2 for v in x)
    z_serial = (sum((u - mu) * (v - mu) for u, v in zip(x, x[1:])) / power + 1 / n) * math.sqrt(n) if power > 0 else 99
    r, two = max(secrets.COINCIDENCE, secrets.SMALL_ALPHABET / k), n * (n - 1) / 2
    sd = math.sqrt(two * r * (1 - r) + n * (n - 1) * (n - 2) * r * r * (secrets.THIRD - 1))
    p = min(1, 3 * min(phi(((q - n) / 2 + 0.5 - two * r) / sd), plain_against_writing(t, a, chain)))
    return max(map(abs, (z_chi, z_runs, z_serial))) <= secrets.Z_MAX, p, n


def plain_secrets(texts, fdr=secrets.FDR):
    found, tested, chain = [], [], plain_chain(texts)
    for i, t in enumerate(texts):
        found.append(plain_spans(t or ""))
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", t or ""):
            ok, p, n = plain_battery(m[0], chain)
            step = min(secrets.GRID, max(0, math.floor(-math.log10(max(p, 1e-300)) * secrets.STEPS_A_DECADE)))
            tested.append((int(math.log2(n)), step, ok, i, m.span(), m[0]))
    for octave in {c[0] for c in tested}:
        steps = [step for step, _ in {(c[1], c[5]) for c in tested if c[0] == octave}]
        good = [s for s in steps if 10 ** (-s / secrets.STEPS_A_DECADE) <= fdr * sum(u >= s for u in steps) / len(steps) * (1 + 1e-12)]
        for _, step, ok, i, span, _ in (c for c in tested if c[0] == octave):
            if ok and good and step >= min(good) and not any(span in found[i][k] for k in KINDS[:3]):
                found[i]["random"].append(span)
    return found


def listed(found, kinds):
    every = sorted((s, KINDS.index(k), e) for k in kinds for s, e in found[k])
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in every)


def test_secrets_match_plain_version(spark):
    rng = random.Random(5)
    draw = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    b64, alnum = secrets.ENCODINGS[9][1], secrets.ENCODINGS[8][1]
    texts = [None, "", "token=abc token: abcdefg", "secret=token: abcdef", 'Api-Key "x" apikey="k_1.2-3=" API_KEY : \'aaaaaaa\'', "password==abcdef",
             "é\U0001f600 token = \"" + draw("0123456789abcdef", 40) + "\" \U0001f600 AKIA" + draw("ABCDEFGHIJ0123", 16) + " AKIA123",
             "AKIAAKIA" + draw("XYZ123", 14), draw("0123456789abcdef", 24) + "g" + draw("0123456789abcdef", 23), "0123456789abcdef" * 4,
             "toſen=abcdef toKen=abcdef TOKEN=ABCDEF", "thisisaverylongwordofwrittentextwithoutanyspaces and internationalizationalism",
             " ".join(draw(b64, rng.randint(28, 60)) for _ in range(20)), " ".join(draw(alnum, 40) + "==" for _ in range(9)),
             " ".join("".join(rng.choice(brute.SYLLABLES).replace("é", "e") for _ in range(12)) for _ in range(40)), "a" * 5000,
             draw(b64, 3000), "\n".join(f"token={draw(alnum, 8)}" for _ in range(700)), "x" * 19 + " " + "y" * 20, "-" * 30 + " " + "1" * 25]
    rows = list(enumerate(texts)) + [(6, texts[6]), (None, "secret: hunter22")]
    df = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1)).withColumn("hex", F.lit(2))
    got = secrets.secrets(df).collect()
    want = plain_secrets([t for _, t in rows])
    assert len(got) == len(rows)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    got = {r.doc_id: r for r in got}
    for (d, t), w in zip(rows, want, strict=True):
        r = got[d]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(w[k]) for k in KINDS[:3]), t
        assert r.base_sha256 == hashlib.sha256(listed(w, KINDS[:3]).encode()).hexdigest()
        assert r.spans == listed(w, KINDS)
    assert sum(r.n_random for r in got.values()) > 15 and got[11].n_random == 0 and got[14].n_random == 0 and got[15].n_random == 0
    assert secrets.secrets(df.limit(0)).count() == 0


def test_random_strings_are_found_among_a_thousand_written_ones_each(spark):
    """One secret to 1,000 distinct written strings (camel case, paths, snake
    case, dates, numbered names); words of both come from the same texts."""
    rng = random.Random(12)
    draw = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    prose = [brute.make_text(rng, 400).replace("é", "e") for _ in range(40)]
    names = sorted({w for t in prose for w in re.findall("[a-z]{3,9}", t)} | set("the value index session handler buffer remote config version "
            "update customer account network thread manager service request response parser builder factory context default library".split()))
    shapes = (lambda w: "".join(x.capitalize() for x in w), "_".join, "/".join, lambda w: "-".join(w).upper(), "".join,
              lambda w: w[0] + "".join(x.capitalize() for x in w[1:]) + str(rng.randrange(100)),
              lambda w: "_".join(w) + f"-20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}")
    written = set()
    while len(written) < 50_000:
        s = rng.choice(shapes)([rng.choice(names) for _ in range(rng.randint(3, 8))])
        if len(s) >= 20:
            written.add(s)
    alphabets = {"hex": 2, "base32": 5, "base36": 6, "base62": 8, "base64": 9}
    planted = [(e, n, draw(secrets.ENCODINGS[i][1], n)) for _ in range(2) for e, i in alphabets.items() for n in (20, 24, 32, 40, 64)]
    joined = sorted(written)
    rows = [(i, " ".join(joined[i::500])) for i in range(500)] + [(1000 + i, t) for i, t in enumerate(prose)]
    rows += [(2000 + i, "key " + s + " ") for i, (_, _, s) in enumerate(planted)] + [(3000 + i, joined[0]) for i in range(50)]
    got = {r.doc_id: r.n_random for r in secrets.secrets(spark.createDataFrame(rows, DOCS).repartition(8)).collect()}
    hits = [got[2000 + i] for i in range(len(planted))]
    assert sum(n for d, n in got.items() if d < 2000 or d >= 3000) <= 0.01 * sum(hits) + 1
    share = lambda test: [h for (e, n, _), h in zip(planted, hits, strict=True) if test(e, n)]
    of = {n: sum(share(lambda _, m, n=n: m == n)) for n in (20, 24, 32, 40, 64)}
    # of 10 each; the uniform tests reject one in a hundred at any length
    assert of[24] > 0 and of[32] > 5, of
    assert sum(share(lambda e, n: n >= 32)) >= 0.9 * len(share(lambda e, n: n >= 32)), of


def test_empty_and_wordless_texts_leave_the_chain_flat(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a bc d")], DOCS)
    assert secrets.writing(df) == [0] * 64
    # "vo" and "we" in each of three words
    assert secrets.writing(spark.createDataFrame([(1, "vowelous " * 3 + "x" * 20)], DOCS))[8 * 2 + 0] == 6
    got = secrets.secrets(df.withColumn("_runs_of", F.lit(1)).withColumn("candidates", F.lit(2))).collect()
    assert [(r.spans, r.n_random) for r in got] == [("", 0)] * 3


@pytest.mark.parametrize("z", [-9.0, -3.0, -0.5, 0.0, 0.7, 2.5])
def test_normal_tail(spark, z):
    got = spark.range(1).select(F.expr(secrets._phi(f"cast({z} as double)"))).first()[0]
    assert got == pytest.approx(phi(z), rel=2e-3, abs=1e-12)
