"""Secret scan: known forms, and a randomness test battery for the rest
(DataFrame functions only).

Known forms (``assign``, ``access``, ``hex``) are found by pattern. The battery
takes every run of 20 or more code characters as a candidate, infers the
narrowest encoding that holds it (decimal, hex, base 32, letters, base 36,
base 62, base 64) and tests, against uniform draws from that alphabet:

* chi-squared of the symbol counts (standardised by its exact multinomial mean
  and variance, so short strings over large alphabets are judged fairly);
* Wald-Wolfowitz runs above and below the middle of the alphabet;
* serial correlation of neighbours.

A string that one of these rejects (|z| > ``Z_MAX``) is no uniform draw. Not
being rejected is weak evidence for short strings, so the same three features
are tested once more the other way round, against *writing*, and their p-values
decide:

* symbol counts: the chance that writing of this length repeats as few symbols,
  under the coincidence rate of writing;
* runs: the likelihood ratio, uniform to writing, of where the string goes on
  with the same kind of symbol (lower, upper, digit, mark; vowels and consonants
  for an alphabet of one kind);
* serial dependence: the same ratio of the class of each symbol after the class
  of the one before.

Both ratios take writing as a chain over eight symbol classes (which kind follows
a kind, and which of three classes of letters follows a letter, in either case),
counted over all words of 8 to 19 code characters of the corpus itself and
restricted to the string's encoding; ``HEDGE`` of its symbols may be anything. Under the chain a
ratio exceeds x with a chance of at most 1 / x, whatever the length, so 1 / ratio
is a p-value, and it shrinks as strings grow. Three times the smallest of the
three is the candidate's. Benjamini-Hochberg at level ``FDR`` runs over all
distinct candidates of the corpus, per octave of length, so that a crowd of
short words can't lend its threshold to long strings or the reverse, nor copies
of one string to each other. p-values are rounded up to a fixed grid, which keeps
the procedure valid and its table at ``GRID`` rows an octave whatever the corpus.
Decimal strings have one class, so only their counts can tell them from writing.

Texts are read twice (chain, then scan) and never shuffled: a document's
candidates stay in its row; pairs of classes are counted into 64 sums, and
candidates move as (octave, grid step, hash), counted before they move. Positions come
from the lengths of matches and gaps, summed in blocks, so a document with
very many matches takes linear time.

Defined results: a null text is empty, without spans. Rows are judged one by
one (repeated rows give repeated results; their candidates count once in the
control). A null id stays null. An empty table gives no rows. Columns of any
name besides the two read are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialize

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}",
            "random": "[A-Za-z0-9+/_-]{20,}={0,2}"}
#: Least length of an assigned value.
ASSIGN_VALUE = 6

Z_MAX = 3.5
FDR = 0.01
#: Steps of the p-value grid, STEPS_A_DECADE per factor of 10.
GRID, STEPS_A_DECADE = 1024, 32
BLOCK = 256

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (pattern that holds the whole string, alphabet), narrowest first.
ENCODINGS = (
    ("^[0-9]+$", _DIGITS),
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[a-z]+$", _LOWER),
    ("^[A-Z]+$", _UPPER),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[0-9a-z]+$", _DIGITS + _LOWER),
    ("^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS),
    ("^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
#: Coincidence rate of writing (the chance that two of its symbols are equal):
#: that of letters, or so many times the uniform rate of a small alphabet.
COINCIDENCE, SMALL_ALPHABET, THIRD = 0.066, 1.6, 1.3

#: Symbol classes of the chain of writing: vowels, frequent and other consonants
#: in either case, digits, marks.
CLASSES = ("aeiou", "cdhlmnrst", "bfgjkpqvwxyz", "AEIOU", "CDHLMNRST", "BFGJKPQVWXYZ", _DIGITS, "+/-_")
#: Kind of each class (lower, upper, digit, mark).
KIND_OF = (0, 0, 0, 1, 1, 1, 2, 3)
#: Words that the chain is counted on.
WRITTEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,19}(?![A-Za-z0-9+/_-])"
#: Share of writing's symbols that the chain leaves open.
HEDGE = 0.1
#: Weight, in pairs, of the changes of kind in general.
PRIOR = 10


def _classes(text: str) -> str:
    """SQL of a string of code characters with each replaced by its class's digit."""
    return f"translate({text}, '{''.join(CLASSES)}', '{''.join(str(i) * len(c) for i, c in enumerate(CLASSES))}')"


def writing(docs: DataFrame, text_col: str = "text") -> list[int]:
    """How often a symbol of class ``b`` follows one of class ``a`` in the words
    of all texts, at ``8 * a + b``."""
    words = f"regexp_extract_all(text, '{WRITTEN}', 0)"
    # pairs from even places, then from odd ones; a blank keeps words apart
    x = docs.select(col(text_col).alias("text")).where(F.expr(f"text rlike '{WRITTEN}'"))
    x = x.select(F.expr(_classes(f"array_join({words}, ' ')")).alias("g"))
    x = x.select(F.explode(F.expr("concat(regexp_extract_all(g, '..', 0), regexp_extract_all(substr(g, 2), '..', 0))")).alias("pair"))
    n = [0] * 64
    # 81 pairs at most
    for r in x.groupBy("pair").count().collect():
        if " " not in r.pair:
            n[8 * int(r.pair[0]) + int(r.pair[1])] = r["count"]
    return n


def ratios(counts: list[int]) -> tuple[list[float], list[float]]:
    """Log-likelihood ratios, uniform draws to writing, of (kind runs, classes)
    for each encoding and pair of classes, at ``64 * encoding + 8 * a + b``."""
    seen = lambda test: sum(n for i, n in enumerate(counts) if test(i // 8, i % 8))
    stay = (seen(lambda a, b: KIND_OF[a] == KIND_OF[b]) + 1) / (sum(counts) + 2)
    # kinds change as they do in the corpus; of a kind that it hardly has, as kinds in general
    kinds_after = []
    for u in range(4):
        row = [seen(lambda a, b, u=u, v=v: (KIND_OF[a], KIND_OF[b]) == (u, v)) for v in range(4)]
        kinds_after.append([(n + PRIOR * (stay if u == v else (1 - stay) / 3)) / (sum(row) + PRIOR) for v, n in enumerate(row)])
    # letters follow letters alike in either case
    letters = [[seen(lambda a, b, u=u, v=v: a < 6 and b < 6 and (a % 3, b % 3) == (u, v)) + 1 for v in range(3)] for u in range(3)]
    first = [sum(r[v] for r in letters) / sum(map(sum, letters)) for v in range(3)]

    def after(a: int, b: int) -> float:
        x = kinds_after[KIND_OF[a]][KIND_OF[b]]
        if b < 6:
            x *= letters[a % 3][b % 3] / sum(letters[a % 3]) if a < 6 else first[b % 3]
        return x

    runs, serial = [], []
    for _, alphabet in ENCODINGS:
        inside = [sum(s in alphabet for s in c) for c in CLASSES]
        uniform = [m / len(alphabet) for m in inside]
        kinds = {KIND_OF[i] for i in range(8) if inside[i]}
        kind = [i % 3 == 0 for i in range(8)] if len(kinds) == 1 else KIND_OF
        for a in range(8):
            share = [after(a, b) * inside[b] / len(CLASSES[b]) for b in range(8)]
            chain = [(1 - HEDGE) * w / sum(share) + HEDGE * u for w, u in zip(share, uniform, strict=True)]
            for b in range(8):
                alike = [c for c in range(8) if (kind[c] == kind[a]) == (kind[b] == kind[a])]
                pu, pw = sum(uniform[c] for c in alike), sum(chain[c] for c in alike)
                runs.append(math.log(pu / pw) if pu > 0 else 0.0)
                serial.append(math.log(uniform[b] / chain[b]) if inside[b] else 0.0)
    return runs, serial


def _running(lens: str) -> str:
    """SQL array of the running sums of an array of bigint, in linear time."""
    local = (f"transform(sequence(0, (size({lens}) - 1) div {BLOCK}), b -> "
             f"aggregate(slice({lens}, cast(b * {BLOCK} + 1 as int), {BLOCK}), cast(array() as array<bigint>), "
             f"(acc, x) -> concat(acc, array(coalesce(get(acc, size(acc) - 1), 0L) + x))))")
    total = ("aggregate(l, cast(array() as array<bigint>), (acc, x) -> "
             "concat(acc, array(coalesce(get(acc, size(acc) - 1), 0L) + get(x, size(x) - 1))))")
    return (f"transform(array({local}), l -> transform(array({total}), o -> "
            f"flatten(transform(l, (x, b) -> transform(x, v -> v + coalesce(get(o, b - 1), 0L)))))[0])[0]")


def find(text: str, pattern: str, group: int | None = None) -> str:
    """SQL array of (start, end, token) of the leftmost non-overlapping
    matches; ``token`` is the match or its ``group``."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    gaps, hits = f"split({text}, {p}, -1)", f"regexp_extract_all({text}, {p}, 0)"
    tokens = hits if group is None else f"regexp_extract_all({text}, {p}, {group})"
    # a gap and its hit are one step; their running sum is the hit's end
    steps = "zip_with(slice(m.gaps, 1, size(m.hits)), m.hits, (g, h) -> cast(length(g) + length(h) as bigint))"
    none = "cast(array() as array<struct<start: bigint, end: bigint, token: string>>)"
    spans = (f"transform(array(struct({gaps} as gaps, {hits} as hits, {tokens} as tokens)), m -> "
             f"transform(array({_running(steps)}), e -> transform(e, (x, i) -> "
             f"struct(x - length(m.hits[i]) as start, x as end, m.tokens[i] as token)))[0])[0]")
    return f"case when {text} rlike {p} then {spans} else {none} end"


def _phi(z: str) -> str:
    """SQL of the standard normal distribution's lower tail (a rational
    approximation, relative to the density, so that small tails keep their
    size; error below 1e-7)."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    poly = (f"({t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D)))))")
    tail = f"(exp(- {z} * {z} / 2) * 0.3989422804014327D * {poly})"
    return f"(case when {z} > 0 then 1 - {tail} else {tail} end)"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def battery(token: str, runs_of: str, serial_of: str) -> str:
    """SQL struct (z_chi, z_runs, z_serial, p_written, length, symbols) of a
    token; ``runs_of`` and ``serial_of`` name the arrays of ``ratios``."""
    encoding = "case " + " ".join(f"when t rlike '{p}' then {i}" for i, (p, _) in enumerate(ENCODINGS[:-1])) + f" else {len(ENCODINGS) - 1} end"
    alphabet = "get(array(" + ", ".join(f"'{a}'" for _, a in ENCODINGS) + "), e)"
    n, k = "cast(length(t) as double)", "cast(length(a) as double)"
    squares = "aggregate(s, 0D, (acc, c) -> acc + power(length(t) - length(replace(t, c, '')), 2))"
    chi = f"(q * {k} / {n} - {n})"
    z_chi = f"(({chi} - ({k} - 1)) / sqrt(2 * ({k} - 1) * ({n} - 1) / {n}))"
    high = "translate(t, a, concat(repeat('L', cast(length(a) div 2 as int)), repeat('H', cast(length(a) - length(a) div 2 as int))))"
    n1 = "cast(length(replace(h, 'L', '')) as double)"
    pairs = f"(2 * {n1} * ({n} - {n1}))"
    runs = "(1 + (length(h) - length(replace(h, 'HL', ''))) / 2 + (length(h) - length(replace(h, 'LH', ''))) / 2)"
    spread = f"({pairs} * ({pairs} - {n}) / ({n} * {n} * ({n} - 1)))"
    z_runs = f"(case when {spread} > 0 then ({runs} - ({pairs} / {n} + 1)) / sqrt({spread}) else 99D end)"
    mean = f"(aggregate(x, 0D, (acc, v) -> acc + v) / {n})"
    serial = ("aggregate(zip_with(slice(x, 1, size(x) - 1), slice(x, 2, size(x) - 1), (u, v) -> (u - mu) * (v - mu)), 0D, (acc, v) -> acc + v)")
    power = "aggregate(x, 0D, (acc, v) -> acc + (v - mu) * (v - mu))"
    z_serial = f"(case when {power} > 0 then ({serial} / {power} + 1 / {n}) * sqrt({n}) else 99D end)"
    rate = f"greatest({COINCIDENCE}D, {SMALL_ALPHABET}D / {k})"
    two, three = f"({n} * ({n} - 1) / 2)", f"({n} * ({n} - 1) * ({n} - 2))"
    # pairs of equal symbols, their mean and spread in writing
    found = f"((q - {n}) / 2)"
    sd = f"sqrt({two} * r * (1 - r) + {three} * r * r * {THIRD - 1:.6f}D)"
    p_counts = _let("w", f"(({found} + 0.5D - {two} * r) / {sd})", _phi("w"))
    places = "zip_with(slice(g, 1, size(g) - 1), slice(g, 2, size(g) - 1), (u, v) -> 64 * e + 8 * u + v)"
    summed = lambda name: f"aggregate(o, 0D, (acc, i) -> acc + get({name}, i))"
    codes = f"transform(regexp_extract_all({_classes('t')}, '.', 0), y -> cast(y as int))"
    against = _let("g", codes, _let("o", places, f"least(exp(- {summed(runs_of)}), exp(- {summed(serial_of)}))"))
    p = f"least(1D, 3D * least({p_counts}, {against}))"
    body = (f"struct({z_chi} as z_chi, {_let('h', high, z_runs)} as z_runs, "
            f"{_let('x', 'transform(c, y -> cast(instr(a, y) as double))', _let('mu', mean, z_serial))} as z_serial, "
            f"{_let('r', rate, p)} as p_written, length(t) as length, length(a) as symbols)")
    body = _let("q", squares, body)
    body = _let("s", "split(a, '(?!^)')", _let("c", "regexp_extract_all(t, '.', 0)", body))
    return _let("t", f"regexp_replace({token}, '=+$', '')", _let("e", encoding, _let("a", alphabet, body)))


def step_of(p: str) -> str:
    """SQL grid step of a p-value, rounded towards larger p-values."""
    return f"cast(least({GRID}, greatest(0, floor(- log10(greatest({p}, 1e-300D)) * {STEPS_A_DECADE}))) as int)"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, assign, access, hex`` (arrays of (start, end)) and
    ``candidates`` (start, end, length octave, grid step, passed, hash)."""
    # 2 * 768 numbers, constants of the plan
    tables = ["array(" + ", ".join(f"{v!r}D" for v in r) + ")" for r in ratios(writing(docs, text_col))]
    x = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    spans = {k: find("text", p, 1 if k == "assign" else None) for k, p in PATTERNS.items()}
    spans["assign"] = f"filter({spans['assign']}, m -> length(m.token) >= {ASSIGN_VALUE})"
    x = x.select("doc_id", *[F.expr(s).alias(k) for k, s in spans.items()])
    ends = lambda k: F.transform(k, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    calm = " and ".join(f"abs(b.{z}) <= {Z_MAX}" for z in ("z_chi", "z_runs", "z_serial"))
    tests = _let("b", battery("m.token", "_runs_of", "_serial_of"), f"struct(m.start as start, m.end as end, cast(floor(log2(b.length)) as int) as octave, "
                                          f"{step_of('b.p_written')} as step, ({calm}) as passed, xxhash64(m.token) as hash)")
    x = x.withColumns({"_runs_of": F.expr(tables[0]), "_serial_of": F.expr(tables[1])})
    return x.select("doc_id", *[ends(k).alias(k) for k in KINDS[:3]], F.expr(f"transform(random, m -> {tests})").alias("candidates"))


def thresholds(scanned: DataFrame, fdr: float = FDR) -> DataFrame:
    """``octave, least_step``: Benjamini-Hochberg over all distinct candidates of
    each octave of length. Candidates at or beyond the step are discoveries."""
    from pyspark.sql import Window
    distinct = scanned.select(F.explode("candidates").alias("c")).select("c.octave", "c.step", "c.hash").distinct()
    counts = distinct.groupBy("octave", "step").agg(F.count("*").alias("n"))
    by = Window.partitionBy("octave")
    x = counts.withColumn("at_least", F.sum("n").over(by.orderBy(F.desc("step")))).withColumn("m", F.sum("n").over(by))
    # p of the step <= fdr * rank / m
    ok = -F.col("step") / F.lit(float(STEPS_A_DECADE)) <= F.log10(F.lit(fdr) * F.col("at_least") / F.col("m"))
    return x.where(ok).groupBy("octave").agg(F.min("step").alias("least_step"))


def _span_list(arrays: list[tuple[int, Column]]) -> Column:
    """``kind:start:end`` of all spans, by start, then kind."""
    tag = lambda k: lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"))
    named = [F.transform(a, tag(k)) for k, a in arrays]
    kinds = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(F.array_sort(F.concat(*named)),
                       lambda m: F.concat_ws(":", F.get(kinds, m["kind"]), m["start"].cast("string"), m["end"].cast("string")))
    return F.array_join(text, ",")


def secrets(docs: DataFrame, fdr: float = FDR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random,
    n_candidates`` per document."""
    scanned = materialize(scan(docs, id_col, text_col), "secrets")
    # one row an octave of length: 31 at most
    limits = {r.octave: r.least_step for r in thresholds(scanned, fdr).collect()}
    least = F.lit(GRID + 1)
    keep = lambda c: _step_limit(c["octave"], limits, least)
    found = F.filter("candidates", lambda c: c["passed"] & (c["step"] >= keep(c)))
    found = F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    # a span that a pattern found as it is isn't given twice
    plain = F.concat("hex", "access", "assign")
    code = lambda a: F.transform(a, lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    new = F.transform(F.array_except(code(found), code(plain)), lambda s: F.struct(
        F.substring_index(s, ":", 1).cast("bigint").alias("start"), F.substring_index(s, ":", -1).cast("bigint").alias("end")))
    x = scanned.select("doc_id", "assign", "access", "hex", new.alias("random"), F.size("candidates").alias("n_candidates"))
    base = [(i, F.col(k)) for i, k in enumerate(KINDS[:3])]
    size = lambda k: F.size(k).cast("bigint")
    return x.select("doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
                    F.sha2(_span_list(base).cast("binary"), 256).alias("base_sha256"),
                    _span_list([*base, (3, F.col("random"))]).alias("spans"), size("random").alias("n_random"),
                    F.col("n_candidates").cast("bigint").alias("n_candidates"))


def _step_limit(octave: Column, limits: dict[int, int], none: Column) -> Column:
    out = none
    for o, s in limits.items():
        out = F.when(octave == o, F.lit(s)).otherwise(out)
    return out
