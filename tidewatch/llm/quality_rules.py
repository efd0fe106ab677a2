"""Rule bitmask ledger: every rule is evaluated once per document.

The ledger keeps the measurements a rule looks at and one failure bit per
rule. A policy is a version and the set of rules it enforces, so a changed
policy is a bitwise test on the stored ledger, not another pass over texts.
Ablations (what each rule rejects, and what it alone rejects) come from the
counts per distinct bit pattern: at most 2^rules rows, whatever the corpus.

Defined results: a null or empty text has no words and no symbols (all
measurements 0) and fails ``few_words``. Rows are judged one by one, so
repeated rows and repeated ids give repeated results, an empty table none.
A null id stays null. Very long texts are measured whole, in memory that is
linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import col, fresh

#: Window of the repetition rule, in words.
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper", "n_letters", "n_stutter")

#: Rules in bit order: name -> SQL over the measurements, true when it fails.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "shouting": "n_words >= 10 and 2 * n_upper > n_letters",
    "stutter": "100 * n_stutter > 30 * n_words",
    "short_words": "n_words >= 10 and word_chars < 2 * n_words",
    "long_words": "n_words >= 10 and word_chars > 40 * n_words",
    "dup_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
}
#: The two rules that every policy enforces.
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version and the rules it enforces (the base rules always)."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r in (*BASE, *self.rules))


POLICIES = {p.version: p for p in (
    Policy("base-1", ()),
    Policy("prose-1", ("symbols", "shouting", "stutter", "short_words", "long_words")),
    Policy("strict-1", tuple(RULES)),
)}
DEFAULT_POLICY = "prose-1"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by a window that occurs twice or more in ``words``.

    Windows are numbered exactly, without hashing: word ids, then ranks of
    pairs, of pairs of pairs, and so on up to the window."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    v = len(number)
    if v == len(words):
        return 0
    if v ** window < 2 ** 62:
        code = ids[:n].copy()
        for k in range(1, window):
            code = code * v + ids[k:k + n]
    else:
        code = ids[:n]
        for k in range(1, window):
            code = np.unique(code, return_inverse=True)[1] * v + ids[k:k + n]
    order = np.argsort(code, kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0, 0, 0, 0)
    # code points are the bytes that aren't UTF-8 continuations
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    upper = len(raw) - len(raw.translate(None, UPPER))
    letters = upper + len(raw) - len(raw.translate(None, LOWER))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    stutter = sum(map(bytes.__eq__, words[1:], words))
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words),
            len(lines), upper, letters, stutter)


@F.arrow_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def _measure_udf(texts: pa.Array) -> pa.Array:
    rows = np.array([measure(t.as_py()) for t in texts], np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], list(MEASURES))


def fail_bits(field=lambda m: m) -> str:
    """SQL of the failure bits; ``field`` maps a measurement to its SQL name."""
    import re
    out = []
    for i, sql in enumerate(RULES.values()):
        named = re.sub(r"\b(n_\w+|word_chars)\b", lambda m: field(m[0]), sql)
        out.append(f"case when {named} then {1 << i}L else 0L end")
    return " | ".join(f"({x})" for x in out)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the measurements and ``fail_bits`` of every document."""
    x = docs.select(col(id_col).alias("doc_id"), _measure_udf(col(text_col)).alias("m")).select("doc_id", "m.*")
    return x.withColumn("fail_bits", F.expr(fail_bits()))


def apply_policy(led: DataFrame, policy: Policy | str = DEFAULT_POLICY) -> DataFrame:
    """Adds ``policy``, ``base_failed`` and ``kept`` by bitwise tests only."""
    p = POLICIES[policy] if isinstance(policy, str) else policy
    base = Policy("", ()).mask
    return led.select("*", F.lit(p.version).alias("policy"),
                      (F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
                      (F.col("fail_bits").bitwiseAND(F.lit(p.mask)) == 0).alias("kept"))


def ablation(led: DataFrame, policy: Policy | str = DEFAULT_POLICY) -> DataFrame:
    """Per enforced rule: documents that fail it, that fail only it (they come
    back if it is dropped), and that the policy without it still rejects."""
    p = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(p.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(i, r) for i, r in enumerate(RULES) if p.mask >> i & 1]
    arms = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in rules])
    x = patterns.select("bits", "n", F.explode(arms).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return x.groupBy("rule").agg(F.lit(p.version).alias("policy"), total(hit).alias("n_failed"),
                                 total(hit & (rest == 0)).alias("n_only"), total(rest != 0).alias("n_rejected_without"))


def keep_documents(docs: DataFrame, policy: Policy | str = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    p = POLICIES[policy] if isinstance(policy, str) else policy
    (m,) = fresh(docs, "measures")
    bits = F.expr(fail_bits(lambda x: f"`{m}`.{x}"))
    return docs.withColumn(m, _measure_udf(col(text_col))) \
               .where(bits.bitwiseAND(F.lit(p.mask)) == 0).drop(m)
